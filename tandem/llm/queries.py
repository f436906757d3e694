"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tandem.llm import centroids, collocations, exact_dedup, itq, language_model, licenses, mixing, positions, quality, sharding, simhash, token_files, toxicity
from tandem.llm.common import WORD, crc32_of_id, stored, table
from tandem.session import scratch_path

SHARDS = 24
WINDOW = 10


def vocabulary() -> str:
    """Where the byte-level vocabulary lies on the machine that runs this."""
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path("byte_bpe_50k.json"))


def op1_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=4), "prints")
    found = simhash.component_ids(prints, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_elias_fano_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(7)) == 2
    return language_model.score(table(spark, sf_dir, "documents"), held_out)


def op3_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary())
    return token_files.read(spark, folder, manifest)


def op4_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32("text").alias("text_crc32"),
    )
    placed = sharding.interleave(docs, "source", SHARDS, "doc_id", "text_crc32")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op5_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_sentences", F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses")
    )


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).drop("text")
    return _predicted(scored, 0.5)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """The model of the labels whose rows are not held out."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(~_held_out()))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = positions.build_index(table(spark, sf_dir, "documents"))
    found = positions.phrase_spans(index, table(spark, sf_dir, "benchmark"), window=WINDOW)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stored(quality.described(table(spark, sf_dir, "documents")), "described")
    labels = table(spark, sf_dir, "labels").where(~_held_out())
    calibrates = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5)) == 4
    scored = quality.score(described, quality.fit(described, labels, calibrates))
    return _predicted(scored.withColumnRenamed("id", "doc_id"), 0.3)


def op11_misra_gries_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all `documents`; of equal texts the row with the largest id stays."""
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of each language of `documents`."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64-wide `embeddings` in 16 clusters."""
    assigned, found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(assigned, found)


def _held_out() -> Column:
    return F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5)) == 0


def _predicted(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_bk_trees,
        op2_elias_fano_ngrams,
        op3_elias_fano_token_files,
        op4_stratified_interleaving,
        op5_itq_near_duplicates,
        op6_pareto_mixing,
        op7_license_sentences,
        op8_ftrl_toxicity,
        op9_positional_index,
        op10_fourier_quality,
        op11_misra_gries_dedup,
        op12_stream_collocations,
        op13_orchard_clusters,
    )
}
