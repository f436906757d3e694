"""From raw documents to token files in five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tandem.llm import jaccard, mixing, positions, simhash, token_files, toxicity
from tandem.llm.common import WORD, stored, table
from tandem.llm.components import components
from tandem.llm.queries import WINDOW, toxicity_model, vocabulary
from tandem.session import scratch_path, ship_package, small

TOXIC = 0.5
#: Near copies: five-word shingles of Jaccard similarity 0.8 differ in about 19 of
#: the 128 bits, with a deviation of 4; the distance of unrelated texts is 64.
#: Such prints only make candidates; a link is a similarity of NEAR or more.
SHINGLE, NEAR_BITS, NEAR = 5, 22, 0.8


def _hash() -> Column:
    return F.xxhash64("text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose id and text hash are not among `keys` (id, h)."""
    keys = small(keys, keys.count())
    same = docs["doc_id"].eqNullSafe(keys["_id"]) & (docs["_h"] == keys["_h2"])
    return docs.join(keys, same, "left_anti").drop("_h")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity_model(spark, docs, sf_dir)
    return toxicity.score(docs, model, score_col="_toxic").where(F.col("_toxic") < TOXIC).drop("_toxic")


def near_groups(docs: DataFrame) -> DataFrame:
    """(key, component_id) of each row: key is (doc_id, h), component_id the smallest key linked with it.

    Components of the fingerprints are candidates. All pairs of different texts
    of a candidate group are compared by their shingle sets.
    """
    keyed = docs.select(F.struct("doc_id", _hash().alias("h")).alias("key"), "text")
    prints = stored(simhash.fingerprints(keyed, "key", shingle=SHINGLE, wide=True), "prints")
    near = simhash.component_ids(prints, "key", NEAR_BITS, wide=True)
    rows = stored(near.select("key", F.col("key.h").alias("h"), F.xxhash64("component_id").alias("c")), "candidates")
    # Rows of one text are copies, whatever their ids; one of them stands for the text.
    distinct = stored(rows.groupBy("c", "h").agg(F.min("key").alias("first")), "texts")
    sizes = distinct.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    doubtful = stored(distinct.join(sizes, "c").select("c", "n", F.col("first.doc_id").alias("_id"), F.col("h").alias("_h2")), "doubtful")
    marked = docs.select("doc_id", "text", _hash().alias("_h"))
    same = marked["doc_id"].eqNullSafe(doubtful["_id"]) & (marked["_h"] == doubtful["_h2"])
    candidates = marked.join(small(doubtful, doubtful.count()), same).select("c", "n", F.col("_h").alias("h"), "text")
    roots = components(jaccard.links(candidates, SHINGLE, NEAR), "h", "near").withColumnRenamed("node", "h")
    rooted = stored(distinct.join(roots, "h", "left").select("h", "first", F.coalesce("root", "h").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("h", "component_id")
    return rows.join(named, "h").select("key", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle sets of Jaccard similarity NEAR: the one with the smallest id."""
    grouped = stored(near_groups(docs), "groups")
    leads = F.col("key") == F.col("component_id")
    lost = grouped.where(~leads).select(F.col("key.doc_id").alias("_id"), F.col("key.h").alias("_h2")).distinct()
    kept = _without(docs.withColumn("_h", _hash()), stored(lost, "lost"))
    # Rows that share id and text lead together; one of them stays.
    twice = stored(grouped.where(leads).groupBy("key").count().where("count > 1").select("key.doc_id", "key.h"), "twice")
    if twice.isEmpty():
        return kept
    ids = twice.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h2"))
    marked = kept.withColumn("_h", _hash())
    same = marked["doc_id"].eqNullSafe(ids["_id"]) & (marked["_h"] == ids["_h2"])
    repeated = marked.join(small(ids, ids.count()), same, "left_semi")
    return _without(marked, ids).unionByName(repeated.dropDuplicates(["doc_id", "_h"]).drop("_h"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    marked = docs.withColumn("_h", _hash())
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_h").cast("string"))
    index = positions.build_index(marked.select(key.alias("key"), "text"), "key")
    found = positions.phrase_spans(index, table(spark, sf_dir, "benchmark"), window=WINDOW)
    hit = stored(found.where(F.size("spans") > 0).select("doc_id").distinct(), "hit")
    parts = F.split("doc_id", r"\|")
    ids = F.when(parts[0] != "", parts[0]).cast(docs.schema["doc_id"].dataType)
    return _without(marked, hit.select(ids.alias("_id"), parts[1].cast("bigint").alias("_h2")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    sized = docs.withColumn("_size", F.regexp_count("text", F.lit(WORD)))
    mixed = mixing.mix(sized, size_col="_size", keep=True)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*").drop("_size")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the token files begins, how long it is and the checksum of its ids."""
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write(docs, folder, vocabulary())
    return token_files.read(spark, folder, manifest)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_ids", token_ids),
]

#: Trained models, fingerprints and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of `sf_dir`."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
