"""The registered queries: one small plan per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrays as ax
from ..operators import batching, combine, embed, heads, labels as lb, metrics as mt, order, splits, stats, tokens
from ..session import scratch_path, spread
from ..sources import ordered, registry as rg, sink, text as src
from . import inputs as inp, models, train as tr
from .inputs import ENC_A, ENC_ALL, ENC_B, ENC_L, ENC_R, LANGS, TAGS, r6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def components(df: DataFrame, vec: str, *keep: str) -> DataFrame:
    """One row per vector item, for comparison: the report form of a vector."""
    return ax.explode_once(df, keep, vec, "j", "value").select(
        *keep, F.col("j").cast("bigint").alias("j"), r6(F.col("value").cast("double")).alias("value")
    )


def listed(values: Column) -> Column:
    """Whole numbers as one text."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


# --- sources and sinks ---------------------------------------------------


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return inp.docs(spark, sf).select("sent_id", "split", "label_raw", inp.flat(F.col("text")).alias("text"))


@query
def src_labeled_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    sink.write_labeled_text(_doc_lines(spark, sf), path, ["sent_id", "label_raw", "text"], split=None)
    df = src.read_labeled_text(spark, path, 1, 2, "Sentence classification", skip_header=False, label_map=LANGS)
    return df.select("label_raw", "label", "text", "sentence_type")


@query
def src_tagged_blocks(spark, sf):
    path = scratch_path(spark, "tagged")
    lines = F.zip_with("words", "gold_tags", lambda w, t: F.concat(w, F.lit(" X Y "), t, F.lit(",O")))
    block = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    inp.tagged(spark, sf).select(block.alias("value")).write.text(path)
    df = src.tagged_good_rows(src.read_tagged_text(spark, path, TAGS))
    return df.select("text", F.size("words").cast("bigint").alias("n_words"), listed(F.col("tags")).alias("tags"))


@query
def src_corpus_splits(spark, sf):
    path = scratch_path(spark, "corpus")
    lines = _doc_lines(spark, sf)
    for split in stats.SPLITS:
        part = lines.where(F.col("split") == split)
        sink.write_labeled_text(part, f"{path}/{split}.csv", ["label_raw", "text"], split=None)
    df = src.read_corpus_dir(spark, path, 0, 1, skip_header=False, label_map=LANGS)
    return df.select("split", "label", "text")


@query
def src_quoted_csv(spark, sf):
    path = scratch_path(spark, "quoted")
    quoted = F.concat(F.lit('"'), F.col("label_raw"), F.lit('", '), F.col("text"))
    sink.write_quoted(inp.docs(spark, sf).select("sent_id", quoted.alias("text")), path)
    df = src.read_quoted(spark, path, {"text": 1, "sent_id": 0}, 2)
    return df.select(F.col("sent_id").cast("bigint").alias("sent_id"), "text")


@query
def src_latin1_lines(spark, sf):
    path = scratch_path(spark, "latin1")
    code = F.get(F.array(*[F.lit(c) for c in rg.QUESTION_CLASSES]), (F.col("sent_id") % 6).cast("int"))
    line = F.concat(code, F.lit(":x "), F.col("text"))
    _doc_lines(spark, sf).select(line.alias("value")).write.csv(
        path, sep="\x01", quote="", escapeQuotes=False, encoding="ISO-8859-1"
    )
    return src.read_questions(spark, path, rg.QUESTION_CLASSES)


@query
def src_gzip_lines(spark, sf):
    parts = {}
    for name in ("documents", "benchmark"):
        path = scratch_path(spark, name)
        df = inp.table(spark, sf, name).select(inp.flat(F.col("text")).alias("text"))
        sink.write_labeled_text(df, path, ["text"], split=None, compression="gzip")
        parts[name] = spark.read.text(path).withColumnRenamed("value", "text")
    return lb.union_sources(parts)


@query
def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "sink")
    df = inp.pairs(spark, sf).withColumn("split", inp.split_rule(F.col("conv_id")))
    flat = df.select("split", "label", inp.flat(F.col("text")).alias("text"), inp.flat(F.col("text_pair")).alias("text_pair"))
    sink.write_labeled_text(flat, path, ["label", "text", "text_pair"])
    back = src.parse_lines(spark, path, 0, 1, "Sentence-pair classification", 2, skip_header=False)
    back = src.good_rows(back.withColumn("split", F.regexp_extract("_file", "split=([a-z]+)", 1)))
    return back.select("split", "label", "text", "text_pair")


@query
def sink_head_params(spark, sf):
    fitted = _fit(spark, sf, (ENC_ALL,), outputs=10, epochs=1)
    path = scratch_path(spark, "params")
    sink.save_params(spark, fitted.params, path)
    loaded = sink.load_params(spark, path, {n: a.shape for n, a in fitted.params.items()})
    scored = heads.with_prediction(inp.encoder(spark, sf, ENC_ALL), loaded["dec_w"], loaded["dec_b"])
    return scored.select("sent_id", "label", "pred")


@query
def sink_ordered_rows(spark, sf):
    path = scratch_path(spark, "ordered")
    d = inp.docs(spark, sf).select("sent_id", "split", F.regexp_replace("text", r"[\r\n]", " ").alias("text"))
    # The writer sorts by any unique column, so texts move once and places come from the manifest.
    d = d.withColumn("key", F.struct(order.seeded_key("sent_id", 13, 2), "sent_id"))
    ordered.write_ordered_text(d, path, ["sent_id", "text"], "key")
    tab = F.instr("value", "\t")
    return ordered.read_ordered_text(spark, path).select(
        "split", "idx", F.substring_index("value", "\t", 1).cast("bigint").alias("sent_id"),
        F.when(tab > 0, F.substr("value", tab + 1)).alias("text"),
    )


@query
def sink_model_store(spark, sf):
    path = scratch_path(spark, "models")
    fixed = inp.dme_params()
    params = {"attn_w": np.array(fixed.attention), "attn_b": np.array([fixed.attention_bias]), "dec_w": np.array(W10_META), "dec_b": np.array(B10)}
    for i, (w, b) in enumerate(fixed.projections):
        params |= {f"proj_w{i}": np.array(w), f"proj_b{i}": np.array(b)}
    models.save_model(spark, models.Model(tr.HeadSpec([32, 32], 10, "dme"), params, inp.CLASSES), path)
    texts = inp.docs(spark, sf).select("sent_id", "text")
    r = models.load_model(spark, path).predict(inp.aligned(spark, sf).join(texts, "sent_id"))
    return r.select("sent_id", "text", *_shares(2), "prediction", "prediction_name")


@query
def corpus_registry(spark, sf):
    corpora = rg.registry(spark)
    sizes = sorted({len(c.label_map) for c in rg.CORPORA.values() if c.label_map})
    classes = corpora.select(
        "corpus", "task", "label_column", "text_column", F.coalesce("pair_column", F.lit(-1)).alias("pair_column"), "header",
        F.get("metrics", F.lit(0)).alias("main_metric"), F.size("label_map").alias("n_labels"),
        F.explode_outer("label_map").alias("l"),
    )
    # Each document falls in one class of every corpus: counted by id once, then looked up.
    hits = inp.docs(spark, sf).select(
        F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n_labels"), "sent_id"
    ).groupBy("n_labels", (F.col("sent_id") % F.col("n_labels")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    # Corpora without classes and classes without documents stay.
    return classes.select("*", F.col("l.label").alias("label"), F.col("l.id").alias("id")).drop("l").join(
        hits, ["n_labels", "id"], "left"
    ).fillna(0, ["n"]).select(
        "corpus", "task", *[F.col(c).cast("bigint").alias(c) for c in ("label_column", "text_column", "pair_column")],
        "header", "main_metric", "label", "id", "n",
    )


@query
def src_dev_variant(spark, sf):
    base = scratch_path(spark, "mnli")
    p = inp.pairs(spark, sf)
    name = F.get(F.array(*[F.lit(n) for n in rg.CORPORA["mnli"].label_map]), (F.col("conv_id") % 3).cast("int"))
    filler = [F.lit(f"x{i}").alias(f"x{i}") for i in range(8)]
    rows = p.select(
        "conv_id", *filler, inp.flat(F.col("text")).alias("a"), inp.flat(F.col("text_pair")).alias("b"), name.alias("gold")
    )
    files = {"train.tsv": F.col("conv_id") % 3 == 0, "dev_matched.tsv": F.col("conv_id") % 3 == 1,
             "dev_mismatched.tsv": F.col("conv_id") % 3 == 2}
    for file, chosen in files.items():
        rows.where(chosen).drop("conv_id").write.csv(
            f"{base}/glue/MNLI/{file}", sep="\t", header=True, quote="", escapeQuotes=False
        )
    both = [
        rg.load_corpus(spark, "mnli", base, evaluate_on_matched=m).withColumn("matched", F.lit(m)) for m in (True, False)
    ]
    return both[0].unionByName(both[1]).select("matched", "split", "label", "text", "text_pair")


# --- projections and labels ----------------------------------------------


@query
def prj_pair_columns(spark, sf):
    p = inp.pairs(spark, sf)
    line = sink.labeled_line(F.lit("0"), inp.flat(F.col("text")), inp.flat(F.col("text_pair")), F.col("label").cast("string"))
    parsed = src.parse_labeled(p.select("sent_id", line.alias("value")), 3, 1, "Sentence-pair classification", 2)
    return src.good_rows(parsed).select("sent_id", "text", "text_pair", "label")


@query
def prj_sentence_type(spark, sf):
    p = inp.pairs(spark, sf, "left")
    texts = F.filter(F.array("text", "text_pair"), lambda t: t.isNotNull())
    return p.select(
        "sent_id", lb.texts_type(texts).alias("by_number"), lb.sentence_type(F.col("text_pair")).alias("sentence_type")
    )


@query
def flt_nonempty(spark, sf):
    d = inp.docs(spark, sf).select("sent_id", F.explode(F.split("text", "\n")).alias("text"))
    return d.where(lb.nonempty(F.col("text")))


@query
def lbl_encode(spark, sf):
    k = F.col("sent_id")
    raw = (
        F.when(k % 7 == 0, F.col("label_raw"))
        .when(k % 7 == 1, (k % 4).cast("string"))
        .when(k % 7 == 2, "1.0")
        .when(k % 7 == 3, "nan")
        .when(k % 7 == 4, "unknown")
        .when(k % 7 == 5, F.concat(F.lit("1_"), (k % 4).cast("string")))
        .otherwise("1d")
    )
    d = inp.docs(spark, sf).select("sent_id", raw.alias("label_raw"))
    return d.select("*", F.coalesce(lb.encode(F.col("label_raw"), LANGS), F.lit(-1).cast("bigint")).alias("label"))


@query
def lbl_decode(spark, sf):
    d = inp.docs(spark, sf).select("sent_id", (F.col("n_chars") % 5).alias("label"))
    return d.select("*", F.coalesce(lb.decode(F.col("label"), LANGS), F.lit("none")).alias("name"))


@query
def lbl_coarse_split(spark, sf):
    d = inp.docs(spark, sf)
    line = F.concat(F.upper("label_raw"), F.lit(":x "), F.col("text"))
    rows = d.select("sent_id", line.alias("line"))
    return rows.select(
        "sent_id",
        ax.lookup(F.create_map(*[F.lit(x) for n in LANGS for x in (n.upper(), f"language_{n}")]), lb.coarse_label(F.col("line"))).alias("label_raw"),
        lb.after_first_token(F.col("line")).alias("text"),
    )


@query
def lbl_inline_tag(spark, sf):
    d = inp.docs(spark, sf)
    line = F.concat(F.lit("<"), F.col("label_raw"), F.lit(">"), F.col("text"), F.lit("<\\"), F.col("label_raw"), F.lit(">"))
    rows = d.select("sent_id", line.alias("line"))
    return rows.select("sent_id", lb.inline_tag(F.col("line")).alias("label_raw"), lb.without_tags(F.col("line")).alias("text"))


@query
def lbl_first_annotation(spark, sf):
    t = inp.tagged(spark, sf)
    both = F.zip_with("gold_tags", "pred_tags", lambda a, b: F.concat(a, F.lit(","), b))
    firsts = F.transform(both, lb.first_annotation)
    return ax.explode_once(t, ["sent_id"], firsts, "pos", "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def prj_clean_tabs(spark, sf):
    d = inp.docs(spark, sf)
    tabbed = F.when(F.col("sent_id") % 5 == 0, "\t\t").otherwise(F.replace("text", F.lit(" "), F.lit("\t ")))
    clean = d.select("sent_id", lb.without_tabs(tabbed).alias("text"))
    return clean.where(F.col("text") != "")


@query
def lbl_target_choice(spark, sf):
    e = inp.table(spark, sf, "events").select(
        "event_id", F.col("value").alias("valence"), (F.col("event_id") % 100).alias("arousal"), F.col("user_id").alias("dominance")
    )
    targets = ("valence", "arousal", "dominance")
    parts = [lb.choose_target(e, t, targets).withColumn("label_type", F.lit(t.lower())) for t in ("Valence", "arousal")]
    return parts[0].unionByName(parts[1])


@query
def prj_sep_join(spark, sf):
    p = inp.pairs(spark, sf, "left")
    return p.select("sent_id", lb.join_pair(F.col("text"), F.col("text_pair")).alias("text"))


@query
def prj_zip_pairs(spark, sf):
    p = inp.pairs(spark, sf)
    # The shorter side has no partner for the last lines of the longer one.
    zipped = lb.zip_pairs(F.split("text", "\n"), F.split("text_pair", "\n"))
    return ax.explode_once(p, ["sent_id"], zipped, "pos", "x").select(
        "sent_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.text").alias("text"), F.col("x.text_pair").alias("text_pair")
    )


@query
def set_label_union(spark, sf):
    d = inp.table(spark, sf, "documents").select("text")
    b = inp.table(spark, sf, "benchmark").select("text")
    return lb.union_sources({"document": d, "benchmark": b}).select("label_raw", "text")


# --- splits and order ----------------------------------------------------

DEV_N = 30


@query
def split_first_n_per_label(spark, sf):
    d = inp.docs(spark, sf).select("sent_id", "label_raw")
    return splits.first_n_per_label(d, "label_raw", "sent_id", DEV_N)


@query
def split_train_antijoin(spark, sf):
    d = inp.docs(spark, sf).select("sent_id", "label_raw", "text")
    return splits.head_split(d, "label_raw", "sent_id", ["label_raw", "text"], DEV_N).select("sent_id", "split")


@query
def split_head_n(spark, sf):
    e = inp.table(spark, sf, "events").select("event_id", "event_type")
    return splits.head_n(e, "event_id", 800)


@query
def split_by_column(spark, sf):
    e = inp.table(spark, sf, "events").select("event_id", "event_type")
    return splits.by_column(e, "event_type", {"click": "train", "view": "dev", "error": "test"})


@query
def shuffle_epoch_order(spark, sf):
    d = inp.docs(spark, sf).select("sent_id")
    parts = [order.with_epoch_order(d, "sent_id", e, seed=13).withColumn("epoch", F.lit(e)) for e in (1, 2)]
    return parts[0].unionByName(parts[1]).select("epoch", "sent_id", "pos")


@query
def slice_rows(spark, sf):
    e = inp.table(spark, sf, "events").select("event_id", "event_type")
    return order.slice_rows(e, "event_id", 150, 650)


@query
def idx_rows(spark, sf):
    return order.with_row_index(inp.labelled(spark, sf).select("sent_id", "label"), "sent_id")


@query
def idx_file_rows(spark, sf):
    e = inp.table(spark, sf, "events")
    return order.with_file_index(e, "idx", "line_no").select("event_id", "idx", "line_no")


# --- statistics ----------------------------------------------------------


@query
def agg_label_dictionary(spark, sf):
    return stats.label_dictionary(inp.docs(spark, sf))


@query
def agg_tag_dictionary(spark, sf):
    t = inp.tagged(spark, sf)
    return stats.label_dictionary(t.select("split", inp.tag_ids(F.col("gold_tags")).alias("tags")), "tags")


@query
def agg_num_classes(spark, sf):
    return stats.num_classes(inp.labelled(spark, sf))


@query
def agg_split_sizes(spark, sf):
    return stats.split_sizes(inp.docs(spark, sf))


@query
def agg_corpus_statistics(spark, sf):
    s = stats.statistics(inp.docs(spark, sf), "documents", "Sentence classification", label_map=LANGS)
    pair = lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), pair), ",")
    return s.select(
        "name", "task", "train", "dev", "test", F.array_join("metrics", ",").alias("metrics"),
        text("label_frequency").alias("label_frequency"), text("label_map").alias("label_map"),
    )


# --- batches -------------------------------------------------------------


def _batched(df: DataFrame, key: str, size: int = 16) -> DataFrame:
    return batching.assign_batches(order.with_row_index(df, key), size)


@query
def batch_assign(spark, sf):
    return _batched(inp.docs(spark, sf).select("sent_id"), "sent_id").select("sent_id", "batch_id", "pos_in_batch")


@query
def batch_pad_tags(spark, sf):
    t = inp.tagged(spark, sf).select("sent_id", inp.tag_ids(F.col("gold_tags")).alias("tags"))
    padded = batching.pad_by_key(t, _doc_lengths(spark, sf), 16, {"tags": batching.tag_fill()})
    return padded.select("sent_id", "batch_id", listed(F.col("tags")).alias("tags"))


def _doc_lengths(spark, sf) -> DataFrame:
    return inp.doc_words(spark, sf).select("sent_id", F.size("words").alias("n"))


@query
def batch_plan(spark, sf):
    d = inp.docs(spark, sf).where(F.col("split") == "train").select("sent_id")
    return batching.batch_plan(d, 16, 10, 0.1)


@query
def batch_pad_words(spark, sf):
    v = inp.stored_vectors(spark, sf)
    w = embed.first_subwords(inp.subword_refs(spark, sf, v), "ref")
    # One group is one sentence. Numbers follow the order of the vectors.
    per = w.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("word_pos", "ref"))).alias("r"))
    refs = per.select("sent_id", F.transform("r", lambda x: x["ref"]).alias("refs"))
    lengths = inp.turns(spark, sf).select("sent_id", F.size(tokens.words(F.col("text"))).alias("n")).where("n > 0")
    padded = batching.pad_by_key(refs, lengths, 4, {"refs": F.lit(inp.PAD_REF)})
    rows = ax.explode_once(padded, ["sent_id", "batch_id"], "refs", "word_pos", "ref")
    return inp.with_vectors(rows, v, batching.word_fill(ENC_ALL[1])).select(
        "sent_id", "batch_id", F.col("word_pos").cast("bigint").alias("word_pos"), _fixed(F.col("vec")).alias("items")
    )


# --- words and embeddings ------------------------------------------------


@query
def tok_words(spark, sf):
    d = inp.doc_words(spark, sf).drop("split")
    return ax.explode_once(d, ["sent_id"], "words", "word_pos", "word").select(
        "sent_id", F.col("word_pos").cast("bigint").alias("word_pos"), "word"
    )


@query
def tok_subword_counts(spark, sf):
    d = inp.doc_words(spark, sf).drop("split")
    counts = tokens.tokenizer_counts(F.col("words"), _demo_tokenizer)
    zipped = F.arrays_zip(F.col("words").alias("word"), counts.alias("n"))
    return ax.explode_once(d, ["sent_id"], zipped, "pos", "x").groupBy(
        F.col("x.word").alias("word")
    ).agg(F.max("x.n").cast("bigint").alias("n_subwords"), F.count(F.lit(1)).alias("n_occurrences"))


def _demo_tokenizer(words: list[str]) -> list[int]:
    # Each word comes with a leading space; two special tokens are added.
    return [-(-(len(w) - 1) // 4) + 2 for w in words]


@query
def tok_word_starts(spark, sf):
    d = inp.doc_words(spark, sf).drop("split")
    counts = tokens.rule_counts(F.col("words"))
    starts = d.select("sent_id", "words", counts.alias("counts")).withColumn(
        "starts", tokens.word_starts(F.col("counts"))
    )
    return tokens.explode_words(starts.drop("counts"), "words", "starts").where(F.col("starts").isNotNull()).select(
        "sent_id", F.col("word_pos").cast("bigint").alias("word_pos"), "word", F.col("starts").alias("start")
    )


@query
def tok_vocabulary(spark, sf):
    v = tokens.vocabulary(inp.doc_words(spark, sf), _demo_tokenizer)
    return v.select("word", "word_id", F.col("n_subwords").cast("bigint").alias("n_subwords"), F.col("c").alias("n_occurrences"))


@query
def tok_subword_table(spark, sf):
    t = inp.turns(spark, sf).select("sent_id", tokens.words(F.col("text")).alias("words"))
    encoded = tokens.encode_words(t, tokens.vocabulary(t, _demo_tokenizer))
    s = tokens.subword_table(encoded, "counts", ["words", "word_ids"], pad_to=8)
    return s.select(
        "sent_id", F.col("subword_pos").cast("bigint").alias("subword_pos"), F.col("word_pos").cast("bigint").alias("word_pos"),
        "is_first", "is_pad", F.col("words").alias("word"), F.col("word_ids").alias("word_id"),
    )


@query
def emb_hash_encode(spark, sf):
    d = spread(inp.docs(spark, sf).select("sent_id", "text"), "sent_id")
    return components(d.select("sent_id", embed.hash_encode(F.col("text")).alias("vec")), "vec", "sent_id")


@query
def emb_batch_infer(spark, sf):
    d = spread(inp.docs(spark, sf).select("sent_id", "text"), "sent_id")
    return components(d.select("sent_id", embed.batch_infer(F.col("text"), _demo_model).alias("vec")), "vec", "sent_id")


@query
def emb_pair_infer(spark, sf):
    p = inp.pairs(spark, sf, "left").select("sent_id", "text", "text_pair")
    return components(p.select("sent_id", embed.batch_infer_pairs(F.col("text"), F.col("text_pair"), _demo_pair_model).alias("vec")), "vec", "sent_id")


def _demo_pair_model():
    """Stands in for a caller's model of pairs: lengths of both texts, words of both, and whether there are two."""

    def predict(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        rows = [
            [len(a) / 1000.0, len(b or "") / 1000.0, (len(a.split()) + len((b or "").split())) / 100.0, float(b is not None)]
            for a, b in zip(first, second, strict=True)
        ]
        return np.array(rows, dtype=np.float32)

    return predict


def _demo_model():
    """Stands in for a caller's model: counts, shares and lengths of a text."""

    def predict(texts: np.ndarray) -> np.ndarray:
        rows = []
        for t in texts.ravel():
            ws = t.split()
            rows.append([len(t) / 1000.0, len(ws) / 100.0, len(t) / max(1, len(ws)), float(t.count("e"))])
        return np.array(rows, dtype=np.float32)

    return predict


@query
def pool_cls(spark, sf):
    v = inp.stored_vectors(spark, sf)
    s = inp.subword_refs(spark, sf, v)
    parts = [embed.pool_cls(s, first, vec="ref").withColumn("cls_first", F.lit(first)) for first in (True, False)]
    return components(inp.with_vectors(parts[0].unionByName(parts[1]), v), "vec", "cls_first", "sent_id")


@query
def pool_mean(spark, sf):
    s = inp.subword_ids(spark, sf)
    v = inp.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", ENC_ALL[0] + 1, ENC_ALL[1]).alias("vec"))
    parts = [
        embed.pool(s, "mean", width=ENC_ALL[1], include_pad=pad, vectors=v).withColumn("include_pad", F.lit(pad)) for pad in (True, False)
    ]
    return components(parts[0].unionByName(parts[1]), "vec", "include_pad", "sent_id")


def _fixed(vec: Column) -> Column:
    """All items of a vector as one text, in ten-thousandths."""
    return listed(F.transform(vec, lambda v: F.round(v.cast("double") * 10000).cast("bigint")))


def _word_items(df: DataFrame, vec: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.col("word_pos").cast("bigint").alias("word_pos"), _fixed(F.col(vec)).alias("items"))


@query
def pool_word_first(spark, sf):
    v = inp.stored_vectors(spark, sf)
    pooled = embed.pool(inp.subword_refs(spark, sf, v), "word-level", starts=inp.word_starts(spark, sf), vec="ref")
    return _word_items(inp.with_vectors(pooled, v), "vec", "sent_id")


@query
def pool_word_with_cls(spark, sf):
    v = inp.stored_vectors(spark, sf)
    pooled = embed.pool(
        inp.subword_refs(spark, sf, v), "word-level", starts=inp.word_starts(spark, sf), keep_special_tokens=True, vec="ref"
    )
    return _word_items(inp.with_vectors(pooled, v), "vec", "sent_id")


@query
def emb_width_check(spark, sf):
    return embed.width_check({n: inp.encoder(spark, sf, e) for n, e in (("all", ENC_ALL), ("left", ENC_L), ("right", ENC_R))})


# --- combining -----------------------------------------------------------


@query
def cmb_align(spark, sf):
    a = inp.aligned(spark, sf, ENC_ALL, ENC_L, ENC_R)
    return a.select("sent_id", "label", *[_fixed(F.col(f"vec_{i}")).alias(f"items_{i}") for i in (1, 2, 3)])


@query
def cmb_project(spark, sf):
    p = inp.dme_params((40, 24))
    a = inp.aligned(spark, sf, ENC_L, ENC_R)
    parts = [
        a.select("sent_id", F.lit(i + 1).alias("encoder"), combine.project(F.col(f"vec_{i + 1}"), w, b).alias("vec"))
        for i, (w, b) in enumerate(p.projections)
    ]
    return components(parts[0].unionByName(parts[1]), "vec", "encoder", "sent_id")


@query
def cmb_layer_norm(spark, sf):
    a = inp.encoder(spark, sf, ENC_ALL)
    normed = combine.layer_norm(F.col("vec"), inp.attention(64), inp.biases(64))
    return components(a.select("sent_id", normed.alias("vec")), "vec", "sent_id")


@query
def cmb_concat(spark, sf):
    c = combine.combine(inp.aligned(spark, sf, ENC_L, ENC_R), ["vec_1", "vec_2"], "concat")
    return components(c, "vec", "sent_id")


@query
def cmb_mean(spark, sf):
    c = combine.combine(inp.aligned(spark, sf, ENC_L, ENC_R), ["vec_1", "vec_2"], "mean", inp.dme_params((40, 24)))
    return components(c, "vec", "sent_id")


def _shares(n: int) -> list[Column]:
    return [r6(F.get("dme_scores", F.lit(i))).alias(f"dme_{i + 1}") for i in range(n)]


@query
def cmb_dme_weights(spark, sf):
    a = inp.aligned(spark, sf, ENC_A, ENC_B)
    w = combine.dme_weights([F.col("vec_1"), F.col("vec_2")], inp.attention(32), 0.1)
    return a.select("sent_id", w.alias("dme_scores")).select("sent_id", *_shares(2))


@query
def cmb_dme(spark, sf):
    c = combine.combine(inp.aligned(spark, sf, ENC_L, ENC_R), ["vec_1", "vec_2"], "dme", inp.dme_params((40, 24), True))
    return components(c, "vec", "sent_id")


@query
def cmb_dme_words(spark, sf):
    both = inp.word_vectors(spark, sf, ENC_A, ENC_B)
    c = combine.combine(both, ["vec_1", "vec_2"], "dme", inp.dme_params())
    return _word_items(c.select("sent_id", "word_pos", "vec", *_shares(2)), "vec", "sent_id", "dme_1", "dme_2")


@query
def cmb_align_words(spark, sf):
    """Words of two encoders with subwords of their own, put together by sentence and word."""
    tables = [
        inp.word_vectors(spark, sf, dims, chars_per_subword=chars).select("sent_id", "word_pos", "vec") for dims, chars in ((ENC_L, 4), (ENC_R, 3))
    ]
    a = combine.align(tables, ["sent_id", "word_pos"])
    c = combine.combine(a, ["vec_1", "vec_2"], "dme", inp.dme_params((40, 24)))
    return _word_items(c.select("sent_id", "word_pos", "vec", *_shares(2)), "vec", "sent_id", "dme_1", "dme_2")


@query
def rpt_attention(spark, sf):
    a = combine.embed_with_attention(inp.aligned(spark, sf), ["vec_1", "vec_2"], inp.dme_params())
    avg = [r6(F.avg(F.get("dme_scores", F.lit(i)))).alias(f"dme_{i + 1}") for i in (0, 1)]
    return a.groupBy("label").agg(*avg, F.count(F.lit(1)).alias("n"))


# --- heads ---------------------------------------------------------------

W10, B10 = inp.weights(10, 64, 3), inp.biases(10, 3)
#: The head behind two encoders of width 32.
W10_META = inp.weights(10, 32, 3)


def _scored(spark, sf, *keep: str) -> DataFrame:
    e = inp.encoder(spark, sf, ENC_ALL).withColumn("logits", heads.logits(F.col("vec"), W10, B10))
    return e.drop("vec")


@query
def head_logits(spark, sf):
    return components(_scored(spark, sf), "logits", "sent_id")


@query
def head_softmax(spark, sf):
    s = _scored(spark, sf).select("sent_id", heads.softmax(F.col("logits")).alias("p"))
    return components(s, "p", "sent_id")


@query
def head_classify(spark, sf):
    return _scored(spark, sf).select("sent_id", "label", heads.classify(F.col("logits")).alias("pred"))


@query
def head_regress(spark, sf):
    e = inp.encoder(spark, sf, ENC_ALL)
    return e.select("sent_id", r6(heads.regress(F.col("vec"), W10[0], B10[0])).alias("score"))


def _tag_scores(spark, sf) -> DataFrame:
    v = inp.tagged_word_vectors(spark, sf)
    w, b = inp.weights(len(TAGS), ENC_ALL[1], 3), inp.biases(len(TAGS), 3)
    scored = v.withColumn("logits", heads.logits(F.col("vec"), w, b)).drop("vec")
    return scored.withColumn("pred", heads.classify(F.col("logits")))


@query
def head_tag_words(spark, sf):
    return _tag_scores(spark, sf).select("sent_id", F.col("word_pos").cast("bigint").alias("word_pos"), "pred")


@query
def head_classify_with_attention(spark, sf):
    a = inp.aligned(spark, sf)
    s = heads.predict_with_attention(a, ["vec_1", "vec_2"], inp.dme_params(), W10_META, B10)
    return s.select("sent_id", F.col("label").alias("gold"), "pred", *_shares(2))


@query
def rpt_predictions(spark, sf):
    texts = inp.docs(spark, sf).select("sent_id", "text")
    a = inp.aligned(spark, sf).join(texts, "sent_id")
    s = heads.predict(a, ["vec_1", "vec_2"], "dme", inp.dme_params(), W10_META, B10)
    r = heads.prediction_report(s, inp.CLASSES)
    return r.select("sent_id", "text", *_shares(2), "prediction", "prediction_name")


@query
def rpt_word_tags(spark, sf):
    r = heads.word_report(_tag_scores(spark, sf), TAGS)
    text = F.array_join(F.transform("words", lambda x: F.concat_ws("/", x["word"], x["tag"])), " ")
    return r.select("sent_id", text.alias("report"))


def _batch_losses(spark, sf) -> DataFrame:
    return heads.loss_cross_entropy(_batched(_scored(spark, sf), "sent_id"))


@query
def loss_cross_entropy(spark, sf):
    return _batch_losses(spark, sf).select("batch_id", r6(F.col("loss")).alias("loss"))


@query
def loss_mse(spark, sf):
    e = inp.encoder(spark, sf, ENC_ALL)
    rows = e.select("sent_id", heads.regress(F.col("vec"), W10[0], B10[0]).alias("score"), F.col("label").cast("double").alias("target"))
    return heads.loss_squared(_batched(rows, "sent_id")).select("batch_id", r6(F.col("loss")).alias("loss"))


@query
def loss_tags(spark, sf):
    batches = _batched(inp.turns(spark, sf).select("sent_id"), "sent_id", 4).select("sent_id", "batch_id")
    per_sentence = heads.sentence_tag_loss(_tag_scores(spark, sf)).join(batches, "sent_id")
    return per_sentence.groupBy("batch_id").agg(r6(F.avg("loss")).alias("loss"))


# --- metrics -------------------------------------------------------------


def _value(df: DataFrame) -> DataFrame:
    return df.select(r6(F.col("value")).alias("value"))


@query
def met_confusion(spark, sf):
    return mt.confusion(inp.event_pairs(spark, sf))


@query
def met_accuracy(spark, sf):
    return _value(mt.accuracy(inp.event_pairs(spark, sf)))


@query
def met_f1_micro(spark, sf):
    return _value(mt.f1_micro(inp.event_pairs(spark, sf)))


@query
def met_matthews(spark, sf):
    return _value(mt.matthews(inp.event_pairs(spark, sf)))


@query
def met_pearson(spark, sf):
    return _value(mt.pearson(inp.value_pairs(spark, sf)))


@query
def met_spearman(spark, sf):
    return _value(mt.spearman(inp.value_pairs(spark, sf)))


def _padded(spark, sf) -> DataFrame:
    t = inp.tagged(spark, sf)
    ids = t.select("sent_id", inp.tag_ids(F.col("gold_tags")).alias("gold"), inp.tag_ids(F.col("pred_tags")).alias("pred"))
    fills = {"gold": batching.tag_fill(), "pred": F.lit(0).cast("bigint")}
    return batching.pad_by_key(ids, _doc_lengths(spark, sf), 16, fills).select("sent_id", "gold", "pred")


@query
def met_unpad_tags(spark, sf):
    u = mt.unpad(_padded(spark, sf))
    return u.select(
        "sent_id", F.col("word_pos").cast("bigint").alias("word_pos"),
        lb.decode(F.col("gold"), TAGS).alias("gold"), lb.decode(F.col("pred"), TAGS).alias("pred"),
    )


@query
def met_tag_accuracy(spark, sf):
    return _value(mt.tag_accuracy(_padded(spark, sf)))


@query
def met_entity_spans(spark, sf):
    t = inp.tagged(spark, sf)
    parts = [
        ax.explode_once(t, ["sent_id", F.lit(side).alias("side")], mt.entity_spans(F.col(f"{side}_tags")), "k", "s")
        for side in ("gold", "pred")
    ]
    return parts[0].unionByName(parts[1]).select(
        "sent_id", "side", F.col("s.type").alias("type"),
        F.col("s.first").cast("bigint").alias("first_word"), F.col("s.last").cast("bigint").alias("last_word"),
    )


@query
def met_entity_f1(spark, sf):
    return _value(mt.entity_f1(inp.tagged(spark, sf)))


@query
def met_val_loss(spark, sf):
    return _value(mt.validation_loss(_batch_losses(spark, sf)))


@query
def eval_corpus(spark, sf):
    parts = [
        mt.evaluate(inp.event_pairs(spark, sf), "Sentence classification", ["matthews_corr", "accuracy", "f1_score"]),
        mt.evaluate(inp.value_pairs(spark, sf), "Sentence regression", stats.default_metrics("Sentence regression")),
        mt.evaluate(inp.tagged(spark, sf), "Sequence labeling", ["accuracy", "f1_score"], "gold_tags", "pred_tags"),
    ]
    tasks = ("classification", "regression", "labeling")
    out = None
    for task, part in zip(tasks, parts):
        row = part.select(F.lit(task).alias("task"), F.col("rank").cast("bigint").alias("rank"), "metric", r6(F.col("value")).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def _runs(spark, sf) -> DataFrame:
    e = inp.table(spark, sf, "events").select("event_type", "user_id", "value")
    return e.groupBy(F.col("event_type").alias("combo"), (F.col("user_id") % 5).alias("run")).agg(F.avg("value").alias("score"))


@query
def sel_best_epoch(spark, sf):
    e = inp.table(spark, sf, "events").select("user_id", "value")
    # Scores in whole steps, so that the rule for ties matters.
    history = e.groupBy((F.col("user_id") % 20).alias("epoch")).agg(F.floor(F.max("value") / 100).cast("double").alias("score"))
    return mt.best_epoch(history)


@query
def rpt_run_summary(spark, sf):
    s = mt.run_summary(_runs(spark, sf), "click")
    return s.select("combo", "runs", *[r6(F.col(c)).alias(c) for c in ("mean", "deviation", "gain")])


@query
def rpt_progress_loss(spark, sf):
    losses = _batch_losses(spark, sf).select((F.col("batch_id") + 1).alias("batch"), "loss")
    n = inp.encoder(spark, sf, ENC_ALL).agg(F.ceil(F.count(F.lit(1)) / 16)).scalar()
    return mt.progress_loss(losses, n).select("part", r6(F.col("loss")).alias("loss"))


# --- training ------------------------------------------------------------


@query
def fit_lr_schedule(spark, sf):
    s = tr.lr_schedule(batch_plan(spark, sf), tr.LEARNING_RATE)
    return s.select("step", F.round(F.col("lr") * 1e6, 6).alias("lr_millionths"))


def _fit_table(spark, sf, encoders, target: Column) -> DataFrame:
    a = inp.aligned(spark, sf, *encoders)
    vectors = [f"vec_{i + 1}" for i in range(len(encoders))]
    return tr.training_table(a, "sent_id", target, vectors)


def _fit(spark, sf, encoders, outputs: int, method: str = "concat", epochs: int = 5, **settings) -> tr.FitResult:
    table = _fit_table(spark, sf, encoders, F.col("label"))
    train = table.where(F.col("id") % 5 > 0)
    spec = tr.HeadSpec([w for _, w in encoders], outputs, method, settings.pop("layer_norm", False), settings.pop("dropout", 0.0))
    return tr.fit(train, spec, epochs=epochs, learning_rate=settings.pop("learning_rate", 0.05), **settings)


def _fit_predictions(spark, sf, result: tr.FitResult, encoders) -> DataFrame:
    table = _fit_table(spark, sf, encoders, F.col("label"))
    return result.score(table).select("id", F.col("y").alias("gold"), F.col("pred").cast("double").alias("pred"))


@query
def fit_classifier(spark, sf):
    return _fit_predictions(spark, sf, _fit(spark, sf, (ENC_ALL,), 10), (ENC_ALL,))


@query
def fit_regressor(spark, sf):
    return _fit_predictions(spark, sf, _fit(spark, sf, (ENC_ALL,), 1), (ENC_ALL,))


@query
def fit_tagger(spark, sf):
    # Each sentence counts once, whatever its number of words.
    rows = inp.tagged_word_vectors(spark, sf).withColumn("id", F.xxhash64("sent_id", "word_pos"))
    table = tr.training_table(rows, "id", F.col("tag_id"), ["vec"], 1 / F.col("n_words"))
    result = tr.fit(table, tr.HeadSpec([ENC_ALL[1]], len(TAGS)), epochs=3, learning_rate=0.05)
    return result.score(table).select("id", F.col("y").alias("gold"), F.col("pred").cast("double").alias("pred"))


@query
def fit_dme(spark, sf):
    encoders = (ENC_L, ENC_R)
    result = _fit(
        spark, sf, encoders, 10, "dme", layer_norm=True, dropout=0.1, learning_rate=[0.05, 0.02], decoder_learning_rate=0.05,
        use_linear_scheduler=True,
    )
    return _fit_predictions(spark, sf, result, encoders)


def _fit_best(spark, sf) -> tr.FitResult:
    table = _fit_table(spark, sf, (ENC_A, ENC_B), F.col("label"))
    part = F.col("id") % 5
    return tr.fit(
        table.where(part > 1), tr.HeadSpec([32, 32], 10, "concat"), dev=table.where(part == 1), test=table.where(part == 0),
        metrics=["accuracy", "f1_score"], epochs=4, steps_per_epoch=2, learning_rate=0.05,
    )


@query
def fit_eval_best(spark, sf):
    result = _fit_best(spark, sf)
    rows = [(result.best_epoch, m, v) for m, v in result.test]
    return spark.createDataFrame(rows, "best_epoch int, metric string, value double")


@query
def rpt_history(spark, sf):
    return _fit_best(spark, sf).history_table(spark)
