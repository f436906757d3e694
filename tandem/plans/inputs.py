"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import explode_once, label_literal, lookup
from ..operators import embed, tokens
from ..operators.combine import CombineParams, align
from ..operators.labels import encode
from ..session import materialize, spread
from ..sources.registry import bio, numbered

LANGS = numbered("de,en,es,fr")
TAGS = bio("PER ORG LOC MISC")
EVENTS = numbered("click,error,purchase,signup,view")
CLASSES = {f"class_{i}": i for i in range(10)}
TURN_SPAN = 1_000_000

# Encoders: the whole stored vector, or two that share it out in equal or unequal parts; start and width.
ENC_ALL = (0, 64)
ENC_A, ENC_B = (0, 32), (32, 32)
ENC_L, ENC_R = (0, 40), (40, 24)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(value: Column) -> Column:
    """Six digits, and no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def split_rule(key: Column) -> Column:
    """Split of a derived corpus: one tenth test, one tenth dev, the rest train."""
    return F.when(key % 10 == 0, "test").when(key % 10 == 1, "dev").otherwise("train")


# --- sentences -----------------------------------------------------------


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sentences labelled by their language."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("sent_id"),
        split_rule(F.col("doc_id")).alias("split"),
        "text",
        F.col("lang").alias("label_raw"),
        lang_id(F.col("lang")).alias("label"),
        "n_chars",
    )


def lang_id(lang: Column) -> Column:
    return encode(lang, LANGS)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a quality label."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return d.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("sent_id"),
        split_rule(F.col("doc_id")).alias("split"),
        "text",
        "lang",
        F.col("quality").cast("bigint").alias("label"),
        F.col("toxic").cast("bigint").alias("toxic"),
    )


def flat(text: Column) -> Column:
    """Text on one line."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * TURN_SPAN + F.col("turn")).alias("sent_id"), "conv_id", "turn", "role", "text")


def pairs(spark: SparkSession, sf: str, how: str = "inner") -> DataFrame:
    """User turns with the assistant turn that follows.

    An equi-join on (conversation, turn) has unique keys, so a conversation that
    holds most of the turns does not become one group.
    """
    t = turns(spark, sf)
    user = t.where(F.col("role") == "user").select("sent_id", "conv_id", "turn", "text")
    answer = t.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_pair")
    )
    return user.join(answer, ["conv_id", "turn"], how).select(
        "sent_id",
        "conv_id",
        "text",
        "text_pair",
        (F.length("text") * 5 > F.length("text_pair")).cast("bigint").alias("label"),
    )


# --- tagged words --------------------------------------------------------


def tag_rule(word: Column, pos: Column, shortest: int, every: int, odd: int | None) -> Column:
    """Demo tag of a word: long words are entities, typed by their length."""
    kind = F.when(F.length(word) % 3 == 0, "PER").otherwise("LOC")
    if odd:
        kind = F.when(pos % odd == 0, "ORG").otherwise(kind)
    prefix = F.when(pos % every == 0, "B-").otherwise("I-")
    return F.when(F.length(word) <= shortest, "O").otherwise(F.concat(prefix, kind))


def gold_rule(word: Column, pos: Column) -> Column:
    return tag_rule(word, pos, 3, 4, None)


def pred_rule(word: Column, pos: Column) -> Column:
    return tag_rule(word, pos, 4, 5, 11)


def tag_ids(names: Column) -> Column:
    mapping = label_literal(TAGS)
    return F.transform(names, lambda t: lookup(mapping, t))


def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as word arrays."""
    d = spread(docs(spark, sf).select("sent_id", "split", "text"), "sent_id")
    return d.select("sent_id", "split", tokens.words(F.col("text")).alias("words"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as word arrays with gold and predicted tag names."""
    d = doc_words(spark, sf)
    return d.select(
        "*",
        F.transform("words", gold_rule).alias("gold_tags"),
        F.transform("words", pred_rule).alias("pred_tags"),
    )


# --- vectors -------------------------------------------------------------


def weights(outputs: int, width: int, shift: int = 0) -> list[list[float]]:
    """Fixed pseudo-random matrix."""
    return [[(((i + shift) * 31 + j * 17 + 7) % 23 - 11) / 50.0 for j in range(width)] for i in range(outputs)]


def biases(outputs: int, shift: int = 0) -> list[float]:
    return [(((i + shift) * 5) % 7 - 3) / 10.0 for i in range(outputs)]


def attention(width: int) -> list[float]:
    return [((j * 7) % 11 - 5) / 10.0 for j in range(width)]


def encoder(spark: SparkSession, sf: str, dims: tuple[int, int]) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("sent_id"),
        F.slice("embedding", dims[0] + 1, dims[1]).alias("vec"),
        F.col("label").cast("bigint").alias("label"),
    )


def aligned(spark: SparkSession, sf: str, *encoders: tuple[int, int]) -> DataFrame:
    """(sent_id, vec_1 …, label): the tables of several encoders joined by sentence."""
    return align([encoder(spark, sf, e) for e in encoders or (ENC_A, ENC_B)])


def dme_params(widths: tuple[int, ...] = (32, 32), layer_norm: bool = False) -> CombineParams:
    """Projections to the widest width and attention, from the fixed numbers."""
    meta = max(widths)
    return CombineParams(
        projections=[(weights(meta, d, 5 * i), biases(meta, i)) for i, d in enumerate(widths)],
        attention=attention(meta),
        attention_bias=0.1,
        layer_norm=layer_norm,
        widths=widths,
    )


# --- subwords ------------------------------------------------------------


def turn_words(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with their words, subword counts and word starts, all as arrays."""
    t = spread(turns(spark, sf).select("sent_id", "text"), "sent_id")
    t = t.withColumn("words", tokens.words(F.col("text")))
    t = t.withColumn("counts", tokens.rule_counts(F.col("words")))
    return t.withColumn("starts", tokens.word_starts(F.col("counts")))


def word_starts(spark: SparkSession, sf: str) -> DataFrame:
    return explode_once(turn_words(spark, sf), ["sent_id"], "starts", "word_pos", "start")


def subword_rows(spark: SparkSession, sf: str, chars_per_subword: int = 4) -> DataFrame:
    """One row per subword of a turn, padded to a multiple of 8; the text is parsed here and nowhere else."""
    t = spread(turns(spark, sf).select("sent_id", "text"), "sent_id").select("sent_id", tokens.words(F.col("text")).alias("word"))
    t = t.withColumn("counts", tokens.rule_counts(F.col("word"), chars_per_subword)).withColumn("n_words", F.size("word"))
    return tokens.subword_table(t, "counts", ["word"], ["sent_id", "n_words"], 8)


def subword_ids(spark: SparkSession, sf: str, chars_per_subword: int = 4) -> DataFrame:
    """Subword rows with the `vec_id` of their vector."""
    n_vecs = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return subword_rows(spark, sf, chars_per_subword).withColumn("vec_id", (F.col("sent_id") * 7 + F.col("subword_pos")) % n_vecs)


def subwords(spark: SparkSession, sf: str, *encoders: tuple[int, int], chars_per_subword: int = 4) -> DataFrame:
    """Subword rows with `vec`, or with vec_1 … of several encoders that share their subwords.

    A vector is one of the stored vectors, picked by sentence and position.
    """
    e = table(spark, sf, "embeddings")
    rows = subword_ids(spark, sf, chars_per_subword)
    dims = encoders or (ENC_ALL,)
    names = ["vec"] if len(dims) == 1 else [f"vec_{i + 1}" for i in range(len(dims))]
    cut = [F.slice("embedding", at + 1, width).alias(n) for n, (at, width) in zip(names, dims, strict=True)]
    return rows.join(e.select("vec_id", *cut), "vec_id").drop("vec_id")


def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, ref, vec): the stored vectors with a number for each row, written once.

    `ref` tells rows of one `vec_id` apart and follows the order of their vectors.
    """
    e = table(spark, sf, "embeddings").where(F.col("vec_id").isNotNull())
    cut = e.select("vec_id", F.slice("embedding", ENC_ALL[0] + 1, ENC_ALL[1]).alias("vec"))
    in_order = cut.repartition("vec_id").sortWithinPartitions("vec_id", "vec")
    return materialize(in_order.select("vec_id", F.monotonically_increasing_id().alias("ref"), "vec"), "vectors")


def subword_refs(spark: SparkSession, sf: str, vectors: DataFrame) -> DataFrame:
    """The rows of `subwords` with the `ref` of their vector in its place.

    What groups, joins or pads subwords moves a number of 8 bytes; the vectors come behind it, by `with_vectors`.
    """
    return subword_ids(spark, sf).join(vectors.select("vec_id", "ref"), "vec_id").drop("vec_id")


#: The `ref` of a padded position; those of vectors are not negative.
PAD_REF = -1


def with_vectors(df: DataFrame, vectors: DataFrame, fill: Column | None = None) -> DataFrame:
    """`vec` in place of `ref`; with `fill`, rows of PAD_REF get that vector.

    Such rows take part in the join under negative numbers of their own, so that padding is no hot key.
    """
    vectors = vectors.select("ref", "vec")
    if fill is None:
        return df.join(vectors, "ref").drop("ref")
    padded = F.col("ref") == PAD_REF
    own = -1 - F.pmod(F.xxhash64(*[c for c in df.columns if c != "ref"]), F.lit(1 << 40))
    joined = df.withColumn("ref", F.when(padded, own).otherwise(F.col("ref"))).join(vectors, "ref", "left")
    vec = F.when(F.col("ref") < 0, fill).otherwise(F.col("vec").cast("array<double>"))
    return joined.withColumn("vec", vec).drop("ref")


def word_vectors(spark: SparkSession, sf: str, *encoders: tuple[int, int], chars_per_subword: int = 4) -> DataFrame:
    """(sent_id, word_pos, word, n_words, vec or vec_1 …): words with the vector of their first subword, from one parse."""
    s = subwords(spark, sf, *encoders, chars_per_subword=chars_per_subword)
    return embed.first_subwords(s, "word", "n_words", *[c for c in s.columns if c.startswith("vec")])


def tagged_word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors with the gold tag of the word."""
    name = gold_rule(F.col("word"), F.col("word_pos"))
    return word_vectors(spark, sf).withColumn("tag_id", encode(name, TAGS))


# --- predictions ---------------------------------------------------------


def event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their type as gold label and a sometimes different type as prediction."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    names = F.array(*[F.lit(n) for n in EVENTS])
    other = F.get(names, (F.floor(F.col("event_id") / 3) % 5).cast("int"))
    guess = F.when(F.col("event_id") % 3 == 0, other).otherwise(F.col("event_type"))
    return e.select(F.col("event_type").alias("gold"), guess.alias("pred"))


def value_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their value as gold target and a shifted value as prediction."""
    e = table(spark, sf, "events").select("event_id", "value")
    return e.select(F.col("value").alias("gold"), (F.col("value") + (F.col("event_id") * 37) % 101).alias("pred"))
