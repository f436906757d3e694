"""Embedding a text column and pooling subword vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..functions.vectors import find_rows, fold_rows, from_matrix, hashed_bag, item_sums

POOLINGS = ("cls", "mean", "word-level")


def hash_encode(text: Column, width: int = 16) -> Column:
    """Demo encoder: signed hashed bag of words."""
    return hashed_bag(tx.words(text), width)


def batch_infer(
    text: Column, make_predict_fn: Callable, batch_size: int = 64, return_type: T.DataType | None = None
) -> Column:
    """Embed with a caller's model: `make_predict_fn()` loads it once per worker and returns
    a function from an array of texts to a [rows, width] array."""
    udf = predict_batch_udf(
        make_predict_fn, return_type=return_type or T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return udf(text)


def batch_infer_pairs(
    text: Column, text_pair: Column, make_predict_fn: Callable, batch_size: int = 64, return_type: T.DataType | None = None
) -> Column:
    """Embed pairs of texts with a caller's model, loaded once per worker.

    Its function gets two arrays of the same rows, first and second texts, and
    returns a [rows, width] array. A null first text is an empty one; a null
    second text marks a single sentence and reaches the model as None.
    """
    udf = predict_batch_udf(
        make_predict_fn, return_type=return_type or T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return udf(F.coalesce(text, F.lit("")), text_pair)


def check_pooling(pooling: str) -> str:
    if pooling not in POOLINGS:
        raise ValueError(f"pooling {pooling!r} is not one of {POOLINGS}")
    return pooling


def pool_cls(subwords: DataFrame, cls_first: bool = True, key: str = "sent_id", vec: str = "vec") -> DataFrame:
    """Vector of the first subword, or of the last one that is not padding.

    `vec` may name a number that stands for the vector instead (see
    `inputs.subword_refs`): numbers are hashed, while arrays make Spark sort all rows.
    """
    rows = subwords.where(~F.col("is_pad"))
    pick = F.min_by if cls_first else F.max_by
    return rows.groupBy(key).agg(pick(vec, "subword_pos").alias(vec))


def pool_mean(
    subwords: DataFrame, width: int, include_pad: bool = False, key: str = "sent_id", vectors: DataFrame | None = None
) -> DataFrame:
    """Mean over the subwords, padding counted only on request.

    One average per dimension in a single hash aggregate: partial sums leave the
    map side, vectors are neither exploded nor collected. That sums up where the
    subwords of a sentence lie together. Vectors that are still to be found by
    their number come as `vectors` (vec_id, vec), and `subwords` then holds the
    `vec_id` of each row; see `sums_by_id`.
    """
    rows = subwords if include_pad else subwords.where(~F.col("is_pad"))
    if vectors is None:
        means = [F.avg(F.get("vec", F.lit(j)).cast("double")).alias(f"_m{j}") for j in range(width)]
    else:
        rows = sums_by_id(rows, vectors, width, key)
        part = lambda c, j: F.sum(F.get(c, F.lit(j)))
        means = [F.try_divide(part("_sums", j), part("_counts", j)).alias(f"_m{j}") for j in range(width)]
    return rows.groupBy(key).agg(*means).select(key, F.array(*[f"_m{j}" for j in range(width)]).alias("vec"))


#: Vectors that a task holds at a time, and the slices of the subwords, to each of which all vectors are sent.
BLOCK_VECTORS, SLICES = 1 << 17, 16
#: Neighbouring subwords of a sentence that are not dealt to different slices.
STRETCH = 4096


def sums_by_id(subwords: DataFrame, vectors: DataFrame, width: int, key: str = "sent_id") -> DataFrame:
    """(key, _sums, _counts): item sums of the vectors that subwords name by `vec_id`, and the items that were not null.

    A join by `vec_id` would scatter a sentence, and then each subword moves as a
    vector. Here vectors are cut into blocks by a hash, subwords into slices by
    sentence, and a task sums what one slice takes from one block: a sentence
    moves about as one vector per block, a subword as a number. A task holds one
    block, whatever the size of its slice; the subwords stream past it. A key may
    come several times. Ids that `vectors` lacks add nothing; ids that it holds
    several times add each of them.
    """
    number = F.col("vec_id").cast("bigint")
    blocks = max(1, -(-vectors.count() // BLOCK_VECTORS))
    block = F.pmod(F.xxhash64(number), F.lit(blocks)).cast("int") * SLICES
    cut = F.pmod(F.xxhash64(key, F.floor(F.col("subword_pos") / STRETCH)), F.lit(SLICES)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    kind = subwords.schema[key].dataType
    held = vectors.where(number.isNotNull()).select("*", every.alias("_slice")).select(
        (block + F.col("_slice")).alias("_cell"), F.lit(False).alias("_named"), number.alias("vec_id"),
        "vec", F.lit(None).cast(kind).alias(key),
    )
    named = subwords.where(number.isNotNull()).select(
        (block + cut).alias("_cell"), F.lit(True).alias("_named"), number.alias("vec_id"),
        # Empty, as a long run of NULL lists is slow to hand to Arrow.
        F.array().cast(vectors.schema["vec"].dataType).alias("vec"), key,
    )
    cells = held.unionByName(named).repartitionById(blocks * SLICES, "_cell").sortWithinPartitions("_cell", "_named", key)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, table = None, np.zeros(0, np.int64), np.zeros((0, 2 * width))
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            of, is_named = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cell", "_named"))
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (is_named[1:] != is_named[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if start == end:
                    continue
                if of[start] != cell:
                    cell, ids, table, fresh = of[start], ids[:0], table[:0], []
                run = batch.slice(start, end - start)
                numbers = run.column("vec_id").to_numpy(zero_copy_only=False)
                if not is_named[start]:
                    fresh.append((numbers, item_sums(run.column("vec"), width)))
                    if sum(len(n) for n, _ in fresh) > BLOCK_VECTORS:
                        ids, table = fold_rows([(ids, table), *fresh])
                        fresh = []
                    continue
                if fresh:
                    ids, table = fold_rows([(ids, table), *fresh])
                    fresh = []
                at, found = find_rows(ids, numbers)
                if not found.any():
                    continue
                coded = run.column(key).filter(pa.array(found)).dictionary_encode(null_encoding="encode")
                codes, at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at[found]
                # In short stretches, which stay in the cache.
                codes, sums = fold_rows([fold_rows([(codes[i : i + 1024], table[at[i : i + 1024]])]) for i in range(0, len(at), 1024)])
                parts = [coded.dictionary.take(pa.array(codes)), from_matrix(sums[:, :width]), from_matrix(sums[:, width:].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(parts, [key, "_sums", "_counts"])

    out = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.ArrayType(t)) for n, t in (("_sums", T.DoubleType()), ("_counts", T.LongType())))])
    return cells.mapInArrow(apply, out)


def pool_word_first(starts: DataFrame, subwords: DataFrame, key: str = "sent_id", vec: str = "vec") -> DataFrame:
    """Vector of the first subword of each word, or with `vec` the number that stands for it.

    `starts` has (key, word_pos, start); the pair (key, position) is unique, so
    the join spreads evenly however long a sentence is.
    """
    s = starts.withColumnRenamed("start", "subword_pos")
    return s.join(subwords.select(key, "subword_pos", vec), [key, "subword_pos"]).select(key, "word_pos", vec)


def first_subwords(subwords: DataFrame, *keep: str, key: str = "sent_id") -> DataFrame:
    """Word vectors out of a subword table that marks first subwords (see `tokens.subword_table`): a filter, no join.

    `keep` names the vector columns and whatever else comes along.
    """
    return subwords.where("is_first").select(key, "word_pos", *(keep or ("vec",)))


def pool_word_with_cls(
    starts: DataFrame, subwords: DataFrame, cls_first: bool = True, key: str = "sent_id", vec: str = "vec"
) -> DataFrame:
    """Word vectors with the sentence vector in front, at word position 0."""
    cls = pool_cls(subwords, cls_first, key, vec).select(key, F.lit(0).alias("word_pos"), vec)
    word_rows = pool_word_first(starts, subwords, key, vec).withColumn("word_pos", F.col("word_pos") + 1)
    return cls.unionByName(word_rows)


def pool(
    subwords: DataFrame,
    pooling: str,
    *,
    width: int | None = None,
    starts: DataFrame | None = None,
    cls_first: bool = True,
    include_pad: bool = False,
    keep_special_tokens: bool = False,
    vec: str = "vec",
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Pool one subword table in the chosen way.

    `vec` names its vectors, or for `cls` and `word-level` the numbers that stand
    for them; for `mean`, `vectors` holds those that its `vec_id` name.
    """
    check_pooling(pooling)
    if pooling == "cls":
        return pool_cls(subwords, cls_first, vec=vec)
    if pooling == "mean":
        if width is None:
            raise ValueError("mean pooling needs the vector width")
        return pool_mean(subwords, width, include_pad, vectors=vectors)
    if starts is None:
        raise ValueError("word-level pooling needs the word starts")
    if keep_special_tokens:
        return pool_word_with_cls(starts, subwords, cls_first, vec=vec)
    return pool_word_first(starts, subwords, vec=vec)


def width_check(tables: dict[str, DataFrame], vec: str = "vec") -> DataFrame:
    """One row per encoder: smallest and largest vector width, and whether they agree."""
    rows = None
    for name, df in tables.items():
        part = df.agg(
            F.min(F.size(vec)).cast("bigint").alias("min_width"), F.max(F.size(vec)).cast("bigint").alias("max_width")
        ).select(F.lit(name).alias("encoder"), "*", (F.col("min_width") == F.col("max_width")).alias("even"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
