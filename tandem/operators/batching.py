"""Batches and padding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import pad
from .order import with_row_index

TAG_PAD = -1  # fixed value: tag id of a padded position


def assign_batches(indexed: DataFrame, batch_size: int, index: str = "idx") -> DataFrame:
    """Batch number and place in the batch from a row index; the last batch may be short."""
    return indexed.withColumn("batch_id", F.floor(F.col(index) / batch_size)).withColumn(
        "pos_in_batch", F.col(index) % batch_size
    )


def tag_fill() -> Column:
    return F.lit(TAG_PAD).cast("bigint")


def word_fill(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def _pad_to_batch(df: DataFrame, values: str, fill: Column) -> DataFrame:
    # A batch has at most batch_size rows, so its window stays small.
    longest = F.max(F.size(values)).over(Window.partitionBy("batch_id"))
    return df.withColumn("_longest", longest).withColumn(values, pad(F.col(values), F.col("_longest"), fill)).drop("_longest")


def pad_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Pad tag arrays with -1 to the longest of their batch."""
    return _pad_to_batch(df, tags, tag_fill())


def pad_words(df: DataFrame, width: int, vectors: str = "vectors") -> DataFrame:
    """Pad arrays of word vectors with zero vectors to the longest of their batch."""
    return _pad_to_batch(df, vectors, word_fill(width))


def pad_by_key(
    df: DataFrame, lengths: DataFrame, batch_size: int, values: Mapping[str, Column], key: str = "sent_id", length: str = "n"
) -> DataFrame:
    """Batches in key order, and the arrays `values` (column -> fill) padded to the longest of their batch.

    Only `lengths` (key, length of the longest array of the row) is numbered and
    grouped; the rows with their arrays move once, to meet their batch. A row
    whose key `lengths` lacks is dropped. Adds `batch_id` and `pos_in_batch`.
    """
    numbered = assign_batches(with_row_index(lengths.select(key, F.col(length).alias("_n")), key), batch_size)
    plan = numbered.withColumn("_longest", F.max("_n").over(Window.partitionBy("batch_id"))).drop("_n", "idx")
    joined = df.join(plan, key)
    return joined.withColumns({c: pad(F.col(c), F.col("_longest"), fill) for c, fill in values.items()}).drop("_longest")


def batch_plan(df: DataFrame, batch_size: int, epochs: int, warmup_fraction: float) -> DataFrame:
    """One row: training rows, updates per epoch, all steps and warm-up steps."""
    updates = F.ceil(F.col("n") / batch_size)
    return (
        df.agg(F.count(F.lit(1)).alias("n"))
        .withColumn("updates_per_epoch", updates)
        .withColumn("training_steps", F.col("updates_per_epoch") * epochs)
        .withColumn("warmup_steps", F.ceil(F.col("training_steps") * F.lit(warmup_fraction)))
    )
