"""Train/dev splits by label counts, by position and by column."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from ..session import small
from .order import range_buckets, slice_rows

def first_n_keys(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """(label, key) of the first `n` rows of each label, in the order of a numeric key.

    One label may hold most of the rows, so no label is sorted as a whole: rows
    are counted by label and range bucket, running totals tell which buckets
    begin before position `n`, and only rows of those are ranked, each in its
    bucket. The plan is the same for every `n`; only the two key columns move.
    """
    bucket = [label, "_cell", "_sub"]
    placed = range_buckets(df.select(label, key), key)
    counts = placed.groupBy(*bucket).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(label).orderBy("_cell", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).where(F.col("_before") < n)
    same = reduce(and_, (F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in bucket))
    touched = placed.alias("p").join(before.alias("b"), same).select("p.*", "_before")
    ranked = touched.withColumn("_rank", F.row_number().over(Window.partitionBy(*bucket).orderBy(key)))
    return ranked.where((F.col("_rank") <= n) & (F.col("_before") + F.col("_rank") <= n)).select(label, key)


def first_n_per_label(df: DataFrame, label: str, key: str, n: int, max_labels: int | None = None) -> DataFrame:
    """The dev rows: first `n` of each label. `max_labels` bounds the number of labels, if known."""
    keys = first_n_keys(df, label, key, n).select(key)
    return df.join(small(keys, max_labels and max_labels * n), key, "left_semi")


def minus_by_value(df: DataFrame, other: DataFrame, values: list[str], max_other: int | None = None) -> DataFrame:
    """Rows of `df` whose values differ from those of every row of `other`; duplicates in `df` stay.

    Values are compared by SHA-256, so that the side sent around has a fixed
    width however long the texts are. NULL equals NULL.
    """
    digest = [F.sha2(F.col(v).cast("string"), 256).alias(f"_d{i}") for i, v in enumerate(values)]
    left = df.select("*", *digest).alias("l")
    right = small(other.select(*digest).distinct(), max_other).alias("r")
    same = reduce(and_, (F.col(f"l._d{i}").eqNullSafe(F.col(f"r._d{i}")) for i in range(len(values))))
    return left.join(right, same, "left_anti").select(*[F.col(f"l.{c}") for c in df.columns])


def head_split(
    df: DataFrame, label: str, key: str, values: list[str], n: int, max_labels: int | None = None
) -> DataFrame:
    """Add `split`: dev = first `n` rows per label, train = rows not equal by value to a dev row."""
    dev = first_n_per_label(df, label, key, n, max_labels)
    train = minus_by_value(df, dev, values, max_labels and max_labels * n)
    return dev.withColumn("split", F.lit("dev")).unionByName(train.withColumn("split", F.lit("train")))


def head_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Add `split`: the first `n` rows in key order are dev, the rest train.

    Only the key at position n-1 is looked up; the rows themselves do not move.
    With n of 0 or less every row is train; with n above the number of rows, dev.
    """
    if n <= 0:
        return df.withColumn("split", F.lit("train"))
    last = slice_rows(df.select(key), key, n - 1, n).agg(F.max(key)).scalar()
    return df.withColumn("split", F.when(last.isNull() | (F.col(key) <= last), "dev").otherwise("train"))


def by_column(df: DataFrame, column: str, splits: dict[str, str]) -> DataFrame:
    """Add `split` from a column (value -> split name); rows with other values are dropped."""
    from ..functions.arrays import lookup

    parts = [F.lit(x) for pair in splits.items() for x in pair]
    return df.where(F.col(column).isin(*splits)).withColumn("split", lookup(F.create_map(*parts), F.col(column)))
