"""Corpus statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import explode_once

SPLITS = ("train", "dev", "test")

# Metrics used when a corpus names none.
DEFAULT_METRICS = {
    "classification": ("accuracy", "f1_score"),
    "regression": ("spearmanr", "pearsonr"),
    "labeling": ("f1_score",),
}


def default_metrics(task: str) -> tuple[str, ...]:
    for kind, metrics in DEFAULT_METRICS.items():
        if kind in task:
            return metrics
    raise ValueError(f"no default metrics for task {task!r}")


def labelled_splits(df: DataFrame) -> DataFrame:
    """Rows whose labels count: train and dev, never test."""
    return df.where(F.col("split").isin("train", "dev"))


def label_dictionary(df: DataFrame, label: str = "label") -> DataFrame:
    """Count of each label (or each tag, if the column holds arrays) over train and dev."""
    rows = labelled_splits(df)
    kind = df.schema[label].dataType.typeName()
    if kind == "array":
        rows = explode_once(rows, [], label, "_pos", "label")
    else:
        rows = rows.select(F.col(label).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def num_classes(df: DataFrame, label: str = "label", task: str = "Sentence classification") -> DataFrame:
    """Number of labels seen in train and dev; 1 for regression."""
    if "regression" in task:
        return df.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("num_classes"))
    return label_dictionary(df, label).agg(F.count(F.lit(1)).alias("num_classes"))


def split_sizes(df: DataFrame) -> DataFrame:
    """One row: rows per split and the line `train x + dev y + test z`."""
    sizes = df.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    line = F.concat_ws(" + ", *[F.concat_ws(" ", F.lit(s), F.col(s).cast("string")) for s in SPLITS])
    return sizes.withColumn("line", line)


def statistics(
    df: DataFrame,
    name: str,
    task: str,
    metrics: Sequence[str] | None = None,
    label_map: Mapping[str, int] | None = None,
    label: str = "label",
) -> DataFrame:
    """One row that describes a corpus. Label counts are kept for classification only."""
    by_label = df.groupBy("split", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counted = F.col("split").isin("train", "dev")
    sizes = [F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s) for s in SPLITS]
    # (split, label) pairs are already counted: what is collected is one entry per class.
    per_label = by_label.groupBy("label").agg(
        *sizes, F.sum(F.when(counted, F.col("n"))).alias("n")
    )
    if "classification" in task:
        entries = F.collect_list(F.when(F.col("n").isNotNull(), F.struct("label", "n")))
        frequency = F.map_from_entries(F.array_sort(entries))
    else:
        frequency = F.lit(None).cast("map<bigint,bigint>")
    map_parts = [F.lit(x) for pair in (label_map or {}).items() for x in pair]
    return per_label.agg(
        *[F.sum(s).alias(s) for s in SPLITS], frequency.alias("label_frequency")
    ).select(
        F.lit(name).alias("name"),
        F.lit(task).alias("task"),
        *SPLITS,
        F.array(*[F.lit(m) for m in (metrics or default_metrics(task))]).alias("metrics"),
        "label_frequency",
        (F.create_map(*map_parts) if map_parts else F.lit(None).cast("map<string,int>")).alias("label_map"),
    )
