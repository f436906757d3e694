"""Writers: labelled text, bucketed tables, head parameters."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def labeled_line(*columns: str | Column) -> Column:
    """Columns joined by tabs, NULL left out."""
    return F.concat_ws("\t", *columns)


def write_labeled_text(
    df: DataFrame, path: str, columns: list[str], split: str | None = "split", compression: str | None = None
) -> None:
    """One tab-separated line per row; one folder per split if the split column is given."""
    line = labeled_line(*columns).alias("value")
    keep = [split] if split else []
    writer = df.select(*keep, line).write.mode("errorifexists")
    if split:
        writer = writer.partitionBy(split)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_quoted(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.csv(path, sep=sep, header=header, quote='"', escape='"', emptyValue="", nullValue="")


def write_corpus(df: DataFrame, path: str) -> None:
    """Sentence rows as Parquet by split, so that a filter on the split reads only its files."""
    df.write.partitionBy("split").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "sent_id", buckets: int = 8) -> DataFrame:
    """Embedding table bucketed and sorted by its key; equal buckets join without a shuffle."""
    (
        df.repartition(buckets, key)
        .write.option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .format("parquet")
        .mode("errorifexists")
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def save_params(spark: SparkSession, params: Mapping[str, np.ndarray], path: str) -> None:
    """Parameters as a table (param, i, j, value); vectors have j = 0, scalars i = j = 0.

    Parameters are the one thing that lives on the driver: a few matrices.
    """
    rows = []
    for name, array in params.items():
        a = np.atleast_1d(np.asarray(array, dtype=np.float64))
        a = a[:, None] if a.ndim == 1 else a
        rows += [(name, i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    spark.createDataFrame(rows, "param string, i int, j int, value double").coalesce(1).write.parquet(path)


def load_params(spark: SparkSession, path: str, shapes: Mapping[str, tuple]) -> dict[str, np.ndarray]:
    out = {name: np.zeros(shape) for name, shape in shapes.items()}
    for r in spark.read.parquet(path).collect():
        a = out[r.param]
        if a.ndim == 0:
            out[r.param] = np.array(r.value)
        elif a.ndim == 1:
            a[r.i] = r.value
        else:
            a[r.i, r.j] = r.value
    return out
