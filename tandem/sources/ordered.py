"""Labelled text whose files keep an order, with a manifest that brings it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.order import with_file_index
from ..session import small
from .sink import labeled_line

MANIFEST = "split string, name string, rows bigint, bytes bigint, first bigint"


def write_ordered_text(
    df: DataFrame, path: str, columns: list[str], order: str, split: str = "split", files: int | None = None
) -> None:
    """Tab-separated lines by split, each split in the order of the unique column `order`.

    Rows are range-partitioned and sorted once by (split, order), and every task
    writes its own run, so the number of a file is its place. The manifest names
    each file with its size, its rows and the position of its first row. It is
    one file and comes last: without it there is no corpus. Texts with a line
    break stop the job. The order column is not written.
    """
    line = labeled_line(*columns)
    line = F.when(line.rlike(r"[\r\n]"), F.raise_error(F.lit("a text with a line break has no line of its own"))).otherwise(line)
    rows = df.select(F.col(split).cast("string").alias("split"), F.col(order).alias("_order"), line.alias("value"))
    by = ("split", "_order")
    placed = (rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)).sortWithinPartitions(*by)
    placed.drop("_order").write.partitionBy("split").text(f"{path}/rows")
    manifest(df.sparkSession, path).coalesce(1).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of `path`, from one pass over the lines; a file of no lines has no row."""
    if not _has_splits(spark, path):
        return spark.createDataFrame([], MANIFEST)
    lines = spark.read.schema("value string, split string").text(f"{path}/rows")
    files = lines.groupBy("split", _name(F.col("_metadata.file_path")).alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.first(F.col("_metadata.file_size")).alias("bytes")
    )
    # part-<task>-<job>.c<file of the task>: numbers, as names of five digits and more do not sort as text.
    at = [F.regexp_extract("name", pattern, 1).cast("bigint") for pattern in (r"^part-(\d+)-", r"[-.]c(\d+)\.")]
    before = Window.partitionBy("split").orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def read_ordered_text(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(split, idx, value): lines with their position in the order of their split; no row is shuffled or sorted.

    A file that is missing, changed in size or not in the manifest stops the
    query; sizes come from the listing, so the check reads no text. An empty
    corpus gives no lines.
    """
    known = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    if not _has_splits(spark, path):
        if not known.isEmpty():
            raise ValueError(f"{path}: the files are not those of the manifest: there are none")
        return spark.createDataFrame([], "split string, idx bigint, value string")
    lines = spark.read.schema("value string, split string").text(f"{path}/rows")
    listed = spark.read.format("binaryFile").load(f"{path}/rows").select(
        F.col("split").cast("string").alias("split"), _name(F.col("path")).alias("name"), F.col("length").alias("size")
    ).where("size > 0")
    if split is not None:
        lines, known, listed = (t.where(F.col("split") == split) for t in (lines, known, listed))
    k, p = known.alias("k"), listed.alias("p")
    same = F.col("k.split").eqNullSafe(F.col("p.split")) & (F.col("k.name") == F.col("p.name"))
    problem = F.raise_error(F.concat(F.lit("the files are not those of the manifest: "), F.coalesce("k.name", "p.name")))
    first = F.when(F.col("k.bytes") == F.col("p.size"), F.col("k.first")).otherwise(problem)
    checked = k.join(p, same, "full").select(
        F.coalesce("k.split", "p.split").alias("_split"), F.coalesce("k.name", "p.name").alias("_name"), first.cast("bigint").alias("_first")
    )
    numbered = with_file_index(lines, "_all", "_line").withColumn("_at", _name(F.col("_file")))
    here = F.col("split").eqNullSafe(F.col("_split")) & (F.col("_at") == F.col("_name"))
    # Every row has a file of the manifest, as a stray file stops the query; left, so that none can go in silence.
    joined = numbered.join(small(checked, known.count()), here, "left")
    idx = F.coalesce(F.col("_first"), F.raise_error(F.lit("a line of a file that is not in the manifest")).cast("bigint")) + F.col("_line")
    return joined.select("split", idx.alias("idx"), "value")


def _has_splits(spark: SparkSession, path: str) -> bool:
    # The writer makes one folder per split, and none for an empty table.
    return "split" in spark.read.format("binaryFile").load(f"{path}/rows").columns


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
