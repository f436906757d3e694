"""Global order without ever sorting all rows in one task.

Rows are assigned to ordered buckets, the (small) bucket table gets running
totals, and only then rows are ordered inside their own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import small

#: Cells cut from all rows, pieces cut from a cell (both powers of two), and the rows from which a cell or a piece is crowded.
CELLS, PIECES = 256, 1024
CELL_ROWS = 1 << 20
#: Rows of a table with one row a bucket: pieces of all cells, and the bucket of null keys.
MOST_BUCKETS = CELLS * PIECES + 1


# --- files ---------------------------------------------------------------


def locate(df: DataFrame) -> DataFrame:
    """Add the place of each row in its source files: `_file`, `_block`, `_file_size`, `_mono`.

    `df` must come straight from a file reader (filters are fine).
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_file_size"),
        F.monotonically_increasing_id().alias("_mono"),
    )


def _block_bound(df: DataFrame) -> int:
    # Every file block is one file or one piece of a partition; counted from the
    # file listing and the scan plan, no job runs.
    return len(df.inputFiles()) + 2 * df.rdd.getNumPartitions()


def with_file_index(
    df: DataFrame, index: str = "idx", line: str | None = None, record_bytes: Column | None = None, separator: int = 2
) -> DataFrame:
    """Row number in file order (path, then position), rows staying where they are.

    One narrow pass counts rows per file block; the running totals of that block
    table are joined back. `line` names a second column: the row number inside
    the file. A row without its block (the scan was split differently the
    second time) stops the query instead of getting a wrong number. With
    `record_bytes` (size of a record and its `separator` bytes) the records of a file
    that was split must add up to the file, or the query stops.
    """
    located = locate(df)
    part = F.shiftright("_mono", 33)
    blocks = located.groupBy("_file", "_block", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_mono").alias("_first"),
        F.first("_file_size").alias("_file_size"),
        F.sum(F.lit(0) if record_bytes is None else record_bytes).alias("_bytes"),
    )
    whole_file = Window.partitionBy("_file")
    surplus = F.sum("_bytes").over(whole_file) - F.col("_file_size")
    # The last record of a file may lack its separator.
    tiled = F.lit(True) if record_bytes is None else (F.count(F.lit(1)).over(whole_file) == 1) | surplus.isin(0, separator)
    in_order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_file",
        "_block",
        "_part",
        "_first",
        tiled.alias("_tiled"),
        (F.col("_first") + F.col("_n")).alias("_end"),
        F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_before_in_file"),
    )
    joined = located.withColumn("_part", part).join(
        small(blocks, _block_bound(df)), ["_file", "_block", "_part"], "left"
    )
    inside = F.col("_mono").between(F.col("_first"), F.col("_end") - 1)
    at = (
        F.when(~F.col("_tiled"), F.raise_error(F.lit("records overlap at a file split; read with regroup=True")).cast("bigint"))
        .when(inside, F.col("_mono") - F.col("_first"))
        .otherwise(F.raise_error(F.lit("file blocks changed between two scans; pin the scan split size")).cast("bigint"))
    )
    out = [F.col(c) for c in df.columns] + [(F.col("_before") + at).alias(index)]
    if line:
        out.append((F.col("_before_in_file") + at).alias(line))
    return joined.select(*out, "_file")


# --- keys ----------------------------------------------------------------


def _splitters(k: Column, parts: int) -> Column:
    """Keys that cut a group into `parts` runs of about as many rows: a quantile sketch, merged over partitions.

    Each splitter is off by at most a (4 * parts)-th of the group's rows.
    """
    return F.percentile_approx(k, [i / parts for i in range(1, parts)], 4 * parts)


def _place(k: Column, splitters: Column, parts: int) -> Column:
    """Number of splitters that are not above `k`, by bisection; `parts` is a power of two."""
    steps = F.array(*(F.lit(parts >> i) for i in range(1, parts.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(splitters, at + step - 1) <= k, step).otherwise(0))


def range_buckets(df: DataFrame, key: str, tie: str | None = None) -> DataFrame:
    """Add ordered bucket columns `_cell`, `_sub` for a numeric key; with `tie` also `_tie`.

    Quantiles of all keys cut CELLS cells, quantiles of its own keys cut a cell of more
    than CELL_ROWS rows into pieces. Clumps and outliers change nothing, as
    cuts follow the rows and not the width of a range. Rows of one key share a
    bucket; if those may be many, a numeric second key `tie` cuts such a bucket in
    the same way. Null keys come first, in a cell of their own.
    With up to CELLS * PIECES * CELL_ROWS rows no bucket holds more than 2 * CELL_ROWS of different keys.
    """
    k = F.col(key).cast("double")
    whole = df.agg(F.struct(_splitters(k, CELLS).alias("cuts"), F.count(F.lit(1)).alias("rows"))).scalar()
    placed = df.withColumn("_whole", whole)
    placed = placed.withColumn("_cell", F.when(k.isNull(), -1).otherwise(_place(k, F.col("_whole.cuts"), CELLS)))
    # Without a crowd in the whole table no cell has one, and the sketches stay empty.
    own = F.when(F.col("_whole.rows") > CELL_ROWS, k)
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"), _splitters(own, PIECES).alias("_cuts"))
    placed = placed.drop("_whole")
    # A cell is cut into as many pieces as it has crowds, so that buckets stay few.
    pieces = F.least(F.ceil(F.col("_rows") / CELL_ROWS), F.lit(PIECES)).cast("int")
    cells = cells.select("_cell", pieces.alias("_pieces"), F.when(pieces > 1, F.col("_cuts")).alias("_cuts"))
    joined = placed.join(small(cells, CELLS + 1), "_cell")
    sub = F.floor(_place(k, F.col("_cuts"), PIECES) * F.col("_pieces") / PIECES).cast("int")
    out = joined.withColumn("_sub", F.when(F.col("_cuts").isNotNull(), sub).otherwise(0)).drop("_pieces", "_cuts")
    return out if tie is None else _cut_ties(out, tie)


def _cut_ties(placed: DataFrame, tie: str) -> DataFrame:
    """Add `_tie`: crowded buckets cut once more by a second key. Crowded buckets are not bounded in number, so the join is left open."""
    t = F.col(tie).cast("double")
    bucket = ["_cell", "_sub"]
    crowded = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_rows"), _splitters(t, PIECES).alias("_cuts")).where(F.col("_rows") > CELL_ROWS)
    joined = placed.join(crowded.drop("_rows"), bucket, "left")
    return joined.withColumn("_tie", F.when(F.col("_cuts").isNull(), 0).when(t.isNull(), -1).otherwise(_place(t, F.col("_cuts"), PIECES))).drop("_cuts")


def bucket_totals(df: DataFrame, bucket: list[str], value: Column) -> DataFrame:
    """One row per bucket: `_n`, and `_before` = sum of `value` over all earlier buckets."""
    totals = df.groupBy(*bucket).agg(F.sum(value).alias("_n"))
    before = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def with_prefix_sum(
    df: DataFrame, bucket: list[str], order: list, value: Column, out: str, max_buckets: int | None
) -> DataFrame:
    """Add `out` = sum of `value` over all rows before this one in (bucket, order)."""
    totals = bucket_totals(df, bucket, value).drop("_n")
    inside = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(small(totals, max_buckets), bucket)
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_inside", "_before")
    )


def with_row_index(df: DataFrame, key: str, index: str = "idx") -> DataFrame:
    """Row number (from 0) in the order of a unique numeric key."""
    bucket = ["_cell", "_sub"]
    return with_prefix_sum(
        range_buckets(df, key), bucket, [key], F.lit(1).cast("bigint"), index, MOST_BUCKETS
    ).drop(*bucket)


def slice_rows(df: DataFrame, key: str, start: int, end: int, index: str = "idx") -> DataFrame:
    """Rows at positions start..end-1 of the key order; other buckets are never sorted."""
    bucket = ["_cell", "_sub"]
    placed = range_buckets(df, key)
    totals = bucket_totals(placed, bucket, F.lit(1).cast("bigint"))
    touched = totals.where((F.col("_before") < end) & (F.col("_before") + F.col("_n") > start)).drop("_n")
    inside = Window.partitionBy(*bucket).orderBy(key)
    return (
        placed.join(small(touched, MOST_BUCKETS), bucket)
        .withColumn(index, F.col("_before") + F.row_number().over(inside) - 1)
        .where((F.col(index) >= start) & (F.col(index) < end))
        .drop("_before", *bucket)
    )


def seeded_key(key: str, seed: int, epoch: int | Column) -> Column:
    """md5 text that orders the rows of one epoch; the same for every run and partitioning."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), e.cast("string"), F.col(key).cast("string")))


def with_epoch_order(df: DataFrame, key: str, epoch: int, seed: int, out: str = "pos") -> DataFrame:
    """Position of each row in the order of an epoch.

    Epoch 1 keeps the key order, later epochs are shuffled by the seeded key,
    whose first 4 hex digits give 65,536 even buckets.
    """
    if epoch <= 1:
        return with_row_index(df, key, out)
    keyed = df.withColumn("_key", seeded_key(key, seed, epoch)).withColumn("_bucket", F.substring("_key", 1, 4))
    return with_prefix_sum(
        keyed, ["_bucket"], ["_key", key], F.lit(1).cast("bigint"), out, 1 << 16
    ).drop("_key", "_bucket")
