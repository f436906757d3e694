"""Exact deduplication with a split of heavy hitters.

A summary of Misra and Gries in each task finds the digests that may be frequent.
Their exact counts and winners come from one combined pass, and that table, of
bounded size, is broadcast: copies of a frequent text are settled where they lie.
All other digests are rare by the summary's guarantee and take an ordinary
shuffle, in which no group holds more than one row in RARE.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tandem.llm.common import stored

#: Counters of a summary. A digest with more than one row in RARE of the table is always found;
#: at most COUNTERS digests are named (see `frequent`).
COUNTERS = 4096
RARE = COUNTERS // 4


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, digest, row): SHA-256 of each whole text, null as the empty text; `row` tells rows apart.

    Stored, so that row numbers are given once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if normalise:
        text = normalise(text)
    return stored(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


class Summary:
    """Counters of Misra and Gries over the values of Arrow arrays.

    A counter falls short of the true count by at most a (COUNTERS + 1)-th of the rows seen.
    """

    def __init__(self, counters: int = COUNTERS) -> None:
        self.counters, self.rows = counters, 0
        self.table: pa.Table | None = None

    def add(self, values: pa.Array) -> None:
        self.rows += len(values)
        counted = pc.value_counts(values)
        new = pa.table({"digest": counted.field(0), "n": counted.field(1)})
        if self.table is not None:
            new = pa.concat_tables([self.table, new]).group_by("digest").aggregate([("n", "sum")]).rename_columns(["digest", "n"])
        if new.num_rows > self.counters:
            # What the first counter beyond the limit holds is taken off all of them.
            off = pc.sort_indices(new["n"], sort_keys=[("", "descending")])[self.counters]
            left = pc.subtract(new["n"], new["n"][off.as_py()])
            new = new.set_column(1, "n", left).filter(pc.greater(left, 0))
        self.table = new

    def kept(self) -> pa.Table:
        """Counters above a COUNTERS-th of the rows seen."""
        return self.table.filter(pc.greater(pc.multiply(self.table["n"], self.counters), self.rows))


def frequent(keys: DataFrame) -> DataFrame:
    """(digest): every digest with more than rows / RARE rows, and at most COUNTERS digests in all.

    A task's counter is short by at most rows / COUNTERS, and a counter that it
    leaves out holds no more than that; so the sum of a digest's counters is
    short by at most 2 * rows / COUNTERS, half of rows / RARE. Sums above that half
    are named: RARE * 2 of them at most, as sums never exceed true counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary()
        for batch in batches:
            if batch.num_rows:
                summary.add(batch.column(0))
        if summary.table is not None:
            found = summary.kept()
            rows = pa.array([summary.rows] + [0] * found.num_rows, pa.int64())
            n = pa.array([0, *found["n"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([b"", *found["digest"].to_pylist()], pa.binary()), n, rows], names=["digest", "n", "rows"])

    counters = stored(keys.select("digest").mapInArrow(run, "digest binary, n bigint, rows bigint"), "counters")
    rows = counters.agg(F.sum("rows").alias("rows")).first().rows or 0
    sums = counters.where("rows = 0").groupBy("digest").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") * (2 * RARE) > rows).select("digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of every row; of equal texts one row stays, that with the largest id.

    A null text is an empty text; empty texts are equal like others. Null ids are smaller
    than all others, so such a row stays only among its like, and keep_id is null then. Of rows that
    share text and id one stays. `normalise` changes texts before they are
    compared; without it they must be identical. Other columns are not read. An empty
    table gives an empty result.
    """
    keys = digests(docs, id_col, text_col, normalise)
    best = F.max(F.struct("id", "row")).alias("best")
    size = F.count(F.lit(1)).alias("size")
    # At most COUNTERS digests, so each of the two joins may broadcast them.
    named = stored(frequent(keys), "frequent")
    winners = stored(keys.join(F.broadcast(named), "digest").groupBy("digest").agg(best, size), "winners")
    settled = keys.join(F.broadcast(winners), "digest", "left")
    own = W.partitionBy("digest")
    heavy = settled.where(F.col("best").isNotNull())
    rare = settled.where(F.col("best").isNull()).select("id", "digest", "row", F.max(F.struct("id", "row")).over(own).alias("best"), F.count(F.lit(1)).over(own).alias("size"))
    every = heavy.select("id", "digest", "row", "best", "size").unionByName(rare)
    return every.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )
