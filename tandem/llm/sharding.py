"""Proportional stratified interleaving: shards that all match the mixture of the whole.

Rows are shuffled by a seeded hash and ranked within their source; the rank as
a fraction of the source's rows puts all sources on one line from 0 to 1, and
equal cuts of that line give every shard the same share of every source, to
within one row. Counts of the shards differ by one row at most.

Ranks come from counts of cells: a cell is a source and one of CELLS slices of
the hash, so the rows of even the largest source are ranked in CELLS pieces,
and a piece only adds the number of rows in the slices before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tandem.llm.common import stored, uniform

#: Slices of the hash: a source with 10^10 rows is ranked in pieces of 2.5 million.
CELLS = 4096


def interleave(rows: DataFrame, stratum: str, shards: int, *identity: str, seed: str = "0") -> DataFrame:
    """`rows` with shard, slot and the fractional rank `_at`.

    `identity` names the columns that feed the seeded hash; rows equal in all of
    them may swap places. Null strata are one stratum of their own. An empty
    table gives an empty result.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    draw = uniform(seed, *(F.col(c) for c in identity))
    keyed = stored(rows.withColumns({"_own": own, "_u": draw}).withColumn("_cell", _cell(F.col("_u"))), "keyed")
    total = keyed.count()

    cells = keyed.groupBy("_own", "_cell").agg(F.count("*").alias("_n"))
    in_own = W.partitionBy("_own")
    cells = cells.select(
        "_own",
        "_cell",
        (F.sum("_n").over(in_own.orderBy("_cell")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(in_own).alias("_all"),
    )
    rank = F.row_number().over(W.partitionBy("_own", "_cell").orderBy("_u", *identity))
    ranked = keyed.join(cells, ["_own", "_cell"]).withColumn("_at", (F.col("_before") + rank - F.lit(0.5)) / F.col("_all"))
    ranked = stored(ranked.drop("_cell", "_before", "_all").withColumn("_cell", _cell(F.col("_at"))), "ranked")

    slices = ranked.groupBy("_cell").agg(F.count("*").alias("_n"))
    slices = slices.select("_cell", (F.sum("_n").over(W.orderBy("_cell")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_cell").orderBy("_at", "_own", "_u", *identity)) - 1
    placed = ranked.join(F.broadcast(slices), "_cell").withColumn("_pos", F.col("_before") + place)
    # Integer arithmetic keeps the cuts exact at every size.
    shard = F.expr(f"(_pos * {shards}) div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard.cast("int"))
    return placed.withColumn("slot", (F.col("_pos") - start).cast("long")).drop("_own", "_u", "_cell", "_before", "_pos")


def _cell(u: Column) -> Column:
    return F.least(F.floor(u * CELLS), F.lit(CELLS - 1)).cast("int")
