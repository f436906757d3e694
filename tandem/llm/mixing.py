"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size gives every document floor(r) whole
copies, which are certain. The words left over are a sample with unequal
probabilities: a document is included with a probability p in proportion to its
size (cut to its four leading bits), and with certainty where that would pass
one, so that the expected words of the sample are the words left over. Documents
are ranked by the odds u / (1 - u) of a reproducible random number divided by the
inclusion odds p / (1 - p), and the first ones are taken until their words fill
what is left. The last document is taken if that brings the sum nearer, so a
source misses its target by at most half of its largest document.

The rank needs no sort of a source: words are summed by slices of the rank, the
slice in which the target is reached is found for each source, and only the rows
of that slice are ordered. Documents taken with certainty have a slice of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tandem.llm.common import stored, uniform
from tandem.session import small

CELLS = 4096
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_COPIES = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """`sizes` (source, source_size), one row a source, with its weight and target.

    Targets share the sum of all sizes by weight, but stop at `most` times the
    size; the excess goes to the others by weight until none is above. In the
    order of cap over weight the capped sources come first, so one pass of
    running sums finds the level of all others. The table has a row for each
    source, so its ordering in one task is small.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("weight", weight).withColumn("_cap", most * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    levels = named.withColumn(
        "_level",
        (F.sum("source_size").over(whole) - F.sum("_cap").over(so_far) + F.col("_cap"))
        / (F.sum("weight").over(whole) - F.sum("weight").over(so_far) + F.col("weight")),
    ).withColumn("_n", F.row_number().over(order))
    free = F.when(F.col("_cap") / F.col("weight") > F.col("_level"), F.struct("_n", "_level"))
    level = F.min(free).over(whole).getField("_level")
    target = F.least(F.col("weight") * level, F.col("_cap").cast("double"))
    return levels.select("source", "source_size", "weight", F.coalesce(target, F.col("_cap").cast("double")).alias("target"))


def size_class(size: Column) -> Column:
    """The size with its four leading bits alone: at most 16 + 8 * 59 classes, none more than an eighth below the size."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - 4, F.lit(0))).cast("long")
    return size - size % unit


def inclusion(classes: DataFrame) -> DataFrame:
    """(source, size_class, p) from (source, size_class, words, rest): the p of one more copy.

    p is c * size_class, or 1 where that is more; c is such that the expected
    words, the sum of p * words, are `rest`. From the largest class on, classes
    are certain until c for the rest leaves all of them at 1 or below. A source
    has at most 488 classes, so its window stays small. Size 0 costs nothing
    and takes part with the share of the source's words that are left over.
    """
    down = W.partitionBy("source").orderBy(F.col("size_class").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum(F.col("size_class").cast("double") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing))
    whole = W.partitionBy("source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = F.try_divide(F.col("rest") - above, weight)
    tried = classes.withColumn("_c", c).withColumn("_share", F.try_divide("rest", F.sum("words").over(whole)))
    # The largest class that is not certain names c for its source.
    first = F.max(F.when(F.col("_c") * F.col("size_class") <= 1, F.struct("size_class", "_c"))).over(whole)
    p = F.when(F.col("size_class") == 0, F.coalesce(F.least("_share", F.lit(1.0)), F.lit(1.0)))
    p = p.when(F.col("size_class") <= first["size_class"], first["_c"] * F.col("size_class")).otherwise(1.0)
    return tried.select("source", "size_class", p.alias("p"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
    keep: bool = False,
) -> DataFrame:
    """(id, size, source, source_size, target, copies): how often the mix takes each row.

    With `keep`, a struct `row` with all columns of `docs` comes along; it isn't
    shuffled but for the rows of the slices that are ordered. Null sources are one source, the last. Rows of size 0 cost nothing;
    no row has more than `most` copies. A source without words has target 0, and its rows
    are taken once. Rows equal in id and size may swap places. An
    empty table gives an empty result.
    """
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size")
    )
    rows = rows.withColumn("_u", uniform(seed, F.col("id"))).withColumn("size_class", size_class(F.col("size")))
    light = stored(rows.drop("row"), "sized")
    rows = rows if keep else light
    classes = stored(light.groupBy("source", "size_class").agg(F.sum("size").alias("words")), "classes")
    goals = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goals = goals.withColumn("_whole", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).cast("long"))
    goals = goals.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    goals = stored(goals, "targets")

    named = goals.select(F.col("source").alias("_source"), F.col("_rest").alias("rest"))
    known = classes.join(small(named, goals.count()), F.col("source").eqNullSafe(F.col("_source")))
    chances = stored(inclusion(known.drop("_source")), "chances")
    chances = chances.withColumnsRenamed({"source": "_source", "size_class": "_class"})
    n_chances = chances.count()

    def ranked(df: DataFrame) -> DataFrame:
        """Rows with their rank `_odds` and its slice; the slices cut odds / (1 + odds) evenly."""
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size_class") == F.col("_class"))
        odds = F.col("_u") / (1 - F.col("_u")) * (1 - F.col("p")) / F.col("p")
        # Nothing is left over where p is 0.
        placed = df.join(small(chances, n_chances), same).withColumn("_odds", F.when(F.col("p") > 0, odds))
        cell = F.floor(F.col("_odds") / (1 + F.col("_odds")) * CELLS).cast("int")
        return placed.withColumn("_cell", F.when(F.col("p") >= 1, -1).otherwise(F.coalesce(cell, F.lit(CELLS)))).drop("_source", "_class")

    cells = ranked(light).groupBy("source", "_cell").agg(F.sum("size").alias("_words"))
    # The slice in which the running sum passes the rest; sources that never pass it have none.
    running = cells.join(goals.select("source", "_rest"), cells["source"].eqNullSafe(goals["source"])).select(
        cells["source"], "_cell", "_words", "_rest"
    )
    running = running.withColumn("_sum", F.sum("_words").over(W.partitionBy("source").orderBy("_cell")))
    edge = running.where(F.col("_sum") > F.col("_rest")).groupBy("source").agg(
        F.min(F.struct("_cell", (F.col("_sum") - F.col("_words")).alias("_before"))).alias("_edge")
    )
    goals = goals.join(edge, goals["source"].eqNullSafe(edge["source"]), "left").select(goals["*"], "_edge.*")
    goals = goals.withColumnsRenamed({"source": "_source", "_cell": "_last"})
    goals = stored(goals, "goals")
    known = ranked(rows).join(small(goals, goals.count()), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    inside = F.coalesce(F.col("_cell") < F.col("_last"), F.lit(True))
    sure = known.where(F.coalesce(F.col("_cell") != F.col("_last"), F.lit(True))).withColumn("_in", inside)
    order = W.partitionBy("source").orderBy("_odds", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    close = known.where(F.col("_cell") == F.col("_last")).withColumn("_sum", F.col("_before") + F.sum("size").over(order))
    close = close.withColumn("_in", F.col("_sum") - F.col("size") / 2 <= F.col("_rest")).drop("_sum")
    # Where nothing is left over, no row is taken once more, whatever it costs.
    once_more = (F.col("_in") & ((F.col("_rest") > 0) | (F.col("source_size") == 0))).cast("long")
    copies = F.least(F.col("_whole") + once_more, F.lit(most).cast("long"))
    return sure.unionByName(close).select(*["row"] * keep, "id", "size", "source", "source_size", "target", copies.alias("copies"))
