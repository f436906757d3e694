"""Evaluation metrics as aggregates; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import bind, explode_once
from ..session import small, temporary_tables
from .order import MOST_BUCKETS, range_buckets, with_prefix_sum

HOT_SHARE = 1e-4


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Rows per (gold, pred): at most classes squared, partial counts on the map side."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Share of the rows whose prediction is right; a NULL prediction is a wrong one."""
    return df.agg(F.avg(F.coalesce(F.col(gold) == F.col(pred), F.lit(False)).cast("double")).alias("value"))


def f1_micro(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Micro F1: hits, false alarms and misses summed over the classes; a NULL prediction counts as wrong."""
    hit = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    off = F.sum(F.when(F.col("gold") == F.col("pred"), 0).otherwise(F.col("n")))
    return confusion(df, gold, pred).agg(hit.alias("tp"), off.alias("fp"), off.alias("fn")).select(_f1().alias("value"))


def _f1() -> Column:
    tp = F.col("tp").cast("double")
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + F.col("fp") + F.col("fn")), F.lit(0.0))


def matthews(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Multi-class Matthews correlation, 0 where a denominator is 0."""
    return _class_sums(confusion(df, gold, pred)).select(_matthews().alias("value"))


def _class_sums(conf: DataFrame) -> DataFrame:
    """One row: rows `s`, right ones `c`, and the sums over classes of gold * pred, gold * gold and pred * pred rows."""
    none = F.lit(0).cast("double")
    n = F.col("n").cast("double")
    hit = F.when(F.col("gold") == F.col("pred"), n).otherwise(none)
    sides = F.explode(
        F.array(
            F.struct(F.col("gold").alias("k"), n.alias("t"), none.alias("p"), hit.alias("c")),
            F.struct(F.col("pred").alias("k"), none.alias("t"), n.alias("p"), none.alias("c")),
        )
    )
    per_class = conf.select(sides.alias("x")).groupBy("x.k").agg(
        F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum("x.c").alias("c")
    )
    s, c = F.sum("t"), F.sum("c")
    tp, tt, pp = F.sum(F.col("t") * F.col("p")), F.sum(F.col("t") * F.col("t")), F.sum(F.col("p") * F.col("p"))
    return per_class.agg(s.alias("s"), c.alias("c"), tp.alias("tp"), tt.alias("tt"), pp.alias("pp"))


def _matthews() -> Column:
    s2 = F.col("s") * F.col("s")
    bottom = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), bottom), F.lit(0.0))


def pearson_of(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate; NULL if one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.agg(pearson_of(F.col(gold).cast("double"), F.col(pred).cast("double")).alias("value"))


def _with_ranks(distinct: DataFrame, value: str) -> DataFrame:
    """Add `rank` to a table of distinct values with their row counts `n`."""
    bucket = ["_cell", "_sub"]
    ranked = with_prefix_sum(range_buckets(distinct, value), bucket, [value], F.col("n"), "_less", MOST_BUCKETS)
    return ranked.withColumn("rank", F.col("_less") + (F.col("n") + 1) / 2).drop("_less", *bucket)


def average_ranks(counted: DataFrame, value: str, n: str = "n") -> DataFrame:
    """Rank of each distinct value (ties get their mean rank): `value, c, rank`."""
    distinct = counted.groupBy(value).agg(F.sum(n).alias("n"))
    return _with_ranks(distinct, value).withColumnRenamed("n", "c")


def attach_by_value(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Join `table` (key, c, …; c = rows per key) to `rows`, safe for hot keys.

    Keys with at least 1/10,000 of all rows (there are at most 10,000 of them)
    are broadcast; only the others, none of them hot, are shuffled.
    """
    bound = table.agg(F.sum("c") * HOT_SHARE).scalar()
    hot = table.where(F.col("c") >= bound)
    cold = table.where(F.col("c") < bound)
    hot_bound = round(1 / HOT_SHARE)
    on_hot = rows.join(small(hot, hot_bound), key)
    on_cold = rows.join(small(hot.select(key), hot_bound), key, "left_anti").join(cold, key)
    return on_hot.unionByName(on_cold)


def _pairs(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(g, p, n): distinct pairs of numbers with their rows; pairs with a null are left out."""
    g, p = F.col(gold).cast("double").alias("g"), F.col(pred).cast("double").alias("p")
    return df.select(g, p).dropna().groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


def _pearson_of_pairs(pairs: DataFrame) -> DataFrame:
    n = F.col("n")
    # Centring first keeps the sums of products exact enough.
    x = F.col("g") - pairs.agg(F.try_divide(F.sum(n * F.col("g")), F.sum(n))).scalar()
    y = F.col("p") - pairs.agg(F.try_divide(F.sum(n * F.col("p")), F.sum(n))).scalar()
    sums = pairs.agg(F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    return sums.select(F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))).alias("value"))


def _spearman_of_pairs(pairs: DataFrame, keep) -> DataFrame:
    """Ranks of predictions are joined to the pairs; ranks of gold values are not
    joined at all, because the pairs are summed up per gold value first."""
    p_ranks = keep(average_ranks(pairs, "p"), "ranks").withColumnRenamed("rank", "y")
    # Ranks average (N + 1) / 2; centring first keeps the sums of squares exact enough.
    mid = (pairs.agg(F.sum("n")).scalar() + 1) / 2
    n, y = F.col("n"), F.col("y") - mid
    per_gold = attach_by_value(pairs, p_ranks, "p").groupBy("g").agg(
        F.sum("n").alias("n"), F.sum(n * y).alias("sy"), F.sum(n * y * y).alias("syy")
    )
    x = F.col("rank") - mid
    ranked = _with_ranks(keep(per_gold, "rank-sums"), "g")
    sums = ranked.agg(F.sum(x * F.col("sy")).alias("xy"), F.sum(F.col("n") * x * x).alias("xx"), F.sum("syy").alias("yy"))
    return sums.select(F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))).alias("value"))


def spearman(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Pearson correlation of average ranks.

    Rows collapse to distinct (gold, pred) pairs with counts, which are stored
    until the one value is known; no file stays behind.
    """
    return _correlations(df, ["spearmanr"], gold, pred).select("value")


def _correlations(df: DataFrame, names: Sequence[str], gold: str, pred: str) -> DataFrame:
    """(name, value) of the correlations asked for, all from one table of pairs, read from `df` once."""
    spark = df.sparkSession
    with temporary_tables(spark) as keep:
        pairs = keep(_pairs(df, gold, pred), "pairs")
        made = {"pearsonr": lambda: _pearson_of_pairs(pairs), "spearmanr": lambda: _spearman_of_pairs(pairs, keep)}
        rows = [(name, made[name]().first().value) for name in names]
    return spark.createDataFrame(rows, "name string, value double")


# --- tags ----------------------------------------------------------------


def unpad(df: DataFrame, gold: str = "gold", pred: str = "pred", key: str = "sent_id") -> DataFrame:
    """One row per real word: padded positions (gold -1) are dropped."""
    pairs = F.arrays_zip(F.col(gold).alias("gold"), F.slice(F.col(pred), 1, F.size(gold)).alias("pred"))
    return explode_once(df, [key], pairs, "word_pos", "x").select(
        key, "word_pos", F.col("x.gold").alias("gold"), F.col("x.pred").alias("pred")
    ).where(F.col("gold") != -1)


def tag_accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred", key: str = "sent_id") -> DataFrame:
    return accuracy(unpad(df, gold, pred, key))


def entity_spans(tags: Column) -> Column:
    """Spans of an array of B-x / I-x / O names as `array<struct<type,first,last>>`.

    A span starts at B-x, and at I-x after O or after another type; it ends
    where the next tag does not continue it. Each tag is zipped with its
    neighbours, starts and ends are picked out in one pass each and pair up in
    order: linear in the sentence, and nothing leaves the row.
    """
    return bind(bind(tags, _with_neighbours), _pair_ends)


def _with_neighbours(tags: Column) -> Column:
    last = F.greatest(F.size(tags) - 1, F.lit(0))
    return F.arrays_zip(
        tags.alias("tag"),
        F.concat(F.array(F.lit(None).cast("string")), F.slice(tags, F.lit(1), last)).alias("before"),
        F.slice(tags, F.lit(2), last).alias("after"),
        F.sequence(F.lit(0), last).alias("at"),
    )


def _pair_ends(near: Column) -> Column:
    starts = F.filter(near, lambda x: (x["tag"] != "O") & ~_continues(x["before"], x["tag"]))
    ends = F.filter(near, lambda x: (x["tag"] != "O") & ~_continues(x["tag"], x["after"]))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(_kind(a["tag"]).alias("type"), a["at"].alias("first"), b["at"].alias("last")),
    )


def _kind(tag: Column) -> Column:
    return F.substr(tag, F.lit(3))


def _continues(tag: Column, following: Column) -> Column:
    """Whether `following` goes on with the span of `tag`."""
    return F.coalesce((following == F.concat(F.lit("I-"), _kind(tag))) & (tag != "O"), F.lit(False))


def entity_counts(df: DataFrame, gold: str = "gold_tags", pred: str = "pred_tags") -> DataFrame:
    """One row: exact span matches and spans on each side.

    Both tag arrays sit in one row, so matching is a set intersection in the row
    (spans as short texts, which intersect by hash) and the only shuffle is the
    final sum.
    """
    return _tag_counts(df, gold, pred).select("tp", "n_gold", "n_pred")


def _tag_counts(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: words, right words, exact span matches and spans on each side."""
    def text(c: str) -> Column:
        return F.transform(
            entity_spans(F.col(c)), lambda s: F.concat(s["first"].cast("string"), F.lit(":"), s["last"].cast("string"), F.lit(":"), s["type"])
        )

    hits = F.aggregate(F.zip_with(gold, pred, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    spans = df.select(text(gold).alias("g"), text(pred).alias("p"), F.size(gold).alias("words"), hits.alias("hits"))
    return spans.agg(
        F.coalesce(F.sum(F.size(F.array_intersect("g", "p"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.size("g")), F.lit(0)).alias("n_gold"),
        F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("n_pred"),
        F.sum("words").alias("words"),
        F.sum("hits").alias("right"),
    )


def _span_f1() -> Column:
    tp = F.col("tp").cast("double")
    return F.coalesce(F.try_divide(2 * tp, F.col("n_gold") + F.col("n_pred")), F.lit(0.0))


def entity_f1(df: DataFrame, gold: str = "gold_tags", pred: str = "pred_tags") -> DataFrame:
    """Micro F1 over exact spans; 0 if neither side has any."""
    return entity_counts(df, gold, pred).select(_span_f1().alias("value"))


# --- evaluation ----------------------------------------------------------


def validation_loss(batch_losses: DataFrame) -> DataFrame:
    """Mean of the batch losses; a short last batch weighs as much as the others."""
    return batch_losses.agg(F.avg("loss").alias("value"))


def evaluate(
    df: DataFrame, task: str, metrics: Sequence[str], gold: str = "gold", pred: str = "pred"
) -> DataFrame:
    """(metric, value) in the order asked for, plus `rank`.

    For sequence labelling `gold` and `pred` are arrays of tag names without padding.
    All metrics of a task come from one shared aggregate, so `df` is read once:
    cells of the confusion matrix, counts of words and spans, or the counted pairs of numbers.
    """
    if "regression" in task:
        kind, known = "regression", {"pearsonr": None, "spearmanr": None}
    elif "classification" in task:
        kind = "classification"
        right = F.try_divide(F.col("c"), F.col("s"))
        # Every wrong row is a false alarm of one class and a miss of another.
        known = {"accuracy": right, "f1_score": F.coalesce(right, F.lit(0.0)), "matthews_corr": _matthews()}
    else:
        kind = "labeling"
        known = {"accuracy": F.try_divide(F.col("right").cast("double"), F.col("words")), "f1_score": _span_f1()}
    for name in metrics:
        if name not in known:
            raise ValueError(f"metric {name!r} is not defined for {task!r}")
    if not metrics:
        return df.sparkSession.createDataFrame([], "rank int, metric string, value double")
    if kind == "regression":
        found = _correlations(df, list(dict.fromkeys(metrics)), gold, pred).collect()
        values = {r.name: r.value for r in found}
        rows = [(i, name, values[name]) for i, name in enumerate(metrics)]
        return df.sparkSession.createDataFrame(rows, "rank int, metric string, value double")
    shared = _class_sums(confusion(df, gold, pred)) if kind == "classification" else _tag_counts(df, gold, pred)
    each = [F.struct(F.lit(i).alias("rank"), F.lit(name).alias("metric"), known[name].alias("value")) for i, name in enumerate(metrics)]
    return shared.select(F.explode(F.array(*each)).alias("m")).select("m.*")


def best_epoch(history: DataFrame, score: str = "score", floor: float | None = None) -> DataFrame:
    """Row with the highest score, the earliest on ties. With `floor`, only scores above it count."""
    rows = history if floor is None else history.where(F.col(score) > floor)
    best = F.max_by(F.struct("epoch", F.col(score).alias("score")), F.struct(score, -F.col("epoch")))
    return rows.agg(best.alias("b")).where(F.col("b").isNotNull()).select("b.epoch", "b.score")


def run_summary(runs: DataFrame, baseline: str, combo: str = "combo", score: str = "score") -> DataFrame:
    """Mean, sample deviation and number of runs per combination, and the gain over a baseline."""
    per = runs.groupBy(combo).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("deviation"), F.count(F.lit(1)).alias("runs")
    )
    base = runs.where(F.col(combo) == baseline).agg(F.avg(score)).scalar()
    return per.withColumn("gain", F.col("mean") - base)


def progress_loss(batch_losses: DataFrame, n_batches: int | Column, parts: int = 10) -> DataFrame:
    """Average loss of each tenth of an epoch, with the number of its batches, numbered from 1.

    Batches that fill no whole tenth are one more, shorter part.
    """
    n = n_batches if isinstance(n_batches, Column) else F.lit(n_batches)
    step = F.greatest(F.floor(n / parts), F.lit(1).cast("bigint"))
    return batch_losses.groupBy(F.floor((F.col("batch") - 1) / step).alias("part")).agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n")
    )
