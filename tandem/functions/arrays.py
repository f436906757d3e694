"""Small per-row array expressions on built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def explode_once(df: DataFrame, keep: Sequence[str | Column], array: str | Column, pos: str, item: str) -> DataFrame:
    """One row per array item, the array being computed once.

    The plain generator also filters its input by the size of the array; where
    the array is an expression or a UDF, that computes it a second time. The
    outer generator does not, and its row for an empty array is dropped behind it.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def label_literal(label_map: Mapping[str, int]) -> Column:
    """Label map as a literal MAP<STRING,BIGINT>."""
    parts = [F.lit(x) for name, i in label_map.items() for x in (name, i)]
    return F.create_map(*parts).cast("map<string,bigint>")


def name_literal(label_map: Mapping[str, int]) -> Column:
    """Reversed label map as a literal MAP<BIGINT,STRING>."""
    parts = [F.lit(x) for name, i in label_map.items() for x in (i, name)]
    return F.create_map(*parts).cast("map<bigint,string>")


def lookup(mapping: Column, key: Column) -> Column:
    """Map value, NULL when the key is absent."""
    return F.try_element_at(mapping, key)


def pad(values: Column, length: Column, fill: Column) -> Column:
    """Append `fill` until the array has `length` items."""
    return F.concat(values, F.array_repeat(fill, (length - F.size(values)).cast("int")))


def argmax(values: Column) -> Column:
    """Index of the largest item, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def _below_top(values: Column) -> Column:
    # Zipped, not captured: a captured expression would be computed again for each item.
    return F.zip_with(values, F.array_repeat(F.array_max(values), F.size(values)), lambda x, top: x - top)


def softmax(values: Column) -> Column:
    """Softmax shifted by the maximum, so large scores do not overflow."""
    powers = F.transform(_below_top(values), F.exp)
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(powers, F.array_repeat(total, F.size(values)), lambda x, t: x / t)


def log_sum_exp(values: Column) -> Column:
    return F.array_max(values) + F.log(F.aggregate(_below_top(values), F.lit(0.0), lambda a, x: a + F.exp(x)))
