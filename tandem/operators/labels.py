"""Label and text-column expressions: projections, parsing, encoding, decoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.arrays import label_literal, lookup, name_literal


def nonempty(text: Column, text_pair: Column | None = None) -> Column:
    """Rows to keep: a text of at least one character, or any pair."""
    single = text.isNotNull() & (text != "")
    return single if text_pair is None else text_pair.isNotNull() | single


def sentence_type(text_pair: Column) -> Column:
    return F.when(text_pair.isNotNull(), "sentence-pair").otherwise("single-sentence")


def texts_type(texts: Column) -> Column:
    """Type of a sentence given as an array of one or two texts; any other number is an error."""
    n = F.size(texts)
    return (
        F.when(n == 1, "single-sentence")
        .when(n == 2, "sentence-pair")
        .otherwise(F.raise_error(F.lit("a sentence has one text or a pair of texts")))
    )


def encode(label_raw: Column, label_map: Mapping[str, int] | None) -> Column:
    """Class id: whole numbers as they are, names through the map; NULL for anything else.

    A label that reads as a number never goes through the map.
    """
    named = F.lit(None).cast("bigint") if not label_map else lookup(label_literal(label_map), label_raw)
    return F.when(tx.is_number(label_raw), tx.to_integer(label_raw)).otherwise(named)


def encode_target(label_raw: Column, label_map: Mapping[str, int] | None = None) -> Column:
    """Regression target: any number, or a name through the map; NULL for anything else."""
    named = F.lit(None).cast("double") if not label_map else lookup(label_literal(label_map), label_raw).cast("double")
    return F.when(tx.is_number(label_raw), tx.to_float(label_raw)).otherwise(named)


def decode(label: Column, label_map: Mapping[str, int]) -> Column:
    return lookup(name_literal(label_map), label)


def coarse_label(line: Column) -> Column:
    """Part before the colon of the first space-separated token."""
    return F.substring_index(F.substring_index(line, " ", 1), ":", 1)


def after_first_token(line: Column) -> Column:
    """Everything behind the first space; empty if there is no space."""
    return F.regexp_replace(line, r"^[^ ]* ?", "")


def inline_tag(line: Column) -> Column:
    """Name in the first `<...>` of the line; NULL if there is none."""
    return F.nullif(F.regexp_extract(line, "<(.*?)>", 1), F.lit(""))


def without_tags(line: Column) -> Column:
    return F.regexp_replace(line, "<.*?>", "")


def first_annotation(tag: Column) -> Column:
    return F.substring_index(tag, ",", 1)


def without_tabs(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit(""))


def choose_target(df: DataFrame, label_type: str, allowed: tuple[str, ...], out: str = "target") -> DataFrame:
    """One of several numeric target columns, chosen by case-insensitive name."""
    name = label_type.lower()
    if name not in allowed:
        raise ValueError(f"label type {label_type!r} is not one of {allowed}")
    others = [c for c in df.columns if c not in allowed]
    return df.select(*others, F.col(name).cast("double").alias(out))


def join_pair(text: Column, text_pair: Column) -> Column:
    """Both texts as one, joined by ` SEP `; a missing pair leaves the text alone."""
    return F.concat_ws(" SEP ", text, text_pair)


def zip_pairs(first: Column, second: Column) -> Column:
    """Two aligned arrays as one array of (text, text_pair)."""
    return F.arrays_zip(first.alias("text"), second.alias("text_pair"))


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")


def union_sources(sources: Mapping[str, DataFrame], out: str = "label_raw") -> DataFrame:
    """Append unlabelled sources, each with its name as constant label."""
    labelled = [df.withColumn(out, F.lit(name)) for name, df in sources.items()]
    result = labelled[0]
    for df in labelled[1:]:
        result = result.unionByName(df)
    return result
