"""Words, subword counts, word starts, subword rows and the vocabulary of a corpus.

All of a sentence stays in its row as arrays, and nothing shuffles, but for the
vocabulary: it counts the words of all sentences, and its numbers are joined
back to them. `explode_words` and `subword_table` turn a sentence into rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.arrays import explode_once
from ..functions.vectors import running_start
from ..session import materialize
from .metrics import attach_by_value
from .order import with_prefix_sum


def words(text: Column) -> Column:
    return tx.words(text)


def rule_counts(words: Column, chars_per_subword: int = 4) -> Column:
    """Demo subword rule: one subword per started group of `chars_per_subword` characters."""
    return F.transform(words, lambda w: F.ceil(F.length(w) / chars_per_subword).cast("int"))


def tokenizer_counts(words: Column, tokenize: Callable[[Sequence[str]], list[int]], n_special: int = 2) -> Column:
    """Subwords per word by the caller's tokenizer.

    `tokenize` gets a list of words, each with a leading space, and returns the
    number of tokens of each, special tokens included. Within an Arrow batch each
    distinct word is tokenized once; word occurrences are never shuffled.
    """

    @F.arrow_udf("array<int>")
    def apply(ws: pa.Array) -> pa.Array:
        ws = ws.combine_chunks() if isinstance(ws, pa.ChunkedArray) else ws
        coded = ws.flatten().dictionary_encode()
        vocabulary = [f" {w}" for w in coded.dictionary.to_pylist()]
        per_word = pa.array([n - n_special for n in tokenize(vocabulary)] if vocabulary else [], pa.int32())
        counts = per_word.take(coded.indices)
        ends = pa.array([0] + ws.value_lengths().fill_null(0).to_pylist(), pa.int32())
        return pa.ListArray.from_arrays(pa.compute.cumulative_sum(ends), counts)

    return apply(words)


def word_starts(counts: Column, max_length: int | None = None, cls_first: bool = True) -> Column:
    """Subword position at which each word starts, from the subword counts.

    All words have a start. Only with a `max_length` are starts at or past it
    dropped, and the array may then be shorter than the list of words.
    """
    starts = running_start(counts, 1 if cls_first else 0)
    return starts if max_length is None else F.filter(starts, lambda s: s < max_length)


def explode_words(df: DataFrame, words: str = "words", *aligned: str) -> DataFrame:
    """One row per word: `word_pos`, `word`, and the item of each aligned array (NULL past its end).

    The arrays are zipped before they are exploded, so no row carries a whole array.
    """
    keep = [c for c in df.columns if c != words and c not in aligned]
    zipped = F.arrays_zip(F.col(words).alias("word"), *[F.col(a).alias(a) for a in aligned])
    exploded = explode_once(df, keep, zipped, "word_pos", "_x")
    return exploded.select(*keep, "word_pos", "_x.word", *[f"_x.{a}" for a in aligned])


def subword_table(
    df: DataFrame, counts: str = "counts", carry: Sequence[str] = (), keep: Sequence[str] = ("sent_id",), pad_to: int = 1
) -> DataFrame:
    """One row per subword: `keep`, `subword_pos`, `word_pos`, `is_first`, `is_pad` and the columns of `carry`.

    A sentence begins and ends with a special token and is padded to a multiple
    of `pad_to`; those rows have no word. `is_first` marks the first subword of a
    word, and only there the items of the arrays in `carry` are set. A word
    without subwords has no row, a sentence without words has its two special
    rows, and one whose counts are NULL has none. Nothing is shuffled.
    """
    types = {f.name: f.dataType.elementType for f in df.select(*carry).schema}
    names = [f"_c{i}" for i in range(len(carry))]

    def row(pos: Column, first: Column, pad: bool, items: Sequence[Column]) -> Column:
        fields = [pos.cast("int").alias("pos"), first.alias("first"), F.lit(pad).alias("pad")]
        return F.struct(*fields, *[i.cast(types[c]).alias(n) for i, c, n in zip(items, carry, names, strict=True)])

    def pieces(word: Column, pos: Column) -> Column:
        first = lambda p: F.when(p == 0, F.lit(True)).otherwise(False)
        own = lambda p: [F.when(p == 0, word[n]) for n in names]
        return F.transform(F.array_repeat(pos, word["n"]), lambda w, p: row(w, first(p), False, own(p)))

    none = [F.lit(None)] * len(carry)
    special, padding = (row(F.lit(None), F.lit(False), pad, none) for pad in (False, True))
    total = F.aggregate(counts, F.lit(0), lambda a, n: a + n.cast("int")) + 2
    n_pads = (F.ceil(total / pad_to) * pad_to - total).cast("int")
    zipped = F.arrays_zip(F.col(counts).alias("n"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    rows = F.concat(F.array(special), F.flatten(F.transform(zipped, pieces)), F.array(special), F.array_repeat(padding, n_pads))
    return explode_once(df, keep, rows, "subword_pos", "_s").select(
        *keep, "subword_pos", F.col("_s.pos").alias("word_pos"), F.col("_s.first").alias("is_first"), F.col("_s.pad").alias("is_pad"),
        *[F.col(f"_s.{n}").alias(c) for c, n in zip(carry, names, strict=True)],
    )


# --- vocabulary ----------------------------------------------------------

#: Buckets of the order that numbers the words: the first four hex digits of a digest.
WORD_BUCKETS = 1 << 16


def vocabulary(df: DataFrame, tokenize: Callable[[Sequence[str]], list[int]], words: str = "words", n_special: int = 2) -> DataFrame:
    """(word, word_id, n_subwords, c): the distinct words of all sentences; c counts their occurrences.

    `tokenize` (see `tokenizer_counts`) gets each distinct word of the corpus
    once, whatever the partitions: the counted words are stored before and the
    result after it. Ids run from 0 in the order of the words' digests, so they
    hang on the set of words alone. Words are counted before they are shuffled,
    so a word that fills a third of a corpus is a few rows. NULL words and
    NULL arrays do not count; without words the table is empty.
    """

    @F.arrow_udf("int")
    def subwords(ws: pa.Array) -> pa.Array:
        given = [f" {w}" for w in ws.to_pylist()]
        return pa.array([n - n_special for n in tokenize(given)] if given else [], pa.int32())

    found = explode_once(df, [], words, "_pos", "word").where(F.col("word").isNotNull())
    counted = materialize(found.groupBy("word").agg(F.count(F.lit(1)).alias("c")), "words")
    keyed = counted.withColumn("_key", F.md5("word")).withColumn("_bucket", F.substring("_key", 1, 4))
    numbered = with_prefix_sum(keyed, ["_bucket"], ["_key", "word"], F.lit(1).cast("bigint"), "word_id", WORD_BUCKETS)
    return materialize(numbered.select("word", "word_id", subwords("word").alias("n_subwords"), "c"), "vocabulary")


def encode_words(df: DataFrame, vocab: DataFrame, words: str = "words", key: str = "sent_id") -> DataFrame:
    """(key, words, word_ids, counts): the numbers of `vocab` put back into the sentences, as arrays.

    Frequent words are broadcast (at most 10,000, each with that share of all
    occurrences), so no word is a hot key; the others shuffle. A group is one
    sentence. A sentence without words, or with NULL for them, has empty arrays;
    words that `vocab` lacks stop the query, as starts would be wrong. Keys
    are unique.
    """
    rows = explode_once(df, [key], words, "_pos", "word").where(F.col("word").isNotNull())
    numbers = attach_by_value(rows, vocab, "word").select(key, F.struct("_pos", "word", "word_id", "n_subwords").alias("_w"))
    sentences = df.select(key, F.coalesce(F.size(F.filter(words, lambda w: w.isNotNull())), F.lit(0)).alias("_n"))
    listed = numbers.groupBy(key).agg(F.array_sort(F.collect_list("_w")).alias("_w"))
    joined = sentences.join(listed, key, "left")
    whole = F.coalesce(F.size("_w"), F.lit(0)) == F.greatest("_n", F.lit(0))
    lost = F.concat(F.lit("the vocabulary lacks a word of sentence "), F.col(key).cast("string"))
    sound = joined.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(lost).cast("boolean")))
    got = lambda name, kind: F.coalesce(F.transform("_w", lambda w: w[name]), F.array().cast(f"array<{kind}>"))
    return sound.select(key, got("word", "string").alias(words), got("word_id", "bigint").alias("word_ids"), got("n_subwords", "int").alias("counts"))
