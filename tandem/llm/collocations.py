"""Phrases whose words belong together, from exact counts of word sequences.

Counts of all orders are streams: one in prefix order (a phrase beside what it
begins with) and one in suffix order (beside what it ends with). Both are sorted, and
sort-merge joins walk them in lockstep: the prefix stream gives the left parts and the
longest-lived extension to the right, the suffix stream the right parts and the extension
to the left. No table of counts is held in memory or looked up by hash.

A phrase with LEAST occurrences has only parts with as many, so rare parts prune
what is counted: words are counted first, then pairs of frequent words by a hash,
then pairs, triples and quadruples of frequent pairs by their text. Between passes the
frequent ones travel as a bitmap of bounded size, which only lets some rare ones
pass; every count that decides is an exact sum by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tandem.llm.common import settle, stored, task

LEAST, LONGEST, SHARE, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Parts of a language whose best phrases are found apart.
HEATS = 64
#: Tokens that a task holds before it hands out their counts.
BUFFER_TOKENS = 4_000_000
#: Places of a buffer that are looked at, or sorted, at once: bounds what a task holds besides its tokens.
STEP = 1 << 19
#: Rows of a batch that a task hands out.
BATCH_ROWS = 1 << 16
#: Bits of a filter: so many for each entry, and no more than 2 ** MOST_BITS (128 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 22, 30
#: Bits of a row of the bitmap, as Spark's bitmap functions have them.
ROW_BITS = 32768
#: No byte of UTF-8; stands between pieces.
_BREAK = b"\xff"
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def pieces_and_words(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, and a break after each piece."""
    return text.lower().translate(_CUT).replace(_BREAK, b" \xff ").split()


def word_hashes(langs: list[str], words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each language and word."""
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in zip(words, langs, strict=True)), np.uint64, len(words))


class Buffer:
    """Tokens of some texts as numbers; a number stands for a word of a language, 0 for a break."""

    def __init__(self) -> None:
        self.numbers: dict[str, Numbers] = {}
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = Numbers(self, lang)
        found = pieces_and_words(text)
        found.append(_BREAK)
        self.tokens.append(np.fromiter(map(self.numbers[lang].__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def array(self) -> np.ndarray:
        """All tokens, end to end; no text is added any more."""
        self.numbers = {}
        self.tokens = [np.concatenate(self.tokens)] if self.tokens else [np.empty(0, np.int32)]
        return self.tokens[0]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each number's language and word."""
        return np.r_[np.uint64(0), word_hashes(self.langs[1:], self.words[1:])]


class Numbers(dict):
    def __init__(self, buffer: Buffer, lang: str) -> None:
        super().__init__({_BREAK: 0})
        self.buffer, self.lang = buffer, lang

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.buffer.words)
        self.buffer.words.append(word)
        self.buffer.langs.append(self.lang)
        return number


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[Buffer]:
    """Whole texts in buffers of about BUFFER_TOKENS; a longer text is a buffer of its own."""
    buffer = Buffer()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            buffer.add(lang, text)
            if buffer.size >= BUFFER_TOKENS:
                yield buffer
                buffer = Buffer()
    if buffer.size:
        yield buffer


def _each(batches: Iterator[pa.RecordBatch], found: Callable[[Buffer], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What `found` gives for each buffer; a buffer and all that was made of it are gone before the next one fills."""
    buffers = _buffers(batches)
    while (buffer := next(buffers, None)) is not None:
        yield from found(buffer)
        del buffer
        settle()


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(_MIX[0]) ^ second
    for shift, mix in zip((30, 27), _MIX[1:], strict=True):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mix)
    return h ^ (h >> np.uint64(31))


def _counts(langs: list[str], phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])


def _words(buffer: Buffer) -> Iterator[pa.RecordBatch]:
    tokens, n = buffer.array(), np.zeros(len(buffer.words), np.int64)
    for lo in range(0, len(tokens), STEP):
        n += np.bincount(tokens[lo : lo + STEP], minlength=len(n))
    for lo in range(1, len(n), BATCH_ROWS):
        yield _counts(buffer.langs[lo : lo + BATCH_ROWS], buffer.words[lo : lo + BATCH_ROWS], n[lo : lo + BATCH_ROWS])


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f): occurrences of every word."""

    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each(batches, _words)

    return texts.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


class Filter:
    """Bitmap of 64-bit hashes: tells that a hash is none of the frequent ones, or may be one."""

    def __init__(self, hashes: DataFrame) -> None:
        """`hashes` has one column `h`; it is read twice and never collected."""
        wanted = max(1, hashes.count()) * BITS_EACH
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(wanted - 1).bit_length()))
        place = F.shiftrightunsigned("h", 64 - self.bits) + 1
        rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
        # At most 2 ** (MOST_BITS - 15) rows of 4 KB.
        map_ = np.zeros((1 << self.bits) // 8, np.uint8)
        for r in rows.toLocalIterator():
            lo = (r.b - 1) * (ROW_BITS // 8)
            map_[lo : lo + ROW_BITS // 8] = np.frombuffer(r.m, np.uint8)
        self.map = map_

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        place = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.map[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def _pair_counts(buffer: Buffer, words: Filter) -> Iterator[pa.RecordBatch]:
    tokens, hashes = buffer.array(), buffer.hashes()
    good = words.may_hold(hashes)
    good[0] = False
    h, size = np.empty(len(tokens), np.uint64), 0
    for lo in range(0, len(tokens) - 1, STEP):
        some = tokens[lo : lo + STEP + 1]
        known = good[some]
        both = np.flatnonzero(known[:-1] & known[1:])
        h[size : size + len(both)] = _pair_hash(hashes[some[both]], hashes[some[both + 1]])
        size += len(both)
    h = h[:size]
    h.sort()
    first = _firsts(h)
    for lo in range(0, len(first), BATCH_ROWS):
        some = first[lo : lo + BATCH_ROWS + 1]
        n = np.diff(some if len(some) > BATCH_ROWS else np.r_[some, size]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(h[some[: len(n)]].view(np.int64)), pa.array(n)], names=["h", "n"])


def _firsts(ascending: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def frequent_pair_hashes(texts: DataFrame, words: Filter, least: int) -> DataFrame:
    """(h): hashes of adjacent words that occur `least` times or more, of words that `words` may hold."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each(batches, lambda buffer: _pair_counts(buffer, shared.value))

    # Rows of a task are distinct already: they are dealt out as they are and added up once.
    rows = texts.mapInArrow(run, "h bigint, n int").repartition("h")
    return rows.groupBy("h").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("h")


def _phrases(buffer: Buffer, pairs: Filter, longest: int) -> Iterator[pa.RecordBatch]:
    tokens, hashes = buffer.array(), buffer.hashes()
    pair = np.zeros(len(tokens), bool)
    for lo in range(0, len(tokens) - 1, STEP):
        some = tokens[lo : lo + STEP + 1]
        inside = np.flatnonzero((some[:-1] > 0) & (some[1:] > 0))
        h = _pair_hash(hashes[some[inside]], hashes[some[inside + 1]])
        pair[lo + inside[pairs.may_hold(h)]] = True
    del hashes
    at = np.flatnonzero(pair)
    # A phrase of n words is its first n - 1, known by a number, and its last word.
    code = tokens.copy()
    for size in range(2, longest + 1):
        if size > 2:
            # The pair that ends the longer phrase must be there too.
            at = at[at + size - 1 < len(tokens)]
            at = at[pair[at + size - 2]]
        if not len(at):
            break
        # Equal phrases end with one word, so phrases are sorted in parts by their last words.
        parts, known = -(-len(at) // STEP), 0
        part_of = (tokens[at + size - 1] % parts).astype(np.uint16)
        for part in range(parts):
            own = at[part_of == part]
            key = code[own].astype(np.int64) << 32 | tokens[own + size - 1]
            order = np.argsort(key)
            first = _firsts(key[order])
            n = np.diff(first, append=len(own))
            code[own[order]] = np.repeat(np.arange(known, known + len(first), dtype=np.int32), n)
            known += len(first)
            start = own[order[first]]
            del own, key, order, first
            for lo in range(0, len(start), BATCH_ROWS):
                some = start[lo : lo + BATCH_ROWS]
                columns = [tokens[some + i].tolist() for i in range(size)]
                phrases = [b" ".join([buffer.words[t] for t in row]) for row in zip(*columns, strict=True)]
                yield _counts([buffer.langs[t] for t in columns[0]], phrases, n[lo : lo + BATCH_ROWS])


def phrase_counts(texts: DataFrame, pairs: Filter, longest: int) -> DataFrame:
    """(lang, phrase, f): occurrences of the phrases of 2 to `longest` words all of whose pairs `pairs` may hold."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)

    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each(batches, lambda buffer: _phrases(buffer, shared.value, longest))

    return texts.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def counted(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to `longest` words with `least` occurrences, and (lang, n), the words of each language.

    Both are stored. Phrases stay inside a piece, and overlapping occurrences all count.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    words = stored(word_counts(texts), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = words.where(F.col("f") >= least)
    hashed = often.select("lang", F.col("phrase").cast("binary")).mapInArrow(_hashed_words, "h bigint")
    pairs = stored(frequent_pair_hashes(texts, Filter(stored(hashed, "word_hashes")), least), "pair_hashes")
    phrases = phrase_counts(texts, Filter(pairs), longest).where(F.col("f") >= least)
    return stored(often.unionByName(phrases), "counts"), totals


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = word_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Lockstep walk of two sorted streams; adaptive execution may split a hot key's side."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def scored(counts: DataFrame, scale: int = SCALE, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers.

    A longer phrase that covers a candidate has a part one word longer than the
    candidate that occurs as often or more, so extensions by one word decide.
    """
    words = F.split("phrase", " ")
    streams = counts.select("lang", "phrase", "f", words.alias("w"), F.size(words).alias("size"))

    def join(w: Column) -> Column:
        return F.array_join(w, " ")

    phrases = streams.where("size > 1")
    last = F.col("size") - 1
    # Extension counts: the prefix stream has a phrase beside its extensions to the right, the suffix stream beside those to the left.
    heads = phrases.where("size > 2").groupBy("lang", join(F.slice("w", 1, last)).alias("phrase")).agg(F.max("f").alias("x"))
    tails = phrases.where("size > 2").groupBy("lang", join(F.slice("w", 2, last)).alias("phrase")).agg(F.max("f").alias("y"))
    open_ = _merged(_merged(phrases, heads, ["lang", "phrase"], "left"), tails, ["lang", "phrase"], "left")
    covered = F.greatest(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))) * 100 >= F.col("f") * share
    left = open_.where(~covered).select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), last)).alias("k"))
    cuts = left.select("lang", "phrase", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("head"), join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("tail"))
    prefix = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    suffix = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = _merged(_merged(cuts, prefix, ["lang", "head"]), suffix, ["lang", "tail"])
    # The product of two decimals of 28 and 9 digits is exact; `div` gives its whole quotient as a long.
    product = F.col("a").cast("decimal(28,0)") * F.lit(scale).cast("decimal(9,0)")
    score = F.call_function("div", product, F.col("l").cast("decimal(28,0)") + F.col("r"))
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases.

    A null text is empty and gives nothing; a null language is `und`. Whole
    texts are read, however long. Repeated rows count each. Equal scores go by the number of occurrences, then by the bytes
    of the phrase. Other columns are not read. An empty table gives an
    empty result.
    """
    counts, totals = counted(docs, lang_col, text_col, least, longest)
    best = (F.col("score").desc(), F.col("a").desc(), "phrase")
    # The best of each of HEATS parts of a language meet in the end, so the last task of a language has a bounded number of rows.
    heats = scored(counts).withColumn("heat", F.pmod(F.xxhash64("phrase"), F.lit(HEATS)))
    heats = heats.withColumn("rank", F.row_number().over(W.partitionBy("lang", "heat").orderBy(*best))).where(F.col("rank") <= top)
    best = heats.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return _merged(best, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
