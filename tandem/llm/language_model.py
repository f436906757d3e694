"""N-gram scoring through Elias-Fano tries.

Texts are cut into blocks of about BLOCK_TOKENS tokens. A block asks for the
training counts of its distinct n-grams; the requests go by a hash of the
n-gram to the shards that add up the counts of all blocks, and the answers
return in the order of the requests. A block therefore holds the counts, over
the whole corpus, of just the n-grams that it needs: nothing is broadcast, a
frequent n-gram has one row for each block, and memory depends on the block.

From its answers a block builds a trie of three levels and maps it into memory.
Level 1 holds the words. Level 2 holds the words seen after a word, level 3
those seen after two words, given as ranks among the successors of the second
word alone. Levels and pointers are ascending and stored in Elias-Fano code; an
n-gram is found by a successor search relative to its context. Each n-gram has
a quantised smoothed log10 probability and, as a context, the log10 share that
goes to the shorter context.

Smoothing is hierarchical: p(c | ab) = (n(abc) + m p(c | b)) / (n(ab) + m), down to
(n(c) + 1) / (N + V + 1) for words, V known words and one unknown. m is the value
of STRENGTHS with the best leave-one-out likelihood of all training texts.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.common import stored, texts, words_of
from tandem.llm.elias_fano import EliasFano, decode_each, encode, encode_each

BLOCK_TOKENS = 1_000_000
#: Tokens for each counting shard.
SHARD_TOKENS = 2_000_000
STRENGTHS = (1.0, 10.0, 100.0, 1000.0, 10000.0)
ORDER = 3

#: Log10 probabilities are kept in steps of 1/4096, down to -16.
STEP = 4096
_KEY_BITS = 48
_START, _END = b"\x00start", b"\x00end"


class _Words(dict):
    """Word to its number in the block, in the order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Made once in a process: most pieces are small, and the pieces of a block grow in number with the shards.
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(values: np.ndarray) -> bytes:
    return _ZIP.compress(values.tobytes())


def _loosen(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_UNZIP.decompress(data), kind)


def blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """(doc_id, held, sizes, hashes, tokens, n_tokens, n_train, block): one row for each block of whole texts.

    tokens: numbers into hashes, the XXH64 of the block's distinct words; the
    end of a text is a token.
    """
    kind = "bigint" if docs.schema[id_col].dataType.simpleString() in ("bigint", "int") else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, held, found, size = _Words(), [], [], [], 0
        for batch in batches:
            for doc, flag, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts(batch.column(1)), strict=True):
                tokens = words_of(text)
                tokens.append(_END)
                found.append(np.fromiter(map(words.__getitem__, tokens), np.uint32, len(tokens)))
                ids.append(doc)
                held.append(bool(flag))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield row(words, ids, held, found)
                    words, ids, held, found, size = _Words(), [], [], [], 0
        if ids:
            yield row(words, ids, held, found)

    def row(words: _Words, ids: list, held: list, found: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        sizes = [len(x) for x in found]
        columns = [
            pa.array([ids], pa.list_(pa.int64() if kind == "bigint" else pa.string())),
            pa.array([held], pa.list_(pa.bool_())),
            pa.array([sizes], pa.list_(pa.int64())),
            pa.array([hashes.tobytes()]),
            pa.array([_squeeze(np.concatenate(found))]),
            pa.array([sum(sizes)], pa.int64()),
            pa.array([held.count(False)], pa.int64()),
            # Stored with the block, so any number that no other block has will do.
            pa.array([uuid.uuid4().int >> 65], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held", "sizes", "hashes", "tokens", "n_tokens", "n_train", "block"])

    chosen = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col), F.coalesce(held_out, F.lit(False)).alias("held"))
    return chosen.mapInArrow(
        run,
        f"doc_id array<{kind}>, held array<boolean>, sizes array<bigint>, hashes binary, tokens binary, n_tokens bigint, n_train bigint, block bigint",
    )


class Grams:
    """Distinct n-grams of a block that end at its tokens, level by level.

    keys[k]: for level k the local number of an n-gram is its place in the
    sorted keys; a key is (number of the n-gram without its last word) * V +
    (last word). of[k]: the number of the n-gram that ends at each token.
    """

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> None:
        v = len(hashes) + 1
        self.start = v - 1  # the number of the mark before a text
        self.hash = [np.r_[hashes, np.uint64(xxhash.xxh64_intdigest(_START))]]
        self.words = v
        first = np.cumsum(sizes) - sizes
        tokens = tokens.astype(np.int64)
        self.of, self.keys, self.last = [tokens], [np.arange(v)], [np.arange(v)]
        self.head: list[np.ndarray] = [np.empty(0, np.int64)]
        self.first_context: list[int] = [self.start]
        before = tokens
        for k in range(1, order):
            # The n-gram one shorter that ends at the token before; at the head of a text, marks alone.
            prior = np.r_[0, before[:-1]]
            marks = self.first_context[-1]
            prior[first] = marks
            # A context of two marks has no token of its own, so it is numbered after all others.
            keys, self_of = _distinct(prior * v + tokens)
            self.keys.append(keys)
            self.head.append(keys // v)
            self.last.append(keys % v)
            self.hash.append(_mixed(self._head_hash(k - 1, keys // v), self.hash[0][keys % v], k))
            self.of.append(self_of)
            self.first_context.append(len(keys))
            before = self_of

    def _head_hash(self, k: int, number: np.ndarray) -> np.ndarray:
        known = self.hash[k]
        marks = np.uint64(xxhash.xxh64_intdigest(_START * (k + 1)))
        return np.where(number < len(known), known[np.minimum(number, len(known) - 1)], marks)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, place of each number among them) of numbers from 0 on."""
    bits = len(x).bit_length()
    if not len(x) or int(x.max()).bit_length() + bits > 63:
        return np.unique(x, return_inverse=True)
    # A number and its place in one integer sort faster than places by their numbers.
    both = (x << bits) | np.arange(len(x))
    both.sort()
    at, both = both & ((1 << bits) - 1), both >> bits
    new = np.r_[True, both[1:] != both[:-1]]
    place = np.empty(len(x), np.int64)
    place[at] = np.cumsum(new) - 1
    return both[new], place


def _mixed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _asked(grams: Grams, k: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the n-grams by shard and key, shard in that order) of a level's requests."""
    h = grams.hash[k]
    shard = (h >> np.uint64(_KEY_BITS)) % np.uint64(shards)
    if k == 0:
        order = np.lexsort((h, shard))
    else:
        # The shard is below 2^16 and so has room above the key. Equal keys get equal counts, in whichever order.
        order = np.argsort((shard << np.uint64(_KEY_BITS)) | (h & np.uint64((1 << _KEY_BITS) - 1)))
    return order, shard[order].astype(np.int64)


def requests(work: DataFrame, order: int, shards: int) -> DataFrame:
    """(shard, level, block, keys, counts): what each block asks of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, train = _block(row, order)
                for k in range(order):
                    counts = np.bincount(grams.of[k][train], minlength=len(grams.hash[k]))
                    at, shard = _asked(grams, k, shards)
                    keys = grams.hash[k][at] if k == 0 else grams.hash[k][at] & np.uint64((1 << _KEY_BITS) - 1)
                    cut = np.searchsorted(shard, np.arange(shards + 1))
                    some = np.flatnonzero(np.diff(cut))
                    # Word hashes use all 64 bits; the code is for 63.
                    code = [keys[cut[s] : cut[s + 1]].tobytes() for s in some] if k == 0 else encode_each(keys, cut[some + 1])
                    counts = counts[at].astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some.tolist(), pa.int32()),
                            pa.array([k] * len(some), pa.int32()),
                            pa.array([row["block"]] * len(some), pa.int64()),
                            pa.array(code, pa.binary()),
                            pa.array([_squeeze(counts[cut[s] : cut[s + 1]]) for s in some], pa.binary()),
                        ],
                        names=["shard", "level", "block", "keys", "counts"],
                    )

    return work.mapInArrow(run, "shard int, level int, block bigint, keys binary, counts binary")


def _block(row: dict, order: int) -> tuple[Grams, np.ndarray]:
    sizes = np.asarray(row["sizes"], np.int64)
    grams = Grams(np.frombuffer(row["hashes"], np.uint64), _loosen(row["tokens"], np.uint32), sizes, order)
    return grams, ~np.repeat(np.asarray(row["held"], bool), sizes)


def answers(asked: DataFrame) -> DataFrame:
    """(block, level, shard, body, known, total): counts over all blocks in the order of each request.

    The shard's own row has block -1, its number of words that training texts
    hold and their tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if at != (row["shard"], row["level"]):
                    if held:
                        yield totals(*at, held)
                    at, held = (row["shard"], row["level"]), []
                held.append(row)
        if held:
            yield totals(*at, held)

    def totals(shard: int, level: int, rows: list[dict]) -> pa.RecordBatch:
        codes = [r["keys"] for r in rows]
        keys, sizes = (np.frombuffer(b"".join(codes), np.uint64), np.array([len(x) >> 3 for x in codes])) if level == 0 else decode_each(codes)
        counts = np.concatenate([_loosen(r["counts"], np.uint32) for r in rows])
        unique, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)
        ends = np.cumsum(sizes).tolist()
        back = [_squeeze(total[inverse[end - n : end]]) for end, n in zip(ends, sizes.tolist(), strict=True)]
        words = level == 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(r["block"] for r in rows), -1], pa.int64()),
                pa.array([level] * (len(rows) + 1), pa.int32()),
                pa.array([shard] * (len(rows) + 1), pa.int32()),
                pa.array([*back, b""], pa.binary()),
                pa.array([0] * len(rows) + [int((total > 0).sum()) * words], pa.int64()),
                pa.array([0] * len(rows) + [int(total.sum()) * words], pa.int64()),
            ],
            names=["block", "level", "shard", "body", "known", "total"],
        )

    dealt = asked.repartition("shard", "level").sortWithinPartitions("shard", "level")
    return dealt.mapInArrow(run, "block bigint, level int, shard int, body binary, known bigint, total bigint")


class Trie:
    """The n-grams of a block that have a training count, in one memory map.

    Level 1 holds all words of the block, so a word is its own node. `span` is the
    size of a context's range in a level: node * span + symbol ascends.
    """

    def __init__(self, grams: Grams, seen: list[np.ndarray]) -> None:
        """seen: for each level, which n-grams have a count; level 1 is not asked."""
        self.nodes, self.span = [grams.words], [grams.words]
        place, parts = np.arange(grams.words), []
        pairs = None
        for k in range(1, len(seen)):
            inside = np.flatnonzero(seen[k])
            # Contexts of marks alone have the number and the node after all others.
            parent = np.r_[place, self.nodes[-1]][grams.head[k][inside]]
            if k == 1:
                symbol = grams.last[1][inside]
                begin = np.searchsorted(parent, np.arange(grams.words + 1))
                pairs = np.full(len(seen[1]), -1, np.int64)
                pairs[inside] = np.arange(len(inside)) - begin[parent]
            else:
                symbol = pairs[_pairs(grams, k)[inside]]
                self.span.append(int(pairs.max(initial=0)) + 1)
            parts.append(encode(parent * self.span[-1] + symbol))
            parts.append(encode(np.searchsorted(parent, np.arange(self.nodes[-1] + 2))))
            place = np.full(len(seen[k]), -1, np.int64)
            place[inside] = np.arange(len(inside))
            self.nodes.append(len(inside))
        mapped = [EliasFano(x) for x in _mapped(parts)]
        self.levels, self.pointers = mapped[0::2], mapped[1::2]

    def search(self, level: int, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Node of `symbol` in the context `parent` of the level before; -1 where it is not there."""
        out = np.full(len(parent), -1, np.int64)
        able = np.flatnonzero((parent >= 0) & (symbol >= 0) & (symbol < self.span[level - 1]))
        out[able] = self.levels[level - 1].find(parent[able] * self.span[level - 1] + symbol[able])
        return out

    def walk(self, grams: Grams, pairs: dict[int, np.ndarray]) -> list[np.ndarray]:
        """Node of every n-gram of the block, level by level."""
        found = [np.arange(grams.words)]
        for k in range(1, len(self.nodes)):
            parent = np.r_[found[-1], self.nodes[k - 1]][grams.head[k]]
            symbol = grams.last[k]
            if k > 1:
                pair = found[1][pairs[k]]
                begin = self.pointers[0].access(grams.head[1][pairs[k]]).astype(np.int64)
                symbol = np.where(pair >= 0, pair - begin, -1)
            found.append(self.search(k, parent, symbol))
        return found


def _mapped(parts: list[bytes]) -> list[memoryview]:
    """The parts in a read-only memory map of a file that has no name any more."""
    with tempfile.TemporaryFile() as file:
        file.write(b"".join(parts) or b"\0")
        file.flush()
        view = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    ends = np.cumsum([len(x) for x in parts]).tolist()
    return [view[end - len(part) : end] for part, end in zip(parts, ends, strict=True)]


def _pairs(grams: Grams, k: int) -> np.ndarray:
    """For each n-gram of level k, the number of the pair of its last two words."""
    out = np.zeros(len(grams.hash[k]), np.int64)
    out[grams.of[k]] = grams.of[1]
    return out


def _shorter(grams: Grams, k: int, pairs: dict[int, np.ndarray]) -> np.ndarray:
    """For each n-gram of level k, the number of the one without its first word."""
    if k == 1:
        return grams.last[1]
    if k == 2:
        return pairs[2]
    out = np.zeros(len(grams.hash[k]), np.int64)
    out[grams.of[k]] = grams.of[k - 1]
    return out


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-log10 * STEP), 65535).astype(np.uint16)


def _log10(codes: np.ndarray) -> np.ndarray:
    return codes / -float(STEP)


def score_block(grams: Grams, train: np.ndarray, sizes: np.ndarray, counts: list[np.ndarray], total: int, known: int, n_texts: int) -> dict[str, np.ndarray]:
    """Per text of a block: n_tokens, n_known, base_score, and scores and left_out for each strength.

    counts: the training counts of the block's n-grams; left_out: the log10
    likelihood of the block's training texts with each one's own token left out.
    """
    first = np.cumsum(sizes) - sizes
    by_text = lambda x: np.add.reduceat(x, first)
    order = len(counts)
    base = np.log10((counts[0] + 1.0) / (total + known + 1.0))
    pairs = {k: _pairs(grams, k) for k in range(2, order)}
    shorter = [np.empty(0, np.int64), *(_shorter(grams, k, pairs) for k in range(1, order))]
    seen = [c > 0 for c in counts]
    trie = Trie(grams, seen)
    node = trie.walk(grams, pairs)
    # Counts of contexts; the mark before a text is one for each training text, and so are several of them.
    context = [np.r_[counts[k], n_texts].astype(float) for k in range(order - 1)]
    if context:
        context[0][grams.start] = n_texts
    own = np.bincount(grams.of[-1][train], minlength=len(counts[-1]))
    mine = np.flatnonzero(own)
    own = own[mine]
    # What all strengths have in common. Of the longest n-grams, those with a count have a probability and those of training texts a likelihood.
    top, levels = order - 1, []
    for k in range(1, order):
        some, likely = (np.flatnonzero(seen[k]), mine) if k == top else (slice(None), slice(None))
        count, around = counts[k].astype(float), context[k - 1][grams.head[k]]
        given, place = _distinct(context[k - 1].astype(np.int64))
        left = np.maximum(count[likely] - 1, 0), shorter[k][likely], np.maximum(around[likely] - 1, 0)
        levels.append(((count[some], shorter[k][some], around[some]), left, slice(None) if k == top else seen[k], given, place[grams.head[k]]))
    scores, left_out = [], []
    for m in STRENGTHS if order > 1 else (1.0,):
        p, out = 10.0**base, np.maximum(counts[0], 1.0) / max(total + known, 1)
        score = _log10(_quantised(base))
        for k, ((count, less, around), (count_left, less_left, around_left), inside, given, place) in enumerate(levels, 1):
            p = (count + m * p[less]) / (around + m)
            out = (count_left + m * out[less_left]) / (around_left + m)
            level = _quantised(np.log10(p[inside]))
            share = _quantised(np.log10(m / (given + m)))
            score = np.where(node[k] >= 0, _log10(np.r_[level, 0])[node[k]], _log10(share)[place] + score[shorter[k]])
        left_out.append(float((own * np.log10(out if top else out[mine])).sum()))
        scores.append(by_text(score[grams.of[-1]]))
    return {
        "n_tokens": sizes,
        "n_known": by_text(seen[0][grams.of[0]].astype(np.int64)),
        "base_score": by_text(base[grams.of[0]]),
        "scores": np.stack(scores, axis=1),
        "left_out": np.array(left_out),
    }


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, strength) of every text.

    Training texts are those with `held_out` false or null. Null texts are
    empty: their one token is the end. Without training texts all words are
    unknown. An empty table gives an empty result.
    """
    work = stored(blocks(docs, id_col, text_col, held_out), "blocks")
    sums = work.agg(F.sum("n_tokens"), F.sum("n_train"), F.count("*")).first()
    tokens, n_texts, n_blocks = (int(x or 0) for x in sums)
    shards = max(1, tokens // SHARD_TOKENS)
    replies = stored(answers(requests(work, order, shards)), "answers")
    known, total = (int(x or 0) for x in replies.where("block = -1").agg(F.sum("known"), F.sum("total")).first())
    kind = work.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, body = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["level"] == -1:
                    if head is not None:
                        yield one(head, body)
                    head, body = row, []
                else:
                    body.append(row)
        if head is not None:
            yield one(head, body)

    def one(row: dict, replies_: list[dict]) -> pa.RecordBatch:
        grams, train = _block(row, order)
        counts = []
        for k in range(order):
            at, _ = _asked(grams, k, shards)
            got = np.concatenate([_loosen(r["body"], np.int64) for r in replies_ if r["level"] == k])
            counts.append(np.empty(len(at), np.int64))
            counts[-1][at] = got
        sizes = np.asarray(row["sizes"], np.int64)
        found = score_block(grams, train, sizes, counts, total, known, n_texts)
        n = len(sizes)
        left = [found["left_out"].tolist()] + [None] * (n - 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(row["doc_id"], pa.int64() if kind == "bigint" else pa.string()),
                pa.array(row["held"], pa.bool_()),
                pa.array(found["n_tokens"].tolist(), pa.int64()),
                pa.array(found["n_known"].tolist(), pa.int64()),
                pa.array(found["base_score"].tolist(), pa.float64()),
                pa.array(found["scores"].tolist(), pa.list_(pa.float64())),
                pa.array(left, pa.list_(pa.float64())),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "scores", "left_out"],
        )

    whole = work.select("block", F.lit(-1).alias("level"), F.lit(0).alias("shard"), "doc_id", "held", "sizes", "hashes", "tokens", F.lit(None).cast("binary").alias("body"))
    empty = [F.lit(None).cast(work.schema[c].dataType).alias(c) for c in ("doc_id", "held", "sizes", "hashes", "tokens")]
    back = replies.where("block >= 0").select("block", "level", "shard", *empty, "body")
    joined = whole.unionByName(back).repartition(max(1, n_blocks), "block").sortWithinPartitions("block", "level", "shard")
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, scores array<double>, left_out array<double>"
    scored = stored(joined.mapInArrow(run, schema), "scores")
    choices = STRENGTHS if order > 1 else (1.0,)
    sums = scored.where("left_out is not null").agg(*(F.sum(F.col("left_out")[i]) for i in range(len(choices)))).first()
    best = max(range(len(choices)), key=lambda i: sums[i] if sums[i] is not None else 0.0)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        "base_score",
        F.col("scores")[best].alias("score"),
        F.lit(choices[best]).alias("strength"),
    )

