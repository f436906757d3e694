"""Distributed positional inverted index and its phrase and proximity search.

The index is cut by documents: a row holds some whole documents (about
BLOCK_WORDS words), their distinct terms in order and, for each term, the
ascending list of its positions in the block. Documents are one gap apart in
the numbering, so no phrase runs from one into the next. Terms are known by
their 64-bit XXH64.

Queries come in blocks of bounded size and each block is sent to all index
rows. A search starts from the shortest lists of a query and keeps the
positions that the other lists, shifted by their offsets, also hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.common import stored, task, texts

BLOCK_WORDS = 500_000
#: Words of queries that go to the executors in one broadcast: 16 MB.
QUERY_WORDS = 1_000_000

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """Words of digits, letters and bytes above 7F, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Hashes(dict):
    """Term to its hash, remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[term] = value = xxhash.xxh64_intdigest(term)
        return value


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows of all documents. Null texts have no words; documents without words are kept."""

    @task("positions")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, found, size = Hashes(), [], [], 0
        for batch in batches:
            for i, text in enumerate(texts(batch.column(1))):
                terms = terms_of(text)
                ids.append(batch.column(0)[i])
                found.append(np.fromiter(map(hashes.__getitem__, terms), np.uint64, len(terms)))
                size += len(terms)
                if size >= BLOCK_WORDS:
                    yield _index_row(ids, found, schema)
                    ids, found, size = [], [], 0
        if ids:
            yield _index_row(ids, found, schema)

    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string()
    schema = pa.schema([("doc_id", pa.list_(id_type)), ("first", pa.list_(pa.int64())), ("terms", pa.binary()), ("starts", pa.binary()), ("positions", pa.binary())])
    chosen = docs.select(F.col(id_col).cast("bigint" if kind == "bigint" else "string").alias("doc_id"), text_col)
    return chosen.mapInArrow(
        run, f"doc_id array<{'bigint' if kind == 'bigint' else 'string'}>, first array<bigint>, terms binary, starts binary, positions binary"
    )


def _index_row(ids: list, found: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in found], np.int64)
    # The numbering leaves one free place after each document.
    first = np.cumsum(sizes + 1) - sizes - 1
    words = np.concatenate(found)
    places = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
    terms, inverse, counts = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    columns = [
        pa.array([[x.as_py() for x in ids]], schema.field("doc_id").type),
        pa.array([[*first.tolist(), int(len(words) + len(sizes))]]),
        pa.array([terms.tobytes()]),
        pa.array([np.r_[0, np.cumsum(counts)].astype(np.uint32).tobytes()]),
        pa.array([places[order].astype(np.uint32).tobytes()]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class Postings:
    """Posting lists of one index row."""

    def __init__(self, first: list[int], terms: bytes, starts: bytes, positions: bytes) -> None:
        self.first = np.asarray(first, np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.starts = np.frombuffer(starts, np.uint32).astype(np.int64)
        self.positions = np.frombuffer(positions, np.uint32)
        self.length = np.diff(self.starts)
        # Which list holds a position: the lists turned round, for shifted membership in one step.
        self.holder = np.full(int(self.first[-1]) + 1, -1, np.int32)
        self.holder[self.positions] = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.length)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """List numbers of term hashes; -2 for terms without postings."""
        if not len(self.terms):
            return np.full(len(hashes), -2)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -2)

    def members(self, positions: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Whether each position is in its list; positions outside the block are in none."""
        inside = (positions >= 0) & (positions < len(self.holder))
        return inside & (self.holder[np.where(inside, positions, 0)] == lists)

    def spans(self, query: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, end) of runs that hold a window of consecutive words of an item.

        `query` has the list numbers of the items' words one after another,
        `first` where each item begins, and its end. An item of fewer words is
        one window. Every window is searched from its rarest word: the run of
        equal words around each posting of it is followed for less than a window
        either way, so it is found whole as far as that window reaches.
        """
        item = np.repeat(np.arange(len(first) - 1), np.diff(first))
        need = np.minimum(window, np.diff(first))[item]
        cost = np.where(query >= 0, self.length[np.maximum(query, 0)] if len(self.length) else 0, 0)
        anchor = np.unique(_rarest(cost, first, window))
        n = cost[anchor]
        q = np.repeat(anchor, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = self.positions[self.starts[query[q]] + step].astype(np.int64) if len(q) else np.empty(0, np.int64)
        left, right = (self._extent(query, item, q, p, sign, window) for sign in (-1, 1))
        hit = left + right + 1 >= need[q]
        q, p, left, right = q[hit], p[hit], left[hit], right[hit]
        return item[q], p - left, p + right + 1

    def _extent(self, query: np.ndarray, item: np.ndarray, q: np.ndarray, p: np.ndarray, sign: int, window: int) -> np.ndarray:
        """How many words next to each posting go on matching the item, less than a window."""
        extent = np.zeros(len(q), np.int64)
        on = np.arange(len(q))
        for k in range(1, window):
            at = q[on] + sign * k
            inside = (at >= 0) & (at < len(query))
            on, at = on[inside], at[inside]
            same = (item[at] == item[q[on]]) & self.members(p[on] + sign * k, query[at])
            on = on[same]
            extent[on] = k
            if not len(on):
                break
        return extent

    def near(self, lists: list[int], within: int) -> list[tuple[int, int]]:
        """(start, end) of stretches of at most `within` places that hold all lists, one for each start of the rarest list."""
        if not lists or min(lists) < 0:
            return []
        held = sorted((self.positions[self.starts[x] : self.starts[x + 1]].astype(np.int64) for x in set(lists)), key=len)
        doc = np.searchsorted(self.first, held[0], "right")
        low, high = held[0].copy(), held[0].copy()
        for other in held[1:]:
            at = np.searchsorted(other, held[0])
            before = other[np.maximum(at - 1, 0)]
            after = other[np.minimum(at, len(other) - 1)]
            gap_b = np.where((at > 0) & (np.searchsorted(self.first, before, "right") == doc), held[0] - before, 1 << 40)
            gap_a = np.where((at < len(other)) & (np.searchsorted(self.first, after, "right") == doc), after - held[0], 1 << 40)
            nearest = np.where(gap_b <= gap_a, before, after)
            lost = np.minimum(gap_b, gap_a) >= 1 << 40
            low = np.where(lost, -(1 << 40), np.minimum(low, nearest))
            high = np.where(lost, 1 << 40, np.maximum(high, nearest))
        good = high - low < within
        return sorted(set(zip(low[good].tolist(), (high[good] + 1).tolist(), strict=True)))


def _rarest(cost: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Index of the cheapest word of every window of every item."""
    best = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = cost[lo:hi]
        if len(own) > window:
            best.append(lo + np.arange(len(own) - window + 1) + np.lib.stride_tricks.sliding_window_view(own, window).argmin(axis=1))
        elif len(own):
            best.append([lo + int(own.argmin())])
    return np.concatenate(best).astype(np.int64) if best else np.empty(0, np.int64)


Query = tuple[object, np.ndarray]


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[Query]]:
    """Items in blocks of at most QUERY_WORDS words, or one larger item; items without words are left out.

    Rows stream to the driver one partition at a time, and no more than a block
    is held.
    """
    block, size, hashes = [], 0, Hashes()
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        words = np.array([hashes[x] for x in terms_of(row[1])], np.uint64)
        if not len(words):
            continue
        if block and size + len(words) > QUERY_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def phrase_spans(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """One row for each document: doc_id, n_words, spans, items.

    spans: the disjoint stretches (start, end) of its words that are hit by a
    window of an item; items: the ids, as text, of the items with a window in it.
    An empty item table leaves every document without hits.
    """

    def search(block: list[Query]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        shared = index.sparkSession.sparkContext.broadcast((
            [str(x) for x, _ in block],
            np.concatenate([x for _, x in block]) if block else np.empty(0, np.uint64),
            np.cumsum([0, *(len(x) for _, x in block)]),
        ))
        return lambda batches: _searched(batches, *shared.value, window)

    kind = index.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"block bigint, doc int, doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    numbered = index.select(F.monotonically_increasing_id().alias("block"), "*")
    numbered = stored(numbered, "index")
    found = [numbered.mapInArrow(search(block), schema) for block in query_blocks(items, id_col, text_col)]
    if not found:
        found = [numbered.mapInArrow(search([]), schema)]
    if len(found) == 1:
        return found[0].withColumn("items", F.array_distinct("items")).drop("block", "doc")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    both = whole.groupBy("block", "doc").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return both.drop("block", "doc")


def merged(spans: Column) -> Column:
    """Sorted spans (start, end) with those that touch joined."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def _searched(batches: Iterator[pa.RecordBatch], names: list[str], hashes: np.ndarray, first: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lists = Postings(row["first"], row["terms"], row["starts"], row["positions"])
            item, start, end = lists.spans(lists.numbers(hashes), first, window) if len(hashes) else (np.empty(0, np.int64),) * 3
            doc = np.searchsorted(lists.first, start, "right") - 1
            n = len(row["doc_id"])
            spans: list[list] = [[] for _ in range(n)]
            order = np.lexsort((start, doc))
            for d, a, b in zip(doc[order].tolist(), (start - lists.first[doc])[order].tolist(), (end - lists.first[doc])[order].tolist(), strict=True):
                if spans[d] and a <= spans[d][-1]["end"]:
                    spans[d][-1]["end"] = max(b, spans[d][-1]["end"])
                else:
                    spans[d].append({"start": a, "end": b})
            held: list[list] = [[] for _ in range(n)]
            for key in np.unique(doc * max(len(names), 1) + item).tolist():
                held[key // len(names)].append(names[key % len(names)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]] * n, pa.int64()),
                    pa.array(range(n), pa.int32()),
                    pa.array(row["doc_id"], batch.schema.field("doc_id").type.value_type),
                    pa.array((np.diff(lists.first) - 1).tolist(), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(held, pa.list_(pa.string())),
                ],
                names=["block", "doc", "doc_id", "n_words", "spans", "items"],
            )


def proximity(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, start, end): stretches of at most `within` words that hold all the terms, around the rarest one."""
    hashes = np.array([xxhash.xxh64_intdigest(x) for t in terms for x in terms_of(t)], np.uint64)
    kind = index.schema["doc_id"].dataType.elementType.simpleString()

    @task("positions")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists = Postings(row["first"], row["terms"], row["starts"], row["positions"])
                found = lists.near(lists.numbers(hashes).tolist(), within)
                doc = [int(np.searchsorted(lists.first, a, "right")) - 1 for a, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_id"][d] for d in doc], batch.schema.field("doc_id").type.value_type),
                        pa.array([a - int(lists.first[d]) for (a, _), d in zip(found, doc, strict=True)], pa.int64()),
                        pa.array([b - int(lists.first[d]) for (_, b), d in zip(found, doc, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "end"],
                )

    return index.mapInArrow(run, f"doc_id {kind}, start bigint, end bigint")
