"""SimHash fingerprints linked through sharded BK-trees.

Two fingerprints that differ in at most r of 64 bits agree in at least two of
r + 2 blocks of bits. A shard holds the fingerprints that agree in one pair of
blocks, and its BK-tree (children keyed by the integer Hamming distance to the
parent) is searched along the edges within the radius. One tree over all
fingerprints has no size bound and can't be broadcast; the trees stay in the
tasks that hold their shards, which are bounded: a shard of more than
SHARD_ROWS fingerprints is cut again by blocks of its remaining bits. Since
fingerprints are distinct, a shard in which only b bits are free has at most
2^b rows, so the cutting ends. Of wide fingerprints further equal bits would
lose links; a crowded shard is cut into tiles, pairs of its slices, each with a
tree of its own. Shards return a spanning forest of their links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.common import sorted_join, stored, task, texts, words_of
from tandem.llm.components import components

SHARD_ROWS = 8192
#: Tree searches of one numpy step: bounds the frontier of (query, node) pairs.
FRONTIER = 4_000_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, shingle: int = 4, seed: int = 42, wide: bool = False) -> bytes:
    """SimHash of the word shingles of a text, repeats included: 8 bytes of XXH64 bits, or 16 of XXH3's 128.

    A text of fewer words is one shingle; a text without words has fingerprint 0.
    """
    digest, width = (xxhash.xxh3_128_digest, 16) if wide else (xxhash.xxh64_digest, 8)
    words = words_of(text)
    if not words:
        return bytes(width)
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = digest(joined, seed)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(words) - shingle + 1].tolist()
        digests = b"".join([digest(joined[i:j], seed) for i, j in zip(start, end[shingle - 1 :].tolist(), strict=True)])
    raw = np.frombuffer(digests, np.uint8).reshape(-1, width)
    places = (raw.astype(np.intp) + np.arange(width) * 256).ravel()
    ones = (np.bincount(places, minlength=width * 256).reshape(width, 256) @ _BYTE_BITS).ravel()
    return np.packbits(2 * ones > len(raw)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, wide: bool = False) -> DataFrame:
    """(id, fp, fp2): the fingerprint of each row as signed 64-bit integers; null texts count as empty.

    fp2 is the second half of a wide fingerprint and 0 otherwise.
    """

    @task("simhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint(t, shingle, seed, wide) for t in texts(batch.column(1)))
            halves = np.frombuffer(found, ">u8").astype(np.uint64).view(np.int64).reshape(-1, 1 + wide)
            second = halves[:, 1] if wide else np.zeros(len(halves), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0]), pa.array(second)], names=[id_col, "fp", "fp2"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint, fp2 bigint")


def component_ids(prints: DataFrame, id_col: str = "doc_id", radius: int = 4, wide: bool = False) -> DataFrame:
    """`prints` with component_id, the smallest id reachable over links of `radius` bits or fewer.

    Equal fingerprints are linked, so copies are collapsed before any search.
    Null ids are a component's smallest only where it has no other. Of 64 bits
    all links are found. Wide prints share a shard when two of eight blocks of
    either half agree, whatever the number of rows: links of up to 16 differing bits
    of 128 are found nearly always, and rarer the farther apart they are.
    """
    # Of wide prints both halves name a node; the second half of the others is 0.
    halves = ["fp", "fp2"] if wide else ["fp"]
    node = F.struct(*halves) if wide else F.col("fp")
    firsts = prints.groupBy(*halves).agg(F.min(id_col).alias("_first"), *([] if wide else [F.min("fp2").alias("fp2")]))
    firsts = stored(firsts, "fingerprints")
    roots = components(links(firsts.select("fp", "fp2"), radius, wide), "fp", "near").withColumnRenamed("node", "_node")
    rooted = firsts.withColumn("_node", node).join(roots, "_node", "left")
    rooted = stored(rooted.select(*halves, "_first", F.coalesce("root", "_node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select(*halves, "component_id"), halves, "left")


def links(prints: DataFrame, radius: int, wide: bool = False) -> DataFrame:
    """(fp, near): links whose components are those of all pairs within `radius` bits that share a shard.

    Of wide prints both are structs (fp, fp2).
    """
    masks: dict[int, tuple[int, int]] = {0: (0, 0)}
    if wide:
        rows = stored(_crowded(_sharded(prints, _finer(masks, 8, wide))), "shards")
        return _search(_tiled(rows), radius, wide)
    rows, found = prints, []
    while True:
        masks = _finer(masks, radius + 2, wide)
        rows = stored(_crowded(_sharded(rows, masks)), "shards")
        found.append(_search(rows.where(F.col("n") <= SHARD_ROWS), radius))
        rows = rows.where(F.col("n") > SHARD_ROWS).select("shard_of", "fp", "fp2")
        above = {r[0] for r in rows.select("shard_of").distinct().toLocalIterator()}
        if not above:
            break
        masks = {code: mask for code, mask in masks.items() if code in above}
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _tiled(rows: DataFrame) -> DataFrame:
    """Shards of more than SHARD_ROWS fingerprints as tiles: every pair of slices of half as many, under a number of its own."""
    large = F.col("n") > SHARD_ROWS
    slices = F.when(large, F.ceil(F.col("n") * 2 / SHARD_ROWS)).otherwise(1)
    cut = rows.withColumn("_k", slices.cast("long")).withColumn("_s", F.pmod(F.xxhash64("fp", "fp2"), F.col("_k")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), lambda o: (o != F.col("_s")) | (F.col("_k") == 1))
    dealt = cut.withColumn("_o", F.explode(others))
    # Shards have numbers below 200; with the two slices behind them they name a tile.
    i, j = F.least("_s", "_o"), F.greatest("_s", "_o")
    return dealt.withColumn("shard_of", (i * F.col("_k") + j) * 200 + F.col("shard_of")).drop("_k", "_s", "_o")


def _finer(masks: dict[int, tuple[int, int]], blocks: int, wide: bool) -> dict[int, tuple[int, int]]:
    """Masks one level deeper: for each mask, those that fix two more of so many blocks of a half's free bits."""
    finer = {}
    for of, both in masks.items():
        k = 0
        for half in range(1 + wide):
            free = [b for b in range(64) if not both[half] >> b & 1]
            cut = [sum(1 << b for b in free[i::blocks]) for i in range(blocks)]
            for chosen in combinations(cut, 2):
                k += 1
                more = both[half] | sum(chosen)
                finer[of * 200 + k] = (more, both[1]) if half == 0 else (both[0], more)
    return finer


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sharded(rows: DataFrame, masks: dict[int, tuple[int, int]]) -> DataFrame:
    """One row for each shard of a fingerprint; below the first level, for the shards under its own mask."""

    def shards(codes: list[int]) -> Column:
        return F.array(*(
            F.struct(
                F.lit(c).cast("long").alias("shard_of"),
                F.col("fp").bitwiseAND(F.lit(_signed(masks[c][0]))).alias("k1"),
                F.col("fp2").bitwiseAND(F.lit(_signed(masks[c][1]))).alias("k2"),
            )
            for c in codes
        ))

    if "shard_of" not in rows.columns:
        return rows.select("fp", "fp2", F.explode(shards(list(masks))).alias("s")).select("s.*", "fp", "fp2")
    # A branch for each mask above; below the first level there are crowded shards alone.
    parts = []
    for above in sorted({c // 200 for c in masks}):
        own = rows.where(F.col("shard_of") == above).select("fp", "fp2").distinct()
        cut = F.explode(shards([c for c in masks if c // 200 == above]))
        parts.append(own.select("fp", "fp2", cut.alias("s")).select("s.*", "fp", "fp2"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows of shards that hold two fingerprints or more, with the shard's size."""
    key = ["shard_of", "k1", "k2"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return sorted_join(rows, sizes, key).select(*key, "fp", "fp2", "n")


def _search(rows: DataFrame, radius: int, wide: bool = False) -> DataFrame:
    key = ["shard_of", "k1", "k2"]
    node = "struct<fp:bigint,fp2:bigint>" if wide else "bigint"

    @task("simhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, fp in _whole_shards(batches):
            a, b = (_nodes(fp[x], wide) for x in shard_spanning(shard, fp, radius))
            yield pa.RecordBatch.from_arrays([a, b], names=["fp", "near"])

    dealt = rows.select(*key, "fp", "fp2").repartition(*key)
    return dealt.sortWithinPartitions(*key).mapInArrow(run, f"fp {node}, near {node}")


def _nodes(fp: np.ndarray, wide: bool) -> pa.Array:
    first, second = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in fp.T)
    return pa.StructArray.from_arrays([first, second], names=["fp", "fp2"]) if wide else first


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shard numbers and fingerprints (rows of two words) of some whole shards at a time."""
    kept = np.empty((5, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([kept, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        last = new[-1] if len(new) else 0
        if last:
            yield _numbered(rows[:, :last])
        kept = rows[:, last:]
    if kept.shape[1]:
        yield _numbered(kept)


def _numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    return np.cumsum(new) - 1, np.ascontiguousarray(rows[3:].T).view(np.uint64)


def shard_links(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the shards: first words of each fingerprint and of the first of its component in the shard."""
    a, b = shard_spanning(shard, fp, radius)
    return fp[a, 0], fp[b, 0]


def shard_spanning(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the shards: rows of each fingerprint and of the first of its component in the shard."""
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    size = np.bincount(shard).astype(np.int64)
    part = (np.cumsum(size**2) - size**2) // FRONTIER
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(size)]
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = np.searchsorted(shard, [first, end])
        tree = BKForest(shard[lo:hi] - first, fp[lo:hi])
        a, b = tree.spanning(radius)
        label = _local_components(hi - lo, a, b)
        member = np.flatnonzero(label != np.arange(hi - lo))
        out_a.append(lo + member)
        out_b.append(lo + label[member])
    return np.concatenate(out_a), np.concatenate(out_b)


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if np.array_equal(label, before):
            return label


class BKForest:
    """One BK-tree for each shard, in arrays.

    The edge from node p at distance d is the key 129 p + d; keys are sorted, so
    the edges of p within [d - r, d + r] are one slice.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray) -> None:
        """`shard` ascends from 0; fingerprints are distinct within a shard."""
        self.fp = fp
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = first[shard]
        item = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        at = self.root[item]
        keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(item):
            key = at * 129 + self.distance(item, at)
            order = np.argsort(key, kind="stable")
            item, key = item[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            children.append(item[new])
            at = item[new][np.cumsum(new) - 1][~new]
            item = item[~new]
        order = np.argsort(np.concatenate(keys))
        self.key, self.child = np.concatenate(keys)[order], np.concatenate(children)[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(axis=1, dtype=np.int64)

    def spanning(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs within `radius` bits that connect what all such pairs of a shard connect.

        Fingerprints near the root are linked with it, so pairs among them add
        nothing; only the others ask the tree.
        """
        every = np.arange(len(self.fp))
        near = (self.distance(every, self.root) <= radius) & (every != self.root)
        rest = every[~near & (every != self.root)]
        a, b = self.within(rest, radius)
        return np.concatenate([every[near], a]), np.concatenate([self.root[near], b])

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, other) for all fingerprints of the query's shard within `radius` bits of it."""
        found_a, found_b = [], []
        for some in np.array_split(query, max(1, len(query) // 4096)) if len(query) else []:
            node = self.root[some]
            while len(some):
                d = self.distance(some, node)
                hit = (d <= radius) & (some != node)
                found_a.append(some[hit])
                found_b.append(node[hit])
                lo = np.searchsorted(self.key, node * 129 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.key, node * 129 + np.minimum(d + radius, 128), "right")
                n = hi - lo
                some = np.repeat(some, n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                node = self.child[np.repeat(lo, n) + step]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])
