"""Links of exact Jaccard similarity among the texts of candidate groups.

A group is cut into slices and every pair of slices is a tile, so the work of a
large group spreads over tasks and no pair of its texts is left out. A tile
returns a spanning forest of its links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tandem.llm.common import grouped, stored, task, texts, words_of

#: Texts of a tile's slice.
SLICE_ROWS = 512


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct word shingles; a text of fewer words, or of none, is one shingle."""
    words = words_of(text)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    digests = (xxhash.xxh3_64_intdigest(joined[i:j]) for i, j in zip(start, end[shingle - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(digests, np.uint64, len(start)))


def spanning(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of Jaccard similarity `least` or more that connect what all such pairs connect.

    A set that is reached leaves the rest, so a dense group is compared few times.
    """
    size = np.array([len(s) for s in sets], np.int64)
    known, code = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.r_[0, np.cumsum(size)]
    left, rest = np.arange(len(sets)), code
    held = np.zeros(len(known), bool)
    found_a, found_b, queue = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left, rest = left[1:], rest[size[left[0]] :]
            continue
        x = queue.pop()
        own = code[cut[x] : cut[x + 1]]
        held[own] = True
        both = np.add.reduceat(held[rest], np.r_[0, np.cumsum(size[left])[:-1]], dtype=np.int64)
        held[own] = False
        near = both / (size[x] + size[left] - both) >= least
        if near.any():
            found_a.append(left[near])
            found_b.append(np.full(near.sum(), x))
            queue += left[near].tolist()
            rest, left = rest[np.repeat(~near, size[left])], left[~near]
    return np.concatenate(found_a), np.concatenate(found_b)


def links(candidates: DataFrame, shingle: int, least: float) -> DataFrame:
    """(h, near): links whose components are those of all pairs of similarity `least` or more within a group.

    `candidates` has (c, n, h, text): the group, the number of its texts, the
    number of the text, and the text.
    """

    @task("jaccard")
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle).tobytes() for t in texts(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["c", "n", "h", "s"])

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            h = table.column("h").to_numpy()
            a, b = spanning([np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("s")], least)
            yield pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(h[b])], names=["h", "near"])

    kept = candidates.select("c", "n", "h", "text").mapInArrow(sets, "c bigint, n bigint, h bigint, s binary")
    kept = stored(kept.dropDuplicates(["c", "h"]), "sets")
    slices = F.ceil(F.col("n") / SLICE_ROWS).cast("int")
    dealt = kept.select("c", "h", "s", slices.alias("_k")).withColumn("_s", F.pmod(F.xxhash64("h"), F.col("_k")).cast("int"))
    # One slice meets itself; of several, a tile has two and pairs within a slice are in all of its tiles.
    others = F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: (o != F.col("_s")) | (F.col("_k") == 1))
    every = dealt.select("c", "h", "s", "_s", F.explode(others).alias("_o"))
    tile = ["c", "i", "j"]
    tiles = every.select("c", F.least("_s", "_o").alias("i"), F.greatest("_s", "_o").alias("j"), "h", "s")
    return tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "h bigint, near bigint")
