"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample make the signs of the rotated vectors a
balanced code that keeps angles. The code is cut into TABLES disjoint substrings, one
Hamming table for each. A vector is entered under its own substring and under all that
differ from it in one bit, so two vectors whose substrings differ in two bits or fewer
meet in that table; and one of TABLES substrings does so whenever two codes differ
in at most RADIUS bits. What meets and differs in few enough bits of the whole code is
compared by the cosine of the original vectors.

Equal vectors are one row with a weight. A table row is a code of 8 bytes;
vectors only travel for members that have a near code. A bucket of more than
TILE rows is cut into tiles, pairs of its slices, so its work spreads over
tasks; a pair belongs to the first table in which it meets and to one bucket there, and is
counted there alone. Buckets return sums and spanning links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.common import grouped, sorted_join, stored, uniform
from tandem.llm.components import components

SAMPLE_ROWS = 10_000
ITERATIONS = 50
BITS = 64
#: Substrings of KEY_BITS bits.
TABLES = 4
KEY_BITS = BITS // TABLES
#: Codes that differ in so many bits meet for certain; others, by chance, most times (see the readme).
RADIUS = 3 * TABLES - 1
#: Codes that differ in more bits are not compared: 8 are expected at 0.93, and 20 lie over four deviations above.
NEAR_BITS = 20
TILE = 2048


@dataclass
class Coder:
    """Rotations from unit vectors to codes of BITS bits."""

    rotation: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit @ self.rotation >= 0).astype(np.uint8)
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def learn(unit: np.ndarray) -> Coder:
    """Principal axes of the sample, then rotations that bring it nearest to its own signs.

    Vectors shorter than BITS get several rotations from different starts, until there are BITS signs.
    """
    draw = np.random.default_rng(11)
    k = min(unit.shape[1], BITS)
    _, _, axes = np.linalg.svd(unit.T @ unit)
    projected = unit @ axes[:k].T
    turns = []
    for _ in range(-(-BITS // k)):
        turn = np.linalg.qr(draw.normal(size=(k, k)))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        turns.append(axes[:k].T @ turn)
    # Bits of one rotation are dealt over the substrings.
    return Coder(np.concatenate(turns, axis=1)[:, :BITS][:, draw.permutation(BITS)])


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", cosine: float = 0.93
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row, linked by cosine within equal groups.

    Vectors that are null, zero, or hold null or non-finite components, and rows
    without a group link with nothing. Each length of vectors has a rotation of
    its own and is searched on its own.
    Rows may repeat ids and vectors: each row is a vector of its own. An empty
    table gives an empty result.
    """
    v = F.col("v")
    sound = F.col("g").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    lengths = [r["d"] for r in base.where("sound").select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not lengths:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    base = base.withColumn("h", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))
    one = stored(base.where("sound").groupBy("g", "h").agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.min("v").alias("v")), "vectors")
    one = one.withColumn("ref", F.xxhash64("g", "h"))

    found = None
    for d in lengths:
        own = one.where(F.size("v") == d)
        sample = own.orderBy(uniform("itq", F.col("h")), "g").limit(SAMPLE_ROWS).select("v").toArrow()
        coder = learn(_unit(_matrix(sample.column(0).combine_chunks())))
        coded = stored(_coded(own, coder), "codes")
        linked = stored(_linked(own, coded, cosine), "links")
        found = linked if found is None else found.unionByName(linked)

    sums = found.groupBy("ref").agg(F.sum("n").alias("n"))
    roots = components(found, "ref", "near").withColumnRenamed("node", "ref")
    members = one.select("ref", "g", "h", "first", "weight").join(sums, "ref", "left").join(roots, "ref", "left")
    members = stored(members.withColumn("root", F.coalesce("root", "ref")), "members")
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    members = members.join(least, "root").select("g", "h", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "least")
    keyed = base.withColumn("h", F.when(F.col("sound"), F.col("h")))
    joined = keyed.join(members, ["g", "h"], "left")
    component = F.coalesce("least", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaling first keeps very large and very small components finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(one: DataFrame, coder: Coder) -> DataFrame:
    shared = one.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.codes(_unit(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64)), batch.column(2)], names=["ref", "code", "g"])

    return one.select("ref", "v", F.xxhash64("g").alias("g")).mapInArrow(run, "ref bigint, code bigint, g bigint")


KEY = ("g", "t", "k")


def substring(code: Column, table: int) -> Column:
    return F.shiftrightunsigned(code, BITS - KEY_BITS * (table + 1)).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def _linked(one: DataFrame, coded: DataFrame, cosine: float) -> DataFrame:
    """(ref, n, near): for each bucket tile, the weights linked with a vector and one spanning link."""
    own = F.array(*(F.struct(F.lit(t).alias("t"), substring(F.col("code"), t).alias("k")) for t in range(TABLES)))
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << b).cast("bigint") for b in range(KEY_BITS)))
    dealt = coded.select("ref", "code", "g", F.explode(own).alias("s")).select("ref", "code", "g", "s.*", F.explode(flips).alias("flip"))
    dealt = dealt.select("g", "t", F.col("k").bitwiseXOR(F.col("flip")).alias("k"), "ref", "code")
    sizes = dealt.groupBy(*KEY).agg(F.count("*").alias("size")).where("size > 1")
    met = stored(sorted_join(dealt, sizes, list(KEY)), "met")

    small = met.where(F.col("size") <= TILE).select(*KEY, "ref", "code").repartition(*KEY).sortWithinPartitions(*KEY)
    near = small.mapInArrow(_near_codes, "g bigint, t int, k bigint, ref bigint").withColumn("slices", F.lit(1))
    large = met.where(F.col("size") > TILE).select(*KEY, "ref", F.ceil(F.col("size") / TILE).cast("int").alias("slices"))
    every = near.unionByName(large).withColumn("slice", F.pmod(F.xxhash64("ref", "t"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    every = every.withColumn("_o", other).withColumns({"i": F.least("slice", "_o"), "j": F.greatest("slice", "_o")})
    vectors = one.select("ref", "v", "weight").join(coded.select("ref", "code"), "ref")
    tiles = sorted_join(every.select(*KEY, "i", "j", "slice", "ref"), vectors, ["ref"])
    tile = [*KEY, "i", "j"]
    tiles = tiles.select(*tile, "slice", "ref", "code", "weight", "v").repartition(*tile).sortWithinPartitions(*tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 5):
            yield _compared(table, cosine)

    return tiles.mapInArrow(run, "ref bigint, n bigint, near bigint")


def _near_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a bucket that have a near code in it; many small buckets are compared at once."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        # The last bucket may go on in the next batch.
        bucket = _numbered(kept)
        whole = int(np.searchsorted(bucket, bucket[-1]))
        yield from _near_rows(kept.slice(0, whole), bucket[:whole])
        kept = kept.slice(whole)
    if kept is not None:
        yield from _near_rows(kept, _numbered(kept))


def _numbered(table: pa.Table) -> np.ndarray:
    keys = np.stack([table.column(c).to_numpy() for c in KEY])
    return np.cumsum(np.r_[0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])


def _near_rows(table: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    code = table.column("code").to_numpy().view(np.uint64)
    keep = np.zeros(len(code), bool)
    rows, step = np.arange(len(code)), 1
    while len(rows):
        # Rows that have another of their bucket `step` places on.
        rows = rows[rows + step < len(code)]
        rows = rows[bucket[rows] == bucket[rows + step]]
        near = rows[np.bitwise_count(code[rows] ^ code[rows + step]) <= NEAR_BITS]
        keep[near] = keep[near + step] = True
        step += 1
    if keep.any():
        yield from table.select(["g", "t", "k", "ref"]).take(np.flatnonzero(keep)).combine_chunks().to_batches()


def _substring(code: np.ndarray, table: int) -> np.ndarray:
    return (code >> np.uint64(BITS - KEY_BITS * (table + 1))) & np.uint64((1 << KEY_BITS) - 1)


def _own_bucket(x: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The smallest key under which two substrings, x and x ^ differ, that differ in two bits or fewer, are both entered."""
    low = differ & (~differ + np.uint64(1))
    return np.where(differ == low, np.minimum(x, x ^ differ), np.minimum(x ^ low, x ^ differ ^ low))


def _compared(table: pa.Table, cosine: float) -> pa.RecordBatch:
    t, k, i, j = (table.column(c)[0].as_py() for c in ("t", "k", "i", "j"))
    part, ref, weight = (table.column(c).to_numpy() for c in ("slice", "ref", "weight"))
    code = table.column("code").to_numpy().view(np.uint64)
    unit = _unit(_matrix(table.column("v").combine_chunks()))
    a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
    n, near = np.zeros(len(ref), np.int64), np.arange(len(ref))
    for lo in range(0, len(a), 512):
        own = a[lo : lo + 512]
        hit = unit[own] @ unit[b].T >= cosine
        x, y = np.nonzero(hit)
        x, y = own[x], b[y]
        good = x < y if i == j else np.ones(len(x), bool)
        x, y = x[good], y[good]
        differ = code[x] ^ code[y]
        # The first table in which the two meet has the pair, in one of its buckets.
        mine = np.bitwise_count(differ) <= NEAR_BITS
        for earlier in range(t):
            mine &= np.bitwise_count(_substring(differ, earlier)) > 2
        mine &= _own_bucket(_substring(code[x], t), _substring(differ, t)) == k
        x, y = x[mine], y[mine]
        np.add.at(n, x, weight[y])
        np.add.at(n, y, weight[x])
        low, high = np.minimum(x, y), np.maximum(x, y)
        near = _spanned(near, low, high)
    rows = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(ref[rows]), pa.array(n[rows]), pa.array(ref[near[rows]])], names=["ref", "n", "near"])


def _spanned(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each row, with the links (a, b) added."""
    while True:
        before = label.copy()
        least = np.minimum(before[a], before[b])
        for ends in (a, b, before[a], before[b]):
            np.minimum.at(label, ends, least)
        label = label[label]
        if np.array_equal(label, before):
            return label
