"""Exact dedup, collocations and centroid clusters against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import types
import unittest.mock

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tandem.llm import centroids, collocations, exact_dedup

# Columns that the operators use inside, as columns of the input.
DOCS = "doc_id bigint, text string, lang string, id string, digest string, row int, best int, size int, n int, phrase string, f int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4, "z", 5) for r in rows], DOCS)


# --- exact dedup -----------------------------------------------------------

COPIES = (
    [(i, "hot text", "en") for i in range(300)]
    + [(1000 + i, f"own {i}", "en") for i in range(200)]
    + [(2000 + i, f"pair {i % 40}", "en") for i in range(80)]
    + [(3000, None, None), (3001, "", "en"), (3002, "Hot text", "en"), (3003, "long " * 50_000, "en"), (3004, "long " * 50_000, "de")]
    + [(None, "hot text", "en"), (None, "alone", "en"), (None, "alone", "en"), (4000, "twin", "en"), (4000, "twin", "en")]
)


@pytest.mark.parametrize("parts", [1, 7])
def test_copies_against_brute_force(spark, parts):
    got = exact_dedup.deduplicate(table(spark, COPIES).repartition(parts)).collect()
    groups = collections.defaultdict(list)
    for i, text, _ in COPIES:
        groups[hashlib.sha256((text or "").encode()).digest()].append(i)
    want = collections.Counter()
    for h, ids in groups.items():
        best = max((x for x in ids if x is not None), default=None)
        for i in ids:
            want[i, best, len(ids), bytes(h)] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got) == want
    kept = collections.Counter(bytes(r.digest) for r in got if r.kept)
    assert kept == {h: 1 for h in groups}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_copies_of_normalised_texts_and_of_nothing(spark):
    df = table(spark, COPIES)
    low = exact_dedup.deduplicate(df, normalise=F.lower).where("doc_id = 3002").first()
    assert (low.keep_id, low.group_size, low.kept) == (3002, 302, True)
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_summary_bound(seed):
    draw = np.random.default_rng(seed)
    values = np.minimum(draw.zipf(1.3, 20_000), 10**6).astype(str)
    summary = exact_dedup.Summary(50)
    for part in np.array_split(values, 9):
        summary.add(pa.array(part.astype(object), pa.binary()))
    true = collections.Counter(values)
    found = {k.decode(): n for k, n in zip(summary.table["digest"].to_pylist(), summary.table["n"].to_pylist(), strict=True)}
    assert len(found) <= 50 and summary.rows == len(values)
    for value, n in true.items():
        assert n - len(values) / 51 <= found.get(value, 0) <= n


def test_every_heavy_digest_is_named(spark):
    """Frequent over the table though rare in each of many parts, among more digests than there are counters."""
    rows = [(i, f"heavy {i % 20}" if i % 5 == 0 else f"own {i}", "en") for i in range(40_000)]
    keys = exact_dedup.digests(table(spark, rows).repartition(16))
    named = {bytes(r.digest) for r in exact_dedup.frequent(keys).collect()}
    assert {hashlib.sha256(f"heavy {k}".encode()).digest() for k in range(0, 20, 5)} <= named
    assert len(named) <= exact_dedup.COUNTERS


# --- collocations ----------------------------------------------------------


def phrases(rows, least, longest, top):
    """All counts by plain dictionaries, every longer phrase compared with every shorter one."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        longer = [v for (o, q), v in often.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * v >= 80 * a for v in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def spoken(seed):
    draw = random.Random(seed)
    vocabulary = ["a", "b", "C", "É", "ß", "word", "other one", "x\x00y", "-", "日本"]
    rows = [(i, "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(draw.randint(0, 60))), draw.choice(["en", "de", None])) for i in range(80)]
    rows += [(100 + i, "new york city hall is open", "en") for i in range(30)]
    rows += [(None, None, "en"), (200, "", None), (201, "   ", "fr"), (202, "...", "fr"), (203, "the the " * 20_000, "en")]
    return rows


@pytest.mark.parametrize(("seed", "least", "top", "buffer"), [(1, 30, 2000, 6_000_000), (2, 3, 25, 500), (3, 1, 40, 6_000_000)])
def test_phrases_against_brute_force(spark, monkeypatch, seed, least, top, buffer):
    monkeypatch.setattr(collocations, "BUFFER_TOKENS", buffer)
    rows = spoken(seed)
    got = collocations.mine(table(spark, rows).repartition(3), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases(rows, least, 4, top)


class Texts:
    """Stands for a table of texts: takes the function that would run in a task."""

    sparkSession = sparkContext = property(lambda self: self)

    def broadcast(self, value):
        return types.SimpleNamespace(value=value)

    def mapInArrow(self, run, schema):
        self.run = run
        return unittest.mock.MagicMock()


class Every(collocations.Filter):
    """Holds every hash."""

    def __init__(self):
        self.bits, self.map = 22, np.full(1 << 19, 255, np.uint8)


@pytest.mark.parametrize(("count", "most"), [((collocations.frequent_pair_hashes, 3), 32), ((collocations.phrase_counts, 4), 64)])
def test_memory_of_a_task_is_bounded_by_its_buffer(spark, monkeypatch, count, most):
    """Peak bytes for each token of a buffer; 57 and 130 while arrays of whole buffers were made and those of the last buffer stayed."""
    monkeypatch.setattr(collocations, "BUFFER_TOKENS", 500_000)
    monkeypatch.setattr(collocations, "STEP", 1 << 16, raising=False)
    draw = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(300)])
    docs = [" ".join(words[draw.integers(0, 300, 10_000)]).encode() for _ in range(20)]
    batches = [pa.record_batch([pa.array(["en"] * 20), pa.array(docs)], names=["lang", "text"])] * 7
    texts, (by, last) = Texts(), count
    by(texts, Every(), last)
    tracemalloc.start()
    try:
        n = sum(pa.compute.sum(b.column("n")).as_py() for b in texts.run(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 140 * (9_999 if last == 3 else 9_999 + 9_998 + 9_997)
    assert peak < most * 500_000


def test_phrases_of_nothing(spark):
    assert collocations.mine(table(spark, spoken(1)).limit(0)).count() == 0


def test_filter_holds_all_that_it_was_given(spark):
    draw = np.random.default_rng(5)
    held = draw.integers(0, 2**64, 30_000, dtype=np.uint64)
    held[:3] = 0, 2**64 - 1, 2**63
    df = spark.createDataFrame([(int(x),) for x in held.view(np.int64)], "h bigint")
    some = collocations.Filter(df)
    assert some.may_hold(held).all()
    assert some.may_hold(draw.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 0.05
    assert not collocations.Filter(df.limit(0)).may_hold(held).any()


def test_scores_beyond_64_bits(spark):
    big = 10**13
    rows = [("en", "a b", big), ("en", "a", big + 7), ("en", "b", 3 * big)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, f bigint")).first()
    assert got.score == 2_000_000 * big // (4 * big + 7)


# --- centroids -------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int, id string, v string, cluster string, distance string, h string"


def nearest(vectors, centres):
    d = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize(("seed", "k", "spread"), [(0, 16, 100), (1, 5, 2), (2, 1, 9), (3, 40, 1), (4, 2, 3)])
def test_orchard_search_is_exact_with_ties(seed, k, spread):
    draw = np.random.default_rng(seed)
    centres = draw.integers(-spread, spread + 1, (k, 3))
    vectors = draw.integers(-2 * spread, 2 * spread + 1, (3000, 3))
    got, distance = centroids.Orchard(centres).nearest(vectors)
    want, least = nearest(vectors, centres)
    assert (got == want).all() and (distance == least).all()


def test_orchard_measures_fewer_than_all():
    draw = np.random.default_rng(9)
    centres = draw.integers(-1000, 1000, (30, 4))
    vectors = centres[draw.integers(0, 30, 2000)] + draw.integers(-5, 6, (2000, 4))
    search = centroids.Orchard(centres)
    measured = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if self is search.centroids and isinstance(key, np.ndarray):
                measured.append(len(key))
            return super().__getitem__(key)

    search.centroids = centres.view(Watched)
    got, _ = search.nearest(vectors)
    assert (got == nearest(vectors, centres)[0]).all()
    assert sum(measured) < 0.7 * 29 * len(vectors)


def clusters(rows, k, rounds):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    vectors = np.array([v for _, v in kept])
    centres = np.array([v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]])
    for _ in range(rounds):
        own, _ = nearest(vectors, centres)
        for c in set(own.tolist()):
            centres[c] = vectors[own == c].sum(axis=0) // (own == c).sum()
    own, distance = nearest(vectors, centres)
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    total = int(distance.sum())
    return sorted(((i if i is not None else -1), int(c), int(d), int(distance[own == c].sum()), total, sha[c]) for (i, _), c, d in zip(kept, own, distance, strict=True))


def vectors(spark, n, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 64))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.3 * draw.normal(size=64)], 1) for i in range(n)]
    same = [float(x) for x in centres[0]]
    rows += [(5, same, 2), (5, same, 2), (None, same, None), (7000, [0.0] * 64, 1), (7001, [-0.0] * 64, 1), (7002, [-0.001] * 64, 1)]
    rows += [(8000, None, 1), (8001, [], 1), (8002, [1.0] * 63, 1), (8003, [1.0] * 63 + [None], 1)]
    rows += [(8004, [1.0] * 63 + [math.nan], 1), (8005, [1.0] * 63 + [math.inf], 1), (8006, [1.0] * 65, 1)]
    return rows, spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS)


@pytest.mark.parametrize(("n", "seed", "parts"), [(400, 1, 5), (400, 2, 1), (3, 3, 2)])
def test_clusters_against_brute_force(spark, n, seed, parts):
    rows, df = vectors(spark, n, seed)
    got = centroids.with_inertia(*centroids.cluster(df.repartition(parts)))
    found = got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in found) == clusters(rows, 16, 3)


def test_clusters_of_nothing_and_of_too_large_components(spark):
    _, df = vectors(spark, 0, 1)
    for none in (df.limit(0), df.where("vec_id between 8000 and 8006")):
        got = centroids.with_inertia(*centroids.cluster(none))
        assert got.count() == 0
    large = spark.createDataFrame([(1, [1e30] + [0.0] * 63, 1, "a", "b", "c", "d", "e")], VECTORS)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(large)
