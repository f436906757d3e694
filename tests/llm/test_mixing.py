"""The mix against a plain loop: targets, inclusion probabilities and the copies of each document."""

import collections
import hashlib
import math

import numpy as np
import pytest

from tandem.llm import mixing

SCHEMA = "doc_id bigint, source string, size bigint"


def u_of(doc_id):
    digest = hashlib.md5(f"mix|{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / (1 << 52)


def top_bits(size):
    cut = max(size.bit_length() - 4, 0)
    return size >> cut << cut


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free -= set(over or free)
    return target


def plain_chances(sizes, rest):
    """p of each size by bisection of the factor, not by the classes in order."""
    low, high = 0.0, 1.0
    words = lambda c: sum(min(1.0, c * top_bits(s)) * s for s in sizes)
    while words(high) < rest and high < 2.0**60:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < rest else (low, mid)
    return {s: min(1.0, high * top_bits(s)) if s else min(1.0, rest / sum(sizes)) for s in set(sizes)}


def plain_mix(rows):
    sizes = collections.defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size or 0
    target, copies = plain_targets(sizes), {}
    for source, total in sizes.items():
        own = [(d, size or 0) for d, s, size in rows if s == source]
        if not total:
            copies.update({d: 1 for d, _ in own})
            continue
        whole = math.floor(target[source] / total)
        rest = target[source] - whole * total
        copies.update({d: whole for d, _ in own})
        if rest <= 0:
            continue
        p = plain_chances([s for _, s in own], rest)
        odds = lambda d, s: u_of(d) / (1 - u_of(d)) * (1 - p[s]) / p[s]
        taken = 0
        for d, s in sorted(own, key=lambda x: (odds(*x) if p[x[1]] < 1 - 1e-12 else -1.0, x[0])):
            taken += s
            if taken - s / 2 > rest:
                break
            copies[d] += 1
    return target, copies


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_copies_are_those_of_a_plain_loop(spark, seed):
    draw = np.random.default_rng(seed)
    names = [None, "a", "b", "c", "d"]
    shares = [0.05, 0.6, 0.2, 0.1, 0.05]
    # Some very long documents are certain, as their share would pass one.
    size = lambda: None if draw.random() < 0.03 else int(draw.pareto(1.1) * 20)
    rows = [(k, names[int(draw.choice(5, p=shares))], size()) for k in range(2000)] + [(5000, "empty", 0), (5001, "empty", None)]
    target, copies = plain_mix(rows)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows) and max(copies.values()) <= 3
    assert {r.source: r.target for r in got} == pytest.approx(target)
    differ = [r.id for r in got if r.copies != copies[r.id]]
    assert not differ, differ[:5]


def test_longer_documents_are_taken_more_often(spark):
    rows = [(k, "b" if k % 4 else "a", 10 if k % 2 else 40) for k in range(8000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).where("source = 'b'").collect()
    assert {math.floor(r.target / r.source_size) for r in got} == {0}
    share = {s: np.mean([r.copies for r in got if r.size == s]) for s in (10, 40)}
    assert share[40] == pytest.approx(4 * share[10], rel=0.15)


def test_no_fourth_copy_and_ties(spark):
    rows = [(k, "big", 1000) for k in range(60)] + [(100 + k, "a", 0 if k % 2 else 3) for k in range(60)] + [(7, "a", 3)] * 5
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.copies for r in got if r.source == "a"} == {3} and len(got) == len(rows)


def test_size_classes(spark):
    sizes = [0, 1, 15, 16, 17, 31, 33, 1000, 2**40 + 12345]
    df = spark.createDataFrame([(s,) for s in sizes], "size bigint")
    got = df.select("size", mixing.size_class(df["size"]).alias("m")).collect()
    assert all(r.m == top_bits(r["size"]) for r in got)
