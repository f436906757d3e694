"""Recall of isolated near pairs, buckets of all sizes, and ids against the tokenizers library."""

import random

import numpy as np
import pytest

from tandem.llm import itq, token_files
from tandem.llm.queries import vocabulary

ROWS = "vec_id bigint, embedding array<double>, label int"


def isolated(width, cosine, n, seed):
    draw = np.random.default_rng(seed)
    a = draw.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = draw.normal(size=a.shape)
    away -= (away * a).sum(axis=1, keepdims=True) * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * away


def links(spark, x, labels):
    df = spark.createDataFrame([(i, [float(c) for c in v], int(g)) for i, (v, g) in enumerate(zip(x, labels, strict=True))], ROWS)
    return {r.vec_id: (r.n_links, r.component_id) for r in itq.near_duplicates(df).collect()}


def test_isolated_pairs_at_the_threshold(spark):
    """Two thousand pairs at cosine 0.9301 and 0.94, each alone in its surroundings."""
    found = total = 0
    for cosine in (0.9301, 0.94):
        a, b = isolated(64, cosine, 1000, 7)
        got = links(spark, np.concatenate([a, b]), np.arange(2000) % 1000 % 3)
        found += sum(got[1000 + i] == (1, i) for i in range(1000))
        total += 1000
        assert all(n <= 1 for n, _ in got.values())
    assert found / total >= 0.985


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_do_not_depend_on_the_size_of_buckets(spark, monkeypatch, tile):
    monkeypatch.setattr(itq, "TILE", tile)
    draw = np.random.default_rng(3)
    centre = draw.normal(size=64)
    crowd = centre + 0.22 * draw.normal(size=(120, 64))
    x = np.concatenate([crowd, draw.normal(size=(60, 64))])
    got = links(spark, x, np.zeros(len(x)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert 100 < want.sum()
    # Pairs near 0.93 that no table brings together are few, and the same ones for every tile.
    counted = np.array([got[i][0] for i in range(len(x))])
    assert (counted <= want).all() and counted.sum() >= 0.99 * want.sum()


def test_codes_within_the_radius_meet():
    draw = np.random.default_rng(2)
    for _ in range(3000):
        flips = draw.choice(itq.BITS, itq.RADIUS, replace=False)
        differ = np.array([sum(1 << int(b) for b in flips)], np.uint64)
        assert min(int(np.bitwise_count(itq._substring(differ, t))[0]) for t in range(itq.TABLES)) <= 2


ODD = ["a", "B", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "1", "12", ".", ",", "'s", "'t", "<|endoftext|>", "日本", "_", "-", " \n", "\x85", "\r", "İ", "²", "ـ", "word", "Other"]


@pytest.mark.parametrize(("name", "cuts"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_those_of_the_library(monkeypatch, name, cuts):
    from tokenizers import Tokenizer

    path = vocabulary().replace("byte_bpe_50k.json", name)
    monkeypatch.setattr(token_files, "KNOWN_PARTS", 400)
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 40)
    own, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    assert own.cuts == cuts
    draw = random.Random(4)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 30))) for _ in range(3000)] + ["", "word " * 20_000]
    for lo in range(0, len(texts), 256):
        some = texts[lo : lo + 256]
        want = [x.ids for x in plain.encode_batch_fast(some, add_special_tokens=False)]
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(some)] == want
