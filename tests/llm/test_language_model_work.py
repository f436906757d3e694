"""What scoring a block costs, in numbers looked at, and that many small pieces are coded as single ones are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import elias_fano, language_model
from tandem.llm.elias_fano import EliasFano, decode_each, encode, encode_each


@pytest.fixture(scope="module")
def block():
    draw = np.random.default_rng(5)
    tokens = np.minimum(draw.zipf(1.3, 30_000) - 1, 999).astype(np.uint32)
    sizes = np.full(100, 300)
    grams = language_model.Grams(draw.integers(1, 2**63, 1000).astype(np.uint64), tokens, sizes, 3)
    train = np.repeat(np.arange(100) % 7 != 2, sizes)
    return grams, train, sizes, [np.bincount(of[train], minlength=len(h)) for of, h in zip(grams.of, grams.hash, strict=True)]


def test_strengths_round_each_share_once_for_equal_contexts(block, monkeypatch):
    grams, train, sizes, counts = block
    rounded, of = [], language_model._quantised
    monkeypatch.setattr(language_model, "_quantised", lambda x: rounded.append(len(x)) or of(x))
    language_model.score_block(grams, train, sizes, counts, int(train.sum()), 900, 85)
    seen = sum(int((c > 0).sum()) for c in counts[1:])
    contexts = sum(len(np.union1d(c, [85])) for c in counts[:2])
    assert sum(rounded) <= len(language_model.STRENGTHS) * (len(counts[0]) + seen + contexts)


def test_many_searches_read_each_low_value_once(monkeypatch):
    values = np.cumsum(np.random.default_rng(2).integers(1, 1000, 20_000)).astype(np.uint64)
    code, read, low = EliasFano(encode(values)), [], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, i: read.append(len(i)) or low(self, i))
    assert (code.find(values) == np.arange(len(values))).all()
    assert sum(read) <= len(values)


@pytest.mark.parametrize("many", [10**9, 0], ids=["many", "few"])
def test_many_and_few_searches_agree(many, monkeypatch):
    monkeypatch.setattr(elias_fano, "MANY", many)
    draw = np.random.default_rng(4)
    for top, n in ((0, 5), (40, 300), (10**7, 300), (2**62, 3), (9, 0)):
        values = np.sort(draw.integers(0, top + 1, n).astype(np.uint64))
        code, asked = EliasFano(encode(values)), np.r_[draw.integers(0, top + 2, 99).astype(np.uint64), values]
        first = np.searchsorted(values, asked)
        assert (code.successor(asked) == first).all()
        assert (code.find(asked) == np.where(np.isin(asked, values), first, -1)).all()
        assert (code.access(np.arange(n)) == values).all()


def test_pieces_coded_together_are_those_coded_alone():
    draw = np.random.default_rng(1)
    runs = [np.sort(draw.integers(0, top + 1, n).astype(np.uint64)) for top in (0, 7, 2**48, 2**62) for n in (0, 1, 70, 0)]
    codes = encode_each(np.concatenate(runs), np.cumsum([len(x) for x in runs]))
    assert codes == [encode(x) for x in runs]
    values, sizes = decode_each(codes)
    assert (values == np.concatenate(runs)).all() and sizes.tolist() == [len(x) for x in runs]
    assert all((EliasFano(x).all() == run).all() for x, run in zip(codes, runs, strict=True))


@pytest.mark.parametrize("top", [6, 2**40, 2**62])
def test_distinct_numbers_of_any_width(top):
    x = np.random.default_rng(0).integers(0, top, 500)
    values, place = language_model._distinct(x)
    assert (values == np.unique(x)).all() and (values[place] == x).all()
    assert [len(a) for a in language_model._distinct(x[:0])] == [0, 0]


def test_requests_ascend_within_their_shards(block):
    grams = block[0]
    for k in range(3):
        order, shard = language_model._asked(grams, k, 7)
        h = grams.hash[k][order]
        key = h if k == 0 else h & np.uint64(2**48 - 1)
        assert sorted(order.tolist()) == list(range(len(h)))
        assert (shard == (h >> np.uint64(48)) % np.uint64(7)).all() and (np.diff(shard) >= 0).all()
        assert (key[1:] >= key[:-1])[np.diff(shard) == 0].all()


def test_scores_are_the_same_for_any_number_of_shards(spark, rows, monkeypatch):
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 3, F.col("id") % 5, F.lit("a"), F.col("id") % 7).alias("text"))
    one = rows(language_model.score(docs, F.col("doc_id") % 7 == 2))
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 4)
    assert rows(language_model.score(docs, F.col("doc_id") % 7 == 2)) == one
