"""Pooling and padding move numbers that stand for vectors; the vectors come once, at the end."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import embed
from tandem.plans import inputs as inp
from tandem.plans.catalog import QUERIES

ODD = [(0, [1.0]), (1, [2.0]), (1, [2.5]), (3, None), (None, [9.0]), (5, [6.0])]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Turns of a few words, one null, one twice; vectors with gaps, doubles and nulls among their numbers."""
    sf = str(tmp_path_factory.mktemp("odd"))
    turns = [(c, t, "user", " ".join("abcdefghijkl"[: 1 + (c * 5 + t * 3 + i) % 11] for i in range((c * 3 + t) % 7))) for c in range(9) for t in range(4)]
    turns += [turns[5], (20, 0, "user", None), (None, 1, "user", "a b c"), (21, 0, "user", "")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    wide = [(i, None if v is None else v * 64, 1) for i, v in ODD]
    spark.createDataFrame(wide, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    return sf


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved_vectors(df):
    """Exchanges, but that of the stored vectors, whose rows hold a vector."""
    lines = plan(df).splitlines()
    own = lambda i: re.match(r"[ :|+*-]*", lines[i]).end()
    found = []
    for i, line in enumerate(lines):
        if re.search(r"[+*-] Exchange ", line):
            below = [own(i)]
            while len(below) < len(lines) - i and own(i + len(below)) > below[0]:
                below.append(own(i + len(below)))
            under = "\n".join(lines[i + 1 : i + len(below)])
            if "vec#" in under and "Join" in under:
                found.append(line)
    return found


def test_cls_is_picked_by_number_without_sorting_vectors(spark, odd):
    df = QUERIES["pool_cls"](spark, odd)
    assert "SortAggregate" not in plan(df)
    assert not moved_vectors(df)


def test_cls_with_gaps_doubles_and_nulls(spark, odd):
    want = {}
    for r in inp.subwords(spark, odd).where("not is_pad").collect():
        for first in (True, False):
            rows = want.setdefault((first, r.sent_id), {})
            rows.setdefault(r.subword_pos, []).append(None if r.vec is None else r.vec[0])
    want = {k: v[(min if k[0] else max)(v)] for k, v in want.items()}
    got = {(r.cls_first, r.sent_id): r.value for r in QUERIES["pool_cls"](spark, odd).where("j = 0").collect()}
    assert set(got) == {k for k, v in want.items() if v.count(None) < len(v)}
    assert all(got[k] in want[k] for k in got)
    assert QUERIES["pool_cls"](spark, odd).count() == 64 * len(got)


def words_by_hand(spark, odd):
    starts = {}
    for r in inp.word_starts(spark, odd).collect():
        starts.setdefault((r.sent_id, r.start), []).append(r.word_pos)
    text = lambda v: None if v is None else ",".join([str(round(v[0] * 10000))] * 64)
    rows = inp.subwords(spark, odd).collect()
    return rows, sorted([(r.sent_id, p, str(text(r.vec))) for r in rows for p in starts.get((r.sent_id, r.subword_pos), [])]), text


def test_word_vectors_behind_the_sentence_vector(spark, odd):
    df = QUERIES["pool_word_with_cls"](spark, odd)
    assert "SortAggregate" not in plan(df) and not moved_vectors(df)
    rows, words, text = words_by_hand(spark, odd)
    got = [(r.sent_id, r.word_pos, str(r["items"])) for r in df.collect()]
    assert sorted((s, p - 1, i) for s, p, i in got if p) == words
    cls = {}
    for r in sorted((r for r in rows if not r.is_pad), key=lambda r: -r.subword_pos):
        cls[r.sent_id] = {str(text(x.vec)) for x in rows if (x.sent_id, x.subword_pos) == (r.sent_id, r.subword_pos)}
    front = [(s, i) for s, p, i in got if p == 0]
    assert sorted(s for s, _ in front) == sorted(cls) and all(i in cls[s] for s, i in front)


def test_mean_sums_blocks_of_vectors(spark, odd, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK_VECTORS", 2)
    monkeypatch.setattr(embed, "STRETCH", 3)
    rows = inp.subwords(spark, odd).collect()
    got = {(r.include_pad, r.sent_id): r.value for r in QUERIES["pool_mean"](spark, odd).where("j = 63").collect()}
    for pad in (True, False):
        of = {}
        for r in rows:
            if pad or not r.is_pad:
                of.setdefault(r.sent_id, []).extend([] if r.vec is None else [r.vec[63]])
        assert {s for p, s in got if p is pad} == set(of)
        assert all(got[pad, s] == (pytest.approx(np.mean(v), abs=1e-6) if v else None) for s, v in of.items())
    assert not moved_vectors(QUERIES["pool_mean"](spark, odd))


def test_item_sums_and_ids_by_hand():
    from tandem.functions import vectors as vx

    import pyarrow as pa

    v = pa.array([[1.0, 2.0, 9.0], None, [3.0], [], [None, 4.0]], pa.list_(pa.float32()))
    assert vx.item_sums(v.slice(0), 2).tolist() == [[1, 2, 1, 1], [0, 0, 0, 0], [3, 0, 1, 0], [0, 0, 0, 0], [0, 4, 0, 1]]
    assert vx.item_sums(v.slice(1, 1), 2).tolist() == [[0, 0, 0, 0]] and vx.item_sums(v[:0], 2).shape == (0, 4)
    ids, rows = vx.fold_rows([(np.array([5, 1]), np.array([[1.0], [2.0]])), (np.array([5]), np.array([[4.0]]))])
    assert ids.tolist() == [1, 5] and rows.tolist() == [[2.0], [5.0]]
    assert vx.find_rows(ids, np.array([5, 2, 9]))[1].tolist() == [True, False, False]
    assert not vx.find_rows(ids[:0], np.array([5])) [1].any()


def test_padding_moves_numbers(spark, odd):
    df = QUERIES["batch_pad_words"](spark, odd)
    assert not moved_vectors(df) and "collect_list(struct(word_pos" in re.sub(r"#\d+", "", plan(df)).replace("named_struct", "struct")
    p = re.sub(r"#\d+L?", "", plan(df))
    assert not re.search(r"collect_list\([^\n]*\bvec\b", p)
    rows, words, _ = words_by_hand(spark, odd)
    of = {}
    for s, p, i in words:
        of.setdefault(s, []).append(i)
    got = {}
    for r in df.collect():
        got.setdefault((r.sent_id, r.batch_id), {}).setdefault(r.word_pos, []).append(str(r["items"]))
    zero = ",".join(["0"] * 64)
    assert {s for s, _ in got} == set(of)
    for (s, _), at in got.items():
        items = [i for p in sorted(at) for i in at[p]]
        assert sorted(at) == list(range(len(at)))
        if all(len(x) == 1 for x in at.values()):
            assert sorted(items[: len(of[s])]) == sorted(of[s]) and set(items[len(of[s]) :]) <= {zero}


def test_first_subwords_are_joined_by_number(spark, odd):
    df = QUERIES["pool_word_first"](spark, odd)
    assert not moved_vectors(df)
    got = sorted((r.sent_id, r.word_pos, str(r["items"])) for r in df.collect())
    assert got == words_by_hand(spark, odd)[1]


def test_starts_are_handed_on_in_runs_of_items(spark, monkeypatch):
    import pyarrow as pa

    from tandem.functions import vectors as vx

    column = pa.array([[1, 2], None, [], [3] * 9, [4], [5, 6], [7]], pa.list_(pa.int32())).slice(0)
    for most in (1, 2, 4, 100):
        runs = list(vx._runs(column, most))
        assert all(len(r) == 1 or vx.row_lengths(r).sum() <= most for r in runs) and sum(map(len, runs)) == 7
        got = [s for r in runs for s in vx._starts(r, 1).to_pylist()]
        assert got == [[1, 2], [], [], list(range(1, 28, 3)), [1], [1, 6], [1]]
    assert [len(r) for r in vx._runs(column[:0], 4)] == [0]
    rows = [(i, [(i + j) % 7 for j in range(i % 40)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, c array<int>").coalesce(1)
    assert vx.RUN_ITEMS < 1 << 20
    got = df.select("i", vx.running_start("c", 0).alias("s")).collect()
    assert all(r.s == [sum(rows[r.i][1][:k]) for k in range(len(rows[r.i][1]))] for r in got)
