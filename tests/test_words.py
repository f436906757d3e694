"""Words of a corpus: subword rows, vocabulary, word vectors and padding by key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import batching, combine as cb, embed, tokens
from tandem.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_subword_rows_by_hand(spark):
    df = spark.createDataFrame(
        [(1, ["ab", "", "c"], [2, 0, 1]), (2, [], []), (3, None, None)], "sent_id bigint, words array<string>, counts array<int>"
    )
    got = [tuple(r) for r in tokens.subword_table(df, "counts", ["words"], pad_to=4).orderBy("sent_id", "subword_pos").collect()]
    special = (None, False, False, None)
    assert got == [
        (1, 0, *special), (1, 1, 0, True, False, "ab"), (1, 2, 0, False, False, None), (1, 3, 2, True, False, "c"),
        (1, 4, *special), *((1, p, None, False, True, None) for p in (5, 6, 7)),
        (2, 0, *special), (2, 1, *special), (2, 2, None, False, True, None), (2, 3, None, False, True, None),
    ]
    assert tokens.subword_table(df, "counts").where("sent_id = 1").count() == 5
    assert tokens.subword_table(df.limit(0), "counts", ["words"]).count() == 0


def test_first_subwords_are_the_word_starts(spark):
    df = spark.createDataFrame([(i, [(i * 7 + j) % 5 + 1 for j in range(i % 9)]) for i in range(60)], "sent_id bigint, counts array<int>")
    rows = tokens.subword_table(df, "counts")
    starts = df.select("sent_id", F.posexplode(tokens.word_starts(F.col("counts"))).alias("word_pos", "start"))
    got = embed.first_subwords(rows, "subword_pos").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, starts.collect()))


@pytest.mark.parametrize("parts", [1, 7])
def test_vocabulary_tokenizes_each_word_of_the_corpus_once(spark, tmp_path, parts):
    log = tmp_path / f"calls-{parts}"
    log.mkdir()

    def tokenize(words):
        import uuid
        from pathlib import Path

        (Path(log) / uuid.uuid4().hex).write_text("\n".join(words))
        return [len(w) - 1 + 2 for w in words]

    hot = [(i, ["the"] * 40 + [f"w{i % 50}"]) for i in range(400)]
    df = spark.createDataFrame([*hot, (400, []), (401, None), (402, [None, "x"])], "sent_id bigint, words array<string>").repartition(parts)
    vocab = tokens.vocabulary(df, tokenize)
    encoded = {r.sent_id: r for r in tokens.encode_words(df, vocab).collect()}
    asked = [w for f in log.iterdir() for w in f.read_text().split("\n")]
    assert sorted(asked) == sorted({" the", " x", *(f" w{i}" for i in range(50))})
    ids = {r.word: r.word_id for r in vocab.collect()}
    import hashlib

    assert [w for w, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(ids, key=lambda w: hashlib.md5(w.encode()).hexdigest())
    assert sorted(ids.values()) == list(range(52))
    assert {r.word: r.c for r in vocab.collect()}["the"] == 16_000
    assert encoded[7].words == ["the"] * 40 + ["w7"] and encoded[7].counts == [3] * 40 + [2]
    assert encoded[7].word_ids == [ids["the"]] * 40 + [ids["w7"]]
    assert encoded[400].words == encoded[401].counts == [] and encoded[402].words == ["x"] and len(encoded) == 403


def test_a_word_outside_the_vocabulary_stops_the_query(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "sent_id bigint, words array<string>")
    vocab = tokens.vocabulary(df.where("sent_id = 2"), lambda ws: [3 for _ in ws])
    with pytest.raises(Exception, match="lacks a word of sentence 1"):
        tokens.encode_words(df, vocab).collect()
    none = df.limit(0)
    empty = tokens.vocabulary(none, lambda ws: [3 for _ in ws])
    assert empty.count() == 0 and tokens.encode_words(none, empty).count() == 0


@pytest.mark.parametrize("n", [2, 3])
def test_words_of_several_encoders_meet_by_sentence_and_word(spark, n):
    words = [(s, p) for s in range(20) for p in range(s)]
    made = lambda rows: spark.createDataFrame([(s, p, [float(s), float(p)]) for s, p in rows], "sent_id bigint, word_pos int, vec array<double>")
    tables = [made(words) for _ in range(n)]
    keys = ["sent_id", "word_pos"]
    got = cb.align(tables, keys).collect()
    assert len(got) == len(words) and all(r[f"vec_{n}"] == [r.sent_id, r.word_pos] for r in got)
    with pytest.raises(Exception, match="no vector of sentence 5, 2"):
        cb.align([*tables[1:], made([w for w in words if w != (5, 2)])], keys).collect()
    assert cb.align([*tables[1:], made([w for w in words if w != (5, 2)])], keys, drop_missing=True).count() == len(words) - 1


def test_arrays_are_padded_to_the_longest_of_their_batch(spark):
    lengths = [(i * 7) % 11 for i in range(53)]
    df = spark.createDataFrame([(i * i, list(range(n)), list(range(n))) for i, n in enumerate(lengths)], "sent_id bigint, a array<bigint>, b array<bigint>")
    got = batching.pad_by_key(
        df.repartition(5), df.select("sent_id", F.size("a").alias("n")), 4, {"a": batching.tag_fill(), "b": F.lit(0).cast("bigint")}
    ).orderBy("sent_id").collect()
    for i, r in enumerate(got):
        longest = max(lengths[i // 4 * 4 : i // 4 * 4 + 4])
        assert (r.sent_id, r.batch_id, r.pos_in_batch) == (i * i, i // 4, i % 4)
        assert r.a == list(range(lengths[i])) + [-1] * (longest - lengths[i])
        assert r.b == list(range(lengths[i])) + [0] * (longest - lengths[i])


@pytest.mark.parametrize("name", ["cmb_dme_words", "rpt_word_tags", "loss_tags", "head_tag_words"])
def test_word_plans_parse_the_text_once(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert len([line for line in p.splitlines() if "split(" in line]) == 1
    assert p.count("ArrowEvalPython") == 1
    # One scan reads texts, and the vectors meet their subwords in one join; batches are numbered from keys alone.
    assert len([line for line in p.splitlines() if "ReadSchema" in line and "text:" in line]) == 1
    assert name == "loss_tags" or p.count("Join") == 1


def test_one_pass_keeps_extra_columns_and_empty_tables(spark):
    from tandem.plans import inputs as inp

    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0], "x")], "sent_id bigint, vec_1 array<double>, vec_2 array<double>, extra string")
    out = cb.combine(df, ["vec_1", "vec_2"], "dme", inp.dme_params((2, 1)))
    assert out.columns == [*df.columns, "dme_scores", "vec"] and np.isclose(sum(out.first().dme_scores), 1)
    assert cb.combine(df.limit(0), ["vec_1", "vec_2"], "dme", inp.dme_params((2, 1))).count() == 0
    with pytest.raises(ValueError):
        cb.combine(df, ["vec_1", "vec_2"], "dme")
