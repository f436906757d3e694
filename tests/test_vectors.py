import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import arrays as ax, vectors as vx
from tandem.operators import combine as cb, embed, heads, tokens
from tandem.plans import inputs as inp

RNG = np.random.default_rng(0)
X1, X2 = RNG.normal(size=(20, 4)), RNG.normal(size=(20, 3))


@pytest.fixture
def aligned(spark):
    one = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X1)], "sent_id bigint, vec array<double>")
    two = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X2)], "sent_id bigint, vec array<double>")
    return cb.align([one.repartition(3), two])


def column(df, name):
    return np.array([r[0] for r in df.orderBy("sent_id").select(name).collect()])


def by_hand(params, x=(X1, X2)):
    hs = [x_ @ np.array(w).T + np.array(b) for x_, (w, b) in zip(x, params.projections)]
    if params.layer_norm:
        hs = [(h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-3) for h in hs]
    s = np.stack([h @ np.array(params.attention) + params.attention_bias for h in hs], 1)
    share = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    return hs, share


@pytest.mark.parametrize("norm", [False, True])
def test_dme_and_mean(aligned, norm):
    p = inp.dme_params((4, 3), norm)
    hs, share = by_hand(p)
    out = cb.combine(aligned, ["vec_1", "vec_2"], "dme", p)
    assert np.allclose(column(out, "dme_scores"), share)
    assert np.allclose(column(out, "vec"), share[:, :1] * hs[0] + share[:, 1:] * hs[1])
    assert np.allclose(column(cb.combine(aligned, ["vec_1", "vec_2"], "mean", p), "vec"), (hs[0] + hs[1]) / 2)


def test_one_pass_equals_the_steps(aligned):
    p, w, b = inp.dme_params((4, 3), True), inp.weights(5, 4), inp.biases(5)
    a = heads.predict_with_attention(aligned, ["vec_1", "vec_2"], p, w, b)
    s = heads.with_prediction(cb.combine(aligned, ["vec_1", "vec_2"], "dme", p), w, b)
    for c in ("dme_scores", "logits", "pred"):
        assert np.allclose(column(a, c), column(s, c))


def test_concat_and_checks(aligned):
    out = cb.combine(aligned, ["vec_1", "vec_2"], "concat")
    assert np.allclose(column(out, "vec"), np.hstack([X1, X2]))
    both = cb.combine(aligned, ["vec_1", "vec_2"], "concat", cb.CombineParams(layer_norm=True))
    assert column(both, "vec").shape == (20, 7)
    assert np.allclose(column(cb.combine(aligned, ["vec_1"], "dme"), "vec"), X1)
    for bad in ("con", "none", "attention"):
        with pytest.raises(ValueError):
            cb.combine(aligned, ["vec_1", "vec_2"], bad)
    for n, method in ((1, "dme"), (2, "mean")):
        with pytest.raises(ValueError):
            cb.embed_with_attention(aligned, ["vec_1", "vec_2"][:n], inp.dme_params((4, 3)), method)


def test_softmax_is_stable_and_ties_go_first(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -1000.0],)], "v array<double>")
    r = df.select(ax.softmax(F.col("v")).alias("s"), ax.argmax(F.col("v")).alias("a"), ax.log_sum_exp(F.col("v")).alias("l")).first()
    assert r.s == [0.5, 0.5, 0.0] and r.a == 0 and r.l == pytest.approx(1000 + np.log(2))


def test_equal_vectors_get_equal_weights(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(vx.attention_weights([F.col("v")] * 4, [500.0, 900.0])).first()[0] == [0.25] * 4


def test_ragged_vectors_are_an_error(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="one width"):
        df.select(vx.linear(F.col("v"), [[1.0]])).collect()


def test_words_and_starts(spark):
    text = " a  bb\tccccc\n dddddddd\xa0e "
    df = spark.createDataFrame([(text,), ("",), (" \n ",)], "text string").coalesce(1)
    w = tokens.words(F.col("text"))
    r = df.select(w.alias("w"), tokens.word_starts(tokens.rule_counts(w), 5).alias("s"), tokens.word_starts(tokens.rule_counts(w), 99, False).alias("z")).collect()
    assert r[0].w == text.split() and r[1].w == r[2].w == []
    assert r[0].s == [1, 2, 3] and r[0].z == [0, 1, 2, 4, 6] and r[1].s == []


def test_tokenizer_sees_each_distinct_word_with_a_space(spark):
    df = spark.createDataFrame([(["ab", "abc", "ab"],), ([],)], "w array<string>").coalesce(1)

    def tokenize(words):
        assert len(set(words)) == len(words) and all(w.startswith(" ") for w in words)
        return [len(w) + 2 for w in words]

    assert [r[0] for r in df.select(tokens.tokenizer_counts(F.col("w"), tokenize)).collect()] == [[3, 4, 3], []]


def test_pooling(spark, rows):
    data = [(1, 0, False, [1.0, 2.0]), (1, 1, False, [3.0, 4.0]), (1, 2, True, [8.0, 9.0])]
    s = spark.createDataFrame(data, "sent_id bigint, subword_pos int, is_pad boolean, vec array<float>")
    starts = spark.createDataFrame([(1, 0, 1)], "sent_id bigint, word_pos int, start bigint")
    assert rows(embed.pool(s, "cls")) == [(1, [1.0, 2.0])]
    assert rows(embed.pool(s, "cls", cls_first=False)) == [(1, [3.0, 4.0])]
    assert rows(embed.pool(s, "mean", width=2)) == [(1, [2.0, 3.0])]
    assert rows(embed.pool(s, "mean", width=2, include_pad=True)) == [(1, [4.0, 5.0])]
    assert rows(embed.pool(s, "word-level", starts=starts)) == [(1, 0, [3.0, 4.0])]
    assert rows(embed.pool(s, "word-level", starts=starts, keep_special_tokens=True)) == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])]
    with pytest.raises(ValueError):
        embed.pool(s, "max")


def test_hashed_bag_fills_wide_vectors(spark):
    vec = spark.range(1).select(vx.hashed_bag(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda k: k.cast("string")), 1024).alias("v")).first().v
    assert len(vec) == 1024 and all(any(vec[i : i + 64]) for i in range(0, 1024, 64))


def test_word_starts_have_no_limit_of_their_own(spark):
    counts = F.array_repeat(F.lit(1), 2000)
    starts = spark.range(1).select(tokens.word_starts(counts).alias("s")).first().s
    assert starts == list(range(1, 2001))


def test_a_sentence_without_a_vector_stops_the_alignment(spark):
    one, two = (spark.createDataFrame([(i, [1.0]) for i in ids], "sent_id bigint, vec array<double>") for ids in ([1, 2], [2, 3]))
    with pytest.raises(Exception, match="no vector of sentence"):
        cb.align([one, two]).collect()
    assert [r.sent_id for r in cb.align([one, two], drop_missing=True).collect()] == [2]
    assert cb.align([one, one.where("false")], drop_missing=True).count() == 0


def encoders(spark, ids, n=3):
    return [
        spark.createDataFrame([(i, [float(i), float(k)], f"text {i}", k) for i in ids], "sent_id bigint, vec array<double>, text string, label int").repartition(3)
        for k in range(n)
    ]


def test_three_encoders_in_one_exchange(spark):
    df = cb.align(encoders(spark, range(50)))
    assert df.columns == ["sent_id", "vec_1", "text", "label", "vec_2", "vec_3"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sent_id") == 1 and "Join" not in plan
    got = sorted(map(tuple, df.collect()))
    assert got == [(i, [float(i), 0.0], f"text {i}", 0, [float(i), 1.0], [float(i), 2.0]) for i in range(50)]


@pytest.mark.parametrize("what", ["missing", "doubled", "null"])
def test_three_encoders_must_have_each_sentence_once(spark, what):
    one, two, three = encoders(spark, range(5))
    if what == "missing":
        two = two.where("sent_id <> 3")
    elif what == "doubled":
        two = two.unionByName(two.where("sent_id = 3"))
    else:
        one, two, three = (t.selectExpr("nullif(sent_id, 3) AS sent_id", "vec", "text", "label") for t in (one, two, three))
    with pytest.raises(Exception, match="more than one" if what == "doubled" else "no vector"):
        cb.align([one, two, three]).collect()
    if what != "doubled":
        assert [r.sent_id for r in cb.align([one, two, three], drop_missing=True).orderBy("sent_id").collect()] == [0, 1, 2, 4]
