import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import metrics as mt
from tandem.session import scratch_root


def table(spark, gold, pred, kind="double", parts=3):
    return spark.createDataFrame(list(zip(gold, pred)), f"gold {kind}, pred {kind}").repartition(parts)


def value(df):
    return df.first().value


def average_rank(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_small_known_values(spark):
    df = table(spark, [1, 1, 1, 0], [1, 0, 1, 1], "bigint")
    assert value(mt.accuracy(df)) == 0.5
    assert value(mt.f1_micro(df)) == 0.5
    assert value(mt.matthews(df)) == pytest.approx(-1 / 3)


def test_missing_prediction_is_wrong(spark):
    df = table(spark, [1, 1], [1, None], "bigint")
    assert value(mt.accuracy(df)) == 0.5
    assert value(mt.f1_micro(df)) == 0.5


def test_single_class_has_no_correlation(spark):
    assert value(mt.matthews(table(spark, [1, 1], [1, 1], "bigint"))) == 0.0
    assert value(mt.pearson(table(spark, [1.0, 2.0], [3.0, 3.0]))) is None
    assert value(mt.spearman(table(spark, [1.0, 2.0], [3.0, 3.0]))) is None


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_correlations_against_numpy(spark, parts):
    rng = np.random.default_rng(3)
    gold = rng.integers(-5, 6, 200).astype(float)
    pred = np.where(rng.random(200) < 0.4, 7.0, gold + rng.normal(size=200).round(1))
    df = table(spark, gold.tolist(), pred.tolist(), parts=parts)
    assert value(mt.pearson(df)) == pytest.approx(np.corrcoef(gold, pred)[0, 1], abs=1e-12)
    want = np.corrcoef(average_rank(gold), average_rank(pred))[0, 1]
    assert value(mt.spearman(df)) == pytest.approx(want, abs=1e-12)


def test_spearman_with_hot_and_cold_values(spark, monkeypatch):
    monkeypatch.setattr(mt, "HOT_SHARE", 0.2)
    gold = [float(i % 17) for i in range(120)]
    pred = [1.0 if i % 3 == 0 else float(i * i % 29) for i in range(120)]
    want = np.corrcoef(average_rank(gold), average_rank(pred))[0, 1]
    assert value(mt.spearman(table(spark, gold, pred))) == pytest.approx(want, abs=1e-12)


def spans_by_hand(tags):
    found, start, kind = [], None, None
    for i, t in enumerate(list(tags) + ["O"]):
        here = None if t == "O" else t[2:]
        if start is not None and (here is None or t[0] == "B" or here != kind):
            found.append((kind, start, i - 1))
            start = None
        if here is not None and start is None:
            start, kind = i, here
    return found


def test_spans_against_a_loop(spark):
    rng = random.Random(0)
    names = ["O", "B-x", "I-x", "B-y", "I-y"]
    cases = [[], ["O"], ["I-x"], ["B-x", "I-y"], ["I-x", "B-x"]] + [[rng.choice(names) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<string>")
    for r in df.select("t", mt.entity_spans(F.col("t")).alias("s")).collect():
        assert [tuple(s) for s in r.s] == spans_by_hand(r.t), r.t


def test_entity_f1(spark):
    df = spark.createDataFrame([(["B-x", "I-x", "O"], ["B-x", "I-x", "B-y"]), (["O"], ["O"])], "gold_tags array<string>, pred_tags array<string>")
    assert value(mt.entity_f1(df)) == pytest.approx(2 / 3)
    assert value(mt.entity_f1(df.where("size(gold_tags) = 1"))) == 0.0


def test_unpad(spark, rows):
    df = spark.createDataFrame([(1, [2, 0, -1], [2, 1, 5])], "sent_id bigint, gold array<bigint>, pred array<bigint>")
    assert rows(mt.unpad(df)) == [(1, 0, 2, 2), (1, 1, 0, 1)]
    assert value(mt.tag_accuracy(df)) == 0.5


def test_best_epoch(spark):
    h = spark.createDataFrame([(1, -0.5), (2, -0.1), (3, -0.1)], "epoch int, score double")
    assert tuple(mt.best_epoch(h).first()) == (2, -0.1)
    assert mt.best_epoch(h, floor=0.0).first() is None


def test_evaluate_keeps_the_order_and_checks_names(spark):
    df = table(spark, [1, 0, 1], [1, 0, 0], "bigint")
    got = [r.metric for r in mt.evaluate(df, "Sentence classification", ["f1_score", "accuracy"]).orderBy("rank").collect()]
    assert got == ["f1_score", "accuracy"]
    with pytest.raises(ValueError):
        mt.evaluate(df, "Sentence classification", ["pearsonr"])


def test_progress_and_summary(spark, rows):
    losses = spark.createDataFrame([(i, float(i)) for i in range(1, 26)], "batch int, loss double")
    got = rows(mt.progress_loss(losses, 25))
    # The last batch fills no part of two and is a part of its own.
    assert got[0] == (0, 1.5, 2) and got[12] == (12, 25.0, 1) and len(got) == 13
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "combo string, score double")
    assert rows(mt.run_summary(runs, "a"), "combo", "mean", "gain") == [("a", 2.0, 0.0), ("b", 5.0, 3.0)]


@pytest.mark.parametrize(
    ("task", "metrics", "columns"),
    [
        ("Sentence classification", ["accuracy", "matthews_corr", "f1_score"], "CAST(id % 3 AS string) AS gold, CAST(id % 4 AS string) AS pred"),
        ("Sequence labeling", ["f1_score", "accuracy"], "array('B-X', IF(id % 2 = 0, 'I-X', 'O')) AS gold, array('B-X', 'O') AS pred"),
        ("Sentence regression", ["spearmanr", "pearsonr"], "CAST(id % 7 AS double) AS gold, CAST(id * id % 11 AS double) AS pred"),
    ],
)
def test_evaluation_reads_its_table_once_and_leaves_nothing(spark, tmp_path, task, metrics, columns):
    path = str(tmp_path / "t")
    spark.sql(f"SELECT {columns} FROM range(200)").write.parquet(path)
    df = spark.read.parquet(path)
    before = set(Path(scratch_root(spark)).iterdir())
    got = mt.evaluate(df, task, metrics)
    rows = [(r["rank"], r["metric"], r["value"]) for r in got.orderBy("rank").collect()]
    assert [r[:2] for r in rows] == list(enumerate(metrics))
    assert set(Path(scratch_root(spark)).iterdir()) == before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 1
    known = {"accuracy": mt.accuracy, "f1_score": mt.f1_micro, "matthews_corr": mt.matthews, "pearsonr": mt.pearson, "spearmanr": mt.spearman}
    if task != "Sequence labeling":
        assert [v for _, _, v in rows] == pytest.approx([known[m](df).first().value for m in metrics])
    else:
        assert [v for _, _, v in rows] == pytest.approx([mt.entity_f1(df, "gold", "pred").first().value, 0.75])


def test_evaluation_of_nothing(spark):
    none = spark.createDataFrame([], "gold double, pred double")
    got = mt.evaluate(none, "Sentence classification", ["accuracy", "f1_score", "matthews_corr"]).orderBy("rank").collect()
    assert [r.value for r in got] == [None, 0.0, 0.0]
    assert [r.value for r in mt.evaluate(none, "Sentence regression", ["pearsonr", "spearmanr"]).collect()] == [None, None]
    assert mt.evaluate(none, "Sentence regression", []).count() == 0
