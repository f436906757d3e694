import pytest
from pyspark.sql import functions as F

from tandem.operators import labels as lb, splits, stats


def sample(spark, parts):
    data = [("a", "x"), ("b", "1"), ("a", "y"), ("a", "x"), ("a", "z"), ("a", "z"), ("b", "2"), ("c", "only"), ("a", None), ("a", "w")]
    return spark.createDataFrame([(i, l, t) for i, (l, t) in enumerate(data)], "id bigint, label string, text string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 37])
@pytest.mark.parametrize("max_labels", [3, None])
def test_head_split(spark, rows, parts, max_labels):
    got = rows(splits.head_split(sample(spark, parts), "label", "id", ["label", "text"], 2, max_labels), "id", "split")
    # Row 3 equals dev row 0 by value and is in neither part; the two "z" both stay.
    assert got == [(0, "dev"), (1, "dev"), (2, "dev"), (4, "train"), (5, "train"), (6, "dev"), (7, "dev"), (8, "train"), (9, "train")]


def test_null_equals_null(spark, rows):
    df = sample(spark, 2)
    assert splits.minus_by_value(df, df.where("text is null"), ["label", "text"]).where("text is null").count() == 0


@pytest.mark.parametrize("n", [1, 4, 10, 99])
def test_head_n(spark, rows, n):
    got = rows(splits.head_n(sample(spark, 3), "id", n), "id", "split")
    assert got == [(i, "dev" if i < n else "train") for i in range(10)]


def test_by_column_drops_other_values(spark, rows):
    got = rows(splits.by_column(sample(spark, 2), "label", {"a": "train", "b": "dev"}).groupBy("split").count())
    assert got == [("dev", 2), ("train", 7)]


def test_statistics(spark):
    df = sample(spark, 2).select("id", F.when(F.col("id") < 6, "train").when(F.col("id") < 8, "dev").otherwise("test").alias("split"), (F.col("id") % 2).alias("label"))
    s = stats.statistics(df, "n", "Sentence classification", label_map={"e": 0, "o": 1}).first()
    assert (s.train, s.dev, s.test, s.metrics, s.label_frequency) == (6, 2, 2, ["accuracy", "f1_score"], {0: 4, 1: 4})
    r = stats.statistics(df, "n", "Sentence regression").first()
    assert r.label_frequency is None and r.metrics == ["spearmanr", "pearsonr"]
    assert stats.num_classes(df, task="Sentence regression").first()[0] == 1
    assert stats.split_sizes(df).first().line == "train 6 + dev 2 + test 2"


def test_choose_target(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, valence double, arousal double")
    assert lb.choose_target(df, "AROUSAL", ("valence", "arousal")).first().target == 3.0
    with pytest.raises(ValueError):
        lb.choose_target(df, "dominance", ("valence", "arousal"))


def test_head_of_no_rows_is_all_train(spark):
    df = spark.range(5)
    assert {r.split for r in splits.head_n(df, "id", 0).collect()} == {"train"}
    assert {r.split for r in splits.head_n(df, "id", 9).collect()} == {"dev"}


@pytest.mark.parametrize("n", [1, 999, 1001, 2000])
def test_first_n_of_a_label_with_most_rows(spark, n):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 7, "rare").when(F.col("id") % 50 == 8, None).otherwise("hot").alias("label"))
    got = {(r.label, r.id) for r in splits.first_n_keys(df.repartition(7), "label", "id", n).collect()}
    want = set()
    for label, keys in {
        "rare": [i for i in range(5000) if i % 50 == 7],
        None: [i for i in range(5000) if i % 50 == 8],
        "hot": [i for i in range(5000) if i % 50 not in (7, 8)],
    }.items():
        want |= {(label, i) for i in keys[:n]}
    assert got == want
