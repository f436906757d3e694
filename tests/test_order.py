import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import batching, order


def keyed(spark, values, parts):
    return spark.createDataFrame([(v,) for v in values], "k bigint").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_row_index_is_the_rank_whatever_the_partitions(spark, rows, monkeypatch, parts):
    monkeypatch.setattr(order, "CELL_ROWS", 16)
    rng = random.Random(1)
    values = rng.sample(range(-500, 3000), 400) + [10**15, -(10**15)]
    got = rows(order.with_row_index(keyed(spark, values, parts), "k"))
    assert got == [(k, i) for i, k in enumerate(sorted(values))]


def crowds(df, *bucket):
    return df.groupBy(*bucket).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize(
    "values",
    [
        list(range(1024, 30_000)),
        [2**40 + i for i in range(30_000)] + [2**41 - 1],
        [0] + [2**62 + 4096 * i for i in range(30_000)],
        [i * i for i in range(20_000)] + [-(2**i) for i in range(60)],
    ],
)
def test_no_bucket_is_crowded_whatever_the_clumps(spark, rows, monkeypatch, values):
    monkeypatch.setattr(order, "CELL_ROWS", 16)
    df = keyed(spark, values, 5)
    placed = order.range_buckets(df, "k")
    assert crowds(placed, "_cell", "_sub") <= 32
    assert placed.select("_cell", "_sub").distinct().count() <= order.MOST_BUCKETS
    spans = placed.groupBy("_cell", "_sub").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_cell", "_sub").collect()
    assert all(a.hi < b.lo for a, b in zip(spans[:-1], spans[1:], strict=True))
    assert rows(order.with_row_index(df, "k")) == [(k, i) for i, k in enumerate(sorted(values))]


def test_clumped_ids_at_full_size(spark):
    """3.5 million ids from 2^40 and a single one at 2^41 - 1."""
    df = spark.range(2**40, 2**40 + 3_500_000, 1, 4).unionByName(spark.range(2**41 - 1, 2**41)).withColumnRenamed("id", "k")
    assert crowds(order.range_buckets(df, "k"), "_cell", "_sub") <= 2 * order.CELL_ROWS
    last = order.slice_rows(df, "k", 3_499_999, 3_500_001).orderBy("k").collect()
    assert [(r.k, r.idx) for r in last] == [(2**40 + 3_499_999, 3_499_999), (2**41 - 1, 3_500_000)]


def test_equal_keys_are_cut_by_a_second_key(spark, monkeypatch):
    monkeypatch.setattr(order, "CELL_ROWS", 16)
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") > 5, F.col("id")).alias("t"))
    placed = order.range_buckets(df, "k", "t")
    assert crowds(placed, "_cell", "_sub") > 6000 and crowds(placed, "_cell", "_sub", "_tie") <= 32
    spans = placed.groupBy("k", "_cell", "_sub", "_tie").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("k", "_tie").collect()
    assert all(a.k < b.k or a.hi is None or a.hi < b.lo for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_null_keys_come_first_and_no_rows_are_fine(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "k bigint")
    assert [(r.k, r.idx) for r in order.with_row_index(df, "k").orderBy("idx").collect()] == [(None, 0), (1, 1), (2, 2), (3, 3)]
    assert order.with_row_index(df.limit(0), "k").count() == 0


def test_fractions_and_signs_keep_their_order(spark, rows):
    values = [-3.5, -0.25, -1e-9, 0.0, 1e-9, 0.3, 0.5, 1.0, 1.5, 2.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "k double")
    assert [r[1] for r in rows(order.with_row_index(df, "k"))] == list(range(len(values)))


@pytest.mark.parametrize("start,end", [(0, 5), (7, 9), (95, 120), (200, 300)])
def test_slice(spark, rows, start, end):
    got = rows(order.slice_rows(keyed(spark, range(0, 300, 3), 5), "k", start, end))
    assert got == [(k, i) for i, k in enumerate(range(0, 300, 3))][start:end]


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_shuffle_depends_on_the_seed_only(spark, rows, parts):
    got = {k: p for k, p in rows(order.with_epoch_order(keyed(spark, range(50), parts), "k", 2, seed=5), "k", "pos")}
    want = sorted(range(50), key=lambda k: hashlib.md5(f"5:2:{k}".encode()).hexdigest())
    assert got == {k: i for i, k in enumerate(want)}


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_file_index_follows_files_for_any_split_size(spark, rows, tmp_path, size):
    for name, n in (("b.txt", 9), ("a.txt", 13), ("c.txt", 1)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = order.with_file_index(spark.read.text(str(tmp_path)), "idx", "line_no").drop("_file")
        got = rows(df, "idx", "line_no", "value")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    lines = [(f, i) for f, n in (("a.txt", 13), ("b.txt", 9), ("c.txt", 1)) for i in range(n)]
    assert got == [(k, i, f"{f}{i}") for k, (f, i) in enumerate(lines)]


def test_batches_and_padding(spark, rows):
    df = spark.createDataFrame([(0, [1]), (1, [2, 3, 4]), (2, [5, 6]), (3, [7]), (4, [8])], "idx bigint, tags array<bigint>")
    got = rows(batching.pad_tags(batching.assign_batches(df, 2)), "idx", "batch_id", "pos_in_batch", "tags")
    assert got == [(0, 0, 0, [1, -1, -1]), (1, 0, 1, [2, 3, 4]), (2, 1, 0, [5, 6]), (3, 1, 1, [7, -1]), (4, 2, 0, [8])]


def test_batch_plan_rounds_up(spark):
    plan = batching.batch_plan(spark.range(33), 16, 10, 0.1).first()
    assert tuple(plan) == (33, 3, 30, 3)
