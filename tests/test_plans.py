"""Shapes of physical plans: what must, and must not, be in them."""

import re

from pyspark.sql import functions as F

from tandem.operators import metrics as mt, order, splits
from tandem.plans import inputs as inp
from tandem.plans.catalog import QUERIES
from tandem.sources import sink

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_is_one_arrow_pass_over_pruned_columns(spark):
    p = plan(QUERIES["head_classify_with_attention"](spark, SF))
    assert p.count("ArrowEvalPython") == 1
    assert "html" not in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_no_cross_join_in_any_lazy_plan(spark):
    for name, q in QUERIES.items():
        if name.startswith(("fit_", "sink_", "src_", "rpt_history")):
            continue
        p = plan(q(spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_first_n_per_label_limits_groups_before_the_shuffle(spark):
    d = inp.docs(spark, SF)
    p = plan(splits.first_n_per_label(d, "label_raw", "sent_id", 30, 4))
    assert "WindowGroupLimit" in p
    # The window side carries keys only, never texts.
    assert not re.search(r"Window \[row_number.*text", p)


def test_unpartitioned_windows_sit_on_bucket_tables_only(spark):
    p = plan(order.with_row_index(inp.docs(spark, SF), "sent_id"))
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "HashAggregate" in "".join(lines[i + 1 : i + 3])


def test_entities_need_no_shuffle_but_the_final_sum(spark):
    df = spark.createDataFrame([(["O"], ["O"])], "gold_tags array<string>, pred_tags array<string>")
    assert plan(mt.entity_f1(df)).count("Exchange") == 1


def test_equal_buckets_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tables = [
            sink.write_bucketed(inp.encoder(spark, SF, e), f"enc_{i}", str(tmp_path / f"enc_{i}"), buckets=4)
            for i, e in enumerate((inp.ENC_A, inp.ENC_B))
        ]
        from tandem.operators.combine import align

        joined = align(tables)
        assert "Exchange" not in plan(joined) and joined.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for i in range(2):
            spark.sql(f"DROP TABLE IF EXISTS enc_{i}")


def test_row_local_scoring_also_runs_on_a_stream(spark, tmp_path):
    from tandem.operators import heads

    e = inp.encoder(spark, SF, inp.ENC_A).select("sent_id", "vec")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    scored = heads.with_prediction(stream, inp.weights(10, 32, 3), inp.biases(10, 3)).select("sent_id", "pred")
    q = (
        scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    q.awaitTermination(60)
    batch = heads.with_prediction(e, inp.weights(10, 32, 3), inp.biases(10, 3)).select("sent_id", "pred")
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0
