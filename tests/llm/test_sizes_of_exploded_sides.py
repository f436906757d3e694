"""Tables that Spark takes for smaller than they are never go whole through the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import itq, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored_plans(monkeypatch):
    """Plans of the tables that the module given stores, by name."""

    def watch(module):
        found, store = {}, module.stored

        def keep(df, name):
            found[name] = plan(df)
            return store(df, name)

        monkeypatch.setattr(module, "stored", keep)
        return found

    return watch


def test_embedding_tables_are_not_broadcast(spark, stored_plans):
    plans = stored_plans(itq)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(20, 16))
    rows = [(k, (base[k % 20] + draw.normal(size=16) * 0.02).tolist(), k % 2) for k in range(200)]
    found = itq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert found.where("n_links > 0").count() == 200
    # Each code is exploded 68 times before its buckets are counted; members of crowded buckets are exploded by slices before they meet their vectors.
    assert ["SortMergeJoin [g" in plans["met"], "Broadcast" in plans["met"], "SortMergeJoin [ref" in plans["links"]] == [True, False, True]


@pytest.mark.parametrize(("wide", "shards"), [(False, 15), (True, 56)])
def test_fingerprint_shards_are_not_broadcast(spark, tmp_path, wide, shards):
    draw = np.random.default_rng(4)
    rows = [(int(a), int(b) if wide else 0) for a, b in draw.integers(0, 1 << 62, (50, 2))]
    rows += [(a ^ 1, b) for a, b in rows]
    # A stored table has a known size, as in the queries.
    spark.createDataFrame(rows, "fp bigint, fp2 bigint").write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    dealt = simhash._sharded(prints, simhash._finer({0: (0, 0)}, 8 if wide else 6, wide))
    crowded = simhash._crowded(dealt)
    assert "SortMergeJoin" in plan(crowded) and "Broadcast" not in plan(crowded)
    got = {tuple(r) for r in crowded.collect()}
    of_shard = dealt.groupBy("shard_of", "k1", "k2").agg(F.collect_list(F.struct("fp", "fp2")).alias("members")).collect()
    assert dealt.count() == len(rows) * shards
    assert got == {(r.shard_of, r.k1, r.k2, m.fp, m.fp2, len(r.members)) for r in of_shard if len(r.members) > 1 for m in r.members}
