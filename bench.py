"""Headline queries, timed: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the number of threads. Each query runs once to warm up and then
BENCH_RUNS times (default 2); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tandem.plans.catalog import QUERIES
from tandem.session import build_session

HEADLINE = [
    "head_classify_with_attention",
    "cmb_dme",
    "cmb_dme_words",
    "pool_mean",
    "tok_word_starts",
    "emb_hash_encode",
    "split_train_antijoin",
    "split_head_n",
    "shuffle_epoch_order",
    "batch_pad_tags",
    "src_labeled_tsv",
    "src_tagged_blocks",
    "loss_tags",
    "met_matthews",
    "met_spearman",
    "met_entity_f1",
    "eval_corpus",
    "fit_classifier",
    "fit_dme",
]


def run(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, sf, name)
        seconds[name] = round(statistics.median(run(spark, sf, name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
