"""Stored models: a folder of versions, each with all that a prediction needs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import heads
from ..sources import sink
from .train import HeadSpec, score_table

FORMAT = 1
VERSIONS = """format int, version int, folder string, widths array<int>, outputs int, method string, layer_norm boolean,
    dropout double, shapes map<string, array<int>>, labels map<string, bigint>"""


@dataclass
class Model:
    """A trained head: shape, parameters and the names of its classes."""

    spec: HeadSpec
    params: Mapping[str, np.ndarray]
    labels: Mapping[str, int] | None = None

    def score(self, table: DataFrame) -> DataFrame:
        """Add `logits` and `pred` to a table with vec_1 … vec_n."""
        return score_table(table, self.spec, self.params)

    def predict(self, table: DataFrame) -> DataFrame:
        """Report of a table with vec_1 … vec_n: prediction, and its name if the classes have names."""
        return heads.prediction_report(self.score(table), self.labels if self.spec.outputs > 1 else None)


def save_model(spark: SparkSession, model: Model, path: str) -> int:
    """Add a version to the folder `path` and return its number, 1 for the first.

    Parameters go to a folder of their own; the version exists from the moment at
    which its row, a single file, is there. A job that dies before leaves an unused
    folder and the earlier versions as they were. One writer at a time: a number given twice stops `load_model`.
    """
    spec = model.spec
    if model.labels and spec.outputs > 1 and sorted(model.labels.values()) != list(range(spec.outputs)):
        raise ValueError(f"labels must name the outputs 0 to {spec.outputs - 1}, each once")
    folder = f"params-{uuid.uuid4().hex}"
    sink.save_params(spark, model.params, f"{path}/{folder}")
    earlier = _versions(spark, path) if _has_versions(spark, path) else None
    last = (earlier.agg(F.max("version")).first()[0] if earlier is not None else None) or 0
    row = (
        FORMAT, last + 1, folder, [int(w) for w in spec.widths], spec.outputs, spec.method, spec.layer_norm, float(spec.dropout),
        {name: [int(n) for n in np.shape(a)] for name, a in model.params.items()}, dict(model.labels) if model.labels else None,
    )
    spark.createDataFrame([row], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return last + 1


def load_model(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """The last or a given version; nothing but the path is needed. Missing or doubled parameters stop it."""
    found = _versions(spark, path)
    wanted = F.col("version") == (found.agg(F.max("version")).first()[0] if version is None else version)
    rows = found.where(wanted).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: {'two models' if rows else 'no model'} of version {version or 'the last'}")
    r = rows[0]
    if r.format != FORMAT:
        raise ValueError(f"{path}: format {r.format} is not {FORMAT}")
    shapes = {name: tuple(shape) for name, shape in r.shapes.items()}
    folder = f"{path}/{r.folder}"
    stored = spark.read.parquet(folder).groupBy("param").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("i", "j").alias("cells")
    )
    sizes = {x.param: (x.n, x.cells) for x in stored.collect()}
    if sizes != {name: (n, n) for name, shape in shapes.items() if (n := int(np.prod(shape, dtype=int)))}:
        raise ValueError(f"{folder}: parameters do not fill their shapes")
    # A single encoder is stored with the method `none`, which is no method to ask for.
    spec = HeadSpec(list(r.widths), r.outputs, "concat" if r.method == "none" else r.method, r.layer_norm, r.dropout)
    return Model(spec, sink.load_params(spark, folder, shapes), r.labels)


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSIONS).parquet(f"{path}/versions")


def _has_versions(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
