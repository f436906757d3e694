"""Session settings, shared scratch folder and the size rule for broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side may carry a broadcast hint only when its row count is bounded by this.
MAX_BROADCAST_ROWS = 1_000_000

_SHIPPED: set[str] = set()


def build_session(app: str = "tandem", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution and skew handling on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, once per session.

    The functions inside the Arrow UDFs belong to it. Not needed when it is
    installed on the executors or was given with `--py-files`.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tandem-')}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session may go without the setting; it gets a fresh folder of
    its own. On a cluster a machine-local folder would be lost to the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="tandem-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that comes in fewer pieces than a few per core.

    A file with a single row group is read by one task, whatever the settings of the
    reader; row-local work on texts would then use one core. A large table has
    many more pieces than cores and is left as it is. Rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 4 * cores else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back.

    For intermediate tables that are used several times: the lineage ends at
    stored files, which outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own below the scratch folder, once nothing reads it any more."""
    if not path.startswith(scratch_root(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the scratch folder")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A `materialize` whose tables are deleted at the end of the block."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            drop_scratch(spark, path)


def small(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast `df` if `max_rows`, a bound proven by the caller, is within the limit.

    Without a bound, or beyond the limit, the join strategy is left to the
    optimizer, which then shuffles and lets adaptive execution split skew.
    """
    if max_rows is not None and max_rows <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df
