"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tandem.session import materialize

T = TypeVar("T")

#: Characters that separate words in the digest contracts: space and 09-0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch of rows on its way to a Python worker; Spark's own setting lets a batch of whole texts take 64 MB, several times over.
BATCH_BYTES = "4m"
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", ("64m", "67108864", "67108864b")


def bounded(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES in this session, unless it has a setting of its own."""
    if spark.conf.get(_BATCH, _SPARKS_OWN[0]).lower() in _SPARKS_OWN:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder; the lineage ends at the files."""
    bounded(df.sparkSession)
    return materialize(df, name)


def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Sort-merge join; adaptive execution may split a hot key's side, but no side is ever broadcast.

    For sides that Spark sizes by the table below them: it takes an explode for as
    small as its input and sends it whole through the driver.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def uniform(seed: str, *parts: Column) -> Column:
    """Reproducible number in (0, 1) from the first 52 bits of an md5 over the parts."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


#: What a worker process keeps from task to task, by owner, and how to let go of it.
HELD: dict[str, Callable[[], None]] = {}


def release(owner: str) -> None:
    """Let go of what other operators keep in this worker process; called where a task begins."""
    for name in [x for x in HELD if x != owner]:
        HELD.pop(name)()


def task(owner: str) -> Callable:
    """Decorator of what a task does with its rows: the worker keeps nothing of other operators meanwhile, and gives
    free memory back to the machine at the end, as workers live on between tasks and allocators keep what was freed."""

    def decorate(run: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
        def whole(rows: Iterator[T]) -> Iterator[T]:
            release(owner)
            try:
                yield from run(rows)
            finally:
                settle()

        return whole

    return decorate


def settle() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        # Another C library than glibc.
        pass


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Whole texts of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case.

    `bytes.lower` changes ASCII letters alone and `bytes.split` cuts at the
    same six characters as the pattern WORD.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Whole groups of rows equal in their first columns; the input is sorted by them."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(width)])
        new = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
        table = pa.Table.from_batches([batch])
        for lo, hi in zip([0, *new], [*new, batch.num_rows], strict=True):
            part = table.slice(lo, hi - lo)
            if kept and any(kept[-1].column(c)[0] != part.column(c)[0] for c in range(width)):
                yield pa.concat_tables(kept)
                kept = []
            kept.append(part)
    if kept:
        yield pa.concat_tables(kept)
