"""Vector expressions as Arrow UDFs.

Matrix work on arrays is the one thing built-in functions do slowly (higher
order functions are interpreted item by item), so whole Arrow batches go to
numpy instead. Each function is row-local: no shuffle, no state between batches.
Parameters are small dense arrays and travel with the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

VECTOR = "array<double>"


def to_matrix(column: pa.Array) -> np.ndarray:
    """[rows, width] matrix of a list column; all vectors of a column share one width."""
    column = _one_array(column)
    if column.null_count:
        raise ValueError("vector column holds NULL; drop such rows first")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(column) and (len(flat) % len(column) or not _even(column)):
        raise ValueError("vectors of one column must share one width")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def from_matrix(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def row_lengths(column: pa.Array) -> np.ndarray:
    return _one_array(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def item_sums(column: pa.Array, width: int) -> np.ndarray:
    """[rows, 2 * width]: the first `width` items of each vector, 0 where there is none, and behind them 1 where there is one."""
    column = _one_array(column)
    lengths, flat = row_lengths(column), column.flatten()
    if not len(flat):
        return np.zeros((len(column), 2 * width))
    place = np.arange(width)
    there = place < lengths[:, None]
    place = np.where(there, (np.cumsum(lengths) - lengths)[:, None] + place, 0)
    if flat.null_count:
        there &= flat.is_valid().to_numpy(zero_copy_only=False)[place]
    items = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.hstack([np.where(there, items[place], 0.0), there])


def fold_rows(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ids, and the sums of the rows of each of them."""
    ids = np.concatenate([i for i, _ in parts])
    rows = np.concatenate([r for _, r in parts]) if len(parts) > 1 else parts[0][1]
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))[: len(ids)])
    return ids[starts], np.add.reduceat(rows[order], starts, axis=0) if len(starts) else rows[:0]


def find_rows(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted id among ascending ids, and whether it is there."""
    if not len(ids):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return at, ids[at] == wanted


def _one_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _even(column: pa.Array) -> bool:
    lengths = row_lengths(column)
    return bool((lengths == lengths[0]).all())


def linear(vec: Column, weight, bias=None) -> Column:
    """`weight @ vec + bias`."""
    w = np.asarray(weight, dtype=np.float64)
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.arrow_udf(VECTOR)
    def apply(v: pa.Array) -> pa.Array:
        if not len(v):
            return from_matrix(np.zeros((0, w.shape[0])))
        return from_matrix(to_matrix(v) @ w.T + b)

    return apply(vec)


def normalize_rows(x: np.ndarray, eps: float) -> np.ndarray:
    """Rows shifted to mean 0 and scaled to (biased) variance 1."""
    centred = x - x.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(axis=1, keepdims=True) + eps)


def layer_norm(vec: Column, scale=None, shift=None, eps: float = 1e-3) -> Column:
    g = 1.0 if scale is None else np.asarray(scale, dtype=np.float64)
    b = 0.0 if shift is None else np.asarray(shift, dtype=np.float64)

    @F.arrow_udf(VECTOR)
    def apply(v: pa.Array) -> pa.Array:
        return from_matrix(normalize_rows(to_matrix(v), eps) * g + b) if len(v) else v.cast(pa.list_(pa.float64()))

    return apply(vec)


def mean_of(vectors: Sequence[Column]) -> Column:
    """Item-wise mean of several vectors of one width."""

    @F.arrow_udf(VECTOR)
    def apply(*vs: pa.Array) -> pa.Array:
        return from_matrix(sum(to_matrix(v) for v in vs) / len(vs))

    return apply(*vectors)


def softmax_rows(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def attention_weights(vectors: Sequence[Column], attention, offset: float = 0.0) -> Column:
    """Softmax over the vectors of a row of `attention · vector + offset`."""
    a = np.asarray(attention, dtype=np.float64)

    @F.arrow_udf(VECTOR)
    def apply(*vs: pa.Array) -> pa.Array:
        if not len(vs[0]):
            return from_matrix(np.zeros((0, len(vs))))
        scores = np.stack([to_matrix(v) @ a + offset for v in vs], axis=1)
        return from_matrix(softmax_rows(scores))

    return apply(*vectors)


def weighted_sum(weights: Column, vectors: Sequence[Column]) -> Column:
    @F.arrow_udf(VECTOR)
    def apply(w: pa.Array, *vs: pa.Array) -> pa.Array:
        share = to_matrix(w)
        return from_matrix(sum(share[:, i : i + 1] * to_matrix(v) for i, v in enumerate(vs)))

    return apply(weights, *vectors)


#: Items of the arrays that `running_start` takes up at a time.
RUN_ITEMS = 1 << 19


def running_start(counts: Column, base: int) -> Column:
    """Sum of the items before each item, plus `base` (ARRAY<INT> in, ARRAY<BIGINT> out).

    A batch of Arrow has a number of rows, however long they are. It is taken up
    and handed on in runs of rows of at most RUN_ITEMS items, or of one longer row.
    """

    @F.arrow_udf("array<bigint>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in batches:
            c = _one_array(c)
            for run in _runs(c, RUN_ITEMS):
                yield _starts(run, base)

    return apply(counts)


def _runs(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """The rows of a list column in slices of at most `most` items, or of one longer row; an empty column once."""
    ends = np.cumsum(row_lengths(column))
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield column.slice(at, to - at)
        at = to
    if not len(column):
        yield column


def _starts(column: pa.Array, base: int) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(row_lengths(column))))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(flat, out=before[1:])
    starts = before[:-1]
    starts -= np.repeat(before[offsets[:-1]] - base, np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(starts))


def hashed_bag(words: Column, width: int) -> Column:
    """Signed hashed bag of words (ARRAY<STRING> in): item j counts the words hashed to j, up or down.

    The first 60 bits of a word's md5 give bucket (56 bits, so any width is
    filled) and sign. Each distinct word of an Arrow batch is hashed once.
    """

    @F.arrow_udf(VECTOR)
    def apply(ws: pa.Array) -> pa.Array:
        ws = _one_array(ws)
        n = row_lengths(ws)
        coded = ws.flatten().dictionary_encode()
        digits = (hashlib.md5(w.encode()).hexdigest()[:15] for w in coded.dictionary.to_pylist())
        code = np.fromiter((int(d, 16) for d in digits), np.int64, len(coded.dictionary))
        code = code[coded.indices.to_numpy(zero_copy_only=False)] if len(code) else code
        cell = np.repeat(np.arange(len(n)), n) * width + (code >> 4) % width
        sums = np.bincount(cell, weights=1.0 - 2.0 * (code % 2), minlength=len(n) * width)
        return from_matrix(sums.reshape(len(n), width))

    return apply(words)
