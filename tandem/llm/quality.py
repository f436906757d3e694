"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

A text is described by STATISTICS numbers. Random cosines of the standardised
numbers approximate a Gaussian kernel; every partition adds up its part of the
normal equations, whose sum is solved for ridge weights. A fold that the weights
haven't seen calibrates them: its scores are counted in bins, and the pooled
shares of label 1 ascend with the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.common import stored, texts, uniform

STATISTICS = (
    "words", "length", "word_length", "word_spread", "unique", "top_word", "top_pair", "letters", "upper", "digits", "spaces",
    "high", "stops", "commas", "symbols", "bars", "marks", "lines", "line_length", "repeated_lines", "capital_words", "entropy",
    "ended_lines", "symbol_words",
)
COSINES = 256
WIDTH = 3.0
RIDGE = 1e-3
#: Labelled texts that a model is learned from, at most.
SAMPLE_ROWS = 50_000
#: Tasks that add up normal equations, and bins of the calibration.
PARTS = 16
BINS = 256


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all 0 for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, total = len(raw), len(words)
    size = np.fromiter(map(len, words), np.int64, total)
    tally = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = np.fromiter(tally.values(), float, len(tally)) / total
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    symbols = count[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 123, 125, 126]].sum()
    last = [w[-1] for w in words]
    return [
        np.log1p(total), np.log1p(n), size.mean(), size.std(), len(tally) / total, max(tally.values()) / total,
        max(pairs.values(), default=0) / total, lower / n, upper / n, digits / n, (count[32] + count[9]) / n, count[128:].sum() / n,
        count[46] / total, count[44] / total, symbols / n, count[124] / total, (count[33] + count[63]) / total, np.log1p(len(lines)),
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(w[0] < 91 and w[0] > 64 for w in words) / total,
        float(-(share * np.log(share)).sum() / np.log(total + 1)), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        sum(x in b"#$%&*|" for x in last) / total,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    shares: np.ndarray
    weights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cosines(x, self.mean, self.scale) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.shares[np.searchsorted(self.edges, self.raw(x), "right")]


def cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    draw = np.random.default_rng(7)
    direction = draw.normal(size=(x.shape[1], COSINES)) / WIDTH
    phase = draw.uniform(0, 2 * np.pi, COSINES)
    # Far outliers count as eight deviations.
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.cos(z @ direction + phase) * np.sqrt(2 / COSINES), np.ones((len(x), 1))])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in texts(batch.column(1))]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(rows)], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, x array<double>")


def _arrays(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def fit(rows: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from described texts and `labels` (id, label 0 or 1), at most SAMPLE_ROWS of them in a hashed order.

    `fold` is true, over the labels' columns, for the rows that calibrate.
    Labels that are null or have no text are left out. Without labels every
    score is 0.5; without rows that calibrate, those of the fit do.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"), F.coalesce(fold, F.lit(False)).alias("fold"))
    chosen = chosen.where("id is not null and y in (0, 1)").orderBy(uniform("quality", F.col("id")), "id", "y").limit(SAMPLE_ROWS)
    sample = stored(rows.join(F.broadcast(chosen), "id").select("id", "x", "y", "fold"), "sample")
    part = F.pmod(F.xxhash64("id", "x"), F.lit(PARTS)).alias("part")
    learn = sample.where(~F.col("fold")).select(part, "x", "y")
    d = len(STATISTICS)

    sums = learn.groupBy("part").applyInArrow(
        lambda t: pa.table({"n": [len(t)], "s": [_matrix(t["x"].combine_chunks()).sum(axis=0).tolist()], "q": [(_matrix(t["x"].combine_chunks()) ** 2).sum(axis=0).tolist()]}),
        "n bigint, s array<double>, q array<double>",
    ).collect()
    n = sum(r["n"] for r in sums)
    if not n:
        return Model(np.zeros(d), np.ones(d), np.empty(0), np.array([0.5]), np.zeros(COSINES + 1))
    mean = np.sum([r["s"] for r in sums], axis=0) / n
    scale = np.sqrt(np.maximum(np.sum([r["q"] for r in sums], axis=0) / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)

    def normal(t: pa.Table) -> pa.Table:
        phi, y = cosines(_matrix(t["x"].combine_chunks()), mean, scale), np.array(t["y"].to_pylist())
        return pa.table({"a": [(phi.T @ phi).tobytes()], "b": [(phi.T @ y).tobytes()]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    equations = learn.groupBy("part").applyInArrow(normal, "a binary, b binary").collect()
    a = np.sum([np.frombuffer(r["a"]) for r in equations], axis=0).reshape(COSINES + 1, -1)
    b = np.sum([np.frombuffer(r["b"]) for r in equations], axis=0)
    weights = np.linalg.solve(a + RIDGE * n * np.eye(COSINES + 1) / COSINES, b)
    model = Model(mean, scale, np.empty(0), np.array([0.5]), weights)
    return _calibrated(sample, model)


def _calibrated(sample: DataFrame, model: Model) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch.column(0)))
                # Ridge scores lie about 0 to 1; the outer bins are open.
                bins = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1), batch.column(2)], names=["bin", "y", "fold"])

    held = sample.select("x", "y", "fold").mapInArrow(count, "bin int, y double, fold boolean")
    rows = held.groupBy("bin", "fold").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    use = [r for r in rows if r["fold"]] or rows
    ones, n = np.zeros(BINS), np.zeros(BINS)
    for r in use:
        ones[r["bin"]] += r["y"]
        n[r["bin"]] += r["n"]
    edges, shares = isotonic(ones, n)
    model.edges, model.shares = edges / (BINS / 2) - 0.5, shares
    return model


def isotonic(ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bins of the pools but the first, shares of all pools): neighbours that fall are pooled until none does."""
    pools: list[list[float]] = []
    for k in np.flatnonzero(n).tolist():
        pools.append([k, ones[k], n[k]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, y, w = pools.pop()
            pools[-1][1] += y
            pools[-1][2] += w
    return np.array([p[0] for p in pools[1:]], float), np.array([p[1] / p[2] for p in pools])


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(id, score) of described texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value(_matrix(batch.column(1))))], names=["id", "score"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
