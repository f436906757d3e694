"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs
with one word between them. Each learner runs FTRL-proximal over its own part
of the sample: every coordinate has its own rate, and L1 sets a weight to zero
until its gradients add up to more than the penalty. After each round the
learners' states are averaged. The weights that are left over, a few of 2^BITS,
are what scoring needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tandem.llm.common import stored, task, texts, uniform
from tandem.llm.positions import terms_of

BITS = 18
#: Labelled texts that a model is learned from, at most.
SAMPLE_ROWS = 20_000
LEARNERS = 4
ROUNDS, PASSES = 8, 1
SCALE = 100.0
ALPHA, BETA, L1, L2 = 3.0, 1.0, 2.0, 0.1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word)
        return value


def features(text: str, hashes: dict[bytes, int]) -> np.ndarray:
    """Slots of a text's words, pairs and skip pairs, repeats included; the last slot is the constant."""
    terms = terms_of(text)
    h = np.fromiter(map(hashes.__getitem__, terms), np.uint64, len(terms))
    top = np.uint64(64 - BITS)
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> top
    two = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> top
    skip = ((h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:]) * np.uint64(0xBF58476D1CE4E5B9)) >> top
    return np.concatenate([one, two, skip, [1 << BITS]]).astype(np.int64)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << BITS) + 1)
        out[self.slots] = self.weights
        return out


def _packed(slots: np.ndarray) -> bytes:
    """Ascending slots by their gaps, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(slots, prepend=0).astype(np.uint32).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32), dtype=np.int64)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from `labels` (id, label 0 or 1), at most SAMPLE_ROWS of them in a hashed order.

    Rows without a text or a label are left out. Without any label all scores
    are 0.5. The sample is spread over LEARNERS tasks; each round returns one
    state of 2^BITS slots from each.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null").orderBy(uniform("toxicity", F.col("id")), "id", "label").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")

    @task("toxicity")
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = [_packed(np.unique(features(t, hashes))) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["id", "label", "slots"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = stored(rows.select("id", "text", "label").mapInArrow(slots, f"id {kind}, label int, slots binary"), "sample")
    dealt = sample.withColumn("learner", F.pmod(F.xxhash64("id", "slots"), F.lit(LEARNERS)).cast("int"))
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for turn in range(ROUNDS):
        state = sample.sparkSession.sparkContext.broadcast((z, n))
        parts = dealt.groupBy("learner").applyInArrow(_learner(state, turn), "z binary, n binary").toArrow()
        if not parts.num_rows:
            break
        z, n = (np.mean([np.frombuffer(x, np.float64) for x in parts.column(c).to_pylist()], axis=0) for c in ("z", "n"))
        state.unpersist()
    w = _weights(z, n)
    # The constant takes no penalty, so a text of unknown words has the share of the label.
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)
    kept = np.flatnonzero(w)
    return Model(kept, w[kept])


def _learner(state, turn: int):  # noqa: ANN001, ANN202
    def run(part: pa.Table) -> pa.Table:
        z, n = (x.copy() for x in state.value)
        ids, label, slots = (part.column(c).to_pylist() for c in ("id", "label", "slots"))
        # Another order each pass, the same in every run.
        keys = [(str(i), xxhash.xxh64_intdigest(s)) for i, s in zip(ids, slots, strict=True)]
        order = [i for k in range(PASSES) for i in sorted(range(len(ids)), key=lambda i: xxhash.xxh64_intdigest(f"{turn}|{k}|{keys[i]}"))]
        for i in order:
            x = _unpacked(slots[i])
            w = _weights(z[x], n[x])
            w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)
            value = np.append(np.full(len(x) - 1, np.sqrt(SCALE / len(x))), 1.0)
            g = (_sigmoid(w @ value) - label[i]) * value
            rate = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - rate * w
            n[x] += g * g
        return pa.table({"z": [z.tobytes()], "n": [n.tobytes()]}, schema=pa.schema([("z", pa.binary()), ("n", pa.binary())]))

    return run


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the model's probability of label 1 in `score_col`, a new name; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.slots, model.weights))

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hashes = Model(*shared.value).dense(), _Hashes()
        for batch in batches:
            found = []
            for text in texts(batch.column(text_col)):
                slots = np.unique(features(text, hashes))
                w = weights[slots]
                found.append(_sigmoid(w[:-1].sum() * np.sqrt(SCALE / len(slots)) + w[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{score_col}` double")
