"""Training a small head on stored embedding tables.

Every step is one Spark job in which each partition turns its rows into summed
gradients, groups of partitions add those up as arrays, and the driver adds the
groups and updates a few thousand parameters. Rows never leave the executors.
Full-batch steps read the cached table; smaller batches are stored by step in the
order of the epoch, and a step reads the files of its own batch alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as vx
from ..operators import heads, metrics as mt
from ..operators.combine import CombineParams, check_method
from ..operators.labels import decode
from ..operators.order import with_epoch_order
from ..session import drop_scratch, scratch_path

# Optimizer settings.
LEARNING_RATE = 2e-5
EPOCHS = 10
BATCH_SIZE = 16
WEIGHT_DECAY = 0.01
CLIP_NORM = 5.0
WARMUP_FRACTION = 0.1
BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8
NORM_EPS = 1e-3

#: Rows of a file of a batch, and groups in which partitions add up their gradients.
FILE_ROWS = 1 << 16
GROUPS = 32


@dataclass
class HeadSpec:
    """Shape of a model: encoder widths, combine method, number of outputs.

    One output means regression with squared error, more mean classification
    with cross-entropy.
    """

    widths: Sequence[int]
    outputs: int
    method: str = "concat"
    layer_norm: bool = False
    dropout: float = 0.0

    def __post_init__(self):
        self.method = check_method(self.method, len(self.widths))

    @property
    def projected(self) -> bool:
        return self.method in ("mean", "dme")

    @property
    def meta_width(self) -> int:
        return max(self.widths) if self.projected else sum(self.widths)

    def init(self, seed: int = 0) -> dict[str, np.ndarray]:
        """Xavier-uniform decoder, uniform 1/sqrt(in) for the other maps."""
        rng = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {}
        meta = self.meta_width
        if self.projected:
            for i, d in enumerate(self.widths):
                p[f"proj_w{i}"] = rng.uniform(-1, 1, (meta, d)) / np.sqrt(d)
                p[f"proj_b{i}"] = rng.uniform(-1, 1, meta) / np.sqrt(d)
        if self.method == "dme":
            p["attn_w"] = rng.uniform(-1, 1, meta) / np.sqrt(meta)
            p["attn_b"] = rng.uniform(-1, 1, 1) / np.sqrt(meta)
        if self.layer_norm and self.method != "none":
            for d in sorted({meta} if self.projected else set(self.widths)):
                p[f"norm_g{d}"], p[f"norm_b{d}"] = np.ones(d), np.zeros(d)
        bound = np.sqrt(6.0 / (meta + self.outputs))
        p["dec_w"] = rng.uniform(-bound, bound, (self.outputs, meta))
        p["dec_b"] = rng.uniform(-1, 1, self.outputs) / np.sqrt(meta)
        return p

    def combine_params(self, p: dict[str, np.ndarray]) -> CombineParams:
        n = range(len(self.widths))
        norms = {int(k[6:]): (p[k], p[f"norm_b{k[6:]}"]) for k in p if k.startswith("norm_g")}
        return CombineParams(
            projections=[(p[f"proj_w{i}"], p[f"proj_b{i}"]) for i in n] if self.projected else None,
            attention=p.get("attn_w"),
            attention_bias=float(p["attn_b"][0]) if "attn_b" in p else 0.0,
            layer_norm=bool(norms),
            norms=norms,
            widths=list(self.widths),
        )


def forward_backward(spec: HeadSpec, p, xs, y, w, mask=None, with_grad: bool = True):
    """Weighted loss sum of a batch and, if asked, its gradient for every parameter."""
    g: dict[str, np.ndarray] = {}
    hs, states = [], []
    for i, x in enumerate(xs):
        h = x @ p[f"proj_w{i}"].T + p[f"proj_b{i}"] if spec.projected else x
        key = h.shape[1]
        if f"norm_g{key}" in p:
            centred = h - h.mean(axis=1, keepdims=True)
            inv = 1.0 / np.sqrt((centred**2).mean(axis=1, keepdims=True) + NORM_EPS)
            states.append((key, centred * inv, inv))
            h = centred * inv * p[f"norm_g{key}"] + p[f"norm_b{key}"]
        hs.append(h)
    share = None
    if spec.method == "dme":
        share = vx.softmax_rows(np.stack([h @ p["attn_w"] + p["attn_b"][0] for h in hs], axis=1))
        z = sum(share[:, i : i + 1] * h for i, h in enumerate(hs))
    elif spec.method == "mean":
        z = sum(hs) / len(hs)
    else:
        z = np.concatenate(hs, axis=1)
    if mask is not None:
        z = z * mask
    out = z @ p["dec_w"].T + p["dec_b"]
    if spec.outputs == 1:
        d = out[:, 0] - y
        loss = float((w * d * d).sum())
        d_out = (2.0 * w * d)[:, None]
    else:
        label = y.astype(np.int64)
        prob = vx.softmax_rows(out)
        rows = np.arange(len(label))
        top = out.max(axis=1)
        loss = float((w * (top + np.log(np.exp(out - top[:, None]).sum(axis=1)) - out[rows, label])).sum())
        d_out = prob
        d_out[rows, label] -= 1.0
        d_out = d_out * w[:, None]
    if not with_grad:
        return loss, g
    g["dec_w"], g["dec_b"] = d_out.T @ z, d_out.sum(axis=0)
    dz = d_out @ p["dec_w"]
    if mask is not None:
        dz = dz * mask
    if spec.method == "dme":
        d_share = np.stack([(dz * h).sum(axis=1) for h in hs], axis=1)
        d_score = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
        dhs = [share[:, i : i + 1] * dz + d_score[:, i : i + 1] * p["attn_w"] for i in range(len(hs))]
        g["attn_w"] = sum(d_score[:, i] @ h for i, h in enumerate(hs))
        g["attn_b"] = np.array([d_score.sum()])
    elif spec.method == "mean":
        dhs = [dz / len(hs)] * len(hs)
    else:
        dhs = np.split(dz, np.cumsum([h.shape[1] for h in hs])[:-1], axis=1)
    for i, x in enumerate(xs):
        dh = dhs[i]
        if states:
            key, unit, inv = states[i]
            g[f"norm_g{key}"] = g.get(f"norm_g{key}", 0.0) + (dh * unit).sum(axis=0)
            g[f"norm_b{key}"] = g.get(f"norm_b{key}", 0.0) + dh.sum(axis=0)
            du = dh * p[f"norm_g{key}"]
            dh = inv * (du - du.mean(axis=1, keepdims=True) - unit * (du * unit).mean(axis=1, keepdims=True))
        if spec.projected:
            g[f"proj_w{i}"], g[f"proj_b{i}"] = dh.T @ x, dh.sum(axis=0)
    return loss, g


def dropout_mask(ids: np.ndarray, width: int, p: float, seed: int) -> np.ndarray:
    """0 or 1/(1-p) per item, decided by a hash of (seed, row id, item): the same on every retry."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
        for shift in (30, 27, 31):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x94D049BB133111EB)
    return (x / 2.0**64 >= p) / (1.0 - p)


def summed_gradient(df: DataFrame, spec: HeadSpec, p: dict[str, np.ndarray], with_grad: bool = True, seed: int = 0):
    """(loss sum, weight sum, gradient sums) over a table (id, y, w, vec_1 …), by one job."""
    names = list(p)
    n_enc = len(spec.widths)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        loss = weight = 0.0
        total = np.zeros(sum(p[n].size for n in names) if with_grad else 0)
        for b in batches:
            if not b.num_rows:
                continue
            part, w, g = _batch_gradient(b, spec, p, n_enc, with_grad, seed)
            loss, weight = loss + part, weight + float(w.sum())
            if with_grad:
                total += np.concatenate([np.ravel(g[n]) for n in names])
        yield _summed(TaskContext.get().partitionId(), np.concatenate(([loss, weight], total)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["part"], r["sums"]) for b in batches for r in b.to_pylist())
        if rows:
            yield _summed(rows[0][0], np.sum([np.frombuffer(s) for _, s in rows], axis=0))

    columns = ["id", "y", "w"] + [f"vec_{i + 1}" for i in range(n_enc)]
    sums = df.select(*columns).mapInArrow(per_partition, "part int, sums binary")
    if df.rdd.getNumPartitions() > GROUPS:
        sums = sums.repartition(GROUPS, F.pmod("part", F.lit(GROUPS))).mapInArrow(added, "part int, sums binary")
    # At most GROUPS rows of one number a parameter, whatever the size of the table.
    rows = sorted((r.part, bytes(r.sums)) for r in sums.collect())
    flat = np.sum([np.frombuffer(s) for _, s in rows], axis=0) if rows else np.zeros(2 + (sum(a.size for a in p.values()) if with_grad else 0))
    grads, at = {}, 2
    if with_grad:
        for n in names:
            grads[n] = flat[at : at + p[n].size].reshape(p[n].shape)
            at += p[n].size
    return flat[0], flat[1], grads


def _batch_gradient(b: pa.RecordBatch, spec: HeadSpec, p, n_enc: int, with_grad: bool, seed: int):
    xs = [vx.to_matrix(b.column(f"vec_{i + 1}")) for i in range(n_enc)]
    y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
    w = b.column("w").to_numpy(zero_copy_only=False).astype(float)
    mask = None
    if with_grad and spec.dropout > 0:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        mask = dropout_mask(ids, spec.meta_width, spec.dropout, seed)
    loss, g = forward_backward(spec, p, xs, y, w, mask, with_grad)
    return loss, w, g


def _summed(part: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["part", "sums"])


def batch_losses(df: DataFrame, spec: HeadSpec, p: dict[str, np.ndarray]) -> DataFrame:
    """(batch_id, loss): weighted mean loss of each batch of a table with `batch_id`."""
    n_enc = len(spec.widths)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = b.column("batch_id").to_numpy()
            for k in np.unique(batch).tolist():
                own = b.filter(pa.array(batch == k))
                loss, w, _ = _batch_gradient(own, spec, p, n_enc, False, 0)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([loss]), pa.array([float(w.sum())])], ["batch_id", "l", "w"])

    columns = ["batch_id", "id", "y", "w"] + [f"vec_{i + 1}" for i in range(n_enc)]
    parts = df.select(*columns).mapInArrow(per_partition, "batch_id bigint, l double, w double")
    return parts.groupBy("batch_id").agg(F.try_divide(F.sum("l"), F.sum("w")).alias("loss"))


def in_batches(df: DataFrame, batch_size: int, epoch: int = 1, seed: int = 0) -> DataFrame:
    """Add `batch_id`: runs of `batch_size` sentences in the order of an epoch; the last may be short.

    A sentence is a row, or all rows of one `sent` if there is such a column. Only
    keys are put in order; rows move once, to their batch.
    """
    key = "sent" if "sent" in df.columns else "id"
    keys = df.select(key).distinct() if key == "sent" else df.select(key)
    at = with_epoch_order(keys, key, epoch, seed, "_pos").select(key, F.floor(F.col("_pos") / batch_size).alias("batch_id"))
    return df.join(at, key)


class StepStore:
    """The rows of an epoch, stored by step: a step reads its own files and no others."""

    def __init__(self, train: DataFrame, batch_size: int, epoch: int, seed: int = 0) -> None:
        self.spark, self.schema = train.sparkSession, train.schema
        self.path = scratch_path(self.spark, f"epoch-{epoch}")
        rows = in_batches(train, batch_size, epoch, seed)
        # A batch of many rows is many files, so that no task holds it whole.
        files = max(1, -(-batch_size // FILE_ROWS))
        dealt = rows.repartition("batch_id", F.pmod(F.xxhash64("id"), F.lit(files)))
        dealt.write.partitionBy("batch_id").parquet(self.path)

    def step(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={number}")

    def drop(self) -> None:
        drop_scratch(self.spark, self.path)


def schedule_factor(step: int, steps: int, warmup: int) -> float:
    if step < warmup:
        return step / max(1, warmup)
    return max(0.0, (steps - step) / max(1, steps - warmup))


def lr_schedule(plan: DataFrame, learning_rate: float) -> DataFrame:
    """Learning rate of every step of a `batch_plan` row: linear rise, then linear fall to 0."""
    step, steps, warmup = F.col("step"), F.col("training_steps"), F.col("warmup_steps")
    one = F.lit(1).cast("bigint")
    rise = step / F.greatest(one, warmup)
    fall = F.greatest(F.lit(0.0), (steps - step) / F.greatest(one, steps - warmup))
    return (
        plan.where(steps > 0)
        .select("training_steps", "warmup_steps", F.explode(F.sequence(F.lit(0).cast("bigint"), steps - 1)).alias("step"))
        .select("step", (F.when(step < warmup, rise).otherwise(fall) * learning_rate).alias("lr"))
    )


@dataclass
class AdamW:
    """Decoupled weight decay, gradients clipped to a global norm first."""

    weight_decay: float = WEIGHT_DECAY
    clip: float = CLIP_NORM
    t: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def update(self, p, grads, rate: Callable[[str], float]) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / (norm + 1e-6))
        self.t += 1
        b1, b2 = BETAS
        for n, g in grads.items():
            g = g * scale
            self.m[n] = b1 * self.m.get(n, 0.0) + (1 - b1) * g
            self.v[n] = b2 * self.v.get(n, 0.0) + (1 - b2) * g * g
            m, v = self.m[n] / (1 - b1**self.t), self.v[n] / (1 - b2**self.t)
            lr = rate(n)
            p[n] = p[n] * (1 - lr * self.weight_decay) - lr * m / (np.sqrt(v) + ADAM_EPS)


def group_rates(
    spec: HeadSpec, learning_rate: float | Sequence[float], decoder_learning_rate: float | None
) -> Callable[[str], float]:
    """Rate of each parameter: one rate for all, or one per encoder's projection;
    everything behind the projections follows the decoder rate, if given."""
    rates = [learning_rate] if isinstance(learning_rate, (int, float)) else list(learning_rate)
    if len(rates) not in (1, len(spec.widths)):
        raise ValueError(f"{len(spec.widths)} encoders but {len(rates)} learning rates")
    decoder = rates[0] if decoder_learning_rate is None else decoder_learning_rate

    def rate(name: str) -> float:
        if name.startswith("proj_"):
            return rates[int(name[6:])] if len(rates) > 1 else rates[0]
        return decoder

    return rate


@dataclass
class FitResult:
    spec: HeadSpec
    params: dict[str, np.ndarray]
    history: list[tuple]
    best_epoch: int | None = None
    test: list[tuple] | None = None
    #: (epoch, step from 1, loss) of every step.
    steps: list[tuple] = field(default_factory=list)

    def progress_table(self, spark, epoch: int, parts: int = 10) -> DataFrame:
        """Average loss of each tenth of an epoch."""
        own = [(k, float(loss)) for e, k, loss in self.steps if e == epoch]
        return mt.progress_loss(spark.createDataFrame(own, "batch bigint, loss double"), max(1, len(own)), parts)

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, train_loss double, val_loss double, score double")

    def score(self, table: DataFrame) -> DataFrame:
        """Add `pred` to a table with vec_1 … vec_n."""
        return score_table(table, self.spec, self.params)


def score_table(table: DataFrame, spec: HeadSpec, p: dict[str, np.ndarray]) -> DataFrame:
    vectors = [f"vec_{i + 1}" for i in range(len(spec.widths))]
    method = "concat" if spec.method == "none" else spec.method
    scored = heads.predict(table, vectors, method, spec.combine_params(p), p["dec_w"], p["dec_b"])
    if spec.outputs == 1:
        scored = scored.withColumn("pred", F.get("logits", F.lit(0)))
    return scored


def fit(
    train: DataFrame,
    spec: HeadSpec,
    *,
    dev: DataFrame | None = None,
    test: DataFrame | None = None,
    metrics: Sequence[str] = (),
    task: str | None = None,
    tags: Mapping[str, int] | None = None,
    learning_rate: float | Sequence[float] = LEARNING_RATE,
    decoder_learning_rate: float | None = None,
    epochs: int = EPOCHS,
    batch_size: int | None = None,
    steps_per_epoch: int = 1,
    use_linear_scheduler: bool = False,
    warmup_fraction: float = WARMUP_FRACTION,
    weight_decay: float = WEIGHT_DECAY,
    floor: float | None = None,
    seed: int = 0,
    init: dict[str, np.ndarray] | None = None,
) -> FitResult:
    """Train on a table (id, y, w, vec_1 …); `w` weighs the loss of a row (1 for sentences,
    1 / number of words for tagged words, so that each sentence counts once).

    Batches have `batch_size` sentences in the order of the epoch (the first in key order,
    later ones shuffled by the seed); without it `steps_per_epoch` equal batches,
    1 being full-batch training. The rows of a sentence of tagged words share a column `sent` and
    a batch, and `tags` (name -> number) makes the metrics those of tag sequences. The
    dev loss is the mean of its batches' losses, in key order. With `dev` and
    `metrics` the parameters of the best epoch by the first metric are kept
    and `test` is scored once with them. `init` gives the first parameters.
    """
    p = {n: np.array(a, float) for n, a in init.items()} if init else spec.init(seed)
    rate = group_rates(spec, learning_rate, decoder_learning_rate)
    optimizer = AdamW(weight_decay)
    if batch_size or steps_per_epoch > 1:
        n = (train.select("sent").distinct() if "sent" in train.columns else train).count()
        batch_size = batch_size or -(-n // steps_per_epoch)
        steps_per_epoch = -(-n // batch_size) if n else 0
    steps = epochs * steps_per_epoch
    warmup = int(np.ceil(steps * warmup_fraction))
    task = task or ("Sequence labeling" if tags else "Sentence regression" if spec.outputs == 1 else "Sentence classification")
    history, every, best, best_score, best_epoch = [], [], p, -np.inf if floor is None else floor, None
    dev_rows = dev if dev is None or not batch_size else in_batches(dev, batch_size)
    kept = [dev_rows] if batch_size else [train, dev_rows]
    cached = [t.persist(StorageLevel.MEMORY_AND_DISK) for t in kept if t is not None]
    try:
        step = 0
        for epoch in range(1, epochs + 1):
            losses = []
            store = StepStore(train, batch_size, epoch, seed) if batch_size else None
            for part in range(steps_per_epoch):
                rows = store.step(part) if store else train
                loss, weight, grads = summed_gradient(rows, spec, p, seed=seed * 1_000_003 + step)
                if weight > 0:
                    factor = schedule_factor(step, steps, warmup) if use_linear_scheduler else 1.0
                    optimizer.update(p, {n: g / weight for n, g in grads.items()}, lambda n: rate(n) * factor)
                    losses.append(loss / weight)
                    every.append((epoch, part + 1, loss / weight))
                step += 1
            if store:
                store.drop()
            val_loss = score = None
            if dev is not None:
                val_loss = _dev_loss(dev_rows, spec, p)
                if metrics:
                    score = _main_score(dev_rows, spec, p, task, metrics, tags)
                    if score is not None and score > best_score:
                        best, best_score, best_epoch = {n: a.copy() for n, a in p.items()}, score, epoch
            history.append((epoch, float(np.mean(losses)) if losses else None, val_loss, score))
    finally:
        for t in cached:
            t.unpersist()
    if best_epoch is None:
        best = p
    result = FitResult(spec, best, history, best_epoch, steps=every)
    if test is not None and metrics:
        rows = mt.evaluate(_gold_pred(result.score(test), tags), task, metrics).orderBy("rank").collect()
        result.test = [(r.metric, r.value) for r in rows]
    return result


def _dev_loss(dev: DataFrame, spec: HeadSpec, p) -> float | None:
    if "batch_id" in dev.columns:
        return mt.validation_loss(batch_losses(dev, spec, p)).first().value
    loss, weight, _ = summed_gradient(dev, spec, p, with_grad=False)
    return float(loss / weight) if weight else None


def _gold_pred(scored: DataFrame, tags: Mapping[str, int] | None = None) -> DataFrame:
    if not tags:
        return scored.select(F.col("y").alias("gold"), F.col("pred").cast("double").alias("pred"))
    return tag_sequences(scored, tags)


def tag_sequences(scored: DataFrame, tags: Mapping[str, int]) -> DataFrame:
    """(sent, gold, pred): names of the tags of each sentence, in the order of `word_pos`. A group is one sentence."""
    word = F.struct("word_pos", F.col("y").cast("int").alias("g"), F.col("pred").cast("int").alias("p"))
    rows = scored.groupBy("sent").agg(F.array_sort(F.collect_list(word)).alias("_words"))
    return rows.select(
        "sent",
        F.transform("_words", lambda x: decode(x["g"], tags)).alias("gold"),
        F.transform("_words", lambda x: decode(x["p"], tags)).alias("pred"),
    )


def _main_score(dev: DataFrame, spec: HeadSpec, p, task: str, metrics: Sequence[str], tags=None) -> float | None:
    row = mt.evaluate(_gold_pred(score_table(dev, spec, p), tags), task, metrics[:1]).first()
    return row.value


def training_table(
    aligned: DataFrame, key: str, target: Column, vectors: Sequence[str], weight: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Columns (id, y, w, vec_1 …) of an aligned table, and those in `keep` (`sent`, `word_pos` for tagged words)."""
    w = F.lit(1.0) if weight is None else weight
    return aligned.select(
        F.col(key).cast("bigint").alias("id"),
        target.cast("double").alias("y"),
        w.cast("double").alias("w"),
        *keep,
        *[F.col(v).cast("array<double>").alias(f"vec_{i}") for i, v in enumerate(vectors, 1)],
    )
