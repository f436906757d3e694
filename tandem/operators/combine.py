"""Combining the vectors of several encoders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as vx

METHODS = ("concat", "mean", "dme")


@dataclass
class CombineParams:
    """Parameters of a combination; arrays are small and dense.

    `projections`: one (weight, bias) per encoder, needed by mean and dme.
    `attention`, `attention_bias`: the score of a projected vector, needed by dme.
    `norms`: width -> (scale, shift) of the layer norm, if `layer_norm` is on.
    """

    projections: Sequence[tuple] | None = None
    attention: Sequence[float] | None = None
    attention_bias: float = 0.0
    layer_norm: bool = False
    norms: Mapping[int, tuple] = field(default_factory=dict)
    widths: Sequence[int] | None = None


def check_method(method: str, n_encoders: int) -> str:
    """`none` for a single encoder, else the method; unknown names are an error."""
    if method not in METHODS:
        raise ValueError(f"combine method {method!r} is not one of {METHODS}")
    return "none" if n_encoders == 1 else method


def align(
    tables: Sequence[DataFrame], key: str | Sequence[str] = "sent_id", vec: str = "vec", drop_missing: bool = False
) -> DataFrame:
    """One row per sentence with vec_1 … vec_n, and the other columns of the first table.

    With several key columns, such as sentence and word position, the rows are words.

    A sentence that one of the tables lacks stops the query; `drop_missing`
    leaves such sentences out. Two tables are joined; if they are bucketed by the key (see
    `sources.sink.write_bucketed`) without a shuffle. Of three or more the rows are put together and
    grouped by the key, so each row moves once; there a doubled sentence stops the query too.
    """
    keys = [key] if isinstance(key, str) else list(key)
    renamed = [
        t.select(*keys, F.col(vec).alias(f"vec_{i}"), *[c for c in t.columns if i == 1 and c not in (*keys, vec)])
        for i, t in enumerate(tables, 1)
    ]
    if len(renamed) > 2:
        return _grouped(renamed, keys, drop_missing)
    if drop_missing or len(renamed) == 1:
        return reduce(lambda a, b: a.join(b, keys), renamed)
    there = [F.col(f"_in_{i}") for i in range(len(renamed))]
    marked = [t.withColumn(f"_in_{i}", F.lit(True)) for i, t in enumerate(renamed)]
    joined = reduce(lambda a, b: a.join(b, keys, "full"), marked)
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in there])
    return joined.where(F.when(complete, F.lit(True)).otherwise(_stop("an encoder has no vector of sentence ", keys))).drop(
        *[f"_in_{i}" for i in range(len(renamed))]
    )


def _stop(message: str, keys: Sequence[str]) -> Column:
    place = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return F.raise_error(F.concat(F.lit(message), place)).cast("boolean")


def _grouped(tables: list[DataFrame], keys: list[str], drop_missing: bool) -> DataFrame:
    """Tagged union of all tables, grouped once. Only one row of each table is kept in a group, however often it is there."""
    union = None
    for i, t in enumerate(tables, 1):
        body = F.struct(*[c for c in t.columns if c not in keys])
        tagged = t.select(*keys, body.alias(f"_t{i}"), F.lit(1).alias(f"_n{i}"))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    n = range(1, len(tables) + 1)
    grouped = union.groupBy(*keys).agg(*[F.first(f"_t{i}", ignorenulls=True).alias(f"_t{i}") for i in n], *[F.count(f"_n{i}").alias(f"_n{i}") for i in n])
    every = reduce(lambda a, b: a & b, [F.col(f"_n{i}") > 0 for i in n])
    once = reduce(lambda a, b: a & b, [F.col(f"_n{i}") < 2 for i in n])
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & every
    sound = F.when(~there, F.lit(False) if drop_missing else _stop("an encoder has no vector of sentence ", keys))
    sound = sound.when(once, F.lit(True)).otherwise(_stop("an encoder has more than one vector of sentence ", keys))
    names = [F.col(f"_t{i}.{c}").alias(c) for i, t in enumerate(tables, 1) for c in t.columns if c not in keys]
    return grouped.where(sound).select(*keys, *names)


def project(vec: Column, weight, bias) -> Column:
    """Linear map of one encoder's vectors to the common width."""
    return vx.linear(vec, weight, bias)


def layer_norm(vec: Column, scale=None, shift=None) -> Column:
    return vx.layer_norm(vec, scale, shift)


def prepare(vectors: Sequence[Column], params: CombineParams, method: str) -> list[Column]:
    """Projected (mean, dme) and normalized vectors, in the order of the encoders."""
    out = list(vectors)
    if method in ("mean", "dme"):
        if params.projections is None:
            raise ValueError(f"{method} needs one projection per encoder")
        out = [project(v, w, b) for v, (w, b) in zip(out, params.projections)]
    if params.layer_norm:
        if method == "concat":
            if params.norms and params.widths is None:
                raise ValueError("layer norm before concat needs the widths of the encoders")
            widths = params.widths or [None] * len(out)
        else:
            widths = [len(params.projections[0][1])] * len(out)
        out = [layer_norm(v, *params.norms.get(w, (None, None))) for v, w in zip(out, widths)]
    return out


def concat(vectors: Sequence[Column]) -> Column:
    return F.concat(*[v.cast("array<double>") for v in vectors])


def mean(vectors: Sequence[Column]) -> Column:
    return vx.mean_of(vectors)


def dme_weights(vectors: Sequence[Column], attention, offset: float = 0.0) -> Column:
    """Attention weight of each encoder: softmax over the encoders of a row."""
    return vx.attention_weights(vectors, attention, offset)


def dme(weights: Column, vectors: Sequence[Column]) -> Column:
    """Meta-embedding: sum of the vectors times their weights."""
    return vx.weighted_sum(weights, vectors)


def combine(df: DataFrame, vectors: Sequence[str], method: str, params: CombineParams | None = None) -> DataFrame:
    """Add `vec` (and `dme_scores` for dme) from the vector columns of an aligned table."""
    params = params or CombineParams()
    method = check_method(method, len(vectors))
    if method == "none":
        return df.withColumn("vec", F.col(vectors[0]))
    if method == "dme":
        if params.projections is None or params.attention is None:
            raise ValueError("dme needs one projection per encoder and attention parameters")
        both = df.withColumn("_m", meta_vector([F.col(v) for v in vectors], params))
        return both.withColumn("dme_scores", F.col("_m.dme_scores")).withColumn("vec", F.col("_m.vec")).drop("_m")
    # Named columns keep each Arrow UDF evaluated once.
    names = [f"_p{i}" for i in range(len(vectors))]
    ready = prepare([F.col(v) for v in vectors], params, method)
    out = df.select("*", *[c.alias(n) for c, n in zip(ready, names)])
    cols = [F.col(n) for n in names]
    return out.withColumn("vec", concat(cols) if method == "concat" else mean(cols)).drop(*names)


def embed_with_attention(df: DataFrame, vectors: Sequence[str], params: CombineParams, method: str = "dme") -> DataFrame:
    """Meta-embedding with its weights; refuses one encoder and methods without attention."""
    if len(vectors) < 2 or method != "dme":
        raise ValueError("attention weights need the dme method and at least two encoders")
    return combine(df, vectors, method, params)


def _meta_rows(vs: Sequence, params: CombineParams) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights and meta-embeddings of an Arrow batch, projections and layer norm included."""
    xs = [vx.to_matrix(v) @ np.asarray(w, float).T + np.asarray(b, float) for v, (w, b) in zip(vs, params.projections, strict=True)]
    if params.layer_norm:
        scale, shift = params.norms.get(len(params.projections[0][1]), (1.0, 0.0))
        xs = [vx.normalize_rows(x, 1e-3) * scale + shift for x in xs]
    a = np.asarray(params.attention, float)
    share = vx.softmax_rows(np.stack([x @ a + float(params.attention_bias) for x in xs], axis=1))
    return share, sum(share[:, i : i + 1] * x for i, x in enumerate(xs))


def meta_score(vectors: Sequence[Column], params: CombineParams, weight, bias) -> Column:
    """Attention weights and decoder scores of a row in one Arrow pass.

    The same numbers as `combine(…, 'dme')` followed by `heads.logits`, without
    handing the projected vectors back and forth between the JVM and Python.
    Result: struct(dme_scores, logits).
    """
    w_out, b_out = np.asarray(weight, float), np.asarray(bias, float)
    return _meta(vectors, params, "logits", lambda meta: meta @ w_out.T + b_out)


def meta_vector(vectors: Sequence[Column], params: CombineParams) -> Column:
    """Attention weights and meta-embedding of a row in one Arrow pass: struct(dme_scores, vec)."""
    return _meta(vectors, params, "vec", lambda meta: meta)


def _meta(vectors: Sequence[Column], params: CombineParams, name: str, last: Callable) -> Column:
    @F.arrow_udf(f"struct<dme_scores:array<double>,{name}:array<double>>")
    def apply(*vs):
        import pyarrow as pa

        if not len(vs[0]):
            empty = pa.array([], pa.list_(pa.float64()))
            return pa.StructArray.from_arrays([empty, empty], ["dme_scores", name])
        share, meta = _meta_rows(vs, params)
        return pa.StructArray.from_arrays([vx.from_matrix(share), vx.from_matrix(last(meta))], ["dme_scores", name])

    return apply(*vectors)
