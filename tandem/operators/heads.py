"""Linear heads over a table of vectors: scores, predictions, losses, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as ax, vectors as vx
from .combine import CombineParams, combine, meta_score
from .labels import decode


def logits(vec: Column, weight, bias) -> Column:
    return vx.linear(vec, weight, bias)


def softmax(scores: Column) -> Column:
    return ax.softmax(scores)


def classify(scores: Column) -> Column:
    """Class id of the largest score, the first one on ties."""
    return ax.argmax(scores)


def regress(vec: Column, weight: Sequence[float], bias: float) -> Column:
    """Score of a head with a single output."""
    return F.get(vx.linear(vec, [list(weight)], [bias]), F.lit(0))


def with_prediction(df: DataFrame, weight, bias, vec: str = "vec") -> DataFrame:
    """Add `logits` and `pred`."""
    return df.withColumn("logits", logits(F.col(vec), weight, bias)).withColumn("pred", classify(F.col("logits")))


def predict_with_attention(
    aligned: DataFrame, vectors: Sequence[str], params: CombineParams, weight, bias
) -> DataFrame:
    """Add `dme_scores`, `logits` and `pred` to an aligned table: one Arrow pass over each row."""
    return (
        aligned.withColumn("_s", meta_score([F.col(v) for v in vectors], params, weight, bias))
        .withColumn("dme_scores", F.col("_s.dme_scores"))
        .withColumn("logits", F.col("_s.logits"))
        .withColumn("pred", classify(F.col("logits")))
        .drop("_s")
    )


def predict(
    aligned: DataFrame, vectors: Sequence[str], method: str, params: CombineParams, weight, bias
) -> DataFrame:
    """Prediction with any combine method; dme also reports its weights."""
    if method == "dme" and len(vectors) > 1:
        return predict_with_attention(aligned, vectors, params, weight, bias)
    return with_prediction(combine(aligned, vectors, method, params), weight, bias)


def prediction_report(scored: DataFrame, label_map: Mapping[str, int] | None = None) -> DataFrame:
    """Report columns: text, attention weights if present, prediction and its name.

    Without a map, and for regression scores, the prediction stays a number.
    """
    keep = [c for c in ("sent_id", "text", "text_pair", "dme_scores") if c in scored.columns]
    out = scored.select(*keep, F.col("pred").alias("prediction"))
    if label_map:
        out = out.withColumn("prediction_name", decode(F.col("prediction"), label_map))
    return out


def word_report(tagged: DataFrame, label_map: Mapping[str, int], key: str = "sent_id") -> DataFrame:
    """Per sentence the ordered list of (word, tag name). A group is one sentence."""
    item = F.struct("word_pos", "word", decode(F.col("pred"), label_map).alias("tag"))
    return tagged.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("words"))


# --- losses --------------------------------------------------------------


def cross_entropy(scores: Column, label: Column) -> Column:
    """Loss of one row: log of the summed exponentials minus the score of the label."""
    return ax.log_sum_exp(scores) - F.get(scores, label.cast("int"))


def loss_cross_entropy(df: DataFrame, scores: str = "logits", label: str = "label") -> DataFrame:
    """Mean cross-entropy of each batch."""
    return df.groupBy("batch_id").agg(F.avg(cross_entropy(F.col(scores), F.col(label))).alias("loss"))


def loss_squared(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Mean squared error of each batch."""
    d = F.col(score) - F.col(target)
    return df.groupBy("batch_id").agg(F.avg(d * d).alias("loss"))


def sentence_tag_loss(df: DataFrame, *keep: str, scores: str = "logits", tag: str = "tag_id", key: str = "sent_id") -> DataFrame:
    """(keep, key, loss): mean loss over the tagged words of each sentence."""
    per_word = df.where(F.col(tag) != -1).withColumn("_loss", cross_entropy(F.col(scores), F.col(tag)))
    return per_word.groupBy(*keep, key).agg(F.avg("_loss").alias("loss"))


def loss_tags(df: DataFrame, scores: str = "logits", tag: str = "tag_id", key: str = "sent_id") -> DataFrame:
    """Tag loss of each batch: mean inside each sentence, then mean over the sentences."""
    per_sentence = sentence_tag_loss(df, "batch_id", scores=scores, tag=tag, key=key)
    return per_sentence.groupBy("batch_id").agg(F.avg("loss").alias("loss"))
