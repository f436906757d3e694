"""The known corpora as rows of one table, and loading a corpus by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import labels as lb, splits as sp
from ..operators.order import with_epoch_order
from ..operators.stats import default_metrics
from . import ordered, text as src


@dataclass(frozen=True)
class CorpusSpec:
    """How a corpus lies on disk and how it is scored. Positions are 0-based."""

    name: str
    task: str
    folder: str
    files: Mapping[str, str]
    label: int | None
    text: int
    pair: int | None = None
    header: bool = False
    delimiter: str = "\t"
    label_map: Mapping[str, int] | None = None
    metrics: tuple[str, ...] = ()
    targets: Mapping[str, int] = field(default_factory=dict)
    dev_label: int | None = None

    @property
    def tagged(self) -> bool:
        return self.task == SEQUENCE

    @property
    def main_metric(self) -> str:
        return (self.metrics or default_metrics(self.task))[0]


def bio(types: str) -> dict[str, int]:
    """Tag map of a list of entity types: O, then B-x and I-x of each."""
    names = ["O"] + [f"{p}-{t}" for t in types.split() for p in "BI"]
    return {n: i for i, n in enumerate(names)}


def numbered(names: str) -> dict[str, int]:
    return {n: i for i, n in enumerate(names.split(","))}


SINGLE = "Sentence classification"
PAIR = "Sentence-pair classification"
PAIR_SCORE = "Sentence-pair regression"
SCORE = "Sentence regression"
SEQUENCE = "Sequence labeling"

TRAIN_DEV = {"train": "train.tsv", "dev": "dev.tsv"}
TRAIN_DEV_TXT = {"train": "train.txt", "dev": "dev.txt"}
THREE_TXT = {"train": "train.txt", "dev": "dev.txt", "test": "test.txt"}

# Layouts, label maps and metrics of the public corpora.
CORPORA: dict[str, CorpusSpec] = {
    "cola": CorpusSpec(
        "CoLA Corpus of Linguistic Acceptability", SINGLE, "glue/CoLA", TRAIN_DEV, 1, 3,
        label_map=numbered("not_acceptable,acceptable"), metrics=("matthews_corr", "accuracy")),
    "sst2": CorpusSpec(
        "SST-2 Stanford Sentiment Treebank", SINGLE, "glue/SST-2", TRAIN_DEV, 1, 0, header=True,
        label_map=numbered("negative,positive"), metrics=("accuracy",)),
    "mrpc": CorpusSpec(
        "MRPC Microsoft Research Paraphrase Corpus", PAIR, "glue/MRPC", TRAIN_DEV, 0, 3, 4, header=True,
        label_map=numbered("not_paraphrase,paraphrase"), metrics=("accuracy", "f1_score")),
    "stsb": CorpusSpec(
        "STS-B Semantic Textual Similarity Benchmark", PAIR_SCORE, "glue/STS-B", TRAIN_DEV, 9, 7, 8, header=True,
        metrics=("pearsonr", "spearmanr")),
    "qqp": CorpusSpec(
        "QQP Quora Question Pairs", PAIR, "glue/QQP", TRAIN_DEV, 5, 3, 4, header=True,
        label_map=numbered("not_paraphrase,paraphrase"), metrics=("accuracy", "f1_score")),
    "mnli": CorpusSpec(
        "MNLI Multi-Genre Natural Language Inference", PAIR, "glue/MNLI",
        {"train": "train.tsv", "dev": "dev_matched.tsv"}, 10, 8, 9, header=True,
        label_map=numbered("contradiction,entailment,neutral"), metrics=("accuracy",)),
    "qnli": CorpusSpec(
        "QNLI Question-answering Natural Language Inference", PAIR, "glue/QNLI", TRAIN_DEV, 3, 1, 2, header=True,
        label_map=numbered("not_entailment,entailment"), metrics=("accuracy",)),
    "rte": CorpusSpec(
        "RTE Recognizing Textual Entailment", PAIR, "glue/RTE", TRAIN_DEV, 3, 1, 2, header=True,
        label_map=numbered("not_entailment,entailment"), metrics=("accuracy",)),
    "wnli": CorpusSpec(
        "WNLI Winograd Schema Challenge", PAIR, "glue/WNLI", TRAIN_DEV, 3, 1, 2, header=True,
        label_map=numbered("not_entailment,entailment"), metrics=("accuracy",)),
    "conll2003": CorpusSpec(
        "CONLL 4-way Named Entity Recognition", SEQUENCE, "conll2003", THREE_TXT, 3, 0, delimiter=" ",
        label_map=bio("PER ORG LOC MISC"), metrics=("f1_score",)),
    "wnut17": CorpusSpec(
        "WNUT 17 Emerging Entities task", SEQUENCE, "wnut17", THREE_TXT, 1, 0,
        label_map=bio("corporation creative-work group location person product"), metrics=("f1_score",)),
    "mit_movie": CorpusSpec(
        "MIT MOVIE Named Entity Recognition", SEQUENCE, "mit_movie", TRAIN_DEV_TXT, 0, 1,
        label_map=bio("Actor Award Character_Name Director Genre Opinion Origin Plot Quote Relationship Soundtrack Year"),
        metrics=("accuracy", "f1_score")),
    "mit_restaurant": CorpusSpec(
        "MIT RESTAURANT Named Entity Recognition", SEQUENCE, "mit_restaurant", TRAIN_DEV_TXT, 0, 1,
        label_map=bio("Amenity Cuisine Dish Hours Location Price Rating Restaurant_Name"),
        metrics=("accuracy", "f1_score")),
    "isear": CorpusSpec(
        "ISEAR Emotion Classification", SINGLE, "isear", TRAIN_DEV, 0, 1,
        label_map=numbered("joy,anger,fear,disgust,shame,guilt,sadness"), metrics=("accuracy",)),
    "trec": CorpusSpec(
        "TREC Question Classification", SINGLE, "trec", TRAIN_DEV, 0, 1,
        label_map=numbered("abbreviation,entities,descriptions,human_beings,locations,numeric_values"),
        metrics=("accuracy",)),
    "sick": CorpusSpec(
        "SICK Sentences Involving Compositional Knowledge (NLI)", PAIR, "sick", TRAIN_DEV, 0, 1, 2,
        label_map=numbered("NEUTRAL,ENTAILMENT,CONTRADICTION"), metrics=("accuracy",)),
    "clickbait": CorpusSpec(
        "CLICKBAIT Detecting Clickbaits in Online News Media", SINGLE, "clickbait", TRAIN_DEV, 0, 1,
        label_map=numbered("clickbait,non clickbait"), metrics=("accuracy",)),
    "emotion_stimulus": CorpusSpec(
        "EMOTION STIMULUS 7-way emotion classification", SINGLE, "emotion_stimulus", TRAIN_DEV, 0, 1,
        label_map=numbered("happy,sad,surprise,disgust,anger,fear,shame"), metrics=("accuracy", "f1_score")),
    "emobank": CorpusSpec(
        "EMOBANK emotions according to Valence-Arousal-Dominance scheme", SCORE, "emobank",
        {"train": "train.csv", "dev": "dev.csv", "test": "test.csv"}, 1, 0,
        metrics=("spearmanr", "pearsonr"), targets={"valence": 1, "arousal": 2, "dominance": 3}),
    "fb_valence_arousal": CorpusSpec(
        "FBVA Predicting Valence and Arousal in Facebook Posts", SCORE, "fb_valence_arousal",
        {"train": "train.csv", "dev": "dev.csv"}, 1, 0,
        metrics=("spearmanr", "pearsonr"), targets={"valence": 1, "arousal": 2}),
}

# Names of the coarse question classes.
QUESTION_CLASSES = {
    "ABBR": "abbreviation",
    "ENTY": "entities",
    "DESC": "descriptions",
    "HUM": "human_beings",
    "LOC": "locations",
    "NUM": "numeric_values",
}

# Dev rows per label (or in all) when a corpus is split on conversion.
DEV_PER_LABEL = {"isear": 180, "sick": 321, "clickbait": 2000, "emotion_stimulus": 30}
DEV_ROWS = {"fb_valence_arousal": 800}


def registry(spark: SparkSession) -> DataFrame:
    """The corpora as a table: one row per corpus, a few columns."""
    rows = [
        (k, c.name, c.task, c.label, c.text, c.pair, c.header, list(c.metrics), list((c.label_map or {}).items()))
        for k, c in CORPORA.items()
    ]
    schema = (
        "corpus string, name string, task string, label_column int, text_column int, pair_column int, "
        "header boolean, metrics array<string>, label_map array<struct<label:string,id:bigint>>"
    )
    return spark.createDataFrame(rows, schema)


def load_corpus(
    spark: SparkSession,
    corpus: str,
    base_path: str,
    *,
    label_type: str = "valence",
    evaluate_on_matched: bool = True,
    dev_label: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Sentences of a prepared corpus under `base_path`, all splits in one table.

    `label_type` picks the target of a corpus with several; `evaluate_on_matched`
    picks the dev file where there are two; `dev_label` is the label position in
    the dev file, if it differs. Rows with a problem stop the query; with
    `strict=False` they are left out.
    """
    spec = CORPORA[corpus]
    path = f"{base_path.rstrip('/')}/{spec.folder}"
    files = dict(spec.files)
    if corpus == "mnli" and not evaluate_on_matched:
        files["dev"] = "dev_mismatched.tsv"
    if spec.tagged:
        df = src.read_tagged_text(
            spark, [f"{path}/{f}" for f in files.values()], spec.label_map, spec.text, spec.label, spec.delimiter,
            with_file=True,
        )
        checked = (src.tagged_strict_rows if strict else src.tagged_good_rows)(df)
        return checked.withColumn("split", src.split_of("_file", files)).drop("_file")
    label = target_position(spec, label_type)
    read = lambda names, position: src.read_corpus_dir(
        spark, path, position, spec.text, spec.task, spec.pair, spec.header, spec.label_map, names, strict
    )
    if dev_label is None or dev_label == label:
        return read(files, label)
    others = {s: f for s, f in files.items() if s != "dev"}
    return read(others, label).unionByName(read({"dev": files["dev"]}, dev_label))


def target_position(spec: CorpusSpec, label_type: str) -> int:
    """Label position; for several targets by case-insensitive name."""
    if not spec.targets:
        return spec.label
    if label_type.lower() not in spec.targets:
        raise ValueError(f"label type {label_type!r} is not one of {tuple(spec.targets)}")
    return spec.targets[label_type.lower()]


# --- raw forms -----------------------------------------------------------
#
# Each converter reads a corpus as published and returns label_raw, text,
# [text_pair], [targets] and split, ready for write_converted.


def convert_isear(spark: SparkSession, path: str, width: int = 2, strict: bool = True) -> DataFrame:
    return _first_n("isear", src.read_quoted(spark, path, {"label_raw": 0, "text": 1}, width, index="sent_id"), strict)


def convert_questions(spark: SparkSession, train: str, dev: str) -> DataFrame:
    parts = {"train": train, "dev": dev}
    rows = [src.read_questions(spark, p, QUESTION_CLASSES).withColumn("split", F.lit(s)) for s, p in parts.items()]
    return rows[0].unionByName(rows[1])


def convert_sick(spark: SparkSession, path: str, width: int = 12, strict: bool = True) -> DataFrame:
    columns = {"label_raw": 3, "text": 1, "text_pair": 2}
    return _first_n("sick", src.read_quoted(spark, path, columns, width, sep="\t", index="sent_id"), strict)


def convert_clickbait(spark: SparkSession, clickbait: str, other: str, seed: int = 0) -> DataFrame:
    files = {"clickbait": clickbait, "non clickbait": other}
    read = lambda p: src.read_quoted(spark, p, {"text": 0}, 1, sep="\t", header=False, index="sent_id")
    rows = None
    for i, (label, p) in enumerate(files.items()):
        # Ids of the second file start in their own range, behind those of the first.
        part = read(p).withColumn("sent_id", F.col("sent_id") + (i << 50)).withColumn("label_raw", F.lit(label))
        rows = part if rows is None else rows.unionByName(part)
    return shuffle_rows(_first_n("clickbait", rows), seed)


def convert_emotion_stimulus(spark: SparkSession, path: str, seed: int = 0, strict: bool = True) -> DataFrame:
    lines = src.read_lines(spark, path)
    stripped = src.tx.strip(F.col("value"))
    rows = lines.select(
        F.col("idx").alias("sent_id"), lb.inline_tag(stripped).alias("label_raw"), lb.without_tags(stripped).alias("text")
    )
    return shuffle_rows(_first_n("emotion_stimulus", rows, strict), seed)


def convert_emobank(spark: SparkSession, path: str) -> DataFrame:
    columns = {"text": 5, "valence": 2, "arousal": 3, "dominance": 4, "part": 1}
    rows = src.read_quoted(spark, path, columns, 6)
    return sp.by_column(rows, "part", {"train": "train", "dev": "dev", "test": "test"}).drop("part")


def convert_fb_valence_arousal(spark: SparkSession, path: str, width: int = 5) -> DataFrame:
    rows = src.read_quoted(spark, path, {"text": 0, "valence": 1, "arousal": 3}, width, index="sent_id")
    clean = rows.withColumn("text", lb.without_tabs(F.col("text"))).where(F.col("text") != "")
    return sp.head_n(clean, "sent_id", DEV_ROWS["fb_valence_arousal"])


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    """Add `pos`, the place of a row in a seeded random order of all splits together."""
    return with_epoch_order(df, "sent_id", epoch=2, seed=seed)


def write_converted(df: DataFrame, path: str, corpus: str, order: str = "pos", files: int | None = None) -> None:
    """Converted rows as text files by split that keep the order of the column `order` (`sent_id` where nothing was shuffled)."""
    ordered.write_ordered_text(df, path, _columns(CORPORA[corpus]), order, files=files)


def load_converted(spark: SparkSession, path: str, corpus: str, label_type: str = "valence", strict: bool = True) -> DataFrame:
    """The rows of `write_converted` as a corpus; `sent_id` is the place of a row in the order of its split."""
    spec = CORPORA[corpus]
    lines = ordered.read_ordered_text(spark, path).withColumnRenamed("idx", "sent_id")
    parsed = src.parse_labeled(lines, target_position(spec, label_type), spec.text, spec.task, spec.pair, spec.label_map)
    return (src.strict_rows if strict else src.good_rows)(parsed)


def _columns(spec: CorpusSpec) -> list[str]:
    """Names of the columns of a converted file, from the positions that the corpus is read by."""
    names = {p: t for t, p in spec.targets.items()} if spec.targets else {spec.label: "label_raw"}
    names[spec.text] = "text"
    if spec.pair is not None:
        names[spec.pair] = "text_pair"
    return [names[p] for p in sorted(names)]


def _first_n(corpus: str, rows: DataFrame, strict: bool = True) -> DataFrame:
    """Dev and train of a corpus; a label that it doesn't know stops the query, or is left out."""
    spec = CORPORA[corpus]
    values = ["label_raw", "text"] + (["text_pair"] if spec.pair is not None else [])
    known = F.coalesce(F.col("label_raw").isin(*spec.label_map), F.lit(False))
    if strict:
        problem = F.raise_error(F.concat(F.lit(f"{corpus}: label "), F.coalesce("label_raw", F.lit("missing")), F.lit(" is not known")))
        rows = rows.withColumn("label_raw", F.when(known, F.col("label_raw")).otherwise(problem))
    else:
        rows = rows.where(known)
    return sp.head_split(rows, "label_raw", "sent_id", values, DEV_PER_LABEL[corpus], len(spec.label_map))
