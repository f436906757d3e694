"""Readers for labelled text. Every reader returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.arrays import explode_once, label_literal, lookup
from ..operators import labels as lb
from ..operators.order import with_file_index, with_prefix_sum

PIECES = 1 << 20
LINES_PER_CHUNK = 1 << 18

def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines with `idx` (number over all files), `line_no` (number in the file) and `_file`."""
    return with_file_index(spark.read.text(paths), "idx", "line_no")


def parse_labeled(
    lines: DataFrame,
    label_column: int,
    sentence_column: int,
    task: str,
    sentence_pair_column: int | None = None,
    label_map: Mapping[str, int] | None = None,
    value: str = "value",
) -> DataFrame:
    """Canonical sentence columns plus `problem` from tab-separated lines, columns by position.

    Quotes are ordinary characters. The whole line is stripped before it is
    split, so a trailing empty column is lost and such a row is a problem row.
    """
    parts = F.split(tx.strip(F.col(value)), "\t")
    keep = [c for c in lines.columns if c != value]
    rows = lines.select(*keep, parts.alias("_parts"))
    raw = F.get("_parts", F.lit(label_column))
    text = F.get("_parts", F.lit(sentence_column))
    pair = F.lit(None).cast("string") if sentence_pair_column is None else F.get("_parts", F.lit(sentence_pair_column))
    needed = max(label_column, sentence_column, sentence_pair_column or 0)
    regression = "regression" in task
    label = F.lit(None).cast("bigint") if regression else lb.encode(raw, label_map)
    target = lb.encode_target(raw, label_map) if regression else F.lit(None).cast("double")
    value_of = target if regression else label
    problem = F.when(F.size("_parts") <= needed, "too few columns").when(value_of.isNull(), "label not understood")
    return rows.select(
        *keep,
        text.alias("text"),
        pair.alias("text_pair"),
        raw.alias("label_raw"),
        label.alias("label"),
        target.alias("target"),
        F.lit(None).cast("array<bigint>").alias("tags"),
        lb.sentence_type(pair).alias("sentence_type"),
        problem.alias("problem"),
    )


def good_rows(parsed: DataFrame) -> DataFrame:
    """Rows without a problem whose text is not empty."""
    pair = F.col("text_pair")
    return parsed.where(F.col("problem").isNull() & lb.nonempty(F.col("text"), pair)).drop("problem")


def bad_rows(parsed: DataFrame) -> DataFrame:
    """Rows set aside, with the reason."""
    return parsed.where(F.col("problem").isNotNull())


def strict_rows(parsed: DataFrame) -> DataFrame:
    """Like `good_rows`, but a problem row stops the query."""
    checked = F.when(F.col("problem").isNull(), F.col("label_raw")).otherwise(F.raise_error(F.col("problem")))
    return good_rows(parsed.withColumn("label_raw", checked).withColumn("problem", F.lit(None).cast("string")))


def read_labeled_text(
    spark: SparkSession,
    paths: str | Sequence[str],
    label_column: int,
    sentence_column: int,
    task: str,
    sentence_pair_column: int | None = None,
    skip_header: bool = True,
    label_map: Mapping[str, int] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Tab-separated labelled text as canonical sentence rows; `sent_id` follows the file order.

    A row with a problem stops the query; with `strict=False` it is left out
    (`bad_rows(parse_lines(...))` gives those rows with their reason).
    """
    parsed = parse_lines(
        spark, paths, label_column, sentence_column, task, sentence_pair_column, skip_header, label_map
    )
    return (strict_rows if strict else good_rows)(parsed).drop("_file")


def parse_lines(
    spark, paths, label_column, sentence_column, task, sentence_pair_column=None, skip_header=True, label_map=None
) -> DataFrame:
    lines = read_lines(spark, paths)
    if skip_header:
        lines = lines.where(F.col("line_no") > 0)
    lines = lines.withColumnRenamed("idx", "sent_id").drop("line_no")
    return parse_labeled(lines, label_column, sentence_column, task, sentence_pair_column, label_map)


def read_corpus_dir(
    spark: SparkSession,
    path: str,
    label_column: int,
    sentence_column: int,
    task: str = "Sentence classification",
    sentence_pair_column: int | None = None,
    skip_header: bool = True,
    label_map: Mapping[str, int] | None = None,
    files: Mapping[str, str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """All splits of a corpus folder in one plan, with `split` taken from the file.

    `files` maps split -> file name; the default is train.csv, dev.csv and, if
    it is there, test.csv. `strict` as in `read_labeled_text`.
    """
    files = dict(files or {"train": "train.csv", "dev": "dev.csv", "test": "test.csv"})
    base = path.rstrip("/")
    for split in ("train", "dev"):
        if split in files and not exists(spark, f"{base}/{files[split]}"):
            raise FileNotFoundError(f"{base}/{files[split]}")
    if "test" in files and not exists(spark, f"{base}/{files['test']}"):
        del files["test"]
    parsed = parse_lines(
        spark,
        [f"{base}/{name}" for name in files.values()],
        label_column,
        sentence_column,
        task,
        sentence_pair_column,
        skip_header,
        label_map,
    )
    parsed = parsed.withColumn("split", split_of("_file", files)).drop("_file")
    return (strict_rows if strict else good_rows)(parsed)


def split_of(path: str, files: Mapping[str, str]) -> Column:
    """Split whose name is that of the file, or of the folder it lies in."""
    parts = F.split(path, "/")
    file, folder = F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
    result = F.lit(None).cast("string")
    for split, name in files.items():
        last = name.split("/")[-1]
        result = F.when((file == last) | (folder == last), split).otherwise(result)
    return result


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_tagged_text(
    spark: SparkSession,
    paths: str | Sequence[str],
    label_map: Mapping[str, int],
    word_position: int = 0,
    label_position: int = 3,
    delimiter: str = " ",
    skip_docstart: bool = False,
    newline: str = "\n",
    with_file: bool = False,
    regroup: bool = False,
) -> DataFrame:
    """One row per sentence from word-per-line text: words, tag names, tag ids and joined text.

    The reader's record separator is the blank line, so one record is a sentence
    and sentences may cross file splits: no line is shuffled to be regrouped.
    Longer runs of blank lines, and lines of white space, are cut inside the
    record. For files with another line end pass `newline`.

    Where a file split falls into a run of three or more line ends, the file
    reader may hand out a record twice. That is noticed by size and stops the
    query; `regroup=True` then reads line by line and gathers the lines of each
    sentence by shuffles, which is right for every input.
    """
    if regroup:
        blocks = _regrouped(spark, paths)
    else:
        records = spark.read.option("lineSep", newline * 2).text(paths)
        size = F.octet_length("value") + 2 * len(newline)
        blocks = with_file_index(records, "_block_no", record_bytes=size, separator=2 * len(newline))
    blank = rf"\r?\n{tx.SPACE_CLASS}*\r?\n|^{tx.SPACE_CLASS}*\r?\n"
    mapping = label_literal(label_map)
    # A single plain character splits without a regular expression.
    pattern = delimiter if len(delimiter) == 1 and delimiter not in ".$|()[{^?*+\\" else rf"\Q{delimiter}\E"
    field = lambda line, at: F.nullif(F.get(F.split(line, pattern), F.lit(at)), F.lit(""))
    # Stripping every line at once: white space around each line break goes.
    to_lines = lambda piece: F.split(
        F.regexp_replace(tx.strip(piece), rf"{tx.SPACE_CLASS}*\n{tx.SPACE_CLASS}*", "\n"), "\n"
    )
    parse = lambda lines: F.struct(
        F.transform(lines, lambda x: field(x, word_position)).alias("words"),
        F.transform(lines, lambda x: lb.first_annotation(field(x, label_position))).alias("tag_names"),
    )
    with_ids = lambda s: F.struct(
        s["words"].alias("words"),
        s["tag_names"].alias("tag_names"),
        F.transform(s["tag_names"], lambda t: lookup(mapping, t)).alias("tags"),
    )
    # Parsed inside the generator, so that later filters do not parse again.
    pieces = F.filter(F.transform(F.split("value", blank), tx.strip), lambda p: p != "")
    parsed = F.transform(F.transform(F.transform(pieces, to_lines), parse), with_ids)
    sentences = explode_once(blocks, ["_file", "_block_no"], parsed, "_piece", "_s")
    # Pieces keep their order inside the record; one record is one sentence unless its
    # blank lines differ from the record separator.
    sent_id = F.when(F.col("_piece") < PIECES, F.col("_block_no") * PIECES + F.col("_piece")).otherwise(
        F.raise_error(F.lit("records do not end where expected; pass the file's newline")).cast("bigint")
    )
    out = sentences.select("_file", sent_id.alias("sent_id"), "_s.words", "_s.tag_names", "_s.tags")
    if skip_docstart:
        out = out.where(~((F.size("words") == 1) & (F.get("words", F.lit(0)) == "-DOCSTART-")))
    out = out.select(
        "*", lb.join_words(F.col("words")).alias("text"), F.lit("single-sentence").alias("sentence_type")
    )
    return out if with_file else out.drop("_file")


def _regrouped(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Sentences as blocks of lines: a sentence is numbered by the blank lines before it."""
    lines = read_lines(spark, paths)
    first = F.when(F.col("line_no") == 0, 1).otherwise(0)
    blank = F.when(tx.strip(F.col("value")) == "", 1).otherwise(0)
    # A new file starts a new sentence, too; both counts grow with the line number.
    marked = lines.withColumn("_chunk", F.floor(F.col("idx") / LINES_PER_CHUNK)).withColumn("_new", first + blank)
    counted = with_prefix_sum(marked, ["_chunk"], ["idx"], F.col("_new").cast("bigint"), "_earlier", None)
    numbered = counted.select("_file", "idx", "value", (F.col("_earlier") + F.col("_new")).alias("_block_no"), blank.alias("_blank"))
    gathered = numbered.where(F.col("_blank") == 0).groupBy("_file", "_block_no").agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_lines")
    )
    return gathered.select("_file", "_block_no", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value"))


def tagged_good_rows(sentences: DataFrame) -> DataFrame:
    """Sentences whose words are all there and whose tags are all in the label map."""
    return sentences.where(~_tag_problem())


def tagged_strict_rows(sentences: DataFrame) -> DataFrame:
    """All sentences; one with a word that is missing or a tag outside the label map stops the query."""
    problem = F.raise_error(F.concat(F.lit("missing word or unknown tag in sentence "), F.col("sent_id").cast("string")))
    return sentences.withColumn("words", F.when(_tag_problem(), problem).otherwise(F.col("words")))


def tagged_bad_rows(sentences: DataFrame) -> DataFrame:
    return sentences.where(_tag_problem())


def _tag_problem() -> Column:
    return F.exists("tags", lambda t: t.isNull()) | F.exists("words", lambda w: w.isNull())


def explode_tagged(sentences: DataFrame) -> DataFrame:
    """Canonical tagged rows: one per word."""
    zipped = F.arrays_zip(F.col("words").alias("word"), F.col("tag_names").alias("tag"), F.col("tags").alias("tag_id"))
    return explode_once(sentences, ["sent_id"], zipped, "word_pos", "_x").select(
        "sent_id", "word_pos", "_x.word", "_x.tag", "_x.tag_id"
    )


def read_quoted(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Mapping[str, int],
    width: int,
    sep: str = ",",
    header: bool = True,
    multi_line: bool = True,
    skip_empty: bool = True,
    index: str | None = None,
) -> DataFrame:
    """Quoted CSV or TSV, columns chosen by position (`columns`: name -> position).

    Only the chosen columns are parsed; `index` adds the row number in file order.
    `multi_line` allows line breaks inside quotes but keeps each file in one
    task; switch it off for large flat files.
    """
    df = spark.read.csv(
        paths,
        schema=", ".join(f"c{i} string" for i in range(width)),
        sep=sep,
        header=header,
        quote='"',
        escape='"',
        multiLine=multi_line,
        enforceSchema=True,
        emptyValue="",
    )
    if skip_empty:
        df = df.where(F.concat_ws("", *[F.col(f"c{i}") for i in columns.values()]) != "")
    chosen = [F.coalesce(F.col(f"c{i}"), F.lit("")).alias(name) for name, i in columns.items()]
    if index is None:
        return df.select(*chosen)
    return with_file_index(df, index).select(index, *chosen)


def read_encoded_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines of a file in a one-byte encoding, as column `value`; blank lines are left out.

    The text reader knows UTF-8 only; the CSV reader decodes, splits large files,
    and with a separator that is never used gives the whole line back.
    """
    return spark.read.csv(
        paths, schema="value string", sep="\x01\x02\x03", quote="", encoding=encoding, header=False, enforceSchema=True
    )


def read_questions(spark: SparkSession, paths: str | Sequence[str], rename: Mapping[str, str]) -> DataFrame:
    """`COARSE:fine word word …` lines: label_raw (renamed coarse class) and text."""
    lines = read_encoded_lines(spark, paths)
    names = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])
    return lines.select(
        lookup(names, lb.coarse_label(F.col("value"))).alias("label_raw"),
        lb.after_first_token(F.col("value")).alias("text"),
    )
