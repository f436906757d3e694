import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import labels as lb
from tandem.sources import registry as rg, sink, text as src

MAP = {"no": 0, "yes": 1}


def parsed(spark, lines, task="Sentence classification", label_map=MAP, pair=None):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "sent_id bigint, value string")
    return src.parse_labeled(df, 0, 1, task, pair, label_map)


def test_edge_lines(spark, rows):
    lines = ["yes\tgood", "no\t ", "1\t\"a\" b", "yes", "", "\tonly text", "yes\t\xa0x\xa0y\xa0", "yes\tt\t", "yes\t\tz"]
    p = parsed(spark, lines)
    # ' ' is stripped away with the tab before it, an empty first column shifts the row.
    assert rows(src.good_rows(p), "sent_id", "label", "text") == [(0, 1, "good"), (2, 1, '"a" b'), (6, 1, "\xa0x\xa0y"), (7, 1, "t")]
    assert [r[0] for r in rows(src.bad_rows(p), "sent_id")] == [1, 3, 4, 5]


@pytest.mark.parametrize(
    "raw,label,target",
    [("1", 1, 1.0), ("1.0", None, 1.0), ("nan", None, float("nan")), ("1_0", 10, 10.0), ("1d", None, None), ("1__0", None, None),
     ("yes", 1, 1.0), ("other", None, None), ("-3", -3, -3.0), ("1e3", None, 1000.0), (".5", None, 0.5), ("5.", None, 5.0), ("Infinity", None, float("inf"))],
)
def test_label_spellings(spark, raw, label, target):
    df = spark.createDataFrame([(raw,)], "r string").select(lb.encode(F.col("r"), MAP), lb.encode_target(F.col("r"), MAP))
    a, b = df.first()
    assert a == label
    assert b == target or (target is not None and np.isnan(target) and np.isnan(b))


def test_a_number_never_goes_through_the_map(spark):
    df = spark.createDataFrame([("1",)], "r string").select(lb.encode(F.col("r"), {"1": 7}))
    assert df.first()[0] == 1


def test_strict_stops(spark):
    with pytest.raises(Exception, match="label not understood"):
        src.strict_rows(parsed(spark, ["what\tx"])).collect()


def test_pairs_survive_when_both_parts_are_empty(spark, rows):
    df = spark.createDataFrame([("", ""), ("", None), (None, None), (" ", None), ("a", "b")], "a string, b string")
    assert df.where(lb.nonempty(F.col("a"), F.col("b"))).count() == 3


def test_three_texts_are_an_error(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>").select(lb.texts_type(F.col("t")))
    with pytest.raises(Exception, match="pair of texts"):
        df.collect()


def test_header_is_skipped_in_each_file_and_order_kept(spark, rows, tmp_path):
    for name, start in (("a.tsv", 0), ("b.tsv", 10)):
        (tmp_path / name).write_text("label\ttext\n" + "".join(f"{i % 2}\tt{start + i}\n" for i in range(5)))
    df = src.read_labeled_text(spark, str(tmp_path), 0, 1, "Sentence classification")
    got = [r[1] for r in rows(df, "sent_id", "text")]
    assert got == [f"t{i}" for i in list(range(5)) + list(range(10, 15))]


def test_corpus_dir_reads_the_test_file_itself(spark, rows, tmp_path):
    for split in ("train", "dev", "test"):
        (tmp_path / f"{split}.csv").write_text(f"text\tlabel\nfrom {split}\tyes\n")
    df = src.read_corpus_dir(spark, str(tmp_path), 1, 0, label_map=MAP)
    assert rows(df, "split", "text") == [(s, f"from {s}") for s in ("dev", "test", "train")]


def test_corpus_dir_without_test_and_without_dev(spark, tmp_path):
    (tmp_path / "train.csv").write_text("h\n0\ta\n")
    with pytest.raises(FileNotFoundError):
        src.read_corpus_dir(spark, str(tmp_path), 0, 1)
    (tmp_path / "dev.csv").write_text("h\n0\tb\n")
    assert src.read_corpus_dir(spark, str(tmp_path), 0, 1).count() == 2


TAGGED = "-DOCSTART- -X- -X- O\n\nEU N X B-ORG\nrejects V X O\n\n\nGerman J X B-MISC,O\n \ncall N X O\nBlackburn N X B-PER"
TAGGED_WANT = [(["-DOCSTART-"], [0]), (["EU", "rejects"], [3, 0]), (["German"], [7]), (["call", "Blackburn"], [0, 1])]


def read_in_splits(spark, path, size, **options):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = src.read_tagged_text(spark, str(path), rg.CORPORA["conll2003"].label_map, **options)
        return [(r.words, r.tags) for r in df.orderBy("sent_id").collect()]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", list(range(1, 24)) + [1 << 20])
def test_tagged_sentences_cross_file_splits(spark, tmp_path, size):
    # Single blank lines only: any split is fine.
    text = TAGGED.replace("\n\n\n", "\n\n")
    (tmp_path / "a.txt").write_text(text)
    assert read_in_splits(spark, tmp_path, size) == TAGGED_WANT


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 11, 23, 1 << 20])
def test_runs_of_blank_lines_are_right_or_refused(spark, tmp_path, size):
    (tmp_path / "a.txt").write_text(TAGGED)
    try:
        assert read_in_splits(spark, tmp_path, size) == TAGGED_WANT
    except Exception as e:
        assert "regroup=True" in str(e) and size < 1 << 20


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_regrouped_sentences_are_right_for_every_split(spark, tmp_path, size):
    (tmp_path / "a.txt").write_text(TAGGED)
    (tmp_path / "b.txt").write_text(TAGGED)
    assert read_in_splits(spark, tmp_path, size, regroup=True) == TAGGED_WANT * 2


def test_tagged_variants(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(TAGGED.replace("\n", "\r\n").encode())
    label_map = rg.CORPORA["conll2003"].label_map
    for newline in ("\n", "\r\n"):
        df = src.read_tagged_text(spark, str(tmp_path), label_map, newline=newline)
        assert [(r.words, r.tags) for r in df.orderBy("sent_id").collect()] == TAGGED_WANT
    assert src.read_tagged_text(spark, str(tmp_path), label_map, skip_docstart=True).count() == 3
    (tmp_path / "a.txt").write_text("O\tthe\nB-Actor\tman\n\nB-What\tx\n\nO\n")
    df = src.read_tagged_text(spark, str(tmp_path), rg.CORPORA["mit_movie"].label_map, 1, 0, "\t")
    assert [r.words for r in src.tagged_good_rows(df).collect()] == [["the", "man"]]
    assert src.tagged_bad_rows(df).count() == 2
    words = src.explode_tagged(src.tagged_good_rows(df)).orderBy("word_pos").collect()
    assert [(r.word_pos, r.word, r.tag, r.tag_id) for r in words] == [(0, "the", "O", 0), (1, "man", "B-Actor", 1)]


def test_quoted_and_latin1_and_gzip(spark, rows, tmp_path):
    (tmp_path / "q.csv").write_text('label,text\njoy,"a, ""b""\nc"\nfear,plain\n,\n')
    df = src.read_quoted(spark, str(tmp_path / "q.csv"), {"label_raw": 0, "text": 1}, 2)
    assert rows(df) == [("fear", "plain"), ("joy", 'a, "b"\nc')]
    (tmp_path / "t.label").write_bytes("HUM:ind Qui était né ?\nNUM:x Combien\n".encode("latin-1"))
    df = src.read_questions(spark, str(tmp_path / "t.label"), rg.QUESTION_CLASSES)
    assert rows(df) == [("human_beings", "Qui était né ?"), ("numeric_values", "Combien")]
    for name, lines in (("x.gz", "one\n\ntwo\n"), ("y.gz", "three\n")):
        (tmp_path / name).write_bytes(gzip.compress(lines.encode()))
    df = rg.convert_clickbait(spark, str(tmp_path / "x.gz"), str(tmp_path / "y.gz"))
    assert rows(df, "label_raw", "text", "split") == [("clickbait", "one", "dev"), ("clickbait", "two", "dev"), ("non clickbait", "three", "dev")]


def test_converters(spark, rows, tmp_path):
    f = tmp_path / "e.txt"
    f.write_text("<happy>so good<\\happy>\n<sad>so <b>bad<\\sad>\n" + "".join(f"<happy>h{i}<\\happy>\n" for i in range(40)))
    df = rg.convert_emotion_stimulus(spark, str(f))
    assert df.where("split = 'dev' and label_raw = 'happy'").count() == 30
    assert rows(df.where("label_raw = 'sad'"), "text") == [("so bad",)]
    f = tmp_path / "bank.csv"
    f.write_text('id,split,V,A,D,text\n1,train,1.0,2,3,"x, y"\n2,dev,1,2,3,z\n3,test,4,5,6,t\n4,other,1,1,1,no\n')
    assert rows(rg.convert_emobank(spark, str(f)), "split", "text", "arousal") == [("dev", "z", "2"), ("test", "t", "5"), ("train", "x, y", "2")]
    f = tmp_path / "fb.csv"
    f.write_text("text,v,_,a,_\n" + "".join(f"t\t{i},{i},0,{i},0\n" for i in range(805)) + "\t,1,0,1,0\n")
    df = rg.convert_fb_valence_arousal(spark, str(f))
    assert rows(df.groupBy("split").count()) == [("dev", 800), ("train", 5)]
    f = tmp_path / "sick.txt"
    f.write_text("id\ta\tb\tlabel\n" + "".join(f"{i}\ta{i}\tb{i}\tNEUTRAL\n" for i in range(400)))
    df = rg.convert_sick(spark, str(f), width=4)
    assert rows(df.groupBy("split").count()) == [("dev", 321), ("train", 79)]


def test_load_corpus_and_targets(spark, rows, tmp_path):
    folder = tmp_path / "emobank"
    folder.mkdir()
    for s in ("train", "dev", "test"):
        (folder / f"{s}.csv").write_text(f"{s} text\t1.5\t2.5\t3.5\n")
    df = rg.load_corpus(spark, "emobank", str(tmp_path), label_type="Arousal")
    assert rows(df, "split", "target") == [("dev", 2.5), ("test", 2.5), ("train", 2.5)]
    with pytest.raises(ValueError):
        rg.load_corpus(spark, "emobank", str(tmp_path), label_type="mood")
    folder = tmp_path / "wnut17"
    folder.mkdir()
    for s in ("train", "dev", "test"):
        (folder / f"{s}.txt").write_text("a\tB-person\nb\tO\n\n")
    assert rows(rg.load_corpus(spark, "wnut17", str(tmp_path)), "split", "tags") == [(s, [9, 0]) for s in ("dev", "test", "train")]


def test_registry_is_complete(spark):
    assert len(rg.CORPORA) == 20
    sizes = {k: len(c.label_map) for k, c in rg.CORPORA.items() if c.label_map}
    assert (sizes["conll2003"], sizes["wnut17"], sizes["mit_movie"], sizes["mit_restaurant"]) == (9, 13, 25, 17)
    assert rg.CORPORA["cola"].main_metric == "matthews_corr"
    assert rg.registry(spark).count() == 20


def test_params_round_trip(spark, tmp_path):
    params = {"w": np.arange(6.0).reshape(2, 3), "b": np.array([1.0, 2.0])}
    sink.save_params(spark, params, str(tmp_path / "p"))
    back = sink.load_params(spark, str(tmp_path / "p"), {"w": (2, 3), "b": (2,)})
    assert all((back[k] == params[k]).all() for k in params)


def test_readers_stop_at_a_bad_row_unless_told_to_leave_it_out(spark, tmp_path):
    path = tmp_path / "one.tsv"
    path.write_text("yes\tgood\nwhat\tbad\n")
    with pytest.raises(Exception, match="label not understood"):
        src.read_labeled_text(spark, str(path), 0, 1, "Sentence classification", skip_header=False, label_map=MAP).collect()
    kept = src.read_labeled_text(spark, str(path), 0, 1, "Sentence classification", skip_header=False, label_map=MAP, strict=False)
    assert [r.text for r in kept.collect()] == ["good"]


def test_an_unknown_tag_stops_the_strict_form(spark, tmp_path):
    path = tmp_path / "tags.txt"
    path.write_text("a X Y O\n\nb X Y B-NEW\n")
    df = src.read_tagged_text(spark, str(path), {"O": 0})
    with pytest.raises(Exception, match="unknown tag in sentence"):
        src.tagged_strict_rows(df).collect()
    assert src.tagged_good_rows(df).count() == 1


def test_split_is_read_from_the_file_or_its_folder(spark):
    files = {"train": "train.csv", "dev": "dev.csv"}
    paths = ["/train.csv/x/dev.csv", "/a/train.csv/part-0", "/a/old-train.csv", "/a/train.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", src.split_of("p", files).alias("s"))
    assert {r.p: r.s for r in df.collect()} == dict(zip(paths, ["dev", "train", None, "train"]))


def test_existence_is_asked_of_the_file_system(spark, tmp_path):
    assert src.exists(spark, str(tmp_path)) and not src.exists(spark, str(tmp_path / "none"))
