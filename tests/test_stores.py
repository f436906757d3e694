"""Stores: ordered text with its manifest, models by version, pairs through a model."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import embed
from tandem.operators.order import with_epoch_order
from tandem.plans.models import Model, load_model, save_model
from tandem.plans.train import HeadSpec
from tandem.sources import ordered, registry as rg

# --- ordered text --------------------------------------------------------


def shuffled(spark, parts):
    # Split names that would be read as numbers or escaped in a folder name, and a missing one.
    names = F.array(F.lit("01"), F.lit("a b=c"), F.lit(None).cast("string"))
    df = spark.range(600, numPartitions=parts).select(
        F.col("id").alias("sent_id"), F.get(names, (F.col("id") % 3).cast("int")).alias("split"), F.concat(F.lit("text "), "id").alias("text")
    )
    return with_epoch_order(df, "sent_id", 2, seed=5)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_files_keep_the_seeded_order(spark, tmp_path, parts):
    df = shuffled(spark, parts)
    ordered.write_ordered_text(df, str(tmp_path / "c"), ["sent_id", "text"], "pos", files=parts)
    want, seen = {}, {}
    for r in df.orderBy("pos").collect():
        want.setdefault(r.split, []).append(f"{r.sent_id}\t{r.text}")
    for r in ordered.read_ordered_text(spark, str(tmp_path / "c")).orderBy("idx").collect():
        assert r.idx == len(seen.setdefault(r.split, []))
        seen[r.split].append(r.value)
    assert seen == want
    one = ordered.read_ordered_text(spark, str(tmp_path / "c"), "01")
    assert [r.value for r in one.orderBy("idx").collect()] == want["01"]


def test_reading_moves_no_row(spark, tmp_path):
    ordered.write_ordered_text(shuffled(spark, 3), str(tmp_path / "c"), ["text"], "pos", files=3)
    plan = ordered.read_ordered_text(spark, str(tmp_path / "c"))._jdf.queryExecution().executedPlan().toString()
    # The text column takes part in no exchange: only tables of files do.
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "value" in x]


@pytest.mark.parametrize("harm", ["missing", "longer", "stray"])
def test_other_files_stop_the_query(spark, tmp_path, harm):
    ordered.write_ordered_text(shuffled(spark, 3), str(tmp_path / "c"), ["text"], "pos", files=3)
    file = sorted((tmp_path / "c" / "rows" / "split=01").glob("part-*"))[0]
    if harm == "missing":
        file.unlink()
    elif harm == "longer":
        file.write_text(file.read_text() + "one more\n")
    else:
        shutil.copy(file, file.with_name(file.name.replace("part-0", "part-9")))
    for check in file.parent.glob(".*.crc"):
        check.unlink()
    with pytest.raises(Exception, match="not those of the manifest"):
        ordered.read_ordered_text(spark, str(tmp_path / "c")).collect()


def test_line_breaks_stop_the_writer_and_empty_tables_stay_empty(spark, tmp_path):
    df = spark.createDataFrame([(0, "train", "a\nb")], "pos bigint, split string, text string")
    with pytest.raises(Exception, match="line break"):
        ordered.write_ordered_text(df, str(tmp_path / "bad"), ["text"], "pos")
    assert not (tmp_path / "bad" / "manifest").exists()
    ordered.write_ordered_text(df.limit(0), str(tmp_path / "none"), ["text"], "pos")
    assert ordered.read_ordered_text(spark, str(tmp_path / "none")).collect() == []


def test_numbers_of_files_are_compared_as_numbers(spark, tmp_path):
    folder = tmp_path / "c" / "rows" / "split=train"
    folder.mkdir(parents=True)
    for number, text in (("99999", "a\n"), ("100000", "b\nc\n")):
        (folder / f"part-{number}-x.c000.txt").write_text(text)
    found = {r.name[5:11].strip("-"): r.first for r in ordered.manifest(spark, str(tmp_path / "c")).collect()}
    assert found == {"99999": 0, "100000": 1}


@pytest.mark.parametrize("files", [1, 4, 37])
def test_converted_corpora_keep_their_shuffled_order(spark, tmp_path, files):
    raw = tmp_path / "raw.txt"
    raw.write_text("".join(f"<{e}>line {i} of {e}<\\{e}>\n" for i in range(40) for e in ("happy", "sad")))
    df = rg.convert_emotion_stimulus(spark, str(raw), seed=3)
    rg.write_converted(df, str(tmp_path / "c"), "emotion_stimulus", files=files)
    sent = sorted(df.collect(), key=lambda r: r.pos)
    back = sorted(rg.load_converted(spark, str(tmp_path / "c"), "emotion_stimulus").collect(), key=lambda r: r.sent_id)
    for split, n in (("dev", 60), ("train", 20)):
        want = [(r.label_raw, r.text) for r in sent if r.split == split]
        got = [r for r in back if r.split == split]
        assert len(want) == n and [(r.label_raw, r.text) for r in got] == want
        assert [r.sent_id for r in got] == list(range(n))


def test_converted_targets_are_read_by_name(spark, rows, tmp_path):
    raw = tmp_path / "bank.csv"
    raw.write_text('id,split,V,A,D,text\n1,train,1.0,2,3,"x, y"\n2,dev,1,2.5,3,z\n')
    df = rg.convert_emobank(spark, str(raw)).withColumn("pos", F.lit(0))
    rg.write_converted(df, str(tmp_path / "c"), "emobank")
    back = rg.load_converted(spark, str(tmp_path / "c"), "emobank", "arousal")
    assert rows(back, "split", "text", "target") == [("dev", "z", 2.5), ("train", "x, y", 2.0)]


# --- models --------------------------------------------------------------


def vectors(spark, n=50):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist(), rng.normal(size=5).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "sent_id bigint, vec_1 array<double>, vec_2 array<double>")


@pytest.mark.parametrize("method", ["concat", "mean", "dme"])
@pytest.mark.parametrize("outputs", [1, 4])
def test_the_path_alone_predicts_the_same(spark, tmp_path, rows, method, outputs):
    spec = HeadSpec([3, 5], outputs, method, layer_norm=True, dropout=0.25)
    names = {f"name {i}": outputs - 1 - i for i in range(outputs)} if outputs > 1 else None
    model = Model(spec, spec.init(3), names)
    assert save_model(spark, model, str(tmp_path / "m")) == 1
    back = load_model(spark, str(tmp_path / "m"))
    assert back.spec == spec and back.labels == names
    assert {k: (a.shape, a.tolist()) for k, a in back.params.items()} == {k: (a.shape, a.tolist()) for k, a in model.params.items()}
    columns = ["sent_id", "prediction", *(["prediction_name"] if names else [])]
    assert rows(back.predict(vectors(spark)), *columns) == rows(model.predict(vectors(spark)), *columns)


def test_versions_and_broken_stores(spark, tmp_path):
    path, spec = str(tmp_path / "m"), HeadSpec([3], 2)
    first, second = (Model(spec, spec.init(seed), {"no": 0, "yes": 1}) for seed in (1, 2))
    assert [save_model(spark, m, path) for m in (first, second)] == [1, 2]
    assert (load_model(spark, path).params["dec_w"] == second.params["dec_w"]).all()
    assert (load_model(spark, path, 1).params["dec_w"] == first.params["dec_w"]).all()
    with pytest.raises(ValueError, match="no model"):
        load_model(spark, path, 3)
    with pytest.raises(ValueError, match="each once"):
        save_model(spark, Model(spec, spec.init(), {"no": 0, "maybe": 0}), path)
    newest = [d for d in (tmp_path / "m").glob("params-*") if np.allclose(
        spark.read.parquet(str(d)).where("param = 'dec_b'").orderBy("i").toPandas().value, second.params["dec_b"])][0]
    short = spark.createDataFrame([("dec_b", 0, 0, 1.0)], "param string, i int, j int, value double")
    short.write.mode("append").parquet(str(newest))
    with pytest.raises(ValueError, match="do not fill"):
        load_model(spark, path)


# --- pairs ---------------------------------------------------------------


def test_pairs_reach_the_model_in_order(spark):
    def make():
        def predict(first, second):
            return np.array([[len(a), -1.0 if b is None else len(b)] for a, b in zip(first, second)], dtype=np.float32)

        return predict

    data = [(0, "abc", "d"), (1, None, "xy"), (2, "a", None), (3, "", ""), (4, None, None)]
    df = spark.createDataFrame(data, "id int, a string, b string").repartition(3)
    out = df.select("id", embed.batch_infer_pairs(F.col("a"), F.col("b"), make, batch_size=2).alias("v")).collect()
    assert {r.id: r.v for r in out} == {0: [3, 1], 1: [0, 2], 2: [1, -1], 3: [0, 0], 4: [0, -1]}
