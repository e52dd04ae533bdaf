import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vozmark import infer
from vozmark.dsp import kernels
from vozmark.infer import FakeRecognizer
from vozmark.pipeline import FeaturePipeline
from vozmark.operators import evaluate as E
from vozmark.operators import selection
from vozmark.sources import audio, corpora, tables
from vozmark.streaming import ingest


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_features_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(0)
    for speaker in ("ana", "rui"):
        (tmp_path / "wav" / speaker).mkdir(parents=True)
        for k in range(2):
            x = rng.normal(0, 0.1, 16000) * (1 + np.sin(np.arange(16000) / 900))
            (tmp_path / "wav" / speaker / f"{speaker}{k}.wav").write_bytes(audio.encode_wav(x))
    (tmp_path / "wav" / "ana" / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "vocab.txt").write_text("<blk> 0\ns 1\na 2\nt 3\ni 4\n")
    rows = audio.read_utterances(spark, str(tmp_path / "wav"))
    assert rows.where("error is not null").count() == 1
    rows = rows.where("error is null")
    pipe = FeaturePipeline(FakeRecognizer(), tables.read_vocabulary(spark, str(tmp_path / "vocab.txt")))
    got = pipe.extract(rows)
    keys = got.groupBy("speaker", "feature").count().collect()
    assert all(r["count"] == 1 for r in keys) and {r["feature"] for r in keys} >= {"mfcc", "soft", "logits"}
    paths = tables.write_npz(got.where("feature = 'mfcc'"), str(tmp_path / "npz"))
    data = np.load(paths[0])
    assert data["vector"].shape == (2, 13) and sorted(data["speaker"]) == ["ana", "rui"]


def test_archive_source(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name in ("x/1.wav", "x/1.txt", "x/2.wav"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    spark.dataSource.register(audio.ArchiveSource)
    got = spark.read.format("archive").option("suffix", ".wav").load(str(tmp_path / "a.tar.gz")).collect()
    assert [(r["seq"], r["name"], r["size"]) for r in got] == [(0, "x/1.wav", 3), (2, "x/2.wav", 3)]


def test_resample_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(48000) / 48000)
    y = audio.resample(x, 48000)
    assert len(y) == 16000
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(y[200:-200] - want[200:-200]).max() < 0.02


def test_stream_keeps_the_latest(spark, tmp_path):
    rows = [(1, "a", 1.0, "2024-01-01 00:00:00"), (1, "a", 2.0, "2024-01-02 00:00:00"), (2, "b", 3.0, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k int, kind string, v double, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), "k int, kind string, v double, at timestamp")
    ingest.run_once(ingest.latest_labels(stream, "k", "kind", "v", "at"), "latest", "complete", str(tmp_path / "cp"))
    assert {(r["k"], r["v"]) for r in spark.table("latest").collect()} == {(1, 2.0), (2, 3.0)}



def test_archive_members_choices_and_quotas(spark):
    names = ["c/Ana_F001/F001-0001.wav", "c/Ana_F001/F001-0002.wav", "c/Ana_F001/F001-0002.txt", "c/Rui_M002/M002-0001.wav", "c/x.wav"]
    rows = corpora.members(spark.createDataFrame(list(enumerate(names)), "seq long, name string"))
    got = corpora.choose_members(rows, speakers={"Ana"}, genders={"F"}, sentences={2}, texts=False)
    assert [r["name"] for r in got.collect()] == [names[1]]
    got = corpora.quota(rows, "seq", 1, 1, False).collect()
    assert sorted(r["name"] for r in got) == [names[0], names[2]]


def test_specs_of_users(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1-3\n7")
    assert corpora.parse_sentence_spec("all") is None and corpora.parse_sentence_spec("1-2, 5") == {0, 1, 4}
    assert corpora.parse_sentence_spec(f"@{tmp_path}/s.txt") == {0, 1, 2, 6}
    sentences = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "b")], "sentence_id long, text string")
    assert corpora.parse_sentence_spec("balanced:1", sentences) == {1}
    assert corpora.parse_speakers("a, b c") == {"a", "b", "c"} and corpora.parse_speakers(None) is None
    code = "a" * 22
    assert corpora.parse_episodes(f"x {code},y") == {code} and corpora.parse_episodes("") is None
    with pytest.raises(ValueError):
        corpora.parse_episodes("none here")
    with pytest.raises(ValueError):
        selection.allowed(spark.createDataFrame([("a",)], "name string"), "name", ["a", "z"])


def test_corpus_files_and_sinks(spark, tmp_path):
    rows = [("a/2.wav", "ana", "F", 2, b"xx"), ("a/1.wav", "ana", "F", 9, b"y"), ("r/1.wav", "rui", "M", 1, b"zzz")]
    df = spark.createDataFrame(rows, "filename string, speaker string, gender string, sentence_id long, content binary")
    sentences = spark.createDataFrame([(1, "um"), (2, 'dois, "x"')], "sentence_id long, text string")
    corpora.write_metadata(df, sentences, str(tmp_path / "meta"))
    got = spark.read.csv(str(tmp_path / "meta"), header=True, escape='"').collect()
    assert [(r["filename"], r["text"]) for r in got] == [("a/1.wav", None), ("a/2.wav", 'dois, "x"'), ("r/1.wav", "um")]
    files = df.withColumn("file", F.substring_index("filename", "/", -1)).withColumn("state", F.lit(" SP/x "))
    done = {r["folder"]: tuple(r)[1:] for r in corpora.write_tree(files, f"file://{tmp_path}/tree").collect()}
    assert done == {"ana": (2, 2, 3), "rui": (1, 1, 3)} and (tmp_path / "tree/ana/2.wav").read_bytes() == b"xx"
    again = {r["folder"]: r["written"] for r in corpora.write_tree(files, f"file://{tmp_path}/tree").collect()}
    assert again == {"ana": 0, "rui": 0}
    listed = corpora.list_files(spark, str(tmp_path / "tree"), "ana", ".wav")
    assert tuple(corpora.tree_summary(listed).first()) == (1, 2, 3)
    dropped = corpora.write_class_tree(files.where("speaker = 'rui'"), "state", f"file://{tmp_path}/classes", 1)
    assert dropped.count() == 0 and (tmp_path / "classes/SP_x/1.wav").exists()
    waves = spark.createDataFrame([("ana", "w.wav", [0.0, 0.5])], "speaker string, file string, samples array<float>")
    corpora.write_wavs(waves, f"file://{tmp_path}/waves").collect()
    assert len(audio.decode_wav((tmp_path / "waves/ana/w.wav").read_bytes())) == 2
    text = "path\tclient_id\nx.mp3\tk1\n".encode()
    with tarfile.open(tmp_path / "cv.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("cv/pt/train.tsv")
        info.size = len(text)
        tar.addfile(info, io.BytesIO(text))
    index, archives = corpora.local_inputs(spark, str(tmp_path / "cv.tar.gz"), "train")
    assert [tuple(r) for r in index.collect()] == [(0, "x.mp3", "k1")] and len(archives) == 1
    with pytest.raises(FileNotFoundError):
        corpora.local_inputs(spark, str(tmp_path / "cv.tar.gz"), "test")
    (tmp_path / "m/auto").mkdir(parents=True)
    (tmp_path / "m/auto/audios_dev_metadata.csv").write_text("file,text\na.wav,um\n")
    meta, missing = corpora.split_metadata(spark, str(tmp_path / "m"), ["auto"], ["dev", "test"])
    assert [tuple(r) for r in meta.collect()] == [("auto", "dev", "a.wav", "um")] and len(missing) == 1
    listing = '[{"tag_name":"v2","assets":[{"name":"a.txt"}]},{"tag_name":"v1","assets":[{"name":"a.zip","browser_download_url":"u","size":5}]}]'
    one = spark.createDataFrame([(listing,)], "value string")
    assert tuple(corpora.latest_asset(one).first()) == ("v1", "u", 5)
    assert corpora.latest_asset(one, tag="v2").count() == 0


def test_annotations_from_files(spark, tmp_path):
    import sqlite3

    (tmp_path / "a.csv").write_text(
        "dataset,speaker,annotator,source,s_coda,r_coda,dt_palat,gold,notes,updated_at\n"
        'd1,a,ann1,,sibilant,,mixed,1,"x, ""y""",2024-01-01 10:00:00\n'
    )
    row = tables.read_annotations(spark, str(tmp_path / "a.csv")).first()
    assert (row["source"], row["s_coda"], row["notes"], row["gold"]) == ("human", "sibilant", 'x, "y"', 1)
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE annotations (dataset, speaker, annotator, s_coda, r_coda, dt_palat, gold, notes, updated_at)")
        db.execute("INSERT INTO annotations VALUES ('d1', ' b ', 'auto', NULL, 'tap', '', 0, NULL, '2024-01-02 10:00:00')")
    row = tables.load_annotations(spark, str(tmp_path / "a.db")).first()
    assert (row["speaker"], row["source"], row["s_coda"], row["r_coda"]) == ("b", "auto", "", "tap")
    with pytest.raises(FileNotFoundError):
        tables.load_annotations(spark, str(tmp_path / "none.db"))
    assert tables.load_annotations(spark, None, str(tmp_path / "a.csv"), default_db=str(tmp_path / "none.db")).count() == 1
    tables.write_annotations(tables.read_annotations(spark, str(tmp_path / "a.csv")).withColumn("extra", F.lit(1)), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == tables.ANNOTATION_COLUMNS
    (tmp_path / "m.json").write_text('{"ana": ["1.wav", "2.wav"], "rui": []}')
    got = tables.read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert [tuple(r) for r in got] == [("ana", 0, "1.wav"), ("ana", 1, "2.wav")]
    (tmp_path / "s.txt").write_bytes("olá\n\nnão\n".encode("latin-1"))
    assert [tuple(r) for r in tables.read_sentences(spark, str(tmp_path / "s.txt")).collect()] == [(1, "olá"), (2, "não")]
    (tmp_path / "t.tsv").write_text("path\tclient_id\na\t" + "k" * 5000 + "\n")
    assert len(tables.read_tsv(spark, str(tmp_path / "t.tsv")).first()["client_id"]) == 5000


def test_command_line(spark, tmp_path, capsys):
    import json

    from vozmark import cli

    (tmp_path / "a.csv").write_text(
        "dataset,speaker,annotator,source,s_coda,r_coda,dt_palat,gold,notes,updated_at\n"
        "d1,a,ann1,human,sibilant,,,0,,2024-01-01 10:00:00\nd1,c,auto,auto,chiado,,,0,,2024-01-01 10:00:00\n"
    )
    assert cli.main(["annotations", "--csv", str(tmp_path / "a.csv"), "--marker", "s_coda", "--out", str(tmp_path / "o.json")]) == 0
    assert [(r["speaker"], r["s_coda"]) for r in json.loads((tmp_path / "o.json").read_text())] == [("a", "sibilant")]
    assert cli.main(["corpora"]) == 0
    names = {r["name"] for r in json.loads(capsys.readouterr().out)}
    assert "yodas" in names and "alcaim" not in names


def test_leave_one_group_out_of_engine_models(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    rows = []
    for i in range(40):
        y = int(i >= 20)
        x = rng.normal(3 * y, 1, 6)
        if i == 5:
            x[2] = np.nan
        rows.append((i, f"spk{i % 8}", y, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "k int, g string, y int, v array<double>")
    made = E.classifiers(trees=20, rounds=20)
    for name in ("lr", "rf", "svm"):
        got = E.loso_cv(df, "k", "g", "y", "v", 6, made[name])
        assert got.count() == 40 and E.accuracy(got).first()["acc"] > 0.9, name
        by = {r["y"]: r["m"] for r in got.groupBy("y").agg(F.avg("score").alias("m")).collect()}
        assert by[1] > by[0], name
    assert E.loso_cv(df, "k", "g", "y", "v", 6, "centroid", "drop").count() == 39
    one = E.per_group(E.loso_cv(df, "k", "g", "y", "v", 6), "g", "k", lists=True).where("g = 'spk0'").first()
    assert one["n"] == 5 and len(one["scores"]) == 5 and one["true"] == [0, 0, 0, 1, 1]
    assert E.loso_cv(df.where("y = 0"), "k", "g", "y", "v", 6, made["lr"]).count() == 0
    data = df.where("k <> 5").select(array_to_vector("v").alias("features"), F.col("y").cast("double").alias("label"))
    model = LogisticRegression(regParam=1e-3).fit(data)
    E.save_model(model, f"file://{tmp_path}/model", {"classes": ["não", "sim"], "loso_acc": 0.8})
    back, meta = E.load_model(LogisticRegressionModel, f"file://{tmp_path}/model")
    assert meta == {"classes": ["não", "sim"], "loso_acc": 0.8}
    told = lambda m: [r["prediction"] for r in m.transform(data).collect()]
    assert told(back) == told(model)


def test_sessions_close_after_the_watermark(spark, tmp_path):
    times = ["10:00:00", "10:20:00", "13:00:00", "18:00:00"]
    df = spark.createDataFrame([(1, f"2024-01-01 {t}") for t in times], "k int, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), "k int, at timestamp")
    ingest.run_once(ingest.sessions(stream, "k", "at"), "closed", "append", str(tmp_path / "cp"))
    assert sorted(r["n"] for r in spark.table("closed").collect()) == [1, 2]


def test_marker_rows_logits_and_embeddings(spark):
    model = FakeRecognizer()
    rng = np.random.default_rng(1)
    waves = [("ana", f"u{k}", [float(v) for v in rng.normal(0, 0.2, 16000)]) for k in range(2)]
    waves.append(("rui", "short", [0.1] * 600))
    rows = spark.createDataFrame(waves, "speaker string, utt_id string, samples array<float>")
    vocabulary = spark.createDataFrame([(0, "<blk>"), (1, "s"), (2, "ʃ"), (3, "t")], "id int, token string")
    pipe = FeaturePipeline(model, vocabulary, groups={"s": ["s", "ʃ", "z"], "dt": ["t"]})
    marks = spark.createDataFrame([("u0", "s", 3, 0.06), ("u0", "dt", 0, 0.0), ("u1", "s", 49, 0.98)], "utt_id string, marker string, frame int, time_s double")
    frames = pipe.frames(rows)
    got = {(r["utt_id"], r["marker"]): r["vector"] for r in pipe.marker_rows(rows, frames, marks).collect()}
    assert {k: len(v) for k, v in got.items()} == {("u0", "s"): 8, ("u0", "dt"): 7, ("u1", "s"): 8}
    logp = model.frames(np.asarray(waves[1][2], np.float32))[47:50]
    soft = np.exp(logp) / np.exp(logp).sum(1, keepdims=True)
    clip = np.asarray(waves[1][2][15680 - 320 : 16000], np.float32)
    want = np.concatenate([kernels.spectral_moments(clip), soft[:, [1, 2]].mean(0)])
    assert np.allclose(got["u1", "s"], want, rtol=1e-3, atol=1e-4)
    per = {r["utt_id"]: r["vector"] for r in pipe.utterance_vectors(frames, marks).collect()}
    assert len(per) == 2 and np.isnan(per["u1"][3]) and len(per["u0"]) == 4
    with pytest.raises(ValueError):
        pipe.pooled(frames, marks.withColumn("marker", F.lit("none")), True)
    assert infer.forward_logits(np.zeros(1599), model) == (None, None)
    out, fps = infer.forward_logits(np.zeros(30 * 16000), model)
    assert len(out) == 25 * 50 and fps == 50
    assert infer.recognise_logits(rows, model).select("utt_id").distinct().count() == 2

    class Frames:
        def load(self):
            pass

        def embed(self, x):
            return np.arange(20, dtype=np.float32)[:, None] * np.ones(3)

    silent = spark.createDataFrame([("eva", "e", None)], rows.schema)
    vectors = {r["speaker"]: r for r in infer.embed(rows.unionByName(silent), Frames(), 3).collect()}
    # 600 samples fill one frame of 320, 16000 more than there are.
    assert list(vectors["rui"]["vector"]) == [0, 0, 0] and list(vectors["ana"]["vector"]) == [9.5] * 3
    assert vectors["eva"]["n"] == 0 and np.isnan(vectors["eva"]["vector"]).all()
