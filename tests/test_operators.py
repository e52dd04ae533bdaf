import random

import numpy as np
from pyspark.sql import functions as F

from vozmark.dsp import kernels as K
from vozmark.operators import evaluate as E
from vozmark.operators import labels as L
from vozmark.operators import phones as P
from vozmark.operators import selection as S

ROWS = [
    ("d1", "a", "ann1", "human", "sibilant", "tap", "palatalized", "2024-01-01 10:00:00"),
    ("d1", "b", "ann1", "human", "mixed", None, None, "2024-01-02 10:00:00"),
    ("d1", "b", "ann2", "human", "sibilant", "caipira", "unsure", "2024-01-01 10:00:00"),
    ("d1", "c", "auto", "auto", "chiado", "tap", "mixed", "2024-01-03 10:00:00"),
    ("d1", "d", "ann1", "human", None, None, None, "2024-01-01 11:00:00"),
    ("d2", "a", "ann2", "human", "chiado", "tap", "mixed", "2024-01-05 10:00:00"),
]
SCHEMA = "dataset string, speaker string, annotator string, source string, s_coda string, r_coda string, dt_palat string, updated_at string"


def test_fold_takes_each_marker_from_its_latest_row(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).where("source <> 'auto'")
    got = {r["speaker"]: tuple(r)[1:] for r in L.latest_fold(rows, "speaker", L.MARKERS, "updated_at").collect()}
    assert got == {
        "a": ("chiado", "tap", "mixed"),
        "b": ("mixed", "caipira", None),
        "d": (None, None, None),
    }


def test_consensus_ties_unsure_and_auto_pool(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["dataset"], r["speaker"]): r for r in L.consensus(rows).collect()}
    b = got["d1", "b"]
    assert (b["s_coda"], b["agree_s_coda"], b["r_coda"], b["dt_palat"]) == ("", 0, "caipira", "unsure")
    assert b["annotators"] == "ann1; ann2" and b["n_annotators"] == 2
    assert got["d1", "c"]["s_coda"] == "chiado" and got["d1", "c"]["source"] == "auto"
    assert got["d1", "d"]["s_coda"] == ""


def test_todo_keeps_only_gaps(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    flags = rows.select("speaker", *[F.col(m).isNotNull().alias(m) for m in L.MARKERS])
    got = L.todo(flags, ["speaker"], L.MARKERS).collect()
    assert [(r["speaker"], r["missing"], r["have"]) for r in got] == [("d", "s_coda r_coda dt_palat", "")]


def test_spikes_against_a_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("sst td iaa r") for _ in range(rng.randint(0, 40))) for _ in range(60)]

    def loop(text):
        out, before = [], None
        for t, x in enumerate(text):
            if x != " " and x != before:
                out.append((t, x))
            before = x
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").where("x <> ''")
    got = df.select("i", P.spikes_of("split(x, '')", " ").alias("s")).collect()
    for r in got:
        assert [(s["t"], s["token"]) for s in r["s"]] == loop(texts[r["i"]])
    long = df.select("i", F.posexplode(F.split("x", "")).alias("t", "id"))
    windows = P.collapse(long, "i", "t", "id", " ").groupBy("i").agg(F.count("*").alias("n")).collect()
    assert {r["i"]: r["n"] for r in windows} == {r["i"]: len(r["s"]) for r in got if r["s"]}


def test_markers_have_their_contexts(spark):
    df = spark.createDataFrame([("ts▁siʃtatʃr",)], "x string")
    got = (
        df.select(P.spikes_of("split(x, '')", " ").alias("s")).select(F.explode(P.markers_of("s")).alias("m"))
    )
    assert sorted((r["m"]["marker"], r["m"]["phone"], r["m"]["next_phone"]) for r in got.collect()) == [
        ("dt", "t", "ʃ"),
        ("r", "r", ""),
        ("s", "s", "▁"),
        ("s", "ʃ", "r"),
        ("s", "ʃ", "t"),
    ]


def test_merge_segments_against_a_loop(spark):
    rng = random.Random(5)
    rows, t = [], 0.0
    for _ in range(200):
        t += rng.random()
        rows.append(("r", round(t, 3), round(t + rng.random(), 3), rng.choice("ab")))
    want = []
    for _, s, e, spk in sorted(rows):
        if want and want[-1][2] == spk and s - want[-1][1] <= 0.3:
            want[-1][1] = e
        else:
            want.append([s, e, spk])
    df = spark.createDataFrame(rows, "rec string, s double, e double, spk string")
    got = S.merge_segments(df, "rec", F.col("s"), F.col("e"), "spk", 0.3).orderBy("start_s").collect()
    assert [[r["start_s"], r["end_s"], r["spk"]] for r in got] == want


def test_eer_against_a_loop(spark):
    rng = np.random.default_rng(1)
    for n in (4, 50, 400):
        y = rng.integers(0, 2, n)
        s = np.round(y + rng.normal(0, 1, n), 1)
        y[:2] = 0, 1
        best = None
        for t in np.unique(s):
            fa, miss = (s[y == 0] >= t).mean(), (s[y == 1] < t).mean()
            if abs(fa - miss) < 0.01:
                best = min(best or 9, (fa + miss) / 2)
        df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
        got = E.equal_error_rate(df, "y", "s").first()["eer"]
        assert abs(got - 100 * (1.0 if best is None else best)) < 1e-9


def test_impute_uses_finite_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, float("nan")]), (3, [5.0, float("inf")])], "k int, v array<double>")
    got = {r["k"]: r["v"] for r in E.impute_mean(df, "v", 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [3.0, 2.0], 3: [5.0, 2.0]}


def test_spectral_moments_of_a_tone_and_silence():
    t = np.arange(16000) / 16000
    m = K.spectral_moments(np.sin(2 * np.pi * 3000 * t))
    assert abs(m[0] - 3000) < 10 and abs(m[4] - 3000) < 10 and m[5] < 0
    assert not K.spectral_moments(np.zeros(16000)).any() and not K.spectral_moments(np.zeros(0)).any()
    assert K.spectral_moments(np.random.default_rng(0).normal(size=256)).shape == (6,)


def test_mfcc_and_filterbank_shapes_and_pitch():
    x = np.random.default_rng(0).normal(size=32000)
    assert K.mfcc(x).shape == (13, 201) and np.isfinite(K.mfcc(x)).all()
    assert K.log_filterbank(x).shape == (200, 80)
    t = np.arange(16000) / 16000
    assert abs(K.pitch_at(np.sin(2 * np.pi * 200 * t), 0.5) - 200) < 3
    assert np.isnan(K.pitch_at(np.zeros(16000), 0.5))


def test_formants_of_two_resonances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=16000)
    for f, bw in ((700, 80), (1200, 90), (2500, 120)):
        r = np.exp(-np.pi * bw / 16000)
        a1, a2 = -2 * r * np.cos(2 * np.pi * f / 16000), r * r
        y = np.zeros_like(x)
        for n in range(len(x)):
            y[n] = x[n] - a1 * y[n - 1] - a2 * y[n - 2]
        x = y
    got = K.formants_at(x, 0.5)
    assert abs(got[0] - 700) < 150 and abs(got[1] - 1200) < 200
