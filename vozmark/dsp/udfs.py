"""Kernels as operations on utterances (speaker, utt_id, samples)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def usable(utterances: DataFrame) -> DataFrame:
    """Utterances long enough, cut at the cap before any Python sees them."""
    cap = C.CAP_SECONDS * C.SAMPLE_RATE
    return utterances.where(F.size("samples") >= C.MIN_SAMPLES).withColumn("samples", F.slice("samples", 1, cap))


def clips(utterances: DataFrame, markers: DataFrame, half: int = 320, pairing: str = "own") -> DataFrame:
    """(speaker, utt_id, marker, frame, samples) around each marker's time.

    pairing "own" takes a marker's own utterance, "all" every utterance of its speaker.
    """
    keys = ["speaker", "utt_id"] if pairing == "own" else ["speaker"]
    marks = markers if pairing == "own" else markers.drop("utt_id")
    centre = F.floor(F.col("time_s") * C.SAMPLE_RATE).cast("int")
    start = F.greatest(centre - half, F.lit(0))
    length = F.greatest(centre + half - start, F.lit(0))
    return utterances.join(marks, keys).select(
        "speaker", "utt_id", "marker", "frame", F.slice("samples", start + 1, length).alias("samples")
    )


def moments(rows: DataFrame) -> DataFrame:
    """Clips with their six spectral moments in place of samples."""
    from .kernels import spectral_moments

    @F.pandas_udf("array<float>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(spectral_moments)

    return rows.withColumn("moments", run("samples")).drop("samples")


def spectral(rows: DataFrame) -> DataFrame:
    """(speaker, vector, n): mean of spectral moments over a speaker's clips."""
    from ..operators.vectors import mean_vectors

    each = moments(rows).select("speaker", F.col("moments").alias("m"))
    counts = each.groupBy("speaker").agg(F.count("*").alias("n"))
    return mean_vectors(each, "speaker", "m").join(counts, "speaker")


def mfcc_mean(utterances: DataFrame, coefficients: int = 13) -> DataFrame:
    """(speaker, vector): unweighted mean over utterances of their mean coefficients."""
    from ..operators.vectors import mean_vectors
    from .kernels import mfcc

    @F.pandas_udf("array<float>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: mfcc(x, coefficients=coefficients).mean(1))

    zero = F.array_repeat(F.lit(0.0), coefficients)
    got = mean_vectors(utterances.where(F.size("samples") > 0).select("speaker", run("samples").alias("m")), "speaker", "m")
    return utterances.select("speaker").distinct().join(got, "speaker", "left").select("speaker", F.coalesce("vector", zero).alias("vector"))


def vowel_tokens(utterances: DataFrame, spikes: DataFrame) -> DataFrame:
    """(speaker, utt_id, vowel, f1, f2, f3, f0) at vowel spikes with all formants finite."""
    from .kernels import formants_at, pitch_at

    pairs = [(p, v) for v, ps in C.VOWEL_SOURCES.items() for p in ps]
    table = utterances.sparkSession.createDataFrame(pairs, "token string, vowel string")
    # A fixed table of 21 rows.
    vowels = spikes.join(F.broadcast(table), "token").select("utt_id", "vowel", (F.col("t") * (C.FRAME_MS / 1000)).alias("time_s"))
    grouped = vowels.groupBy("utt_id").agg(F.collect_list(F.struct("vowel", "time_s")).alias("at"))
    both = utterances.join(grouped, "utt_id").select("speaker", "utt_id", "samples", "at")

    def run(batches):
        for batch in batches:
            rows = []
            for speaker, utt, x, at in batch.itertuples(index=False):
                for s in at:
                    if 0 < s["time_s"] < len(x) / C.SAMPLE_RATE:
                        f = formants_at(x, s["time_s"])
                        rows.append((speaker, utt, s["vowel"], *map(float, f), pitch_at(x, s["time_s"])))
            yield pd.DataFrame(rows, columns=["speaker", "utt_id", "vowel", "f1", "f2", "f3", "f0"])

    schema = "speaker string, utt_id string, vowel string, f1 double, f2 double, f3 double, f0 double"
    out = both.mapInPandas(run, schema)
    return out.where(" AND ".join(f"NOT isnan({c})" for c in ("f1", "f2", "f3")))
