"""Features of speakers from utterances: frames once, then spikes, markers and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config as C
from .dsp import udfs
from .infer import Embedder, Recognizer, embed, recognise
from .operators import phones as P
from .operators import vectors as V

DEFAULT = ["spec", "soft", "logits", "formants", "mfcc"]


class FeaturePipeline:
    """One job per feature over all speakers; the recogniser runs once per utterance."""

    def __init__(self, recognizer: Recognizer, vocabulary: DataFrame, embedders: dict[str, Embedder] | None = None,
                 groups: dict[str, list[str]] | None = None, blank: int = 0):
        self.recognizer, self.vocabulary, self.blank = recognizer, vocabulary, blank
        self.embedders, self.groups = embedders or {}, groups or C.PHONE_GROUPS

    def frames(self, utterances: DataFrame) -> DataFrame:
        return recognise(udfs.usable(utterances), self.recognizer)

    def spikes(self, frames: DataFrame) -> DataFrame:
        ids = frames.select("speaker", "utt_id", "t", P.argmax("logp").alias("id"))
        kept = P.collapse(ids, "utt_id", "t", "id", self.blank)
        return kept.join(self.vocabulary, "id", "left").select("utt_id", "t", F.coalesce("token", F.lit("?")).alias("token"))

    def phonemes(self, frames: DataFrame) -> DataFrame:
        """(utt_id, sequence): tokens in order without special ones."""
        rows = self.spikes(frames).where(~F.col("token").isin(C.SPECIAL_TOKENS))
        pairs = F.array_sort(F.collect_list(F.struct("t", "token")))
        return rows.groupBy("utt_id").agg(F.transform(pairs, lambda s: s["token"]).alias("sequence"))

    def markers(self, frames: DataFrame) -> DataFrame:
        return P.marker_frames(self.spikes(frames))

    def _around(self, frames: DataFrame, markers: DataFrame, soft: bool) -> DataFrame:
        """(speaker, utt_id, frame, marker, pos, x): values of the marker's group tokens, pooled
        over the frames around it; ``soft`` pools probabilities, else log probabilities."""
        unknown = sorted({r["marker"] for r in markers.select("marker").distinct().collect()} - set(self.groups))
        if unknown:  # markers are a handful of names
            raise ValueError(f"no phone group of {', '.join(unknown)}")
        spark = frames.sparkSession
        table = spark.createDataFrame(
            [(m, k, p) for m, ps in self.groups.items() for k, p in enumerate(ps)], "marker string, pos int, token string"
        )
        wanted = table.join(self.vocabulary, "token").select("marker", "pos", "id")
        half = C.POOL_HALF_WINDOW
        marks = markers.select("utt_id", "marker", F.col("frame"), F.explode(F.sequence(F.col("frame") - half, F.col("frame") + half)).alias("t"))
        # Only frames near a marker become probabilities.
        near = frames.select("speaker", "utt_id", "t", "logp").join(marks, ["utt_id", "t"])
        values = P.softmax("logp") if soft else F.col("logp").cast("array<double>")
        joined = near.withColumn("v", values).join(F.broadcast(wanted), "marker")
        return joined.groupBy("speaker", "utt_id", "frame", "marker", "pos").agg(F.avg(F.get("v", F.col("id"))).alias("x"))

    def pooled(self, frames: DataFrame, markers: DataFrame, soft: bool) -> DataFrame:
        """(speaker, marker, pos, value): means over a speaker's markers of the pooled values."""
        return self._around(frames, markers, soft).groupBy("speaker", "marker", "pos").agg(F.avg("x").alias("value"))

    def utterance_vectors(self, frames: DataFrame, markers: DataFrame, soft: bool = False) -> DataFrame:
        """(utt_id, vector): as vectors, for each utterance that has a marker."""
        per = self._around(frames, markers, soft).groupBy("utt_id", "marker", "pos").agg(F.avg("x").alias("value"))
        named = per.withColumnRenamed("utt_id", "speaker")
        return self.vectors(named, markers.select(F.col("utt_id").alias("speaker")).distinct()).withColumnRenamed("speaker", "utt_id")

    def marker_rows(self, utterances: DataFrame, frames: DataFrame, markers: DataFrame, half: int = 320) -> DataFrame:
        """(speaker, utt_id, marker, frame, vector): spectral moments of the clip around each marker,
        and the pooled probabilities of its group's known tokens. Groups differ in width."""
        pairs = F.array_sort(F.collect_list(F.struct("pos", "x")))
        soft = self._around(frames, markers, True).groupBy("utt_id", "marker", "frame").agg(
            F.transform(pairs, lambda p: p["x"].cast("float")).alias("soft")
        )
        placed = utterances.select("speaker", "utt_id").join(markers, "utt_id")
        shape = udfs.moments(udfs.clips(utterances, placed, half))
        both = shape.join(soft, ["utt_id", "marker", "frame"])
        return both.select("speaker", "utt_id", "marker", "frame", F.concat("moments", "soft").alias("vector"))

    def vectors(self, pooled: DataFrame, speakers: DataFrame) -> DataFrame:
        """(speaker, vector): the groups' blocks in order, NaN where a speaker has no marker."""
        cells = [(m, k) for m, ps in self.groups.items() for k in range(len(ps))]
        picked = [
            F.coalesce(F.max(F.when((F.col("marker") == m) & (F.col("pos") == k), F.col("value"))), F.lit(float("nan")))
            for m, k in cells
        ]
        got = speakers.join(pooled, "speaker", "left").groupBy("speaker")
        return got.agg(F.array(*picked).cast("array<float>").alias("vector"))

    def extract(self, utterances: DataFrame, features: list[str] | None = None, pairing: str = "own") -> DataFrame:
        """(speaker, feature, vector) in long form; unknown names are left out."""
        features = features or DEFAULT
        rows = udfs.usable(utterances).cache()
        speakers = rows.select("speaker").distinct()
        needs = {"spec", "soft", "logits", "formants"} & set(features)
        frames = recognise(rows, self.recognizer).cache() if needs else None
        marks = self.markers(frames).cache() if needs else None
        parts = {}
        if "spec" in features:
            where = rows.select("speaker", "utt_id").join(marks, "utt_id")
            parts["spec"] = udfs.spectral(udfs.clips(rows, where, pairing=pairing)).select("speaker", "vector")
        for name in ("soft", "logits"):
            if name in features:
                parts[name] = self.vectors(self.pooled(frames, marks, name == "soft"), speakers)
        if "formants" in features:
            tokens = udfs.vowel_tokens(rows, self.spikes(frames))
            parts["formants"] = V.formant_vector(tokens, "speaker").select("speaker", "vector")
        if "mfcc" in features:
            parts["mfcc"] = udfs.mfcc_mean(utterances)
        for name, model in self.embedders.items():
            if name in features:
                parts[name] = embed(utterances, model).select("speaker", "vector")
        out = None
        for name, part in parts.items():
            part = part.select("speaker", F.lit(name).alias("feature"), F.col("vector").cast("array<float>").alias("vector"))
            out = part if out is None else out.unionByName(part)
        return out

    @staticmethod
    def wide(features: DataFrame) -> DataFrame:
        return features.groupBy("speaker").pivot("feature").agg(F.first("vector"))
