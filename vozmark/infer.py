"""Recognisers and embedders: pluggable, loaded once for each Python worker."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config as C


class Recognizer(Protocol):
    def load(self) -> None: ...

    def frames(self, samples: np.ndarray) -> np.ndarray:
        """(frames, vocabulary) log probabilities."""


class Embedder(Protocol):
    def load(self) -> None: ...

    def embed(self, samples: np.ndarray) -> np.ndarray: ...


class OnnxRecognizer:
    """A CTC model with inputs x (1, frames, 80) and x_lens, run by ONNX Runtime."""

    def __init__(self, path: str):
        self.path, self.session = path, None

    def load(self) -> None:
        import onnxruntime

        have = onnxruntime.get_available_providers()
        wanted = [p for p in ("CUDAExecutionProvider", "CPUExecutionProvider") if p in have]
        self.session = self.session or onnxruntime.InferenceSession(self.path, providers=wanted)

    def frames(self, samples: np.ndarray) -> np.ndarray:
        from .dsp.kernels import log_filterbank

        x = log_filterbank(samples)[None]
        return self.session.run(None, {"x": x, "x_lens": np.array([x.shape[1]], np.int64)})[0][0]


class FakeRecognizer:
    """A deterministic stand-in: one token for each 20 ms, by the frame's energy."""

    def __init__(self, size: int = 8):
        self.size = size

    def load(self) -> None:
        pass

    def frames(self, samples: np.ndarray) -> np.ndarray:
        hop = C.SAMPLE_RATE * C.FRAME_MS // 1000
        n = len(samples) // hop
        level = np.abs(np.asarray(samples[: n * hop], np.float64)).reshape(n, hop).mean(1)
        out = np.full((n, self.size), -5.0, np.float32)
        out[np.arange(n), np.minimum((level * self.size * 2).astype(int), self.size - 1)] = 0
        return out


def recognise(utterances: DataFrame, recognizer: Recognizer) -> DataFrame:
    """(speaker, utt_id, t, logp) of utterances (speaker, utt_id, samples)."""

    def run(batches):
        recognizer.load()
        for batch in batches:
            for speaker, utt, x in batch.itertuples(index=False):
                logp = recognizer.frames(np.asarray(x, np.float32))
                n = len(logp)
                yield pd.DataFrame({"speaker": [speaker] * n, "utt_id": [utt] * n, "t": range(n), "logp": list(logp)})

    rows = utterances.select("speaker", "utt_id", "samples")
    return rows.mapInPandas(run, "speaker string, utt_id string, t int, logp array<float>")


def forward_logits(samples: np.ndarray, recognizer: Recognizer) -> tuple[np.ndarray | None, float | None]:
    """(frames x vocabulary, frames a second) of at most LOGIT_SECONDS; (None, None) of a sound
    that is too short."""
    x = np.asarray(samples[: C.LOGIT_SECONDS * C.SAMPLE_RATE], np.float32)
    if len(x) < C.LOGIT_LEAST_SECONDS * C.SAMPLE_RATE:
        return None, None
    out = recognizer.frames(x)
    return out, len(out) / (len(x) / C.SAMPLE_RATE)


def recognise_logits(utterances: DataFrame, recognizer: Recognizer) -> DataFrame:
    """(speaker, utt_id, t, logp, fps) by forward_logits; utterances that are too short have none."""

    def run(batches):
        recognizer.load()
        for batch in batches:
            for speaker, utt, x in batch.itertuples(index=False):
                out, fps = forward_logits(x, recognizer)
                n = 0 if out is None else len(out)
                if n:
                    yield pd.DataFrame({"speaker": [speaker] * n, "utt_id": [utt] * n, "t": range(n), "logp": list(out), "fps": [fps] * n})

    rows = utterances.select("speaker", "utt_id", "samples")
    return rows.mapInPandas(run, "speaker string, utt_id string, t int, logp array<float>, fps double")


def embedding(samples: np.ndarray, embedder: Embedder) -> np.ndarray:
    """One vector of an utterance, capped and padded. Of an embedder that gives frames, the mean
    over those that the sound's own length fills."""
    from .dsp.kernels import scrub

    x = scrub(samples, least=C.MIN_SAMPLES)
    out = np.asarray(embedder.embed(x), np.float32)
    if out.ndim == 2 and len(out) > 1:
        out = out[: min(max(1, len(x) // C.EMBED_HOP), len(out))].mean(0)
    return np.ravel(out)


def embed(utterances: DataFrame, embedder: Embedder, size: int | None = None) -> DataFrame:
    """(speaker, vector, n): unweighted mean of utterance embeddings; short ones are padded.
    A speaker without a readable utterance (samples null) has n 0 and ``size`` NaN if size is given,
    else is left out."""
    from .operators.vectors import mean_vectors

    def run(batches):
        embedder.load()
        for batch in batches:
            yield pd.DataFrame({"speaker": batch["speaker"], "vector": [embedding(x, embedder) for x in batch["samples"]]})

    readable = utterances.where("samples IS NOT NULL").select("speaker", "samples")
    each = readable.mapInPandas(run, "speaker string, vector array<float>")
    counts = each.groupBy("speaker").count().withColumnRenamed("count", "n")
    out = mean_vectors(each, "speaker", "vector").join(counts, "speaker")
    if size is None:
        return out
    nothing = F.array_repeat(F.lit(float("nan")), size)
    every = utterances.select("speaker").distinct().join(out, "speaker", "left")
    return every.select("speaker", F.coalesce("vector", nothing).alias("vector"), F.coalesce("n", F.lit(0)).alias("n"))
