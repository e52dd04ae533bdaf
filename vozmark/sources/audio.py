"""Audio: PCM decoding, resampling, encoding, and archives as a data source."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import SAMPLE_RATE


def resample(x: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Windowed-sinc resampling."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    ratio, half = min(1.0, to / rate), 16
    at = np.arange(int(len(x) * to / rate)) * (rate / to)
    reach = int(np.ceil(half / ratio))
    near = np.floor(at).astype(int)[:, None] + np.arange(-reach, reach + 1)
    d = (near - at[:, None]) * ratio
    weight = np.sinc(d) * np.where(np.abs(d) < half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0) * ratio
    inside = (near >= 0) & (near < len(x))
    return (x[np.clip(near, 0, len(x) - 1)] * weight * inside).sum(1).astype(np.float32)


def decode_wav(data: bytes, downmix: str = "first") -> np.ndarray:
    """16 kHz mono float32 of a PCM wave file; channel 0, or the channels' mean."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 3:
        raw = b"".join(b"\0" + raw[i : i + 3] for i in range(0, len(raw), 3))
        width = 4
    kind, scale, shift = {1: ("u1", 128.0, 128), 2: ("<i2", 32768.0, 0), 4: ("<i4", 2147483648.0, 0)}[width]
    x = ((np.frombuffer(raw, kind).astype(np.float64) - shift) / scale).reshape(-1, channels)
    return resample(x.mean(1) if downmix == "mean" else x[:, 0], rate)


def decode_pcm16(data: bytes) -> np.ndarray:
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768


def encode_wav(x: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_utterances(spark: SparkSession, directory: str, downmix: str = "first") -> DataFrame:
    """(path, speaker, utt_id, samples, error): unreadable files have an error and no samples."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(directory)

    @F.pandas_udf("samples array<float>, error string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                try:
                    rows.append((decode_wav(data, downmix), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["samples", "error"])

    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    rows = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("speaker"), name.alias("utt_id"), decode("content").alias("d"))
    return rows.select("path", "speaker", "utt_id", "d.samples", "d.error")


class ArchiveSource(DataSource):
    """``spark.read.format("archive").option("suffix", ".wav").load(path)``: members of tar and zip
    files, one partition an archive, in archive order; content is read for kept names alone."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, seq long, name string, size long, content binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.suffixes = tuple(s for s in options.get("suffix", "").split(",") if s)
        self.limit = int(options.get("limit", "0"))

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import tarfile
        import zipfile

        path, given = partition.value, 0
        wanted = lambda n: not self.suffixes or n.endswith(self.suffixes)
        if zipfile.is_zipfile(path):
            with zipfile.ZipFile(path) as z:
                for seq, info in enumerate(z.infolist()):
                    if not info.is_dir() and wanted(info.filename):
                        yield path, seq, info.filename, info.file_size, z.read(info)
                        given += 1
                        if self.limit and given >= self.limit:
                            return
            return
        with tarfile.open(path, "r|*") as tar:
            for seq, info in enumerate(tar):
                if info.isfile() and wanted(info.name):
                    yield path, seq, info.name, info.size, tar.extractfile(info).read()
                    given += 1
                    if self.limit and given >= self.limit:
                        return
