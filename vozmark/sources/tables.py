"""Readers and writers of annotation, metadata, manifest, vocabulary and feature tables."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATIONS = (
    "dataset string, speaker string, annotator string, source string, s_coda string, r_coda string,"
    " dt_palat string, gold int, notes string, updated_at timestamp"
)


#: The columns of an annotation file, in order.
ANNOTATION_COLUMNS = "dataset speaker annotator source s_coda r_coda dt_palat gold notes updated_at".split()


def load_annotations(spark: SparkSession, db: str | None = None, csv: str | None = None, default_db: str | None = None) -> DataFrame:
    """Annotation rows: of the named SQLite file, which must be there; else of the default one if
    it is there; else of the CSV file."""
    import os

    from ..config import ANNOTATIONS_DB

    if db is not None and not os.path.exists(db):
        raise FileNotFoundError(db)
    path = db or default_db or ANNOTATIONS_DB
    if os.path.exists(path):
        return read_annotations_db(spark, path)
    if csv is None:
        raise FileNotFoundError(f"neither {path} nor a CSV file")
    return read_annotations(spark, csv)


def write_annotations(rows: DataFrame, path: str) -> None:
    """The ten columns as CSV; others are left out."""
    write_csv(rows, path, ANNOTATION_COLUMNS, ["dataset", "speaker", "annotator"])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, schema=ANNOTATIONS, header=True, multiLine=True, escape='"')
    return rows.withColumn("source", F.coalesce("source", F.lit("human")))


def read_annotations_db(spark: SparkSession, path: str) -> DataFrame:
    """The annotations of a SQLite file, a hand-made table that fits the driver."""
    columns = ["dataset", "speaker", "annotator", "s_coda", "r_coda", "dt_palat", "gold", "notes", "updated_at"]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute(f"SELECT {', '.join(columns)} FROM annotations").fetchall()
    kinds = ", ".join(f"{c} {'int' if c == 'gold' else 'string'}" for c in columns)
    df = spark.createDataFrame(rows, kinds)
    text = ["dataset", "speaker", "annotator", "s_coda", "r_coda", "dt_palat", "notes"]
    df = df.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in text})
    return df.withColumns(
        {
            "source": F.when(F.col("annotator") == "auto", "auto").otherwise("human"),
            "updated_at": F.to_timestamp("updated_at"),
        }
    )


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    rows.orderBy(*order).select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, maxCharsPerColumn=-1, quote="")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(speaker, seq, path) of a JSON object {speaker: [path, ...]}."""
    text = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(pairs).alias("speaker", "paths")).select("speaker", F.posexplode("paths").alias("seq", "path"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of lines ``token id``; a later line of one id wins."""
    from ..operators.selection import last_wins

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))
    parts = lines.select("seq", F.split(F.trim("line"), r"\s+").alias("p")).where(F.size("p") >= 2)
    return last_wins(parts.select(F.col("p")[1].cast("int").alias("id"), F.col("p")[0].alias("token"), "seq"), "id", ["seq"]).drop("seq")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(sentence_id, text), 1-based, of a Latin-1 text without its blank lines."""
    data = spark.read.format("binaryFile").load(path)
    lines = F.filter(F.split(F.decode("content", "ISO-8859-1"), r"\r?\n"), lambda x: F.trim(x) != "")
    return data.select(F.posexplode(lines).alias("i", "text")).select((F.col("i") + 1).alias("sentence_id"), F.trim("text").alias("text"))


def speakers_in(spark: SparkSession, directory: str, least: int = 2) -> DataFrame:
    """(speaker, n, paths): sub-directories with at least so many wav files, from names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(directory)
    found = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("speaker"))
    return found.groupBy("speaker").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).where(F.col("n") >= least)


def write_features(features: DataFrame, path: str) -> None:
    """One partition directory for each feature."""
    features.write.mode("overwrite").partitionBy("feature").parquet(path)


def write_npz(features: DataFrame, path: str) -> list[str]:
    """One .npz for each feature in a folder that all executors share, through the engine-neutral
    file system of its URI; a feature's speakers are few and are one task's."""
    base = path if "://" in path else f"file://{path}"

    def save(frame):
        import io

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        name = frame["feature"].iloc[0]
        frame = frame.sort_values("speaker")
        out = io.BytesIO()
        np.savez(out, speaker=frame["speaker"].to_numpy(str), vector=np.stack(frame["vector"]).astype(np.float32))
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}.npz") as stream:
            stream.write(out.getvalue())
        return pd.DataFrame({"path": [f"{path}/{name}.npz"]})

    out = features.select("feature", "speaker", "vector").groupBy("feature").applyInPandas(save, "path string")
    return sorted(r["path"] for r in out.collect())
