"""Filters, quotas, samples, joins of corpus building, and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_frequent(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key has at least so many rows."""
    many = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    return rows.join(many, key, "left_semi")


def top_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def cap_per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark prunes groups before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def first_keys(rows: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The n keys seen first."""
    return rows.groupBy(key).agg(F.min(seq).alias("first_seq")).orderBy("first_seq", key).limit(n)


def balanced_keys(rows: DataFrame, key: str, group: str, seq: str, n: int, groups: int) -> DataFrame:
    """n // groups keys of each group, those seen first."""
    firsts = rows.groupBy(key, group).agg(F.min(seq).alias("first_seq"))
    return cap_per_key(firsts, group, ["first_seq", key], n // groups)


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("__last")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"__last.{c}").alias(c) for c in cols])


def merge_segments(rows: DataFrame, rec: str, start: Column, end: Column, spk: str, gap: float) -> DataFrame:
    """Runs of one speaker's neighbouring segments with gaps up to ``gap``; the last end holds."""
    w = Window.partitionBy(rec).orderBy("start_s", "end_s")
    flagged = rows.select(rec, start.alias("start_s"), end.alias("end_s"), F.col(spk).alias("spk")).withColumn(
        "new",
        F.when(
            (F.lag("spk").over(w) == F.col("spk")) & (F.col("start_s") - F.lag("end_s").over(w) <= gap), 0
        ).otherwise(1),
    )
    return (
        flagged.withColumn("island", F.sum("new").over(w))
        .groupBy(rec, "island", "spk")
        .agg(F.min("start_s").alias("start_s"), F.max_by("end_s", F.struct("start_s", "end_s")).alias("end_s"))
    )


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_")


def human_size(n: Column) -> Column:
    """Bytes with one decimal in steps of 1024, up to TB."""
    n = n.cast("double")
    out, base = None, 1.0
    for unit in ["B", "KB", "MB", "GB"]:
        text = F.format_string(f"%.1f {unit}", F.round(n / base, 1))
        out = F.when(n < base * 1024, text) if out is None else out.when(n < base * 1024, text)
        base *= 1024
    return out.otherwise(F.format_string("%.1f TB", F.round(n / base, 1)))


def group_key(value: Column) -> Column:
    """Value without outer white space, null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def class_counts(rows: DataFrame, by: str) -> DataFrame:
    """(class, n) of the values of a column; blank ones are no class."""
    named = rows.select(group_key(F.col(by).cast("string")).alias("class")).where("class IS NOT NULL")
    return named.groupBy("class").agg(F.count("*").alias("n"))


def frequent_classes(rows: DataFrame, by: str, least: int) -> DataFrame:
    """(class, n, kept): every class and whether it has so many rows."""
    return class_counts(rows, by).withColumn("kept", F.col("n") >= least)


def unknown_names(asked: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Names that are asked for and not known."""
    return asked.join(known.select(name).distinct(), name, "left_anti")


def allowed(rows: DataFrame, name: str, asked: list[str]) -> DataFrame:
    """Rows of the names asked for; an error that tells the unknown ones and what there is."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(n,) for n in asked], f"{name} string")
    unknown = sorted(r[0] for r in unknown_names(wanted, rows, name).collect())
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return rows.join(F.broadcast(wanted), name, "left_semi")


def scan_hits(rows: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the hits. Only the key is read to tell them, as columns are pruned."""
    return rows.join(hits.select(key).distinct(), key, "left_semi")


def missing_rows(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there."""
    return rows.join(there.select(key).distinct(), key, "left_anti")


def appearance_order(turns: DataFrame, rec: str, spk: str, seq: Column) -> DataFrame:
    """(rec, spk, idx): speakers of a recording numbered from 0 as they first appear."""
    firsts = turns.groupBy(rec, spk).agg(F.min(seq).alias("__first"))
    w = Window.partitionBy(rec).orderBy("__first")
    return firsts.select(rec, spk, (F.dense_rank().over(w) - 1).alias("idx"))


def number_segments(segments: DataFrame, rec: str, order: str, length: Column, least: float) -> DataFrame:
    """Segments of at least so many seconds, numbered from 1 by recording and speaker."""
    w = Window.partitionBy(rec, "spk").orderBy(order)
    return segments.where(length >= least).withColumn("number", F.row_number().over(w))


def durations(segments: DataFrame, rec: str, spk: str, length: Column, seq: Column) -> DataFrame:
    """(rec, spk, duration, first): seconds of each speaker, and where they first appear."""
    return segments.groupBy(rec, spk).agg(F.round(F.sum(length), 4).alias("duration"), F.min(seq).alias("first"))


def most_active(sums: DataFrame, rec: str, spk: str, n: int = 2) -> DataFrame:
    """The n speakers of each recording with the most seconds (the earlier of equals), numbered
    anew from 0 in order of their old index ``spk``."""
    top = cap_per_key(sums, rec, [F.desc("duration"), "first"], n)
    w = Window.partitionBy(rec).orderBy(spk)
    return top.withColumn("idx", F.row_number().over(w) - 1)


def labelled(features: DataFrame, labels: DataFrame, key: str = "speaker") -> DataFrame:
    """Features with the label of their speaker, joined by key, never by place."""
    return features.join(labels, key)
