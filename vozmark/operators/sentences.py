"""Phonetically balanced subset of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import units


def balanced_subset(rows: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(round, key, distance): greedily k sentences whose pooled unit shares come closest to all
    sentences' in L1; ties go to the smallest key, sentences without units are never taken.

    A round is one pass over the sentences' unit counts; the driver holds the corpus' and
    the subset's counts, one number for each unit. Fewer sentences than k end it early.
    """
    spark = rows.sparkSession
    counted = rows.select(key, units(F.col(text)).alias("u")).where(F.size("u") > 0)
    per = (
        counted.select(key, F.explode("u").alias("unit"))
        .groupBy(key, "unit")
        .agg(F.count("*").alias("n"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("unit", "n"))).alias("c"), F.sum("n").alias("t"))
        .cache()
    )
    corpus = {
        r["unit"]: r["n"]
        for r in per.select(F.explode("c").alias("unit", "n")).groupBy("unit").agg(F.sum("n").alias("n")).collect()
    }
    total = sum(corpus.values())
    have = dict.fromkeys(corpus, 0)
    out: list[tuple] = []
    for turn in range(k):
        size = sum(have.values())
        terms = [
            F.abs((F.lit(have[u]) + F.coalesce(F.try_element_at("c", F.lit(u)), F.lit(0))) / (F.col("t") + size) - F.lit(n / total))
            for u, n in sorted(corpus.items())
        ]
        if not terms:
            break
        best = (
            per.where(~F.col(key).isin([x[1] for x in out]))
            .select(key, "c", F.round(sum(terms[1:], terms[0]), 9).alias("d"))
            .orderBy("d", key)
            .first()
        )
        if best is None:
            break
        out.append((turn, best[key], best["d"]))
        for u, n in best["c"].items():
            have[u] += n
    per.unpersist()
    return spark.createDataFrame(out, f"round int, {key} {rows.schema[key].dataType.simpleString()}, distance double")
