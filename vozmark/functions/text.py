"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letter pairs that are one unit, and letters.
DIGRAPHS = ["lh", "nh", "ch", "rr", "ss", "qu", "gu"]
LETTERS = "a-záâãàéêíóôõúüç"


def units(text: Column) -> Column:
    """Units of a sentence from the left, pairs before letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{'|'.join(DIGRAPHS)}|[{LETTERS}]"), 0)


def unit_shares(rows: DataFrame, text: str) -> DataFrame:
    """(unit, n, share): units over all rows."""
    counts = rows.select(F.explode(units(F.col(text))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("unit", "n", (F.col("n") / F.col("t")).alias("share"))


def ranges(spec: str) -> list[tuple[int, int]]:
    """'1-3,7' as 0-based half-open ranges."""
    out = []
    for part in spec.replace(",", " ").split():
        lo, _, hi = part.partition("-")
        out.append((int(lo) - 1, int(hi or lo)))
    return out


def decode_latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")
