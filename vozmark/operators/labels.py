"""Consolidating annotations: latest-wins fold, majority vote, summary, todo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ["s_coda", "r_coda", "dt_palat"]


def usable(value: Column, unsure: str = "unsure") -> Column:
    return value.isNotNull() & (F.trim(value) != "") & (value != unsure)


def latest_fold(rows: DataFrame, key: str, columns: list[str], at: str, valid=usable) -> DataFrame:
    """Per key and column the latest valid value, of equally late ones the highest; keys without
    any stay, with nulls."""
    latest = [F.max(F.when(valid(F.col(c)), F.struct(F.col(at), F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    return rows.groupBy(key).agg(*latest)


def labels_map(folded: DataFrame, columns: list[str]) -> DataFrame:
    """(key..., labels): the labels that there are as one map."""
    rest = [c for c in folded.columns if c not in columns]
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c), F.col(c))) for c in columns]))
    return folded.select(*rest, F.map_from_entries(pairs).alias("labels"))


def annotated(folded: DataFrame, key: str, columns: list[str], marker: str | None = None, value=None) -> DataFrame:
    """Keys of folded rows that have a label: of the marker if given, with that value if given."""
    if marker is None:
        return folded.where(F.coalesce(*columns).isNotNull()).select(key)
    return with_label(folded, marker, value).select(key)


def with_label(folded: DataFrame, marker: str, value=None) -> DataFrame:
    """Folded rows, whole, that have a label of the marker, or that value of it."""
    own = F.col(marker)
    return folded.where(own.isNotNull() if value is None else own == F.lit(value))


def visible(rows: DataFrame, include_auto: bool = False, source: str = "source") -> DataFrame:
    """Rows without those that a script wrote."""
    return rows if include_auto else rows.where(F.col(source) != "auto")


def choose_rows(rows: DataFrame, marker: str, value: str | None = None) -> DataFrame:
    """Rows with a label of the marker, 'unsure' among them, or with that value."""
    rows = rows.where(F.trim(marker) != "")
    return rows if value is None else rows.where(F.col(marker) == value)


def profile(rows: DataFrame, dataset: str, speaker: str) -> DataFrame:
    """(dataset, n, n_speakers)"""
    return rows.groupBy(dataset).agg(F.count("*").alias("n"), F.count_distinct(speaker).alias("n_speakers"))


def labelled_more_than_once(rows: DataFrame, speaker: str) -> DataFrame:
    """(speaker, n) of speakers with several rows."""
    return rows.groupBy(speaker).agg(F.count("*").alias("n")).where("n > 1")


def latest_by_kind(rows: DataFrame, key: str, kind: str, value: str, at: str, kinds: list[str]) -> DataFrame:
    """The same fold where labels stand below each other: one column for each kind."""
    own = lambda k: F.max(F.when(F.col(kind) == k, F.struct(F.col(at), F.col(value).alias("v"))))["v"].alias(k)
    return rows.groupBy(key).agg(*[own(k) for k in kinds])


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, winner, agree): the most frequent value; a tie for first gives '' and 0.

    Counts are combined before the shuffle, and the winner needs no window over a key's rows.
    """
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(
        F.max(F.struct("n", value)).alias("top"), F.sort_array(F.collect_list("n"), asc=False).alias("ns")
    )
    tied = F.coalesce(F.get("ns", F.lit(1)) == F.col("top.n"), F.lit(False))
    return top.select(
        *keys,
        F.when(tied, "").otherwise(F.col(f"top.{value}")).alias("winner"),
        F.when(tied, 0).otherwise(F.col("top.n")).cast("long").alias("agree"),
    )


def consensus(rows: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Majority labels per (dataset, speaker) over human rows, or all rows if none is human."""
    markers = markers or MARKERS
    keys = ["dataset", "speaker"]
    human = F.col("source") == "human"
    heads = rows.groupBy(*keys).agg(
        F.max(human).alias("has_human"),
        F.sum(human.cast("long")).alias("n_annotators"),
        F.array_join(F.array_sort(F.collect_set(F.when(human, F.col("annotator")))), "; ").alias("annotators"),
    )
    pool = rows.join(heads.select(*keys, "has_human"), keys).where(human | ~F.col("has_human"))
    long = pool.unpivot(keys, markers, "marker", "value")
    votes = majority(long, [*keys, "marker"], "value")
    wide = votes.groupBy(*keys).agg(
        *[F.max(F.when(F.col("marker") == m, F.col("winner"))).alias(m) for m in markers],
        *[F.max(F.when(F.col("marker") == m, F.col("agree"))).alias(f"agree_{m}") for m in markers],
    )
    cols = [c for m in markers for c in (F.coalesce(m, F.lit("")).alias(m), F.coalesce(f"agree_{m}", F.lit(0)).alias(f"agree_{m}"))]
    source = F.when(F.col("has_human"), "human").otherwise("auto").alias("source")
    return heads.join(wide, keys, "left").select(*keys, source, "n_annotators", "annotators", *cols)


def summary(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Counts of each non-blank value of each column, by keys."""
    long = rows.unpivot(keys, columns, "marker", "value").where(F.trim("value") != "")
    return long.groupBy(*keys, "marker", "value").agg(F.count("*").alias("n"))


def todo(have: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys for which some column (boolean: ever seen) is missing, with missing and have lists."""
    seen = have.groupBy(*keys).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in columns])
    listed = lambda cond: F.array_compact(F.array(*[F.when(cond(F.col(f"`{c}`")), F.lit(c)) for c in columns]))
    return seen.select(
        *keys,
        F.array_join(listed(lambda c: ~c), " ").alias("missing"),
        F.array_join(F.array_sort(listed(lambda c: c)), " ").alias("have"),
    ).where("missing <> ''")
