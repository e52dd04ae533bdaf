"""Training-data pipeline: language ID, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
to the shared folder and gives the next stage what it reads there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vozmark.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from vozmark.llm.common import Scratch, carried, small, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; lang becomes the predicted language.

    Null and empty texts and texts without a letter are rejected, as are ties of two
    languages. Repeated rows and null doc_ids are judged one by one; extra columns stay.
    """
    judged = language_id.detect(docs, language_id.learn(docs), carry=True)
    lang = next((c for c in docs.columns if c.lower() == "lang"), None)
    own = [F.col("lang_pred").alias(c) if c == lang else F.col("row")[c].alias(c) for c in docs.columns]
    return judged.where(~F.col("lang_rejected")).select(*own)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; drops documents of which nothing is left.

    n_chars becomes the length of a text that was cut. Null texts, and texts without a line
    that could be cut, stay as they are, whatever the doc_id; rows that share a doc_id and a
    text are cut alike. Extra columns stay, also those with the names of the operator's own.
    """
    cut = line_dedup.dedup_lines(docs, carry=True)
    length = F.length("text").cast("long")
    n_removed = F.col("n_removed")
    own = [
        F.when(n_removed > 0, length).otherwise(F.col("row")[c]).alias(c)
        if c.lower() == "n_chars"
        else F.col("text").alias(c) if c.lower() == "text" else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return cut.where((n_removed == 0) | (n_removed < F.col("n_lines"))).select(*own)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates.

    Rows are told by doc_id and text: of rows that are equal in both one stays, and rows
    that share a doc_id alone are judged by their own texts. Texts without words and rows with a null
    doc_id belong to no group and stay. Extra columns stay.
    """
    judged = near_dedup.grouped(docs)
    ids = [F.col("doc_id").alias("id2"), F.col("th").alias("th2")]
    gone = judged.where(~F.col("kept")).select(*ids).distinct()
    worded = judged.where(F.col("kept") & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    again = worded.groupBy("doc_id", "th").count().where("count > 1").select(*ids)
    rows = carried(docs, [], doc_id="long", text="string").select("row", "doc_id", F.xxhash64("text").alias("th"))
    same = (F.col("doc_id") == F.col("id2")) & (F.col("th") == F.col("th2"))
    left = rows.join(small(gone), same, "left_anti")
    if not again.isEmpty():
        again = small(again)
        one = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "th"])
        left = left.join(again, same, "left_anti").unionByName(one)
    return left.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none. Rows are judged by doc_id and text, so repeated rows and
    null doc_ids share no verdict with other texts. Without items every row stays, as do extra columns.
    """
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's rate and number of copies for the target weights.

    Every row stands once, whatever its rate: weights hold over rate or n_copies. Columns rate
    and n_copies that are there already are replaced. Null and empty texts have a rate like any
    other; repeated rows and null doc_ids are rated one by one; extra columns stay.
    """
    rated = mixing.mix(docs, table(spark, sf_dir, "labels"), carry=True)
    new = ("rate", "n_copies")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return rated.select(*own, *new)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Compression and MinHash cannot be told in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; the tables of stages before are dropped once they are read."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.last(stage(spark, docs, sf_dir))
    return docs
