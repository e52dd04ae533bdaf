"""Line deduplication over overlapping windows of three lines.

Lines that hold a word, without white space at their ends, form windows of three in a
row. A window that occurs again later, in order of (doc_id, place in the text), is
removed there: its three lines are covered, covered lines merge into spans, and spans are
cut from the text. The first occurrence stays.

Cases: null text stays null; a text with fewer than three such lines keeps them all.
Lines without a word are never covered, but a text of which no line with a word is left
becomes empty. Rows that share a doc_id (a null one comes first) and a text are one place
and are cut alike; of rows that share a doc_id alone, windows at the same place are both
first. Other columns are kept as they are, but for those named like a result, which are
replaced. Windows are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, Scratch, carried

WINDOW = 3


def _has_word(name: str) -> str:
    return rf"{name} RLIKE '[^\\x20\\x09-\\x0D]'"


def _places(lines: str) -> Column:
    """0-based places of the lines with a word."""
    return F.expr(
        f"transform(filter(transform({lines}, (x, i) -> struct(x, i)), s -> {_has_word('s.x')}), s -> s.i)"
    )


def windows(docs: DataFrame) -> DataFrame:
    """One row (id, text hash, k, two hashes) for each window of each text."""
    trimmed = F.expr(
        rf"transform(filter({{}}, x -> {_has_word('x')}), x -> btrim(x, ' \t\u000b\f\r'))".format(
            "split(text, '\\n', -1)"
        )
    )
    rows = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), trimmed.alias("l")
    )
    hashed = F.expr(
        f"transform(sequence(0, size(l) - {WINDOW}), i ->"
        " struct(i AS k, xxhash64(l[i], l[i + 1], l[i + 2]) AS a,"
        " xxhash64('second', l[i + 2], l[i + 1], l[i]) AS b))"
    )
    return (
        rows.where(F.size("l") >= WINDOW)
        .select("id", "th", F.explode(hashed).alias("w"))
        .select("id", "th", F.col("w.k").alias("k"), F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    )


def repeats(docs: DataFrame) -> DataFrame:
    """(id, text hash, spans): the spans of line numbers that are later occurrences.

    The first place of a window is a map-side combined minimum, so a window that a third
    of all texts share is one row a task in that shuffle; joining places with the windows
    that repeat is a sort-merge join whose hot partitions the engine splits.
    """
    places = windows(docs)
    first = (
        places.groupBy("a", "b")
        .agg(F.min(F.struct("id", "k")).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    later = places.join(first, ["a", "b"]).where(
        ~F.struct("id", "k").eqNullSafe(F.col("first"))
    )
    starts = later.groupBy("id", "th").agg(F.sort_array(F.collect_set("k")).alias("s"))
    begin = f"filter(s, (v, i) -> i = 0 OR v - get(s, i - 1) > {WINDOW})"
    end = f"filter(s, (v, i) -> i = size(s) - 1 OR get(s, i + 1) - v > {WINDOW})"
    spans = f"zip_with({begin}, {end}, (a, b) -> struct(a AS first, b + {WINDOW - 1} AS last))"
    return starts.select("id", "th", F.expr(spans).alias("spans"))


def dedup_lines(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``docs`` with text cut, and with n_lines, n_removed and removed_spans.

    Spans number the lines that hold a word, from 0. Columns n_lines, n_removed and
    removed_spans that are there already are replaced; with ``carry`` the caller's row stays
    whole, as a struct ``row`` beside them and the text.
    """
    scratch = Scratch(docs.sparkSession)
    new = ["n_lines", "n_removed", "removed_spans"]
    rows = carried(docs, [] if carry else new, doc_id="long", text="string")
    rows = rows.withColumn("th", F.xxhash64("text"))
    spans = scratch.keep(repeats(rows.select("doc_id", "text")))
    total = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    # Texts without a repeat need no shuffle: spans, or the ids that have some, are broadcast if few.
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
    named = spans.withColumnsRenamed({"id": "id2", "th": "th2"})
    if sum(total) <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(named), same, "left")
    elif total[0] <= MAX_BROADCAST:
        ids = F.broadcast(named.drop("spans"))
        joined = rows.join(ids, same, "left_semi").join(named, same, "left").unionByName(
            rows.join(ids, same, "left_anti"), allowMissingColumns=True
        )
    else:
        joined = rows.join(named, same, "left")
    gone = F.expr("flatten(transform(spans, s -> sequence(s.first, s.last)))")
    split = joined.withColumn("lines", F.expr("split(text, '\\n', -1)"))
    placed = split.withColumns(
        {"at": F.coalesce(_places("lines"), F.array()), "gone": F.coalesce(gone, F.array())}
    )
    cut = F.expr(
        "array_join(transform(array_except(sequence(0, size(lines) - 1),"
        " transform(gone, j -> at[j])), i -> lines[i]), '\\n')"
    )
    text = (
        F.when(F.size("gone") == 0, F.col("text"))
        .when(F.size("gone") >= F.size("at"), F.lit(""))
        .otherwise(cut)
    )
    done = placed.select(
        "row",
        text.alias("text"),
        F.size("at").alias("n_lines"),
        F.size("gone").alias("n_removed"),
        F.coalesce("spans", F.array()).alias("removed_spans"),
    )
    if carry:
        return done
    own = [c for c in docs.columns if c.lower() not in new]
    return done.select(
        *[F.col("text").alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in own], *new
    )


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
    return out.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        spans.alias("spans"),
        F.length("text").cast("long").alias("n_chars_left"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


ORACLE = r"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT rid, doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
         row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS j
  FROM raw WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]')),
win AS (
  SELECT rid, doc_id, j AS k, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS g
  FROM worded WINDOW w AS (PARTITION BY rid ORDER BY j)),
later AS (
  SELECT rid, k FROM (
    SELECT rid, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS o
    FROM win WHERE g IS NOT NULL) WHERE o > 1),
gone AS (SELECT DISTINCT rid, k + d AS j FROM later, (SELECT unnest([0, 1, 2]) AS d)),
flags AS (
  SELECT w.rid, w.pos, w.j, g.j IS NOT NULL AS cut
  FROM worded w LEFT JOIN gone g ON w.rid = g.rid AND w.j = g.j),
islands AS (
  SELECT rid, min(j) AS a, max(j) AS b FROM (
    SELECT rid, j, j - row_number() OVER (PARTITION BY rid ORDER BY j) AS i FROM flags WHERE cut)
  GROUP BY rid, i),
spans AS (SELECT rid, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM islands GROUP BY rid),
counts AS (SELECT rid, count(*) AS n_lines, sum(cut::INT) AS n_removed FROM flags GROUP BY rid),
left_over AS (
  SELECT r.rid, string_agg(r.line, chr(10) ORDER BY r.pos) AS text
  FROM raw r LEFT JOIN flags f ON r.rid = f.rid AND r.pos = f.pos WHERE NOT coalesce(f.cut, FALSE)
  GROUP BY r.rid),
res AS (
  SELECT d.rid, d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
         coalesce(s.spans, '') AS spans,
         CASE WHEN c.n_removed = c.n_lines THEN '' ELSE l.text END AS text
  FROM (SELECT DISTINCT rid, doc_id FROM raw) d
  LEFT JOIN counts c USING (rid) LEFT JOIN spans s USING (rid) LEFT JOIN left_over l USING (rid))
SELECT doc_id, n_lines, n_removed, spans, length(text)::BIGINT AS n_chars_left, md5(text) AS text_md5 FROM res
UNION ALL
SELECT doc_id, 0, 0, '', NULL, NULL FROM documents WHERE text IS NULL
"""
