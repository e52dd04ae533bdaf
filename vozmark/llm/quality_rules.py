"""Quality rules: one table of thresholds, compiled into one Spark projection.

Each rule is a row of RULES: a measure over another, and the range it must lie in. The
projection holds only built-in functions; nothing is shuffled.

Cases: null text has no words, no lines and no symbols, so it fails the base rule, as do
empty texts. Repeated rows and repeated or null doc_ids are judged one by one. Columns
other than those named are ignored. A measure over zero is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, pick, quoted, words_of

#: Windows double from one word, so their length is a power of two.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is it that this for on with as was are be at by from or an not he",
    "fr": "le la les de des du un une et en est que qui dans pour par sur au pas ne ce avec il elle",
    "de": "der die das und in von zu den mit ist nicht ein eine auf für im dem des sich auch es an",
    "es": "el la los las de del y que en un una no se con por para su al es lo como más o pero",
}

#: (rule, measure, over, least, most): the measure over the other must lie within the range.
RULES: list[tuple[str, str, str, float | None, float | None]] = [
    ("word_length", "word_chars", "n_words", 1.5, 20.0),
    ("symbols", "n_symbols", "n_words", None, 0.1),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
]


MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
    "n_bullet_lines", "n_ellipsis_lines",
]


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str) -> str:
    """Words covered by windows that occur twice or more among the windows of ``words``.

    Windows become hashes; only if some hash repeats are hashes sorted with their places,
    so that places of one hash are neighbours, and the places kept that have a neighbour
    of the same hash. Each such place covers the words up to the next place, WINDOW at most.
    """
    # Hashes of 1 word, then of 2, 4 and 8, each from two of the ones before.
    hashes = f"transform({words}, w -> xxhash64(w))"
    for step in (1, 2, 4):
        zipped = f"zip_with(q, slice(q, {step + 1}, size(q)), (a, b) -> xxhash64(a, b))"
        hashes = _let(hashes, "q", zipped)
    hashes = f"slice({hashes}, 1, size({words}) - {WINDOW - 1})"
    # 43 bits of the hash before 21 of the place: longs sort far faster than structs. Full
    # hashes are compared before two neighbours count as the same window.
    pairs = f"sort_array(transform(h, (x, i) -> (x & {-1 << 21}L) | i))"
    same = f"coalesce(h[int(v & {(1 << 21) - 1}L)] = h[int(get(p, k {{}} 1) & {(1 << 21) - 1}L)], false)"
    twice = f"filter(p, (v, k) -> {same.format('-')} OR {same.format('+')})"
    places = f"array_sort(transform({_let(pairs, 'p', twice)}, v -> v & {(1 << 21) - 1}L))"
    # A text of more windows than 21 bits can count is sorted as structs.
    pairs = "array_sort(transform(h, (x, i) -> struct(x AS x, CAST(i AS BIGINT) AS i)))"
    twice = (
        "filter(p, (v, k) -> coalesce(get(p, k - 1).x = v.x, false)"
        " OR coalesce(get(p, k + 1).x = v.x, false))"
    )
    long_places = f"array_sort(transform({_let(pairs, 'p', twice)}, v -> v.i))"
    places = f"CASE WHEN size(h) < {1 << 21} THEN {places} ELSE {long_places} END"
    gaps = (
        "aggregate(transform(d, (v, k) ->"
        f" least({WINDOW}L, coalesce(CAST(get(d, k + 1) - v AS BIGINT), {WINDOW}L))),"
        " 0L, (a, b) -> a + b)"
    )
    covered = (
        f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {_let(places, 'd', gaps)} END"
    )
    return f"CASE WHEN size({words}) < {WINDOW + 1} THEN 0L ELSE {_let(hashes, 'h', covered)} END"


def measures() -> list[Column]:
    """Every measure a rule can name, of columns text, words and lines."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for v in STOP_WORDS.values() for w in v.split()}))
    exprs = {
        "n_words": "size(words)",
        "word_chars": "length(array_join(words, ''))",
        "n_symbols": "regexp_count(text, '[#*$%&|<>]')",
        "n_dup_lines": "size(lines) - size(array_distinct(lines))",
        "n_repeat_words": _repeat_words("words"),
        "n_stop_words": f"size(filter(words, w -> lower(w) IN ({stop})))",
        "n_lines": "size(lines)",
        "n_bullet_lines": r"size(filter(lines, l -> l RLIKE '^[ \\t]*[-*\u2022]'))",
        "n_ellipsis_lines": r"size(filter(lines, l -> l RLIKE '(\\.\\.\\.|\u2026)[ \\t]*$'))",
    }
    return [F.expr(e).cast("long").alias(k) for k, e in exprs.items()]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def verdict(rules=None) -> Column:
    """Names of the rules a row fails, from its measures."""
    failed = []
    for name, part, whole, least, most in RULES if rules is None else rules:
        ratio = F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
        bad = F.lit(False)
        if least is not None:
            bad = bad | (ratio < least)
        if most is not None:
            bad = bad | (ratio > most)
        failed.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*failed))


def apply_rules(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """``docs`` with measures, base_failed, failed_rules and kept.

    Columns of these names that are there already are replaced.
    """
    new = ["base_failed", "failed_rules", "kept", *MEASURES]
    split = carried(docs, new, **{text: "string"}).select(
        "row",
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        words_of(F.col(text)).alias("words"),
        F.expr(rf"filter(split(coalesce({text}, ''), '\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    measured = split.select("row", *measures())
    judged = measured.withColumn("base_failed", base_failed()).withColumn("failed_rules", verdict(rules))
    own = [c for c in docs.columns if c.lower() not in new]
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select(
        *[F.col(f"row.{quoted(c)}") for c in own], *MEASURES, "base_failed", "failed_rules", "kept"
    )


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    return apply_rules(pick(docs, doc_id="long", text="string")).drop("text", "failed_rules")


# The same in DuckDB: stop words and thresholds come from the tables above.
def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for v in STOP_WORDS.values() for w in v.split()}))
    bad = []
    for _, part, whole, least, most in RULES:
        ratio = f"(CASE WHEN {whole} = 0 THEN 0.0 ELSE {part}::DOUBLE / {whole} END)"
        bad += [f"{ratio} < {least}"] if least is not None else []
        bad += [f"{ratio} > {most}"] if most is not None else []
    ws = r"[ \t\n\x0b\f\r]"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^ \t\n\x0b\f\r]')) AS lines
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '{ws}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda w: lower(w) IN ({stop})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '^[ \t]*[-*\u2022]')))::BIGINT AS n_bullet_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|\u2026)[ \t]*$')))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND NOT ({" OR ".join(bad)})) AS kept FROM b
""".replace("\\u2022", "\u2022").replace("\\u2026", "\u2026")
