"""Benchmark decontamination over templates.

Words become template words: numbers, names and units turn into typed placeholders, so
that a question with other numbers, names or units has the same template. They also
become caseless words, the same but for names, which are lower-cased instead, so that a
copy in other case has the same caseless words. Windows of eight words of a benchmark item in
either form, one every few words, are hash-joined with windows of the texts. A window with
fewer than MIN_RICH words that are no placeholders says nothing about a text that has other
values, so it is joined by its bare words instead, and items that have one are indexed at
every word. Of the texts only those windows are formed that may meet one: where a text has
the longest word of an item's window (its anchor), at the anchor's place in the window.

For each match the longest common run around it, of words equal in either form, is worked
out; it counts if it has MIN_WORDS words, or the whole of a shorter item, and if its slots
are consistent: on each side, equal values stand where the other side has equal values.
Equal texts are consistent with themselves. Of an inconsistent run the longest consistent
part counts, as a copy may go on with words of the text's own. No part counts that has a
changed number, quantity or unit whose clash is with a slot outside the part: there the
item goes on, but as another question.

Template words: a word without punctuation at its ends, lower-cased. It is a number if
it has a digit and otherwise only digits and number marks, a quantity if letters follow
the digits, a unit if it is in UNITS, a name if it is written with a capital (so the
first word of a sentence is a name on both sides, which its slot check undoes).

Cases: null or empty texts match nothing, nor do items without words. An item shorter
than a window is one window of its own length. Repeated documents are found one by one,
and repeated items (same id and text) once; rows with one id and other text stay apart. A
run must have MIN_LITERAL words (a shorter item: all) that are equal on both sides, values of
slots included. Columns other than those named are ignored. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, carried, pick, small, words_of

WINDOW = 8
#: A common run counts from this many words on, or with the whole of a shorter item.
MIN_WORDS = 13
MIN_LITERAL = 5
#: Any run of MIN_WORDS words holds a window that starts at a multiple of STRIDE.
STRIDE = MIN_WORDS - WINDOW + 1
#: A window joins by its form if so many of its words are no placeholders, else by its bare words.
#: Of any MIN_WORDS words with MIN_LITERAL such words, some eight in a row have as many.
MIN_RICH = 3
#: Words of all items up to this number are broadcast; beyond, the join shuffles.
MAX_ITEM_WORDS = 1_000_000

# Units of measure and currency.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres"
    " mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l"
    " liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour"
    " hours day days week weeks month months year years dollar dollars euro euros cent cents"
    " percent degrees"
)


def _template(word: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS.split())
    bare = rf"regexp_replace({word}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}%]+$', '')"
    body = (
        r"CASE WHEN b RLIKE '^\\p{Ll}+$' THEN"
        f" CASE WHEN b IN ({units}) THEN '<unit>' ELSE b END"
        r" WHEN b RLIKE '^[0-9][0-9.,:/%]*$' THEN '<number>'"
        r" WHEN b RLIKE '^[0-9][0-9.,:/]*\\p{L}+$' THEN '<quantity>'"
        r" WHEN b RLIKE '^\\p{Lu}[\\p{L}\\p{M}\'’-]*$' THEN '<name>'"
        " ELSE lower(b) END"
    )
    # Most words are plain lower-case letters and need neither of the two rewrites.
    return (
        rf"CASE WHEN {word} RLIKE '^\\p{{Ll}}{{{{5,}}}}$' THEN"
        f" CASE WHEN {word} IN ({units}) THEN '<unit>' ELSE {word} END"
        f" ELSE element_at(transform(array({bare}), b -> {body}), 1) END"
    ).replace("{{5,}}", "{5,}")


def template_words(words: str) -> Column:
    return F.expr(f"transform({words}, w -> {_template('w')})")


def _bare(word: str) -> str:
    """The word as slots compare it: without punctuation at its ends, in one case."""
    return (
        rf"replace(lower(regexp_replace({word}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}%]+$', '')), 'ß', 'ss')"
    )


def caseless_words(words: str, tpl: str) -> Column:
    """Template words of any case: names are words, and units are units, in capitals too."""
    units = ", ".join(f"'{u}'" for u in UNITS.split())
    return F.expr(
        f"zip_with({tpl}, {words}, (t, w) -> CASE WHEN t = '<name>' THEN"
        f" element_at(transform(array({_bare('w')}), b -> IF(b IN ({units}), '<unit>', b)), 1)"
        f" WHEN t IN ({units}) THEN '<unit>' ELSE replace(t, 'ß', 'ss') END)"
    )


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Items with words: (item, item_id, b_words, b_tpl, b_cl)."""
    return (
        pick(benchmark, item_id="long", text="string")
        .distinct()
        .select(
            F.xxhash64("item_id", "text").alias("item"),
            "item_id",
            words_of(F.col("text")).alias("b_words"),
        )
        .where(F.size("b_words") > 0)
        .withColumn("b_tpl", template_words("b_words"))
        .withColumn("b_cl", caseless_words("b_words", "b_tpl"))
        .withColumn("b_bare", F.expr(f"transform(b_words, w -> {_bare('w')})"))
    )


def _rich(form: str) -> str:
    """SQL: the window says enough without its values. Short windows need their whole share."""
    return f"size(filter({form}, x -> x NOT LIKE '<%>')) >= least({MIN_RICH}, size({form}))"


def _key(kind: str, form: str) -> str:
    return f"xxhash64('{kind}', array_join({form}, ' '))"


def item_windows(items: DataFrame) -> DataFrame:
    """(hash, item, at, n_item, anchor, place, n, kind) of the items' windows.

    Kinds: t template, c caseless, b bare words. ``place`` is the anchor's in the window.
    """
    n = f"least({WINDOW}, size(b_words))"
    form = lambda f: f"slice({f}, at + 1, n)"
    at_all = items.withColumn("n", F.expr(n)).withColumn("at", F.explode(F.expr("sequence(0, size(b_words) - n)")))
    poor = f"NOT ({_rich(form('b_tpl'))}) OR NOT ({_rich(form('b_cl'))})"
    strided = f"at % {STRIDE} = 0 OR at = size(b_words) - n"
    # An item all of whose strided windows are rich needs no others.
    marked = at_all.withColumn("poor", F.expr(f"({strided}) AND ({poor})"))
    dense = marked.where("poor").select("item").distinct().withColumn("dense", F.lit(True))
    marked = marked.join(dense, "item", "left").where(F.expr(f"dense OR {strided}"))
    anchor = lambda ok: (
        "array_max(filter(transform(sequence(0, n - 1), i ->"
        f" struct(length(b_bare[at + i]) AS l, b_bare[at + i] AS anchor, i AS place, {ok} AS ok)), s -> s.ok))"
    )
    kinds = []
    for kind, f in (("t", "b_tpl"), ("c", "b_cl")):
        rich = _rich(form(f))
        kinds.append(f"IF({rich}, struct('{kind}' AS kind, {_key('f', form(f))} AS hash, {anchor(f'{f}[at + i] NOT LIKE {chr(39)}<%>{chr(39)}')} AS a), NULL)")
        kinds.append(f"IF({rich}, NULL, struct('b' AS kind, {_key('b', form('b_bare'))} AS hash, {anchor('true')} AS a))")
    found = marked.withColumn("w", F.explode(F.expr(f"array_compact(array({', '.join(kinds)}))")))
    return found.select(
        "w.hash", "item", "at", F.size("b_words").alias("n_item"), "w.a.anchor", "w.a.place", "n", "w.kind"
    ).distinct()


def _consistent_parts(sl: str, n: str) -> str:
    """Longest parts [p, q) of a run of n words whose slots (i, kind, b, d) are consistent.

    A consistent run is one part. Otherwise a part starts behind the last slot that
    clashes with one in it, and ends before the first that does.
    """
    clash = "x.kind = y.kind AND (x.b = y.b) <> (x.d = y.d)"
    whole = f"array(struct(0 AS p, {n} AS q))"
    pairs = f"array_distinct(transform({sl}, s -> struct(s.kind, s.b, s.d)))"
    one = lambda side: f"size({pairs}) = size(array_distinct(transform({sl}, s -> struct(s.kind, s.{side}))))"
    lows = (
        f"filter(transform({sl}, y -> struct(y.i AS j, coalesce(array_max(transform("
        f"filter({sl}, x -> x.i < y.i AND {clash}), x -> x.i)), -1) + 1 AS low)), c -> c.low > 0)"
    )
    state = "struct(acc.parts AS parts, acc.p AS p)"
    parts = (
        f"aggregate({lows}, struct(CAST(array() AS array<struct<p:int,q:int>>) AS parts, 0 AS p), (acc, c) ->"
        f" IF(c.low > acc.p, struct(concat(acc.parts, array(struct(acc.p AS p, c.j AS q))) AS parts, c.low AS p), {state}),"
        f" acc -> concat(acc.parts, array(struct(acc.p AS p, {n} AS q))))"
    )
    changed = (
        f"exists({sl}, x -> x.i >= r.p AND x.i < r.q AND x.b <> x.d AND x.kind <> '<name>'"
        f" AND exists({sl}, y -> (y.i < r.p OR y.i >= r.q) AND {clash}))"
    )
    return f"CASE WHEN {one('b')} AND {one('d')} THEN {whole} ELSE filter({parts}, r -> NOT {changed}) END"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: where, how long, and if slots differ.

    Columns: doc_id, text_hash, item_id, doc_start (word, from 0), item_start, n_words,
    reworded (true if some slot has another value than in the item).
    """
    scratch = Scratch(docs.sparkSession)
    items = scratch.keep(benchmark_items(benchmark))
    windows = scratch.keep(item_windows(items))
    anchors = small(windows.select("anchor", "place", "n", "kind").distinct())

    rows = pick(docs, doc_id="long", text="string").where(F.col("text").isNotNull())
    worded = rows.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    # Every word of a text is looked up among the anchors, of which each has WINDOW places at most.
    plain = r"CASE WHEN w RLIKE '^\\p{Ll}+$' THEN replace(w, 'ß', 'ss') ELSE " + _bare("w") + " END"
    spots = worded.select("doc_id", "th", "words", F.posexplode("words").alias("pos", "w"))
    spots = spots.select("doc_id", "th", "words", "pos", F.expr(plain).alias("anchor")).join(anchors, "anchor")
    spots = spots.withColumn("at_doc", F.col("pos") - F.col("place"))
    spots = spots.where((F.col("at_doc") >= 0) & (F.col("at_doc") + F.col("n") <= F.size("words")))
    cut = spots.select("doc_id", "th", "at_doc", "kind", F.expr("slice(words, at_doc + 1, n)").alias("words"))
    cut = cut.withColumn("t", F.when(F.col("kind") != "b", template_words("words")))
    form = F.expr(
        f"CASE kind WHEN 't' THEN {_key('f', 't')} WHEN 'c' THEN {_key('f', 'c')}"
        f" ELSE {_key('b', 'transform(words, w -> ' + _bare('w') + ')')} END"
    )
    cut = cut.withColumn("c", F.when(F.col("kind") == "c", caseless_words("words", "t")))
    found = cut.select("doc_id", "th", "at_doc", form.alias("hash"))
    # One row for each document, item and shift, however many windows met.
    met = (
        found.join(small(windows.select("hash", "item", "at", "n_item").distinct()), "hash")
        .select("doc_id", "th", "item", "n_item", (F.col("at_doc") - F.col("at")).alias("shift"), "at")
        .groupBy("doc_id", "th", "item", "n_item", "shift")
        .agg(F.sort_array(F.collect_set("at")).alias("ats"))
    )
    met = scratch.keep(met)
    # Only texts in which a window met come along, and of these the words beside the item's.
    texts = worded.withColumnsRenamed({"doc_id": "id", "th": "h"})
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))
    texts = texts.join(small(met.select("doc_id", "th").distinct()), same, "left_semi")
    there = texts.join(met, same).select(
        "doc_id", "th", "item", "shift", "ats", F.least("shift", F.lit(0)).alias("off"),
        F.expr("slice(words, greatest(shift, 0) + 1, greatest(n_item + least(shift, 0), 0))").alias("words"),
    ).distinct()
    there = there.withColumn("t", template_words("words")).withColumn("c", caseless_words("words", "t"))
    n_words = items.agg(F.coalesce(F.sum(F.size("b_words")), F.lit(0))).first()[0]
    if n_words <= MAX_ITEM_WORDS:
        pairs = there.join(F.broadcast(items), "item")
    else:
        times = met.groupBy("item").agg(F.count("*").alias("times"))
        pairs = attach(there, items.join(times, "item"), ["item"], "times")
    # Places of the item at which the words are equal in either form, shift applied.
    pairs = pairs.withColumn(
        "eq",
        F.expr(
            "transform(sequence(0, size(b_tpl) - 1), j -> coalesce(get(t, j + off) = b_tpl[j]"
            " OR get(c, j + off) = b_cl[j], false))"
        ),
    ).withColumn("at", F.explode("ats"))
    stop = F.expr(
        "coalesce(get(filter(transform(eq, (e, j) -> IF(e, NULL, j)), j -> j > at), 0), size(eq))"
    )
    start = F.expr(
        "coalesce(array_max(filter(transform(eq, (e, j) -> IF(e, NULL, j)), j -> j < at)), -1) + 1"
    )
    # Windows of one run give one run.
    runs = pairs.withColumns({"a": start, "z": stop}).drop("at", "ats").where("z > a")
    # The first word of a sentence is no name where both sides have the same word.
    slots = F.expr(
        "transform(sequence(a, z - 1), j -> struct(IF(t[j + off] = b_tpl[j], b_tpl[j], b_cl[j]) AS kind,"
        f" b_bare[j] AS b, {_bare('words[j + off]')} AS d))"
    )
    enough = F.col("z") - F.col("a") >= F.least(F.lit(MIN_WORDS), F.size("b_tpl"))
    runs = runs.where(enough).withColumn("all", slots)
    # Only the whole run, if that is consistent; otherwise parts, from the run's own start.
    runs = runs.withColumn(
        "sl", F.expr("filter(transform(all, (s, i) -> struct(i, s.kind, s.b, s.d)), s -> s.kind LIKE '<%>')")
    )
    runs = runs.withColumn("part", F.explode(F.expr(_consistent_parts("sl", "size(all)"))))
    runs = runs.select(
        "doc_id", "th", "item_id", "shift", "b_tpl",
        F.expr("slice(all, part.p + 1, part.q - part.p)").alias("all"),
        (F.col("a") + F.col("part.p")).alias("a"), (F.col("a") + F.col("part.q")).alias("z"),
    ).where(enough)
    literal = F.expr("size(filter(all, s -> s.b = s.d))")
    good = runs.where(literal >= F.least(F.lit(MIN_LITERAL), F.size("b_tpl")))
    return (
        good.select(
            "doc_id", "th", "item_id",
            F.struct(
                (F.col("z") - F.col("a")).cast("long").alias("n_words"),
                (-F.col("a") - F.col("shift")).cast("long").alias("neg_start"),
                F.col("a").cast("long").alias("item_start"),
                F.expr("exists(all, s -> s.kind LIKE '<%>' AND s.b <> s.d)").alias("reworded"),
            ).alias("best"),
        )
        .groupBy("doc_id", "th", "item_id")
        .agg(F.max("best").alias("best"))
        .select(
            "doc_id", F.col("th").alias("text_hash"), "item_id",
            (-F.col("best.neg_start")).alias("doc_start"), "best.item_start", "best.n_words", "best.reworded",
        )
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in whose text an item was found; columns unchanged."""
    leaks = find_leaks(docs, benchmark).select(
        F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_th")
    )
    rows = carried(docs, [], doc_id="long", text="string")
    same = F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.xxhash64("text") == F.col("__leak_th"))
    return rows.join(small(Scratch(docs.sparkSession).keep(leaks.distinct())), same, "left_anti").select("row.*")


def op5_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark).drop("text_hash")
