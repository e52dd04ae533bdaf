"""From frames to spikes, markers and pooled values.

Two forms: over long tables (utt, t, ...) by windows, and over arrays within a row, which
need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def is_vowel(t: str) -> str:
    return f"substring({t}, 1, 1) IN ({_in(C.VOWELS)})"


def is_coda(phone: str, after: str, sources: list[str]) -> str:
    """SQL: a coda source before the end, a boundary or no vowel."""
    return f"({phone} IN ({_in(sources)}) AND NOT ({is_vowel(after)}))"


def is_dt(phone: str, after: str) -> str:
    return f"({phone} IN ({_in(C.STOPS)}) AND {after} IN ({_in(C.FRONT_CONTEXT)}))"


def tests(phone: str, after: str) -> dict[str, str]:
    return {
        "s": is_coda(phone, after, C.CODA_S),
        "r": is_coda(phone, after, C.CODA_R),
        "dt": is_dt(phone, after),
    }


def argmax(values: str) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def spikes_of(tokens: str, blank: str) -> Column:
    """array<struct<t, token>> of collapsed tokens: no blanks, no repeats of the one before."""
    # The array is bound once: a filter pushed below would else work it out for each item.
    one = (
        f"filter(transform(c, (x, i) -> IF(x <> '{blank}' AND NOT coalesce(get(c, i - 1) = x, false),"
        " struct(i AS t, x AS token), NULL)), s -> s IS NOT NULL)"
    )
    return F.expr(f"element_at(transform(array({tokens}), c -> {one}), 1)")


def markers_of(spikes: str) -> Column:
    """array<struct<marker, frame, phone, next_phone>> of spikes; the next of the last is ''."""
    near = "coalesce(get(c, k + 1).token, '')"
    pairs = f"transform(c, (s, k) -> struct(s.t AS frame, s.token AS phone, {near} AS next_phone))"
    each = ", ".join(
        f"IF({cond}, struct('{m}' AS marker, p.frame AS frame, p.phone AS phone, p.next_phone AS next_phone), NULL)"
        for m, cond in tests("p.phone", "p.next_phone").items()
    )
    return F.expr(f"flatten(element_at(transform(array({spikes}), c -> transform({pairs}, p -> array_compact(array({each})))), 1))")


def _text_pattern(marker: str) -> str:
    """A stretch up to and with the next run of a marker's phone: group 1 the phone, 2 the next
    phone. Runs are possessive, so no match begins within a run that fails."""
    blanks = "(?= *+"
    if marker == "dt":
        return rf"(?s)\G.*?([{''.join(C.STOPS)}])\1*+{blanks}([{''.join(C.FRONT_CONTEXT)}]))"
    phones = C.CODA_S if marker == "s" else C.CODA_R
    return rf"(?s)\G.*?([{''.join(phones)}])\1*+{blanks}(?![{C.VOWELS}])(.?))"


def markers_in_text(text: str, marker: str) -> tuple[Column, Column]:
    """array<struct<frame, phone, next_phone>> over a column __z, and that column, of a text whose characters are frames and whose
    spaces are blanks: what spikes_of and markers_of give, by three passes of one pattern. Only
    the markers become items, not every frame."""
    pattern = F.lit(_text_pattern(marker))
    part = lambda i: F.regexp_extract_all(F.col(text), pattern, i)
    zipped = F.arrays_zip(part(0).alias("s"), part(1).alias("p"), part(2).alias("n"))
    # A stretch ends with the run, which begins where the phone's repeats at its end do.
    state = "struct(CAST(array() AS array<struct<frame:int,phone:string,next_phone:string>>) AS found, 0 AS at)"
    lam = (
        "(a, z) -> struct(concat(a.found, array(struct(a.at + length(rtrim(z.p, z.s)) AS frame, z.p AS phone, z.n AS next_phone))) AS found,"
        " a.at + length(z.s) AS at)"
    )
    return F.expr(f"aggregate(__z, {state}, {lam}).found"), zipped


def text_markers(rows: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, frame, phone, next_phone) of rows of text; no shuffle."""
    found, zipped = markers_in_text(text, marker)
    return rows.select(key, zipped.alias("__z")).select(key, F.explode(found).alias("m")).select(key, "m.*")


def text_marker_counts(rows: DataFrame, key: str, text: str, markers: list[str]) -> DataFrame:
    """(key, marker, n) of texts with such markers; no shuffle."""
    counts = [F.struct(F.lit(m).alias("marker"), F.size(F.regexp_extract_all(F.col(text), F.lit(_text_pattern(m)), 1)).cast("long").alias("n")) for m in markers]
    return rows.select(key, F.explode(F.array(*counts)).alias("m")).select(key, "m.*").where("n > 0")


def collapse(frames: DataFrame, utt: str = "utt_id", t: str = "t", token: str = "id", blank=0) -> DataFrame:
    """Long form: frames that begin a run of a token other than blank."""
    before = F.lag(token).over(Window.partitionBy(utt).orderBy(t))
    kept = frames.withColumn("__before", before).where(
        (F.col(token) != blank) & (F.col("__before").isNull() | (F.col("__before") != F.col(token)))
    )
    return kept.drop("__before")


def next_token(spikes: DataFrame, utt: str = "utt_id", t: str = "t", token: str = "token") -> DataFrame:
    return spikes.withColumn("next_phone", F.lead(token, 1, "").over(Window.partitionBy(utt).orderBy(t)))


def marker_frames(spikes: DataFrame) -> DataFrame:
    """(utt_id, marker, frame, time_s, phone, next_phone) of spikes (utt_id, t, token)."""
    near = next_token(spikes)
    kinds = F.array_compact(
        F.array(*[F.when(F.expr(c), F.lit(m)) for m, c in tests("token", "next_phone").items()])
    )
    return near.select(
        "utt_id",
        F.explode(kinds).alias("marker"),
        F.col("t").alias("frame"),
        (F.col("t") * (C.FRAME_MS / 1000)).alias("time_s"),
        F.col("token").alias("phone"),
        "next_phone",
    )


def pool(frames: DataFrame, utt: str, t: str, values: list[str], half: int = C.POOL_HALF_WINDOW) -> DataFrame:
    """Means over the frames from t - half to t + half."""
    near = Window.partitionBy(utt).orderBy(t).rowsBetween(-half, half)
    return frames.select(utt, t, *[F.avg(v).over(near).alias(v) for v in values])


def softmax(values: str) -> Column:
    """Softmax of an array, shifted by its maximum."""
    shifted = f"transform({values}, x -> exp(CAST(x AS DOUBLE) - array_max({values})))"
    return F.expr(
        f"element_at(transform(array({shifted}), e -> transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b))), 1)"
    )


def frame_of(seconds: str, fps: float) -> Column:
    """Nearest frame, halves to even."""
    return F.bround(F.col(seconds) * fps, 0).cast("int")
