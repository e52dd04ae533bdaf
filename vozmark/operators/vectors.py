"""Speaker-level vectors from token and utterance rows, and array kernels in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def present(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def formant_vector(tokens: DataFrame, speaker: str, vowels: list[str] | None = None) -> DataFrame:
    """(speaker, vector, n_tokens): means of F1-F3 by vowel, mean and population deviation of
    each over all tokens, and of the F0 that are present; NaN where there is nothing."""
    vowels = vowels or C.CANONICAL_VOWELS
    nan = F.lit(float("nan"))
    parts = [F.avg(F.when(F.col("vowel") == v, F.col(f))) for v in vowels for f in ("f1", "f2", "f3")]
    parts += [agg(f) for f in ("f1", "f2", "f3") for agg in (F.avg, F.stddev_pop)]
    f0 = F.when(present(F.col("f0")), F.col("f0"))
    parts += [F.avg(f0), F.stddev_pop(f0)]
    vector = F.array(*[F.coalesce(p, nan) for p in parts]).cast("array<float>")
    return tokens.groupBy(speaker).agg(vector.alias("vector"), F.count("*").alias("n_tokens"))


def mean_of_means(rows: DataFrame, speaker: str, utt: str, value: str) -> DataFrame:
    """Unweighted mean of utterance means; never a mean over all frames."""
    each = rows.groupBy(speaker, utt).agg(F.avg(value).alias("m"))
    return each.groupBy(speaker).agg(F.avg("m").alias("mean"), F.count("*").alias("n_utterances"))


def element_means(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value): element-wise means; partial sums are one row a key and position."""
    items = rows.select(key, F.posexplode(vector).alias("pos", "x"))
    return items.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise means as one array for each key."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return element_means(rows, key, vector).groupBy(key).agg(F.transform(pairs, lambda s: s["value"]).alias("vector"))


def pad_truncate(vector: Column, size: int) -> Column:
    """First ``size`` items, NaN as 0, zeros behind."""
    clean = F.transform(F.slice(vector, 1, size), lambda x: F.nanvl(x, F.lit(0.0).cast("float")))
    return F.concat(clean, F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size(clean)))


def log_ratio(high: Column, low: Column) -> Column:
    return F.log10((high + 1e-12) / (low + 1e-12))


def power_moments(power: str, low: tuple[int, int], high: tuple[int, int]) -> dict[str, Column]:
    """Centroid, variance, skewness, excess kurtosis, first peak and log band ratio of a power
    array, in bins; bands are bins from and to, both included."""
    total = lambda body: F.expr(f"aggregate(transform({power}, (x, i) -> {body}), 0D, (a, b) -> a + b)")
    energy, first = total("x"), total("x * i")
    m1 = first / energy
    raw = {k: total(f"x * pow(i, {k})") / energy for k in (2, 3, 4)}
    m2 = raw[2] - m1 * m1
    m3 = raw[3] - 3 * m1 * raw[2] + 2 * F.pow(m1, 3)
    m4 = raw[4] - 4 * m1 * raw[3] + 6 * m1 * m1 * raw[2] - 3 * F.pow(m1, 4)
    safe = F.greatest(m2, F.lit(1e-9))
    band = lambda b: total(f"IF(i BETWEEN {b[0]} AND {b[1]}, x, 0D)")
    return {
        "m1": m1,
        "variance": m2,
        "skew": m3 / F.pow(safe, 1.5),
        "kurtosis": m4 / F.pow(safe, 2) - 3,
        "peak": (F.array_position(power, F.array_max(power)) - 1).cast("int"),
        "ratio": log_ratio(band(high), band(low)),
    }


def dft_power(wave: str, size: int) -> Column:
    """array<struct<k, power>> of the bins 0 to size / 2 of a wave of ``size`` samples."""
    part = lambda f: (
        f"pow(aggregate(transform({wave}, (x, n) -> CAST(x AS DOUBLE) * {f}(2 * pi() * k * n / {size})), 0D, (a, b) -> a + b), 2)"
    )
    return F.expr(f"transform(sequence(0, {size // 2}), k -> struct(k, {part('cos')} + {part('sin')} AS power))")
