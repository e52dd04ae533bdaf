"""Mixing to target weights with soft domain membership.

A classifier learned from the labelled table gives every document posteriors over domains
(combinations of the labels quality and toxic). Document rates, how often a document is
to be drawn, are fitted by projected gradient steps on least squares: each step sums the
expected tokens of every domain over all documents, and moves every rate against the
domains' errors, never below zero. Rates start at one. Steps are taken in variables scaled
by the documents' tokens, so that a long document moves no further than a short one, and
errors are weighed by the inverse of the domains' Gram matrix, so that all curvatures are
at most one and steps of full length are safe. A small ridge holds rates near one.

The classifier is Gaussian naive Bayes over a few measures of the text, its class means
and variances being sums over all labelled documents.

Cases: null and empty texts have no tokens, prior posteriors, and a rate like any other.
A null quality or toxic label is no label; of several rows for one doc_id the highest
labels hold. Repeated rows and null doc_ids are rated one by one. A domain without labelled
documents gets no posterior and its target is shared among the others; without labels at
all there is one domain and all rates are one. Columns other than those named are ignored.
Everything is DataFrame operations; per-domain sums alone reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, pick, words_of

# Weights of the expected tokens after mixing, by domain quality_toxic.
TARGETS = {"q1_t0": 0.82, "q0_t0": 0.09, "q1_t1": 0.08, "q0_t1": 0.01}
TOLERANCE = 2e-3
#: Steps end if the worst error hasn't fallen by the share STALL for PATIENCE steps. Rates are
#: written every FOLD steps. MAX_STEPS is an error.
STALL, PATIENCE, FOLD, MAX_STEPS = 1e-3, 12, 20, 2000
#: Weight of the squared distance of rates from one, which keeps rates apart from extremes
#: where targets cannot be met.
RIDGE = 1e-4
#: Gaussian posteriors are flattened by this power, as the measures depend on each other.
SHARPNESS = 0.5
MEASURES = ["length", "symbols", "shouts", "tables", "capitals", "repeats", "insults"]
# Insults counted as a measure.
_INSULTS = (
    "idiot|moron|stupid|loser|scum|trash|pathetic|worthless|disgusting|clown|dumm|trottel|abschaum"
    "|basura|escoria|imb[eé]cil|crétin|connard|ordure"
)


def measured(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, n_tokens, one double for each measure) of each row; with ``carry`` also the whole row."""
    read = {"doc_id": "long", "text": "string"}
    rows = carried(docs, [], **read) if carry else pick(docs, **read)
    rows = rows.withColumn("words", words_of(F.col("text")))
    n = F.greatest(F.size("words"), F.lit(1))
    text = F.coalesce(F.col("text"), F.lit(""))
    per_word = lambda c: F.log1p(10.0 * c / n)
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return rows.select(
        "doc_id",
        *(["row"] if carry else []),
        F.size("words").cast("double").alias("n_tokens"),
        F.log1p(F.size("words").cast("double")).alias("length"),
        per_word(F.regexp_count(text, F.lit(r"[#*$%&<>]"))).alias("symbols"),
        per_word(F.regexp_count(text, F.lit(r"!!"))).alias("shouts"),
        per_word(F.regexp_count(text, F.lit(r" \| "))).alias("tables"),
        per_word(upper).alias("capitals"),
        (1 - F.size(F.array_distinct("words")) / n).cast("double").alias("repeats"),
        per_word(F.regexp_count(text, F.lit(rf"(?i)\b(?:{_INSULTS})"))).alias("insults"),
    )


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents."""
    return (
        pick(labels, doc_id="long", quality="int", toxic="int")
        .where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        .select("doc_id", F.concat(F.lit("q"), F.col("q"), F.lit("_t"), F.col("t")).alias("domain"))
    )


def learn(rows: DataFrame, labelled: DataFrame) -> dict[str, dict]:
    """Prior, and mean and variance of each measure, by domain."""
    stats = [F.avg(m).alias(f"m_{m}") for m in MEASURES] + [F.var_pop(m).alias(f"v_{m}") for m in MEASURES]
    by = rows.join(labelled, "doc_id").groupBy("domain").agg(F.count("*").alias("n"), *stats).collect()
    total = sum(r["n"] for r in by)
    floor = 1e-2
    return {
        r["domain"]: {
            "prior": r["n"] / total,
            "mean": [r[f"m_{m}"] for m in MEASURES],
            "var": [max(floor, r[f"v_{m}"] or 0.0) for m in MEASURES],
        }
        for r in sorted(by, key=lambda r: r["domain"])
    }


def posteriors(model: dict[str, dict]) -> list[Column]:
    """One column p_<domain> for each domain, summing to one."""
    if not model:
        return [F.lit(1.0).alias("p_all")]
    scores = []
    for d in model.values():
        s = F.lit(math.log(d["prior"]))
        for m, mean, var in zip(MEASURES, d["mean"], d["var"], strict=True):
            s = s - SHARPNESS * (F.pow(F.col(m) - mean, 2) / (2 * var) + 0.5 * math.log(var))
        scores.append(s)
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    total = sum(powers[1:], powers[0])
    return [(p / total).alias(f"p_{name}") for name, p in zip(model, powers, strict=True)]


def fit_rates(
    rows: DataFrame, targets: dict[str, float], scratch: Scratch, tolerance: float = TOLERANCE
) -> tuple[Column, list[float]]:
    """The rate as a column over p_<domain>, and the relative errors left.

    rows: n_tokens and p_<domain> for every domain. A step is K numbers, so a rate is a fold of
    the steps over a document's posteriors and needs no join; while steps go on, rates so far are
    written every FOLD steps. Steps
    end when all errors are below the tolerance, or when the worst one improves no more: then no
    nonnegative rates near one meet the targets.
    """
    names = [c for c in rows.columns if c.startswith("p_")]
    k = len(names)
    n = F.col("n_tokens")
    gram = [F.coalesce(F.sum(n * F.col(a) * F.col(b)), F.lit(0.0)) for a in names for b in names]
    sums = [F.coalesce(F.sum(n * F.col(a)), F.lit(0.0)) for a in names]
    got = list(rows.agg(*gram, *sums).first())
    g = [got[i * k : (i + 1) * k] for i in range(k)]
    now = got[k * k :]
    total = sum(now)
    wanted = [targets.get(c[2:], 0.0) for c in names]
    share = sum(wanted)
    goal = [total * (w / share if share else 1 / k) for w in wanted]
    if total <= 0:
        return F.lit(1.0), [0.0] * k
    # With the errors weighed by the inverse Gram matrix the largest curvature is one. Documents
    # at rate 0 don't move, so the matrix over the others is tried first, and that over all
    # after a step that made the worst error larger.
    safe = lambda g: np.linalg.pinv(np.array(g).reshape(k, k) + 1e-9 * total * np.eye(k))
    weigh = every = safe(g)
    rows = rows.withColumn("r", F.lit(1.0))

    def rate(steps: list[list[float]], start: Column) -> Column:
        if not steps:
            return start
        folded = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
        move = lambda s: sum((s[i] * F.col(c) for i, c in enumerate(names)), F.lit(0.0))
        return F.aggregate(folded, start, lambda r, s: F.greatest(F.lit(0.0), r - move(s) - RIDGE * (r - 1)))

    steps: list[list[float]] = []
    written: DataFrame | None = None
    done, r = 0, F.col("r")  # steps that the written rates hold
    best, since, last = math.inf, 0, math.inf
    for _ in range(MAX_STEPS):
        errors = [(a - b) / b if b > 0 else a / total for a, b in zip(now, goal, strict=True)]
        worst = max(abs(e) for e in errors)
        if worst < tolerance:
            break
        best, since = (worst, 0) if worst < best * (1 - STALL) else (best, since + 1)
        if since >= PATIENCE:
            break
        weigh, last = (weigh if worst < last else every), worst
        steps.append((weigh @ (np.array(now) - np.array(goal))).tolist())
        if len(steps) - done == FOLD:
            rows = scratch.keep(rows.select("n_tokens", *names, rate(steps[done:], r).alias("r")))
            done = len(steps)
            if written is not None:
                scratch.drop(written)
            written = rows
        drawn = rows.select(*names, "n_tokens", rate(steps[done:], r).alias("now"))
        sums = [F.coalesce(F.sum(F.col("now") * n * F.col(c)), F.lit(0.0)) for c in names]
        moving = [F.coalesce(F.sum(F.when(F.col("now") > 0, n * F.col(a) * F.col(b))), F.lit(0.0)) for a in names for b in names]
        got = list(drawn.agg(*sums, *moving).first())
        now, weigh = got[:k], safe(got[k:])
    else:
        raise RuntimeError(f"rates still improve after {MAX_STEPS} steps; errors are {errors}")
    return rate(steps, F.lit(1.0)), errors


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    learn_from: DataFrame | None = None,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, n_copies, target_error) of every row.

    n_copies draws the rate: its whole part, and one more with the chance of the rest, by a
    hash of the document. target_error is the worst relative error that the rates leave, the
    same in every row: above TOLERANCE if no nonnegative rates meet the targets. ``learn_from`` holds the labelled documents if docs do not. With
    ``carry`` the row itself comes along as a struct ``row``.
    """
    scratch = Scratch(docs.sparkSession)
    # Texts are measured once.
    seen = scratch.keep(measured(docs, carry))
    known = domains(labels)
    model = learn((seen if learn_from is None else measured(learn_from)).select("doc_id", *MEASURES), known)
    numbers = scratch.keep(seen.select("n_tokens", *posteriors(model)))
    names = [c for c in numbers.columns if c.startswith("p_")]
    rate, errors = fit_rates(numbers, TARGETS if targets is None else targets, scratch)
    scratch.drop(numbers)
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1_000_000)) / 1_000_000.0
    rated = seen.select("doc_id", *(["row"] if carry else []), "n_tokens", *posteriors(model)).withColumn("rate", rate)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return rated.select(
        "doc_id",
        *(["row"] if carry else []),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        *names,
        "rate",
        copies.cast("long").alias("n_copies"),
        F.lit(float(max((abs(e) for e in errors), default=0.0))).alias("target_error"),
    )


def op3_mixing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, labels)
