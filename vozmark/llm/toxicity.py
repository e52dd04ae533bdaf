"""Toxicity by weak supervision.

Many voters look at a text, each on its own: every term of a learned lexicon (words and word
beginnings that labelled rows show to go with toxic texts) is one, and so are fixed lexicons
by language and topic, for the words that no learned term covers, and patterns. A generative
label model says how votes come about: given the label, a voter's vote depends on the vote
of one other voter at most (a forest over the voters), so that dependent voters don't count
their common evidence twice. EM estimates the voters' accuracies and these dependences without
labels, and gives every fitted text a posterior label. A linear classifier over the votes is
trained on the posteriors and scores every whole text.

Learning reads labels only of rows whose crc32(doc_id) mod 4 is not 2, of which at most
MAX_LABELLED, first by a hash of their id, are used: to learn the lexicon and the share of
toxic texts, and as that voter. Scores depend on the text alone.

Cases: null and empty texts have no votes and get the score of a text without any. A null
label is no label; of several labels for one doc_id the highest holds, of several texts the
first in order. Repeated rows and null doc_ids are scored one by one. Without labels of both
kinds only the fixed lexicons and the patterns vote. Columns other than those named are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, held_out, pick, quoted

#: Bound of what is fitted: labelled rows.
MAX_LABELLED = 20_000
#: A term is learned from this many toxic rows on, at this z-score and precision.
MIN_TOXIC, MIN_Z, MIN_PRECISION = 5, 8.0, 0.5
STEMS = (4, 5, 6, 7)
#: So many learned terms are sought for every toxic row.
COVER = 3
THRESHOLD = 0.3
#: Nats of mutual information given the label from which on two voters are dependent.
MIN_DEPENDENCE = 0.005

# Common insults by language and topic.
LEXICONS = {
    "en_wits": "idiot idiots moron morons stupid dumb imbecile clown clowns fool fools",
    "en_worth": "loser losers scum trash garbage pathetic worthless disgusting vermin filth",
    "fr_wits": "idiot idiote crétin imbécile abruti stupide débile",
    "fr_worth": "connard ordure minable salaud déchet racaille",
    "de_wits": "idiot idioten dummkopf trottel dumm blödmann",
    "de_worth": "abschaum widerlich wertlos gesindel dreck",
    "es_wits": "idiota idiotas imbécil estúpido estúpida tonto",
    "es_worth": "basura escoria inútil asqueroso patético",
}

# What each pattern looks for, in the text as it is.
PATTERNS = {
    "address": r"(?i)\b(?:you are|you're|du bist|tu es|eres) (?:an? |ein(?:e)? |une? |una? )?(?:\p{L}+ ){0,2}\p{L}+",
    "command": r"(?i)\b(?:shut up|get lost|go away|halt die|tais-toi|cállate)\b",
    "masked": r"(?i)\b\p{L}[*#@$]{2,}\p{L}*\b",
    "threat": r"(?i)\b(?:i will|i'll|ich werde|je vais|voy a) (?:\p{L}+ ){0,2}(?:hurt|kill|find|töten|tuer|matar)\b",
    "shout": r"!{3,}",
    "capitals": r"\b\p{Lu}{4,}(?:\s+\p{Lu}{3,}){2,}",
    "wish": r"(?i)\b(?:i hate|hope you|ich hasse|je déteste|odio a)\b",
}


def normal(text: str | None) -> str:
    """Letters in lower case, words between single spaces."""
    import regex

    return " " + regex.sub(r"[^\p{L}]+", " ", (text or "").lower()).strip() + " "


@dataclass
class Model:
    """Terms (a beginning ``" x"`` or a word ``" x "``), every voter's weight and accuracy, and
    the pairs (voter, voter it depends on, correlation given the label)."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0
    accuracies: list[float] = field(default_factory=list)
    dependences: list[tuple[str, str, float]] = field(default_factory=list)


def voter_names(terms: list[str]) -> list[str]:
    return [f"term:{t}" for t in terms] + [f"lexicon:{k}" for k in LEXICONS] + [f"pattern:{k}" for k in PATTERNS]


class Reader:
    """Casts the votes for texts."""

    def __init__(self, terms: list[str]):
        import ahocorasick
        import regex

        # Each string looked for has the voters that it makes vote.
        wanted: dict[str, list[int]] = {t: [i] for i, t in enumerate(terms)}
        for k, words in enumerate(LEXICONS.values(), len(terms)):
            for word in words.split():
                if not any(f" {word} ".startswith(t) for t in terms):
                    wanted.setdefault(f" {word} ", []).append(k)
        self.finder = ahocorasick.Automaton()
        for text, voters in wanted.items():
            self.finder.add_word(text, voters)
        self.finder.make_automaton()
        self.first_pattern = len(terms) + len(LEXICONS)
        self.patterns = [regex.compile(p) for p in PATTERNS.values()]

    def read(self, text: str | None) -> list[int]:
        """The voters that vote for toxic, ascending; the others abstain."""
        found: set[int] = set()
        for _, voters in self.finder.iter(normal(text)):
            found.update(voters)
        if text:
            found.update(i for i, p in enumerate(self.patterns, self.first_pattern) if p.search(text))
        return sorted(found)


def _forest(codes: np.ndarray, post: np.ndarray, kinds: int) -> tuple[list[int], np.ndarray]:
    """Each voter's parent (-1: none) in the forest of the strongest dependences given the
    label, and the mutual informations."""
    n, m = codes.shape
    hot = (codes[:, :, None] == np.arange(kinds)).reshape(n, m * kinds).astype(np.float64)
    info = np.zeros((m, m))
    for p in (post, 1 - post):
        total = p.sum()
        if total < 2:
            continue
        joint = ((hot * p[:, None]).T @ hot / total).reshape(m, kinds, m, kinds)
        single = np.einsum("akak->ak", joint)
        apart = single[:, :, None, None] * single[None, None, :, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(joint > 1e-12, joint * np.log(joint / apart), 0.0)
        info += part.sum((1, 3)) * total / n
    np.fill_diagonal(info, 0)
    parent = [-1] * m
    # Prim's walk from each voter that no tree holds yet, strongest dependences first.
    left = set(range(m))
    while left:
        root = max(left, key=lambda i: (info[i].sum(), -i))
        left.discard(root)
        queue = [(-info[root, j], j, root) for j in left if info[root, j] >= MIN_DEPENDENCE]
        heapq.heapify(queue)
        while queue:
            _, j, by = heapq.heappop(queue)
            if j not in left:
                continue
            left.discard(j)
            parent[j] = by
            for k in left:
                if info[j, k] >= MIN_DEPENDENCE:
                    heapq.heappush(queue, (-info[j, k], k, j))
    return parent, info


def label_model(votes: np.ndarray, prior: float, labels: np.ndarray | None = None, rounds: int = 60):
    """Posterior labels, accuracies and dependences from votes (rows x voters; 1, 0 or -1).

    P(votes, y) = P(y) * product over voters of P(vote | y, vote of the voter's parent). EM
    starts from votes that are right four times in five; the forest of parents is chosen from
    those first posteriors, so that a dependent pair is not taken for the label, and anew
    every ten rounds. ``labels`` (1, 0 or
    -1) are one voter more, right nineteen times in twenty at the start, without dependences;
    its accuracy comes last. Dependences are (voter, parent, correlation of their votes given the label).
    """
    own = votes.shape[1]
    if labels is not None:
        votes = np.column_stack([votes, labels])
    n, m = votes.shape
    codes = (1 - votes).astype(np.int64)  # 1, 0, -1 as 0, 1, 2
    rate = np.stack([(codes == k).mean(0) for k in range(3)], 1)
    lean = np.repeat([[4.0, 1.0, 0.25]], m, axis=0)
    lean[own:] = [19.0, 1.0, 1 / 19]
    base = np.log(prior / (1 - prior))
    parent = [-1] * m
    # log P(vote | y, parent's vote) of each voter: (y, parent's vote, vote)
    first = np.stack([rate / lean, rate * lean]) + 1e-3
    first /= first.sum(2, keepdims=True)
    table = np.repeat(np.log(first)[:, :, None, :], 3, axis=2).transpose(1, 0, 2, 3)
    post = np.full(n, prior)
    for step in range(rounds):
        score = np.full(n, base)
        for j in range(m):
            up = codes[:, parent[j]] if parent[j] >= 0 else np.zeros(n, np.int64)
            score += table[j, 1, up, codes[:, j]] - table[j, 0, up, codes[:, j]]
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if step % 10 == 0 and step < rounds - 10:
            parent[:own] = _forest(codes[:, :own], post, 3)[0]
        for j in range(m):
            up = codes[:, parent[j]] if parent[j] >= 0 else np.zeros(n, np.int64)
            for y, p in ((0, 1 - post), (1, post)):
                count = np.bincount(up * 3 + codes[:, j], weights=p, minlength=9).reshape(3, 3)
                # What a parent's vote was never seen with falls back on the vote's own share.
                alone = count.sum(0) + 0.5 * rate[j] + 1e-2
                alone /= alone.sum()
                table[j, y] = np.log((count + alone) / (count.sum(1, keepdims=True) + 1))
    active = np.abs(votes) > 0
    right = np.where(votes > 0, post[:, None], 1 - post[:, None])
    accuracy = (right * active).sum(0) / np.maximum(active.sum(0), 1)
    dependences = []
    for j, up in enumerate(parent):
        if up >= 0:
            both = 0.0
            for p in (post, 1 - post):
                total = max(p.sum(), 1e-9)
                a, b = votes[:, j] - p @ votes[:, j] / total, votes[:, up] - p @ votes[:, up] / total
                spread = np.sqrt((p @ a**2) * (p @ b**2))
                both += (p @ (a * b)) / spread * total / n if spread > 1e-12 else 0.0
            dependences.append((j, up, float(both)))
    return post, accuracy, dependences


def linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 40):
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + penalty * w
        curve = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], w[-1]


def operating_point(z: np.ndarray, toxic: np.ndarray) -> float:
    """What to add to log-odds so that THRESHOLD tells the posterior labels best (by F1), from
    the middle of the best gap between scores."""
    values, at = np.unique(z, return_inverse=True)
    if len(values) < 2 or not toxic.any():
        return 0.0
    hits = np.bincount(at, weights=toxic)[::-1].cumsum()[::-1]  # toxic rows from each value on
    rows = np.bincount(at)[::-1].cumsum()[::-1]
    f1 = 2 * hits / (rows + toxic.sum())
    best = 1 + int(np.argmax(f1[1:]))
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (values[best - 1] + values[best]) / 2)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most MAX_LABELLED learnable labelled documents."""
    known = (
        pick(labels, doc_id="long", toxic="int")
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    rows = pick(docs, doc_id="long", text="string")
    # At most MAX_LABELLED pairs of integers.
    return rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def learn_terms(rows: DataFrame, n_all: int, n_toxic: int) -> list[str]:
    """Words and word beginnings that go with toxic rows, most telling first. Their number is
    bounded by the words of the labelled rows, at MIN_TOXIC rows each."""
    base = n_toxic / n_all
    words = F.array_distinct(
        F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+", " ")), " ")
    )
    forms = [F.concat(F.lit(" "), F.col("w"), F.lit(" "))]
    forms += [
        F.when(F.length("w") > k, F.concat(F.lit(" "), F.substring("w", 1, k))) for k in STEMS
    ]
    terms = (
        rows.select("toxic", F.explode(words).alias("w"))
        .where(F.length("w") >= 3)
        .groupBy("w")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
        .select(F.explode(F.array_compact(F.array(*forms))).alias("term"), "n", "k")
        .groupBy("term")
        # A text with two words of one beginning counts twice: good enough to choose by.
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .where((F.col("k") >= MIN_TOXIC) & (F.col("k") >= MIN_PRECISION * F.col("n")))
        .withColumn("z", (F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base)))
        .where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "term")
    )
    return [r["term"] for r in terms.collect()]


def choose(found: list, truth: np.ndarray, terms: list[str]) -> list[int]:
    """Terms that together cover every toxic row COVER times, each for rows that those before leave.

    A term's gain is the toxic rows that it covers and that still want one, less twice the
    others; a row that a chosen beginning of the term, or a longer form, covers wants it no more. Terms that merely stand beside telling ones in the same texts are left out so. Of terms
    with one gain the longest is taken. Gains only fall, so a term whose gain is still the
    highest when it is worked out anew is the best.
    """
    rows = [set() for _ in terms]
    for at, own in enumerate(found):
        for i in own:
            rows[i].add(at)
    wants = {at: COVER for at in np.flatnonzero(truth > 0).tolist()}
    clean = [sum(at not in wants for at in r) for r in rows]
    queue = [(2 * c - (len(r) - c), -len(t), i) for i, (r, c, t) in enumerate(zip(rows, clean, terms, strict=True))]
    heapq.heapify(queue)
    chosen: list[int] = []
    while queue:
        loss, length, i = heapq.heappop(queue)
        word = terms[i].strip()
        kin = [rows[c] for c in chosen if (other := terms[c].strip()).startswith(word) or word.startswith(other)]
        now = 2 * clean[i] - sum(wants.get(at, 0) > 0 and not any(at in r for r in kin) for at in rows[i])
        if now != loss:
            heapq.heappush(queue, (now, length, i))
        elif -now < MIN_TOXIC:
            break
        else:
            chosen.append(i)
            for at in rows[i]:
                if wants.get(at):
                    wants[at] -= 1
    return chosen


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(sample(docs, labels))
    count = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    n, k = count["n"], count["k"]
    terms = learn_terms(rows, n, k) if 0 < k < n else []

    def read(terms: list[str]) -> pd.DataFrame:
        @F.pandas_udf("array<int>")
        def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            reader = Reader(terms)
            for texts in batches:
                yield pd.Series([reader.read(t) for t in texts])

        # At most MAX_LABELLED rows.
        return rows.select("doc_id", "toxic", look(F.col("text")).alias("found")).orderBy("doc_id").toPandas()

    got = read(terms)
    if terms:
        own = [[i for i in found if i < len(terms)] for found in got["found"]]
        terms = [terms[i] for i in choose(own, got["toxic"].to_numpy(dtype=np.float64), terms)]
        got = read(terms)
    scratch.drop(rows)
    names = voter_names(terms)
    if not len(got):
        # Nothing to fit: the fixed lexicons alone.
        return Model(weights=[4.0 if v.startswith("lexicon") else 0.0 for v in names], intercept=-2.5)
    votes = np.zeros((len(got), len(names)))
    for row, found in enumerate(got["found"]):
        votes[row, list(found)] = 1
    known = 0 < k < n
    prior = float(np.clip(k / n, 0.02, 0.5)) if known else 0.1
    given = np.where(got["toxic"].to_numpy() > 0, 1.0, -1.0) if known else None
    post, accuracy, dependences = label_model(votes, prior, given)
    # All votes are for toxic, so one that would count against it counts for nothing.
    use = np.ones(len(names), bool)
    while True:
        weights, intercept = linear(votes * use, post)
        if not (weights < 0).any():
            break
        use &= weights >= 0
    intercept += operating_point(votes @ weights + intercept, post > 0.5)
    pairs = [(names[i], names[j], c) for i, j, c in dependences]
    return Model(terms, weights.tolist(), float(intercept), accuracy.tolist(), pairs)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with tox_score of the whole text; a column of that name is replaced."""

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model.terms)
        for texts in batches:
            z = [model.intercept + sum(model.weights[i] for i in reader.read(t)) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -30, 30))), dtype="float64")

    rows = carried(docs, ["tox_score"], text="string")
    own = [c for c in docs.columns if c.lower() != "tox_score"]
    return rows.select(*[F.col(f"row.{quoted(c)}") for c in own], rate("text").alias("tox_score"))


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rated = score(pick(docs, doc_id="long", text="string"), fit(docs, labels))
    return rated.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
