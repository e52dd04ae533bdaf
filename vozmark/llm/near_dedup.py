"""Near-duplicate groups: MinHash banding, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence).
Documents of equal sets become one representative, the smallest doc_id. Representatives
whose signatures agree in a band are candidates. A candidate pair's signatures are
compared batch by batch, and the pair is dropped once the posterior probability that its
similarity reaches the threshold is below MISS; survivors are confirmed on full sets.
Confirmed links make components.

No bucket of a band is expanded into its pairs. Members are compared in groups of bounded
size, each in one task, that hold signatures and full sets; a group gives out a spanning
forest of confirmed links, so what it gives out grows with its rows, not with its pairs.
Each bucket's hub, its member of the smallest number, first meets the others. Buckets whose
members are then in several components go on: in rounds, every member stands in one block
of one of its buckets; at last, in every such bucket, those outside its largest component
meet each other and those inside, block by block. Pairs within one component, or whose set
sizes alone exclude the threshold, are never looked at.

Cases: documents without text or words have an empty set, link with nothing and are kept.
Rows with a null doc_id link with nothing, have a null component and are kept. Repeated
rows get the same result each; rows with one doc_id and different texts are judged by
their own texts. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, bound_batches, pick, small, tidy

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, BANDS = 128, 32
#: A pair is dropped if its chance to reach the threshold is below this, after each BATCH.
MISS, BATCH = 1e-5, 32
#: Rows of a block, and shingles (8 bytes each); a text of more is a block of its own.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Groups of more rows are compared batch by batch as matrices.
SMALL = 64
#: Rounds in blocks before the complete one; fewer if one finds nothing. They only save work.
FOREST_ROUNDS = 2
_MASK = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's shingles. bytes.split parts at the contract's spaces."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    weights = _constants(SHINGLE, 5)
    if n < SHINGLE:
        return _mix((hashed * weights[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = hashed[: n - SHINGLE + 1] * weights[0]
    for k in range(1, SHINGLE):
        total += hashed[k : n - SHINGLE + 1 + k] * weights[k]
    return np.unique(_mix(total))


class Signer:
    def __init__(self):
        both = _constants(2 * PERMUTATIONS, 7)
        self.flip = (both[:PERMUTATIONS] >> np.uint64(20)).astype(np.uint32)
        self.times = (both[PERMUTATIONS:] >> np.uint64(20)).astype(np.uint32) | np.uint32(1)
        self.rows = _constants(PERMUTATIONS, 11).reshape(BANDS, -1)
        self.band = _constants(BANDS, 13)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), 1024):
            part = (short[at : at + 1024, None] ^ self.flip) * self.times
            np.minimum(low, part.min(0), out=low)
        return low

    def bands(self, low: np.ndarray) -> np.ndarray:
        keys = (low.reshape(BANDS, -1).astype(np.uint64) * self.rows).sum(1, dtype=np.uint64)
        return _mix(keys + self.band).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, fp1, fp2, sig, bands) of each row (doc_id, th, text); sig holds 16 bits of
    each minimum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer()
        for batch in batches:
            rows = []
            for doc_id, th, text in zip(batch["doc_id"], batch["th"], batch["text"], strict=True):
                s = shingle_set(text)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if not len(s) or doc_id is None:
                    rows.append((doc_id, th, len(s), None, None, None, None))
                    continue
                low = signer.sign(s)
                fp1 = int(_mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))
                fp2 = int(_mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))
                sig = (low & np.uint32(0xFFFF)).astype(np.uint16).tobytes()
                rows.append((doc_id, th, len(s), fp1, fp2, sig, signer.bands(low)))
            out = pd.DataFrame(rows, columns=["doc_id", "th", "n", "fp1", "fp2", "sig", "bands"])
            yield out.astype({"doc_id": "Int64", "fp1": "Int64", "fp2": "Int64"})

    schema = "doc_id long, th long, n long, fp1 long, fp2 long, sig binary, bands array<long>"
    return docs.select("doc_id", "th", "text").mapInPandas(tidy(run), schema)


def least_matches(k: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Matches of k below which P(similarity >= percent | matches), uniform prior, is below miss."""
    grid = (np.arange(4000) + 0.5) / 4000
    for m in range(k + 1):
        log = m * np.log(grid) + (k - m) * np.log(1 - grid)
        density = np.exp(log - log.max())
        if density[grid >= percent / 100].sum() >= miss * density.sum():
            return m
    return k


def bounds() -> list[tuple[int, int, int]]:
    """(from, to, least matches so far) of each batch of hashes."""
    return [(k - BATCH, k, least_matches(k)) for k in range(BATCH, PERMUTATIONS + 1, BATCH)]


def compare(a: np.ndarray, b: np.ndarray, limits) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of signature rows that survive every batch, and their matches."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for start, stop, least in limits:
        matches = matches + (a[left, start:stop] == b[left, start:stop]).sum(1, dtype=np.int32)
        ok = matches >= least
        left, matches = left[ok], matches[ok]
    return left, matches


def _fits(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)


def _shared(items: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i (ascending) with the sets j."""
    out = np.zeros(len(i), np.int64)
    at = 0
    while at < len(i):
        mine, stop, total = items[i[at]], at, 0
        while stop < len(i) and i[stop] == i[at] and (stop == at or total + len(items[j[stop]]) <= BLOCK_SHINGLES):
            total += len(items[j[stop]])
            stop += 1
        theirs = [items[k] for k in j[at:stop]]
        starts = np.cumsum([0, *map(len, theirs[:-1])])
        theirs = np.concatenate(theirs)
        place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        out[at:stop] = np.add.reduceat((mine[place] == theirs).astype(np.int64), starts)
        at = stop
    return out


def _survivors(side, comp, n, sig, limits):
    """(i, j, matches) of a group's pairs that pass every batch. Only pairs of two components,
    of sizes that fit, and with one of side 1 at least are compared."""
    if len(n) <= SMALL:
        i, j = np.triu_indices(len(n), 1)
        ok = (comp[i] != comp[j]) & ((side[i] > 0) | (side[j] > 0)) & _fits(n[i], n[j])
        i, j = i[ok], j[ok]
    else:
        ones, zeros = np.flatnonzero(side > 0), np.flatnonzero(side == 0)
        start, stop, least = limits[0]
        parts = []
        for x, y in ((ones, ones), (ones, zeros)):
            for at in range(0, len(x) if len(y) else 0, BLOCK):
                some = x[at : at + BLOCK]
                count = np.zeros((len(some), len(y)), np.uint8)
                for k in range(start, stop):
                    count += sig[some, k][:, None] == sig[y, k][None, :]
                u, v = np.nonzero(count >= least)
                u, v = some[u], y[v]
                ok = (comp[u] != comp[v]) & _fits(n[u], n[v])
                if y is ones:
                    ok &= u < v
                parts.append((u[ok], v[ok]))
        i = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        j = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
    left, matches = compare(sig[i], sig[j], limits)
    return i[left], j[left], matches


def confirmed_links(side, rep, comp, n, sig, items, limits) -> list[tuple[int, int]]:
    """A spanning forest, between components, of the links in a group.

    Survivors are confirmed on full sets, best matches first, some of each row at a time;
    pairs that links found by then have put into one component need no test.
    """
    root: dict[int, int] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    i, j, matches = _survivors(side, comp, n, sig, limits)
    order = np.lexsort((-matches, i))
    i, j = i[order], j[order]
    out, take = [], 1
    while len(i):
        first = np.searchsorted(i, i)  # where each row's pairs begin
        now = np.arange(len(i)) - first < take
        p, q = i[now], j[now]
        both = _shared(items, p, q)
        for a, b in zip(*(x[100 * both >= PERCENT * (n[p] + n[q] - both)] for x in (p, q)), strict=True):
            u, v = find(int(comp[a])), find(int(comp[b]))
            if u != v:
                root[u] = v
                out.append((min(rep[a], rep[b]), max(rep[a], rep[b])))
        i, j = i[~now], j[~now]
        if len(i):
            top = np.array([find(int(c)) for c in comp])
            apart = top[i] != top[j]
            i, j = i[apart], j[apart]
        take *= 2
    return out


def _linked(limits):
    """Kernel over rows (g, side, rep, comp, n, sig, items), sorted by group: confirmed links."""

    def columns(held: list[pd.DataFrame]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([b[c].to_numpy() for b in held]) for c in held[0].columns}

    def links(c, s, e):
        if e - s < 2:
            return []
        sig = np.frombuffer(b"".join(c["sig"][s:e]), np.uint16).reshape(-1, PERMUTATIONS)
        items = [np.frombuffer(x, np.uint64) for x in c["items"][s:e]]
        return confirmed_links(c["side"][s:e], c["rep"][s:e], c["comp"][s:e], c["n"][s:e], sig, items, limits)

    def run(batches):
        held: list[pd.DataFrame] = []  # rows of the group at the end of what was read
        for batch in batches:
            if not len(batch):
                continue
            g = batch["g"].to_numpy()
            if held and held[0]["g"].iloc[0] == g[-1]:
                held.append(batch)
                continue
            last = int(np.searchsorted(g, g[-1]))
            c = columns([*held, batch.iloc[:last]])
            cuts = [0, *(np.flatnonzero(np.diff(c["g"])) + 1).tolist(), len(c["g"])]
            out = [x for s, e in zip(cuts[:-1], cuts[1:], strict=True) for x in links(c, s, e)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
            held = [batch.iloc[last:]]
        if held:
            c = columns(held)
            yield pd.DataFrame(links(c, 0, len(c["g"])), columns=["a", "b"], dtype="int64")

    return run


def with_sets(wanted: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, n, sig, items) of wanted (rep, n, doc_id, th, sig): full sets from the texts."""
    ids = wanted.select("rep", "doc_id", "th")
    # Rows that share an id and a text are one; any of them will do.
    texts = docs.join(small(ids), ["doc_id", "th"]).select("rep", "text")

    def build(batches):
        for batch in batches:
            sets = [shingle_set(t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"rep": batch["rep"], "items": sets})

    sets = texts.mapInPandas(tidy(build), "rep long, items binary")
    rows = wanted.select("rep", "n", "sig").join(sets, "rep").dropDuplicates(["rep"])
    return scratch.keep(rows)


def _stars(edges: DataFrame) -> bool:
    """True if every larger end has one smaller end, which is no larger end itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("high"), F.lit(0).alias("low")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("high"), F.lit(1).alias("low"))
    )
    return ends.groupBy("x").agg(F.sum("high").alias("h"), F.max("low").alias("l")).where("h > 1 or h > 0 and l > 0").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, comp) of every id in an edge (a, b), comp being the smallest reachable.

    Large-star and small-star steps by turns move edges towards the smallest ids until all
    are stars. The joins with a centre's one minimum are safe for a hot centre.
    """

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))

    now = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            attach(both, least(both), ["u"], "deg")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = scratch.keep(large)
        small = least(large)
        new = (
            attach(large, small, ["u"], "deg")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        )
        new = scratch.keep(new.where("u <> v").distinct())
        scratch.drop(now, large)
        now = new
    return now.select(F.col("u").alias("rep"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("rep"), F.col("v").alias("comp")).distinct()
    )


def _blocks(rows: str, shingles: str) -> Column:
    need = F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1))
    return need.cast("int")


def _dealt(rows: DataFrame, turn: int) -> DataFrame:
    """Rows (key, rep, comp, m, s, ...) of unsettled buckets, each row in one block of one bucket.

    A row's bucket is the first by a hash of the turn, so that rows that share many
    buckets mostly choose the same.
    """
    choice = F.struct(F.xxhash64(F.lit(turn), "key").alias("h"), "key", "comp", "m", "s")
    one = rows.groupBy("rep").agg(F.min(choice).alias("c")).select("rep", "c.*")
    block = F.pmod(F.xxhash64(F.lit(turn), "rep"), _blocks("m", "s"))
    return one.select(F.xxhash64("key", block).alias("g"), F.lit(1).alias("side"), "rep", "comp")


def _complete(rows: DataFrame) -> DataFrame:
    """All rows of unsettled buckets, dealt so that those outside the largest component meet
    everyone: outside block i with outside block j >= i, and with every inside block.

    rows: (key, rep, comp, big, m_in, s_in, m_out, s_out), big being that component.
    """
    inside = F.col("comp") == F.col("big")
    rows = rows.withColumns({"n_in": _blocks("m_in", "s_in"), "n_out": _blocks("m_out", "s_out")})
    own = F.pmod(F.xxhash64(F.lit("own"), "rep"), F.when(inside, F.col("n_in")).otherwise(F.col("n_out")))
    rows = rows.withColumn("own", own.cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    base = ["key", "rep", "comp", "own"]
    outside = rows.where(~inside)
    out = outside.select(*base, every("n_out")).select(
        F.xxhash64("key", F.lit("out"), F.least("own", "other"), F.greatest("own", "other")).alias("g"),
        # The later block of two stands on side 0: its own pairs are made in its own group.
        F.when(F.col("own") <= F.col("other"), 1).otherwise(0).alias("side"), "rep", "comp",
    )
    with_in = outside.where("m_in > 0").select(*base, every("n_in")).select(
        F.xxhash64("key", F.lit("in"), "own", "other").alias("g"), F.lit(1).alias("side"), "rep", "comp"
    )
    within = rows.where(inside).select(*base, every("n_out")).select(
        F.xxhash64("key", F.lit("in"), "other", "own").alias("g"), F.lit(0).alias("side"), "rep", "comp"
    )
    return out.unionByName(with_in).unionByName(within)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) of every row, th being xxhash64 of its text."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = pick(docs, doc_id="long", text="string").withColumn("th", F.xxhash64("text"))
    signed = scratch.keep(signatures(rows))
    # Texts of one set are one representative, whose number is given as the table is written.
    reps = scratch.keep(
        signed.where("fp1 is not null")
        .groupBy("fp1", "fp2", "n")
        .agg(
            F.min(F.struct("doc_id", "th")).alias("d"), F.first("sig").alias("sig"),
            F.first("bands").alias("bands"), F.count("*").alias("copies"),
        )
        .select(F.monotonically_increasing_id().alias("rep"), "n", "fp1", "fp2", "d.*", "sig", "bands", "copies")
    )
    keyed = reps.select("rep", "n", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    sizes = scratch.keep(sizes)
    buckets = scratch.keep(attach(keyed, sizes, ["key"], "m"))
    wanted = reps.join(buckets.select("rep").distinct(), "rep", "left_semi")
    sets = with_sets(scratch.keep(wanted.select("rep", "n", "doc_id", "th", "sig")), rows, scratch)
    limits = bounds()

    def find_links(dealt: DataFrame) -> DataFrame:
        """Links (a, b) found in rows (g, side, rep, comp)."""
        full = dealt.join(sets, "rep").select("g", "side", "rep", "comp", "n", "sig", "items")
        there = full.repartition("g").sortWithinPartitions("g")
        return scratch.keep(there.mapInPandas(tidy(_linked(limits)), "a long, b long"))

    # Every hub with the others of its buckets, each pair once.
    pairs = scratch.keep(buckets.where("rep <> hub").select("hub", "rep", "n").distinct())
    hubs = scratch.keep(pairs.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("s")))
    blocks = _blocks("m", "s")
    group = lambda block: F.xxhash64("hub", block).alias("g")
    members = attach(pairs, hubs, ["hub"], "m").select(
        group(F.pmod(F.xxhash64("rep"), blocks).cast("int")), F.lit(0).alias("side"), "rep", F.col("rep").alias("comp")
    )
    centres = hubs.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        group(F.col("block")), F.lit(1).alias("side"), F.col("hub").alias("rep"), F.col("hub").alias("comp")
    )
    links = find_links(members.unionByName(centres))
    comps = scratch.keep(components(links, scratch))

    turn = 0
    while True:
        placed = buckets.where("m > 2").join(comps, "rep", "left").select(
            "key", "rep", "n", F.coalesce("comp", "rep").alias("comp")
        )
        parts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        open_keys = scratch.keep(
            parts.groupBy("key")
            .agg(F.max(F.struct("c", "s", "comp")).alias("big"), F.sum("c").alias("m"), F.sum("s").alias("s"))
            .where("big.c < m")
            .select(
                "key", "m", "s", F.col("big.comp").alias("big"), F.col("big.c").alias("m_in"),
                F.col("big.s").alias("s_in"), (F.col("m") - F.col("big.c")).alias("m_out"),
                (F.col("s") - F.col("big.s")).alias("s_out"),
            )
        )
        if open_keys.isEmpty():
            break
        open_rows = scratch.keep(attach(placed, open_keys, ["key"], "m"))
        complete = turn >= FOREST_ROUNDS
        new = find_links(_complete(open_rows) if complete else _dealt(open_rows, turn))
        none = new.isEmpty()
        if not none:
            stars = comps.select(F.col("rep").alias("a"), F.col("comp").alias("b"))
            comps = scratch.keep(components(stars.unionByName(new), scratch))
        scratch.drop(open_keys, open_rows, new)
        if complete:
            break
        turn = FOREST_ROUNDS if none else turn + 1
    named = comps.join(reps.select("rep", "doc_id"), "rep")
    firsts = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size"))
    firsts = scratch.keep(firsts)
    member = attach(comps, firsts, ["comp"], "size").select("rep", "component_id")
    by_set = scratch.keep(
        reps.select("rep", "fp1", "fp2", "n", "doc_id", "copies").join(member, "rep", "left").select(
            "fp1", "fp2", "n", F.coalesce("component_id", "doc_id").alias("component_id"), "copies"
        )
    )
    ids = ["fp1", "fp2", "n"]
    whole = signed.where("fp1 is not null").select("doc_id", "th", *ids)
    found = attach(whole, by_set, ids, "copies").select("doc_id", "th", "n", "component_id")
    bare = signed.where("fp1 is null").select("doc_id", "th", "n", F.col("doc_id").alias("component_id"))
    return scratch.last(
        found.unionByName(bare).select(
            "doc_id",
            "th",
            F.col("n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT u.b, r.m FROM r JOIN u ON r.doc_id = u.a WHERE r.m < u.b),
k AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""
