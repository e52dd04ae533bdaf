"""URL filter: rules first, then a host's trust and distrust spread over the link graph.

Rules allow or block a host with all its subdomains below a path prefix; the longest that
fits decides. Where none fits, personalised PageRank decides: trust flows along links
from hosts that rules mostly allow, distrust flows against links from hosts that rules
mostly block, and a host with more distrust than trust is blocked.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule, is no
seed and is allowed. Null html has no links. Repeated rows are judged one by one and each
counts as a page. Links to the own host and links without a host count for nothing.
Without links, a host has its seed's score alone. Columns other than those named are
ignored. Everything is DataFrame operations; only sums over all hosts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, Scratch, ascii_lower, pick

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MAX_RULES = 1000
#: A host is a seed if rules block, or allow, this share of its pages.
BLOCKED_SHARE, ALLOWED_SHARE = 0.5, 0.1
#: At this damping TOLERANCE is met after some 95 rounds at most; MAX_ITERATIONS is an error.
DAMPING, MAX_ITERATIONS, TOLERANCE = 0.85, 200, 1e-6
#: A host is blocked if its distrust is above this times its trust.
DISTRUST_RATIO = 1.0
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINKS = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """The longest fitting rule as struct(length, host_length, verdict, rule), or null."""
    rules = RULES if rules is None else rules
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; they are compiled into one expression")
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(
                F.lit(len(h + p)).alias("length"),
                F.lit(len(h)).alias("host_length"),
                F.lit(verdict).alias("verdict"),
                F.lit(h + p).alias("rule"),
            ),
        )
        for verdict, h, p in rules
    ]
    none = F.lit(None).cast("struct<length:int,host_length:int,verdict:string,rule:string>")
    return F.array_max(F.array(*fits)) if fits else none


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of host src with a link to another host dst."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINKS), 1), ascii_lower))
    return (
        pages.where(F.col("html").contains("//"))
        .select(host_of(F.col("url")).alias("src"), F.explode(found).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def host_seeds(judged: DataFrame) -> DataFrame:
    """(host, trust, distrust): seed weights in pages, from rows with host and verdict."""
    share = lambda v: F.sum((F.col("rule_verdict") == v).cast("int"))
    return (
        judged.where(F.col("host") != "")
        .groupBy("host")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(share("allow"), F.lit(0)).alias("a"),
            F.coalesce(share("block"), F.lit(0)).alias("b"),
        )
        .withColumn("blocked", F.col("b") >= BLOCKED_SHARE * F.col("n"))
        .select(
            "host",
            F.when(~F.col("blocked") & (F.col("a") >= ALLOWED_SHARE * F.col("n")), F.col("a"))
            .otherwise(0)
            .cast("double")
            .alias("trust"),
            F.when(F.col("blocked"), F.col("b")).otherwise(0).cast("double").alias("distrust"),
        )
    )


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust): personalised PageRank along and against links.

    Each kind's seeds sum to one. Mass of hosts that pass nothing on returns to the seeds.
    """
    spark = seeds.sparkSession
    scratch = Scratch(spark)
    links = scratch.keep(links)
    ends = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = scratch.keep(
        ends.withColumn("trust", F.lit(0.0))
        .withColumn("distrust", F.lit(0.0))
        .unionByName(seeds)
        .groupBy("host")
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    total = hosts.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    scale = lambda c, s: (F.col(c) / s if s else F.lit(0.0)).alias(c)
    base = hosts.select("host", scale("trust", total["t"]), scale("distrust", total["d"]))
    if links.isEmpty():
        return base
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    both = both.unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    flow = scratch.keep(
        both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share"))
    )
    start = scratch.keep(
        base.unpivot("host", ["trust", "distrust"], "kind", "seed").select("kind", "host", "seed")
    )
    # A host of very many links is hot; as in attach, such hosts are few and are broadcast.
    senders = flow.groupBy("kind", "host").agg(F.count("*").alias("deg"))
    all_links = senders.agg(F.coalesce(F.sum("deg"), F.lit(0))).first()[0]
    hot = F.coalesce(F.col("deg") > max(HOT_ROWS, HOT_SHARE * all_links), F.lit(False))
    rank = scratch.keep(
        start.join(senders, ["kind", "host"], "left").select(
            "kind", "host", "seed", F.col("deg").isNotNull().alias("sends"), hot.alias("hot"), F.col("seed").alias("score")
        )
    )
    hubs = rank.where("hot").select("kind", "host")
    hot_flow = scratch.keep(flow.join(F.broadcast(hubs), ["kind", "host"]))
    cold_flow = scratch.keep(flow.join(F.broadcast(hubs), ["kind", "host"], "left_anti"))
    scratch.drop(flow, start)
    for _ in range(MAX_ITERATIONS):
        lost = {
            r["kind"]: r["s"] or 0.0
            for r in rank.groupBy("kind").agg(F.sum(F.when(~F.col("sends"), F.col("score"))).alias("s")).collect()
        }
        back = F.when(F.col("kind") == "trust", lost.get("trust", 0.0)).otherwise(lost.get("distrust", 0.0))
        mass = rank.where(F.col("score") > 0)
        sent = (
            mass.where("not hot").select("kind", "host", "score").join(cold_flow, ["kind", "host"])
            .unionByName(hot_flow.join(F.broadcast(mass.where("hot").select("kind", "host", "score")), ["kind", "host"])
                         .select("kind", "host", "score", "to", "share"))
            .groupBy("kind", F.col("to").alias("host"))
            .agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        )
        new = scratch.keep(
            rank.join(sent, ["kind", "host"], "left").select(
                "kind",
                "host",
                "seed",
                "sends",
                "hot",
                (
                    (1 - DAMPING + DAMPING * back) * F.col("seed")
                    + DAMPING * F.coalesce("got", F.lit(0.0))
                ).alias("score"),
                F.col("score").alias("before"),
            )
        )
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("m")).first()["m"]
        scratch.drop(rank)
        rank = new
        if (moved or 0.0) < TOLERANCE:
            break
    else:
        raise RuntimeError(f"scores still move by {moved} after {MAX_ITERATIONS} rounds")
    score = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(k)
    return rank.groupBy("host").agg(score("trust"), score("distrust"))


def filter_urls(pages: DataFrame, rules=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    rows = pick(pages, page_id="long", url="string", html="string")
    placed = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = placed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict")
    )
    scores = propagate(host_seeds(judged), host_links(rows))
    spread = F.when(F.col("distrust") > DISTRUST_RATIO * F.col("trust"), F.lit("block")).otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", spread).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
