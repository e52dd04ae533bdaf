"""Queries over the driver's tables and the same in SQL.

The tables hold no audio: characters of documents stand for phones, embeddings for frames
or spectra, events for annotations or turns. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import phones as P
from ..operators import selection as S
from ..operators import vectors as V
from ..sources import corpora as R

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
KINDS = ["click", "purchase", "scroll", "signup", "view"]
FRUITLESS = "error"


def query(sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c):
    return F.round(c, 6)


# ---- labels -------------------------------------------------------------------------

_FOLD = "SELECT user_id, " + ", ".join(
    f"max_by(value, ts) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS
) + " FROM events GROUP BY user_id"


def _fold(t):
    return L.latest_by_kind(t("events"), "user_id", "event_type", "value", "ts", KINDS)


@query(_FOLD)
def latest_wins_fold(t):
    return _fold(t)


@query(f"SELECT user_id FROM ({_FOLD}) WHERE coalesce({', '.join(KINDS)}) IS NOT NULL")
def fold_any_label(t):
    return L.annotated(_fold(t), "user_id", KINDS)


@query(f"SELECT user_id, click, view FROM ({_FOLD}) WHERE click > 50")
def fold_value_filter(t):
    return _fold(t).where("click > 50").select("user_id", "click", "view")


@query(f"WITH f AS ({_FOLD}) SELECT user_id, {', '.join(KINDS)} FROM f WHERE view IS NOT NULL")
def fold_with_label(t):
    return L.with_label(_fold(t), "view")


@query(f"WITH f AS ({_FOLD}) SELECT user_id FROM f WHERE click = (SELECT max(click) FROM f)")
def fold_speakers_of_value(t):
    top = _fold(t).agg(F.max("click").alias("click"))
    return L.annotated(_fold(t).join(F.broadcast(top), "click", "left_semi"), "user_id", KINDS, "click")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' AND event_type = 'click'")
def rows_filter_marker(t):
    rows = L.visible(t("events").withColumn("source", F.when(F.col("event_type") == FRUITLESS, "auto").otherwise("human")))
    return L.choose_rows(rows, "event_type", "click").select("event_id", "user_id", "event_type")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM c)
SELECT user_id, CASE WHEN count(*) > 1 THEN '' ELSE max(event_type) END AS winner,
       (CASE WHEN count(*) > 1 THEN 0 ELSE max(n) END)::BIGINT AS agree
FROM r WHERE k = 1 GROUP BY user_id""")
def consensus_vote(t):
    return L.majority(t("events"), ["user_id"], "event_type")


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS annotators
FROM orders GROUP BY o_custkey""")
def annotator_list(t):
    return t("orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("annotators")
    )


@query("""
SELECT o_orderstatus, marker, value, count(*) AS n FROM (
  SELECT o_orderstatus, 'o_orderpriority' AS marker, o_orderpriority AS value FROM orders
  UNION ALL SELECT o_orderstatus, 'o_orderstatus', o_orderstatus FROM orders)
WHERE trim(value) <> '' GROUP BY ALL""")
def label_summary(t):
    rows = t("orders").withColumn("status", F.col("o_orderstatus"))
    out = L.summary(rows.select("status", "o_orderpriority", "o_orderstatus"), ["status"], ["o_orderpriority", "o_orderstatus"])
    return out.withColumnRenamed("status", "o_orderstatus")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""
WITH p(k, name) AS (VALUES """ + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_PRIORITIES)) + """),
s AS (SELECT c_custkey, k, name, EXISTS (
        SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = name) AS seen
      FROM customer, p)
SELECT c_custkey, string_agg(name, ' ' ORDER BY k) FILTER (WHERE NOT seen) AS missing,
       coalesce(string_agg(name, ' ' ORDER BY name) FILTER (WHERE seen), '') AS have
FROM s GROUP BY c_custkey HAVING bool_or(NOT seen)""")
def todo_missing(t):
    seen = t("customer").select("c_custkey").join(
        t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), "c_custkey", "left"
    )
    flags = seen.select("c_custkey", *[(F.col("o_orderpriority") == p).alias(p) for p in _PRIORITIES])
    return L.todo(flags, ["c_custkey"], _PRIORITIES)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def multi_annotated(t):
    return L.labelled_more_than_once(t("orders"), "o_custkey")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def dataset_profile(t):
    return L.profile(t("documents"), "lang", "source").withColumnRenamed("n_speakers", "n_sources")


# ---- filters, routing, quotas -------------------------------------------------------


_CLIPS = """clips AS (
  SELECT source || '/' || (doc_id % 97) AS path, doc_id::VARCHAR AS client_id, doc_id AS seq,
         CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS variant FROM documents),
idx AS (SELECT path, max_by(client_id, seq) AS client_id FROM clips WHERE trim(coalesce(variant, '')) IN ('', 'de') GROUP BY path)"""


def _clips(t):
    variant = F.expr("CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN NULL ELSE lang END").alias("variant")
    path = F.concat_ws("/", "source", (F.col("doc_id") % 97).cast("string")).alias("path")
    rows = t("documents").select(path, F.col("doc_id").cast("string").alias("client_id"), F.col("doc_id").alias("seq"), variant)
    return R.clip_index(rows, "de")


@query(f"WITH {_CLIPS} SELECT path, client_id FROM idx")
def variant_filter(t):
    return _clips(t)


@query("""
WITH idx AS (SELECT 'f' || doc_id || '.mp3' AS path, source AS client_id FROM documents WHERE doc_id % 3 > 0),
keep AS (SELECT client_id FROM idx GROUP BY client_id HAVING count(*) >= 4 ORDER BY count(*) DESC, client_id LIMIT 6)
SELECT 'clips/f' || d.doc_id || '.mp3' AS name, client_id FROM documents d JOIN idx ON idx.path = 'f' || d.doc_id || '.mp3'
WHERE client_id IN (SELECT client_id FROM keep)""")
def clip_speakers(t):
    file = F.concat(F.lit("f"), F.col("doc_id"), F.lit(".mp3"))
    index = t("documents").where("doc_id % 3 > 0").select(file.alias("path"), F.col("source").alias("client_id"))
    archive = t("documents").select(F.concat(F.lit("clips/"), file).alias("name"))
    return R.clip_speakers(archive, index, R.frequent_speakers(index, 4, 6)).select("name", "client_id")


@query("""
SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type
FROM events GROUP BY user_id""")
def dedupe_last_wins(t):
    return S.last_wins(t("events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


_SUBSET = """CASE doc_id % 5 WHEN 0 THEN 'train/NURC_RE/type/' || source || '/' || doc_id || '.wav'
  WHEN 1 THEN 'train/CORAL/' || doc_id || '_CO_' || source || '.wav' WHEN 2 THEN 'train/Ted_part1/' || source || '-' || doc_id || '.wav'
  WHEN 3 THEN 'train/alip/' || doc_id || '.wav' ELSE 'train/NURC_RE/' || source || '.wav' END"""


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'nurc' WHEN 1 THEN 'coral' WHEN 2 THEN 'ted' END AS subset,
       CASE WHEN doc_id % 5 < 3 THEN source END AS speaker,
       CASE doc_id % 5 WHEN 0 THEN doc_id || '.wav' WHEN 1 THEN doc_id || '_CO_' || source || '.wav'
         WHEN 2 THEN source || '-' || doc_id || '.wav' END AS file
FROM documents""")
def route_paths(t):
    rows = t("documents").select("doc_id", F.expr(_SUBSET).alias("name"))
    return R.route_subsets(rows).select("doc_id", "subset", "speaker", "file")


@query("""
SELECT doc_id, lang AS split, source AS speaker, doc_id || '.wav' AS file FROM documents
WHERE lang IN ('de', 'fr') AND doc_id % 4 <> 3""")
def route_splits(t):
    kind = F.when(F.col("doc_id") % 4 == 3, "text").otherwise("audio")
    name = F.concat_ws("/", F.lit("root"), "lang", kind, "source", F.lit("c1"), F.concat(F.col("doc_id").cast("string"), F.lit(".wav")))
    rows = R.route_splits(t("documents").select("doc_id", name.alias("name")), ["de", "fr"])
    return rows.select("doc_id", "split", "speaker", "file")


@query("SELECT c_custkey, c_mktsegment AS speaker FROM customer")
def stem_speaker(t):
    path = F.concat(F.lit("a/b_c/"), F.col("c_mktsegment"), F.lit("_"), F.col("c_custkey"), F.lit(".x.wav"))
    return t("customer").select("c_custkey", R.stem_speaker(path).alias("speaker"))


_EPISODE = "CASE WHEN event_id % 9 > 0 THEN substr(md5(user_id::VARCHAR), 1, 22) END"


def _episodes(t):
    code = F.md5(F.col("event_id").cast("string").cast("binary"))
    name = F.concat(F.lit("x/"), F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 22))
    name = F.concat(name, F.when(F.col("event_id") % 9 > 0, "_").otherwise("-"), code, F.substring(code, 1, 8), F.lit("_1.mp3"))
    return t("events").select("event_id", R.episode_of(name).alias("episode"))


@query(f"SELECT event_id, {_EPISODE} AS episode FROM events")
def episode_ids(t):
    return _episodes(t)


@query(f"""
WITH e AS (SELECT event_id, {_EPISODE} AS episode FROM events),
f AS (SELECT episode FROM e WHERE episode IS NOT NULL GROUP BY episode ORDER BY min(event_id) LIMIT 20)
SELECT event_id, episode FROM e WHERE episode IN (SELECT episode FROM f)
QUALIFY row_number() OVER (PARTITION BY episode ORDER BY event_id) <= 3""")
def cap_episodes(t):
    return R.cap_episodes(_episodes(t), ["event_id"], per_episode=3, episodes=20)


@query("""
SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1)::BIGINT AS i,
       lang || '_' || lpad((row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1)::VARCHAR, 6, '0') AS file
FROM documents WHERE lang IN ('de', 'es')""")
def split_rows(t):
    docs = t("documents").select("doc_id", "lang", "source")
    rows = R.split_rows({k: docs.where(F.col("lang") == k) for k in ("de", "es")}, "source", ["doc_id"])
    return rows.select("doc_id", "i", "file")


@query("""
SELECT trim(value) AS class, count(*) AS n, count(*) >= 30 AS kept FROM (
  SELECT CASE WHEN doc_id % 6 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN NULL ELSE ' ' || source END AS value FROM documents)
WHERE trim(coalesce(value, '')) <> '' GROUP BY trim(value)""")
def class_counts(t):
    value = F.expr("CASE WHEN doc_id % 6 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN NULL ELSE concat(' ', source) END")
    return S.frequent_classes(t("documents").select(value.alias("value")), "value", 30)


@query("""
SELECT count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS n_dirs, count(*) AS n_files, sum(size)::BIGINT AS bytes
FROM (SELECT url AS path, length(coalesce(html, '')) AS size FROM pages)""")
def tree_summary(t):
    rows = t("pages").select(F.col("url").alias("path"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    return R.tree_summary(rows)


@query("SELECT vec_id, quality AS y, embedding[1]::DOUBLE AS x FROM embeddings JOIN labels ON vec_id = doc_id")
def labels_by_key(t):
    labels = t("labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("y"))
    features = t("embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return S.labelled(features, labels, "vec_id").select("vec_id", "y", "x")


@query("SELECT 'n_' || lpad(c_custkey::VARCHAR, 4, '0') AS name, c_custkey FROM customer WHERE c_custkey < 10000")
def numbered_names(t):
    rows = t("customer").where("c_custkey < 10000").select(F.lit("n").alias("base"), "c_custkey")
    return rows.select(R.numbered("base", "c_custkey", 4).alias("name"), "c_custkey")


@query(r"SELECT p_partkey, regexp_replace(p_name, '[^\p{L}\p{N}\-_.]', '_', 'g') AS name FROM part")
def safe_names(t):
    return t("part").select("p_partkey", S.safe_name(F.col("p_name")).alias("name"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id BETWEEN 0 AND 49 OR doc_id = 59 OR doc_id BETWEEN 99 AND 119")
def sentence_ranges(t):
    docs = t("documents")
    spans = docs.sparkSession.createDataFrame(X.ranges("1-50,60,100-120"), "lo long, hi long")
    ids = spans.select(F.explode(F.sequence("lo", F.col("hi") - 1)).alias("doc_id"))
    return docs.join(ids, "doc_id", "left_semi").select("doc_id", "n_chars")


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)""")
def speakers_min_clips(t):
    return S.keep_frequent(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
def top_speakers(t):
    return S.top_keys(t("orders"), "o_custkey", 20)


@query("""
SELECT o_custkey, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3""")
def cap_per_speaker(t):
    return S.cap_per_key(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 3)


@query("SELECT o_custkey, min(o_orderkey) AS first_seq FROM orders GROUP BY o_custkey ORDER BY 2, 1 LIMIT 25")
def first_n_speakers(t):
    return S.first_keys(t("orders"), "o_custkey", "o_orderkey", 25)


@query("""
SELECT c_custkey, c_mktsegment, c_custkey AS first_seq FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= 8""")
def balanced_quota(t):
    rows = t("customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").alias("seq"))
    return S.balanced_keys(rows, "c_custkey", "c_mktsegment", "seq", 41, 5)


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem)
WHERE l_returnflag <> 'R' OR r <= 5""")
def cap_wav_keep_rest(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    capped = S.cap_per_key(rows.where("l_returnflag = 'R'"), "l_suppkey", ["l_orderkey", "l_linenumber"], 5)
    return capped.unionByName(rows.where("l_returnflag <> 'R'"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 50")
def deterministic_sample(t):
    return S.hash_sample(t("documents").select("doc_id"), "doc_id", 50)


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100")
def head_n(t):
    return t("events").orderBy("event_id").limit(100).select("event_id", "user_id")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_join_two_phase(t):
    hits = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.scan_hits(t("lineitem").select("l_orderkey", "l_linenumber"), hits, "l_orderkey")


@query("""
SELECT o_orderkey, coalesce(c_name, '') AS text FROM orders
LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""")
def metadata_left_join(t):
    names = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sentence_id"), F.col("c_name").alias("text"))
    return R.with_texts(t("orders").select("o_orderkey", F.col("o_custkey").alias("sentence_id")), names).select("o_orderkey", "text")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_rows_anti(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return S.missing_rows(t("customer").select("c_custkey"), urgent, "c_custkey")


_ALLOWED = ["BRAZIL", "FRANCE", "ATLANTIS", "NATION_3"]


@query("SELECT unnest(['BRAZIL', 'FRANCE', 'ATLANTIS', 'NATION_3']) AS name EXCEPT SELECT n_name FROM nation")
def allowlist_validate(t):
    nation = t("nation")
    asked = nation.sparkSession.createDataFrame([(n,) for n in _ALLOWED], "name string")
    return S.unknown_names(asked, nation.select(F.col("n_name").alias("name")))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) ELSE printf('%.1f KB', round(n_chars / 1024.0::DOUBLE, 1)) END AS size FROM documents")
def human_sizes(t):
    return t("documents").select("doc_id", S.human_size(F.col("n_chars")).alias("size"))


# ---- frames, spikes, markers --------------------------------------------------------


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS token FROM embeddings")
def frame_argmax(t):
    return t("embeddings").select("vec_id", P.argmax("embedding").alias("token"))


_CHARS = """chars AS (
  SELECT doc_id, unnest(range(len(cs))) AS t, unnest(cs) AS token
  FROM (SELECT doc_id, string_split(lower(text), '') AS cs FROM documents WHERE text <> '')),
prev AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY t) AS p FROM chars),
spikes AS (SELECT doc_id, t, token FROM prev WHERE token <> ' ' AND (p IS NULL OR p <> token)),
ctx AS (SELECT *, lead(token, 1, '') OVER (PARTITION BY doc_id ORDER BY t) AS next_phone FROM spikes)"""


def _spiked(t):
    """(doc_id, s): spikes of each text as an array; no shuffle."""
    chars = F.split(F.lower("text"), "")
    rows = t("documents").where("text <> ''").select("doc_id", chars.alias("cs"))
    return rows.select("doc_id", P.spikes_of("cs", " ").alias("s"))


@query(f"WITH {_CHARS} SELECT doc_id, count(*) AS n_frames, count(*) FILTER (WHERE p IS NULL OR p <> token) AS n_runs FROM prev GROUP BY doc_id")
def ctc_collapse(t):
    rows = t("documents").where("text <> ''").select("doc_id", F.split(F.lower("text"), "").alias("cs"))
    runs = F.expr("size(filter(transform(cs, (x, i) -> NOT coalesce(get(cs, i - 1) = x, false)), b -> b))")
    return rows.select("doc_id", F.size("cs").cast("long").alias("n_frames"), runs.cast("long").alias("n_runs"))


@query(f"WITH {_CHARS} SELECT doc_id, md5(string_agg(token, '' ORDER BY t)) AS tokens_md5 FROM spikes GROUP BY doc_id")
def ctc_decode(t):
    text = F.array_join(F.transform("s", lambda x: x["token"]), "")
    return _spiked(t).where(F.size("s") > 0).select("doc_id", F.md5(text.cast("binary")).alias("tokens_md5"))


@query(f"WITH {_CHARS} SELECT doc_id, count(*) AS n, min(t)::INT AS first_t, max(t)::INT AS last_t, sum(t)::BIGINT AS sum_t FROM spikes GROUP BY doc_id")
def spikes(t):
    return _spiked(t).where(F.size("s") > 0).select(
        "doc_id",
        F.size("s").cast("long").alias("n"),
        F.expr("element_at(s, 1).t").alias("first_t"),
        F.expr("element_at(s, -1).t").alias("last_t"),
        F.expr("aggregate(s, 0L, (a, x) -> a + x.t)").alias("sum_t"),
    )


@query(f"WITH {_CHARS} SELECT token, next_phone, count(*) AS n FROM ctx GROUP BY ALL")
def spike_context(t):
    pairs = F.expr(
        "element_at(transform(array(s), c -> transform(c, (x, k) ->"
        " struct(x.token AS token, coalesce(get(c, k + 1).token, '') AS next_phone))), 1)"
    )
    return _spiked(t).select(F.explode(pairs).alias("p")).groupBy("p.token", "p.next_phone").agg(F.count("*").alias("n"))


def _texts(t):
    return t("documents").where("text <> ''").select("doc_id", F.lower("text").alias("text"))


def _marker_sql(marker: str) -> str:
    return (
        f"WITH {_CHARS} SELECT doc_id, t::INT AS frame, t * 20 / 1000.0::DOUBLE AS time_s, token AS phone, next_phone"
        f" FROM ctx WHERE {P.tests('token', 'next_phone')[marker]}"
    )


for _m in C.PHONE_GROUPS:

    def _one(t, m=_m):
        rows = P.text_markers(_texts(t), "doc_id", "text", m)
        return rows.select("doc_id", "frame", (F.col("frame") * 20 / 1000.0).alias("time_s"), "phone", "next_phone")

    _one.__name__ = f"markers_{_m}"
    query(_marker_sql(_m))(_one)


@query(f"WITH {_CHARS} SELECT doc_id, marker, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{m}' AS marker FROM ctx WHERE {c}" for m, c in P.tests("token", "next_phone").items()
) + ") GROUP BY ALL")
def marker_counts(t):
    return P.text_marker_counts(_texts(t), "doc_id", "text", list(C.PHONE_GROUPS))


@query(f"WITH {_CHARS} SELECT marker, count(*) AS n, sum(t)::BIGINT AS sum_t FROM (" + " UNION ALL ".join(
    f"SELECT t, '{m}' AS marker FROM ctx WHERE {c}" for m, c in P.tests("token", "next_phone").items()
) + ") GROUP BY marker")
def marker_totals(t):
    """The general form, over arrays of tokens."""
    marks = _spiked(t).select(F.explode(P.markers_of("s")).alias("m"))
    return marks.groupBy("m.marker").agg(F.count("*").alias("n"), F.sum(F.col("m.frame").cast("long")).alias("sum_t"))


_VOWELS = {"a": "aáâãàä", "e": "eéêè", "i": "ií", "o": "oóôõö", "u": "uúü"}


@query(f"WITH {_CHARS}, v(phone, vowel) AS (VALUES " + ", ".join(
    f"('{p}', '{v}')" for v, ps in _VOWELS.items() for p in ps
) + ") SELECT vowel, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM spikes JOIN v ON token = phone GROUP BY vowel")
def vowel_map_join(t):
    rows = _spiked(t).select("doc_id", F.explode(F.transform("s", lambda x: x["token"])).alias("phone"))
    per_doc = rows.groupBy("doc_id", "phone").agg(F.count("*").alias("n"))
    vowels = rows.sparkSession.createDataFrame([(p, v) for v, ps in _VOWELS.items() for p in ps], "phone string, vowel string")
    # A fixed table of a few rows.
    return per_doc.join(F.broadcast(vowels), "phone").groupBy("vowel").agg(
        F.sum("n").alias("n"), F.count_distinct("doc_id").alias("n_docs")
    )


@query("""
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
e AS (SELECT vec_id, i, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM x)
SELECT vec_id, i::INT AS i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e""")
def softmax_probs(t):
    return t("embeddings").select("vec_id", F.posexplode(P.softmax("embedding")).alias("i", "p")).withColumn("p", r6("p"))


_ITEMS = "x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_NEAR = "OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


def _pooled(rows):
    names = [f"x{i}" for i in range(64)]
    wide = rows.select("vec_id", "label", *[F.get("v", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    near = P.pool(wide, "label", "vec_id", names)
    return near.select("vec_id", "label", F.posexplode(F.array(*names)).alias("i", "v")).withColumn("v", r6("v"))


@query(f"WITH {_ITEMS} SELECT vec_id, label, i::INT AS i, round(avg(v) {_NEAR}, 6) AS v FROM x")
def window_pool(t):
    return _pooled(t("embeddings").select("vec_id", "label", F.col("embedding").alias("v")))


@query(f"""
WITH {_ITEMS}, e AS (SELECT vec_id, label, i, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM x),
p AS (SELECT vec_id, label, i, e / sum(e) OVER (PARTITION BY vec_id) AS v FROM e)
SELECT vec_id, label, i::INT AS i, round(avg(v) {_NEAR}, 6) AS v FROM p""")
def window_probs(t):
    return _pooled(t("embeddings").select("vec_id", "label", P.softmax("embedding").alias("v")))


@query(f"WITH {_ITEMS} SELECT label, i::INT AS pos, round(avg(v), 6) AS value FROM x GROUP BY ALL UNION ALL SELECT DISTINCT label, 64, NULL FROM x")
def group_logits(t):
    ids = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(65)]  # the last one is absent
    got = t("embeddings").groupBy("label").agg(F.array(*ids).alias("v"))
    return got.select("label", F.posexplode("v").alias("pos", "value")).withColumn("value", r6("value"))


@query("SELECT event_id, round_even(value * 50, 0)::INT AS frame FROM events")
def time_to_frame(t):
    return t("events").select("event_id", P.frame_of("value", 50).alias("frame"))


# ---- vectors ------------------------------------------------------------------------


_F0 = "CASE WHEN l_linenumber > 1 THEN l_tax END"
_FORMANTS = [f"avg({c}) FILTER (WHERE l_returnflag = '{v}')" for v in "ANR" for c in ("l_quantity", "l_extendedprice", "l_discount")]
_FORMANTS += [f"{a}({c})" for c in ("l_quantity", "l_extendedprice", "l_discount") for a in ("avg", "stddev_pop")]
_FORMANTS += [f"{a}({_F0})" for a in ("avg", "stddev_pop")]


@query(f"""
SELECT l_suppkey, unnest(range({len(_FORMANTS)}))::INT AS pos, n_tokens,
       unnest([{', '.join(f'round(({e})::FLOAT::DOUBLE, 2)' for e in _FORMANTS)}]) AS value
FROM (SELECT l_suppkey, count(*) AS n_tokens, {', '.join(f'{e} AS m{i}' for i, e in enumerate(_FORMANTS))} FROM lineitem GROUP BY l_suppkey)
""".replace("round((", "round((").replace(", ".join(f"round(({e})::FLOAT::DOUBLE, 2)" for e in _FORMANTS), ", ".join(f"round(m{i}::FLOAT::DOUBLE, 2)" for i in range(len(_FORMANTS)))))
def formant_vector(t):
    cols = [F.col(a).alias(b) for a, b in (("l_quantity", "f1"), ("l_extendedprice", "f2"), ("l_discount", "f3"), ("l_returnflag", "vowel"))]
    f0 = F.when(F.col("l_linenumber") > 1, F.col("l_tax")).otherwise(float("nan")).alias("f0")
    got = V.formant_vector(t("lineitem").select("l_suppkey", *cols, f0), "l_suppkey", list("ANR"))
    rows = got.select("l_suppkey", "n_tokens", F.posexplode("vector").alias("pos", "value"))
    return rows.select("l_suppkey", "pos", "n_tokens", F.round(F.col("value").cast("double"), 2).alias("value"))


@query("""
SELECT l_suppkey, round(avg(m), 4) AS mean, count(*) AS n_utterances
FROM (SELECT l_suppkey, l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def mean_of_means(t):
    return V.mean_of_means(t("lineitem"), "l_suppkey", "l_orderkey", "l_quantity").withColumn("mean", F.round("mean", 4))


@query("""
SELECT label, i::INT AS pos, round(avg(v), 6) AS value
FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL""")
def embedding_mean(t):
    return V.element_means(t("embeddings"), "label", "embedding").withColumn("value", r6("value"))


@query("""
SELECT vec_id, unnest(range(80))::INT AS pos, unnest([coalesce(round(embedding[i + 1]::DOUBLE, 6), 0.0::DOUBLE) FOR i IN range(80)]) AS x
FROM embeddings""")
def pad_truncate(t):
    return t("embeddings").select("vec_id", F.posexplode(V.pad_truncate(F.col("embedding"), 80)).alias("pos", "x")).withColumn(
        "x", r6(F.col("x").cast("double"))
    )


@query("""
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
p AS (SELECT vec_id, i, v * v AS p FROM x),
a AS (SELECT vec_id, sum(p) AS e, sum(p * i) / sum(p) AS m1, max(p) AS top,
             sum(p) FILTER (WHERE i BETWEEN 8 AND 16) AS lo, sum(p) FILTER (WHERE i BETWEEN 20 AND 32) AS hi FROM p GROUP BY vec_id),
b AS (SELECT p.vec_id, sum(p * (i - m1) ** 2) / any_value(e) AS m2, sum(p * (i - m1) ** 3) / any_value(e) AS m3,
             sum(p * (i - m1) ** 4) / any_value(e) AS m4, min(i) FILTER (WHERE p = top) AS peak FROM p JOIN a USING (vec_id) GROUP BY p.vec_id)
SELECT vec_id, round(m1, 4) AS m1, round(m2, 4) AS variance, round(m3 / greatest(m2, 1e-9) ** 1.5, 4) AS skew,
       round(m4 / greatest(m2, 1e-9) ** 2 - 3, 4) AS kurtosis, peak::INT AS peak,
       round(log10((hi + 1e-12) / (lo + 1e-12)), 4) AS ratio FROM a JOIN b USING (vec_id)""")
def spectral_moments_sql(t):
    p = t("embeddings").select("vec_id", F.expr("transform(embedding, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE))").alias("p"))
    got = V.power_moments("p", (8, 16), (20, 32))
    return p.select("vec_id", *[c.alias(n) if n == "peak" else F.round(c, 4).alias(n) for n, c in got.items()])


@query("""
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS n, unnest(embedding)::DOUBLE AS v FROM embeddings),
k AS (SELECT unnest(range(33)) AS k)
SELECT vec_id, k::INT AS k, round(sum(v * cos(2 * pi() * k * n / 64)) ** 2 + sum(v * sin(2 * pi() * k * n / 64)) ** 2, 5) AS power
FROM x, k GROUP BY ALL""")
def dft_power(t):
    rows = t("embeddings").select("vec_id", F.explode(V.dft_power("embedding", 64)).alias("s"))
    return rows.select("vec_id", "s.k", F.round("s.power", 5).alias("power"))


# ---- segments -----------------------------------------------------------------------

_GAP = 3600
_TURNS = f"""turns AS (SELECT user_id, event_type AS spk, epoch(ts) AS s, epoch(ts) + value AS e FROM events),
flags AS (SELECT *, CASE WHEN lag(spk) OVER w = spk AND s - lag(e) OVER w <= {_GAP} THEN 0 ELSE 1 END AS new
          FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM flags),
merged AS (SELECT user_id, island::BIGINT AS island, spk, min(s) AS start_s, max_by(e, (s, e)) AS end_s FROM isl GROUP BY ALL)"""


def _turns(t):
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    rows = t("events").select("user_id", "event_type", start.alias("s"), (start + F.col("value")).alias("e"))
    return S.merge_segments(rows, "user_id", F.col("s"), F.col("e"), "event_type", _GAP)


@query(f"WITH {_TURNS} SELECT user_id, island, spk, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM merged")
def merge_segments(t):
    return _turns(t).select("user_id", "island", "spk", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


@query("""
SELECT user_id, event_type, (rank() OVER (PARTITION BY user_id ORDER BY f) - 1)::INT AS idx
FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL)""")
def turn_order(t):
    return S.appearance_order(t("events"), "user_id", "event_type", F.struct("ts", "event_id"))


@query(f"""WITH {_TURNS} SELECT user_id, island, spk, row_number() OVER (PARTITION BY user_id, spk ORDER BY island)::INT AS number
FROM merged WHERE end_s - start_s >= 20""")
def segment_numbers(t):
    length = F.col("end_s") - F.col("start_s")
    return S.number_segments(_turns(t), "user_id", "island", length, 20).select("user_id", "island", "spk", "number")


@query("""
WITH d AS (SELECT user_id, event_type, round(sum(value), 4) AS duration, min(event_id) AS f FROM events GROUP BY ALL),
top AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY duration DESC, f) <= 2)
SELECT user_id, event_type, duration, (row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1)::INT AS idx FROM top""")
def top2_by_duration(t):
    sums = S.durations(t("events"), "user_id", "event_type", F.col("value"), F.col("event_id"))
    return S.most_active(sums, "user_id", "event_type").select("user_id", "event_type", "duration", "idx")


# ---- sentences ----------------------------------------------------------------------

_UNIT = f"{'|'.join(X.DIGRAPHS)}|[{X.LETTERS}]"
_UNITS = f"u AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_UNIT}')) AS unit FROM documents)"


@query(f"WITH {_UNITS} SELECT doc_id, count(*) AS n_units, count(DISTINCT unit) AS n_kinds FROM u GROUP BY doc_id")
def text_units(t):
    found = t("documents").select("doc_id", X.units(F.col("text")).alias("u")).where(F.size("u") > 0)
    return found.select("doc_id", F.size("u").cast("long").alias("n_units"), F.size(F.array_distinct("u")).cast("long").alias("n_kinds"))


@query(f"WITH {_UNITS} SELECT unit, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM u GROUP BY unit")
def unit_distribution(t):
    return X.unit_shares(t("documents"), "text").withColumn("share", F.round("share", 8))


@query(f"""
WITH {_UNITS}, c AS (SELECT doc_id, unit, count(*) AS n FROM u GROUP BY ALL),
g AS (SELECT unit, sum(n) / sum(sum(n)) OVER () AS q FROM c GROUP BY unit),
s AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id)
SELECT s.doc_id, round(sum(abs(coalesce(n, 0) / t - q)), 6) AS distance
FROM s CROSS JOIN g LEFT JOIN c ON c.doc_id = s.doc_id AND c.unit = g.unit
GROUP BY s.doc_id ORDER BY 2, 1 LIMIT 1""")
def greedy_round(t):
    return _nearest(t).orderBy("distance", "doc_id").limit(1)


def _nearest(t):
    """L1 distance of each text's unit shares from all texts': units a text lacks add their share."""
    docs = t("documents").select("doc_id", X.units(F.col("text")).alias("u")).where(F.size("u") > 0)
    own = docs.select("doc_id", F.size("u").alias("t"), F.explode("u").alias("unit")).groupBy("doc_id", "t", "unit").agg(F.count("*").alias("n"))
    shares = own.groupBy("unit").agg(F.sum("n").alias("c"))
    total = shares.agg(F.sum("c").alias("all"))
    # At most one row a unit, of which the alphabet has a few dozen.
    shares = F.broadcast(shares.join(F.broadcast(total)).select("unit", (F.col("c") / F.col("all")).alias("q")))
    gap = F.sum(F.abs(F.col("n") / F.col("t") - F.col("q")) - F.col("q"))
    return own.join(shares, "unit").groupBy("doc_id").agg(F.round(gap + 1.0, 6).alias("distance"))


@query()
def balanced_subset(t):
    from ..operators.sentences import balanced_subset as pick

    return pick(t("documents").select("doc_id", "text"), "doc_id", "text", 5)


# ---- evaluation ---------------------------------------------------------------------

_BAD = "CASE WHEN vec_id % 17 = 0 AND i = 3 THEN NULL ELSE v END"


def _holed(t):
    hole = F.expr("transform(embedding, (x, i) -> IF(vec_id % 17 = 0 AND i = 3, CAST('NaN' AS DOUBLE), CAST(x AS DOUBLE)))")
    return t("embeddings").select("vec_id", "label", hole.alias("embedding"))


@query(f"""
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
h AS (SELECT vec_id, i, {_BAD} AS v FROM x),
m AS (SELECT i, avg(v) AS m FROM h WHERE vec_id % 17 <> 0 GROUP BY i)
SELECT vec_id, i::INT AS i, round(coalesce(v, m), 6) AS v FROM h JOIN m USING (i)""")
def nan_impute(t):
    return E.impute_mean(_holed(t), "embedding", 64).select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", r6("v"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 17 <> 0")
def drop_nonfinite(t):
    return _holed(t).where(E.all_finite("embedding")).select("vec_id", "label")


@query("""
WITH f AS (SELECT DISTINCT vec_id % 5 AS fold FROM embeddings)
SELECT fold, CASE WHEN vec_id % 5 = fold THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM embeddings, f GROUP BY ALL""")
def loso_folds(t):
    sizes = t("embeddings").groupBy((F.col("vec_id") % 5).alias("fold")).agg(F.count("*").alias("test"))
    total = sizes.agg(F.sum("test").alias("all"))
    rows = sizes.join(F.broadcast(total)).select("fold", "test", (F.col("all") - F.col("test")).alias("train"))
    return rows.unpivot("fold", ["test", "train"], "role", "n").where("n > 0")


#: What becomes of a component that is not finite, and of its row.
_MODES = {
    "nanmean": "SELECT h.vec_id, i, coalesce(v, m) AS v FROM h JOIN (SELECT i, avg(v) AS m FROM h WHERE vec_id % 17 <> 0 GROUP BY i) USING (i)",
    "drop": "SELECT vec_id, i, v FROM h WHERE vec_id % 17 <> 0",
    "zero": "SELECT vec_id, i, coalesce(v, 0) AS v FROM h",
}


def _centroid_sql(mode: str) -> str:
    return f"""
WITH h AS (SELECT vec_id, i, {_BAD} AS v FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)),
x AS (SELECT f.*, f.vec_id % 5 AS g, (label >= 5)::INT AS y FROM ({_MODES[mode]}) f JOIN embeddings USING (vec_id)),
m AS (SELECT f.g, y, i, avg(v) AS m FROM x, (SELECT DISTINCT g FROM x) f WHERE x.g <> f.g GROUP BY ALL),
d AS (SELECT vec_id, x.g, x.y, m.y AS cls, round(sum((v - m) ** 2), 6) AS d FROM x JOIN m ON x.g = m.g AND x.i = m.i GROUP BY ALL),
p AS (SELECT vec_id, g AS grp, y, arg_min(cls, (d, cls)) AS pred, round(sum(CASE cls WHEN 0 THEN d ELSE -d END), 4) + 0.0::DOUBLE AS score FROM d GROUP BY ALL)"""


def _loso(t, mode="nanmean", learner="centroid"):
    rows = _holed(t).select("vec_id", (F.col("vec_id") % 5).alias("grp"), (F.col("label") >= 5).cast("int").alias("y"), "embedding")
    return E.loso_cv(rows, "vec_id", "grp", "y", "embedding", 64, learner, mode).withColumn("score", F.round("score", 4) + F.lit(0.0))


for _m in E.IMPUTE_MODES:

    def _one_mode(t, m=_m):
        return _loso(t, m).select("vec_id", "grp", "y", "pred", "score")

    _one_mode.__name__ = f"loso_centroid_{_m}"
    query(_centroid_sql(_m) + " SELECT vec_id, grp, y, pred, score FROM p")(_one_mode)


@query(_centroid_sql("nanmean") + " SELECT vec_id, grp, y, pred FROM p")
def loso_centroid(t):
    return _loso(t).select("vec_id", "grp", "y", "pred")


@query(_centroid_sql("nanmean") + " SELECT grp, round(avg((y = pred)::INT), 6) AS acc, count(*) AS n FROM p GROUP BY grp")
def per_speaker_accuracy(t):
    return E.per_group(_loso(t), "grp", "vec_id").withColumn("acc", r6("acc"))


@query(_centroid_sql("nanmean") + """
SELECT grp, array_to_string(list(pred ORDER BY vec_id), ',') AS preds, array_to_string(list(y ORDER BY vec_id), ',') AS truth,
       md5(array_to_string(list(printf('%.4f', score) ORDER BY vec_id), ',')) AS scores FROM p GROUP BY grp""")
def per_speaker_record(t):
    got = E.per_group(_loso(t), "grp", "vec_id", lists=True)
    told = F.array_join(F.transform("scores", lambda x: F.format_string("%.4f", x)), ",")
    return got.select(
        "grp", F.array_join("preds", ",").alias("preds"), F.array_join("true", ",").alias("truth"), F.md5(told.cast("binary")).alias("scores")
    )


@query(" UNION ALL ".join(
    f"SELECT * FROM ({_centroid_sql(m)} SELECT '{m}' AS mode, round(avg((y = pred)::INT), 6) AS acc, count(*) AS n FROM p)" for m in E.IMPUTE_MODES
))
def loso_accuracy(t):
    out = None
    for m in E.IMPUTE_MODES:
        part = E.accuracy(_loso(t, m)).select(F.lit(m).alias("mode"), r6("acc").alias("acc"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(_centroid_sql("nanmean") + """,
b AS (SELECT score AS s, sum((y = 1)::INT) AS p, sum((y <> 1)::INT) AS n FROM p GROUP BY score),
c AS (SELECT sum(p) OVER w AS cp, sum(n) OVER w AS cn, (SELECT sum(p) FROM b) AS tp, (SELECT sum(n) FROM b) AS tn
      FROM b WINDOW w AS (ORDER BY s DESC))
SELECT round(coalesce(min((cn / tn + 1 - cp / tp) / 2) FILTER (WHERE abs(cn / tn - (1 - cp / tp)) < 0.01), 1.0) * 100, 6) AS eer FROM c""")
def loso_eer(t):
    return E.equal_error_rate(_loso(t), "y", "score").withColumn("eer", r6("eer"))


@query("""
WITH r AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
b AS (SELECT s, sum((y = 1)::INT) AS p, sum((y <> 1)::INT) AS n FROM r GROUP BY s),
c AS (SELECT sum(p) OVER w AS cp, sum(n) OVER w AS cn, (SELECT sum(p) FROM b) AS tp, (SELECT sum(n) FROM b) AS tn
      FROM b WINDOW w AS (ORDER BY s DESC))
SELECT round(coalesce(min((cn / tn + 1 - cp / tp) / 2) FILTER (WHERE abs(cn / tn - (1 - cp / tp)) < 0.01), 1.0) * 100, 6) AS eer FROM c""")
def eer(t):
    rows = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    return E.equal_error_rate(rows, "quality", "n_chars").withColumn("eer", r6("eer"))


#: Rounds of boosting in registered queries; 300 are the default.
BOOSTING_ROUNDS = 30


def _fits(name):
    def run(t):
        rows = t("embeddings").select("vec_id", (F.col("vec_id") % 3).alias("grp"), (F.col("label") >= 5).cast("int").alias("y"), "embedding")
        learner = E.classifiers(rounds=300 if name == "svm" else BOOSTING_ROUNDS)[name]
        return E.per_group(E.loso_cv(rows, "vec_id", "grp", "y", "embedding", 64, learner), "grp", "vec_id").select("grp", "n", "acc")

    run.__name__ = f"loso_{name}"
    return run


for _name in ("rf", "gb", "lr", "svm", "xgb"):
    query()(_fits(_name))


@query()
def ablation_grid(t):
    rows = t("embeddings").select("vec_id", (F.col("vec_id") % 2).alias("grp"), (F.col("label") >= 5).cast("int").alias("y"), "embedding")
    sets = {"low": (F.slice("embedding", 1, 32), 32), "high": (F.slice("embedding", 33, 32), 32)}
    made = E.classifiers(rounds=BOOSTING_ROUNDS)
    return E.ablation_grid(rows, "vec_id", "grp", "y", sets, {n: made[n] for n in ("lr", "rf")})


def _half_sql(name: str, condition: str) -> str:
    return f"""
SELECT * FROM (WITH x AS (SELECT vec_id, vec_id % 2 AS g, (label >= 5)::INT AS y, i, v FROM (
  SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE {condition}),
m AS (SELECT f.g, y, i, avg(v) AS m FROM x, (SELECT DISTINCT g FROM x) f WHERE x.g <> f.g GROUP BY ALL),
d AS (SELECT vec_id, x.g, x.y, m.y AS cls, round(sum((v - m) ** 2), 6) AS d FROM x JOIN m ON x.g = m.g AND x.i = m.i GROUP BY ALL),
p AS (SELECT vec_id, y, arg_min(cls, (d, cls)) AS pred FROM d GROUP BY ALL)
SELECT '{name}' AS feature, 'centroid' AS classifier, round(avg((y = pred)::INT), 6) AS acc, 2::BIGINT AS n_train FROM p)"""


@query(_half_sql("low", "i < 32") + " UNION ALL " + _half_sql("high", "i >= 32"))
def ablation_centroid(t):
    rows = t("embeddings").select("vec_id", (F.col("vec_id") % 2).alias("grp"), (F.col("label") >= 5).cast("int").alias("y"), "embedding")
    sets = {"low": (F.slice("embedding", 1, 32), 32), "high": (F.slice("embedding", 33, 32), 32)}
    grid = E.ablation_grid(rows, "vec_id", "grp", "y", sets, {"centroid": "centroid"})
    return grid.select("feature", "classifier", r6("acc").alias("acc"), F.col("n_train").cast("long").alias("n_train"))


@query("""SELECT name, large FROM (VALUES ('alcaim', TRUE), ('cml_tts', TRUE), ('certas_palavras', FALSE), ('yodas', FALSE)) AS c(name, large) WHERE NOT large""")
def catalog_filter(t):
    from ..sources.corpora import registry

    names = ["alcaim", "cml_tts", "certas_palavras", "yodas"]
    return registry(t("region").sparkSession).where(F.col("name").isin(names) & ~F.col("large")).select("name", "large")
