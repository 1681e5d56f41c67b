"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import text as X
from sparkloom.operators import graph as G
from sparkloom.functions.prose import VECTOR_STOP, token_estimate
from sparkloom.operators import index as I
from sparkloom.operators import relational as R
from sparkloom.operators import retrieval as S
from sparkloom.plans.stores import store, stores_sql
from sparkloom.sources.tables import events, graph, outcomes, read
from sparkloom.streaming import sessions as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "r12_hybrid_search"
QUERY = ["that", "therein", "reation"]

_E = """WITH e AS (SELECT *, user_id || '_' || strftime(ts, '%Y-%m-%d') AS sess, CAST(props->>'k' AS BIGINT) AS k,
    CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS secs FROM events)"""
_G = """WITH RECURSIVE g AS (SELECT 'o:' || o_orderkey AS from_id, 'c:' || o_custkey AS to_id, 'uses' AS relation FROM orders
    UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'owns' FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'owns' FROM supplier
    UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'derived_from' FROM nation)"""
_STOPS = "(" + ", ".join(f"'{w}'" for w in VECTOR_STOP) + ")"
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: strlen(t) >= %d)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# telemetry: aggregations, distinct counts, top-k


@query(_E + """, w AS (SELECT CAST(floor(((SELECT max(secs) FROM e) - secs) / 1209600) AS BIGINT) AS back, event_type = 'purchase' AS passed FROM e WHERE event_type IN ('error', 'purchase')),
    a AS (SELECT back, count(*) AS runs, count(*) FILTER (passed) AS runs_passed, round(avg(passed::INT), 6) AS rate FROM w GROUP BY 1)
    SELECT a.*, CASE WHEN b.rate IS NULL THEN 'new' WHEN abs(a.rate - b.rate) <= 0.005 THEN 'flat' WHEN a.rate > b.rate THEN 'up' ELSE 'down' END AS trend FROM a LEFT JOIN a b ON b.back = a.back + 1""")
def a01_kpi_windows(spark, sf_dir):
    """Runs and pass rates of 14-day windows counted back from the last event, each against the one before."""
    e = events(spark, sf_dir)
    last = e.agg(F.max("at").alias("last"))
    w = outcomes(e).crossJoin(F.broadcast(last)).groupBy(F.floor((F.col("last") - F.col("at")) / 1209600).alias("back"))
    a = w.agg(F.count("*").alias("runs"), F.count_if("passed").alias("runs_passed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("rate"))
    b = a.select((F.col("back") - 1).alias("back"), F.col("rate").alias("was"))
    return a.join(b, "back", "left").select("back", "runs", "runs_passed", "rate", R.trend(F.col("rate"), F.col("was")).alias("trend"))


@query(_E + " SELECT count(*) AS sessions FROM (SELECT sess FROM e WHERE event_type = 'error' UNION SELECT sess FROM e WHERE event_type = 'purchase' UNION SELECT sess FROM e WHERE event_type = 'view' UNION SELECT sess FROM e WHERE event_type = 'click')")
def a02_sessions_worked(spark, sf_dir):
    e = events(spark, sf_dir)
    parts = [e.where(F.col("event_type") == t).select("sess") for t in ("error", "purchase", "view", "click")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).agg(F.count_distinct("sess").alias("sessions"))


@query(_E + " SELECT event_type, count(*) AS calls, count(DISTINCT (props, sess, secs // 600)) AS bursts FROM e GROUP BY 1")
def a03_bursts(spark, sf_dir):
    burst = F.struct("props", "sess", F.floor(F.col("at") / 600))
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("calls"), F.count_distinct(burst).alias("bursts"))


@query("SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1")
def a04_hot_tools(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool")


@query("SELECT event_type AS tool, count(*) AS n FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) GROUP BY 1")
def a05_hot_tools_recent(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(500).groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))


@query(_E + " SELECT event_type, count(*) AS n, sum(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS approved, round(avg((k % 4 = 0)::INT), 6) AS rate FROM e GROUP BY 1 HAVING count(*) >= 5")
def a06_approval_rates(spark, sf_dir):
    ok = (F.col("k") % 4 == 0).cast("int")
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(ok).alias("approved"), F.round(F.avg(ok), 6).alias("rate")).where("n >= 5")


@query("SELECT count(*) FILTER (toxic = 1) AS wrong, count(*) FILTER (toxic = 0 AND quality = 0) AS useless, count(*) FILTER (toxic = 0 AND quality = 1) AS fine FROM labels")
def a07_base_rate(spark, sf_dir):
    t, q = F.col("toxic"), F.col("quality")
    return read(spark, sf_dir, "labels").agg(F.count_if(t == 1).alias("wrong"), F.count_if((t == 0) & (q == 0)).alias("useless"), F.count_if((t == 0) & (q == 1)).alias("fine"))


@query(_E + " SELECT count(*) AS sessions, sum(p)::BIGINT AS green FROM (SELECT sess, arg_max((event_type = 'purchase')::INT, event_id) AS p FROM e WHERE event_type IN ('error', 'purchase') GROUP BY 1)")
def a09_ended_green(spark, sf_dir):
    last = outcomes(events(spark, sf_dir)).groupBy("sess").agg(F.max_by(F.col("passed").cast("int"), "event_id").alias("p"))
    return last.agg(F.count("*").alias("sessions"), F.sum("p").alias("green"))


@query("SELECT props, count(*) AS seen, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2 ORDER BY seen DESC, props LIMIT 20")
def a10_top_gaps(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type = 'error'").groupBy("props").agg(F.count("*").alias("seen"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return e.where("seen >= 2").orderBy(F.desc("seen"), "props").limit(20)


@query("""SELECT lang, l[n // 2 + 1] AS median, l[CAST(round((n - 1) * 0.9) AS INT) + 1] AS p90 FROM (SELECT lang, list_sort(list(n_chars)) AS l, count(*) AS n FROM documents GROUP BY 1)""")
def a13_a14_percentiles(spark, sf_dir):
    """Upper median and nearest-rank 90th percentile: values are counted first, so a group's window has its different values only."""
    per = read(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = W.partitionBy("lang").orderBy("n_chars")
    d = per.select("lang", "n_chars", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(W.partitionBy("lang")).alias("n"))
    at = lambda i: F.min(F.when(F.col("upto") >= i, F.col("n_chars")))
    return d.groupBy("lang").agg(at(F.floor(F.col("n") / 2) + 1).alias("median"), at(F.round((F.col("n") - 1) * 0.9) + 1).alias("p90"))


@query("""SELECT l_returnflag AS model, CAST(sum(l_quantity) AS DOUBLE) AS tokens, round(CAST(sum(l_quantity) AS DOUBLE) * CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'R' THEN 2.0 END, 6) AS cost FROM lineitem GROUP BY 1""")
def a15_cost_ledger(spark, sf_dir):
    """Amounts priced by model; a model without a price keeps its amount and has no cost."""
    used = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.sum("l_quantity").cast("double").alias("tokens"))
    price = F.when(F.col("model") == "A", 0.5).when(F.col("model") == "R", 2.0)
    return used.withColumn("cost", F.round(F.col("tokens") * price, 6))


@query("SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) * 1.0 / count(*)), 6) AS idf FROM (SELECT DISTINCT doc_id, unnest(" + _TOK % 3 + ") AS term FROM documents) GROUP BY 1")
def a16_document_frequency(spark, sf_dir):
    """In how many documents each word is; doc_id is a key."""
    return I.document_frequency(read(spark, sf_dir, "documents"), "text").select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def a22_breakdown(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT regexp_replace(line, '[0-9]+', '#', 'g') AS shape, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1 HAVING count(*) >= 2")
def a24_line_shapes(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(X.mask_numbers(F.col("line")).alias("shape")).agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line")).where("n >= 2")


# ordered analytics


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS size, sum(CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations)
    SELECT conv_id, turn, seg::BIGINT AS seg, least(greatest(size - coalesce(lag(size) OVER w, 0), 0), 100000)::BIGINT AS grown, (sum(size) OVER w)::BIGINT AS resident, row_number() OVER w <= 30 AS early
    FROM t WINDOW w AS (PARTITION BY conv_id, seg ORDER BY turn)""")
def w04_w05_segments(spark, sf_dir):
    """Growth and running size of a transcript, both starting anew at each boundary."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    c = c.withColumn("seg", F.sum((F.col("turn") % 4 == 3).cast("int")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy("conv_id", "seg").orderBy("turn")
    grown = F.least(F.greatest(F.col("size") - F.coalesce(F.lag("size").over(w), F.lit(0)), F.lit(0)), F.lit(100000))
    return c.select("conv_id", "turn", "seg", grown.cast("long").alias("grown"), F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("resident"), (F.row_number().over(w) <= 30).alias("early"))


@query(_E + """, j AS (SELECT k, ts, event_id, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'changed' END AS c FROM e),
    f AS (SELECT k, arg_min(c, (ts, event_id)) AS f, arg_max(c, (ts, event_id)) AS l, count(*) AS n FROM j GROUP BY 1)
    SELECT k, CASE WHEN f = 'added' THEN 'added' WHEN f = 'removed' AND l = 'added' THEN 'changed' WHEN l = 'removed' THEN 'removed' ELSE 'changed' END AS net, n FROM f WHERE NOT (f = 'added' AND l = 'removed')""")
def w10_net_changes(spark, sf_dir):
    change = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("changed")
    return R.net_changes(events(spark, sf_dir).withColumn("change", change), "k", ["ts", "event_id"])


@query("""WITH s AS (SELECT l_suppkey AS key, l_orderkey AS s, l_orderkey + l_linenumber * 3 AS e FROM lineitem),
    m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s),
    i AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT key, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY key, island""")
def w13_merge_intervals(spark, sf_dir):
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("s"), (F.col("l_orderkey") + F.col("l_linenumber") * 3).alias("e"))
    return R.merge_intervals(spans, "key", "s", "e")


@query(_E + " SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e WHERE event_type IN ('view', 'click')) WHERE n <= 12")
def w19_caps(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).select("user_id", "event_id", F.row_number().over(w).alias("n")).where("n <= 12").drop("n")


# joins


@query(_E + " SELECT event_id FROM e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND CAST(p.k AS VARCHAR) = CAST(e.k AS VARCHAR))")
def j07_undelivered(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", F.col("k").cast("string").alias("k"), "event_type")
    return e.where("event_type = 'error'").join(e.where("event_type = 'purchase'"), ["user_id", "k"], "left_anti").select("event_id")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 25")
def j08_o05_audit_sample(spark, sf_dir):
    """A repeatable sample of what has no audit: the lowest digests of the ids."""
    d = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return d.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(25)


@query("""WITH t AS (SELECT s_nationkey AS nation, s_suppkey % 40 AS name, s_suppkey AS target FROM supplier), c AS (SELECT c_custkey AS call, c_custkey % 40 AS name, c_nationkey AS nation FROM customer),
    p AS (SELECT name, count(*) AS n, min(target) AS only FROM t GROUP BY 1), o AS (SELECT name, nation, count(*) AS n, min(target) AS only FROM t GROUP BY 1, 2)
    SELECT call, c.name, c.nation, CASE WHEN p.n = 1 THEN p.only WHEN o.n = 1 THEN o.only END AS target FROM c JOIN p USING (name) LEFT JOIN o ON o.name = c.name AND o.nation = c.nation WHERE CASE WHEN p.n = 1 THEN p.only WHEN o.n = 1 THEN o.only END IS NOT NULL""")
def j15_unique_match(spark, sf_dir):
    t = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 40).alias("name"), F.col("s_suppkey").alias("target"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call"), (F.col("c_custkey") % 40).alias("name"), F.col("c_nationkey").alias("nation"))
    return R.unique_match(c, t, "name", "nation")


@query("""WITH d AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, sha256(text) AS h FROM d WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END) AS h FROM d WHERE doc_id % 7 <> 1)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def j21_c05_item_diff(spark, sf_dir):
    """Two versions of a set of items; contents meet as digests, so texts aren't shuffled."""
    d = read(spark, sf_dir, "documents")
    before = d.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    after = d.where("doc_id % 7 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("h"))
    return R.diff(before, after, "doc_id", "h")


@query("""WITH h AS (SELECT page_id AS id, 'provide' AS side, lower(regexp_extract(url, '^[a-z]+://[^/]*(/[^/?#]*)', 1)) AS key FROM pages
    UNION ALL SELECT page_id, 'consume', lower(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1))) FROM pages),
    l AS (SELECT key, min(CASE WHEN side = 'provide' THEN id END) AS provider, count(*) FILTER (side = 'consume') AS n_consumers FROM h GROUP BY 1)
    SELECT *, CASE WHEN provider IS NULL THEN 'no provider' WHEN n_consumers = 0 THEN 'no consumer' ELSE 'linked' END AS state FROM l""")
def j20_boundary_links(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    provide = p.select(F.col("page_id").alias("id"), F.lit("provide").alias("side"), F.lower(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^/?#]*)", 1)).alias("key"))
    consume = p.select(F.col("page_id").alias("id"), F.lit("consume").alias("side"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("key")).withColumn("key", F.lower("key"))
    return R.link_halves(provide.union(consume))


# retrieval


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + _TOK % 3 + ") AS term FROM documents) WHERE term NOT IN " + _STOPS + " GROUP BY 1, 2")
def r01_postings(spark, sf_dir):
    """Postings of the words that term vectors have: three bytes or more and not common."""
    return _vector_terms(_documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"))


def _documents(spark, sf_dir):
    """The stored index of the documents."""
    return I.build(read(spark, sf_dir, "documents"), "doc_id", ["text"], "documents")


def _vector_terms(index):
    return index.postings.where((F.octet_length("term") >= 3) & ~F.col("term").isin(*VECTOR_STOP))


@query("WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + _TOK % 3 + ") AS term FROM documents) WHERE term NOT IN " + _STOPS + " GROUP BY 1, 2) SELECT doc_id, term, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS w FROM p")
def r06_term_vectors(spark, sf_dir):
    """Term frequencies scaled to length 1; the norm lies beside each posting."""
    return _vector_terms(_documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "term", F.round(F.col("tf") / F.col("norm"), 6).alias("w"))


def _hits(t: str) -> str:
    return f"starts_with(w, '{t}')" if len(t) >= 6 else f"w = '{t}'"


_BM = (
    "c AS (SELECT doc_id, len(ws) AS len, " + ", ".join(f"len(list_filter(ws, lambda w: {_hits(t)})) AS f{i}" for i, t in enumerate(QUERY)) + " FROM (SELECT doc_id, " + _TOK % 1 + " AS ws FROM documents)), "
    "s AS (SELECT count(*) AS n, greatest(avg(len), 1) AS av, " + ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(QUERY))) + " FROM c), "
    "bm AS (SELECT doc_id, " + " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / av))" for i in range(len(QUERY))) + " AS score FROM c, s WHERE greatest(0, " + ", ".join(f"f{i}" for i in range(len(QUERY))) + ") > 0)"
)
_COS = (
    "p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + _TOK % 3 + ") AS term FROM documents) WHERE term NOT IN " + _STOPS + " GROUP BY 1, 2), "
    "cs AS (SELECT doc_id, sum(tf * CASE WHEN term IN (" + ", ".join(f"'{t}'" for t in QUERY) + f") THEN {1 / len(QUERY) ** 0.5!r}::DOUBLE ELSE 0 END) / sqrt(sum(tf * tf)) AS cosine FROM p GROUP BY 1)"
)


@query("WITH " + _BM + " SELECT doc_id, round(score, 6) AS score FROM bm")
def r05_bm25(spark, sf_dir):
    return I.bm25(_documents(spark, sf_dir), QUERY).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("WITH " + _COS + " SELECT doc_id, round(cosine, 6) AS cosine FROM cs WHERE cosine > 0 ORDER BY round(cosine, 6) DESC, doc_id LIMIT 20")
def r11_semantic_search(spark, sf_dir):
    found = I.cosine_to(_documents(spark, sf_dir), QUERY).select(F.col("key").alias("doc_id"), F.round("cosine", 6).alias("cosine"))
    return found.orderBy(F.desc("cosine"), "doc_id").limit(20)


# stems of the words that units have; those that aren't here are their own
_STEMS = "map {'docs': 'doc', 'economy': 'economi', 'fields': 'field', 'large': 'larg', 'methods': 'method'}"
_FTS = (
    "tx AS (SELECT id, f, unnest(list_transform(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), lambda x: coalesce(" + _STEMS + "[x], x))) AS term FROM "
    "(SELECT id, 10.0 AS f, name AS t FROM units UNION ALL SELECT id, 4.0, summary FROM units UNION ALL SELECT id, 1.0, body FROM units)), "
    "ln AS (SELECT id, count(*) AS len FROM tx GROUP BY 1), cp AS (SELECT (SELECT count(*) FROM units) AS n, sum(len) / (SELECT count(*) FROM units) AS av FROM ln), "
    "hf AS (SELECT id, term, sum(f) AS f FROM tx WHERE term IN (%s) GROUP BY 1, 2), hd AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM hf), "
    "ft AS (SELECT hd.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))) AS score, count(*) AS found FROM hd JOIN ln USING (id), cp GROUP BY 1)"
)


def _unit_texts(spark, sf_dir):
    return I.build(store(spark, sf_dir, "units"), "id", ["name", "summary", "body"], "units-stems", stemmed=True)


@query(stores_sql("units") + ", " + _FTS % "'larg', 'ring', 'economi'" + " SELECT id, round(score, 6) AS score, found = 3 AS every_word, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS place FROM ft QUALIFY place < 50")
def r04_j05_w01_full_text(spark, sf_dir):
    """Units by stemmed full text, names ten and summaries four times a body's weight; which hold every word; ranks from 0."""
    texts, query_ = _unit_texts(spark, sf_dir), ["Large", "rings", "economy"]
    every = I.full_text(texts, query_, [10, 4, 1], every=True).select("key", F.lit(True).alias("every"))
    best = I.full_text(texts, query_, [10, 4, 1]).orderBy(F.round("score", 9).desc(), "key").limit(50)
    place = F.row_number().over(W.orderBy(F.round("score", 9).desc(), "key")) - 1
    return best.withColumn("place", place.cast("long")).join(every, "key", "left").select(F.col("key").alias("id"), F.round("score", 6).alias("score"), F.coalesce("every", F.lit(False)).alias("every_word"), "place")


@query(stores_sql("units") + ", " + _FTS % "'larg', 'ring', 'economi'" + r""", vw AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(name || ' ' || summary || ' ' || body), '[^\p{L}\p{N}_]+'), lambda x: strlen(x) >= 3)) AS term FROM units) WHERE term NOT IN """ + _STOPS + """ GROUP BY 1, 2),
    cs AS (SELECT id, sum(CASE WHEN term IN ('large', 'rings', 'economy') THEN tf ELSE 0 END) / sqrt(3) / sqrt(sum(tf * tf)) AS c FROM vw GROUP BY 1), rk AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS lexical_rank FROM ft QUALIFY lexical_rank < 40),
    j AS (SELECT coalesce(cs.id, rk.id) AS id, coalesce(c, 0) AS c, lexical_rank FROM (SELECT * FROM cs WHERE c > 0) cs FULL JOIN rk ON rk.id = cs.id)
    SELECT id, round(c, 6) AS cosine, lexical_rank::INT AS lexical_rank, round(c + coalesce(greatest(0, 1 - c) * 0.55 / (1 + lexical_rank), 0), 6) AS score FROM j ORDER BY score DESC, id LIMIT 10""")
def r12_hybrid_search(spark, sf_dir):
    """Units by the cosine of their term vectors, lifted by their rank in weighted full text."""
    vectors = I.build(store(spark, sf_dir, "units"), "id", ["name", "summary", "body"], "units-words")
    return I.hybrid(vectors, _unit_texts(spark, sf_dir), ["large", "rings", "economy"], [10, 4, 1], 10).withColumnRenamed("key", "id")


@query("""SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'the and') THEN 20 WHEN h >= 2 THEN h ELSE 0 END AS score FROM (SELECT *, contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT AS h FROM documents)) WHERE score > 0""")
def r13_recall(spark, sf_dir):
    score = S.recall_score(F.col("text"), "the and", ["the", "and"])
    return read(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where("score > 0")


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(embedding, q), 5) AS cosine FROM embeddings, q WHERE vec_id <> 0 ORDER BY cosine DESC, vec_id LIMIT 10""")
def r07_dense_search(spark, sf_dir):
    """Cosine of every vector with one query vector; the query is one row, so its broadcast is bounded."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = v.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot(F.col("v"), F.col("q")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q")))
    return v.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", F.round(cos, 5).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


# graph


@query(_G + " SELECT relation, count(*) AS edges, count(DISTINCT from_id) AS sources, count(DISTINCT to_id) AS targets FROM g GROUP BY 1")
def g01_a11_graph_counts(spark, sf_dir):
    return graph(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("from_id").alias("sources"), F.count_distinct("to_id").alias("targets"))


@query(_G + " SELECT to_id, from_id FROM g WHERE relation = 'uses' GROUP BY 1, 2")
def g06_j02_used_by(spark, sf_dir):
    return graph(spark, sf_dir).where("relation = 'uses'").select("to_id", "from_id").distinct()


@query(_G + ", r AS (SELECT 's:1' AS node, 0 AS distance UNION SELECT 'o:1', 0 UNION ALL SELECT g.to_id, distance + 1 FROM r JOIN g ON g.from_id = r.node WHERE distance < 3) SELECT node, min(distance) AS distance FROM r GROUP BY 1")
def g07_subgraph(spark, sf_dir):
    roots = spark.createDataFrame([("s:1",), ("o:1",)], "node string")
    return G.reach(graph(spark, sf_dir), roots, 3)


@query(_G + """, n AS (SELECT from_id AS node FROM g UNION SELECT to_id FROM g), u AS (SELECT to_id AS node, count(DISTINCT from_id) AS a FROM g GROUP BY 1), d AS (SELECT from_id AS node, count(DISTINCT to_id) AS b FROM g GROUP BY 1),
    t AS (SELECT node, coalesce(a, 0) AS affected, coalesce(b, 0) AS depends FROM n LEFT JOIN u USING (node) LEFT JOIN d USING (node))
    SELECT *, CASE WHEN affected + depends // 2 <= 2 THEN 'low' WHEN affected + depends // 2 <= 7 THEN 'medium' ELSE 'high' END AS risk FROM t""")
def g10_impact(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.impact(g, g.select(F.col("from_id").alias("node")).union(g.select("to_id")).distinct())


@query("""WITH b AS (SELECT vec_id AS id, label AS a FROM embeddings WHERE vec_id % 10 <> 0), c AS (SELECT vec_id AS id, (label + 3) % 10 AS b FROM embeddings WHERE vec_id % 10 <> 1),
    p AS (SELECT a, b, count(*) AS m FROM b JOIN c USING (id) GROUP BY 1, 2)
    SELECT a, b, m AS "both", round(m / ((SELECT count(*) FROM b x WHERE x.a = p.a) + (SELECT count(*) FROM c y WHERE y.b = p.b) - m), 6) AS jaccard FROM p""")
def g12_j28_community_overlap(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    before = v.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    after = v.where("vec_id % 10 <> 1").select(F.col("vec_id").alias("id"), ((F.col("label") + 3) % 10).alias("community"))
    return G.community_overlap(before, after).withColumn("jaccard", F.round("jaccard", 6))


# identity, versions, pruning


@query("SELECT sha256(lang || '|' || text) AS hash, min(doc_id) AS doc_id, count(*) AS refs FROM documents GROUP BY 1")
def s19_s20_content_store(spark, sf_dir):
    """Content by digest with its first owner and its reference count."""
    return read(spark, sf_dir, "documents").groupBy(F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("refs"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def s25_prune_log(spark, sf_dir):
    return read(spark, sf_dir, "events").select("ts", "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("event_id")


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def s26_orphans(spark, sf_dir):
    keep = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey").join(keep, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT doc_id, round(CASE WHEN quality * 3 = 0 THEN CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END ELSE greatest(0.0, (quality * 3 - toxic) / (quality * 3)) END, 6) AS survival FROM labels")
def c11_survival(spark, sf_dir):
    use, rev = F.col("quality") * 3, F.col("toxic")
    rate = F.when(use == 0, F.when(rev == 1, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), (use - rev) / F.greatest(use, F.lit(1))))
    return read(spark, sf_dir, "labels").select("doc_id", F.round(rate, 6).alias("survival"))


# scalar functions


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 59) || '…' ELSE text END AS short, greatest(1, strlen(text) // 4)::BIGINT AS tokens FROM documents")
def f02_f44_clip(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.ellipsize(F.col("text"), 60).alias("short"), token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(text || CASE WHEN doc_id % 10 = 0 THEN ' ghp_' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 20) ELSE '' END, '\\b(ghp|gho|ghs|sk|pk|xoxb)[_-][A-Za-z0-9]{16,}', '\\1_[REDACTED]', 'g'),
    '(?i)\\b(token|password|secret|api_key)(\\s*[=:]\\s*)"[^"]*"', '\\1\\2"[REDACTED]"', 'g') AS clean FROM documents""")
def f12_scrub(spark, sf_dir):
    added = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" ghp_"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 20))).otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", X.scrub(F.concat("text", added)).alias("clean"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/(\\{[^/]*\\}|:[^/]+|[0-9]+)', '/*', 'g') AS key FROM pages")
def f22_path_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.path_key(F.col("url")).alias("key"))


# event time and delivery


@query(_E + " SELECT event_id, min(secs) OVER (PARTITION BY user_id ORDER BY secs RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) // 60 AS session_minute FROM e")
def x01_session_key(spark, sf_dir):
    return ST.session_key(events(spark, sf_dir)).select("event_id", "session_minute")


@query(_E + " SELECT 'err:' || k AS signature, count(*) AS seen, count(DISTINCT sess) AS sessions, min(secs) AS first_at, max(secs) AS last_at FROM e WHERE event_type = 'error' GROUP BY 1")
def x03_recurring_failures(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.groupBy(F.concat(F.lit("err:"), "k").alias("signature")).agg(F.count("*").alias("seen"), F.count_distinct("sess").alias("sessions"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query(_E + """, o AS (SELECT user_id, k, secs, event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY secs, event_id) AS n FROM e WHERE event_type = 'purchase')
    SELECT user_id, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY secs, event_id) AS m FROM o WHERE n = 1) WHERE m <= 4""")
def x05_deliver_once(spark, sf_dir):
    p = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "k", "at", "event_id")
    return ST.deliver_once(p, ["user_id", "k"], "at", "user_id", 4).select("user_id", "k", "event_id")


@query(_E + " SELECT o.event_id AS offer_id, min(s.secs) AS seen_at FROM e o LEFT JOIN e s ON s.event_type = 'purchase' AND s.user_id = o.user_id AND s.k = o.k AND s.secs BETWEEN o.secs AND o.secs + 86400 WHERE o.event_type = 'click' GROUP BY 1")
def x06_confirm_offers(spark, sf_dir):
    e = events(spark, sf_dir)
    offers = e.where("event_type = 'click'").select(F.col("event_id").alias("offer_id"), "user_id", "k", F.col("at").alias("offered"))
    return ST.confirm_offers(offers, e.where("event_type = 'purchase'").select("user_id", "k", F.col("at").alias("seen_at")), ["user_id", "k"])


@query(_E + " SELECT event_type AS hook, count(*) AS fired, count(*) FILTER (value > 100) AS matched, max(secs) AS last_at FROM e GROUP BY 1")
def x07_heartbeats(spark, sf_dir):
    return ST.heartbeats(events(spark, sf_dir))


# learning loop


@query("SELECT count(*) AS looked_at, count(*) FILTER (toxic = 1) AS bad, count(*) FILTER (toxic = 1) > 3 AS stop FROM (SELECT * FROM labels ORDER BY doc_id DESC LIMIT 20)")
def l19_w09_kill_switch(spark, sf_dir):
    last = read(spark, sf_dir, "labels").orderBy(F.desc("doc_id")).limit(20)
    return last.agg(F.count("*").alias("looked_at"), F.count_if(F.col("toxic") == 1).alias("bad"), (F.count_if(F.col("toxic") == 1) > 3).alias("stop"))
