"""Further queries: listings, history, delivery states, rules of the learning loop, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import text as X
from sparkloom.functions.prose import token_estimate
from sparkloom.operators import graph as G
from sparkloom.plans.catalog import _E, _G, _TOK, QUERY, _documents, query
from sparkloom.sources.work import Tables
from sparkloom.sources.tables import events, graph, outcomes, read
from sparkloom.streaming import jobs as J
from sparkloom.streaming import sessions as ST

# aggregations


@query("SELECT count(*) AS answers, count(*) FILTER (quality <> toxic) AS agree, count(*) >= 20 AND count(*) FILTER (quality <> toxic) >= 0.9 * count(*) AS calibrated FROM labels")
def a08_l20_calibration(spark, sf_dir):
    """A judge counts as calibrated from 20 answers on, with nine of ten in agreement."""
    d = read(spark, sf_dir, "labels").agg(F.count("*").alias("answers"), F.count_if(F.col("quality") != F.col("toxic")).alias("agree"))
    return d.withColumn("calibrated", (F.col("answers") >= 20) & (F.col("agree") >= 0.9 * F.col("answers")))


@query("""WITH t AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents),
    n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1)
    SELECT lang, term, count(*) AS members FROM t JOIN n USING (lang) GROUP BY lang, term, docs HAVING count(*) * 2 >= docs""")
def a18_shared_by_half(spark, sf_dir):
    """Terms that at least half of a group's members have."""
    d = read(spark, sf_dir, "documents")
    n = d.groupBy("lang").agg(F.count("*").alias("docs"))
    terms = d.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("term"))
    found = terms.groupBy("lang", "term").agg(F.count("*").alias("members")).join(n, "lang")
    return found.where("members * 2 >= docs").select("lang", "term", "members")


@query("""WITH c AS (SELECT event_type, props, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT event_type, arg_min(props, (-n, props)) AS most FROM c WHERE props IS NOT NULL GROUP BY 1)
    SELECT event_type, round(avg(value), 6) AS average, count(*) FILTER (value < 10) AS low, any_value(most) AS most FROM events LEFT JOIN m USING (event_type) GROUP BY 1""")
def a20_fidelity(spark, sf_dir):
    """Average, number of low values, and the most frequent detail; of equally frequent ones the first."""
    per = read(spark, sf_dir, "events").groupBy("event_type", "props").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count("value").alias("values"), F.count_if(F.col("value") < 10).alias("low"))
    first = F.min(F.when(F.col("props").isNotNull(), F.struct((-F.col("n")).alias("n"), "props")))
    agg = per.groupBy("event_type").agg(F.sum("total").alias("t"), F.sum("values").alias("v"), F.sum("low").alias("low"), first.alias("first"))
    return agg.select("event_type", F.round(F.col("t") / F.col("v"), 6).alias("average"), "low", F.col("first.props").alias("most"))


@query("SELECT c_nationkey AS community, count(*) AS size, min(c_custkey) AS first_member, max(c_custkey) AS last_member FROM customer GROUP BY 1")
def a21_community_sizes(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("community"))
    return c.agg(F.count("*").alias("size"), F.min("c_custkey").alias("first_member"), F.max("c_custkey").alias("last_member"))


@query("SELECT sha256(concat_ws(':', count(*), count(lang), sum(n_chars)::BIGINT, max(doc_id))) AS version FROM documents")
def a25_fingerprint(spark, sf_dir):
    """One digest of counts, sums and the largest id; it changes when the table does."""
    parts = F.count("*"), F.count("lang"), F.sum("n_chars"), F.max("doc_id")
    return read(spark, sf_dir, "documents").agg(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256).alias("version"))


# ordered analytics


@query(_E + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM e WHERE event_type IN ('error', 'purchase'))
    SELECT user_id, event_id, event_type = 'purchase' AS passed FROM r WHERE i = 1""")
def w02_w03_last_run(spark, sf_dir):
    """The last run of each command decides whether it is green."""
    last = outcomes(events(spark, sf_dir)).groupBy("user_id").agg(F.max_by(F.struct("event_id", "passed"), "event_id").alias("l"))
    return last.select("user_id", "l.event_id", "l.passed")


@query(_E + " SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM e GROUP BY 1")
def w06_first_call(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


@query("SELECT sha256(coalesce(text, '')) AS message, arg_min(conv_id, (conv_id, turn)) AS conv_id, arg_min(turn, (conv_id, turn)) AS turn, count(*) AS copies FROM conversations GROUP BY 1")
def w07_first_seen(spark, sf_dir):
    """Each message once, where it came first; the digest is the key that moves, not the text."""
    c = read(spark, sf_dir, "conversations").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("message"), "conv_id", "turn")
    return c.groupBy("message").agg(F.min(F.struct("conv_id", "turn")).alias("at"), F.count("*").alias("copies")).select("message", "at.conv_id", "at.turn", "copies")


@query(_E + " SELECT sess, event_id, row_number() OVER (PARTITION BY sess ORDER BY event_id) AS version, event_id = max(event_id) OVER (PARTITION BY sess) AS latest FROM e")
def w08_versions(spark, sf_dir):
    w = W.partitionBy("sess")
    e = events(spark, sf_dir).select("sess", "event_id")
    return e.select("sess", "event_id", F.row_number().over(w.orderBy("event_id")).cast("long").alias("version"), (F.col("event_id") == F.max("event_id").over(w)).alias("latest"))


@query(_E + """ SELECT sess, list_reduce(list_prepend(0, list(k ORDER BY event_id)), lambda a, x: CASE WHEN a + x <= 100 THEN a + x ELSE a END) AS admitted
    FROM e WHERE k IS NOT NULL GROUP BY 1""")
def w11_budget_admission(spark, sf_dir):
    """Takes what still fits, in order, and skips what doesn't: a fold, not a prefix. A session's items are few."""
    items = events(spark, sf_dir).where("k is not null").groupBy("sess").agg(F.array_sort(F.collect_list(F.struct("event_id", "k"))).alias("items"))
    fold = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: F.when(a + x["k"] <= 100, a + x["k"]).otherwise(a))
    return items.select("sess", fold.alias("admitted"))


@query("""WITH t AS (SELECT conv_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations))
    SELECT conv_id, count(*) FILTER (used <= 500) AS listed, count(*) FILTER (used > 500) AS left_over, coalesce(max(used) FILTER (used <= 500), 0)::BIGINT AS chars FROM t GROUP BY 1""")
def w12_char_budget(spark, sf_dir):
    """How many turns fit a budget of 500 characters, and how many are left over."""
    c = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    used = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(W.unboundedPreceding, 0))
    fits = F.col("used") <= 500
    agg = c.select("conv_id", used.alias("used")).groupBy("conv_id")
    return agg.agg(F.count_if(fits).alias("listed"), F.count_if(~fits).alias("left_over"), F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).cast("long").alias("chars"))


@query(_E + """, p AS (SELECT *, lag(sess) OVER (PARTITION BY user_id ORDER BY sess) AS previous FROM (SELECT DISTINCT user_id, sess FROM e)) SELECT * FROM p""")
def w17_previous_snapshot(spark, sf_dir):
    s = events(spark, sf_dir).select("user_id", "sess").distinct()
    return s.withColumn("previous", F.lag("sess").over(W.partitionBy("user_id").orderBy("sess")))


@query(_E + " SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM e GROUP BY 1, 2")
def w15_recent_distinct(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


# joins and sets


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j06_pending(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j10_already_seen(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 0) AS last_order FROM customer")
def j12_latest_or_zero(spark, sf_dir):
    last = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("m"))
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return c.join(last, "c_custkey", "left").select("c_custkey", F.coalesce("m", F.lit(0)).alias("last_order"))


@query(_E + """, v AS (SELECT *, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS view_id FROM e)
    SELECT event_id, user_id, view_id FROM v WHERE event_type = 'error'""")
def j22_j27_as_of(spark, sf_dir):
    """Each error with the same user's latest earlier view: one window over both sides, so no range join."""
    before = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    e = read(spark, sf_dir, "events").where("event_type in ('error', 'view')").select("event_id", "user_id", "event_type")
    seen = e.withColumn("view_id", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(before))
    return seen.where("event_type = 'error'").select("event_id", "user_id", "view_id")


@query("SELECT q.conv_id, q.turn, length(q.text) AS asked, length(a.text) AS answered FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def j32_event_pairs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("n").alias("asked"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("answered"))
    return q.join(a, ["conv_id", "turn"])


@query("""WITH k AS (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark)
    SELECT source, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE k.doc_id = d.doc_id)) AS known FROM documents d GROUP BY 1""")
def j34_known_keys(spark, sf_dir):
    """How many entries of each source other stores know already."""
    known = read(spark, sf_dir, "labels").select("doc_id").union(read(spark, sf_dir, "benchmark").select("item_id")).distinct().withColumn("hit", F.lit(True))
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(known, "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("known"))


@query("SELECT doc_id AS id, CASE WHEN toxic IS NULL THEN 'documents' ELSE 'labels' END AS origin FROM documents LEFT JOIN labels USING (doc_id)")
def u02_override(spark, sf_dir):
    """Two stores as one; of a key in both, the second store's row stays."""
    a = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("rank"), F.lit("documents").alias("origin"))
    b = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("rank"), F.lit("labels").alias("origin"))
    return a.union(b).groupBy("id").agg(F.max_by("origin", "rank").alias("origin"))


@query("""WITH u AS (SELECT user_id, bool_or(event_type = 'error') AS a, bool_or(event_type = 'purchase') AS b FROM events GROUP BY 1)
    SELECT count(*) FILTER (a AND b) AS both_sets, count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND NOT b) AS only_first FROM u""")
def u03_u04_set_sizes(spark, sf_dir):
    """Intersection, union and difference in one pass by flags on each member."""
    has = lambda t: F.bool_or(F.col("event_type") == t)
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(has("error").alias("a"), has("purchase").alias("b"))
    a, b = F.col("a"), F.col("b")
    return u.agg(F.count_if(a & b).alias("both_sets"), F.count_if(a | b).alias("either"), F.count_if(a & ~b).alias("only_first"))


# retrieval and listings


_BUCKET = "CASE WHEN lower(p_name) = 'green' THEN 3000 WHEN lower(p_name) LIKE 'green%' THEN 2000 WHEN lower(p_name) LIKE '%green%' THEN 1000 WHEN lower(p_type) LIKE '%brass%' THEN 100 WHEN lower(p_brand) LIKE '%1%' THEN 50 END"


@query(f"SELECT p_partkey, {_BUCKET} AS score FROM part WHERE {_BUCKET} IS NOT NULL")
def r17_p03_search_buckets(spark, sf_dir):
    """Equal names before names that start with the term, that hold it, and hits in other columns."""
    name = F.lower("p_name")
    score = F.when(name == "green", 3000).when(name.startswith("green"), 2000).when(name.contains("green"), 1000)
    score = score.when(F.lower("p_type").contains("brass"), 100).when(F.lower("p_brand").contains("1"), 50)
    return read(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score is not null")


@query(_E + ", m AS (SELECT max(secs) - 604800 AS since FROM e) SELECT event_type, count(*) FILTER (secs > since OR k = 7) AS listed, count(*) FILTER (NOT (secs > since OR coalesce(k = 7, false))) AS older FROM e, m GROUP BY 1")
def r24_delta_since(spark, sf_dir):
    """Entries newer than a week before the last, or picked by the hint, are listed; the others are counted."""
    e = events(spark, sf_dir)
    chosen = (F.col("at") > F.col("last") - 604800) | F.coalesce(F.col("k") == 7, F.lit(False))
    both = e.crossJoin(F.broadcast(e.agg(F.max("at").alias("last"))))  # a single row
    return both.groupBy("event_type").agg(F.count_if(chosen).alias("listed"), F.count_if(~chosen).alias("older"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT doc_id, line_no::BIGINT AS line_no, length(line) AS chars FROM l WHERE regexp_matches(line, '(?i)licen[cs]e')""")
def r25_r27_line_search(spark, sf_dir):
    """Lines that match a pattern, with their place; documents without a match don't leave the scan."""
    d = read(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)licen[cs]e"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").rlike("(?i)licen[cs]e"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.length("line").alias("chars"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 1000 THEN 1 ELSE 2 END AS tier,
    row_number() OVER (PARTITION BY CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 1000 THEN 1 ELSE 2 END ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier QUALIFY place <= 25""")
def o04_o06_tiers(spark, sf_dir):
    """The first 25 of each tier."""
    tier = F.when(F.col("s_acctbal") < 0, 0).when(F.col("s_acctbal") < 1000, 1).otherwise(2)
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", tier.alias("tier"))
    place = F.row_number().over(W.partitionBy("tier").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return s.select("s_suppkey", "tier", place.cast("long").alias("place")).where("place <= 25")


@query("""SELECT doc_id, regexp_matches(source, '(^|[_.-])(gen|generated|min)([_.-]|$)') OR len(list_filter(string_split(text, chr(10)), lambda l: strlen(l) > 5000)) > 0 AS generated FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)""")
def s03_generated(spark, sf_dir):
    """Generated files by name, or by a line of more than 5,000 bytes."""
    long_line = F.exists(F.split("text", "\n"), lambda x: F.octet_length(x) > 5000)
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", (F.col("source").rlike("(^|[_.-])(gen|generated|min)([_.-]|$)") | long_line).alias("generated"))


# functions


@query("SELECT page_id, replace(lower(regexp_extract(url, '//([^./]+)', 1)), '_', '') AS key, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages")
def f23_f24_boundary_keys(spark, sf_dir):
    u = F.col("url")
    key = F.replace(F.lower(F.regexp_extract(u, r"//([^./]+)", 1)), F.lit("_"), F.lit(""))
    return read(spark, sf_dir, "pages").select("page_id", key.alias("key"), F.regexp_extract(u, r"[?&]page=([0-9]+)", 1).alias("page"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: regexp_matches(t, '^[A-Z]')))) AS type_tokens FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def f14_type_tokens(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0)
    found = F.array_distinct(F.filter(words, lambda t: t.rlike("^[A-Z]")))
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.size(found).cast("long").alias("type_tokens"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, len(json_keys(props)) AS fields FROM events")
def f46_f47_json(spark, sf_dir):
    p = F.col("props")
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(p, "$.k").cast("long").alias("k"), F.size(F.json_object_keys(p)).cast("long").alias("fields"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS l FROM benchmark), g AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(l) - 1, 1)), lambda i: array_to_string(l[i:i+2], ' '))) AS gram FROM w)
    SELECT gram, count(*) AS n, count(DISTINCT item_id) AS items FROM g GROUP BY 1""")
def f49_l24_ngrams(spark, sf_dir):
    """Three-word runs with their counts, and in how many items they occur."""
    w = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("l")).where(F.size("l") >= 3)
    grams = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.array_join(F.slice("l", i, 3), " "))).alias("gram"))
    per_item = grams.groupBy("gram", "item_id").agg(F.count("*").alias("c"))
    return per_item.groupBy("gram").agg(F.sum("c").alias("n"), F.count("*").alias("items"))


@query("SELECT doc_id, sha256(concat_ws('|', lang, text)) AS content_hash, greatest(1, strlen(coalesce(text, '')) // 4)::BIGINT AS token_estimate FROM documents")
def f41_f44_hash_and_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("content_hash"), token_estimate(F.col("text")).alias("token_estimate"))


# delivery, states and the learning loop


@query(_E + """, m AS (SELECT max(secs) AS now FROM e), s AS (SELECT event_type, max(secs) AS last_at, count(*) AS n FROM e GROUP BY 1),
    d(event_type, days) AS (VALUES ('error', 7), ('purchase', 1), ('refund', 3))
    SELECT d.event_type, CASE WHEN n IS NULL THEN 'never' WHEN now - last_at <= days * 86400 THEN 'live' ELSE 'idle' END AS status FROM d CROSS JOIN m LEFT JOIN s USING (event_type)""")
def x08_liveness(spark, sf_dir):
    """Mechanisms against the days in which each should have been seen."""
    e = events(spark, sf_dir)
    d = spark.createDataFrame([("error", 7), ("purchase", 1), ("refund", 3)], "event_type string, days int")
    seen = e.groupBy("event_type").agg(F.max("at").alias("last_at"))
    both = d.join(seen, "event_type", "left").crossJoin(F.broadcast(e.agg(F.max("at").alias("now"))))  # a single row
    status = F.when(F.col("last_at").isNull(), "never").when(F.col("now") - F.col("last_at") <= F.col("days") * 86400, "live").otherwise("idle")
    return both.select("event_type", status.alias("status"))


@query(_E + " SELECT user_id, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'view') AND bool_or(event_type = 'click') AS complete FROM e GROUP BY 1")
def x13_protocol_steps(spark, sf_dir):
    has = lambda t: F.bool_or(F.col("event_type") == t)
    d = read(spark, sf_dir, "events").groupBy("user_id").agg(has("view").alias("viewed"), has("click").alias("clicked"))
    return d.withColumn("complete", F.col("viewed") & F.col("clicked"))


@query(_E + """ SELECT user_id, k, max(secs) AS written, arg_max(value, (secs, event_id)) AS kept, count(*) AS drafts FROM e WHERE k IS NOT NULL GROUP BY 1, 2""")
def x11_late_arrival(spark, sf_dir):
    """The entry written last stays, whatever arrived last."""
    e = events(spark, sf_dir).where("k is not null").groupBy("user_id", "k")
    return e.agg(F.max("at").alias("written"), F.max_by("value", F.struct("at", "event_id")).alias("kept"), F.count("*").alias("drafts"))


@query(_E + """, m AS (SELECT max(secs) - 2592000 AS since FROM e) SELECT k, count(*) AS seen FROM e, m WHERE event_type = 'error' AND secs >= since AND k IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY seen DESC, k LIMIT 20""")
def l03_gap_proposals(spark, sf_dir):
    """The twenty gaps seen most in the last 30 days, three times or more."""
    e = events(spark, sf_dir)
    recent = e.crossJoin(F.broadcast(e.agg((F.max("at") - 2592000).alias("since")))).where("event_type = 'error' and at >= since and k is not null")
    return recent.groupBy("k").agg(F.count("*").alias("seen")).where("seen >= 3").orderBy(F.desc("seen"), "k").limit(20)


@query(_E + " SELECT user_id, least(count(*) FILTER (event_type = 'purchase'), 10) / 10 AS credibility, ceil(count(*) * (0.5 + 0.25 * count(*) FILTER (event_type = 'purchase')))::BIGINT AS weight FROM e GROUP BY 1")
def l13_l11_credibility(spark, sf_dir):
    """Ten passes are full credibility; evidence weighs ceil(h (0.5 + 0.25 p)) for h hits and p passes."""
    passes = F.count_if(F.col("event_type") == "purchase")
    d = read(spark, sf_dir, "events").groupBy("user_id").agg(passes.alias("p"), F.count("*").alias("h"))
    return d.select("user_id", (F.least("p", F.lit(10)) / 10).alias("credibility"), F.ceil(F.col("h") * (0.5 + 0.25 * F.col("p"))).alias("weight"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN avg(l_discount) < 0.04 THEN 'low' WHEN avg(l_discount) < 0.08 THEN 'fair' ELSE 'good' END AS health FROM lineitem GROUP BY 1, 2")
def m08_health_markers(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_discount").alias("d"))
    return d.select("l_returnflag", "l_linestatus", "n", F.when(F.col("d") < 0.04, "low").when(F.col("d") < 0.08, "fair").otherwise("good").alias("health"))


@query(_E + """, f AS (SELECT sess, event_type, min(event_id) AS first_id FROM e GROUP BY 1, 2)
    SELECT sess, string_agg(event_type, '>' ORDER BY first_id) AS tools FROM f GROUP BY 1""")
def m09_m10_session_tools(spark, sf_dir):
    """A session's tools in order of first use; kinds of tools are few."""
    f = events(spark, sf_dir).groupBy("sess", "event_type").agg(F.min("event_id").alias("first_id"))
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "event_type")))
    return f.groupBy("sess").agg(F.array_join(ordered["event_type"], ">").alias("tools"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'no name' WHEN p_size <= 0 THEN 'no size' WHEN p_retailprice < 950 THEN 'no fact' END, 'ok') AS verdict FROM part")
def l29_record_rules(spark, sf_dir):
    """Each record with the first rule it breaks."""
    bad = F.when(F.col("p_name").isNull() | (F.trim("p_name") == ""), "no name").when(F.col("p_size") <= 0, "no size").when(F.col("p_retailprice") < 950, "no fact")
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(bad, F.lit("ok")).alias("verdict"))


# graphs


@query(_G + """, p AS (SELECT 'o:1' AS node, ['o:1'] AS path, 0 AS d UNION ALL SELECT to_id, list_append(path, to_id), d + 1 FROM p JOIN g ON from_id = node WHERE d < 4)
    SELECT node, array_to_string(arg_min(path, (d, path)), ' > ') AS path FROM p GROUP BY 1""")
def g08_dependency_path(spark, sf_dir):
    found = G.shortest_paths(graph(spark, sf_dir), spark.createDataFrame([("o:1",)], "node string"), 4)
    return found.select("node", F.array_join("path", " > ").alias("path"))


@query(_G + " SELECT b.to_id AS node, count(DISTINCT a.from_id) AS transitive, true AS deep FROM g a JOIN g b ON a.to_id = b.from_id GROUP BY 1")
def g11_transitive_impact(spark, sf_dir):
    return G.second_hop(graph(spark, sf_dir))


@query("""WITH s AS (SELECT c_nationkey, avg((c_acctbal < 0)::INT) AS drift FROM customer GROUP BY 1)
    SELECT c_nationkey, CASE WHEN drift >= 0.5 THEN 3.0 WHEN drift >= 0.3 THEN 2.0 WHEN drift >= 0.1 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight, drift >= 0.3 AS high FROM s""")
def g13_priority_weights(spark, sf_dir):
    s = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") < 0).cast("int")).alias("drift"))
    d = F.col("drift")
    weight = F.when(d >= 0.5, 3.0).when(d >= 0.3, 2.0).when(d >= 0.1, 1.5).otherwise(1.0)
    return s.select("c_nationkey", weight.alias("weight"), (d >= 0.3).alias("high"))


# ranking with term weights


@query(f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK % 3}) AS term FROM documents) GROUP BY 1, 2),
    f AS (SELECT term, ln((SELECT count(*) FROM documents) * 1.0 / count(*)) + 1 AS idf FROM p GROUP BY 1),
    w AS (SELECT doc_id, term, tf * idf AS w, CASE WHEN term IN ('that', 'therein', 'reation') THEN idf ELSE 0 END AS q FROM p JOIN f USING (term)),
    z AS (SELECT sqrt(sum(idf * idf)) AS qn FROM f WHERE term IN ('that', 'therein', 'reation'))
    SELECT doc_id, round(sum(w * q) / (sqrt(sum(w * w)) * any_value(qn)), 6) AS cosine FROM w, z GROUP BY 1 HAVING sum(w * q) > 0""")
def r10_tfidf_cosine(spark, sf_dir):
    """Documents by the cosine of their weighted terms with a query's; weights are tf (ln(n / df) + 1), from the stored postings."""
    index = _documents(spark, sf_dir)
    p = index.postings.where(F.octet_length("term") >= 3).select(F.col("key").alias("doc_id"), "term", "tf")
    idf = p.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(index.corpus)).select("term", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"))
    idf = Tables(spark, "idf").written(idf)  # its size is known then, and a small one goes to the postings instead of these to it
    wanted = F.col("term").isin(*QUERY)
    size = idf.where(wanted).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("qn"))
    w = p.join(idf, "term").select("doc_id", (F.col("tf") * F.col("idf")).alias("w"), F.when(wanted, F.col("idf")).otherwise(0.0).alias("q"))
    agg = w.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("dot > 0")
    return agg.crossJoin(F.broadcast(size)).select("doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("qn")), 6).alias("cosine"))


@query(f"""WITH w AS (SELECT item_id, list_distinct({_TOK % 1}) AS l FROM benchmark)
    SELECT item_id, list_contains(l, 'that')::INT + (len(list_filter(l, lambda x: starts_with(x, 'therei'))) > 0)::INT + (len(list_filter(l, lambda x: starts_with(x, 'reatio'))) > 0)::INT AS score FROM w WHERE score > 0""")
def r14_hint_score(spark, sf_dir):
    """Distinct tokens found as whole words, or as starts of words from six bytes on."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(X.tokens(F.col("text"), 1)).alias("l"))

    def hit(t):
        return (F.exists("l", lambda x: x.startswith(t)) if len(t.encode()) >= 6 else F.array_contains("l", t)).cast("int")

    score = hit("that") + hit("therei") + hit("reatio")
    return b.select("item_id", score.alias("score")).where("score > 0")


# functions of dates and paths


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) // 600 AS bucket FROM orders""")
def f33_f38_dates(spark, sf_dir):
    t = F.col("o_orderdate").cast("timestamp")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.floor(F.unix_timestamp(t) / 600).alias("bucket"))


@query("SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS host, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) - 1 AS segments FROM pages")
def f27_segments(spark, sf_dir):
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    return read(spark, sf_dir, "pages").select("page_id", parts[0].alias("host"), (F.size(parts) - 1).cast("long").alias("segments"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'error|failed|panic') THEN false WHEN regexp_matches(lower(text), 'passed|done|ok') THEN true END AS passed FROM conversations""")
def f11_classify(spark, sf_dir):
    """Signs of failure win over signs of success; a text with neither has no verdict."""
    t = F.lower("text")
    verdict = F.when(t.rlike("error|failed|panic"), False).when(t.rlike("passed|done|ok"), True)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", verdict.alias("passed"))


# streaming jobs


@query("SELECT event_type AS hook, count(*) AS fired, count(*) FILTER (value > 100) AS matched, CAST(floor(epoch_us(max(ts)) / 1000000) AS BIGINT) AS last_at FROM events GROUP BY 1")
def x07_heartbeats_stream(spark, sf_dir):
    """Counters kept by a streaming aggregation."""
    stream = J.with_seconds(J.stream_of(spark, f"{sf_dir}/events.parquet"))
    return J.totals_to(ST.heartbeats(stream), J.shared_folder(spark, "heartbeats"))


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def x05_first_push_stream(spark, sf_dir):
    """Each push once, by streaming keyed state."""
    stream = J.stream_of(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", "props")
    return J.append_to(J.first_of_each(stream, ["user_id", "event_type", "props"]), J.shared_folder(spark, "pushes"))
