"""Queries of lookups, joins and similarity over the knowledge stores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import prose as P
from sparkloom.operators import lookup as L
from sparkloom.operators import similarity as S
from sparkloom.plans.catalog import query
from sparkloom.plans.stores import store, stores_sql
from sparkloom.sources.tables import read


def _units(spark, sf_dir):
    return store(spark, sf_dir, "units")


# lookups and filters


@query(stores_sql("units") + " SELECT kind, count(*) AS units, count(*) FILTER (name = 'SmallRing0') AS named, count(*) FILTER (module = 'm1::small') AS members FROM units GROUP BY 1")
def p01_by_kind(spark, sf_dir):
    """Units of a kind, of a name and of a module."""
    return _units(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("units"), F.count_if(F.col("name") == "SmallRing0").alias("named"), F.count_if(F.col("module") == "m1::small").alias("members"))


@query(stores_sql("units") + " SELECT id, name FROM units WHERE contains(lower(name), 'ring') OR contains(lower(body), 'ring')")
def p02_f01_keyword(spark, sf_dir):
    """Units whose name or body holds a word, in any case."""
    u = _units(spark, sf_dir)
    return u.where(F.contains(F.lower("name"), F.lit("ring")) | F.contains(F.lower("body"), F.lit("ring"))).select("id", "name")


@query(stores_sql("units") + " SELECT id FROM units WHERE kind = 'struct' AND lower(language) = 'rust' AND lower(origin) IN ('brand#1', 'brand#7') AND starts_with(path, 'src/small')")
def p04_item_filter(spark, sf_dir):
    u = _units(spark, sf_dir)
    return u.where((F.col("kind") == "struct") & (F.lower("language") == "rust") & F.lower("origin").isin("brand#1", "brand#7") & F.col("path").startswith("src/small")).select("id")


@query(stores_sql("entries") + " SELECT kind, count(*) FILTER (superseded_by IS NULL) AS live, count(*) FILTER (superseded_by > 0) AS superseded, count(*) FILTER (superseded_by = 0) AS retracted FROM entries GROUP BY 1")
def p05_live(spark, sf_dir):
    """Live entries, those with a newer one, and those taken back."""
    s = F.col("superseded_by")
    return store(spark, sf_dir, "entries").groupBy("kind").agg(F.count_if(s.isNull()).alias("live"), F.count_if(s > 0).alias("superseded"), F.count_if(s == 0).alias("retracted"))


@query(stores_sql("units") + " SELECT id FROM units WHERE visibility <> 'private' AND (contains(path, 'small') OR contains(path, 'economy')) AND NOT contains(path, 'bolt')")
def p06_p07_included(spark, sf_dir):
    """What isn't private, on a path that is wanted and not excluded."""
    u = _units(spark, sf_dir)
    wanted = F.contains("path", F.lit("small")) | F.contains("path", F.lit("economy"))
    return u.where((F.col("visibility") != "private") & wanted & ~F.contains("path", F.lit("bolt"))).select("id")


_REQ = "req AS (SELECT CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN upper(substring(c_mktsegment, 1, 1)) || 'Ring1' ELSE CASE c_custkey % 2 WHEN 0 THEN 'smallring2' ELSE 'OldBolt3' END END AS q FROM customer)"


def _requests(spark, sf_dir):
    k = F.col("c_custkey")
    q = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lit("Ring1"))).otherwise(F.when(k % 2 == 0, "smallring2").otherwise("OldBolt3"))
    return read(spark, sf_dir, "customer").select(q.alias("q"))


@query(stores_sql("units") + ", " + _REQ + """, asked AS (SELECT DISTINCT q FROM req),
    m AS (SELECT q, u.*, CASE WHEN CAST(u.id AS VARCHAR) = q THEN 0 WHEN u.name = q THEN 1 WHEN lower(u.name) = lower(q) THEN 2 END AS rank FROM asked JOIN units u ON CAST(u.id AS VARCHAR) = q OR u.name = q OR lower(u.name) = lower(q)),
    b AS (SELECT *, min(rank) OVER (PARTITION BY q) AS least FROM m)
    SELECT q, id, ['id', 'name', 'case'][rank + 1] AS tier, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY len(string_split(module, '::')), -methods, id) AS place FROM b WHERE rank = least) WHERE place <= 5""")
def p08_p09_candidates(spark, sf_dir):
    """Requested names: by id, else by name, else in any case; shallow modules and many methods first."""
    u = _units(spark, sf_dir).select("id", "name", "module", "methods")
    q = F.col("q")
    keys = [("id", q, F.col("id").cast("string")), ("name", q, F.col("name")), ("case", F.lower(q), F.lower("name"))]
    found = L.tiers(_requests(spark, sf_dir), "q", u, keys, [F.size(F.split("module", "::")), F.desc("methods"), F.col("id")], 5)
    return found.select("q", "id", "tier", F.col("place").cast("long").alias("place"))


@query(stores_sql("units") + ", " + _REQ + """, asked AS (SELECT DISTINCT q FROM req),
    m AS (SELECT q, u.id, CASE WHEN CAST(u.id AS VARCHAR) = q THEN 0 WHEN lower(u.name) = lower(q) THEN 1 ELSE 2 END AS rank FROM asked JOIN units u ON CAST(u.id AS VARCHAR) = q OR lower(u.name) = lower(q) OR lower(substring(u.name, 1, 6)) = lower(substring(q, 1, 6)))
    SELECT q, id, ['id', 'name', 'start'][rank + 1] AS tier, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, id) AS place FROM m) WHERE place <= 7""")
def p10_graph_candidates(spark, sf_dir):
    """Candidates of all tiers in their order, each once, at most seven."""
    u = _units(spark, sf_dir).select("id", "name")
    q, start = F.col("q"), lambda c: F.lower(F.substring(c, 1, 6))
    keys = [("id", q, F.col("id").cast("string")), ("name", F.lower(q), F.lower("name")), ("start", start(q), start(F.col("name")))]
    return L.cascade(_requests(spark, sf_dir), "q", u, keys, "id", [F.col("id")], 7).select("q", "id", "tier", F.col("place").cast("long").alias("place"))


_EXT = "md|markdown|txt|html|htm|rst|adoc|csv|jsonl|log"
PROSE_FILE, TEST_FILE = rf"\.({_EXT})$", r"(^|/)(tests?|examples?)/|_test\.|\.test\.|_spec\."


@query("""WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'docs/a.MD' WHEN 1 THEN 'src/lib.rs' WHEN 2 THEN 'tests/it.rs' WHEN 3 THEN 'README' ELSE 'x/foo_test.go' END AS path FROM pages)
    SELECT page_id, page_id % 5 = 0 AS prose, page_id % 5 IN (2, 4) AS test FROM f""")
def p11_file_classes(spark, sf_dir):
    """Prose by its extension; tests and examples by folder or name."""
    names = F.array(*map(F.lit, ("docs/a.MD", "src/lib.rs", "tests/it.rs", "README", "x/foo_test.go")))
    p = read(spark, sf_dir, "pages").select("page_id", F.element_at(names, (F.col("page_id") % 5 + 1).cast("int")).alias("path"))
    return p.select("page_id", F.lower("path").rlike(PROSE_FILE).alias("prose"), F.lower("path").rlike(TEST_FILE).alias("test"))


@query(stores_sql("entries") + " SELECT project, kind, count(*) AS n FROM entries WHERE tags LIKE 'tag1,%' AND project IN (SELECT 'p' || CAST(label % 3 AS VARCHAR) FROM embeddings) GROUP BY 1, 2")
def p12_p13_tagged(spark, sf_dir):
    """Entries with a tag, of projects that a list of folders has."""
    folders = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), (F.col("label") % 3).cast("string")).alias("project"))
    e = store(spark, sf_dir, "entries").where(F.split("tags", ",")[0] == "tag1")
    return e.join(folders, "project", "left_semi").groupBy("project", "kind").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'assert:x is y' WHEN 1 THEN 'assert:x@t' WHEN 2 THEN 'rust:E1' ELSE 'other' END AS sig FROM events) SELECT event_id, sig FROM s WHERE NOT (sig LIKE 'assert:%' AND sig NOT LIKE '%@%')""")
def p14_legacy_dropped(spark, sf_dir):
    """Rows of an older shape go: those like one pattern and unlike another."""
    sig = F.element_at(F.array(*map(F.lit, ("assert:x is y", "assert:x@t", "rust:E1", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = read(spark, sf_dir, "events").select("event_id", sig.alias("sig"))
    return e.where(~(F.col("sig").like("assert:%") & ~F.col("sig").like("%@%")))


# joins


@query(stores_sql("units", "entries") + """, refs AS (SELECT DISTINCT id AS entry, id % (SELECT count(*) FROM units) AS unit FROM entries)
    SELECT e.id, e.kind, u.name, u.signature_changed_at FROM entries e JOIN refs r ON r.entry = e.id JOIN units u ON u.id = r.unit WHERE u.signature_changed_at > e.at AND e.superseded_by IS NULL""")
def j03_c12_m06_stale_entries(spark, sf_dir):
    """Live entries that refer to a unit whose signature changed after they were written."""
    u, e = _units(spark, sf_dir), store(spark, sf_dir, "entries")
    n = u.agg(F.count("*").alias("n"))
    refs = e.crossJoin(F.broadcast(n)).select(F.col("id").alias("entry"), (F.col("id") % F.col("n")).alias("unit")).distinct()
    changed = u.where("signature_changed_at is not null").select(F.col("id").alias("unit"), "name", "signature_changed_at")
    live = e.where("superseded_by is null").select(F.col("id").alias("entry"), "kind", "at")
    return live.join(refs, "entry").join(changed, "unit").where("signature_changed_at > at").select(F.col("entry").alias("id"), "kind", "name", "signature_changed_at")


@query(stores_sql("entries") + """, t AS (SELECT id, e.at, superseded_by, unnest(string_split(tags, ',')) AS tag FROM entries e)
    SELECT id, min(t.at) AS at, count(*) AS matched FROM t WHERE tag IN ('tag2', 'user', 'tag4') AND superseded_by IS NULL GROUP BY 1""")
def j04_by_tags(spark, sf_dir):
    """Accepted entries with any of some tags, each once."""
    wanted = F.array(*map(F.lit, ("tag2", "user", "tag4")))
    e = store(spark, sf_dir, "entries").where("superseded_by is null").withColumn("hit", F.array_intersect(F.split("tags", ","), wanted))
    return e.where(F.size("hit") > 0).select("id", "at", F.size("hit").cast("long").alias("matched"))


@query(stores_sql("gaps") + """, s AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'f' || CAST(session % 20 AS VARCHAR) ELSE 'g' || CAST(id % 30 AS VARCHAR) END AS file FROM gaps)
    SELECT o.id FROM s o WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.session = o.session AND p.at < o.at AND p.at > o.at - 400 AND (p.query = o.query OR p.file = o.file))""")
def j09_conditional_offers(spark, sf_dir):
    """Offers without an earlier one of the same topic or of the same file in the session, within a time.

    The last earlier row of each key decides, so two windows stand for the range join with an or.
    """
    s = store(spark, sf_dir, "gaps").withColumn("file", F.when(F.col("id") % 4 == 0, F.concat(F.lit("f"), (F.col("session") % 20).cast("string"))).otherwise(F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))))
    # rows of one moment don't see each other: a range that ends one before
    last = lambda key: F.max("at").over(W.partitionBy("session", key).orderBy("at").rangeBetween(W.unboundedPreceding, -1))
    recent = lambda c: F.coalesce(c > F.col("at") - 400, F.lit(False))
    return s.withColumns({"q": last("query"), "f": last("file")}).where(~(recent(F.col("q")) | recent(F.col("f")))).select("id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j11_not_asked(spark, sf_dir):
    """Keys that a list doesn't hold; the list has no nulls."""
    asked = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(asked, "c_custkey", "left_anti")


@query("""WITH done AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')) SELECT user_id, event_type, 'backfill' AS origin FROM done
    UNION ALL SELECT user_id, 'seen', 'own' FROM (SELECT DISTINCT user_id FROM events)""")
def j13_backfill(spark, sf_dir):
    """Rows that an older store implies, added to those of the new one."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type")
    old = e.where(F.col("event_type").isin("error", "purchase")).distinct().withColumn("origin", F.lit("backfill"))
    return old.unionByName(e.select("user_id").distinct().select("user_id", F.lit("seen").alias("event_type"), F.lit("own").alias("origin")))


@query(stores_sql("lines") + """, a AS (SELECT DISTINCT file, line FROM lines WHERE id % 3 = 0), q AS (SELECT id, file, line FROM lines WHERE id % 3 <> 0),
    n AS (SELECT q.id, q.line, (SELECT min(a.line) FROM a WHERE a.file = q.file AND a.line BETWEEN q.line AND q.line + 4) AS above, (SELECT max(a.line) FROM a WHERE a.file = q.file AND a.line <= q.line) AS below FROM q)
    SELECT id, coalesce(above, below) AS item_line, coalesce(CASE WHEN above IS NULL THEN below WHEN below IS NULL THEN above WHEN line - below <= above - line THEN below ELSE above END) AS nearest FROM n""")
def j22_j23_item_at(spark, sf_dir):
    """The item at a place: the next one within four lines, else the last before; and the nearest, the one before if equally near.

    Both sides run through one window over a file; no range join.
    """
    lines = store(spark, sf_dir, "lines").select("id", "file", "line")
    item = F.when(F.col("id") % 3 == 0, F.col("line"))
    w = W.partitionBy("file").orderBy("line")
    below = F.max(item).over(w.rangeBetween(W.unboundedPreceding, 0))
    above = F.min(item).over(w.rangeBetween(0, W.unboundedFollowing))
    n = lines.select("id", "line", below.alias("below"), above.alias("above")).where("id % 3 <> 0")
    near = F.when(F.col("above") <= F.col("line") + 4, F.col("above"))
    # a line further off than four still counts where nothing comes before
    at = F.coalesce(near, F.col("below"))
    nearest = F.when(near.isNull(), F.col("below")).when(F.col("below").isNull(), near).when(F.col("line") - F.col("below") <= near - F.col("line"), F.col("below")).otherwise(near)
    return n.select("id", at.alias("item_line"), nearest.alias("nearest"))


@query("""WITH s AS (SELECT l_suppkey AS f, l_orderkey AS id, l_orderkey - l_orderkey % 40 AS s, l_orderkey - l_orderkey % 40 + 3 + l_linenumber * 6 AS e FROM lineitem),
    d AS (SELECT DISTINCT f, s, e FROM s), q AS (SELECT DISTINCT f, id AS line FROM s)
    SELECT q.f, q.line, min(d.e - d.s) AS size, count(*) AS around FROM q JOIN d ON d.f = q.f AND q.line BETWEEN d.s AND d.e GROUP BY 1, 2""")
def j24_innermost(spark, sf_dir):
    """The smallest interval around a line, and how many there are; intervals are met in cells of forty lines, not file by file."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    s = l.select(F.col("l_suppkey").alias("f"), F.col("l_orderkey").alias("id"), (F.col("l_orderkey") - F.col("l_orderkey") % 40).alias("s"), "l_linenumber")
    d = s.select("f", "s", (F.col("s") + 3 + F.col("l_linenumber") * 6).alias("e")).distinct()
    d = d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / 40), F.floor(F.col("e") / 40))))
    q = s.select("f", F.col("id").alias("line"), F.floor(F.col("id") / 40).alias("cell")).distinct()
    hit = q.join(d, ["f", "cell"]).where("line between s and e")
    return hit.groupBy("f", "line").agg(F.min(F.col("e") - F.col("s")).alias("size"), F.count("*").alias("around"))


_TERMS = ("t AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(body), '[a-z_][a-z0-9_:.]*'), lambda x: length(x) >= 3 AND x NOT IN (" + ", ".join("'" + x.replace("'", "''") + "'" for x in P.SIMILARITY_STOP)
    + ")) ) AS term FROM d), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) + %d AS n FROM d), f AS (SELECT term, count(*) + %d AS df FROM c GROUP BY 1), "
    "r AS (SELECT id, term, (1 + ln(tf)) * ln(n / df) AS w FROM c JOIN f USING (term), n), z AS (SELECT id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1), v AS (SELECT id, term, w / norm AS w FROM r JOIN z USING (id) WHERE w > 0), "
    "p AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS cosine FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2)")  # fmt: skip


@query(stores_sql("entries") + ", d AS (SELECT id, body FROM entries), " + _TERMS % (0, 0) + """ SELECT a, b, round(cosine, 6) AS cosine FROM p JOIN entries x ON x.id = a JOIN entries y ON y.id = b
    WHERE cosine >= 0.35 AND x.project = y.project AND greatest(0, (x.used - x.reverted) / greatest(x.used, 1)) >= 0.1 AND greatest(0, (y.used - y.reverted) / greatest(y.used, 1)) >= 0.1""")
def j25_r09_l15_merge_candidates(spark, sf_dir):
    """Pairs of one project that are alike and have survived: candidates for a merge."""
    e = store(spark, sf_dir, "entries")
    kept = e.where(F.greatest(F.lit(0.0), (F.col("used") - F.col("reverted")) / F.greatest("used", F.lit(1))) >= 0.1).select("id", "project")
    pairs = S.similar_pairs(S.weighted_terms(e.select("id", "body"), "id", "body"), "id", 0.35, kept)
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(stores_sql("entries") + ", d AS (SELECT id, body FROM entries), " + _TERMS % (1, 1) + """, s AS (SELECT a AS id, b AS other, cosine FROM p UNION ALL SELECT b, a, cosine FROM p)
    SELECT id, arg_max(other, (round(cosine, 9), -other)) AS nearest, round(max(cosine), 6) AS cosine FROM s WHERE cosine >= 0.25 GROUP BY 1""")
def j26_r08_nearest(spark, sf_dir):
    """The nearest other entry of each, of those that are related at all; the entry itself counts as a document once more."""
    terms = S.weighted_terms(store(spark, sf_dir, "entries").select("id", "body"), "id", "body", extra=1)
    return S.nearest(terms, "id", 0.25).select("id", "nearest", F.round("cosine", 6).alias("cosine"))


@query(stores_sql("entries") + ", d AS (SELECT id, body FROM entries), " + _TERMS % (0, 0) + """, s AS (SELECT a AS id, b AS other, cosine FROM p WHERE cosine >= 0.25 UNION ALL SELECT b, a, cosine FROM p WHERE cosine >= 0.25),
    o AS (SELECT s.id, arg_max(other, (round(cosine, 9), -other)) AS nearest, max(cosine) AS cosine FROM s JOIN entries x ON x.id = s.id JOIN entries y ON y.id = s.other AND y.kind = x.kind AND y.at < x.at GROUP BY 1)
    SELECT e.id, nearest, round(cosine, 6) AS cosine, CASE WHEN cosine >= 0.9 THEN 'supersede' WHEN cosine >= 0.25 THEN 'pair' ELSE 'none' END AS rule FROM entries e LEFT JOIN o USING (id)""")
def j27_l16_l17_nearest_older(spark, sf_dir):
    """Each entry with the nearest older one of its kind, and what follows: nothing, a pair to look at, or a newer version of it."""
    e = store(spark, sf_dir, "entries").select("id", "body", "at", "kind")
    members, pairs = S.similar_classes(S.weighted_terms(e, "id", "body"), "id", 0.25)
    near = S.nearest_older(members, pairs.withColumn("cosine", F.round("cosine", 9)), e, "id", "at", "kind")
    return e.select("id").join(near, "id", "left").select("id", "nearest", F.round("cosine", 6).alias("cosine"), S.band(F.col("cosine")).alias("rule"))


@query(stores_sql("gaps", "entries") + """, g AS (SELECT DISTINCT session, lower(query) AS q FROM gaps), e AS (SELECT id, lower(body) AS b FROM entries)
    SELECT 'wall #' || s_suppkey AS cite, count(*) AS citing FROM supplier JOIN (SELECT conv_id, unnest(list_distinct(regexp_extract_all('see wall #' || conv_id % 30 || ' and wall #' || turn % 7, 'wall #([0-9]+)', 1))) AS n FROM conversations) c ON c.n = CAST(s_suppkey AS VARCHAR) GROUP BY 1""")
def j30_mentions(spark, sf_dir):
    """Entries that cite a number in their text, by the number."""
    c = read(spark, sf_dir, "conversations").select(F.format_string("see wall #%d and wall #%d", F.col("conv_id") % 30, F.col("turn") % 7).alias("t"))
    cites = c.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("wall #([0-9]+)"), 1))).alias("n")).select(F.col("n").cast("long").alias("s_suppkey"))
    known = read(spark, sf_dir, "supplier").select("s_suppkey")
    return cites.groupBy("s_suppkey").agg(F.count("*").alias("citing")).join(known, "s_suppkey").select(F.concat(F.lit("wall #"), F.col("s_suppkey").cast("string")).alias("cite"), "citing")


@query(stores_sql("walls") + """, n(name) AS (VALUES ('serde'), ('tokio-util'), ('tokio'), ('change')), w AS (SELECT id, unnest(list_distinct(regexp_split_to_array(lower(claim), '[^a-z0-9_-]+'))) AS word FROM walls)
    SELECT name, id FROM w JOIN n ON n.name = w.word""")
def j31_m23_packages(spark, sf_dir):
    """Limits that name a changed package as a whole word."""
    names = spark.createDataFrame([("serde",), ("tokio-util",), ("tokio",), ("change",)], "name string")
    w = store(spark, sf_dir, "walls").select("id", F.explode(F.array_distinct(F.split(F.lower("claim"), "[^a-z0-9_-]+"))).alias("name"))
    return w.join(names, "name", "left_semi").select("name", "id")


@query(stores_sql("calls") + """, u AS (SELECT id AS use_id, c.at, sess FROM calls c WHERE id % 2 = 0), r AS (SELECT id - 1 AS use_id, c.at, length(output) AS chars FROM calls c WHERE id % 2 = 1 AND id % 6 <> 1)
    SELECT u.use_id, r.at - u.at AS took, chars FROM u LEFT JOIN r USING (use_id)""")
def j32_tool_results(spark, sf_dir):
    """Tool calls with their results, by the id that both carry; a call without one keeps nulls."""
    c = store(spark, sf_dir, "calls")
    u = c.where("id % 2 = 0").select(F.col("id").alias("use_id"), "at")
    r = c.where("id % 2 = 1 and id % 6 <> 1").select((F.col("id") - 1).alias("use_id"), F.col("at").alias("done"), F.length("output").alias("chars"))
    return u.join(r, "use_id", "left").select("use_id", (F.col("done") - F.col("at")).alias("took"), "chars")


@query(stores_sql("gaps") + """ SELECT o.id, max(p.at) AS earlier FROM gaps o JOIN gaps p ON p.query = o.query AND p.tool = o.tool AND p.session <> o.session AND p.at < o.at - 3600 GROUP BY 1""")
def j33_recurrence(spark, sf_dir):
    """The last earlier push of the same topic in another session, more than an hour ago.

    Of all earlier rows only the last of two different sessions matter: one of them is another session's.
    """
    g = store(spark, sf_dir, "gaps")
    w = W.partitionBy("query", "tool").orderBy("at").rangeBetween(W.unboundedPreceding, -3601)
    # the last row before the run of the last one's session
    change = g.withColumn("prev", F.lag("session").over(W.partitionBy("query", "tool").orderBy("at", "id")))
    change = change.withColumn("before_run", F.when(F.col("prev") != F.col("session"), F.lag("at").over(W.partitionBy("query", "tool").orderBy("at", "id"))))
    run = change.withColumn("run_before", F.last("before_run", True).over(W.partitionBy("query", "tool").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)))
    seen = run.withColumn("l", F.max(F.struct("at", "session", "run_before")).over(w)).where("l is not null")
    earlier = F.when(F.col("l.session") != F.col("session"), F.col("l.at")).otherwise(F.col("l.run_before"))
    return seen.select("id", earlier.alias("earlier")).where("earlier is not null")


@query("""WITH keys AS (SELECT substring(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), 1, 40) AS k FROM documents UNION SELECT substring(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), 1, 40) FROM benchmark UNION SELECT lower(p_name) FROM part UNION SELECT lower(c_name) FROM customer
    UNION SELECT lower(s_name) FROM supplier UNION SELECT lower(url) FROM pages UNION SELECT lower(n_name) FROM nation),
    e AS (SELECT conv_id, turn, substring(lower(regexp_replace(trim(CASE WHEN turn % 3 = 0 THEN 'Small  ring' WHEN turn % 3 = 1 THEN text ELSE 'SUPPLIER#000000001' END), '\\s+', ' ', 'g')), 1, 40) AS k FROM conversations)
    SELECT turn % 3 AS class, count(*) AS n, count(*) FILTER (k IN (SELECT k FROM keys)) AS known FROM e GROUP BY 1""")
def j34_f17_coverage(spark, sf_dir):
    """How many captured entries seven stores know already, by the first 40 characters of what each is known by."""
    name = lambda table, col: read(spark, sf_dir, table).select(P.entry_key(F.col(col)).alias("k"))
    parts = [name("documents", "text"), name("benchmark", "text"), name("part", "p_name"), name("customer", "c_name"), name("supplier", "s_name"), name("pages", "url"), name("nation", "n_name")]
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.union(p)
    t = F.col("turn") % 3
    text = F.when(t == 0, "Small  ring").when(t == 1, F.col("text")).otherwise("SUPPLIER#000000001")
    e = read(spark, sf_dir, "conversations").select(t.alias("class"), P.entry_key(text).alias("k"))
    hit = e.join(keys.where("k is not null").distinct().withColumn("hit", F.lit(True)), "k", "left")
    return hit.groupBy("class").agg(F.count("*").alias("n"), F.count("hit").alias("known"))


@query("""WITH cues(cue) AS (VALUES ('the'), ('thand'), ('que'), ('zzz')) SELECT cue, count(*) FILTER (contains(lower(text), cue)) AS fires, count(*) FILTER (contains(lower(text), cue) AND role = 'user') AS hits FROM conversations CROSS JOIN cues GROUP BY 1""")
def j35_l23_cue_replay(spark, sf_dir):
    """Candidate cues replayed over all messages; the candidates are a fixed list, so their broadcast is bounded."""
    cues = spark.createDataFrame([("the",), ("thand",), ("que",), ("zzz",)], "cue string")
    both = read(spark, sf_dir, "conversations").crossJoin(F.broadcast(cues))
    fires = F.contains(F.lower("text"), F.col("cue"))
    return both.groupBy("cue").agg(F.count_if(fires).alias("fires"), F.count_if(fires & (F.col("role") == "user")).alias("hits"))


@query(stores_sql("walls", "gaps") + """, p AS (SELECT DISTINCT lower(substring(claim, 1, 40)) AS text FROM walls), g AS (SELECT tool, query, count(*) AS seen FROM gaps GROUP BY 1, 2)
    SELECT tool, query, seen FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(text, substring(g.query, 3, 3)))""")
def j29_unproposed_gaps(spark, sf_dir):
    """Gaps whose words no proposal holds: substrings of a fixed length are looked up, not compared pair by pair."""
    p = store(spark, sf_dir, "walls").select(F.lower(F.substring("claim", 1, 40)).alias("t")).distinct()
    grams = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1))), lambda i: F.substring("t", i, F.lit(3)))).alias("g")).distinct()
    g = store(spark, sf_dir, "gaps").groupBy("tool", "query").agg(F.count("*").alias("seen")).withColumn("g", F.substring("query", 3, 3))
    return g.join(grams, "g", "left_anti").select("tool", "query", "seen")
