"""Queries of sources and sinks: tables are written in foreign formats to the shared folder and read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.plans.catalog import _E, query
from sparkloom.plans.stores import store, stores_sql
from sparkloom.sources import files as S
from sparkloom.sources.tables import events, read
from sparkloom.streaming import jobs as J
from sparkloom.streaming import verdicts as V


def _folder(spark, name):
    return J.shared_folder(spark, name)


@query("""WITH p AS (SELECT CASE page_id % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'src/deep' WHEN 2 THEN 'target/x' ELSE 'logs' END AS dir, url FROM pages) SELECT dir, count(*) AS lines FROM p WHERE dir IN ('src', 'src/deep') GROUP BY 1""")
def s02_s04_source_tree(spark, sf_dir):
    """Lines of a tree of files without pruned and ignored folders."""
    d = F.col("page_id") % 4
    p = read(spark, sf_dir, "pages").select("url", F.when(d == 0, "src").when(d == 1, "src/deep").when(d == 2, "target/x").otherwise("logs").alias("dir"))
    folder = _folder(spark, "sources")
    for name in ("src", "src/deep", "target/x", "logs"):
        p.where(F.col("dir") == name).select("url").write.text(f"{folder}/tree/{name}")
    lines = S.source_lines(spark, f"{folder}/tree", ["/logs", "*.tmp", "# none"])
    return lines.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).agg(F.count("*").alias("lines"))


@query("SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def s05_s10_x09_transcripts(spark, sf_dir):
    """Assistant turns of transcript files as a stream: lines are filtered as text, and each is captured exactly once."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"))
    folder = _folder(spark, "transcripts")
    c.write.json(f"{folder}/in")
    lines = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{folder}/in")
    parsed = S.marked_lines(lines, '"type":"assistant"', "conv_id bigint, turn bigint, type string, message struct<content:string>").where("type = 'assistant'")
    return J.append_to(parsed.where("message.content is not null").select("conv_id", "turn", F.length("message.content").alias("chars")), folder)


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1")
def s06_s17_usage_scan(spark, sf_dir):
    """Event lines from a time on: the time in the line's text decides before anything is parsed."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))
    folder = _folder(spark, "usage")
    e.write.json(f"{folder}/in")
    recent = S.recent_lines(spark.read.text(f"{folder}/in"), "timestamp", "2024-01-03", "event_id bigint, event_type string, timestamp string")
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT lang, count(*) AS docs, count(toxic) AS labelled, sum(toxic)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def s07_s01_json_corpus(spark, sf_dir):
    """A corpus and its labels from JSON lines, with their schemas declared."""
    folder = _folder(spark, "corpus")
    read(spark, sf_dir, "documents").select("doc_id", "lang").write.json(f"{folder}/docs")
    read(spark, sf_dir, "labels").select("doc_id", "toxic").write.json(f"{folder}/labels")
    d = spark.read.schema("doc_id bigint, lang string").json(f"{folder}/docs")
    l = spark.read.schema("doc_id bigint, toxic int").json(f"{folder}/labels")  # noqa: E741
    return d.join(l, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.count("toxic").alias("labelled"), F.sum("toxic").alias("toxic"))


@query("SELECT 'g' || vec_id % 3 AS graph, label::BIGINT AS community, count(*) AS members FROM embeddings GROUP BY 1, 2")
def s09_s15_m35_graph_files(spark, sf_dir):
    """Members of communities from graph files: one object a part of a graph, with its nodes in a list."""
    v = read(spark, sf_dir, "embeddings").select(F.format_string("g%d", F.col("vec_id") % 3).alias("graph"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("community"))
    folder = _folder(spark, "graphs")
    parts = v.groupBy("graph", (F.col("id") % 50).alias("part")).agg(F.collect_list(F.struct("id", "community")).alias("nodes"))  # a part's nodes, not a graph's
    parts.select("graph", "nodes", F.array().cast("array<struct<source:bigint,target:bigint>>").alias("links")).write.json(f"{folder}/in")
    return S.graph_nodes(spark, f"{folder}/in").groupBy("graph", "community").agg(F.count("*").alias("members"))


@query("""WITH m AS (SELECT s_name AS name, s_suppkey AS k FROM supplier) SELECT name, unnest(['app', 'lib' || k % 3, 'tool']) AS target, unnest([false, k % 3 = 1, true]) AS ignored FROM m""")
def s12_manifests(spark, sf_dir):
    """Targets that manifests name, and whether their own ignore list takes them out."""
    k = F.col("s_suppkey") % 3
    m = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.array(F.lit("app"), F.format_string("lib%d", k), F.lit("tool")).alias("targets"), F.array(F.lit("lib1"), F.lit("tool")).alias("ignore"))
    folder = _folder(spark, "manifests")
    m.write.json(f"{folder}/in")
    return S.manifest_targets(spark, f"{folder}/in")


@query("""WITH e AS (SELECT event_id, event_type AS path, epoch_us(ts) AS at, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events) SELECT event_id, path FROM e WHERE before IS NULL OR e.at - before > 120000000""")
def s16_x10_debounce(spark, sf_dir):
    """Changes of a path that come after two quiet minutes."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("path"), at.alias("at"))
    before = F.lag("at").over(W.partitionBy("path").orderBy("at", "event_id"))
    return e.withColumn("before", before).where("before is null or at - before > 120000000").select("event_id", "path")


@query(stores_sql("units") + """, b AS (SELECT id, body, NULL AS previous FROM units WHERE id % 4 <> 0), a AS (SELECT id, CASE WHEN id % 3 = 0 THEN body || '!' ELSE body END AS body FROM units WHERE id % 4 <> 1)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'inserted' WHEN a.id IS NULL OR a.body = b.body THEN 'kept' ELSE 'updated' END AS act, CASE WHEN a.body <> b.body THEN length(b.body) END AS previous_chars FROM a FULL JOIN b ON a.id = b.id""")
def s18_s21_upsert(spark, sf_dir):
    """Upsert by key: what each row becomes, with the length of the text before where it changed."""
    u = store(spark, sf_dir, "units").select("id", "body")
    b = u.where("id % 4 <> 0").select("id", F.col("body").alias("old"))
    a = u.where("id % 4 <> 1").select("id", F.when(F.col("id") % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("new"))
    changed = F.coalesce(F.col("new") != F.col("old"), F.lit(False))
    both = a.join(b, "id", "full")
    act = F.when(F.col("old").isNull(), "inserted").when(changed, "updated").otherwise("kept")
    return both.select("id", act.alias("act"), F.when(changed, F.length("old")).alias("previous_chars"))


@query(stores_sql("units") + """ SELECT module, '# ' || module || chr(10) || string_agg('- ' || name || ': ' || summary, chr(10) ORDER BY name, id) AS text FROM units WHERE language = 'Go' GROUP BY 1""")
def s22_m25_markdown_sheets(spark, sf_dir):
    """A sheet for each module, written as text files by the executors and read back; a module's units are few."""
    line = F.struct("name", "id", F.concat(F.lit("- "), "name", F.lit(": "), "summary").alias("l"))
    u = store(spark, sf_dir, "units").where("language = 'Go'").groupBy("module").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    sheet = F.concat(F.lit("# "), "module", F.lit("\n"), F.array_join(F.transform("rows", lambda x: x["l"]), "\n"))
    folder = _folder(spark, "sheets")
    u.select(F.to_json(F.struct("module", sheet.alias("text"))).alias("value")).write.text(f"{folder}/out")
    return spark.read.schema("module string, text string").json(f"{folder}/out")


@query("""WITH c AS (SELECT event_id, ts, 'call' AS log FROM events UNION ALL SELECT o_orderkey, o_orderdate, 'journal' FROM orders UNION ALL SELECT page_id, TIMESTAMP '2024-01-01', 'snapshot' FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY ts DESC, event_id DESC) AS n FROM c)
    SELECT log, event_id AS id FROM r WHERE n <= CASE log WHEN 'call' THEN 5000 WHEN 'journal' THEN 20000 ELSE 5 END""")
def s25_prunes(spark, sf_dir):
    """The last 5,000 calls, 20,000 journal rows and five snapshots stay; each limit is a top-k of its own table."""
    keep = lambda df, log, at, key, n: df.select(F.lit(log).alias("log"), F.col(key).alias("id"), F.col(at).alias("at")).orderBy(F.desc("at"), F.desc("id")).limit(n).select("log", "id")
    pages = read(spark, sf_dir, "pages").withColumn("at", F.lit(0))
    return keep(read(spark, sf_dir, "events"), "call", "ts", "event_id", 5000).union(keep(read(spark, sf_dir, "orders"), "journal", "o_orderdate", "o_orderkey", 20000)).union(keep(pages, "snapshot", "at", "page_id", 5))


@query(stores_sql("units") + """, g AS (SELECT id FROM units WHERE root IS NULL OR root NOT IN ('root1', 'root2')), m AS (SELECT id, unnest(['new', 'get', 'drop']) AS member FROM units) SELECT 'units' AS child, count(*) AS gone FROM g UNION ALL SELECT 'members', count(*) FROM m WHERE id IN (SELECT id FROM g)""")
def s26_orphan_cascade(spark, sf_dir):
    """Units without a root that is kept go, and their members with them."""
    u = store(spark, sf_dir, "units")
    gone = u.join(spark.createDataFrame([("root1",), ("root2",)], "root string"), "root", "left_anti").select("id")
    members = u.select("id", F.explode(F.array(*map(F.lit, ("new", "get", "drop")))).alias("member")).join(gone, "id", "left_semi")
    return gone.agg(F.count("*").alias("gone")).select(F.lit("units").alias("child"), "gone").union(members.agg(F.count("*").alias("gone")).select(F.lit("members"), "gone"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN sha256(lang) END AS hash, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS size FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0")
def s27_migration(spark, sf_dir):
    """Versions of a table with different columns as one; what a version lacks is null and filled where it can be."""
    d = read(spark, sf_dir, "documents")
    old = d.where("doc_id % 5 = 0 and doc_id % 3 <> 0 and doc_id % 2 <> 0").select("doc_id", "lang")
    sized = d.where("doc_id % 3 = 0").select("doc_id", "lang", F.col("n_chars").alias("size"))
    hashed = d.where("doc_id % 2 = 0 and doc_id % 3 <> 0").select("doc_id", "lang", F.sha2("lang", 256).alias("hash"))
    return S.merged([old, sized, hashed]).withColumn("hash", F.coalesce("hash", F.when(F.col("doc_id") % 2 == 0, F.sha2("lang", 256))))


_VERDICTS = _E + """, r AS (SELECT sess, event_id AS id, CASE WHEN event_type = 'view' THEN k END AS entry, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS passed FROM e),
    v AS (SELECT sess, min(id) AS first, arg_max(passed, id) AS last FROM r WHERE passed IS NOT NULL GROUP BY 1), s AS (SELECT r.sess, entry, min(id) AS id, any_value(last) AS last FROM r JOIN v USING (sess) WHERE entry IS NOT NULL AND id < first GROUP BY 1, 2),
    c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sess ORDER BY id) <= 12)"""


def _verdict_rows(spark, sf_dir):
    t = F.col("event_type")
    return events(spark, sf_dir).select("sess", F.col("event_id").alias("id"), F.when(t == "view", F.col("k")).alias("entry"), F.when(t == "purchase", True).when(t == "error", False).alias("passed"))


@query(_VERDICTS + " SELECT entry, count(*) AS use, count(*) FILTER (NOT last) AS reverted FROM c GROUP BY 1")
def x02_verdict_credits(spark, sf_dir):
    """What sessions' verdicts credit to the entries that they had retrieved, over a table."""
    return V.credits_of_table(_verdict_rows(spark, sf_dir)).groupBy("entry").agg(F.sum("use").alias("use"), F.sum("reverted").alias("reverted"))


@query(_VERDICTS + " SELECT entry, count(*) AS use, count(*) FILTER (NOT last) AS reverted FROM c GROUP BY 1")
def x02_verdict_credits_stream(spark, sf_dir):
    """The same by the state machine on a stream, whose changes add up to it."""
    folder = _folder(spark, "verdicts")
    _verdict_rows(spark, sf_dir).repartitionByRange(4, "id").write.parquet(f"{folder}/in")
    changes = V.credits_of_stream(J.stream_of(spark, f"{folder}/in"))  # one batch: files of one write have no order
    rows = J.append_to(changes, folder)
    return rows.groupBy("entry").agg(F.sum("use").alias("use"), F.sum("reverted").alias("reverted"))


@query("SELECT o.event_id AS offer_id, min(CAST(floor(epoch_us(s.ts) / 1000000) AS BIGINT)) AS seen_at FROM events o JOIN events s ON s.event_type = 'purchase' AND o.event_type = 'click' AND s.user_id = o.user_id AND s.props = o.props AND s.ts BETWEEN o.ts AND o.ts + INTERVAL 1 DAY GROUP BY 1")
def x06_confirmed_stream(spark, sf_dir):
    """Offers and their first confirmation within a day, as a join of two streams with watermarks."""
    e = J.stream_of(spark, f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp")
    offers = e.where("event_type = 'click'").select("user_id", "props", F.col("event_id").alias("offer_id"), at.alias("offered_at"))
    seen = J.stream_of(spark, f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select("user_id", "props", at.alias("seen_at"))
    rows = J.append_to(J.confirmed(offers, seen, ["user_id", "props"]), _folder(spark, "offers"))
    return rows.groupBy("offer_id").agg(F.min(F.unix_seconds("seen_at")).alias("seen_at"))
