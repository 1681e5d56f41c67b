"""Queries of code units: nodes, inferred edges, call resolution, traversal, change capture."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import prose as P
from sparkloom.operators import code as K
from sparkloom.operators import graph as G
from sparkloom.operators import relational as R
from sparkloom.plans.catalog import _G, query
from sparkloom.plans.stores import store, stores_sql
from sparkloom.sources.tables import graph, read


def _units(spark, sf_dir):
    return store(spark, sf_dir, "units")


_EDGES = """nd AS (SELECT name, min(id) AS to_id FROM units GROUP BY 1), ln AS (SELECT id, name, unnest(string_split(body, chr(10))) AS line FROM units),
    im AS (SELECT id, unnest(list_transform(string_split(substring(line, 6), ','), lambda x: trim(x))) AS t FROM ln WHERE starts_with(line, 'impl:')),
    us AS (SELECT id, name, unnest(list_filter(regexp_extract_all(line, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Z]'))) AS t FROM ln WHERE starts_with(line, 'fields:') OR starts_with(line, 'methods:') OR starts_with(line, 'sig:') OR starts_with(ltrim(line), name || '::')),
    me AS (SELECT u.id, root, unnest(string_split(trim(substring(l.line, 9)), ' | ')) AS method FROM ln l JOIN units u USING (id) WHERE starts_with(l.line, 'methods:')),
    ed AS (SELECT DISTINCT * FROM (SELECT CAST(id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, 'implements' AS relation FROM im JOIN nd ON nd.name = im.t
        UNION ALL SELECT CAST(id AS VARCHAR), CAST(to_id AS VARCHAR), 'uses' FROM us JOIN nd ON nd.name = us.t WHERE us.t <> us.name
        UNION ALL SELECT id || '::method:' || method, CAST(id AS VARCHAR), 'derived_from' FROM me))"""


@query(stores_sql("units") + """, b AS (SELECT id, name FROM units WHERE id % 10 <> 0), a AS (SELECT id, CASE WHEN id % 7 = 0 THEN name || 'X' ELSE name END AS name FROM units WHERE id % 10 <> 1)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.name <> b.name THEN 'renamed' ELSE 'kept' END AS state FROM b FULL JOIN a ON a.id = b.id""")
def g01_s18_node_sync(spark, sf_dir):
    """Nodes mirror units: what an upsert by id does to each, so edges of kept nodes stay."""
    u = _units(spark, sf_dir).select("id", "name")
    before = u.where("id % 10 <> 0").select("id", F.col("name").alias("b"))
    after = u.where("id % 10 <> 1").select("id", F.when(F.col("id") % 7 == 0, F.concat("name", F.lit("X"))).otherwise(F.col("name")).alias("a"))
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "renamed").otherwise("kept")
    return before.join(after, "id", "full").select("id", state.alias("state"))


@query(stores_sql("units") + ", " + _EDGES + " SELECT * FROM ed")
def g02_j17_m34_infer_edges(spark, sf_dir):
    """Traits, used types and members as edges; a name stands for its smallest id."""
    return K.infer_edges(_units(spark, sf_dir))


@query(stores_sql("units") + ", " + _EDGES + """, ch AS (SELECT id, name FROM units WHERE root = 'root1' AND id % 5 = 0), tk AS (SELECT id, unnest(list_distinct(regexp_extract_all(body, '[A-Za-z0-9_]+'))) AS t FROM units),
    af AS (SELECT id FROM ch UNION SELECT tk.id FROM tk JOIN ch ON ch.name = tk.t) SELECT ed.* FROM ed JOIN af ON CAST(af.id AS VARCHAR) = split_part(ed.from_id, '::', 1)""")
def g03_j16_relink(spark, sf_dir):
    """Edges of changed units and of those elsewhere that name them, made anew; the rest isn't touched."""
    u = _units(spark, sf_dir)
    changed = u.where("root = 'root1' and id % 5 = 0")
    return K.infer_edges(changed.unionByName(K.mentioning(u, changed)), u)


@query(stores_sql("units") + ", " + _EDGES + """, ca AS (SELECT id AS caller, root, CASE id % 3 WHEN 0 THEN 'get_' || split_part(summary, ' ', 2) WHEN 1 THEN name ELSE 'SmallRing' || CAST(id % 9 AS VARCHAR) END AS callee FROM units WHERE root IS NOT NULL),
    ow AS (SELECT root, method AS callee, id FROM me WHERE root IS NOT NULL UNION SELECT root, name, id FROM units WHERE root IS NOT NULL), un AS (SELECT root, callee, min(id) AS target, count(*) AS n FROM ow GROUP BY 1, 2)
    SELECT ca.caller, ca.callee, CASE WHEN n = 1 AND target <> caller THEN target END AS target FROM ca LEFT JOIN un USING (root, callee)""")
def g04_j14_calls(spark, sf_dir):
    """Every call, with its target where one unit of its root alone has that name or method; never the caller."""
    u = _units(spark, sf_dir).where("root is not null")
    callee = F.when(F.col("id") % 3 == 0, F.concat(F.lit("get_"), F.split("summary", " ")[1])).when(F.col("id") % 3 == 1, F.col("name")).otherwise(F.concat(F.lit("SmallRing"), (F.col("id") % 9).cast("string")))
    owners = K.methods(u).select("root", F.col("method").alias("callee"), "id").union(u.select("root", "name", "id")).distinct()
    unique = owners.groupBy("root", "callee").agg(F.min("id").alias("target"), F.count("*").alias("n"))
    calls = u.select(F.col("id").alias("caller"), "root", callee.alias("callee")).join(unique, ["root", "callee"], "left")
    return calls.select("caller", "callee", F.when((F.col("n") == 1) & (F.col("target") != F.col("caller")), F.col("target")).alias("target"))


@query(_G + """, m(from_id, to_id, relation) AS (VALUES ('o:1', 'r:1', 'uses'), ('o:1', 'r:2', 'likes'), ('c:1', 'n:1', 'owns'), ('c:1', 'n:1', 'owns')) SELECT from_id, to_id, relation FROM g UNION SELECT * FROM m WHERE relation IN ('uses', 'owns', 'derived_from', 'implements')""")
def g05_manual_edges(spark, sf_dir):
    """Edges that are added by hand, if their relation is allowed; each edge once."""
    manual = spark.createDataFrame([("o:1", "r:1", "uses"), ("o:1", "r:2", "likes"), ("c:1", "n:1", "owns"), ("c:1", "n:1", "owns")], "from_id string, to_id string, relation string")
    return graph(spark, sf_dir).union(manual.where(F.col("relation").isin("uses", "owns", "derived_from", "implements"))).distinct()


@query(stores_sql("units") + ", " + _EDGES + " SELECT e.from_id, e.relation, u.id AS to_unit, u.name, u.kind FROM ed e JOIN units u ON CAST(u.id AS VARCHAR) = e.to_id")
def j01_neighbours(spark, sf_dir):
    """What each node points at, with the target's name and kind."""
    u = _units(spark, sf_dir)
    named = u.select(F.col("id").cast("string").alias("to_id"), F.col("id").alias("to_unit"), "name", "kind")
    return K.infer_edges(u).join(named, "to_id").select("from_id", "relation", "to_unit", "name", "kind")


@query(_G + """, r AS (SELECT 's:1' AS node, 0 AS d UNION SELECT 'o:1', 0 UNION ALL SELECT g.to_id, d + 1 FROM r JOIN g ON g.from_id = r.node WHERE d < 2), n AS (SELECT node, min(d) AS distance FROM r GROUP BY 1)
    SELECT g.from_id, g.to_id, g.relation, n.distance FROM g JOIN n ON n.node = g.from_id""")
def g07_subgraph_edges(spark, sf_dir):
    """The edges of every node that a bounded search expands; those to nodes seen before too."""
    roots = spark.createDataFrame([("s:1",), ("o:1",)], "node string")
    return G.subgraph(graph(spark, sf_dir), roots, 3)


@query(_G + """, q(a, b) AS (VALUES ('o:1', 'r:0'), ('o:2', 'r:1'), ('o:2', 'o:1'), ('s:3', 'n:1')), p AS (SELECT DISTINCT a AS root, a AS node, 0 AS d FROM q UNION ALL SELECT root, to_id, d + 1 FROM p JOIN g ON from_id = node WHERE d < 4)
    SELECT a, b, EXISTS (SELECT 1 FROM p WHERE p.root = a AND p.node = b) AS reached FROM q""")
def g09_reachable(spark, sf_dir):
    """Whether one node reaches another within four steps; searches from all starts run together."""
    pairs = spark.createDataFrame([("o:1", "r:0"), ("o:2", "r:1"), ("o:2", "o:1"), ("s:3", "n:1")], "a string, b string")
    g = graph(spark, sf_dir).select("from_id", "to_id")
    tables = G.Tables(spark, "reachable")
    level = tables.written(pairs.select(F.col("a").alias("root"), F.col("a").alias("node")).distinct())
    found = level
    for _ in range(4):
        new = level.join(g, level.node == g.from_id).select("root", F.col("to_id").alias("node")).distinct()
        level = tables.written(new.join(found, ["root", "node"], "left_anti"))
        found = found.union(level)
    hit = found.select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(True).alias("hit"))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("reached"))


@query(stores_sql("units") + ", " + _EDGES + """, we AS (SELECT *, CASE relation WHEN 'uses' THEN 1.0 WHEN 'implements' THEN 2.0 ELSE 0.5 END AS weight FROM ed), tg AS (SELECT DISTINCT to_id AS node FROM we),
    hv AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY weight DESC, from_id, relation) AS n FROM we), a AS (SELECT to_id AS target, from_id AS node, relation FROM we WHERE relation = 'uses' UNION SELECT to_id, from_id, relation FROM hv WHERE n <= 20),
    c AS (SELECT target, count(*) AS affected FROM a GROUP BY 1), o AS (SELECT from_id AS target, count(DISTINCT to_id) AS depends FROM we GROUP BY 1)
    SELECT target, affected, coalesce(depends, 0) AS depends, CASE WHEN affected + coalesce(depends, 0) // 2 <= 2 THEN 'low' WHEN affected + coalesce(depends, 0) // 2 <= 7 THEN 'medium' ELSE 'high' END AS risk FROM c LEFT JOIN o USING (target)""")
def g10_p12_impact_of_change(spark, sf_dir):
    """Who a change affects: users and the twenty inbound edges of most weight; and the grade of its risk."""
    weight = F.when(F.col("relation") == "uses", 1.0).when(F.col("relation") == "implements", 2.0).otherwise(0.5)
    e = K.infer_edges(_units(spark, sf_dir)).withColumn("weight", weight)
    affected = G.impact_of(e, e.select(F.col("to_id").alias("node")).distinct()).groupBy("target").agg(F.count("*").alias("affected"))
    depends = e.groupBy(F.col("from_id").alias("target")).agg(F.count_distinct("to_id").alias("depends"))
    both = affected.join(depends, "target", "left").withColumn("depends", F.coalesce("depends", F.lit(0)))
    score = F.col("affected") + F.floor(F.col("depends") / 2)
    return both.withColumn("risk", F.when(score <= 2, "low").when(score <= 7, "medium").otherwise("high"))


_COMM = """b AS (SELECT vec_id AS id, label AS c FROM embeddings WHERE vec_id % 10 <> 0), a AS (SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 THEN (label + 3) % 12 ELSE label + 100 END AS c FROM embeddings WHERE vec_id % 10 <> 1),
    nb AS (SELECT c, count(*) AS n FROM b GROUP BY 1), na AS (SELECT c, count(*) AS n FROM a GROUP BY 1), j AS (SELECT b.c AS x, a.c AS y, count(*) AS m FROM b JOIN a USING (id) GROUP BY 1, 2),
    p AS (SELECT x, y, m / (nb.n + na.n - m) AS jaccard, m, nb.n AS prev, na.n AS curr FROM j JOIN nb ON nb.c = x JOIN na ON na.c = y)"""


@query("WITH RECURSIVE " + _COMM + """, o AS (SELECT *, row_number() OVER (ORDER BY jaccard DESC, x, y) AS i FROM p),
    g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ux, []::BIGINT[] AS uy, false AS took UNION ALL SELECT o.i, CASE WHEN list_contains(ux, x) OR list_contains(uy, y) THEN ux ELSE list_append(ux, x::BIGINT) END, CASE WHEN list_contains(ux, x) OR list_contains(uy, y) THEN uy ELSE list_append(uy, y::BIGINT) END, NOT (list_contains(ux, x) OR list_contains(uy, y)) FROM g JOIN o ON o.i = g.i + 1)
    SELECT x AS a, y AS b, round(jaccard, 6) AS jaccard, curr - m AS added, prev - m AS removed, round((curr - m + prev - m) / greatest(prev, curr), 6) AS drift, (curr - m + prev - m) / greatest(prev, curr) >= 0.3 AS high FROM o JOIN g ON g.i = o.i AND g.took""")
def g12_j28_community_drift(spark, sf_dir):
    """Communities of two snapshots paired greedily by overlap, each once, with what came, what went and how far they drifted."""
    v = read(spark, sf_dir, "embeddings")
    before = v.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    after = v.where("vec_id % 10 <> 1").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 6 == 0, (F.col("label") + 3) % 12).otherwise(F.col("label") + 100).alias("community"))
    overlap = G.community_overlap(before, after)
    size = lambda df, key, n: df.groupBy(F.col("community").alias(key)).agg(F.count("*").alias(n))
    chosen = G.greedy_matching(overlap).join(overlap.select("a", "b", "both"), ["a", "b"]).join(size(before, "a", "prev"), "a").join(size(after, "b", "curr"), "b")
    drift = (F.col("curr") + F.col("prev") - 2 * F.col("both")) / F.greatest("prev", "curr")
    return chosen.select("a", "b", F.round("jaccard", 6).alias("jaccard"), (F.col("curr") - F.col("both")).alias("added"), (F.col("prev") - F.col("both")).alias("removed"), F.round(drift, 6).alias("drift"), (drift >= 0.3).alias("high"))


@query(stores_sql("units") + """, parts AS (SELECT id AS part, name, module FROM units WHERE kind = 'fn'), types AS (SELECT id, name, module FROM units WHERE kind = 'struct'),
    j AS (SELECT part, t.id AS unit, CASE WHEN split_part(p.module, '::', 1) <> split_part(t.module, '::', 1) THEN 0 WHEN split_part(p.module, '::', 2) <> split_part(t.module, '::', 2) THEN 1 WHEN p.module = t.module AND contains(p.module, 'inner') THEN 3 ELSE 2 END AS overlap FROM parts p JOIN types t USING (name))
    SELECT part, arg_max(unit, (overlap, unit)) AS unit, max(overlap) AS overlap FROM j GROUP BY 1""")
def j18_e03_attach(spark, sf_dir):
    """Parts go to the type of their name that shares most of the module path; ties to the last one."""
    u = _units(spark, sf_dir)
    return K.attach(u.where("kind = 'fn'").select(F.col("id").alias("part"), "name", "module"), u.where("kind = 'struct'").select("id", "name", "module"))


@query(stores_sql("units") + """, declared AS (SELECT DISTINCT name FROM units WHERE kind = 'struct' AND language = 'python')
    SELECT name, min(id) AS id, count(*) AS halves, sum(methods)::BIGINT AS methods, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM units WHERE name IN (SELECT name FROM declared) GROUP BY 1""")
def j19_e03_partials(spark, sf_dir):
    """Halves of a declared name folded to one."""
    u = _units(spark, sf_dir)
    declared = u.where("kind = 'struct' and language = 'python'").select("name").distinct()
    return u.join(declared, "name", "left_semi").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("halves"), F.sum("methods").alias("methods"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


# change capture


@query("""WITH b AS (SELECT page_id, length(html) AS len, page_id * 10 AS mtime, sha256(html) AS h FROM pages WHERE page_id % 9 <> 0), a AS (SELECT page_id, length(html) + CASE WHEN page_id % 7 = 0 THEN 5 ELSE 0 END AS len, page_id * 10 + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN page_id % 7 = 0 THEN sha256(html || 'extra') ELSE sha256(html) END AS h FROM pages WHERE page_id % 9 <> 1)
    SELECT coalesce(a.page_id, b.page_id)::VARCHAR AS path, CASE WHEN b.len IS NULL THEN 'new' WHEN a.len IS NULL THEN 'gone' WHEN a.len = b.len AND a.mtime = b.mtime AND b.mtime < 397 THEN 'same' WHEN a.h = b.h THEN CASE WHEN a.len = b.len AND a.mtime = b.mtime THEN 'racy' ELSE 'touched' END ELSE 'changed' END AS state FROM a FULL JOIN b ON a.page_id = b.page_id""")
def c01_s04_m26_check_ladder(spark, sf_dir):
    """Files by their stamps, then by content where stamps differ or are too fresh."""
    p = read(spark, sf_dir, "pages")
    k, path = F.col("page_id"), F.col("page_id").cast("string").alias("path")
    before = p.where("page_id % 9 <> 0").select(path, F.length("html").alias("len"), (k * 10).alias("mtime"), F.sha2("html", 256).alias("hash"))
    seven = k % 7 == 0
    after = p.where("page_id % 9 <> 1").select(path, (F.length("html") + F.when(seven, 5).otherwise(0)).alias("len"), (k * 10 + F.when(k % 5 == 0, 1).otherwise(0)).alias("mtime"), F.when(seven, F.sha2(F.concat("html", F.lit("extra")), 256)).otherwise(F.sha2("html", 256)).alias("hash"))
    return K.check_ladder(after, before, 400)


@query(stores_sql("units") + """, b AS (SELECT root, id, name FROM units WHERE root IS NOT NULL), a AS (SELECT 'root2' AS root, id + 1 AS id, name FROM b WHERE root = 'root2' AND id % 3 <> 0)
    SELECT root, count(*) AS units, count(*) FILTER (fresh) AS fresh FROM (SELECT root, id, false AS fresh FROM b WHERE root <> 'root2' UNION ALL SELECT root, id, true FROM a) GROUP BY 1""")
def c02_reindex(spark, sf_dir):
    """A root made anew: its old rows go as a whole, all other roots stay."""
    b = _units(spark, sf_dir).where("root is not null").select("root", "id", "name")
    new = b.where("root = 'root2' and id % 3 <> 0").select("root", (F.col("id") + 1).alias("id"), "name")
    rows = b.join(new.select("root").distinct(), "root", "left_anti").withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    return rows.groupBy("root").agg(F.count("*").alias("units"), F.count_if("fresh").alias("fresh"))


def _body(extra):
    return F.concat("body", F.lit(extra))


_FACETS = """f AS (SELECT id, 'impl' AS facet, 'Show' AS key, '' AS value FROM units UNION ALL SELECT id, 'impl', regexp_extract(body, 'impl: Show, (\\w+)', 1), '' FROM units
    UNION ALL SELECT id, 'fields', 'size', regexp_extract(body, 'size: (\\w+)', 1) FROM units UNION ALL SELECT id, 'fields', 'count', 'i64' FROM units UNION ALL SELECT id, 'fields', 'map', 'Map<K, V>' FROM units UNION ALL SELECT id, 'sig', 'fn(a', 'i32)' FROM units
    UNION ALL SELECT id, 'methods', unnest(['new', regexp_extract(body, '(get_\\w+)', 1), 'drop']), '' FROM units)"""


@query(stores_sql("units") + ", " + _FACETS + " SELECT DISTINCT * FROM f")
def c03_facets(spark, sf_dir):
    """What a unit consists of; separators within brackets don't split, prose isn't a facet."""
    u = _units(spark, sf_dir).withColumn("body", F.concat(F.replace("body", F.lit("count: i64"), F.lit("count: i64, map: Map<K, V>")), F.lit("\nsig: fn(a: i32)")))
    return K.facets(u)


@query(stores_sql("units") + """ SELECT id, 'fields' AS facet, 'count' AS key, '~' AS sign FROM units WHERE id % 3 = 0 UNION ALL SELECT id, 'methods', 'drop', '-' FROM units WHERE id % 4 = 0 UNION ALL SELECT id, 'sig', 'fn()', '+' FROM units WHERE id % 5 = 0""")
def c04_facet_delta(spark, sf_dir):
    """Facets that came, went or changed between two versions of units."""
    u = _units(spark, sf_dir)
    k = F.col("id")
    body = F.when(k % 3 == 0, F.replace("body", F.lit("count: i64"), F.lit("count: u8"))).otherwise(F.col("body"))
    body = F.when(k % 4 == 0, F.replace(body, F.lit(" | drop"), F.lit(""))).otherwise(body)
    body = F.when(k % 5 == 0, F.concat(body, F.lit("\nsig: fn()"))).otherwise(body)
    return K.facet_delta(K.facets(u), K.facets(u.withColumn("body", body)))


@query(stores_sql("journal", "units") + """, w AS (SELECT u.name, j.* FROM journal j JOIN units u ON u.id = j.unit_id),
    f AS (SELECT name, unit_id, arg_min(change, id) AS f, arg_max(change, id) AS l, max(w.at) AS last_at, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT name, unit_id, CASE WHEN f = 'added' THEN 'added' WHEN f = 'removed' AND l = 'added' THEN 'changed' WHEN l = 'removed' THEN 'removed' ELSE 'changed' END AS net, n FROM f WHERE NOT (f = 'added' AND l = 'removed')""")
def c06_journal(spark, sf_dir):
    """What the journal comes to for each unit, with the unit's name."""
    names = _units(spark, sf_dir).select(F.col("id").alias("unit_id"), "name")
    return R.net_changes(store(spark, sf_dir, "journal"), "unit_id", ["id"]).join(names, "unit_id").select("name", "unit_id", "net", "n")


@query(stores_sql("entries", "journal", "units") + """, l AS (SELECT unit_id, max((journal.at, change)) AS m FROM journal GROUP BY 1), n AS (SELECT u.name, max((u2.a, u2.c)) AS m FROM units u JOIN (SELECT unit_id, arg_max(journal.at, id) AS a, arg_max(change, id) AS c FROM journal GROUP BY 1) u2 ON u2.unit_id = u.id GROUP BY 1),
    r AS (SELECT id, e.at, unnest(list_distinct(list_filter(regexp_split_to_array(body, '[^A-Za-z0-9_]+'), lambda x: length(x) >= 4 AND regexp_matches(x, '^[A-Za-z_]') AND ((regexp_matches(x, '^[A-Z]') AND regexp_matches(x, '[A-Z].*[A-Z]') AND regexp_matches(x, '[a-z]')) OR (contains(x, '_') AND NOT regexp_matches(x, '[A-Z]')))))) AS name FROM entries e),
    d AS (SELECT r.id, r.name, n.m[1] AS changed_at, n.m[2] AS change, row_number() OVER (PARTITION BY r.id ORDER BY r.name) AS place FROM r JOIN n USING (name) WHERE n.m[1] > r.at) SELECT * FROM d WHERE place <= 3""")
def c07_drift_notes(spark, sf_dir):
    """Entries that name code which changed after they were written."""
    names = _units(spark, sf_dir).select(F.col("id").alias("unit"), "name")
    journal = store(spark, sf_dir, "journal").withColumnRenamed("unit_id", "unit")
    return K.drift_notes(store(spark, sf_dir, "entries"), P.code_references(F.col("body")), names, journal)


_ACTS = "a AS (SELECT event_id, user_id AS target, CASE event_type WHEN 'signup' THEN 'supersede' WHEN 'error' THEN 'retract' WHEN 'purchase' THEN 'restore' ELSE 'propose' END AS act FROM events)"


def _acts(spark, sf_dir):
    t = F.col("event_type")
    act = F.when(t == "signup", "supersede").when(t == "error", "retract").when(t == "purchase", "restore").otherwise("propose")
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("target"), act.alias("act"))


@query("WITH " + _ACTS + """ SELECT target, CASE arg_max(act, event_id) WHEN 'supersede' THEN 'superseded' WHEN 'retract' THEN 'retracted' ELSE 'live' END AS state, count(*) FILTER (act = 'retract') AS retractions FROM a WHERE act <> 'propose' GROUP BY 1""")
def c08_l15_target_states(spark, sf_dir):
    """The state of each entry by the last act on it; a restore undoes either."""
    a = _acts(spark, sf_dir).where("act <> 'propose'").groupBy("target").agg(F.max_by("act", "event_id").alias("last"), F.count_if(F.col("act") == "retract").alias("retractions"))
    return a.select("target", F.when(F.col("last") == "supersede", "superseded").when(F.col("last") == "retract", "retracted").otherwise("live").alias("state"), "retractions")


@query("WITH " + _ACTS + """, s AS (SELECT target, arg_max(act, event_id) AS status, max(event_id) AS last_id, count(*) AS changes FROM a GROUP BY 1) SELECT * FROM s ORDER BY last_id DESC LIMIT 20""")
def c09_m33_ledger(spark, sf_dir):
    """The twenty changes of last date, each with its status."""
    s = _acts(spark, sf_dir).groupBy("target").agg(F.max_by("act", "event_id").alias("status"), F.max("event_id").alias("last_id"), F.count("*").alias("changes"))
    return s.orderBy(F.desc("last_id")).limit(20)


@query("""WITH f AS (SELECT page_id % 10 AS evaluator, url, sha256(html) AS h FROM pages), n AS (SELECT evaluator, sha256(string_agg(url || '=' || h, ';' ORDER BY url, h)) AS stamp FROM f GROUP BY 1),
    o AS (SELECT evaluator, sha256(string_agg(url || '=' || CASE WHEN evaluator = 3 THEN sha256(h) ELSE h END, ';' ORDER BY url, CASE WHEN evaluator = 3 THEN sha256(h) ELSE h END)) AS registered FROM f WHERE evaluator <> 5 GROUP BY 1)
    SELECT evaluator, stamp, CASE WHEN registered IS NULL THEN 'unregistered' WHEN registered = stamp THEN 'valid' ELSE 'changed' END AS state FROM n LEFT JOIN o USING (evaluator)""")
def c10_evaluators(spark, sf_dir):
    """Evaluators whose files are still the registered ones: one digest over the digests of the files in order.

    An evaluator's files are few; only their digests are gathered.
    """
    f = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("evaluator"), "url", F.sha2("html", 256).alias("h"))
    stamp = lambda df, name: df.groupBy("evaluator").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", "h"))), lambda x: F.concat(x["url"], F.lit("="), x["h"])), ";"), 256).alias(name))
    old = f.where("evaluator <> 5").withColumn("h", F.when(F.col("evaluator") == 3, F.sha2("h", 256)).otherwise(F.col("h")))
    both = stamp(f, "stamp").join(stamp(old, "registered"), "evaluator", "left")
    return both.select("evaluator", "stamp", F.when(F.col("registered").isNull(), "unregistered").when(F.col("registered") == F.col("stamp"), "valid").otherwise("changed").alias("state"))


@query("""WITH r(rule, pattern) AS (VALUES ('old name', 'Eau'), ('old flag', 'the the'), ('never', 'zzzz')), l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)
    SELECT rule, doc_id, line_no::BIGINT AS line_no FROM l JOIN r ON contains(line, pattern)""")
def c14_stale_guidance(spark, sf_dir):
    """Lines that a list of outdated phrases finds; the list is fixed, so it runs inside the scan."""
    rules = {"old name": "Eau", "old flag": "the the", "never": "zzzz"}
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    hits = F.array_compact(F.array(*[F.when(F.contains("line", F.lit(p)), r) for r, p in rules.items()]))
    return lines.select(F.explode(hits).alias("rule"), "doc_id", (F.col("i") + 1).cast("long").alias("line_no"))


@query("""WITH d AS (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: CASE length(l) % 3 WHEN 0 THEN '+' || l WHEN 1 THEN '-' || l ELSE ' ' || l END)) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
    SELECT doc_id, trim(substring(arg_min(line, i) FILTER (starts_with(line, '+')), 2)) AS first_added, count(*) FILTER (starts_with(line, '-')) AS deleted FROM d GROUP BY 1""")
def s11_m37_patch_summary(spark, sf_dir):
    """The first line that a patch adds, and how many it removes, without leaving the row."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.when(F.length(x) % 3 == 0, "+").when(F.length(x) % 3 == 1, "-").otherwise(" "), x))
    d = read(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    added = F.filter("l", lambda x: x.startswith("+"))
    return d.select("doc_id", F.trim(F.substring(F.get(added, F.lit(0)), 2, 1_000_000)).alias("first_added"), F.size(F.filter("l", lambda x: x.startswith("-"))).cast("long").alias("deleted"))


@query(stores_sql("units", "entries") + """, f AS (SELECT path, unnest(list_distinct(list_filter(regexp_extract_all(body, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Z]') AND length(x) >= 4))) AS name FROM units WHERE root = 'root3')
    SELECT e.id, count(DISTINCT f.name) AS names FROM f JOIN (SELECT id, unnest(list_distinct(regexp_extract_all(body, '[A-Za-z0-9_]+'))) AS name FROM entries WHERE superseded_by IS NULL) e ON e.name = f.name GROUP BY 1""")
def m27_f29_change_relevance(spark, sf_dir):
    """Live entries that name a type of the changed files, as a whole word."""
    changed = _units(spark, sf_dir).where("root = 'root3'").select(F.explode(F.array_distinct(F.filter(K.type_tokens(F.col("body")), lambda t: F.length(t) >= 4))).alias("name")).distinct()
    words = store(spark, sf_dir, "entries").where("superseded_by is null").select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[A-Za-z0-9_]+"), 0))).alias("name"))
    return words.join(changed, "name", "left_semi").groupBy("id").agg(F.count("*").alias("names"))


@query(stores_sql("units") + """, w AS (SELECT id, name, path, substring(body, 1, 30) AS snippet, row_number() OVER (PARTITION BY name, substring(body, 1, 30) ORDER BY path, line, id) AS dup, path || line AS p, line FROM units)
    SELECT name, id, place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line, id) AS place FROM w WHERE dup = 1) WHERE place <= 3""")
def w18_m36_snippets(spark, sf_dir):
    """Different snippets of a name in the order of the scan, three at most."""
    u = _units(spark, sf_dir).withColumn("snippet", F.substring("body", 1, 30))
    scan = ["path", "line", "id"]
    once = u.withColumn("dup", F.row_number().over(W.partitionBy("name", "snippet").orderBy(*scan))).where("dup = 1")
    return once.withColumn("place", F.row_number().over(W.partitionBy("name").orderBy(*scan)).cast("long")).where("place <= 3").select("name", "id", "place")


@query(stores_sql("units") + """, t AS (SELECT DISTINCT name FROM units WHERE kind = 'trait'), i AS (SELECT DISTINCT trim(unnest(string_split(regexp_extract(body, 'impl: ([^\\n]*)', 1), ','))) AS name FROM units) SELECT name FROM t WHERE name NOT IN (SELECT name FROM i)""")
def u04_traits_not_implemented(spark, sf_dir):
    """Traits that no unit implements."""
    u = _units(spark, sf_dir)
    done = u.select(F.explode(F.split(F.regexp_extract("body", "impl: ([^\n]*)", 1), ",")).alias("n")).select(F.trim("n").alias("name"))
    return u.where("kind = 'trait'").select("name").distinct().join(done, "name", "left_anti")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels) EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def u06_intersect_except(spark, sf_dir):
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")  # noqa: E741
    return d.where("lang = 'en'").select("doc_id").intersect(l.select("doc_id")).exceptAll(l.where("toxic = 1").select("doc_id").distinct())


_KINDS = "CASE WHEN n.hit IS NOT NULL THEN 1 ELSE 0 END"


@query(stores_sql("units") + """ SELECT u.id, sum(CASE WHEN v.module = u.module THEN 50 ELSE 0 END + CASE WHEN v.kind = u.kind THEN 20 ELSE 0 END + CASE WHEN v.origin = u.origin THEN 15 ELSE 0 END)::BIGINT AS related, count(*) AS same_name FROM units u JOIN units v ON v.name = u.name AND v.id <> u.id GROUP BY 1""")
def r16_related(spark, sf_dir):
    """How related the namesakes of a unit are, by module, kind and origin: sums over groups, so no pair is made.

    Of the units of a name, those that agree with one in a column are its group there, less itself.
    """
    u = _units(spark, sf_dir).select("id", "name", "module", "kind", "origin")
    others = lambda *cols: F.count("*").over(W.partitionBy("name", *cols)) - 1
    score = 50 * others("module") + 20 * others("kind") + 15 * others("origin")
    return u.select("id", score.alias("related"), others().alias("same_name")).where("same_name > 0")
