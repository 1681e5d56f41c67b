"""The consolidation of a store and the closeout of its sessions as pipelines of stages, stopped and taken up again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.operators import graph as G
from sparkloom.operators import learning as L
from sparkloom.operators.stages import Pipeline, Stage
from sparkloom.plans.catalog import _E, _G, query
from sparkloom.plans.stores import store, stores_sql
from sparkloom.sources.tables import events, graph, read
from sparkloom.sources.work import files_mark
from sparkloom.streaming.jobs import shared_folder

_IS = lambda t: F.col("event_type") == t


def _health(calls):
    return calls.groupBy("event_type").agg(F.count("*").alias("n"))


def _tools(calls):
    """Tools of each session in the order of first use."""
    first = calls.groupBy("sess", "event_type").agg(F.min("event_id").alias("first"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("sess").agg(order.alias("tools"))  # as many as there are kinds of event


def _clusters(calls):
    outcome = calls.groupBy("sess").agg((F.count_if(_IS("purchase")) > F.count_if(_IS("error"))).alias("good"))
    return _tools(calls).join(outcome, "sess").groupBy("tools").agg(F.count("*").alias("members"), F.count_if("good").alias("good"))


def _skills(clusters):
    wide = clusters.where("members >= 3 and size(tools) >= 2")
    return wide.groupBy(F.concat_ws("-", F.lit("skill"), F.slice("tools", 1, 2)).alias("name")).agg(F.sum("members").alias("members"), F.sum("good").alias("good"))


def _triage(skills):
    share = F.col("good") / F.col("members")
    return skills.select("name", F.when(share >= 0.5, "trial").when(F.col("members") < 10, "noise").otherwise("review").alias("decision"))


def _gaps(calls):
    half = calls.agg(((F.min("at") + F.max("at")) / 2).alias("middle"))
    c = calls.where("k is not null").crossJoin(F.broadcast(half))  # a single row
    late = F.col("at") > F.col("middle")
    kinds = {"early": _IS("error") & ~late, "late": _IS("error") & late, "passes": _IS("purchase"), "uses": _IS("view"), "decided": _IS("signup")}
    return c.groupBy("k").agg(*(F.count_if(cond).alias(name) for name, cond in kinds.items())).where("early + late >= 3")


def _gates(gaps):
    seen = F.col("early") + F.col("late")
    p = gaps.withColumns({"duplicate": F.col("decided") > 20, "valid": F.col("uses") > 0, "credibility": F.least(F.col("passes"), F.lit(10)) / 10, "seen": seen, "survival": F.greatest(F.lit(0.0), (F.col("uses") - F.col("late")) / F.greatest(F.col("uses"), F.lit(1)))})
    return L.gates(p).select("k", "early", "late", "outcome", "reason")


def _trials(gates):
    return gates.where("outcome = 'trial'").select("k", F.when(F.col("late") >= F.col("early"), "pending").otherwise("rejected").alias("state"))


def _fidelity(calls):
    steps = {"click": "closeout", "view": "bootstrap", "purchase": "plan", "signup": "partial"}
    step = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])[F.col("event_type")]
    score, missing = L.fidelity(F.col("tools"))
    return calls.groupBy("sess").agg(F.collect_set(step).alias("tools")).select("sess", score.alias("score"), missing.alias("missing"))


def _drift(gaps):
    return gaps.select("k", (F.col("late") - F.col("early")).alias("boost")).where("boost >= 2").orderBy(F.desc("boost"), "k").limit(10)


def _meta(gates, trials, triage, fidelity):
    parts = [gates.select(F.concat(F.lit("gate "), "outcome", F.lit(" "), "reason").alias("signal")), trials.select(F.concat(F.lit("trial "), "state")), triage.select(F.concat(F.lit("skill "), "decision")), fidelity.where("score < 0.6").select(F.lit("low fidelity"))]
    return reduce(lambda a, b: a.union(b), parts).groupBy("signal").agg(F.count("*").alias("n"))


CONSOLIDATION = [
    Stage("health", ("calls",), _health),
    Stage("clusters", ("calls",), _clusters),
    Stage("skills", ("clusters",), _skills),
    Stage("triage", ("skills",), _triage),
    Stage("gaps", ("calls",), _gaps),
    Stage("gates", ("gaps",), _gates),
    Stage("trials", ("gates",), _trials),
    Stage("fidelity", ("calls",), _fidelity),
    Stage("drift", ("gaps",), _drift),
    Stage("meta", ("gates", "trials", "triage", "fidelity"), _meta),
]


def _resumed(spark, sf_dir, name, stages, stop_after):
    """The tables of a pipeline that one run left behind a stage and another one ended."""
    folder = shared_folder(spark, name)
    raw = read(spark, sf_dir, "events")
    inputs = {"calls": (events(spark, sf_dir), files_mark(spark, raw))}
    Pipeline(spark, folder, stages).run(inputs, stop_after)
    return Pipeline(spark, folder, stages).run(inputs)


@query(_E + """, f AS (SELECT sess, event_type, min(event_id) AS first FROM e GROUP BY 1, 2), t AS (SELECT sess, list(event_type ORDER BY first) AS tools FROM f GROUP BY 1),
    o AS (SELECT sess, count(*) FILTER (event_type = 'purchase') > count(*) FILTER (event_type = 'error') AS good FROM e GROUP BY 1),
    c AS (SELECT tools, count(*) AS members, count(*) FILTER (good) AS good FROM t JOIN o USING (sess) GROUP BY 1),
    s AS (SELECT 'skill-' || tools[1] || '-' || tools[2] AS name, sum(members)::BIGINT AS members, sum(good)::BIGINT AS good FROM c WHERE members >= 3 AND len(tools) >= 2 GROUP BY 1),
    tr AS (SELECT name, CASE WHEN good / members >= 0.5 THEN 'trial' WHEN members < 10 THEN 'noise' ELSE 'review' END AS decision FROM s),
    h AS (SELECT (min(secs) + max(secs)) / 2 AS middle FROM e),
    g AS (SELECT k, count(*) FILTER (event_type = 'error' AND secs <= middle) AS early, count(*) FILTER (event_type = 'error' AND secs > middle) AS late, count(*) FILTER (event_type = 'purchase') AS passes, count(*) FILTER (event_type = 'view') AS uses, count(*) FILTER (event_type = 'signup') AS decided FROM e, h WHERE k IS NOT NULL GROUP BY 1 HAVING early + late >= 3),
    p AS (SELECT *, CASE WHEN decided > 20 THEN 'reject duplicate' WHEN uses = 0 THEN 'reject syntax' WHEN least(passes, 10) / 10 < 0.2 THEN 'reject credibility' WHEN early + late < 5 THEN 'trial seen too rarely' WHEN greatest(0, (uses - late) / greatest(uses, 1)) < 0.5 THEN 'reject survival' ELSE 'pass ' END AS gate FROM g),
    q AS (SELECT k, CASE WHEN late >= early THEN 'pending' ELSE 'rejected' END AS state FROM p WHERE starts_with(gate, 'trial')),
    x AS (SELECT sess, bool_or(event_type = 'click') AS c, bool_or(event_type = 'view') AS b, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'signup') AS q FROM e GROUP BY 1),
    fi AS (SELECT sess, greatest(0, round(1 - CASE WHEN c THEN 0 ELSE 0.25 END - CASE WHEN b THEN 0 ELSE 0.15 END - CASE WHEN p THEN 0 ELSE 0.1 END - CASE WHEN q THEN 0 ELSE 0.1 END, 6)) AS score FROM x),
    dr AS (SELECT k, late - early AS boost FROM g WHERE late - early >= 2 ORDER BY boost DESC, k LIMIT 10)
    SELECT 'health' AS stage, event_type AS item, CAST(count(*) AS VARCHAR) AS value FROM e GROUP BY 2
    UNION ALL SELECT 'clusters', array_to_string(tools, '>'), CAST(members AS VARCHAR) FROM c UNION ALL SELECT 'skills', name, CAST(members AS VARCHAR) FROM s UNION ALL SELECT 'triage', name, decision FROM tr
    UNION ALL SELECT 'gaps', CAST(k AS VARCHAR), CAST(early + late AS VARCHAR) FROM g UNION ALL SELECT 'gates', CAST(k AS VARCHAR), gate FROM p UNION ALL SELECT 'trials', CAST(k AS VARCHAR), state FROM q
    UNION ALL SELECT 'fidelity', sess, CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR) FROM fi UNION ALL SELECT 'drift', CAST(k AS VARCHAR), CAST(boost AS VARCHAR) FROM dr
    UNION ALL SELECT 'meta', signal, CAST(count(*) AS VARCHAR) FROM (SELECT 'gate ' || gate AS signal FROM p UNION ALL SELECT 'trial ' || state FROM q UNION ALL SELECT 'skill ' || decision FROM tr UNION ALL SELECT 'low fidelity' FROM fi WHERE score < 0.6) GROUP BY 2""")
def l08_staged_consolidation(spark, sf_dir):
    """All stages of the consolidation, run to the gaps, and taken up from there by a second run."""
    tables, _ = _resumed(spark, sf_dir, "consolidation", CONSOLIDATION, "gaps")
    shown = {
        "health": ("event_type", F.col("n")), "clusters": (F.array_join("tools", ">"), F.col("members")), "skills": ("name", F.col("members")), "triage": ("name", F.col("decision")), "gaps": ("k", F.col("early") + F.col("late")),
        "gates": ("k", F.concat("outcome", F.lit(" "), "reason")), "trials": ("k", F.col("state")), "fidelity": ("sess", F.round(F.col("score") * 100).cast("bigint")), "drift": ("k", F.col("boost")), "meta": ("signal", F.col("n")),
    }
    rows = [tables[s].select(F.lit(s).alias("stage"), (F.col(i) if isinstance(i, str) else i).cast("string").alias("item"), v.cast("string").alias("value")) for s, (i, v) in shown.items()]
    return reduce(lambda a, b: a.union(b), rows)


def _markers(calls):
    """Markers of sessions; the first of each key is committed, the others are known."""
    m = calls.where(_IS("signup") & F.col("k").isNotNull())
    n = F.row_number().over(W.partitionBy("k", "user_id").orderBy("event_id"))
    return m.select("sess", "k", "event_id", (n == 1).alias("committed"))


def _outcomes(calls):
    verdict = calls.where(_IS("purchase") | _IS("error"))
    return verdict.groupBy("sess").agg(F.max_by(_IS("purchase"), "event_id").alias("passed"), F.count("*").alias("runs"))


def _credits(calls, outcomes):
    """What a session looked up gets a use, and a reversal if the session failed."""
    views = calls.where(_IS("view") & F.col("k").isNotNull()).select("sess", "k").distinct()
    return views.join(outcomes, "sess").select("sess", "k", (~F.col("passed")).alias("reverted"))


def _review(calls, markers):
    """Committed markers that name what failed in the same session."""
    failed = calls.where(_IS("error") & F.col("k").isNotNull()).select("sess", "k").distinct()
    return markers.where("committed").join(failed, ["sess", "k"]).groupBy("sess").agg(F.count("*").alias("relevant"))


def _snapshots(calls, markers, outcomes):
    counts = markers.groupBy("sess").agg(F.count_if("committed").alias("committed"), F.count_if(~F.col("committed")).alias("known"))
    last = calls.groupBy("sess").agg(F.first("user_id").alias("user_id"), F.max("event_id").alias("last"))
    return last.join(_tools(calls), "sess").join(counts, "sess", "left").join(outcomes, "sess", "left").fillna(0, ["committed", "known"])


def _mirror(snapshots):
    """Snapshots of a user numbered in their order."""
    return snapshots.select("sess", F.row_number().over(W.partitionBy("user_id").orderBy("last")).cast("bigint").alias("number"))


def _closed(snapshots, credits, review, mirror):
    c = credits.groupBy("sess").agg(F.count("*").alias("used"), F.count_if("reverted").alias("reverted"))
    rows = snapshots.join(c, "sess", "left").join(review, "sess", "left").join(mirror, "sess").fillna(0, ["used", "reverted", "relevant"])
    closed = F.col("passed").isNotNull() & (F.col("committed") + F.col("known") > 0)
    return rows.select("sess", F.array_join("tools", ",").alias("tools"), "committed", "known", "passed", "used", "reverted", "relevant", "number", closed.alias("closed"))


CLOSEOUT = [
    Stage("markers", ("calls",), _markers),
    Stage("outcomes", ("calls",), _outcomes),
    Stage("credits", ("calls", "outcomes"), _credits),
    Stage("review", ("calls", "markers"), _review),
    Stage("snapshots", ("calls", "markers", "outcomes"), _snapshots),
    Stage("mirror", ("snapshots",), _mirror),
    Stage("closed", ("snapshots", "credits", "review", "mirror"), _closed),
]


@query(_E + """, m AS (SELECT sess, k, row_number() OVER (PARTITION BY k, user_id ORDER BY event_id) = 1 AS committed FROM e WHERE event_type = 'signup' AND k IS NOT NULL),
    o AS (SELECT sess, arg_max(event_type = 'purchase', event_id) AS passed FROM e WHERE event_type IN ('purchase', 'error') GROUP BY 1),
    c AS (SELECT sess, count(*) AS used, count(*) FILTER (NOT passed) AS reverted FROM (SELECT DISTINCT sess, k FROM e WHERE event_type = 'view' AND k IS NOT NULL) JOIN o USING (sess) GROUP BY 1),
    r AS (SELECT sess, count(*) AS relevant FROM m JOIN (SELECT DISTINCT sess, k FROM e WHERE event_type = 'error') USING (sess, k) WHERE committed GROUP BY 1),
    f AS (SELECT sess, event_type, min(event_id) AS first FROM e GROUP BY 1, 2), t AS (SELECT sess, string_agg(event_type, ',' ORDER BY first) AS tools FROM f GROUP BY 1),
    n AS (SELECT sess, count(*) FILTER (committed) AS committed, count(*) FILTER (NOT committed) AS known FROM m GROUP BY 1),
    l AS (SELECT sess, any_value(user_id) AS user_id, max(event_id) AS last FROM e GROUP BY 1)
    SELECT sess, tools, coalesce(committed, 0) AS committed, coalesce(known, 0) AS known, passed, coalesce(used, 0) AS used, coalesce(reverted, 0) AS reverted, coalesce(relevant, 0) AS relevant,
        row_number() OVER (PARTITION BY user_id ORDER BY last) AS number, passed IS NOT NULL AND coalesce(committed + known, 0) > 0 AS closed
    FROM l JOIN t USING (sess) LEFT JOIN n USING (sess) LEFT JOIN o USING (sess) LEFT JOIN c USING (sess) LEFT JOIN r USING (sess)""")
def l26_staged_closeout(spark, sf_dir):
    """The seven steps that close sessions, run to the credits, and taken up from there by a second run."""
    tables, _ = _resumed(spark, sf_dir, "closeout", CLOSEOUT, "credits")
    return tables["closed"]


# what is asked of the graph and the units, from tables


@query(_G + """, q AS (SELECT DISTINCT 'o:' || o_orderkey AS a, CASE o_orderkey % 4 WHEN 0 THEN 'r:' || o_orderkey % 5 WHEN 1 THEN 'n:' || o_orderkey % 25 WHEN 2 THEN 'c:' || o_custkey ELSE 'o:' || o_orderkey END AS b FROM orders UNION SELECT 's:' || s_suppkey, 'r:' || s_suppkey % 6 FROM supplier),
    p AS (SELECT DISTINCT a AS root, a AS node, 0 AS d FROM q UNION ALL SELECT root, to_id, d + 1 FROM p JOIN g ON from_id = node WHERE d < 4) SELECT a, b, EXISTS (SELECT 1 FROM p WHERE p.root = q.a AND p.node = q.b) AS reached FROM q""")
def g09_reachable_pairs(spark, sf_dir):
    """Whether each order reaches a region, nation, customer or itself, and each supplier a region, within four steps."""
    key = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    o, s = F.col("o_orderkey"), F.col("s_suppkey")
    to = F.when(o % 4 == 0, key("r:", o % 5)).when(o % 4 == 1, key("n:", o % 25)).when(o % 4 == 2, key("c:", F.col("o_custkey"))).otherwise(key("o:", o))
    pairs = read(spark, sf_dir, "orders").select(key("o:", o).alias("a"), to.alias("b")).union(read(spark, sf_dir, "supplier").select(key("s:", s), key("r:", s % 6)))
    return G.reachable(graph(spark, sf_dir), pairs, 4)


@query(_G + """, m AS (SELECT 'o:' || l_orderkey AS from_id, 's:' || l_suppkey AS to_id, CASE l_returnflag WHEN 'A' THEN 'uses' WHEN 'R' THEN 'owns' ELSE 'likes' END AS relation FROM lineitem) SELECT from_id, to_id, relation FROM g UNION SELECT * FROM m WHERE relation IN ('uses', 'owns', 'derived_from', 'implements')""")
def g05_added_edges(spark, sf_dir):
    """Edges from the lines of orders added to the graph, if their relation is allowed; each edge once."""
    relation = F.when(F.col("l_returnflag") == "A", "uses").when(F.col("l_returnflag") == "R", "owns").otherwise("likes")
    added = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey")).alias("from_id"), F.concat(F.lit("s:"), F.col("l_suppkey")).alias("to_id"), relation.alias("relation"))
    return graph(spark, sf_dir).union(added.where(F.col("relation").isin("uses", "owns", "derived_from", "implements"))).distinct()


@query(stores_sql("units", "entries") + """, w AS (SELECT id AS hint, unnest(list_distinct(regexp_extract_all(body, '[A-Za-z0-9_]+'))) AS name FROM entries), n AS (SELECT name, arg_min(summary, id) AS summary FROM units GROUP BY 1), l AS (SELECT hint, string_agg(name || ': ' || summary, chr(10) ORDER BY name) AS l, count(*) AS named FROM w JOIN n USING (name) GROUP BY 1)
    SELECT hint AS id, l AS added, named FROM l""")
def m28_entry_hints(spark, sf_dir):
    """Entries that name units, with the units' summaries."""
    n = store(spark, sf_dir, "units").groupBy("name").agg(F.min_by("summary", "id").alias("summary"))
    w = store(spark, sf_dir, "entries").select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[A-Za-z0-9_]+"), 0))).alias("name")).join(n, "name")
    lines = F.array_sort(F.collect_list(F.struct("name", F.concat_ws(": ", "name", "summary").alias("l"))))  # the names of one entry
    return w.groupBy("id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("added"), F.count("*").alias("named"))
