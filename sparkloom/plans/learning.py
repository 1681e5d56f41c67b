"""Queries of the learning loop, of telemetry, and of listings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import commands as C
from sparkloom.functions import prose as P
from sparkloom.operators import learning as L
from sparkloom.operators import retrieval as S
from sparkloom.operators import similarity as SIM
from sparkloom.plans.catalog import _E, query
from sparkloom.plans.knowledge import _TERMS
from sparkloom.plans.stores import store, stores_sql
from sparkloom.sources.tables import events, read

# aggregations


@query(stores_sql("gaps") + ", g AS (SELECT tool, query, count(*) AS seen FROM gaps GROUP BY 1, 2) SELECT count(*) AS gaps, sum(seen)::BIGINT AS seen, count(*) FILTER (seen >= 2) AS repeated FROM g")
def a10_m01_r22_gap_summary(spark, sf_dir):
    """Misses by what was looked for: how many there are, how often, and how many came again."""
    g = store(spark, sf_dir, "gaps").groupBy("tool", "query").agg(F.count("*").alias("seen"))
    return g.agg(F.count("*").alias("gaps"), F.sum("seen").alias("seen"), F.count_if(F.col("seen") >= 2).alias("repeated"))


@query(stores_sql("entries", "walls", "gaps") + """ SELECT json_object('entries', (SELECT count(*) FROM entries), 'live', (SELECT count(*) FROM entries WHERE superseded_by IS NULL), 'walls', (SELECT count(*) FROM walls), 'gaps', (SELECT count(DISTINCT (tool, query)) FROM gaps))::VARCHAR AS report""")
def a12_s24_l27_health(spark, sf_dir):
    """Counts over several stores as one JSON report; each store is aggregated by itself."""
    e = store(spark, sf_dir, "entries").agg(F.count("*").alias("entries"), F.count_if(F.col("superseded_by").isNull()).alias("live"))
    w = store(spark, sf_dir, "walls").agg(F.count("*").alias("walls"))
    g = store(spark, sf_dir, "gaps").agg(F.count_distinct("tool", "query").alias("gaps"))
    return e.crossJoin(F.broadcast(w)).crossJoin(F.broadcast(g)).select(F.to_json(F.struct("entries", "live", "walls", "gaps")).alias("report"))  # single rows


@query("""WITH u AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'big-5-5-x' WHEN 1 THEN 'big-5-mini' WHEN 2 THEN 'small-1' ELSE 'other' END AS model, length(text) AS n FROM conversations), p(prefix, price) AS (VALUES ('big-5', 5.0), ('big-5-5', 4.0), ('small', 1.0)),
    w AS (SELECT model, turn // 2 AS win, sum(n)::BIGINT AS tokens FROM u GROUP BY 1, 2), m AS (SELECT model, arg_max(price, length(prefix)) AS price FROM (SELECT DISTINCT model FROM u) x JOIN p ON starts_with(model, prefix) GROUP BY 1)
    SELECT model, win, tokens, round(tokens * price / 1000000, 9)::DOUBLE AS cost FROM w LEFT JOIN m USING (model)""")
def a15_priced_windows(spark, sf_dir):
    """Amounts by window and model, priced by the longest prefix of the model's name; a model without one has no cost."""
    c = F.col("conv_id") % 4
    model = F.when(c == 0, "big-5-5-x").when(c == 1, "big-5-mini").when(c == 2, "small-1").otherwise("other")
    used = read(spark, sf_dir, "conversations").groupBy(model.alias("model"), F.floor(F.col("turn") / 2).alias("win")).agg(F.sum(F.length("text")).alias("tokens"))
    price = F.coalesce(*[F.when(F.col("model").startswith(p), F.lit(v)) for p, v in (("big-5-5", 4.0), ("big-5", 5.0), ("small", 1.0))])
    return used.withColumn("cost", F.round(F.col("tokens") * price / 1_000_000, 9))


@query("""WITH o AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS outcomes, sum(n)::BIGINT AS total FROM o GROUP BY 1""")
def a17_outcome_maps(spark, sf_dir):
    """How each member's outcomes are distributed; kinds are few, so a map has a few entries."""
    o = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string"))))
    return o.groupBy("user_id").agg(F.array_join(entries, ",").alias("outcomes"), F.sum("n").alias("total"))


_REASONS = ("duplicate: a", "syntax: b", "credibility 0.1", "duplicate: c", "other", "survival low")


@query("""WITH r AS (SELECT ['duplicate: a', 'syntax: b', 'credibility 0.1', 'duplicate: c', 'other', 'survival low'][event_id % 6 + 1] AS reason FROM events)
    SELECT CASE WHEN starts_with(reason, 'duplicate') THEN 'duplicate' WHEN starts_with(reason, 'syntax') THEN 'syntax' WHEN starts_with(reason, 'credibility') THEN 'credibility' WHEN starts_with(reason, 'survival') THEN 'survival' ELSE 'unknown' END AS kind, count(*) AS n FROM r GROUP BY 1""")
def a19_l10_rejections(spark, sf_dir):
    """Reasons of rejection counted by how they begin."""
    reason = F.element_at(F.array(*map(F.lit, _REASONS)), (F.col("event_id") % 6 + 1).cast("int"))
    kind = F.coalesce(*[F.when(F.col("reason").startswith(p), p) for p in ("duplicate", "syntax", "credibility", "survival")], F.lit("unknown"))
    return read(spark, sf_dir, "events").select(reason.alias("reason")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_STEP = {"click": "closeout", "view": "bootstrap", "purchase": "plan", "signup": "partial"}
_SEEN = _E + ", s AS (SELECT sess, any_value(user_id) AS user_id, bool_or(event_type = 'click') AS c, bool_or(event_type = 'view') AS b, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'signup') AS q FROM e GROUP BY 1), f AS (SELECT *, greatest(0, round(1 - CASE WHEN c THEN 0 ELSE 0.25 END - CASE WHEN b THEN 0 ELSE 0.15 END - CASE WHEN p THEN 0 ELSE 0.1 END - CASE WHEN q THEN 0 ELSE 0.1 END, 6))::DOUBLE AS score, list_filter([CASE WHEN NOT c THEN 'closeout' END, CASE WHEN NOT b THEN 'bootstrap' END, CASE WHEN NOT p THEN 'steps|plan' END, CASE WHEN NOT q THEN 'partial' END], lambda x: x IS NOT NULL) AS missing FROM s)"


def _fidelity(spark, sf_dir):
    step = F.create_map(*[F.lit(x) for kv in _STEP.items() for x in kv])[F.col("event_type")]
    s = events(spark, sf_dir).groupBy("sess").agg(F.first("user_id").alias("user_id"), F.collect_set(step).alias("tools"))
    score, missing = L.fidelity(F.col("tools"))
    return s.select("sess", "user_id", score.alias("score"), missing.alias("missing"))


@query(_SEEN + " SELECT sess, score, array_to_string(missing, ',') AS missing FROM f")
def f42_l07_session_fidelity(spark, sf_dir):
    """How far each session kept to the steps, and which it left out."""
    return _fidelity(spark, sf_dir).select("sess", "score", F.array_join("missing", ",").alias("missing"))


@query(_SEEN + """, m AS (SELECT user_id, x, count(*) AS n FROM (SELECT user_id, unnest(missing) AS x FROM f) GROUP BY 1, 2), t AS (SELECT user_id, arg_min(x, (-n, x)) AS most FROM m GROUP BY 1)
    SELECT user_id, round(avg(score), 6) AS average, count(*) FILTER (score < 0.6) AS low, any_value(most) AS most FROM f LEFT JOIN t USING (user_id) GROUP BY 1""")
def a20_fidelity_trends(spark, sf_dir):
    """Average fidelity, low sessions, and the step left out most; of equal ones the first."""
    f = _fidelity(spark, sf_dir)
    most = f.select("user_id", F.explode("missing").alias("x")).groupBy("user_id", "x").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("m"))
    return f.groupBy("user_id").agg(F.round(F.avg("score"), 6).alias("average"), F.count_if(F.col("score") < 0.6).alias("low")).join(most, "user_id", "left").select("user_id", "average", "low", F.col("m.x").alias("most"))


@query(_E + """, h AS (SELECT sess, k, count(*) AS hits FROM e WHERE event_type = 'view' AND k IS NOT NULL GROUP BY 1, 2), o AS (SELECT sess, count(*) FILTER (event_type = 'purchase') AS pos, count(*) FILTER (event_type = 'error') AS neg FROM e GROUP BY 1)
    SELECT k, sum(CASE WHEN pos > 0 THEN ceil(hits * (0.5 + 0.25 * pos)) ELSE 0 END)::BIGINT AS use_delta, sum(CASE WHEN neg > 0 THEN ceil(hits * (0.5 + 0.35 * neg)) ELSE 0 END)::BIGINT AS reverted_delta FROM h JOIN o USING (sess) WHERE pos + neg > 0 GROUP BY 1""")
def a23_l11_l12_evidence(spark, sf_dir):
    """What sessions' outcomes add to the entries that they retrieved, by hits."""
    e = events(spark, sf_dir)
    hits = e.where("event_type = 'view' and k is not null").groupBy("sess", "k").agg(F.count("*").alias("hits"))
    o = e.groupBy("sess").agg(F.count_if(F.col("event_type") == "purchase").alias("pos"), F.count_if(F.col("event_type") == "error").alias("neg")).where("pos + neg > 0")
    use, back = F.when(F.col("pos") > 0, F.ceil(F.col("hits") * (0.5 + 0.25 * F.col("pos")))).otherwise(0), F.when(F.col("neg") > 0, F.ceil(F.col("hits") * (0.5 + 0.35 * F.col("neg")))).otherwise(0)
    return hits.join(o, "sess").groupBy("k").agg(F.sum(use).alias("use_delta"), F.sum(back).alias("reverted_delta"))


@query("SELECT lang, round(avg((quality = 1)::INT), 6) AS coverage, round(avg(CASE WHEN quality = 1 THEN (toxic = 0)::INT END), 6) AS precise, count(*) AS cases FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a26_benchmark_ratios(spark, sf_dir):
    """Coverage and precision as averages of truths."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    good, clean = F.col("quality") == 1, (F.col("toxic") == 0).cast("int")
    return d.groupBy("lang").agg(F.round(F.avg(good.cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(good, clean)), 6).alias("precise"), F.count("*").alias("cases"))


# ordered analytics and listings


@query(stores_sql("calls") + r""", r AS (SELECT user_id, id, regexp_replace(string_split(regexp_replace(trim(command), '^(?:cd [^;&]*(?:&&|;)\s*)+', ''), chr(10))[1], '\s+', ' ', 'g') AS cmd, NOT (contains(output, 'error') OR contains(output, 'FAILED') OR contains(output, 'panicked')) AS ok FROM calls WHERE tool <> 'Edit'),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS back FROM r), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, cmd ORDER BY id DESC) AS n FROM p), q AS (SELECT *, (""" + " OR ".join(f"contains(lower(cmd), '{n}')" for n in C.BUILD_OR_TEST) + r""") AS build FROM l WHERE n = 1),
    s AS (SELECT user_id, cmd, CASE WHEN ok AND build THEN 'green' WHEN NOT ok AND (build OR back <= 12) THEN 'failing' END AS state, id FROM q)
    SELECT user_id, state, cmd, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, state ORDER BY id DESC) AS place FROM s WHERE state IS NOT NULL) WHERE place <= CASE state WHEN 'green' THEN 5 ELSE 2 END""")
def w03_l31_last_runs(spark, sf_dir):
    """Each command's last run decides: green builds, at most five, and what still fails, at most two; others fail only among the last twelve runs."""
    ok = ~(F.contains("output", F.lit("error")) | F.contains("output", F.lit("FAILED")) | F.contains("output", F.lit("panicked")))
    r = store(spark, sf_dir, "calls").where("tool <> 'Edit'").select("user_id", "id", C.comparable(F.col("command")).alias("cmd"), ok.alias("ok"))
    p = r.withColumn("back", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("id"))))
    last = p.groupBy("user_id", "cmd").agg(F.max_by(F.struct("ok", "back"), "id").alias("l"), F.max("id").alias("id"))
    build = C.is_build_or_test(F.col("cmd"))
    state = F.when(F.col("l.ok") & build, "green").when(~F.col("l.ok") & (build | (F.col("l.back") <= 12)), "failing")
    s = last.withColumn("state", state).where("state is not null")
    place = F.row_number().over(W.partitionBy("user_id", "state").orderBy(F.desc("id"))).cast("long")
    return s.withColumn("place", place).where(F.col("place") <= F.when(F.col("state") == "green", 5).otherwise(2)).select("user_id", "state", "cmd", "place")


@query("""WITH b AS (SELECT *, count(*) FILTER (turn % 3 = 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - (turn % 3 = 2)::INT AS later FROM conversations) SELECT conv_id, turn, length(text) AS n FROM b WHERE later = 1 AND turn % 3 <> 2 OR later = 0 AND turn % 3 = 2""")
def w14_last_segment(spark, sf_dir):
    """What lies between the last two boundaries, with the last boundary."""
    c = read(spark, sf_dir, "conversations")
    edge = (F.col("turn") % 3 == 2).cast("int")
    later = F.sum(edge).over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)) - edge
    return c.withColumns({"later": later, "edge": edge}).where("(later = 1 and edge = 0) or (later = 0 and edge = 1)").select("conv_id", "turn", F.length("text").alias("n"))


@query("""WITH f AS (SELECT user_id, event_type AS file, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2) SELECT user_id, file, n, row_number() OVER (PARTITION BY user_id ORDER BY last_id DESC) AS place FROM f""")
def w15_recent_files(spark, sf_dir):
    """What was touched, each once with its count, the latest first."""
    f = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("file")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return f.select("user_id", "file", "n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last_id"))).cast("long").alias("place"))


@query(_E + """, w AS (SELECT event_type, ((SELECT max(secs) FROM e) - secs) // 1209600 AS back, value FROM e), a AS (SELECT event_type, avg(value) FILTER (back = 0) AS now, avg(value) FILTER (back = 1) AS before FROM w GROUP BY 1)
    SELECT event_type, CASE WHEN abs(now - before) < 0.005 THEN 'same' WHEN (now > before) = (event_type <> 'error') THEN 'improving' ELSE 'regressing' END AS trend FROM a WHERE now IS NOT NULL AND before IS NOT NULL""")
def w16_x12_polarised_trend(spark, sf_dir):
    """A window against the one before; for errors less is better. Both windows come from one scan."""
    e = events(spark, sf_dir)
    back = F.floor((F.col("last") - F.col("at")) / 1_209_600)
    a = e.crossJoin(F.broadcast(e.agg(F.max("at").alias("last")))).groupBy("event_type").agg(F.avg(F.when(back == 0, F.col("value"))).alias("now"), F.avg(F.when(back == 1, F.col("value"))).alias("before"))  # a single row
    better = (F.col("now") > F.col("before")) == (F.col("event_type") != "error")
    return a.where("now is not null and before is not null").select("event_type", F.when(F.abs(F.col("now") - F.col("before")) < 0.005, "same").when(better, "improving").otherwise("regressing").alias("trend"))


@query(stores_sql("entries") + """, s AS (SELECT *, CASE WHEN used = 0 THEN CASE WHEN reverted > 0 THEN 0.0 ELSE 1.0 END ELSE greatest(0, (used - reverted) / used) END AS survival FROM entries WHERE superseded_by IS NULL)
    SELECT id, round(survival, 6)::DOUBLE AS survival, place FROM (SELECT *, row_number() OVER (ORDER BY round(survival, 9) DESC, used DESC, e.at DESC, id) AS place FROM s e) WHERE place <= 30""")
def o02_o03_best_entries(spark, sf_dir):
    """Live entries by survival, use and date; the first thirty."""
    use, back = F.col("used"), F.col("reverted")
    s = F.when(use == 0, F.when(back > 0, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), (use - back) / use))
    order = [F.round("survival", 9).desc(), F.desc("used"), F.desc("at"), F.col("id")]
    best = store(spark, sf_dir, "entries").where("superseded_by is null").withColumn("survival", s).orderBy(*order).limit(30)
    return best.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long")).select("id", F.round("survival", 6).alias("survival"), "place")


@query(stores_sql("entries") + """, t AS (SELECT id, e.at, length(body) AS n, CASE WHEN contains(tags, 'tag1') THEN 0 WHEN used >= 8 THEN 1 WHEN reverted >= 3 THEN 2 ELSE 3 END AS tier FROM entries e WHERE superseded_by IS NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY t.at DESC, id) AS place, sum(n) OVER (PARTITION BY tier ORDER BY t.at DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM t)
    SELECT id, tier, place, place <= [1000000, 25, 30, 1000000][tier + 1] AND used <= 4000 AS listed FROM p""")
def o04_w12_tiered_listing(spark, sf_dir):
    """Matched entries, then those that fired (25), related ones (30) and the rest, newest first, in a budget of characters; what is over is told by id."""
    tier = F.when(F.contains("tags", F.lit("tag1")), 0).when(F.col("used") >= 8, 1).when(F.col("reverted") >= 3, 2).otherwise(3)
    t = store(spark, sf_dir, "entries").where("superseded_by is null").select("id", "at", F.length("body").alias("n"), tier.alias("tier"))
    p = S.budgeted(t, "tier", [F.desc("at"), F.col("id")], F.col("n"), 4000)
    most = F.element_at(F.array(*map(F.lit, (1_000_000, 25, 30, 1_000_000))), F.col("tier") + 1)
    return p.select("id", "tier", "place", (F.col("listed") & (F.col("place") <= most)).alias("listed"))


@query(stores_sql("walls") + """, s AS (SELECT id, area, CASE status WHEN 'open' THEN 0 WHEN 'held' THEN 1 WHEN 'Broken' THEN 2 ELSE 3 END AS rank, contains(claim, 'serde')::INT + contains(claim, 'bound')::INT * 2 AS score FROM walls)
    SELECT id, area, score, row_number() OVER (PARTITION BY area ORDER BY score DESC, rank, id) AS place FROM s""")
def o07_walls_order(spark, sf_dir):
    """Limits by their score, then open before held before moved."""
    state = P.alias(F.col("status"), P.STATUS)
    rank = F.when(state == "open", 0).when(state == "holds", 1).when(state == "moved", 2).otherwise(3)
    score = F.contains("claim", F.lit("serde")).cast("int") + F.contains("claim", F.lit("bound")).cast("int") * 2
    w = store(spark, sf_dir, "walls").withColumns({"rank": rank, "score": score})
    return w.select("id", "area", "score", F.row_number().over(W.partitionBy("area").orderBy(F.desc("score"), "rank", "id")).cast("long").alias("place"))


@query(stores_sql("entries", "traps") + """, d AS (SELECT 'entry' AS origin, id, e.at, body FROM entries e UNION ALL SELECT 'trap', id, added_at, description FROM traps) SELECT origin, id, length(body) AS chars, row_number() OVER (ORDER BY d.at, origin, id) AS place FROM d QUALIFY place <= 100""")
def u05_all_docs(spark, sf_dir):
    """Entries and traps as one list by time; its first hundred."""
    d = store(spark, sf_dir, "entries").select(F.lit("entry").alias("origin"), "id", "at", F.length("body").alias("chars")).union(store(spark, sf_dir, "traps").select(F.lit("trap"), "id", "added_at", F.length("description")))
    first = d.orderBy("at", "origin", "id").limit(100)
    return first.select("origin", "id", "chars", F.row_number().over(W.orderBy("at", "origin", "id")).cast("long").alias("place"))


# retrieval of context


_TRAPQ = "q(id, text) AS (VALUES (1, 'pool_acquire failed in setSize3 while polling'), (2, 'CuboidDef recv_timeout again'), (3, 'nothing shared here'), (4, 'recv_timeout'))"


@query(stores_sql("traps") + ", " + _TRAPQ + r""", w AS (SELECT id AS trap, unnest(list_distinct(list_filter(regexp_split_to_array(lower(description), '[^\p{L}\p{N}_]+'), lambda x: x <> ''))) AS word FROM traps),
    a AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: strlen(x) >= 4))) AS token FROM q), h AS (SELECT DISTINCT token, trap FROM (SELECT DISTINCT token FROM a) JOIN w ON word = token OR (strlen(token) >= 6 AND starts_with(word, token))),
    f AS (SELECT token, count(*) <= 3 AS rare FROM h GROUP BY 1), g AS (SELECT id, trap, count(*) FILTER (rare AND (contains(token, '_') OR token IN ('cuboiddef', 'setsize3'))) AS ids, count(*) FILTER (rare) AS rare, count(*) AS score, bool_or(rare AND (contains(token, '_') OR token IN ('cuboiddef', 'setsize3')) AND length(token) >= 9) AS long FROM a JOIN h USING (token) JOIN f USING (token) GROUP BY 1, 2)
    SELECT id, m[4] AS trap, m[1] AS ids, m[2] AS rare, m[3] AS score FROM (SELECT id, max((ids, rare, score, trap)) AS m FROM g WHERE long OR (ids >= 1 AND rare >= 2) OR (rare >= 3 AND score >= 2) GROUP BY 1)""")
def r15_x04_best_trap(spark, sf_dir):
    """For each failure the trap with the best distinctive evidence; common words alone never count."""
    q = spark.createDataFrame([(1, "pool_acquire failed in setSize3 while polling"), (2, "CuboidDef recv_timeout again"), (3, "nothing shared here"), (4, "recv_timeout")], "id int, text string")
    return S.best_trap(q, store(spark, sf_dir, "traps"))


@query(stores_sql("units") + """, s AS (SELECT id, name, module, length(body) AS n, (lower(name) = 'ring3')::INT * 300 + contains(lower(name), 'ring')::INT * 100 + contains(lower(module), 'small')::INT * 40 + contains(lower(summary), 'small')::INT * 30 + contains(lower(body), 'get_ring')::INT * 25 AS score FROM units),
    p AS (SELECT *, row_number() OVER (ORDER BY score DESC, name, id) AS place FROM s WHERE score > 0) SELECT id, score, sum(n) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) <= 1500 AS listed FROM p WHERE place <= 15""")
def r18_api_context(spark, sf_dir):
    """Units for a task by points per word, fifteen at most, in a budget of characters."""
    has = lambda c, w: F.contains(F.lower(c), F.lit(w)).cast("int")
    score = (F.lower("name") == "ring3").cast("int") * 300 + has("name", "ring") * 100 + has("module", "small") * 40 + has("summary", "small") * 30 + has("body", "get_ring") * 25
    order = [F.desc("score"), F.col("name"), F.col("id")]
    best = store(spark, sf_dir, "units").withColumn("score", score).where("score > 0").orderBy(*order).limit(15).withColumn("all", F.lit(1))
    return S.budgeted(best, "all", order, F.length("body"), 1500).select("id", "score", "listed")


_PACKET = (("unit", 8), ("pattern", 4), ("trap", 6))


@query(stores_sql("units", "entries", "traps") + """, d AS (SELECT 'unit' AS section, id, contains(lower(body), 'ring')::INT * 2 + contains(lower(name), 'small')::INT AS score, greatest(1, strlen(body) // 4) AS cost, 8 AS most FROM units
        UNION ALL SELECT 'pattern', id, contains(lower(body), 'smallring')::INT * 3 + contains(body, 'le')::INT, greatest(1, strlen(body) // 4), 4 FROM entries WHERE superseded_by IS NULL AND kind = 'pattern' UNION ALL SELECT 'trap', id, contains(lower(description), 'pool')::INT * 2 + 1, greatest(1, strlen(description) // 4), 6 FROM traps),
    p AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, id) AS place FROM d WHERE score > 0), k AS (SELECT * FROM p WHERE place <= most),
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC, section, id) AS i FROM k),
    f AS (SELECT list_reduce(list_prepend({'used': 0::BIGINT, 'ids': []::BIGINT[], 'c': 0::BIGINT, 'i': 0::BIGINT}, list({'used': 0::BIGINT, 'ids': []::BIGINT[], 'c': cost::BIGINT, 'i': i::BIGINT} ORDER BY i)), lambda s, x: CASE WHEN s.used + x.c <= 900 THEN {'used': s.used + x.c, 'ids': list_append(s.ids, x.i), 'c': 0::BIGINT, 'i': 0::BIGINT} ELSE s END) AS r FROM o)
    SELECT section, id, score, cost::BIGINT AS cost, list_contains((SELECT r.ids FROM f), i) AS admitted FROM o""")
def r19_w11_context_packet(spark, sf_dir):
    """A packet of units, patterns and traps: so many of each, then what still fits a budget of tokens in order of score, skipping what doesn't.

    The fold goes over the few rows that the sections' limits leave.
    """
    u, e, t = store(spark, sf_dir, "units"), store(spark, sf_dir, "entries"), store(spark, sf_dir, "traps")
    has = lambda c, w: F.contains(c, F.lit(w)).cast("int")
    part = lambda df, name, score, text: df.select(F.lit(name).alias("section"), "id", score.alias("score"), P.token_estimate(F.col(text)).alias("cost"))
    d = part(u, "unit", has(F.lower("body"), "ring") * 2 + has(F.lower("name"), "small"), "body")
    d = d.union(part(e.where("superseded_by is null and kind = 'pattern'"), "pattern", has(F.lower("body"), "smallring") * 3 + has("body", "le"), "body"))
    d = d.union(part(t, "trap", has(F.lower("description"), "pool") * 2 + 1, "description")).where("score > 0")
    most = F.create_map(*[F.lit(x) for kv in _PACKET for x in kv])[F.col("section")]
    kept = d.withColumn("place", F.row_number().over(W.partitionBy("section").orderBy(F.desc("score"), "id"))).where(F.col("place") <= most)
    rows = kept.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "section", "id", "score", "cost"))).alias("rows"))  # 18 at most
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("took"))
    fold = F.aggregate("rows", start, lambda s, x: F.struct((s["used"] + F.when(s["used"] + x["cost"] <= 900, x["cost"]).otherwise(0)).alias("used"), F.concat(s["took"], F.array(s["used"] + x["cost"] <= 900)).alias("took")))
    out = rows.select(F.explode(F.arrays_zip("rows", fold["took"].alias("took"))).alias("z"))
    return out.select("z.rows.section", "z.rows.id", "z.rows.score", "z.rows.cost", F.col("z.took").alias("admitted"))


@query("""WITH n AS (SELECT doc_id, generate_subscripts(string_split(text, '. '), 1) AS i, unnest(string_split(text, '. ')) AS note FROM documents),
    s AS (SELECT *, contains(lower(note), 'than')::INT + contains(lower(note), 'thereat')::INT + contains(lower(note), 'ering')::INT AS score FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place FROM s)
    SELECT doc_id, count(*) AS notes, count(*) FILTER (score > 0) AS matched, count(*) FILTER (score > 0 AND place <= 3) AS expanded FROM p GROUP BY 1""")
def r20_m29_note_tiers(spark, sf_dir):
    """Notes of a text that a hint matches: the best three are shown whole, the rest by their first clause. Worked out inside each row."""
    terms = ("than", "thereat", "ering")
    notes = F.split("text", r"\. ")
    score = lambda x: sum(F.contains(F.lower(x), F.lit(t)).cast("int") for t in terms)
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.transform(notes, score).alias("s"))
    hit = F.size(F.filter("s", lambda x: x > 0)).cast("long")
    return d.select("doc_id", F.size("s").cast("long").alias("notes"), hit.alias("matched"), F.least(hit, F.lit(3).cast("long")).alias("expanded"))


@query(_E + """, s AS (SELECT event_id, sess, props, row_number() OVER (PARTITION BY sess, sha256(props) ORDER BY event_id) AS n FROM e WHERE event_type = 'view') SELECT event_id, CASE WHEN n = 1 THEN props ELSE 'ref:' || substring(sha256(props), 1, 12) END AS sent FROM s""")
def r21_already_sent(spark, sf_dir):
    """What a session was sent before is sent as a reference."""
    e = events(spark, sf_dir).where("event_type = 'view'").withColumn("h", F.sha2("props", 256))
    n = F.row_number().over(W.partitionBy("sess", "h").orderBy("event_id"))
    return e.select("event_id", F.when(n == 1, F.col("props")).otherwise(F.concat(F.lit("ref:"), F.substring("h", 1, 12))).alias("sent"))


@query(stores_sql("entries", "traps", "walls", "units") + """, d AS (SELECT 'entry' AS origin, id, lower(body) AS t FROM entries WHERE superseded_by IS NULL UNION ALL SELECT 'trap', id, lower(description) FROM traps UNION ALL SELECT 'wall', id, lower(claim) FROM walls UNION ALL SELECT 'unit', id, lower(name || ' ' || summary) FROM units),
    s AS (SELECT origin, id, CASE WHEN contains(t, 'small ring pool') THEN 30 ELSE CASE WHEN h >= 2 THEN h ELSE 0 END END AS score FROM (SELECT *, contains(t, 'small')::INT + contains(t, 'ring')::INT + contains(t, 'pool')::INT AS h FROM d))
    SELECT origin, id, score, row_number() OVER (PARTITION BY origin ORDER BY score DESC, id) AS place FROM s WHERE score > 0 QUALIFY place <= 5""")
def r23_r13_o06_recall(spark, sf_dir):
    """Recall of a topic over four stores, the best five of each; two of its words must be there."""
    topic = "Small ring pool"
    terms = S.recall_terms(topic)
    parts = [
        store(spark, sf_dir, "entries").where("superseded_by is null").select(F.lit("entry").alias("origin"), "id", F.col("body").alias("t")),
        store(spark, sf_dir, "traps").select(F.lit("trap"), "id", "description"),
        store(spark, sf_dir, "walls").select(F.lit("wall"), "id", "claim"),
        store(spark, sf_dir, "units").select(F.lit("unit"), "id", F.concat_ws(" ", "name", "summary")),
    ]
    d = parts[0]
    for p in parts[1:]:
        d = d.union(p)
    s = d.select("origin", "id", S.recall_score(F.col("t"), topic.lower(), terms).alias("score")).where("score > 0")
    return s.withColumn("place", F.row_number().over(W.partitionBy("origin").orderBy(F.desc("score"), "id")).cast("long")).where("place <= 5")


# the learning loop


@query("WITH RECURSIVE " + stores_sql("entries")[5:] + ", d AS (SELECT id, body FROM entries), " + _TERMS % (0, 0) + """, q AS (SELECT a, b, cosine FROM p WHERE cosine >= 0.55), e2 AS (SELECT a AS id, b AS other, cosine FROM q UNION ALL SELECT b, a, cosine FROM q),
    o AS (SELECT id, row_number() OVER (ORDER BY e.at DESC, id) AS i FROM entries e), nb AS (SELECT o.id, o.i, coalesce(list(e2.other) FILTER (x.i < o.i), []::BIGINT[]) AS earlier FROM o LEFT JOIN e2 USING (id) LEFT JOIN o x ON x.id = e2.other GROUP BY 1, 2),
    g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS leaders UNION ALL SELECT nb.i, CASE WHEN list_has_any(leaders, earlier) THEN leaders ELSE list_append(leaders, nb.id) END FROM g JOIN nb ON nb.i = g.i + 1),
    ll AS (SELECT DISTINCT unnest((SELECT leaders FROM g ORDER BY i DESC LIMIT 1)) AS leader)
    SELECT o.id, coalesce(CASE WHEN o.id IN (SELECT leader FROM ll) THEN o.id END, (SELECT arg_max(e2.other, (e2.cosine, -x.i)) FROM e2 JOIN ll ON ll.leader = e2.other JOIN o x ON x.id = e2.other WHERE e2.id = o.id AND x.i < o.i)) AS leader FROM o""")
def l01_leader_clusters(spark, sf_dir):
    """Entries gathered around leaders, newest first, at a similarity of 0.55; rounds of joins give what going through them in order gives."""
    e = store(spark, sf_dir, "entries").select("id", "body", "at")
    members, pairs = SIM.similar_classes(SIM.weighted_terms(e, "id", "body"), "id", 0.55)
    newest = F.lit(-1_000_000) * F.col("at") + F.col("id")
    return L.leaders_of_classes(e.select("id", newest.alias("o")), members, pairs, "id", "o")


@query(_E + """, m AS (SELECT k AS cluster, count(DISTINCT user_id) AS members, avg((event_type = 'purchase')::INT) AS confidence, arg_max(event_type, (n2, event_type)) AS main FROM (SELECT *, count(*) OVER (PARTITION BY k, event_type) AS n2 FROM e) WHERE k IS NOT NULL GROUP BY 1)
    SELECT 'skill-' || cluster || '-' || main AS name, members, round(confidence, 6) AS confidence FROM m WHERE members >= 5 AND cluster % 10 <> 0""")
def l02_m18_skill_candidates(spark, sf_dir):
    """Clusters with members enough as skills, named from their domain and main tool; decided names are left out."""
    e = events(spark, sf_dir).where("k is not null")
    kinds = e.groupBy("k", "event_type").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "event_type")).alias("m"))
    m = e.groupBy("k").agg(F.count_distinct("user_id").alias("members"), F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("confidence")).where("members >= 5")
    decided = e.where("k % 10 = 0").select("k").distinct()
    named = m.join(kinds, "k").join(decided, "k", "left_anti")
    return named.select(F.format_string("skill-%d-%s", "k", "m.event_type").alias("name"), "members", "confidence")


_PROPS = """p AS (SELECT page_id AS id, page_id % 7 = 0 AS duplicate, page_id % 5 <> 1 AS valid, least(page_id % 12, 10) / 10 AS credibility, page_id % 9 AS seen, (page_id % 4) / 4 AS survival FROM pages)"""


def _proposals(spark, sf_dir):
    k = F.col("page_id")
    return read(spark, sf_dir, "pages").select(k.alias("id"), (k % 7 == 0).alias("duplicate"), (k % 5 != 1).alias("valid"), (F.least(k % 12, F.lit(10)) / 10).alias("credibility"), (k % 9).alias("seen"), ((k % 4) / 4).alias("survival"))


@query("WITH " + _PROPS + """ SELECT id, CASE WHEN duplicate OR NOT valid OR credibility < 0.2 THEN 'reject' WHEN seen < 5 THEN 'trial' WHEN survival < 0.5 THEN 'reject' ELSE 'pass' END AS outcome, CASE WHEN duplicate THEN 'duplicate' WHEN NOT valid THEN 'syntax' WHEN credibility < 0.2 THEN 'credibility' WHEN seen < 5 THEN 'seen too rarely' WHEN survival < 0.5 THEN 'survival' ELSE '' END AS reason FROM p""")
def l04_gates(spark, sf_dir):
    """Proposals through the gates in order, with the first one that stops each."""
    return L.gates(_proposals(spark, sf_dir)).select("id", "outcome", "reason")


@query("WITH " + _PROPS + """, t AS (SELECT id, seen AS original, id * 86400 AS staged, id * 86400 + 14 * 86400 AS expires, (id * 5) % 11 AS now_seen FROM p WHERE NOT duplicate) SELECT id, expires, CASE WHEN expires > (SELECT max(id) FROM p) * 43200 THEN 'running' WHEN now_seen >= original THEN 'pending' ELSE 'rejected' END AS state FROM t""")
def l05_m15_trials(spark, sf_dir):
    """Trials with the day they end; ended ones wait for review if the gap is still seen as often."""
    p = _proposals(spark, sf_dir).where("not duplicate")
    now = _proposals(spark, sf_dir).agg((F.max("id") * 43_200).alias("now"))
    t = p.withColumn("expires", F.col("id") * 86_400 + 14 * 86_400).crossJoin(F.broadcast(now))  # a single row
    state = F.when(F.col("expires") > F.col("now"), "running").when((F.col("id") * 5) % 11 >= F.col("seen"), "pending").otherwise("rejected")
    return t.select("id", "expires", state.alias("state"))


@query("""WITH a AS (SELECT lower(trim(c_mktsegment)) AS attempted, c_nationkey AS reason, count(*) AS times, max(c_custkey) AS last_id FROM customer GROUP BY 1, 2) SELECT attempted, reason, times, last_id, times >= 3 AS promoted FROM a""")
def l14_m02_corrections(spark, sf_dir):
    """Corrections counted by what was attempted and why it failed; the newest stands, and often repeated ones become traps."""
    c = read(spark, sf_dir, "customer").groupBy(F.lower(F.trim("c_mktsegment")).alias("attempted"), F.col("c_nationkey").alias("reason"))
    return c.agg(F.count("*").alias("times"), F.max("c_custkey").alias("last_id")).withColumn("promoted", F.col("times") >= 3)


@query("WITH d AS (SELECT event_id, user_id AS entry, event_type = 'error' AS raise, event_type = 'purchase' AS settle FROM events), s AS (SELECT entry, max(event_id) FILTER (raise) AS raised, max(event_id) FILTER (settle) AS settled FROM d GROUP BY 1) SELECT entry, coalesce(raised > coalesce(settled, -1), false) AS disputed FROM s")
def l18_m20_disputes(spark, sf_dir):
    """Entries with a dispute that nothing settled since."""
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("event_id")))
    s = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entry")).agg(last("error").alias("raised"), last("purchase").alias("settled"))
    return s.select("entry", F.coalesce(F.col("raised") > F.coalesce("settled", F.lit(-1)), F.lit(False)).alias("disputed"))


@query("WITH q AS (SELECT doc_id AS id, 'label' AS origin FROM labels WHERE toxic = 1 UNION ALL SELECT item_id, 'item' FROM benchmark) SELECT id, origin FROM q ORDER BY md5(origin || id), id LIMIT 30")
def l20_review_queue(spark, sf_dir):
    """Thirty questions of several sources in an order that a seed fixes."""
    q = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("label").alias("origin")).union(read(spark, sf_dir, "benchmark").select("item_id", F.lit("item")))
    return q.orderBy(F.md5(F.concat("origin", F.col("id").cast("string"))), "id").limit(30)


@query("SELECT conv_id, count(*) AS calls, sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 5 ELSE 2 END * length(text) + CASE WHEN turn > 0 THEN 0.1 * length(text) ELSE 0 END)::DOUBLE AS cost FROM conversations GROUP BY 1")
def l21_run_cost(spark, sf_dir):
    """What a run cost, by weights of what it read, wrote and read again."""
    n = F.length("text")
    part = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 5).otherwise(2) * n + F.when(F.col("turn") > 0, 0.1 * n).otherwise(0.0)
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum(part).alias("cost"))


@query(_E + """, r AS (SELECT k AS skill, min(secs) AS started, max(secs) AS last_at, count(*) FILTER (event_type = 'click') AS invoked FROM e WHERE k IS NOT NULL GROUP BY 1), m AS (SELECT max(secs) AS now FROM e) SELECT skill, invoked, CASE WHEN now - started < 5184000 THEN 'trial' WHEN invoked >= 5 THEN 'approve' ELSE 'retire' END AS decision FROM r, m""")
def l25_skill_triage(spark, sf_dir):
    """Drafts after sixty days: used ones are approved, the others go."""
    e = events(spark, sf_dir)
    r = e.where("k is not null").groupBy(F.col("k").alias("skill")).agg(F.min("at").alias("started"), F.count_if(F.col("event_type") == "click").alias("invoked")).crossJoin(F.broadcast(e.agg(F.max("at").alias("now"))))  # a single row
    return r.select("skill", "invoked", F.when(F.col("now") - F.col("started") < 5_184_000, "trial").when(F.col("invoked") >= 5, "approve").otherwise("retire").alias("decision"))


@query("WITH c AS (SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')), n AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM c) SELECT user_id, count(*) FILTER (event_type = 'error') AS noted, count(*) FILTER (event_type = 'error' AND next = 'purchase') AS resolved, count(*) FILTER (event_type = 'error' AND next IS DISTINCT FROM 'purchase') AS open FROM n GROUP BY 1")
def l28_m19_challenges(spark, sf_dir):
    """Challenges noted, resolved by what came next, and still open."""
    c = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    n = c.withColumn("next", F.lead("event_type").over(W.partitionBy("user_id").orderBy("event_id")))
    noted, solved = F.col("event_type") == "error", F.coalesce(F.col("next") == "purchase", F.lit(False))
    return n.groupBy("user_id").agg(F.count_if(noted).alias("noted"), F.count_if(noted & solved).alias("resolved"), F.count_if(noted & ~solved).alias("open"))


@query(stores_sql("walls") + """ SELECT area, count(*) FILTER (status = 'open') AS due, count(*) FILTER (status = 'Broken') AS moved, count(*) FILTER (status = 'held') AS held, max(evidence_date) FILTER (evidence_kind = 'Benchmark' OR (evidence_kind IN ('vendor docs', 'paper') AND evidence_date <> '')) AS newest_fact FROM walls GROUP BY 1""")
def l30_m22_walls_due(spark, sf_dir):
    """Limits by area: those to visit again, what became of the others, and the newest fact."""
    state, kind = P.alias(F.col("status"), P.STATUS), P.alias(F.col("evidence_kind"), P.EVIDENCE)
    fact = (kind == "measured") | (kind.isin("vendor-doc", "paper") & (F.col("evidence_date") != ""))
    w = store(spark, sf_dir, "walls").groupBy("area")
    return w.agg(F.count_if(state == "open").alias("due"), F.count_if(state == "moved").alias("moved"), F.count_if(state == "holds").alias("held"), F.max(F.when(fact, F.col("evidence_date"))).alias("newest_fact"))


# supporting operators


@query("SELECT o_orderkey AS id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS latest FROM orders")
def m03_numbering(spark, sf_dir):
    """Records numbered in order of creation within their project."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.row_number().over(w).cast("long").alias("number"), F.max("o_orderkey").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("latest"))


@query(_E + " SELECT user_id, min(secs) FILTER (event_type = 'purchase') AS handled_at, count(*) FILTER (event_type = 'error' AND k % 2 = 0) AS fired, bool_or(k = 7) AS warned FROM e GROUP BY 1")
def m04_m05_marks(spark, sf_dir):
    """The first time that something was handled stays; what fired and whether there was a warning."""
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("at"))).alias("handled_at"), F.count_if((F.col("event_type") == "error") & (F.col("k") % 2 == 0)).alias("fired"), F.bool_or(F.col("k") == 7).alias("warned"))


@query("WITH a AS (SELECT user_id AS obs, event_id, CASE event_type WHEN 'signup' THEN 'recorded' WHEN 'purchase' THEN 'crystallised' WHEN 'error' THEN 'dismissed' END AS s FROM events), l AS (SELECT obs, arg_max(s, event_id) FILTER (s IS NOT NULL) AS status, count(s) AS acts FROM a GROUP BY 1) SELECT * FROM l WHERE status IS NOT NULL")
def m07_m16_observations(spark, sf_dir):
    """The status of each observation by the last act on it."""
    t = F.col("event_type")
    s = F.when(t == "signup", "recorded").when(t == "purchase", "crystallised").when(t == "error", "dismissed")
    a = read(spark, sf_dir, "events").select(F.col("user_id").alias("obs"), "event_id", s.alias("s")).where("s is not null")
    return a.groupBy("obs").agg(F.max_by("s", "event_id").alias("status"), F.count("s").alias("acts"))


@query("""WITH m AS (SELECT doc_id, lang AS kind, lower(substring(trim(coalesce(text, '')), 1, 40)) AS key, n_chars FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY doc_id) AS n FROM m)
    SELECT doc_id, CASE WHEN key = '' THEN 'placeholder' WHEN n > 1 THEN 'known' WHEN n_chars < 20 THEN 'too short' ELSE 'committed' END AS result FROM f""")
def m12_s19_commits(spark, sf_dir):
    """Markers are committed once by the key of their kind; the others say why not."""
    key = F.lower(F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 40))
    m = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", key.alias("key"))
    n = F.row_number().over(W.partitionBy("lang", "key").orderBy("doc_id"))
    return m.select("doc_id", F.when(F.col("key") == "", "placeholder").when(n > 1, "known").when(F.col("n_chars") < 20, "too short").otherwise("committed").alias("result"))


@query(_E + """, t AS (SELECT sess, event_type, min(event_id) AS f FROM e GROUP BY 1, 2), m AS (SELECT sess, count(*) AS markers, count(*) FILTER (event_type = 'error') AS traps FROM e GROUP BY 1)
    SELECT m.sess, markers, traps, (SELECT string_agg(event_type, ',' ORDER BY f) FROM t WHERE t.sess = m.sess) AS tools FROM m""")
def m13_s08_session_snapshot(spark, sf_dir):
    """A session's markers by type with its tools in order of first use: both from one pass by session."""
    t = events(spark, sf_dir).groupBy("sess", "event_type").agg(F.min("event_id").alias("f"), F.count("*").alias("n"))
    tools = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",")  # kinds are few
    return t.groupBy("sess").agg(F.sum("n").alias("markers"), F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)).alias("traps"), tools.alias("tools"))


@query(_E + """, m AS (SELECT max(secs) AS now FROM e), r AS (SELECT DISTINCT sha256(props) AS h FROM e, m WHERE event_type = 'error' AND now - secs <= 2592000) SELECT event_id, EXISTS (SELECT 1 FROM r WHERE h = sha256(e.props)) AS rejected FROM e, m WHERE event_type = 'click' AND now - secs <= 7776000""")
def m14_recent_rejections(spark, sf_dir):
    """Whether the same content was rejected in the last thirty days; rows of more than ninety days are gone."""
    e = events(spark, sf_dir)
    e = e.crossJoin(F.broadcast(e.agg(F.max("at").alias("now")))).withColumns({"age": F.col("now") - F.col("at"), "h": F.sha2("props", 256)})  # a single row
    r = e.where("event_type = 'error' and age <= 2592000").select("h").distinct().withColumn("hit", F.lit(True))
    return e.where("event_type = 'click' and age <= 7776000").join(r, "h", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("rejected"))


@query("""WITH p AS (SELECT doc_id AS a, (doc_id * 7 + 3) % 50 AS b FROM labels UNION ALL SELECT (doc_id * 7 + 3) % 50, doc_id FROM labels WHERE doc_id % 3 = 0) SELECT least(a, b) AS low, greatest(a, b) AS high, count(*) AS said FROM p WHERE a <> b GROUP BY 1, 2""")
def m20_pair_exists(spark, sf_dir):
    """Pairs by a key that doesn't tell which side is which."""
    l = read(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") * 7 + 3) % 50).alias("other"))  # noqa: E741
    p = l.union(l.where("doc_id % 3 = 0").select("other", "doc_id")).where("doc_id <> other")
    return p.groupBy(F.least("doc_id", "other").alias("low"), F.greatest("doc_id", "other").alias("high")).agg(F.count("*").alias("said"))


@query(stores_sql("units") + """, h(id, hint) AS (VALUES (1, 'work on SmallRing1 and RedBolt2'), (2, 'nothing'), (3, 'LargeGear7?')), w AS (SELECT id AS hint_id, unnest(list_distinct(regexp_extract_all(hint, '[A-Za-z0-9_]+'))) AS name FROM h), n AS (SELECT name, min(id) AS id, arg_min(summary, id) AS summary FROM units GROUP BY 1)
    SELECT h.id, h.hint || coalesce(chr(10) || string_agg(n.name || ': ' || n.summary, chr(10) ORDER BY n.name), '') AS augmented FROM h LEFT JOIN w ON w.hint_id = h.id LEFT JOIN n USING (name) GROUP BY h.id, h.hint""")
def m28_augmented_hints(spark, sf_dir):
    """Hints with the summaries of the units that they name."""
    h = spark.createDataFrame([(1, "work on SmallRing1 and RedBolt2"), (2, "nothing"), (3, "LargeGear7?")], "id int, hint string")
    n = store(spark, sf_dir, "units").groupBy("name").agg(F.min_by("summary", "id").alias("summary"))
    w = h.select("id", "hint", F.explode_outer(F.array_distinct(F.regexp_extract_all("hint", F.lit("[A-Za-z0-9_]+"), 0))).alias("name")).join(n, "name", "left")
    line = F.array_sort(F.collect_list(F.when(F.col("summary").isNotNull(), F.concat_ws(": ", "name", "summary"))))  # names of one hint
    return w.groupBy("id", "hint").agg(line.alias("l")).select("id", F.concat_ws("\n", F.array("hint"), "l").alias("augmented"))


@query(_E + """, m AS (SELECT max(secs) AS now FROM e), s AS (SELECT event_type, max(secs) AS last_at FROM e GROUP BY 1), d(event_type, days) AS (VALUES ('error', 7), ('refund', 3), ('view', 0)) SELECT d.event_type, CASE WHEN last_at IS NULL THEN 'never seen' ELSE 'silent for ' || ((now - last_at) // 86400) || ' days' END AS problem FROM d CROSS JOIN m LEFT JOIN s USING (event_type) WHERE last_at IS NULL OR now - last_at > days * 86400""")
def m30_x16_problems(spark, sf_dir):
    """Mechanisms that aren't live, with what is wrong."""
    e = events(spark, sf_dir)
    d = spark.createDataFrame([("error", 7), ("refund", 3), ("view", 0)], "event_type string, days int")
    both = d.join(e.groupBy("event_type").agg(F.max("at").alias("last_at")), "event_type", "left").crossJoin(F.broadcast(e.agg(F.max("at").alias("now"))))  # a single row
    gone = F.col("now") - F.col("last_at")
    return both.where(F.col("last_at").isNull() | (gone > F.col("days") * 86_400)).select("event_type", F.when(F.col("last_at").isNull(), "never seen").otherwise(F.format_string("silent for %d days", F.floor(gone / 86_400))).alias("problem"))


@query(_E + """, p AS (SELECT event_id, user_id, secs, row_number() OVER (PARTITION BY user_id ORDER BY secs DESC, event_id DESC) AS n FROM e, (SELECT max(secs) AS now FROM e) WHERE event_type = 'click' AND now - secs <= 21600 AND k % 3 <> 0) SELECT event_id, user_id FROM p WHERE n <= 2""")
def x14_pending_notices(spark, sf_dir):
    """What opened in the last six hours and wasn't told yet, two at most."""
    e = events(spark, sf_dir)
    p = e.crossJoin(F.broadcast(e.agg(F.max("at").alias("now")))).where("event_type = 'click' and now - at <= 21600 and k % 3 <> 0")  # a single row
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id")))
    return p.withColumn("n", n).where("n <= 2").select("event_id", "user_id")


@query("SELECT lang, count(*) AS items, count(*) FILTER (quality IS NOT NULL) AS documented, round(avg((quality IS NOT NULL)::INT), 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def s23_coverage_report(spark, sf_dir):
    """How much of each kind is documented."""
    l = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.first("quality").alias("quality"))  # noqa: E741
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(l, "doc_id", "left")
    has = F.col("quality").isNotNull()
    return d.groupBy("lang").agg(F.count("*").alias("items"), F.count_if(has).alias("documented"), F.round(F.avg(has.cast("int")), 6).alias("share"))


@query(stores_sql("units") + """ SELECT 'path', count(*) AS n FROM units WHERE false UNION ALL SELECT module, count(*) FROM units u WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT module AS m FROM units WHERE kind = 'trait') t WHERE t.m = u.module) GROUP BY 1""".replace("SELECT 'path', count(*) AS n FROM units WHERE false UNION ALL SELECT module, count(*) FROM", "SELECT module, count(*) AS n FROM"))
def s13_s14_undeclared(spark, sf_dir):
    """Projects on disk that no manifest names."""
    u = store(spark, sf_dir, "units")
    declared = u.where("kind = 'trait'").select("module").distinct()
    return u.join(declared, "module", "left_anti").groupBy("module").agg(F.count("*").alias("n"))
