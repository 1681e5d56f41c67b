"""Queries of markers, code search, classifications and the last supporting operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import commands as C
from sparkloom.functions import disputes as D
from sparkloom.functions import markers as M
from sparkloom.functions import prose as P
from sparkloom.operators import lookup as L
from sparkloom.operators import retrieval as S
from sparkloom.plans.catalog import _E, query
from sparkloom.plans.stores import store, stores_sql
from sparkloom.sources.tables import events, read


@query("""WITH c AS (SELECT conv_id, turn, conv_id * 100 + turn AS id FROM conversations), m AS (SELECT conv_id, turn, 'pattern' AS kind, 'keep "it" ' || id AS key, 'body ' || id AS body FROM c UNION ALL SELECT conv_id, turn, 'trap', 'breaks', 'wrong' || chr(10) || 'way' FROM c WHERE id % 2 = 0 UNION ALL SELECT conv_id, turn, 'note', 'a note', 'a note' FROM c WHERE id % 3 = 0)
    SELECT conv_id, turn, kind, key, body FROM m""")
def f16_f20_m11_m31_markers(spark, sf_dir):
    """Markers of texts: escaped attributes, wrong closing tags, examples in fences and placeholders."""
    id_ = F.col("conv_id") * 100 + F.col("turn")
    text = F.concat(
        F.lit('before [KB-PATTERN name="keep \\"it\\" '), id_.cast("string"), F.lit('" uses="x"] body '), id_.cast("string"), F.lit(" [/KB-TRAP]\n```\n[KB-ADR title=\"example\"]x[/KB-ADR]\n```\n"),
        F.when(id_ % 2 == 0, '[KB-TRAP description="breaks"]wrong\nway[/KB-TRAP]').otherwise('[KB-TRAP description="<description>"]x[/KB-TRAP]'),
        F.when(id_ % 3 == 0, " [KB-NOTE]a note[/KB-NOTE]").otherwise(" [KB-NOTE]...[/KB-NOTE] [KB-OTHER]x[/KB-OTHER]"),
    )
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(M.parse(text)).alias("m"))
    return c.select("conv_id", "turn", "m.kind", "m.key", "m.body")


_PROJECTS = (("ledger", ("bank_", "invoice")), ("garden", ("small", "blue")), ("forge", ("ring", "bolt")))


@query(stores_sql("units") + """ SELECT coalesce(CASE WHEN contains(t, 'bank_') OR contains(t, 'invoice') THEN 'ledger' WHEN contains(t, 'small') OR contains(t, 'blue') THEN 'garden' WHEN contains(t, 'ring') OR contains(t, 'bolt') THEN 'forge' END, 'none') AS project, count(*) AS n FROM (SELECT lower(name || ' ' || summary) AS t FROM units) GROUP BY 1""")
def f19_projects(spark, sf_dir):
    """The first project whose words an entry has."""
    text = F.lower(F.concat_ws(" ", "name", "summary"))
    rule = F.coalesce(*[F.when(F.greatest(*[F.contains(text, F.lit(w)) for w in words]), project) for project, words in _PROJECTS], F.lit("none"))
    return store(spark, sf_dir, "units").groupBy(rule.alias("project")).agg(F.count("*").alias("n"))


_SIGS = ("fn new(x: i32) -> Self", "fn with(mut self, n: u8) -> Self", "fn get(&self) -> &str", "fn edit(&mut self) -> &mut Self", "fn find(&self) -> Option<Item>", "fn run(&self)")


@query(stores_sql("units") + """, s AS (SELECT id, ['fn new(x: i32) -> Self', 'fn with(mut self, n: u8) -> Self', 'fn get(&self) -> &str', 'fn edit(&mut self) -> &mut Self', 'fn find(&self) -> Option<Item>', 'fn run(&self)'][id % 6 + 1] AS sig FROM units)
    SELECT id, CASE id % 6 WHEN 1 THEN 'builder' WHEN 3 THEN 'builder' WHEN 0 THEN 'constructor' ELSE 'other' END AS role, CASE id % 6 WHEN 2 THEN 'borrow' WHEN 3 THEN 'borrow' WHEN 5 THEN 'nothing' ELSE 'owned' END AS returns FROM s""")
def f26_r28_signatures(spark, sf_dir):
    """Builders, constructors, and what a method gives back, by its signature."""
    sig = F.element_at(F.array(*map(F.lit, _SIGS)), (F.col("id") % 6 + 1).cast("int"))
    out, takes_self = F.regexp_extract(sig, r"->\s*(.*)$", 1), sig.rlike(r"\((&?\s*(mut\s+)?)?self")
    own = out.rlike(r"^(&mut\s+)?Self$")
    role = F.when(own & takes_self, "builder").when(own, "constructor").otherwise("other")
    returns = F.when(out == "", "nothing").when(out.startswith("&"), "borrow").otherwise("owned")
    return store(spark, sf_dir, "units").select("id", role.alias("role"), returns.alias("returns"))


@query(r"""WITH l AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'retry 17 of 250 at /srv/app/x.log' WHEN 1 THEN 'https://h.example/a?b=1 took 3.5s' ELSE 'plain' END AS line FROM conversations)
    SELECT regexp_replace(regexp_replace(regexp_replace(line, 'https?://\S+', '<url>', 'g'), '(^|\s)/\S+', '\1<path>', 'g'), '[0-9]+', '#', 'g') AS shape, count(*) AS n FROM l GROUP BY 1""")
def f31_masks(spark, sf_dir):
    """Lines by their shape: addresses, paths and numbers are masked."""
    t = F.col("turn") % 3
    line = F.when(t == 0, "retry 17 of 250 at /srv/app/x.log").when(t == 1, "https://h.example/a?b=1 took 3.5s").otherwise("plain")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"https?://\S+", "<url>"), r"(^|\s)/\S+", "$1<path>"), "[0-9]+", "#")
    return read(spark, sf_dir, "conversations").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


@query(stores_sql("calls") + r""" SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(output), '[^\p{L}\p{N}_]+'), lambda t: strlen(t) >= 4 AND NOT regexp_matches(t, '^[0-9]+$')))), ' ') AS tokens, list_filter(string_split(regexp_replace(output, '\s+', ' ', 'g'), ' '), lambda w: regexp_matches(w, '^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.:-]+)+$'))[1] AS path FROM calls""")
def f10_failure_tokens(spark, sf_dir):
    """Words of a failure that can be looked up, and the first path in it."""
    words = F.filter(F.split(F.lower("output"), r"[^\p{L}\p{N}_]+"), lambda t: (F.octet_length(t) >= 4) & ~t.rlike("^[0-9]+$"))
    paths = F.filter(F.split(F.regexp_replace("output", r"\s+", " "), " "), lambda w: w.rlike(r"^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.:-]+)+$"))
    return store(spark, sf_dir, "calls").select("id", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("tokens"), F.get(paths, F.lit(0)).alias("path"))


@query(r"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS l FROM benchmark),
    s AS (SELECT item_id, list_sum(list_transform(['than', 'thes', 'tion', 'reing', 'therbl', 'heou'], lambda t: (list_contains(l, t) OR (strlen(t) >= 6 AND len(list_filter(l, lambda x: starts_with(x, t))) > 0))::INT))::INT AS score FROM w)
    SELECT item_id, score, score >= 2 AS expanded FROM s WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, item_id) <= 12""")
def r03_r14_hint_expansion(spark, sf_dir):
    """Entries by how many different words of a hint they have; two make an entry be shown whole, and twelve are shown."""
    hint = ["than", "thes", "tion", "reing", "therbl", "heou"]
    b = read(spark, sf_dir, "benchmark").select("item_id", S.hint_score(F.col("text"), hint).alias("score")).where("score > 0")
    return b.withColumn("expanded", F.col("score") >= S.expand_threshold(hint)).orderBy(F.desc("score"), "item_id").limit(12)


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: strlen(t) >= 4 AND t NOT IN (" + ", ".join(f"'{w}'" for w in P.HINT_STOP) + ")))), ' ') AS hint, len(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_:.]*'), lambda t: length(t) >= 3 AND t NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in P.SIMILARITY_STOP) + "))) AS similar_words FROM benchmark")
def r02_r03_tokenisers(spark, sf_dir):
    """What two of the tokenisers make of a text."""
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(P.hint_tokens(F.col("text")), " ").alias("hint"), F.size(P.similarity_tokens(F.col("text"))).cast("long").alias("similar_words"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::BIGINT AS i FROM documents), h AS (SELECT *, regexp_matches(line, '(?i)\\bthat\\b') AS word, contains(line, 'the.') AS fixed FROM l),
    n AS (SELECT *, bool_or(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h)
    SELECT doc_id, count(*) FILTER (word) AS words, count(*) FILTER (fixed) AS fixed, count(*) FILTER (near) AS shown, min(i) FILTER (word) AS first_line FROM n GROUP BY 1 HAVING count(*) FILTER (word OR fixed) > 0""")
def r25_search_modes(spark, sf_dir):
    """Lines with a word or a fixed text, with a line of context on each side; by file: counts and first places. Worked out inside each row."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    d = read(spark, sf_dir, "documents").select("doc_id", F.transform(lines, lambda x: x.rlike(r"(?i)\bthat\b")).alias("w"), F.size(F.filter(lines, lambda x: F.contains(x, F.lit("the.")))).cast("long").alias("fixed"))
    at = lambda i: F.coalesce(F.get("w", i), F.lit(False))
    near = F.size(F.filter(F.transform("w", lambda x, i: at(i - 1) | x | at(i + 1)), lambda x: x))
    words = F.size(F.filter("w", lambda x: x)).cast("long")
    first = F.array_position("w", True)
    return d.select("doc_id", words.alias("words"), "fixed", near.cast("long").alias("shown"), F.when(first > 0, first).alias("first_line")).where("words > 0 or fixed > 0")


@query(stores_sql("units") + """, l AS (SELECT id, path, unnest(string_split(body, chr(10))) AS line FROM units), t AS (SELECT id, path, starts_with(line, 'docs:') AS comment, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))) AS ident FROM l)
    SELECT ident, count(*) FILTER (NOT comment) AS code_lines, count(*) FILTER (comment) AS comment_lines, count(DISTINCT path) AS files FROM t WHERE ident IN ('Show', 'Facet', 'SmallRing3', 'count', 'nothing') GROUP BY 1""")
def r26_references(spark, sf_dir):
    """Uses of names, in code and in comments."""
    l = store(spark, sf_dir, "units").select("id", "path", F.explode(F.split("body", "\n")).alias("line"))  # noqa: E741
    t = l.select("id", "path", F.col("line").startswith("docs:").alias("comment"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0))).alias("ident"))
    wanted = t.where(F.col("ident").isin("Show", "Facet", "SmallRing3", "count", "nothing"))
    return wanted.groupBy("ident").agg(F.count_if(~F.col("comment")).alias("code_lines"), F.count_if("comment").alias("comment_lines"), F.count_distinct("path").alias("files"))


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) SELECT doc_id, array_to_string(ls[2:4], chr(10)) AS lines, len(ls) AS total, array_to_string(list_transform(list_filter(ls, lambda x: length(x) > 80), lambda x: substring(x, 1, 20)), ' | ') AS outline FROM l""")
def r27_line_ranges(spark, sf_dir):
    """Lines two to four of a text, and its outline: how its long lines begin."""
    ls = F.split(F.coalesce("text", F.lit("")), "\n")
    outline = F.array_join(F.transform(F.filter(ls, lambda x: F.length(x) > 80), lambda x: F.substring(x, 1, 20)), " | ")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(ls, 2, 3), "\n").alias("lines"), F.size(ls).cast("long").alias("total"), outline.alias("outline"))


@query(stores_sql("units") + """, q(q) AS (VALUES ('SmallRing3'), ('smallring4'), ('RING5'), ('ing6')), m AS (SELECT q, u.id, CASE WHEN u.name = q THEN 0 WHEN lower(u.name) = lower(q) THEN 1 WHEN lower(u.name) LIKE '%' || lower(q) AND length(q) = 5 THEN 2 END AS tier FROM units u, q)
    SELECT q, id, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, id) AS place FROM m WHERE tier IS NOT NULL) WHERE place <= 4""")
def p03_suffix_tiers(spark, sf_dir):
    """Names by exact match, in any case, and by their end: ends of one length meet in an equi-join."""
    u = store(spark, sf_dir, "units").select("id", "name")
    q = spark.createDataFrame([("SmallRing3",), ("smallring4",), ("RING5",), ("ing6",)], "q string")
    end = lambda c: F.lower(F.substring(c, -5, 5))
    keys = [("0", F.col("q"), F.col("name")), ("1", F.lower("q"), F.lower("name")), ("2", F.when(F.length("q") == 5, F.lower("q")), end("name"))]
    return L.cascade(q, "q", u, keys, "id", [F.col("id")], 4).select("q", "id", F.col("tier").cast("int").alias("tier"), F.col("place").cast("long").alias("place"))


@query(_E + """, d AS (SELECT k, count(*) AS boost FROM e WHERE event_type = 'error' AND k IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT k, count(*) AS pending FROM e WHERE event_type = 'click' AND k IS NOT NULL GROUP BY 1) SELECT d.k, boost, coalesce(pending, 0) AS pending FROM d LEFT JOIN p USING (k) WHERE coalesce(pending, 0) <= (SELECT max(pending) FROM p) ORDER BY boost DESC, d.k LIMIT 10""")
def l09_drift_digest(spark, sf_dir):
    """What drifted most: boosts of two and more, the first ten."""
    e = events(spark, sf_dir).where("k is not null")
    n = e.groupBy("k").agg(F.count_if(F.col("event_type") == "error").alias("boost"), F.count_if(F.col("event_type") == "click").alias("pending"))
    return n.where("boost >= 2").orderBy(F.desc("boost"), "k").limit(10)


@query(stores_sql("calls", "entries", "walls", "gaps") + f""" SELECT 'calls' AS part, count(*) AS n, max(id) AS last_id FROM calls UNION ALL SELECT 'builds', count(*) FILTER ({" OR ".join(f"contains(lower(command), '{n}')" for n in C.BUILD_OR_TEST)}), max(id) FROM calls
    UNION ALL SELECT 'entries', count(*), max(id) FROM entries UNION ALL SELECT 'retired', count(*) FILTER (superseded_by IS NOT NULL), max(id) FROM entries UNION ALL SELECT 'walls', count(*), max(id) FROM walls UNION ALL SELECT 'gaps', count(*), max(id) FROM gaps""")
def l08_l22_l26_digest(spark, sf_dir):
    """A digest of a run: what each store holds and its last id; every store is read once."""
    calls, e = store(spark, sf_dir, "calls"), store(spark, sf_dir, "entries")
    row = lambda df, *parts: df.agg(F.max("id").alias("last_id"), F.array(*[F.struct(F.lit(p).alias("part"), n.alias("n")) for p, n in parts]).alias("r")).select(F.explode("r").alias("r"), "last_id").select("r.part", "r.n", "last_id")
    out = row(calls, ("calls", F.count("*")), ("builds", F.count_if(C.is_build_or_test(F.col("command")))))
    out = out.union(row(e, ("entries", F.count("*")), ("retired", F.count_if(F.col("superseded_by").isNotNull()))))
    return out.union(row(store(spark, sf_dir, "walls"), ("walls", F.count("*")))).union(row(store(spark, sf_dir, "gaps"), ("gaps", F.count("*"))))


@query(_E + """, s AS (SELECT user_id, bool_or(event_type = 'view') AS started, bool_or(event_type = 'click') AS planned, count(*) FILTER (event_type IN ('purchase', 'error')) AS work FROM e GROUP BY 1) SELECT user_id, started AND planned AS complete, CASE WHEN started AND planned THEN 'open' WHEN work > 0 THEN 'blocked' ELSE 'idle' END AS gate, (SELECT max(event_id) FROM e) AS generation FROM s""")
def x13_x15_m32_protocol(spark, sf_dir):
    """Steps of a session add up to a complete start, which opens the gate for work; with the store's generation."""
    e = read(spark, sf_dir, "events")
    has = lambda t: F.bool_or(F.col("event_type") == t)
    s = e.groupBy("user_id").agg((has("view") & has("click")).alias("complete"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("work"))
    gate = F.when(F.col("complete"), "open").when(F.col("work") > 0, "blocked").otherwise("idle")
    return s.crossJoin(F.broadcast(e.agg(F.max("event_id").alias("generation")))).select("user_id", "complete", gate.alias("gate"), "generation")  # a single row


@query("""WITH q(cue) AS (VALUES ('thand'), ('ering'), ('que ')), p AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, turn % 4 = 0 AS label FROM conversations) SELECT cue, count(*) FILTER (contains(t, cue) AND label) AS fixed, count(*) FILTER (contains(t, cue) AND NOT label) AS broke, count(*) FILTER (NOT contains(t, cue) AND label) AS missed FROM p CROSS JOIN q GROUP BY 1""")
def m21_cue_scores(spark, sf_dir):
    """What proposed cues would have fixed, broken and missed; a fixed list of cues, worked out inside one aggregation."""
    t, label = F.lower(F.coalesce("text", F.lit(""))), F.col("turn") % 4 == 0
    parts = []
    for cue in ("thand", "ering", "que "):
        hit = F.contains(t, F.lit(cue))
        parts.append(F.struct(F.lit(cue).alias("cue"), F.count_if(hit & label).alias("fixed"), F.count_if(hit & ~label).alias("broke"), F.count_if(~hit & label).alias("missed")))
    return read(spark, sf_dir, "conversations").agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query(_E + """, r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM e), c(event_type, most) AS (VALUES ('view', 12), ('click', 3), ('error', 4), ('signup', 2)) SELECT user_id, event_type, count(*) AS served FROM r JOIN c USING (event_type) WHERE n <= most GROUP BY 1, 2""")
def w19_serving_caps(spark, sf_dir):
    """Patterns, lines, pushes and notices of a session, each kind under its own limit."""
    caps = F.create_map(*[F.lit(x) for kv in (("view", 12), ("click", 3), ("error", 4), ("signup", 2)) for x in kv])[F.col("event_type")]
    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.where(caps.isNotNull()).select("user_id", "event_type", F.least("n", caps.cast("long")).alias("served"))


@query(stores_sql("calls") + """, t AS (SELECT sess, tool, min(id) AS f FROM calls GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY sess ORDER BY f) AS place FROM t) SELECT sess, string_agg(tool, '>' ORDER BY place) AS tools, string_agg(DISTINCT CASE WHEN contains(tool, '__') THEN split_part(tool, '__', 1) ELSE 'host' END, ',' ORDER BY CASE WHEN contains(tool, '__') THEN split_part(tool, '__', 1) ELSE 'host' END) AS tags FROM p WHERE place <= 30 GROUP BY 1""")
def m09_m10_traces(spark, sf_dir):
    """A session's first thirty tools in order of first use, with the domains that they belong to."""
    t = store(spark, sf_dir, "calls").groupBy("sess", "tool").agg(F.min("id").alias("f"))
    p = t.withColumn("place", F.row_number().over(W.partitionBy("sess").orderBy("f"))).where("place <= 30")
    domain = F.when(F.contains("tool", F.lit("__")), F.split("tool", "__")[0]).otherwise("host")
    g = p.groupBy("sess").agg(F.array_sort(F.collect_list(F.struct("place", "tool"))).alias("t"), F.array_sort(F.collect_set(domain)).alias("d"))  # thirty at most
    return g.select("sess", F.array_join(F.transform("t", lambda x: x["tool"]), ">").alias("tools"), F.array_join("d", ",").alias("tags"))


@query(stores_sql("entries") + """ SELECT CASE WHEN s < 0.4 THEN 'low' WHEN s < 0.8 THEN 'fair' ELSE 'good' END AS health, count(*) AS n FROM (SELECT CASE WHEN used = 0 THEN CASE WHEN reverted > 0 THEN 0.0 ELSE 1.0 END ELSE greatest(0, (used - reverted) / used) END AS s FROM entries WHERE superseded_by IS NULL) GROUP BY 1""")
def m08_l06_pattern_health(spark, sf_dir):
    """Live entries by the health of their survival; a report only, nothing is proposed from it."""
    use, back = F.col("used"), F.col("reverted")
    s = F.when(use == 0, F.when(back > 0, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), (use - back) / use))
    health = F.when(s < 0.4, "low").when(s < 0.8, "fair").otherwise("good")
    return store(spark, sf_dir, "entries").where("superseded_by is null").groupBy(health.alias("health")).agg(F.count("*").alias("n"))


def _listed(cues):
    return "[" + ", ".join("{'c': '" + c.replace("'", "''") + "', 'l': '" + l + "'}" for c, l in cues) + "]"


_ALL = [c for c, _ in (*D.EMPHASIS, *D.LIMIT_CUES, *D.CUES)]
_PROMPTS = [f"Well{c if c[0] in ' ,' else ' ' + c} now {'is it possible' if i % 3 == 0 else 'then'}" for i, c in enumerate(_ALL)] + ["Please add a test", ""]


@query(f"""WITH p AS (SELECT event_id, [{', '.join("'" + t.replace("'", "''") + "'" for t in _PROMPTS)}][event_id % {len(_PROMPTS)} + 1] AS t FROM events), l AS (SELECT *, lower(t) AS w FROM p),
    f AS (SELECT *, list_filter({_listed(D.EMPHASIS)}, lambda x: contains(t, x.c))[1].l AS e, list_filter({_listed(D.LIMIT_CUES)}, lambda x: contains(w, x.c))[1].l AS m, list_filter({_listed(D.CUES)}, lambda x: contains(w, x.c))[1].l AS c,
        list_has_any(regexp_split_to_array(w, '[^\\p{{L}}\\p{{N}}'']+'), [{', '.join(f"'{x}'" for x in D.LIMIT_WORDS)}]) OR {' OR '.join("contains(w, '" + x.replace("'", "''") + "')" for x in D.LIMIT_PHRASES)} AS lim FROM l)
    SELECT event_id, coalesce(e, m, CASE WHEN c IS NOT NULL AND lim THEN 'disputes a limit' ELSE c END) AS label FROM f""")
def f18_disputes(spark, sf_dir):
    """Messages that dispute a claim or a limit, with the label of the first cue."""
    t = F.element_at(F.array(*map(F.lit, _PROMPTS)), (F.col("event_id") % len(_PROMPTS) + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", D.dispute(F.col("t")).alias("label"))
