"""Text functions on text of the given tables: addresses, turns and documents, with names and numbers of their own; the SQL works the answers out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import boundaries as B
from sparkloom.functions import markers as M
from sparkloom.functions import prose as P
from sparkloom.functions import text as X
from sparkloom.plans.catalog import query
from sparkloom.sources.tables import read


def _sql(spark, sf_dir, table: str, select: str) -> DataFrame:
    """A projection that both engines can run, of a whole table."""
    read(spark, sf_dir, table).createOrReplaceTempView(f"_{table}_of_queries")
    return spark.sql(f"SELECT {select} FROM _{table}_of_queries")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# boundaries between languages

_OWN = "regexp_replace(coalesce(url, ''), '^[a-z]+://[^/]*', '')"
#: Half of the lines have a page's own path, half one of a few paths that both sides name.
_PATH = f"CASE WHEN page_id % 2 = 0 THEN {_OWN} ELSE '/' || split_part({_OWN}, '/', 2) || '/' || CAST(page_id % 3 AS VARCHAR(9)) END"
_HOST = "CASE WHEN page_id % 2 = 0 THEN regexp_extract(coalesce(url, ''), '^([a-z]+://[^/]*)', 1) ELSE 'https://other.example:8080' END"
_TAIL = "CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '/{id}' WHEN 2 THEN '/:id/Items' WHEN 3 THEN '/<int:x>' WHEN 4 THEN '/*' WHEN 5 THEN '/$' || 'v' ELSE '/a+b' END"
_METHOD = "CASE page_id % 5 WHEN 0 THEN 'get' WHEN 1 THEN 'post' WHEN 2 THEN 'put' WHEN 3 THEN 'delete' ELSE 'patch' END"
_UPPER = "upper(substring(m, 1, 1)) || substring(m, 2)"
_SHAPES = [
    "'@app.' || m || '(\"' || p || '\")'", "'@bp.route(''' || p || ''')'", "'  .route(\"' || p || '\", ' || m || '(show))'", "'#[' || m || '(\"' || p || '\")]'", "'router.' || m || '(`' || p || '`, h)'", "'mux.HandleFunc(\"' || p || '\", ok)'",
    f"'@' || {_UPPER} || 'Mapping(value = \"' || p || '\")'", f"'[Http' || {_UPPER} || '(\"' || p || '\")]'", "'fetch(`' || u || '`)'", "'axios.' || m || '(\"' || u || '\", body)'", "'requests.' || m || '(\"' || u || '\")'", "'new WebSocket(\"' || u || '\")'",
    "'pub extern \"C\" fn solve_' || replace(replace(p, '/', '_'), '?', '_') || '(x: i32)'", "'import { solve' || CAST(page_id % 50 AS VARCHAR(9)) || ', init_all } from \"./ik_wasm.js\"'", "'let path = \"' || p || '\";'", "'app.use(' || m || ')'",
]
_LINE = "CASE CAST(floor(page_id / 3) AS BIGINT) % 16 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END"
_LINES = f"SELECT page_id AS id, {_LINE} AS text FROM (SELECT page_id, {_PATH} || {_TAIL} AS p, {_HOST} || {_PATH} || {_TAIL} AS u, {_METHOD} AS m FROM TABLE_) s"
_RULE = " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN {{'kind': 'http', 'side': '{side}', 'method': {f'lower(regexp_extract(text, {_q(p)}, {m}))' if m else _q('any')}, 'raw': regexp_extract(text, {_q(p)}, {g})}}" for p, m, g, side in B.RULES)
_HALVES = f"""l AS ({_LINES.replace("TABLE_", "pages")}), r AS (SELECT id, CASE {_RULE} END AS h FROM l),
    f AS (SELECT id, h.kind AS kind, h.side AS side, h.method AS method, h.raw AS raw FROM r WHERE h IS NOT NULL UNION ALL SELECT id, 'ffi', 'provide', 'call', regexp_extract(text, {_q(B.EXPORT)}, 1) FROM l WHERE regexp_matches(text, {_q(B.EXPORT)})
        UNION ALL SELECT id, 'ffi', 'consume', 'call', trim(unnest(string_split(regexp_extract(text, {_q(B.IMPORT)}, 1), ','))) FROM l WHERE regexp_matches(text, {_q(B.IMPORT)})),
    n AS (SELECT *, string_split_regex(raw, '[?#]')[1] AS bare FROM f), o AS (SELECT *, CASE WHEN contains(bare, '://') THEN CASE WHEN instr(split_part(bare, '://', 2), '/') > 0 THEN substring(split_part(bare, '://', 2), instr(split_part(bare, '://', 2), '/')) ELSE '/' END ELSE bare END AS path FROM n),
    h AS (SELECT id, kind, side, method, CASE WHEN kind = 'ffi' THEN 'ffi:' || lower(replace(raw, '_', '')) ELSE '/' || coalesce(array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[{{<$*+]') OR starts_with(x, ':') THEN '*' ELSE lower(x) END), '/'), '') END AS key FROM o)"""


def _lines(spark, sf_dir):
    read(spark, sf_dir, "pages").createOrReplaceTempView("_pages_of_queries")
    return spark.sql(_LINES.replace("TABLE_", "_pages_of_queries"))


@query("WITH " + _HALVES + " SELECT id, kind, side, method, key FROM h")
def f22_f23_f24_route_lines(spark, sf_dir):
    """Halves of boundaries in lines of sixteen shapes around the tables' own addresses."""
    return B.halves(_lines(spark, sf_dir)).select("id", "kind", "side", "method", "key")


@query("WITH " + _HALVES + """, g AS (SELECT kind, key, min(id) FILTER (side = 'provide') AS provider, arg_min(method, id) FILTER (side = 'provide') AS method, count(*) FILTER (side = 'consume') AS consumers, list(DISTINCT method) FILTER (side = 'consume' AND method <> 'any') AS asked FROM h GROUP BY 1, 2)
    SELECT kind, key, provider, consumers, CASE WHEN provider IS NULL THEN 'no provider' WHEN consumers = 0 THEN 'no consumer' ELSE 'linked' END AS state, coalesce(method NOT IN ('any', 'call') AND len(list_filter(asked, lambda m: m <> method)) > 0, false) AS mismatch FROM g""")
def g14_j20_linked_routes(spark, sf_dir):
    """Both sides of each boundary: the first provider, how many consumers, orphans, and methods that differ."""
    h = B.halves(_lines(spark, sf_dir))
    provide, consume = F.col("side") == "provide", F.col("side") == "consume"
    g = h.groupBy("kind", "key").agg(
        F.min(F.when(provide, F.struct("id", "method"))).alias("first"), F.count_if(consume).alias("consumers"),
        F.collect_set(F.when(consume & (F.col("method") != "any"), F.col("method"))).alias("asked"),  # of a handful of methods
    )
    state = F.when(F.col("first").isNull(), "no provider").when(F.col("consumers") == 0, "no consumer").otherwise("linked")
    other = ~F.col("first.method").isin("any", "call") & F.exists("asked", lambda m: m != F.col("first.method"))
    return g.select("kind", "key", F.col("first.id").alias("provider"), "consumers", state.alias("state"), F.coalesce(other, F.lit(False)).alias("mismatch"))


# redaction, masks, times

_KEYS = ["'ghp_' || md5(t)", "'sk-' || md5(t)", "'AKIA' || upper(substring(md5(t), 1, 16))", "'xoxb-' || substring(md5(t), 1, 11)", "'my_ghp_' || md5(t)", "'hf_' || substring(md5(t), 1, 12)", "'-----BEGIN KEY-----' || chr(10) || md5(t) || chr(10) || '-----END KEY-----'"]
_SECRET = "CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(_KEYS)) + " END"
_RAW = f"conv_id, turn, CASE WHEN turn % 3 = 1 THEN repeat(t || ' ', 60) ELSE t END || ' (' || {_SECRET} || ') ' || {_SECRET} || chr(10) || 'tail' AS raw"
_CLEAN = f"regexp_replace(regexp_replace(raw, '(?s)-----BEGIN.*?-----END[^\\n]*', '[REDACTED key block]', 'g'), '(^|[^A-Za-z0-9_-])({'|'.join(X.SECRET_PREFIXES)})[A-Za-z0-9_-]{{12,}}', '\\1\\2[REDACTED]', 'g')"


@query(f"WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), r AS (SELECT {_RAW} FROM c), s AS (SELECT conv_id, turn, {_CLEAN} AS s FROM r)" + """
    , h AS (SELECT conv_id, turn, s, hex(encode(s)) AS h FROM s), n AS (SELECT *, list_max(list_filter([8141, 8142, 8143, 8144], lambda n: NOT substring(h, 2 * n + 1, 2) BETWEEN '80' AND 'BF')) AS n FROM h)
    SELECT conv_id, turn, sha256(CASE WHEN strlen(s) > 8192 THEN decode(unhex(substring(h, 1, 2 * n))) || '...[' || (strlen(s) - n) || ' bytes truncated]' ELSE s END) AS clean FROM n""")
def f12_redacted_turns(spark, sf_dir):
    """Turns with credentials of several kinds among their text, masked twice: what is masked stays as it is; long ones are cut with a note."""
    read(spark, sf_dir, "conversations").createOrReplaceTempView("_conversations_of_queries")
    c = spark.sql(f"SELECT {_RAW} FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM _conversations_of_queries) s")
    once = X.redact(F.col("raw"))
    return c.select("conv_id", "turn", F.sha2(X.redact(once), 256).alias("clean"))


_LOG = "'GET ' || coalesce(url, '') || ' took ' || CAST(page_id AS VARCHAR(20)) || '.5 ms at /srv/d' || CAST(page_id % 9 AS VARCHAR(9)) || '/x.log'"


@query(rf"""SELECT regexp_replace(regexp_replace(regexp_replace({_LOG}, 'https?://\S+', '<url>', 'g'), '(^|\s)/\S+', '\1<path>', 'g'), '[0-9]+', '#', 'g') AS shape, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1""")
def f31_masked_lines(spark, sf_dir):
    """Log lines around the tables' addresses by their shape."""
    line = F.col("line")
    shape = X.mask_numbers(F.regexp_replace(F.regexp_replace(line, r"https?://\S+", "<url>"), r"(^|\s)/\S+", "$1<path>"))
    return _sql(spark, sf_dir, "pages", f"page_id, {_LOG} AS line").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


_TWO = "lpad(CAST({} AS VARCHAR(9)), 2, '0')"
_STAMP = "'2024-' || " + " || ".join([_TWO.format("conv_id % 13 + 1"), "'-'", _TWO.format("conv_id % 30 + 1"), "'T'", _TWO.format("(conv_id + turn) % 26"), "':'", _TWO.format("turn * 7 % 60"), "':'", _TWO.format("(conv_id * 11) % 60")])
_SINCE = f"CASE conv_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'SESSION' WHEN 2 THEN CAST(turn + 1 AS VARCHAR(9)) || 'm' WHEN 3 THEN ' ' || CAST(conv_id AS VARCHAR(20)) || 'h ' WHEN 4 THEN CAST(turn AS VARCHAR(9)) || 'd' WHEN 5 THEN {_STAMP} || 'Z' WHEN 6 THEN 'v' || CAST(turn AS VARCHAR(9)) || '.2' ELSE CAST(turn AS VARCHAR(9)) || 'mh' END"
_JSON_LINE = f"""CASE WHEN turn % 4 = 3 THEN '{{{{"type":"x","timestamp":"soon"}}}}' ELSE '{{{{"type":"x","timestamp":"' || {_STAMP} || '.123Z","m":1}}}}' END""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH s AS (SELECT conv_id, turn, trim({_SINCE}) AS s, 1700000000 + conv_id * 1000 AS now, {_JSON_LINE} AS line FROM conversations)
    SELECT conv_id, turn, CASE WHEN s = '' OR lower(s) = 'session' THEN now - 100 WHEN regexp_full_match(s, '[0-9]+[mhd]') THEN now - CAST(left(s, -1) AS BIGINT) * CASE right(s, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END
        WHEN regexp_matches(s, '^[0-9-]+T') THEN CAST(epoch(try_strptime(s, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) END AS since, CAST(epoch(try_strptime(json_extract_string(line, '$.timestamp'), '%Y-%m-%dT%H:%M:%S.%gZ')) AS BIGINT) AS line_at FROM s""")
def f33_f35_f39_times(spark, sf_dir):
    """What a `since` of many forms means, and the times of transcript lines; months, days and hours that there aren't give null."""
    c = _sql(spark, sf_dir, "conversations", f"conv_id, turn, {_SINCE} AS since, 1700000000 + conv_id * 1000 AS now, {_JSON_LINE} AS line")
    return c.select("conv_id", "turn", P.since_seconds(F.col("since"), F.col("now"), F.col("now") - 100).alias("since"), X.line_time(F.col("line")).alias("line_at"))


# JSON

_TEXT = "coalesce(text, '')"


@query(f"""WITH a AS (SELECT conv_id, to_json(list(length({_TEXT}) ORDER BY turn)) AS a FROM conversations GROUP BY 1), c AS (SELECT conv_id, count(*) AS n, max(role) AS role FROM conversations GROUP BY 1)
    SELECT conv_id, unnest(json_extract(a, '$[*]'))::BIGINT AS value, json_array_length(a)::BIGINT AS n, n AS turns FROM a JOIN c USING (conv_id)""")
def f46_f48_json_turns(spark, sf_dir):
    """A JSON array of each conversation's lengths, taken apart again."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("t"), F.count("*").alias("turns"))
    json = c.select("conv_id", "turns", F.to_json(F.transform("t", lambda x: x["n"])).alias("a"))
    items = F.from_json("a", "array<bigint>")
    return json.select("conv_id", F.explode(items).alias("value"), F.size(items).cast("long").alias("n"), "turns")


@query(f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {_TEXT} WHEN 1 THEN array_to_string(string_split({_TEXT}, ' ')[1:3], chr(10)) ELSE '' END AS text, 'seen ' || coalesce(role, '') AS seen, CASE WHEN role = 'user' THEN 'user' ELSE 'user,' || coalesce(role, 'none') END AS tags FROM conversations""")
def f46_f47_f50_turn_content(spark, sf_dir):
    """A turn's content as a JSON text, a list of parts, or something else; a field set in an object; an element added once."""
    text = F.coalesce("text", F.lit(""))
    part = F.transform(F.slice(F.split(text, " "), 1, 3), lambda w: F.struct(w.alias("text")))
    content = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(text.alias("c")))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(part.alias("c")))).otherwise(F.to_json(F.struct(F.struct(text.alias("x")).alias("c"))))
    object_ = F.to_json(F.create_map(F.lit("seen"), F.lit("no"), F.lit("role"), F.coalesce("role", F.lit(""))))
    map_ = F.from_json(object_, "map<string,string>")
    seen = F.map_concat(F.map_filter(map_, lambda k, v: k != "seen"), F.create_map(F.lit("seen"), F.concat(F.lit("seen "), F.coalesce("role", F.lit("")))))["seen"]
    tags = F.array_union(F.array(F.lit("user")), F.array(F.coalesce("role", F.lit("none"))))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.text_of(content, "c").alias("text"), seen.alias("seen"), F.array_join(tags, ",").alias("tags"))


# markers

_ESC = "replace(replace(substring(t, 1, 24), chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
_KINDS = "CASE (conv_id + turn) % 4 WHEN 0 THEN 'PATTERN' WHEN 1 THEN 'TRAP' WHEN 2 THEN 'NOTE' ELSE 'OTHER' END"
_KEYED = "CASE (conv_id + turn) % 4 WHEN 0 THEN ' name=\"' WHEN 1 THEN ' description=\"' ELSE ' x=\"' END"
_ONE = f"'[KB-' || {_KINDS} || {_KEYED} || {_ESC} || '\"] ' || substring(t, 20, 30) || ' [/KB-' || CASE WHEN turn % 2 = 0 THEN {_KINDS} ELSE 'ADR' END || ']'"
_MARKED = f"substring(t, 1, 40) || chr(10) || CASE WHEN conv_id % 5 = 0 THEN '```' || chr(10) || {_ONE} || chr(10) || '```' || chr(10) ELSE {_ONE} || chr(10) END || '[KB-NOTE]...[/KB-NOTE] [KB-TRAP description=\"<what>\"]x[/KB-TRAP]'"
_PARSED = M.MARKER.replace("[\\s\\S]", "(?s:.)")


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), x AS (SELECT conv_id, turn, regexp_replace({_MARKED}, '```\\n(?s:.*?)\\n```', '', 'g') AS x FROM c),
    m AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, {_q(_PARSED)})) AS m FROM x),
    p AS (SELECT conv_id, turn, lower(regexp_extract(m, {_q(_PARSED)}, 1)) AS kind, regexp_extract(m, '(?:name|description)="((?:[^"\\\\]|\\\\.)*)"', 1) AS raw, trim(regexp_extract(m, {_q(_PARSED)}, 3), ' ') AS body FROM m),
    k AS (SELECT conv_id, turn, kind, CASE WHEN kind = 'note' THEN body ELSE regexp_replace(raw, '\\\\(.)', '\\1', 'g') END AS key, body FROM p)
    SELECT conv_id, turn, kind, key, body FROM k WHERE trim(key) <> '' AND NOT starts_with(trim(key), '...') AND NOT (starts_with(trim(key), '<') AND suffix(trim(key), '>'))""")
def f16_f20_marked_turns(spark, sf_dir):
    """Markers around the turns' own words: escaped names, wrong closing tags, fenced examples, placeholders, unknown kinds."""
    read(spark, sf_dir, "conversations").createOrReplaceTempView("_conversations_of_queries")
    c = spark.sql(f"SELECT conv_id, turn, {_MARKED} AS x FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM _conversations_of_queries) s")
    return c.select("conv_id", "turn", F.explode(M.parse(F.col("x"))).alias("m")).select("conv_id", "turn", "m.kind", "m.key", "m.body")


# vocabularies, classes, shapes

_SPELL = "CASE page_id % 4 WHEN 0 THEN ' ' || {0} WHEN 1 THEN upper({0}) WHEN 2 THEN replace({0}, '-', '_') || ' ' ELSE replace({0}, '-', ' ') END"


def _spelt(words: tuple[str, ...], number: str) -> str:
    """A word of a list by a number, spelt in one of four ways."""
    return _SPELL.format(f"(CASE {number} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END)")


_WORDS = {
    "origin": (P.PROVENANCE, (*P.PROVENANCE, "physics", "nobody knows", "")),
    "evidence": (P.EVIDENCE, (*P.EVIDENCE, "measured", "hearsay")),
    "state": (P.STATUS, (*P.STATUS, "open", "holds")),
}
_TEST = "CASE page_id % 6 WHEN 0 THEN 'run ' || CAST(page_id % 90 AS VARCHAR(9)) || ' min on it' WHEN 1 THEN '(~' || CAST(page_id % 9 AS VARCHAR(9)) || '.5 h)' WHEN 2 THEN 'v' || CAST(page_id AS VARCHAR(20)) || '.0.' || CAST(page_id % 7 AS VARCHAR(9)) || ' m' WHEN 3 THEN CAST(page_id % 5 AS VARCHAR(9)) || '-days, or ' || CAST(page_id AS VARCHAR(20)) || ' hours' WHEN 4 THEN CASE WHEN page_id % 4 = 0 THEN 'Half a Day' ELSE 'an hour' END || ' or 3 m' ELSE CAST(page_id AS VARCHAR(20)) || ' meters' END"
_DATE = "CASE page_id % 5 WHEN 0 THEN '20' || lpad(CAST(page_id % 99 AS VARCHAR(9)), 2, '0') WHEN 1 THEN '2024-' || lpad(CAST(page_id % 15 AS VARCHAR(9)), 2, '0') WHEN 2 THEN ' 2023-02-' || lpad(CAST(page_id % 33 AS VARCHAR(9)), 2, '0') || ' ' WHEN 3 THEN '2024-1-' || CAST(page_id % 31 AS VARCHAR(9)) ELSE coalesce(substring(url, 1, 10), '') END"
_ROW = ", ".join([*(f"{_spelt(words, f'CAST(floor(page_id / 4) AS BIGINT)')} AS {n}" for n, (_, words) in _WORDS.items()), f"{_TEST} AS test", f"{_DATE} AS day"])


def _usual(column: str, table: dict[str, str]) -> str:
    slug = f"regexp_replace(regexp_replace(lower(trim({column})), '[ _]', '-', 'g'), '^$', '')"
    return f"coalesce(map {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in table.items())}}}[{slug}], {slug})"


_NUMBER = r"'(?:^|[^0-9.])([0-9]+(?:\.[0-9]+)?)[ -]*(min|mins|minutes|minute|m|hours|hour|hrs|hr|h|days|day)(?:[^a-z]|$)'"


@query(f"""WITH w AS (SELECT page_id, {_ROW} FROM pages), n AS (SELECT *, regexp_extract(lower(test), {_NUMBER}, 1) AS n, regexp_extract(lower(test), {_NUMBER}, 2) AS u, trim(day) AS d FROM w)
    SELECT page_id, {", ".join(f"{_usual(n, table)} AS {n}" for n, (table, _) in _WORDS.items())},
    CASE WHEN contains(lower(test), 'half a day') THEN 240 WHEN contains(lower(test), 'half an hour') THEN 30 WHEN contains(lower(test), 'an hour') THEN 60 WHEN contains(lower(test), 'a day') THEN 480 WHEN n <> '' THEN round(CAST(n AS DOUBLE) * CASE u[1] WHEN 'm' THEN 1 WHEN 'h' THEN 60 ELSE 480 END)::INT END AS minutes,
    regexp_full_match(d, '[0-9]{{4}}') OR (regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}') AND try_strptime(d || '-01', '%Y-%m-%d') IS NOT NULL) OR (regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(d, '%Y-%m-%d') IS NOT NULL) AS valid FROM n""")
def f21_f36_f37_spelt_words(spark, sf_dir):
    """Whole vocabularies in four spellings each, minutes in phrases with numbers of all kinds, and dates of which many aren't."""
    w = _sql(spark, sf_dir, "pages", f"page_id, {_ROW}")
    return w.select("page_id", *(P.alias(F.col(n), table).alias(n) for n, (table, _) in _WORDS.items()), P.minutes(F.col("test")).alias("minutes"), P.valid_date(F.col("day")).alias("valid"))


_FILE = "CASE page_id % 9 WHEN 0 THEN 'Tests/' WHEN 1 THEN 'a/example/' WHEN 2 THEN 'contests/' WHEN 3 THEN 'x/examples/y/' ELSE 'src/' END || coalesce(regexp_replace(url, '^.*/', ''), '') || CASE CAST(floor(page_id / 9) AS BIGINT) % 10 WHEN 0 THEN '.MD' WHEN 1 THEN '_test.go' WHEN 2 THEN '.test.ts' WHEN 3 THEN '_spec.rb' WHEN 4 THEN '.htm' WHEN 5 THEN '.html.erb' WHEN 6 THEN '.jsonl' WHEN 7 THEN '.rs' WHEN 8 THEN 'txt' ELSE '' END"


@query(f"""WITH f AS (SELECT page_id, lower({_FILE}) AS p FROM pages) SELECT page_id, contains(p, '.') AND list_contains(['md', 'markdown', 'txt', 'html', 'htm', 'rst', 'adoc', 'csv', 'jsonl', 'log'], string_split(p, '.')[-1]) AS prose,
    len(list_filter(string_split(p, '/')[1:-2], lambda x: x IN ('test', 'tests', 'example', 'examples'))) > 0 OR contains(p, '_test.') OR contains(p, '.test.') OR contains(p, '_spec.') AS test FROM f""")
def p11_file_kinds(spark, sf_dir):
    """Prose by its extension, tests and examples by folder or name, over paths with the tables' own names."""
    from sparkloom.plans.knowledge import PROSE_FILE, TEST_FILE

    return _sql(spark, sf_dir, "pages", f"page_id, lower({_FILE}) AS p").select("page_id", F.col("p").rlike(PROSE_FILE).alias("prose"), F.col("p").rlike(TEST_FILE).alias("test"))


_SIG = "CASE WHEN turn % 2 = 0 THEN 'assert:' ELSE 'rust:E' || CAST(turn AS VARCHAR(9)) || ':' END || substring(coalesce(text, ''), 1, 12) || CASE WHEN conv_id % 3 = 0 THEN '@t' || CAST(conv_id AS VARCHAR(20)) ELSE '' END"


@query(f"SELECT conv_id, turn, sig FROM (SELECT conv_id, turn, {_SIG} AS sig FROM conversations) WHERE NOT (starts_with(sig, 'assert:') AND NOT contains(sig, '@'))")
def p14_legacy_signatures(spark, sf_dir):
    """Signatures of an older shape go: those of assertions without a place."""
    sig = F.col("sig")
    return _sql(spark, sf_dir, "conversations", f"conv_id, turn, {_SIG} AS sig").where(~(sig.like("assert:%") & ~sig.like("%@%")))


_REASON = "CASE (conv_id * 3 + turn) % 6 WHEN 0 THEN 'duplicate of ' WHEN 1 THEN 'syntax: ' WHEN 2 THEN 'credibility 0.' WHEN 3 THEN 'survival ' WHEN 4 THEN ' duplicate ' ELSE '' END || CAST(turn AS VARCHAR(9)) || substring(coalesce(text, ''), 1, 5)"


@query(f"SELECT coalesce(nullif(regexp_extract(r, '^(duplicate|syntax|credibility|survival)', 1), ''), 'unknown') AS kind, count(*) AS n, count(DISTINCT r) AS reasons FROM (SELECT {_REASON} AS r FROM conversations) GROUP BY 1")
def a19_l10_rejection_reasons(spark, sf_dir):
    """Reasons of rejection by how they begin, with how many different ones there are."""
    kind = F.coalesce(*[F.when(F.col("r").startswith(p), p) for p in ("duplicate", "syntax", "credibility", "survival")], F.lit("unknown"))
    return _sql(spark, sf_dir, "conversations", f"{_REASON} AS r").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("r").alias("reasons"))


_BLOCK = "repeat(' ', CAST(1 + conv_id % 5 AS INT)) || replace(substring(coalesce(text, ''), 1, 60), ' ', chr(10) || repeat(' ', CAST(1 + turn % 4 AS INT))) || chr(10) || '  ' || chr(10)"


@query(f"""WITH b AS (SELECT conv_id, turn, string_split({_BLOCK}, chr(10)) AS ls FROM conversations), n AS (SELECT *, coalesce(list_min(list_transform(list_filter(ls, lambda x: trim(x, ' ') <> ''), lambda x: length(x) - length(ltrim(x, ' ')))), 0) AS n FROM b)
    SELECT conv_id, turn, array_to_string(list_transform(ls, lambda x: CASE WHEN trim(x, ' ') = '' THEN '' ELSE substring(x, n + 1) END), chr(10)) AS dedented FROM n""")
def f30_dedented_turns(spark, sf_dir):
    """Blocks of lines with indents of their own, without what all lines share."""
    return _sql(spark, sf_dir, "conversations", f"conv_id, turn, {_BLOCK} AS b").select("conv_id", "turn", X.dedent(F.col("b")).alias("dedented"))


# preference tiers

_TERMS = ("than", "che", "nich", "para")
_SCORE = " + ".join(f"contains(lower(note), '{t}')::INT" for t in _TERMS)


@query(f"""WITH c AS (SELECT conv_id, turn, string_split(text, '. ') AS notes FROM conversations WHERE text IS NOT NULL),
    e AS (SELECT conv_id, turn, unnest(notes) AS note, generate_subscripts(notes, 1) AS i FROM c), s AS (SELECT *, {_SCORE} AS score, trim(replace(note, chr(10), ' '), ' ') AS flat FROM e),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i) AS place, instr(flat, '. ') AS stop, substring(flat, 1, 40) AS head FROM s),
    t AS (SELECT *, score > 0 AND place <= 3 AS whole, CASE WHEN score > 0 AND place <= 3 THEN note WHEN stop BETWEEN 1 AND 40 THEN substring(flat, 1, stop) || ' …' WHEN length(flat) <= 40 THEN flat WHEN contains(head, ' ') THEN rtrim(substring(head, 1, length(head) - instr(reverse(head), ' ')), ' ') || ' …' ELSE head || ' …' END AS shown FROM p)
    SELECT conv_id, turn, string_agg('- ' || shown, chr(10) ORDER BY i) AS text, count(*) FILTER (NOT whole) AS collapsed FROM t GROUP BY 1, 2""")
def r20_note_text(spark, sf_dir):
    """Notes of a text for a hint: the three that match best are whole and in their place, of the others the first clause."""
    notes = F.split("text", r"\. ")
    score = lambda x: sum((F.contains(F.lower(x), F.lit(t)).cast("int") for t in _TERMS), F.lit(0))
    ranked = F.array_sort(F.filter(F.transform(notes, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"))), lambda r: r["s"] < 0))
    c = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", notes.alias("notes"), F.transform(F.slice(ranked, 1, 3), lambda r: r["i"]).alias("best"))
    shown = F.transform("notes", lambda x, i: F.concat(F.lit("- "), F.when(F.array_contains("best", i), x).otherwise(P.first_clause(x, 40))))
    return c.select("conv_id", "turn", F.array_join(shown, "\n").alias("text"), (F.size("notes") - F.size("best")).cast("long").alias("collapsed"))
