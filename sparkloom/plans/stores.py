"""Stores of a knowledge engine, derived from the given tables by SQL that Spark and DuckDB both run.

Each is a whole-table projection: code units, knowledge entries, traps, calls with their output,
journal, walls, gaps. Queries read them by store(); their SQL gets them by stores_sql().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.tables import read

NL = "chr(10)"

_V = "CAST({} AS VARCHAR(20))"
_K, _U = _V.format("k"), _V.format("user_id")


def _pick(number: str, choices: list[str]) -> str:
    """One of several expressions by a number."""
    return f"CASE {number} % {len(choices)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


#: A call's command: what leads it, a program and its arguments, each by digits of the event's number; names and numbers are the event's own.
_LEADS = ["''", f"'cd /work/p' || {_K} || ' && '", "'RUST_LOG=debug '", f"'sudo -E -u u' || {_U} || '; '", f"'env FOO=' || {_K} || ' BAR=x '", f"'cd /tmp/x; cd y' || {_K} || ' && '", "'nohup true;  '"]
_PROGRAMS = [
    f"'cargo test  --all -p m' || {_K}", "'cargo build'", "'npm test'", f"'pytest -q tests/test_' || {_K} || '.py'", "'ls -la src'", f"'/usr/bin/Python3 -m pytest -k t' || {_U}", "'git status'", "'cargo check'",
    "'cargo clippy --fix'", f"'grep -rn \"fn f' || {_K} || '\" src'", "'./gradlew build'", f"'sed -n ' || {_K} || ',200p src/lib.rs'", f"'sleep ' || {_K}", "'   '", f"'go test ./pkg' || {_U} || '/...'", f"'Tools/Run.exe --id ' || {_U} || chr(10) || 'cargo test'",
]
_OUTPUTS = [
    f"'---- net::retry_' || {_K} || ' stdout ----' || chr(10) || 'thread main panicked at src/net/r' || {_U} || '.rs:' || {_K} || ':9:' || chr(10) || 'assertion failed: left_' || {_U} || ' == right after ' || {_K} || ' tries' || chr(10) || chr(10) || 'test result: FAILED. 1 passed; 1 failed'",
    f"'error[E0425]: cannot find value `sym_' || {_U} || '` in this scope' || chr(10) || ' --> src/m' || {_K} || '/lib.rs:' || {_K} || ':5' || chr(10) || {_K} || ' . frob'",
    f"' Tests  ' || {_K} || ' failed; ' || {_U} || ' passed'", f"'== ' || {_K} || ' passed in 0.31s ==' || chr(10) || 'ok. all ' || {_U} || ' done'", f"'total ' || {_K}",
    "'error: test failed, to rerun pass --lib'", "'nothing to commit'", f"'warning: unused' || chr(10) || 'error[E0308]: mismatched types in ' || {_K} || ' places' || chr(10) || '  --> src/a/b/model' || {_U} || '.rs:7:13'",
    f"'Finished `dev` profile in ' || {_K} || 's'", f"'src/m' || {_U} || '.rs:' || {_K} || ':fn main() {{{{'", f"'BUILD SUCCESSFUL in ' || {_K} || 's'", f"'running' || chr(10) || '    thread t' || {_U} || ' panicked at lib/pool' || {_K} || '.rs:9:1:' || chr(10) || 'test result: FAILED'",
    f"'thread main panicked at x/y_' || {_U} || '.rs:1:1:' || chr(10) || 'short ' || {_K}", f"'FAILED (errors=' || {_K} || ')' || chr(10) || 'error: no such thing ' || {_U}", "''",
]
_DIGIT = "CAST(floor(event_id / {}) AS BIGINT)"
_COMMAND = "(" + _pick("event_id", _LEADS) + " || " + _pick(_DIGIT.format(7), _PROGRAMS) + ")"
_OUTPUT = "(" + _pick(_DIGIT.format(3), _OUTPUTS) + ")"

#: Lines of program text around language boundaries.
_LINES = """(VALUES
    (0, '@app.get("/api/models/{model_id}/Items")'), (1, 'fetch(`/api/models/$' || '{id}/items`)'), (2, '@bp.route("/login")'),
    (3, 'axios.post("/login", body)'), (4, '.route("/users/:id", get(show))'), (5, 'requests.get("http://host:80/users/7?x=1")'),
    (6, '#[post("/orders")]'), (7, 'router.delete("/orders/:id", h)'), (8, 'mux.HandleFunc("/health", ok)'), (9, '@GetMapping("/health")'),
    (10, '[HttpPut("/items/{id}")]'), (11, 'new WebSocket("ws://host/live")'), (12, 'pub extern "C" fn solve_ik(x: i32)'),
    (13, 'import { solveIk, init } from "./ik_wasm.js"'), (14, 'let total = a + b;'), (15, 'client.patch("/items/9")')
    ) AS t(i, line)"""

STORES: dict[str, str] = {
    # code units: names repeat across modules; bodies name other units' names
    "units": """SELECT p_partkey AS id, upper(substring(p_name, 1, 1)) || substring(split_part(p_name, ' ', 1), 2) || upper(substring(split_part(p_name, ' ', 2), 1, 1)) || substring(split_part(p_name, ' ', 2), 2) || CAST(p_partkey % 9 AS VARCHAR(9)) AS name,
        CASE p_size % 4 WHEN 0 THEN 'struct' WHEN 1 THEN 'trait' WHEN 2 THEN 'fn' ELSE 'enum' END AS kind,
        'm' || CAST(p_size % 5 AS VARCHAR(9)) || '::' || lower(p_type) || CASE WHEN p_partkey % 3 = 0 THEN '::inner' ELSE '' END AS module,
        CASE p_size % 3 WHEN 0 THEN 'Rust' WHEN 1 THEN 'python' ELSE 'Go' END AS language, lower(p_brand) AS origin,
        'src/' || lower(p_type) || '/' || split_part(p_name, ' ', 2) || CASE p_size % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.go' END AS path,
        CAST(p_partkey % 400 + 1 AS BIGINT) AS line, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'root' || CAST(p_partkey % 4 AS VARCHAR(9)) END AS root,
        CASE p_partkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'crate' ELSE 'public' END AS visibility, CAST(p_size % 7 AS BIGINT) AS methods,
        p_name || ' of ' || lower(p_type) AS summary,
        'impl: Show, ' || upper(substring(p_name, 1, 1)) || substring(split_part(p_name, ' ', 1), 2) || 'Ring' || CAST(p_partkey % 9 AS VARCHAR(9)) || chr(10)
          || 'fields: size: ' || upper(substring(p_name, 1, 1)) || substring(split_part(p_name, ' ', 1), 2) || 'Bolt' || CAST((p_partkey + 1) % 9 AS VARCHAR(9)) || ', count: i64' || chr(10)
          || 'methods: new | get_' || split_part(p_name, ' ', 2) || ' | drop' || chr(10) || 'docs: not a Facet' AS body,
        CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey * 1000 AS BIGINT) END AS signature_changed_at
        FROM {part}""",
    # knowledge entries: every turn of the conversations; a third are recaps or copies of others
    "entries": """SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 2 THEN 'trap' ELSE 'pattern' END AS kind, 'p' || CAST(conv_id % 4 AS VARCHAR(9)) AS project,
        CAST(conv_id * 60 + turn AS BIGINT) AS at, coalesce(CASE WHEN conv_id % 5 = 0 AND turn > 0 THEN first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) || ' and again ' || role || CASE WHEN turn % 2 = 0 THEN ' overlap_' || CAST(conv_id AS VARCHAR(9)) || ' changed_words later_on SmallRing' || CAST(conv_id % 9 AS VARCHAR(9)) ELSE '' END ELSE text END, '') AS body, 'tag' || CAST(turn % 5 AS VARCHAR(9)) || ',' || coalesce(role, '') AS tags,
        CASE WHEN (conv_id + turn) % 11 = 0 THEN 0 WHEN (conv_id + turn) % 13 = 0 THEN conv_id * 1000 END AS superseded_by,
        CAST((conv_id * 7 + turn) % 12 AS BIGINT) AS used, CAST((conv_id * 3 + turn) % 5 AS BIGINT) AS reverted FROM {conversations}""",
    # traps: the benchmark's items, with the identifiers that some of them name
    "traps": """SELECT item_id AS id, text || CASE WHEN item_id IN (3, 23) THEN ' pool_acquire setSize' || CAST(item_id % 4 AS VARCHAR(9)) WHEN item_id IN (7, 27) THEN ' CuboidDef recv_timeout' ELSE '' END AS description,
        CAST(item_id * 50 AS BIGINT) AS added_at FROM {benchmark}""",
    "calls": f"""SELECT e.event_id AS id, e.user_id, CAST(e.user_id AS VARCHAR(20)) || '_' || date_format_day AS sess, e.at AS at, CASE event_type WHEN 'error' THEN 'Bash' WHEN 'view' THEN 'kb__search' WHEN 'click' THEN 'code__outline' WHEN 'signup' THEN 'PowerShell' ELSE 'Edit' END AS tool, {_COMMAND} AS command, {_OUTPUT} AS output, e.known_k AS k
        FROM (SELECT event_id, user_id, event_type, {{day}} AS date_format_day, {{secs}} AS at, {{k}} AS known_k, coalesce({{k}}, 0) AS k FROM {{events}}) e""",
    "lines": f"""SELECT d.page_id AS id, 'f' || CAST(d.page_id % 40 AS VARCHAR(9)) AS file, d.page_id % 97 AS line, 'o' || CAST(d.page_id % 3 AS VARCHAR(9)) AS origin, t.line AS text FROM {{pages}} d JOIN {_LINES} ON t.i = d.page_id % 16""",
    # journal of changes to units, in order of id
    "journal": """SELECT event_id AS id, e.at AS at, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'changed' END AS change, k * 7 AS unit_id FROM (SELECT event_id, event_type, {secs} AS at, {k} AS k FROM {events}) e WHERE k IS NOT NULL""",
    "walls": """SELECT s_suppkey AS id, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' needs serde to change' WHEN 1 THEN ' is bound by tokio-util' ELSE ' stays' END AS claim,
        CASE s_suppkey % 8 WHEN 0 THEN 'Physical' WHEN 1 THEN 'os policy' WHEN 2 THEN ' Config ' WHEN 3 THEN 'version' WHEN 4 THEN 'research_code' WHEN 5 THEN 'cost' WHEN 6 THEN 'expert' ELSE 'nothing known' END AS provenance,
        CASE s_suppkey % 5 WHEN 0 THEN 'held' WHEN 1 THEN 'Broken' WHEN 2 THEN 'open' WHEN 3 THEN 'retire' ELSE 'odd' END AS status,
        CASE s_suppkey % 9 WHEN 0 THEN '~20 min on the device' WHEN 1 THEN '(~1.5 h)' WHEN 2 THEN 'half a day' WHEN 3 THEN 'needs 30.0.1' WHEN 4 THEN '2 days' WHEN 5 THEN 'an hour or so' WHEN 6 THEN 'v2 then 45-minutes' WHEN 7 THEN '' ELSE 'no idea' END AS cheapest_test,
        CASE s_suppkey % 4 WHEN 0 THEN 'Benchmark' WHEN 1 THEN 'vendor docs' WHEN 2 THEN 'paper' ELSE 'reasoning' END AS evidence_kind,
        CASE s_suppkey % 6 WHEN 0 THEN '2024' WHEN 1 THEN '2024-02' WHEN 2 THEN '2024-02-30' WHEN 3 THEN '' WHEN 4 THEN '2023-13' ELSE '2023-11-05' END AS evidence_date, s_nationkey AS area
        FROM {supplier}""",
    # gaps: what was looked for and not found
    "gaps": """SELECT o_custkey AS session, CASE o_orderkey % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'recall' ELSE 'item' END AS tool, lower(o_orderpriority) AS query, o_orderkey AS id, CAST(o_orderkey AS BIGINT) AS at FROM {orders}""",
}

_SPARK = {
    "day": "date_format(ts, 'yyyy-MM-dd')",
    "secs": "unix_seconds(ts)",
    "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
}
_DUCK = {
    "day": "strftime(ts, '%Y-%m-%d')",
    "secs": "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)",
    "k": "CAST(props->>'k' AS BIGINT)",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _filled(name: str, words: dict[str, str]) -> str:
    sql = STORES[name]
    for k, v in words.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def store(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The store's rows; only the tables that it names are read."""
    used = {t: f"sparkloom_{t}" for t in _TABLES if "{" + t + "}" in STORES[name]}
    for t, view in used.items():
        table = read(spark, sf_dir, t)
        if dict(table.dtypes).get("ts") == "timestamp_ntz":
            table = table.withColumn("ts", table["ts"].cast("timestamp"))
        table.createOrReplaceTempView(view)
    return spark.sql(_filled(name, _SPARK | used).replace("VARCHAR(9)", "STRING"))


def stores_sql(*names: str) -> str:
    """WITH clause that defines the stores, without the keyword at its end."""
    return "WITH " + ", ".join(f"{n} AS ({_filled(n, _DUCK | {t: t for t in _TABLES})})" for n in names)
