"""Queries over foreign and streaming sources: captured lines, debounced changes, offers that expire, late drafts, SQLite files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans.catalog import _E, query
from sparkloom.sources.capture import captured
from sparkloom.sources.sqlite import sqlite_table, write_sqlite
from sparkloom.sources.tables import read
from sparkloom.streaming import jobs as J


@query("SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def x09_s05_captured_lines(spark, sf_dir):
    """Assistant turns of transcripts captured by byte offset: files of a second writing come in a second run, and nothing comes twice."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"))
    folder = J.shared_folder(spark, "captured")
    early = F.coalesce(F.col("turn") < 2, F.lit(True))
    schema = "conv_id bigint, turn bigint, type string, message struct<content:string>"
    for part in (c.where(early), c.where(~early)):
        part.write.mode("append").json(f"{folder}/in")
        lines = captured(spark, f"{folder}/in", suffix=".json", needle='"type":"assistant"').select(F.from_json("line", schema).alias("j")).select("j.*")
        kept = lines.where("type = 'assistant' and message.content is not null").select("conv_id", "turn", F.length("message.content").alias("chars"))
        rows = J.append_to(kept, folder)
    return rows


@query("""WITH c AS (SELECT user_id AS path, event_type AS act, event_id, ts, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS stretch FROM c),
    s AS (SELECT path, arg_max(act, (ts, event_id)) AS act, max(event_id) AS event_id, count(*) AS changes, epoch_us(max(ts)) AS last_at, max(ts) AS last FROM g GROUP BY path, stretch)
    SELECT path, act, event_id, changes, last_at FROM s WHERE last + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""")
def x10_debounced_stream(spark, sf_dir):
    """The last change of each stretch of changes to a path, once it has been quiet for the gap; as a stream with event time.

    The tables' changes are minutes apart, so the gap is an hour; the operator's is two seconds. Stretches that
    the end of the stream leaves open are not out yet.
    """
    stream = J.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("path"), F.col("event_type").alias("act"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = J.append_to(J.quiet_ends(stream, "path", "ts", ["event_id", "act"], "1 hour", "0 seconds"), J.shared_folder(spark, "debounce"))
    return rows.select("path", "act", "event_id", "changes", F.unix_micros("last_at").alias("last_at"))


@query(_E + """, o AS (SELECT o.event_id AS offer_id, o.ts, min(s.secs) AS seen_at FROM e o LEFT JOIN e s ON s.event_type = 'purchase' AND s.user_id = o.user_id AND s.props = o.props AND s.ts >= o.ts AND s.ts <= o.ts + INTERVAL 1 DAY WHERE o.event_type = 'click' GROUP BY 1, 2)
    SELECT offer_id, seen_at FROM o WHERE seen_at IS NOT NULL OR ts + INTERVAL 1 DAY < (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) FROM e)""")
def x06_offers_stream(spark, sf_dir):
    """Offers with their first confirmation within a day, or null once the day is over; a left outer join of two streams."""
    e = J.stream_of(spark, f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp")
    offers = e.where("event_type = 'click'").select("user_id", "props", F.col("event_id").alias("offer_id"), at.alias("offered_at"))
    seen = J.stream_of(spark, f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select("user_id", "props", at.alias("seen_at"))
    rows = J.append_to(J.offered(offers, seen, ["user_id", "props"]), J.shared_folder(spark, "offers"))
    return rows.groupBy("offer_id").agg(F.min(F.unix_seconds("seen_at")).alias("seen_at"))


@query(_E + """ SELECT user_id * 1000 + k AS entry, max(value) AS written, max_by(event_id, (value, event_id)) AS kept, count(*) AS drafts FROM e WHERE k IS NOT NULL GROUP BY 1""")
def x11_late_drafts_stream(spark, sf_dir):
    """Drafts of entries as a stream whose order isn't that of writing: an older draft never replaces a newer one."""
    e = J.stream_of(spark, f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long")).where("k is not null")
    drafts = e.select((F.col("user_id") * 1000 + F.col("k")).alias("entry"), F.col("value").alias("written"), F.col("event_id").alias("draft"))
    return J.newest_to(drafts, "entry", "written", "draft", J.shared_folder(spark, "drafts"))


@query("SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE role = 'assistant' AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def s10_s01_sqlite_turns(spark, sf_dir):
    """The last two answers of each conversation from foreign SQLite files, which are only read; their own engine drops other roles."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    folder = J.shared_folder(spark, "sqlite")
    write_sqlite(c.repartition(4, "conv_id"), folder, "turns")
    turns = sqlite_table(spark, folder, "turns", rangeRows="20000").where("role = 'assistant' and text is not null")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("place", place).where("place <= 2").select("conv_id", "turn", F.length("text").alias("chars"))
