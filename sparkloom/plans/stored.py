"""Queries that change stored tables: upserts, released content, reindexed roots, undone classes, migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.catalog import query
from sparkloom.sources.tables import read
from sparkloom.sources.versioned import VersionedTable, latest
from sparkloom.streaming.jobs import shared_folder


@query("""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS now, coalesce(text, '') AS was, (conv_id + turn) % 4 <> 0 AS old, (conv_id + turn) % 4 <> 1 AS new, role = 'user' AS again FROM conversations)
    SELECT conv_id, turn, length(CASE WHEN new THEN now ELSE was END) AS chars, CASE WHEN old AND new AND now <> was AND again IS DISTINCT FROM true THEN length(was) END AS previous_chars FROM a WHERE old OR new""")
def s18_stored_upsert(spark, sf_dir):
    """Turns upserted twice in a stored table: a changed text keeps the one before, one that comes again unchanged drops it."""
    u = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("body"))
    fold = (F.col("conv_id") + F.col("turn")) % 4
    first = u.where(fold != 0).select("conv_id", "turn", "body", F.lit(None).cast("string").alias("previous"))
    table = VersionedTable.create(first, shared_folder(spark, "upsert"), ["conv_id", "turn"])
    changed = F.col("has_old") & F.col("has_new") & (F.col("old.body") != F.col("new.body"))
    values = latest(["body"]) | {"previous": F.when(changed, F.col("old.body")).when(~F.col("has_new"), F.col("old.previous"))}
    news = u.where(fold != 1).withColumn("body", F.when(F.col("turn") % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    table.merge(news, values)
    table.merge(news.where("role = 'user'"), values)
    return table.read().select("conv_id", "turn", F.length("body").alias("chars"), F.length("previous").alias("previous_chars"))


@query("""WITH h AS (SELECT sha256(coalesce(lang, '') || '|' || coalesce(text, '')) AS hash, doc_id FROM documents), n AS (SELECT hash, count(*) AS refs, count(*) FILTER (doc_id % 3 = 0) AS gone FROM h GROUP BY 1)
    SELECT hash, refs - gone AS refs FROM n WHERE refs > gone""")
def s20_stored_release(spark, sf_dir):
    """Content by digest in a stored table: references are taken and released, and content without any goes."""
    d = read(spark, sf_dir, "documents")
    hashed = d.select(F.sha2(F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))), 256).alias("hash"), "doc_id")
    counted = lambda df: df.groupBy("hash").agg(F.count("*").alias("refs"))
    table = VersionedTable.create(counted(hashed.where("doc_id % 2 = 0")), shared_folder(spark, "content"), ["hash"])
    number = lambda side: F.coalesce(F.col(f"{side}.refs"), F.lit(0))
    table.merge(counted(hashed.where("doc_id % 2 <> 0")), {"refs": number("old") + number("new")}, operation="take")
    table.merge(counted(hashed.where("doc_id % 3 = 0")), {"refs": number("old") - number("new")}, keep=number("old") > number("new"), operation="release")
    table.release()
    return table.read()


@query("""WITH b AS (SELECT lang AS root, doc_id AS id, source AS name FROM documents WHERE lang IS NOT NULL), a AS (SELECT id, name || CASE WHEN id % 5 = 0 THEN '_v2' ELSE '' END AS name FROM b WHERE root = 'de' AND id % 3 <> 0 UNION ALL SELECT -1 - id, name FROM b WHERE root = 'de' AND id % 7 = 0),
    o AS (SELECT id, name FROM b WHERE root = 'de')
    SELECT coalesce(a.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.name <> o.name THEN 'changed' ELSE 'same' END AS change, a.name AS name FROM a FULL JOIN o USING (id) UNION ALL SELECT id, 'same', name FROM b WHERE root <> 'de'""")
def c02_stored_reindex(spark, sf_dir):
    """A root indexed anew in one commit: new, changed and vanished units against the version before, other roots untouched."""
    units = read(spark, sf_dir, "documents").where("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("root"), F.col("source").alias("name"))
    table = VersionedTable.create(units, shared_folder(spark, "index"), ["id"])
    before = table.head()["version"]
    own = units.where("root = 'de'")
    found = own.where("id % 3 <> 0").withColumn("name", F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("_v2"))).otherwise(F.col("name")))
    found = found.unionByName(own.where("id % 7 = 0").withColumn("id", -1 - F.col("id")))
    stays = found.withColumn("there", F.lit(True))
    vanished = table.read().where("root = 'de'").join(found, "id", "left_anti").withColumn("there", F.lit(False))
    table.merge(stays.unionByName(vanished), latest(["root", "name"]), keep=~F.col("has_new") | F.col("new.there"), operation="reindex de")
    old, new = table.read(before).alias("o"), table.read().alias("n")
    change = F.when(F.col("o.id").isNull(), "added").when(F.col("n.id").isNull(), "removed").when(F.col("n.name") != F.col("o.name"), "changed").otherwise("same")
    return old.join(new, F.col("o.id") == F.col("n.id"), "full").select(F.coalesce("n.id", "o.id").alias("id"), change.alias("change"), F.col("n.name").alias("name"))


@query("""WITH l AS (SELECT conv_id AS id, max(turn) FILTER (role = 'assistant') AS said, coalesce(bool_or(length(text) % 3 = 0), false) AS retracted, coalesce(bool_or(length(text) % 7 = 0), false) AS restored FROM conversations GROUP BY 1)
    SELECT id, CASE WHEN retracted AND NOT restored THEN 0 ELSE said END AS superseded_by, CASE WHEN retracted AND NOT restored THEN 'retracted' WHEN said IS NOT NULL THEN 'superseded' ELSE 'live' END AS state FROM l""")
def c08_stored_undo(spark, sf_dir):
    """Entries superseded, then a class of changes retracted, then part of it restored to what stood before."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", F.length("text").alias("n"))
    entries = c.groupBy("id").agg(F.lit(None).cast("bigint").alias("superseded_by"), F.lit(None).cast("bigint").alias("before"), F.lit(False).alias("retracted"))
    table = VersionedTable.create(entries, shared_folder(spark, "undo"), ["id"])
    old = lambda c: F.col(f"old.{c}")
    newer = c.where("role = 'assistant'").groupBy("id").agg(F.max("turn").alias("by"))
    table.merge(newer, {"superseded_by": F.when(F.col("has_new"), F.col("new.by")).otherwise(old("superseded_by"))}, operation="supersede")
    hit = F.col("has_new") & ~old("retracted")  # what is retracted already stays as it is
    retract = {"before": F.when(hit, old("superseded_by")).otherwise(old("before")), "superseded_by": F.when(hit, 0).otherwise(old("superseded_by")), "retracted": F.col("has_new") | old("retracted")}
    table.merge(c.where("n % 3 = 0").select("id").distinct(), retract, operation="retract")
    back = F.col("has_new") & old("retracted")
    restore = {"before": F.when(~back, old("before")), "superseded_by": F.when(back, old("before")).otherwise(old("superseded_by")), "retracted": old("retracted") & ~F.col("has_new")}
    table.merge(c.where("n % 7 = 0").select("id").distinct(), restore, operation="restore")
    state = F.when(F.col("retracted"), "retracted").when(F.col("superseded_by").isNotNull(), "superseded").otherwise("live")
    return table.read().select("id", "superseded_by", state.alias("state"))


@query("""SELECT doc_id, lang, sha256(coalesce(lang, '')) AS hash, coalesce(n_chars, 0) // 4 AS tokens, doc_id % 2 = 0 AS first_level FROM documents""")
def s27_stored_migration(spark, sf_dir):
    """A stored table brought through two levels, each once, with rows added between; the versions before stay as backups."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n_chars"))
    table = VersionedTable.create(d.where("doc_id % 2 = 0"), shared_folder(spark, "migration"), ["doc_id"])
    hashed = F.sha2(F.coalesce("lang", F.lit("")), 256)
    table.migrate(1, {"hash": hashed})
    table.migrate(1, {"hash": F.lit("never")})
    table.merge(d.where("doc_id % 2 <> 0").withColumn("hash", hashed), latest(["lang", "n_chars", "hash"]))
    table.migrate(2, {"tokens": F.expr("n_chars div 4")})
    table.release()
    backup = table.read(0).select("doc_id", F.lit(True).alias("first_level"))
    return table.read().join(backup, "doc_id", "left").select("doc_id", "lang", "hash", "tokens", F.coalesce("first_level", F.lit(False)).alias("first_level"))


@query("""WITH p AS (SELECT page_id, sha256(coalesce(url, '') || '|v1') AS key, length(html) AS chars FROM pages), d AS (SELECT key, max(page_id) AS put_at, arg_max(chars, page_id) AS chars, count(*) FILTER (page_id % 3 = 0) AS hits FROM p GROUP BY 1),
    n AS (SELECT count(*) AS n FROM d) SELECT key, put_at, chars, hits FROM d QUALIFY row_number() OVER (ORDER BY put_at DESC) <= (SELECT n - n // 4 FROM n)""")
def s21_stored_cache(spark, sf_dir):
    """Answers put in a stored cache by the digest of what was asked and the index version, read, and the oldest quarter evicted."""
    p = read(spark, sf_dir, "pages").select("page_id", F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("|v1")), 256).alias("key"), F.length("html").alias("chars"))
    put = p.groupBy("key").agg(F.max("page_id").alias("put_at"), F.max_by("chars", "page_id").alias("chars"))  # the last answer put counts
    table = VersionedTable.create(put.limit(0).withColumn("hits", F.lit(0).cast("bigint")), shared_folder(spark, "cache"), ["key"])
    fresh = latest(["put_at", "chars"]) | {"hits": F.when(F.col("has_new"), 0).otherwise(F.col("old.hits"))}
    table.merge(put, fresh, operation="put")
    got = p.where("page_id % 3 = 0").groupBy("key").agg(F.count("*").alias("n"))
    table.merge(got, {"hits": F.coalesce("old.hits", F.lit(0)) + F.coalesce("new.n", F.lit(0))}, keep=F.col("has_old"), operation="get")
    there = table.read()
    oldest = there.orderBy("put_at").limit(there.count() // 4).select("key")
    table.merge(oldest, {}, keep=~F.col("has_new"), operation="evict")
    return table.read()
