"""Queries that join by parts of texts, of any length."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import contains as C
from sparkloom.plans.catalog import query
from sparkloom.sources.tables import read

_ASKS = "asks AS (SELECT substring(text, 1 + conv_id % 5, 1 + (conv_id * 7 + turn) % 15) AS ask, count(*) AS seen FROM conversations WHERE role = 'user' GROUP BY 1)"


@query("WITH " + _ASKS + """, said AS (SELECT lower(text) AS t FROM conversations WHERE role = 'assistant') SELECT ask, seen FROM asks WHERE ask IS NOT NULL AND NOT EXISTS (SELECT 1 FROM said WHERE ask <> '' AND contains(t, lower(ask)))""")
def j29_unanswered_asks(spark, sf_dir):
    """What users ask, of one to fifteen characters, that no answer holds in any case."""
    c = read(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    piece = F.substring("text", (1 + F.col("conv_id") % 5).cast("int"), (1 + (F.col("conv_id") * 7 + F.col("turn")) % 15).cast("int"))
    asks = c.where("role = 'user'").groupBy(piece.alias("ask")).agg(F.count("*").alias("seen")).where("ask is not null")
    return asks.join(C.held(asks, "ask", c.where("role = 'assistant'"), "id", "text"), "ask", "left_anti")


@query("""WITH n AS (SELECT DISTINCT right(url, 1 + page_id % 12) AS ending FROM pages WHERE url IS NOT NULL) SELECT ending, count(*) AS pages, min(page_id) AS first FROM n JOIN pages ON ending <> '' AND ends_with(lower(url), lower(ending)) GROUP BY 1""")
def p03_suffix_join(spark, sf_dir):
    """Addresses by their ends of one to twelve characters."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    ends = p.select(F.right("url", (1 + F.col("page_id") % 12).cast("int")).alias("ending"))
    return C.ending(ends, "ending", p, "page_id", "url").groupBy("ending").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


@query("""WITH q AS (SELECT DISTINCT CASE page_id % 9 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN upper(url) ELSE substring(url, 8 + page_id % 4, 5 + page_id % 11) END AS q FROM pages WHERE url IS NOT NULL),
    m AS (SELECT q, page_id, 0 AS tier FROM q JOIN pages ON q = CAST(page_id AS VARCHAR) UNION ALL SELECT q, page_id, 1 FROM q JOIN pages ON lower(q) = lower(url) UNION ALL SELECT q, page_id, 2 FROM q JOIN pages ON q <> '' AND contains(lower(url), lower(q))),
    o AS (SELECT q, page_id, min(tier) AS tier FROM m GROUP BY 1, 2)
    SELECT q, page_id, tier::INT AS tier FROM o QUALIFY row_number() OVER (PARTITION BY q ORDER BY tier, page_id) <= 7""")
def p10_like_cascade(spark, sf_dir):
    """Pages for what is asked: by id, by address in any case, then by any part of it; each once, at most seven for each."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    asked = F.when(k % 9 == 0, k.cast("string")).when(k % 9 == 1, F.upper("url")).otherwise(F.substring("url", (8 + k % 4).cast("int"), (5 + k % 11).cast("int")))
    q = p.where("url is not null").select(asked.alias("q")).distinct()
    by_id = q.join(p.select("page_id", k.cast("string").alias("q")), "q").select("q", "page_id", F.lit(0).alias("tier"))
    by_name = q.withColumn("low", F.lower("q")).join(p.select("page_id", F.lower("url").alias("low")), "low").select("q", "page_id", F.lit(1).alias("tier"))
    parts = C.contained(q, "q", p, "page_id", "url").withColumn("tier", F.lit(2))
    best = by_id.unionByName(by_name).unionByName(parts).groupBy("q", "page_id").agg(F.min("tier").alias("tier"))
    place = F.row_number().over(W.partitionBy("q").orderBy("tier", "page_id"))  # at most seven of each task's rows are shuffled
    return best.withColumn("place", place).where("place <= 7").select("q", "page_id", "tier")
