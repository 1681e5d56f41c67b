"""Queries of code search: pages are the files, a line begins at each tag, and their trigrams are indexed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import search as S
from sparkloom.plans.catalog import query
from sparkloom.sources.tables import read

_LINES = "l AS (SELECT coalesce(url, '') AS path, string_split(replace(coalesce(html, ''), '<', chr(10) || '<'), chr(10)) AS ls FROM pages), i AS (SELECT path, ls, generate_subscripts(ls, 1) AS i FROM l)"


def _index(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("url", F.replace("html", F.lit("<"), F.lit("\n<")).alias("html"))
    return S.build(pages, "url", "html", "tags")


@query("WITH " + _LINES + r""" SELECT path, i AS line, true AS hit, ls[i] AS text FROM i WHERE regexp_matches(ls[i], 'track\((1|2)[0-9]?\)|<title>(The|Ein)')""")
def r25_search_extended(spark, sf_dir):
    """Lines that fit an extended expression; blocks without the trigrams of either side aren't read."""
    return S.search(_index(spark, sf_dir), S.Search(r"track\((1|2)[0-9]?\)|<title>(The|Ein)"))


@query("WITH " + _LINES + r""", h AS (SELECT path, len(list_filter(ls, lambda x: regexp_matches(x, '(?i)\bAD\b'))) AS hits FROM l) SELECT path, hits FROM h WHERE hits > 0""")
def r25_search_word_count(spark, sf_dir):
    """How many lines of each file have a word, in any case; two letters need no trigram, so all are read."""
    return S.search(_index(spark, sf_dir), S.Search("AD", kind="fixed", word=True, ignore_case=True, output="count"))


@query("WITH " + _LINES + r""", h AS (SELECT path, len(list_filter(ls, lambda x: contains(x, '="/the,">'))) AS hits FROM l) SELECT path, hits FROM h WHERE hits > 0""")
def r25_search_fixed_count(spark, sf_dir):
    """How many lines of each file have a text as it stands, signs and all."""
    return S.search(_index(spark, sf_dir), S.Search('="/the,">', kind="fixed", output="count"))


@query("WITH " + _LINES + r""" SELECT path FROM l WHERE len(list_filter(ls, lambda x: regexp_matches(x, '(?i)lang="(de|fr)"|^<h1>the'))) > 0""")
def r25_search_basic_files(spark, sf_dir):
    """Files with a line that fits a basic expression in any case."""
    return S.search(_index(spark, sf_dir), S.Search(r'lang="\(de\|fr\)"\|^<h1>THE', kind="basic", ignore_case=True, output="files"))


@query("WITH " + _LINES + r""", h AS (SELECT *, regexp_matches(ls[i], '^<h1>') AS hit FROM i WHERE regexp_matches(path, '/(en|de)/[^/]*$') OR regexp_matches(path, '(^|/)[^/][^/]#[^/]*$')),
    n AS (SELECT path, ls, i, hit, len(list_filter(range(greatest(i - 1, 1), least(i + 1, len(ls)) + 1), lambda j: regexp_matches(ls[j], '^<h1>'))) > 0 AS near FROM h) SELECT path, i AS line, hit, ls[i] AS text FROM n WHERE near""")
def r25_f25_search_context(spark, sf_dir):
    """Headings with a line on each side, in the files that one of two globs fits."""
    return S.search(_index(spark, sf_dir), S.Search("^<h1>", context=1, glob="{en,de}/*, ??#*"))


@query(r"""WITH p AS (SELECT DISTINCT coalesce(url, '') AS path FROM pages) SELECT path, regexp_matches(path, '(^|/)[^/]*\.(php|html)$') AS kind, regexp_matches(path, '(^|/)en/.*$') AS below, regexp_matches(path, '(^|/)(fr|e[^/])/[^/]*[^/]page=[^/]*$') AS ask, regexp_matches(path, '(^|/)[^/]*#top$|(^|/)de/[^/]$') AS either FROM p""")
def f25_glob_language(spark, sf_dir):
    """The language of globs on all paths: alternatives, any depth, one sign, several globs."""
    paths = read(spark, sf_dir, "pages").select(F.coalesce("url", F.lit("")).alias("path")).distinct()
    globs = {"kind": "*.{php,html}", "below": "en/**", "ask": r"{fr,e?}\*?page=*", "either": "*#top, de/?"}
    return paths.select("path", *(F.col("path").rlike(S.glob_pattern(g)).alias(n) for n, g in globs.items()))
