"""Queries of the text problems and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from . import groups, markup, mix, pack, split, toxicity

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles over 512 tokens, and sentences over it."""
    return split.oversized(split.article_lengths(table(spark, d, "articles"))).distinct()


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All articles in pieces of at most 512 tokens, by token offset and with their words."""
    return split.article_pieces(table(spark, d, "articles"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with the first mention of its group."""
    return groups.mention_groups(table(spark, d, "articles"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Headings, list items, code blocks and formulas of every page, numbered per kind."""
    return markup.elements(table(spark, d, "raw_articles"))


@query
def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every page with its structure."""
    return markup.texts(table(spark, d, "raw_articles"))


@query
def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text with its container of 2,048 tokens."""
    return pack.pack(table(spark, d, "documents"))


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and their fill."""
    return pack.pack_report(pack.pack(table(spark, d, "documents")))


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of each text in the mixture."""
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mix.mixture_report(cut_lineage(mix.mixture(docs, targets)), docs, targets)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual passage."""
    return _scores(spark, d).where("flagged").select("doc_id").distinct()


@query
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document."""
    return _scores(spark, d).select("doc_id", F.round("score", 6).alias("score"), "flagged")


@query
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of such documents per source."""
    return toxicity.rates(_scores(spark, d))


ORACLES["p3_found"] = r"""
WITH latest AS (SELECT article_id, tokens FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY ingested_at DESC) AS rn FROM articles WHERE article_id IS NOT NULL) WHERE rn = 1),
sent AS (SELECT article_id, unnest(tokens) AS s, unnest(range(len(tokens))) AS sent_no FROM latest),
n AS (SELECT article_id, sent_no, len(list_filter(coalesce(s, []), lambda t: t IS NOT NULL AND NOT regexp_matches(t, '^[\s\p{Z}\x{0085}\x{001c}-\x{001f}]*$'))) AS n FROM sent)
SELECT DISTINCT article_id, CAST(sent_no AS INTEGER) AS sent_no FROM n WHERE n > 512
UNION ALL SELECT article_id, -1 FROM n GROUP BY article_id HAVING sum(n) > 512"""

_BLANK = r"^[\s\p{Z}\x{0085}\x{001c}-\x{001f}]*$"
ORACLES["p3_pieces"] = rf"""
WITH RECURSIVE real AS (SELECT article_id, ingested_at, list_transform(coalesce(tokens, []), lambda s: list_filter(coalesce(s, []), lambda t: t IS NOT NULL AND NOT regexp_matches(t, '{_BLANK}'))) AS toks FROM articles WHERE article_id IS NOT NULL),
latest AS (SELECT article_id, toks FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY ingested_at DESC, list_transform(toks, lambda s: len(s)) DESC) AS rn FROM real) WHERE rn = 1),
lens AS (SELECT article_id, flatten(toks) AS words, len(flatten(toks)) AS total, list_transform(range(1, len(toks) + 1), lambda i: CAST(list_sum(list_transform(toks[1:i], lambda s: len(s))) AS BIGINT)) AS ends FROM latest),
walk AS (
  SELECT article_id, words, total, ends, 0 AS piece, CAST(0 AS BIGINT) AS b, coalesce(list_max(list_filter(ends, lambda x: x > 0 AND x <= 512)), least(512, total)) AS e FROM lens WHERE total > 0
  UNION ALL
  SELECT article_id, words, total, ends, piece + 1, s, CASE WHEN last > e THEN last ELSE least(s + 512, total) END
  FROM (SELECT *, coalesce(list_max(list_filter(ends, lambda x: x <= s + 512)), 0) AS last
    FROM (SELECT *, e - least(e - coalesce(list_max(list_filter(ends, lambda x: x < e)), 0), 32) AS s FROM walk WHERE e < total)))
SELECT article_id, CAST(piece AS INTEGER) AS piece, b AS "start", CAST(e AS BIGINT) AS "end", CAST(len(list_filter(ends, lambda x: x <= b)) AS INTEGER) AS first_sentence, CAST(len(list_filter(ends, lambda x: x < e)) AS INTEGER) AS last_sentence,
  array_to_string(words[b + 1:e], ' ') AS text FROM walk"""

# labels go round until nothing changes, in at most as many rounds as an article has clusters
ORACLES["p4_found"] = """
WITH RECURSIVE c AS (SELECT article_id, row_number() OVER () AS cno, unnest(c) AS m FROM (SELECT article_id, unnest(clusters) AS c FROM articles WHERE article_id IS NOT NULL)),
m AS (SELECT DISTINCT article_id, cno, m.start AS s, m.end AS e FROM c WHERE m.start IS NOT NULL AND m.end IS NOT NULL),
near AS (SELECT DISTINCT a.article_id, a.cno AS x, b.cno AS y FROM m a JOIN m b ON a.article_id = b.article_id AND a.s = b.s AND a.e = b.e),
reach AS (SELECT article_id, x, y FROM near UNION SELECT r.article_id, r.x, n.y FROM reach r JOIN near n ON n.article_id = r.article_id AND n.x = r.y),
root AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
g AS (SELECT DISTINCT m.article_id, root.root, s, e FROM m JOIN root ON root.x = m.cno)
SELECT article_id, s AS m_start, e AS m_end, first_value(s) OVER w AS g_start, first_value(e) OVER w AS g_end FROM g WINDOW w AS (PARTITION BY article_id, root ORDER BY s, e)"""
