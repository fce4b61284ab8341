"""Queries of the engine's own operators over the knowledge graph and the annotated articles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals, text
from ..operators import annotate, curate, documents, kg, stats
from ..session import table

QUERIES = {}
ORACLES = {}
POINT_IN_TIME = "P7080"
#: thresholds at which every pruning rule removes some but not all edges of the test tables
MAX_AVG_FAN, MIN_COUNT = 1.1, 60


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def latest(df: DataFrame, at: str) -> DataFrame:
    """One row per article: the latest, of equally late ones the one with the longest lists."""
    cols = [c for c in df.columns if c != "article_id"]
    sizes = [F.coalesce(F.size(c), F.lit(-1)).alias(f"n_{c}") for c in ("nel", "clusters", "entities", "annotations") if c in cols]
    rows = df.where("article_id IS NOT NULL").groupBy("article_id").agg(F.max_by(F.struct(*cols), F.struct(at, *sizes, F.xxhash64(*cols).alias("h"))).alias("x"))
    return rows.select("article_id", "x.*")


def _annotations(spark: SparkSession, d: str, name: str = "annotations") -> DataFrame:
    return latest(table(spark, d, name), "loaded_at")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "articles"), "ingested_at")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "relation_db").where("subject IS NOT NULL")
    return e.select("edge_id", "subject", "ord", "prop", F.when(F.col("value.type") == "wikibase-entityid", F.col("value.value.id")).alias("object")).distinct()


def _wiki(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki_db").select(text.format_wikilink("title").alias("title"), "id").where("title IS NOT NULL AND id IS NOT NULL")


def _names(spark: SparkSession, d: str) -> DataFrame:
    known = stats.display_names(table(spark, d, "alias_db"))
    core = table(spark, d, "core_entities").select("id", F.col("label").alias("name"))
    props = table(spark, d, "property_list").select(F.col("prop").alias("id"), F.col("label").alias("name"))
    return known.unionByName(core).unionByName(props).groupBy("id").agg(F.min("name").alias("name"))


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY {at} DESC, {more}) AS rn FROM {t} WHERE article_id IS NOT NULL) WHERE rn = 1"
_ANN = _LATEST.format(at="loaded_at", t="annotations", more="coalesce(len(annotations), -1) DESC")
_ANN_B = _LATEST.format(at="loaded_at", t="annotations_b", more="coalesce(len(annotations), -1) DESC")
_ART = _LATEST.format(at="ingested_at", t="articles", more="coalesce(len(nel), -1) DESC, coalesce(len(clusters), -1) DESC, coalesce(len(entities), -1) DESC")
_EDGE = "SELECT DISTINCT edge_id, subject, ord, prop, CASE WHEN value.type = 'wikibase-entityid' THEN value.value.id END AS object FROM relation_db WHERE subject IS NOT NULL"
_MENTION = f"SELECT article_id, flatten(list_transform(tokens, lambda s: coalesce(s, []))) AS flat, unnest(annotations) AS a, unnest(range(len(annotations))) AS idx FROM ({_ANN})"
_PAIR = f"SELECT article_id, flat, idx, a, unnest(a.relation[1:least(len(a.relation), len(a.parent_id))]) AS relation, unnest(a.parent_id[1:least(len(a.relation), len(a.parent_id))]) AS parent, unnest(range(least(len(a.relation), len(a.parent_id)))) AS pair_no FROM ({_MENTION})"
_NAME = """SELECT id, min(name) AS name FROM (
  SELECT id, min(aliases[1]) AS name FROM alias_db WHERE len(aliases) > 0 GROUP BY id
  UNION ALL SELECT id, label FROM core_entities UNION ALL SELECT prop, label FROM property_list) GROUP BY id"""
_FAN = """SELECT relation, round(avg(fan), 6) AS avg_fan, round(coalesce(stddev_samp(fan), 0), 6) AS std_fan, max(fan) AS max_fan, min(fan) AS min_fan
  FROM (SELECT relation, s, count(DISTINCT o) AS fan FROM ({}) WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY ALL) GROUP BY relation"""
_LINK = "upper(substring(replace({0}, ' ', '_'), 1, 1)) || substring(replace({0}, ' ', '_'), 2)"
_WIKI = f"SELECT title, id FROM (SELECT {_LINK.format('title')} AS title, id FROM wiki_db WHERE length(title) > 0 AND id IS NOT NULL)"


# -- edges -------------------------------------------------------------------------------------------------
@query(_FAN.format(f"SELECT prop AS relation, subject AS s, object AS o FROM ({_EDGE})"))
def fan_stats_edges(spark: SparkSession, d: str) -> DataFrame:
    """AGG2, AGG4: fan-out of every relation."""
    return stats.fan_stats(_edges(spark, d))


@query(_FAN.format(f"SELECT relation, a.id AS s, parent AS o FROM ({_PAIR})"))
def fan_stats_annotations(spark: SparkSession, d: str) -> DataFrame:
    """AGG3: distinct parents per annotated child and relation."""
    return stats.annotated_fan(_annotations(spark, d))


@query(f"SELECT prop, round(avg(n), 6) AS avg_fan FROM (SELECT prop, subject, count(DISTINCT object) AS n FROM ({_EDGE}) WHERE object IS NOT NULL GROUP BY ALL) GROUP BY prop HAVING avg(n) >= {MAX_AVG_FAN}")
def prune_bad_relations(spark: SparkSession, d: str) -> DataFrame:
    """AGG5, FLT19."""
    return curate.bad_relations(_edges(spark, d), MAX_AVG_FAN).withColumn("avg_fan", F.round("avg_fan", 6))


@query(f"SELECT r AS prop, count(*) AS n FROM (SELECT unnest(a.relation) AS r FROM ({_MENTION})) GROUP BY r HAVING count(*) <= {MIN_COUNT}")
def prune_rare_relations(spark: SparkSession, d: str) -> DataFrame:
    """AGG6, FLT20."""
    return curate.rare_relations(_annotations(spark, d), MIN_COUNT)


@query(f"""WITH e AS ({_EDGE}), bad AS ({ORACLES['prune_bad_relations']}), rare AS ({ORACLES['prune_rare_relations']})
SELECT edge_id, subject, ord, prop, object FROM e WHERE NOT regexp_matches(prop, 'P.*:{POINT_IN_TIME}') AND NOT regexp_matches(prop, 'P7008')
AND prop NOT IN (SELECT prop FROM bad) AND prop NOT IN (SELECT prop FROM rare)""")
def prune_edges(spark: SparkSession, d: str) -> DataFrame:
    """FLT17-20, JN18: all rules together."""
    return curate.prune_edges(_edges(spark, d), _annotations(spark, d), [f"P.*:{POINT_IN_TIME}", "P7008"], MAX_AVG_FAN, MIN_COUNT)


@query(f"SELECT object AS subject, 'R:' || prop AS prop, subject AS object FROM ({_EDGE}) WHERE object IS NOT NULL")
def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    """PRJ4."""
    return kg.reverse_edges(_edges(spark, d))


@query(f"SELECT subject, prop, object FROM ({_EDGE}) WHERE object IS NOT NULL UNION ALL SELECT object, 'R:' || prop, subject FROM ({_EDGE}) WHERE object IS NOT NULL")
def edges_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """SET1: main and qualified edges united with their reverse ones."""
    e = _edges(spark, d).where("object IS NOT NULL").select("subject", "prop", "object")
    return e.unionByName(kg.reverse_edges(e))


@query(f"""SELECT prop, prop LIKE 'R:%' AS is_reverse, split_part(b, ':', 1) AS main, nullif(split_part(b, ':', 2), '') AS qualifier, count(*) AS n
FROM (SELECT prop, CASE WHEN prop LIKE 'R:%' THEN substring(prop, 3) ELSE prop END AS b FROM ({_EDGE})) GROUP BY ALL""")
def qualified_properties(spark: SparkSession, d: str) -> DataFrame:
    """D6: property strings taken apart, with their edges."""
    back, main, qual = kg.split_property(F.col("prop"))
    return _edges(spark, d).select("prop", back.alias("is_reverse"), main.alias("main"), qual.alias("qualifier")).groupBy("prop", "is_reverse", "main", "qualifier").agg(F.count("*").alias("n"))


# -- entity dump -------------------------------------------------------------------------------------------
_DUMP = "SELECT line_no, CAST(t AS JSON) AS j FROM (SELECT line_no, trim(regexp_replace(regexp_replace(trim(line), '^\\[', ''), ',?\\s*\\]?$', '')) AS t FROM entity_dump) WHERE t LIKE '{%' AND json_valid(t)"
_TITLE = _LINK.format("json_extract_string(j, '$.sitelinks.enwiki.title')")


@query(f"SELECT title, max_by(id, line_no) AS id FROM (SELECT line_no, {_TITLE} AS title, json_extract_string(j, '$.id') AS id FROM ({_DUMP})) WHERE length(title) > 0 AND id IS NOT NULL GROUP BY title")
def kg_titles(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, FLT8, FLT12, FN1, AGG14: title table of the dump."""
    return kg.wiki_titles(table(spark, d, "entity_dump"))


@query(f"""SELECT id, max_by(array_to_string(names, '|'), line_no) AS aliases FROM (
  SELECT line_no, json_extract_string(j, '$.id') AS id, list_filter(list_concat([json_extract_string(j, '$.labels.en.value')],
    CASE WHEN json_type(j, '$.aliases.en') = 'ARRAY' THEN list_filter(list_transform(from_json(j->'$.aliases.en', '["JSON"]'), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.value') END), lambda x: x IS NOT NULL)
         WHEN json_type(j, '$.aliases.en') = 'OBJECT' THEN [json_extract_string(j, '$.aliases.en.value')] ELSE [] END), lambda x: x IS NOT NULL) AS names
  FROM ({_DUMP})) WHERE id IS NOT NULL AND len(names) > 0 GROUP BY id""")
def kg_aliases(spark: SparkSession, d: str) -> DataFrame:
    """PRJ1, FLT7, AGG14: alias table of the dump."""
    return kg.alias_lists(table(spark, d, "entity_dump")).select("id", F.array_join("aliases", "|").alias("aliases"))


@query(f"SELECT k.* FROM ({ORACLES['kg_aliases']}) k WHERE NOT starts_with(k.id, 'Q') OR k.id IN (SELECT id FROM wiki_db)")
def kg_aliases_allowed(spark: SparkSession, d: str) -> DataFrame:
    """FLT1: alias table of the entities that an allow-list names."""
    allowed = table(spark, d, "wiki_db").select("id").where("id IS NOT NULL").distinct()
    return kg.alias_lists(table(spark, d, "entity_dump"), allowed).select("id", F.array_join("aliases", "|").alias("aliases"))


_GOOD = """json_type({0}, '$.datavalue') = 'OBJECT' AND coalesce(json_extract_string({0}, '$.datatype'), '') NOT IN (""" + ", ".join(f"'{x}'" for x in kg.BAD_DATATYPES) + """)
    AND NOT (coalesce(json_extract_string({0}, '$.datatype'), '') = 'monolingualtext' AND coalesce(json_extract_string({0}, '$.datavalue.value.language'), '') <> 'en')"""


def _groups(field: str, prop: str, keep: str, source: str) -> str:
    """(keep, g, key, no, x): elements of a field that is a map of lists or of single elements, or a list of elements that name their property."""
    text = f"CASE WHEN json_type({field}) = 'VARCHAR' THEN TRY_CAST(json_extract_string({field}, '$') AS JSON) ELSE {field} END"
    return f"""SELECT {keep}, g, key, unnest(range(len(xs))) AS no, unnest(xs) AS x FROM (SELECT {keep}, g, key, CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END AS xs FROM (
    SELECT {keep}, unnest(range(len(map_keys(m)))) AS g, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS v FROM (SELECT {keep}, CAST(f AS MAP(VARCHAR, JSON)) AS m FROM (SELECT {keep}, {text} AS f FROM {source}) WHERE json_type(f) = 'OBJECT')))
  UNION ALL SELECT {keep}, g, {prop} AS key, 0 AS no, x FROM (SELECT {keep}, unnest(range(json_array_length(f)::BIGINT)) AS g, unnest(CAST(f AS JSON[])) AS x FROM (SELECT {keep}, {text} AS f FROM {source}) WHERE json_type(f) = 'ARRAY')"""


def _edges_sql(where_subject: str, where_prop: str) -> str:
    return f"""WITH lines AS ({_DUMP}),
ents AS (
  SELECT line_no, 0 AS part, json_extract_string(j, '$.id') AS subject, j->'$.claims' AS claims FROM lines WHERE coalesce(json_type(j, '$.entities'), 'NULL') = 'NULL'
  UNION ALL SELECT line_no, part, coalesce(nullif(json_extract_string(e, '$.id'), ''), key), e->'$.claims' FROM (SELECT line_no, unnest(range(len(map_keys(m)))) AS part, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS e FROM (
    SELECT line_no, CAST(j->'$.entities' AS MAP(VARCHAR, JSON)) AS m FROM lines WHERE json_type(j, '$.entities') = 'OBJECT'))
  UNION ALL SELECT line_no, part, json_extract_string(e, '$.id'), e->'$.claims' FROM (SELECT line_no, unnest(range(json_array_length(j, '$.entities')::BIGINT)) AS part, unnest(CAST(j->'$.entities' AS JSON[])) AS e FROM lines WHERE json_type(j, '$.entities') = 'ARRAY')
), known AS (SELECT * FROM ents WHERE subject IS NOT NULL AND {where_subject}),
c AS (SELECT line_no, part, subject, g, key AS prop, no, x FROM ({_groups("claims", "json_extract_string(x, '$.mainsnak.property')", "line_no, part, subject", "known")}) WHERE key IS NOT NULL AND {where_prop} AND {_GOOD.format("(x->'$.mainsnak')")}),
q AS (SELECT line_no, part, subject, g0, no0, prop, g, key, no, x FROM ({_groups("ql", "json_extract_string(x, '$.property')", "line_no, part, subject, g0, no0, prop", "(SELECT line_no, part, subject, g AS g0, no AS no0, prop, x->'$.qualifiers' AS ql FROM c)")}) WHERE key IS NOT NULL AND {_GOOD.format("x")}),
every AS (SELECT line_no, part, subject, g, no, -1 AS q, CAST(-1 AS BIGINT) AS k, prop, x->'$.mainsnak.datavalue' AS dv FROM c
  UNION ALL SELECT line_no, part, subject, g0, no0, g, row_number() OVER (PARTITION BY line_no, part, subject, g0, no0, g ORDER BY no) - 1, prop || ':' || key, x->'$.datavalue' FROM q)
SELECT line_no, subject, CAST(row_number() OVER (PARTITION BY line_no, subject ORDER BY part, g, no, q, k) - 1 AS INTEGER) AS ord, prop, json_extract_string(dv, '$.type') AS value_type,
  CASE WHEN json_type(dv, '$.value') = 'VARCHAR' THEN json_extract_string(dv, '$.value') ELSE CAST(dv->'$.value' AS VARCHAR) END AS value FROM every"""


@query(_edges_sql("true", "true"))
def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    """PRJ2, PRJ3, FLT4-6: edge table of the dump, qualifiers behind their claim."""
    return kg.edges(table(spark, d, "entity_dump"))


@query(_edges_sql("subject IN (SELECT id FROM wiki_db)", "key IN (SELECT prop FROM property_list WHERE dimension IS NOT NULL)"))
def kg_edges_allowed(spark: SparkSession, d: str) -> DataFrame:
    """FLT2, FLT3, JN8: edges of the entities and properties that allow-lists name."""
    allowed = table(spark, d, "wiki_db").select("id").where("id IS NOT NULL").distinct()
    return kg.edges(table(spark, d, "entity_dump"), allowed, table(spark, d, "property_list").where("dimension IS NOT NULL").select("prop"))


@query(f"SELECT title, {_LINK.format('title')} AS link, upper(substring(replace(title, ' ', '_'), 1, 1)) || lower(substring(replace(title, ' ', '_'), 2)) AS redirect, count(*) AS n FROM wiki_db WHERE length(title) > 0 GROUP BY ALL")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    """FN1, FN2: both key forms of every title."""
    t = table(spark, d, "wiki_db").where("length(title) > 0")
    return t.groupBy("title", text.format_wikilink("title").alias("link"), text.redirect_title("title").alias("redirect")).agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT title, min(id) AS id FROM ({_WIKI}) GROUP BY title),
r AS (SELECT DISTINCT {_LINK.format("a[2]")} AS title, {_LINK.format("a[1]")} AS target FROM (SELECT aliases AS a FROM alias_db WHERE len(aliases) > 1))
SELECT title, id FROM w UNION ALL
SELECT r.title, min(w.id) AS id FROM r JOIN w ON w.title = r.target WHERE r.title NOT IN (SELECT title FROM w) GROUP BY r.title""")
def redirect_titles(spark: SparkSession, d: str) -> DataFrame:
    """JN7, SET5: second aliases taken as redirects to the first."""
    w = _wiki(spark, d).groupBy("title").agg(F.min("id").alias("id"))
    r = table(spark, d, "alias_db").where("size(aliases) > 1").select(F.get("aliases", 1).alias("from_title"), F.get("aliases", 0).alias("to_title")).distinct()
    return kg.add_redirects(w, r)


# -- annotations -------------------------------------------------------------------------------------------
@query("SELECT DISTINCT e.id AS id FROM (SELECT unnest(entities) AS e FROM articles) WHERE e.id IS NOT NULL")
def list_entities(spark: SparkSession, d: str) -> DataFrame:
    """AGG1, SNK10."""
    return stats.list_entities(table(spark, d, "articles"))


@query(f"SELECT r AS relation, count(*) AS n FROM (SELECT unnest(a.relation) AS r FROM ({_MENTION})) GROUP BY r")
def relation_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG6."""
    return stats.relation_counts(_annotations(spark, d))


@query(f"SELECT CASE WHEN relation IN ('@@REFLEXIVE@@', '@@NEW@@') THEN relation ELSE '@@STORY@@' END AS generator, count(*) AS n FROM ({_PAIR}) GROUP BY ALL")
def generator_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG7, FLT27, JN13, PRJ12."""
    return stats.generator_counts(_annotations(spark, d))


@query(f"""WITH nm AS ({_NAME}), p AS (SELECT relation, article_id, idx, pair_no FROM ({_PAIR}) WHERE relation NOT IN ('@@REFLEXIVE@@', '@@NEW@@')),
shown AS (SELECT relation, string_agg(coalesce(n.name, part), ' : ' ORDER BY i) AS readable FROM (
  SELECT relation, unnest(string_split(relation, ':')) AS part, unnest(range(len(string_split(relation, ':')))) AS i FROM (SELECT DISTINCT relation FROM p)) LEFT JOIN nm n ON n.id = part GROUP BY relation),
h AS (SELECT s.readable, count(*) AS n, min((p.article_id, p.idx, p.pair_no)) AS seen FROM p JOIN shown s USING (relation) GROUP BY s.readable)
SELECT CAST(row_number() OVER (ORDER BY n DESC, seen) AS INTEGER) AS rank, readable, n FROM h""")
def readable_histogram(spark: SparkSession, d: str) -> DataFrame:
    """SRT2, AGG7: relations by their readable name, the most frequent first, of equally frequent ones the first seen."""
    return stats.readable_histogram(_annotations(spark, d), _names(spark, d))


_GAPS = f"""SELECT p.article_id, p.idx, p.pair_no, p.flat, p.a, p.relation, p.parent, max_by(s.a, s.idx) AS last
  FROM ({_PAIR}) p JOIN ({_MENTION}) s ON s.article_id = p.article_id AND s.a.id = p.parent AND s.idx < p.idx
  WHERE p.relation NOT IN ('@@REFLEXIVE@@', '@@NEW@@') GROUP BY ALL"""


@query(f"""WITH g AS (SELECT a.span[2] - last.span[1] AS length, count(*) AS n FROM ({_GAPS}) GROUP BY ALL)
SELECT CAST(length AS INTEGER) AS length, n, round(sum(n) OVER (ORDER BY length) / sum(n) OVER (), 6) AS cdf FROM g WHERE length IS NOT NULL""")
def length_cdf(spark: SparkSession, d: str) -> DataFrame:
    """AGG8, WIN6, WIN7, SRT3."""
    return stats.length_cdf(_annotations(spark, d))


_PER = f"""SELECT coalesce(list_sum(list_transform(tokens, lambda s: coalesce(len(s), 0))), 0) AS tokens, coalesce(len(ann), 0) AS n,
  len(list_filter(ann, lambda a: a.relation = ['@@NEW@@'])) AS nw, len(list_filter(ann, lambda a: list_contains(coalesce(a.relation, []), '@@REFLEXIVE@@'))) AS reflexive,
  len(list_filter(ann, lambda a: len(list_filter(coalesce(a.relation, []), lambda r: r NOT IN ('@@NEW@@', '@@REFLEXIVE@@'))) > 0)) AS related,
  len(list_filter(ann, lambda a: a.source = 'WIKI')) AS wiki, len(list_filter(ann, lambda a: a.source = 'NEL')) AS nel, len(list_filter(ann, lambda a: a.source = 'COREF')) AS coref, len(list_filter(ann, lambda a: a.source = 'KG')) AS kg,
  (SELECT count(DISTINCT coalesce(x.id, '<null>')) FROM (SELECT unnest(ann) AS x)) AS ids, list_max(list_transform(ann, lambda a: a.span[2] - a.span[1])) AS longest
  FROM (SELECT tokens, list_filter(annotations, lambda a: a IS NOT NULL) AS ann FROM ({_ANN}))"""


@query(f"""SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS annotations, round(sum(n) / count(*), 6) AS per_page, round(sum(reflexive) / sum(n), 6) AS p_reflexive, round(sum(wiki) / sum(n), 6) AS p_wiki,
round(sum(nel) / sum(n), 6) AS p_nel, round(sum(coref) / sum(n), 6) AS p_coref, round(sum(kg) / sum(n), 6) AS p_kg, round(sum(nw) / sum(n), 6) AS p_new, round(sum(related) / sum(n), 6) AS p_related,
CAST(max(ids) AS INTEGER) AS max_entities, CAST(max(longest) AS INTEGER) AS max_mention FROM ({_PER})""")
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG9, SNK9."""
    return stats.summary(_annotations(spark, d))


@query(f"SELECT a.source AS source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_MENTION}) WHERE a.relation = ['@@NEW@@'] GROUP BY a.source")
def source_given_new(spark: SparkSession, d: str) -> DataFrame:
    """AGG10."""
    return stats.source_given_new(_annotations(spark, d))


@query(f"""WITH m AS ({_MENTION}), p AS ({_PAIR}),
l AS (SELECT p.article_id, p.idx, p.pair_no, p.a, p.flat, p.relation, p.parent, max_by(s.a.span[2], s.idx) AS last
  FROM p JOIN m s ON s.article_id = p.article_id AND s.a.id = p.parent AND s.idx <= p.idx GROUP BY ALL)
SELECT article_id, CAST(idx AS INTEGER) AS idx, CAST(pair_no AS INTEGER) AS pair_no, a.id AS id, relation, parent FROM l
WHERE array_to_string(flat[a.span[1] + 1:a.span[2]], ' ') NOT IN ('.', '"') AND NOT regexp_matches(relation, '^.*{POINT_IN_TIME}$') AND a.span[1] - last <= 30""")
def manual_deletions(spark: SparkSession, d: str) -> DataFrame:
    """FLT21-24, JN12, WIN5."""
    return curate.manual_deletions(_annotations(spark, d), point_in_time=POINT_IN_TIME)


def _split_lists(titles: DataFrame) -> list[DataFrame]:
    h = F.substring(F.md5("title"), 1, 1)
    return [titles.where(h.isin(*which)).select("title") for which in ("01", "12", "3")]


@query("""WITH o AS (SELECT DISTINCT article_id, title, loaded_at FROM annotations WHERE title IS NOT NULL),
x AS (SELECT article_id, title, loaded_at, substring(md5(title), 1, 1) AS h, row_number() OVER (PARTITION BY title ORDER BY article_id, loaded_at) AS nth FROM o),
y AS (SELECT *, h IN ('0', '1') AS v, h IN ('1', '2') AS t, h = '3' AS m FROM x)
SELECT article_id, title, loaded_at, CASE WHEN v AND nth = 1 THEN 'valid' WHEN t AND nth = 1 + v::INT THEN 'test' ELSE 'train' END AS split, m AND nth = 1 AS mini FROM y""")
def split_by_title(spark: SparkSession, d: str) -> DataFrame:
    """JN17, WIN8, SET6: every document in its split; the lists are drawn from the titles by digest."""
    docs = table(spark, d, "annotations").where("title IS NOT NULL").select("article_id", "title", "loaded_at").distinct()
    return curate.split_by_title(docs.withColumn("at", F.struct("article_id", "loaded_at")), *_split_lists(docs.select("title").distinct()), order="at").drop("at")


@query("""WITH listed AS (SELECT DISTINCT title FROM wiki_db WHERE title IS NOT NULL) SELECT title FROM listed WHERE title NOT IN (SELECT title FROM annotations WHERE title IS NOT NULL)""")
def unused_titles(spark: SparkSession, d: str) -> DataFrame:
    """SET6: listed titles that no document has."""
    return curate.unused_titles(table(spark, d, "annotations"), table(spark, d, "wiki_db").where("title IS NOT NULL").select("title").distinct())


@query(f"SELECT article_id, len(tokens) AS sentences FROM ({_ART}) WHERE len(tokens) > 0")
def documents_with_tokens(spark: SparkSession, d: str) -> DataFrame:
    """FLT10: documents that have any sentence."""
    return curate.with_tokens(_articles(spark, d)).select("article_id", F.size("tokens").cast("long").alias("sentences"))


@query(f"""WITH a AS (SELECT article_id, pos, max_by(x.id, idx) AS id, max_by(x.source, idx) AS source FROM (SELECT article_id, idx, a AS x, unnest(range(a.span[1], a.span[2])) AS pos FROM ({_MENTION})) GROUP BY ALL),
b AS (SELECT article_id, pos, max_by(x.id, idx) AS id, max_by(x.source, idx) AS source FROM (SELECT article_id, idx, a AS x, unnest(range(a.span[1], a.span[2])) AS pos FROM ({_MENTION.replace(_ANN, _ANN_B)})) GROUP BY ALL),
same AS (SELECT x.article_id FROM ({_ANN}) x JOIN ({_ANN_B}) y ON x.article_id = y.article_id AND x.tokens IS NOT DISTINCT FROM y.tokens)
SELECT article_id, CAST(pos AS INTEGER) AS pos, a.id AS id_a, a.source AS source_a, b.id AS id_b, b.source AS source_b FROM a FULL JOIN b USING (article_id, pos) WHERE article_id IN (SELECT article_id FROM same)""")
def token_diff(spark: SparkSession, d: str) -> DataFrame:
    """JN16, FLT35, D18: annotations of both systems token by token, for articles with equal tokens."""
    a, b = _annotations(spark, d), _annotations(spark, d, "annotations_b")
    return curate.token_diff(a, b).join(curate.same_tokens(a, b), "article_id", "left_semi")


@query(f"""WITH r AS (SELECT DISTINCT relation FROM ({_PAIR}) WHERE relation IS NOT NULL), p AS (SELECT relation, unnest(string_split(relation, ':')) AS part, unnest(range(len(string_split(relation, ':')))) AS i FROM r)
SELECT relation, string_agg(coalesce(n.name, part), ' : ' ORDER BY i) AS readable FROM p LEFT JOIN ({_NAME}) n ON n.id = part GROUP BY relation""")
def readable_relations(spark: SparkSession, d: str) -> DataFrame:
    """FN9, JN15."""
    pairs = stats.story_pairs(stats.mentions(_annotations(spark, d)))
    return stats.readable_relations(pairs.select(F.col("pair.relation").alias("relation")), _names(spark, d))


@query(f"""WITH nm AS ({_NAME}), p AS ({_PAIR}),
shown AS (SELECT relation, string_agg(CASE WHEN part LIKE 'R%' THEN 'Reverse' ELSE coalesce(n.name, '') END, ':' ORDER BY i) AS readable
  FROM (SELECT relation, unnest(string_split(relation, ':')) AS part, unnest(range(len(string_split(relation, ':')))) AS i FROM (SELECT DISTINCT relation FROM p WHERE relation IS NOT NULL)) LEFT JOIN nm n ON n.id = part GROUP BY relation),
g AS (SELECT article_id, idx, string_agg(p.parent, ', ' ORDER BY coalesce(p.parent, '') || coalesce(p.relation, ''), pair_no) AS parents,
    string_agg(coalesce(n.name, ''), ', ' ORDER BY coalesce(p.parent, '') || coalesce(p.relation, ''), pair_no) AS parent_names,
    string_agg(p.relation, ', ' ORDER BY coalesce(p.parent, '') || coalesce(p.relation, ''), pair_no) AS relations,
    string_agg(coalesce(s.readable, ''), ', ' ORDER BY coalesce(p.parent, '') || coalesce(p.relation, ''), pair_no) AS readable
  FROM p LEFT JOIN nm n ON n.id = p.parent LEFT JOIN shown s ON s.relation = p.relation GROUP BY ALL)
SELECT m.article_id, CAST(m.idx AS INTEGER) AS idx, m.a.id AS id, coalesce(n.name, '') AS name, coalesce(parents, '') AS parents, coalesce(parent_names, '') AS parent_names, coalesce(relations, '') AS relations, coalesce(readable, '') AS readable
FROM ({_MENTION}) m LEFT JOIN g ON g.article_id = m.article_id AND g.idx = m.idx LEFT JOIN nm n ON n.id = m.a.id""")
def readable_annotations(spark: SparkSession, d: str) -> DataFrame:
    """PRJ11, FN10, SRT5, JN14, D19."""
    return stats.readable_annotations(_annotations(spark, d), _names(spark, d))


@query(f"""SELECT relation, rank, article_id, CAST(idx AS INTEGER) AS idx, CAST(a.span[2] - last.span[1] AS INTEGER) AS length,
  '[[ ' || concat_ws(' | ', array_to_string(flat[last.span[1] + 1:last.span[2]], ' '), coalesce(pn.name, parent), last.source) || ' ]] ' || array_to_string(flat[last.span[2] + 1:a.span[1]], ' ')
  || ' [[ ' || concat_ws(' | ', array_to_string(flat[a.span[1] + 1:a.span[2]], ' '), coalesce(cn.name, a.id), a.source) || ' ]]' AS excerpt
FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY article_id, idx, pair_no) AS rank FROM ({_GAPS}) WHERE a.span[2] - last.span[1] < 40) g
LEFT JOIN ({_NAME}) pn ON pn.id = g.parent LEFT JOIN ({_NAME}) cn ON cn.id = g.a.id WHERE rank <= 5""")
def relation_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ10, AGG15, SRT6, FLT28, SNK7: the first five excerpts of every relation (the top-k is the report)."""
    return stats.excerpts(_annotations(spark, d), _names(spark, d), 5, 40)


_LOCS = f"SELECT article_id AS doc, a.id AS child, a.span[1] AS loc FROM ({_MENTION}) WHERE a.id IS NOT NULL AND a.span[1] IS NOT NULL"


@query(f"""WITH m AS (SELECT DISTINCT * FROM ({_LOCS})), e AS (SELECT DISTINCT object, prop, subject FROM ({_EDGE}) WHERE object IS NOT NULL),
p AS (SELECT q.doc, q.child, q.loc, e.prop, s.child AS parent, max(s.loc) AS seen FROM m q JOIN e ON e.object = q.child JOIN m s ON s.doc = q.doc AND s.child = e.subject AND s.loc <= q.loc GROUP BY q.doc, q.child, q.loc, e.prop, s.child)
SELECT doc, child, loc, row_number() OVER (PARTITION BY doc, child, loc ORDER BY loc - seen, prop, parent) AS rank, prop, parent, loc - seen AS dist FROM p QUALIFY rank <= 10""")
def nearest_parents_topk(spark: SparkSession, d: str) -> DataFrame:
    """SRT1, JN11: the ten nearest parents of each mention, by their last mention up to it."""
    m = stats.mentions(_annotations(spark, d)).select(F.col("article_id").alias("doc"), F.col("a.id").alias("child"), F.get("a.span", 0).alias("loc")).where("child IS NOT NULL AND loc IS NOT NULL").distinct()
    links = _edges(spark, d).where("object IS NOT NULL").select(F.col("subject").alias("parent"), "prop", F.col("object").alias("child")).distinct()
    return stats.nearest_parents(m, links, 10)


# -- documents ---------------------------------------------------------------------------------------------
@query(f"""SELECT article_id, CAST(i AS INTEGER) AS window_no, array_to_string(list_transform(tokens[i + 1:i + 3], lambda s: array_to_string(coalesce(s, []), ' ')), ' / ') AS window_text
FROM (SELECT article_id, tokens, unnest(range(len(tokens) - 2)) AS i FROM ({_ART}))""")
def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    """WIN1, FN6."""
    w = documents.window_rows(_articles(spark, d))
    said = F.array_join(F.transform("sentences", lambda s: F.array_join(F.coalesce(s, F.array().cast("array<string>")), " ")), " / ")
    return w.select("article_id", "window_no", said.alias("window_text"))


@query(f"""SELECT article_id, CAST(i AS INTEGER) AS sent_no, CAST(coalesce(sum(n) OVER (PARTITION BY article_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS token_offset
FROM (SELECT article_id, unnest(range(len(tokens))) AS i, coalesce(len(unnest(tokens)), 0) AS n FROM ({_ART}))""")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """WIN2, PRJ8."""
    return _articles(spark, d).select("article_id", F.posexplode(text.sentence_offsets("tokens")).alias("sent_no", "token_offset"))


_TOKENS = f"SELECT article_id, unnest(range(len(flat))) AS pos, unnest(flat) AS token FROM (SELECT article_id, flatten(list_transform(tokens, lambda s: coalesce(s, []))) AS flat FROM ({_ART}))"
_STAMP = f"SELECT article_id, pos, max_by(id, no) AS id FROM (SELECT article_id, no, e.id AS id, unnest(range(e.start, e.end)) AS pos FROM (SELECT article_id, unnest(entities) AS e, unnest(range(len(entities))) AS no FROM ({_ART}))) GROUP BY ALL"


@query(f"SELECT t.article_id, CAST(t.pos AS INTEGER) AS pos, t.token, s.id FROM ({_TOKENS}) t LEFT JOIN ({_STAMP}) s ON s.article_id = t.article_id AND s.pos = t.pos")
def linked_tokens(spark: SparkSession, d: str) -> DataFrame:
    """PRJ5, PRJ7, JN9, ANN1: every token with the link that covers it."""
    return documents.token_rows(_articles(spark, d))


@query(f"""WITH t AS (SELECT t.article_id, t.pos, s.id FROM ({_TOKENS}) t LEFT JOIN ({_STAMP}) s ON s.article_id = t.article_id AND s.pos = t.pos),
g AS (SELECT *, CASE WHEN id IS NOT DISTINCT FROM lag(id) OVER (PARTITION BY article_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM t),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY article_id ORDER BY pos) AS run FROM g)
SELECT article_id, id, CAST(min(pos) AS INTEGER) AS "start", CAST(max(pos) + 1 AS INTEGER) AS "end" FROM r WHERE id IS NOT NULL GROUP BY article_id, run, id""")
def serialize_spans(spark: SparkSession, d: str) -> DataFrame:
    """WIN3, WIN10, PRJ9, ANN8, ANN11: runs of equally linked tokens."""
    return documents.runs(documents.token_rows(_articles(spark, d)), "id")


@query(f"""SELECT c.article_id, CAST(c.cluster_no AS INTEGER) AS cluster_no, array_to_string(list_sort(list_distinct(list(s.id))), ',') AS ids, count(DISTINCT s.id) AS n_ids
FROM (SELECT article_id, cluster_no, unnest(range(m.start, m.end + 1)) AS pos FROM (SELECT article_id, cluster_no, unnest(c) AS m FROM (SELECT article_id, unnest(clusters) AS c, unnest(range(len(clusters))) AS cluster_no FROM ({_ART}))))
 c JOIN ({_STAMP}) s ON s.article_id = c.article_id AND s.pos = c.pos JOIN ({_TOKENS}) t ON t.article_id = c.article_id AND t.pos = c.pos WHERE s.id IS NOT NULL GROUP BY ALL""")
def cluster_entities(spark: SparkSession, d: str) -> DataFrame:
    """AGG12, FLT33, ANN3: ids found in each cluster."""
    return documents.cluster_entities(_articles(spark, d))


@query(f"""WITH RECURSIVE c AS (SELECT article_id, row_number() OVER () AS cno, unnest(c) AS m FROM (SELECT article_id, unnest(clusters) AS c FROM ({_ART}))),
m AS (SELECT DISTINCT article_id, cno, m.start AS s, m.end AS e FROM c WHERE m IS NOT NULL),
near AS (SELECT DISTINCT a.article_id, a.cno AS x, b.cno AS y FROM m a JOIN m b ON a.article_id = b.article_id AND a.s = b.s AND a.e = b.e),
reach AS (SELECT article_id, x, y FROM near UNION SELECT r.article_id, r.x, n.y FROM reach r JOIN near n ON n.article_id = r.article_id AND n.x = r.y),
g AS (SELECT DISTINCT m.article_id, r.root, s, e FROM m JOIN (SELECT x, min(y) AS root FROM reach GROUP BY x) r ON r.x = m.cno),
f AS (SELECT *, first_value(s) OVER w AS fs, first_value(e) OVER w AS fe FROM g WINDOW w AS (PARTITION BY article_id, root ORDER BY s, e))
SELECT article_id, CAST(dense_rank() OVER (PARTITION BY article_id ORDER BY fs, fe) - 1 AS INTEGER) AS cluster_no, s AS "start", e AS "end" FROM f""")
def coref_merge(spark: SparkSession, d: str) -> DataFrame:
    """AGG11, JN19, SET2, SRT4, FN8: clusters of an article joined where they share a mention, member by member."""
    merged = documents.merge_clusters(_articles(spark, d))
    return merged.select("article_id", F.posexplode("clusters").alias("cluster_no", "c")).select("article_id", "cluster_no", F.explode("c").alias("m")).select("article_id", "cluster_no", "m.start", "m.end")


@query(f"""WITH w AS (SELECT title, min(id) AS id FROM ({_WIKI}) GROUP BY title),
c AS (SELECT article_id, unnest(nel) AS c, unnest(range(len(nel))) AS no FROM ({_ART}))
SELECT article_id, CAST(no AS INTEGER) AS no, c.start AS "start", c.end AS "end", w.id AS id FROM c JOIN w ON w.title = {_LINK.format("c.label")} WHERE c.score >= 0.5""")
def nel_links(spark: SparkSession, d: str) -> DataFrame:
    """FLT13, JN3, ANN2: linker candidates that score enough and whose label is a title."""
    w = _wiki(spark, d).groupBy("title").agg(F.min("id").alias("id"))
    c = _articles(spark, d).select("article_id", F.posexplode("nel").alias("no", "c")).where("c.score >= 0.5").withColumn("title", text.format_wikilink("c.label"))
    return c.join(w, "title").select("article_id", "no", F.col("c.start").alias("start"), F.col("c.end").alias("end"), "id")


@query(f"""WITH w AS (SELECT title, min(id) AS id FROM ({_WIKI}) GROUP BY title)
SELECT a.article_id, w.id AS root, coalesce(len(a.tokens), 0) > 0 AS has_tokens FROM ({_ART}) a LEFT JOIN w ON w.title = {_LINK.format("a.title")}""")
def root_entities(spark: SparkSession, d: str) -> DataFrame:
    """JN1, FLT9, FLT36: each article's own entity."""
    w = _wiki(spark, d).groupBy("title").agg(F.min("id").alias("root"))
    a = _articles(spark, d).select("article_id", text.format_wikilink("title").alias("title"), F.coalesce(F.size("tokens") > 0, F.lit(False)).alias("has_tokens"))
    return a.join(w, "title", "left").select("article_id", "root", "has_tokens")


_SIGNS = r"[\p{L}\p{M}\p{N}]+(?:[''’.\-][\p{L}\p{M}\p{N}]+)*|[^\s\p{L}\p{M}\p{N}]"


@query(f"""WITH n AS (SELECT name, min(id) AS id FROM (SELECT id, regexp_extract_all(alias, '{_SIGNS}') AS name FROM (SELECT id, unnest(aliases) AS alias FROM alias_db)) WHERE len(name) > 0 GROUP BY name),
f AS (SELECT article_id, flatten(list_transform(tokens, lambda s: coalesce(s, []))) AS flat FROM ({_ART})),
g AS (SELECT article_id, pos, k, flat[pos + 1:pos + k] AS name FROM (SELECT article_id, flat, unnest(range(len(flat))) AS pos FROM f) CROSS JOIN (SELECT DISTINCT len(name) AS k FROM n) WHERE pos + k <= len(flat))
SELECT article_id, CAST(pos AS INTEGER) AS pos, CAST(max(k) AS INTEGER) AS words, max_by(id, k) AS id FROM g JOIN n USING (name) GROUP BY article_id, pos""")
def alias_match_longest(spark: SparkSession, d: str) -> DataFrame:
    """JN10, SRT7: where names of any length and with any signs stand, the longest at each place."""
    names = table(spark, d, "alias_db").select("id", F.explode("aliases").alias("alias"))
    return annotate.longest_names(_articles(spark, d).select("article_id", text.flatten_tokens("tokens").alias("flat")), names)


@query()
def html_documents(spark: SparkSession, d: str) -> DataFrame:
    """SRC13, FLT30-32, FN21, PRJ6, JN2, FLT29, WIN9: pages as tokenised, linked documents."""
    pages = table(spark, d, "raw_articles").where("html IS NOT NULL AND article_id IS NOT NULL")
    pages = pages.groupBy("article_id").agg(F.max_by(F.struct("title", "html"), F.struct("fetched_at", F.sha2("html", 256))).alias("x")).select("article_id", "x.*")
    docs = documents.html_documents(pages, _wiki(spark, d)).select("article_id", "title", F.posexplode("tokens").alias("sent_no", "words"), "entities")
    linked = F.transform("entities", lambda e: F.concat_ws(":", e["id"], e["start"], e["end"]))
    return docs.select("article_id", "title", "sent_no", F.array_join("words", " ").alias("words"), F.when(F.col("sent_no") == 0, F.array_join(linked, ",")).alias("links"))


def _annotated(spark: SparkSession, d: str, opt: annotate.Options) -> DataFrame:
    core = table(spark, d, "core_entities").select("id", F.array("label").alias("aliases"))
    aliases = table(spark, d, "alias_db").select("id", "aliases").where("id IS NOT NULL").distinct().unionByName(core)
    out = annotate.annotate(_articles(spark, d), _wiki(spark, d), aliases, table(spark, d, "relation_db"), table(spark, d, "units"), opt)
    a = out.select("article_id", F.posexplode("annotations").alias("idx", "a"))
    return a.select("article_id", "idx", "a.source", "a.id", F.array_join("a.relation", ",").alias("relations"), F.array_join("a.parent_id", ",").alias("parents"), F.get("a.span", 0).alias("start"), F.get("a.span", 1).alias("end"))


@query()
def annotate_documents(spark: SparkSession, d: str) -> DataFrame:
    """ANN0-14, JN4-6, JN11, FLT14, FLT16, FLT26: stories of all mentions of all articles."""
    return _annotated(spark, d, annotate.Options())


@query()
def annotate_options(spark: SparkSession, d: str) -> DataFrame:
    """FLT15, FLT25, FLT34, ANN10: the same with every option on: near parents only, names of links from the start, linker ids among the links, pruned clusters."""
    return _annotated(spark, d, annotate.Options(cutoff=40, match_aliases=True, unmatch=True, prune_clusters=True))


# -- literals ----------------------------------------------------------------------------------------------
def _sql_date(template: str) -> str:
    m = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "][mo]"
    named = f"replace(replace(replace(d, '%b', {m(literals.SHORT_MONTHS)}), '%m', lpad(CAST(mo AS VARCHAR), 2, '0')), '%B', {m(literals.MONTHS)})"
    day = f"CASE WHEN da <> 0 THEN replace('{template}', '%d', lpad(CAST(da AS VARCHAR), 2, '0')) ELSE '{template}' END"
    return f"replace(CASE WHEN mo BETWEEN 1 AND 12 THEN {named.replace('(d,', '(' + day + ',')} ELSE {day} END, '%Y', CAST(abs(y) AS VARCHAR))"


def _sql_formats(formats: list) -> str:
    parts = []
    for template, era, strip in formats:
        s = _sql_date(template)
        s = f"regexp_replace({s}, '(^|\\s)0+', '\\1', 'g')" if strip else s
        parts.append(f"[{s}]" if not era else f"[{s}, e1 || ' ' || {s}, {s} || ' ' || e1, e2 || ' ' || {s}, {s} || ' ' || e2]")
    return f"array_to_string(list_concat({', '.join(parts)}), '|')" if len(parts) > 1 else f"array_to_string({parts[0]}, '|')"


_ISO = r"'^([+-][0-9]+)-([0-9]{2})-([0-9]{2})T'"


@query(f"""WITH v AS (SELECT DISTINCT edge_id, value.value.time AS t, value.value.precision AS p FROM relation_db WHERE value.type = 'time'),
x AS (SELECT *, regexp_matches(t, {_ISO}) AS ok, try_cast(regexp_extract(t, {_ISO}, 1) AS BIGINT) AS y, try_cast(regexp_extract(t, {_ISO}, 2) AS INT) AS mo, try_cast(regexp_extract(t, {_ISO}, 3) AS INT) AS da FROM v),
z AS (SELECT *, CASE WHEN y < 0 THEN 'BC' ELSE 'AD' END AS e1, CASE WHEN y < 0 THEN 'BCE' ELSE 'CE' END AS e2 FROM x)
SELECT edge_id, 'T::' || CAST(p AS VARCHAR) || '::' || t AS node, CASE WHEN NOT coalesce(ok, false) THEN '' WHEN p = 11 THEN {_sql_formats(literals.DAY_FORMATS)} WHEN p = 10 THEN {_sql_formats(literals.MONTH_FORMATS)} WHEN p < 10 THEN {_sql_formats(literals.YEAR_FORMATS)} ELSE '' END AS aliases FROM z""")
def date_literals(spark: SparkSession, d: str) -> DataFrame:
    """FN11-14, FN16, D7, D17: node id and all spellings of every date."""
    v = table(spark, d, "relation_db").where("value.type = 'time'").select("edge_id", F.col("value.type").alias("k"), F.col("value.value").alias("v")).distinct()
    return v.select("edge_id", literals.literal_id(F.col("k"), F.col("v")).alias("node"), F.array_join(literals.time_aliases(F.col("v.time"), F.col("v.precision")), "|").alias("aliases"))


_AMOUNT = "try_cast(CASE WHEN regexp_matches(a, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN a END AS DOUBLE)"


@query(f"""WITH v AS (SELECT DISTINCT edge_id, value.value.amount AS a, value.value.unit AS unit FROM relation_db WHERE value.type = 'quantity'),
x AS (SELECT edge_id, v.unit AS unit, {_AMOUNT} AS f, u.label, u.symbol FROM v LEFT JOIN units u ON u.unit <> '1' AND u.unit = regexp_extract(v.unit, '([^/]*)$', 1))
SELECT edge_id, 'V::' || printf('%.4f', f) || '::' || coalesce(unit, '1') AS node, CASE WHEN f IS NULL OR label IS NULL THEN NULL ELSE
  array_to_string([printf('%f', f) || ' ' || label, printf('%f', f) || ' ' || symbol, printf('%.0f', f) || ' ' || label, printf('%.0f', f) || ' ' || symbol,
  printf('%.1f', f) || ' ' || label, printf('%.1f', f) || ' ' || symbol, printf('%.2f', f) || ' ' || label, printf('%.2f', f) || ' ' || symbol], '|') END AS aliases FROM x WHERE f IS NOT NULL""")
def quantity_literals(spark: SparkSession, d: str) -> DataFrame:
    """FN15, FN16: node id of every readable quantity, and its spellings where the unit is known."""
    v = table(spark, d, "relation_db").where("value.type = 'quantity'").select("edge_id", F.col("value.type").alias("k"), F.col("value.value").alias("v")).distinct()
    v = v.withColumn("unit", F.regexp_extract("v.unit", r"([^/]*)$", 1)).join(table(spark, d, "units").where("unit <> '1'").select("unit", "label", "symbol"), "unit", "left")
    said = F.when(F.col("label").isNotNull(), F.array_join(literals.quantity_aliases(F.col("v.amount"), F.col("label"), F.col("symbol")), "|"))
    return v.select("edge_id", literals.literal_id(F.col("k"), F.col("v")).alias("node"), said.alias("aliases")).where("node IS NOT NULL")


