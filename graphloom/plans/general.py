"""Queries of the general data problems (1, 2, 6, 7) and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import copydiff, orphans, units, variants
from ..session import table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _values(spark: SparkSession, d: str) -> DataFrame:
    return units.common_unit_values(table(spark, d, "relation_db"), table(spark, d, "property_list"), table(spark, d, "units"))


@query
def p1_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity edge with its amount in the common unit of its property's dimension (null: none can be given)."""
    return _values(spark, d).select("edge_id", "subject", "prop", "dimension", F.round("value", 6).alias("value"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of edges of one subject and property whose values agree within 0.5 %."""
    return units.equal_value_pairs(_values(spark, d), ["subject", "prop"], "edge_id", "value", 0.005)


@query
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Edges of one subject and property with exactly the same value, as classes."""
    return units.value_classes(_values(spark, d), ["subject", "prop"], "edge_id", "value")


def _refs(spark: SparkSession, d: str):
    return orphans.references(table(spark, d, "relation_db"), table(spark, d, "annotations")), table(spark, d, "alias_db"), table(spark, d, "core_entities")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """References to entities that did not exist when their row was loaded, with the reason."""
    return orphans.orphans(*_refs(spark, d))


@query
def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month, and what is open at the month's end."""
    return orphans.orphan_snapshots(*_refs(spark, d))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Differences between the latest versions of both systems' articles, cell by cell."""
    return copydiff.differences(table(spark, d, "annotations"), table(spark, d, "annotations_b"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per label, alias, claim and qualifier of each entity's last readable line."""
    flat = variants.flatten_dump(table(spark, d, "entity_dump"), values=False)
    return flat.select("entity_id", "kind", "key1", "pos1", "key2", "pos2").distinct()


def _subtype(name: str):
    def table_of(spark: SparkSession, d: str) -> DataFrame:
        return variants.subtype_table(variants.flatten_dump(table(spark, d, "entity_dump")), name)

    table_of.__name__ = f"p7_{name}"
    table_of.__doc__ = f"The typed subtype table of {name} rows, under the supertype's keys."
    return table_of


for _name in variants.SUBTYPES:
    query(_subtype(_name))


def _alias_rows() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {quote(label)})" for label, names in units.EXTRA_ALIASES.items() for a in names)


_NUM = r"[-+]?(?:[0-9]{1,3}(?: [0-9]{3})+|[0-9](?:[0-9.,]*[0-9])?)(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?"
_VALUES_SQL = rf"""
WITH alias AS (
  SELECT alias, dimension, min_by(factor, unit) AS factor, min_by(shift, unit) AS shift FROM (
    SELECT lower(unnest([unit, label, symbol, label || 's'])) AS alias, dimension, unit, factor, shift FROM units
    UNION ALL SELECT x.a, u.dimension, u.unit, u.factor, u.shift FROM (VALUES {_alias_rows()}) x(a, label) JOIN units u USING (label)
  ) WHERE alias <> '' GROUP BY ALL
), said AS (
  SELECT edge_id, subject, r.prop, p.dimension, lower(coalesce(r.value.value.unit, '')) AS unit_field,
    regexp_replace(regexp_replace(regexp_replace(coalesce(r.value.value.amount, r.value.value.text), '\([^)]*\)', ' ', 'g'), '[\x{{00A0}}\x{{202F}}]', ' ', 'g'), '([A-Za-z])2($|[^0-9A-Za-z])', '\1²\2', 'g') AS t
  FROM relation_db r LEFT JOIN (SELECT DISTINCT prop, dimension FROM property_list WHERE dimension IS NOT NULL) p ON p.prop = r.prop WHERE r.value.type = 'quantity'
), dist AS (SELECT DISTINCT * FROM said),
parts AS (
  SELECT *, unnest(nums) AS num, unnest(tails) AS tail, unnest(range(len(nums))) AS k FROM (
    SELECT *, regexp_extract_all(t, '({_NUM})([^0-9]*)', 1) AS nums, regexp_extract_all(t, '({_NUM})([^0-9]*)', 2) AS tails FROM dist)
), named AS (
  SELECT *, replace(num, ' ', '') AS n,
    trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(tail), '\b(in the register|tall|surveyed|estimate|approx|about|and)\b', ' ', 'g'), ' +', ' ', 'g')), '[.,;:]+$', '')) AS written,
    trim(regexp_replace(trim(CASE WHEN contains(unit_field, '://') THEN regexp_extract(unit_field, '([^/#]*)$', 1) ELSE unit_field END), '[.,;:]+$', '')) AS field
  FROM parts
), spelled AS (
  SELECT *, CASE WHEN written <> '' THEN written WHEN k > 0 THEN NULL WHEN regexp_matches(lower(t), '^[^0-9]*\bpop\.? *[0-9]') THEN 'pop' ELSE field END AS a,
    try_cast(CASE
      WHEN contains(n, ',') AND contains(n, '.') AND strpos(reverse(n), ',') < strpos(reverse(n), '.') THEN replace(replace(n, '.', ''), ',', '.')
      WHEN contains(n, ',') AND contains(n, '.') THEN replace(n, ',', '')
      WHEN regexp_matches(n, '^[-+]?[1-9][0-9]{{0,2}}(,[0-9]{{3}})+$') THEN replace(n, ',', '')
      WHEN regexp_matches(n, '^[-+]?[0-9]+(\.[0-9]{{3}}){{2,}}$') THEN replace(n, '.', '')
      ELSE replace(n, ',', '.') END AS DOUBLE) AS v
  FROM named
), measured AS (
  SELECT s.*, coalesce(a4.factor, a3.factor, a2.factor, a1.factor) AS factor, coalesce(a4.shift, a3.shift, a2.shift, a1.shift) AS shift
  FROM spelled s
  LEFT JOIN alias a4 ON a4.dimension = s.dimension AND a4.alias = s.a
  LEFT JOIN alias a3 ON a3.dimension = s.dimension AND a3.alias = array_to_string(string_split(s.a, ' ')[1:3], ' ')
  LEFT JOIN alias a2 ON a2.dimension = s.dimension AND a2.alias = array_to_string(string_split(s.a, ' ')[1:2], ' ')
  LEFT JOIN alias a1 ON a1.dimension = s.dimension AND a1.alias = string_split(s.a, ' ')[1]
), amounts AS (
  SELECT d.edge_id, d.subject, d.prop, d.dimension,
    CASE WHEN count(CASE WHEN k = 0 AND factor IS NOT NULL AND v IS NOT NULL THEN 1 END) > 0 THEN
      max(CASE WHEN k = 0 AND v < 0 THEN -1 ELSE 1 END * CASE WHEN k = 0 THEN 1 END) * sum(abs(v) * factor) + CASE WHEN count(factor) = 1 THEN max(shift) ELSE 0 END END AS value
  FROM dist d LEFT JOIN measured m ON m.edge_id = d.edge_id GROUP BY ALL
)"""

ORACLES["p1_amounts"] = _VALUES_SQL + " SELECT edge_id, subject, prop, dimension, round(value, 6) AS value FROM amounts"
ORACLES["p1_found"] = (
    _VALUES_SQL
    + """
SELECT DISTINCT a.edge_id AS edge_a, b.edge_id AS edge_b FROM amounts a JOIN amounts b ON a.subject = b.subject AND a.prop = b.prop AND a.edge_id < b.edge_id
WHERE abs(a.value - b.value) <= 0.005 * greatest(abs(a.value), abs(b.value)) * (1 + 1e-12)"""
)

ORACLES["p1_classes"] = (
    _VALUES_SQL
    + """, one AS (SELECT DISTINCT edge_id, subject, prop, value FROM amounts WHERE value IS NOT NULL AND edge_id IS NOT NULL AND subject IS NOT NULL AND prop IS NOT NULL)
SELECT edge_id, min(edge_id) OVER w AS class, count(*) OVER w AS members FROM one WINDOW w AS (PARTITION BY subject, prop, value)"""
)

_REFS_SQL = r"""
WITH raw AS (
  SELECT 'relation_db' AS ref_table, 'id' AS ref_field, loaded_at, edge_id AS row_key, value.value.id AS t FROM relation_db WHERE value.type = 'wikibase-entityid'
  UNION ALL SELECT 'annotations', 'id', loaded_at, article_id, a.id FROM (SELECT loaded_at, article_id, unnest(annotations) AS a FROM annotations)
  UNION ALL SELECT 'annotations', 'parent_id', loaded_at, article_id, unnest(a.parent_id) FROM (SELECT loaded_at, article_id, unnest(annotations) AS a FROM annotations)
), refs AS (
  SELECT DISTINCT ref_table, ref_field, strftime(loaded_at, '%Y-%m') AS month, row_key, upper(regexp_replace(t, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) AS target, loaded_at FROM raw
), q AS (SELECT * FROM refs WHERE regexp_matches(target, '^Q[0-9]+$') AND loaded_at IS NOT NULL),
spans AS (SELECT DISTINCT upper(trim(id)) AS target, created_at, deleted_at FROM alias_db WHERE created_at IS NOT NULL),
judged AS (
  SELECT q.ref_table, q.ref_field, q.month, q.row_key, q.target, q.loaded_at, any_value(c.id) IS NOT NULL AS core,
    count(s.target) AS spans, count(CASE WHEN s.created_at <= q.loaded_at THEN 1 END) AS created,
    count(CASE WHEN s.created_at <= q.loaded_at AND (s.deleted_at IS NULL OR s.deleted_at > q.loaded_at) THEN 1 END) AS alive
  FROM q LEFT JOIN spans s ON s.target = q.target LEFT JOIN core_entities c ON c.id = q.target GROUP BY ALL
)"""
_REASON = "CASE WHEN spans = 0 THEN 'missing' WHEN created > 0 THEN 'deleted' ELSE 'late' END"
ORACLES["p2_found"] = _REFS_SQL + f" SELECT DISTINCT ref_table, ref_field, month, row_key, target, {_REASON} AS reason FROM judged WHERE NOT core AND alive = 0"
ORACLES["p2_snapshots"] = (
    _REFS_SQL
    + f""", ends AS (SELECT DISTINCT month, CAST(strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH AS TIMESTAMP) AS e FROM q),
new AS (SELECT ref_table, month, count(*) AS loaded,
    count(DISTINCT CASE WHEN NOT core AND alive = 0 AND {_REASON} = 'missing' THEN (ref_field, row_key, target) END) AS missing,
    count(DISTINCT CASE WHEN NOT core AND alive = 0 AND {_REASON} = 'deleted' THEN (ref_field, row_key, target) END) AS deleted,
    count(DISTINCT CASE WHEN NOT core AND alive = 0 AND {_REASON} = 'late' THEN (ref_field, row_key, target) END) AS late
  FROM judged GROUP BY ALL),
life AS (SELECT e.month, s.target FROM ends e JOIN spans s ON s.created_at < e.e AND (s.deleted_at IS NULL OR s.deleted_at >= e.e) GROUP BY ALL),
opened AS (SELECT q.ref_table, e.month, count(*) AS open_at_end FROM q JOIN ends e ON e.month >= q.month
  WHERE NOT EXISTS (SELECT 1 FROM life l WHERE l.month = e.month AND l.target = q.target) AND NOT EXISTS (SELECT 1 FROM core_entities c WHERE c.id = q.target) GROUP BY ALL)
SELECT ref_table, month, loaded, missing, deleted, late, coalesce(open_at_end, 0) AS open_at_end FROM new LEFT JOIN opened USING (ref_table, month)"""
)


def _side(name: str, t: str) -> str:
    return f"{name} AS (SELECT article_id, tokens, annotations FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY loaded_at DESC) AS rn FROM {t}) WHERE rn = 1)"


_NOTE = """SELECT article_id, coalesce(n.span[1], -1) AS item, n.source AS source, n.id AS id, to_json(coalesce(n.relation, [])) AS relation,
  to_json(coalesce(n.parent_id, [])) AS parent_id, to_json(coalesce(n.span, [])) AS span FROM (SELECT article_id, unnest(annotations) AS n FROM {})"""
ORACLES["p6_found"] = f"""
WITH {_side("a", "annotations")}, {_side("b", "annotations_b")},
ta AS (SELECT article_id, to_json(coalesce(unnest(tokens), [])) AS s, unnest(range(len(tokens))) AS item FROM a),
tb AS (SELECT article_id, to_json(coalesce(unnest(tokens), [])) AS s, unnest(range(len(tokens))) AS item FROM b),
na AS ({_NOTE.format("a")}), nb AS ({_NOTE.format("b")}),
cells AS (
  SELECT article_id, CAST(item AS INTEGER) AS item, 'tokens' AS field, CASE WHEN tb.s IS NULL THEN 'only_a' WHEN ta.s IS NULL THEN 'only_b' ELSE 'differs' END AS diff
  FROM ta FULL JOIN tb USING (article_id, item) WHERE ta.s IS DISTINCT FROM tb.s
  UNION ALL
  SELECT article_id, CAST(item AS INTEGER), f, d FROM (
    SELECT article_id, item, unnest(CASE WHEN nb.span IS NULL OR na.span IS NULL THEN ['annotation'] ELSE ['source', 'id', 'relation', 'parent_id', 'span'] END) AS f,
      unnest(CASE WHEN nb.span IS NULL THEN ['only_a'] WHEN na.span IS NULL THEN ['only_b'] ELSE [
        CASE WHEN na.source IS DISTINCT FROM nb.source THEN 'differs' END, CASE WHEN na.id IS DISTINCT FROM nb.id THEN 'differs' END,
        CASE WHEN na.relation <> nb.relation THEN 'differs' END, CASE WHEN na.parent_id <> nb.parent_id THEN 'differs' END, CASE WHEN na.span <> nb.span THEN 'differs' END] END) AS d
    FROM na FULL JOIN nb USING (article_id, item)) WHERE d IS NOT NULL
)
SELECT DISTINCT article_id, item, field, diff FROM cells WHERE article_id IN (SELECT article_id FROM a) AND article_id IN (SELECT article_id FROM b)
UNION ALL SELECT article_id, -1, 'row', 'only_a' FROM a WHERE article_id NOT IN (SELECT article_id FROM b)
UNION ALL SELECT article_id, -1, 'row', 'only_b' FROM b WHERE article_id NOT IN (SELECT article_id FROM a)"""


def _decoded(field: str) -> str:
    """A field of an entity, also where it was stored as JSON text once more."""
    return f"CASE WHEN json_type({field}) = 'VARCHAR' AND regexp_matches(json_extract_string({field}, '$'), '^\\s*[{{\\[]') THEN TRY_CAST(json_extract_string({field}, '$') AS JSON) ELSE {field} END"


def _listed(source: str, field: str, own: str, keep: str, good: str, bad: str) -> str:
    """Elements of a field in all its shapes: (keep, key, place, x). ``good``: what an element x must be; ``bad``: what spoils its list."""
    return f"""
  SELECT {keep}, key, place, x FROM (
    SELECT {keep}, key, held, unnest(CASE WHEN json_type(held) = 'ARRAY' THEN CAST(held AS JSON[]) ELSE [held] END) AS x,
      unnest(CASE WHEN json_type(held) = 'ARRAY' THEN range(json_array_length(held)::BIGINT) ELSE [0::BIGINT] END) AS place
    FROM (SELECT {keep}, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS held FROM (SELECT {keep}, CAST({field} AS MAP(VARCHAR, JSON)) AS m FROM {source} WHERE json_type({field}) = 'OBJECT'))
    WHERE json_type(held) <> 'ARRAY' OR len(list_filter(CAST(held AS JSON[]), lambda x: {bad})) = 0)
  WHERE {good}
  UNION ALL
  SELECT {keep}, key, row_number() OVER (PARTITION BY {keep}, key ORDER BY i) - 1 AS place, x FROM (
    SELECT {keep}, i, x, {own} AS key FROM (SELECT {keep}, unnest(CAST({field} AS JSON[])) AS x, unnest(range(json_array_length({field})::BIGINT)) AS i FROM {source} WHERE json_type({field}) = 'ARRAY'
      AND len(list_filter(CAST({field} AS JSON[]), lambda x: ({bad}) OR json_type(x) = 'VARCHAR')) = 0) WHERE {good}) WHERE key IS NOT NULL"""


_IS_TERM = "(json_type(x) = 'VARCHAR' OR (json_type(x, '$.language') = 'VARCHAR' AND json_type(x, '$.value') = 'VARCHAR'))"
_HAS = lambda key: f"(json_type(x) = 'OBJECT' AND json_exists(x, '$.{key}'))"
_NONE = "coalesce(json_type(x), 'NULL') <> 'NULL'"
_NESTED_SQL = rf"""
WITH lines AS (SELECT line_no, CAST(t AS JSON) AS j FROM (SELECT line_no, trim(regexp_replace(regexp_replace(trim(line), '^\[', ''), ',?\s*\]?,?$', '')) AS t FROM entity_dump) WHERE t LIKE '{{%' AND json_valid(t)),
ents AS (
  SELECT line_no, json_extract_string(j, '$.id') AS entity_id, j AS e FROM lines WHERE NOT json_exists(j, '$.entities') AND json_type(j, '$.id') = 'VARCHAR'
  UNION ALL SELECT line_no, coalesce(nullif(json_extract_string(e, '$.id'), ''), key), e FROM (SELECT line_no, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS e FROM (
    SELECT line_no, CAST(j->'$.entities' AS MAP(VARCHAR, JSON)) AS m FROM lines WHERE json_type(j, '$.entities') = 'OBJECT')) WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT line_no, json_extract_string(e, '$.id'), e FROM (SELECT line_no, unnest(CAST(j->'$.entities' AS JSON[])) AS e FROM lines WHERE json_type(j, '$.entities') = 'ARRAY') WHERE json_type(e, '$.id') = 'VARCHAR'
), latest AS (SELECT entity_id, e FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY line_no DESC) AS rn FROM ents) WHERE rn = 1 AND NOT json_exists(e, '$.missing')),
f AS (SELECT entity_id, {_decoded("e->'$.labels'")} AS labels, {_decoded("e->'$.aliases'")} AS aliases, {_decoded("e->'$.claims'")} AS claims FROM latest),
label AS ({_listed("f", "labels", "json_extract_string(x, '$.language')", "entity_id", f"{_NONE} AND {_IS_TERM} AND json_type(x) <> 'ARRAY'", f"{_NONE} AND NOT coalesce({_IS_TERM}, false)")}),
alias AS ({_listed("f", "aliases", "json_extract_string(x, '$.language')", "entity_id", f"{_NONE} AND {_IS_TERM}", f"{_NONE} AND NOT coalesce({_IS_TERM}, false)")}),
claim AS ({_listed("f", "claims", "coalesce(json_extract_string(x, '$.mainsnak.property'), json_extract_string(x, '$.property'))", "entity_id", f"{_NONE} AND {_HAS('mainsnak')}", f"{_NONE} AND NOT coalesce({_HAS('mainsnak')}, false)")}),
c AS (SELECT entity_id, key AS key1, place AS pos1, x AS claim, {_decoded("x->'$.qualifiers'")} AS q FROM claim),
qualifier AS ({_listed("c", "q", "json_extract_string(x, '$.property')", "entity_id, key1, pos1", f"{_NONE} AND {_HAS('snaktype')}", f"{_NONE} AND NOT coalesce({_HAS('snaktype')}, false)")}),
node AS (
  SELECT entity_id, 'label' AS kind, key AS key1, 0 AS pos1, '' AS key2, 0 AS pos2, x FROM label
  UNION ALL SELECT entity_id, 'alias', key, place, '', 0, x FROM alias UNION ALL SELECT entity_id, 'claim', key1, pos1, '', 0, claim FROM c
  UNION ALL SELECT entity_id, 'qualifier', key1, pos1, key, place, x FROM qualifier
), dated AS (SELECT *, CASE WHEN kind = 'claim' THEN x->'$.mainsnak' ELSE x END AS s, CASE WHEN kind = 'claim' THEN x->'$.mainsnak.datavalue' WHEN kind = 'qualifier' THEN x->'$.datavalue' END AS dv FROM node),
typed AS (SELECT *, dv->'$.value' AS v, CASE WHEN kind IN ('label', 'alias') THEN 'term' WHEN coalesce(json_type(dv), 'NULL') = 'NULL' THEN 'empty'
    WHEN json_type(s, '$.snaktype') IS NULL OR coalesce(json_type(dv, '$.type'), '') <> 'VARCHAR' THEN 'other' WHEN json_type(dv, '$.value') = 'VARCHAR' THEN 'text'
    WHEN json_type(dv, '$.value.id') = 'VARCHAR' AND (json_type(dv, '$.value."entity-type"') = 'VARCHAR' OR json_type(dv, '$.value."numeric-id"') IN ('UBIGINT', 'BIGINT', 'DOUBLE')) THEN 'entity'
    WHEN json_type(dv, '$.value.time') = 'VARCHAR' THEN 'time' WHEN json_type(dv, '$.value.amount') = 'VARCHAR' THEN 'quantity'
    WHEN json_type(dv, '$.value.text') = 'VARCHAR' AND json_type(dv, '$.value.language') = 'VARCHAR' THEN 'text'
    WHEN json_type(dv, '$.value.latitude') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(dv, '$.value.longitude') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'place' ELSE 'other' END AS subtype FROM dated)
SELECT DISTINCT entity_id, kind, key1, CAST(pos1 AS INTEGER) AS pos1, key2, CAST(pos2 AS INTEGER) AS pos2"""
_VALUE_SQL = {
    "term": "coalesce(json_extract_string(x, '$.value'), json_extract_string(x, '$')) AS text",
    "entity": "json_extract_string(v, '$.id') AS target",
    "time": "json_extract_string(v, '$.time') AS time, TRY_CAST(v->>'$.precision' AS INTEGER) AS precision, CASE WHEN json_type(v, '$.calendarmodel') = 'VARCHAR' THEN json_extract_string(v, '$.calendarmodel') END AS calendar",
    "quantity": "json_extract_string(v, '$.amount') AS amount, CASE WHEN json_type(v, '$.unit') = 'VARCHAR' THEN json_extract_string(v, '$.unit') END AS unit",
    "text": "CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE json_extract_string(v, '$.text') END AS text, json_extract_string(v, '$.language') AS language",
    "place": "CAST(v->>'$.latitude' AS DOUBLE) AS latitude, CAST(v->>'$.longitude' AS DOUBLE) AS longitude",
    "other": "CAST(dv AS VARCHAR) AS json",
    "empty": "CASE WHEN json_type(s, '$.snaktype') = 'VARCHAR' THEN json_extract_string(s, '$.snaktype') END AS snaktype",
}
ORACLES["p7_found"] = _NESTED_SQL + " FROM typed"
for _name, _columns in _VALUE_SQL.items():
    ORACLES[f"p7_{_name}"] = _NESTED_SQL + f", {_columns} FROM typed WHERE subtype = '{_name}'"
