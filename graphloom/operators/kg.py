"""Knowledge graph tables out of an entity dump: titles, aliases, edges with qualifiers, reverse edges, redirects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_wikilink
from ..sources.readers import dump_lines

# Kinds of claims that say nothing about other entities.
BAD_DATATYPES = ["external-id", "url", "commonsMedia", "globecoordinate"]
_SNAK = "struct<property:string,datatype:string,datavalue:struct<type:string,value:string>>"
_CLAIM = f"struct<mainsnak:{_SNAK},qualifiers:string>"
_BLANK = " \t\r\n"
REVERSE = "R:"


def _line(path: str) -> Column:
    return F.get_json_object("line", path)


def wiki_titles(lines: DataFrame) -> DataFrame:
    """title -> id for entities with a page; of equal titles the last line counts."""
    rows = dump_lines(lines).select("line_no", format_wikilink(_line("$.sitelinks.enwiki.title")).alias("title"), _line("$.id").alias("id"))
    return rows.where("title IS NOT NULL AND id IS NOT NULL").groupBy("title").agg(F.max_by("id", "line_no").alias("id"))


def alias_lists(lines: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """id -> label and aliases, label first; entities without any give no row; the last line of an id counts.

    ``allowed`` (id) restricts entities; other ids (properties) always stay.
    """
    also = F.transform(F.from_json(_line("$.aliases.en"), "array<struct<value:string>>"), lambda x: x["value"])
    names = F.array_compact(F.concat(F.array(_line("$.labels.en.value")), F.coalesce(also, F.array().cast("array<string>"))))
    rows = dump_lines(lines).select("line_no", _line("$.id").alias("id"), names.alias("aliases")).where("id IS NOT NULL AND size(aliases) > 0")
    if allowed is not None:
        marked = rows.join(allowed.select("id", F.lit(True).alias("__in")), "id", "left")
        rows = marked.where(~F.col("id").startswith("Q") | F.col("__in")).drop("__in")
    return rows.groupBy("id").agg(F.max_by("aliases", "line_no").alias("aliases"))


def _good(snak: Column) -> Column:
    """Snaks with a value, of a kind that matters; monolingual text in English only."""
    foreign = (snak["datatype"] == "monolingualtext") & ~F.get_json_object(snak["datavalue"]["value"], "$.language").eqNullSafe("en")
    return snak["datavalue"].isNotNull() & ~F.coalesce(snak["datatype"].isin(BAD_DATATYPES), F.lit(False)) & ~F.coalesce(foreign, F.lit(False))


def _entities(lines: DataFrame) -> DataFrame:
    """(line_no, part, subject, claims): the entities of every line, those of a wrapper one by one; claims as JSON."""
    rows = dump_lines(lines)
    inner = F.ltrim(F.when(F.col("line").contains('"entities"'), _line("$.entities")), F.lit(_BLANK))
    none = F.lit(None).cast("string")
    listed = F.transform(F.from_json(inner, "array<string>"), lambda x: F.struct(none.alias("key"), x.alias("value")))
    keyed = F.transform(F.map_entries(F.from_json(inner, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    own = F.array(F.struct(none.alias("key"), F.col("line").alias("value")))
    rows = rows.select("line_no", F.posexplode(F.when(inner.isNull(), own).when(inner.startswith("["), listed).otherwise(keyed)).alias("part", "e"))
    name = F.get_json_object("e.value", "$.id")
    return rows.select("line_no", "part", F.coalesce(F.nullif(name, F.lit("")), "e.key", name).alias("subject"), F.get_json_object("e.value", "$.claims").alias("claims"))


def _by_property(field: Column, schema: str, prop: Callable[[Column], Column]) -> Column:
    """[(key, value)] of a JSON field, value an array: a map of lists, of single elements or of both, or one list of elements that name their property.

    Every element is read on its own, so one of an unknown shape takes no other along.
    """
    field = F.ltrim(field, F.lit(_BLANK))
    read = lambda x: F.from_json(x, schema)
    some = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    keyed = F.transform(F.map_entries(F.from_json(field, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), F.transform(some(e["value"]), read).alias("value")))
    listed = F.transform(F.transform(F.from_json(field, "array<string>"), read), lambda x: F.struct(prop(x).alias("key"), F.array(x).alias("value")))
    return F.when(field.startswith("["), F.filter(listed, lambda e: e["key"].isNotNull())).otherwise(keyed)


def edges(lines: DataFrame, allowed: DataFrame | None = None, properties: DataFrame | None = None) -> DataFrame:
    """(line_no, subject, ord, prop, value_type, value): claims, each followed by its qualifiers (``P:Q``).

    ``allowed`` (id) restricts subjects, ``properties`` (prop) main properties. A claim that is left out takes
    its qualifiers along. Claims and qualifiers are read in every shape of the dump (``_by_property``).
    """
    rows = _entities(lines).where("subject IS NOT NULL")
    if allowed is not None:
        rows = rows.join(allowed.select(F.col("id").alias("subject")), "subject", "left_semi")
    grouped = rows.select("line_no", "part", "subject", F.posexplode(_by_property(F.col("claims"), _CLAIM, lambda x: x["mainsnak"]["property"])).alias("at", "e"))
    if properties is not None:
        grouped = grouped.join(properties.select(F.col("prop").alias("__p")), F.col("e.key") == F.col("__p"), "left_semi")
    claim = grouped.select("line_no", "part", "subject", "at", F.col("e.key").alias("prop"), F.posexplode("e.value").alias("no", "claim")).where(_good(F.col("claim.mainsnak")))
    flat = lambda prop, snak, q, k: F.struct(prop.alias("prop"), snak["datavalue"]["type"].alias("value_type"), snak["datavalue"]["value"].alias("value"), q.alias("q"), k.alias("k"))
    main = F.array(flat(F.col("prop"), F.col("claim.mainsnak"), F.lit(-1), F.lit(-1)))
    said = F.coalesce(_by_property(F.col("claim.qualifiers"), _SNAK, lambda x: x["property"]), F.array().cast(f"array<struct<key:string,value:array<{_SNAK}>>>"))
    quals = F.flatten(F.transform(said, lambda e, q: F.transform(F.filter(F.coalesce(e["value"], F.array().cast(f"array<{_SNAK}>")), _good), lambda s, k: flat(F.concat_ws(":", F.col("prop"), e["key"]), s, q, k))))
    out = claim.select("line_no", "part", "subject", "at", "no", F.inline(F.concat(main, quals)))
    place = F.row_number().over(_per_subject())
    return out.withColumn("ord", place - 1).select("line_no", "subject", "ord", "prop", "value_type", "value")


def _per_subject():
    from pyspark.sql import Window

    return Window.partitionBy("line_no", "subject").orderBy("part", "at", "no", "q", "k")


def reverse_edges(edge: DataFrame) -> DataFrame:
    """(subject, prop, object) of all entity edges turned round, whether or not the new subject is in the graph."""
    return edge.where("object IS NOT NULL").select(F.col("object").alias("subject"), F.concat(F.lit(REVERSE), F.col("prop")).alias("prop"), F.col("subject").alias("object"))


def split_property(prop: Column) -> tuple[Column, Column, Column]:
    """(is_reverse, main property, qualifier property or null) of a property string."""
    back = prop.startswith(REVERSE)
    bare = F.when(back, F.substring(prop, len(REVERSE) + 1, 10**6)).otherwise(prop)
    return back, F.split_part(bare, F.lit(":"), F.lit(1)), F.nullif(F.split_part(bare, F.lit(":"), F.lit(2)), F.lit(""))


def add_redirects(wiki: DataFrame, redirects: DataFrame, hops: int = 1) -> DataFrame:
    """Titles plus those redirects whose target is known and whose own title is new; ``hops`` follows chains."""
    named = redirects.select(format_wikilink("from_title").alias("title"), format_wikilink("to_title").alias("target")).where("title IS NOT NULL AND target IS NOT NULL")
    for _ in range(hops):
        found = named.join(wiki.select(F.col("title").alias("target"), "id"), "target").select("title", "id").groupBy("title").agg(F.min("id").alias("id"))
        wiki = wiki.unionByName(found.join(wiki.select("title"), "title", "left_anti"))
    return wiki
