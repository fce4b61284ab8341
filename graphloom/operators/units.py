"""Measured quantities in one common unit per dimension (problem 1).

Pure SQL expressions: the number and the unit are taken out of the amount or the free text by regular
expressions, the unit's spelling is resolved by a join against an alias table, the unit written with the
number comes before the unit field and that before a source default, then factor and shift apply.

Defined cases
* null or unreadable amount, unknown unit, or a unit of another dimension than the property's: ``value`` null
* no unit at all: the optional ``defaults`` (feed, prop, unit) apply; without them ``value`` is null
* repeated rows of one edge count once; a null ``edge_id``, subject or prop never takes part in a pair
* lone comma before exactly three digits separates thousands (``1,640``) unless the number begins with 0
* several components (``5 ft 3 in``, ``0h02m47s``) are added up; text in round brackets is ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import salted_join

# Spellings of units beyond the id, label, symbol and regular plural of the units table.
EXTRA_ALIASES = {
    "metre": ["meter", "meters", "metres", "mtr", "mètre", "mètres"],
    "kilometre": ["kilometer", "kilometers", "kilometres"],
    "centimetre": ["centimeter", "centimeters", "centimetres"],
    "millimetre": ["millimeter", "millimeters", "millimetres"],
    "foot": ["feet", "'", "′"],
    "inch": ["inches", '"', "″"],
    "mile": ["miles"],
    "nautical mile": ["nm", "nautical miles"],
    "square metre": ["sq m", "m²", "square meter", "square meters", "square metres"],
    "square kilometre": ["sq km", "km²", "square kilometer", "square kilometers", "square kilometres"],
    "square mile": ["mi²", "mi2", "square miles"],
    "hectare": ["hectares"],
    "acre": ["acres"],
    "kilogram": ["kilo", "kilos", "kilograms", "kilogramme", "kilogrammes"],
    "gram": ["grams", "gramme", "grammes"],
    "tonne": ["tonnes", "metric ton", "metric tons"],
    "pound": ["lbs", "pounds"],
    "stone": ["stones"],
    "second": ["sec", "secs", "seconds", "sekunde", "sekunden"],
    "minute": ["m", "mins", "minutes", "minuten"],
    "hour": ["hr", "hrs", "hours", "stunde", "stunden"],
    "day": ["days", "tag", "tage"],
    "metre per second": ["metres per second", "meter per second", "meters per second", "mps"],
    "kilometre per hour": ["kilometres per hour", "kilometer per hour", "kilometers per hour", "kph", "kmh"],
    "mile per hour": ["miles per hour", "mi/h"],
    "knot": ["knots", "kt", "kts"],
    "kelvin": ["kelvins"],
    "degree Celsius": ["c", "celsius", "deg c", "degrees celsius"],
    "degree Fahrenheit": ["f", "fahrenheit", "deg f", "degrees fahrenheit"],
    "one": ["people", "inhabitants", "persons", "residents", "pop"],
    "thousand": ["tsd", "thousands"],
    "million": ["mio", "mln", "millions"],
}

#: blank, no-break, figure, thin and narrow no-break space
_SPACES = " \\u00a0\\u2007\\u2009\\u202f"
_BLANK = rf"[\s{_SPACES}]"
_NUMBER = rf"[-+\u2212]?(?:\d{{1,3}}(?:[{_SPACES}]\d{{3}}(?!\d))++|\d(?:[\d.,]*\d)?)(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
_COMPONENT = rf"({_NUMBER}){_BLANK}*((?:[^\d]++|(?<=[A-Za-z])[23](?![0-9A-Za-z]))*+)"
#: what may stand behind a number without naming a unit: a preposition before an article or pronoun (with which
#: "in" is no inch), participles and adverbs, adjectives of measure, words of estimation
_NOISE = r"(?i)\b(?:(?:in|on|at|of|by|from|to|for|according to) (?:the|a|an|its|all|this|that)\b.*|\p{L}{3,}ed|\p{L}{3,}ly|tall|high|long|wide|deep|heavy|estimate|approx|about|around|circa|and)\b"


def number_value(s: Column) -> Column:
    """Text of one number in any of the usual notations as DOUBLE; null if it is none."""
    t = F.translate(F.regexp_replace(s, _BLANK, ""), "\u2212", "-")
    both = t.contains(",") & t.contains(".")
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    plain = (
        F.when(both & comma_last, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^[-+]?[1-9]\d{0,2}(,\d{3})+$") | t.rlike(r"^[-+]?\d+(,\d+){2,}"), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^[-+]?\d+(\.\d{3}){2,}$"), F.replace(t, F.lit("."), F.lit("")))
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )
    return plain.try_cast("double")


def alias_key(s: Column) -> Column:
    """Case, blanks and a final full stop do not tell unit spellings apart."""
    t = F.trim(F.regexp_replace(F.lower(s), rf"{_BLANK}+", " "))
    return F.regexp_replace(t, r"[.,;:]+$", "")


def unit_aliases(units: DataFrame) -> DataFrame:
    """(alias, dimension, unit, factor, shift); one row per alias and dimension."""
    extra = F.create_map(*[x for k, v in EXTRA_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.array_compact(
        F.concat(
            F.array("unit", "label", "symbol", F.concat("label", F.lit("s"))),
            F.coalesce(F.try_element_at(extra, F.col("label")), F.array().cast("array<string>")),
        )
    )
    return (
        units.select(F.explode(names).alias("alias"), "dimension", "unit", F.col("factor").cast("double"), F.col("shift").cast("double"))
        .withColumn("alias", alias_key(F.col("alias")))
        .where(F.col("alias") != "")
        .groupBy("alias", "dimension")
        .agg(F.min(F.struct("unit", "factor", "shift")).alias("u"))
        .select("alias", "dimension", "u.*")
    )


def common_unit_values(edges: DataFrame, properties: DataFrame, units: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Every quantity edge with its ``value`` in the common unit: edge_id, subject, prop, feed, dimension, value.

    ``defaults`` (feed, prop, unit) names the unit that a feed means where it writes none.
    """
    props = properties.where(F.col("dimension").isNotNull()).select("prop", "dimension").distinct()
    aliases = unit_aliases(units)
    v = F.col("value.value")
    q = (
        edges.where(F.col("value.type") == "quantity")
        .select("edge_id", "subject", "prop", "feed", F.coalesce(v["amount"], v["text"]).alias("said"), v["unit"].alias("unit_field"))
        .join(props, "prop", "left")
    )
    if defaults is not None:
        q = q.join(defaults.select("feed", "prop", F.col("unit").alias("unit_default")), ["feed", "prop"], "left")
    else:
        q = q.withColumn("unit_default", F.lit(None).cast("string"))
    said = F.regexp_replace("said", r"\([^)]*\)", " ")
    q = q.withColumn("c", F.arrays_zip(F.regexp_extract_all(said, F.lit(_COMPONENT), F.lit(1)).alias("num"), F.regexp_extract_all(said, F.lit(_COMPONENT), F.lit(2)).alias("tail")))
    q = q.withColumn("lead", F.when(F.lower(F.regexp_extract(said, r"^[^\d]*", 0)).rlike(r"\bpop(\.|ulation)?\s*$"), F.lit("pop")))
    # Number by number; an edge has one, or a few components. Nothing is shuffled up to the last step.
    q = q.select("*", F.posexplode_outer("c").alias("k", "one")).drop("c")
    written = alias_key(F.regexp_replace(F.col("one.tail"), _NOISE, " "))
    # of an address the last part names the unit; any other slash belongs to the unit itself
    field = alias_key(F.when(F.col("unit_field").rlike(r"^\s*\w+://"), F.regexp_extract("unit_field", r"([^/#]*)$", 1)).otherwise(F.col("unit_field")))
    q = q.select(
        "edge_id", "subject", "prop", "feed", "dimension", "k", number_value(F.col("one.num")).alias("num"),
        F.coalesce(
            F.nullif(written, F.lit("")),
            F.when(F.col("k") == 0, F.coalesce(F.col("lead"), F.nullif(field, F.lit("")), alias_key(F.col("unit_default")))),
        ).alias("alias"),
    )
    # A unit stands at the front of what follows the number; of the known ones the one of most words counts.
    lengths = [r["n"] for r in aliases.select(F.size(F.split("alias", " ")).alias("n")).distinct().orderBy(F.desc("n")).collect()]
    for words in lengths:
        a = aliases.select(F.col("alias").alias(f"a{words}"), F.col("dimension").alias(f"d{words}"), F.struct("unit", "factor", "shift").alias(f"u{words}"))
        front = F.substring_index(F.col("alias"), " ", words)
        q = q.join(a, (front == F.col(f"a{words}")) & (F.col("dimension") == F.col(f"d{words}")), "left")
    q = q.withColumn("u", F.coalesce(*[F.col(f"u{words}") for words in lengths], F.lit(None).cast("struct<unit:string,factor:double,shift:double>")))
    term = F.abs("num") * F.col("u.factor")
    per_edge = q.groupBy("edge_id", "subject", "prop", "feed", "dimension").agg(
        F.max(F.when(F.col("k") == 0, F.when(F.col("num") < 0, -1.0).otherwise(1.0))).alias("sign"),
        F.count(F.when((F.col("k") == 0) & F.col("u").isNotNull() & F.col("num").isNotNull(), 1)).alias("ok"),
        # components after the first count only where they name a unit themselves; repeated rows count once
        F.collect_set(F.when(F.col("u").isNotNull(), F.struct("k", term.alias("t"), F.col("u.shift").alias("s"), F.col("u.unit").alias("unit")))).alias("parts"),
    )
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["t"])
    shift = F.when(F.size("parts") == 1, F.element_at("parts", 1)["s"]).otherwise(F.lit(0.0))
    return per_edge.select("edge_id", "subject", "prop", "feed", "dimension", F.when(F.col("ok") > 0, F.col("sign") * total + shift).alias("value"))


def _comparable(values: DataFrame, keys: list[str], id_col: str, value_col: str) -> DataFrame:
    base = values.where(F.col(value_col).isNotNull() & F.col(id_col).isNotNull()).dropna(subset=keys)
    return base.select(*keys, F.col(id_col).alias("i"), F.col(value_col).alias("v")).distinct()


def value_classes(values: DataFrame, keys: list[str], id_col: str, value_col: str) -> DataFrame:
    """(id, class, members): rows of one key with exactly the same value, named by the least id of them. No pairs."""
    base = _comparable(values, keys, id_col, value_col)
    classes = base.groupBy(*keys, "v").agg(F.min("i").alias("class"), F.count("*").alias("members"))
    return base.join(classes, [*keys, "v"]).select(F.col("i").alias(id_col), "class", "members")


def equal_value_pairs(values: DataFrame, keys: list[str], id_col: str, value_col: str, tolerance: float, hot_rows: int = 200_000) -> DataFrame:
    """Pairs (edge_a < edge_b) with equal keys whose values differ by at most ``tolerance`` of the larger one.

    A band join: values go to buckets of one tolerance on a logarithmic scale and meet their neighbours
    only, so a key with very many values is not compared pair by pair. Buckets of more than ``hot_rows`` rows are
    spread over several tasks. All pairs of a bucket are asked for; ``value_classes`` tells as much without pairs.
    """
    import math

    width = -math.log1p(-tolerance)
    base = _comparable(values, keys, id_col, value_col)
    v = F.col("v")
    bucket = F.when(v == 0, F.lit(-(2**40))).otherwise(F.floor(F.log(F.abs(v)) / F.lit(width))).cast("long")
    cell = lambda b: F.struct(*keys, F.signum("v").alias("sg"), b.alias("b")).alias("cell")
    left = base.select(F.col("i").alias("edge_a"), F.col("v").alias("va"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"), *keys, "v").select("edge_a", "va", cell(F.col("b")))
    right = base.select(F.col("i").alias("edge_b"), F.col("v").alias("vb"), cell(bucket))
    near = F.abs(F.col("va") - F.col("vb")) <= F.lit(tolerance) * F.greatest(F.abs("va"), F.abs("vb")) * F.lit(1 + 1e-12)
    pairs = salted_join(left, right, "cell", hot_rows=hot_rows, salt_from=F.xxhash64("edge_a")).where((F.col("edge_a") < F.col("edge_b")) & near)
    return pairs.select("edge_a", "edge_b").distinct()
