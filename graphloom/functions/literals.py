"""Literals of the knowledge graph: node ids and the ways a date or a quantity is written."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (format, with era, without leading zeros), by precision.
YEAR_FORMATS = [("%Y", True, True)]
MONTH_FORMATS = [("%B %Y", True, True), ("%b %Y", True, True), *YEAR_FORMATS]
DAY_FORMATS = [
    ("%d %B %Y", True, True), ("%d %b %Y", True, True), ("%B %d, %Y", True, True), ("%b %d, %Y", True, True),
    ("%d %B", False, True), ("%d %b", False, True), ("%B %d", False, True), ("%b %d", False, True), ("%Y-%m-%d", False, False),
    *MONTH_FORMATS,
]
MONTHS = "January February March April May June July August September October November December".split()
SHORT_MONTHS = [m[:3] for m in MONTHS]

_ISO = r"^([+-][0-9]+)-([0-9]{2})-([0-9]{2})(?=T)"
_DIRECTIVE = re.compile(r"%[dbmBY]")
_ZEROS = re.compile(r"(?<=\s)0+|^0+")


def parse_date(iso: Column) -> Column:
    """STRUCT<year BIGINT, month INT, day INT>; null if the text doesn't begin with a signed date."""
    part = lambda i, kind: F.regexp_extract(iso, _ISO, i).try_cast(kind)
    return F.when(iso.rlike(_ISO), F.struct(part(1, "bigint").alias("year"), part(2, "int").alias("month"), part(3, "int").alias("day")))


def format_date(year: int, month: int, day: int, template: str, strip: bool) -> str:
    """The directives d, b, m, B and Y filled in; those of a zero month or day stay as they are."""
    fills = {"%Y": str(abs(year))}
    if day:
        fills["%d"] = f"{day:02d}"
    if 1 <= month <= 12:
        fills |= {"%m": f"{month:02d}", "%B": MONTHS[month - 1], "%b": SHORT_MONTHS[month - 1]}
    out = _DIRECTIVE.sub(lambda m: fills.get(m[0], m[0]), template)
    return _ZEROS.sub("", out) if strip else out


def written_dates(iso: str | None, precision: int | None) -> list[str]:
    """All ways to write a point in time of day, month or coarser precision; none for finer or unreadable ones."""
    m = re.match(_ISO, iso) if isinstance(iso, str) else None
    if m is None or precision is None or precision != precision or precision > 11:
        return []
    year, month, day = int(m[1]), int(m[2]), int(m[3])
    eras = ("BC", "BCE") if year < 0 else ("AD", "CE")
    out = []
    for template, with_era, strip in {11: DAY_FORMATS, 10: MONTH_FORMATS}.get(int(precision), YEAR_FORMATS):
        text = format_date(year, month, day, template, strip)
        out.append(text)
        if with_era:
            out += [f"{a} {b}" for era in eras for a, b in ((era, text), (text, era))]
    return out


def plain_dates(iso: str | None, precision: int | None) -> list[str]:
    """``written_dates`` without eras."""
    m = re.match(_ISO, iso) if isinstance(iso, str) else None
    if m is None or precision is None or precision != precision or precision > 11:
        return []
    return [format_date(int(m[1]), int(m[2]), int(m[3]), template, strip) for template, _, strip in {11: DAY_FORMATS, 10: MONTH_FORMATS}.get(int(precision), YEAR_FORMATS)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _dates(iso: pd.Series, precision: pd.Series) -> pd.Series:
    return pd.Series([written_dates(*x) for x in zip(iso, precision)], dtype=object)


def time_aliases(iso: Column, precision: Column) -> Column:
    """``written_dates`` of two columns, in Arrow batches: as one expression of built-in functions, the up to 40
    spellings of 11,741 dates took 20 s on one core; so they take 2 s."""
    return _dates(iso, precision)


@F.pandas_udf(T.StringType())
def fixed4(x: pd.Series) -> pd.Series:
    """Four decimals, ties to even on the exact binary value (the JVM's formatter rounds half up)."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.4f}")


def written_amounts(value: float, unit: bool) -> list[str]:
    """All ways to write a number before a unit, in four precisions; without a unit, the bare number."""
    return [format(value, p) for p in ("f", "1.0f", "0.1f", "0.2f")] if unit else [str(float(value))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _amounts(x: pd.Series, long: pd.Series, short: pd.Series) -> pd.Series:
    def one(v, name, sign):
        if pd.isna(v):
            return []
        if name is None or pd.isna(name):
            return written_amounts(v, False)
        return [f"{n} {u}" for n in written_amounts(v, True) for u in (name, sign)]

    return pd.Series([one(*t) for t in zip(x, long, short)])


def amount_value(amount: Column) -> Column:
    """Plain decimal notation as DOUBLE; null otherwise (a bare cast would also take type suffixes such as F)."""
    return F.when(amount.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), amount.try_cast("double"))


def quantity_aliases(amount: Column, label: Column, symbol: Column) -> Column:
    """Four precisions by long and short unit name; the bare number where the unit is none or unknown (null label)."""
    return _amounts(amount_value(amount), label, symbol)


def literal_id(kind: Column, value: Column) -> Column:
    """Node id of a time (``T::precision::time``) or quantity (``V::amount::unit``); null for all else."""
    amount = amount_value(value["amount"])
    return F.when((kind == "time") & value["time"].isNotNull(), F.concat(F.lit("T::"), value["precision"].cast("string"), F.lit("::"), value["time"])).when(
        (kind == "quantity") & amount.isNotNull(), F.concat(F.lit("V::"), fixed4(amount), F.lit("::"), F.coalesce(value["unit"], F.lit("1")))
    )
