"""Differences between two copies of annotated articles, field by field (problem 6).

Both sides are unpivoted to (key, field, value) cells; the cells of one side count +1, of the other -1, and
what doesn't cancel is a difference. This is done on two levels. On the first a whole article is one cell, its
digest: articles that cancel are done with, and only 32 bytes of each are shuffled. On the second the articles that
don't cancel are read again and unpivoted into one cell per sentence and annotation field.

Defined cases
* of several rows of an article the one with the latest loaded_at counts; of equally late ones the one with
  the greatest digest, so repeated rows change nothing and the choice is the same on every run
* null and empty arrays are equal; an article with null tokens and one without sentences are the same
* annotations with a null span (or no start) match under start -1; several of one start are compared as a bag
* rows with a null article_id name no article and are left out; null versions count as the earliest
* strings are compared exactly, through a 256-bit digest of the cell
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FIELDS = ["source", "id", "relation", "parent_id", "span"]


#: differing articles up to which their keys are sent to every task that reads the tables again; more are joined by shuffle
MOST_SENT = 1_000_000


def _digest(c: Column) -> Column:
    """256 bits of a value's unambiguous text (null fields are written out)."""
    return F.unhex(F.sha2(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), 256))


def _list(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def articles(df: DataFrame, key: str = "article_id", version: str = "loaded_at") -> DataFrame:
    """(key, version, sentences, notes): the compared content in one form, null arrays as empty ones and annotations in order. No shuffle."""
    note = lambda a: F.struct(F.coalesce(F.get(a["span"], 0), F.lit(-1)).alias("start"), *[(_list(a[f]) if f in ("relation", "parent_id", "span") else a[f]).alias(f) for f in FIELDS])
    rows = df.where(F.col(key).isNotNull())
    return rows.select(F.col(key).alias("key"), F.coalesce(F.col(version), F.lit("0001-01-01 00:00:00").cast(dict(df.dtypes)[version])).alias("version"), _list(F.transform("tokens", _list)).alias("sentences"), _list(F.sort_array(F.transform("annotations", note))).alias("notes"))


def digests(rows: DataFrame) -> DataFrame:
    """(key, version, digest) of the latest version of every article; of equally late ones the greatest digest."""
    own = rows.select("key", "version", _digest(F.struct("sentences", "notes")).alias("digest"))
    return own.groupBy("key").agg(F.max(F.struct("version", "digest")).alias("x")).select("key", "x.*")


def cells(rows: DataFrame) -> DataFrame:
    """(key, item, field, value): one cell per sentence and annotation field."""
    sentence = lambda s, i: F.struct(i.alias("item"), F.lit("tokens").alias("field"), _digest(s).alias("value"))
    note = lambda a: F.array(*[F.struct(a["start"].alias("item"), F.lit(f).alias("field"), _digest(a[f]).alias("value")) for f in FIELDS])
    none = F.array().cast("array<struct<item:int,field:string,value:binary>>")
    every = F.concat(F.coalesce(F.transform("sentences", sentence), none), F.coalesce(F.flatten(F.transform("notes", note)), none))
    return rows.select("key", F.inline(every))


def differences(a: DataFrame, b: DataFrame, key: str = "article_id") -> DataFrame:
    """(article_id, item, field, diff) for everything that is on one side only or differs."""
    sides = {1: articles(a, key), -1: articles(b, key)}
    whole = digests(sides[1]).withColumn("sign", F.lit(1)).unionByName(digests(sides[-1]).withColumn("sign", F.lit(-1)))
    # first level: an article whose digests cancel is the same on both sides
    held = whole.groupBy("key").agg(F.sum("sign").alias("net"), F.collect_list(F.struct("sign", "version", "digest")).alias("x"))
    held = cut_lineage(held.where((F.col("net") != 0) | (F.get("x", 0)["digest"] != F.get("x", 1)["digest"])))
    article = held.where("net <> 0").select("key", F.lit(-1).alias("item"), F.lit("row").alias("field"), F.when(F.col("net") > 0, "only_a").otherwise("only_b").alias("diff"))
    odd = held.where("net = 0").select("key", F.inline("x"))
    few = odd.count() <= MOST_SENT

    def unpivoted(sign: int) -> DataFrame:
        """Cells of one side's differing articles. The key alone chooses the rows, then the digest among their versions."""
        want = odd.where(F.col("sign") == sign).select("key", "version", F.col("digest").alias("wanted"))
        rows = sides[sign].join(F.broadcast(want) if few else want, ["key", "version"])
        rows = rows.withColumn("digest", _digest(F.struct("sentences", "notes"))).where("digest <=> wanted")
        # repeated rows hold the same cells
        once = rows.groupBy("key").agg(F.any_value("sentences").alias("sentences"), F.any_value("notes").alias("notes"))
        return cells(once).withColumn("sign", F.lit(sign))

    flat = unpivoted(1).unionByName(unpivoted(-1))
    # second level: a cell is dropped where both sides hold it equally often. What remains is gathered per cell address.
    uneven = flat.groupBy("key", "item", "field", "value").agg(F.sum("sign").alias("net"), F.count_if(F.col("sign") > 0).alias("a"), F.count_if(F.col("sign") < 0).alias("b"))
    per_field = uneven.groupBy("key", "item", "field").agg(F.max(F.abs("net")).alias("off"), (F.sum("a") > 0).alias("in_a"), (F.sum("b") > 0).alias("in_b")).where("off > 0")
    note = (F.col("in_a") != F.col("in_b")) & (F.col("field") != "tokens")
    inside = per_field.select(
        "key", "item", F.when(note, "annotation").otherwise(F.col("field")).alias("field"), F.when(~F.col("in_b"), "only_a").when(~F.col("in_a"), "only_b").otherwise("differs").alias("diff")
    )
    return article.unionByName(inside).withColumnRenamed("key", key).distinct()
