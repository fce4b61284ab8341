"""Curation: pruning edges, deleting annotations, splits, token-wise diffs and document filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import span_text, zip_pairs
from .stats import mentions, relation_counts, story_pairs


def bad_relations(edges: DataFrame, max_avg_fan: float = 15) -> DataFrame:
    """Relations whose subjects have ``max_avg_fan`` or more distinct objects on average."""
    fan = edges.where("object IS NOT NULL").select("prop", "subject", "object").distinct().groupBy("prop", "subject").agg(F.count("*").alias("n"))
    return fan.groupBy("prop").agg(F.avg("n").alias("avg_fan")).where(F.col("avg_fan") >= max_avg_fan)


def rare_relations(docs: DataFrame, min_count: int = 5) -> DataFrame:
    """Relations seen at least once and at most ``min_count`` times in annotations."""
    return relation_counts(docs).where(F.col("n") <= min_count).select(F.col("relation").alias("prop"), "n")


def prune_edges(edges: DataFrame, docs: DataFrame, patterns: list[str], max_avg_fan: float = 15, min_count: int = 5) -> DataFrame:
    """Edges without those of unwanted (unanchored pattern), far too common, or rarely used relations."""
    kept = edges
    for p in patterns:
        kept = kept.where(~F.col("prop").rlike(p))
    # both lists have one row per property
    kept = kept.join(bad_relations(edges, max_avg_fan).select("prop"), "prop", "left_anti")
    return kept.join(rare_relations(docs, min_count).select("prop"), "prop", "left_anti")


def manual_deletions(docs: DataFrame, key: str = "article_id", bad_spans: tuple[str, ...] = (".", '"'), point_in_time: str = "P585", cutoff: int = 30) -> DataFrame:
    """(key, idx, pair_no, id, relation, parent) of the story pairs that stay.

    A pair goes if its mention is a bare stop or quote, its relation is a point in time, or its parent's last
    mention (the current one included) ended more than ``cutoff`` tokens before; a mention without pairs goes.
    """
    m = mentions(docs, key)
    end, start = F.get("a.span", 1), F.get("a.span", 0)
    seen = m.select(key, F.col("a.id").alias("entity"), "idx", F.lit(0).alias("kind"), end.alias("end"))
    pairs = story_pairs(m, key, "flat", "idx").select(
        key, F.col("pair.parent").alias("entity"), "idx", F.lit(1).alias("kind"), F.struct("pair_no", F.col("a.id").alias("id"), "pair.relation", "pair.parent", start.alias("start"), span_text("flat", start, end).alias("said")).alias("p")
    )
    both = seen.withColumn("p", F.lit(None).cast(pairs.schema["p"].dataType)).unionByName(pairs.withColumn("end", F.lit(None).cast("int")))
    w = Window.partitionBy(key, "entity").orderBy("idx", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = both.withColumn("last", F.last("end", ignorenulls=True).over(w)).where("kind = 1").select(key, "idx", "p.*", "last")
    return judged.where(~F.col("said").isin(*bad_spans) & ~F.col("relation").rlike(f"^.*{point_in_time}$") & F.col("last").isNotNull() & (F.col("start") - F.col("last") <= cutoff)).drop("start", "said", "last")


def split_by_title(docs: DataFrame, valid: DataFrame, test: DataFrame, mini: DataFrame, order: str = "line_no") -> DataFrame:
    """Adds ``split`` and ``mini``. A listed title is used up by its first document; a repeated one falls through
    from valid to test to train."""
    for name, titles in (("valid", valid), ("test", test), ("mini", mini)):
        docs = docs.join(titles.select("title", F.lit(True).alias(f"in_{name}")).distinct(), "title", "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("title").orderBy(order))
    split = F.when(F.col("in_valid") & (F.col("nth") == 1), "valid").when(F.col("in_test") & (F.col("nth") == 1 + F.col("in_valid").cast("int")), "test").otherwise("train")
    return docs.withColumn("nth", nth).withColumn("split", split).withColumn("mini", F.col("in_mini") & (F.col("nth") == 1)).drop("nth", "in_valid", "in_test", "in_mini")


def unused_titles(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """Listed titles that no document has."""
    return titles.join(docs.select("title").distinct(), "title", "left_anti")


def token_diff(a: DataFrame, b: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, pos, id_a, id_b, source_a, source_b) for all tokens that either side annotates; of overlapping
    annotations the last one counts. Both sides must have the same tokens."""
    def side(df: DataFrame, s: str) -> DataFrame:
        m = mentions(df, key).where(F.get("a.span", 1) > F.get("a.span", 0))
        pos = m.select(key, "idx", F.explode(F.sequence(F.get("a.span", 0), F.get("a.span", 1) - 1)).alias("pos"), "a")
        last = pos.groupBy(key, "pos").agg(F.max_by(F.struct("a.id", "a.source"), "idx").alias("x"))
        return last.select(key, "pos", F.col("x.id").alias(f"id_{s}"), F.col("x.source").alias(f"source_{s}"))

    return side(a, "a").join(side(b, "b"), [key, "pos"], "full")


def same_tokens(a: DataFrame, b: DataFrame, key: str = "article_id") -> DataFrame:
    """Keys of documents whose tokens are alike on both sides."""
    return a.select(key, F.col("tokens").alias("ta")).join(b.select(key, F.col("tokens").alias("tb")), key).where(F.col("ta").eqNullSafe(F.col("tb"))).select(key)


def with_tokens(docs: DataFrame) -> DataFrame:
    """Documents that have any sentence."""
    return docs.where(F.size("tokens") > 0)


def good_or_featured(pages: DataFrame, column: str = "wikitext") -> DataFrame:
    """Pages that carry the template of a good or featured article."""
    return pages.where(F.col(column).rlike(r"\{\{([Gg]ood|[Ff]eatured) [Aa]rticle\}\}"))


def story_sizes(docs: DataFrame, key: str = "article_id") -> DataFrame:
    """Pairs per mention."""
    return mentions(docs, key).select(key, "idx", F.size(zip_pairs("a.relation", "a.parent_id")).alias("pairs"))


