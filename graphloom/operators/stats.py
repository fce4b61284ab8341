"""Measures of edges and annotations: fan-out, histograms, distances, summaries, readable labels, excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flatten_tokens, span_text, zip_pairs

NEW, REFLEXIVE, STORY = "@@NEW@@", "@@REFLEXIVE@@", "@@STORY@@"
BORING = [REFLEXIVE, NEW]


def fan_stats(links: DataFrame, relation: str = "prop", subject: str = "subject", target: str = "object") -> DataFrame:
    """Mean, deviation, most and least distinct targets per subject, by relation. One subject has deviation 0.

    Distinct triples are made first, so a hot relation or subject is spread by its targets before it is counted.
    """
    triples = links.select(F.col(relation).alias("relation"), F.col(subject).alias("s"), F.col(target).alias("o")).where("s IS NOT NULL AND o IS NOT NULL").distinct()
    fan = triples.groupBy("relation", "s").agg(F.count("*").alias("fan"))
    return fan.groupBy("relation").agg(
        F.round(F.avg("fan"), 6).alias("avg_fan"), F.round(F.coalesce(F.stddev_samp("fan"), F.lit(0.0)), 6).alias("std_fan"), F.max("fan").alias("max_fan"), F.min("fan").alias("min_fan")
    )


def mentions(docs: DataFrame, key: str = "article_id") -> DataFrame:
    """One row per annotation with its place, and the flattened tokens of its document. Null annotations give none."""
    return docs.select(key, flatten_tokens("tokens").alias("flat"), F.posexplode("annotations").alias("idx", "a"))


def story_pairs(mention: DataFrame, *keep: str) -> DataFrame:
    """One row per (relation, parent) of a mention."""
    return mention.select(*keep, "a", F.posexplode(zip_pairs("a.relation", "a.parent_id")).alias("pair_no", "pair"))


def annotated_fan(docs: DataFrame) -> DataFrame:
    """Fan of annotations: distinct parents per child and relation."""
    pairs = story_pairs(mentions(docs))
    return fan_stats(pairs.select(F.col("pair.relation").alias("prop"), F.col("a.id").alias("subject"), F.col("pair.parent").alias("object")))


def relation_counts(docs: DataFrame) -> DataFrame:
    """How often each relation stands in a story."""
    rel = docs.select(F.explode("annotations").alias("a")).select(F.explode("a.relation").alias("relation"))
    return rel.groupBy("relation").agg(F.count("*").alias("n"))


def readable_histogram(docs: DataFrame, names: DataFrame, key: str = "article_id") -> DataFrame:
    """(rank, readable, n): relations by readable name, the most frequent first, of equally frequent ones the first seen. Boring ones are left out."""
    pairs = story_pairs(docs.select(key, F.posexplode("annotations").alias("idx", "a")), key, "idx").select(key, "idx", "pair_no", F.col("pair.relation").alias("relation"))
    pairs = pairs.where(~F.col("relation").isin(BORING))
    # counted by relation first, so names meet one row per relation
    per = pairs.groupBy("relation").agg(F.count("*").alias("n"), F.min(F.struct(key, "idx", "pair_no")).alias("seen"))
    shown = per.join(readable_relations(per, names), "relation").groupBy("readable").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    # one row per name: as long as the list of relations
    return shown.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "seen")).alias("rank"), "readable", "n")


def generator_counts(docs: DataFrame) -> DataFrame:
    """Stories by what generates them: an earlier mention, nothing known, or a relation."""
    kind = F.when(F.col("pair.relation").isin(BORING), F.col("pair.relation")).otherwise(STORY)
    return story_pairs(mentions(docs)).groupBy(kind.alias("generator")).agg(F.count("*").alias("n"))


def _last_before(docs: DataFrame, key: str) -> DataFrame:
    """Story pairs beside the latest earlier mention of their parent in the same document (null if none).

    Mentions and pairs are laid in one order per document and parent, and the last mention is carried over:
    an as-of join in one sort, without comparing mentions with each other. No words take part in it.
    """
    m = docs.select(key, F.posexplode("annotations").alias("idx", "a"))
    mark = F.struct(F.get("a.span", 0).alias("start"), F.get("a.span", 1).alias("end"), F.col("a.source").alias("source"), F.col("a.id").alias("id"))
    # of interest is where an entity was last mentioned strictly before: a mention's update comes after its pairs
    seen = m.select(key, F.col("a.id").alias("entity"), "idx", F.lit(1).alias("kind"), mark.alias("at"))
    pairs = story_pairs(m, key, "idx").select(key, F.col("pair.parent").alias("entity"), "idx", F.lit(0).alias("kind"), F.struct(mark.alias("m"), "pair_no", "pair").alias("p"))
    both = seen.withColumn("p", F.lit(None).cast(pairs.schema["p"].dataType)).unionByName(pairs.withColumn("at", F.lit(None).cast(seen.schema["at"].dataType)))
    w = Window.partitionBy(key, "entity").orderBy("idx", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("last", F.last("at", ignorenulls=True).over(w)).where("kind = 0").select(key, "idx", "p.*", "last")


def length_cdf(docs: DataFrame, key: str = "article_id") -> DataFrame:
    """Distances from the start of a parent's last mention to the end of the child's, with their distribution."""
    gaps = _last_before(docs, key).where(~F.col("pair.relation").isin(BORING) & F.col("last").isNotNull())
    n = gaps.groupBy((F.col("m.end") - F.col("last.start")).alias("length")).agg(F.count("*").alias("n")).where("length IS NOT NULL")
    # one row per distance: the table is as long as documents are, and a single window may sum it
    run = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return n.select("length", "n", F.round(run / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("cdf"))


def summary(docs: DataFrame, key: str = "article_id") -> DataFrame:
    """One row: tokens, annotations, and the shares of sources and kinds of stories. Ratios of nothing are null."""
    none = F.array().cast("array<string>")
    rel = lambda a: F.coalesce(a["relation"], none)
    ann = F.expr("filter(annotations, a -> a IS NOT NULL)")
    count = lambda test: F.coalesce(F.size(F.filter("ann", test)), F.lit(0))
    from_source = lambda s: lambda a: a["source"] == s
    is_new = lambda a: rel(a) == F.array(F.lit(NEW))
    length = lambda a: F.coalesce(F.get(a["span"], 1) - F.get(a["span"], 0), F.lit(0))
    per = docs.withColumn("ann", ann).select(
        F.aggregate(F.coalesce("tokens", F.array().cast("array<array<string>>")), F.lit(0), lambda n, s: n + F.coalesce(F.size(s), F.lit(0))).alias("tokens"),
        F.coalesce(F.size("ann"), F.lit(0)).alias("n"),
        count(is_new).alias("new"),
        count(lambda a: F.array_contains(rel(a), REFLEXIVE)).alias("reflexive"),
        count(lambda a: F.exists(rel(a), lambda r: ~r.isin(BORING))).alias("related"),
        *[count(from_source(s)).alias(s.lower()) for s in ("WIKI", "NEL", "COREF", "KG")],
        F.size(F.array_distinct(F.transform("ann", lambda a: a["id"]))).alias("ids"),
        F.array_max(F.transform("ann", length)).alias("longest"),
    )
    total = F.sum("n")
    share = lambda c: F.round(F.try_divide(F.sum(c), total), 6)
    return per.agg(
        F.sum("tokens").alias("tokens"), total.alias("annotations"), F.round(F.try_divide(total, F.count("*")), 6).alias("per_page"),
        share("reflexive").alias("p_reflexive"), share("wiki").alias("p_wiki"), share("nel").alias("p_nel"), share("coref").alias("p_coref"), share("kg").alias("p_kg"),
        share("new").alias("p_new"), share("related").alias("p_related"), F.max("ids").alias("max_entities"), F.max("longest").alias("max_mention"),
    )


def source_given_new(docs: DataFrame) -> DataFrame:
    """Which source the mentions of unexplained entities come from."""
    new = docs.select(F.explode("annotations").alias("a")).where(F.col("a.relation") == F.array(F.lit(NEW)))
    n = new.groupBy(F.col("a.source").alias("source")).agg(F.count("*").alias("n"))
    return n.select("source", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


def list_entities(docs: DataFrame) -> DataFrame:
    """All ids that any document links to."""
    return docs.select(F.explode("entities").alias("e")).select(F.col("e.id").alias("id")).where("id IS NOT NULL").distinct()


def display_names(aliases: DataFrame) -> DataFrame:
    """id -> first alias; of several rows of an id the least name."""
    return aliases.where("size(aliases) > 0").groupBy("id").agg(F.min(F.get("aliases", 0)).alias("name"))


def readable_relations(relations: DataFrame, names: DataFrame, column: str = "relation", joiner: str = " : ", reverse: bool = False) -> DataFrame:
    """(relation, readable): parts named by their first alias. Distinct relations are named once.

    ``reverse`` gives the display variant: parts beginning with R read Reverse, unknown parts are empty.
    """
    parts = relations.select(F.col(column).alias("relation")).where("relation IS NOT NULL").distinct().select("relation", F.posexplode(F.split("relation", ":")).alias("i", "part"))
    said = F.when(F.col("part").startswith("R"), F.lit("Reverse")).otherwise(F.coalesce("name", F.lit(""))) if reverse else F.coalesce("name", "part")
    named = parts.join(names.select(F.col("id").alias("part"), "name"), "part", "left").select("relation", "i", said.alias("said"))
    return named.groupBy("relation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "said"))), lambda x: x["said"]), joiner).alias("readable"))


def readable_annotations(docs: DataFrame, names: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, idx, id, name, parents, parent_names, relations, readable), the pairs in the order of parent and relation."""
    m = mentions(docs, key).drop("flat")
    pairs = story_pairs(m, key, "idx").select(key, "idx", "pair_no", F.col("pair.parent").alias("parent"), F.col("pair.relation").alias("relation"))
    label = names.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    shown = readable_relations(pairs, names, joiner=":", reverse=True)
    pairs = pairs.join(label, "parent", "left").join(shown, "relation", "left")
    order = F.struct(F.concat(F.coalesce("parent", F.lit("")), F.coalesce("relation", F.lit(""))).alias("o"), "pair_no", "parent", F.coalesce("parent_name", F.lit("")).alias("parent_name"), "relation", F.coalesce("readable", F.lit("")).alias("readable"))
    packed = pairs.groupBy(key, "idx").agg(F.sort_array(F.collect_list(order)).alias("ps"))
    text = lambda f: F.coalesce(F.array_join(F.transform("ps", lambda p: p[f]), ", "), F.lit(""))
    out = m.select(key, "idx", F.col("a.id").alias("id")).join(packed, [key, "idx"], "left").join(names.select("id", "name"), "id", "left")
    return out.select(key, "idx", "id", F.coalesce("name", F.lit("")).alias("name"), text("parent").alias("parents"), text("parent_name").alias("parent_names"), text("relation").alias("relations"), text("readable").alias("readable"))


def excerpts(docs: DataFrame, names: DataFrame, per_relation: int = 5, longest: int | None = None, key: str = "article_id") -> DataFrame:
    """The first ``per_relation`` excerpts of each relation: parent, the words between, and child, in order of document and place."""
    found = _last_before(docs, key).where(~F.col("pair.relation").isin(BORING) & F.col("last").isNotNull())
    found = found.withColumn("length", F.col("m.end") - F.col("last.start"))
    if longest is not None:
        found = found.where(F.col("length") < longest)
    # the first ones are kept by an aggregate that combines on the map side, so a hot relation is no hot task
    own = F.struct(key, "idx", "pair_no", "pair", "m", "last", "length")
    spread = found.select(F.col("pair.relation").alias("relation"), own.alias("x"), F.pmod(F.xxhash64(key), F.lit(64)).alias("salt"))
    for by in (["relation", "salt"], ["relation"]):
        first = Window.partitionBy(*by).orderBy(f"x.{key}", "x.idx", "x.pair_no")
        spread = spread.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_relation)
    # words are cut where they lie, for the chosen excerpts only
    chosen = spread.select("relation", "rank", "x.*")
    words = docs.select(key, flatten_tokens("tokens").alias("flat")).join(chosen, key)
    child = names.select(F.col("id").alias("__c"), F.col("name").alias("child_name"))
    parent = names.select(F.col("id").alias("__p"), F.col("name").alias("parent_name"))
    said = words.select(
        "relation", "rank", key, "idx", "length", "pair", "m", "last",
        span_text("flat", F.col("last.start"), F.col("last.end")).alias("before"), span_text("flat", F.col("last.end"), F.col("m.start")).alias("between"), span_text("flat", F.col("m.start"), F.col("m.end")).alias("behind"),
    )
    said = said.join(child, F.col("m.id") == F.col("__c"), "left").join(parent, F.col("pair.parent") == F.col("__p"), "left")
    box = lambda text, name, i, source: F.concat(F.lit("[[ "), F.concat_ws(" | ", text, F.coalesce(name, i), source), F.lit(" ]]"))
    text = F.concat(
        box(F.col("before"), F.col("parent_name"), F.col("pair.parent"), F.col("last.source")), F.lit(" "), F.col("between"), F.lit(" "),
        box(F.col("behind"), F.col("child_name"), F.col("m.id"), F.col("m.source")),
    )
    return said.select("relation", "rank", key, "idx", "length", text.alias("excerpt"))


def parent_candidates(mention: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, child, prop, parent): links (parent, prop, child) with both ends mentioned in a document.

    A link is looked up from the end with fewer links, then the other end is looked for in the same document:
    neither the links of a hub are listed for every document that mentions it, nor all pairs of a document.
    """
    held = mention.select("doc", F.col("child").alias("id")).distinct()
    n_out = links.groupBy("parent").agg(F.count("*").alias("n_out"))
    n_in = links.groupBy("child").agg(F.count("*").alias("n_in"))
    sized = links.join(n_out, "parent").join(n_in, "child")

    def looked_up(rows: DataFrame, near: str, far: str) -> DataFrame:
        found = rows.join(held.withColumnRenamed("id", near), near).select("doc", "child", "prop", "parent")
        return found.join(held.withColumnRenamed("id", far), ["doc", far], "left_semi")

    return looked_up(sized.where("n_out <= n_in"), "parent", "child").unionByName(looked_up(sized.where("n_out > n_in"), "child", "parent"))


def nearest_parents(mention: DataFrame, links: DataFrame, k: int | None = 10) -> DataFrame:
    """For each mention (doc, child, loc): its ``k`` nearest parents by links (parent, prop, child), nearest first; None: all.

    A parent's place is that of its last mention up to the child's, so it moves on through the document: an
    as-of join in one sort per document and parent. A parent that is mentioned later only is none.
    """
    asked = mention.join(parent_candidates(mention, links), ["doc", "child"]).select("doc", "parent", "loc", F.lit(1).alias("kind"), F.struct("child", "prop").alias("q"))
    seen = mention.select("doc", F.col("child").alias("parent"), "loc", F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["q"].dataType).alias("q"))
    upto = Window.partitionBy("doc", "parent").orderBy("loc", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.last(F.when(F.col("kind") == 0, F.col("loc")), ignorenulls=True).over(upto)
    near = seen.unionByName(asked).withColumn("at", at).where("kind = 1 AND at IS NOT NULL").select("doc", "q.child", "loc", "q.prop", "parent", (F.col("loc") - F.col("at")).alias("dist"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("doc", "child", "loc").orderBy("dist", "prop", "parent")))
    return (near if k is None else near.where(F.col("rank") <= k)).select("doc", "child", "loc", "rank", "prop", "parent", "dist")
