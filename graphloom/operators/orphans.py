"""References to entities that do not exist, kept as an incrementally maintained state (problem 2).

``advance`` takes the state after some period and the events of the next one: references probe the parent
index, arriving parents resolve the references that wait for them, deletions reopen. Within a batch the
events of one target are folded in time order by a window; across batches one row per target is carried (how
often created, how many spans open, how many references so far per table) and the references that still wait
for a parent. What is open is counted from the same fold: a reference that comes to a missing target opens, an
arriving parent closes all of its target's references, a deletion reopens them; the changes are summed per table
and month. Targets that hold a large part of the references are salted: their few parent events are repeated
per salt, the references are not.

Defined cases
* ids compare trimmed of any outer blanks and in upper case; null, empty and literal ids are no references
* at one instant parents change before references are judged (created_at inclusive, deleted_at exclusive)
* a span that ends before it begins never makes its entity exist, but counts as a row of it
* rows with a null created_at have no known span and are left out; so are references with a null loaded_at
* repeated rows on either side give one row
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written

REFERENCE = ["ref_table", "ref_field", "month", "row_key", "target"]
TABLES = ("relation_db", "annotations")


@dataclass
class OrphanState:
    """parents: target, created, live, and references so far per table (n_0, n_1, ...). waiting: REFERENCE columns and loaded_at, parent never seen so far."""

    parents: DataFrame
    waiting: DataFrame


@dataclass
class Advanced:
    """What a batch gives: the new state, the orphans it settles (``deleted`` and ``late``), and per table and month by how much the open references change."""

    state: OrphanState
    settled: DataFrame
    flows: DataFrame


def entity_id(c: Column) -> Column:
    """Canonical ``Q<number>`` or null."""
    t = F.upper(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(t.rlike(r"^Q\d+$"), t)


def _reference(df: DataFrame, table: str, field: str, key: str, target: Column) -> DataFrame:
    return df.select(
        F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.date_format("loaded_at", "yyyy-MM").alias("month"),
        F.col(key).alias("row_key"), entity_id(target).alias("target"), "loaded_at",
    ).where(F.col("target").isNotNull() & F.col("loaded_at").isNotNull())


def references(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """All references of both tables: REFERENCE columns and loaded_at."""
    found = edges.where(F.col("value.type") == "wikibase-entityid")
    ann = annotations.select("article_id", "loaded_at", F.explode("annotations").alias("a"))
    parents = ann.select("article_id", "loaded_at", F.explode("a.parent_id").alias("p"))
    return (
        _reference(found, "relation_db", "id", "edge_id", F.col("value.value.id"))
        .unionByName(_reference(ann, "annotations", "id", "article_id", F.col("a.id")))
        .unionByName(_reference(parents, "annotations", "parent_id", "article_id", F.col("p")))
    )


def parent_changes(spans: DataFrame) -> DataFrame:
    """(target, at, created, delta): one row for each beginning and each end of a span."""
    s = spans.select(entity_id(F.col("id")).alias("target"), "created_at", "deleted_at").distinct()
    s = s.where(F.col("target").isNotNull() & F.col("created_at").isNotNull())
    empty = F.col("deleted_at") <= F.col("created_at")
    begins = s.select("target", F.col("created_at").alias("at"), F.lit(1).alias("created"), F.when(empty, 0).otherwise(1).alias("delta"))
    ends = s.where(F.col("deleted_at") > F.col("created_at")).select("target", F.col("deleted_at").alias("at"), F.lit(0).alias("created"), F.lit(-1).alias("delta"))
    return begins.unionByName(ends)


def _counts(tables) -> list[str]:
    return [f"n_{i}" for i in range(len(tables))]


def initial_state(refs: DataFrame, permanent: DataFrame, tables=TABLES) -> OrphanState:
    """Before all events: ``permanent`` (id) always exist, nothing waits."""
    parents = permanent.select(entity_id(F.col("id")).alias("target")).where(F.col("target").isNotNull()).distinct()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return OrphanState(parents.select("target", one.alias("created"), one.alias("live"), *[none.alias(n) for n in _counts(tables)]), refs.select(*REFERENCE, "loaded_at").limit(0))


def advance(state: OrphanState, refs: DataFrame, changes: DataFrame, hot_rows: int = 200_000, tables=TABLES) -> Advanced:
    """The state after a batch and what the batch settles. Repeated references within a batch count once."""
    counts, none = _counts(tables), F.lit(0).cast("long")
    refs = refs.select(*REFERENCE, "loaded_at").distinct()
    hot = refs.groupBy("target").count().where(F.col("count") > hot_rows).select("target", F.ceil(F.col("count") / hot_rows).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    known = state.parents.select("target", F.lit(None).cast("timestamp").alias("at"), "created", F.col("live").alias("delta"), *counts)
    known = known.unionByName(changes.select("target", "at", F.col("created").cast("long"), F.col("delta").cast("long"), *[none.alias(n) for n in counts]))
    left = known.join(hot, "target", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    right = refs.join(hot, "target", "left").withColumn("salt", F.pmod(F.xxhash64("row_key", "loaded_at", "ref_field"), salts).cast("int")).drop("salts")
    once = [F.when(F.col("salt") == 0, F.col(n)).otherwise(0).alias(n) for n in counts]
    events = left.select("target", "salt", "at", F.lit(0).alias("kind"), "created", "delta", *once, F.lit(None).cast(_ref_struct(refs)).alias("ref")).unionByName(
        right.select(
            "target", "salt", F.col("loaded_at").alias("at"), F.lit(1).alias("kind"), none.alias("created"), none.alias("delta"),
            *[F.when(F.col("ref_table") == t, 1).otherwise(0).cast("long").alias(n) for t, n in zip(tables, counts)], F.struct("ref_table", "ref_field", "month", "row_key").alias("ref"),
        )
    )
    key = Window.partitionBy("target", "salt")
    order = key.orderBy(F.col("at").asc_nulls_first(), "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    folded = events.select(
        "target", "salt", "at", "kind", "ref",
        F.sum("delta").over(so_far).alias("live"), F.sum("created").over(so_far).alias("seen"), F.sum("created").over(key).alias("ever"), *[F.sum(n).over(so_far).alias(n) for n in counts],
    )
    judged = folded.where("kind = 1").withColumn(
        "reason",
        F.when(F.col("live") > 0, F.lit(None)).when(F.col("seen") > 0, "deleted").when(F.col("ever") > 0, "late").otherwise("waiting"),
    ).where(F.col("reason").isNotNull())
    judged = cut_lineage(judged.select("ref.*", "target", F.col("at").alias("loaded_at"), "reason"))
    # all references of a target are open while it doesn't exist: what an event changes in that is its flow
    opened = [F.when(F.col("live") <= 0, F.col(n)).otherwise(0).alias(n) for n in counts]
    steps = folded.select("target", "salt", "at", "kind", *opened).select("at", *[(F.col(n) - F.coalesce(F.lag(n).over(order), F.lit(0))).alias(n) for n in counts]).where("at IS NOT NULL")
    flows = steps.groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(*[F.sum(n).alias(n) for n in counts])
    flows = flows.select("month", F.inline(F.array(*[F.struct(F.lit(t).alias("ref_table"), F.col(n).alias("opened")) for t, n in zip(tables, counts)]))).where("opened <> 0")
    arrived = changes.where("created > 0").select("target").distinct()
    resolved = state.waiting.join(arrived, "target", "left_semi").withColumn("reason", F.lit("late"))
    waiting = state.waiting.join(arrived, "target", "left_anti").select(*REFERENCE, "loaded_at")
    waiting = cut_lineage(waiting.unionByName(judged.where("reason = 'waiting'").select(*REFERENCE, "loaded_at")))
    met = refs.select("target", none.alias("created"), none.alias("delta"), *[F.when(F.col("ref_table") == t, 1).otherwise(0).cast("long").alias(n) for t, n in zip(tables, counts)])
    parents = known.drop("at").unionByName(met).groupBy("target").agg(F.sum("created").alias("created"), F.sum("delta").alias("live"), *[F.sum(n).alias(n) for n in counts])
    settled = judged.where("reason <> 'waiting'").unionByName(resolved).select(*REFERENCE, "reason")
    return Advanced(OrphanState(cut_lineage(parents), waiting), settled, flows)


def open_references(state: OrphanState, tables=TABLES) -> DataFrame:
    """(ref_table, open): references whose target does not exist now, read from the state."""
    total = state.parents.where("live <= 0").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _counts(tables)])
    return total.select(F.inline(F.array(*[F.struct(F.lit(t).alias("ref_table"), F.col(n).alias("open")) for t, n in zip(tables, _counts(tables))])))


def _ref_struct(refs: DataFrame) -> str:
    kinds = dict(refs.dtypes)
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in REFERENCE if c != "target") + ">"


def play(refs: DataFrame, spans: DataFrame, permanent: DataFrame, hot_rows: int = 200_000, tables=TABLES) -> tuple[DataFrame, DataFrame, OrphanState]:
    """(orphans with reason, flows, state): the history played year by year through ``advance``.

    Events are read from their tables once and written by year, so every batch reads its own year alone.
    Only the years themselves come to the driver. What happens before the first reference belongs to its year.
    """
    state = initial_state(refs, permanent, tables)
    changes = parent_changes(spans)
    spread = refs.select(F.year("loaded_at").alias("period"), *REFERENCE, F.col("loaded_at").alias("at")).unionByName(changes.select(F.year("at").alias("period"), "target", "at", "created", "delta"), allowMissingColumns=True)
    events = written(spread, "period")
    years = [r["period"] for r in events.where("ref_table IS NOT NULL").select("period").distinct().orderBy("period").collect()]
    gone = refs.select(*REFERENCE, F.lit("missing").alias("reason")).limit(0)
    if not years:
        return gone, refs.select("month", "ref_table", F.lit(0).cast("long").alias("opened")).limit(0), state
    done, flows, before = None, None, None
    for year in years:
        # the last batch reaches to the end: what is created after all references can still turn a waiting one into a late one
        batch = events if year == years[-1] else events.where(F.col("period") <= year)
        if before is not None:
            batch = batch.where(F.col("period") > before)
        found = advance(state, batch.where("ref_table IS NOT NULL").withColumnRenamed("at", "loaded_at"), batch.where("ref_table IS NULL"), hot_rows, tables)
        state, before = found.state, year
        done = found.settled if done is None else done.unionByName(found.settled)
        flows = found.flows if flows is None else flows.unionByName(found.flows)
    done = done.unionByName(state.waiting.select(*REFERENCE, F.lit("missing").alias("reason"))).distinct()
    return done, flows.groupBy("month", "ref_table").agg(F.sum("opened").alias("opened")), state


def orphans(refs: DataFrame, spans: DataFrame, permanent: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """All orphan references with their reason."""
    return play(refs, spans, permanent, hot_rows)[0]


def orphan_snapshots(refs: DataFrame, spans: DataFrame, permanent: DataFrame) -> DataFrame:
    """Per table and month: references loaded, orphans among them by reason, and all that are open at its end.

    Open at the end of a month is what was loaded by then and whose target does not exist then: the sum of all flows up to it.
    """
    lost, flows, _ = play(refs, spans, permanent)
    new = refs.select(*REFERENCE, "loaded_at").distinct().groupBy("ref_table", "month").agg(F.count("*").alias("loaded"))
    why = lost.groupBy("ref_table", "month").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ("missing", "deleted", "late")])
    # one row per table and month: a calendar, whose running sums are no window over rows of data
    upto = Window.partitionBy("ref_table").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    calendar = new.join(flows, ["ref_table", "month"], "full").select("ref_table", "month", "loaded", F.sum(F.coalesce("opened", F.lit(0))).over(upto).alias("open_at_end")).where("loaded IS NOT NULL")
    out = calendar.join(why, ["ref_table", "month"], "left")
    return out.select("ref_table", "month", "loaded", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("missing", "deleted", "late", "open_at_end")])
