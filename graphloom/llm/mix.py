"""Mixing sources to target shares of all tokens (problem 9).

Entropy balancing over documents: of all rates that give every source its tokens, those nearest to one copy
per document (in relative entropy) are taken, no rate above the source's ``max_repeats``. They are exponential
tilts of the documents' own sizes, rate = min(max_repeats, exp(lambda of the source x tokens / mean tokens)):
small texts stay near one copy, large ones bear most of the change, and a rate at the cap stays there. The
convex dual is solved by Newton steps kept within a bracket; gradient and curvature of a step come from one
distributed aggregate over (source, length) classes, and only they reach the driver (one row per source of the
target table). The mixture is the largest in which no source needs more than ``max_repeats`` copies of every text,
so every share is met by all of its source's tokens; the source that binds has all its rates at the cap.

Rates become copies by systematic rounding along the documents of a source in order of length, so a
document has floor(rate) or ceil(rate) copies and a source's tokens are off by about one text; single copies
are then added or taken back until what is left is less than a short text.

Defined cases
* source names compare in lower case, trimmed, with blanks and hyphens as underscores; null names no source
* sources without a target are left out; targets without any token keep a report row with share 0, and the
  other targets are raised in proportion; a null or non-positive share, or max_repeats below 1, is no target
* null and empty texts have no tokens and no copies; of several targets of one source the largest counts
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import VOCABULARY, count_tokens


def source_key(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}\-]+", "_"), F.lit(""))


def clean_targets(targets: DataFrame) -> DataFrame:
    rows = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    rows = rows.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1")
    return rows.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")


def _tilt(tilts: dict[str, tuple[float, float, float]]) -> Column:
    """Rate of a document (source, n_tokens), for tilts (lambda, mean tokens, cap) of its source; an infinite lambda is the cap."""
    pick = lambda k: F.create_map(*[F.lit(x) for s, t in tilts.items() for x in (s, float(t[k]))])[F.col("source")]
    return F.least(pick(2), F.exp(pick(0) * F.col("n_tokens") / pick(1)))


def solve_dual(classes: DataFrame, targets: dict[str, tuple[float, int]], size: float | None = None, tolerance: float = 1e-7, max_steps: int = 100) -> dict[str, tuple[float, float, float]]:
    """(lambda, mean tokens, cap) per source. ``classes``: (source, n_tokens, docs). One aggregate per step for all sources.

    ``size``: tokens of the mixture; by default the largest that max_repeats allows, and never more. Raises if
    the steps don't converge.
    """
    total = classes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("t"), F.sum("docs").alias("n")).collect()
    have = {r["source"]: (float(r["t"]), float(r["t"]) / r["n"]) for r in total if r["source"] in targets and r["t"]}
    if not have:
        return {}
    whole = sum(targets[s][0] for s in have)
    most = min(targets[s][1] * t * whole / targets[s][0] for s, (t, _) in have.items())
    want = {s: targets[s][0] / whole * (most if size is None else min(size, most)) for s in have}
    cap = {s: float(targets[s][1]) for s in have}
    lam = {s: float("inf") if want[s] >= cap[s] * t * (1 - 1e-12) else float(np.log(want[s] / t)) for s, (t, _) in have.items()}
    low, high = dict.fromkeys(have, -float("inf")), dict.fromkeys(have, float("inf"))
    for _ in range(max_steps):
        tilts = {s: (lam[s], have[s][1], cap[s]) for s in have}
        rate = F.col("docs") * F.col("rate") * F.col("n_tokens")
        mean = F.create_map(*[F.lit(x) for s in have for x in (s, have[s][1])])[F.col("source")]
        capped = F.create_map(*[F.lit(x) for s in have for x in (s, cap[s])])[F.col("source")]
        rows = classes.where(F.col("source").isin(list(have))).withColumn("rate", _tilt(tilts))
        sums = {r["source"]: r for r in rows.groupBy("source").agg(F.sum(rate).alias("g"), F.sum(F.when(F.col("rate") < capped, rate * F.col("n_tokens") / mean).otherwise(0.0)).alias("h")).collect()}
        done = True
        for s in have:
            off = want[s] - sums[s]["g"]
            if np.isinf(lam[s]) or abs(off) <= tolerance * want[s]:
                continue
            done = False
            low[s], high[s] = (lam[s], high[s]) if off > 0 else (low[s], lam[s])
            step = lam[s] + off / sums[s]["h"] if sums[s]["h"] > 0 else float("inf")
            if not low[s] < step < high[s]:  # outside of what is known: halve, or look farther
                step = (low[s] + high[s]) / 2 if np.isfinite(low[s]) and np.isfinite(high[s]) else lam[s] + (1.0 if off > 0 else -1.0) * max(1.0, abs(lam[s]))
            lam[s] = step
        if done:
            return tilts
    raise RuntimeError(f"rates still change after {max_steps} steps")


def mixture(docs: DataFrame, targets: DataFrame, size: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) of all documents of targeted sources with at least one copy."""
    # The target table names sources; it is as long as there are sources, and its shares steer the driver's dual.
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in clean_targets(targets).collect()}
    sized = count_tokens(docs.select("doc_id", source_key(F.col("source")).alias("source"), "text"), ["doc_id", "source"], path=vocabulary)
    sized = cut_lineage(sized.where(F.col("source").isin(list(goal)) & (F.col("n_tokens") > 0)))
    classes = cut_lineage(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")))
    tilts = solve_dual(classes, goal, size)
    if not tilts:
        return sized.select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")).limit(0)
    cap = F.create_map(*[F.lit(x) for s, (_, most) in goal.items() for x in (s, most)])[F.col("source")]
    rounded = cut_lineage(_round(sized.withColumn("rate", _tilt(tilts)).where("rate > 0").withColumn("cap", cap)))
    return _settle(rounded).where("copies > 0").drop("cap")


def _round(rated: DataFrame, strands: int = 64) -> DataFrame:
    """Copies by systematic rounding of the running sum of rates along each source.

    The running sum is made in two levels: over groups of similar length (a sixteenth of an octave, split
    into ``strands`` by hash), a table of bounded size per source, then within a group. No window holds a
    whole source, and equal lengths spread over the strands.
    """
    size_class = F.floor(F.log2("n_tokens") * 16).cast("int")
    rows = rated.withColumn("cls", size_class).withColumn("strand", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(strands)).cast("int"))
    key = ["source", "cls", "strand"]
    groups = rows.groupBy(*key).agg(F.sum("rate").alias("s"))
    upto = Window.partitionBy("source").orderBy("cls", "strand").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*key, F.coalesce(F.sum("s").over(upto), F.lit(0.0)).alias("before"))
    within = Window.partitionBy(*key).orderBy("n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("rate").over(within)).join(groups, key)
    end = F.col("before") + F.col("upto")
    # rounding noise must not lift a whole number over its neighbour
    tick = lambda x: F.floor(F.round(x, 7) + F.lit(0.5))
    copies = (tick(end) - tick(end - F.col("rate"))).cast("int")
    return summed.select("doc_id", "source", "n_tokens", "rate", "cap", F.least(copies, "cap").alias("copies"))


def _settle(rounded: DataFrame, steps: int = 12) -> DataFrame:
    """Single copies added or taken back until each source's tokens meet its target to less than a short text.

    What a source is off by is less than about one long text after rounding. Per source and length class one
    candidate (the least id) that could give or take a copy comes to the driver, a table of bounded size,
    and the longest that fits is used, again and again; the few changes are joined back.
    """
    off = rounded.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("rate") - F.col("copies"))).alias("off"))
    want = {r["source"]: r["off"] for r in off.collect()}
    cls = F.floor(F.log2("n_tokens") * 16).cast("int")
    pick = F.min(F.struct("n_tokens", "doc_id"))
    up = rounded.where("copies < cap").groupBy("source", cls.alias("cls")).agg(pick.alias("c")).select("source", F.lit(1).alias("sign"), "c.*")
    down = rounded.where("copies > 0").groupBy("source", cls.alias("cls")).agg(pick.alias("c")).select("source", F.lit(-1).alias("sign"), "c.*")
    free: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in up.unionByName(down).collect():
        free.setdefault((r["source"], r["sign"]), []).append((r["n_tokens"], r["doc_id"]))
    moves, used = [], set()
    for source, left in want.items():
        for _ in range(steps):
            sign = 1 if left > 0 else -1
            fits = [x for x in free.get((source, sign), []) if x[0] < 2 * abs(left) and x[1] not in used]
            if not fits:
                break
            n, doc = min(fits, key=lambda x: (abs(abs(left) - x[0]), x[1]))
            used.add(doc)
            moves.append((source, doc, sign))
            left -= sign * n
    if not moves:
        return rounded
    change = rounded.sparkSession.createDataFrame(moves, "source string, doc_id long, step int")
    joined = rounded.join(F.broadcast(change), ["source", "doc_id"], "left")
    return joined.withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")


def mixture_report(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: its share as asked, documents and copies used, tokens, and the share reached."""
    got = mixed.groupBy("source").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    out = clean_targets(targets).join(got, "source", "left").fillna(0, ["texts", "copies", "most_repeats", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return out.select("source", "target_share", "max_repeats", "texts", "copies", "most_repeats", "tokens", F.round(F.coalesce(F.try_divide("tokens", total), F.lit(0.0)), 6).alias("reached_share"))
