"""Packing texts into containers of fixed capacity (problem 8).

A text longer than a container fills whole containers, and its rest is packed like any other text. Pieces
are dealt to shards by hash, so each shard sees the same mix of lengths; within a shard a vector best-fit
in decreasing order puts every piece into the open container that it leaves with the smallest weighted
residual norm over three capacities (tokens, pieces, attention cost), among those where all three suffice.
A piece that alone costs more attention than the budget has a container of its own.
Shards have a fixed size, so work grows with the data and the space lost is at most about one container in
a shard of many thousand pieces.

Defined cases
* null and empty texts have no tokens: they come out with n_tokens 0, container null
* repeated rows are packed as often as they occur; ties in length are broken by id and part
* no documents give no rows
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import VOCABULARY, count_tokens


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    #: pieces in one container
    pieces: int = 512
    #: sum of squared piece lengths. Below the square of the token capacity it keeps nearly full pieces from being
    #: filled up; a piece that alone costs more has a container of its own, as it must not be divided
    attention: int = 2048 * 2048 * 7 // 8
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


def vector_best_fit(sizes: np.ndarray, cap: Capacity) -> np.ndarray:
    """Container number of each piece, the pieces being taken in the order given."""
    most = np.array([cap.tokens, cap.pieces, cap.attention], dtype=float)
    weight = np.array(cap.weights)
    placed = np.empty(len(sizes), dtype=np.int64)
    free = np.empty((3, 1024))
    number = np.empty(1024, dtype=np.int64)
    n_open = total = 0
    least = sizes.min() if len(sizes) else 0
    for i, size in enumerate(sizes):
        if size * size > cap.attention:
            placed[i], total = total, total + 1
            continue
        need = np.array([size, 1, size * size], dtype=float)
        left = free[:, :n_open] - need[:, None]
        fits = (left >= 0).all(axis=0)
        if fits.any():
            norm = (weight[:, None] * (left / most[:, None]) ** 2).sum(axis=0)
            norm[~fits] = np.inf
            k = int(norm.argmin())
        else:
            if n_open == free.shape[1]:
                free, number = np.concatenate([free, np.empty_like(free)], axis=1), np.concatenate([number, np.empty_like(number)])
            k = n_open
            free[:, k], number[k] = most, total
            n_open, total = n_open + 1, total + 1
        free[:, k] -= need
        placed[i] = number[k]
        # A container that not even the smallest piece fits into is closed: the last open one takes its place.
        if free[0, k] < least or free[1, k] < 1 or free[2, k] < least * least:
            n_open -= 1
            free[:, k], number[k] = free[:, n_open], number[n_open]
    return placed


def pack(docs: DataFrame, cap: Capacity = Capacity(), shard_pieces: int = 16_384, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, tok_start, n_tokens, container, shard): every piece of every text in its container."""
    sized = count_tokens(docs, ["doc_id"], path=vocabulary)
    full = F.floor(F.col("n_tokens") / cap.tokens)
    last = F.greatest(F.ceil(F.col("n_tokens") / cap.tokens) - 1, F.lit(0))
    parts = sized.select("doc_id", "n_tokens", full.alias("full"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    size = F.least(F.col("n_tokens") - F.col("part") * cap.tokens, F.lit(cap.tokens))
    parts = parts.select("doc_id", F.col("part").cast("int"), (F.col("part") * cap.tokens).alias("tok_start"), size.alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    parts = cut_lineage(parts)
    whole = F.col("n_tokens") == cap.tokens
    loose = parts.where((F.col("n_tokens") > 0) & ~whole)
    shards = max(1, -(-loose.count() // shard_pieces))
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "row"), F.lit(shards)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        return pdf.assign(container=vector_best_fit(pdf["n_tokens"].to_numpy(), cap))

    filled = dealt.groupBy("shard").applyInPandas(fill, "doc_id long, part int, tok_start long, n_tokens long, row long, shard int, container long")
    names = ["doc_id", "part", "tok_start", "n_tokens"]
    # container numbers: shard and number within it; full ones, which nothing else fits into, are numbered by row
    packed = filled.select(*names, (F.col("shard") * F.lit(2**32) + F.col("container")).alias("container"), "shard")
    alone = parts.where(whole).select(*names, (-F.col("row") - 1).alias("container"), F.lit(-1).alias("shard"))
    empty = parts.where("n_tokens = 0").select(*names, F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("shard"))
    return packed.unionByName(alone).unionByName(empty)


def pack_report(packed: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """One row: pieces, tokens, containers, the fewest that could do, and the share of space that is used."""
    bins = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return bins.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count("*").alias("containers"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / cap.tokens).alias("fewest"), F.round(F.sum("t") / (F.count("*") * cap.tokens), 6).alias("fill"), F.max("t").alias("fullest"),
    )
