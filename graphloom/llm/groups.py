"""Connected groups of pairwise matches on a two-dimensional grid (problem 4).

Pairs are contracted where they lie, before anything is shuffled: every task runs a union-find over its pairs
and hands on one spanning star per local group, at most as many edges as it has vertices. Vertices are then
hashed into blocks; the edge (u, v) belongs to the partition (block of u, block of v) of a grid, whose side
follows the number of edges so that a partition holds ``cell`` of them. Every partition runs a union-find again.
Rows and columns exchange representatives: a vertex takes the least one that any partition found for it, and
the edges left between representatives go through the (smaller) grid again until no parent changes.

Defined cases
* the group of a vertex is named by its least member; a vertex without partner is its own group
* null endpoints are dropped; loops, repeated and reversed pairs change nothing; no pairs give no rows
* a vertex with very many partners spreads over the partitions of one row, each holding a part of them
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, salted_join


def local_union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least index of each vertex's group, for edges between indices below n: hooking and path halving in bulk."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        open_ = lo != hi
        if not open_.any():
            break
        u, v, lo, hi = u[open_], v[open_], lo[open_], hi[open_]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _stars(edges: list[pa.RecordBatch], loops: bool) -> pa.Table:
    """Spanning stars (u = least member, v = member) of batches of edges; with ``loops`` also (u, u), so that every vertex is a v."""
    rows = sum(b.num_rows for b in edges)
    both = pa.chunked_array([b.column(k) for k in (0, 1) for b in edges]).combine_chunks()
    coded = both.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy()]
    names = coded.dictionary.take(pa.array(order))
    parent = local_union_find(codes[:rows], codes[rows:], len(names))
    member = np.arange(len(names)) if loops else np.flatnonzero(parent != np.arange(len(names)))
    return pa.table({"u": names.take(pa.array(parent[member])), "v": names.take(pa.array(member))})


def _contract(chunk: int):
    """Stars of one partition. Edges come in chunks and only stars are kept, so memory follows the vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, kept = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= max(chunk, 2 * kept):
                stars = _stars(held, False)
                held, rows, kept = stars.to_batches(), stars.num_rows, stars.num_rows
        if rows:
            yield from _stars(held, False).to_batches(max_chunksize=65536)

    return run


def _local(chunk: int):
    """Stars of stretches of about ``chunk`` pairs, with loops: bounded memory, as the pairs of a task are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield from _stars(held, True).to_batches(max_chunksize=65536)
                held, rows = [], 0
        if rows:
            yield from _stars(held, True).to_batches(max_chunksize=65536)

    return run


def components(pairs: DataFrame, u: str, v: str, blocks: int | None = None, max_rounds: int = 50, cell: int = 1_000_000, chunk: int = 500_000) -> DataFrame:
    """(vertex, group) for every vertex of ``pairs``. ``blocks`` squared partitions make up the grid; None: by ``cell`` edges each."""
    kind = dict(pairs.dtypes)[u]
    ddl = f"u {kind}, v {kind}"
    named = pairs.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    local = cut_lineage(named.mapInArrow(_local(chunk), ddl))
    edges, labels = local.where(F.col("u") != F.col("v")), None
    for _ in range(max_rounds):
        side = blocks or max(1, int(np.ceil(np.sqrt(edges.count() / cell))))
        block = [F.pmod(F.xxhash64(c), F.lit(side)) for c in ("u", "v")]
        place = (block[0] * side + block[1]).cast("int")
        stars = cut_lineage(edges.repartitionById(side * side, place).mapInArrow(_contract(chunk), ddl))
        if side == 1:  # one partition saw every edge left, and its stars are the groups
            roots = stars.select("v", F.col("u").alias("p"))
            labels = roots if labels is None else _flatten(labels.unionByName(roots))
            break
        # exchange along rows and columns: a vertex takes the least representative that any partition found
        roots = _flatten(cut_lineage(stars.groupBy("v").agg(F.min("u").alias("p"))))
        labels = roots if labels is None else labels.unionByName(roots)
        # what links two different roots is an edge of the next, smaller graph; a vertex stands in at most one
        # star per partition, and a representative of very many members is reduced before it is looked up
        half = stars.join(roots, "v").where(F.col("p") != F.col("u")).select("p", "u").distinct()
        other = roots.select(F.col("v").alias("u"), F.col("p").alias("q"))
        links = half.join(other, "u", "left").select("p", F.coalesce("q", "u").alias("q")).where(F.col("p") != F.col("q"))
        edges = cut_lineage(links.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        if edges.isEmpty():
            labels = _flatten(labels)
            break
    else:
        raise RuntimeError(f"parents still change after {max_rounds} rounds")
    # every vertex by itself or by its group, whose name is less than any other member's
    every = local.select("v", F.col("v").alias("p")).unionByName(labels)
    return every.groupBy(F.col("v").alias("vertex")).agg(F.min("p").alias("group"))


def _flatten(labels: DataFrame) -> DataFrame:
    """Pointer doubling until every vertex points at a root. ``labels``: one parent p < v for each v that has one."""
    while True:
        heads = labels.select("p").distinct()
        moves = cut_lineage(heads.join(labels.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p"))
        if moves.isEmpty():
            return labels
        # a parent may be that of a third of all vertices
        labels = cut_lineage(salted_join(labels, moves, "p", "left").select("v", F.coalesce("pp", "p").alias("p")))


def mention_pairs(articles: DataFrame) -> DataFrame:
    """Each mention beside the first of its cluster, as sortable keys; a lone mention is paired with itself.

    A star per cluster links the same mentions as all its pairs. Null clusters, mentions and positions
    give nothing.
    """
    cluster = articles.where(F.col("article_id").isNotNull()).select("article_id", F.explode("clusters").alias("c"))
    clean = F.filter("c", lambda m: m.isNotNull() & m["start"].isNotNull() & m["end"].isNotNull())
    keyed = F.transform(clean, lambda m: mention_key(F.col("article_id"), m))
    cluster = cluster.select(keyed.alias("c")).where(F.size("c") > 0)
    return cluster.select(F.array_min("c").alias("u"), F.explode("c").alias("v"))


def mention_key(article: Column, mention: Column) -> Column:
    """16 bytes that sort as (article, start, end): big-endian integers, moved so that negative ones sort too."""
    short = lambda c: F.lpad(F.hex(c.cast("long") + F.lit(1 << 31)), 8, "0")
    return F.unhex(F.concat(F.lpad(F.hex(article.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), short(mention["start"]), short(mention["end"])))


def read_key(c: Column) -> tuple[Column, Column, Column]:
    """(article_id, start, end) of a mention key."""
    number = lambda at, n, off, kind: (F.conv(F.substring(F.hex(c), at, n), 16, 10).cast("decimal(20,0)") - F.lit(str(off)).cast("decimal(20,0)")).cast(kind)
    return number(1, 16, 1 << 63, "long"), number(17, 8, 1 << 31, "int"), number(25, 8, 1 << 31, "int")


def mention_groups(articles: DataFrame) -> DataFrame:
    """(article_id, m_start, m_end, g_start, g_end): every mention with the first mention of its group."""
    grouped = components(mention_pairs(articles), "u", "v")
    a, ms, me = read_key(F.col("vertex"))
    _, gs, ge = read_key(F.col("group"))
    return grouped.select(a.alias("article_id"), ms.alias("m_start"), me.alias("m_end"), gs.alias("g_start"), ge.alias("g_end"))
