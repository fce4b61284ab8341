"""Cutting oversized texts at sentence ends, with overlap (problem 3).

A text is an ordered row of sentences, each a number of tokens. Positions are token offsets. A piece ends
at the last sentence end within ``limit`` tokens of its start, or after ``limit`` tokens where there is none;
the next piece begins with the sentence before that end, or ``overlap`` tokens before it if that sentence is
longer. The end of a piece thus decides the next one from what lies at most ``limit`` tokens ahead and
``overlap`` behind, so ranges of one text are worked on by different tasks. Every text, short or long, goes this way:

1. every range, with a halo of sentence ends on both sides, maps each end that can reach it to the end by
   which the walk leaves it (a boundary table of at most ``limit`` entries per range);
2. the boundary tables of a text are stitched from range to range; only these small tables are gathered;
3. each range emits the pieces that begin from its own entry, by offset.

Texts come as rows of sentences (``article_lengths``: of a row only its sentence lengths are kept) or as files of
any size (``file_sentences``: byte ranges, each read with a halo by its own task; no file is loaded as a whole).

Defined cases
* null, empty and all-blank tokens (Unicode blanks included) do not count; a sentence of such has no tokens
* null or empty texts give no piece; a text of at most ``limit`` tokens is one piece
* repeated rows of one text are the caller's to drop (``article_sentences`` keeps the latest per article)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Unicode blanks, as str.isspace() sees them
BLANK = r"^[\s\u001c-\u001f\u0085\p{Z}]*$"


def real_tokens(sentence: Column) -> Column:
    """Number of tokens of one sentence that count."""
    return F.coalesce(F.size(F.filter(sentence, lambda t: t.isNotNull() & ~t.rlike(BLANK))), F.lit(0))


def article_lengths(articles: DataFrame) -> DataFrame:
    """(article_id, lens): tokens per sentence of the latest delivery of every article, in order."""
    lens = F.coalesce(F.transform("tokens", lambda s: F.when(s.isNotNull(), real_tokens(s)).otherwise(0)), F.array().cast("array<int>"))
    rows = articles.where(F.col("article_id").isNotNull()).select("article_id", "ingested_at", lens.alias("lens"))
    # Lengths, not words, are shuffled; equally late deliveries are told apart by the lengths themselves.
    return rows.groupBy("article_id").agg(F.max_by("lens", F.struct("ingested_at", "lens")).alias("lens"))


def steps(ends: np.ndarray, at: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For piece ends ``at``: start and end of the piece that follows. ``ends``: all sentence ends, sorted, from 0."""
    before = ends[np.maximum(np.searchsorted(ends, at, "left") - 1, 0)]
    start = np.where(at == 0, 0, at - np.minimum(at - before, overlap))
    last = ends[np.searchsorted(ends, start + limit, "right") - 1]
    return start, np.where(last > at, last, np.minimum(start + limit, ends[-1]))


#: one range of a text: its sentences with halo, numbered from ``sent``, by where they end and how long they are
_RANGE = "`range` long, total long, sent long, ends array<long>, lens array<int>"


def _rows(schema: str, key: str, kind: str) -> str:
    return f"{key} {kind}, {schema}"


def ranges_of_lengths(lengths: DataFrame, limit: int, overlap: int, span: int, key: str = "article_id") -> DataFrame:
    """Ranges of texts (key, lens): prefix sums of a text's own lengths, no shuffle."""
    kind = dict(lengths.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            values, bounds = np.asarray(column.values), np.asarray(column.offsets)
            out: list[tuple] = []
            for row, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])):
                n = values[i:j].astype(np.int64)
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                for r in range(-(-total // span)):
                    lo, hi = r * span, min((r + 1) * span, total)
                    first = int(np.searchsorted(ends, lo - limit - overlap, "left"))
                    last = int(np.searchsorted(ends - n, hi + limit, "right"))
                    out.append((row, r, total, first, ends[first:last], n[first:last].astype(np.int32)))
            yield _batch(key, b.column(0), out)

    return lengths.select(key, "lens").where("size(lens) > 0").mapInArrow(cut, _rows(_RANGE, key, kind))


def _batch(key: str, keys: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    lists = lambda k, kind: pa.array([x[k] for x in out], pa.list_(kind))
    plain = lambda k: pa.array([x[k] for x in out], pa.int64())
    return pa.RecordBatch.from_arrays([keys.take(plain(0)), plain(1), plain(2), plain(3), lists(4, pa.int64()), lists(5, pa.int32())], names=[key, "range", "total", "sent", "ends", "lens"])


def ranges_of_sentences(sentences: DataFrame, limit: int, overlap: int, span: int, key: str = "article_id") -> DataFrame:
    """Ranges of texts that come sentence by sentence (key, sent, n), of any length.

    Lengths become offsets in two levels, blocks of sentences and sentences in a block, so that no window
    holds all sentences of a text.
    """
    block = F.floor(F.col("sent") / 4096)
    sums = sentences.groupBy(key, block.alias("block")).agg(F.sum("n").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(key, "block", before.alias("base"), F.sum("s").over(Window.partitionBy(key)).alias("total"))
    inner = F.sum("n").over(Window.partitionBy(key, "block").orderBy("sent").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offs = sentences.withColumn("block", block).withColumn("e", inner).join(base, [key, "block"]).where("total > 0")
    offs = offs.select(key, "sent", "total", (F.col("base") + F.col("e")).alias("end"), "n")
    # A sentence belongs to its range and, as halo, to the ranges it can influence.
    lo = F.ceil((F.col("end") - F.col("n") - limit) / span) - 1
    hi = F.floor((F.col("end") + limit + overlap) / span)
    marks = offs.withColumn("range", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.floor((F.col("total") - 1) / span)))))
    packed = marks.groupBy(key, "range", "total").agg(F.sort_array(F.collect_list(F.struct(F.col("sent").cast("long").alias("sent"), F.col("end").cast("long").alias("end"), F.col("n").cast("int").alias("n")))).alias("m"))
    return packed.select(key, F.col("range").cast("long"), F.col("total").cast("long"), F.get("m", F.lit(0))["sent"].alias("sent"), F.transform("m", lambda x: x["end"]).alias("ends"), F.transform("m", lambda x: x["n"]).alias("lens"))


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(range, total, first sentence, ends, lens) of every row."""
    rng, total, sent = (batch.column(k).to_pylist() for k in (1, 2, 3))
    ends, lens = batch.column(4), batch.column(5)
    ev, eo, lv, lo = np.asarray(ends.values), np.asarray(ends.offsets), np.asarray(lens.values), np.asarray(lens.offsets)
    for i in range(batch.num_rows):
        yield rng[i], total[i], sent[i], ev[eo[i] : eo[i + 1]], lv[lo[i] : lo[i + 1]]


def _known(ends: np.ndarray, lens: np.ndarray, total: int) -> np.ndarray:
    """Places near a range where a piece may end: ends and beginnings of its sentences, and the end of the text."""
    return np.unique(np.concatenate([ends, ends - lens, [total]]))


def boundary_tables(ranges: DataFrame, limit: int, overlap: int, span: int, key: str = "article_id") -> DataFrame:
    """(key, range, total, leaves, counts, long): for every place by which the walk can enter a range, in order, where
    it leaves and after how many pieces; and the sentences over the limit that end in the range."""
    kind = dict(ranges.dtypes)[key]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves, counts, long = [], [], []
            for rng, total, sent, ends, lens in _unpack(b):
                lo, hi = rng * span, min((rng + 1) * span, total)
                known = _known(ends, lens, total)
                at = np.array([0]) if rng == 0 else np.arange(lo, min(lo + limit + 1, hi), dtype=np.int64)
                count = np.zeros(len(at), dtype=np.int64)
                while (inside := at < hi).any():
                    at[inside] = steps(known, at[inside], limit, overlap)[1]
                    count[inside] += 1
                leaves.append(at)
                counts.append(count)
                long.append(sent + np.flatnonzero((lens > limit) & (ends > lo) & (ends <= hi)))
            many = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), many(leaves), many(counts), many(long)], names=[key, "range", "total", "leaves", "counts", "long"])

    return ranges.mapInArrow(tables, f"{key} {kind}, `range` long, total long, leaves array<long>, counts array<long>, long array<long>")


def stitched(tables: DataFrame, span: int, key: str = "article_id") -> DataFrame:
    """(key, range, entry, number, last): by which place the walk enters each range and as which piece; ``last`` is the
    number of pieces up to the range's end. Ranges that a piece jumps over are left out. Only the tables are gathered, in order."""
    kind = dict(tables.dtypes)[key]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, number = object(), 0, 0
        for b in batches:
            out: list[tuple] = []
            lv, lo, cv = np.asarray(b.column(3).values), np.asarray(b.column(3).offsets), np.asarray(b.column(4).values)
            for i, (k, rng, total) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
                if k != now:
                    now, at, number = k, 0, 0
                if at >= min((rng + 1) * span, total):
                    continue
                place = lo[i] + (at - rng * span if rng else 0)
                out.append((i, rng, at, number, number + int(cv[place])))
                at, number = int(lv[place]), number + int(cv[place])
            cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:]], names=[key, "range", "entry", "number", "last"])

    rows = tables.select(key, "range", "total", "leaves", "counts").repartition(key).sortWithinPartitions(key, "range")
    return rows.mapInArrow(walk, f"{key} {kind}, `range` long, entry long, number long, last long")


def oversized(lengths: DataFrame, limit: int = 512, overlap: int = 32, span: int = 2048) -> DataFrame:
    """(article_id, sent_no): texts over the limit (-1) and single sentences over it (their place), from the boundary tables.

    A text over the limit is one whose stitched walk takes more than one piece; a long sentence is met in the range it ends in.
    """
    tables = boundary_tables(ranges_of_lengths(lengths, limit, overlap, span), limit, overlap, span)
    whole = stitched(tables, span).where("last > 1").select("article_id", F.lit(-1).alias("sent_no")).distinct()
    return whole.unionByName(tables.select("article_id", F.explode(F.col("long").cast("array<int>")).alias("sent_no")))


def range_pieces(ranges: DataFrame, limit: int = 512, overlap: int = 32, span: int = 2048, key: str = "article_id") -> DataFrame:
    """(key, piece, start, end, first_sentence, last_sentence) of texts cut into ranges, by token offset."""
    kind = dict(ranges.dtypes)[key]
    entries = stitched(boundary_tables(ranges, limit, overlap, span, key), span, key)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            entry, number = b.column(6).to_pylist(), b.column(7).to_pylist()
            for i, (rng, total, sent, ends, lens) in enumerate(_unpack(b)):
                known = _known(ends, lens, total)
                at, no, hi = np.array([entry[i]]), number[i], min((rng + 1) * span, total)
                while at[0] < hi:
                    start, at = steps(known, at, limit, overlap)
                    s, e = int(start[0]), int(at[0])
                    # empty sentences share an end with the one before and hold nothing
                    out.append((i, no, s, e, sent + int(np.searchsorted(ends, s, "right")), sent + int(np.searchsorted(ends, e, "left"))))
                    no += 1
            cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), cols[1].cast(pa.int32()), cols[2], cols[3], cols[4].cast(pa.int32()), cols[5].cast(pa.int32())], names=[key, "piece", "start", "end", "first_sentence", "last_sentence"])

    held = ranges.join(entries, [key, "range"]).select(*ranges.columns, "entry", "number")
    return held.mapInArrow(emit, f"{key} {kind}, piece int, start long, end long, first_sentence int, last_sentence int")


def pieces(lengths: DataFrame, limit: int = 512, overlap: int = 32, span: int = 2048) -> DataFrame:
    """(article_id, piece, start, end, first_sentence, last_sentence) of texts with (article_id, lens)."""
    return range_pieces(ranges_of_lengths(lengths, limit, overlap, span), limit, overlap, span)


def article_pieces(articles: DataFrame, limit: int = 512, overlap: int = 32, span: int = 2048) -> DataFrame:
    """``pieces`` of the latest delivery of every article, each with its words (``text``, joined by blanks)."""
    lens = F.coalesce(F.transform("tokens", lambda s: F.when(s.isNotNull(), real_tokens(s)).otherwise(0)), F.array().cast("array<int>"))
    rows = articles.where(F.col("article_id").isNotNull()).select("article_id", "ingested_at", "tokens", lens.alias("lens"))
    last = rows.groupBy("article_id").agg(F.max_by(F.struct("tokens", "lens"), F.struct("ingested_at", "lens", F.xxhash64("tokens"))).alias("x")).select("article_id", "x.*")
    cut = pieces(last.select("article_id", "lens"), limit, overlap, span)
    real = F.filter(F.flatten(F.filter("tokens", lambda s: s.isNotNull())), lambda t: t.isNotNull() & ~t.rlike(BLANK))
    words = last.select("article_id", real.alias("words"))
    said = F.array_join(F.slice("words", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")), " ")
    return words.join(cut, "article_id").select("article_id", "piece", "start", "end", "first_sentence", "last_sentence", said.alias("text"))


#: a sentence of a file ends behind a full stop, exclamation or question mark before a blank, and at a line's end
_FILE_END = re.compile(rb"[.!?][\"')\]]*[ \t\r\n]|\n")


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _first_end(f, at: int, size: int, chunk: int) -> int:
    """End of the sentence that runs at byte ``at``, found chunk by chunk; the file's end if none follows."""
    held = b""
    while at < size:
        f.seek(at)
        data = f.read(chunk)
        if m := _FILE_END.search(held + data):
            return at - len(held) + m.end()
        held = data[-8:]  # a mark and the blank behind it may lie on both sides
        at += len(data)
    return size


def file_sentences(spark: SparkSession, path: str, range_bytes: int = 64 << 20, chunk: int = 1 << 20) -> DataFrame:
    """(path, sent, byte, n): every sentence of text files with the byte it begins at and its number of words.

    A file is cut into byte ranges, one task each. A range owns the sentences that begin in it: it looks a few bytes
    back to see whether one begins at its front, and ahead of its end (the halo) until its last one ends. Files
    are read in chunks; of a sentence only its length is kept. Sentences are numbered by prefix sums over the ranges.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    cuts = files.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))))
    cuts = cuts.repartition(F.xxhash64("path", "range"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, size, rng in zip(*(b.column(k).to_pylist() for k in range(3))):
                lo, hi = rng * range_bytes, min((rng + 1) * range_bytes, size)
                begins, counts = [], []
                with _opened(p) as f:
                    at = 0 if lo == 0 else _first_end(f, max(lo - 1, 0), size, chunk)
                    if lo:  # a mark right before the front ends a sentence at the front or behind it
                        f.seek(max(lo - 8, 0))
                        near = [max(lo - 8, 0) + m.end() for m in _FILE_END.finditer(f.read(16))]
                        at = min([e for e in near if e >= lo] + [at])
                    while at < hi:
                        end = _first_end(f, at, size, chunk)
                        words, inside, place = 0, False, at
                        f.seek(at)
                        while place < end:
                            data = f.read(min(chunk, end - place))
                            parts = data.split()
                            words += len(parts) - (1 if parts and inside and not data[:1].isspace() else 0)
                            inside, place = not data[-1:].isspace(), place + len(data)
                        begins.append(at)
                        counts.append(words)
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(begins), pa.string()), pa.array([rng] * len(begins), pa.int64()), pa.array(begins, pa.int64()), pa.array(counts, pa.int32()), pa.array(range(len(begins)), pa.int64())], names=["path", "range", "byte", "n", "i"])

    found = cuts.select("path", "size", "range").mapInArrow(read, "path string, `range` long, byte long, n int, i long")
    size = found.groupBy("path", "range").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(size.select("path", "range", before.alias("before")), ["path", "range"]).select("path", (F.col("before") + F.col("i")).alias("sent"), "byte", "n")


def file_pieces(spark: SparkSession, path: str, limit: int = 512, overlap: int = 32, span: int = 1 << 16, range_bytes: int = 64 << 20) -> DataFrame:
    """(path, piece, start, end, first_sentence, last_sentence, byte): pieces of text files by word offset, with the byte their first sentence begins at."""
    sentences = file_sentences(spark, path, range_bytes)
    cut = range_pieces(ranges_of_sentences(sentences.select("path", "sent", "n"), limit, overlap, span, "path"), limit, overlap, span, "path")
    return cut.join(sentences.select("path", F.col("sent").cast("int").alias("first_sentence"), "byte"), ["path", "first_sentence"])
