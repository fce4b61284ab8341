"""Readers: entity dump, wiki export, JSON lines, allow-lists, titles, pre-fetched pages, providers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_DDL = "title string, tokens array<array<string>>, entities array<array<string>>, nel array<struct<score:double,tokens:string,start:int,end:int,label:string>>, clusters array<array<array<int>>>"
SPANS = "array<struct<id:string,start:int,end:int>>"
CLUSTERS = "array<array<struct<start:int,end:int>>>"


def dump_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines of an entity dump as clean JSON: brackets and trailing commas dropped, unreadable lines left out."""
    # an entity begins and ends with a brace, so only the dump's own signs can be cut off
    clean = F.rtrim(F.ltrim(F.col(column), F.lit("[ \t\r\n")), F.lit("], \t\r\n"))
    out = lines.withColumn(column, clean)
    return out.where(F.col(column).startswith("{") & F.try_parse_json(F.col(column)).isNotNull())


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(line_no, line) of a plain, gzip or bzip2 dump. A gzip file is one split, so it is spread at once."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return dump_lines(raw.repartition(partitions) if partitions else raw)


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    """(from_title, to_title) of a wiki export's redirect pages."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, redirect struct<_title:string>").load(path)
    return pages.where(F.col("redirect._title").isNotNull()).select(F.col("title").alias("from_title"), F.col("redirect._title").alias("to_title"))


def read_wikitext(spark: SparkSession, path: str) -> DataFrame:
    """(title, wikitext) of a wiki export."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text:struct<_VALUE:string>>").load(path)
    return pages.select("title", F.col("revision.text._VALUE").alias("wikitext"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents in JSON lines, spans as structs; entities and clusters are arrays of arrays on disk."""
    raw = spark.read.schema(DOCUMENT_DDL).json(path)
    spans = F.transform("entities", lambda e: F.struct(F.get(e, 0).alias("id"), F.get(e, 1).try_cast("int").alias("start"), F.get(e, 2).try_cast("int").alias("end")))
    clusters = F.transform("clusters", lambda c: F.transform(c, lambda m: F.struct(F.get(m, 0).alias("start"), F.get(m, 1).alias("end"))))
    return raw.where("title IS NOT NULL").withColumn("entities", spans.cast(SPANS)).withColumn("clusters", clusters.cast(CLUSTERS))


def read_list(spark: SparkSession, path: str | None, column: str = "id") -> DataFrame | None:
    """One stripped entry per line, without repeats; None stays None and restricts nothing."""
    if path is None:
        return None
    return spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "").distinct()


def read_properties(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Property ids out of the entity addresses in the first column of a CSV file."""
    if path is None:
        return None
    first = spark.read.csv(path).select(F.regexp_extract("_c0", r"(?<=/entity/)P\d+", 0).alias("prop"))
    return first.where("prop <> ''").distinct()


class Fetcher(Protocol):
    """Gives the page source of a title, or None."""

    def __call__(self, title: str) -> str | None: ...


def fetch_pages(titles: DataFrame, fetch: Fetcher, column: str = "title") -> DataFrame:
    """(title, html, error): pages from any provider, one call per title; a failing call leaves html null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b[column]:
                try:
                    rows.append((t, fetch(t), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((t, None, str(e)))
            yield pd.DataFrame(rows, columns=["title", "html", "error"])

    return titles.select(column).mapInPandas(run, "title string, html string, error string")


class CorefProvider(Protocol):
    """Clusters of one window of sentences: mentions as (sentence, start, end), counted from 1, end exclusive."""

    def __call__(self, sentences: list[list[str]]) -> list[list[tuple[int, int, int]]]: ...
