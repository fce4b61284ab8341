"""From article pages to tokenised, linked documents; token rows, windows and coreference clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_tokens, flatten_tokens, format_wikilink, sentence_offsets, sentence_windows
from ..sources.readers import CLUSTERS, CorefProvider

FORMULA = "__LATEX_FORMULA__"
_DROP_TAGS = {"div", "table", "ul", "style"}
_DROP_CLASSES = {"reference", "noprint", "mw-empty-elt"}
_CLUSTERS = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "col", "area", "base", "embed", "track"}


class _Segments(HTMLParser):
    """Text segments of the first ``root`` element: (text, title of the link it is in, leading bold)."""

    def __init__(self, root: str):
        super().__init__(convert_charrefs=True)
        self.root, self.depth, self.skip, self.started, self.done = root, 0, 0, False, False
        self.out: list[list] = []
        self.held: list[tuple[str, str | None, int]] = []

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if not self.started:
            self.started = tag == self.root
            self.depth = 1 if self.started else 0
            return
        if tag in _VOID:
            return
        self.depth += 1
        if self.skip:
            return
        at = dict(attrs)
        classes = set((at.get("class") or "").split())
        if tag in _DROP_TAGS or classes & _DROP_CLASSES or (tag == "span" and "mw-editsection" in classes) or re.match(r"h[1-6]", tag):
            self.skip = self.depth
        elif tag == "span" and "mwe-math-element" in classes:
            self.handle_data(FORMULA)
            self.skip = self.depth
        elif tag == "a" and not self.held:
            self.held.append(("a", at.get("title"), self.depth))
            self.out.append(["", at.get("title"), False])
        elif tag == "b" and not self.held and len(self.out) < 50:
            self.held.append(("b", None, self.depth))
            self.out.append(["", None, True])

    def handle_endtag(self, tag):
        if not self.started or self.done or tag in _VOID:
            return
        if self.skip == self.depth:
            self.skip = 0
        if self.held and self.held[-1][2] == self.depth:
            self.held.pop()
        self.depth -= 1
        self.done = self.depth == 0

    def handle_data(self, data):
        if not self.started or self.done or self.skip:
            return
        if self.held:
            self.out[-1][0] += data
        else:
            self.out.append([data, None, False])


def page_segments(html: str | None, root: str = "div") -> list[dict]:
    if not html:
        return []
    p = _Segments(root)
    p.feed(html)
    p.close()
    return [{"text": t, "link": link, "bold": bold} for t, link, bold in p.out]


def html_documents(pages: DataFrame, wiki: DataFrame, key: str = "article_id", root: str = "div") -> DataFrame:
    """(key, title, tokens, entities): sentences of words and [start, end) spans of links to known titles.

    Links are resolved by a join, tokens and offsets stay in the JVM; only the markup walk is Python. A page
    with a leading bold is left out if its own title is unknown; null pages are left out.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "title": b["title"], "segments": [page_segments(h, root) for h in b["html"]]})

    kind = dict(pages.dtypes)[key]
    seg = pages.where("html IS NOT NULL").select(key, "title", "html").mapInPandas(walk, f"{key} {kind}, title string, segments array<struct<text:string,link:string,bold:boolean>>")
    rows = seg.select(key, "title", F.posexplode("segments").alias("i", "s"))
    rows = rows.withColumn("words", alias_tokens("s.text")).withColumn("target", format_wikilink(F.when(F.col("s.bold"), F.col("title")).otherwise(F.col("s.link"))))
    named = rows.join(wiki.groupBy(F.col("title").alias("target")).agg(F.min("id").alias("id")), "target", "left")
    per = named.groupBy(key, "title").agg(
        F.sort_array(F.collect_list(F.struct("i", "words", "id"))).alias("segs"), F.bool_or(F.col("s.bold") & F.col("id").isNull()).alias("lost")
    ).where(~F.col("lost"))
    words = F.flatten(F.transform("segs", lambda s: s["words"]))
    offsets = sentence_offsets(F.transform("segs", lambda s: s["words"]))
    spans = F.transform(F.arrays_zip("segs", offsets.alias("at")), lambda z: F.struct(z["segs"]["id"].alias("id"), z["at"].alias("start"), (z["at"] + F.size(z["segs"]["words"])).alias("end")))
    return per.select(key, "title", sentences(words).alias("tokens"), F.filter(spans, lambda e: e["id"].isNotNull() & (e["end"] > e["start"])).alias("entities"))


def sentences(words):
    """Words cut behind full stops, exclamation and question marks."""
    ends = F.filter(F.transform(words, lambda w, i: F.when(w.isin(".", "!", "?"), i + 1)), lambda i: i.isNotNull())
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(words))))
    cut = lambda b, w: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda e, i: F.slice(w, F.get(b, i) + 1, e - F.get(b, i)))
    return F.get(F.transform(F.array(F.struct(words.alias("w"), bounds.alias("b"))), lambda x: F.when(F.size(x["w"]) > 0, cut(x["b"], x["w"])).otherwise(F.array().cast("array<array<string>>"))), 0)


def token_rows(docs: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, pos, token, id) with the id of the last wiki link that covers the token."""
    toks = docs.select(key, F.posexplode(flatten_tokens("tokens")).alias("pos", "token"))
    links = docs.select(key, F.posexplode("entities").alias("no", "e")).where("e.end > e.start")
    pos = links.select(key, "no", F.col("e.id").alias("id"), F.explode(F.sequence(F.col("e.start"), F.col("e.end") - 1)).alias("pos"))
    last = pos.groupBy(key, "pos").agg(F.max_by("id", "no").alias("id"))
    return toks.join(last, [key, "pos"], "left")


def runs(rows: DataFrame, value: str, key: str = "article_id", order: str = "pos") -> DataFrame:
    """(key, value, start, end) of runs of equal values; null values break runs and give none."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col(order) - F.lag(order).over(w) != 1)
    numbered = rows.withColumn("run", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(w)).where(F.col(value).isNotNull())
    return numbered.groupBy(key, "run", value).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("run")


def window_rows(docs: DataFrame, key: str = "article_id", size: int = 3) -> DataFrame:
    """(key, window_no, offset, sentences): every window of sentences with the token offset it begins at."""
    return docs.select(key, sentence_offsets("tokens").alias("offs"), F.posexplode(sentence_windows("tokens", size)).alias("window_no", "sentences")).select(
        key, "window_no", F.get("offs", F.col("window_no")).alias("offset"), "sentences"
    )


def coreference(docs: DataFrame, provider: CorefProvider, key: str = "article_id", size: int = 3) -> DataFrame:
    """(key, clusters, failed): clusters of all windows by a provider, moved to document positions and merged.

    A window whose call fails gives no cluster and is counted in ``failed``. Mentions (sentence, start, end) count from 1, end exclusive;
    clusters have inclusive ends.
    """
    kind = dict(docs.dtypes)[key]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, off, sents in zip(b[key], b["offset"], b["sentences"]):
                sents = [list(s) for s in sents]
                begins = [sum(map(len, sents[:i])) for i in range(len(sents))]
                try:
                    found = provider(sents)
                except Exception:  # noqa: BLE001
                    out.append((k, None, 1))
                    continue
                for cluster in found:
                    out.append((k, [{"start": int(off + begins[s - 1] + i - 1), "end": int(off + begins[s - 1] + j - 2)} for s, i, j in cluster], 0))
            yield pd.DataFrame(out, columns=[key, "cluster", "failed"])

    found = window_rows(docs, key, size).mapInPandas(call, f"{key} {kind}, cluster array<struct<start:int,end:int>>, failed int")
    return merge_clusters(found.groupBy(key).agg(F.collect_list("cluster").alias("clusters"), F.sum("failed").cast("int").alias("failed")), key, "failed")


def merged(clusters: list) -> list[list[tuple[int, int]]]:
    """Clusters joined where they share a mention, in the order of their first mention: union-find over the numbers of sorted mentions."""
    spans = [sorted({(m["start"], m["end"]) for m in (c if c is not None else []) if m is not None}) for c in clusters or []]
    every = sorted({m for c in spans for m in c})
    number = {m: i for i, m in enumerate(every)}
    up = list(range(len(every)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for c in spans:
        for m in c[1:]:
            a, b = top(number[c[0]]), top(number[m])
            up[max(a, b)] = min(a, b)  # the least mention stays on top, so groups come out in its order
    groups: dict[int, list] = {}
    for i, m in enumerate(every):
        groups.setdefault(top(i), []).append(m)
    return list(groups.values())


def merge_clusters(docs: DataFrame, key: str = "article_id", *keep: str) -> DataFrame:
    """(key, clusters) and columns to keep, with the clusters of each document merged; null clusters give an empty list."""
    kinds = dict(docs.dtypes)
    ddl = ", ".join([f"{key} {kinds[key]}", f"clusters {CLUSTERS}", *[f"{c} {kinds[c]}" for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [[[{"start": s, "end": e} for s, e in c] for c in merged(cs)] for cs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, _CLUSTERS), *b.columns[2:]], names=[key, "clusters", *keep])

    return docs.select(key, "clusters", *keep).mapInArrow(run, ddl)


def cluster_entities(docs: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, cluster_no, ids): the distinct ids of links inside each cluster's mentions."""
    m = docs.select(key, F.posexplode("clusters").alias("cluster_no", "c")).select(key, "cluster_no", F.explode("c").alias("m")).where("m.end >= m.start")
    pos = m.select(key, "cluster_no", F.explode(F.sequence(F.col("m.start"), F.col("m.end"))).alias("pos"))
    hit = pos.join(token_rows(docs, key).where("id IS NOT NULL"), [key, "pos"])
    return hit.groupBy(key, "cluster_no").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"), F.countDistinct("id").alias("n_ids"))
