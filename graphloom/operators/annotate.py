"""The annotator: every mention of an entity with the relation and parent that explain it.

Set-based stages gather, per document, the ids it links to and the part of the knowledge graph that its own
words can reach: an object is reached from a subject if the rarest words of one of its names occur in the
document, and no object that comes before it has the same name (the first owner of a name keeps it). All edges
between reached ids are kept, and those to literals whose names begin with words of the document. Words and ids
travel as hashes; where two fall together, edges are kept that the document doesn't need, which changes nothing.
Then one sequential pass per document, in Arrow batches, merges the evidence (links, entity linker, coreference,
exact names) and tells each mention's story; a match changes the names that may match next, so this pass can't
be set-based.

Defined cases
* an unknown or null title gives an empty list of annotations; null entities, nel and clusters count as none
* spans outside the document are cut to it; a span with a null end covers nothing
* of equal distances, parents are taken in the order of relation and id
* repeated edges count once; of several alias rows of an entity all names count, in the order given
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import MONTHS, SHORT_MONTHS, amount_value, literal_id, plain_dates, written_amounts, written_dates
from ..functions.text import PRONOUNS, STOP_WORDS, alias_tokens, bad_alias, capitalize_tokens, flatten_tokens, format_wikilink
from ..session import shuffles_freed, written
from .trie import TokenTrie

ANNOTATION = "array<struct<source:string,id:string,relation:array<string>,parent_id:array<string>,span:array<int>>>"
_ANNOTATION = pa.list_(
    pa.struct([("source", pa.string()), ("id", pa.string()), ("relation", pa.list_(pa.string())), ("parent_id", pa.list_(pa.string())), ("span", pa.list_(pa.int32()))])
)
_ENTITY = re.compile(r"Q\d+")


@dataclass(frozen=True)
class Options:
    #: farthest a parent or earlier mention may lie, in tokens; None: no limit
    cutoff: int | None = None
    #: names of linked entities may match from the start
    match_aliases: bool = False
    #: linker ids count only if the document links to them too
    unmatch: bool = False
    #: mentions of a cluster must be pronouns or made of the entity's names
    prune_clusters: bool = False
    score: float = 0.5
    most_parents: int = 10
    #: property whose objects' names stand for the subject; edges behind it aren't looked at
    same_as: str = "P395"
    #: keep the trie's cursor where the document ended
    legacy: bool = False


class Session:
    """State of one document: ids and sources of its tokens, names that may match, parents, last mentions."""

    def __init__(self, tokens: list[str], names: dict[str, list[list[str]]], edges: dict[str, list[tuple[str, str]]], opt: Options):
        self.tokens, self.names, self.edges, self.opt = tokens, names, edges, opt
        n = len(tokens)
        self.ids: list[str | None] = [None] * n
        self.sources: list[str | None] = [None] * n
        self.story: list[tuple | None] = [None] * n
        self.trie = TokenTrie()
        #: names with other words can't match; with a cursor that is kept their beginnings count, too
        self.said = None if opt.legacy else frozenset(tokens)
        self.words: dict[str, set[str]] = {}
        self.parents: dict[str, set[tuple[str, str]]] = {}
        self.last: dict[str, int] = {}

    def cover(self, start, end) -> range:
        return range(0) if start is None or end is None else range(max(start, 0), min(end, len(self.tokens)))

    def stamp(self, where, name: str, source: str) -> None:
        for i in where:
            self.ids[i], self.sources[i] = name, source

    def learn(self, owner: str, source: str | None = None, new_only: bool = False) -> None:
        """Names of ``source`` (or of the owner) from now on match as ``owner``."""
        said, trie = self.said, self.trie
        for name in self.names.get(source or owner, ()):
            first = _capital(name[0])
            if said is not None and not ((name[0] in said or first in said) and (len(name) == 1 or said.issuperset(name[1:]))):
                continue
            if not (new_only and trie.find(name) is not None):
                trie.add(name, owner)
                if first != name[0]:
                    trie.add([first, *name[1:]], owner)

    def link(self, entities, nel, clusters, root: str) -> None:
        linked = {root}
        for e in entities:
            linked.add(e["id"])
            if self.opt.match_aliases:
                self.learn(e["id"])
            self.stamp(self.cover(e["start"], e["end"]), e["id"], "WIKI")
        for c in nel:
            where = self.cover(c["start"], c["end"])
            taken = any(self.ids[i] is not None for i in where)
            if c["id"] is not None and (c["score"] or 0) >= self.opt.score and not taken and (not self.opt.unmatch or c["id"] in linked):
                self.stamp(where, c["id"], "NEL")
        for cluster in clusters:
            spans = [self.cover(m["start"], None if m["end"] is None else m["end"] + 1) for m in (cluster if cluster is not None else []) if m is not None]
            if self.opt.prune_clusters:
                spans = self.pruned(spans)
            found = self.ids_in(spans)
            if len(found) == 1:
                name = found.pop()
                self.stamp([i for s in spans for i in s if self.ids[i] != name], name, "COREF")

    def ids_in(self, spans) -> set[str]:
        return {self.ids[i] for s in spans for i in s if self.ids[i] is not None}

    def pruned(self, spans: list[range]) -> list[range]:
        """Without mentions that are neither a pronoun nor made of the one entity's words and articles."""
        found = self.ids_in(spans)
        if len(found) != 1:
            return []
        name = found.pop()
        words = self.words.get(name)
        if words is None:
            words = self.words[name] = {"the", "The", "a", "A", "an", "An", "this", "This", "that", "That"}
            for n in self.names.get(name, ()):
                words.update([*n, _capital(n[0])])
        tokens = self.tokens
        return [s for s in spans if (len(s) == 1 and tokens[s.start].lower() in _PRONOUNS) or words.issuperset(tokens[s.start : s.stop])]

    def expand(self, name: str, at: int) -> None:
        """Brings an entity's neighbours in when it is first mentioned."""
        if name not in self.last:
            for prop, child in self.edges.get(name, ()):
                if prop == self.opt.same_as:
                    self.learn(name, child, new_only=True)
                    break
                self.parents.setdefault(child, set()).add((prop, name))
                self.learn(child, new_only=True)
        self.last[name] = at

    def explain(self, name: str, at: int) -> list[tuple[str, str]]:
        limit = float("inf") if self.opt.cutoff is None else self.opt.cutoff
        out = []
        if name in self.last and at - self.last[name] <= limit:
            out.append(("@@REFLEXIVE@@", name))
        near = sorted((at - self.last[p], prop, p) for prop, p in self.parents.get(name, ()))
        return out + [(prop, p) for d, prop, p in near if d < limit][: self.opt.most_parents]

    def run(self) -> None:
        i, n = 0, len(self.tokens)
        legacy, starts = self.opt.legacy, self.trie.root
        while i < n:
            if self.ids[i] is not None:
                name, end = self.ids[i], i + 1
                while end < n and self.ids[end] == name:
                    end += 1
            else:
                if not legacy and self.tokens[i] not in starts:
                    i += 1
                    continue
                end, name = self.trie.longest(self.tokens, i)
                if not legacy:
                    self.trie.reset()
            here, at = range(i, end), end + (end - i)
            i = end
            if name is None:
                continue
            story = self.explain(name, at)
            if not story:
                if not (_ENTITY.match(name) and any(self.sources[k] is not None for k in here)):
                    for k in here:
                        self.ids[k] = self.sources[k] = self.story[k] = None
                    continue
                story = [("@@NEW@@", name)]
            for k in here:
                self.ids[k], self.story[k] = name, tuple(story)
                self.sources[k] = self.sources[k] or "KG"
            if name in self.names:
                self.expand(name, at)

    def spans(self) -> list[dict]:
        """Runs of tokens that agree in source, id and story."""
        out: list[dict] = []
        before = None
        for i, now in enumerate(zip(self.sources, self.ids, self.story)):
            if now[1] is not None and now == before:
                out[-1]["span"][1] = i + 1
            elif now[1] is not None:
                story = now[2] or ()
                out.append({"source": now[0], "id": now[1], "relation": [r for r, _ in story], "parent_id": [p for _, p in story], "span": [i, i + 1]})
            before = now
        return out


@functools.lru_cache(maxsize=20_000)
def _capital(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def annotate_one(tokens, root, entities, nel, clusters, names, edges, opt: Options = Options()) -> list[dict]:
    """Annotations of one document. ``names``: id -> token lists; ``edges``: id -> [(prop, object id)]."""
    if root is None:
        return []
    s = Session(list(tokens), names, edges, opt)
    s.learn(root)
    s.link(entities or [], nel or [], clusters or [], root)
    s.run()
    return s.spans()


def graph_edges(relation: DataFrame, known: DataFrame, same_as: str = "P395") -> DataFrame:
    """(subject, ord, prop, child, kind, v): edges to entities and to literals, up to the first ``same_as`` edge to a known one.

    Edges to unknown entities are still among them; who looks names up drops them.
    """
    rows = relation.select("subject", "ord", "prop", F.col("value.type").alias("kind"), F.col("value.value").alias("v")).where("subject IS NOT NULL")
    ents = rows.where("kind = 'wikibase-entityid' AND v.id IS NOT NULL").select("subject", "ord", "prop", F.col("v.id").alias("child"), "kind", "v")
    lits = rows.where("kind IN ('time', 'quantity')").select("subject", "ord", "prop", literal_id(F.col("kind"), F.col("v")).alias("child"), "kind", "v").where("child IS NOT NULL")
    same = F.col("prop") == same_as
    stop = ents.where(same).join(known.select(F.col("id").alias("child")), "child", "left_semi").select("subject", "ord").unionByName(lits.where(same).select("subject", "ord"))
    stop = written(stop.groupBy("subject").agg(F.min("ord").alias("stop")))
    return ents.unionByName(lits).join(stop, "subject", "left").where(F.coalesce(F.col("ord") <= F.col("stop"), F.lit(True))).drop("stop")


def entity_names(aliases: DataFrame) -> DataFrame:
    """(id, ord, name): all usable names of entities, their tokens joined by blanks (no token holds a blank)."""
    rows = aliases.select("id", F.posexplode("aliases").alias("ord", "alias")).select("id", "ord", alias_tokens("alias").alias("name"))
    return rows.where(~bad_alias("name")).select("id", "ord", F.array_join("name", " ").alias("name"))


def name_keys(names: DataFrame) -> DataFrame:
    """(name, keys): hashes of the only word, or of the two adjoining words that the fewest names hold, of a name as it is and capitalised.

    A text with the name holds these words; that a thousand names begin alike doesn't matter then.
    """
    words = F.split("name", " ", -1)
    pairs = lambda t: F.when(F.size(t) == 1, F.array(F.hash(F.get(t, F.lit(0)), F.lit(None)))).otherwise(F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.hash(a, b)))
    forms = F.array_distinct(F.array(pairs(words), pairs(capitalize_tokens(words))))
    held = names.select("name").distinct().select("name", F.posexplode(forms).alias("form", "k")).select("name", "form", F.explode("k").alias("key"))
    least = held.join(held.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("name", "form").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    return least.groupBy("name").agg(F.collect_set("key").alias("keys"))


_ASCII = re.compile(r"[A-Za-z0-9]+(?:['.\-][A-Za-z0-9]+)*|[^\sA-Za-z0-9]")
_STOP = frozenset(STOP_WORDS)
_PRONOUNS = frozenset(PRONOUNS)


@functools.lru_cache(maxsize=20_000)
def date_names(iso: str, precision: int) -> list[list[str]]:
    """Tokens of all usable spellings of a date; these hold ASCII only, so this is the shared tokenizer."""
    found = (_ASCII.findall(x) for x in dict.fromkeys(written_dates(iso, precision)))
    return [t for t in found if not all(w.lower() in _STOP for w in t)]


def date_fronts(iso: str | None, precision: int | None) -> list[list[str]]:
    """First words of spellings, so that a text with any spelling holds some of them.

    A spelling that holds the bare year stands nowhere without the year, which is a spelling itself.
    """
    names = [_ASCII.findall(x) for x in dict.fromkeys(plain_dates(iso, precision))]
    if not all(names):  # a year without digits left: only the era is written
        names = date_names(iso, precision)
    year = next((n[0] for n in reversed(names) if len(n) == 1 and n[0].isdigit()), None)
    return [m for m in names if m == [year] or year not in m]


@functools.lru_cache(maxsize=20_000)
def amount_names(spelled: str) -> list[list[str]]:
    """Tokens of the spellings of a quantity: its value, then the tokens of the unit's names, if it has one, a line each."""
    value, *units = spelled.split("\n")
    units = [u.split(" ") for u in units if u]
    return [_ASCII.findall(x) + u for x in written_amounts(float(value), bool(units)) for u in units or [[]]]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _fronts(iso: pd.Series, precision: pd.Series, spelled: pd.Series) -> pd.Series:
    """First two words of spellings of a date or a quantity, as they are and capitalised."""

    def one(t, p, q):
        names = amount_names(q) if isinstance(q, str) else date_fronts(t, p)
        return [list(x) for x in dict.fromkeys(n for m in names for n in (tuple(m[:2]), (_capital(m[0]), *m[1:2])))]

    return pd.Series([one(*x) for x in zip(iso, precision, spelled)], dtype=object)


def literal_names(edges: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(child, keys, spelled): what a text must hold for a literal to stand in it, and what ``amount_names`` reads of a quantity.

    A literal is written out once, however many edges lead to it.
    """
    times = edges.where("kind = 'time'").select("child", "v.time", "v.precision").dropDuplicates(["child"]).withColumn("easy", easy_date_keys(F.col("time"), F.col("precision")))
    easy = times.where("easy IS NOT NULL").select("child", F.col("easy").alias("keys"), F.lit(None).cast("string").alias("spelled"))
    times = times.where("easy IS NULL").select("child", "time", "precision", F.lit(None).cast("string").alias("spelled"))
    q = edges.where("kind = 'quantity'").groupBy("child").agg(F.min(F.struct("v.amount", "v.unit")).alias("v")).select("child", "v.amount", F.regexp_extract("v.unit", r"([^/]*)$", 1).alias("unit"))
    value = amount_value(F.col("amount")).cast("string")
    if units is not None:
        said = units.where("unit <> '1' AND label IS NOT NULL").select("unit", *(F.array_join(alias_tokens(c), " ").alias(c) for c in ("label", "symbol")))
        q = q.join(said, "unit", "left").select("child", F.concat_ws("\n", value, "label", "symbol").alias("spelled"))
    else:
        q = q.select("child", value.alias("spelled"))
    both = times.unionByName(q, allowMissingColumns=True).withColumn("words", _fronts("time", "precision", "spelled"))
    return both.select("child", F.transform("words", _front).alias("keys"), "spelled").unionByName(easy)


def easy_date_keys(iso: Column, precision: Column) -> Column:
    """Hashes of ``date_fronts`` for years from 32 with a month and a day, so most dates need no Python; null for all others."""
    part = lambda i: F.regexp_extract(iso, r"^[+-]0*([0-9]+)-([0-9]{2})-([0-9]{2})(?=T)", i)
    year, month, day = part(1), part(2).try_cast("int"), part(3).try_cast("int")
    said = lambda names: F.get(F.array(*map(F.lit, names)), month - 1)
    d, long, short = day.cast("string"), said(MONTHS), said(SHORT_MONTHS)
    days = F.array(F.hash(year), F.hash(d, long), F.hash(d, short), F.hash(long, d), F.hash(short, d), F.hash(F.concat_ws("-", year, part(2), part(3))))
    clear = (year.try_cast("bigint") >= 32) & month.between(1, 12) & (day >= 1)
    return F.when(clear & (precision == 11), days).when(clear & (precision < 11), F.array(F.hash(year)))


def _front(tokens):
    """Hash of what a name must share with a text: its only word, or its first two."""
    return F.hash(F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1)))


def longest_names(docs: DataFrame, aliases: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, pos, words, id): where names (id, alias) stand in documents (key, flat), the longest at each place.

    Names are tokenised as documents are, whatever their length and signs; of equal names the least id counts.
    Runs of tokens are made only where a name's first word stands, and only as long as such names are.
    """
    names = aliases.select("id", alias_tokens("alias").alias("name")).where("size(name) > 0").groupBy("name").agg(F.min("id").alias("id"))
    first = names.groupBy(F.get("name", F.lit(0)).alias("token")).agg(F.collect_set(F.size("name")).alias("lengths"))
    places = docs.select(key, F.posexplode("flat").alias("pos", "token")).join(first, "token")
    places = places.groupBy(key).agg(F.collect_list(F.struct("pos", "lengths")).alias("places"))
    runs = docs.join(places, key).select(key, "flat", F.explode("places").alias("p")).select(key, "flat", "p.pos", F.explode("p.lengths").alias("words"))
    runs = runs.where(F.col("pos") + F.col("words") <= F.size("flat")).select(key, "pos", "words", F.slice("flat", F.col("pos") + 1, F.col("words")).alias("name"))
    return runs.join(names, "name").groupBy(key, "pos").agg(F.max("words").alias("words"), F.max_by("id", "words").alias("id"))


@shuffles_freed
def annotate(docs: DataFrame, wiki: DataFrame, aliases: DataFrame, relation: DataFrame, units: DataFrame | None = None, opt: Options = Options(), key: str = "article_id", hot_degree: int = 1000, hot_rows: int = 200_000, few_rows: int = 10_000) -> DataFrame:
    """(key, annotations) of documents with title, tokens, entities, nel and clusters; ``key`` must be unique.

    Subjects with more than ``hot_degree`` edges are looked up by subject and word together, so the edges of a
    hub are never listed for every document that mentions it; subjects that more than ``hot_rows`` documents
    reach are spread over several tasks. The graph is followed until nothing new is reached; an entity is looked
    up once for each document that reaches it, and hops of up to ``few_rows`` ids are sent to where the graph is.
    """
    kind = dict(docs.dtypes)[key]
    titles = wiki.groupBy("title").agg(F.min("id").alias("id"))
    nel = F.transform(
        F.filter(F.coalesce("nel", F.array()), lambda c: (c["score"] >= opt.score) & ~F.isnan(c["score"])),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), format_wikilink(c["label"]).alias("title")),
    )
    text = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    base = docs.select(F.col(key).alias("doc"), format_wikilink("title").alias("title"), flatten_tokens("tokens").alias("tokens"), "entities", nel.alias("nel"), "clusters")
    base = base.select("doc", "title", "tokens", F.transform("entities", lambda e: e["id"]).alias("linked"), F.transform("nel", lambda c: c["title"]).alias("labels"), text("title", "tokens", "entities", "nel", "clusters").alias("text"))
    base = written(base)
    own = F.array(F.struct("title", F.lit(True).alias("own")))
    asked = base.select("doc", F.explode(F.array_distinct(F.concat(own, F.transform("labels", lambda c: F.struct(c.alias("title"), F.lit(False).alias("own")))))).alias("x")).select("doc", "x.*")
    found = written(asked.where("title IS NOT NULL").join(titles, "title"))
    roots = found.where("own").select("doc")
    links = base.select("doc", F.explode(F.array_distinct("linked")).alias("id")).where("id IS NOT NULL")
    stamped = written(links.unionByName(found.select("doc", "id")).distinct().join(roots, "doc", "left_semi"))

    known = aliases.select("id").distinct()
    full = written(graph_edges(relation, known, opt.same_as))
    hubs = written(full.groupBy("subject").count().where(F.col("count") > hot_degree).select("subject"))
    some_hubs = not hubs.isEmpty()
    # What is looked up of an edge's object: its names with their keys, or how a literal is spelled; the object's own id is a key, too.
    names = written(entity_names(aliases).groupBy("id", "name").agg(F.min("ord").alias("ord")))
    said = names.join(name_keys(names), "name").groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), "\n").alias("names"),
        F.flatten(F.collect_list(F.transform("keys", lambda k: F.struct("name", k.alias("key"))))).alias("said"),
    )
    listed = written(known.join(said, "id", "left"))
    entity = F.col("kind") == "wikibase-entityid"
    keyed = lambda keys: F.array_append(F.coalesce(keys, F.array().cast("array<int>")), F.hash("child"))
    looked = listed.select(F.col("id").alias("child"), F.lit(True).alias("entity"), F.lit(None).cast("string").alias("spelled"), "said")
    looked = looked.select("child", "entity", "spelled", "said", keyed(F.transform("said", lambda x: x["key"])).alias("keys"))
    spelled = literal_names(full, units).select("child", F.lit(False).alias("entity"), F.coalesce("spelled", F.lit("")).alias("spelled"), F.lit(None).cast(dict(looked.dtypes)["said"]).alias("said"), keyed(F.col("keys")).alias("keys"))
    edges = full.select("subject", "ord", "prop", "child", entity.alias("entity")).join(written(looked.unionByName(spelled)), ["child", "entity"]).drop("entity")
    cold = edges.join(hubs, "subject", "left_anti") if some_hubs else edges
    # A row per entity: names, edges, and the keys of all edges.
    cold = cold.groupBy(F.col("subject").alias("id")).agg(F.collect_list(F.struct("ord", "prop", "child", "spelled", "said", "keys")).alias("edges"))
    nodes = listed.select("id", F.coalesce("names", F.lit("")).alias("names")).join(cold, "id", "left")
    nodes = written(nodes.select(F.col("id").alias("subject"), "names", "edges", F.array_distinct(F.flatten(F.transform("edges", lambda e: e["keys"]))).alias("keys")))
    if some_hubs:
        hot = written(edges.join(hubs, "subject", "left_semi"))
        ways = hot.select("subject", F.struct("ord", "prop", "child").alias("x"), F.explode("said").alias("s")).groupBy("subject", "s.name", "s.key").agg(F.min("x")["child"].alias("id"))
        ways = written(ways.select("subject", "key", "id").distinct())
        keys = F.when(F.col("said").isNull(), F.col("keys")).otherwise(F.array(F.hash("child")))
        rows = hot.select("subject", F.struct("ord", "prop", "child", "spelled").alias("row"), F.explode(keys).alias("key"))
        word, bit = (F.shiftrightunsigned("key", 6) % 16384).alias("word"), F.expr("shiftleft(1L, key & 63)")
        # One bit for all keys that agree in 20 bits: 16,384 words, however many keys there are.
        marks = F.broadcast(written(ways.select("key").unionByName(rows.select("key")).groupBy(word).agg(F.bit_or(bit).alias("bits"))))

    # Evidence of a document: hashes of its words, of pairs of words, and of the ids it links to.
    pairs = F.zip_with("tokens", F.slice("tokens", F.lit(2), F.size("tokens")), lambda a, b: F.hash(a, b))
    seen = base.select("doc", F.concat(F.transform("tokens", lambda a: F.hash(a)), F.when(F.size("tokens") > 0, pairs).otherwise(F.array().cast("array<int>"))).alias("seen"))
    evidence = written(stamped.groupBy("doc").agg(F.collect_list(F.hash("id")).alias("ids")).join(seen, "doc").select("doc", F.array_distinct(F.concat("ids", "seen")).alias("held")))

    if some_hubs:
        marked = lambda d: d.withColumn("word", word).join(marks, "word").where(F.col("bits").bitwiseAND(bit) != 0).select("doc", "key")
        hub_held = written(marked(evidence.select("doc", F.explode("held").alias("key"))))

    def at_hubs(ids: DataFrame, held: DataFrame, table: DataFrame) -> DataFrame:
        """Rows of the table (subject, key, ...) for those hubs among ids (doc, id) whose keys (doc, key) the documents hold."""
        return ids.withColumnRenamed("id", "subject").join(hubs, "subject", "left_semi").join(held, "doc").join(table, ["subject", "key"])

    def spread(start: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both with a salt: subjects that more than ``hot_rows`` documents reach go to several tasks."""
        # at most one in hot_rows subjects is in here
        busy = F.broadcast(start.groupBy("subject").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("salts")).where("salts > 1"))
        some = F.coalesce("salts", F.lit(1))
        left = start.join(busy, "subject", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), some).cast("int")).drop("salts")
        return left, table.join(busy, "subject", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), some - 1))).drop("salts")

    def kept(at: DataFrame, *more: str) -> DataFrame:
        """(doc, subject, fact, lead): of the edges in each row those that the document may need, and what they lead to."""
        at = at.select("doc", "subject", *more, "met", F.when(F.size("met") > 0, F.filter("edges", lambda e: F.arrays_overlap(e["keys"], "met"))).alias("edges"))
        lead = F.flatten(F.transform(F.filter("edges", lambda e: e["said"].isNotNull()), lambda e: F.transform(F.filter(e["said"], lambda s: F.array_contains("met", s["key"])), lambda s: F.struct(s["name"].alias("name"), e["ord"].alias("ord"), e["prop"].alias("prop"), e["child"].alias("child")))))
        short = F.transform("edges", lambda e: F.struct(*(e[c].alias(c) for c in ("ord", "prop", "child", "spelled"))))
        return written(at.select("doc", "subject", F.to_json(F.struct("subject", *more, short.alias("edges"))).alias("fact"), lead.alias("lead")))

    def told(ids: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """Of n ids (doc, id): (doc, fact) with names and the edges kept, and (doc, subject, lead)."""
        start, met = ids.withColumnRenamed("id", "subject"), F.array_intersect("keys", "held").alias("met")
        if n <= few_rows:  # counted, so small
            proof = evidence.join(F.broadcast(ids.select("doc").distinct()), "doc", "left_semi")
            hits = kept(F.broadcast(start).join(nodes, "subject").join(proof, "doc").select("doc", "subject", "names", "edges", met), "names")
            return hits.select("doc", "fact"), hits.select("doc", "subject", "lead")

        def at_nodes(left: DataFrame, n: int, *columns: str) -> DataFrame:
            right, on = nodes.select("subject", *columns), ["subject"]
            if n > hot_rows:
                left, right = spread(left, right)
                on = ["subject", "salt"]
            return (F.broadcast(left) if n <= few_rows else left).join(right, on)

        # Edges, much wider than their keys, only go to the documents that hold some key.
        at = written(at_nodes(start, n, "names", "keys").join(evidence, "doc").select("doc", "subject", "names", met))
        hits = at.where("size(met) > 0").select("doc", "subject", "met")
        hits = kept(at_nodes(hits, hits.count(), "edges"))
        return at.select("doc", F.to_json(F.struct("subject", "names")).alias("fact")).unionByName(hits.select("doc", "fact")), hits.select("doc", "subject", "lead")

    def reachable(ids: DataFrame, leads: DataFrame) -> DataFrame:
        """(doc, id) that a document reaches from its ids (doc, id) in one step: of equal names of a subject's objects the first in order counts, as it does below."""
        lead = leads.where("size(lead) > 0").select("doc", "subject", F.explode("lead").alias("x"))
        near = lead.groupBy("doc", "subject", "x.name").agg(F.min(F.struct("x.ord", "x.prop", "x.child"))["child"].alias("id")).select("doc", "id")
        if some_hubs:
            far = at_hubs(ids, hub_held, ways)
            near = near.unionByName(far.select("doc", "id"))
        return near.distinct()

    # Ids reached from the linked ones, hop by hop, as far as the document's words lead.
    frontier, reached, facts = stamped, stamped, None
    # every round adds new (doc, id) only, so this ends, however long a chain is
    for hop in itertools.count(1):
        n = frontier.count()
        if n == 0 and facts is not None:
            break
        new, leads = told(frontier, n)
        facts = new if facts is None else facts.unionByName(new)
        frontier = written(reachable(frontier, leads).join(reached, ["doc", "id"], "left_anti"))
        reached = reached.unionByName(frontier)
        if hop % 16 == 0:  # else plan and tasks grow with every round
            reached, facts = written(reached.repartition("doc", "id")), written(facts)
    if some_hubs:
        held = hub_held.unionByName(marked(reached.select("doc", F.hash("id").alias("key")))).distinct()
        far = at_hubs(reached, held, rows)
        facts = facts.unionByName(far.groupBy("doc", "subject").agg(F.collect_set("row").alias("edges")).select("doc", F.to_json(F.struct("subject", "edges")).alias("fact")))
    facts = facts.groupBy("doc").agg(F.concat(F.lit("["), F.array_join(F.collect_list("fact"), ","), F.lit("]")).alias("facts"))
    ids = found.groupBy("doc").agg(text(F.collect_list(F.struct("title", "id")).alias("ids")).alias("ids"))
    ready = base.select("doc", "text").join(facts, "doc", "left").join(ids, "doc", "left").select("doc", "text", "facts", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_annotated(json.loads(x), json.loads(f or "[]"), json.loads(i)["ids"] if i else [], opt) for x, f, i in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _ANNOTATION)], names=[key, "annotations"])

    return ready.mapInArrow(run, f"{key} {kind}, annotations {ANNOTATION}")


def _annotated(r: dict, facts: list[dict], titles: list[dict], opt: Options) -> list[dict]:
    """Annotations of a document with its part of the graph: names and edges of entities, ids of titles."""
    ids = {x["title"]: x["id"] for x in titles}
    if r["title"] not in ids:
        return []
    names: dict[str, list[list[str]]] = {}
    edges: dict[str, list] = {}
    for f in facts:
        if "names" in f:
            names[f["subject"]] = [n.split(" ") for n in f["names"].split("\n") if n]
        for x in f.get("edges", ()):
            child, spelled = x["child"], x.get("spelled")
            edges.setdefault(f["subject"], []).append((x.get("ord"), x.get("prop"), child))
            # literals have names but are never expanded
            if child in names or spelled is None:
                continue
            if spelled:
                names[child] = amount_names(spelled)
            else:
                precision, _, iso = child[3:].partition("::")
                names[child] = date_names(iso, int(precision))
    # as Spark orders rows: nulls first
    graph = {s: [e[1:] for e in sorted(es, key=lambda e: [(v is not None, v) for v in e])] for s, es in edges.items()}
    tokens = [t if t is not None else "" for t in r["tokens"] or []]
    linker = [{**c, "score": opt.score, "id": ids.get(c["title"])} for c in r["nel"] or []]
    return annotate_one(tokens, ids.get(r["title"]), r["entities"], linker, r["clusters"], _Names(names), graph, opt)


class _Names(dict):
    """Names by id; only entities count as members, literals just have names."""

    def __contains__(self, name) -> bool:
        return super().__contains__(name) and not str(name).startswith(("T::", "V::"))
