"""The engine's own operators: golden cases, fixtures for readers, and the annotator against brute force."""

import bz2
import datetime as dt
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import literals, text
from graphloom.operators import annotate, curate, documents, kg, stats
from graphloom.operators.trie import TokenTrie
from graphloom.sources import readers, writers

TOKENS = "Robert Plant sings for Led Zeppelin . He rocks .".split()
NAMES = {"Q0": [["Robert", "Plant"]], "Q1": [["Robert", "Lockwood", "Logan", "IV"], ["Robby"]], "Q2": [["Robert", "Lockwood"]], "Q3": [["Led", "Zeppelin"]]}
EDGES = {"Q0": [("influenced_by", "Q2"), ("plays_in", "Q3")], "Q1": [("listens_to", "Q0")]}
LINKS = [{"id": "Q0", "start": 0, "end": 2}]
NEL = [{"start": 0, "end": 2, "score": 0.6, "id": "Q0"}, {"start": 2, "end": 3, "score": 0.0, "id": "Q4"}, {"start": 4, "end": 6, "score": 0.7, "id": "Q3"}]
CLUSTERS = [[{"start": 0, "end": 1}, {"start": 7, "end": 7}]]


def note(source, name, story, start, end):
    return {"source": source, "id": name, "relation": [r for r, _ in story], "parent_id": [p for _, p in story], "span": [start, end]}


GOLD = [note("WIKI", "Q0", [("@@NEW@@", "Q0")], 0, 2), note("NEL", "Q3", [("plays_in", "Q0")], 4, 6), note("COREF", "Q0", [("@@REFLEXIVE@@", "Q0")], 7, 8)]


def test_golden_annotation():
    assert annotate.annotate_one(TOKENS, "Q0", LINKS, NEL, CLUSTERS, NAMES, EDGES) == GOLD
    assert annotate.annotate_one(TOKENS, None, LINKS, NEL, CLUSTERS, NAMES, EDGES) == []
    assert annotate.annotate_one([], "Q0", None, None, None, NAMES, EDGES) == []


def test_mixed_cluster_and_pruning():
    s = annotate.Session(TOKENS, NAMES, EDGES, annotate.Options())
    s.link(LINKS, NEL, [[{"start": 0, "end": 1}, {"start": 4, "end": 5}, {"start": 7, "end": 7}]], "Q0")
    assert s.ids == ["Q0", "Q0", None, None, "Q3", "Q3", None, None, None, None]
    s = annotate.Session(TOKENS, NAMES, EDGES, annotate.Options(prune_clusters=True))
    s.link(LINKS, [], [[{"start": 0, "end": 1}, {"start": 4, "end": 5}, {"start": 7, "end": 7}]], "Q0")
    assert s.ids[7] == "Q0" and s.ids[4] is None
    s = annotate.Session(TOKENS, NAMES, EDGES, annotate.Options(unmatch=True))
    s.link(LINKS, NEL, [], "Q0")
    assert s.ids[4] is None
    s = annotate.Session(TOKENS, NAMES, EDGES, annotate.Options(match_aliases=True))
    s.link(LINKS, [], [], "Q0")
    assert s.trie.find(["Robert", "Plant"]) == "Q0"


def test_trie():
    t = TokenTrie()
    t.add("abc", "x")
    assert [t.step(c) for c in "abc"] == [(True, None), (True, None), (True, "x")]
    t.reset()
    assert t.step("d") == (False, None)
    t.add("abc", "y")
    assert t.find("abc") == "x" and t.find("ab") is None and t.find("abd") is None
    free = TokenTrie(fixed=False)
    free.add("a", "x")
    free.add("a", "y")
    assert free.find("a") == "y"
    n = TokenTrie()
    n.add(["Robert", "Lockwood", "Logan", "IV"], "Q1")
    n.add(["Robert", "Lockwood"], "Q2")
    words = "Robert Lockwood Logan IV".split()
    assert [n.step(w)[1] for w in words] == [None, "Q2", None, "Q1"]
    n.reset()
    assert n.longest("Robert Lockwood Logan".split(), 0) == (2, "Q2")


def test_cutoff_and_literals():
    names = {"Q0": [["A"]], "Q1": [["B"]], "T::9::x": [["1999"]]}
    edges = {"Q0": [("P1", "Q1"), ("P2", "T::9::x")]}
    words = ["A", *"abcdefgh", "B", "1999"]
    held = annotate._Names(names)
    got = annotate.annotate_one(words, "Q0", [{"id": "Q0", "start": 0, "end": 1}], [], [], held, edges)
    assert [(a["id"], a["relation"]) for a in got] == [("Q0", ["@@NEW@@"]), ("Q1", ["P1"]), ("T::9::x", ["P2"])]
    short = annotate.annotate_one(words, "Q0", [{"id": "Q0", "start": 0, "end": 1}], [], [], held, edges, annotate.Options(cutoff=9))
    assert [a["id"] for a in short] == ["Q0"]


def test_annotator_on_tables_equals_whole_graph(spark):
    """What the set-based stage leaves out of the graph changes nothing."""
    rng = random.Random(6)
    words = [f"W{i}" for i in range(25)]
    names = {f"Q{i}": sorted({tuple(rng.choices(words, k=rng.choice([1, 1, 2, 3]))) for _ in range(rng.randint(1, 3))}) for i in range(30)}
    rel = [(f"Q{rng.randrange(30)}", k, rng.choice(["P1", "P2", "P395"] if k % 25 == 0 else ["P1", "P2"]), f"Q{rng.randrange(33)}") for k in range(120)]
    docs = []
    for d in range(30):
        toks = [rng.choice(words) for _ in range(40)]
        ents = [(f"Q{rng.randrange(30)}", s, s + rng.randint(1, 2)) for s in rng.sample(range(38), 4)]
        nel = [(rng.random(), "x", s, s + 1, f"title {rng.randrange(30)}") for s in rng.sample(range(39), 3)]
        cl = [[(s, s) for s in rng.sample(range(40), 2)] for _ in range(2)]
        docs.append((d, f"title {d}", [toks[:20], toks[20:]], ents, nel, cl))
    ddl = f"article_id long, title string, tokens array<array<string>>, entities {readers.SPANS}, nel array<struct<score:double,tokens:string,start:int,end:int,label:string>>, clusters {readers.CLUSTERS}"
    df = spark.createDataFrame([*docs, (77, None, None, None, None, None), (78, "title 1", None, None, None, None)], ddl)
    wiki = spark.createDataFrame([(f"Title_{i}", f"Q{i}") for i in range(30)], "title string, id string")
    alias = spark.createDataFrame([(k, [" ".join(n) for n in v]) for k, v in names.items()], "id string, aliases array<string>")
    value = "value struct<type:string,value:struct<id:string,time:string,precision:int,amount:string,unit:string>>"
    relation = spark.createDataFrame([(s, o, p, ("wikibase-entityid", (c, None, None, None, None))) for s, o, p, c in rel], f"subject string, ord int, prop string, {value}")
    for hot in (3, 1000):
        got = {r["article_id"]: [a.asDict() for a in r["annotations"]] for r in annotate.annotate(df, wiki, alias, relation, hot_degree=hot).collect()}
        edges = {}
        for s, _, p, c in sorted(rel, key=lambda x: x[1]):
            if c in names:
                edges.setdefault(s, []).append((p, c))
        held = {k: [list(n) for n in v] for k, v in names.items()}
        some = 0
        for d, _, toks, ents, nel, cl in docs:
            want = annotate.annotate_one(
                toks[0] + toks[1], f"Q{d}", [dict(zip(("id", "start", "end"), e)) for e in ents],
                [{"score": s, "start": a, "end": b, "id": "Q" + t.split()[1]} for s, _, a, b, t in nel], [[{"start": a, "end": b} for a, b in c] for c in cl], held, edges,
            )
            assert got[d] == want
            some += sum(r.startswith("P") for a in want for r in a["relation"])
        assert some > 5 and got[77] == [] and got[78] == []


def test_annotator_follows_long_chains(spark):
    """Every entity of a chain of 24 is named, only its head is linked."""
    n = 24
    toks = [f"W{i}" for i in range(n)]
    ddl = f"article_id long, title string, tokens array<array<string>>, entities {readers.SPANS}, nel array<struct<score:double,tokens:string,start:int,end:int,label:string>>, clusters {readers.CLUSTERS}"
    df = spark.createDataFrame([(1, "title 0", [toks], [("Q0", 0, 1)], None, None)], ddl)
    alias = spark.createDataFrame([(f"Q{i}", [f"W{i}"]) for i in range(n)], "id string, aliases array<string>")
    value = "value struct<type:string,value:struct<id:string,time:string,precision:int,amount:string,unit:string>>"
    relation = spark.createDataFrame([(f"Q{i}", 0, "P1", ("wikibase-entityid", (f"Q{i + 1}", None, None, None, None))) for i in range(n - 1)], f"subject string, ord int, prop string, {value}")
    got = annotate.annotate(df, spark.createDataFrame([("Title_0", "Q0")], "title string, id string"), alias, relation).first()["annotations"]
    assert [(a["id"], a["parent_id"]) for a in got] == [("Q0", ["Q0"])] + [(f"Q{i}", [f"Q{i - 1}"]) for i in range(1, n)]


@pytest.mark.parametrize("opt", [annotate.Options(), annotate.Options(cutoff=40, match_aliases=True, unmatch=True, prune_clusters=True)])
@pytest.mark.parametrize("hot", [50, 1000])
def test_annotator_reaches_first_owner_of_a_name_only(spark, monkeypatch, opt, hot):
    """A hub has many objects of one name: only the first, the linked and those named in full are reached, and nothing changes by it."""
    n = 300
    toks = "Hub stands by Creek , by W7 Creek and by W9 Creek since 26 October and 1791 , 5.0 km off .".split()
    ents, edges = [("Q0", 0, 1), ("Q12", 8, 10)], [("Q0", k, "P1", f"Q{k}") for k in range(1, n)]
    names = {"Q0": ["Hub"]} | {f"Q{k}": [f"W{k} Creek", "Creek"] for k in range(1, n)}
    days, amount = {f"T::11::+1791-{m:02d}-26T00:00:00Z": (f"+1791-{m:02d}-26T00:00:00Z", 11) for m in (10, 11)}, ("V::5.0000::x/U1", "5", "x/U1")
    ddl = f"article_id long, title string, tokens array<array<string>>, entities {readers.SPANS}, nel array<struct<score:double,tokens:string,start:int,end:int,label:string>>, clusters {readers.CLUSTERS}"
    df = spark.createDataFrame([(1, "title 0", [toks], ents, [(float("nan"), "x", 0, 1, "title 0")], None)], ddl)
    alias = spark.createDataFrame(list(names.items()), "id string, aliases array<string>")
    value = "value struct<type:string,value:struct<id:string,time:string,precision:int,amount:string,unit:string>>"
    rel = [(s, o, p, ("wikibase-entityid", (c, None, None, None, None))) for s, o, p, c in edges]
    rel += [("Q0", n + i, "P2", ("time", (None, *d, None, None))) for i, d in enumerate(days.values())] + [("Q0", n + 5, "P3", ("quantity", (None, None, None, *amount[1:])))]
    relation = spark.createDataFrame(rel, f"subject string, ord int, prop string, {value}")
    units = spark.createDataFrame([("U1", "kilometre", "km")], "unit string, label string, symbol string")
    sent, write = [], annotate.written
    monkeypatch.setattr(annotate, "written", lambda d, *by: sent.append(write(d, *by)) or sent[-1])
    wiki = spark.createDataFrame([("Title_0", "Q0")], "title string, id string")
    got = [a.asDict() for a in annotate.annotate(df, wiki, alias, relation, units, opt, hot_degree=hot).first()["annotations"]]
    graph = {"Q0": [("P1", c) for *_, c in edges] + [("P2", t) for t in days] + [("P3", amount[0])]}
    held = {k: [x.split() for x in v] for k, v in names.items()} | {t: [text.split() for text in literals.written_dates(*d)] for t, d in days.items()} | {amount[0]: [["5.0", "km"]]}
    assert got == annotate.annotate_one(toks, "Q0", [dict(zip(("id", "start", "end"), e)) for e in ents], [], [], annotate._Names(held), graph, opt)
    first = "Q12" if opt.match_aliases else "Q1"
    assert {"Q0", first, "Q7", "Q9", *list(days)[:1], amount[0]} <= {a["id"] for a in got}
    assert sum(d.count() for d in sent if d.columns == ["doc", "id"]) <= 6


@pytest.mark.parametrize("limits", [{}, {"few_rows": 0}, {"few_rows": 0, "hot_rows": 1}, {"few_rows": 0, "hot_rows": 1, "hot_degree": 1}])
def test_annotator_looks_entities_up_once(spark, monkeypatch, limits):
    """Small, large and hot hops tell the same, and no entity's edges come twice for a document."""
    toks = "Root met Ann , Ann met Bob , Bob met Cy on 26 October 1791 .".split()
    alias = spark.createDataFrame([("Q0", ["Root"]), ("Q1", ["Ann"]), ("Q2", ["Bob"]), ("Q3", ["Cy"]), ("Q4", ["Dee"])], "id string, aliases array<string>")
    day = ("time", (None, "+1791-10-26T00:00:00Z", 11, None, None))
    ent = lambda c: ("wikibase-entityid", (c, None, None, None, None))
    rel = [("Q0", 0, "P1", ent("Q1")), ("Q0", 1, "P1", ent("Q4")), ("Q1", 0, "P1", ent("Q2")), ("Q1", 1, "P1", ent("Q0")), ("Q2", 0, "P1", ent("Q3")), ("Q3", 0, "P2", day), ("Q3", 1, "P2", ent("Q9"))]
    relation = spark.createDataFrame(rel, "subject string, ord int, prop string, value struct<type:string,value:struct<id:string,time:string,precision:int,amount:string,unit:string>>")
    ddl = f"article_id long, title string, tokens array<array<string>>, entities {readers.SPANS}, nel array<struct<score:double,tokens:string,start:int,end:int,label:string>>, clusters {readers.CLUSTERS}"
    df = spark.createDataFrame([(i, "title 0", [toks], [("Q0", 0, 1)], None, None) for i in range(3)], ddl)
    sent, write = [], annotate.written
    monkeypatch.setattr(annotate, "written", lambda d, *by: sent.append(write(d, *by)) or sent[-1])
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = annotate.annotate(df, spark.createDataFrame([("Title_0", "Q0")], "title string, id string"), alias, relation, **limits).collect()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    t = "T::11::+1791-10-26T00:00:00Z"
    for r in got:
        assert [(a["id"], a["parent_id"]) for a in r["annotations"]] == [("Q0", ["Q0"]), ("Q1", ["Q0"]), ("Q1", ["Q1", "Q0"]), ("Q2", ["Q1"]), ("Q2", ["Q2", "Q1"]), ("Q3", ["Q2"]), (t, ["Q3"])]
    lists = [d for d in sent if "fact" in d.columns]
    edges = [(r["doc"], r["subject"], e["child"]) for d in lists for r in d.collect() for e in json.loads(r["fact"]).get("edges", [])]
    assert lists and len(edges) == len(set(edges)) and not {"Q4", "Q9"} & {c for *_, c in edges}


def test_names_outside_the_text_are_left_out():
    s = annotate.Session(["new", "York", "is", "big"], {"Q1": [["new", "York"], ["new", "Jersey"], ["NEW", "big"], ["Big"], ["IS"]]}, {}, annotate.Options())
    s.learn("Q1")
    assert s.trie.find(["new", "York"]) == "Q1" and s.trie.find(["new", "Jersey"]) is None and "NEW" not in s.trie.root and "Big" not in s.trie.root
    s = annotate.Session(["new"], {"Q1": [["new", "Jersey"]]}, {}, annotate.Options(legacy=True))
    s.learn("Q1")
    assert s.trie.find(["new", "Jersey"]) == "Q1"


def test_easy_date_keys(spark):
    """Dates whose keys need no Python have the keys of ``date_fronts``."""
    dates = [(f"{sign}{y}-{m:02d}-{d:02d}T00:00:00Z", k) for sign in "+-" for y in ("0026", "0032", "1791", "00001791", "12000") for m in (0, 1, 5, 12, 13) for d in (0, 5, 26) for k in (7, 9, 10, 11, 12, None)]
    df = spark.createDataFrame([(i, k, annotate.date_fronts(i, k)) for i, k in dates], "iso string, k int, fronts array<array<string>>")
    rows = df.select("iso", "k", annotate.easy_date_keys(F.col("iso"), F.col("k")).alias("got"), F.transform("fronts", annotate._front).alias("want")).collect()
    assert sum(r["got"] is not None for r in rows) == 2 * 4 * 3 * 2 * 4
    for r in rows:
        assert r["got"] is None or set(r["got"]) == set(r["want"])


def test_literal_fronts(spark):
    """A text with any spelling of a literal holds the first words of some spelling that is looked for; names are as the shared tokenizer has them."""
    rng = random.Random(5)
    dates = [(f"{rng.choice('+-')}{rng.choice([0, 5, 26, 1791, 12000]):04d}-{rng.randrange(14):02d}-{rng.choice([0, 5, 26]):02d}T00:00:00Z", rng.choice([7, 9, 10, 11, 12])) for _ in range(300)]
    capital = lambda t: [annotate._capital(t[0]), *t[1:]]
    df = spark.createDataFrame([(i, k, literals.written_dates(i, k)) for i, k in dates], "iso string, k int, texts array<string>").select("iso", "k", F.explode("texts").alias("t"))
    rows = df.select("iso", "k", text.alias_tokens("t").alias("t")).where(~text.bad_alias("t")).collect()
    assert rows
    for r in rows:
        assert r["t"] in annotate.date_names(r["iso"], r["k"])
        for said in (r["t"], capital(r["t"])):
            places = {tuple(said[i : i + k]) for i in range(len(said)) for k in (1, 2)}
            assert any(tuple(f[:2]) in places for m in annotate.date_fronts(r["iso"], r["k"]) for f in (m, capital(m)))
    amounts = [("5", "kilometre", "km/h"), ("-0.56202", "square metre", "m²"), ("1e30", None, None), ("7", None, None), ("-2.5", None, None)]
    df = spark.createDataFrame(amounts, "amount string, label string, symbol string")
    df = df.select("amount", text.alias_tokens("label").alias("l"), text.alias_tokens("symbol").alias("s"), F.transform(literals.quantity_aliases(F.col("amount"), F.col("label"), F.col("symbol")), text.alias_tokens).alias("want"))
    for r in df.collect():
        assert annotate.amount_names("\n".join([str(float(r["amount"])), *(" ".join(u) for u in (r["l"], r["s"]) if u)])) == r["want"]


def test_longest_names_of_any_length(spark):
    """One word, more than three, and signs; against all runs of all lengths."""
    rng = random.Random(3)
    words = ["A", "B", "C", "&", "."]
    names = [("Q1", "A"), ("Q2", "A B"), ("Q3", "A B C A B"), ("Q4", "B & C"), ("Q0", "B & C"), ("Q5", "C."), ("Q6", "B C A"), ("Q7", ""), ("Q8", None)]
    docs = [(i, [rng.choice(words) for _ in range(60)]) for i in range(20)] + [(98, []), (99, ["A", "B", "C", "A", "B", None, "C", "."])]
    got = annotate.longest_names(spark.createDataFrame(docs, "article_id long, flat array<string>"), spark.createDataFrame(names, "id string, alias string")).collect()
    known = {}
    for i, n in names:
        if n:
            t = tuple(n.replace(".", " .").split())
            known[t] = min(i, known.get(t, i))
    want = set()
    for d, flat in docs:
        for at in range(len(flat)):
            fit = [n for n in range(1, len(flat) - at + 1) if tuple(flat[at : at + n]) in known]
            if fit:
                want.add((d, at, max(fit), known[tuple(flat[at : at + max(fit)])]))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r["words"] for r in got} == {1, 2, 3, 5} and (99, 0, 5, "Q3") in want and (99, 6, 2, "Q5") in want


def test_text_functions(spark):
    df = spark.createDataFrame([("robert plant x", ["mcDONALD", "Farm"], [["a"], None, ["b", "c"], ["d"]]), ("", [], None), (None, None, [])], "t string, w array<string>, s array<array<string>>")
    r = df.select(text.format_wikilink("t").alias("a"), text.redirect_title("t").alias("b"), text.capitalize_tokens("w").alias("c"), text.sentence_windows("s", 3).alias("d"), text.sentence_offsets("s").alias("e"), text.flatten_tokens("s").alias("f")).collect()
    assert r[0][:3] == ("Robert_plant_x", "Robert_plant_x", ["Mcdonald", "Farm"]) and r[0]["d"] == [[["a"], None, ["b", "c"]], [None, ["b", "c"], ["d"]]]
    assert r[0]["e"] == [0, 1, 1, 3] and r[0]["f"] == ["a", "b", "c", "d"]
    assert r[1]["a"] is None and r[1]["d"] == [] and r[1]["f"] == [] and r[2]["a"] is None
    shift = spark.range(1).select(text.shift_spans(F.expr("array(array(named_struct('start', 1, 'end', 2)))"), 2).alias("x")).first()["x"]
    assert [tuple(m) for m in shift[0]] == [(3, 4)]
    z = spark.range(1).select(text.zip_pairs(F.expr("array('a', 'b')"), F.expr("array('x')")).alias("z")).first()["z"]
    assert [tuple(p) for p in z] == [("a", "x")]


def test_literals(spark):
    rows = [("+1948-08-20T00:00:00Z", 11), ("-0044-03-00T00:00:00Z", 10), ("+12345-00-00T00:00:00Z", 9), ("+2001-01-01T00:00:00Z", 14), ("x", 11), (None, 11)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, p int").select(literals.time_aliases(F.col("t"), F.col("p"))).collect()]
    assert len(got[0]) == 40 and {"20 August 1948", "AD 20 Aug 1948", "August 20, 1948 CE", "1948-08-20", "1948"} <= set(got[0])
    assert len(got[1]) == 15 and "March 44 BC" in got[1] and "BCE 44" in got[1]
    assert got[2] == ["12345", "AD 12345", "12345 AD", "CE 12345", "12345 CE"] and got[3:] == [[], [], []]
    q = spark.createDataFrame([("0.03125", "metre", "m"), ("+5", None, None), ("5F", "metre", "m"), (None, "metre", "m")], "a string, l string, s string")
    said = [r[0] for r in q.select(literals.quantity_aliases(F.col("a"), F.col("l"), F.col("s"))).collect()]
    assert said == [["0.031250 metre", "0.031250 m", "0 metre", "0 m", "0.0 metre", "0.0 m", "0.03 metre", "0.03 m"], ["5.0"], [], []]
    ids = q.select(literals.literal_id(F.lit("quantity"), F.struct(F.lit(None).cast("string").alias("time"), F.lit(1).alias("precision"), F.col("a").alias("amount"), F.lit("1").alias("unit")))).collect()
    assert [r[0] for r in ids] == ["V::0.0312::1", "V::5.0000::1", None, None]


def snak(kind, value, lang=None):
    v = {"type": "string", "value": value} if lang is None else {"type": "monolingualtext", "value": {"language": lang, "text": value}}
    return {"datatype": kind, "datavalue": v}


DUMP = [
    "[",
    json.dumps({"id": "Q1", "labels": {"en": {"value": "One"}}, "aliases": {"en": [{"value": "Uno"}]}, "sitelinks": {"enwiki": {"title": "one page"}},
                "claims": {"P1": [{"mainsnak": snak("string", "a"), "qualifiers": {"P2": [snak("string", "b"), snak("url", "c")]}}, {"mainsnak": {"datatype": "string"}, "qualifiers": {"P2": [snak("string", "z")]}}],
                           "P3": [{"mainsnak": snak("external-id", "x")}], "P4": [{"mainsnak": snak("monolingualtext", "t", "de")}, {"mainsnak": snak("monolingualtext", "u", "en")}]}}) + ",",
    json.dumps({"id": "Q2", "claims": []}) + ",", '{"id": "Q3", "labels": {"en": {"value": "cut', json.dumps({"id": "P9", "labels": {"en": {"value": "prop"}}}) + ",",
    json.dumps({"id": "Q4", "sitelinks": {"enwiki": {"title": "one page"}}, "labels": {"en": {"value": "Four"}}}) + "]",
]


def test_dump(spark, tmp_path):
    with gzip.open(tmp_path / "dump.json.gz", "wt") as f:
        f.write("\n".join(DUMP))
    lines = readers.read_dump(spark, str(tmp_path / "dump.json.gz"), partitions=3)
    assert lines.count() == 4
    assert {tuple(r) for r in kg.wiki_titles(lines).collect()} == {("One_page", "Q4")}
    assert {(r["id"], tuple(r["aliases"])) for r in kg.alias_lists(lines).collect()} == {("Q1", ("One", "Uno")), ("P9", ("prop",)), ("Q4", ("Four",))}
    only = spark.createDataFrame([("Q1",)], "id string")
    assert {r["id"] for r in kg.alias_lists(lines, only).collect()} == {"Q1", "P9"}
    got = [(r["subject"], r["ord"], r["prop"]) for r in kg.edges(lines).orderBy("ord").collect()]
    assert got == [("Q1", 0, "P1"), ("Q1", 1, "P1:P2"), ("Q1", 2, "P4")]
    assert kg.edges(lines, properties=spark.createDataFrame([("P4",)], "prop string")).count() == 1
    assert kg.edges(lines.limit(0)).count() == 0 and kg.wiki_titles(lines.limit(0)).count() == 0


def test_claims_of_all_shapes(spark):
    """Single beside listed claims, one list, JSON text, wrapped entities; an element of no known shape takes no other along."""
    item = lambda p, v, **more: {"mainsnak": {"property": p, **snak("string", v)}, **more}
    q = lambda p, v: {"property": p, **snak("string", v)}
    quals = {"P8": q("P8", "x"), "P9": [q("P9", "y"), None, q("P9", "z")]}
    mixed = {"P1": item("P1", "a", qualifiers=quals), "P2": [item("P2", "b"), None, "odd", item("P2", "c", qualifiers=[q("P9", "w"), q("P8", "v")])], "P3": None, "P4": 5}
    listed = [item("P1", "a"), item("P2", "b", qualifiers=json.dumps(quals)), item("P1", "c", qualifiers=[]), {"mainsnak": snak("string", "no property")}]
    lines = [
        {"id": "Q1", "claims": mixed}, {"id": "Q2", "claims": listed}, {"id": "Q3", "claims": json.dumps(listed[:1])}, {"id": "Q4", "claims": {}},
        {"entities": {"Q5": {"claims": {"P1": item("P1", "a")}}, "Q6": {"id": "Q6", "claims": listed[:1]}, "Q7": {"id": "Q7", "missing": ""}}}, {"entities": [{"id": "Q8", "claims": mixed}, {"claims": mixed}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "line_no long, line string")
    got = {}
    for r in kg.edges(df).orderBy("line_no", "subject", "ord").collect():
        got.setdefault(r["subject"], []).append((r["ord"], r["prop"], r["value"]))
    said = lambda *rows: [(i, *r) for i, r in enumerate(rows)]
    all_mixed = said(("P1", "a"), ("P1:P8", "x"), ("P1:P9", "y"), ("P1:P9", "z"), ("P2", "b"), ("P2", "c"), ("P2:P9", "w"), ("P2:P8", "v"))
    one = said(("P1", "a"))
    assert got == {"Q1": all_mixed, "Q2": said(("P1", "a"), ("P2", "b"), ("P2:P8", "x"), ("P2:P9", "y"), ("P2:P9", "z"), ("P1", "c")), "Q3": one, "Q5": one, "Q6": one, "Q8": all_mixed}
    assert kg.edges(df, properties=spark.createDataFrame([("P2",)], "prop string")).where("subject = 'Q2'").count() == 4


def test_wiki_export_lists_and_pages(spark, tmp_path):
    xml = "<mediawiki xmlns='http://www.mediawiki.org/xml/export-0.10/'><page><title>old name</title><redirect title='One page'/></page><page><title>older</title><redirect title='Old name'/></page><page><title>x</title><revision><text>{{Featured article}} y</text></revision></page></mediawiki>"
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    red = readers.read_redirects(spark, str(tmp_path / "w.xml.bz2"))
    wiki = spark.createDataFrame([("One_page", "Q1")], "title string, id string")
    assert {tuple(r) for r in kg.add_redirects(wiki, red).collect()} == {("One_page", "Q1"), ("Old_name", "Q1")}
    assert kg.add_redirects(wiki, red, hops=2).count() == 3
    assert curate.good_or_featured(readers.read_wikitext(spark, str(tmp_path / "w.xml.bz2"))).count() == 1
    (tmp_path / "ids").write_text(" Q1 \nQ1\n\nQ2\n")
    (tmp_path / "props.csv").write_text("http://kb.example/entity/P31,a\nnone,b\n")
    assert readers.read_list(spark, str(tmp_path / "ids")).count() == 2 and readers.read_list(spark, None) is None
    assert [r[0] for r in readers.read_properties(spark, str(tmp_path / "props.csv")).collect()] == ["P31"]

    def fetch(title):
        if title == "bad":
            raise OSError("no")
        return f"<div>{title}</div>"

    got = {r["title"]: r["html"] for r in readers.fetch_pages(spark.createDataFrame([("a",), ("bad",)], "title string"), fetch).collect()}
    assert got == {"a": "<div>a</div>", "bad": None}


def test_documents_and_writers(spark, tmp_path):
    line = {"title": "Robert Plant", "tokens": [TOKENS[:7], TOKENS[7:]], "entities": [["Q0", 0, 2]], "clusters": [[[0, 1], [7, 7]]], "nel": [{"score": 0.6, "tokens": "x", "start": 0, "end": 2, "label": "y"}]}
    (tmp_path / "d.jsonl").write_text(json.dumps(line) + "\n{}\n")
    doc = readers.read_documents(spark, str(tmp_path / "d.jsonl")).first()
    assert [tuple(e) for e in doc["entities"]] == [("Q0", 0, 2)] and [tuple(m) for m in doc["clusters"][0]] == [(0, 1), (7, 7)]
    df = spark.createDataFrame([("a", "train", True), ("b", "valid", False)], "title string, split string, mini boolean")
    writers.write_splits(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/split=train")).count() == 1 and spark.read.json(str(tmp_path / "s/mini")).count() == 1
    writers.write_tsv(df, str(tmp_path / "t"))
    writers.write_csv(df, str(tmp_path / "c"))
    writers.write_lines(df, str(tmp_path / "l"), "title")
    writers.write_table(df, str(tmp_path / "p"), "title")
    writers.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2 and spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_html_documents(spark):
    page = '<p>skip</p><div><h2>Head</h2><p><b>Robert Plant</b> sang in <a href="/x" title="led Zeppelin">the band</a><sup class="reference">[1]</sup>. <span class="mwe-math-element"><math>x</math></span> <a title="none">no</a>!</p><table><tr><td>t</td></tr></table><!-- c --><ul><li>i</li></ul></div><div>after</div>'
    df = spark.createDataFrame([(1, "Robert Plant", page), (2, "Unknown", "<div><b>U</b> x</div>"), (3, "Unknown", "<div>x</div>"), (4, "t", None), (5, "t", "")], "article_id long, title string, html string")
    wiki = spark.createDataFrame([("Robert_Plant", "Q0"), ("Led_Zeppelin", "Q3")], "title string, id string")
    got = {r["article_id"]: r for r in documents.html_documents(df, wiki).collect()}
    assert set(got) == {1, 3}
    assert got[1]["tokens"] == [["Robert", "Plant", "sang", "in", "the", "band", "."], ["_", "_", "LATEX", "_", "FORMULA", "_", "_", "no", "!"]]
    assert [tuple(e) for e in got[1]["entities"]] == [("Q0", 0, 2), ("Q3", 4, 6)]


def test_coreference(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["c"], ["d"], ["e"]]), (2, [["x"]]), (3, None)], "article_id long, tokens array<array<string>>")

    def provider(sents):
        if sents[0] == ["c"]:
            return [[(1, 1, 2), (3, 1, 2)]]
        return [[(1, 2, 3), (2, 1, 2)]]

    got = {r["article_id"]: [[tuple(m) for m in c] for c in r["clusters"]] for r in documents.coreference(df, provider).collect()}
    assert got == {1: [[(1, 1), (2, 2), (4, 4)]]}
    def fails(sents):
        if sents[0] == ["c"]:
            raise ValueError("no answer")
        return provider(sents)

    odd = {r["article_id"]: ([[tuple(m) for m in c] for c in r["clusters"]], r["failed"]) for r in documents.coreference(df, fails).collect()}
    assert odd == {1: ([[(1, 1), (2, 2)]], 1)}
    span = lambda *ms: [{"start": a, "end": b} for a, b in ms]
    assert documents.merged([span((1, 2), (3, 4)), span((5, 6)), span((3, 4), (7, 8)), span((5, 6), (9, 10))]) == [[(1, 2), (3, 4), (7, 8)], [(5, 6), (9, 10)]]
    assert documents.merged(None) == [] and documents.merged([None, []]) == []


def test_curation_and_statistics_of_nothing(spark):
    ddl = "article_id long, title string, tokens array<array<string>>, annotations array<struct<source:string,id:string,relation:array<string>,parent_id:array<string>,span:array<int>>>"
    odd = spark.createDataFrame([(1, None, None, None), (2, "t", [], []), (3, "t", [["a"]], [(None, None, None, None, None), ("WIKI", "Q1", ["@@NEW@@"], ["Q1"], [0, 1])])], ddl)
    edge = spark.createDataFrame([], "subject string, prop string, object string, edge_id long, ord int")
    names = spark.createDataFrame([], "id string, name string")
    for docs, n in ((odd, 1), (odd.limit(0), 0)):
        assert stats.summary(docs).first()["annotations"] in (2, None, 0)
        assert stats.length_cdf(docs).count() == 0 and stats.excerpts(docs, names).count() == 0
        assert curate.manual_deletions(docs).count() == n
        assert stats.source_given_new(docs).count() == n
        assert curate.prune_edges(edge, docs, ["x"]).count() == 0
        assert curate.token_diff(docs, docs).count() == n
        stats.readable_annotations(docs, names).count()
        stats.annotated_fan(docs).count()
    assert curate.with_tokens(odd).count() == 1 and stats.fan_stats(edge).count() == 0


def test_streaming(spark, tmp_path):
    from graphloom.streaming import streams

    spark.createDataFrame([(1, [[(0, 1), (5, 5)], [(5, 5), (9, 9)]])], f"article_id long, clusters {readers.CLUSTERS}").write.parquet(str(tmp_path / "in"))
    q = streams.merge_cluster_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert len(spark.read.parquet(str(tmp_path / "out")).first()["clusters"]) == 1
    t0 = dt.datetime(2024, 1, 1)
    ddl = "kind string, target string, at timestamp, created long, delta long, ref_table string, ref_field string, month string, row_key long"
    rows = [("ref", "Q1", t0, None, None, "annotations", "id", "2024-01", 1), ("ref", "Q2", t0, None, None, "annotations", "id", "2024-01", 2), ("parent", "Q1", t0 + dt.timedelta(1), 1, 1, None, None, None, None)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        q = streams.orphan_stream(spark, str(tmp_path / "ev"), ddl, str(tmp_path / "state"), str(tmp_path / "ck2"))
        q.awaitTermination(240)
        settled, waiting, opened = streams.read_orphans(spark, str(tmp_path / "state"))
        assert waiting.count() == 2 - i and settled.count() == i
        assert [tuple(r) for r in opened.where("ref_table = 'annotations'").collect()] == [("annotations", "2024-01", 2 - i)]
    assert settled.first()["reason"] == "late"
