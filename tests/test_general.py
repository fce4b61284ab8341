"""The general data problems against brute force and on awkward rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import copydiff, orphans, units, variants

EDGE = "edge_id long, subject string, ord int, prop string, value struct<type:string,value:struct<id:string,time:string,precision:int,amount:string,unit:string,text:string>>, feed string, stated_at timestamp, loaded_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def quantity(i, amount=None, unit=None, text=None, prop="P1", subject="Q1", feed=None):
    return (i, subject, 0, prop, ("quantity", (None, None, None, amount, unit, text)), feed, T0, T0)


def reference(i, target, at, kind="wikibase-entityid"):
    return (i, "Q1", 0, "P9", (kind, (target, None, None, None, None, None)), None, T0, day(at))


@pytest.fixture(scope="module")
def measures(spark):
    props = spark.createDataFrame([("P1", "height", "quantity", "length"), ("P2", "mean temperature", "quantity", "temperature"), ("P3", "population", "quantity", "count"), ("P4", "duration", "quantity", "time"), ("P5", "country", "item", None), ("P6", "speed", "quantity", "speed"), ("P7", "area", "quantity", "area")], "prop string, label string, value_kind string, dimension string")
    unit = spark.createDataFrame(
        [("U1", "metre", "m", "length", 1.0, 0.0), ("U2", "foot", "ft", "length", 0.3048, 0.0), ("U3", "inch", "in", "length", 0.0254, 0.0), ("U4", "kelvin", "K", "temperature", 1.0, 0.0), ("U5", "degree Celsius", "°C", "temperature", 1.0, 273.15),
         ("1", "one", "", "count", 1.0, 0.0), ("U6", "thousand", "k", "count", 1000.0, 0.0), ("U7", "second", "s", "time", 1.0, 0.0), ("U8", "minute", "min", "time", 60.0, 0.0), ("U9", "hour", "h", "time", 3600.0, 0.0), ("U10", "square metre", "m2", "area", 1.0, 0.0),
         ("U11", "metre per second", "m/s", "speed", 1.0, 0.0), ("U12", "kilometre per hour", "km/h", "speed", 1 / 3.6, 0.0), ("U13", "royal foot of old measure", "rf", "length", 0.3, 0.0)],
        "unit string, label string, symbol string, dimension string, factor double, shift double",
    )
    return props, unit


CASES = [
    (quantity(1, "+12.5", "http://kb.example/entity/U1"), 12.5),
    (quantity(2, "1.234,5", "m"), 1234.5),
    (quantity(3, "1,640", "metre"), 1640.0),
    (quantity(4, "0,640", "metre"), 0.64),
    (quantity(5, "12 345,5", "m"), 12345.5),
    (quantity(6, "2.5E+02m", "U2"), 250.0),
    (quantity(7, None, None, "5 ft 3 in"), 5 * 0.3048 + 3 * 0.0254),
    (quantity(8, None, None, '5\' 3.5"'), 5 * 0.3048 + 3.5 * 0.0254),
    (quantity(9, "-5", "°C", prop="P2"), 268.15),
    (quantity(10, None, None, "about 1,003 people", prop="P3"), 1003.0),
    (quantity(11, "1.5", "Tsd.", prop="P3"), 1500.0),
    (quantity(12, None, None, "0h02m47s", prop="P4"), 167.0),
    (quantity(13, None, None, "runs 1 hours, 2 minutes and 3 seconds", prop="P4"), 3723.0),
    (quantity(14, "10", "kelvin"), None),
    (quantity(15, "10", "old rods"), None),
    (quantity(16, "10", None), None),
    (quantity(17, None, None, None), None),
    (quantity(18, "", ""), None),
    (quantity(19, "ten", "m"), None),
    (quantity(20, "3 m (surveyed)", "U2"), 3.0),
    (quantity(21, "1,234,567", "1", prop="P3"), 1234567.0),
    (quantity(22, "7 " + "x" * 20000, "m"), None),
    (quantity(23, "12", "m/s", prop="P6"), 12.0),
    (quantity(24, "3.6", "http://kb.example/entity/U12", prop="P6"), 1.0),
    (quantity(25, "5 in the whole register", "m"), 5.0),
    (quantity(26, None, None, "5 in, measured"), 5 * 0.0254),
    (quantity(27, "5 royal foot of old measure books"), 1.5),
    (quantity(28, None, None, "1" + " 000" * 20 + " m"), 1e60),
    (quantity(29, None, None, " ".join(["1 m2"] * 40), prop="P7"), 40.0),
]


def test_units(spark, measures):
    rows = [c[0] for c in CASES]
    edges = spark.createDataFrame(rows + rows[:3], EDGE).withColumn("unit", F.lit("clash")).withColumn("dimension", F.lit("clash"))
    got = {r["edge_id"]: r["value"] for r in units.common_unit_values(edges, *measures).collect()}
    assert len(got) == len(CASES)
    for row, want in CASES:
        assert got[row[0]] == (None if want is None else pytest.approx(want)), row


def test_unit_defaults(spark, measures):
    edges = spark.createDataFrame([quantity(1, "2", None, feed="f")], EDGE)
    defaults = spark.createDataFrame([("f", "P1", "foot")], "feed string, prop string, unit string")
    assert units.common_unit_values(edges, *measures, defaults=defaults).first()["value"] == pytest.approx(0.6096)


def test_equal_pairs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([0.0, -1.0, 1.0]) * round(rng.uniform(1, 1.2), 4)) for i in range(300)] + [(900, "a", None), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "edge_id long, k string, value double")
    # also with every bucket spread over several tasks
    got, salted = ({tuple(r) for r in units.equal_value_pairs(df, ["k"], "edge_id", "value", 0.005, hot).collect()} for hot in (10**6, 5))
    assert got == salted
    ok = [r for r in rows if r[0] is not None and r[2] is not None]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 0.005 * max(abs(a[2]), abs(b[2]))}
    assert got == want and want
    classes = {r["edge_id"]: (r["class"], r["members"]) for r in units.value_classes(df, ["k"], "edge_id", "value").collect()}
    same = {a[0]: [b[0] for b in ok if b[1:] == a[1:]] for a in ok}
    assert classes == {i: (min(x), len(x)) for i, x in same.items()} and max(n for _, n in classes.values()) > 1


def test_salted_join(spark):
    from graphloom.session import salted_join

    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 7}", i) for i in range(50)] + [(None, 1)], "k string, a int")
    small = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("k1", "z"), ("none", "w")], "k string, b string")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "k", how).select("k", "a", "b").collect()))
        assert sorted(map(str, salted_join(big, small, "k", how, hot_rows=20).select("k", "a", "b").collect())) == want


def brute_orphans(refs, spans, core):
    out = set()
    for key, target, at in refs:
        if target in core or at is None:
            continue
        own = [(c, d) for i, c, d in spans if i == target and c is not None]
        if any(c <= at and (d is None or d > at) for c, d in own):
            continue
        out.add((key, target, "missing" if not own else "deleted" if any(c <= at for c, _ in own) else "late"))
    return out


@pytest.mark.parametrize("hot", [3, 10**6])
def test_orphans_against_brute_force(spark, hot):
    rng = random.Random(5)
    ids = [f"Q{i}" for i in range(12)]
    spans = [(rng.choice(ids[:9]), rng.choice([None, *range(0, 1500, 100)]), None if rng.random() < 0.4 else rng.randrange(0, 1600, 100)) for _ in range(40)]
    spans = [(i, day(c), day(d)) for i, c, d in spans] + [("Q3", day(0), day(0))] * 2
    refs = [(k, "Q1" if rng.random() < 0.4 else rng.choice([*ids, "Q99"]), day(rng.randrange(0, 1500, 50))) for k in range(300)]
    edges = spark.createDataFrame([reference(k, rng.choice([t, f" {t.lower()} "]), (at - T0).days) for k, t, at in refs] + [reference(900, None, 1), reference(901, "T::9::x", 1), reference(902, "", 1), reference(903, "Q98", None), reference(904, "Q98", 1, "time")], EDGE)
    ann = spark.createDataFrame([], "article_id long, annotations array<struct<id:string,parent_id:array<string>>>, loaded_at timestamp")
    alias = spark.createDataFrame(spans, "id string, created_at timestamp, deleted_at timestamp")
    core = spark.createDataFrame([("Q11",)], "id string")
    found = orphans.orphans(orphans.references(edges, ann), alias, core, hot_rows=hot).collect()
    assert {(r["row_key"], r["target"], r["reason"]) for r in found} == brute_orphans(refs, spans, {"Q11"})
    assert len(found) == len({tuple(r) for r in found})


@pytest.mark.parametrize("hot", [3, 10**6])
def test_deletions_reopen(spark, hot):
    """What the state and its flows count as open against a count over all references, at every month's end."""
    rng = random.Random(6)
    ids = [f"Q{i}" for i in range(8)]
    spans = [(i, day(c), day(c + rng.randrange(20, 400))) for i in ids[:6] for c in sorted(rng.sample(range(0, 900, 30), 3))] + [("Q5", day(1000), None)]
    refs = sorted({(k, rng.choice(ids), day(rng.randrange(0, 1000, 40))) for k in range(120)})
    edges = spark.createDataFrame([reference(k, t, (at - T0).days) for k, t, at in refs], EDGE)
    ann = spark.createDataFrame([], "article_id long, annotations array<struct<id:string,parent_id:array<string>>>, loaded_at timestamp")
    alias = spark.createDataFrame(spans, "id string, created_at timestamp, deleted_at timestamp")
    _, flows, state = orphans.play(orphans.references(edges, ann), alias, spark.createDataFrame([("Q7",)], "id string"), hot)

    alive = lambda target, at: target == "Q7" or sum((c < at) - (d is not None and d < at) for i, c, d in spans if i == target) > 0
    flow = {r["month"]: r["opened"] for r in flows.where("ref_table = 'relation_db'").collect()}
    for month in sorted(flow):
        year, m = map(int, month.split("-"))
        end = dt.datetime(year + m // 12, m % 12 + 1, 1)
        assert sum(n for k, n in flow.items() if k <= month) == sum(at < end and not alive(t, end) for _, t, at in refs), month
    assert any(n < 0 for n in flow.values())
    now = {r["ref_table"]: r["open"] for r in orphans.open_references(state).collect()}
    assert now == {"relation_db": sum(not alive(t, day(9999)) for _, t, _ in refs), "annotations": 0}


def test_orphans_of_nothing(spark):
    edges = spark.createDataFrame([], EDGE)
    ann = spark.createDataFrame([], "article_id long, annotations array<struct<id:string,parent_id:array<string>>>, loaded_at timestamp")
    alias = spark.createDataFrame([], "id string, created_at timestamp, deleted_at timestamp")
    assert orphans.orphans(orphans.references(edges, ann), alias, spark.createDataFrame([], "id string")).count() == 0


NOTE = "article_id long, title string, tokens array<array<string>>, annotations array<struct<source:string,id:string,relation:array<string>,parent_id:array<string>,span:array<int>>>, loaded_at timestamp"


def test_differences(spark):
    n = lambda i, s, rel=("r",), par=("p",), e=None: ("W", i, list(rel) if rel is not None else None, list(par), [s, e or s + 1])
    a = [
        (1, "t", [["x"], None, ["y"]], [n("Q1", 0), n("Q2", 5)], day(1)),
        (1, "t", [["old"]], [], day(0)),
        (2, "t", None, None, day(0)),
        (3, "t", [["only"]], [], day(0)),
        (5, "t", [["a b"]], [n("Q1", 0, None), n("Q1", 1), ("W", "Q9", [], [], None)], day(0)),
        (None, "t", [["x"]], [], day(0)),
    ]
    b = [
        (1, "other", [["x"], [], ["z"], ["more"]], [n("Q2", 5, ("r", "s")), n("Q1", 0, e=3), n("Q7", 9)], day(3)),
        (2, "t", [], [], day(0)),
        (4, "t", None, None, day(0)),
        (5, "t", [["a", "b"]], [n("Q1", 0, ()), ("V", "Q9", [], [], [])], day(0)),
        (5, "t", [["a", "b"]], [n("Q1", 0, ()), ("V", "Q9", [], [], [])], day(0)),
    ]
    got = {tuple(r) for r in copydiff.differences(spark.createDataFrame(a, NOTE), spark.createDataFrame(b, NOTE)).collect()}
    assert got == {
        (1, 2, "tokens", "differs"), (1, 3, "tokens", "only_b"), (1, 0, "span", "differs"), (1, 5, "relation", "differs"), (1, 9, "annotation", "only_b"),
        (3, -1, "row", "only_a"), (4, -1, "row", "only_b"), (5, 0, "tokens", "differs"), (5, 1, "annotation", "only_a"), (5, -1, "source", "differs"),
    }
    empty = spark.createDataFrame([], NOTE)
    assert copydiff.differences(empty, empty).count() == 0


def test_variants(spark):
    lines = [
        (0, "["), (1, '{"id":"Q1","labels":{"en":"old"}},'), (2, '{"id":"Q1","labels":{"en":{"language":"en","value":"A"},"de":"B"},"aliases":{"en":[{"language":"en","value":"x"},null,"y"],"fr":{"language":"fr","value":"z"}},'
         '"claims":{"P1":[{"mainsnak":{"snaktype":"novalue","property":"P1"},"qualifiers":{"P2":[{"snaktype":"somevalue","property":"P2"}],"P3":{"snaktype":"value","property":"P3"}}},{"mainsnak":{"snaktype":"value","property":"P1"},"qualifiers":[]}]}},'),
        (3, '{"id":"Q2","labels":[{"language":"en","value":"A"}],"claims":[{"mainsnak":{"snaktype":"value","property":"P1"}},{"mainsnak":{"snaktype":"value","property":"P2"}},{"mainsnak":{"snaktype":"value","property":"P1"}}]}'),
        (4, '{"id":"Q3","claims":"{\\"P1\\":{\\"mainsnak\\":{\\"snaktype\\":\\"value\\",\\"property\\":\\"P1\\"}}}","aliases":null,"labels":[]}'),
        (5, '{"id":"Q4","labels":{"en":"gone"}}'), (6, '{"id":"Q4","missing":true}'), (7, '{"entities":{"Q5":{"id":"Q5","labels":{"en":"w"}}},"success":1}'), (8, '{"id":"Q6","labels":{"en":'),
        (9, None), (10, ""), (11, '{"id":"Q1"'), (12, "]"), (13, '{"labels":{"en":"no id"}}'),
    ]
    df = spark.createDataFrame(lines, "line_no long, line string").withColumn("kind", F.lit("clash"))
    got = {(r["entity_id"], r["kind"], r["key1"], r["pos1"], r["key2"], r["pos2"]) for r in variants.flatten_dump(df).collect()}
    assert got == {
        ("Q1", "label", "en", 0, "", 0), ("Q1", "label", "de", 0, "", 0), ("Q1", "alias", "en", 0, "", 0), ("Q1", "alias", "en", 2, "", 0), ("Q1", "alias", "fr", 0, "", 0),
        ("Q1", "claim", "P1", 0, "", 0), ("Q1", "claim", "P1", 1, "", 0), ("Q1", "qualifier", "P1", 0, "P2", 0), ("Q1", "qualifier", "P1", 0, "P3", 0),
        ("Q2", "label", "en", 0, "", 0), ("Q2", "claim", "P1", 0, "", 0), ("Q2", "claim", "P1", 1, "", 0), ("Q2", "claim", "P2", 0, "", 0),
        ("Q3", "claim", "P1", 0, "", 0), ("Q5", "label", "en", 0, "", 0),
    }
    assert variants.flatten_dump(df.limit(0)).count() == 0


def test_automaton_goes_by_children():
    run = lambda x: variants.TreeAutomaton().run(x)[0]
    value = {"type": "time", "value": {"time": "+2000", "precision": 9}}
    assert run(value) == "value<time>" and run({"type": "time", "value": {"when": "+2000"}}) == "map<map<text>|text>"
    snak = {"snaktype": "value", "property": "P1", "datavalue": value}
    assert run(snak) == "snak<value<time>>" and run({"snaktype": "novalue"}) == "snak<empty>"
    assert run({"mainsnak": snak}) == "statement<snak<value<time>>>" and run({"P1": [{"mainsnak": snak}], "P2": [None]}) == "map<list<statement>>"
    assert run({"language": "en", "value": "x"}) == "term" and run({"language": "en", "value": 3}) == "map<number|text>"


def test_subtype_tables(spark, tmp_path):
    held = [
        ("entity", {"type": "wikibase-entityid", "value": {"entity-type": "item", "id": "Q9"}}), ("time", {"type": "time", "value": {"time": "+1999-01-01T00:00:00Z", "precision": 11}}),
        ("quantity", {"type": "quantity", "value": {"amount": "+3", "unit": "1"}}), ("text", {"type": "string", "value": "abc"}), ("text", {"type": "monolingualtext", "value": {"text": "abc", "language": "en"}}),
        ("place", {"type": "globecoordinate", "value": {"latitude": 1, "longitude": 2.5}}), ("other", {"type": "odd", "value": [1, {"a": "ü"}]}), ("other", {"value": 3}), ("empty", None),
    ]
    claims = [{"mainsnak": {"snaktype": "value", "property": "P1", "datavalue": v}, "qualifiers": {"P2": [{"snaktype": "value", "property": "P2", "datavalue": v}]}} for _, v in held]
    line = json.dumps({"id": "Q1", "labels": {"en": {"language": "en", "value": "A"}}, "claims": {"P1": claims}})
    flat = variants.flatten_dump(spark.createDataFrame([(1, line)], "line_no long, line string")).cache()
    tables = {name: variants.subtype_table(flat, name).collect() for name in variants.SUBTYPES}
    assert {k: len(v) for k, v in tables.items()} == {"term": 1, "entity": 2, "time": 2, "quantity": 2, "text": 4, "place": 2, "other": 4, "empty": 2}
    assert {tuple(r[:6]) for rows in tables.values() for r in rows} == {tuple(r) for r in flat.select(*variants.KEYS).collect()}
    # a qualifier is tied to its claim by key1 and pos1
    claim = {(r["key1"], r["pos1"]): r for rows in tables.values() for r in rows if r["kind"] == "claim"}
    assert all(claim[r["key1"], r["pos1"]][6:] == r[6:] for rows in tables.values() for r in rows if r["kind"] == "qualifier")
    assert tables["time"][0][6:] == ("+1999-01-01T00:00:00Z", 11, None) and tables["place"][0][6:] == (1.0, 2.5) and tables["empty"][0][6:] == ("value",)
    variants.write_subtypes(flat, str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t"))
    assert again.count() == flat.count() and again.where("subtype = 'time'").select("time", "precision").distinct().collect() == [("+1999-01-01T00:00:00Z", 11)]
