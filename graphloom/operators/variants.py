"""Deeply nested records as related flat tables (problem 7).

A deterministic bottom-up tree automaton gives every JSON node a state that follows from the states of its
children (``TreeAutomaton.RULES``): a snak is known by the state of its value, a statement by the state of its
snak, a map or list by the states of what it holds, whatever position they stand in. Every label, alias,
claim and qualifier is routed by its state to a typed subtype table (``SUBTYPES``: terms, entities, times,
quantities, texts, ... each with its own columns); all subtypes keep the supertype's keys: entity, kind, property
or language, place, and for a qualifier those of its claim, its parent.

Defined cases
* a line counts if it parses after dropping the dump's brackets and commas; others give nothing
* of several lines of an entity the highest line_no counts; if it marks the entity missing, nothing comes out
* fields that are absent, null, empty or of an unknown structure give no row
* null elements of a list give no row but keep their place; references are not followed
* repeated lines give repeated parses but one set of rows; null lines are skipped
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys of the supertype, common to all subtype tables; key2 and pos2 tie a qualifier to its claim key1, pos1
KEYS = ["entity_id", "kind", "key1", "pos1", "key2", "pos2"]
#: subtype table -> its own columns
SUBTYPES = {
    "term": {"text": "string"},
    "entity": {"target": "string"},
    "time": {"time": "string", "precision": "int", "calendar": "string"},
    "quantity": {"amount": "string", "unit": "string"},
    "text": {"text": "string", "language": "string"},
    "place": {"latitude": "double", "longitude": "double"},
    "other": {"json": "string"},
    "empty": {"snaktype": "string"},
}
_COLUMNS = {c: t for columns in SUBTYPES.values() for c, t in columns.items()}


class TreeAutomaton:
    """Deterministic bottom-up automaton over JSON trees. ``run`` visits a tree once and gives (state, children) nodes."""

    LEAVES = {str: "text", bool: "flag", int: "number", float: "number", type(None): "null"}
    _TEXT, _NUMBER = frozenset({"text"}), frozenset({"number"})
    _VALUES = frozenset({"entity", "time", "quantity", "text_in_language", "place", "text"})
    #: (state, {key: states its child may be in; None: any}); the first rule whose keys and child states all hold counts.
    #: A state in braces takes up the state of the child named: the value's of a snak, the snak's of a statement.
    RULES = (
        ("statement<{mainsnak}>", {"mainsnak": None}),
        ("snak<{datavalue}>", {"snaktype": None, "datavalue": None}),
        ("snak<empty>", {"snaktype": None}),
        ("term", {"language": _TEXT, "value": _TEXT}),
        ("value<{value}>", {"type": _TEXT, "value": _VALUES}),
        ("entity", {"id": _TEXT, "entity-type": _TEXT}),
        ("entity", {"id": _TEXT, "numeric-id": _NUMBER}),
        ("time", {"time": _TEXT}),
        ("quantity", {"amount": _TEXT}),
        ("text_in_language", {"text": _TEXT, "language": _TEXT}),
        ("place", {"latitude": _NUMBER, "longitude": _NUMBER}),
        ("wrapper", {"entities": None}),
        ("missing", {"missing": None}),
    )

    def run(self, node) -> tuple:
        kind = type(node)
        if kind is dict:
            below = {k: self.run(x) for k, x in node.items()}
            for state, wanted in self.RULES:
                if all(k in below and (allowed is None or below[k][0] in allowed) for k, allowed in wanted.items()):
                    if "{" in state:
                        key = state[state.index("{") + 1 : state.index("}")]
                        state = state.replace("{" + key + "}", below[key][0])
                    return state, below
            return self.join("map", below.values()), below
        if kind is list:
            below = [self.run(x) for x in node]
            return self.join("list", below), below
        return self.LEAVES[kind], None

    def join(self, shape: str, children) -> str:
        """State of a map or list: the kinds of what it holds, empty and null children aside."""
        below = {self.kind(state) for state, _ in children} - {"null", "list<>", "map<>"}
        return f"{shape}<{'|'.join(sorted(below))}>"

    @staticmethod
    def kind(state: str) -> str:
        """A state without what it took up: any statement is a statement to the list it stands in."""
        return state.partition("<")[0] if state.startswith(("statement<", "snak<", "value<")) else state


_AUTOMATON = TreeAutomaton()
#: field -> kinds of elements it may hold, and the key an element of a plain list names its place by
_FIELDS = {"labels": ({"term", "text"}, "language"), "aliases": ({"term", "text"}, "language"), "claims": ({"statement"}, "property"), "qualifiers": ({"snak"}, "property")}
_VALUE_TYPES = {"entity": "entity", "time": "time", "quantity": "quantity", "text_in_language": "text", "text": "text", "place": "place"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_ROWS = pa.list_(
    pa.struct([("kind", pa.string()), ("key1", pa.string()), ("pos1", pa.int32()), ("key2", pa.string()), ("pos2", pa.int32()), ("shape", pa.string()), ("subtype", pa.string()), *[(c, _ARROW[t]) for c, t in _COLUMNS.items()]])
)
_PARSED = pa.schema([("entity_id", pa.string()), ("line_no", pa.int64()), ("missing", pa.bool_()), ("rows", _ROWS)])
_ROW_DDL = "kind:string,key1:string,pos1:int,key2:string,pos2:int,shape:string,subtype:string," + ",".join(f"{c}:{t}" for c, t in _COLUMNS.items())
PARSED_DDL = f"entity_id string, line_no long, missing boolean, rows array<struct<{_ROW_DDL}>>"


def read_line(line: str | None):
    """The JSON value of a dump line, or None if it isn't readable."""
    text = (line or "").strip()
    if text.startswith("["):
        text = text[1:].lstrip()
    text = text.rstrip(",").rstrip()
    if text.endswith("]") and not text.startswith("["):
        text = text[:-1].rstrip().rstrip(",")
    if not text.startswith("{"):
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def entities_of(record: dict) -> Iterator[tuple[dict, bool, dict]]:
    """(entity, marked missing, states of its fields) of one line: itself, or what a wrapper holds."""
    state, below = _AUTOMATON.run(record)
    if state != "wrapper":
        yield record, state == "missing", below
        return
    inner, (_, parts) = record["entities"], below["entities"]
    pairs = [(k, e, parts[k]) for k, e in inner.items()] if isinstance(inner, dict) else [(None, e, part) for e, part in zip(inner or [], parts or [])]
    for key, e, (own, held) in pairs:
        if isinstance(e, dict):
            yield (e if e.get("id") else {**e, "id": key}), own == "missing", held


def _decoded(node, typed: tuple) -> tuple:
    """A field that was stored as JSON text once more, with its states."""
    if isinstance(node, str) and node.lstrip()[:1] in ("{", "["):
        try:
            node = json.loads(node)
        except ValueError:
            return None, ("null", None)
        return node, _AUTOMATON.run(node)
    return node, typed


def _places(field: str, node, typed: tuple) -> Iterator[tuple[str, int, object, tuple, str]]:
    """(key, place, element, element's state and children, shape) of a field in any of its shapes; null elements keep their place."""
    allowed, own_key = _FIELDS[field]
    node, (state, below) = _decoded(node, typed)
    if isinstance(node, dict):
        for key, held in node.items():
            state, children = below[key]
            if isinstance(held, list):
                kinds = set(state[5:-1].split("|")) - {""}
                if not kinds or not kinds <= allowed:
                    continue
                for place, (x, t) in enumerate(zip(held, children)):
                    if x is not None:
                        yield key, place, x, t, f"map<{state}>"
            elif _AUTOMATON.kind(state) in allowed:
                yield key, 0, held, below[key], f"map<{_AUTOMATON.kind(state)}>"
    elif isinstance(node, list) and set(state[5:-1].split("|")) in ({"term"}, {"statement"}, {"snak"}) and set(state[5:-1].split("|")) <= allowed:
        count: dict[str, int] = {}
        for x, t in zip(node, below):
            if x is None:
                continue
            key = x.get(own_key) if own_key == "language" else (x.get("mainsnak") or x).get(own_key)
            if key is not None:
                place = count.get(key, 0)
                count[key] = place + 1
                yield key, place, x, t, state


def _typed(x, state: str) -> tuple[str, dict]:
    """Subtype table and its columns of a label, alias, claim or qualifier in a state."""
    if isinstance(x, str):
        return "term", {"text": x}
    if state == "term":
        return "term", {"text": x["value"]}
    while state.startswith(("statement<", "snak<")):
        state = state.partition("<")[2][:-1]
    snak = x.get("mainsnak", x)
    snak = snak if isinstance(snak, dict) else {}
    held = snak.get("datavalue")
    if held is None:
        return "empty", {"snaktype": snak.get("snaktype") if isinstance(snak.get("snaktype"), str) else None}
    value = held.get("value") if isinstance(held, dict) else held
    kind = _VALUE_TYPES.get(state[6:-1] if state.startswith("value<") else "")
    if kind == "entity":
        return kind, {"target": value["id"]}
    if kind == "time":
        number = value.get("precision")
        return kind, {"time": value["time"], "precision": number if type(number) is int else None, "calendar": value.get("calendarmodel") if isinstance(value.get("calendarmodel"), str) else None}
    if kind == "quantity":
        return kind, {"amount": value["amount"], "unit": value.get("unit") if isinstance(value.get("unit"), str) else None}
    if kind == "text":
        return kind, {"text": value} if isinstance(value, str) else {"text": value["text"], "language": value["language"]}
    if kind == "place":
        return kind, {"latitude": float(value["latitude"]), "longitude": float(value["longitude"])}
    return "other", {"json": json.dumps(held, ensure_ascii=False, separators=(",", ":"))}


def flatten_entity(e: dict, below: dict, values: bool = True) -> list[dict]:
    """Rows of all subtype tables of one entity, under the common supertype's keys."""
    rows = []

    def add(kind, key1, pos1, key2, pos2, shape, x, state):
        subtype, columns = _typed(x, state)
        rows.append({"kind": kind, "key1": key1, "pos1": pos1, "key2": key2, "pos2": pos2, "shape": shape, "subtype": subtype, **(columns if values else {})})

    field = lambda name: (name, e.get(name), below.get(name, ("null", None)))
    for key, _, x, t, shape in _places(*field("labels")):
        if not isinstance(x, list):
            add("label", key, 0, "", 0, shape, x, t[0])
    for key, place, x, t, shape in _places(*field("aliases")):
        add("alias", key, place, "", 0, shape, x, t[0])
    for key, place, x, t, shape in _places(*field("claims")):
        add("claim", key, place, "", 0, shape, x, t[0])
        for key2, place2, y, t2, shape2 in _places("qualifiers", x.get("qualifiers"), t[1].get("qualifiers", ("null", None))):
            add("qualifier", key, place, key2, place2, shape2, y, t2[0])
    return rows


def flatten_dump(lines: DataFrame, values: bool = True) -> DataFrame:
    """KEYS, shape, subtype and the columns of all subtypes: one row per label, alias, claim and qualifier."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few lines at a time: a record may be large and its rows many.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {n: [] for n in _PARSED.names}
                for no, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    record = read_line(line)
                    for e, gone, below in entities_of(record) if record is not None else ():
                        if not isinstance(e.get("id"), str):
                            continue
                        out["entity_id"].append(e["id"])
                        out["line_no"].append(no)
                        out["missing"].append(gone)
                        out["rows"].append([] if gone else flatten_entity(e, below, values))
                yield pa.RecordBatch.from_pydict(out, schema=_PARSED)

    parsed = lines.select("line_no", "line").mapInArrow(parse, PARSED_DDL)
    last = parsed.groupBy("entity_id").agg(F.max_by(F.struct("missing", "rows"), "line_no").alias("x"))
    return last.where(~F.col("x.missing")).select("entity_id", F.inline("x.rows"))


def subtype_table(flat: DataFrame, name: str) -> DataFrame:
    """One typed table of a flattened dump: the supertype's keys and the subtype's own columns."""
    return flat.where(F.col("subtype") == name).select(*KEYS, *SUBTYPES[name])


def write_subtypes(flat: DataFrame, path: str) -> None:
    """All typed tables in one pass, as partitions of one folder that can be read one by one."""
    flat.select(*KEYS, "shape", "subtype", *_COLUMNS).write.mode("overwrite").partitionBy("subtype").parquet(path)
