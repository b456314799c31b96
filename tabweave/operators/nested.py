"""Nested JSON documents to related flat relations, by structural variant.

A nesting is described by its roles: the document, and every array of objects that becomes a relation of its own, with the
field that holds it and the role it belongs to. WEB_TABLE is the nesting of stored web tables,

    table (id) -> tuple (id, tuple_pos) -> cell (id, tuple_pos, cell_pos) -> alternative (.., alt_pos)

1. Each document is read once. A deterministic bottom-up tree automaton gives every node a state; the state of an object is
   the set of its known fields with the states of their values, child arrays included.
2. The state names the structural variant of a node: the kind of its value, the arrays it has, its marker field.
3. route() writes every node to the subtype table of its role and kind, partitioned by these two; a subtype table has one
   typed value column and reads only its own files. All subtypes of a role keep the keys of their common supertype, so a
   parent is found by dropping the last position, in any of the parent's subtypes.

Positions count from 0 in the arrays as stored, null elements included; a role that has no such position holds -1.

Defined cases: a content that is null, empty, cut off, followed by other text, or not an object (or a string holding
one) yields no node; so does one nested deeper than Python's parser allows. Arrays that are null, absent or of another
type have no children. An element that is neither object nor null is a node of the variant "stray" without a value.
Numbers of any size are numbers: number_text is the number as written, number_value the nearest double. Text with lone
surrogates keeps U+FFFD in their place. Rows repeated exactly count once. Other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.plans.common import scratch


@dataclass(frozen=True)
class Role:
    """name; the array field of the parent role that holds it ("" for the document); its position column; the field that is
    typed; a text field kept beside it; a field whose presence marks a variant."""

    name: str
    field: str = ""
    parent: str = ""
    pos: str = ""
    value: str = ""
    tag: str = ""
    marker: str = ""


TABLE, TUPLE, CELL, ALTERNATIVE = "table", "tuple", "cell", "alternative"
WEB_TABLE = (
    Role(TABLE, marker="schema"),
    Role(TUPLE, "tuples", TABLE, "tuple_pos", marker="cm"),
    Role(CELL, "cells", TUPLE, "cell_pos", "value", "type"),
    Role(ALTERNATIVE, "alternatives", CELL, "alt_pos", "value", "type"),
)
#: The typed columns of each kind of value; the variant of a valued node starts with the kind.
TYPED = {"text": "text_value", "number": "number_value", "flag": "flag_value", "nested": "json_value"}
KINDS = ("empty", "flag", "number", "text", "nested")
_ROWS = 20_000


class Num(float):
    """A number with its source text."""

    def __new__(cls, s: str) -> Num:
        n = float.__new__(cls, s)
        n.source = s
        return n


def _no_constant(s: str):
    raise ValueError(s)


def read_object(content: str | None) -> dict | None:
    """The one complete JSON object in content, or in the JSON string that content is; else None."""
    if not content:
        return None
    try:
        o = json.loads(content, parse_int=Num, parse_float=Num, parse_constant=_no_constant)
        if isinstance(o, str):
            o = json.loads(o, parse_int=Num, parse_float=Num, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def as_json(v) -> str:
    """v as JSON text, numbers as they were written."""
    if type(v) is Num:
        return v.source
    if type(v) is list:
        return "[" + ", ".join(map(as_json, v)) + "]"
    if type(v) is dict:
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {as_json(x)}" for k, x in v.items()) + "}"
    return json.dumps(v, ensure_ascii=False)


class ShapeAutomaton:
    """States are small integers: 0 null, 1 flag, 2 number, 3 text; arrays and objects get theirs on first sight. Only known
    fields take part; the others don't change a state, which keeps the number of states small."""

    def __init__(self, fields: tuple[str, ...]) -> None:
        self.fields = fields
        self.states: dict = {}
        self.names: list[tuple] = [("null",), ("flag",), ("number",), ("text",)]

    def _state(self, symbol: tuple) -> int:
        s = self.states.get(symbol)
        if s is None:
            s = self.states[symbol] = len(self.names)
            self.names.append(symbol)
        return s

    def leaf(self, v) -> int:
        """The transition on a value below which nothing is routed."""
        if v is None:
            return 0
        t = type(v)
        return 3 if t is str else 1 if t is bool else 2 if t is Num else self._state(("array",)) if t is list else self._state(("object",))

    def array(self, children: set[int]) -> int:
        return self._state(("array", *sorted(children)))

    def object(self, o: dict, child: dict[str, int]) -> int:
        """The transition on an object: its known fields, each with the state of its value, in a fixed order."""
        return self._state(("object", *((f, child[f] if f in child else self.leaf(o[f])) for f in self.fields if f in o)))

    def fields_of(self, state: int) -> dict[str, int]:
        return dict(x for x in self.names[state][1:] if isinstance(x, tuple))


class Shredder:
    """Turns documents of one nesting into rows of its relations."""

    def __init__(self, roles: tuple[Role, ...]):
        self.roles = roles
        self.root = roles[0]
        self.children = {r.name: [c for c in roles if c.parent == r.name and c is not r] for r in roles}
        self.pos = [r.pos for r in roles if r.pos]
        self.width = len(self.pos)
        self.slot = {r.name: self.pos.index(r.pos) if r.pos else -1 for r in roles}
        known = dict.fromkeys(f for r in roles for f in (r.value, r.field, r.marker, r.tag) if f)
        self.fields = tuple(known)
        types = [("id", pa.int64()), ("role", pa.string()), ("variant", pa.string()), ("kind", pa.string()), *((p, pa.int32()) for p in self.pos), ("text_value", pa.string()), ("number_value", pa.float64()), ("number_text", pa.string()), ("flag_value", pa.bool_()), ("json_value", pa.string()), ("type_tag", pa.string()), ("n_children", pa.int32())]
        self.arrow = pa.schema(types)
        self.schema = "id long, role string, variant string, kind string, " + "".join(f"{p} int, " for p in self.pos) + "text_value string, number_value double, number_text string, flag_value boolean, json_value string, type_tag string, n_children int"
        self.clear()
        self.columns: list[list] = [[] for _ in types]

    def clear(self) -> None:
        """States are a memo only: dropping them changes no variant."""
        self.automaton = ShapeAutomaton(self.fields)
        self.memo: dict[tuple[str, int], tuple[str, str]] = {}

    def variant(self, role: Role, state: int) -> tuple[str, str]:
        """(variant, kind) of a node, by its state alone."""
        found = self.memo.get((role.name, state))
        if found is None:
            a, below = self.automaton, self.automaton.fields_of(state)
            is_array = lambda f: below.get(f, 0) > 3 and a.names[below[f]][0] == "array"
            if role.value:
                v = below.get(role.value, 0)
                kind = KINDS[v] if v < 4 else "nested"
                name = kind + "".join(f"_{c.field}" for c in self.children[role.name] if is_array(c.field) and len(a.names[below[c.field]]) > 1)
            else:
                kind = "node"
                lacking = [c.field for c in self.children[role.name] if not is_array(c.field)]
                name = f"without_{lacking[0]}" if lacking else "with_schema" if role.marker in below else "plain"
            found = self.memo[role.name, state] = (name, kind)
        return found

    def add(self, *row) -> None:
        for c, v in zip(self.columns, row):
            c.append(v)

    def node(self, role: Role, key: int, o: dict, at: tuple[int, ...], structure: bool, values: bool) -> int:
        """Adds the rows of o and of everything below it; its state."""
        child: dict[str, int] = {}
        n = 0
        for c in self.children[role.name]:
            held = o.get(c.field)
            if type(held) is not list:
                continue
            states, slot = set(), self.slot[c.name]
            n += len(held)
            for i, x in enumerate(held):
                here = at[:slot] + (i,) + at[slot + 1 :]
                if type(x) is dict:
                    states.add(self.node(c, key, x, here, structure, values))
                else:
                    states.add(self.automaton.leaf(x))
                    if structure:
                        self.add(key, c.name, "null" if x is None else "stray", "empty" if c.value else "node", *here, None, None, None, None, None, None, 0)
            child[c.field] = self.automaton.array(states)
        state = self.automaton.object(o, child)
        variant, kind = self.variant(role, state)
        if structure or role.value and kind != "empty":
            v = o.get(role.value) if values and role.value else None
            tag = o.get(role.tag) if values and role.tag else None
            number = v if kind == "number" else None
            self.add(key, role.name, variant, kind, *at, v if kind == "text" else None, number, number.source if number is not None else None, v if kind == "flag" else None, as_json(v) if kind == "nested" and values else None, tag if type(tag) is str else None, n)
        return state

    def document(self, key: int, o: dict, structure: bool, values: bool) -> None:
        self.node(self.root, key, o, (-1,) * self.width, structure, values)

    def batch(self) -> pa.RecordBatch:
        columns, self.columns = self.columns, [[] for _ in self.columns]
        arrays = []
        for c, f in zip(columns, self.arrow):
            try:
                arrays.append(pa.array(c, f.type))
            except UnicodeEncodeError:
                arrays.append(pa.array([x if x is None else x.encode("utf-8", "surrogatepass").decode("utf-8", "replace") for x in c], f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=self.arrow)


def nodes(df: DataFrame, key: str = "id", content: str = "content", structure: bool = True, values: bool = True, roles: tuple[Role, ...] = WEB_TABLE) -> DataFrame:
    """All nodes of all readable contents, one row each: the keys, role, variant, kind, the typed value columns, a text field
    and the number of children. structure=False gives only nodes that hold a value, values=False leaves the typed columns
    null."""
    schema = Shredder(roles).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shredder(roles)
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                if k is not None and (o := read_object(text.as_py())) is not None:
                    s.document(k, o, structure, values)
                    if len(s.columns[0]) >= _ROWS:
                        yield s.batch()
                if len(s.automaton.names) > 100_000:
                    s.clear()
        yield s.batch()

    return df.select(F.col(key).cast("long"), F.col(content).cast("string")).distinct().mapInArrow(run, schema)


def keys_of(role: str, roles: tuple[Role, ...] = WEB_TABLE) -> list[str]:
    """The key columns of a role: the document's and one position per level."""
    by_name = {r.name: r for r in roles}
    out: list[str] = []
    r = by_name[role]
    while r.pos:
        out.insert(0, r.pos)
        r = by_name[r.parent]
    return ["id", *out]


def _subtypes(roles: tuple[Role, ...]) -> list[tuple[str, Role, str]]:
    """(name, role, kind) of every subtype table."""
    return [(f"{r.name}_{k}" if r.value else f"{r.name}s", r, k) for r in roles for k in ((*TYPED, "empty") if r.value else ("node",))]


def variant_tables(all_nodes: DataFrame, roles: tuple[Role, ...] = WEB_TABLE) -> dict[str, DataFrame]:
    """The typed subtype relations: one per role and kind of value, each with the keys of its supertype."""
    out = {}
    for name, role, kind in _subtypes(roles):
        of = all_nodes.where((F.col("role") == role.name) & (F.col("kind") == kind))
        keys = keys_of(role.name, roles)
        if not role.value:
            out[name] = of.select(*keys, "variant", F.col("n_children").alias("n_" + ("_".join(c.field for c in roles if c.parent == role.name and c is not role) or "children")))
        elif kind == "empty":
            out[name] = of.select(*keys, "variant", "type_tag")
        else:
            out[name] = of.select(*keys, "variant", F.col(TYPED[kind]).alias("value"), *(["number_text"] if kind == "number" else []), "type_tag")
    return out


def route(all_nodes: DataFrame, path: str | None = None, roles: tuple[Role, ...] = WEB_TABLE) -> dict[str, DataFrame]:
    """Writes every node to the subtype table of its role and kind and gives these tables, each of which reads only its own
    files. There are as many folders as roles and kinds, whatever the data."""
    spark: SparkSession = all_nodes.sparkSession
    path = path or scratch(spark, "variants")
    all_nodes.write.partitionBy("role", "kind").parquet(path)
    return variant_tables(spark.read.schema(all_nodes.schema).parquet(path), roles)


def value_positions(tables: dict[str, DataFrame], roles: tuple[Role, ...] = WEB_TABLE) -> DataFrame:
    """The keys of each value in routed tables: all positions, -1 for those a role lacks."""
    out = None
    for name, role, kind in _subtypes(roles):
        if role.value and kind != "empty":
            own = keys_of(role.name, roles)
            one = tables[name].select("id", *((F.col(r.pos) if r.pos in own else F.lit(-1).alias(r.pos)) for r in roles if r.pos))
            out = one if out is None else out.unionByName(one)
    return out
