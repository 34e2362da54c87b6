"""Nested JSON columns to related flat tables, by shared inlining.

1. ``schema_graph``: an element is a path of keys; a list's items are further occurrences of the list's element. Every
   record is reduced to counts of the shapes its elements have, and these are summed over all rows (partial sums in
   the Python workers, a shuffle of a few rows). An object that holds mostly lists of scalars, or such objects, is
   ``open``: its keys are data and are not part of the graph. A key below an element of its own name leads back to that
   element (a cycle).
2. ``plan``: a table for each element that is repeated (a list in any record), recursive (open, or in a cycle) or shared
   (objects of one name and the same keys below several parents). All other descendants are inlined as columns of the
   nearest table. ``NAMES`` gives names to elements that are known to be tables; nothing else is declared.
3. ``shred``: one Arrow pass over the rows emits the elements of all tables with the foreign keys
   (record, parent_key, pos). An open element gives a row per element of its lists, parent_key the keys on the way;
   elements of a list within a list go to the table ``<name>_item`` with the outer element's key as parent_key.

Text that is not JSON gives nothing; JSON inside a JSON string or a code fence is read; a lone value in place of a list
is a list of one (but for elements named ``..._json``, which hold JSON text); NULL elements keep their position but give
no row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: nodes that a worker keeps before it passes on its counts
NODES = 50_000
_FENCE = re.compile(r"^```[ \t]*\w*[ \t]*\r?\n?(.*?)\r?\n?[ \t]*```$", re.S)
_NOTHING = object()
_OPENERS = frozenset('[{"` \n\t\r')


def read_json(text: str | None) -> object:
    """The value of a JSON text, through fences and strings that hold JSON; ``_NOTHING`` if it is none."""
    if text is None:
        return _NOTHING
    body = text.strip().lstrip("﻿").strip()
    if m := _FENCE.match(body):
        body = m[1].strip()
    try:
        value = json.loads(body)
    except (ValueError, RecursionError):
        return _NOTHING
    return unwrap(value)


def unwrap(value: object) -> object:
    """A string that holds a JSON object, list or string stands for what it holds."""
    while isinstance(value, str) and value.strip()[:1] in ("[", "{", '"', "`"):
        inner = read_json(value)
        if inner is _NOTHING:
            break
        value = inner
    return value


def as_list(value: object) -> list:
    return value if isinstance(value, list) else [] if value is None or value is _NOTHING else [value]


@dataclass(frozen=True)
class Table:
    """A repeated, shared or recursive element. ``path`` leads to it from its parent table's element (or the record)."""

    name: str
    column: str
    path: tuple[str, ...] = ()
    parent: str | None = None
    #: its keys are data
    recursive: bool = False
    #: its elements hold elements of it at these paths
    cycles: tuple[tuple[str, ...], ...] = ()

    @property
    def text(self) -> bool:
        """The element is stored as JSON text, so text that is not JSON is no element."""
        return (self.path or (self.column,))[-1].endswith("_json")


#: names for the elements of the history's two JSON columns that are tables
NAMES = {
    ("retrieved_chunks",): "chunk",
    ("retrieved_chunks", "metadata", "keywords_json"): "keyword",
    ("rewriting_metadata_json", "query_vectors"): "vector",
    ("rewriting_metadata_json", "micro_ontology"): "term",
}
Names = dict[tuple[str, ...], str]


@dataclass
class Plan:
    tables: list[Table]
    #: table -> paths of its inlined columns below its element
    columns: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)


def written(path: tuple[str, ...]) -> str:
    """A path as text: keys joined by dots; dots and backslashes in keys behind a backslash."""
    return ".".join(k.replace("\\", "\\\\").replace(".", "\\.") for k in path)


def read_path(text: str) -> tuple[str, ...]:
    return tuple(re.sub(r"\\(.)", r"\1", k, flags=re.S) for k in re.findall(r"(?:^|(?<=\.))(?:[^.\\]|\\.)*", text, flags=re.S))


class _Node:
    """An element of the schema graph: how often it had which shape, and its children."""

    __slots__ = ("name", "up", "shapes", "keys")

    def __init__(self, name: str, up: _Node | None) -> None:
        self.name, self.up = name, up
        self.shapes: dict[str, int] = {}
        self.keys: dict[str, _Node] = {}


def is_open(value: dict) -> bool:
    """Whether more than half of an object's values that are not NULL or empty objects are lists of scalars or open objects."""
    n = data = 0
    for x in value.values():
        x = unwrap(x) if isinstance(x, str) and x[:1] in _OPENERS else x
        if x is None or x == {}:
            continue
        n += 1
        data += isinstance(x, list) and not any(isinstance(i, (dict, list)) for i in x) or isinstance(x, dict) and is_open(x)
    return 2 * data > n


def _observe(node: _Node, value: object, closed: frozenset[tuple[str, ...]], path: tuple[str, ...]) -> int:
    """Counts the shapes of a value and what is below it; how many nodes are new."""
    stack, new = [(node, value, path)], 0
    while stack:
        n, v, way = stack.pop()
        if isinstance(v, str) and v[:1] in _OPENERS:
            v = unwrap(v)
        if isinstance(v, dict):
            if way not in closed and is_open(v):
                shape = "open"
            else:
                shape = "object"
                for k, x in v.items():
                    child = n.keys.get(k)
                    if child is None:
                        up: _Node | None = n
                        while up is not None and up.name != k:
                            up = up.up
                        if up is not None and isinstance(x, (dict, list)):
                            child = up  # a cycle
                            up.shapes["cycle"] = up.shapes.get("cycle", 0) + 1
                            n.shapes[f"back {k}"] = n.shapes.get(f"back {k}", 0) + 1
                        else:
                            child = n.keys[k] = _Node(k, n)
                            new += 1
                    stack.append((child, x, (*way, k)))
        elif isinstance(v, list):
            shape = "list"
            stack += [(n, x, way) for x in v]
        else:
            shape = "null" if v is None else "scalar"
        n.shapes[shape] = n.shapes.get(shape, 0) + 1
    return new


def _counts(roots: dict[str, _Node]) -> Iterator[tuple[str, str, int]]:
    stack = [((c,), n) for c, n in roots.items()]
    while stack:
        path, n = stack.pop()
        yield from ((written(path), shape, k) for shape, k in n.shapes.items())
        stack += [((*path, k), x) for k, x in n.keys.items()]


def schema_graph(df: DataFrame, columns: list[str], names: Names = NAMES) -> DataFrame:
    """(element, shape, occurrences), one row per element and shape that occurs in any record, without the elements
    below open ones. Objects that lead to a named element are not open."""
    closed = frozenset(path[:k] for path in dict(names) for k in range(1, len(path)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {c: _Node(c, None) for c in columns}
        nodes = 0
        for b in batches:
            for c in columns:
                for text in b.column(c).to_pylist():
                    v = read_json(text)
                    if v is not _NOTHING:
                        nodes += _observe(seen[c], v, closed, (c,))
                    if nodes > NODES:
                        yield rows(list(_counts(seen)))
                        seen, nodes = {c: _Node(c, None) for c in columns}, 0
        yield rows(list(_counts(seen)))

    def rows(counts: list[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"element": pa.array([e[0] for e in counts], pa.string()), "shape": pa.array([e[1] for e in counts], pa.string()), "occurrences": pa.array([e[2] for e in counts], pa.int64())})

    graph = df.select(*columns).mapInArrow(count, "element string, shape string, occurrences bigint").groupBy("element", "shape").agg(F.sum("occurrences").alias("occurrences"))
    votes = graph.groupBy("element").agg(F.coalesce(F.sum(F.when(F.col("shape") == "open", F.col("occurrences"))), F.lit(0)).alias("open"), F.coalesce(F.sum(F.when(F.col("shape") == "object", F.col("occurrences"))), F.lit(0)).alias("fixed"))
    open_ = votes.where("open > fixed").select(F.col("element").alias("up"))
    keys = F.split("element", r"(?<!\\)(?:\\\\)*\.")
    above = graph.select("element").distinct().select("element", F.explode(F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: F.array_join(F.slice(keys, F.lit(1), i), "."))).alias("up")).where("up <> element")
    return graph.join(above.join(open_, "up").select("element").distinct(), "element", "left_anti")


def plan(graph: DataFrame, names: Names = NAMES) -> Plan:
    """Tables and inlined columns of a schema graph, which comes to the driver: it is as large as the schema.

    Named elements are tables even if no record has them. Further ones are named by their path.
    """
    named: Names = dict(names)
    shapes: dict[tuple[str, ...], dict[str, int]] = {}
    for r in graph.collect():
        shapes.setdefault(read_path(r["element"]), {})[r["shape"]] = r["occurrences"]
    below: dict[tuple[str, ...], set[str]] = {}
    for e in shapes:
        if len(e) > 1:
            below.setdefault(e[:-1], set()).add(e[-1])
    is_map = {e for e, s in shapes.items() if s.get("open", 0) > s.get("object", 0)}
    kinds: dict[tuple[str, frozenset[str]], set[tuple[str, ...]]] = {}
    for e, k in below.items():
        if len(e) > 1 and e not in is_map:
            kinds.setdefault((e[-1], frozenset(k)), set()).add(e)
    shared = {e for group in kinds.values() if len(group) > 1 for e in group}
    chosen = {e for e, s in shapes.items() if s.get("list") or "cycle" in s} | is_map | shared | set(named)
    chosen = sorted((e for e in chosen if not any(e[:k] in is_map for k in range(1, len(e)))), key=lambda e: (len(e), e))
    tables: list[Table] = []
    at: dict[tuple[str, ...], Table] = {}
    for e in chosen:
        owner = next((e[:k] for k in range(len(e) - 1, 0, -1) if e[:k] in at), None)
        back = tuple((*x[len(e) :], e[-1]) for x, s in shapes.items() if x[: len(e)] == e and f"back {e[-1]}" in s)
        t = Table(named.get(e) or re.sub(r"\W+", "_", "_".join(e)).strip("_"), e[0], e[len(owner) :] if owner else e[1:], at[owner].name if owner else None, e in is_map, back)
        tables.append(t)
        at[e] = t
    columns: dict[str, list[tuple[str, ...]]] = {t.name: [] for t in tables}
    for e in sorted(e for e, s in shapes.items() if s.get("scalar") and e not in at):
        owner = next((e[:k] for k in range(len(e) - 1, 0, -1) if e[:k] in at), None)
        if owner and not at[owner].recursive:
            columns[at[owner].name].append(e[len(owner) :])
    for e, t in at.items():  # lists of scalars have themselves as their column
        if shapes.get(e, {}).get("scalar") and not t.recursive:
            columns[t.name].append(())
    return Plan(tables, columns)


def _step(value: object, path: tuple[str, ...]) -> object:
    for key in path:
        value = unwrap(value)
        if not isinstance(value, dict) or key not in value:
            return _NOTHING
        value = value[key]
    return value


def _terms(value: object) -> Iterator[tuple[str, str, int, object]]:
    """Elements of each list at any depth: (keys on the way joined by '/', positions in lists about it, position, element)."""
    stack: list[tuple[tuple[str, ...], str, object]] = [((), "", value)]
    while stack:
        keys, place, v = stack.pop()
        v = unwrap(v)
        if isinstance(v, dict):
            stack += [((*keys, str(k)), place, x) for k, x in v.items()]
            continue
        for i, x in enumerate(as_list(v)):
            if x is None:
                continue
            yield "/".join(keys), place, i, x
            if isinstance(unwrap(x), (dict, list)):
                stack.append((keys, f"{place}/{i}" if place else str(i), x))


def _elements(t: Table, value: object) -> list:
    if value is _NOTHING or value is None:
        return []
    if t.text and isinstance(value, str):
        return as_list(read_json(value))
    return as_list(unwrap(value))


def shred(df: DataFrame, key: str, p: Plan, payload: bool = True) -> DataFrame:
    """(record, child, parent_key, place, pos, payload) of every element of every table of the plan.

    ``place``: the positions in the lists about a list within lists, '' for others. ``payload`` is the element as JSON
    (NULL when it isn't asked for). Each row of ``df`` is shredded on its own; repeated rows give repeated elements.
    """
    tables = p.tables
    tops = [t for t in tables if t.parent is None]
    below = {t.name: [x for x in tables if x.parent == t.name] for t in tables}
    columns = sorted({t.column for t in tables})

    def within(name: str, value: list, parent_key: str, out: list) -> None:
        """Elements of lists within a list: their lists' key is that of the outer element."""
        for i, x in enumerate(value):
            if x is not None:
                out.append((name, parent_key, "", i, x))
                if isinstance(x, list):
                    within(f"{name}_item", x, f"{parent_key}/{i}", out)

    def emit(t: Table, value: object, parent_key: str, out: list) -> None:
        value = _step(value, t.path)
        if t.recursive:
            out += [(t.name, k if not parent_key else f"{parent_key}/{k}", place, i, x) for k, place, i, x in _terms(value if value is not _NOTHING else None)]
            return
        held(t, value, parent_key, out)

    def held(t: Table, value: object, parent_key: str, out: list) -> None:
        for i, x in enumerate(_elements(t, value)):
            if x is None:
                continue
            out.append((t.name, parent_key, "", i, x))
            own = f"{parent_key}/{i}" if parent_key else str(i)
            if isinstance(x, list):
                within(f"{t.name}_item", x, own, out)
            for u in below[t.name]:
                emit(u, x, own, out)
            for path in t.cycles:
                held(t, _step(x, path), own, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, cols, out = [], {c: part.column(c).to_pylist() for c in columns}, []
                for i, rid in enumerate(part.column(key).to_pylist()):
                    parsed = {c: read_json(cols[c][i]) for c in columns}
                    before = len(out)
                    for t in tops:
                        emit(t, parsed[t.column], "", out)
                    ids += [rid] * (len(out) - before)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.int32()), pa.array([json.dumps(o[4], ensure_ascii=False) if payload else None for o in out], pa.string())],
                    names=["record", "child", "parent_key", "place", "pos", "payload"],
                )

    return df.select(F.col(key).cast("bigint").alias(key), *columns).mapInArrow(run, "record bigint, child string, parent_key string, place string, pos int, payload string")


def flat_table(shredded: DataFrame, p: Plan, name: str) -> DataFrame:
    """One relation of the plan with its inlined columns (as text) next to the foreign keys.

    Column names are the keys on the way with '_' between; a name that is taken gets a number.
    """
    rows = shredded.where(F.col("child") == name)
    names: dict[tuple[str, ...], str] = {}
    for path in p.columns[name]:
        base = re.sub(r"\W+", "_", "_".join(path)).strip("_").lower() or "value"
        n, k = base, 2
        while n in names.values() or n in ("record", "child", "parent_key", "place", "pos"):
            n, k = f"{base}_{k}", k + 1
        names[path] = n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [unwrap(json.loads(x)) if x is not None else None for x in b.column("payload").to_pylist()]
            got = [[_text(_step(v, path), bool(path)) for v in values] for path in names]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("record", "parent_key", "place", "pos")), *(pa.array(g, pa.string()) for g in got)], names=["record", "parent_key", "place", "pos", *names.values()])

    if not names:
        return rows.select("record", "parent_key", "place", "pos", F.col("payload").alias("value")).distinct()
    return rows.select("record", "parent_key", "place", "pos", "payload").mapInArrow(read, "record bigint, parent_key string, place string, pos int, " + ", ".join(f"`{n}` string" for n in names.values())).distinct()


def _text(value: object, inlined: bool) -> str | None:
    """A scalar as text; an element that is its own column also if it is a list or an object."""
    if value is _NOTHING or value is None or inlined and isinstance(value, (dict, list)):
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
