"""Deeply nested records as related flat tables (problem 3), by shared inlining.

1. ``schema_graph`` walks every record once and sums up which element has which member, of which kind and how often.
   Elements are named after the member that holds them, as elements of a document type are; members whose names are
   data (``7``, ``Player 7``) are one repeated member ``#``.
2. ``plan_tables`` analyses the graph: an element gets a table of its own if it is a root, repeated (the item of a list
   or of a map), shared (an object with several parents) or recursive (it can contain itself). Every other element is a
   singleton and is inlined: its members become columns of the nearest table above it.
3. ``shred`` walks the records again and emits the rows of all tables with their keys.

A row's key is (record id, row_key). ``row_key`` is a digest of the parent's key and the step from it: the names of the
inlined members on the way, the member's own name, and the place in a list. So no two rows of a record share a key, and a
key has the same size at any depth. A row's parent is the row (record id, parent_key) of ``parent_table``; ``place`` is its
own place from 1, or the number in the member's name for a map, ``name`` that name. ``path`` holds the places from the
record down, for rows of at most ``PATH_DEPTH`` levels; deeper rows have their keys only. Rows are emitted where the record
is read: no shuffle.

Defined cases: texts that don't parse (``parse`` gives None) have no rows; null items and null members have none, but
keep their place; a member missing or null leaves its column null; a member that is a scalar here and an object there
fills a column in the first case and inlined columns in the second; items of lists within lists share a table that refers
to itself, maps within maps too; dots and backslashes inside member names are escaped by a backslash in column names;
records may be nested to any depth; an element with so many different members that the schema graph would outgrow the
driver is taken for a map, whatever its members are called; empty tables give empty results; members may be called like the
operator's own columns (they live in a map).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Members of the schema graph that are brought to the driver; beyond it the elements with most members are taken for maps.
MOST_EDGES = 20_000
#: Levels down to which rows carry their path.
PATH_DEPTH = 64
ROOT = "$"
_DATA_KEY = re.compile(r"^(?:.*\D)?(\d{1,9})$", re.S)
_GRAPH = "parent string, member string, kind string, n bigint"
_ROWS = (
    "table string, parent_table string, row_key string, parent_key string, path array<int>, parent_place int, place int, member string, name string, item_text string, "
    "columns map<string,string>"
)
_SUFFIXES = re.compile(r"(?:\[\]|\.#)+$")


def data_number(key: str) -> int | None:
    """The number in a member name that is data, as in ``7`` or ``Player 7``."""
    m = _DATA_KEY.match(key)
    return int(m.group(1)) if m and (key.isdigit() or " " in key) else None


def scalar_text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


@dataclass
class Reader:
    """How a source's text becomes records: ``parse`` gives the root value or None; ``variant`` names, for a member, the
    sibling whose value tells the kinds of that member apart (``{"content": "event"}``)."""

    parse: Callable[[str], object]
    variant: dict[str, str] = field(default_factory=dict)


def items_of(element: str, mark: str) -> str:
    """The element of the items (``[]``) or of the members of a map (``.#``); containers within containers stay at one name."""
    return _SUFFIXES.sub("", element) + mark


def _members(reader: Reader, obj: dict, is_map: bool = False) -> Iterator[tuple[str, int | None, object, str]]:
    """(element name, number if the name is data, value, name) of each member that isn't null."""
    for key, value in obj.items():
        if value is None:
            continue
        number = data_number(key)
        if number is not None or is_map:
            yield "#", number, value, key
            continue
        by = reader.variant.get(key)
        if by is not None and isinstance(value, dict) and isinstance(obj.get(by), str):
            yield f"{key}:{obj[by]}", None, value, key
        else:
            yield key, None, value, key


def _kind(value: object) -> str:
    return "object" if isinstance(value, dict) else "list" if isinstance(value, list) else "scalar"


def _count_edges(reader: Reader, name: str, value: object, edges: dict, maps: frozenset[str]) -> None:
    todo = [(name, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            for member, _, child, _ in _members(reader, v, at in maps):
                label = items_of(at, ".#") if member == "#" else member
                edges[at, label, "map " + _kind(child) if member == "#" else _kind(child)] += 1
                if not isinstance(child, (str, int, float, bool)):
                    todo.append((label, child))
        elif isinstance(v, list):
            label = items_of(at, "[]")
            for child in v:
                if child is not None:
                    edges[at, label, "item " + _kind(child)] += 1
                    if not isinstance(child, (str, int, float, bool)):
                        todo.append((label, child))


def schema_graph(texts: DataFrame, text: str, reader: Reader, maps: frozenset[str] = frozenset()) -> DataFrame:
    """(parent, member, kind, n) over all records; each task hands on its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: dict = defaultdict(int)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                root = reader.parse(t) if t is not None else None
                if root is not None:
                    _count_edges(reader, ROOT, root, edges, maps)
        keys = list(edges)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(list(edges.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["parent", "member", "kind", "n"])

    return texts.select(text).mapInArrow(run, _GRAPH).groupBy("parent", "member", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Plan:
    """``tables``: elements with a table of their own, and why; every other element is inlined. ``maps``: elements all of whose members are data."""

    tables: dict[str, str]
    maps: frozenset[str] = frozenset()


def plan_tables(edges: list[tuple[str, str, str]]) -> Plan:
    """The tables of a schema graph given as (parent, member, kind)."""
    parents: dict[str, set[str]] = defaultdict(set)
    children: dict[str, set[str]] = defaultdict(set)
    objects, why = set(), {ROOT: "root"}
    for parent, member, kind in edges:
        children[parent].add(member)
        if kind.endswith("object"):
            objects.add(member)
            parents[member].add(parent)
        if kind.startswith(("item ", "map ")):
            why[member] = "repeated"
    for member in objects:
        if member not in why and len(parents[member]) > 1:
            why[member] = "shared"
    for member in objects:  # recursive: reachable from itself
        todo, seen = list(children[member]), set()
        while todo:
            at = todo.pop()
            if at == member:
                why.setdefault(member, "recursive")
                break
            if at not in seen:
                seen.add(at)
                todo.extend(children[at])
    return Plan(why)


def learn_plan(texts: DataFrame, text: str, reader: Reader, most: int = MOST_EDGES) -> Plan:
    """Scalar members can't get a table, so only what holds others, or is repeated, is brought to the driver."""
    maps: frozenset[str] = frozenset()
    while True:
        graph = schema_graph(texts, text, reader, maps).filter(F.col("kind") != "scalar").select("parent", "member", "kind")
        edges = graph.limit(most + 1).collect()
        if len(edges) <= most:
            return Plan(plan_tables([tuple(r) for r in edges]).tables, maps)
        # names are data: the elements with most different members become maps, as many as it takes at least
        wide = graph.filter(~F.col("kind").startswith("map ")).groupBy("parent").agg(F.count_distinct("member").alias("n"))
        maps |= {r.parent for r in wide.orderBy(F.desc("n"), "parent").limit(max(1, most // 200)).collect()}


def _key(parent: str, step: str) -> str:
    return hashlib.blake2b(f"{parent}\0{step}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _escaped(name: str) -> str:
    return name.replace("\\", "\\\\").replace(".", "\\.") if "." in name or "\\" in name else name


def _emit(reader: Reader, plan: Plan, root: object, only: Callable[[str], bool]) -> Iterator[tuple]:
    """Rows (table, parent table, key, parent's key, path, parent's place, place, member, name, item text, columns) of a record, parents before children."""
    todo: list[tuple] = [(ROOT, None, None, "$", (), None, None, ROOT, None, root)]
    while todo:
        table, parent_table, parent_key, step, path, parent_place, place, member, own, value = todo.pop()
        wanted = only(table)
        if not wanted and not isinstance(value, (dict, list)):
            continue
        key = _key(parent_key, step) if parent_key is not None else ROOT
        short = path is not None and len(path) < PATH_DEPTH
        columns: dict[str, str | None] = {}
        below: list[tuple] = []
        inline: list[tuple[str, str, object]] = [("", table, value)]
        while inline:
            prefix, element, v = inline.pop()
            if isinstance(v, dict):
                for name, number, child, own_name in _members(reader, v, element in plan.maps):
                    label = items_of(element, ".#") if name == "#" else name
                    if name == "#" or (isinstance(child, dict) and label in plan.tables):
                        at = number if name == "#" else 1
                        deeper = (*path, 0 if at is None else at) if short else None
                        below.append((label, table, key, f"{prefix}{_escaped(own_name)}", deeper, place, at, element if name == "#" else name, own_name, child))
                    elif isinstance(child, (dict, list)):
                        inline.append((f"{prefix}{_escaped(own_name)}.", label, child))
                    elif wanted:
                        columns[prefix + _escaped(own_name)] = scalar_text(child)
            elif isinstance(v, list):
                label = items_of(element, "[]")
                for i, child in enumerate(v, 1):
                    if child is not None:
                        below.append((label, table, key, f"{prefix}[{i}]", (*path, i) if short else None, place, i, element, None, child))
        if wanted:
            text = None if isinstance(value, (dict, list)) else scalar_text(value)
            yield table, parent_table, key, parent_key, None if path is None else list(path), parent_place, place, member, own, text, columns
        todo.extend(reversed(below))


def shred(texts: DataFrame, key: str, text: str, reader: Reader, plan: Plan | None = None, only: set[str] | None = None) -> DataFrame:
    """(rec_id, table, parent_table, row_key, parent_key, path, parent_place, place, member, name, item_text, columns): the rows of all tables.

    ``columns`` holds the inlined members by dotted name; ``flat_table`` makes a table of named columns of it. ``only``
    names the tables that are asked for; the rows of others aren't made.
    """
    plan = plan or learn_plan(texts, text, reader)
    kind = texts.schema[key].dataType.simpleString()
    text_type, number = pa.string(), pa.int32()
    types = [text_type, text_type, text_type, text_type, pa.list_(number), number, number, text_type, text_type, text_type, pa.map_(text_type, text_type)]
    names = ["table", "parent_table", "row_key", "parent_key", "path", "parent_place", "place", "member", "name", "item_text", "columns"]
    wanted = only.__contains__ if only is not None else lambda _: True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                root = reader.parse(t) if t is not None else None
                if root is not None:
                    for row in _emit(reader, plan, root, wanted):
                        ids.append(i)
                        rows.append(row)
            cols = [batch.column(0).take(pa.array(ids, pa.int64()))]
            for j, type_ in enumerate(types):
                values = [list(r[j].items()) if j == 10 else r[j] for r in rows]
                cols.append(pa.array(values, type_))
            yield pa.RecordBatch.from_arrays(cols, ["rec_id", *names])

    return texts.select(key, text).mapInArrow(run, f"rec_id {kind}, {_ROWS}")


def flat_table(rows: DataFrame, table: str | Column, columns: dict[str, str]) -> DataFrame:
    """One table: its keys and ``columns`` (output name -> dotted member name)."""
    where = F.col("table") == table if isinstance(table, str) else table
    keys = ["rec_id", "table", "parent_table", "row_key", "parent_key", "path", "place"]
    return rows.filter(where).select(*keys, *[F.col("columns")[src].alias(out) for out, src in columns.items()], "item_text")


def child_items(rows: DataFrame) -> DataFrame:
    """(rec_id, row_key, parent_key, parent_no, member, name, item_no, item): every child with its parent's place (0: the record)."""
    return rows.filter("parent_table IS NOT NULL").select(
        "rec_id", "row_key", "parent_key", F.coalesce("parent_place", F.lit(0)).alias("parent_no"), "table", "parent_table", "member", "name",
        F.col("place").alias("item_no"), F.col("item_text"), "columns",
    )
