"""Nested JSON records as related flat tables, one typed table for each structural variant."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- JSON

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))')


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_constant)
_BAD = object()


def parse(text: str | None):
    """The value of a complete JSON text, ``_BAD`` otherwise; texts that are JSON strings of JSON are unwrapped."""
    while isinstance(text, str):
        try:
            text = _DECODER.decode(text.strip(" \t\n\r"))
        except RecursionError:
            try:
                text = _parse_deep(text)
            except ValueError:
                return _BAD
        except ValueError:
            return _BAD
    return _BAD if text is None else text


def _parse_deep(text: str):
    """The same without recursion, for nesting beyond the interpreter's stack."""
    tokens, at, n = [], 0, len(text.rstrip(" \t\n\r"))
    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            return _BAD
        tokens.append(m)
        at = m.end()
    stack: list[tuple[object, str | None]] = []
    value, key, expect = _BAD, None, "value"
    done = False
    for m in tokens:
        mark = m[1]
        if done:
            return _BAD
        if mark in ("[", "{"):
            if expect not in ("value", "first"):
                return _BAD
            stack.append(([] if mark == "[" else {}, key))
            key, expect = None, "first" if mark == "[" else "firstkey"
            continue
        if mark == ":":
            if expect != "colon":
                return _BAD
            expect = "value"
            continue
        if mark == ",":
            if expect != "next":
                return _BAD
            expect = "value" if isinstance(stack[-1][0], list) else "key"
            continue
        if mark in ("]", "}"):
            if not stack or isinstance(stack[-1][0], list) != (mark == "]") or expect not in ("next", "first" if mark == "]" else "firstkey"):
                return _BAD
            value, key = stack.pop()
        elif m[2] and expect in ("key", "firstkey"):
            key, expect = _DECODER.decode(m[2]), "colon"
            continue
        elif expect in ("value", "first"):
            value = _DECODER.decode(m[2] or m[3])
        else:
            return _BAD
        if not stack:
            done = True
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
            expect = "next"
        else:
            stack[-1][0][key] = value
            key, expect = None, "next"
    return value if done else _BAD


# ---------------------------------------------------------------- shapes

#: States of the tree automaton. A value's state follows from its kind and the set of its children's states alone.
NULL, FLAG, NUMBER, TEXT, OBJECT, NAMED = "null", "flag", "number", "text", "object", "named"
EMPTY, TEXTS, NESTED, OBJECTS, MIXED = "empty", "texts", "nested", "objects", "mixed"
_ATOMS = {type(None): NULL, bool: FLAG, int: NUMBER, float: NUMBER, str: TEXT}
_LISTS = {frozenset(): EMPTY, frozenset({TEXT}): TEXTS, frozenset({NAMED}): OBJECTS}
_ARRAYS = {EMPTY, TEXTS, NESTED}


def _array_state(children: frozenset) -> str:
    if children in _LISTS:
        return _LISTS[children]
    if children <= {TEXT, *_ARRAYS}:
        return NESTED
    return MIXED


def state_of(value) -> str:
    """Runs the automaton bottom up, without recursion."""
    if type(value) in _ATOMS:
        return _ATOMS[type(value)]
    if isinstance(value, dict):
        return NAMED if isinstance(value.get("name"), str) else OBJECT
    stack: list[tuple[Iterator, set]] = [(iter(value), set())]
    while True:
        it, seen = stack[-1]
        for child in it:
            if isinstance(child, list):
                stack.append((iter(child), set()))
                break
            seen.add(state_of(child))
        else:
            stack.pop()
            state = _array_state(frozenset(seen))
            if not stack:
                return state
            stack[-1][1].add(state)


def _leaves(value) -> Iterator[tuple[int, object]]:
    """(depth, leaf) of nested arrays in order; objects are leaves."""
    stack = [iter([value])]
    while stack:
        for v in stack[-1]:
            if isinstance(v, list):
                stack.append(iter(v))
                break
            yield len(stack) - 1, v
        else:
            stack.pop()


# ---------------------------------------------------------------- routes

#: Columns of the one stream that all tables are selected from.
FLAT = pa.schema(
    [
        ("table", pa.string()),
        ("raw_id", pa.int64()),
        ("attr_path", pa.string()),
        ("variant", pa.string()),
        ("ordinal", pa.int32()),
        ("depth", pa.int32()),
        ("item", pa.string()),
        ("detail", pa.string()),
        ("is_default", pa.bool_()),
    ]
)

#: Table of a child by its field and the state of its value; what isn't here has no items. ``eval`` keeps platforms in ``meta``, ``latest`` at the top.
ROUTES = {
    "outputs": {OBJECT: "outputs_object", NAMED: "outputs_object"},
    "latest_outputs": {NAMED: "outputs_single", OBJECTS: "outputs_array", MIXED: "outputs_array"},
    **{f: {TEXT: "platforms_single", TEXTS: "platforms_array", NESTED: "platforms_nested", MIXED: "platforms_nested"} for f in ("platforms", "latest_platforms")},
    "meta_version": {TEXT: "meta_version_single", TEXTS: "meta_version_array", NESTED: "meta_version_array", MIXED: "meta_version_array"},
}
CHILD_TABLES = {t: f.removeprefix("latest_") for f, routes in ROUTES.items() for t in routes.values()}


def _entries(shape: str, doc) -> Iterator[tuple[str | None, dict, dict[str, object]]]:
    """(attr_path, object, its children by field) of each package of a record."""
    if not isinstance(doc, dict):
        return
    if shape == "latest":
        path = doc.get("attr_path")
        children = {"latest_outputs": doc.get("outputs"), "latest_platforms": doc.get("platforms"), "meta_version": doc.get("meta_version")}
        yield path if isinstance(path, str) else None, doc, children
    elif shape == "eval":
        wrapped = _ATOMS.get(type(doc.get("version"))) == NUMBER and isinstance(doc.get("packages"), dict)
        for path, package in (doc["packages"] if wrapped else doc).items():
            if isinstance(package, dict) and isinstance(package.get("outputs"), dict):
                meta = package.get("meta")
                yield path, package, {"outputs": package["outputs"], "platforms": meta.get("platforms") if isinstance(meta, dict) else None}


def shred_record(raw_id: int | None, shape: str | None, payload: str | None) -> Iterator[tuple]:
    """Rows of ``FLAT`` of one record."""
    for path, package, children in _entries(shape, parse(payload)):
        states = {f: state_of(v) for f, v in children.items()}
        variant = ",".join([f"{f.removeprefix('latest_')}={s}" for f, s in states.items()])
        texts = [package.get(k) if isinstance(package.get(k), str) else None for k in ("version", "system")]
        yield "packages", raw_id, path, f"{shape}:{variant}", None, None, texts[0], texts[1], None
        for field, value in children.items():
            table = ROUTES[field].get(states[field])
            if not table:
                continue
            if table == "outputs_object":
                items = ((1, k, v, None) for k, v in value.items())
            elif field == "latest_outputs":
                items = ((d, v["name"], v.get("path"), v.get("default")) for d, v in _leaves(value) if isinstance(v, dict) and isinstance(v.get("name"), str))
            else:
                items = ((d, v.strip() if field.endswith("platforms") else v, None, None) for d, v in _leaves(value) if isinstance(v, str))
            for k, (depth, item, detail, default) in enumerate(items):
                if item:
                    yield table, raw_id, path, states[field], k, depth, item, detail if isinstance(detail, str) else None, default if isinstance(default, bool) else None


def _shredded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in FLAT]
        for record in zip(*(batch.column(c).to_pylist() for c in ("raw_id", "shape", "payload"))):
            for row in shred_record(*record):
                for col, v in zip(cols, row):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(_utf8(c) if t.type == pa.string() else c, t.type) for c, t in zip(cols, FLAT)], schema=FLAT)


def _utf8(values: list) -> list:
    """Escapes may name half of a surrogate pair, which no text can hold; it becomes U+FFFD."""
    try:
        pa.array(values, pa.string())
        return values
    except (UnicodeEncodeError, pa.ArrowException):
        return [v if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values]


def shred(records: DataFrame) -> DataFrame:
    """One pass over ``records (raw_id, shape, payload)`` into the rows of all flat tables, column ``table`` telling them apart.

    ``packages`` is the common supertype: one row for each package of a record with its structural ``variant``; the
    other tables hold the items of its children, each with ``raw_id`` and ``attr_path`` of its parent, its place and
    depth. A tree automaton gives each child value a state from the states of its parts; the state picks the table
    (``ROUTES``). Payloads that are null or no complete JSON give nothing, those quoted once more are unwrapped; of repeated object keys
    the last counts; empty strings are no items; fields of another type have none. Unknown shapes and empty tables give no rows.
    Each record is one row of one task: nothing is gathered.
    """
    ddl = ", ".join(f"`{f.name}` {({pa.string(): 'string', pa.int64(): 'long', pa.int32(): 'int', pa.bool_(): 'boolean'})[f.type]}" for f in FLAT)
    return records.select(F.col("raw_id").cast("long").alias("raw_id"), "shape", "payload").mapInArrow(_shredded, ddl)


def subtype_table(flat: DataFrame, name: str) -> DataFrame:
    """One of the typed tables of ``shred``, copies of a record counting once."""
    own = flat.where(F.col("table") == name)
    if name == "packages":
        return own.select("raw_id", "attr_path", "variant", F.col("item").alias("version"), F.col("detail").alias("system")).distinct()
    cols = {"outputs_object": ["path"], "outputs_single": ["path", "is_default"], "outputs_array": ["path", "is_default"]}.get(name, [])
    return own.select("raw_id", "attr_path", "ordinal", "depth", "item", *(F.col("detail").alias(c) if c == "path" else F.col(c) for c in cols)).distinct()


def child_items(flat: DataFrame) -> DataFrame:
    """``(raw_id, attr_path, child, item)``: each distinct item of all the child tables."""
    child = F.create_map(*(F.lit(x) for kv in CHILD_TABLES.items() for x in kv))[F.col("table")]
    return flat.where(F.col("table") != "packages").select("raw_id", "attr_path", child.alias("child"), "item").distinct()
