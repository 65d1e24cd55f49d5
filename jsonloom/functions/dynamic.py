"""JSON text whose shape is not known before it is read, an Arrow batch at a time.

Everything here keeps the key order and duplicate-key rules that Spark's own JSON types lose; numbers are written as values.number_text
does, not by their literals. Where the shape is
known, use the other modules: they stay in the JVM.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Steps of path(): each child of a value; a value and all below it.
EACH, DEEP = ("each",), ("deep",)
KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "boolean": pa.bool_()}
_WRITER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def _dump(x) -> str:
    return _WRITER.encode(x)


def _number(text: str):
    """A number with a fraction or exponent: whole ones are whole, those out of range are the largest doubles."""
    value = float(text)
    if value in (float("inf"), float("-inf")):
        return 1.7976931348623157e308 if value > 0 else -1.7976931348623157e308
    return int(value) if value == value and value == int(value) and abs(value) < 1e17 else value


_READER = json.JSONDecoder(parse_float=_number, parse_constant=lambda name: None if name == "NaN" else _number(name))


def _load(text: str):
    """A JSON value; NaN, which has no JSON text, is null."""
    return _READER.decode(text)


def _children(x):
    return enumerate(x) if isinstance(x, list) else x.items() if isinstance(x, dict) else ()


def _events(x, path: list, top: bool = True):
    """[path, leaf] events, and [path] behind the last child of each non-empty array or object."""
    last = None
    for last, child in _children(x):
        yield from _events(child, [*path, last], False)
    if last is None:
        yield [path, x]
    else:
        yield [[*path, last]]


def _paths(x, path: list):
    for key, child in _children(x):
        yield [*path, key]
        yield from _paths(child, [*path, key])


def _from_events(events: list):
    """The values that event sequences spell."""
    out, value, open_ = [], None, False
    for event in events:
        path = event[0]
        if len(event) == 2:
            if not path:
                out.append(event[1])
                continue
            if not open_:
                value, open_ = ([] if isinstance(path[0], int) else {}), True
            at = value
            for here, below in zip(path, path[1:], strict=False):
                at = _child(at, here, [] if isinstance(below, int) else {})
            _child(at, path[-1], event[1])
        elif len(path) == 1:
            out.append(value)
            value, open_ = None, False
    return out


def _child(at, key, value):
    if isinstance(at, list):
        if key == len(at):
            at.append(value)
        return at[key]
    return at.setdefault(key, value)


def rank(x):
    """A key for the order over all values."""
    if x is None or isinstance(x, bool):
        return (0 if x is None else 1 + x,)
    if isinstance(x, (int, float)):
        return (3, (x == x, x if x == x else 0))
    if isinstance(x, str):
        return (4, x.encode())
    if isinstance(x, list):
        return (5, [rank(v) for v in x])
    names = sorted(x, key=str.encode)
    return (6, [n.encode() for n in names], [rank(x[n]) for n in names])


def _flat(x: list, depth: int) -> list:
    return [y for v in x for y in (_flat(v, depth - 1) if isinstance(v, list) and depth else [v])]


def _mapped(f, returns: str, kind: pa.DataType | None = None):
    """f on the value of each JSON text; equal texts of an Arrow batch are read once. f must not change its value."""
    kind = kind or KINDS[returns]

    def over(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        return pa.array([f(_load(v)) for v in coded.dictionary.to_pylist()], kind).take(coded.indices)

    return arrow_udf(over, returns)


def _listed(f):
    """f on the JSON values of each array of texts."""

    def over(lists: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(_load(f"[{','.join(v)}]")) for v in lists.to_pylist()], KINDS["array<string>"])

    return arrow_udf(over, "array<string>")


def paths(x: Column) -> Column:
    """All paths below the root as JSON arrays, a parent before its children."""
    return _mapped(lambda v: [_dump(p) for p in _paths(v, [])], "array<string>")(x)


def paths_where(x: Column, holds) -> Column:
    """The paths below the root of values that `holds`, a function of a Python value, is true for."""
    return _mapped(lambda v: [_dump(p) for p in _paths(v, []) if holds(_get(v, p))], "array<string>")(x)


def _reached(x, steps: list, path: list):
    """(path, value) of what a path expression names."""
    if not steps:
        yield path, x
        return
    step, rest = steps[0], steps[1:]
    if step in (EACH, DEEP):
        if step == DEEP:
            yield from _reached(x, rest, path)
        elif not isinstance(x, (list, dict)):
            raise ValueError(f"Cannot iterate over {_kind(x)}")
        for key, child in _children(x):
            yield from _reached(child, steps if step == DEEP else rest, [*path, key])
        return
    if x is not None and not isinstance(x, dict if isinstance(step, str) else list):
        raise ValueError(f"Cannot index {_kind(x)} with {'number' if not isinstance(step, str) else _dump(step)}")
    yield from _reached(_get(x, [step]), rest, [*path, step])


def path(x: Column, steps: list, holds=None) -> Column:
    """The paths that a path expression names, whether there is a value or not: steps are keys, places, EACH and DEEP. With `holds`
    only those whose value it is true for. Raises where a step doesn't fit the kind of a value."""
    return _mapped(lambda v: [_dump(p) for p, found in _reached(v, steps, []) if holds is None or holds(found)], "array<string>")(x)


def _names(pattern) -> list[str]:
    return [pattern] if isinstance(pattern, str) else [n for p in (pattern if isinstance(pattern, list) else pattern.values()) for n in _names(p)]


def _bind(x, pattern, found: dict) -> None:
    if isinstance(pattern, str):
        found[pattern] = _dump(x)
        return
    if x is not None and not isinstance(x, type(pattern)):
        raise ValueError(f"Cannot index {_kind(x)} with {'number' if isinstance(pattern, list) else _dump(next(iter(pattern), ''))}")
    for key, below in _children(pattern):
        _bind(_get(x, [key]), below, found)


def destructured(x: Column, *patterns) -> Column:
    """A struct of the JSON texts that a pattern binds. A pattern is a name, a list of patterns for the places of an array, or a
    dict of patterns for the keys of an object; what is missing is "null". The first pattern that fits the kinds of the values
    counts, names of the others are "null"; raises where none fits."""
    names = list(dict.fromkeys(n for p in patterns for n in _names(p)))

    def bound(v):
        for pattern in patterns:
            found = dict.fromkeys(names, "null")
            try:
                _bind(v, pattern, found)
                return found
            except ValueError:
                if pattern is patterns[-1]:
                    raise

    fields = ",".join(f"`{n}`:string" for n in names)
    return _mapped(bound, f"struct<{fields}>", pa.struct([(n, pa.string()) for n in names]))(x)


def tostream(x: Column) -> Column:
    return _mapped(lambda v: [_dump(e) for e in _events(v, [])], "array<string>")(x)


def fromstream(events: Column) -> Column:
    """The values that an array of events spells."""
    return _listed(lambda v: [_dump(y) for y in _from_events(v)])(events)


def truncate_stream(events: Column, depth: int) -> Column:
    """Events without the first `depth` steps of their paths; those with no more steps go."""

    return _listed(lambda v: [_dump([e[0][depth:], *e[1:]]) for e in v if len(e[0]) > depth])(events)


def sort(x: Column) -> Column:
    """An array of any values in order."""
    return _mapped(lambda v: _dump(sorted(v, key=rank)), "string")(x)


def unique(x: Column) -> Column:
    def once(v):
        out = []
        for y in sorted(v, key=rank):
            if not out or rank(out[-1]) != rank(y):
                out.append(y)
        return _dump(out)

    return _mapped(once, "string")(x)


def flatten(x: Column, depth: int = -1) -> Column:
    return _mapped(lambda v: _dump(_flat(v, depth)), "string")(x)


def leaf_count(x: Column) -> Column:
    return _mapped(lambda v: sum(1 for e in _events(v, []) if len(e) == 2), "bigint")(x)


def _get(x, path: list):
    for key in path:
        if x is None:
            return None
        if isinstance(key, str):
            x = x.get(key) if isinstance(x, dict) else None
        else:
            x = x[int(key)] if isinstance(x, list) and -len(x) <= int(key) < len(x) else None
    return x


def _set(x, path: list, value):
    if not path:
        return value
    key, rest = path[0], path[1:]
    if isinstance(key, str):
        if x is not None and not isinstance(x, dict):
            raise ValueError(f"Cannot index {_kind(x)} with \"{key}\"")
        return {**(x or {}), key: _set((x or {}).get(key), rest, value)}
    if x is not None and not isinstance(x, list):
        raise ValueError(f"Cannot index {_kind(x)} with number")
    out = list(x or [])
    if key < -len(out):
        raise ValueError("Out of bounds negative array index")
    at = key + len(out) if key < 0 else key
    out += [None] * (at + 1 - len(out))
    out[at] = _set(out[at], rest, value)
    return out


def _kind(x) -> str:
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def _delete(x, path: list):
    if not path or x is None:
        return None
    key = path[0]
    if len(path) > 1:
        below = _get(x, [key])
        return x if below is None else _set(x, [key], _delete(below, path[1:]))
    if isinstance(x, dict):
        return {k: v for k, v in x.items() if k != key}
    at = key + len(x) if key < 0 else key
    return [v for i, v in enumerate(x) if i != at]


def _merge(x, y):
    if isinstance(x, dict) and isinstance(y, dict):
        return {**x, **{k: _merge(x[k], v) if k in x else v for k, v in y.items()}}
    return y


def _within(x, y) -> bool:
    if isinstance(x, dict) and isinstance(y, dict):
        return all(k in x and _within(x[k], v) for k, v in y.items())
    if isinstance(x, list) and isinstance(y, list):
        return all(any(_within(v, w) for v in x) for w in y)
    return y in x if isinstance(x, str) and isinstance(y, str) else rank(x) == rank(y)


def getpath(x: Column, path: list) -> Column:
    """The value at a path, "null" where there is none."""
    return _mapped(lambda v: _dump(_get(v, path)), "string")(x)


def setpath(x: Column, path: list, value) -> Column:
    """With a value put at a path; objects and arrays are made and arrays filled with null as needed."""
    return _mapped(lambda v: _dump(_set(v, path, value)), "string")(x)


def delpaths(x: Column, paths_: list[list]) -> Column:
    """Without the values at some paths, the last and deepest first."""
    ordered = sorted(paths_, key=rank, reverse=True)

    def cut(v):
        for path in ordered:
            v = _delete(v, path)
        return _dump(v)

    return _mapped(cut, "string")(x)


def pick(x: Column, paths_: list[list]) -> Column:
    """Only the values at some paths, in containers of their own."""

    def only(v):
        out = None
        for path in paths_:
            out = _set(out, path, _get(v, path))
        return _dump(out)

    return _mapped(only, "string")(x)


def merge(x: Column, y: Column) -> Column:
    """Objects merged at every level, y's values winning."""
    def over(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else _dump(_merge(_load(a), _load(b))) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.string())

    return arrow_udf(over, "string")(x, y)


def contains(x: Column, y) -> Column:
    """Strings by substring, arrays and objects by their elements, all else by equality."""
    return _mapped(lambda v: _within(v, y), "boolean")(x)


def walk(x: Column, f) -> Column:
    """f on every value, children first; f gets and gives Python values."""

    def over(v):
        v = [over(y) for y in v] if isinstance(v, list) else {k: over(y) for k, y in v.items()} if isinstance(v, dict) else v
        return f(v)

    return _mapped(lambda v: _dump(over(v)), "string")(x)


def sort_keys(x: Column) -> Column:
    """Objects with their keys in order, at every level."""
    return _mapped(lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True), "string")(x)


def pretty(x: Column, indent: int = 2) -> Column:
    return _mapped(lambda v: json.dumps(v, ensure_ascii=False, indent=indent or None, separators=(",", ": ") if indent else (",", ":")), "string")(x)


def values_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """(at, json): the JSON values that stand one after the other in each text, with other columns kept."""
    rest = [f for f in texts.schema.fields if f.name != column]

    def parse(batches):
        decoder = json.JSONDecoder()
        for batch in batches:
            kept, ats, found = [], [], []
            for row, text in enumerate(batch.column(column).to_pylist()):
                at, n, text = 0, 0, text or ""
                while True:
                    while at < len(text) and text[at] in " \t\r\n\x1e﻿":
                        at += 1
                    if at >= len(text):
                        break
                    value, at = decoder.raw_decode(text, at)
                    kept.append(row)
                    ats.append(n)
                    found.append(_dump(value))
                    n += 1
            columns = [batch.column(f.name).take(pa.array(kept, pa.int64())) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ats, pa.int32()), pa.array(found, pa.string())], names=[*(f.name for f in rest), "at", "json"])

    return texts.mapInArrow(parse, type(texts.schema)([*rest]).add("at", "integer").add("json", "string"))


def kind(x: Column) -> Column:
    """The kind of a JSON text's value, by its first character."""
    head = F.substring(F.ltrim(x), 1, 1)
    return F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(head.isin("t", "f"), "boolean").when(head == "n", "null").otherwise("number")
