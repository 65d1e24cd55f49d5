"""Objects: structs where the fields are known, maps where they are data. A map keeps the order of its entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def keys(m: Column) -> Column:
    """In order of their bytes."""
    return F.array_sort(F.map_keys(m))


def keys_unsorted(m: Column) -> Column:
    return F.map_keys(m)


def values(m: Column) -> Column:
    return F.map_values(m)


def has(m: Column, key: Column | str) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def to_entries(m: Column) -> Column:
    return F.map_entries(m)


def from_entries(entries: Column) -> Column:
    """Of entries with a key and a value; of equal keys the last value counts, at the first one's place."""
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def from_named_entries(entries: Column, fields: list[str]) -> Column:
    """Of entries whose key stands in any of key, k, name, Name, Key, K and whose value in any of value, v, Value, V; `fields` are
    the fields that these structs have. The first that is not null counts."""
    some = lambda e, names: F.coalesce(*[e[n] for n in names if n in fields], F.lit(None))
    return from_entries(F.transform(entries, lambda e: F.struct(some(e, ("key", "k", "name", "Name", "Key", "K")).cast("string").alias("key"), some(e, ("value", "v", "Value", "V")).alias("value"))))


def with_entries(m: Column, f: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """Entries through f, and only those that `keep` holds for."""
    entries = F.map_entries(m)
    entries = F.filter(entries, keep) if keep else entries
    return from_entries(F.transform(entries, f))


def map_values(m: Column, f: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """Values through f; what `keep` doesn't hold for goes."""
    m = F.map_filter(m, lambda _, v: F.coalesce(keep(v), F.lit(False))) if keep else m
    return F.transform_values(m, lambda _, v: f(v))


def deleted(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))


def picked(m: Column, *names: str) -> Column:
    """The named keys in the order of the names, null where the map has none."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.try_element_at(m, F.lit(n)) for n in names]))


def assigned(m: Column, key: str, value: Column) -> Column:
    """With key set to value; a new key comes last."""
    from jsonloom.functions.arith import merged

    return merged(m, F.create_map(F.lit(key), value))


def getpath(x: Column, path: list[str | int]) -> Column:
    """A field, element or map value by a path that is known; null anywhere on it gives null."""
    from jsonloom.functions.arrays import at

    for part in path:
        x = at(x, part) if isinstance(part, int) else x.getField(part)
    return x


def setpath(x: Column, path: list[str], value: Column) -> Column:
    """A struct with the field at a path set."""
    return x.withField(".".join(f"`{p}`" for p in path), value)


def delpaths(x: Column, *paths: list[str]) -> Column:
    """A struct without the fields at some paths."""
    return x.dropFields(*[".".join(f"`{p}`" for p in path) for path in paths])


def deep_merged(x: Column, y: Column, schema_x, schema_y) -> Column:
    """Structs merged by field: y's fields win, structs on both sides merge further, fields of x keep their place."""
    from pyspark.sql.types import StructType

    fields = []
    names = {f.name: f.dataType for f in schema_y.fields}
    for f in schema_x.fields:
        if f.name not in names:
            fields.append(x[f.name].alias(f.name))
        elif isinstance(f.dataType, StructType) and isinstance(names[f.name], StructType):
            fields.append(deep_merged(x[f.name], y[f.name], f.dataType, names[f.name]).alias(f.name))
        else:
            fields.append(y[f.name].alias(f.name))
    mine = {f.name for f in schema_x.fields}
    return F.struct(*fields, *[y[f.name].alias(f.name) for f in schema_y.fields if f.name not in mine])


def paths(schema, arrays: bool = False) -> list[list[str]]:
    """All field paths of a schema, a parent before its children; with `arrays`, an element step "[]" too."""
    from pyspark.sql.types import ArrayType, StructType

    out = []
    for f in schema.fields:
        out.append([f.name])
        kind, at = f.dataType, [f.name]
        while arrays and isinstance(kind, ArrayType):
            at, kind = [*at, "[]"], kind.elementType
            out.append(at)
        if isinstance(kind, StructType):
            out += [[*at, *p] for p in paths(kind, arrays)]
    return out


def walked(x: Column, schema, f: Callable[[Column, object], Column]) -> Column:
    """f on every value of a struct, children first; f gets the value and its type and keeps the type."""
    from pyspark.sql.types import ArrayType, StructType

    if isinstance(schema, StructType):
        x = F.when(x.isNotNull(), F.struct(*[walked(x[c.name], c.dataType, f).alias(c.name) for c in schema.fields]))
    elif isinstance(schema, ArrayType):
        x = F.transform(x, lambda e: walked(e, schema.elementType, f))
    return f(x, schema)
