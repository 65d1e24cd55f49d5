"""Arrays inside a row, by higher-order functions: nothing is exploded or shuffled."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonloom.functions.values import let


def at(a: Column, i: Column | int) -> Column:
    """Element i, from the end if negative, cut to an integer; null outside."""
    i = (i if isinstance(i, Column) else F.lit(i)).cast("int")
    return F.get(a, F.when(i < 0, i + F.size(a)).otherwise(i))


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def cut(a: Column, start: Column | float | None = None, end: Column | float | None = None) -> Column:
    """a[start:end], negative positions from the end; a fractional end counts, a fractional start does not."""
    n = F.size(a)

    def place(v, default: Column, up: bool) -> Column:
        if v is None:
            return default
        p = (F.ceil if up else F.floor)(v if isinstance(v, Column) else F.lit(v)).cast("int")
        return F.greatest(F.lit(0), F.least(n, F.when(p < 0, p + n).otherwise(p)))

    low = place(start, F.lit(0), False)
    return F.slice(a, low + 1, F.greatest(place(end, n, True) - low, F.lit(0)))


def places(n: Column) -> Column:
    """0 to n - 1; none for n under 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def span(start: Column | float, end: Column | float, step: Column | float = 1) -> Column:
    """start, start + step, ... before end; a negative step goes down, a zero step gives none."""
    start, end, step = (x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (start, end, step))
    n = F.when(step == 0, F.lit(0)).otherwise(F.ceil((end - start) / F.when(step == 0, F.lit(1.0)).otherwise(step)))
    return F.transform(places(n), lambda i: start + i * step)


def mapped(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def flat_mapped(a: Column, f: Callable[[Column], Column]) -> Column:
    """f gives an array of outputs for each element."""
    return F.flatten(F.transform(a, f))


def selected(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(a, lambda x: F.coalesce(f(x), F.lit(False)))


def any_of(a: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.exists(a, lambda x: F.coalesce(f(x), F.lit(False)))


def all_of(a: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.forall(a, lambda x: F.coalesce(f(x), F.lit(False)))


def added(a: Column) -> Column:
    """The sum of numbers; null for none."""
    return F.when(F.size(a) == 0, None).otherwise(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0))))


def joined(a: Column) -> Column:
    """Strings put together; null for none."""
    return F.when(F.size(a) == 0, None).otherwise(F.array_join(a, "", ""))


def _order(a: Column, key: Callable[[Column], Column]) -> Column:
    """Keys with their places, in order; null first."""
    return F.array_sort(F.transform(a, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"))))


def _starts(order: Column) -> Column:
    """Where a key begins in keys that are in order."""
    return F.filter(places(F.size(order)), lambda i: (i == 0) | ~F.get(order, i)["key"].eqNullSafe(F.get(order, i - 1)["key"]))


def sort_by(a: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """Stable; null first."""
    return F.transform(_order(a, key), lambda o: F.get(a, o["at"]))


def unique_by(a: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """Sorted by key, the first of each key."""
    return let(_order(a, key), lambda order: F.transform(_starts(order), lambda i: F.get(a, F.get(order, i)["at"])))


def min_by(a: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """The first of the least; null for none."""
    return F.get(a, F.array_min(F.transform(a, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"))))["at"])


def max_by(a: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """The last of the greatest; null for none."""
    return F.get(a, F.array_max(F.transform(a, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"))))["at"])


def group_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """Arrays of the elements of each key, in order of the keys; members keep their order."""
    ends = lambda order, starts, j: F.coalesce(F.get(starts, j + 1), F.size(order))
    of = lambda order, starts: F.transform(starts, lambda i, j: F.transform(F.slice(order, i + 1, ends(order, starts, j) - i), lambda o: F.get(a, o["at"])))
    return let(_order(a, key), lambda order: let(_starts(order), lambda starts: of(order, starts)))


def reversed_(a: Column) -> Column:
    return F.reverse(a)


def indices(a: Column, needle: Column, sub: bool = False) -> Column:
    """Where an element stands, or with `sub` where a run of elements starts."""
    if sub:
        m = F.size(needle)
        return F.when(m == 0, F.array().cast("array<int>")).otherwise(F.filter(places(F.size(a) - m + 1), lambda i: F.slice(a, i + 1, m) == needle))
    return F.filter(places(F.size(a)), lambda i: F.get(a, i).eqNullSafe(needle))


def contains(a: Column, b: Column, element: Callable[[Column, Column], Column] = lambda x, y: x.eqNullSafe(y)) -> Column:
    """Every element of b is in some element of a."""
    return F.forall(b, lambda y: F.exists(a, lambda x: element(x, y)))


def flattened(a: Column, depth: int = 1) -> Column:
    """The nesting of an array's type must be at least the depth."""
    if depth < 0:
        raise ValueError("flatten depth must not be negative")
    for _ in range(depth):
        a = F.flatten(a)
    return a


def transposed(a: Column) -> Column:
    """Rows as columns; short rows are filled with null."""
    width = F.coalesce(F.array_max(F.transform(a, lambda r: F.size(r))), F.lit(0))
    return F.transform(places(width), lambda i: F.transform(a, lambda r: F.get(r, i)))


def combinations(arrays: list[Column]) -> Column:
    """All ways to take one element of each array, the first array outermost."""
    def more(out: Column, a: Column) -> Column:
        return F.flatten(F.transform(out, lambda head: F.transform(a, lambda x: F.concat(head, F.array(x)))))

    return fold(more, arrays[1:], F.transform(arrays[0], lambda x: F.array(x)))


def combinations_of(a: Column, n: int) -> Column:
    """All ways to take n elements of one array, with repetition, the first place outermost."""
    return combinations([a] * n) if n else F.array(F.array().cast("array<string>"))


def bsearch(a: Column, x: Column) -> Column:
    """In a sorted array the place of x, else minus one minus where it would stand."""
    below = F.size(F.filter(a, lambda v: v < x))
    return F.when(F.coalesce(F.get(a, below).eqNullSafe(x), F.lit(False)), below).otherwise(-1 - below)


def removed(a: Column, where: Column) -> Column:
    """Without the elements at an array of places, negative ones from the end."""
    gone = F.transform(where, lambda i: F.when(i < 0, i + F.size(a)).otherwise(i))
    return F.filter(a, lambda _, i: ~F.array_contains(gone, i))


def put(a: Column, i: int, value: Column) -> Column:
    """With the value at a place; null fills what lies between the end and it."""
    n = F.size(a)
    place = F.lit(i) if i >= 0 else n + i
    full = F.when(place >= n, F.concat(a, F.transform(places(place - n + 1), lambda _: F.get(a, F.lit(-1))))).otherwise(a)
    return F.transform(full, lambda x, j: F.when(j == place, value).otherwise(x))


def updated(a: Column, f: Callable[[Column], Column], where: Callable[[Column], Column] | None = None) -> Column:
    """Each element (that `where` holds for) through f."""
    return F.transform(a, lambda x: F.when(F.coalesce(where(x), F.lit(False)), f(x)).otherwise(x) if where else f(x))


def reduced(a: Column, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """The state after all elements."""
    return F.aggregate(a, start, step, finish) if finish else F.aggregate(a, start, step)


def running(a: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state after each element; `kind` is its SQL type."""
    empty = F.array().cast(f"array<{kind}>")
    return F.aggregate(a, empty, lambda s, x: F.concat(s, F.array(step(F.coalesce(F.try_element_at(s, F.lit(-1)), start.cast(kind)), x).cast(kind))))
