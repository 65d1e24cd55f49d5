"""Regular expressions, as Java understands them; POSIX classes and flags are translated, what Java reads otherwise is refused.

Flags: g all matches, i ignore case, x extended, s none, n no empty matches, l and p as documented in translated().
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from jsonloom.functions.values import let

POSIX = {"alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}", "space": r"\s", "punct": r"\p{IsPunctuation}", "cntrl": r"\p{Cntrl}", "xdigit": "0-9A-Fa-f", "word": r"\w", "blank": r" \t"}
REFUSED = [r"\(\?~", r"\(\*", r"\\g<", r"\\k<[^>]*[+-]\d", r"\(\?\("]


def translated(pattern: str, flags: str | None = "") -> str:
    """A pattern for Java: x and i as they are, s (single line) as nothing, p and m as dot-all; \\h is a hex digit."""
    flags = flags or ""
    if bad := set(flags) - set("gixsnplm"):
        raise ValueError(f"{flags} is not a valid modifier string: {''.join(sorted(bad))}")
    if "l" in flags:
        raise ValueError("longest match is not supported")
    for refused in REFUSED:
        if re.search(refused, pattern):
            raise ValueError(f"this construct is not supported: {refused}")
    out = re.sub(r"\[:(\^?)(\w+):\]", lambda m: f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]], pattern)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\h", r"\1[0-9A-Fa-f]", out)
    inline = ("i" if "i" in flags else "") + ("x" if "x" in flags else "") + ("s" if set(flags) & {"p", "m"} else "")
    return f"(?{inline}){out}" if inline else out


def groups(pattern: str) -> list[str | None]:
    """The capture groups in order, each with its name or None."""
    found, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(" and pattern[i + 1 : i + 2] != "?":
            found.append(None)
        elif m := re.match(r"\(\?<([A-Za-z]\w*)>", pattern[i:]):
            found.append(m[1])
        i += 1
    return found


def test(s: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_like(s, F.lit(translated(pattern, flags)))


def optional(pattern: str) -> bool:
    """Whether a match may leave out a group: then null must be told from the empty text, which Java's functions in Spark don't do."""
    return bool(re.search(r"\||\)(?:[?*]|\{0?,)", re.sub(r"\\.|\[[^\]]*\]", "", pattern)))


def capture(s: Column, pattern: str, flags: str = "") -> Column:
    """The named groups of the first match as a struct, a group that took no part null; null without a match. With the flag g an
    array of all matches' structs."""
    java = translated(pattern, flags)
    named = [(i + 1, name) for i, name in enumerate(groups(pattern)) if name]
    if "g" in flags or optional(pattern):
        each = F.transform(match(s, pattern, flags), lambda m: F.struct(*[m["captures"][i - 1]["string"].alias(name) for i, name in named]))
        return each if "g" in flags else F.get(each, F.lit(0))
    return F.when(F.regexp_like(s, F.lit(java)), F.struct(*[F.regexp_extract(s, java, i).alias(name) for i, name in named]))


def scan(s: Column, pattern: str, flags: str = "") -> Column:
    """All matches; with groups, an array of the groups of each, null for a group that took no part."""
    java, n = translated(pattern, flags), len(groups(pattern))
    if n and optional(pattern):
        return F.transform(match(s, pattern, flags + "g"), lambda m: F.transform(m["captures"], lambda c: c["string"]))
    if not n:
        return F.regexp_extract_all(s, F.lit(java), F.lit(0))
    each = [F.regexp_extract_all(s, F.lit(java), F.lit(i + 1)) for i in range(n)]
    return F.transform(F.arrays_zip(*[x.alias(f"g{i}") for i, x in enumerate(each)]), lambda m: F.array(*[m[f"g{i}"] for i in range(n)]))


def splits(s: Column, pattern: str, flags: str = "") -> Column:
    """The parts between matches."""
    return F.when(s == "", F.array(F.lit(""))).otherwise(F.split(s, translated(pattern, flags), -1))


def _template(text: str) -> str:
    """A replacement with {name} for captures, as Java wants it."""
    parts = re.findall(r"\{(\w+)\}|([^{]+|\{)", text)
    return "".join(f"${{{name}}}" if name else re.sub(r"([\\$])", r"\\\1", plain) for name, plain in parts)


def gsub(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Every match replaced; {name} in the replacement stands for a named group."""
    return F.regexp_replace(s, F.lit(translated(pattern, flags)), F.lit(_template(replacement)))


def sub(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match replaced. Groups in the pattern are referred to by name, not by number."""
    java = translated(pattern, flags)
    if re.search(r"\\[1-9]", pattern):
        raise ValueError("refer to groups by name")
    return F.regexp_replace(s, F.lit(rf"(?s:\A(?<before0>.*?))(?<match0>{java})(?s:(?<after0>.*)\z)"), F.lit("${before0}" + _template(replacement) + "${after0}"))


def replaced(s: Column, pattern: str, f: Callable[[Column], Column], flags: str = "") -> Column:
    """The first match, or with the flag g every match, put in place of what f makes of its named groups, a struct; a group that took
    no part is null, and a null result ends as null."""
    named = [(i, name) for i, name in enumerate(groups(pattern)) if name]

    def put(matches: Column) -> Column:
        ends = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(matches, i - 1)["offset"] + F.get(matches, i - 1)["length"])
        made = lambda m: f(F.struct(*[m["captures"][i]["string"].alias(name) for i, name in named]) if named else F.lit(None))
        parts = F.transform(matches, lambda m, i: F.concat(F.substr(s, ends(i) + 1, m["offset"] - ends(i)), made(m)))
        return F.concat(F.aggregate(parts, F.lit(""), lambda out, part: F.concat(out, part)), F.substr(s, ends(F.size(matches)) + 1))

    return let(match(s, pattern, flags), put)


MATCH = "array<struct<offset:int,length:int,string:string,captures:array<struct<offset:int,length:int,string:string,name:string>>>>"


def match(s: Column, pattern: str, flags: str = "") -> Column:
    """Matches with code-point offsets and captures (Spark has no function for offsets): the first, or all with g."""
    translated(pattern, flags)
    # this engine reads POSIX classes and named groups as they are
    python = regex.compile(re.sub(r"(?<!\\)((?:\\\\)*)\\h", r"\1[0-9A-Fa-f]", pattern), (regex.I if "i" in flags else 0) | (regex.X if "x" in flags else 0) | (regex.S if set(flags) & {"p", "m"} else 0))
    names = {i: name for name, i in python.groupindex.items()}

    def one(m) -> dict:
        captures = [{"offset": m.start(i) if m[i] is not None else -1, "length": len(m[i]) if m[i] is not None else 0, "string": m[i], "name": names.get(i)} for i in range(1, python.groups + 1)]
        return {"offset": m.start(), "length": len(m[0]), "string": m[0], "captures": captures}

    @pandas_udf(MATCH)
    def found(values):
        def of(v):
            if v is None:
                return None
            all_ = (one(m) for m in python.finditer(v) if m[0] or "n" not in flags)
            return list(all_) if "g" in flags else [x for _, x in zip(range(1), all_, strict=False)]

        return values.map(of)

    return found(s)
