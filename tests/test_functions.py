"""Single values, against results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from jsonloom.functions import arith, arrays, dynamic, formats, maths, objects, regex, strings, times, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


L = F.lit
A = lambda *xs: F.array(*[L(x) for x in xs])
INTS = "array<int>"

CASES = {
    "add numbers": (lambda: arrays.added(F.transform(A(1, 2, 3), lambda x: x * 2)), 12.0),
    "add none": (lambda: arrays.added(F.array().cast(INTS)), None),
    "plus null": (lambda: arith.plus(L(None).cast("int"), L(3)), 3),
    "joined": (lambda: arith.joined(L("a"), L(None).cast("string")), "a"),
    "without keeps repeats": (lambda: arith.without(A(1, 2, 1, 3, 1), A(2)), [1, 1, 3, 1]),
    "repeat": (lambda: arith.repeated(L("ab"), L(2.7)), "abab"),
    "repeat zero": (lambda: arith.repeated(L("ab"), L(0.5)), ""),
    "repeat negative": (lambda: arith.repeated(L("ab"), L(-1)), None),
    "remainder sign": (lambda: arith.remainder(L(-5), L(3)), -2.0),
    "remainder cut": (lambda: arith.remainder(L(5.9), L(-3.2)), 2.0),
    "remainder one": (lambda: arith.remainder(L(7), L(-1)), 0.0),
    "length": (lambda: F.length(L("a😀b")), 3),
    "indices": (lambda: strings.indices(L("😀a😀"), "😀"), [0, 2]),
    "indices overlap": (lambda: strings.indices(L("aaa"), "aa"), [0, 1]),
    "index none": (lambda: strings.index(L("abc"), "x"), None),
    "rindex": (lambda: strings.rindex(L("a,b,c"), ","), 3),
    "split characters": (lambda: strings.split(L("abc"), ""), ["a", "b", "c"]),
    "split empty": (lambda: strings.split(L(""), ","), []),
    "split ends": (lambda: strings.split(L(",a,"), ","), ["", "a", ""]),
    "split pattern signs": (lambda: strings.split(L("a.b.c"), "."), ["a", "b", "c"]),
    "join": (lambda: strings.join(A("a", None, "b"), "-"), "a--b"),
    "join none": (lambda: strings.join(F.array().cast("array<string>"), "-"), ""),
    "implode": (lambda: strings.implode(A(65.9, 128512.0)), "A😀"),
    "explode": (lambda: strings.explode(L("a😀")), [97, 128512]),
    "slice": (lambda: strings.slice(L("abcdef"), 1, -1), "bcde"),
    "slice fraction": (lambda: strings.slice(L("abcdef"), 1.9, 3.1), "bcd"),
    "trim": (lambda: strings.trim(L("\t  a b\n")), "a b"),
    "trimstr": (lambda: strings.trimstr(L("xaxx"), "x"), "ax"),
    "downcase": (lambda: strings.ascii_downcase(L("ÀB")), "Àb"),
    "number": (lambda: strings.to_number(L("-1.5e2")), -150.0),
    "try number": (lambda: strings.try_number(L(" 1")), None),
    "boolean": (lambda: strings.to_boolean(L("false")), False),
    "at end": (lambda: arrays.at(A(1, 2, 3), -1), 3),
    "at outside": (lambda: arrays.at(A(1, 2, 3), 3), None),
    "cut": (lambda: arrays.cut(A(0, 1, 2, 3, 4), -3, -1), [2, 3]),
    "cut fraction": (lambda: arrays.cut(A(0, 1, 2, 3), 1.2, 2.2), [1, 2]),
    "cut outside": (lambda: arrays.cut(A(0, 1), 5, 9), []),
    "range": (lambda: arrays.span(0, 3.2), [0.0, 1.0, 2.0, 3.0]),
    "range down": (lambda: arrays.span(5, 0, -2), [5.0, 3.0, 1.0]),
    "range none": (lambda: arrays.span(0, -1), []),
    "range no step": (lambda: arrays.span(0, 3, 0), []),
    "group": (lambda: arrays.group_by(A(3, 1, 2), lambda x: x % 2), [[2], [3, 1]]),
    "sort null first": (lambda: arrays.sort_by(A(2, None, 1)), [None, 1, 2]),
    "sort stable": (lambda: arrays.sort_by(A("bb", "a", "cc", "d"), F.length), ["a", "d", "bb", "cc"]),
    "unique": (lambda: arrays.unique_by(A(2, 1, 2, None, None)), [None, 1, 2]),
    "min first": (lambda: arrays.min_by(A("bb", "a", "c"), F.length), "a"),
    "max last": (lambda: arrays.max_by(A("bb", "a", "cc"), F.length), "cc"),
    "min none": (lambda: arrays.min_by(F.array().cast(INTS)), None),
    "subsequence": (lambda: arrays.indices(A(1, 2, 1, 2, 1), A(1, 2), sub=True), [0, 2]),
    "contains": (lambda: arrays.contains(A("foobar", "baz"), A("bar"), lambda x, y: F.contains(x, y)), True),
    "transpose": (lambda: arrays.transposed(F.array(A(1, None), A(2, 3))), [[1, 2], [None, 3]]),
    "combinations": (lambda: arrays.combinations([A(1, 2), A(3, 4)]), [[1, 3], [1, 4], [2, 3], [2, 4]]),
    "search found": (lambda: arrays.bsearch(A(1, 3, 5), L(3)), 1),
    "search place": (lambda: arrays.bsearch(A(1, 3, 5), L(4)), -3),
    "removed": (lambda: arrays.removed(A(0, 1, 2, 3), A(-1, -2)), [0, 1]),
    "put beyond": (lambda: arrays.put(A(1), 3, L(9)), [1, None, None, 9]),
    "any of none": (lambda: arrays.any_of(F.array().cast("array<boolean>")), False),
    "all of none": (lambda: arrays.all_of(F.array().cast("array<boolean>")), True),
    "running": (lambda: arrays.running(A(1, 2, 3), L(0), lambda s, x: s + x, "int"), [1, 3, 6]),
    "last entry wins": (lambda: objects.from_entries(F.array(*[F.struct(L(k).alias("key"), L(v).alias("value")) for k, v in (("a", 1), ("b", 2), ("a", 3))])), {"a": 3, "b": 2}),
    "picked": (lambda: objects.picked(F.create_map(L("a"), L(1)), "a", "z"), {"a": 1, "z": None}),
    "merged order": (lambda: objects.keys_unsorted(arith.merged(F.create_map(L("b"), L(1), L("a"), L(1)), F.create_map(L("b"), L(2), L("c"), L(2)))), ["b", "a", "c"]),
    "html": (lambda: formats.html(L("!()<>&'\"\t")), "!()&lt;&gt;&amp;&apos;&quot;\t"),
    "uri": (lambda: formats.uri(L("a μ ∰ 😎*~")), "a%20%CE%BC%20%E2%88%B0%20%F0%9F%98%8E%2A~"),
    "urid plus": (lambda: formats.urid(L("a+b%20c")), "a+b c"),
    "csv": (lambda: formats.csv([(L(1), "number"), (L("!()<>&'\"\t"), "string"), (L(None).cast("string"), "string"), (L(True), "boolean")]), "1,\"!()<>&'\"\"\t\",,true"),
    "tsv": (lambda: formats.tsv([(L("a\tb\\"), "string"), (L(float("nan")), "number")]), "a\\tb\\\\\t"),
    "shell": (lambda: formats.shell(L("O'Hara")), "'O'\\''Hara'"),
    "base64 long": (lambda: formats.base64(L("x" * 100)), "eHh4" * 33 + "eA=="),
    "base64 no padding": (lambda: formats.base64d(L("YWJjZA")), "abcd"),
    "number text whole": (lambda: values.number_text(L(3.0)), "3"),
    "number text large": (lambda: values.number_text(L(1e10)), "10000000000"),
    "number text exponent": (lambda: values.number_text(L(1e300)), "1e+300"),
    "number text small": (lambda: values.number_text(L(1e-5)), "1e-05"),
    "number text tenth": (lambda: values.number_text(L(0.0001)), "0.0001"),
    "number text part": (lambda: values.number_text(L(-123.456)), "-123.456"),
    "number text nan": (lambda: values.number_text(L(float("nan"))), "null"),
    "number text infinite": (lambda: values.number_text(L(float("inf"))), "1.7976931348623157e+308"),
    "less null": (lambda: values.less(L(None).cast("int"), L(1)), True),
    "nan below nan": (lambda: values.less_numbers(L(float("nan")), L(float("nan"))), True),
    "nan unequal": (lambda: values.equal_numbers(L(float("nan")), L(float("nan"))), False),
    "alternative false": (lambda: values.alternative(L(False), L(True), booleans=True), True),
    "zero is true": (lambda: values.truthy(L(0)), True),
    "round half": (lambda: maths.round(L(-2.5)), -3.0),
    "rint half": (lambda: maths.unary("rint", L(2.5)), 2.0),
    "trunc": (lambda: maths.trunc(L(-1.7)), -1.0),
    "log zero": (lambda: maths.log(L(0.0)), -math.inf),
    "fmax nan": (lambda: maths.fmax(L(float("nan")), L(1.0)), 1.0),
    "remainder near": (lambda: maths.remainder(L(10.0), L(3.0)), 1.0),
    "frexp": (lambda: maths.frexp(L(8.0)), [0.5, 4.0]),
    "modf": (lambda: maths.modf(L(-3.25)), [-0.25, -3.0]),
    "significand": (lambda: maths.significand(L(10.0)), 1.25),
    "gamma": (lambda: maths.special("tgamma", L(5.0)), 24.0),
    "nextafter": (lambda: maths.special("nextafter", L(1.0), L(2.0)), math.nextafter(1.0, 2.0)),
    "fma": (lambda: maths.special("fma", L(2.0), L(3.0), L(4.0)), 10.0),
    "mktime": (lambda: times.mktime(A(2024, 8, 21)), 1726876800),
    "mktime carries": (lambda: times.mktime(A(2023, 12, 1)), 1704067200),
    "fromdate": (lambda: times.fromdate(L("2015-03-05T23:51:47Z")), 1425599507),
    "todate": (lambda: times.todate(L(1425599507)), "2015-03-05T23:51:47Z"),
    "gmtime": (lambda: times.gmtime(L(-0.25)), [1970.0, 0.0, 1.0, 0.0, 0.0, 0.75, 4.0, 0.0]),
    "strftime": (lambda: times.strftime(L(1425599621), "%A, %B %d, %Y %e %U"), "Thursday, March 05, 2015  5 09"),
    "strptime": (lambda: times.strptime(L("2015-03-05T23:51:47Z"), "%Y-%m-%dT%H:%M:%SZ"), [2015.0, 2.0, 5.0, 23.0, 51.0, 47.0, 4.0, 63.0]),
    "test flag": (lambda: regex.test(L("ABC"), "b", "i"), True),
    "test class": (lambda: regex.test(L("xyz"), "^[[:alpha:]]+$"), True),
    "scan groups": (lambda: regex.scan(L("a1b2"), "([a-z])([0-9])"), [["a", "1"], ["b", "2"]]),
    "gsub names": (lambda: regex.gsub(L("ab $1"), "(?<x>[a-z])", "<{x}>"), "<a><b> $1"),
    "gsub signs": (lambda: regex.gsub(L("a.b"), r"\.", "$\\"), "a$\\b"),
    "sub first": (lambda: regex.sub(L("aaa"), "a", "b"), "baa"),
    "sub none": (lambda: regex.sub(L("xyz"), "a", "b"), "xyz"),
    "paths": (lambda: dynamic.paths(L("[1,[2]]")), ["[0]", "[1]", "[1,0]"]),
    "tostream": (lambda: dynamic.tostream(L('{"a":[1,{"b":2}]}')), ['[["a",0],1]', '[["a",1,"b"],2]', '[["a",1,"b"]]', '[["a",1]]', '[["a"]]']),
    "stream back": (lambda: dynamic.fromstream(dynamic.tostream(L('{"a":[1,{"b":2},[]]}'))), ['{"a":[1,{"b":2},[]]}']),
    "truncated": (lambda: dynamic.truncate_stream(A("[[0],1]", "[[1,0],2]", "[[1,0]]", "[[1]]"), 1), ["[[0],2]", "[[0]]"]),
    "sort kinds": (lambda: dynamic.sort(L('[{"a":1},[1],"b",2,true,false,null]')), '[null,false,true,2,"b",[1],{"a":1}]'),
    "unique kinds": (lambda: dynamic.unique(L('[1,1,"a",null,[1],[1],null]')), '[null,1,"a",[1]]'),
    "flatten deep": (lambda: dynamic.flatten(L("[1,[2,[3,[4]]]]"), 1), "[1,2,[3,[4]]]"),
    "kind": (lambda: dynamic.kind(L(" [1]")), "array"),
}


@pytest.mark.parametrize("name", CASES)
def test_value(spark, name):
    column, want = CASES[name]
    assert one(spark, column()) == want


def test_errors(spark):
    for column in (arith.divided(L(1), L(0)), arith.remainder(L(1), L(0.5)), strings.to_number(L("1x")), strings.to_boolean(L("yes")), formats.base64d(L("a"))):
        with pytest.raises(Exception):
            one(spark, column)
    for pattern in ("(?~x)", r"\g<1>"):
        with pytest.raises(ValueError):
            regex.translated(pattern)
    with pytest.raises(ValueError):
        regex.translated("a", "q")


def test_match(spark):
    found = one(spark, regex.match(L("😀foo bar foo"), r"(?<w>fo)(o)|(x)", "g"))
    assert [(m.offset, m.length, m.string) for m in found] == [(1, 3, "foo"), (9, 3, "foo")]
    assert [(c.offset, c.string, c.name) for c in found[0].captures] == [(1, "fo", "w"), (3, "o", None), (-1, None, None)]


def test_bessel(spark):
    assert abs(one(spark, maths.special("j0", L(1.0))) - 0.7651976865579666) < 1e-12
    assert abs(one(spark, maths.special("y0", L(1.0))) - 0.08825696421567698) < 1e-5
    assert abs(one(spark, maths.special("jn", L(2.0), L(3.0))) - 0.486091260585891) < 1e-12
