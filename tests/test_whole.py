"""Queries over whole tables, with values that the test data lack."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_queries import SF, TABLES

from jsonloom import catalog
from jsonloom.functions import dynamic, errors, formats, maths, regex, times
from jsonloom.operators import groups, streams


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def of_sql(duck, sql, columns):
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    return [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]


def test_recurse_until_none_is_alive(spark):
    df = spark.createDataFrame([("a", 0), ("b", 39), ("c", 100), ("d", None)], "k string, v int")
    got = sorted(map(tuple, streams.recurse(df, "v", lambda v: v + 1, while_=lambda v: v < 40).collect()), key=repr)
    assert got == sorted([*[("a", i, i) for i in range(40)], ("b", 0, 39), ("c", 0, 100), ("d", 0, None)], key=repr)


def test_recurse_double(spark, duck):
    columns = ["p_partkey", "level", "value"]
    got = sorted(tuple(r) for r in catalog.QUERIES["recurse_double"](spark, SF).select(columns).collect())
    whole = "WITH RECURSIVE r AS (SELECT p_partkey, 0 AS level, CAST(p_size AS BIGINT) AS value FROM part UNION ALL SELECT p_partkey, level + 1, value * 2 FROM r WHERE value * 2 < 50) SELECT * FROM r"
    assert got == sorted(of_sql(duck, whole, columns))


def test_total_order_sort(spark, duck):
    columns = ["event_id", "kind", "place"]
    found = catalog.QUERIES["total_order_sort"](spark, SF)
    whole = """SELECT event_id, kind, row_number() OVER (ORDER BY kind, CASE WHEN kind = 3 THEN value END NULLS FIRST, CASE WHEN kind = 4 THEN event_type END NULLS FIRST, event_id) AS place
     FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END AS kind FROM events)"""
    assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(of_sql(duck, whole, columns))


def test_placed(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert groups.placed(df, "v").select(F.spark_partition_id()).distinct().count() > 1
        assert sorted(map(tuple, groups.placed(df, "v").collect())) == [(i, i + 1) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, groups.placed(df, "v").collect())) == [(i, i + 1) for i in range(5000)]
    assert groups.placed(df.where("v < 0"), "v").count() == 0


def same_size(got, want):
    return got == want or (got is not None and want is not None and math.isclose(got, want, rel_tol=1e-9, abs_tol=6e-5)) or repr(got) == repr(want)


def sized(g):
    """Large values as their logarithm, as math_special gives them."""
    return g if g is None or abs(g) < 1e6 else math.log(abs(g))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A table of events with values beyond those of the test data: (folder, values by event_id)."""
    values = [0.0, 12.5, 80.0, 80.5, 327.53, 500.5, 560.21, 1650.0, 1690.0, 1720.0, 9000.0, -0.5, -1.0, -7.25, -10.0, -25.0, -30.0, None]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(f"{folder}/events.parquet")
    return folder, dict(enumerate(values))


def test_math_special(spark, duck, wide):
    columns = ["event_id", "g", "l"]
    got = {r.event_id: (r.g, r.l) for r in catalog.QUERIES["math_special"](spark, SF).collect()}
    want = of_sql(duck, "SELECT event_id, gamma(value / 10 + 1) AS g, lgamma(value / 10 + 1) AS l FROM events", columns)
    assert len(got) == len(want) and all(same_size(got[i][0], sized(g)) and same_size(got[i][1], x) for i, g, x in want)
    found = {r.event_id: (r.g, r.l) for r in catalog.QUERIES["math_special"](spark, wide[0]).collect()}
    for i, v in wide[1].items():
        if v is None:
            assert found[i] == (None, None)
        elif v < -10 and v % 10 == 0:  # the poles below zero
            assert math.isnan(found[i][0]) and found[i][1] == math.inf
        else:
            x = v / 10 + 1
            g = math.inf if x == 0 or x > 171.6 else math.gamma(x)
            assert same_size(found[i][0], sized(g))
            assert same_size(found[i][1], math.inf if x == 0 else math.lgamma(x))


def test_math_unary(spark, duck, wide):
    names = ["e", "l", "l10", "l2", "s", "c", "a", "sh", "th"]
    of = [lambda v: math.exp(v / 100), lambda v: math.log(v + 1), lambda v: math.log10(v + 1), lambda v: math.log2(v + 1), math.sin, math.cos, math.atan, lambda v: math.sinh(v / 100), lambda v: math.tanh(v / 100)]
    found = {r.event_id: r for r in catalog.QUERIES["math_unary"](spark, wide[0]).collect()}
    assert len(found) == len(wide[1])
    for i, v in wide[1].items():
        for name, f in zip(names, of, strict=True):
            if v is None:
                assert found[i][name] is None
            elif name[0] == "l" and v <= -1:
                assert found[i][name] == -math.inf if v == -1 else math.isnan(found[i][name])
            else:
                assert same_size(found[i][name], f(v))


def test_lgamma_r_while_until(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", -0.5), ("c", -1.5), ("d", -2.0), ("e", None)], "k string, v double")
    got = {r.k: r.x for r in df.select("k", maths.lgamma_r(F.col("v")).alias("x")).collect()}
    assert got == {"a": [math.lgamma(3), 1.0], "b": [math.lgamma(-0.5), -1.0], "c": [math.lgamma(-1.5), 1.0], "d": [math.inf, 1.0], "e": None}
    df = spark.createDataFrame([("a", 1), ("b", 70), ("c", 200)], "k string, v int")
    grown = streams.while_(df, "v", lambda v: v < 100, lambda v: v * 3)
    assert sorted((r.k, r.v) for r in grown.collect()) == [*[("a", 3**i) for i in range(5)], ("b", 70)]
    assert sorted(map(tuple, streams.until(df, "v", lambda v: v >= 100, lambda v: v + 1).collect())) == [("a", 100), ("b", 100), ("c", 200)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_in_any_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        s = [0, 1425599507, -86399, 1236495600, 1710055800]  # the last two in a gap of New York's clocks
        df = spark.createDataFrame([(x,) for x in s], "s long")
        got = df.select("s", times.todate(F.col("s")).alias("d"), times.fromdate(times.todate(F.col("s"))).alias("b"), times.strftime(F.col("s"), "%a %e %B %H:%M:%S %-d").alias("t"), times.seconds(F.lit("2024-03-10 02:30:00").cast("timestamp_ntz")).alias("n")).collect()
        for r in got:
            t = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=r.s)
            assert (r.d, r.b, r.n) == (t.strftime("%Y-%m-%dT%H:%M:%SZ"), r.s, 1710037800)
            assert r.t == t.strftime("%a %e %B %H:%M:%S ") + str(t.day)
        text = "Thursday, March 05, 2015 23:51:47 +0200 x"
        assert df.limit(1).select(times.strptime(F.lit(text), "%A, %B %d, %Y %H:%M:%S %z x").alias("b")).first().b == [2015, 2, 5, 23, 51, 47, 4, 63]
        assert df.limit(1).select(times.strptime(F.lit("1425599507"), "%s").alias("b")).first().b[:3] == [2015, 2, 5]
        with pytest.raises(Exception, match="date does not match"):
            df.select(times.strptime(F.lit("no"), "%Y")).collect()
        with pytest.raises(Exception, match="invalid gmtime"):
            df.select(times.mktime(times.gmtime(F.lit(-1)))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_regex_groups_and_classes(spark):
    df = spark.createDataFrame([("xyz",), ("a",), ("",)], "s string")
    assert [m.string for m in df.select(regex.match(F.lit("xyz 12"), "[[:alpha:]]+", "g").alias("m")).first().m] == ["xyz"]
    assert df.select(regex.match(F.lit("zfaz"), r"\h+").alias("m")).first().m[0].string == "fa"
    c = df.select("s", regex.capture(F.col("s"), "(?<x>x)?(?<y>a)?").alias("c")).collect()
    assert [tuple(r.c) for r in c] == [("x", None), (None, "a"), (None, None)]
    assert [tuple(x) for x in df.select(regex.capture(F.lit("a1b2"), "(?<l>[a-z])(?<d>[0-9])", "g").alias("c")).first().c] == [("a", "1"), ("b", "2")]


def test_bessel_everywhere(spark):
    x = [1e-9, 1e-3, 0.5, 3.0, 17.2, 59.9, 60.1, 250.0, 1e6]
    df = spark.createDataFrame([(v,) for v in [*x, 0.0, -2.0, math.inf, None]], "x double")
    names = ["j0", "j1", "y0", "y1"]
    got = {r.x: r for r in df.select("x", *[maths.special(n, F.col("x")).alias(n) for n in names], maths.special("yn", F.lit(3.0), F.col("x")).alias("y3"), maths.special("jn", F.lit(-3.0), F.col("x")).alias("j3")).collect()}
    for v in x:
        r = got[v]  # the Wronskian of both kinds
        assert math.isclose((r.j1 * r.y0 - r.j0 * r.y1) * math.pi * v / 2, 1, rel_tol=1e-9)
    assert math.isclose(got[3.0].y3, -0.5385416161050318, rel_tol=1e-12) and math.isclose(got[3.0].j3, -0.30906272225525164, rel_tol=1e-12)
    assert tuple(got[0.0])[1:] == (1.0, 0.0, -math.inf, -math.inf, -math.inf, 0.0)
    assert math.isclose(got[-2.0].j1, -0.5767248077568734, rel_tol=1e-12) and math.isnan(got[-2.0].y0)
    assert (got[math.inf].j0, got[math.inf].y1) == (0, 0) and tuple(got[None])[1:] == (None,) * 6


def test_paths_and_patterns(spark):
    j = '{"a":[1,{"b":null}],"c":"x"}'
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(dynamic.path(F.lit(j), ["a", dynamic.EACH])) == ['["a",0]', '["a",1]']
    assert one(dynamic.path(F.lit(j), ["z", "y"])) == ['["z","y"]']
    assert one(dynamic.path(F.lit(j), [dynamic.DEEP], lambda v: isinstance(v, (int, str)))) == ['["a",0]', '["c"]']
    assert one(dynamic.path(F.lit("null"), [])) == ["[]"]
    assert one(dynamic.paths_where(F.lit(j), lambda v: v is None)) == ['["a",1,"b"]']
    for steps in (["c", "d"], ["c", 0], ["z", dynamic.EACH]):
        with pytest.raises(Exception, match="Cannot"):
            one(dynamic.path(F.lit(j), steps))
    assert one(dynamic.destructured(F.lit("[1,[2]]"), ["a", ["b", "c"]])).asDict() == {"a": "1", "b": "2", "c": "null"}
    assert one(dynamic.destructured(F.lit("[[3]]"), [["a"]], ["a", "b"])).asDict() == {"a": "3", "b": "null"}
    assert one(dynamic.destructured(F.lit("[3]"), {"k": "a"}, [["b"]], ["c"])).asDict() == {"a": "null", "b": "null", "c": "3"}
    assert one(dynamic.destructured(F.lit("null"), {"k": ["a"]})).asDict() == {"a": "null"}
    with pytest.raises(Exception, match="Cannot index number"):
        one(dynamic.destructured(F.lit("3"), {"k": "a"}, ["b"]))


def test_replaced_and_base64(spark):
    df = spark.createDataFrame([("😀foo bar",), ("",), ("zz",), (None,)], "s string")
    f = lambda c: F.concat(F.lit("<"), F.upper(F.coalesce(c["v"], F.lit("-"))), F.lit(">"))
    got = {r.s: (r.a, r.b) for r in df.select("s", regex.replaced(F.col("s"), "[b-df-hj-np-tv-z](?<v>[aeiou])?", f, "g").alias("a"), regex.replaced(F.col("s"), "(?<v>[a-z])", f).alias("b")).collect()}
    assert got["😀foo bar"] == ("😀<O>o <A><->", "😀<F>oo bar") and got["zz"] == ("<-><->", "<Z>z") and got[""] == ("", "") and got[None] == (None, None)
    for text, want in (("YQ", "a"), ("YWI=", "ab"), ("", ""), ("=", ""), ("/w==", "\ufffd"), ("4pi6", "☺")):
        assert df.limit(1).select(formats.base64d(F.lit(text)).alias("x")).first().x == want
    for text in ("Not base64 data", "YWJjZ", "a", "YWJj ZGVm", "YW JjYQ", "YWJ\n", "é234", " "):
        with pytest.raises(Exception, match="is not valid base64 data"):
            df.limit(1).select(formats.base64d(F.lit(text)).alias("x")).collect()


def test_number_selectors_and_debug(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.5, 5e-324, math.inf, math.nan, None]], "x double")
    seen = Observation("seen")
    rows = errors.debug(df, seen, F.count("x").alias("n"), F.max("x").alias("most"))
    got = rows.select(errors.finites(F.col("x")).alias("f"), errors.normals(F.col("x")).alias("n")).collect()
    assert [r.f for r in got] == [0.0, 1.5, 5e-324, None, None, None] and [r.n for r in got] == [None, 1.5, None, None, None, None]
    assert seen.get["n"] == 5


def test_numbers_of_json_text(spark):
    df = spark.createDataFrame([("[1e2,1.10,1e400,-1e400,NaN,1.5,100000000000000000000]",)], "j string")
    assert df.select(dynamic.flatten(F.col("j")).alias("x")).first().x == "[100,1.1,1.7976931348623157e+308,-1.7976931348623157e+308,null,1.5,100000000000000000000]"
