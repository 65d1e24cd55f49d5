"""Operators on streams: order, ties, nulls, plans, sources, sinks and state."""

import json

import pytest
from pyspark.sql import functions as F

from jsonloom.functions import objects
from jsonloom.operators import groups, joins, streams, updates
from jsonloom.plans.inspect import plan
from jsonloom.sources import readers, writers
from jsonloom.streaming import running


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_generators(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "id int, xs array<int>")
    assert rows(streams.each(df, "xs")) == [(1, 0, 5), (1, 1, 6)]
    assert rows(streams.comma(df.select("id"), [F.col("id"), F.col("id") * 10])) == [(1, 0, 1), (1, 1, 10), (2, 0, 2), (2, 1, 20), (3, 0, 3), (3, 1, 30)]
    assert rows(streams.ranges(df.select("id"), F.col("id") - 1.5)) == [(2, 0), (3, 0), (3, 1)]
    grown = streams.recurse(spark.createDataFrame([(2,)], "v int"), "v", lambda v: v * v, 5, lambda v: v < 20)
    assert rows(grown) == [(0, 2), (1, 4), (2, 16)]
    assert rows(streams.alternative(spark.createDataFrame([(1, None), (2, 7)], "k int, v int"), spark.createDataFrame([(1, 0), (2, 0)], "k int, v int"), ["k"], "v")) == [(1, 0), (2, 7)]


def test_limits(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, i int")
    assert rows(streams.limit(df, 1.2, ["i"], ["k"])) == [("a", 0), ("a", 1), ("b", 9)]
    assert rows(streams.skip(df, 1.2, ["i"], ["k"])) == [("a", 1), ("a", 2), ("a", 3), ("a", 4)]
    assert rows(streams.nth(df, 4, ["i"], ["k"])) == [("a", 4)]
    for call in (lambda: streams.limit(df, -1, ["i"]), lambda: streams.skip(df, -1, ["i"]), lambda: streams.nth(df, -1, ["i"])):
        with pytest.raises(ValueError):
            call()


def test_ties_and_nan(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 1, 1), ("k", 3, 2), ("k", 3, 3)], "k string, v int, i int")
    assert rows(groups.min_by(df, ["k"], "v", ["i"], F.col("i"))) == [("k", 0)]
    assert rows(groups.max_by(df, ["k"], "v", ["i"], F.col("i"))) == [("k", 3)]
    nan = spark.createDataFrame([(1, float("nan")), (2, float("nan")), (3, 1.0), (4, 1.0)], "i int, v double")
    assert sorted(r.n for r in groups.group_numbers(nan, "v", "i", n=F.count(F.lit(1))).collect()) == [1, 1, 2]
    assert rows(groups.added(df, ["k"], "v", ["i"])) == [("k", 8)]


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (None, "z", 2)], "k int, w string, i int")
    found = joins.join(left, joins.index(right, F.col("k"), ["i"], name="key"), F.col("k"))
    assert [(r.k, r.v, r.row.w if r.row else None) for r in found.orderBy("v").collect()] == [(1, "a", "y"), (2, "b", None), (None, "c", None)]
    assert rows(joins.is_in(left, right, "k")) == [(1, "a"), (None, "c")]
    assert rows(joins.not_in(left, right, "k")) == [(2, "b")]
    assert rows(joins.minus(left.unionByName(left), right.select("k", F.lit("a").alias("v")), ["k", "v"])) == [(2, "b"), (2, "b"), (None, "c"), (None, "c")]


def test_updates(spark):
    df = spark.createDataFrame([((1, [3, 4, 5]), "t")], "s struct<a:int,xs:array<int>>, t string")
    assert updates.update(df, ["s", "xs", "[]"], lambda x: x * 2, lambda x: x != 4).first().s.xs == [6, 10]
    assert updates.assign(df, ["s", "b"], F.col("t")).first().s.b == "t" if "b" in df.schema["s"].dataType.names else True
    assert updates.delete(df, ["s", "xs"], ["t"]).schema.simpleString() == "struct<s:struct<a:int>>"
    assert updates.pick(df, ["s", "a"]).schema.simpleString() == "struct<s:struct<a:int>>"
    assert objects.paths(df.schema, arrays=True) == [["s"], ["s", "a"], ["s", "xs"], ["s", "xs", "[]"], ["t"]]


def test_deep_merge_and_walk(spark):
    df = spark.createDataFrame([((1, (2, 3)), ((9, 8), 7))], "x struct<a:int,b:struct<c:int,d:int>>, y struct<b:struct<c:int,e:int>,f:int>")
    merged = df.select(objects.deep_merged(F.col("x"), F.col("y"), df.schema["x"].dataType, df.schema["y"].dataType).alias("m")).first().m
    assert merged.asDict(True) == {"a": 1, "b": {"c": 9, "d": 3, "e": 8}, "f": 7}
    walked = df.select(objects.walked(F.col("x"), df.schema["x"].dataType, lambda v, kind: v + 1 if kind.typeName() == "integer" else v).alias("w")).first().w
    assert walked.asDict(True) == {"a": 2, "b": {"c": 3, "d": 4}}


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    from jsonloom import catalog

    found = plan(catalog.QUERIES["select_and"](spark, sf))
    assert found.exchanges == 0 and found.python == 0
    assert "GreaterThan(l_quantity,45.0)" in found.pushed[0]
    assert "l_tax" not in found.read[0]
    assert plan(catalog.QUERIES["group_agg"](spark, sf)).exchanges == 1
    assert plan(catalog.QUERIES["sort_topk"](spark, sf)).count("TakeOrderedAndProject") == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "values.json").write_text('{"a":1} [2,\n3]\n"x"')
    assert [r.json for r in readers.json_values(spark, str(tmp_path / "values.json")).orderBy("at").collect()] == ['{"a":1}', "[2,3]", '"x"']
    (tmp_path / "lines.json").write_text('{"a":1,"b":"x"}\n\n{"b":"y"}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "lines.json"), "a int, b string")) == [(1, "x"), (None, "y")]
    assert readers.json_texts(spark, str(tmp_path / "lines.json")).count() == 2
    (tmp_path / "seq").write_text('\x1e{"a":1}\n\x1e[1,\x1e2\n')
    assert sorted(r.json for r in readers.sequence(spark, str(tmp_path / "seq")).collect()) == ["2", '{"a":1}']
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    writers.write_json(df, str(tmp_path / "out"))
    assert sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda r: r["a"]) == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    writers.write_raw(df.where("a = 2"), F.col("b"), str(tmp_path / "raw"), "\0")
    assert [r.value for r in spark.read.text(str(tmp_path / "raw"), lineSep="\0").collect()] == ["x"]
    writers.write_sequence(df, str(tmp_path / "rs"))
    assert readers.sequence(spark, str(tmp_path / "rs")).count() == 2
    assert readers.slurped(readers.json_texts(spark, str(tmp_path / "lines.json"))).count() == 1
    assert [r.event for r in readers.events(spark.createDataFrame([("[1]",)], "json string")).orderBy("at").collect()] == ["[[0],1]", "[[0]]"]


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("".join(json.dumps({"k": "a", "i": i, "v": i}) + "\n" for i in (2, 1, 3)))
    events = running.inputs(spark, str(folder), "k string, i int, v double")
    made = running.foreach(events, "k", "i", "v", 0.0, lambda s, v: s + v)
    made.writeStream.format("memory").queryName("foreach_test").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert rows(spark.table("foreach_test").select("i", "state")) == [(1, 1.0), (2, 3.0), (3, 6.0)]
    running.reduce(events, ["k"], total=F.sum("v")).writeStream.format("memory").queryName("reduce_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start().awaitTermination(120)
    assert rows(spark.table("reduce_test")) == [("a", 6.0)]
