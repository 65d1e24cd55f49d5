"""Queries of the training-data operators that SQL can express give what DuckDB gives."""

import os

import duckdb
import pytest

from jsonloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_no_import_from_outside():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "jsonloom")):
        if not folder.endswith("llm") and "__pycache__" not in folder:
            for n in names:
                assert "llm" not in open(os.path.join(folder, n), encoding="utf-8").read(), n
