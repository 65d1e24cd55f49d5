"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from jsonloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 6) + 0.0)
    return repr(value)


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalog.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    want = sorted(tuple(shown(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_math_bits_odd_numbers(spark, tmp_path):
    values = [0.0, -0.0, 0.5, -0.5, 0.01, -0.01, 1.5, 8.0, -8191.99, 5e-324, float("inf"), float("-inf"), float("nan"), None]
    spark.createDataFrame(list(enumerate(values)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["math_bits"](spark, str(tmp_path)).collect()
    cursor = duckdb.connect()
    cursor.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    cursor.execute(catalog.ORACLES["math_bits"])
    columns = [d[0] for d in cursor.description]
    # signs of zero count, but not those that rounding leaves
    exact = lambda row: [repr(v) if c != "rest" else shown(v) for c, v in zip(columns, row, strict=True)]
    assert sorted(exact([r[c] for c in columns]) for r in got) == sorted(exact(row) for row in cursor.fetchall())
