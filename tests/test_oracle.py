"""Every registered query with an oracle matches DuckDB on sf0.001; the others run."""
import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, SF).count() >= 0
        return
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "ticker" in df.columns


TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
              "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("stream_")))
def test_types_match(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    spark_types = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    rel = con.sql(SQL[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
