"""SRC-6: declared source tables (parquet) with explicit schema contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Columns of a validated event, in order.
EVENT_COLUMNS = ["ticker", "price", "volume", "event_time", "source", "open_price", "high_price", "low_price",
                 "close_price", "event_kind", "bar_interval", "market_session"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one driver table; selecting ``columns`` right away keeps the parquet scan narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing has been written yet.

    Existence is asked of the file system; a table that is there but cannot be read raises.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    files = fs.listFiles(place, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return spark.read.parquet(path)
    return None


def assert_schema(df: DataFrame, contract: T.StructType | list[str], check_types: bool = True) -> DataFrame:
    """Fail fast when a frame's columns (and types) differ from its contract."""
    if isinstance(contract, T.StructType):
        want = [(f.name, f.dataType) for f in contract.fields]
        have = [(f.name, f.dataType) for f in df.schema.fields]
        if not check_types:
            want = [(n, None) for n, _ in want]
            have = [(n, None) for n, _ in have]
    else:
        want = list(contract)
        have = df.columns
    if want != have:
        raise AssertionError(f"schema mismatch:\n want {want}\n have {have}")
    return df


def _sql_literal(v, dt: T.DataType) -> str:
    if v is None:
        return f"CAST(NULL AS {dt.simpleString()})"
    if isinstance(dt, T.ArrayType):
        inner = ", ".join(_sql_literal(x, dt.elementType) for x in v)
        return f"CAST(array({inner}) AS {dt.simpleString()})"
    if isinstance(dt, T.StringType):
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(dt, T.BooleanType):
        return "true" if v else "false"
    return f"CAST({v!r} AS {dt.simpleString()})"


def literal_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small fixed table as an inline ``VALUES`` relation. Catalyst turns it into a
    LocalRelation: exact size statistics (so the optimiser and ``broadcast_if_small`` know it is
    tiny) and no generated code, unlike ``createDataFrame`` from Python rows (an RDD without
    statistics)."""
    values = ", ".join("(" + ", ".join(_sql_literal(v, f.dataType) for v, f in zip(r, schema.fields)) + ")"
                       for r in rows)
    names = ", ".join(f.name for f in schema.fields)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[df[f.name] if have[f.name] == f.dataType.simpleString() else df[f.name].cast(f.dataType)
                       .alias(f.name) for f in schema.fields])
