"""Helpers the scale design relies on: size-checked broadcast, literal frames, cluster settings,
reading what exists, exact rounding and event order."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.joins import broadcast_if_small, estimated_bytes
from tidemark.functions.numeric import event_order_key, round_ratio_half_up
from tidemark.session import cluster_conf
from tidemark.sources.tables import literal_frame, read_if_exists, read_table


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_broadcast_only_when_estimate_is_small(spark):
    small = literal_frame(spark, [("a", 1)], T.StructType([T.StructField("k", T.StringType()),
                                                          T.StructField("v", T.IntegerType())]))
    big = read_table(spark, "/root/testdata/sf0.01", "lineitem")
    assert estimated_bytes(small) < 10_000
    assert "ResolvedHint" in small.join(broadcast_if_small(small), "k")._jdf.queryExecution().analyzed().toString() \
        or "broadcast" in broadcast_if_small(small)._jdf.queryExecution().analyzed().toString().lower()
    hinted = broadcast_if_small(big, max_bytes=1024)
    assert "broadcast" not in hinted._jdf.queryExecution().analyzed().toString().lower()


def test_literal_frame_roundtrip(spark):
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("a", T.ArrayType(T.StringType())),
                           T.StructField("b", T.BooleanType()), T.StructField("n", T.StringType())])
    rows = [("it's \\ fine", ["x", "y'z"], True, None)]
    got = literal_frame(spark, rows, schema).collect()[0]
    assert (got["s"], got["a"], got["b"], got["n"]) == rows[0]
    assert "LocalRelation" in literal_frame(spark, rows, schema)._jdf.queryExecution().optimizedPlan().toString()


def test_cluster_conf_scales_with_cores():
    c = cluster_conf(1000, 4)
    assert int(c["spark.sql.shuffle.partitions"]) == 12000
    assert c["spark.sql.adaptive.enabled"] == "true" and c["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_only_a_missing_table_counts_as_empty(spark, tmp_path):
    path = str(tmp_path / "table")
    assert read_if_exists(spark, path) is None
    spark.range(3).write.parquet(path)
    assert read_if_exists(spark, path).count() == 3
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        read_if_exists(spark, str(broken)).count()


def test_order_key_follows_time_for_ids_of_both_signs(spark):
    ids = [-2 ** 63, -1, 0, 1, 2 ** 63 - 1]
    rows = [(f"2024-01-02 03:04:05.{us:06d}", i) for us in (0, 1, 2) for i in ids]
    df = spark.createDataFrame(rows, "ts string, id long").withColumn("event_time", F.to_timestamp("ts"))
    got = [(r["ts"], r["id"]) for r in df.orderBy(event_order_key()).collect()]
    assert got == sorted(rows)


def test_exact_half_away_from_zero(spark):
    df = spark.createDataFrame([(5, 2), (-5, 2), (1, 3), (2, 3), (-1, 8)], "p long, q long")
    got = [r[0] for r in df.select(round_ratio_half_up(F.col("p"), F.col("q"), 0)).collect()]
    assert got == [Decimal(3), Decimal(-3), Decimal(0), Decimal(1), Decimal(0)]
    got2 = [r[0] for r in df.select(round_ratio_half_up(F.col("p"), F.col("q"), 2)).collect()]
    assert got2 == [Decimal("2.50"), Decimal("-2.50"), Decimal("0.33"), Decimal("0.67"), Decimal("-0.13")]
