"""Sinks write what they claim and can be read back (SNK-1…7)."""
from pyspark.sql import functions as F

from tidemark.operators.validation import dead_letters, split_valid, validate_events
from tidemark.sources import sinks as S
from tidemark.sources.fixtures import load_raw_messages

SF = "/root/testdata/sf0.001"


def test_sinks_roundtrip(spark, tmp_path):
    valid, invalid = split_valid(validate_events(load_raw_messages(spark, SF)))
    base = str(tmp_path)
    first = S.append_events(valid, f"{base}/events", spark).count()
    again = S.append_events(valid, f"{base}/events", spark).count()      # replay: nothing new
    assert first > 0 and again == 0
    assert spark.read.parquet(f"{base}/events").count() == first
    S.write_raw_lake(valid.select(*S.EVENT_COLUMNS), f"{base}/raw", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    assert spark.read.json(f"{base}/raw").filter(F.col("date") == "2024-02-01").count() == valid.count()
    dl = dead_letters(invalid)
    S.write_dead_letters(dl, f"{base}/dead")
    S.write_dead_letter_lake(dl, f"{base}/dead_lake")
    assert spark.read.parquet(f"{base}/dead").count() == invalid.count()
    assert spark.read.json(f"{base}/dead_lake").count() == invalid.count()
    msgs = S.publish_events(valid.select(*S.EVENT_COLUMNS).limit(5), f"{base}/topic")
    assert spark.read.text(f"{base}/topic").count() == 5 and msgs.count() == 5
    daily = spark.createDataFrame([("A", "2024-01-02", 1), ("A", "2024-01-03", 2)], "ticker string, trade_date string, v int")
    S.materialize(daily, f"{base}/mart")
    S.materialize(daily.filter("trade_date = '2024-01-03'").withColumn("v", F.lit(9)), f"{base}/mart")
    got = {str(r["trade_date"]): r["v"] for r in spark.read.parquet(f"{base}/mart").collect()}
    assert got == {"2024-01-02": 1, "2024-01-03": 9}                     # only the rewritten partition changed
    kept = S.prune_retention(dl, "created_at", 7, "2024-02-01 00:00:00")
    assert kept.filter(F.col("created_at") < F.lit("2024-01-25").cast("timestamp")).count() == 0


def test_retention_removes_rows(spark, tmp_path):
    path = str(tmp_path / "letters")
    rows = [(f"2024-01-{d:02d} 00:00:00", d) for d in range(1, 31)]
    spark.createDataFrame(rows, "t string, n int").selectExpr("cast(t as timestamp) created_at", "n").write.parquet(path)
    assert S.prune_table(spark, path, "created_at", 7, "2024-02-01 00:00:00") == 24
    assert {r["n"] for r in spark.read.parquet(path).collect()} == set(range(25, 31))
    assert S.prune_table(spark, path, "created_at", 7, "2024-02-01 00:00:00") == 0


def test_watchlist_rows_are_replaced_and_deleted(spark):
    from tidemark.operators.cache import delete_rows, upsert
    columns = "principal_id string, ticker string, price_alert_threshold double, updated_at timestamp"
    base = spark.createDataFrame([("p", "A", 1.0, None), ("p", "B", 2.0, None), ("q", "A", 3.0, None)], columns)
    changes = spark.createDataFrame([("p", "A", 5.0, None), ("q", "C", 6.0, None)], columns)
    keys = ["principal_id", "ticker"]
    out = upsert(base, changes, keys, ["price_alert_threshold"], "updated_at", "2024-02-01 00:00:00")
    got = {(r["principal_id"], r["ticker"]): (r["price_alert_threshold"], r["updated_at"] is not None) for r in out.collect()}
    assert got == {("p", "A"): (5.0, True), ("p", "B"): (2.0, False), ("q", "A"): (3.0, False), ("q", "C"): (6.0, True)}
    left = delete_rows(out, changes.where("ticker = 'C'"), keys)
    assert {(r["principal_id"], r["ticker"]) for r in left.collect()} == {("p", "A"), ("p", "B"), ("q", "A")}


def test_append_with_a_stored_target(spark, tmp_path):
    """Half of the events are stored already: exactly the other half is appended."""
    from tidemark.operators.validation import split_valid, validate_events
    from tidemark.sources.fixtures import load_raw_messages
    valid, _ = split_valid(validate_events(load_raw_messages(spark, "/root/testdata/sf0.001")))
    path = str(tmp_path / "events")
    half = valid.where("crc32(concat(ticker, event_time)) % 2 = 0")
    first, rest = S.append_events(half, path, spark).count(), S.append_events(valid, path, spark)
    stored = spark.read.parquet(path)
    assert first > 0 and rest.count() > 0 and stored.count() == first + rest.count()
    assert stored.groupBy(*S.IDENTITY).count().where("count > 1").count() == 0
    assert stored.count() == S.pending_events(valid, None).count()
