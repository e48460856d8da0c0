"""Streaming = batch, and replaying the same input appends nothing (STR-4)."""
import tempfile

from tidemark.sources.fixtures import raw_messages_from_events
from tidemark.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def _stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def test_ingest_replay_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="tm-stream-")
    q = S.ingest_stream(raw_messages_from_events(_stream(spark)), f"{base}/events", f"{base}/dead", f"{base}/ck1")
    q.awaitTermination()
    n1 = spark.read.parquet(f"{base}/events").count()
    # a second consumer with a fresh checkpoint replays everything from the start
    q = S.ingest_stream(raw_messages_from_events(_stream(spark)), f"{base}/events", f"{base}/dead", f"{base}/ck2")
    q.awaitTermination()
    assert spark.read.parquet(f"{base}/events").count() == n1
    assert spark.read.parquet(f"{base}/dead").count() > 0


def test_refresh_marts_equals_batch(spark):
    """Two micro-batch runs (even events first, then everything, i.e. late events and a replayed
    overlap): the incrementally refreshed mart equals the batch mart over the stored events."""
    from pyspark.sql import functions as F
    from tidemark.operators.staging import stage_stock_prices, stage_symbol_reference
    from tidemark.plans.marts import daily_stock_summary
    from tidemark.sources.symbols import symbol_reference
    base = tempfile.mkdtemp(prefix="tm-refresh-")
    sym = stage_symbol_reference(symbol_reference(spark))
    first = _stream(spark).filter(F.pmod("event_id", F.lit(2)) == 0)
    for i, src in enumerate([first, _stream(spark)]):
        q = S.refresh_marts_stream(raw_messages_from_events(src), f"{base}/events", f"{base}/dead",
                                   f"{base}/daily", sym, f"{base}/ck{i}")
        q.awaitTermination()
    streamed = spark.read.parquet(f"{base}/daily").drop("block", "ticker_bucket")
    stored = spark.read.parquet(f"{base}/events")
    batch = daily_stock_summary(stage_stock_prices(stored), sym)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_lake_stream_and_replay_then_stream(spark):
    from pyspark.sql import functions as F
    from tidemark.sources.fixtures import load_bars
    base = tempfile.mkdtemp(prefix="tm-lake-")
    q = S.lake_stream(raw_messages_from_events(_stream(spark)), f"{base}/raw", f"{base}/invalid", f"{base}/ck")
    q.awaitTermination()
    raw = spark.read.json(f"{base}/raw")
    assert raw.count() > 0 and {"date", "ticker"} <= set(raw.columns)          # date=/ticker= partitions
    assert spark.read.json(f"{base}/invalid").filter(F.col("validation_error").isNotNull()).count() > 0
    # STR-6: history first, then the live stream; the overlap is harmless
    base2 = tempfile.mkdtemp(prefix="tm-replay-")
    q = S.replay_then_stream(load_bars(spark, SF), "2024-02-01 00:00:00", raw_messages_from_events(_stream(spark)),
                             f"{base2}/events", f"{base2}/dead", f"{base2}/ck")
    q.awaitTermination()
    ev = spark.read.parquet(f"{base2}/events")
    assert ev.filter(F.col("event_kind") == "historical_bar").count() > 0
    assert ev.filter(F.col("event_kind") == "live_snapshot").count() > 0
    assert ev.groupBy("ticker", "event_time", "source", "event_kind", "bar_interval").count() \
        .filter("count > 1").count() == 0


def test_refresh_with_alerts(spark):
    from tidemark.operators.staging import stage_symbol_reference
    from tidemark.sources.fixtures import load_watchlists
    from tidemark.sources.symbols import symbol_reference
    base = tempfile.mkdtemp(prefix="tm-alerts-")
    sym = stage_symbol_reference(symbol_reference(spark))
    q = S.refresh_marts_stream(raw_messages_from_events(_stream(spark)), f"{base}/events", f"{base}/dead",
                               f"{base}/daily", sym, f"{base}/ck", alerts_path=f"{base}/alerts",
                               watch=load_watchlists(spark, SF))
    q.awaitTermination()
    alerts = spark.read.parquet(f"{base}/alerts")
    assert alerts.count() > 0 and "triggered_price_alert" in alerts.columns


def test_refresh_dependent_marts_equal_batch(spark):
    """Two runs (even events, then all): every incrementally maintained mart equals the batch mart."""
    from pyspark.sql import functions as F
    from tidemark.operators.staging import stage_stock_prices, stage_symbol_reference
    from tidemark.plans import marts as M
    from tidemark.sources.symbols import symbol_reference
    base = tempfile.mkdtemp(prefix="tm-marts-")
    sym = stage_symbol_reference(symbol_reference(spark))
    as_of = "2024-02-01 00:00:00"
    first = _stream(spark).filter(F.pmod("event_id", F.lit(2)) == 0)
    for i, src in enumerate([first, _stream(spark)]):
        q = S.refresh_marts_stream(raw_messages_from_events(src), f"{base}/events", f"{base}/dead",
                                   f"{base}/daily", sym, f"{base}/ck{i}", marts_dir=f"{base}/marts", as_of=as_of)
        q.awaitTermination()
    daily = M.daily_stock_summary(stage_stock_prices(spark.read.parquet(f"{base}/events")), sym)
    stg = stage_stock_prices(spark.read.parquet(f"{base}/events"))
    expected = {
        "intraday_stock_rollup": M.intraday_stock_rollup(stg, sym),
        "stock_risk_indicators": M.stock_risk_indicators(daily),
        "stock_drawdown_recovery": M.stock_drawdown_recovery(daily),
        "stock_anomaly_history": M.stock_anomaly_history(daily),
        "stock_signal_feature_store": M.signal_feature_store(daily, as_of),
        "sector_daily_summary": M.sector_daily_summary(daily),
        "benchmark_relative_strength": M.benchmark_relative_strength(daily),
        "market_regime_summary": M.market_regime_summary(daily),
    }
    for name, want in expected.items():
        got = spark.read.parquet(f"{base}/marts/{name}").drop("ticker_bucket")
        got = got.select(*want.columns)
        assert got.count() == want.count(), name
        assert got.exceptAll(want).count() == 0, name


def test_nothing_is_lost_or_stored_twice(spark, tmp_path):
    """Rejected messages and alerts: a replay adds none, and no cap holds any back; an unreadable table raises."""
    import pytest
    from pyspark.sql import functions as F
    from tidemark.plans.queries import watchlist_alerts
    from tidemark.sources.fixtures import load_raw_messages
    base = str(tmp_path)
    batch = load_raw_messages(spark, SF)
    one = S.ingest_batch(batch, 0, f"{base}/events", f"{base}/dead", counters_path=f"{base}/counters")
    two = S.ingest_batch(batch, 1, f"{base}/events", f"{base}/dead", counters_path=f"{base}/counters")
    assert one["events_persisted"] > 0 and one["dead_letter_written"] == one["invalid_event"] > 0
    assert two["events_persisted"] == 0 and two["dead_letter_written"] == 0
    assert spark.read.parquet(f"{base}/dead").count() == one["invalid_event"]
    stored = {(r["batch_id"], r["metric_name"]): r["value"] for r in spark.read.parquet(f"{base}/counters").collect()}
    assert stored[(0, "pipeline.invalid_event")] == one["invalid_event"] and (1, "pipeline.last_offset") in stored

    sym = spark.createDataFrame([("T", "c", "s", None, None)],
                                "ticker string, company_name string, sector string, benchmark_ticker string, benchmark_name string")
    watch = spark.createDataFrame([(f"p{i}", "T", 1.0, 9.0) for i in range(3)],
                                  "principal_id string, ticker string, price_alert_threshold double, volume_alert_threshold double")
    daily = spark.range(200).select(F.lit("T").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
                                    .alias("trade_date"), F.lit(1.0).alias("close_price"), F.lit(2.0).alias("relative_price_change_pct"),
                                    F.lit(2.0).alias("price_change_pct"), F.lit(1.0).alias("volume_vs_avg_ratio"),
                                    F.lit("normal").alias("anomaly_flag"))
    assert S.alerts_for_batch(daily, watch, sym).count() == 600
    top = watchlist_alerts(watch, daily, sym, None, 50)
    assert {r["count"] for r in top.groupBy("principal_id").count().collect()} == {50}

    broken = tmp_path / "daily"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"unreadable")
    touched = spark.createDataFrame([("T", None)], "ticker string, trade_date date").where("trade_date IS NULL").limit(0)
    with pytest.raises(Exception):
        S.refresh_marts_batch(spark, touched, f"{base}/events", sym, str(broken), f"{base}/staging")
    assert (broken / "part-0.parquet").read_bytes() == b"unreadable"


def test_backfill_sets_rejected_bars_aside(spark, tmp_path):
    from tidemark.sources.fixtures import load_bars
    from tidemark.sources.ingest import backfill
    events, dead = str(tmp_path / "events"), str(tmp_path / "dead")
    for _ in range(2):
        counts = backfill(load_bars(spark, SF), "2024-02-01 00:00:00", target_path=events, dead_letter_path=dead).collect()
    rejected = sum(r["dead_letter_count"] for r in counts)
    assert rejected > 0 and spark.read.parquet(dead).count() == rejected
