"""Plan shape: what the scale design relies on, asserted on the physical plans."""
from tidemark.plans.catalog import Ctx
from tidemark.plans import marts as M

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_daily_and_hourly_are_hash_aggregates(spark):
    c = Ctx(spark, SF)
    for df in (c.daily, c.hourly):
        p = _plan(df)
        assert "SortAggregate" not in p
        assert "HashAggregate" in p


def test_event_scan_is_pruned(spark):
    p = _plan(Ctx(spark, SF).daily)
    # only the event columns the fixture mapping needs are read (no event_type, no user_id)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double,props:string>" in p


def test_dimension_and_benchmark_joins_are_broadcast(spark):
    p = _plan(Ctx(spark, SF).daily)
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p


def test_signal_store_reuses_ticker_partitioning(spark):
    c = Ctx(spark, SF)
    daily_ex = _plan(c.daily).count("Exchange hashpartitioning")
    sig_ex = _plan(M.signal_feature_store(c.daily, "2024-02-01 00:00:00")).count("Exchange hashpartitioning")
    assert sig_ex == daily_ex          # risk/drawdown/severity windows add no shuffle


def test_no_python_in_core_marts(spark):
    c = Ctx(spark, SF)
    for df in (c.daily, c.hourly, M.market_regime_summary(c.daily)):
        p = _plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_materialized_build_matches_lazy_marts(spark, tmp_path):
    from tidemark.plans.materialize import build_marts
    c = Ctx(spark, SF)
    t = build_marts(spark, c.stg, c.sym, str(tmp_path / "marts"), "2024-02-01 00:00:00", raw=c.raw)
    assert "stock_signal_feature_store" in t
    stored = spark.read.parquet(str(tmp_path / "marts" / "stock_signal_feature_store"))
    lazy = M.signal_feature_store(c.daily, "2024-02-01 00:00:00")
    assert stored.exceptAll(lazy).count() == 0 and lazy.exceptAll(stored).count() == 0


def test_hot_ticker_is_absorbed_by_partial_aggregation(spark):
    from pyspark.sql import functions as F
    from tidemark.operators.staging import stage_stock_prices
    from tidemark.sources.fixtures import HOT_TICKER, load_stock_prices
    c = Ctx(spark, SF)
    stg = stage_stock_prices(load_stock_prices(spark, SF, hot_ticker=True))
    daily = M.daily_stock_summary(stg, c.sym)
    p = _plan(daily)
    assert "SortAggregate" not in p and "HashAggregate" in p
    counts = {r["ticker"]: r["n"] for r in daily.groupBy("ticker").agg(F.sum("event_count").alias("n")).collect()}
    assert counts[HOT_TICKER] >= sum(counts.values()) / 3          # the hot ticker really is hot
    # every open-session event is counted exactly once, whatever the skew
    open_events = stg.filter(F.col("market_session") != "closed").count()
    assert sum(counts.values()) == open_events
    assert daily.groupBy("ticker", "trade_date").count().filter("count > 1").count() == 0


def test_check_suites_read_the_events_once(spark):
    """One pass per table: no suite scans the event table more than twice, none sorts it to aggregate (two small
    marts of the daily grain pick names by a sort)."""
    from tidemark.plans.catalog import REGISTRY
    for name, sorts in (("dq_checks", 0), ("lineage", 0), ("mart_data_tests", 2), ("metrics_rollup", 0), ("request_log_metrics", 0)):
        p = _plan(REGISTRY[name](spark, SF))
        scans = sum("events.parquet" in line for line in p.splitlines() if line.startswith("Location"))
        assert scans <= 2, (name, scans)
        assert p.split("\n\n")[0].count("SortAggregate") <= sorts, name


def test_benchmark_join_follows_sizes_not_constants(spark):
    """Rows without a benchmark keep a key of their own, whatever join the planner takes."""
    p = _plan(Ctx(spark, SF).daily)
    assert "LeftSemi" in p and "coalesce(benchmark_ticker" in p
