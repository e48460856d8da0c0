"""Hand-made rows for labels and edge cases (FIXTURES.md §3)."""
import datetime as dt
from decimal import Decimal


from tidemark.operators.staging import stage_stock_prices, stage_symbol_reference
from tidemark.plans import marts as M
from tidemark.sources.symbols import symbol_reference

COLS = ("id bigint, ticker string, price decimal(10,2), volume bigint, event_time timestamp, source string, "
        "open_price decimal(10,2), high_price decimal(10,2), low_price decimal(10,2), close_price decimal(10,2), "
        "event_kind string, bar_interval string, market_session string, inserted_at timestamp")


def _events(spark, rows):
    """rows: (ticker, day, price, volume[, hour, id]) on trading days in January 2024."""
    out = []
    for i, r in enumerate(rows):
        ticker, day, price, volume = r[:4]
        hour = r[4] if len(r) > 4 else 15
        ident = r[5] if len(r) > 5 else i
        ts = dt.datetime(2024, 1, day, hour, 0, 0)
        out.append((ident, ticker, Decimal(str(price)), volume, ts, "t", None, None, None, None, "live_snapshot",
                    "snapshot", "regular", ts))
    return stage_stock_prices(spark.createDataFrame(out, COLS))


def _sym(spark):
    return stage_symbol_reference(symbol_reference(spark))


DAYS = [2, 3, 4, 5, 8, 9, 10, 11, 12]


def test_drawdown_equal_peaks(spark):
    closes = [100, 110, 110, 80, 110, 120, 90]
    ev = _events(spark, [("ZZQ", d, c, 100) for d, c in zip(DAYS, closes)])
    dd = M.stock_drawdown_recovery(M.daily_stock_summary(ev, _sym(spark))).orderBy("trade_date").collect()
    assert [float(r["drawdown_pct"]) for r in dd] == [0, 0, 0, -27.27, 0, 0, -25]
    # equal peaks move the peak date forward: 110 on day 3 then again on day 4 and day 8
    assert [r["days_since_peak"] for r in dd] == [0, 0, 0, 1, 0, 0, 1]
    assert [r["recovery_status"] for r in dd] == ["recovered"] * 3 + ["deep_drawdown", "recovered", "recovered",
                                                                    "deep_drawdown"]


def test_first_day_and_volume_ratio(spark):
    ev = _events(spark, [("ZZQ", d, 100, v) for d, v in zip(DAYS, [100, 100, 100, 200])])
    daily = M.daily_stock_summary(ev, _sym(spark))
    rows = daily.orderBy("trade_date").collect()
    assert float(rows[0]["price_change_pct"]) == 0 and float(rows[0]["volume_vs_avg_ratio"]) == 1
    assert float(rows[3]["volume_vs_avg_ratio"]) == 2
    risk = M.stock_risk_indicators(daily).orderBy("trade_date").collect()
    assert float(risk[0]["rolling_volatility_7d"]) == 0 and risk[0]["sharpe_like_ratio_7d"] is None
    assert rows[0]["company_name"] is None and rows[0]["sector"] == "Other"       # Q7: unknown ticker


def test_benchmark_missing_and_relative(spark):
    # AAPL has benchmark XLK; XLK trades only on day 3 → relative = own change elsewhere
    ev = _events(spark, [("AAPL", 2, 100, 10), ("AAPL", 3, 110, 10), ("AAPL", 4, 121, 10),
                         ("XLK", 2, 50, 10), ("XLK", 3, 51, 10)])
    rows = {(r["ticker"], r["trade_date"].day): r for r in M.daily_stock_summary(ev, _sym(spark)).collect()}
    a3, a4 = rows[("AAPL", 3)], rows[("AAPL", 4)]
    assert float(a3["benchmark_price_change_pct"]) == 2.0
    assert float(a3["relative_price_change_pct"]) == 8.0
    assert a4["benchmark_price_change_pct"] is None
    assert float(a4["relative_price_change_pct"]) == float(a4["price_change_pct"]) == 10.0   # Q4
    assert a4["anomaly_flag"] == "price_move"


def test_open_close_tie_break(spark):
    ev = _events(spark, [("ZZQ", 2, 10, 1, 15, 7), ("ZZQ", 2, 20, 1, 15, 3)])
    r = M.daily_stock_summary(ev, _sym(spark)).collect()[0]
    assert float(r["open_price"]) == 20 and float(r["close_price"]) == 10      # id 3 opens, id 7 closes
    assert float(r["avg_price"]) == 15


def test_regime_fanout_and_dedupe(spark):
    # three tickers on one date, two benchmarks (XLK, XLC) → Q3 doubles the counts
    ev = _events(spark, [("AAPL", 2, 100, 10), ("MSFT", 2, 100, 10), ("GOOGL", 2, 100, 10)])
    daily = M.daily_stock_summary(ev, _sym(spark))
    fan = M.market_regime_summary(daily).collect()[0]
    ded = M.market_regime_summary(daily, dedupe_leaders=True).collect()[0]
    assert fan["ticker_count"] == 6 and ded["ticker_count"] == 3
    assert fan["benchmark_leader"] == ded["benchmark_leader"] == "XLK"
    assert fan["avg_volume_ratio"] == ded["avg_volume_ratio"]


def test_signal_store_matches_marts(spark):
    closes = [100, 104, 97, 110, 111, 90, 95, 99, 130]
    ev = _events(spark, [("NVDA", d, c, 100 * (i + 1)) for i, (d, c) in enumerate(zip(DAYS, closes))])
    daily = M.daily_stock_summary(ev, _sym(spark))
    sig = {r["trade_date"]: r for r in M.signal_feature_store(daily, "2024-02-01 00:00:00").collect()}
    risk = {r["trade_date"]: r for r in M.stock_risk_indicators(daily).collect()}
    dd = {r["trade_date"]: r for r in M.stock_drawdown_recovery(daily).collect()}
    an = {r["trade_date"]: r for r in M.stock_anomaly_history(daily).collect()}
    for d, s in sig.items():
        assert s["rolling_volatility_7d"] == risk[d]["rolling_volatility_7d"]
        assert s["drawdown_pct"] == dd[d]["drawdown_pct"]
        assert s["anomaly_severity_score"] == (an[d]["anomaly_severity_score"] if d in an else 0)


def test_the_dimension_is_read_anew_and_large_moves_fit(spark):
    from pyspark.sql import functions as F
    from tidemark.plans import marts as M

    def sym(benchmark):
        return spark.createDataFrame([("AAA", "a", "s", benchmark, benchmark)],
                                     "ticker string, company_name string, sector string, benchmark_ticker string, benchmark_name string")

    rows = [(t, f"2024-01-0{d}", 1, p, p, p, 10, p, p) for t in ("AAA", "XLK", "SPY") for d, p in ((2, "0.01"), (3, "99999999.99"))]
    agg = spark.createDataFrame(rows, "ticker string, d string, event_count long, a string, b string, c string, total_volume long, e string, f string")
    agg = agg.select("ticker", F.to_date("d").alias("trade_date"), "event_count", *[F.col(x).cast("decimal(10,2)").alias(y) for x, y in (
        ("a", "avg_price"), ("b", "min_price"), ("c", "max_price"))], "total_volume", F.current_timestamp().alias("last_updated_at"),
        F.col("e").cast("decimal(10,2)").alias("open_price"), F.col("f").cast("decimal(10,2)").alias("close_price"))
    for benchmark in ("XLK", "SPY"):
        out = M.daily_from_aggregates(agg, sym(benchmark)).where("ticker = 'AAA'").orderBy("trade_date").collect()
        assert [r["benchmark_ticker"] for r in out] == [benchmark] * 2
        assert float(out[1]["benchmark_close_price"]) == 99999999.99
        assert float(out[1]["price_change_pct"]) == 999999999800.0
