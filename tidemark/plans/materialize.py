"""The production mart build: stage → daily/hourly (written once) → the dependent marts.

``daily_stock_summary`` feeds seven marts; recomputing it from the event table for each of them
would scan the events seven times. The build writes it once to the output folder (shared
storage), reads it back, and derives the other marts from the stored copy — the same cut a
build with materialised tables makes. Every mart is written with overwrite semantics
(full refresh); STR-8 covers the incremental path.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.quality import run_checks
from tidemark.operators.staging import stage_stock_prices, stage_symbol_reference
from tidemark.plans import marts as M
from tidemark.plans.queries import DAILY_COLUMNS
from tidemark.sources.tables import assert_schema


#: Columns every stored mart must have, in order.
CONTRACTS = {
    "daily_stock_summary": DAILY_COLUMNS,
    "stock_risk_indicators": ["ticker", "trade_date", "close_price", "price_change_pct", "rolling_return_7d_pct",
                              "rolling_volatility_7d", "sharpe_like_ratio_7d", "observed_days", "last_updated_at"],
    "stock_drawdown_recovery": ["ticker", "trade_date", "close_price", "rolling_peak_close", "drawdown_pct",
                                "days_since_peak", "recovery_status", "last_updated_at"],
    "market_regime_summary": ["trade_date", "regime_label", "avg_relative_move_pct", "avg_volume_ratio", "avg_volatility_7d",
                              "risk_off_share", "outperformer_share", "ticker_count", "anomaly_count", "benchmark_leader",
                              "last_updated_at"],
}


def write_table(df: DataFrame, path: str, partition_col: str | None = None, sort_cols: list[str] | None = None) -> None:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name in CONTRACTS:
        assert_schema(df, CONTRACTS[name])
    w = df.sortWithinPartitions(*sort_cols) if sort_cols else df
    wr = w.write.mode("overwrite")
    if partition_col:
        wr = wr.partitionBy(partition_col)
    wr.parquet(path)


def build_marts(spark: SparkSession, stg: DataFrame, sym: DataFrame, out_dir: str, as_of: str,
                dedupe_leaders: bool = False, with_checks: bool = True, raw: DataFrame | None = None) -> dict:
    """Build and write every mart under ``out_dir``; returns {name: seconds}."""
    timings = {}
    out = out_dir.rstrip("/")

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        timings[name] = round(time.perf_counter() - t0, 3)

    # 1. daily and hourly from the events (the only steps that read event volume)
    timed("daily_stock_summary", lambda: write_table(M.daily_stock_summary(stg, sym), f"{out}/daily_stock_summary",
                                                     sort_cols=["ticker", "trade_date"]))
    timed("intraday_stock_rollup", lambda: write_table(M.intraday_stock_rollup(stg, sym),
                                                       f"{out}/intraday_stock_rollup",
                                                       sort_cols=["ticker", "interval_start"]))
    daily = spark.read.parquet(f"{out}/daily_stock_summary")
    # 2. marts on the stored daily grain
    dependents = {
        "stock_risk_indicators": lambda d: M.stock_risk_indicators(d),
        "stock_drawdown_recovery": lambda d: M.stock_drawdown_recovery(d),
        "stock_anomaly_history": lambda d: M.stock_anomaly_history(d),
        "sector_daily_summary": lambda d: M.sector_daily_summary(d),
        "benchmark_relative_strength": lambda d: M.benchmark_relative_strength(d),
        "market_regime_summary": lambda d: M.market_regime_summary(d, None, dedupe_leaders),
        "stock_signal_feature_store": lambda d: M.signal_feature_store(d, as_of),
    }
    for name, fn in dependents.items():
        timed(name, lambda fn=fn, name=name: write_table(fn(daily), f"{out}/{name}"))
    if with_checks and raw is not None:
        timed("dq_checks", lambda: write_table(run_checks(raw, daily, as_of), f"{out}/_dq_checks"))
    return timings


def staging_views(spark: SparkSession, raw: DataFrame, symbols: DataFrame) -> None:
    """The staging layer as session views (nothing is stored): stg_stock_prices, stg_symbol_reference."""
    stage_stock_prices(raw).createOrReplaceTempView("stg_stock_prices")
    stage_symbol_reference(symbols).createOrReplaceTempView("stg_symbol_reference")

