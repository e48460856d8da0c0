"""MART-1…10: the analytic marts as DataFrame → DataFrame functions.

Plan shape (checked with ``explain``):

* MART-1 / MART-2 read the event table once and run ONE partial+final hash aggregate per grain.
  First/last values per group come from ``min_by``/``max_by`` on a single DECIMAL order key
  (event time in µs, then id), which replaces the reference's DISTINCT ON sub-queries and their
  joins; the string session is carried as an integer code so the aggregate stays hash-based.
  Map-side partial aggregation bounds what a hot ticker sends through the shuffle.
* Every window runs on the daily (or hourly) grain, partitioned by ticker: one row per ticker and
  day, so no window partition grows with event volume. MART-3, 4, 9 reuse that partitioning
  (no further exchange); MART-9 is computed in one pass instead of three self-joins.
* The benchmark self-join keeps only benchmark tickers on its right side (a semi-join with the
  dimension). Its strategy is left to the planner and AQE; the key replaces NULL benchmarks by a
  per-ticker non-matching value, so tickers without a benchmark never pile up in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import ny_date
from tidemark.functions.joins import broadcast_if_small
from tidemark.functions.numeric import cents, event_order_key, pct_change_2, pct_change_4, round_ratio_half_up
from tidemark.operators.staging import coalesce_ohlc, drop_closed

# Anomaly, drawdown, volatility and regime thresholds; signal weights.
ANOMALY_MOVE_PCT = 5
ANOMALY_VOLUME_RATIO = 1.5
DEEP_DRAWDOWN_PCT = -20
REGIME_HIGH_VOL = 6
REGIME_HIGH_VOL_RATIO = 1.4
REGIME_ELEVATED_VOL = 4
REGIME_RISK_ON = 1.5
REGIME_RISK_OFF = -1.5
SIGNAL_HIGH_VOL = 6
SIGNAL_ELEVATED_VOL = 3
SIGNAL_WEIGHTS = {"move": "0.45", "volume": "2.25", "severity": "0.35", "sharpe": "0.25"}

# Session names carried through the hourly aggregate as integer codes.
SESSION_CODES = ["premarket", "regular", "after_hours", "pre", "post", "closed"]

# Wide enough for any change between two DECIMAL(10,2) prices and any ratio of two BIGINT volumes.
DEC2 = "decimal(24,2)"
DEC4 = "decimal(26,4)"


def order_key(ts: str = "event_time", ident: str = "id") -> Column:
    """Total event order (time in µs, then id) as one DECIMAL(38,0) — a hash-aggregatable key."""
    return event_order_key(ts, ident)


def avg_round(col: Column, scale_in: int, digits: int, count: Column | None = None) -> Column:
    """ROUND(AVG(col), digits) for a DECIMAL column with ``scale_in`` digits, exact (aggregate)."""
    unscaled = (col * F.lit(10 ** scale_in)).cast("decimal(38,0)")
    n = F.count(col) if count is None else count
    return F.when(n > 0, round_ratio_half_up(F.sum(unscaled), n * F.lit(10 ** scale_in), digits))


def _by_ticker(order: str) -> Window:
    return Window.partitionBy("ticker").orderBy(order)


def _meta(sym: DataFrame) -> DataFrame:
    """Dimension columns used by the marts (the dimension is a 20-row seed: always broadcast)."""
    return broadcast_if_small(sym.select("ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name"))


def benchmark_join(left: DataFrame, right: DataFrame, time_col: str) -> DataFrame:
    """Left join of rows to their benchmark's row at the same time (JN-4).

    ``right`` holds (bm_ticker, bm_time, …) of benchmark tickers only. The strategy is left to the
    planner and AQE, which know the sizes; rows without a benchmark get a never-matching key per
    ticker, so they do not pile up in one partition of a shuffle join.
    """
    lk = left.withColumn("_bkey", F.coalesce("benchmark_ticker", F.concat(F.lit("\u0000"), F.col("ticker"))))
    rk = right.withColumnRenamed("bm_ticker", "_bkey")
    return lk.join(rk, (lk["_bkey"] == rk["_bkey"]) & (lk[time_col] == rk["bm_time"]), "left") \
        .drop("_bkey", "bm_time")


def _benchmark_rows(df: DataFrame, sym: DataFrame) -> DataFrame:
    """Rows of the dimension's benchmark tickers only; the semi-join follows the dimension as it is now."""
    bms = sym.where(F.col("benchmark_ticker").isNotNull()).select(F.col("benchmark_ticker").alias("ticker")).distinct()
    return df.join(broadcast_if_small(bms), "ticker", "left_semi")


DAILY_AGGREGATE_COLUMNS = ["ticker", "trade_date", "event_count", "avg_price", "min_price", "max_price",
                           "total_volume", "last_updated_at", "open_price", "close_price"]


def daily_aggregates(stg: DataFrame) -> DataFrame:
    """AG-1/AG-2: the per (ticker, New York trade date) aggregates of MART-1 — the only part that
    reads event volume (one partial + final hash aggregate)."""
    base = coalesce_ohlc(drop_closed(stg)).select(
        "ticker", ny_date(F.col("event_time")).alias("trade_date"), "price", "volume",
        "open_price", "high_price", "low_price", "close_price", "inserted_at",
        order_key().alias("_k"))
    agg = base.groupBy("ticker", "trade_date").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(cents(F.col("price"))).alias("_sum_cents"),
        F.min("low_price").alias("min_price"),
        F.max("high_price").alias("max_price"),
        F.sum("volume").alias("total_volume"),
        F.max("inserted_at").alias("last_updated_at"),
        F.min_by("open_price", "_k").alias("open_price"),
        F.max_by("close_price", "_k").alias("close_price"),
    )
    avg = round_ratio_half_up(F.col("_sum_cents"), F.col("event_count") * 100, 2).cast("decimal(10,2)")
    return agg.withColumn("avg_price", avg).select(*DAILY_AGGREGATE_COLUMNS)


def daily_stock_summary(stg: DataFrame, sym: DataFrame) -> DataFrame:
    """MART-1: one row per ticker × New York trade date (closed session excluded)."""
    return daily_from_aggregates(daily_aggregates(stg), sym)


def daily_from_aggregates(agg: DataFrame, sym: DataFrame) -> DataFrame:
    """MART-1 window, dimension and benchmark columns over per-day aggregates (daily grain only,
    so the incremental refresh can rebuild them from stored aggregates without the events)."""
    w = _by_ticker("trade_date")
    trail = w.rowsBetween(-6, -1)
    enriched = agg.select(
        "*",
        F.lag("close_price").over(w).alias("previous_close_price"),
        F.sum("total_volume").over(trail).alias("_trail_sum"),
        F.count("total_volume").over(trail).alias("_trail_n"),
    )
    pc = F.col("previous_close_price")
    pct = F.when(pc.isNull() | (pc == 0), F.lit(0).cast(DEC2)) \
        .otherwise(pct_change_2(F.col("close_price"), pc)).cast(DEC2)
    ratio = F.when((F.col("_trail_n") == 0) | F.col("_trail_sum").isNull() | (F.col("_trail_sum") == 0),
                   F.lit(1).cast(DEC2)) \
        .otherwise(round_ratio_half_up(F.col("total_volume") * F.col("_trail_n"), F.col("_trail_sum"), 2)).cast(DEC2)
    final_base = enriched.withColumns({"price_change_pct": pct, "volume_vs_avg_ratio": ratio}) \
        .join(_meta(sym), "ticker", "left") \
        .withColumn("sector", F.coalesce("sector", F.lit("Other")))
    bench = _benchmark_rows(final_base, sym).select(
        F.col("ticker").alias("bm_ticker"), F.col("trade_date").alias("bm_time"),
        F.col("close_price").alias("benchmark_close_price"),
        F.col("price_change_pct").alias("benchmark_price_change_pct"))
    joined = benchmark_join(final_base, bench, "trade_date")
    p, b = F.col("price_change_pct"), F.col("benchmark_price_change_pct")
    move = F.abs(F.coalesce(p - b, p))
    flag = (F.when((move >= ANOMALY_MOVE_PCT) & (F.col("volume_vs_avg_ratio") >= ANOMALY_VOLUME_RATIO), "price_and_volume")
            .when(move >= ANOMALY_MOVE_PCT, "price_move")
            .when(F.col("volume_vs_avg_ratio") >= ANOMALY_VOLUME_RATIO, "volume_spike")
            .otherwise("normal"))
    return joined.select(
        "ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "trade_date",
        "event_count", "avg_price", "min_price", "max_price", "total_volume", "last_updated_at",
        "open_price", "close_price", "previous_close_price", "benchmark_close_price",
        "benchmark_price_change_pct",
        F.round(p - F.coalesce(b, F.lit(0)), 2).cast(DEC2).alias("relative_price_change_pct"),
        "price_change_pct", "volume_vs_avg_ratio", flag.alias("anomaly_flag"),
    )


HOURLY_AGGREGATE_COLUMNS = ["ticker", "interval_start", "market_session", "open_price", "high_price", "low_price",
                            "close_price", "bar_count", "total_volume", "last_updated_at"]


def hourly_aggregates(stg: DataFrame) -> DataFrame:
    """AG-2/AG-3: per (ticker, hour) OHLC, count, volume and first session of MART-2 — one partial +
    final hash aggregate (the session travels as an integer code)."""
    codes = F.array(*[F.lit(s) for s in SESSION_CODES])
    base = coalesce_ohlc(drop_closed(stg)).select(
        "ticker", F.date_trunc("hour", F.col("event_time")).alias("interval_start"),
        "open_price", "high_price", "low_price", "close_price", "volume", "inserted_at",
        F.array_position(codes, F.col("market_session")).cast("int").alias("_session"),
        order_key().alias("_k"))
    agg = base.groupBy("ticker", "interval_start").agg(
        F.count(F.lit(1)).alias("bar_count"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.sum("volume").alias("total_volume"),
        F.max("inserted_at").alias("last_updated_at"),
        F.min_by("open_price", "_k").alias("open_price"),
        F.max_by("close_price", "_k").alias("close_price"),
        F.min_by("_session", "_k").alias("_session"),
    )
    return agg.withColumn("market_session", F.element_at(codes, F.col("_session"))) \
        .select(*HOURLY_AGGREGATE_COLUMNS)


def intraday_stock_rollup(stg: DataFrame, sym: DataFrame) -> DataFrame:
    """MART-2: one row per ticker × hour (UTC hour = New York hour for open sessions)."""
    return intraday_from_aggregates(hourly_aggregates(stg), sym)


def intraday_from_aggregates(agg: DataFrame, sym: DataFrame) -> DataFrame:
    """MART-2 LAG, dimension and benchmark columns over stored hourly aggregates."""
    w = _by_ticker("interval_start")
    pc = F.col("previous_close_price")
    change = F.when(pc.isNull() | (pc == 0), F.lit(None).cast(DEC4)) \
        .otherwise(pct_change_4(F.col("close_price"), pc)).cast(DEC4)
    feats = agg.withColumns({
        "previous_close_price": F.lag("close_price").over(w),
    }).withColumn("_change", change).join(_meta(sym), "ticker", "left") \
        .withColumn("sector", F.coalesce("sector", F.lit("Other")))
    bench = _benchmark_rows(feats, sym).select(
        F.col("ticker").alias("bm_ticker"), F.col("interval_start").alias("bm_time"),
        F.col("close_price").alias("benchmark_close_price"),
        F.col("_change").alias("benchmark_interval_change_pct"))
    joined = benchmark_join(feats, bench, "interval_start")
    return joined.select(
        "ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "interval_start",
        "market_session", "open_price", "high_price", "low_price", "close_price",
        "previous_close_price", "benchmark_close_price", "benchmark_interval_change_pct",
        (F.col("_change") - F.coalesce("benchmark_interval_change_pct", F.lit(0))).cast(DEC4)
        .alias("relative_interval_change_pct"),
        "bar_count", "total_volume", "last_updated_at",
    )


def _risk_columns(daily: DataFrame) -> dict[str, Column]:
    w7 = _by_ticker("trade_date").rowsBetween(-6, 0)
    p = F.col("price_change_pct")
    std = F.stddev_pop(p).over(w7)
    return {
        "rolling_return_7d_pct": F.round(F.sum(p).over(w7), 4).cast(DEC4),
        "rolling_volatility_7d": F.round(std, 4).cast(DEC4),
        "sharpe_like_ratio_7d": F.when(std.isNull() | (std == 0), F.lit(None))
                                 .otherwise(F.round(F.avg(p).over(w7).cast("double") / std, 4)).cast(DEC4),
        "observed_days": F.count(F.lit(1)).over(w7),
    }


def stock_risk_indicators(daily: DataFrame) -> DataFrame:
    """MART-3: rolling 7-row return, population volatility, Sharpe-like ratio."""
    return daily.select("ticker", "trade_date", "close_price", "price_change_pct",
                        *[c.alias(n) for n, c in _risk_columns(daily).items()], "last_updated_at")


def _drawdown_columns() -> dict[str, Column]:
    run = _by_ticker("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col("close_price")
    peak = F.max(c).over(run)
    return {"rolling_peak_close": peak,
            "_peak_date": F.when(c == peak, F.col("trade_date"))}


def stock_drawdown_recovery(daily: DataFrame) -> DataFrame:
    """MART-4: running peak, drawdown, days since the latest (on ties: later) peak, status."""
    run = _by_ticker("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.select("ticker", "trade_date", "close_price", "last_updated_at",
                     *[c.alias(n) for n, c in _drawdown_columns().items()])
    peak = F.col("rolling_peak_close")
    dd = F.when(peak == 0, F.lit(0).cast(DEC2)).otherwise(pct_change_2(F.col("close_price"), peak)).cast(DEC2)
    d = d.withColumns({"drawdown_pct": dd,
                       "days_since_peak": F.datediff("trade_date", F.max("_peak_date").over(run)).cast("bigint")})
    return d.select("ticker", "trade_date", "close_price", "rolling_peak_close", "drawdown_pct", "days_since_peak",
                    _recovery_status(F.col("drawdown_pct")).alias("recovery_status"), "last_updated_at")


def month_block(time: Column) -> Column:
    """Number of a date's month: the block of a segmented scan at daily grain."""
    return F.year(time) * 12 + F.month(time)


def _close_at(time: str) -> Column:
    """(close, time), ordered by the close and then by the time; null without a close."""
    return F.when(F.col("close_price").isNotNull(), F.struct(F.col("close_price").alias("close"), F.col(time).alias("at")))


def block_peaks(rows: DataFrame, time: str = "trade_date") -> DataFrame:
    """WN-3/4, first step: highest close of each (ticker, block) and its latest time (partial aggregation)."""
    return rows.groupBy("ticker", "block").agg(F.max(_close_at(time)).alias("_top")) \
        .select("ticker", "block", F.col("_top.close").alias("peak"), F.col("_top.at").alias("peak_at"))


def carried_peaks(peaks: DataFrame) -> DataFrame:
    """Second step: ``peaks`` with the peak carried into each block: the running maximum over the blocks before.

    The only window over a whole ticker, on one row per block.
    """
    before = Window.partitionBy("ticker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.when(F.col("peak").isNotNull(), F.struct("peak", "peak_at"))).over(before)
    return peaks.withColumn("_c", top).withColumns({"peak": F.col("_c.peak"), "peak_at": F.col("_c.peak_at")}).drop("_c")


def running_peaks(rows: DataFrame, carried: DataFrame, time: str = "trade_date") -> DataFrame:
    """Third step: ``rows`` with ``rolling_peak_close`` and ``_peak_at``, by a window within each (ticker, block).

    ``carried``: (ticker, block, peak, peak_at), one row per block.
    """
    run = Window.partitionBy("ticker", "block").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    c = carried.select("ticker", "block", F.when(F.col("peak").isNotNull(), F.struct(F.col("peak").alias("close"), F.col("peak_at").alias("at")))
                       .alias("_carried"))
    joined = rows.join(c, ["ticker", "block"], "left").withColumn("_run", F.max(_close_at(time)).over(run))
    top = F.greatest("_run", "_carried")  # skips nulls; of equal closes the later
    return joined.withColumns({"rolling_peak_close": top["close"], "_peak_at": top["at"]}).drop("_run", "_carried")


def drawdown_from_peaks(rows: DataFrame) -> DataFrame:
    """MART-4 columns of daily rows with their running peak."""
    peak = F.col("rolling_peak_close")
    dd = F.when(peak == 0, F.lit(0).cast(DEC2)).otherwise(pct_change_2(F.col("close_price"), peak)).cast(DEC2)
    rows = rows.withColumns({"drawdown_pct": dd, "days_since_peak": F.datediff("trade_date", "_peak_at").cast("bigint")})
    return rows.select("ticker", "trade_date", "close_price", "rolling_peak_close", "drawdown_pct", "days_since_peak",
                       _recovery_status(F.col("drawdown_pct")).alias("recovery_status"), "last_updated_at")


def segmented_drawdown(daily: DataFrame, block: Column | None = None) -> DataFrame:
    """MART-4 as a segmented scan: block peaks, a scan over the blocks, a window within each block.

    No task holds a ticker's whole history, whatever its grain; ``block`` is any expression that grows with
    ``trade_date``, months if not given.
    """
    rows = daily.select("ticker", "trade_date", "close_price", "last_updated_at",
                        (month_block(F.col("trade_date")) if block is None else block).alias("block"))
    return drawdown_from_peaks(running_peaks(rows, carried_peaks(block_peaks(rows))))


def _recovery_status(dd: Column) -> Column:
    return F.when(dd <= DEEP_DRAWDOWN_PCT, "deep_drawdown").when(dd < 0, "underwater").otherwise("recovered")


def _severity() -> Column:
    return F.round(F.abs(F.coalesce("relative_price_change_pct", "price_change_pct")) + F.col("volume_vs_avg_ratio"),
                   4).cast(DEC4)


def stock_anomaly_history(daily: DataFrame) -> DataFrame:
    """MART-5: anomalous ticker-days with a severity score."""
    return daily.filter(F.col("anomaly_flag") != "normal").select(
        "ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "trade_date", "anomaly_flag",
        _severity().alias("anomaly_severity_score"), "relative_price_change_pct", "price_change_pct",
        "volume_vs_avg_ratio", "close_price", "total_volume")


def sector_daily_summary(daily: DataFrame) -> DataFrame:
    """MART-6: sector × date; top mover by abs(change) desc, volume desc, ticker (Q10: sector from daily)."""
    p = F.col("price_change_pct")
    rank_key = F.struct((-F.abs(p)).alias("a"), (-F.col("total_volume")).alias("v"), F.col("ticker").alias("t"))
    g = daily.groupBy("sector", "trade_date").agg(
        F.count(F.lit(1)).alias("ticker_count"),
        avg_round(p, 2, 4).cast(DEC4).alias("avg_price_change_pct"),
        avg_round(F.coalesce("relative_price_change_pct", "price_change_pct"), 2, 4).cast(DEC4)
        .alias("avg_relative_price_change_pct"),
        avg_round(F.col("volume_vs_avg_ratio"), 2, 4).cast(DEC4).alias("avg_volume_ratio"),
        F.sum("total_volume").alias("total_volume"),
        F.count_if(F.col("anomaly_flag") != "normal").alias("anomaly_count"),
        F.min_by(F.struct(F.col("ticker").alias("t"), p.alias("p")), rank_key).alias("_top"),
    )
    return g.select("sector", "trade_date", "ticker_count", "avg_price_change_pct", "avg_relative_price_change_pct",
                    "avg_volume_ratio", "total_volume", "anomaly_count",
                    F.col("_top.t").alias("top_ticker"), F.col("_top.p").alias("top_ticker_price_change_pct"))


def benchmark_relative_strength(daily: DataFrame) -> DataFrame:
    """MART-7: benchmark × date; members, average relative move, out/under-performers, leader."""
    rel0 = F.coalesce(F.col("relative_price_change_pct"), F.lit(0).cast(DEC2))
    rank_key = F.struct((-F.abs(rel0)).alias("a"), (-F.col("total_volume")).alias("v"), F.col("ticker").alias("t"))
    g = daily.filter(F.col("benchmark_ticker").isNotNull()).groupBy("benchmark_ticker", "trade_date").agg(
        F.max("benchmark_name").alias("benchmark_name"),
        F.max("benchmark_price_change_pct").alias("benchmark_price_change_pct"),
        F.count(F.lit(1)).alias("ticker_count"),
        avg_round(rel0, 2, 4).cast(DEC4).alias("avg_relative_price_change_pct"),
        F.count_if(rel0 > 0).alias("outperformer_count"),
        F.count_if(rel0 < 0).alias("underperformer_count"),
        F.min_by(F.struct(F.col("ticker").alias("t"), F.col("relative_price_change_pct").alias("r")), rank_key)
        .alias("_top"),
        F.sum("total_volume").alias("total_volume"),
        F.max("last_updated_at").alias("last_updated_at"),
    )
    return g.select("benchmark_ticker", "benchmark_name", "trade_date", "benchmark_price_change_pct", "ticker_count",
                    "avg_relative_price_change_pct", "outperformer_count", "underperformer_count",
                    F.col("_top.t").alias("top_relative_ticker"), F.col("_top.r").alias("top_relative_price_change_pct"),
                    "total_volume", "last_updated_at")


def market_regime_summary(daily: DataFrame, risk: DataFrame | None = None, dedupe_leaders: bool = False) -> DataFrame:
    """MART-8: one row per date with a regime label.

    The reference joins every benchmark-leader row of a date (quirk Q3), multiplying
    ``ticker_count`` and ``anomaly_count`` by the number of benchmarks of that date (averages
    are unaffected). Both sides are aggregated per date first and the multiplication is applied
    to the counts, which gives the same numbers without materialising the fan-out.
    ``dedupe_leaders=True`` gives the corrected counts.
    """
    if risk is None:
        joined = daily.withColumn("rolling_volatility_7d", _risk_columns(daily)["rolling_volatility_7d"])
    else:
        joined = daily.join(risk.select("ticker", "trade_date", "rolling_volatility_7d"), ["ticker", "trade_date"], "left")
    move = F.coalesce("relative_price_change_pct", "price_change_pct", F.lit(0).cast(DEC2))
    vol = F.col("rolling_volatility_7d")
    n = F.count(F.lit(1))
    per_date = joined.groupBy("trade_date").agg(
        n.alias("_n"),
        avg_round(move, 2, 4, n).cast(DEC4).alias("avg_relative_move_pct"),
        avg_round(F.col("volume_vs_avg_ratio"), 2, 4, n).cast(DEC4).alias("avg_volume_ratio"),
        avg_round(vol, 4, 4).cast(DEC4).alias("avg_volatility_7d"),
        round_ratio_half_up(F.count_if(move < 0), n, 4).cast(DEC4).alias("risk_off_share"),
        round_ratio_half_up(F.count_if(move > 0), n, 4).cast(DEC4).alias("outperformer_share"),
        F.count_if(F.col("anomaly_flag") != "normal").alias("_anomalies"),
        F.max("last_updated_at").alias("last_updated_at"),
        # exact label inputs: AVG(x) >= t  <=>  SUM(x) >= n·t
        F.sum(F.coalesce(vol, F.lit(0).cast(DEC4))).alias("_sum_vol0"),
        F.sum("volume_vs_avg_ratio").alias("_sum_ratio"),
        F.sum(move).alias("_sum_move"),
    )
    counts = joined.filter(F.col("benchmark_ticker").isNotNull()) \
        .groupBy("trade_date", "benchmark_ticker").agg(F.count(F.lit(1)).alias("c"))
    leaders = counts.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("_n_leaders"),
        F.min_by("benchmark_ticker", F.struct((-F.col("c")).alias("c"), F.col("benchmark_ticker").alias("b")))
        .alias("benchmark_leader"))
    # one row per trade date on both sides
    out = per_date.join(leaders, "trade_date", "left")
    mult = F.lit(1) if dedupe_leaders else F.greatest(F.coalesce("_n_leaders", F.lit(0)), F.lit(1))
    nn = F.col("_n")
    label = (F.when((F.col("_sum_vol0") >= nn * REGIME_HIGH_VOL) & (F.col("_sum_ratio") >= nn * REGIME_HIGH_VOL_RATIO),
                    "risk_off_high_volatility")
             .when(F.col("_sum_vol0") >= nn * REGIME_ELEVATED_VOL, "high_volatility")
             .when(F.col("_sum_move") >= nn * REGIME_RISK_ON, "broad_risk_on")
             .when(F.col("_sum_move") <= nn * REGIME_RISK_OFF, "broad_risk_off")
             .otherwise("balanced"))
    return out.select(
        "trade_date", label.alias("regime_label"), "avg_relative_move_pct", "avg_volume_ratio", "avg_volatility_7d",
        "risk_off_share", "outperformer_share", (nn * mult).cast("bigint").alias("ticker_count"),
        (F.col("_anomalies") * mult).cast("bigint").alias("anomaly_count"), "benchmark_leader", "last_updated_at")


def signal_feature_store(daily: DataFrame, as_of: str, peak: str | None = None) -> DataFrame:
    """MART-9: daily + risk + drawdown + anomaly severity in one ticker-partitioned pass.

    ``peak``: a column with the running peak, where the rows do not hold the whole history.
    """
    risk = _risk_columns(daily)
    d = daily.select("*", *[c.alias(n) for n, c in risk.items() if n != "observed_days"],
                     (_drawdown_columns()["rolling_peak_close"] if peak is None else F.col(peak)).alias("_peak"))
    peak = F.col("_peak")
    d = d.withColumn("drawdown_pct", F.when(peak == 0, F.lit(0).cast(DEC2))
                     .otherwise(pct_change_2(F.col("close_price"), peak)).cast(DEC2))
    sev = F.when(F.col("anomaly_flag") != "normal", _severity()).otherwise(F.lit(0).cast(DEC4))
    vol0 = F.coalesce("rolling_volatility_7d", F.lit(0).cast(DEC4))
    regime = F.when(vol0 >= SIGNAL_HIGH_VOL, "high_volatility").when(vol0 >= SIGNAL_ELEVATED_VOL, "elevated_volatility") \
        .otherwise("stable")
    wt = {k: F.lit(v).cast("decimal(3,2)") for k, v in SIGNAL_WEIGHTS.items()}
    score = F.round(
        F.abs(F.coalesce("relative_price_change_pct", "price_change_pct")) * wt["move"]
        + F.greatest(F.col("volume_vs_avg_ratio") - 1, F.lit(0).cast(DEC2)) * wt["volume"]
        + F.col("anomaly_severity_score") * wt["severity"]
        + F.abs(F.coalesce("sharpe_like_ratio_7d", F.lit(0).cast(DEC4))) * wt["sharpe"], 4).cast(DEC4)
    d = d.withColumn("anomaly_severity_score", sev).withColumn("market_regime_label", regime)
    return d.select(
        "ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "trade_date", "close_price",
        "previous_close_price", "price_change_pct", "benchmark_price_change_pct", "relative_price_change_pct",
        "volume_vs_avg_ratio", "drawdown_pct", "rolling_return_7d_pct", "rolling_volatility_7d",
        "sharpe_like_ratio_7d", "anomaly_flag", "anomaly_severity_score", "market_regime_label",
        score.alias("signal_strength_score"), F.lit(as_of).cast("timestamp").alias("feature_generated_at"))


def build_marts(stg: DataFrame, sym: DataFrame, as_of: str, dedupe_leaders: bool = False) -> dict[str, DataFrame]:
    """All marts in dependency order (lazy). Persist ``daily`` when several marts are written."""
    daily = daily_stock_summary(stg, sym)
    risk = stock_risk_indicators(daily)
    return {
        "daily_stock_summary": daily,
        "intraday_stock_rollup": intraday_stock_rollup(stg, sym),
        "stock_risk_indicators": risk,
        "stock_drawdown_recovery": stock_drawdown_recovery(daily),
        "stock_anomaly_history": stock_anomaly_history(daily),
        "sector_daily_summary": sector_daily_summary(daily),
        "benchmark_relative_strength": benchmark_relative_strength(daily),
        "market_regime_summary": market_regime_summary(daily, None, dedupe_leaders),
        "stock_signal_feature_store": signal_feature_store(daily, as_of),
    }
