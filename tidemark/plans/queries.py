"""SRV-1…19 and DSH-1…11: served analytic queries and dashboard-derived tables.

Every query is a lazy DataFrame over a mart. Patterns used:

* "latest date" filters (JN-11) are an equi-join with the one-row ``max(trade_date)`` aggregate,
  broadcast (one row by construction) — never a cross join.
* "latest row per ticker" is ``max_by(struct(row), order)`` — partial aggregation sends at most
  one row per ticker and map partition through the shuffle, however many rows a ticker has.
* top-k is ``orderBy(...).limit(k)`` with a total order (``ticker`` or another key as the last
  tie-breaker), which Spark plans as TakeOrderedAndProject (a per-partition top-k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import broadcast_if_small
from tidemark.functions.numeric import cents, pct_change_4, round_ratio_half_up
from tidemark.operators.staging import check_limit
from tidemark.plans.marts import DEC4, avg_round

# Default dashboard alert thresholds, move and sentiment label cut-offs.
DEFAULT_PRICE_ALERT_THRESHOLD = 4
DEFAULT_VOLUME_ALERT_THRESHOLD = 1.5
MOVE_CLASS_CUTOFF = 0.25
SENTIMENT_CUTOFF = 0.2

DAILY_COLUMNS = ["ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "trade_date",
                 "event_count", "avg_price", "min_price", "max_price", "total_volume", "last_updated_at",
                 "open_price", "close_price", "previous_close_price", "benchmark_close_price",
                 "benchmark_price_change_pct", "relative_price_change_pct", "price_change_pct",
                 "volume_vs_avg_ratio", "anomaly_flag"]


def latest_date(df: DataFrame, col: str = "trade_date") -> DataFrame:
    """Rows of the latest ``col`` (scalar-subquery filter as a broadcast one-row join)."""
    last = df.agg(F.max(col).alias(col))
    return df.join(broadcast_if_small(last), col, "left_semi")


def latest_rows(df: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """The row with the greatest ``order`` per ``key`` (DISTINCT ON … ORDER BY order DESC)."""
    cols = [c for c in df.columns]
    order_cols = [order] if isinstance(order, str) else order
    ok = F.struct(*[F.col(c) for c in order_cols]) if len(order_cols) > 1 else F.col(order_cols[0])
    agg = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), ok).alias("_r"))
    return agg.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


# --------------------------------------------------------------------------- SRV

def market_summary(daily: DataFrame, limit: int = 100) -> DataFrame:
    check_limit(limit, 250)
    return daily.select(*DAILY_COLUMNS).orderBy(F.desc("trade_date"), "ticker").limit(limit)


def stock_summary(daily: DataFrame, ticker: str) -> DataFrame:
    return daily.filter(F.col("ticker") == ticker).select(*DAILY_COLUMNS).orderBy(F.desc("trade_date"))


def top_movers(daily: DataFrame, limit: int = 10) -> DataFrame:
    check_limit(limit, 100)
    move = F.abs(F.coalesce("relative_price_change_pct", "price_change_pct"))
    return latest_date(daily).select(
        "ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "trade_date", "close_price",
        "previous_close_price", "benchmark_close_price", "benchmark_price_change_pct",
        "relative_price_change_pct", "price_change_pct", "total_volume", "volume_vs_avg_ratio", "anomaly_flag",
    ).orderBy(move.desc(), F.desc("total_volume"), "ticker").limit(limit)


HOURLY_COLUMNS = ["ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "interval_start",
                  "market_session", "open_price", "high_price", "low_price", "close_price", "previous_close_price",
                  "benchmark_close_price", "benchmark_interval_change_pct", "relative_interval_change_pct",
                  "bar_count", "total_volume", "last_updated_at"]


def intraday_candles(hourly: DataFrame, ticker: str, limit: int = 48) -> DataFrame:
    check_limit(limit, 390)
    return hourly.filter(F.col("ticker") == ticker).select(*HOURLY_COLUMNS) \
        .orderBy(F.desc("interval_start")).limit(limit)


def intraday_movers(hourly: DataFrame, limit: int = 12) -> DataFrame:
    check_limit(limit, 100)
    cols = ["ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "interval_start",
            "market_session", "close_price", "previous_close_price", "benchmark_interval_change_pct",
            "relative_interval_change_pct", "total_volume", "bar_count"]
    last = latest_rows(hourly.filter(F.col("market_session") != "closed").select(*cols), "ticker", "interval_start")
    pc = F.col("previous_close_price")
    own = F.when(pc.isNull() | (pc == 0), F.lit(None)).otherwise(pct_change_4(F.col("close_price"), pc))
    change = F.coalesce(F.col("relative_interval_change_pct"), own).cast(DEC4)
    out = last.withColumn("interval_change_pct", change)
    return out.select("ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "interval_start",
                      "market_session", "close_price", "previous_close_price", "interval_change_pct",
                      "benchmark_interval_change_pct", "relative_interval_change_pct", "total_volume", "bar_count") \
        .orderBy(F.abs("interval_change_pct").desc_nulls_last(), F.desc("total_volume"), "ticker").limit(limit)


def market_volatility(daily: DataFrame, limit: int = 30) -> DataFrame:
    check_limit(limit, 100)
    p = F.col("price_change_pct")
    g = daily.groupBy("ticker").agg(
        F.round(F.stddev_pop(p), 4).cast(DEC4).alias("volatility_score"),
        avg_round(F.abs(p), 2, 4).cast(DEC4).alias("avg_absolute_move_pct"),
        F.max(F.abs(p)).cast(DEC4).alias("max_absolute_move_pct"),
        F.count(F.lit(1)).alias("observed_days"),
    ).filter(F.col("observed_days") >= 2)
    return g.orderBy(F.col("volatility_score").desc_nulls_last(), F.desc("avg_absolute_move_pct"), "ticker") \
        .limit(limit)


def pearson(x: Column, y: Column) -> Column:
    """Population Pearson correlation; NULL (not an error) when either side has zero variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ticker_correlation(daily: DataFrame, ticker: str, limit: int = 8) -> DataFrame:
    """SRV-7: correlation of every other ticker's daily change with one target ticker.

    The target side has one row per trade date (bounded by the calendar), so it is broadcast.
    """
    check_limit(limit, 100)
    target = daily.filter(F.col("ticker") == ticker) \
        .select("trade_date", F.col("price_change_pct").alias("_target"))
    cand = daily.filter(F.col("ticker") != ticker).select("ticker", "trade_date", "price_change_pct")
    g = cand.join(broadcast_if_small(target), "trade_date").groupBy("ticker").agg(
        F.round(pearson(F.col("_target").cast("double"), F.col("price_change_pct").cast("double")), 4)
        .cast(DEC4).alias("correlation"),
        F.count(F.lit(1)).alias("overlapping_days"),
    ).filter(F.col("overlapping_days") >= 2)
    return g.orderBy(F.abs("correlation").desc_nulls_last(), "ticker").limit(limit)


def drawdown_latest(drawdown: DataFrame, limit: int = 30) -> DataFrame:
    check_limit(limit, 100)
    return latest_rows(drawdown, "ticker", "trade_date") \
        .orderBy(F.abs("drawdown_pct").desc(), F.desc("days_since_peak"), "ticker").limit(limit)


def risk_latest(risk: DataFrame, limit: int = 30) -> DataFrame:
    check_limit(limit, 100)
    return latest_rows(risk, "ticker", "trade_date") \
        .orderBy(F.col("rolling_volatility_7d").desc_nulls_last(), F.col("sharpe_like_ratio_7d").asc_nulls_last(),
                 "ticker").limit(limit)


def sector_performance(sector: DataFrame, limit: int = 20) -> DataFrame:
    check_limit(limit, 100)
    return latest_date(sector).orderBy(
        F.coalesce("avg_relative_price_change_pct", "avg_price_change_pct").desc(), F.desc("total_volume"),
        "sector").limit(limit)


def benchmark_strength(bench: DataFrame, limit: int = 20) -> DataFrame:
    check_limit(limit, 100)
    return latest_date(bench).orderBy(F.abs("avg_relative_price_change_pct").desc(), F.desc("total_volume"),
                                      "benchmark_ticker").limit(limit)


def regimes(regime: DataFrame, limit: int = 30) -> DataFrame:
    check_limit(limit, 250)
    return regime.orderBy(F.desc("trade_date")).limit(limit)


def anomalies(anom: DataFrame, limit: int = 50, ticker: str | None = None) -> DataFrame:
    check_limit(limit, 250)
    df = anom if ticker is None else anom.filter(F.col("ticker") == ticker)
    return df.orderBy(F.desc("trade_date"), F.desc("anomaly_severity_score"), "ticker").limit(limit)


def signal_features(signal: DataFrame, ticker: str, limit: int = 30) -> DataFrame:
    check_limit(limit, 250)
    return signal.filter(F.col("ticker") == ticker).orderBy(F.desc("trade_date")).limit(limit)


def watchlist(watch: DataFrame, sym: DataFrame, principal: str | None = None) -> DataFrame:
    """SRV-16: watchlist rows with symbol attributes (all principals when ``principal`` is None)."""
    w = watch if principal is None else watch.filter(F.col("principal_id") == principal)
    s = broadcast_if_small(sym.select("ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name"))
    return w.join(s, "ticker", "left").select(
        "principal_id", "ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name",
        "price_alert_threshold", "volume_alert_threshold", "created_at", "updated_at",
    ).orderBy("principal_id", "ticker")


def alert_rows(watch: DataFrame, daily: DataFrame, sym: DataFrame) -> DataFrame:
    """Daily rows of watched tickers that trip a price/volume threshold or are anomalous, for every principal, in no order."""
    d = daily.select("ticker", "trade_date", "close_price", "relative_price_change_pct", "price_change_pct",
                     "volume_vs_avg_ratio", "anomaly_flag")
    s = broadcast_if_small(sym.select("ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name"))
    j = watch.select("principal_id", "ticker", "price_alert_threshold", "volume_alert_threshold").join(d, "ticker")
    price_hit = F.abs("price_change_pct") >= F.col("price_alert_threshold")
    vol_hit = F.col("volume_vs_avg_ratio") >= F.col("volume_alert_threshold")
    return j.filter(price_hit | vol_hit | (F.col("anomaly_flag") != "normal")).join(s, "ticker", "left").select(
        "principal_id", "ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name", "trade_date",
        "close_price", "relative_price_change_pct", "price_change_pct", "volume_vs_avg_ratio", "anomaly_flag",
        "price_alert_threshold", "volume_alert_threshold", price_hit.alias("triggered_price_alert"),
        vol_hit.alias("triggered_volume_alert"))


def watchlist_alerts(watch: DataFrame, daily: DataFrame, sym: DataFrame, principal: str | None = None,
                     limit: int | None = 50) -> DataFrame:
    """SRV-17: the alerts as they are served, in order.

    ``limit`` holds per principal (the latest, then the largest moves); None: every alert.
    """
    if limit is not None:
        check_limit(limit, 250)
    j = alert_rows(watch if principal is None else watch.filter(F.col("principal_id") == principal), daily, sym)
    order = [F.desc("trade_date"), F.abs("price_change_pct").desc(), F.asc("ticker")]
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("principal_id").orderBy(*order))
        j = j.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
    return j.orderBy("principal_id", *order)


def sort_rows(df: DataFrame, col: str, direction: str = "asc", tie_breakers: list[str] | None = None) -> DataFrame:
    """SRV-19: sort by a chosen column (binary collation), NULLs last; optional tie-breakers."""
    c = F.col(col)
    return df.orderBy(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last(), *(tie_breakers or []))


# --------------------------------------------------------------------------- DSH

def market_metrics(daily: DataFrame) -> DataFrame:
    """DSH-1: ticker count, day count, total volume, mean of avg_price (zeros on empty input)."""
    return daily.agg(
        F.count_distinct("ticker").alias("ticker_count"),
        F.count_distinct("trade_date").alias("day_count"),
        F.coalesce(F.sum(F.coalesce("total_volume", F.lit(0))), F.lit(0)).cast("bigint").alias("total_volume"),
        F.coalesce(avg_round(F.coalesce(F.col("avg_price"), F.lit(0).cast("decimal(10,2)")), 2, 4), F.lit(0))
        .cast(DEC4).alias("avg_price"),
    )


def latest_by_ticker(daily: DataFrame) -> DataFrame:
    """DSH-2: the latest daily row per ticker."""
    return latest_rows(daily.select(*DAILY_COLUMNS), "ticker", "trade_date")


def market_trend(daily: DataFrame) -> DataFrame:
    """DSH-3: per date total volume and mean avg_price rounded to 2."""
    return daily.groupBy("trade_date").agg(
        F.sum(F.coalesce("total_volume", F.lit(0))).cast("bigint").alias("total_volume"),
        avg_round(F.coalesce(F.col("avg_price"), F.lit(0).cast("decimal(10,2)")), 2, 2)
        .cast("decimal(12,2)").alias("avg_price"),
    ).orderBy("trade_date")


def market_leaders(daily: DataFrame, limit: int = 6) -> DataFrame:
    """DSH-4: latest rows by volume."""
    return latest_by_ticker(daily).orderBy(F.desc("total_volume"), "ticker").limit(limit)


def latest_movers(daily: DataFrame, limit: int = 6) -> DataFrame:
    """DSH-5: latest rows by abs(price change) (own change, not relative)."""
    return latest_by_ticker(daily).orderBy(F.abs(F.coalesce("price_change_pct", F.lit(0))).desc(), "ticker") \
        .limit(limit)


def anomaly_feed(daily: DataFrame, limit: int = 8) -> DataFrame:
    """DSH-6: latest anomalous rows by abs(change) + volume ratio."""
    sev = F.abs(F.coalesce("price_change_pct", F.lit(0))) + F.coalesce("volume_vs_avg_ratio", F.lit(0))
    return latest_by_ticker(daily).filter(F.col("anomaly_flag") != "normal") \
        .withColumn("feed_severity", sev.cast(DEC4)).orderBy(F.desc("feed_severity"), "ticker").limit(limit)


def ticker_trend(daily: DataFrame, ticker: str | None = None, last_n: int | None = None) -> DataFrame:
    """DSH-7: closes indexed to 100 from the first row, benchmark from its first positive close.

    ``last_n`` keeps the latest n rows per ticker first (22 / 66 / 132 / all in the dashboard).
    Computed per ticker with aggregate bases joined back (no whole-partition window frames).
    """
    d = daily if ticker is None else daily.filter(F.col("ticker") == ticker)
    close = F.coalesce(F.nullif(F.col("close_price"), F.lit(0)), F.col("avg_price"), F.lit(0).cast("decimal(10,2)"))
    d = d.select("ticker", "trade_date", cents(close).alias("_c"),
                 cents(F.coalesce(F.col("benchmark_close_price"), F.lit(0).cast("decimal(10,2)"))).alias("_b"))
    if last_n is not None:

        rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("trade_date")))
        d = d.withColumn("_rn", rn).filter(F.col("_rn") <= last_n).drop("_rn")
    bases = d.groupBy("ticker").agg(
        F.min_by("_c", "trade_date").alias("_base"),
        F.min_by("_b", F.when(F.col("_b") > 0, F.col("trade_date"))).alias("_bbase"))
    j = d.join(bases, "ticker")
    idx = F.when(F.col("_base") > 0, round_ratio_half_up(F.col("_c") * 100, F.col("_base"), 2))
    bidx = F.when((F.col("_b") > 0) & (F.col("_bbase") > 0), round_ratio_half_up(F.col("_b") * 100, F.col("_bbase"), 2))
    return j.select("ticker", "trade_date", (F.col("_c") / 100).cast("decimal(12,2)").alias("close_price"),
                    (F.col("_b") / 100).cast("decimal(12,2)").alias("benchmark_close_price"),
                    idx.cast("decimal(14,2)").alias("indexed_close_price"),
                    bidx.cast("decimal(14,2)").alias("indexed_benchmark_close_price"))


def watchlist_state(watch: DataFrame, daily: DataFrame) -> DataFrame:
    """DSH-8: each watchlist entry with its latest daily row and alert booleans."""
    last = latest_by_ticker(daily).select("ticker", "trade_date", "price_change_pct", "volume_vs_avg_ratio",
                                          "anomaly_flag")
    j = watch.join(last, "ticker", "left")
    pct = F.coalesce(F.col("price_change_pct"), F.lit(0).cast("decimal(12,2)"))
    ratio = F.coalesce(F.nullif(F.col("volume_vs_avg_ratio"), F.lit(0)), F.lit(1).cast("decimal(12,2)"))
    price_hit = F.abs(pct) >= F.coalesce("price_alert_threshold", F.lit(DEFAULT_PRICE_ALERT_THRESHOLD))
    vol_hit = ratio >= F.coalesce("volume_alert_threshold", F.lit(DEFAULT_VOLUME_ALERT_THRESHOLD))
    anomalous = F.coalesce(F.col("anomaly_flag") != "normal", F.lit(False))
    return j.select("principal_id", "ticker", "price_alert_threshold", "volume_alert_threshold", "trade_date",
                    pct.alias("price_change_pct"), ratio.alias("volume_vs_avg_ratio"), "anomaly_flag",
                    price_hit.alias("price_alert_triggered"), vol_hit.alias("volume_alert_triggered"),
                    (price_hit | vol_hit | anomalous).alias("has_alert"))


def move_class(col: Column) -> Column:
    """DSH-9: positive / negative / neutral at ±0.25."""
    v = F.coalesce(col.cast("double"), F.lit(0.0))
    return F.when(v > MOVE_CLASS_CUTOFF, "positive").when(v < -MOVE_CLASS_CUTOFF, "negative").otherwise("neutral")


def sentiment_label(col: Column) -> Column:
    """DSH-9: Positive / Negative / Neutral at ±0.2."""
    return F.when(col > SENTIMENT_CUTOFF, "Positive").when(col < -SENTIMENT_CUTOFF, "Negative").otherwise("Neutral")


def triggered_alerts(state: DataFrame) -> DataFrame:
    """DSH-10: watchlist entries with an alert."""
    return state.filter(F.col("has_alert"))


def quick_tickers(daily: DataFrame, n: int = 5) -> DataFrame:
    """DSH-10: first n market leaders."""
    return market_leaders(daily, 6).limit(n).select("ticker")


def focus_ticker(anom: DataFrame, ticker: str) -> DataFrame:
    """DSH-11: anomaly rows of one ticker (= SRV-13 with a ticker)."""
    return anom.filter(F.col("ticker") == ticker).orderBy(F.desc("trade_date"), F.desc("anomaly_severity_score"))


