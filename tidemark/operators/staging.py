"""PRJ-1…6: staging projections and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request ticker pattern and result limits of the served queries.
TICKER_PATTERN = r"^[A-Za-z][A-Za-z0-9.\-]{0,9}$"


def _blank_to(col: str, default: str | None) -> Column:
    v = F.nullif(F.trim(F.col(col)), F.lit(""))
    return F.coalesce(v, F.lit(default)) if default is not None else v


def stage_stock_prices(raw: DataFrame) -> DataFrame:
    """PRJ-1: typed, trimmed view of the raw event table; rows without ticker dropped."""
    dec = "decimal(10,2)"
    return raw.filter(F.col("ticker").isNotNull()).select(
        F.col("id").cast("bigint").alias("id"),
        F.upper(F.trim("ticker")).alias("ticker"),
        F.col("price").cast(dec).alias("price"),
        F.col("volume").cast("bigint").alias("volume"),
        F.col("event_time").cast("timestamp").alias("event_time"),
        _blank_to("source", "unknown").alias("source"),
        F.col("open_price").cast(dec).alias("open_price"),
        F.col("high_price").cast(dec).alias("high_price"),
        F.col("low_price").cast(dec).alias("low_price"),
        F.col("close_price").cast(dec).alias("close_price"),
        _blank_to("event_kind", "live_snapshot").alias("event_kind"),
        _blank_to("bar_interval", "snapshot").alias("bar_interval"),
        _blank_to("market_session", "regular").alias("market_session"),
        F.col("inserted_at").cast("timestamp").alias("inserted_at"),
    )


def stage_symbol_reference(raw: DataFrame) -> DataFrame:
    """PRJ-2: dimension keyed by ``ticker``; '' benchmark → NULL, default benchmark kind."""
    return raw.select(
        F.upper(F.trim("canonical_ticker")).alias("ticker"),
        "company_name",
        "sector",
        F.upper(_blank_to("benchmark_ticker", None)).alias("benchmark_ticker"),
        "benchmark_name",
        _blank_to("benchmark_kind", "broad_market").alias("benchmark_kind"),
        "aliases",
        "is_benchmark",
        "created_at",
        "updated_at",
    )


def drop_closed(df: DataFrame, col: str = "market_session") -> DataFrame:
    """PRJ-3: keep open-session events."""
    return df.filter(F.col(col) != "closed")


def coalesce_ohlc(df: DataFrame, price_col: str = "price") -> DataFrame:
    """PRJ-4: open/high/low/close fall back to the event price."""
    p = F.col(price_col)
    return df.withColumns({c: F.coalesce(F.col(c), p)
                           for c in ("open_price", "high_price", "low_price", "close_price")})


def valid_tickers(df: DataFrame, col: str = "ticker") -> DataFrame:
    """PRJ-5: rows whose ticker matches the request pattern."""
    return df.filter(F.col(col).rlike(TICKER_PATTERN))


def check_limit(limit: int, upper: int, lower: int = 1) -> int:
    """Served queries accept a limit in [lower, upper] (100 / 250 / 390 upper bounds)."""
    if not isinstance(limit, int) or limit < lower or limit > upper:
        raise ValueError(f"limit must be an integer in [{lower}, {upper}], got {limit!r}")
    return limit


def search_rows(df: DataFrame, text: str, cols: list[str] | None = None) -> DataFrame:
    """PRJ-6: case-insensitive substring search over the visible columns."""
    needle = (text or "").strip().lower()
    if not needle:
        return df
    cols = cols or df.columns
    cond = reduce(lambda a, b: a | b,
                  [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in cols])
    return df.filter(cond)
