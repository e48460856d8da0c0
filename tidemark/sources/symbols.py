"""SRC-5: the symbol dimension.

Two alias lists exist on purpose (quirk Q8): the seed rows of the dimension table and the
alias list used by ticker lookup differ for NVDA, TSLA and SPY. The dimension table feeds
the marts; the lookup list feeds ``normalize_ticker`` / ``symbol_profile``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import literal_frame

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's seed data): the 20-row symbol dimension.
# (canonical_ticker, company_name, sector, benchmark_ticker, benchmark_name,
#  benchmark_kind, aliases, is_benchmark)
# ---------------------------------------------------------------------------------------
SYMBOL_SEED = [
    ("AAPL", "Apple Inc.", "Technology", "XLK", "Technology Select Sector SPDR Fund", "sector_etf", ["Apple", "Apple Inc", "iPhone maker"], False),
    ("MSFT", "Microsoft Corporation", "Technology", "XLK", "Technology Select Sector SPDR Fund", "sector_etf", ["Microsoft", "Microsoft Corp", "Azure"], False),
    ("NVDA", "NVIDIA Corporation", "Technology", "XLK", "Technology Select Sector SPDR Fund", "sector_etf", ["NVIDIA", "Nvidia", "GeForce"], False),
    ("AMD", "Advanced Micro Devices, Inc.", "Technology", "XLK", "Technology Select Sector SPDR Fund", "sector_etf", ["AMD", "Advanced Micro Devices", "Ryzen"], False),
    ("INTC", "Intel Corporation", "Technology", "XLK", "Technology Select Sector SPDR Fund", "sector_etf", ["Intel", "Intel Corp"], False),
    ("GOOGL", "Alphabet Inc.", "Communication Services", "XLC", "Communication Services Select Sector SPDR Fund", "sector_etf", ["Alphabet", "Google", "Alphabet Inc"], False),
    ("META", "Meta Platforms, Inc.", "Communication Services", "XLC", "Communication Services Select Sector SPDR Fund", "sector_etf", ["Meta", "Facebook", "Instagram"], False),
    ("NFLX", "Netflix, Inc.", "Communication Services", "XLC", "Communication Services Select Sector SPDR Fund", "sector_etf", ["Netflix", "Netflix Inc"], False),
    ("AMZN", "Amazon.com, Inc.", "Consumer Discretionary", "XLY", "Consumer Discretionary Select Sector SPDR Fund", "sector_etf", ["Amazon", "Amazon.com", "AWS"], False),
    ("TSLA", "Tesla, Inc.", "Consumer Discretionary", "XLY", "Consumer Discretionary Select Sector SPDR Fund", "sector_etf", ["Tesla", "Tesla Inc"], False),
    ("JPM", "JPMorgan Chase & Co.", "Financials", "XLF", "Financial Select Sector SPDR Fund", "sector_etf", ["JPMorgan", "JP Morgan", "JPMorgan Chase"], False),
    ("BAC", "Bank of America Corporation", "Financials", "XLF", "Financial Select Sector SPDR Fund", "sector_etf", ["Bank of America", "BofA", "BAC"], False),
    ("XOM", "Exxon Mobil Corporation", "Energy", "XLE", "Energy Select Sector SPDR Fund", "sector_etf", ["Exxon", "Exxon Mobil"], False),
    ("CVX", "Chevron Corporation", "Energy", "XLE", "Energy Select Sector SPDR Fund", "sector_etf", ["Chevron", "Chevron Corp"], False),
    ("SPY", "SPDR S&P 500 ETF Trust", "Benchmark", None, None, "broad_market", ["SPY", "S&P 500"], True),
    ("XLK", "Technology Select Sector SPDR Fund", "Technology", "SPY", "SPDR S&P 500 ETF Trust", "broad_market", ["XLK", "Technology Select Sector SPDR Fund"], True),
    ("XLC", "Communication Services Select Sector SPDR Fund", "Communication Services", "SPY", "SPDR S&P 500 ETF Trust", "broad_market", ["XLC", "Communication Services Select Sector SPDR Fund"], True),
    ("XLY", "Consumer Discretionary Select Sector SPDR Fund", "Consumer Discretionary", "SPY", "SPDR S&P 500 ETF Trust", "broad_market", ["XLY", "Consumer Discretionary Select Sector SPDR Fund"], True),
    ("XLF", "Financial Select Sector SPDR Fund", "Financials", "SPY", "SPDR S&P 500 ETF Trust", "broad_market", ["XLF", "Financial Select Sector SPDR Fund"], True),
    ("XLE", "Energy Select Sector SPDR Fund", "Energy", "SPY", "SPDR S&P 500 ETF Trust", "broad_market", ["XLE", "Energy Select Sector SPDR Fund"], True),
]

# Alias lists of the ticker lookup where they differ from the seed rows (Q8).
LOOKUP_ALIAS_OVERRIDES = {
    "NVDA": ["NVIDIA", "Nvidia", "NVidia", "GeForce"],
    "TSLA": ["Tesla", "Tesla Inc", "Elon Musk EV maker"],
    "SPY": ["SPY", "S&P 500", "SPDR S&P 500 ETF Trust"],
}

# Defaults of a profile for a ticker outside the catalog.
DEFAULT_SECTOR = "Other"
DEFAULT_BENCHMARK = "SPY"
DEFAULT_BENCHMARK_NAME = "SPDR S&P 500 ETF Trust"
DEFAULT_BENCHMARK_KIND = "broad_market"

SYMBOL_SCHEMA = T.StructType([
    T.StructField("canonical_ticker", T.StringType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("sector", T.StringType(), False),
    T.StructField("benchmark_ticker", T.StringType(), True),
    T.StructField("benchmark_name", T.StringType(), True),
    T.StructField("benchmark_kind", T.StringType(), False),
    T.StructField("aliases", T.ArrayType(T.StringType(), False), False),
    T.StructField("is_benchmark", T.BooleanType(), False),
])

LOOKUP_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("sector", T.StringType(), False),
    T.StructField("benchmark_ticker", T.StringType(), True),
    T.StructField("benchmark_name", T.StringType(), True),
    T.StructField("benchmark_kind", T.StringType(), False),
    T.StructField("aliases", T.ArrayType(T.StringType(), False), False),
    T.StructField("is_benchmark", T.BooleanType(), False),
])


def symbol_reference(spark: SparkSession, created_at: str = "2024-01-01 00:00:00") -> DataFrame:
    """The dimension table as seeded (20 rows; always small enough to broadcast)."""
    df = literal_frame(spark, SYMBOL_SEED, SYMBOL_SCHEMA)
    ts = F.lit(created_at).cast("timestamp")
    return df.withColumns({"created_at": ts, "updated_at": ts})


def symbol_lookup(spark: SparkSession) -> DataFrame:
    """Catalog used by the ticker lookup (code alias lists), with catalog position."""
    rows = []
    for pos, (t, name, sector, bt, bn, kind, aliases, is_bm) in enumerate(SYMBOL_SEED):
        rows.append((t, pos, name, sector, bt, bn, kind, LOOKUP_ALIAS_OVERRIDES.get(t, aliases), is_bm))
    return literal_frame(spark, rows, LOOKUP_SCHEMA)


def benchmark_tickers() -> list[str]:
    """Tickers that appear as somebody's benchmark or are flagged as benchmarks."""
    out = {r[3] for r in SYMBOL_SEED if r[3]} | {r[0] for r in SYMBOL_SEED if r[7]}
    return sorted(out)


def alias_map(spark: SparkSession) -> DataFrame:
    """(alias_key, canonical) pairs: ticker itself plus every lookup alias, upper-cased.

    Later entries win on duplicate keys, as in a dict built in catalog order.
    """
    rows: dict[str, str] = {}
    for t, *_rest in SYMBOL_SEED:
        rows[t] = t
        for a in LOOKUP_ALIAS_OVERRIDES.get(t, _rest[5]):
            rows[a.strip().upper()] = t
    schema = T.StructType([T.StructField("alias_key", T.StringType(), False),
                           T.StructField("canonical", T.StringType(), False)])
    return literal_frame(spark, sorted(rows.items()), schema)
