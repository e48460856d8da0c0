"""SYM-1…6: ticker lookup, symbol profiles, tracked tickers, news terms, entity matches.

The catalog is a 20-row dimension, so every lookup is a broadcast join (size fixed by the seed);
per-row work is column expressions and higher-order array functions — no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import broadcast_if_small
from tidemark.sources.symbols import (DEFAULT_BENCHMARK, DEFAULT_BENCHMARK_KIND, DEFAULT_BENCHMARK_NAME,
                                      DEFAULT_SECTOR, LOOKUP_ALIAS_OVERRIDES, SYMBOL_SEED, alias_map,
                                      symbol_lookup)


def normalize_ticker(df: DataFrame, col: str, out: str = "ticker") -> DataFrame:
    """SYM-1: trim + upper, then alias (tickers, company names, nicknames) → canonical ticker.

    Unknown symbols pass through upper-cased; NULL becomes ''.
    """
    spark = df.sparkSession
    key = F.upper(F.trim(F.coalesce(F.col(col).cast("string"), F.lit(""))))
    amap = broadcast_if_small(alias_map(spark).withColumnRenamed("canonical", "_canon"))
    j = df.withColumn("_key", key).join(amap, F.col("_key") == F.col("alias_key"), "left")
    return j.withColumn(out, F.coalesce(F.col("_canon"), F.col("_key"))).drop("_key", "alias_key", "_canon")


def symbol_profile(df: DataFrame, col: str = "ticker", normalize: bool = True) -> DataFrame:
    """SYM-2: canonical profile with defaults for symbols outside the catalog.

    Defaults: company = ticker, sector 'Other', benchmark SPY (none for SPY itself), kind
    'broad_market', no aliases, not a benchmark. A catalog NULL (SPY's benchmark) stays NULL.
    """
    spark = df.sparkSession
    d = normalize_ticker(df, col, "_canonical") if normalize else df.withColumn("_canonical", F.col(col))
    cat = broadcast_if_small(symbol_lookup(spark).select(
        F.col("ticker").alias("_cat_ticker"), F.col("company_name").alias("_cn"), F.col("sector").alias("_sec"),
        F.col("benchmark_ticker").alias("_bt"), F.col("benchmark_name").alias("_bn"),
        F.col("benchmark_kind").alias("_bk"), F.col("aliases").alias("_al"), F.col("is_benchmark").alias("_ib")))
    j = d.join(cat, F.col("_canonical") == F.col("_cat_ticker"), "left")
    known = F.col("_cat_ticker").isNotNull()
    is_spy = F.col("_canonical") == DEFAULT_BENCHMARK
    return j.select(
        *[c for c in df.columns if c not in ("company_name", "sector", "benchmark_ticker", "benchmark_name",
                                            "benchmark_kind", "aliases", "is_benchmark")],
        F.col("_canonical").alias("canonical_ticker"),
        F.when(known, F.col("_cn")).otherwise(F.col("_canonical")).alias("company_name"),
        F.when(known, F.col("_sec")).otherwise(F.lit(DEFAULT_SECTOR)).alias("sector"),
        F.when(known, F.col("_bt")).when(is_spy, F.lit(None)).otherwise(F.lit(DEFAULT_BENCHMARK)).alias("benchmark_ticker"),
        F.when(known, F.col("_bn")).when(is_spy, F.lit(None)).otherwise(F.lit(DEFAULT_BENCHMARK_NAME))
        .alias("benchmark_name"),
        F.when(known, F.col("_bk")).otherwise(F.lit(DEFAULT_BENCHMARK_KIND)).alias("benchmark_kind"),
        F.when(known, F.col("_al")).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(F.col("_ib"), F.lit(False)).alias("is_benchmark"),
    )


def tracked_tickers(configured: DataFrame, group_col: str, order_col: str, symbol_col: str) -> DataFrame:
    """SYM-3: per group, configured tickers in order, then each one's benchmark, then SPY.

    Three branches ranked (branch, position) are unioned; the first occurrence of every canonical
    ticker wins. Returns (group, position, ticker) with position 1, 2, …. A group holds one
    configuration (a handful of tickers), so the per-group window stays small.
    """
    pos = F.row_number().over(Window.partitionBy(group_col).orderBy(order_col, symbol_col))
    norm = normalize_ticker(configured.select(group_col, order_col, symbol_col), symbol_col, "_t") \
        .filter(F.col("_t") != "").withColumn("_pos", pos)
    first = norm.select(group_col, F.lit(0).alias("_branch"), "_pos", F.col("_t").alias("ticker"))
    bench = symbol_profile(norm.select(group_col, "_pos", F.col("_t").alias("_src")), "_src", normalize=False) \
        .filter(F.col("benchmark_ticker").isNotNull()) \
        .select(group_col, F.lit(1).alias("_branch"), "_pos", F.col("benchmark_ticker").alias("ticker"))
    spy = configured.select(group_col).distinct().select(
        group_col, F.lit(2).alias("_branch"), F.lit(0).alias("_pos"), F.lit(DEFAULT_BENCHMARK).alias("ticker"))
    allrows = first.unionByName(bench).unionByName(spy)
    firsts = allrows.groupBy(group_col, "ticker").agg(F.min(F.col("_branch") * 1000000 + F.col("_pos")).alias("_rank"))
    w = Window.partitionBy(group_col).orderBy("_rank")
    return firsts.select(group_col, F.row_number().over(w).alias("position"), "ticker")


def profile_terms(profile: DataFrame) -> Column:
    """[ticker, company_name, *aliases] of a profile row."""
    return F.concat(F.array(F.col("canonical_ticker"), F.col("company_name")), F.col("aliases"))


def news_query_terms(df: DataFrame, col: str = "ticker", limit: int = 4) -> DataFrame:
    """SYM-4: profile terms, trimmed, case-insensitively deduplicated in order, first ``limit``.

    Returns the input rows with ``terms`` ARRAY<STRING>.
    """
    prof = symbol_profile(df, col)
    terms = F.filter(F.transform(profile_terms(prof), lambda t: F.trim(t)), lambda t: t != "")
    # keep a term when no earlier term has the same upper-case form
    dedup = F.filter(terms, lambda t, i: ~F.exists(F.slice(terms, 1, i), lambda u: F.upper(u) == F.upper(t)))
    return prof.withColumn("terms", F.slice(dedup, 1, limit))


def match_entities(df: DataFrame, text_col: str, ticker_col: str = "ticker") -> DataFrame:
    """SYM-5: profile strings contained in the text (case-insensitive), in profile order, duplicates kept."""
    # lower-cased once, not once a term
    prof = symbol_profile(df, ticker_col).withColumn("_low_text", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    low = F.col("_low_text")
    cands = F.filter(F.transform(profile_terms(prof), lambda t: F.trim(t)), lambda t: t != "")
    return prof.withColumn("canonical_entity_matches",
                           F.when(low == "", F.array().cast("array<string>"))
                           .otherwise(F.filter(cands, lambda t: F.contains(low, F.lower(t))))).drop("_low_text")


def attach_symbol_meta(df: DataFrame, sym: DataFrame, col: str = "ticker") -> DataFrame:
    """SYM-6: left join of the dimension; sector defaults to 'Other' (unknown company/benchmark stay NULL)."""
    meta = broadcast_if_small(sym.select(F.col("ticker").alias("_mt"), "company_name", "sector", "benchmark_ticker",
                                  "benchmark_name"))
    j = df.join(meta, F.col(col) == F.col("_mt"), "left").drop("_mt")
    return j.withColumn("sector", F.coalesce("sector", F.lit(DEFAULT_SECTOR)))


def symbol_candidates() -> list[str]:
    """Strings a user may type for a symbol: tickers, company names and lookup aliases."""
    out: list[str] = []
    for t, name, *_rest in SYMBOL_SEED:
        out += [t, name, *LOOKUP_ALIAS_OVERRIDES.get(t, _rest[4])]
    return out
