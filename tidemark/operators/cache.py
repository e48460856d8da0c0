"""Search cache: FRS-1…4 (freshness, resolution), MUT-1…3 (upsert, delete, invalidate), SRV-15, SRV-18.

The cache has one row per (ticker, cache_date) with a live column family, a news column family
(articles as ARRAY<STRUCT>) and bookkeeping times. Every operation here is a whole-table
DataFrame transformation: freshness is evaluated for all rows at an ``as_of`` instant, upserts
are full outer joins on the key with per-family ``coalesce``, deletes are anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import infer_session, market_context
from tidemark.functions.numeric import event_order_key, round_ratio_half_up

# Cache time-to-live per family (minutes), freshness states and reasons, quote sources.
LIVE_TTL_MIN, NEWS_TTL_MIN, SUMMARY_TTL_MIN = 15, 180, 180
STATE_MISS, STATE_FRESH, STATE_STALE = "miss", "fresh", "stale"
REASON_MISS, REASON_CLOSED, REASON_EXPIRED, REASON_FRESH = (
    "cache_miss", "market_closed_since_last_update", "ttl_expired", "fresh_within_ttl")
LIVE_PROVIDER_SOURCE, STALE_CACHE_SOURCE = "yfinance_live_api", "daily_cache_stale"
LIVE_COLUMNS = ["live_price", "live_volume", "live_event_time", "live_source", "live_expires_at", "live_updated_at"]
NEWS_COLUMNS = ["article_count", "news_expires_at", "news_updated_at"]
SUMMARY_COLUMNS = ["news_summary", "summary_source", "summary_model", "summary_fallback_reason",
                   "news_summary_expires_at"]
SCOPES = {"live": ("live_expires_at", "live_updated_at"),
          "news": ("news_expires_at", "news_updated_at"),
          "news_summary": ("news_summary_expires_at", "news_updated_at")}
KEYS = ["ticker", "cache_date"]


def _minutes(m: int) -> Column:
    return F.make_interval(mins=F.lit(m))


def cache_articles(articles_enriched: DataFrame) -> DataFrame:
    """The cache's news articles as a child table keyed by (ticker, cache_date, position).

    The reference keeps them as a JSON array inside the cache row; here the array is a view over
    this table (``article_arrays``), so no row ever has to hold an unbounded list."""
    return articles_enriched.withColumn("cache_date", F.to_date("published_at")).drop("fetch_batch")


def article_arrays(children: DataFrame, rows: DataFrame) -> DataFrame:
    """ARRAY<STRUCT> of articles for a *bounded selection* of cache rows (e.g. one ticker's latest
    row), ordered by arrival: the serving form of the news family."""
    cols = [c for c in children.columns if c not in KEYS]
    sel = children.join(rows.select(*KEYS), KEYS, "left_semi")
    g = sel.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ["position"] + [
        c for c in cols if c != "position"]]))).alias("news_articles"))
    return rows.join(g, KEYS, "left")


def build_cache(articles_enriched: DataFrame, events: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Cache rows (one per ticker × cache_date) from enriched articles and stored events.

    News family: article count and times of the (ticker, publication date) group — the articles
    themselves live in ``cache_articles``. Live family: the last event of the ticker's UTC day.
    Full outer join on (ticker, cache_date)."""
    news = cache_articles(articles_enriched).groupBy("ticker", "cache_date").agg(
        F.count(F.lit(1)).alias("article_count"), F.max("published_at").alias("news_updated_at"))
    news = news.withColumns({"news_expires_at": F.col("news_updated_at") + _minutes(NEWS_TTL_MIN),
                             "news_summary_expires_at": F.col("news_updated_at") + _minutes(SUMMARY_TTL_MIN)})
    if summaries is not None:
        news = news.join(summaries.select("ticker", "cache_date", F.col("summary").alias("news_summary"),
                                          F.col("source").alias("summary_source"),
                                          F.col("model").alias("summary_model"),
                                          F.col("fallback_reason").alias("summary_fallback_reason")),
                         KEYS, "left")
    else:
        news = news.withColumns({"news_summary": F.lit(None).cast("string"),
                                 "summary_source": F.lit(None).cast("string"),
                                 "summary_model": F.lit(None).cast("string"),
                                 "summary_fallback_reason": F.lit(None).cast("string")})
    key = event_order_key()
    live = events.withColumn("cache_date", F.to_date("event_time")).groupBy("ticker", "cache_date").agg(
        F.max_by(F.struct(F.col("price").alias("live_price"), F.col("volume").alias("live_volume"),
                          F.col("event_time").alias("live_event_time"), F.col("source").alias("live_source"),
                          F.col("inserted_at").alias("live_updated_at")), key).alias("_l"))
    live = live.select("ticker", "cache_date", "_l.*") \
        .withColumn("live_expires_at", F.col("live_updated_at") + _minutes(LIVE_TTL_MIN))
    c = news.join(live, KEYS, "full")
    return c.select(
        *KEYS, *LIVE_COLUMNS, "article_count", "news_summary", "summary_source", "summary_model",
        "summary_fallback_reason", "news_expires_at", "news_summary_expires_at", "news_updated_at",
        F.least("news_updated_at", "live_updated_at").alias("created_at"),
        F.greatest("news_updated_at", "live_updated_at").alias("updated_at"))


def latest_cache_row(cache: DataFrame) -> DataFrame:
    """SRV-18: per ticker the row with the latest (cache_date, updated_at) — all tickers at once."""
    cols = [c for c in cache.columns if c != "ticker"]
    g = cache.groupBy("ticker").agg(F.max_by(F.struct(*[F.col(c) for c in cols]),
                                             F.struct("cache_date", "updated_at")).alias("_r"))
    return g.select("ticker", *[F.col(f"_r.{c}").alias(c) for c in cols])


def cache_status(rows: DataFrame, as_of: str | list[str], scope: str | list[str]) -> DataFrame:
    """FRS-1: miss / fresh / stale per row at each ``as_of`` for each scope — one pass.

    The (as_of, scope) combinations are generated per row (a small literal array exploded, no
    join), so the input is read once however many instants and scopes are evaluated. Stale rows
    count as fresh when the market is closed and the row was updated after the last session
    close. ``rows`` may hold NULL cache columns for misses (e.g. after a left join).
    """
    as_ofs = [as_of] if isinstance(as_of, str) else list(as_of)
    scopes = [scope] if isinstance(scope, str) else list(scope)
    combos = F.array(*[F.struct(F.lit(a).cast("timestamp").alias("as_of"), F.lit(s).alias("scope"))
                       for a in as_ofs for s in scopes])
    d = rows.withColumn("_c", F.explode(combos)).withColumns({"as_of": F.col("_c.as_of"), "scope": F.col("_c.scope")})
    d = market_context(d, "as_of", prefix="_m_")
    sc = F.col("scope")

    def by_scope(i: int) -> Column:
        out = None
        for name, cols in SCOPES.items():
            out = F.when(sc == name, F.col(cols[i])) if out is None else out.when(sc == name, F.col(cols[i]))
        return out

    now = F.col("as_of")
    exp, upd = by_scope(0), by_scope(1)
    d = d.withColumns({"_exp": exp, "_upd": upd})
    exp, upd = F.col("_exp"), F.col("_upd")
    miss = F.col("cache_date").isNull()
    stale0 = exp.isNull() | (exp <= now)
    closed_ok = stale0 & upd.isNotNull() & ~F.col("_m_is_market_open") & (upd >= F.col("_m_last_session_close_at"))
    stale = stale0 & ~closed_ok
    reason = F.when(miss, REASON_MISS).when(closed_ok, REASON_CLOSED) \
        .when(stale0, REASON_EXPIRED).otherwise(REASON_FRESH)
    lag = F.when(exp.isNotNull() & stale, F.greatest(F.lit(0), (F.unix_seconds(now) - F.unix_seconds(exp))))
    return d.select(
        "ticker", "scope", "as_of",
        F.when(miss, STATE_MISS).when(stale, STATE_STALE).otherwise(STATE_FRESH).alias("state"),
        (miss | stale).alias("is_stale"),
        F.when(miss, F.lit(None)).otherwise(exp).alias("expires_at"),
        F.when(miss, F.lit(None)).otherwise(upd).alias("updated_at"),
        F.when(miss, F.lit(None)).otherwise(lag).cast("bigint").alias("stale_by_seconds"),
        reason.alias("freshness_reason"), F.col("_m_session").alias("market_session"),
        F.col("_m_is_market_open").alias("is_market_open"))


def resolve_quotes(provider: DataFrame, cache_latest: DataFrame, profiles: DataFrame | None = None,
                   as_of: str | None = None) -> DataFrame:
    """FRS-2: provider quote wins; else the cached live quote labelled ``daily_cache_stale``; else
    an error row. ``provider``: (ticker, price, volume, event_time); one row per requested ticker
    in ``cache_latest ∪ provider``."""
    p = provider.select("ticker", F.col("price").alias("_pp"), F.col("volume").alias("_pv"),
                        F.col("event_time").alias("_pt"), F.lit(True).alias("_ok"))
    c = cache_latest.select("ticker", "live_price", "live_volume", "live_event_time")
    j = p.join(c, "ticker", "full")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    cached = ~ok & F.col("live_price").isNotNull()
    out = j.select(
        "ticker",
        F.when(ok, F.col("_pp")).when(cached, F.col("live_price")).cast("decimal(10,2)").alias("price"),
        F.when(ok, F.col("_pv")).when(cached, F.coalesce(F.col("live_volume"), F.lit(0))).cast("bigint").alias("volume"),
        F.when(ok, F.col("_pt")).when(cached, F.col("live_event_time")).alias("event_time"),
        F.when(ok, F.lit(LIVE_PROVIDER_SOURCE)).when(cached, F.lit(STALE_CACHE_SOURCE)).alias("source"),
        F.when(~ok & ~cached, F.lit("No market data available")).alias("error"))
    if profiles is not None:  # company, sector, benchmark of the answer
        out = out.join(profiles, "ticker", "left")
    if as_of is not None:
        out = out.withColumn("market_session", infer_session(F.lit(as_of).cast("timestamp")))
    return out


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], cols: list[str],
           touched_col: str | None = "updated_at", touched_at: str | None = None) -> DataFrame:
    """MUT-1: column-family upsert. Rows of ``changes`` replace ``cols`` of the matching base rows
    (insert when new); other columns keep their base values; ``touched_col`` is set to
    ``touched_at`` on changed rows. Implemented as a full outer join on ``keys``."""
    ch = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_changed"))
    j = base.join(ch, keys, "full")
    changed = F.coalesce(F.col("_changed"), F.lit(False))
    sel = []
    for c in base.columns:
        if c in keys:
            sel.append(F.col(c))
        elif c in cols:
            sel.append(F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif touched_col and c == touched_col and touched_at is not None:
            sel.append(F.when(changed, F.lit(touched_at).cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            sel.append(F.col(c))
    return j.select(*sel)


def delete_rows(base: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """MUT-2: rows of ``base`` whose key is not in ``keys_df``."""
    return base.join(keys_df.select(*keys).distinct(), keys, "left_anti")


def invalidate(cache: DataFrame, tickers: DataFrame, scopes: list[str], touched_at: str | None = None) -> DataFrame:
    """MUT-3: all three scopes → delete the tickers' rows; otherwise NULL the scopes' columns."""
    if set(scopes) == set(SCOPES):
        return delete_rows(cache, tickers, ["ticker"])
    t = tickers.select("ticker").distinct().withColumn("_hit", F.lit(True))
    j = cache.join(t, "ticker", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    clear = set()
    if "live" in scopes:
        clear |= set(LIVE_COLUMNS)
    if "news" in scopes:
        clear |= set(NEWS_COLUMNS)
    if "news_summary" in scopes:
        clear |= set(SUMMARY_COLUMNS)
    sel = []
    for c in cache.columns:
        if c in clear:
            sel.append(F.when(hit, F.lit(None)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and touched_at is not None:
            sel.append(F.when(hit, F.lit(touched_at).cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            sel.append(F.col(c))
    return j.select(*sel)


def upsert_news(cache: DataFrame, children: DataFrame, articles: DataFrame, summaries: DataFrame,
                as_of: str) -> tuple[DataFrame, DataFrame]:
    """Store fetched articles and their summary together under today's key: (cache rows, article table).

    ``articles``: enriched articles of the tickers fetched; ``summaries``: one row per ticker. Both families
    get new times; the tickers' articles of the day are replaced."""
    today, now = F.to_date(F.lit(as_of)), F.lit(as_of).cast("timestamp")
    mine = articles.drop("fetch_batch").withColumn("cache_date", today)
    counts = mine.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("article_count"))
    changes = counts.join(summaries.select("ticker", "summary", "source", "model", "fallback_reason"), "ticker").select(
        *KEYS, "article_count", F.col("summary").alias("news_summary"), F.col("source").alias("summary_source"),
        F.col("model").alias("summary_model"), F.col("fallback_reason").alias("summary_fallback_reason"),
        (now + _minutes(NEWS_TTL_MIN)).alias("news_expires_at"), (now + _minutes(SUMMARY_TTL_MIN)).alias("news_summary_expires_at"),
        now.alias("news_updated_at"))
    columns = [c for c in changes.columns if c not in KEYS]
    kept = delete_rows(children, counts, KEYS)
    return upsert(cache, changes, KEYS, columns, "updated_at", as_of), kept.unionByName(mine.select(*children.columns))


def sentiment_over_time(children: DataFrame, ticker: str | None = None, limit: int | None = 30) -> DataFrame:
    """SRV-15: per (ticker, cache_date) averages over the cached articles (NULL → 0), round 4.

    A grouped aggregate over the article child table (cache rows without articles drop out, as an
    inner unnest does). ``limit`` keeps the latest ``limit`` dates per ticker.
    """
    c = children if ticker is None else children.filter(F.col("ticker") == ticker)
    a = c.select("ticker", "cache_date", F.struct("sentiment", "impact_score", "source_quality_score").alias("a"))

    def avg4(x: Column) -> Column:
        u = (F.coalesce(x.cast("decimal(10,4)"), F.lit(0).cast("decimal(10,4)")) * 10000).cast("decimal(38,0)")
        return round_ratio_half_up(F.sum(u), F.count(F.lit(1)) * 10000, 4).cast("decimal(10,4)")

    g = a.groupBy("ticker", "cache_date").agg(
        avg4(F.col("a.sentiment")).alias("avg_sentiment"), avg4(F.col("a.impact_score")).alias("avg_impact_score"),
        avg4(F.col("a.source_quality_score")).alias("avg_source_quality_score"),
        F.count(F.lit(1)).alias("article_count"))
    if limit is not None:
        rk = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("cache_date")))
        g = g.withColumn("_r", rk).filter(F.col("_r") <= limit).drop("_r")
    return g


def refresh(cache: DataFrame, tickers: DataFrame, scopes: list[str], as_of: str, provider_quotes: DataFrame | None = None,
            provider_news: DataFrame | None = None, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """FRS-4: refresh the requested scopes of the requested tickers.

    live → provider quotes upserted into the live family (FRS-2 / MUT-1); news → provider
    articles into the news family; news_summary → new summaries into the summary family. Returns
    (new cache, one result row per (ticker, scope))."""
    key_date = F.to_date(F.lit(as_of))
    now = F.lit(as_of).cast("timestamp")
    t = tickers.select("ticker").distinct()
    out = cache
    results = []
    if "live" in scopes and provider_quotes is not None:
        q = provider_quotes.join(t, "ticker", "left_semi")
        ch = q.select("ticker", key_date.alias("cache_date"), F.col("price").alias("live_price"),
                      F.col("volume").alias("live_volume"), F.col("event_time").alias("live_event_time"),
                      F.lit(LIVE_PROVIDER_SOURCE).alias("live_source"),
                      (now + _minutes(LIVE_TTL_MIN)).alias("live_expires_at"), now.alias("live_updated_at"))
        out = upsert(out, ch, KEYS, LIVE_COLUMNS, "updated_at", as_of)
        results.append(q.select("ticker", F.lit("live").alias("scope")))
    if "news" in scopes and provider_news is not None:
        # provider_news: (ticker, article_count); the fetched articles go to the child table
        n = provider_news.join(t, "ticker", "left_semi")
        ch = n.select("ticker", key_date.alias("cache_date"), "article_count", now.alias("news_updated_at"),
                      (now + _minutes(NEWS_TTL_MIN)).alias("news_expires_at"))
        out = upsert(out, ch, KEYS, NEWS_COLUMNS, "updated_at", as_of)
        results.append(n.select("ticker", F.lit("news").alias("scope")))
    if "news_summary" in scopes and summaries is not None:
        s = summaries.join(t, "ticker", "left_semi")
        ch = s.select("ticker", key_date.alias("cache_date"), F.col("summary").alias("news_summary"),
                      F.col("source").alias("summary_source"), F.col("model").alias("summary_model"),
                      F.col("fallback_reason").alias("summary_fallback_reason"),
                      (now + _minutes(SUMMARY_TTL_MIN)).alias("news_summary_expires_at"), now.alias("news_updated_at"))
        out = upsert(out, ch, KEYS, SUMMARY_COLUMNS + ["news_updated_at"], "updated_at", as_of)
        results.append(s.select("ticker", F.lit("news_summary").alias("scope")))
    from functools import reduce
    res = reduce(DataFrame.unionByName, results) if results else t.select("ticker", F.lit(None).cast("string")
                                                                                       .alias("scope"))
    return out, res.withColumns({"refreshed": F.lit(True), "invalidated": F.lit(False)})
