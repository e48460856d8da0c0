"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each callable reads the driver tables of ``sf_dir`` (through the fixture mapping), runs the
operator over the whole tables and returns its result with comparison-friendly types
(DECIMAL → DOUBLE, INT → BIGINT), the same casts the oracle SQL applies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.staging import stage_stock_prices, stage_symbol_reference
from tidemark.plans import marts as M
from tidemark.plans import queries as Q
from tidemark.operators.validation import dead_letters, split_valid, validate_events
from tidemark.sources.fixtures import load_raw_messages, load_stock_prices, load_watchlists
from tidemark.sources.sinks import EVENT_COLUMNS, append_events
from tidemark.session import materialized
from tidemark.sources.symbols import symbol_reference

# Fixed "now" of every registered query (no wall-clock time in a registered query).
AS_OF = "2024-02-01 00:00:00"
# Parameters of the parameterised served queries.
FOCUS_TICKER = "AAPL"


def for_compare(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) or isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


class Ctx:
    """Lazily built inputs and marts of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` returns, written out: worked out once in a query, however often it is read."""
        if name not in self._made:
            self._made[name] = materialized(make(), name)
        return self._made[name]

    @property
    def raw(self) -> DataFrame:
        return load_stock_prices(self.spark, self.sf_dir)

    @property
    def stg(self) -> DataFrame:
        return stage_stock_prices(self.raw)

    @property
    def sym(self) -> DataFrame:
        return stage_symbol_reference(symbol_reference(self.spark))

    @property
    def daily(self) -> DataFrame:
        return M.daily_stock_summary(self.stg, self.sym)

    @property
    def daily_once(self) -> DataFrame:
        """``daily`` over aggregates that are written out: the events are read once, however often it is read."""
        return M.daily_from_aggregates(self.once("daily-aggregates", lambda: M.daily_aggregates(self.stg)), self.sym)

    @property
    def hourly(self) -> DataFrame:
        return M.intraday_stock_rollup(self.stg, self.sym)

    @property
    def checked(self) -> DataFrame:
        return validate_events(load_raw_messages(self.spark, self.sf_dir))

    @property
    def watch(self) -> DataFrame:
        return load_watchlists(self.spark, self.sf_dir)


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Callable[[Ctx], DataFrame]) -> Callable[[Ctx], DataFrame]:
        REGISTRY[name] = lambda spark, sf_dir: for_compare(fn(Ctx(spark, sf_dir)))
        return fn
    return deco


# ------------------------------------------------------------------ staging / marts
@register("stage_stock_prices")
def _q_stage(c: Ctx):
    return c.stg


@register("daily_stock_summary")
def _q_daily(c: Ctx):
    return c.daily


@register("intraday_stock_rollup")
def _q_hourly(c: Ctx):
    return c.hourly


@register("stock_risk_indicators")
def _q_risk(c: Ctx):
    return M.stock_risk_indicators(c.daily)


@register("stock_drawdown_recovery")
def _q_drawdown(c: Ctx):
    return M.stock_drawdown_recovery(c.daily)


@register("stock_anomaly_history")
def _q_anomaly(c: Ctx):
    return M.stock_anomaly_history(c.daily)


@register("sector_daily_summary")
def _q_sector(c: Ctx):
    return M.sector_daily_summary(c.daily)


@register("benchmark_relative_strength")
def _q_bench(c: Ctx):
    return M.benchmark_relative_strength(c.daily)


@register("market_regime_summary")
def _q_regime(c: Ctx):
    return M.market_regime_summary(c.daily)


@register("market_regime_summary_dedup")
def _q_regime_dedup(c: Ctx):
    return M.market_regime_summary(c.daily, dedupe_leaders=True)


@register("signal_feature_store")
def _q_signal(c: Ctx):
    return M.signal_feature_store(c.daily, AS_OF)


# ------------------------------------------------------------------ served queries
@register("market_summary")
def _q_market_summary(c: Ctx):
    return Q.market_summary(c.daily, 100)


@register("stock_summary")
def _q_stock_summary(c: Ctx):
    return Q.stock_summary(c.daily, FOCUS_TICKER)


@register("top_movers")
def _q_top_movers(c: Ctx):
    return Q.top_movers(c.daily, 10)


@register("intraday_candles")
def _q_candles(c: Ctx):
    return Q.intraday_candles(c.hourly, FOCUS_TICKER, 48)


@register("intraday_movers")
def _q_intraday_movers(c: Ctx):
    return Q.intraday_movers(c.hourly, 12)


@register("market_volatility")
def _q_volatility(c: Ctx):
    return Q.market_volatility(c.daily, 30)


@register("ticker_correlation")
def _q_correlation(c: Ctx):
    return Q.ticker_correlation(c.daily_once, FOCUS_TICKER, 8)


@register("drawdown_latest")
def _q_drawdown_latest(c: Ctx):
    return Q.drawdown_latest(M.stock_drawdown_recovery(c.daily), 30)


@register("risk_latest")
def _q_risk_latest(c: Ctx):
    return Q.risk_latest(M.stock_risk_indicators(c.daily), 30)


@register("sector_performance")
def _q_sector_perf(c: Ctx):
    return Q.sector_performance(M.sector_daily_summary(c.daily), 20)


@register("benchmark_strength")
def _q_bench_strength(c: Ctx):
    return Q.benchmark_strength(M.benchmark_relative_strength(c.daily), 20)


@register("regimes")
def _q_regimes(c: Ctx):
    return Q.regimes(M.market_regime_summary(c.daily), 30)


@register("anomalies")
def _q_anomalies(c: Ctx):
    return Q.anomalies(M.stock_anomaly_history(c.daily), 50)


@register("signal_features")
def _q_signal_features(c: Ctx):
    return Q.signal_features(M.signal_feature_store(c.daily, AS_OF), FOCUS_TICKER, 30)


@register("watchlist")
def _q_watchlist(c: Ctx):
    return Q.watchlist(c.watch, c.sym)


@register("watchlist_alerts")
def _q_watchlist_alerts(c: Ctx):
    return Q.watchlist_alerts(c.watch, c.daily, c.sym, None, 50)


# ------------------------------------------------------------------ dashboard tables
@register("market_metrics")
def _q_market_metrics(c: Ctx):
    return Q.market_metrics(c.daily)


@register("market_trend")
def _q_market_trend(c: Ctx):
    return Q.market_trend(c.daily)


@register("market_leaders")
def _q_market_leaders(c: Ctx):
    return Q.market_leaders(c.daily, 6)


@register("latest_movers")
def _q_latest_movers(c: Ctx):
    return Q.latest_movers(c.daily, 6)


@register("anomaly_feed")
def _q_anomaly_feed(c: Ctx):
    return Q.anomaly_feed(c.daily, 8)


@register("ticker_trend")
def _q_ticker_trend(c: Ctx):
    return Q.ticker_trend(c.daily)


@register("watchlist_state")
def _q_watchlist_state(c: Ctx):
    return Q.watchlist_state(c.watch, c.daily)


# ------------------------------------------------------------------ ingest
@register("validate_events_valid")
def _q_valid(c: Ctx):
    valid, _ = split_valid(c.checked)
    return valid.select("topic", "partition", "offset", *EVENT_COLUMNS)


@register("validate_events_invalid")
def _q_invalid(c: Ctx):
    _, invalid = split_valid(c.checked)
    return dead_letters(invalid)


@register("append_events")
def _q_append(c: Ctx):
    valid, _ = split_valid(c.checked)
    return append_events(valid, None).select(*EVENT_COLUMNS)


# ------------------------------------------------------------------ symbols and calendar
from tidemark.functions import calendar as CAL  # noqa: E402
from tidemark.functions import symbols as SYM  # noqa: E402
from tidemark.sources.fixtures import load_bars, load_symbol_requests  # noqa: E402
from tidemark.sources.tables import read_table  # noqa: E402


@register("normalize_ticker")
def _q_normalize(c: Ctx):
    return SYM.normalize_ticker(load_symbol_requests(c.spark, c.sf_dir), "raw_symbol")


@register("symbol_profile")
def _q_profile(c: Ctx):
    p = SYM.symbol_profile(load_symbol_requests(c.spark, c.sf_dir), "raw_symbol")
    return p.withColumn("aliases", F.array_join("aliases", "|"))


@register("tracked_tickers")
def _q_tracked(c: Ctx):
    return SYM.tracked_tickers(c.watch, "principal_id", "price_alert_threshold", "ticker")


@register("news_query_terms")
def _q_terms(c: Ctx):
    t = SYM.news_query_terms(load_symbol_requests(c.spark, c.sf_dir), "raw_symbol")
    return t.select("c_custkey", "raw_symbol", F.posexplode("terms").alias("position", "term")) \
        .withColumn("position", F.col("position") + 1)


def _articles_min(c: Ctx) -> DataFrame:
    from tidemark.sources.fixtures import article_text, article_ticker
    docs = read_table(c.spark, c.sf_dir, "documents", ["doc_id", "text"])
    did = F.col("doc_id")
    return docs.select("doc_id", article_ticker(did).alias("ticker"), article_text(did, F.col("text")).alias("text"))


@register("match_entities")
def _q_match(c: Ctx):
    m = SYM.match_entities(_articles_min(c), "text", "ticker")
    return m.select("doc_id", "ticker", F.posexplode("canonical_entity_matches").alias("position", "entity")) \
        .withColumn("position", F.col("position") + 1)


def _calendar_days(c: Ctx) -> DataFrame:
    """Days derived from the event table: every event's New York date and weekly steps for 3 years."""
    ev = read_table(c.spark, c.sf_dir, "events", ["ts"])
    d = ev.select(CAL.ny_date(F.col("ts").cast("timestamp")).alias("d")).distinct()
    return d.select(F.explode(F.sequence("d", F.date_add("d", 3 * 366), F.expr("INTERVAL 7 DAYS"))).alias("day")) \
        .distinct()


@register("trading_calendar")
def _q_calendar(c: Ctx):
    return CAL.with_calendar(_calendar_days(c), "day")


@register("infer_session")
def _q_infer_session(c: Ctx):
    ev = read_table(c.spark, c.sf_dir, "events", ["event_id", "ts"])
    ts = F.col("ts").cast("timestamp")
    return ev.select("event_id", ts.alias("event_time"), CAL.infer_session(ts).alias("session"))


@register("market_context")
def _q_market_context(c: Ctx):
    ev = read_table(c.spark, c.sf_dir, "events", ["event_id", "ts"])
    return CAL.market_context(ev.select("event_id", F.col("ts").cast("timestamp").alias("as_of")), "as_of")


@register("bars_to_events")
def _q_bars(c: Ctx):
    from tidemark.sources.ingest import bars_to_events
    return bars_to_events(load_bars(c.spark, c.sf_dir), AS_OF, 30, "1h")


# ------------------------------------------------------------------ news, cache, quality, metrics

from tidemark.operators import cache as CACHE  # noqa: E402
from tidemark.operators import news as NEWS  # noqa: E402
from tidemark.operators import quality as DQ  # noqa: E402
from tidemark.sources.fixtures import (load_articles, metric_events_from_events,  # noqa: E402
                                       request_logs_from_events)

CACHE_AS_OF = ["2024-01-10 15:00:00", "2024-01-10 03:00:00", "2024-01-13 15:00:00", "2024-01-15 15:00:00"]
INVALIDATE_TICKERS = ["AAPL", "MSFT", "NVDA"]


def _articles(c: Ctx) -> DataFrame:
    return NEWS.dedupe_articles(load_articles(c.spark, c.sf_dir))


def _enriched(c: Ctx) -> DataFrame:
    # several aggregates read the enriched articles: they are enriched once
    return NEWS.attach_cluster_counts(c.once("articles", lambda: NEWS.enrich_articles(_articles(c))))


def _cache(c: Ctx, with_summaries: bool = False) -> DataFrame:
    """Cache rows; counts and times need only the deduplicated articles, summaries the enriched ones."""
    if not with_summaries:
        return CACHE.build_cache(_articles(c), c.raw)
    enriched = _enriched(c)
    keys = ["ticker", "cache_date"]
    e2 = enriched.withColumn("cache_date", F.to_date("published_at"))
    metrics = NEWS.news_metrics(e2, keys=keys)
    summaries = NEWS.template_summary(metrics, NEWS.first_headlines(e2, 3, keys), keys=keys)
    return CACHE.build_cache(enriched, c.raw, summaries)


@register("article_dedupe")
def _q_article_dedupe(c: Ctx):
    return _articles(c).select("article_id", "fetch_batch", "article_key")


@register("article_entities")
def _q_article_entities(c: Ctx):
    a = _articles(c).withColumn("entity_text", NEWS._joined_text("title", "description"))
    return NEWS.top_entities(NEWS.entity_mentions(a, "entity_text"))


@register("topic_cluster")
def _q_topic_cluster(c: Ctx):
    low = _articles(c).select("article_id", F.lower(NEWS._joined_text("title", "description")).alias("_low"))
    return low.select("article_id", NEWS.topic_cluster(F.col("_low"), lowered=True).alias("cluster"))


@register("source_quality")
def _q_source_quality(c: Ctx):
    return _articles(c).select("article_id", "url", "source_name",
                               NEWS.source_quality(F.col("url"), F.col("source_name")).alias("source_quality_score"))


@register("impact_score")
def _q_impact(c: Ctx):
    return _enriched(c).select("article_id", "ticker", "cluster", "cluster_article_count", "source_quality_score",
                               "impact_score", "impact_label", F.size("entities").alias("entity_count"))


@register("news_metrics")
def _q_news_metrics(c: Ctx):
    from tidemark.sources.fixtures import FIXTURE_TICKERS
    tick = c.spark.createDataFrame([(t,) for t in FIXTURE_TICKERS], "ticker string")
    return NEWS.news_metrics(_enriched(c), tick)


def _page(c: Ctx) -> DataFrame:
    # metrics, prompts and headlines read the pages: they are cut out once
    return c.once("page", lambda: NEWS.provider_page(_enriched(c)).drop("_r"))


@register("summary_job")
def _q_summary_job(c: Ctx):
    # like the reference, one summary covers one provider page of articles
    page = _page(c)
    return NEWS.summary_job(NEWS.news_metrics(page, keys=NEWS.PAGE_KEYS), page)


@register("summary_ranked")
def _q_summary_ranked(c: Ctx):
    page = _page(c)
    return NEWS.summary_job(NEWS.news_metrics(page, keys=NEWS.PAGE_KEYS), page, "ranked", "sentence_rank")


@register("template_summary")
def _q_template_summary(c: Ctx):
    enriched = _enriched(c)
    return NEWS.template_summary(NEWS.news_metrics(enriched), NEWS.first_headlines(enriched))


@register("sentiment_over_time")
def _q_sentiment(c: Ctx):
    return CACHE.sentiment_over_time(CACHE.cache_articles(_enriched(c)), None, 30)


@register("latest_cache_row")
def _q_latest_cache(c: Ctx):
    r = CACHE.latest_cache_row(_cache(c))
    return r.select("ticker", "cache_date", "live_price", "live_volume", "live_event_time", "live_source",
                    "live_expires_at", "live_updated_at", "news_expires_at", "news_updated_at", "updated_at",
                    F.coalesce(F.col("article_count"), F.lit(0)).alias("article_count"))


@register("cache_status")
def _q_cache_status(c: Ctx):
    from tidemark.sources.fixtures import FIXTURE_TICKERS
    # every requested ticker, one of which was never cached
    asked = c.spark.createDataFrame([(t,) for t in [*FIXTURE_TICKERS, "NOSUCH"]], "ticker string")
    rows = asked.join(CACHE.latest_cache_row(_cache(c)), "ticker", "left")
    return CACHE.cache_status(rows, CACHE_AS_OF, list(CACHE.SCOPES))


QUOTE_AS_OF = "2024-01-30 21:00:00"
QUOTE_WINDOW_MIN = 60


def _provider_quotes(c: Ctx) -> DataFrame:
    """Live-provider answers at QUOTE_AS_OF: the latest trade of every ticker that traded in the
    hour before (tickers without a recent trade get no quote, as when the provider fails)."""
    from tidemark.plans.queries import latest_rows
    now = F.lit(QUOTE_AS_OF).cast("timestamp")
    recent = c.raw.filter((F.col("event_time") > now - F.expr(f"INTERVAL {QUOTE_WINDOW_MIN} MINUTES"))
                          & (F.col("event_time") <= now))
    return latest_rows(recent.select("ticker", "id", "price", "volume", "event_time"), "ticker",
                       ["event_time", "id"]).drop("id")


@register("resolve_quotes")
def _q_resolve(c: Ctx):
    profiles = c.sym.select("ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name")
    return CACHE.resolve_quotes(_provider_quotes(c), CACHE.latest_cache_row(_cache(c)), profiles, QUOTE_AS_OF)


@register("upsert")
def _q_upsert(c: Ctx):
    q = _provider_quotes(c)
    changes = q.select("ticker", F.to_date(F.lit(QUOTE_AS_OF)).alias("cache_date"), F.col("price").alias("live_price"),
                       F.col("volume").alias("live_volume"), F.col("event_time").alias("live_event_time"),
                       F.lit(CACHE.LIVE_PROVIDER_SOURCE).alias("live_source"),
                       (F.lit(QUOTE_AS_OF).cast("timestamp") + F.expr("INTERVAL 15 MINUTES")).alias("live_expires_at"),
                       F.lit(QUOTE_AS_OF).cast("timestamp").alias("live_updated_at"))
    up = CACHE.upsert(_cache(c), changes, CACHE.KEYS, CACHE.LIVE_COLUMNS, "updated_at", QUOTE_AS_OF)
    return up.select("ticker", "cache_date", *CACHE.LIVE_COLUMNS, "news_updated_at", "updated_at")


@register("invalidate")
def _q_invalidate(c: Ctx):
    t = c.spark.createDataFrame([(x,) for x in INVALIDATE_TICKERS], "ticker string")
    inv = CACHE.invalidate(_cache(c, with_summaries=True), t, ["live", "news_summary"], AS_OF)
    return inv.select("ticker", "cache_date", *CACHE.LIVE_COLUMNS, "news_summary_expires_at", "news_updated_at",
                      "updated_at", F.col("news_summary").isNull().alias("summary_cleared"))


@register("dq_checks")
def _q_dq(c: Ctx):
    return DQ.run_checks(c.raw, materialized(c.daily, "daily"), AS_OF)


@register("dq_duplicates")
def _q_dq_dups(c: Ctx):
    valid, _ = split_valid(c.checked)
    return DQ.duplicate_groups(valid)


@register("lineage")
def _q_lineage(c: Ctx):
    daily, hourly = materialized(c.daily, "daily"), materialized(c.hourly, "hourly")
    marts = {"daily_stock_summary": daily, "intraday_stock_rollup": hourly,
             "stock_drawdown_recovery": M.stock_drawdown_recovery(daily),
             "stock_risk_indicators": M.stock_risk_indicators(daily),
             "sector_daily_summary": M.sector_daily_summary(daily),
             "benchmark_relative_strength": M.benchmark_relative_strength(daily),
             "market_regime_summary": M.market_regime_summary(daily),
             "stock_anomaly_history": M.stock_anomaly_history(daily),
             "stock_signal_feature_store": M.signal_feature_store(daily, AS_OF)}
    return DQ.lineage_many(c.raw, marts, AS_OF, "stock_prices")


def _events(c: Ctx) -> DataFrame:
    return read_table(c.spark, c.sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])


@register("metrics_rollup")
def _q_metrics(c: Ctx):
    return DQ.rollup_metrics(metric_events_from_events(_events(c)))


@register("request_log_metrics")
def _q_request_logs(c: Ctx):
    return DQ.rollup_metrics(DQ.request_log_metrics(request_logs_from_events(_events(c))))


@register("metric_samples")
def _q_metric_samples(c: Ctx):
    return DQ.metric_samples(DQ.rollup_metrics(DQ.request_log_metrics(request_logs_from_events(_events(c)))))


# ------------------------------------------------------------------ streaming (run to completion)
import uuid as _uuid  # noqa: E402

from tidemark.session import scratch_path  # noqa: E402
from tidemark.streaming import jobs as STREAM  # noqa: E402


def _event_stream(c: Ctx) -> DataFrame:
    from tidemark.sources.tables import table_path
    schema = c.spark.read.parquet(table_path(c.sf_dir, "events")).schema
    return c.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(c.sf_dir)


@register("stream_ingest")
def _q_stream_ingest(c: Ctx):
    from tidemark.sources.fixtures import raw_messages_from_events
    run = scratch_path(c.spark, f"stream-ingest-{_uuid.uuid4().hex}")
    q = STREAM.ingest_stream(raw_messages_from_events(_event_stream(c)), f"{run}/events", f"{run}/dead",
                             f"{run}/_checkpoint")
    q.awaitTermination()
    return c.spark.read.parquet(f"{run}/events").select(*EVENT_COLUMNS)


@register("stream_hourly_bars")
def _q_stream_bars(c: Ctx):
    from tidemark.sources.fixtures import stock_prices_from_events
    run = scratch_path(c.spark, f"stream-bars-{_uuid.uuid4().hex}")
    ev = stage_stock_prices(stock_prices_from_events(_event_stream(c)))
    q = STREAM.stream_hourly_bars(ev, f"{run}/bars", f"{run}/_checkpoint")
    q.awaitTermination()
    return STREAM.current_bars(c.spark, f"{run}/bars")



@register("append_events_stored")
def _q_append_stored(c: Ctx):
    """Two appends to one table, the second with everything: what is stored already is not stored again."""
    run = scratch_path(c.spark, f"append-{_uuid.uuid4().hex}")
    valid, _ = split_valid(materialized(c.checked, "checked"))
    append_events(valid.where(F.pmod(F.xxhash64("ticker", "event_time"), F.lit(2)) == 0), run, c.spark)
    append_events(valid, run, c.spark)
    return c.spark.read.parquet(run).select(*EVENT_COLUMNS)


def _two_batches(c: Ctx, run: str):
    """Every other event first, then the rest (late for its days); after each, the (ticker, trade date) keys it touched."""
    from tidemark.sources.sinks import event_date
    raw = c.raw.withColumn("event_date", event_date())
    for batch in (0, 1):
        part = raw.where(F.pmod("id", F.lit(2)) == batch)
        part.write.mode("append").partitionBy("event_date").parquet(f"{run}/events")
        yield batch, stage_stock_prices(part).where("market_session <> 'closed'").select(
            "ticker", CAL.ny_date(F.col("event_time")).alias("trade_date")).distinct()


@register("incremental_daily")
def _q_incremental_daily(c: Ctx):
    """The daily mart after two refreshes."""
    run = scratch_path(c.spark, f"refresh-{_uuid.uuid4().hex}")
    for batch, touched in _two_batches(c, run):
        STREAM.refresh_marts_batch(c.spark, touched, f"{run}/events", c.sym, f"{run}/daily", f"{run}/staging/{batch}")
    return c.spark.read.parquet(f"{run}/daily").select(*Q.DAILY_COLUMNS)


@register("stream_alerts")
def _q_stream_alerts(c: Ctx):
    """The alerts that stand after two refreshes, as the sum of what each emitted."""
    run = scratch_path(c.spark, f"alerts-{_uuid.uuid4().hex}")
    for batch, touched in _two_batches(c, run):
        done = STREAM.refresh_marts_batch(c.spark, touched, f"{run}/events", c.sym, f"{run}/daily", f"{run}/staging/{batch}")
        STREAM.emit_alerts(c.spark, done.differing, c.watch, c.sym, f"{run}/alerts", str(batch))
    return STREAM.current_alerts(c.spark, f"{run}/alerts")


@register("correlation_topk")
def _q_correlation_topk(c: Ctx):
    from tidemark.operators.correlation import best_partners
    return best_partners(c.daily, 8)


@register("stock_drawdown_segmented")
def _q_drawdown_segmented(c: Ctx):
    return M.segmented_drawdown(c.daily)


@register("metrics_stream")
def _q_metrics_stream(c: Ctx):
    from tidemark.sources.fixtures import metric_events_from_events
    run = scratch_path(c.spark, f"metrics-{_uuid.uuid4().hex}")
    STREAM.metrics_stream(metric_events_from_events(_event_stream(c)), f"{run}/metrics", f"{run}/_checkpoint").awaitTermination()
    return STREAM.current_metrics(c.spark, f"{run}/metrics")


@register("article_content")
def _q_article_content(c: Ctx):
    from tidemark.sources.fixtures import pages_text
    pages = pages_text(read_table(c.spark, c.sf_dir, "pages", ["page_id", "html"]))
    return NEWS.article_content(_articles(c), pages).select("article_id", "url", "content")


# ------------------------------------------------------------------ more operators
@register("sentiment_score")
def _q_sentiment_score(c: Ctx):
    a = _articles(c)
    return a.select("article_id", NEWS.sentiment_score(NEWS._joined_text("title", "description")).alias("score"))


@register("sentiment_learned")
def _q_sentiment_learned(c: Ctx):
    from tidemark.operators.sentiment import induce_lexicon, scoped_score
    a = c.once("texts", lambda: _articles(c).select("article_id", NEWS._joined_text("title", "description").alias("text")))
    return scoped_score(a, induce_lexicon(a))


NEWS_AS_OF = "2024-01-10 15:00:00"
NEWS_WINDOW_DAYS = 2


def _provider_news(c: Ctx) -> DataFrame:
    """News-provider answers at NEWS_AS_OF: tickers with articles published in the two days before
    (the count of such articles); the others get nothing back."""
    now = F.lit(NEWS_AS_OF).cast("timestamp")
    e = _articles(c).filter((F.col("published_at") > now - F.make_interval(days=F.lit(NEWS_WINDOW_DAYS)))
                            & (F.col("published_at") <= now))
    return e.groupBy("ticker").agg(F.count(F.lit(1)).alias("article_count"))


@register("resolve_news")
def _q_resolve_news(c: Ctx):
    latest = CACHE.latest_cache_row(_cache(c))
    return NEWS.resolve_news(_provider_news(c), latest, NEWS_AS_OF)


SUMMARY_AS_OF = "2024-01-30 14:00:00"


def _fresh_summaries(c: Ctx) -> tuple[DataFrame, DataFrame]:
    """Articles of the two days before SUMMARY_AS_OF, and their template summary per ticker."""
    now = F.lit(SUMMARY_AS_OF).cast("timestamp")
    recent = _enriched(c).filter((F.col("published_at") > now - F.make_interval(days=F.lit(NEWS_WINDOW_DAYS)))
                                 & (F.col("published_at") <= now))
    metrics = NEWS.news_metrics(recent)
    made = NEWS.template_summary(metrics, NEWS.first_headlines(recent)).join(metrics.select("ticker", "article_count"), "ticker")
    return recent, made


@register("resolve_news_summary")
def _q_resolve_news_summary(c: Ctx):
    rows = _cache(c, with_summaries=True).where("news_summary IS NOT NULL")
    return NEWS.resolve_news_summary(CACHE.latest_cache_row(rows), _fresh_summaries(c)[1], SUMMARY_AS_OF)


@register("upsert_news")
def _q_upsert_news(c: Ctx):
    recent, made = _fresh_summaries(c)
    children = CACHE.cache_articles(_enriched(c))
    cache, articles = CACHE.upsert_news(_cache(c, with_summaries=True), children, recent, made, SUMMARY_AS_OF)
    stored = articles.groupBy(*CACHE.KEYS).agg(F.count(F.lit(1)).alias("stored_articles"))
    return cache.join(stored, CACHE.KEYS, "left").select(
        *CACHE.KEYS, "article_count", "news_summary", "summary_source", "news_expires_at", "news_summary_expires_at",
        "news_updated_at", "updated_at", F.coalesce("stored_articles", F.lit(0)).alias("stored_articles"))


@register("refresh")
def _q_refresh(c: Ctx):
    t = c.spark.createDataFrame([(x,) for x in INVALIDATE_TICKERS], "ticker string")
    cache = _cache(c)
    new_cache, res = CACHE.refresh(cache, t, ["live"], QUOTE_AS_OF, provider_quotes=_provider_quotes(c))
    return new_cache.select("ticker", "cache_date", *CACHE.LIVE_COLUMNS, "updated_at")


@register("backfill")
def _q_backfill(c: Ctx):
    from tidemark.sources.ingest import backfill
    return backfill(load_bars(c.spark, c.sf_dir), AS_OF, session_vocab="mapped")


@register("snapshots_to_events")
def _q_snapshots(c: Ctx):
    from tidemark.sources.ingest import snapshots_to_events
    q = c.raw.select("ticker", F.col("price").alias("last_price"), F.col("volume").alias("last_volume"), "event_time")
    return snapshots_to_events(q)


@register("search_rows")
def _q_search(c: Ctx):
    from tidemark.operators.staging import search_rows
    return search_rows(c.daily, "tech", ["ticker", "company_name", "sector", "benchmark_ticker", "benchmark_name",
                                        "anomaly_flag"])


@register("sort_rows")
def _q_sort(c: Ctx):
    return Q.sort_rows(c.daily, "volume_vs_avg_ratio", "desc", ["ticker", "trade_date"])


@register("move_class")
def _q_move_class(c: Ctx):
    return c.daily.select("ticker", "trade_date", Q.move_class(F.col("price_change_pct")).alias("move_class"),
                          Q.sentiment_label(F.col("relative_price_change_pct") / 10).alias("relative_label"))


@register("triggered_alerts")
def _q_triggered(c: Ctx):
    return Q.triggered_alerts(Q.watchlist_state(c.watch, c.daily))


@register("quick_tickers")
def _q_quick(c: Ctx):
    return Q.quick_tickers(c.daily, 5)


@register("focus_ticker")
def _q_focus(c: Ctx):
    return Q.focus_ticker(M.stock_anomaly_history(c.daily), FOCUS_TICKER)


@register("attach_symbol_meta")
def _q_attach_meta(c: Ctx):
    return SYM.attach_symbol_meta(c.raw.select("id", "ticker"), c.sym)


@register("prune_retention")
def _q_prune(c: Ctx):
    from tidemark.sources.sinks import prune_retention
    _, invalid = split_valid(c.checked)
    return prune_retention(dead_letters(invalid), "created_at", 7, AS_OF)


@register("invalidate_all")
def _q_invalidate_all(c: Ctx):
    t = c.spark.createDataFrame([(x,) for x in INVALIDATE_TICKERS], "ticker string")
    inv = CACHE.invalidate(_cache(c), t, list(CACHE.SCOPES), AS_OF)
    return inv.select("ticker", "cache_date", "live_price", "news_updated_at", "updated_at")


@register("dq_not_null")
def _q_not_null(c: Ctx):
    return DQ.not_null_counts(c.daily, Q.DAILY_COLUMNS)


@register("stale_fallback_total")
def _q_stale_total(c: Ctx):
    return DQ.stale_fallback_total(DQ.rollup_metrics(metric_events_from_events(_events(c))))


@register("latest_by_ticker")
def _q_latest_by_ticker(c: Ctx):
    return Q.latest_by_ticker(c.daily)


@register("cluster_distribution")
def _q_clusters(c: Ctx):
    a = _articles(c).withColumn("cluster", NEWS.topic_cluster(NEWS._joined_text("title", "description")))
    return NEWS.cluster_distribution(a, "fetch_batch")


@register("valid_tickers")
def _q_valid_tickers(c: Ctx):
    from tidemark.operators.staging import valid_tickers
    return valid_tickers(load_symbol_requests(c.spark, c.sf_dir), "raw_symbol")


@register("mart_data_tests")
def _q_mart_data_tests(c: Ctx):
    daily, hourly = materialized(c.daily, "daily"), materialized(c.hourly, "hourly")
    tables = {"stg_stock_prices": c.stg, "stg_symbol_reference": c.sym, "daily_stock_summary": daily,
              "intraday_stock_rollup": hourly, "stock_drawdown_recovery": M.stock_drawdown_recovery(daily),
              "stock_risk_indicators": M.stock_risk_indicators(daily),
              "sector_daily_summary": M.sector_daily_summary(daily),
              "benchmark_relative_strength": M.benchmark_relative_strength(daily),
              "market_regime_summary": M.market_regime_summary(daily),
              "stock_anomaly_history": M.stock_anomaly_history(daily),
              "stock_signal_feature_store": M.signal_feature_store(daily, AS_OF)}
    return DQ.data_tests(tables)
