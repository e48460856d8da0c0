"""Mapping of the driver's generic tables onto the market-data model (see FIXTURES.md).

All mappings are column expressions over the driver tables, so their cost grows with the
tables and every registered query works on whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import infer_session
from tidemark.functions.numeric import event_order_key
from tidemark.sources.symbols import SYMBOL_SEED
from tidemark.sources.tables import read_table

# Fixture ticker list, indexed by event_id % 22 (the last two are unknown
# to the symbol dimension on purpose).
FIXTURE_TICKERS = ["AAPL", "MSFT", "NVDA", "AMD", "INTC", "GOOGL", "META", "NFLX", "AMZN", "TSLA",
                   "JPM", "BAC", "XOM", "CVX", "SPY", "XLK", "XLC", "XLY", "XLF", "XLE", "ZZY", "ZZZ"]

# Article keywords by doc_id % 13, rated domains by doc_id % 12 (10 rated, one
# unrated, one NULL url).
ARTICLE_KEYWORDS = ["earnings", "guidance", "upgrade", "merger", "lawsuit", "launch", "chip",
                    "inflation", "regulator", "partnership", "Apple", "press release", "none"]
ARTICLE_DOMAINS = ["reuters.com", "bloomberg.com", "wsj.com", "ft.com", "cnbc.com", "marketwatch.com",
                   "finance.yahoo.com", "seekingalpha.com", "benzinga.com", "fool.com",
                   "example-news.net", None]


def _pick(items: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (index + 1).cast("int"))


# Skew scenario: the share of all events given to one hot ticker.
HOT_TICKER, HOT_SHARE_DENOMINATOR = "AAPL", 3


def fixture_ticker(event_id: Column, scale_tickers: bool = False, user_id: Column | None = None,
                   hot_ticker: bool = False) -> Column:
    t = _pick(FIXTURE_TICKERS, F.pmod(event_id, F.lit(len(FIXTURE_TICKERS))))
    if hot_ticker:
        # a third of all events (on top of its normal share) belong to one ticker
        t = F.when(F.pmod(F.xxhash64(event_id), F.lit(HOT_SHARE_DENOMINATOR)) == 0, F.lit(HOT_TICKER)).otherwise(t)
    if scale_tickers and user_id is not None:
        # Bench variant: half of the rows go to per-user tickers, so window partitions grow.
        return F.when(F.pmod(event_id, F.lit(2)) == 1, F.concat(F.lit("T"), user_id.cast("string"))).otherwise(t)
    return t


def stock_prices_from_events(events: DataFrame, scale_tickers: bool = False, hot_ticker: bool = False) -> DataFrame:
    """events → raw ``stock_prices`` rows (FIXTURES.md 2.1).

    ``ts`` is a wall-clock TIMESTAMP_NTZ in the file; it is read as a UTC instant.
    """
    ts = F.col("ts").cast("timestamp")
    eid = F.col("event_id")
    price = F.round(F.lit(100) + F.col("value") / 25, 2).cast("decimal(10,2)")
    k = F.get_json_object("props", "$.k").cast("bigint")
    spike = F.when(F.pmod(F.dayofmonth(ts) + F.pmod(eid, F.lit(22)), F.lit(9)) == 0, 8).otherwise(1)
    has_ohlc = F.pmod(eid, F.lit(3)) != 0
    dec = lambda c: c.cast("decimal(10,2)")
    return events.select(
        eid.alias("id"),
        fixture_ticker(eid, scale_tickers, F.col("user_id"), hot_ticker).alias("ticker"),
        price.alias("price"),
        ((F.lit(100) + k * 100) * spike).cast("bigint").alias("volume"),
        ts.alias("event_time"),
        F.lit("fixture").alias("source"),
        F.when(has_ohlc, price).cast("decimal(10,2)").alias("open_price"),
        F.when(has_ohlc, dec(price + F.lit(0.05).cast("decimal(3,2)"))).alias("high_price"),
        F.when(has_ohlc, dec(price - F.lit(0.05).cast("decimal(3,2)"))).alias("low_price"),
        F.when(has_ohlc, price).cast("decimal(10,2)").alias("close_price"),
        F.lit("live_snapshot").alias("event_kind"),
        F.lit("snapshot").alias("bar_interval"),
        infer_session(ts).alias("market_session"),
        (ts + F.expr("INTERVAL 5 SECONDS")).alias("inserted_at"),
    )


def load_stock_prices(spark: SparkSession, sf_dir: str, scale_tickers: bool = False,
                      hot_ticker: bool = False) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value", "props"])
    return stock_prices_from_events(ev, scale_tickers, hot_ticker)


def watchlists_from_customers(customer: DataFrame, created_at: str = "2024-01-01 00:00:00") -> DataFrame:
    """customer → dashboard watchlists (FIXTURES.md 2.4); distinct on (principal, ticker)."""
    key = F.col("c_custkey")
    ts = F.lit(created_at).cast("timestamp")
    rows = customer.select(
        F.concat(F.lit("p"), F.pmod(key, F.lit(50)).cast("string")).alias("principal_id"),
        _pick(FIXTURE_TICKERS, F.pmod(key, F.lit(22))).alias("ticker"),
        (F.lit(1) + F.pmod(key, F.lit(6))).cast("decimal(10,2)").alias("price_alert_threshold"),
        (F.lit(1) + F.pmod(key, F.lit(4)) / 2).cast("decimal(10,2)").alias("volume_alert_threshold"),
        key,
    )
    # Several customers map to one (principal, ticker): keep the smallest customer key.
    first = rows.groupBy("principal_id", "ticker").agg(
        F.min_by(F.struct("price_alert_threshold", "volume_alert_threshold"), F.col("c_custkey")).alias("t"))
    return first.select("principal_id", "ticker", "t.price_alert_threshold", "t.volume_alert_threshold",
                        ts.alias("created_at"), ts.alias("updated_at"))


def load_watchlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlists_from_customers(read_table(spark, sf_dir, "customer", ["c_custkey"]))


# Session names of the calendar mapped to the validator's vocabulary.
SESSION_TO_VALIDATOR = {"premarket": "pre", "after_hours": "post", "regular": "regular", "closed": "closed"}


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def raw_messages_from_events(events: DataFrame) -> DataFrame:
    """events → JSON messages of the price topic with injected faults (FIXTURES.md 2.2).

    Fault kind by ``event_id % 50``: 1 missing price · 2 empty ticker · 3 12-letter ticker ·
    4 price −1 · 5 price "NaN" · 6 price "12.345" (valid) · 7 volume −5 · 8 volume "12.5" ·
    9 volume 12.7 (valid) · 10 time without offset · 11 time "yesterday" · 12 time with Z (valid) ·
    13 unknown kind · 14 interval "1h" · 15 session "premarket" · 16 high < close · 17 low > open ·
    18 only open present (valid) · 19 not an object · 20 broken JSON · 21 message delivered twice ·
    22 source "" (valid) · 23 ticker null · 24 volume "Infinity".
    Returns (topic, partition, offset, value, timestamp) like a Kafka source.
    """
    sp = stock_prices_from_events(events)
    k = F.pmod(F.col("id"), F.lit(50))
    price = F.col("price").cast("string")
    plus = lambda d: (F.col("price") + F.lit(d).cast("decimal(4,2)")).cast("string")
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    has = F.col("open_price").isNotNull()
    sess_map = F.create_map(*[F.lit(x) for kv in SESSION_TO_VALIDATOR.items() for x in kv])
    fields = [
        ("ticker", F.when(k == 2, F.lit('""')).when(k == 3, F.lit('"ABCDEFGHIJKL"')).when(k == 23, F.lit("null"))
         .otherwise(_q(F.col("ticker"))), None),
        ("price", F.when(k == 4, F.lit("-1")).when(k == 5, F.lit('"NaN"')).when(k == 6, F.lit('"12.345"'))
         .otherwise(price), k == 1),
        ("volume", F.when(k == 7, F.lit("-5")).when(k == 8, F.lit('"12.5"')).when(k == 9, F.lit("12.7"))
         .when(k == 24, F.lit('"Infinity"')).otherwise(F.col("volume").cast("string")), None),
        ("event_time", F.when(k == 10, _q(iso)).when(k == 11, F.lit('"yesterday"'))
         .when(k == 12, _q(F.concat(iso, F.lit("Z")))).otherwise(_q(F.concat(iso, F.lit("+00:00")))), None),
        ("source", F.when(k == 22, F.lit('""')).otherwise(F.lit('"fixture"')), None),
        ("open_price", F.when(k.isin(16, 17, 18), price).when(has, price).otherwise(F.lit("null")), None),
        ("high_price", F.when(k == 16, plus("-0.50")).when(k == 17, plus("0.50")).when(has, plus("0.05"))
         .otherwise(F.lit("null")), k == 18),
        ("low_price", F.when(k == 16, plus("-0.60")).when(k == 17, plus("0.10")).when(has, plus("-0.05"))
         .otherwise(F.lit("null")), k == 18),
        ("close_price", F.when(k.isin(16, 17), price).when(has, price).otherwise(F.lit("null")), k == 18),
        ("event_kind", F.when(k == 13, F.lit('"tick"')).otherwise(F.lit('"live_snapshot"')), None),
        ("bar_interval", F.when(k == 14, F.lit('"1h"')).otherwise(F.lit('"snapshot"')), None),
        ("market_session", F.when(k == 15, F.lit('"premarket"'))
         .otherwise(_q(F.element_at(sess_map, F.col("market_session")))), None),
    ]
    parts = []
    for name, val, omit in fields:
        pair = F.concat(F.lit(f'"{name}": '), val)
        parts.append(F.when(omit, F.lit(None)).otherwise(pair) if omit is not None else pair)
    body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    value = (F.when(k == 19, F.lit("[1]"))
             .when(k == 20, F.concat(F.lit('{"ticker": "'), F.col("ticker"), F.lit('", "price": ')))
             .otherwise(body))
    copies = F.explode(F.when(k == 21, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return sp.select("id", "event_time", value.alias("value"), copies.alias("_copy")).select(
        F.lit("stock_prices").alias("topic"),
        F.pmod(F.col("id"), F.lit(4)).cast("int").alias("partition"),
        (F.col("id") * 2 + F.col("_copy")).alias("offset"),
        "value",
        (F.col("event_time") + F.expr("INTERVAL 1 SECOND")).alias("timestamp"),
    )


def load_raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value", "props"])
    return raw_messages_from_events(ev)


# Strings users type for symbols, plus three unknown ones (a rule over the symbol catalog).
UNKNOWN_SYMBOLS = ["ZZY", "Unknown Holdings", ""]


def symbol_requests(customer: DataFrame) -> DataFrame:
    """customer → (c_custkey, raw_symbol): catalog strings in three spellings (as is, lower, padded)."""
    from tidemark.functions.symbols import symbol_candidates
    cands = symbol_candidates() + UNKNOWN_SYMBOLS
    key = F.col("c_custkey")
    x = _pick(cands, F.pmod(F.floor(key / 3), F.lit(len(cands))))
    variant = F.pmod(key, F.lit(3))
    raw = F.when(variant == 1, F.lower(x)).when(variant == 2, F.concat(F.lit("  "), x, F.lit(" "))).otherwise(x)
    return customer.select(key, raw.alias("raw_symbol"))


def load_symbol_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_requests(read_table(spark, sf_dir, "customer", ["c_custkey"]))


def bars_from_events(events: DataFrame) -> DataFrame:
    """events → daily OHLCV bars per ticker (UTC day, naive time), with faults (FIXTURES.md 2.4):
    NULL close on days ≡ 0 mod 7, open 0 on days ≡ 0 mod 5, NULL volume on days ≡ 0 mod 6."""
    sp = stock_prices_from_events(events)
    day = F.to_date("event_time")
    key = event_order_key()
    b = sp.groupBy("ticker", day.alias("day")).agg(
        F.min_by("price", key).alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"),
        F.max_by("price", key).alias("Close"), F.sum("volume").alias("Volume"))
    dom = F.dayofmonth("day")
    return b.select(
        "ticker", F.col("day").cast("timestamp_ntz").alias("ts"),
        F.when(dom % 5 == 0, F.lit(0).cast("decimal(10,2)")).otherwise(F.col("Open")).alias("Open"),
        "High", "Low",
        F.when(dom % 7 == 0, F.lit(None).cast("decimal(10,2)")).otherwise(F.col("Close")).alias("Close"),
        F.when(dom % 6 == 0, F.lit(None).cast("bigint")).otherwise(F.col("Volume")).alias("Volume"))


def load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value", "props"])
    return bars_from_events(ev)


def article_ticker(doc_id: Column) -> Column:
    return _pick(FIXTURE_TICKERS[:20], F.pmod(doc_id, F.lit(20)))


def article_text(doc_id: Column, text: Column) -> Column:
    """A document's whole text as article text; every 7th one names its company, every 11th its ticker."""
    names = {t: name for t, name, *_ in SYMBOL_SEED}
    company = _pick([names[t] for t in FIXTURE_TICKERS[:20]], F.pmod(doc_id, F.lit(20)))
    mention = F.when(F.pmod(doc_id, F.lit(7)) == 0, F.concat(F.lit("Shares of "), company)) \
        .when(F.pmod(doc_id, F.lit(11)) == 0, F.concat(F.lit("more on "), F.lower(article_ticker(doc_id))))
    return F.concat_ws(" ", F.coalesce(text, F.lit("")), mention)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """documents → news article rows (FIXTURES.md 2.3, over whole texts).

    title = keyword + first 8 words, description = all the rest, url on a rated / unrated / missing domain, press-release source every 17th article, published over 30 days, a
    deterministic sentiment; one fetch batch per (ticker, publication day), arrival = doc_id.
    """
    did = F.col("doc_id")
    # columns of their own: the text is gone through once, however many expressions read them
    documents = documents.withColumn("_words", F.trim(F.regexp_replace(article_text(did, F.col("text")), r" \s+|[\t\n\x0B\f\r]\s*", " "))) \
        .withColumn("_lead", F.regexp_extract("_words", r"^((?:\S+ ){0,7}\S+)", 1))
    words, lead = F.col("_words"), F.col("_lead")
    kw = _pick(ARTICLE_KEYWORDS, F.pmod(did, F.lit(len(ARTICLE_KEYWORDS))))
    kw = F.when(kw == "none", F.lit(None)).otherwise(kw)
    domain = _pick(ARTICLE_DOMAINS, F.pmod(did, F.lit(len(ARTICLE_DOMAINS))))
    published = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(13), F.lit(0), F.lit(0)) \
        + F.make_interval(days=F.pmod(did, F.lit(30)).cast("int"))
    ticker = article_ticker(did)
    return documents.select(
        did.alias("article_id"), ticker.alias("ticker"),
        F.concat(ticker, F.lit(":"), F.date_format(published, "yyyy-MM-dd")).alias("fetch_batch"),
        did.alias("position"),
        F.concat_ws(" ", kw, lead).alias("title"),
        F.trim(F.substr(words, F.length(lead) + 1)).alias("description"),
        F.when(domain.isNotNull(), F.concat(F.lit("https://www."), domain, F.lit("/news/"), did.cast("string")))
        .alias("url"),
        published.alias("published_at"),
        F.when(F.pmod(did, F.lit(17)) == 0, F.lit("Press Release Wire")).otherwise(F.col("source")).alias("source_name"),
        F.round((F.pmod(did * 37, F.lit(201)) - 100) / 100, 2).alias("sentiment"),
    )


def load_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return articles_from_documents(docs)


def pages_text(pages: DataFrame) -> DataFrame:
    """pages → (page_id, page_text): HTML without tags, whitespace collapsed (article bodies)."""
    txt = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"<[^>]*>", " "), r"\s+", " ")
    return pages.select("page_id", F.trim(txt).alias("page_text"))


# Fixed rule: HTTP method per event type of the driver's event table (request-log fixture).
EVENT_METHODS = {"view": "GET", "click": "POST", "purchase": "POST", "signup": "PUT", "error": "DELETE"}
METRIC_KINDS = ["counter", "gauge", "timing"]


def request_logs_from_events(events: DataFrame) -> DataFrame:
    """events → structured request logs (FIXTURES.md 2.4): status 500 every 20th request; every 33rd request
    raised and has no response (no status)."""
    methods = F.create_map(*[F.lit(x) for kv in EVENT_METHODS.items() for x in kv])
    return events.select(
        F.col("event_id").alias("request_id"), F.coalesce(F.element_at(methods, F.col("event_type")), F.lit("GET"))
        .alias("method"), F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(F.pmod("event_id", F.lit(33)) == 7, F.lit(None)).when(F.pmod("event_id", F.lit(20)) == 0, 500).otherwise(200)
        .cast("int").alias("status_code"),
        F.col("value").alias("duration_ms"), F.col("user_id").cast("string").alias("client_host"),
        F.col("ts").cast("timestamp").alias("ts"))


def metric_events_from_events(events: DataFrame) -> DataFrame:
    """events → metric events (name, kind, value, ts, seq): kind by event_id % 3; every 12th one counts a stale
    answer."""
    kind = _pick(METRIC_KINDS, F.pmod("event_id", F.lit(3)))
    return events.select(
        F.when(F.pmod("event_id", F.lit(12)) == 0, F.concat(F.lit("api.stale_fallback."), F.col("event_type")))
        .otherwise(F.concat(F.lit("api.request."), F.col("event_type"))).alias("name"), kind.alias("kind"),
        F.when(kind == "counter", F.lit(1)).otherwise(F.round(F.col("value"), 2)).cast("decimal(20,2)").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
