"""SRC-1…4, SRC-7: price-event sources.

* ``read_price_stream`` subscribes to the topic from the earliest offset: Kafka when its connector is on the
  classpath, the partitioned message log of ``topic_log``, or a directory of JSON-lines files.
* ``snapshots_to_events`` / ``bars_to_events`` turn quote and bar tables into events, with
  the session from the calendar and the symbol profile columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import infer_session
from tidemark.functions.symbols import normalize_ticker, symbol_profile
from tidemark.sources.tables import EVENT_COLUMNS

MESSAGE_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Sources and kinds written by the producers.
SNAPSHOT_SOURCE = "yfinance"
HISTORY_SOURCE = "yfinance_history"
PROFILE_COLUMNS = ["company_name", "sector", "benchmark_ticker", "benchmark_name"]


def read_price_stream(spark: SparkSession, source: str = "kafka", topic: str = "stock_prices",
                      path: str | None = None, **opts) -> DataFrame:
    """SRC-1: the price topic as a streaming frame (topic, partition, offset, value, timestamp).

    ``source="kafka"`` needs ``kafka.bootstrap.servers`` in ``opts``; ``source="log"`` reads the topic's message
    log under ``path`` (``opts``: startingOffsets, groupId …); ``source="files"`` JSON lines with the message
    columns.
    """
    if source == "log":
        from tidemark.sources.topic_log import register
        register(spark)
        return spark.readStream.format("topic_log").options(path=path, topic=topic, **opts).load()
    if source == "kafka":
        r = (spark.readStream.format("kafka").option("subscribe", topic)
             .option("startingOffsets", "earliest"))
        for k, v in opts.items():
            r = r.option(k, v)
        return r.load().select("topic", "partition", "offset", F.col("value").cast("string").alias("value"),
                               "timestamp")
    r = spark.readStream.schema(MESSAGE_SCHEMA)
    for k, v in opts.items():
        r = r.option(k, v)
    return r.json(path)


def parse_event_json(messages: DataFrame, value_col: str = "value", out: str = "event") -> DataFrame:
    """SRC-2: bytes/text → parsed object (VARIANT, NULL when the text is not JSON)."""
    return messages.withColumn(out, F.try_parse_json(F.col(value_col).cast("string")))


def _with_profile(df: DataFrame) -> DataFrame:
    prof = symbol_profile(df.withColumnRenamed("ticker", "_sym"), "_sym", normalize=False)
    return prof.drop("_sym", "benchmark_kind", "aliases", "is_benchmark").withColumnRenamed("canonical_ticker", "ticker")


def snapshots_to_events(quotes: DataFrame) -> DataFrame:
    """SRC-3: quote rows (ticker, last_price, last_volume, event_time) → ``live_snapshot`` events."""
    q = normalize_ticker(quotes, "ticker", "_t").drop("ticker").withColumnRenamed("_t", "ticker")
    price = F.round(F.col("last_price").cast("decimal(38,10)"), 2).cast("decimal(10,2)")
    ev = q.select(
        "ticker", price.alias("price"), F.coalesce(F.col("last_volume").cast("bigint"), F.lit(0)).alias("volume"),
        F.col("event_time").cast("timestamp").alias("event_time"), F.lit(SNAPSHOT_SOURCE).alias("source"),
        price.alias("open_price"), price.alias("high_price"), price.alias("low_price"), price.alias("close_price"),
        F.lit("live_snapshot").alias("event_kind"), F.lit("snapshot").alias("bar_interval"),
        infer_session(F.col("event_time").cast("timestamp")).alias("market_session"))
    return _with_profile(ev)


def bars_to_events(bars: DataFrame, as_of: str, lookback_days: int = 30, interval: str = "1h") -> DataFrame:
    """SRC-4: OHLCV bars (ticker, ts, Open, High, Low, Close, Volume) → ``historical_bar`` events.

    A naive bar time is UTC; bars older than ``lookback_days`` before ``as_of`` or without a close
    are dropped; an open/high/low that is NULL *or 0* falls back to the close (Q18); NULL volume → 0.
    """
    ts = F.col("ts").cast("timestamp")
    earliest = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(lookback_days))
    close = F.round(F.col("Close").cast("decimal(38,10)"), 2)

    def fb(c: str):
        return F.round(F.coalesce(F.nullif(F.col(c).cast("decimal(38,10)"), F.lit(0)),
                                  F.col("Close").cast("decimal(38,10)")), 2).cast("decimal(10,2)")

    t = normalize_ticker(bars, "ticker", "_t").drop("ticker").withColumnRenamed("_t", "ticker")
    ev = t.filter((ts >= earliest) & F.col("Close").isNotNull()).select(
        "ticker", close.cast("decimal(10,2)").alias("price"),
        F.coalesce(F.col("Volume").cast("bigint"), F.lit(0)).alias("volume"), ts.alias("event_time"),
        F.lit(HISTORY_SOURCE).alias("source"), fb("Open").alias("open_price"), fb("High").alias("high_price"),
        fb("Low").alias("low_price"), close.cast("decimal(10,2)").alias("close_price"),
        F.lit("historical_bar").alias("event_kind"), F.lit(interval).alias("bar_interval"),
        infer_session(ts).alias("market_session"))
    return _with_profile(ev)


def backfill(bars: DataFrame, as_of: str, tickers: list[str] | None = None, target_path: str | None = None,
             lookback_days: int = 30, interval: str = "1h", session_vocab: str = "strict",
             dead_letter_path: str | None = None) -> DataFrame:
    """SRC-7: replay bars (all or some tickers) through validation and the idempotent append.

    Good events go to ``target_path``, rejected ones to ``dead_letter_path``; both writes are idempotent.
    Returns per-ticker counts of events appended and dead-lettered, counted before the write from one
    validated copy. With the reference's default
    interval '1h' every bar is dead-lettered (Q2) unless ``session_vocab="mapped"``.
    """
    from tidemark.operators.validation import dead_letters, split_valid, validate_events
    from tidemark.session import materialized
    from tidemark.sources.sinks import pending_events, write_dead_letters, write_events

    ev = bars_to_events(bars, as_of, lookback_days, interval)
    if tickers:
        ev = ev.filter(F.col("ticker").isin(*tickers))
    # a bar's own key makes the offset, so a repeated backfill meets its earlier dead letters
    offset = F.shiftrightunsigned(F.xxhash64("ticker", "event_time", "bar_interval"), 1)
    msgs = ev.select(F.lit("backfill").alias("topic"), F.lit(0).alias("partition"), offset.alias("offset"),
                     F.to_json(F.struct(*[F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
                                          .alias("event_time") if c == "event_time" else F.col(c) for c in EVENT_COLUMNS]))
                     .alias("value"), F.col("event_time").alias("timestamp"))
    checked = validate_events(msgs, session_vocab=session_vocab)
    if target_path is not None or dead_letter_path is not None:
        checked = materialized(checked, "backfill")
    valid, invalid = split_valid(checked)
    spark = bars.sparkSession
    appended = pending_events(valid, target_path, spark)
    if target_path is not None:
        appended = materialized(appended, "backfill")
        write_events(appended, target_path)
    if dead_letter_path is not None:
        write_dead_letters(dead_letters(invalid), dead_letter_path)
    a = appended.groupBy("ticker").agg(F.count(F.lit(1)).alias("event_count"))
    bad = invalid.select(F.get_json_object("payload", "$.ticker").alias("ticker")) \
        .groupBy("ticker").agg(F.count(F.lit(1)).alias("dead_letter_count"))
    return a.join(bad, "ticker", "full").na.fill(0, ["event_count", "dead_letter_count"])
