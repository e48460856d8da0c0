"""SNK-1…7: sinks. Every writer is idempotent or append-only with a natural key.

* The event table is parquet partitioned by ``event_date`` (UTC date of the event). The
  idempotent append (SNK-1) anti-joins a batch against the stored rows of the dates the batch
  touches only (a literal partition filter: the distinct dates of a batch are few).
* Marts are rebuilt with dynamic partition overwrite by ``trade_date``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialized
from tidemark.sources.identity import IDENTITY, has_filter, note
from tidemark.sources.tables import EVENT_COLUMNS, read_if_exists

MESSAGE_KEY = ["source_topic", "source_partition", "source_offset"]


def event_date(ts: str = "event_time") -> Column:
    return F.to_date(F.col(ts))


def dedupe_batch(valid: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Keep the first row per event identity (first by ``order``, e.g. source partition/offset).

    Identity groups hold one row per delivery of the same event, so they stay tiny whatever the
    skew of tickers; the aggregate is partial (map-side) before its shuffle.
    """
    order = order or ["partition", "offset"]
    cols = [c for c in valid.columns if c not in IDENTITY]
    g = valid.groupBy(*IDENTITY).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return g.select(*IDENTITY, *[F.col(f"_r.{c}").alias(c) for c in cols])


def new_events(batch: DataFrame, target: DataFrame | None) -> DataFrame:
    """Rows of a deduplicated batch whose identity is not stored yet (INSERT … ON CONFLICT DO NOTHING)."""
    rows = batch.withColumn("event_date", event_date())
    if target is None:
        return rows
    # only the partitions of the dates present in the batch are read (static partition pruning;
    # the distinct dates of a batch are bounded by its time span)
    dates = [r[0] for r in rows.select("event_date").distinct().collect()]
    keys = target.filter(F.col("event_date").isin(*dates)).select(*IDENTITY, "event_date")
    return rows.join(keys, IDENTITY + ["event_date"], "left_anti")


def pending_events(valid: DataFrame, target_path: str | None, spark: SparkSession | None = None,
                   order: list[str] | None = None) -> DataFrame:
    """Deduplicated rows of a batch whose identity is not stored at ``target_path`` yet."""
    batch = dedupe_batch(valid, order).select(*EVENT_COLUMNS, *(order or ["partition", "offset"]))
    target = read_if_exists(spark, target_path) if target_path is not None and spark is not None else None
    return new_events(batch, target).select(*EVENT_COLUMNS, "event_date")


def write_events(fresh: DataFrame, target_path: str) -> None:
    """Append; a table that streams append to has an identity filter, which must know every event first."""
    if has_filter(fresh.sparkSession, target_path):
        fresh = materialized(fresh, "events")
        note(fresh.sparkSession, fresh, target_path)
    fresh.sortWithinPartitions("event_date", "ticker", "event_time") \
        .write.mode("append").partitionBy("event_date").parquet(target_path)


def append_events(valid: DataFrame, target_path: str | None, spark: SparkSession | None = None,
                  order: list[str] | None = None) -> DataFrame:
    """SNK-1: deduplicate a batch, drop identities already stored, append the rest.

    Returns the rows that were (or, with ``target_path=None``, would be) appended, from a copy
    taken before the write.
    """
    fresh = pending_events(valid, target_path, spark, order)
    if target_path is not None:
        fresh = materialized(fresh, "append")
        write_events(fresh, target_path)
    return fresh


def write_raw_lake(df: DataFrame, path: str, ingest_ts: Column | None = None, mode: str = "append") -> None:
    """SNK-2: raw JSON lake under date=<ingest UTC date>/ticker=<ticker>; no dedupe."""
    ts = ingest_ts if ingest_ts is not None else F.current_timestamp()
    # rows of a folder meet first, so a task writes few files; large folders stay split
    df.withColumn("date", F.date_format(ts, "yyyy-MM-dd")).hint("rebalance", "date", "ticker") \
        .write.mode(mode).partitionBy("date", "ticker").json(path)


def write_dead_letters(letters: DataFrame, path: str) -> int:
    """SNK-3: dead-letter table rows (append); a message already set aside is not stored again.

    Returns the number of rows written.
    """
    stored = read_if_exists(letters.sparkSession, path)
    if stored is not None:
        spans = letters.groupBy("source_topic", "source_partition").agg(
            F.min("source_offset").alias("lo"), F.max("source_offset").alias("hi"))  # one row a topic partition
        known = stored.select(*MESSAGE_KEY).join(spans, ["source_topic", "source_partition"]) \
            .where(F.col("source_offset").between(F.col("lo"), F.col("hi"))).select(*MESSAGE_KEY)
        letters = letters.join(known, MESSAGE_KEY, "left_anti")
    written = Observation()
    letters.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return written.get["n"]


def write_dead_letter_lake(invalid: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-4: invalid/stocks/date=… JSON with payload, error and time."""
    invalid.select("payload", "validation_error", "created_at",
                   F.date_format("created_at", "yyyy-MM-dd").alias("date")) \
        .hint("rebalance", "date").write.mode(mode).partitionBy("date").json(path)


def publish_events(events: DataFrame, path: str | None = None, kafka_options: dict | None = None,
                   topic: str | None = None) -> DataFrame:
    """SNK-5: events → JSON messages (``value``), keyed by ticker.

    Written to Kafka when options are given; with a ``topic`` to that topic's message log under ``path``
    (a ticker's events in time order in one partition); with a path alone as lines of text files.
    """
    msgs = events.select(F.col("ticker").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))
    if kafka_options:
        msgs.write.format("kafka").options(**kafka_options).save()
    elif topic is not None:
        from tidemark.sources.topic_log import publish
        publish(msgs.withColumn("_at", F.get_json_object("value", "$.event_time")), path, topic, order="_at")
    elif path is not None:
        msgs.select("value").write.mode("append").text(path)
    return msgs


def materialize(df: DataFrame, path: str, partition_col: str | None = "trade_date") -> None:
    """SNK-6: rebuild a mart; with a partition column only the partitions present are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def prune_table(spark: SparkSession, path: str, ts_col: str, days: int, as_of: str) -> int:
    """SNK-7 on a stored table: removes the expired rows for good; returns how many went.

    The kept rows are written beside the table and swapped in by renaming, so an interrupted run leaves the
    old table in place.
    """
    table = spark.read.parquet(path)
    kept, fresh, old = prune_retention(table, ts_col, days, as_of), f"{path}.kept", f"{path}.old"
    before = table.count()
    kept.write.mode("overwrite").parquet(fresh)
    after = spark.read.schema(table.schema).parquet(fresh).count()
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(place(path), place(old))
    fs.rename(place(fresh), place(path))
    fs.delete(place(old), True)
    return before - after


def prune_retention(df: DataFrame, ts_col: str, days: int, as_of: str) -> DataFrame:
    """SNK-7: rows younger than ``days`` days at ``as_of`` (retention of dead letters, cache, jobs)."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return df.filter(F.col(ts_col) >= limit)
