"""STR-1…9: Structured Streaming jobs.

* ``ingest_stream`` (STR-1, 3, 4, 5): messages → validation → idempotent append of valid events +
  dead letters, in ``foreachBatch`` with a checkpoint: offsets are committed only after the batch
  succeeded, and a replayed batch appends nothing twice (events by identity: a Bloom filter beside the
  table names the few that may be stored, see ``sources.identity``; dead letters by topic, partition and
  offset). Batch counters are stored as metric rows.
* ``lake_stream`` (STR-2): the same topic into the raw JSON lake and the dead-letter lake, as its
  own query with its own checkpoint (its own consumer position).
* ``stream_hourly_bars`` (STR-7): event-time state, finished hours once, late rows as corrections (``hours``).
* ``refresh_marts_stream`` (STR-8): after each batch the touched (ticker, day) keys are aggregated again from
  the partition-pruned events, and the blocks of the marts that they reach are replaced (``blocks``).
* ``emit_alerts`` (STR-9): new, changed and withdrawn watch-list alerts of the rows that changed.
* ``metrics_stream`` (MET-1): counters, gauges and timings as a streaming aggregate.

Every writer targets the shared folder (``spark.checkpoint.dir`` or explicit paths): nothing uses
machine-local state, so a lost executor only re-runs tasks.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import ny_date
from tidemark.operators.staging import drop_closed
from tidemark.operators.validation import dead_letters, split_valid, validate_events
from tidemark.session import materialized
from tidemark.sources.identity import IDENTITY, compact, note, with_possible
from tidemark.sources.sinks import (dedupe_batch, event_date, write_dead_letter_lake, write_dead_letters,
                                    write_raw_lake)
from tidemark.sources.tables import EVENT_COLUMNS
from tidemark.streaming.blocks import (DAILY, HOURLY, PARTITION, Refresh, delete, in_partitions, partitions_of, reached, refresh,
                                       rewrite, summary_path, with_block, written)
from tidemark.streaming.hours import _ids, current_bars, stream_hourly_bars  # noqa: F401

#: Batches after which an event table's identity filter is merged.
COMPACT_EVERY = 100


def arrival_key() -> Column:
    """Arrival order of a message as the event's id: partition, then offset."""
    return F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")


def ingest_batch(batch: DataFrame, batch_id: int, events_path: str, dead_letter_path: str,
                 session_vocab: str = "strict", counters_path: str | None = None) -> dict:
    """One micro-batch of STR-1: validate, dedupe, anti-join against stored identities, append.

    Returns the batch counters (STR-5) and, with ``counters_path``, stores them as metric rows.
    """
    checked = validate_events(batch, session_vocab=session_vocab).persist()
    try:
        return ingest_checked(checked, batch_id, events_path, dead_letter_path, counters_path)
    finally:
        checked.unpersist()


def ingest_checked(checked: DataFrame, batch_id: int, events_path: str, dead_letter_path: str,
                   counters_path: str | None = None) -> dict:
    """``ingest_batch`` for an already validated (and persisted) batch.

    Both writes are idempotent: events by identity, dead letters by topic, partition and offset. A write
    that fails fails the batch, which the checkpoint repeats; its counter is stored first.
    """
    spark = checked.sparkSession
    step = "persist_failed"
    valid, invalid = split_valid(checked)
    counters = checked.agg(F.count(F.lit(1)).alias("messages"),
                           F.count_if(F.col("validation_error").isNotNull()).alias("invalid_event"),
                           F.max("offset").alias("last_offset")).first().asDict()
    counters |= {"batch_id": batch_id, "events_persisted": 0, "persist_failed": 0, "dead_letter_written": 0,
                 "dead_letter_failed": 0}
    fresh = dedupe_batch(valid).select(*EVENT_COLUMNS, arrival_key().alias("id"))
    fresh = with_possible(spark, fresh, events_path).persist()
    try:
        counters["possible_repeats"] = fresh.where("possible").count()
        new = fresh.drop("possible").withColumn("event_date", event_date())
        if counters["possible_repeats"]:
            # only rows that may be stored are looked for, in the few dates they fall on (a literal partition filter)
            asked = fresh.where("possible").drop("possible").withColumn("event_date", event_date())
            dates = [r[0] for r in asked.select("event_date").distinct().collect()]
            keys = spark.read.parquet(events_path).filter(F.col("event_date").isin(*dates)).select(*IDENTITY, "event_date")
            new = fresh.where("NOT possible").drop("possible").withColumn("event_date", event_date()) \
                .unionByName(asked.join(keys, IDENTITY + ["event_date"], "left_anti"))
        seen = Observation()
        new = new.withColumn("inserted_at", F.current_timestamp()).observe(seen, F.count(F.lit(1)).alias("n"))
        # one file per task and date, rows clustered by ticker: ticker filters (benchmark branch,
        # single-ticker queries) skip row groups through the parquet min/max statistics
        step = "persist_failed"
        note(spark, fresh.where("NOT possible"), events_path)  # before the events: a stored event is always known
        new.sortWithinPartitions("event_date", "ticker", "event_time") \
            .write.mode("append").partitionBy("event_date").parquet(events_path)
        counters["events_persisted"] = seen.get["n"]
        step = "dead_letter_failed"
        letters = dead_letters(invalid)
        if counters["invalid_event"]:
            counters["dead_letter_written"] = write_dead_letters(letters, dead_letter_path)
    except Exception:
        counters[step] = 1
        raise
    finally:
        fresh.unpersist()
        if counters_path:
            write_counters(spark, counters, counters_path)
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        compact(spark, events_path)
    return counters


def write_counters(spark: SparkSession, counters: dict, path: str) -> None:
    """STR-5: a batch's counters as metric rows (metric_name, value, batch_id), one folder per batch."""
    batch_id = counters["batch_id"]
    rows = [(f"pipeline.{k}", float(v)) for k, v in counters.items() if k != "batch_id" and v is not None]
    spark.createDataFrame(rows, "metric_name string, value double").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def without_redelivery(messages: DataFrame, within: str) -> DataFrame:
    """STR-4: a message (topic, partition, offset) that arrives again ``within`` a time is dropped in the state store.

    The watermark is on the arrival, so no message is ever too late, and keys leave the state after that
    time. Repeated events under other offsets are the identity filter's part: which of two rows survives
    here is open, there it is the first by offset.
    """
    return messages.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", within) \
        .dropDuplicatesWithinWatermark(["topic", "partition", "offset"]).drop("_arrival")


def ingest_stream(messages: DataFrame, events_path: str, dead_letter_path: str, checkpoint: str,
                  trigger: dict | None = None, session_vocab: str = "strict", counters_path: str | None = None,
                  redelivered_within: str | None = None):
    """STR-1: start the ingest query (returns the StreamingQuery)."""
    def run(batch: DataFrame, batch_id: int):
        ingest_batch(batch, batch_id, events_path, dead_letter_path, session_vocab, counters_path)

    if redelivered_within:
        messages = without_redelivery(messages, redelivered_within)
    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run) \
        .trigger(**(trigger or {"availableNow": True})).start()


def lake_stream(messages: DataFrame, raw_path: str, invalid_path: str, checkpoint: str,
                trigger: dict | None = None):
    """STR-2: raw lake (valid events as JSON under date=/ticker=) and dead-letter lake, no dedupe.

    Each batch owns a folder (``batch_id=``) that a repeated batch overwrites, so a retry adds nothing.
    """
    def run(batch: DataFrame, batch_id: int):
        checked = validate_events(batch).persist()
        try:
            valid, invalid = split_valid(checked)
            write_raw_lake(valid.select(*EVENT_COLUMNS), f"{raw_path.rstrip('/')}/batch_id={batch_id}", mode="overwrite")
            write_dead_letter_lake(dead_letters(invalid), f"{invalid_path.rstrip('/')}/batch_id={batch_id}", mode="overwrite")
        finally:
            checked.unpersist()

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run) \
        .trigger(**(trigger or {"availableNow": True})).start()


def refresh_marts_batch(spark: SparkSession, touched: DataFrame, events_path: str, sym: DataFrame,
                        daily_path: str, staging_path: str) -> Refresh:
    """STR-8 step: bring the daily mart up to date after a micro-batch.

    ``touched``: (ticker, trade_date) keys of the events the batch appended. Only the touched days are
    aggregated again from their events; the window and benchmark columns are computed again for the months
    that ``blocks`` finds reached, and only those month folders are replaced. ``staging_path`` names the batch.
    """
    return refresh(spark, touched, events_path, sym, daily_path, staging_path, DAILY)


def refresh_hourly_batch(spark: SparkSession, touched_hours: DataFrame, events_path: str, sym: DataFrame,
                         hourly_path: str, staging_path: str) -> Refresh:
    """STR-8 for MART-2: the same for the touched (ticker, interval_start) keys, in blocks of a day."""
    return refresh(spark, touched_hours, events_path, sym, hourly_path, staging_path, HOURLY)


def refresh_dependent_marts(spark: SparkSession, done: Refresh, daily_path: str, marts_dir: str, as_of: str,
                            staging_path: str) -> None:
    """STR-8, second half: the marts that derive from the daily mart, after its refresh ``done``.

    Per-ticker marts are computed again in the changed blocks from the rows their frames need; the running peak
    also in later blocks into which another peak is carried now. Market-wide marts (one row per date, or
    sector or benchmark and date) are computed again for the dates of the changed blocks, which are the only
    ones with other rows. Untouched blocks and dates keep their files.
    """
    from tidemark.plans import marts as M
    out = marts_dir.rstrip("/")
    changed = done.changed
    daily = spark.read.parquet(daily_path)

    def rows_of(blocks: DataFrame) -> DataFrame:
        return daily.where(in_partitions(partitions_of(blocks))).join(blocks, ["ticker", "block"], "left_semi")

    def only(df: DataFrame, blocks: DataFrame) -> DataFrame:
        return with_block(df, DAILY).join(blocks, ["ticker", "block"], "left_semi")

    def put(df: DataFrame, blocks: DataFrame, name: str) -> None:
        rewrite(only(df, blocks), blocks, f"{out}/{name}", f"{staging_path}/{name}")

    near = rows_of(done.read).drop(*PARTITION)
    put(M.stock_risk_indicators(near), changed, "stock_risk_indicators")
    put(M.stock_anomaly_history(rows_of(changed).drop(*PARTITION)), changed, "stock_anomaly_history")

    moved = done.carried.where("moved").select("ticker", "block")
    deep = written(changed.unionByName(moved).distinct(), f"{staging_path}/peaks_changed")
    before = reached(spark.read.parquet(summary_path(daily_path)), deep, DAILY.look_back, backwards=True)
    frames = written(before, f"{staging_path}/peaks_read")
    # tickers reached through their benchmark only have no new peaks: theirs are carried as before
    summary = spark.read.parquet(summary_path(daily_path)).join(frames.select("ticker").distinct(), "ticker", "left_semi")
    peaked = written(M.running_peaks(rows_of(frames), M.carried_peaks(summary)), f"{staging_path}/peaked")
    put(M.drawdown_from_peaks(peaked), deep, "stock_drawdown_recovery")
    put(M.signal_feature_store(peaked.withColumnRenamed("rolling_peak_close", "peak").drop(*PARTITION, "_peak_at"), as_of, "peak"),
        deep, "stock_signal_feature_store")

    def by_date(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(f"{out}/{name}")

    blocks = sorted({b for b, _ in done.parts})
    dates = F.broadcast(rows_of(changed).select("trade_date").distinct())  # at most the days of the changed months
    market = daily.where(F.col("block").isin(*blocks)).drop(*PARTITION).join(dates, "trade_date", "left_semi")
    risk = spark.read.parquet(f"{out}/stock_risk_indicators").where(F.col("block").isin(*blocks)).drop(*PARTITION)
    by_date(M.sector_daily_summary(market), "sector_daily_summary")
    by_date(M.benchmark_relative_strength(market), "benchmark_relative_strength")
    by_date(M.market_regime_summary(market, risk), "market_regime_summary")


def alerts_for_batch(daily_rows: DataFrame, watch: DataFrame, sym: DataFrame) -> DataFrame:
    """STR-9: watch-list alerts on daily rows (all principals, no limit, in no order)."""
    from tidemark.plans.queries import alert_rows
    return alert_rows(watch, daily_rows, sym)


ALERT_KEY = ["principal_id", "ticker", "trade_date"]


def _alert_log(spark: SparkSession, log_path: str) -> list[int]:
    place = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n[4:]) for n in names if n.startswith("seq="))


def _alert_state(log: DataFrame) -> DataFrame:
    """Each alert's latest entry."""
    values = [c for c in log.columns if c not in (*ALERT_KEY, "seq")]
    return log.groupBy(*ALERT_KEY).agg(F.max_by(F.struct(*values), "seq").alias("v")).select(*ALERT_KEY, "v.*").where("change <> 'withdrawn'")


def emit_alerts(spark: SparkSession, differing: DataFrame, watch: DataFrame, sym: DataFrame, log_path: str, batch: str) -> DataFrame:
    """STR-9: what the daily rows that a batch made ``differing`` change in the alerts.

    The keyed state (principal, ticker, date) is the log itself, read for the dates of the batch only. Written
    and returned are the alerts that are ``new``, ``changed`` or ``withdrawn``; one that stands as it was is not
    said again. ``batch`` names the batch: repeated, it replaces its own entries.
    """
    out = log_path.rstrip("/")
    entries = _alert_log(spark, out)
    seq = entries[-1] + 1 if entries else 0
    if entries and (last := spark.read.parquet(f"{out}/seq={entries[-1]}").select("batch").first()) and last[0] == batch:
        seq = entries.pop()
    now = alerts_for_batch(differing, watch, sym)
    values = [c for c in now.columns if c not in ALERT_KEY]
    keys = differing.select("ticker", "trade_date").distinct()
    dates = [r[0] for r in keys.select("trade_date").distinct().collect()]  # the dates a batch changes
    new = now.select(*ALERT_KEY, F.struct(*values).alias("now"))
    if entries:
        log = spark.read.parquet(out).where((F.col("seq") < seq) & F.col("trade_date").isin(*dates)).join(keys, ["ticker", "trade_date"], "left_semi")
        old = _alert_state(log).select(*ALERT_KEY, F.struct(*values).alias("was"))
        both = new.join(old, ALERT_KEY, "full")
    else:
        both = new.withColumn("was", F.lit(None).cast(new.schema["now"].dataType))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "withdrawn") \
        .when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    found = both.withColumn("change", change).where(F.col("change").isNotNull()) \
        .select(*ALERT_KEY, F.coalesce("now", "was").alias("v"), "change").select(*ALERT_KEY, "v.*", "change", F.lit(batch).alias("batch"))
    found = materialized(found, "alerts")
    if found.isEmpty():
        if seq in _alert_log(spark, out):
            delete(spark, f"{out}/seq={seq}")
    else:
        found.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("trade_date").parquet(f"{out}/seq={seq}")
    return found


def current_alerts(spark: SparkSession, log_path: str) -> DataFrame:
    """All alerts that stand after the last batch: the sum of what the batches emitted."""
    return _alert_state(spark.read.parquet(log_path)).drop("change", "batch")


def metrics_stream(metric_events: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None):
    """MET-1 as a running stream: counters, gauges and timings per (name, kind).

    Spark's streaming aggregate holds sum, count, maximum and the latest value by (time, seq) in the state
    store: one row per metric, restart-safe through the checkpoint. Each batch's updated rows replace theirs in
    a small table with one version per batch; the version before stays until the next is complete.
    """
    from tidemark.operators.quality import rollup_metrics
    out = out_path.rstrip("/")

    def run(updated: DataFrame, batch_id: int):
        spark = updated.sparkSession
        before = [i for i in _ids(spark, out, "batch_id") if i < batch_id]
        rows = updated
        if before:
            old = spark.read.parquet(f"{out}/batch_id={before[-1]}")
            updated = updated.persist()
            rows = old.join(updated.select("name", "kind"), ["name", "kind"], "left_anti").unionByName(updated)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        updated.unpersist()
        for i in before[:-1]:
            delete(spark, f"{out}/batch_id={i}")

    return rollup_metrics(metric_events).writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(run).trigger(**(trigger or {"availableNow": True})).start()


def current_metrics(spark: SparkSession, out_path: str) -> DataFrame:
    out = out_path.rstrip("/")
    return spark.read.parquet(f"{out}/batch_id={_ids(spark, out, 'batch_id')[-1]}")


def refresh_marts_stream(messages: DataFrame, events_path: str, dead_letter_path: str, daily_path: str,
                         sym: DataFrame, checkpoint: str, alerts_path: str | None = None,
                         watch: DataFrame | None = None, trigger: dict | None = None,
                         marts_dir: str | None = None, as_of: str | None = None):
    """STR-8/9: ingest, refresh the reached blocks of the daily mart, then (with ``marts_dir``) the dependent
    marts, and (with ``alerts_path``) emit what the changed rows change in the watch-list alerts."""
    if marts_dir is not None and as_of is None:
        raise ValueError("the dependent marts need as_of")
    name = f"{zlib.crc32(checkpoint.encode()):08x}"  # a batch is named by its query and its number

    def run(batch: DataFrame, batch_id: int):
        checked = validate_events(batch).persist()  # once per batch
        try:
            ingest_checked(checked, batch_id, events_path, dead_letter_path)
            _refresh_after_ingest(batch.sparkSession, split_valid(checked)[0], batch_id)
        finally:
            checked.unpersist()

    def _refresh_after_ingest(spark: SparkSession, valid: DataFrame, batch_id: int):
        staging = f"{daily_path}_staging/{name}"
        rows = drop_closed(valid).select(F.upper(F.trim("ticker")).alias("ticker"), "event_time")
        touched = rows.select("ticker", ny_date(F.col("event_time")).alias("trade_date")).distinct()
        done = refresh_marts_batch(spark, touched, events_path, sym, daily_path, f"{staging}/{batch_id}/daily")
        if marts_dir is not None:
            refresh_dependent_marts(spark, done, daily_path, marts_dir, as_of, f"{staging}/{batch_id}")
            hours = rows.select("ticker", F.date_trunc("hour", F.col("event_time")).alias("interval_start")).distinct()
            refresh_hourly_batch(spark, hours, events_path, sym, f"{marts_dir}/intraday_stock_rollup", f"{staging}/{batch_id}/hourly")
        if alerts_path and watch is not None:
            emit_alerts(spark, done.differing.drop(*PARTITION), watch, sym, alerts_path, f"{name}/{batch_id}")
        delete(spark, f"{staging}/{batch_id - 1}")  # only the last batch can be repeated

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run) \
        .trigger(**(trigger or {"availableNow": True})).start()


def replay_then_stream(bars: DataFrame, as_of: str, messages: DataFrame, events_path: str, dead_letter_path: str,
                       checkpoint: str, trigger: dict | None = None):
    """STR-6: backfill history first (batch), then start the live stream; the idempotent append
    makes any overlap between the two harmless."""
    from tidemark.sources.ingest import backfill
    backfill(bars, as_of, target_path=events_path, session_vocab="mapped", dead_letter_path=dead_letter_path)
    return ingest_stream(messages, events_path, dead_letter_path, checkpoint, trigger)


def query_metrics(query) -> dict:
    """STR-5: counters of the last progress report (rows in, observed metrics of the batch)."""
    p = query.lastProgress or {}
    out = {"numInputRows": p.get("numInputRows"), "batchId": p.get("batchId")}
    for name, row in (p.get("observedMetrics") or {}).items():
        out[name] = row
    return out
