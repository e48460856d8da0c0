"""STR-7: hourly bars over event time, finished hours written once.

The event-time state is a table: the partials of the hours that are still open, and the watermark (latest
event time seen, less a delay; it never goes back). A batch

* puts its rows of hours that ended before the watermark *of the batch before* into ``corrections``,
* merges the others into the open hours,
* moves the watermark and writes the hours that end before it to ``bars``: each once, in one file set,
* writes the open rest as the next state.

Partials carry the order keys that decide them, so a correction merges with its bar exactly, however late
it comes; nothing is dropped. The state holds the hours within the delay only. All folders of a batch
carry its id and are overwritten when the batch is repeated; the state of the batch before stays until the
next one is complete, so a stop at any point repeats one batch.

``compact_bars`` folds finished hours and corrections up to a batch into a base; the stream goes on with
the folders behind it. One writer, one checkpoint per output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.staging import coalesce_ohlc, drop_closed
from tidemark.plans.marts import SESSION_CODES, order_key
from tidemark.streaming.blocks import delete, exists, written

DELAY = "2 hours"

#: A partial: OHLC and first session of an hour, with the order keys that decide them.
PARTIAL = ("ticker string, interval_start timestamp, first_key decimal(38,0), last_key decimal(38,0), open_price decimal(10,2), "
           "high_price decimal(10,2), low_price decimal(10,2), close_price decimal(10,2), bar_count long, total_volume long, "
           "session_code int, last_time timestamp")


def hourly_bars(events: DataFrame) -> DataFrame:
    """Mergeable hourly partials per ticker."""
    codes = F.array(*[F.lit(s) for s in SESSION_CODES])
    base = coalesce_ohlc(drop_closed(events)).withColumn("_k", order_key()) \
        .withColumn("_s", F.array_position(codes, F.col("market_session")).cast("int"))
    return base.groupBy("ticker", F.date_trunc("hour", F.col("event_time")).alias("interval_start")).agg(
        F.min("_k").alias("first_key"), F.max("_k").alias("last_key"),
        F.min_by("open_price", "_k").alias("open_price"), F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"), F.max_by("close_price", "_k").alias("close_price"),
        F.count(F.lit(1)).alias("bar_count"), F.sum("volume").alias("total_volume"),
        F.min_by("_s", "_k").alias("session_code"), F.max("event_time").alias("last_time"))


def merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("ticker", "interval_start").agg(
        F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"),
        F.min_by("open_price", "first_key").alias("open_price"), F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"), F.max_by("close_price", "last_key").alias("close_price"),
        F.sum("bar_count").alias("bar_count"), F.sum("total_volume").alias("total_volume"),
        F.min_by("session_code", "first_key").alias("session_code"), F.max("last_time").alias("last_time"))


def _ids(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers of the complete folders ``key=N`` under ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[len(key) + 1:]) for n in names if n.startswith(f"{key}=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], PARTIAL)
    return spark.read.parquet(*folders).select(*[c.split()[0] for c in PARTIAL.split(", ")])


def hourly_batch(spark: SparkSession, batch: DataFrame, batch_id: int, out_path: str, delay: str = DELAY) -> None:
    """One micro-batch; its mark is written last and makes it complete."""
    out = out_path.rstrip("/")
    before = [i for i in _ids(spark, f"{out}/marks", "batch_id") if i < batch_id]
    watermark, state = None, _read(spark, [])
    if before:
        watermark = spark.read.parquet(f"{out}/marks/batch_id={before[-1]}").first()["watermark"]
        state = _read(spark, [f"{out}/open/batch_id={before[-1]}"])
    part = written(hourly_bars(batch), f"{out}/touched/batch_id={batch_id}")
    end = F.col("interval_start") + F.expr("INTERVAL 1 HOUR")
    late = F.lit(False) if watermark is None else end <= F.lit(watermark)
    part.where(late).write.mode("overwrite").parquet(f"{out}/corrections/batch_id={batch_id}")
    seen = part.agg((F.max("last_time") - F.expr(f"INTERVAL {delay}")).alias("w")).first()["w"]
    watermark = max((w for w in (watermark, seen) if w is not None), default=None)
    hours = merged(state.unionByName(part.where(~late)))
    closed = F.lit(False) if watermark is None else end <= F.lit(watermark)
    hours.where(closed).sortWithinPartitions("interval_start", "ticker").write.mode("overwrite").parquet(f"{out}/bars/batch_id={batch_id}")
    hours.where(~closed).write.mode("overwrite").parquet(f"{out}/open/batch_id={batch_id}")
    spark.createDataFrame([(watermark,)], "watermark timestamp").coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}")
    delete(spark, f"{out}/touched/batch_id={batch_id}")
    for old in before[:-1]:  # the state before this one stays, in case this batch is repeated
        delete(spark, f"{out}/marks/batch_id={old}")
        delete(spark, f"{out}/open/batch_id={old}")


def stream_hourly_bars(events: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None, delay: str = DELAY):
    """STR-7: start the query."""
    def run(batch: DataFrame, batch_id: int):
        hourly_batch(batch.sparkSession, batch, batch_id, out_path, delay)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run) \
        .trigger(**(trigger or {"availableNow": True})).start()


def _parts(spark: SparkSession, out: str) -> tuple[list[str], list[str]]:
    """Folders of finished hours and of corrections behind the newest base, the base included."""
    base = _ids(spark, f"{out}/base", "through")
    through = base[-1] if base else -1
    bars = [f"{out}/bars/batch_id={i}" for i in _ids(spark, f"{out}/bars", "batch_id") if i > through]
    late = [f"{out}/corrections/batch_id={i}" for i in _ids(spark, f"{out}/corrections", "batch_id") if i > through]
    return ([f"{out}/base/through={through}"] if base else []) + bars, late


def finished_bars(spark: SparkSession, out_path: str) -> DataFrame:
    """Partials of the finished hours, corrected; only hours with corrections are merged."""
    bars, late = (_read(spark, folders) for folders in _parts(spark, out_path.rstrip("/")))
    key = ["ticker", "interval_start"]
    hit = late.select(*key).distinct()
    return bars.join(hit, key, "left_anti").unionByName(merged(bars.join(hit, key, "left_semi").unionByName(late)))


def current_bars(spark: SparkSession, out_path: str) -> DataFrame:
    """The hourly bars as of the last batch: finished hours with their corrections, and the open ones so far."""
    out = out_path.rstrip("/")
    last = _ids(spark, f"{out}/marks", "batch_id")[-1:]
    codes = F.array(*[F.lit(s) for s in SESSION_CODES])
    rows = finished_bars(spark, out).unionByName(_read(spark, [f"{out}/open/batch_id={i}" for i in last]))
    return rows.select("ticker", "interval_start", F.element_at(codes, F.col("session_code")).alias("market_session"), "open_price",
                       "high_price", "low_price", "close_price", "bar_count", "total_volume")


def compact_bars(spark: SparkSession, out_path: str) -> int | None:
    """Fold the finished hours and corrections up to the last complete batch into a new base.

    The running log goes on behind it: the folders it replaces are removed once the base is complete, and no
    reader or later batch needs them. Returns the batch up to which the base reaches.
    """
    out = out_path.rstrip("/")
    done = _ids(spark, f"{out}/marks", "batch_id")
    if not done:
        return None
    through, old = done[-1], _ids(spark, f"{out}/base", "through")
    if old and old[-1] == through:
        return through
    finished_bars(spark, out).sort("interval_start", "ticker").write.mode("overwrite").parquet(f"{out}/base/through={through}")
    for name in ("bars", "corrections"):
        for i in _ids(spark, f"{out}/{name}", "batch_id"):
            if i <= through:
                delete(spark, f"{out}/{name}/batch_id={i}")
    for i in old:
        delete(spark, f"{out}/base/through={i}")
    return through
