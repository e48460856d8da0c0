"""STR-4: which events of a batch may be stored already, without reading the event table.

Beside an event table lies a Bloom filter of its identities, one per event date (a batch touches few):
an identity sets ``BITS`` bits of one 64-bit word, so the filter is a table (word, bits) that plain
grouping by bit_or builds, merges and asks. An identity whose bits are not all set is certainly new;
only the others are looked for in the event table. A filter that is too full, or a stop between two
writes, costs look-ups and never a wrong answer:

* the bits of a batch are written before its events, so every stored event is in the filter;
* appends add one delta per batch; ``compact`` merges them into a new generation, which counts only
  when it is complete. A generation is never changed but for deltas, one writer at a time;
* a table that has events and no filter gets generation 0 from its events, once.

``WORDS`` words per date at ``BITS`` bits: two identities a word give about one false alarm in 5000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read_if_exists

IDENTITY = ["ticker", "event_time", "source", "event_kind", "bar_interval"]
WORDS = 1 << 22
BITS = 5

_SCHEMA = "word long, bits long, event_date date"


def filter_path(events_path: str) -> str:
    return f"{events_path.rstrip('/')}_identity"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _generation(spark: SparkSession, path: str) -> int | None:
    """The newest complete generation."""
    place, fs = _fs(spark, path)
    if not fs.exists(place):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    found = [int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(_fs(spark, f"{path}/{n}/base/_SUCCESS")[0])]
    return max(found, default=None)


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64(*IDENTITY), F.lit(words)).alias("word")


def _mask() -> Column:
    """``BITS`` different bits of a word (an odd step never meets a place twice)."""
    h = F.xxhash64(F.lit("bits"), *IDENTITY)
    first, step = F.pmod(h, F.lit(64)), F.pmod(F.shiftright(h, 8), F.lit(32)) * 2 + 1
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        place = ((first + step * i) % 64).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def _dated(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("event_time"))


def identity_bits(events: DataFrame, words: int = WORDS) -> DataFrame:
    """(word, bits, event_date) of the events' identities."""
    rows = _dated(events.select(*IDENTITY)).select(_word(words), _mask().alias("bits"), "event_date")
    return rows.groupBy("word", "event_date").agg(F.bit_or("bits").alias("bits")).select("word", "bits", "event_date")


def _write(bits: DataFrame, path: str, mode: str) -> None:
    # the rows of a date meet first, so that a delta has few files; the mark of a complete folder is written in static mode only
    bits.hint("rebalance", "event_date").sortWithinPartitions("event_date", "word") \
        .write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("event_date").parquet(path)


def open_filter(spark: SparkSession, events_path: str, words: int = WORDS) -> str | None:
    """The folder of the current generation; built from the stored events where there is none yet.

    None where nothing is stored: then everything is new.
    """
    path = filter_path(events_path)
    at = _generation(spark, path)
    if at is None:
        stored = read_if_exists(spark, events_path)
        if stored is None:
            return None
        _write(identity_bits(stored, words), f"{path}/gen=0/base", "overwrite")
        at = 0
    return f"{path}/gen={at}"


def _bits(spark: SparkSession, folder: str) -> DataFrame | None:
    parts = [spark.read.schema(_SCHEMA).parquet(f"{folder}/{n}") for n in ("base", "delta")
             if _fs(spark, f"{folder}/{n}")[1].exists(_fs(spark, f"{folder}/{n}")[0])]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None


def with_possible(spark: SparkSession, batch: DataFrame, events_path: str, words: int = WORDS) -> DataFrame:
    """``batch`` with ``possible``: whether a row's identity may be stored already.

    Reads the filter of the batch's dates only (literal partition filter: a batch spans few).
    """
    folder = open_filter(spark, events_path, words)
    if folder is None:
        return batch.withColumn("possible", F.lit(False))
    rows = _dated(batch).withColumns({"_word": _word(words), "_mask": _mask()})
    wanted = F.col("event_date").isin(*[r[0] for r in rows.select("event_date").distinct().collect()])
    known = _bits(spark, folder).where(wanted).groupBy("word", "event_date").agg(F.bit_or("bits").alias("_bits")) \
        .withColumnRenamed("word", "_word")
    asked = rows.join(known, ["_word", "event_date"], "left")
    possible = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return asked.withColumn("possible", possible).select(*batch.columns, "possible")


def note(spark: SparkSession, events: DataFrame, events_path: str, words: int = WORDS) -> None:
    """Add the identities of ``events``; call it before the events are written."""
    folder = open_filter(spark, events_path, words)
    if folder is None:
        folder = f"{filter_path(events_path)}/gen=0"
        _write(spark.createDataFrame([], _SCHEMA), f"{folder}/base", "overwrite")
    _write(identity_bits(events, words), f"{folder}/delta", "append")


def has_filter(spark: SparkSession, events_path: str) -> bool:
    return _generation(spark, filter_path(events_path)) is not None


def compact(spark: SparkSession, events_path: str) -> None:
    """Merge a filter's deltas into a new generation and drop the old one (between two batches)."""
    path = filter_path(events_path)
    at = _generation(spark, path)
    if at is None:
        return
    merged = _bits(spark, f"{path}/gen={at}").groupBy("word", "event_date").agg(F.bit_or("bits").alias("bits")) \
        .select("word", "bits", "event_date")
    _write(merged, f"{path}/gen={at + 1}/base", "overwrite")
    place, fs = _fs(spark, f"{path}/gen={at}")
    fs.delete(place, True)
