"""STR-8: marts kept in blocks, so that a batch rewrites only the blocks its rows reach.

A mart row lies in a block (a month of the daily mart, a day of the hourly one) and a ticker bucket;
folders are ``block=…/ticker_bucket=…``. Beside the mart lies one summary row per (ticker, block): number of
rows, highest close and its latest date. From the summaries alone follows what a batch reaches:

* the window columns look back over a stated number of rows, so a changed row reaches as many rows after
  it: blocks are counted on until that many rows lie between (``reached``); other tickers are reached
  in the same blocks through their benchmark;
* to compute a reached block again, the rows before it are needed, counted back in the same way;
* the running peak reaches any distance, but only as (peak, date): the peaks carried into a block are the
  running maximum over the summaries before it, and a block is reached only where they change.

A refresh first writes all it found out to a staging folder of its batch, then replaces block folders from
there. Stopped before the staging is complete it has changed nothing; stopped later, the repeated batch takes
the staging as it is.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.staging import stage_stock_prices
from tidemark.plans.marts import (DAILY_AGGREGATE_COLUMNS, HOURLY_AGGREGATE_COLUMNS, carried_peaks, daily_aggregates,
                                  daily_from_aggregates, hourly_aggregates, intraday_from_aggregates, month_block)
from tidemark.sources.tables import read_if_exists

TICKER_BUCKETS = 64
PARTITION = ["block", "ticker_bucket"]


def ticker_bucket(col: str = "ticker") -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(TICKER_BUCKETS)).cast("int")


def day_block(time: Column) -> Column:
    return F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))


@dataclass(frozen=True)
class Grain:
    """One mart: its time column and block, how many rows its windows look back, and how it is computed."""
    time: str
    block: Callable[[Column], Column]
    look_back: int
    aggregate_columns: list[str]
    aggregates: Callable[[DataFrame], DataFrame]
    from_aggregates: Callable[[DataFrame, DataFrame], DataFrame]
    #: UTC dates that can hold the events of a value of the time column
    utc_dates: Callable[[_dt.date], tuple[_dt.date, ...]]


#: LAG reaches one row, the trailing volume six, the rolling risk six behind a changed LAG.
DAILY = Grain("trade_date", month_block, 7, DAILY_AGGREGATE_COLUMNS, daily_aggregates, daily_from_aggregates,
              lambda day: (day, day + _dt.timedelta(days=1)))  # a New York day spans two UTC dates
HOURLY = Grain("interval_start", day_block, 1, HOURLY_AGGREGATE_COLUMNS, hourly_aggregates, intraday_from_aggregates,
               lambda day: (day,))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_block(df: DataFrame, grain: Grain) -> DataFrame:
    return df.withColumns({"block": grain.block(F.col(grain.time)).cast("int"), "ticker_bucket": ticker_bucket()})


def partitions_of(rows: DataFrame) -> list[tuple[int, int]]:
    """The (block, ticker_bucket) folders of (ticker, block) rows: bounded by the blocks a batch reaches."""
    found = rows.select("block", ticker_bucket().alias("ticker_bucket")).distinct().collect()
    return sorted((r["block"], r["ticker_bucket"]) for r in found)


def in_partitions(parts: list[tuple[int, int]]) -> Column:
    """A literal partition filter: only these folders are listed and read."""
    by: dict[int, list[int]] = {}
    for block, bucket in parts:
        by.setdefault(block, []).append(bucket)
    wanted = F.lit(False)
    for block, buckets in by.items():
        wanted = wanted | ((F.col("block") == block) & F.col("ticker_bucket").isin(*buckets))
    return wanted


def replace_partitions(df: DataFrame, path: str, parts: list[tuple[int, int]]) -> None:
    """Make the folders ``parts`` of a table hold exactly the rows of ``df`` (a stored frame); others keep their files."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
    filled = {(r[0], r[1]) for r in df.select(*PARTITION).distinct().collect()}
    for block, bucket in parts:
        if (block, bucket) not in filled:  # a folder whose last row is gone
            delete(spark, f"{path}/block={block}/ticker_bucket={bucket}")


def _counted(summary: DataFrame, touched: DataFrame) -> DataFrame:
    """(ticker, block, n, before): stored rows of each block and before it, touched blocks included."""
    rows = summary.select("ticker", "block", "n").unionByName(touched.select("ticker", "block", F.lit(0).cast("long").alias("n")))
    rows = rows.groupBy("ticker", "block").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ticker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before)


def reached(summary: DataFrame, touched: DataFrame, rows: int, backwards: bool = False) -> DataFrame:
    """(ticker, block): the touched blocks and those with fewer than ``rows`` stored rows between.

    ``touched`` may have ``tail``: the rows of the block behind its last touched one. A ticker has one summary row
    a block, so the join within a ticker stays small.
    """
    tail = F.col("tail") if "tail" in touched.columns else F.lit(0)
    touched = touched.groupBy("ticker", "block").agg(F.min(tail).alias("tail"))
    counted = _counted(summary.join(touched.select("ticker").distinct(), "ticker", "left_semi"), touched)
    t = touched.join(counted, ["ticker", "block"]).select("ticker", F.col("block").alias("t"), F.col("before").alias("t_before"),
                                                          (F.col("before") + F.col("n") - F.col("tail")).alias("t_through"))
    near = F.col("t_before") - (F.col("before") + F.col("n")) < rows if backwards else F.col("before") - F.col("t_through") < rows
    side = F.col("block") < F.col("t") if backwards else F.col("block") > F.col("t")
    found = counted.join(t, "ticker").where((F.col("block") == F.col("t")) | (side & near))
    return found.select("ticker", "block").distinct()


def plan_blocks(summary: DataFrame, touched: DataFrame, sym: DataFrame, grain: Grain) -> tuple[DataFrame, DataFrame]:
    """(changed, read): the (ticker, block)s to compute again, and those whose rows that takes."""
    own = reached(summary, touched, grain.look_back)
    pairs = sym.where(F.col("benchmark_ticker").isNotNull()).select("ticker", "benchmark_ticker")
    dependents = pairs.join(own.withColumnRenamed("ticker", "benchmark_ticker"), "benchmark_ticker").select("ticker", "block")
    changed = own.unionByName(dependents).distinct()
    benchmarks = pairs.join(changed, "ticker").select(F.col("benchmark_ticker").alias("ticker"), "block")
    read = reached(summary, changed.unionByName(benchmarks), grain.look_back, backwards=True)
    return changed, read


def summarize(rows: DataFrame, grain: Grain) -> DataFrame:
    """One row per (ticker, block) of a mart's rows."""
    close = F.struct(F.col("close_price").alias("close"), F.col(grain.time).alias("at"))
    top = F.max(F.when(F.col("close_price").isNotNull(), close))
    return rows.groupBy("ticker", *PARTITION).agg(F.count(F.lit(1)).alias("n"), top.alias("_top")).select(
        "ticker", "n", F.col("_top.close").alias("peak"), F.col("_top.at").alias("peak_at"), *PARTITION)


def summary_path(path: str) -> str:
    return f"{path.rstrip('/')}_blocks"


def _summary(spark: SparkSession, path: str) -> DataFrame:
    stored = read_if_exists(spark, summary_path(path))
    if stored is not None:
        return stored
    return spark.createDataFrame([], "ticker string, n long, peak decimal(10,2), peak_at date, block int, ticker_bucket int")


@dataclass
class Refresh:
    """What a refresh left in its staging folder."""
    #: (ticker, block) computed again, and read for that
    changed: DataFrame
    read: DataFrame
    #: rows of the mart that are new or have other values than before
    differing: DataFrame
    #: (ticker, block, peak, peak_at, moved): what is carried into a block; moved: other than before the refresh
    carried: DataFrame | None
    parts: list[tuple[int, int]]


def refresh(spark: SparkSession, keys: DataFrame, events_path: str, sym: DataFrame, path: str, staging: str,
            grain: Grain) -> Refresh:
    """Bring the mart at ``path`` up to date after a batch; ``keys``: (ticker, time) of the batch's rows.

    ``staging`` names one batch: a complete staging folder is taken as the interrupted refresh of that batch.
    """
    done = f"{staging}/carried" if grain is DAILY else f"{staging}/differing"
    if not exists(spark, f"{done}/_SUCCESS"):
        _stage(spark, keys, events_path, sym, path, staging, grain)
    read = lambda name: spark.read.parquet(f"{staging}/{name}")
    changed = read("changed")
    parts = partitions_of(changed)
    rows = read("rows")
    replace_partitions(rows, path, parts)
    replace_partitions(read("summary"), summary_path(path), parts)
    return Refresh(changed, read("read"), read("differing"), read("carried") if grain is DAILY else None, parts)


def _stage(spark: SparkSession, keys: DataFrame, events_path: str, sym: DataFrame, path: str, staging: str, grain: Grain) -> None:
    keys = written(with_block(keys.select("ticker", grain.time).distinct(), grain), f"{staging}/keys")
    days = [r[0] for r in keys.select(F.to_date(grain.time)).distinct().collect()]  # bounded by the batch
    dates = sorted({d for day in days if day is not None for d in grain.utc_dates(day)})
    events = spark.read.parquet(events_path).filter(F.col("event_date").isin(*dates))
    fresh = grain.aggregates(stage_stock_prices(events)).join(keys.select("ticker", grain.time), ["ticker", grain.time], "left_semi")
    old, stored = _summary(spark, path), read_if_exists(spark, path)
    touched = keys.groupBy("ticker", "block").agg(F.max(grain.time).alias("_last"))
    if stored is not None:
        behind = stored.where(in_partitions(partitions_of(keys))).join(touched, ["ticker", "block"]).where(F.col(grain.time) > F.col("_last")) \
            .groupBy("ticker", "block").agg(F.count(F.lit(1)).alias("tail"))
        touched = touched.join(behind, ["ticker", "block"], "left").fillna(0, ["tail"])
    changed, need = plan_blocks(old, touched, sym, grain)
    changed, need = written(changed, f"{staging}/changed"), written(need, f"{staging}/read")
    parts = partitions_of(changed)
    base = fresh
    if stored is not None:
        prior = stored.where(in_partitions(partitions_of(need))).join(need, ["ticker", "block"], "left_semi")
        base = prior.select(*grain.aggregate_columns).join(keys.select("ticker", grain.time), ["ticker", grain.time], "left_anti") \
            .unionByName(fresh)
    again = with_block(grain.from_aggregates(base, sym), grain).join(changed, ["ticker", "block"], "left_semi")
    again = written(again, f"{staging}/again")
    rows, differing = again, again
    if stored is not None:
        here = stored.where(in_partitions(parts))
        rows = again.unionByName(here.join(changed, ["ticker", "block"], "left_anti").select(*again.columns))
        differing = again.join(_same(again, here, grain), ["ticker", grain.time], "left_anti")
    rows = written(rows, f"{staging}/rows")
    new = written(summarize(rows, grain), f"{staging}/summary")
    written(differing, f"{staging}/differing")
    if grain is DAILY:
        written(_carried(old, new, keys, parts), f"{staging}/carried")


def _same(again: DataFrame, stored: DataFrame, grain: Grain) -> DataFrame:
    """Keys of the rows that are stored with the same values."""
    values = [c for c in again.columns if c not in ("ticker", grain.time, *PARTITION)]
    a = again.select("ticker", grain.time, F.struct(*values).alias("a"))
    b = stored.select("ticker", grain.time, F.struct(*values).alias("b"))
    return a.join(b, ["ticker", grain.time]).where(F.col("a").eqNullSafe(F.col("b"))).select("ticker", grain.time)


def _carried(old: DataFrame, new: DataFrame, keys: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """Peaks carried into every block of the touched tickers, with whether they are other than before."""
    tickers = keys.select("ticker").distinct()
    old = old.join(tickers, "ticker", "left_semi")
    kept = old.where(~in_partitions(parts)).unionByName(new.join(tickers, "ticker", "left_semi").select(*old.columns))
    was = carried_peaks(old).select("ticker", "block", F.struct("peak", "peak_at").alias("was"))
    now = carried_peaks(kept).select("ticker", "block", "peak", "peak_at")
    return now.join(was, ["ticker", "block"], "left").select(
        "ticker", "block", "peak", "peak_at", (~F.struct("peak", "peak_at").eqNullSafe(F.col("was"))).alias("moved"))


def rewrite(again: DataFrame, changed: DataFrame, path: str, staging: str) -> list[tuple[int, int]]:
    """Replace the rows of the (ticker, block)s ``changed`` in a dependent mart by ``again``; returns the folders."""
    spark = again.sparkSession
    parts = partitions_of(changed)
    rows, stored = again, read_if_exists(spark, path)
    if stored is not None:
        rows = again.unionByName(stored.where(in_partitions(parts)).join(changed, ["ticker", "block"], "left_anti").select(*again.columns))
    replace_partitions(written(rows, staging), path, parts)
    return parts
