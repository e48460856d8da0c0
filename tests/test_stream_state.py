"""State kept between micro-batches: identities, mart blocks, open hours, alerts, metrics."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.staging import stage_stock_prices, stage_symbol_reference
from tidemark.operators.validation import validate_events
from tidemark.plans import marts as M
from tidemark.sources import identity as I
from tidemark.sources.fixtures import load_raw_messages, load_stock_prices, metric_events_from_events
from tidemark.streaming import blocks as B
from tidemark.streaming import hours as H
from tidemark.streaming import jobs as S

SF = "/root/testdata/sf0.001"

EVENT = "id long, ticker string, price decimal(10,2), volume long, event_time timestamp, source string, open_price decimal(10,2), " \
        "high_price decimal(10,2), low_price decimal(10,2), close_price decimal(10,2), event_kind string, bar_interval string, " \
        "market_session string, inserted_at timestamp"
SYM = "ticker string, company_name string, sector string, benchmark_ticker string, benchmark_name string"


def same(a, b):
    return sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def price_events(spark, rows):
    """rows: (id, ticker, day, close, volume), at 15:00 UTC of the day."""
    found = [(i, t, float(c), v, dt.datetime.combine(d, dt.time(15, 0)), "s", float(c), float(c), float(c), float(c), "live_snapshot", "1m",
              "regular", dt.datetime(2024, 12, 1)) for i, t, d, c, v in rows]
    kinds = EVENT.replace("decimal(10,2)", "double")
    df = spark.createDataFrame(found, kinds)
    return df.select(*[F.col(c).cast("decimal(10,2)").alias(c) if c.endswith("price") else F.col(c) for c in df.columns])


# ------------------------------------------------------------------------------------------ STR-4
def split_messages(spark):
    """Two halves of the messages without a common identity."""
    raw = load_raw_messages(spark, SF).persist()
    half = F.pmod(F.xxhash64(F.get_json_object("value", "$.ticker"), F.get_json_object("value", "$.event_time")), F.lit(2))
    return raw.where(F.coalesce(half, F.lit(0)) == 0), raw.where(half == 1)


def test_a_batch_without_repeats_reads_no_event_file(spark, tmp_path):
    events, dead = str(tmp_path / "events"), str(tmp_path / "dead")
    one, two = split_messages(spark)
    first = S.ingest_batch(one, 0, events, dead)
    assert first["events_persisted"] > 0 and first["possible_repeats"] == 0
    stored = files(events)
    for f in stored:  # a batch that read them would fail
        os.rename(f, f + ".aside")
        open(f, "wb").write(b"not parquet")
    second = S.ingest_batch(two, 1, events, dead)
    assert second["possible_repeats"] == 0 and second["events_persisted"] > 0
    for f in stored:
        os.replace(f + ".aside", f)
    every = spark.read.parquet(events)
    assert every.count() == first["events_persisted"] + second["events_persisted"] == every.select(*I.IDENTITY).distinct().count()


def test_replayed_late_and_repeated_events_append_nothing(spark, tmp_path):
    events, dead = str(tmp_path / "events"), str(tmp_path / "dead")
    one, two = split_messages(spark)
    n = S.ingest_batch(one, 0, events, dead)["events_persisted"]
    again = S.ingest_batch(one, 1, events, dead)
    assert again["events_persisted"] == 0 and again["possible_repeats"] == n
    mixed = S.ingest_batch(one.unionByName(two), 2, events, dead)
    assert mixed["possible_repeats"] >= n and mixed["events_persisted"] > 0
    I.compact(spark, events)
    assert os.listdir(I.filter_path(events)) == ["gen=1"]
    assert S.ingest_batch(one.unionByName(two), 3, events, dead)["events_persisted"] == 0


def test_a_stop_between_filter_and_events_loses_nothing(spark, tmp_path):
    events, dead = str(tmp_path / "events"), str(tmp_path / "dead")
    one, two = split_messages(spark)
    S.ingest_batch(one, 0, events, dead)
    checked = validate_events(two)
    from tidemark.operators.validation import split_valid
    I.note(spark, split_valid(checked)[0], events)  # the batch died after this
    n = S.ingest_batch(two, 1, events, dead)
    assert n["events_persisted"] > 0 and n["possible_repeats"] >= n["events_persisted"]
    every = spark.read.parquet(events)
    assert every.count() == every.select(*I.IDENTITY).distinct().count()


def test_a_table_without_a_filter_gets_one_and_a_full_filter_only_asks_more(spark, tmp_path):
    from tidemark.sources.sinks import write_events
    events, dead = str(tmp_path / "events"), str(tmp_path / "dead")
    one, two = split_messages(spark)
    S.ingest_batch(one, 0, events, dead)
    plain = str(tmp_path / "plain")
    spark.read.parquet(events).write.partitionBy("event_date").parquet(plain)  # as a batch job left it
    assert not I.has_filter(spark, plain)
    assert S.ingest_batch(one, 0, plain, dead)["events_persisted"] == 0 and I.has_filter(spark, plain)
    batch = spark.read.parquet(events).select(*I.IDENTITY)
    full = I.with_possible(spark, batch.withColumn("source", F.lit("other")), plain, words=1)  # asks words no one wrote
    assert set(full.columns) == {*I.IDENTITY, "possible"}
    tight = I.identity_bits(batch, words=1)
    assert tight.count() <= batch.select(F.to_date("event_time")).distinct().count()
    # a batch job that appends to a table with a filter tells the filter
    more = spark.read.parquet(events).limit(0).withColumn("event_date", F.to_date("event_time"))
    write_events(more, plain)
    assert I.with_possible(spark, batch, plain).where("NOT possible").count() == 0


def test_redelivered_messages_are_dropped_in_the_state_store(spark, tmp_path):
    src = str(tmp_path / "topic")
    raw = load_raw_messages(spark, SF).limit(50)
    raw.write.parquet(f"{src}/a")
    out = str(tmp_path / "out")
    ck = str(tmp_path / "ck")

    def run():
        stream = spark.readStream.schema(raw.schema).option("recursiveFileLookup", "true").parquet(src)
        S.without_redelivery(stream, "1 hour").writeStream.format("parquet").option("checkpointLocation", ck) \
            .trigger(availableNow=True).start(out).awaitTermination()

    run()
    raw.write.parquet(f"{src}/b")  # the broker sends everything once more, after a restart
    run()
    assert spark.read.parquet(out).count() == 50 == spark.read.parquet(out).select("topic", "partition", "offset").distinct().count()


# ------------------------------------------------------------------------------------------ STR-8, WN-3/4
def test_segmented_drawdown_equals_the_plain_window(spark):
    import random
    r = random.Random(4)
    rows = [(t, dt.date(2023, 1, 1) + dt.timedelta(days=d), None if r.random() < .05 else float(r.choice([5, 7, 7, 9, 9, 11, 0])), dt.datetime(2024, 1, 1))
            for t in "ABC" for d in sorted(r.sample(range(400), 150))]
    daily = spark.createDataFrame(rows, "ticker string, trade_date date, close_price double, last_updated_at timestamp") \
        .withColumn("close_price", F.col("close_price").cast("decimal(10,2)"))
    want = M.stock_drawdown_recovery(daily)
    assert same(M.segmented_drawdown(daily), want)
    assert same(M.segmented_drawdown(daily, F.datediff("trade_date", F.lit("2023-01-01").cast("date")) / 3), want)
    assert same(M.segmented_drawdown(daily, F.lit(0)), want)
    plan = M.segmented_drawdown(daily)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    for w in windows:  # rows by (ticker, block); over a whole ticker only the block summaries
        assert "block" in w.rsplit("], [", 2)[1] or "_top" not in w and "close_price" not in w


def calendar(spark):
    """Three tickers (A is the benchmark of B), a row every third day of four months."""
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=3 * i) for i in range(38)]
    rows = [(i * 4 + j, t, d, 50 + (i * (j + 3)) % 17 + j, 100 + (i * 7 + j) % 13 * 20) for i, d in enumerate(days) for j, t in enumerate("ABD")]
    return rows, spark.createDataFrame([("A", "a", "x", None, None), ("B", "b", "x", "A", "a"), ("D", "d", "y", None, None)], SYM)


def test_a_late_event_rewrites_only_the_blocks_it_reaches(spark, tmp_path):
    base, as_of = str(tmp_path), "2024-06-01 00:00:00"
    rows, sym = calendar(spark)
    late = [r for r in rows if r[1] == "B" and r[2] == dt.date(2023, 2, 7)]
    # a new highest close of D far back; A, B's benchmark, on a month's last day
    far = [(9000, "D", dt.date(2023, 2, 3), 990, 5), (9001, "A", dt.date(2023, 3, 31), 77, 900)]
    assert late
    rows_before, rewritten = {}, []
    for i, batch in enumerate([[r for r in rows if r not in late], late, far]):
        events = price_events(spark, batch).withColumn("event_date", F.to_date("event_time"))
        events.coalesce(1).write.mode("append").partitionBy("event_date").parquet(f"{base}/events")
        keys = events.select("ticker", M.ny_date(F.col("event_time")).alias("trade_date")).distinct()
        was = files(f"{base}/daily") | files(f"{base}/marts")
        done = S.refresh_marts_batch(spark, keys, f"{base}/events", sym, f"{base}/daily", f"{base}/st/{i}")
        if i != 1:
            S.refresh_dependent_marts(spark, done, f"{base}/daily", f"{base}/marts", as_of, f"{base}/st/{i}/marts")
        now = files(f"{base}/daily") | files(f"{base}/marts")
        rewritten.append({f for f in was if now.get(f) != was[f]})
        daily = spark.read.parquet(f"{base}/daily")
        rows_now = {str(r): (r["ticker"], r["trade_date"]) for r in daily.drop(*B.PARTITION).collect()}
        assert sorted(tuple(r) for r in done.differing.select("ticker", "trade_date").collect()) == \
            sorted(k for r, k in rows_now.items() if r not in rows_before), i
        rows_before = rows_now

    def months(paths, mart):
        found = {int(f.split("block=")[1].split("/")[0]) for f in paths if f"/{mart}/" in f and "block=" in f}
        return {(b - 1) // 12 * 100 + (b - 1) % 12 + 1 for b in found}

    assert months(rewritten[1], "daily") == {202302}  # seven rows on are still in February
    assert months(rewritten[2], "daily") == {202302, 202303, 202304}  # the look-back reaches over March's end
    assert months(rewritten[2], "stock_drawdown_recovery") == {202302, 202303, 202304}  # the peak is carried to the end
    assert not any("block=24277" in f for f in set().union(*rewritten))  # January keeps its files
    want = M.daily_stock_summary(stage_stock_prices(spark.read.parquet(f"{base}/events")), sym)
    assert same(daily, want)
    stored = daily.drop(*B.PARTITION)
    for name, df in {"stock_drawdown_recovery": M.stock_drawdown_recovery(stored), "stock_risk_indicators": M.stock_risk_indicators(stored),
                     "stock_signal_feature_store": M.signal_feature_store(stored, as_of)}.items():
        # the batch between them only told of B in February: its dependent marts were not asked for
        got = spark.read.parquet(f"{base}/marts/{name}")
        assert same(got.where("ticker <> 'B'"), df.where("ticker <> 'B'")), name


def test_a_repeated_refresh_takes_its_staging(spark, tmp_path):
    base = str(tmp_path)
    rows, sym = calendar(spark)
    events = price_events(spark, rows[:40]).withColumn("event_date", F.to_date("event_time"))
    events.write.partitionBy("event_date").parquet(f"{base}/events")
    keys = events.select("ticker", M.ny_date(F.col("event_time")).alias("trade_date")).distinct()
    one = S.refresh_marts_batch(spark, keys, f"{base}/events", sym, f"{base}/daily", f"{base}/st")
    n = one.differing.count()
    B.delete(spark, f"{base}/daily")  # as if the batch had died before the mart was replaced
    two = S.refresh_marts_batch(spark, keys, f"{base}/events", sym, f"{base}/daily", f"{base}/st")
    assert two.differing.count() == n == spark.read.parquet(f"{base}/daily").count() > 0


# ------------------------------------------------------------------------------------------ STR-7
def test_finished_hours_are_written_once_and_late_rows_correct_them(spark, tmp_path):
    events = stage_stock_prices(load_stock_prices(spark, SF)).persist()
    cut = events.selectExpr("percentile_approx(unix_micros(event_time), array(0.3, 0.6), 10000) p").first()[0]
    t = F.unix_micros("event_time")
    late = F.pmod("id", F.lit(7)) == 0
    parts = [events.where((t < cut[0]) & ~late), events.where((t >= cut[0]) & (t < cut[1]) | (t < cut[0]) & late), events.where(t >= cut[1])]
    out = str(tmp_path / "bars")
    H.hourly_batch(spark, parts[0], 0, out)
    H.hourly_batch(spark, parts[1], 1, out)
    kept = files(f"{out}/bars")
    B.delete(spark, f"{out}/marks/batch_id=1")  # stopped before the batch was complete: it is repeated
    H.hourly_batch(spark, parts[1], 1, out)
    assert {f for f in kept if "batch_id=0" in f} <= set(files(f"{out}/bars"))
    H.hourly_batch(spark, parts[2], 2, out)
    assert spark.read.parquet(f"{out}/corrections").count() > 0
    key = ["ticker", "interval_start"]
    bars = spark.read.parquet(f"{out}/bars")
    assert bars.count() == bars.select(*key).distinct().count() > 0  # each finished hour once
    hagg = M.hourly_aggregates(events).drop("last_updated_at")
    assert same(H.current_bars(spark, out), hagg)
    open_hours = spark.read.parquet(f"{out}/open/batch_id=2").select("interval_start").distinct().count()
    assert open_hours <= 3 and sorted(os.listdir(f"{out}/open")) == ["batch_id=1", "batch_id=2"]
    # compaction hands over to the running log
    assert H.compact_bars(spark, out) == 2
    assert same(H.current_bars(spark, out), hagg)
    H.hourly_batch(spark, events.limit(0), 3, out)
    one = events.where("market_session <> 'closed'").limit(1).withColumns({"id": F.lit(10 ** 9), "volume": F.lit(5).cast("long")})
    H.hourly_batch(spark, one, 4, out)
    assert same(H.current_bars(spark, out), M.hourly_aggregates(events.unionByName(one)).drop("last_updated_at"))
    assert os.listdir(f"{out}/base") == ["through=2"]


# ------------------------------------------------------------------------------------------ STR-9
def test_a_batch_says_only_what_changed(spark, tmp_path):
    log = str(tmp_path / "alerts")
    sym = spark.createDataFrame([("T", "c", "s", None, None), ("U", "c", "s", None, None)], SYM)
    watch = spark.createDataFrame([("p", "T", 3.0, 9.0), ("q", "T", 5.0, 9.0), ("q", "U", 3.0, 9.0)],
                                  "principal_id string, ticker string, price_alert_threshold double, volume_alert_threshold double")

    def daily(rows):
        return spark.createDataFrame([(t, dt.date(2024, 1, d), 1.0, p, p, 1.0, "normal") for t, d, p in rows],
                                     "ticker string, trade_date date, close_price double, relative_price_change_pct double, price_change_pct double, "
                                     "volume_vs_avg_ratio double, anomaly_flag string")

    def said(rows, batch):
        out = S.emit_alerts(spark, daily(rows), watch, sym, log, batch)
        return sorted((r["principal_id"], r["ticker"], r["trade_date"].day, r["change"]) for r in out.collect())

    assert said([("T", 1, 6.0), ("T", 2, 4.0), ("U", 1, 1.0)], "a/0") == [("p", "T", 1, "new"), ("p", "T", 2, "new"), ("q", "T", 1, "new")]
    assert said([("T", 1, 6.0), ("T", 2, 4.0)], "a/1") == []  # nothing to say twice
    second = [("T", 1, 4.5), ("U", 1, -3.5)]
    want = [("p", "T", 1, "changed"), ("q", "T", 1, "withdrawn"), ("q", "U", 1, "new")]
    assert said(second, "a/2") == want
    assert said(second, "a/2") == want  # the repeated batch says the same and is stored once
    now = daily([("T", 1, 4.5), ("T", 2, 4.0), ("U", 1, -3.5)])
    assert same(S.current_alerts(spark, log), S.alerts_for_batch(now, watch, sym))
    assert said([("T", 1, 0.0), ("T", 2, 0.0), ("U", 1, 0.0)], "b/0") == [("p", "T", 1, "withdrawn"), ("p", "T", 2, "withdrawn"), ("q", "U", 1, "withdrawn")]
    assert S.current_alerts(spark, log).count() == 0


# ------------------------------------------------------------------------------------------ MET-1
def test_metrics_go_on_after_a_restart(spark, tmp_path):
    from tidemark.operators.quality import rollup_metrics
    events = metric_events_from_events(spark.read.parquet(f"{SF}/events.parquet")).persist()
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for i in range(3):
        events.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i).write.parquet(f"{src}/{i}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(src)
        S.metrics_stream(stream, out, ck).awaitTermination()
        done = events.where(F.pmod(F.xxhash64("seq"), F.lit(3)) <= i)
        assert same(S.current_metrics(spark, out), rollup_metrics(done))
    assert len([n for n in os.listdir(out) if n.startswith("batch_id=")]) <= 2
