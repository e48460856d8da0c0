"""The message log: offsets per partition, consumers with their own positions, restarts, bad offsets."""
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import topic_log as T
from tidemark.sources.fixtures import load_stock_prices
from tidemark.sources.ingest import read_price_stream
from tidemark.sources.sinks import publish_events
from tidemark.sources.tables import EVENT_COLUMNS

SF = "/root/testdata/sf0.001"


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.col("id").cast("string").alias("value"), "id")


def consume(spark, path, out, ck, trigger=None, **opts):
    q = read_price_stream(spark, "log", "t", path, **opts).writeStream.format("parquet").option("checkpointLocation", ck) \
        .trigger(**(trigger or {"availableNow": True})).start(out)
    q.awaitTermination()
    if "groupId" in opts:
        T.commit_progress(q, path, "t", opts["groupId"])
    return sorted(int(r["value"]) for r in spark.read.parquet(out).collect())


def test_offsets_are_dense_and_ordered_per_partition(spark, tmp_path):
    path = str(tmp_path)
    for start in (0, 100):
        T.publish(rows(spark, 100, start), path, "t", 4, order="id")
    T.register(spark)
    got = spark.read.format("topic_log").options(path=path, topic="t").load().collect()
    assert sorted(int(r["value"]) for r in got) == list(range(200))
    by = {}
    for r in sorted(got, key=lambda r: (r["partition"], r["offset"])):
        by.setdefault(r["partition"], []).append((r["offset"], int(r["value"])))
    for found in by.values():
        assert [o for o, _ in found] == list(range(len(found)))
        assert [v for _, v in found] == sorted(v for _, v in found)  # a key's messages keep their order
    assert {r["topic"] for r in got} == {"t"} and all(r["timestamp"] is not None for r in got)
    part = spark.read.format("topic_log").options(path=path, topic="t", startingOffsets="latest").load()
    assert part.count() == 0


def test_two_consumers_each_with_its_position_and_a_restart(spark, tmp_path):
    path = str(tmp_path / "log")
    T.publish(rows(spark, 50), path, "t", 3)
    a, b = ({"out": str(tmp_path / f"out-{n}"), "ck": str(tmp_path / f"ck-{n}"), "groupId": n} for n in "ab")
    assert consume(spark, path, **a) == list(range(50))
    T.publish(rows(spark, 30, 50), path, "t", 3)
    assert consume(spark, path, **b, recordsPerTask="7") == list(range(80))  # from the earliest, whatever a has read
    folder = T.TopicFolder(path, "t")
    assert sum(folder.group("a").values()) == 50 and sum(folder.group("b").values()) == 80
    T.publish(rows(spark, 20, 80), path, "t", 3)
    assert consume(spark, path, **a) == list(range(100))  # goes on where its checkpoint stands: nothing twice, nothing lost
    assert folder.group("a") == folder.ends()
    # a new query of group b starts where the group stands
    late = consume(spark, path, str(tmp_path / "out-c"), str(tmp_path / "ck-c"), startingOffsets="group", groupId="b")
    assert late == list(range(80, 100))


def test_a_bounded_trigger_reads_the_log_in_steps(spark, tmp_path):
    import time
    path = str(tmp_path / "log")
    T.publish(rows(spark, 60), path, "t", 2)
    sizes = []
    q = read_price_stream(spark, "log", "t", path, recordsPerTrigger="20").writeStream \
        .option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, i: sizes.append(df.count())).trigger(processingTime="0 seconds").start()
    try:
        until = time.time() + 60
        while sum(sizes) < 60 and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert sum(sizes) == 60 and max(sizes) <= 20


@pytest.mark.parametrize("bad", ['{"0": 5000}', '{"9": 0}', '{"0": -1}'])
def test_offsets_outside_the_log_are_errors(spark, tmp_path, bad):
    path = str(tmp_path / "log")
    T.publish(rows(spark, 10), path, "t", 2)
    with pytest.raises(Exception, match="outside the log"):
        consume(spark, path, str(tmp_path / "out"), str(tmp_path / "ck"), startingOffsets=bad)


def test_a_streaming_writer_commits_a_repeated_batch_once(spark, tmp_path):
    src, path, ck = (str(tmp_path / n) for n in ("src", "log", "ck"))
    rows(spark, 40).write.parquet(f"{src}/a")
    T.register(spark)

    def run():
        stream = spark.readStream.schema("key string, value string, id long").option("recursiveFileLookup", "true").parquet(src)
        T.dealt(stream, 3).writeStream.format("topic_log").options(path=path, topic="t", partitions=3, writer="w") \
            .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    run()
    rows(spark, 5, 40).write.parquet(f"{src}/b")
    run()
    last = max(int(n) for n in os.listdir(f"{ck}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):  # stopped after the log took the batch, before the checkpoint did
        os.remove(f"{ck}/commits/{name}")
    run()
    got = spark.read.format("topic_log").options(path=path, topic="t").load()
    assert sorted(int(r["value"]) for r in got.collect()) == list(range(45))
    folder = T.TopicFolder(path, "t")
    with pytest.raises(RuntimeError, match="another writer"):
        folder.put(f"{folder.log}/{0:020d}.json", {}, new=True)


def test_published_events_are_ingested(spark, tmp_path):
    from tidemark.streaming.jobs import ingest_stream
    events = load_stock_prices(spark, SF).select(*EVENT_COLUMNS)
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    publish_events(events.withColumn("event_time", iso), str(tmp_path / "log"), topic="stock_prices")
    ingest_stream(read_price_stream(spark, "log", path=str(tmp_path / "log")), str(tmp_path / "events"), str(tmp_path / "dead"),
                  str(tmp_path / "ck")).awaitTermination()
    dead = spark.read.parquet(str(tmp_path / "dead")).count() if os.path.exists(tmp_path / "dead") else 0
    assert spark.read.parquet(str(tmp_path / "events")).count() + dead >= events.dropDuplicates(["ticker", "event_time", "source", "event_kind", "bar_interval"]).count()
