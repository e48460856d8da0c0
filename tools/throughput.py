"""
and streaming ingest rows per second (file source, availableNow), at $BENCH_SF_DIR.

The message fixture is written once to the scratch folder (8 files), so the timings measure
validation / ingest, not fixture generation.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    from tidemark.operators.validation import split_valid, validate_events
    from tidemark.session import get_spark, scratch_path
    from tidemark.sources.fixtures import load_raw_messages
    from tidemark.sources.ingest import MESSAGE_SCHEMA
    from tidemark.streaming.jobs import ingest_stream
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    run = scratch_path(spark, f"throughput-{uuid.uuid4().hex}")
    load_raw_messages(spark, sf).repartition(cpus).write.json(f"{run}/messages")
    msgs = spark.read.schema(MESSAGE_SCHEMA).json(f"{run}/messages")
    n = msgs.count()
    valid, invalid = split_valid(validate_events(msgs))
    valid.write.format("noop").mode("overwrite").save()          # warm-up (codegen)
    t0 = time.perf_counter()
    valid.write.format("noop").mode("overwrite").save()
    invalid.write.format("noop").mode("overwrite").save()
    t_val = time.perf_counter() - t0
    stream = spark.readStream.schema(MESSAGE_SCHEMA).json(f"{run}/messages")
    t0 = time.perf_counter()
    q = ingest_stream(stream, f"{run}/events", f"{run}/dead", f"{run}/_ck")
    q.awaitTermination()
    t_stream = time.perf_counter() - t0
    print(json.dumps({"messages": n, "batch_validate_sec": round(t_val, 3),
                      "events_validated_per_sec": round(n / t_val), "stream_ingest_sec": round(t_stream, 3),
                      "stream_rows_per_sec": round(n / t_stream), "cpus": cpus}))


if __name__ == "__main__":
    main()
