"""SRC-1 / SNK-5: a partitioned message log as a Spark data source (``format("topic_log")``).

For sites without a broker connector: topics live in a shared folder, written and read by Spark tasks.

* A writer's tasks write one Parquet file per topic partition; the driver then commits the batch by one
  entry in ``_log``, which gives every file its partition's next offsets. An entry appears whole or not
  at all, so readers never see half a batch; one writer commits at a time (a taken entry is an error).
  A streaming writer's repeated batch is recognised and committed once.
* Every entry carries the offsets behind it, so a reader asks only the newest entry where a topic ends and
  goes back no further than its own backlog. Tasks read ranges of offsets of one partition.
* A reader starts at ``startingOffsets``: ``earliest`` (default), ``latest``, ``group`` (where the group
  ``groupId`` stands) or a JSON object {partition: offset}; afterwards its checkpoint counts. Offsets outside
  the log are an error. The position of ``groupId``, if given, is written to ``_groups`` behind its batches: when
  the next one starts, and by ``commit_progress`` when a query has ended. It is never ahead of what was read.

Columns: topic, partition, offset, value, timestamp. Options: path, topic, partitions (when first written),
startingOffsets, groupId, recordsPerTask, recordsPerTrigger, writer (a streaming writer's name).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter,
                                    DataSourceStreamReader, InputPartition, WriterCommitMessage)

SCHEMA = "topic string, partition int, offset long, value string, timestamp timestamp"
PARTITIONS = 8
RECORDS_PER_TASK = 500_000


class TopicFolder:
    """One topic's folder and its commit entries."""

    def __init__(self, path: str, topic: str):
        self.fs, root = pafs.FileSystem.from_uri(path)
        self.topic, self.root = topic, f"{root.rstrip('/')}/{topic}"
        self.log = f"{self.root}/_log"

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.log, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def entry(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.log}/{version:020d}.json") as f:
            return json.loads(f.read())

    def newest(self) -> dict | None:
        versions = self.versions()
        return self.entry(versions[-1]) if versions else None

    def ends(self) -> dict[int, int]:
        """Per partition the offset behind its last message."""
        entry = self.newest()
        return {int(p): n for p, n in entry["ends"].items()} if entry else {}

    def starts(self) -> dict[int, int]:
        """Per partition its first offset still there."""
        versions = self.versions()
        return {int(p): n for p, n in self.entry(versions[0])["starts"].items()} if versions else {}

    def files(self, start: dict[int, int], end: dict[int, int]) -> list[dict]:
        """Files with messages of the ranges, newest entries first and no further back than needed."""
        found = []
        for version in reversed(self.versions()):
            entry = self.entry(version)
            found += [f for f in entry["files"] if f["base"] < end.get(f["partition"], 0)
                      and f["base"] + f["count"] > start.get(f["partition"], 0)]
            if all(int(p) not in end or n <= start.get(int(p), 0) for p, n in entry["starts"].items()):
                break
        return found

    def commit(self, written: list[dict], partitions: int, writer: str | None = None, batch: int | None = None) -> None:
        last = self.newest() or {"version": -1, "ends": {str(p): 0 for p in range(partitions)}, "writers": {}}
        if writer is not None and last["writers"].get(writer, -1) >= batch:
            self.remove(written)  # this batch is in the log already
            return
        ends, files = dict(last["ends"]), []
        for f in written:
            p = str(f["partition"])
            files.append(f | {"base": ends[p]})
            ends[p] += f["count"]
        writers = last["writers"] | ({writer: batch} if writer is not None else {})
        entry = {"version": last["version"] + 1, "starts": last["ends"], "ends": ends, "files": files, "writers": writers}
        self.put(f"{self.log}/{entry['version']:020d}.json", entry, new=True)

    def put(self, path: str, content: dict, new: bool = False) -> None:
        """Write a small file whole: aside first, then by renaming."""
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        if new and self.fs.get_file_info(path).type != pafs.FileType.NotFound:
            raise RuntimeError(f"{path} was committed by another writer")
        aside = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(aside, path)

    def remove(self, written: list[dict]) -> None:
        for f in written:
            self.fs.delete_file(f"{self.root}/{f['file']}")

    def group(self, name: str) -> dict[int, int] | None:
        path = f"{self.root}/_groups/{name}.json"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return {int(p): n for p, n in json.loads(f.read()).items()}

    def put_group(self, name: str, offsets: dict) -> None:
        self.put(f"{self.root}/_groups/{name}.json", offsets)

    def read(self, part: OffsetRange) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        with self.fs.open_input_file(f"{self.root}/{part.file}") as f:
            table = pq.ParquetFile(f).read().slice(part.first - part.base, part.end - part.first)
        n = len(table)
        for batch in pa.table({"topic": pa.array([self.topic] * n, pa.string()), "partition": pa.array([part.partition] * n, pa.int32()),
                               "offset": pa.array(range(part.first, part.end), pa.int64()), "value": table["value"],
                               "timestamp": table["timestamp"]}).to_batches(max_chunksize=10_000):
            yield batch


@dataclass
class OffsetRange(InputPartition):
    """Offsets [first, end) of a partition, in one file whose first message has offset ``base``."""
    partition: int
    file: str
    base: int
    first: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


def _ranges(folder: TopicFolder, start: dict[int, int], end: dict[int, int], per_task: int) -> list[OffsetRange]:
    found = []
    for f in folder.files(start, end):
        p, base = f["partition"], f["base"]
        at, to = max(base, start.get(p, 0)), min(base + f["count"], end[p])
        while at < to:
            found.append(OffsetRange(p, f["file"], base, at, min(to, at + per_task)))
            at += per_task
    return found


def _checked(folder: TopicFolder, offsets: dict[int, int]) -> dict[int, int]:
    starts, ends = folder.starts(), folder.ends()
    for p, n in offsets.items():
        if p not in ends or not starts[p] <= n <= ends[p]:
            raise ValueError(f"topic {folder.topic}: offset {n} of partition {p} lies outside the log {starts.get(p)}..{ends.get(p)}")
    return {p: offsets.get(p, starts[p]) for p in ends}


def _initial(folder: TopicFolder, options: dict) -> dict[int, int]:
    wanted = options.get("startingoffsets", "earliest")
    if wanted == "earliest":
        return folder.starts()
    if wanted == "latest":
        return folder.ends()
    if wanted == "group":
        return _checked(folder, folder.group(options["groupid"]) or {})
    return _checked(folder, {int(p): n for p, n in json.loads(wanted).items()})


# options come with their names in lower case
class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.folder = TopicFolder(options["path"], options["topic"])
        self.per_task = int(options.get("recordspertask", RECORDS_PER_TASK))
        self.per_trigger = int(options["recordspertrigger"]) if "recordspertrigger" in options else None
        self.at: dict[int, int] | None = None

    def initialOffset(self) -> dict:
        return {str(p): n for p, n in _initial(self.folder, self.options).items()}

    def latestOffset(self) -> dict:
        ends = self.folder.ends()
        if self.per_trigger is not None:
            at = self.at if self.at is not None else _initial(self.folder, self.options)
            share = max(1, self.per_trigger // max(1, len(ends)))
            ends = {p: min(n, at.get(p, 0) + share) for p, n in ends.items()}
        return {str(p): n for p, n in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[OffsetRange]:
        first, last = ({int(p): n for p, n in o.items()} for o in (start, end))
        first = _checked(self.folder, first)
        _checked(self.folder, last)
        self._position(start)  # all before it has been processed
        self.at = last
        return _ranges(self.folder, first, last, self.per_task)

    def read(self, partition: OffsetRange) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        self.at = {int(p): n for p, n in end.items()}
        self._position(end)

    def _position(self, offsets: dict) -> None:
        if "groupid" in self.options:
            self.folder.put_group(self.options["groupid"], offsets)


class _Reader(DataSourceReader):
    """The log as it stands, from ``startingOffsets``."""

    def __init__(self, options: dict):
        self.options, self.folder = options, TopicFolder(options["path"], options["topic"])

    def partitions(self) -> list[OffsetRange]:
        return _ranges(self.folder, _initial(self.folder, self.options), self.folder.ends(), int(self.options.get("recordspertask", RECORDS_PER_TASK)))

    def read(self, partition: OffsetRange | None) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition) if partition is not None else iter(())


class _Writer:
    """What batch and streaming writers share: a file per topic partition and task."""

    def __init__(self, options: dict):
        self.options, self.folder = options, TopicFolder(options["path"], options["topic"])
        self.count = int(options.get("partitions", PARTITIONS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        open_: dict[int, tuple] = {}
        self.folder.fs.create_dir(self.folder.root, recursive=True)
        kind = pa.schema([("value", pa.string()), ("timestamp", pa.timestamp("us", "UTC"))])
        for batch in iterator:
            for p in pc.unique(batch["partition"]).to_pylist():
                if p not in open_:
                    name = f"{p:05d}-{uuid.uuid4().hex}.parquet"
                    stream = self.folder.fs.open_output_stream(f"{self.folder.root}/{name}")
                    open_[p] = (name, stream, pq.ParquetWriter(stream, kind), [0])
                mine = batch.filter(pc.equal(batch["partition"], p))
                open_[p][2].write_table(pa.table({c: mine[c] for c in ("value", "timestamp")}).cast(kind))
                open_[p][3][0] += len(mine)
        for _, stream, writer, _ in open_.values():
            writer.close()
            stream.close()
        return Written([{"partition": p, "file": name, "count": n[0]} for p, (name, _, _, n) in open_.items()])

    def _files(self, messages: list) -> list[dict]:
        return [f for m in messages if m is not None for f in m.files]


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.folder.commit(self._files(messages), self.count)

    def abort(self, messages: list) -> None:
        self.folder.remove(self._files(messages))


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.folder.commit(self._files(messages), self.count, self.options["writer"], batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.folder.remove(self._files(messages))


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(dict(self.options))


def commit_progress(query, path: str, topic: str, group: str) -> None:
    """Write a group's position as of an ended query's last batch."""
    progress = query.lastProgress
    for source in (json.loads(progress.json)["sources"] if progress else []):
        end = source.get("endOffset")
        if end:
            TopicFolder(path, topic).put_group(group, json.loads(end) if isinstance(end, str) else end)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicLog)


def dealt(messages: DataFrame, partitions: int = PARTITIONS, order: str | None = None) -> DataFrame:
    """(partition, value, timestamp) rows as the writer takes them: one key's messages in one partition, in ``order``."""
    stamp = F.col("timestamp") if "timestamp" in messages.columns else F.current_timestamp()
    rows = messages.withColumns({"partition": F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"), "timestamp": stamp})
    if not messages.isStreaming:
        rows = rows.repartition(partitions, "partition")
        if order:
            rows = rows.sortWithinPartitions("partition", order)
    return rows.select("partition", F.col("value").cast("string").alias("value"), "timestamp")


def publish(messages: DataFrame, path: str, topic: str, partitions: int = PARTITIONS, order: str | None = None) -> None:
    """SNK-5: append (key, value[, timestamp]) messages to a topic as one commit."""
    register(messages.sparkSession)
    dealt(messages, partitions, order).write.format("topic_log").mode("append").options(path=path, topic=topic, partitions=partitions).save()
