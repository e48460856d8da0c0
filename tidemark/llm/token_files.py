"""Token ids as Parquet list columns, written for selective reads.

Documents are dealt into ranges of ascending id (cut at quantiles of the ids, for which the ids alone are
read), tokenised there and written by Spark's Parquet writer: dictionary pages for the token list (delta encoding from writer version 2 for the counters
and wherever a dictionary grows too large), row groups and pages of a stated size, and the column
and offset indexes the writer adds. A reader of ``n_tokens`` or of an id range touches only those
columns, row groups and pages.

Edge cases: ids are whole numbers (others that do not cast to a long stop the run); null and empty texts are
the end id alone; null ids sort first; equal ids are ordered by
their content, equal rows are interchangeable; an empty table gives an empty dataset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import text_rows, with_range
from tidemark.llm.tokens import encoder, public_tokenizer

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DICTIONARY_BYTES = 1 << 20

SCHEMA = "shard int, doc_id long, start_in_shard long, n_tokens int, tokens array<int>"


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Rows in ascending id order within and across partitions, with each row's place in its partition."""
    path = tokenizer or public_tokenizer("byte_bpe_50k.json")
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = (with_range(rows, "doc_id", n, "shard").repartitionById(n, "shard").withColumn("tie", F.xxhash64("text"))
            .sortWithinPartitions("doc_id", "tie").drop("tie"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        enc = encoder(path, "byte")
        at = 0
        for batch in batches:
            shards, ids, starts, lengths, blobs, size = [], [], [], [], [], 0

            def out():
                offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
                np.cumsum(lengths, out=offsets[1:])
                flat = pa.array(np.frombuffer(b"".join(blobs), dtype="<i4"))
                return pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=["shard", "doc_id", "start_in_shard", "n_tokens", "tokens"])

            for shard, doc, text in text_rows(batch, "shard", "doc_id", "text"):
                data = enc.encode(text or "") + end
                shards.append(shard)
                ids.append(doc)
                starts.append(at)
                lengths.append(len(data) // 4)
                blobs.append(data)
                at += len(data) // 4
                size += len(data)
                if size > 16 << 20:
                    yield out()
                    shards, ids, starts, lengths, blobs, size = [], [], [], [], [], 0
            if ids:
                yield out()

    return rows.mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                      row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, **columns: str) -> None:
    """Write the dataset: one file per id range."""
    (token_table(docs, tokenizer, end_id, **columns).write
     .option("compression", "snappy")  # packed dictionary indexes hardly shrink further
     .option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES))
     .option("parquet.enable.dictionary#doc_id", "false")  # ascending: delta encoding
     .option("parquet.enable.dictionary#start_in_shard", "false")
     .option("parquet.enable.dictionary#n_tokens", "false")
     .option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.size", str(page_bytes))
     .parquet(path))


def read_token_files(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """The dataset with ``start``: the number of ids before the document over all files.

    Totals per file come from the counters alone (one row per file, so that table is broadcast); the
    list column is read only on request.
    """
    from pyspark.sql import Window
    data = spark.read.schema(SCHEMA).parquet(path)
    totals = data.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file
    base = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = data.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("start_in_shard"))
    keep = ["doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens")]
    return out.select(*keep, "tokens") if tokens else out.select(*keep)


def token_digest(data: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, from the lists as they were read back."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for batch in batches:
            lists = batch.column("tokens")
            values = lists.values.to_numpy(zero_copy_only=False).view("<u4")  # int32 ids, read in place
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            sizes = pa.array(np.diff(at).astype("int64"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), sizes,
                                              pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return data.select("doc_id", "start", "tokens").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
