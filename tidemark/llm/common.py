"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import scratch_path


#: Arrow batches handed to Python stay small, whatever the length of the texts.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    for key, value in ARROW.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared checkpoint folder and read again.

    Cuts the lineage: a lost executor costs the tasks that ran on it, never the stages before.
    ``partitions``: columns by whose values the folder is divided.
    """
    path = scratch_path(df.sparkSession, f"llm-{label}-{uuid.uuid4().hex}")
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """At the end of a task: give Arrow's freed memory back to the system (Python workers are reused)."""
    pa.default_memory_pool().release_unused()


def text_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns of an Arrow batch as Python tuples."""
    return zip(*(batch.column(n).to_pylist() for n in names))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` under neutral names c0, c1 ..., with the row key (i, t): hashes of the id and of the text.

    Whatever extra columns are called, nothing clashes; ``unkeyed`` restores names and order.
    """
    rows = docs.withColumns({f"key {uuid.uuid4().hex}": F.xxhash64(id_col)}).withColumns({f"key {uuid.uuid4().hex}": F.xxhash64(text_col)})
    return rows.toDF(*[f"c{i}" for i in range(len(docs.columns))], "i", "t")


def unkeyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def with_range(rows: DataFrame, col: str, n: int, out: str) -> DataFrame:
    """``rows`` with ``out``: which of at most ``n`` ranges of ascending ``col`` (a long) a row lies in, nulls in the first.

    The ranges are cut at quantiles, read from the column alone; a row finds its range by binary search.
    Rows of one value lie in one range.
    """
    cuts = rows.agg(F.percentile_approx(col, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    limits = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))]).cast("array<int>")

    def step(found, width):
        # the number of limits below the value, one bit at a time
        return F.when(F.coalesce(F.get(limits, found + width - 1) < F.col(col), F.lit(False)), found + width).otherwise(found)

    return rows.withColumn(out, F.aggregate(steps, F.lit(0), step) if cuts else F.lit(0))
