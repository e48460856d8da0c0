"""Size-checked broadcast.

A broadcast hint is placed only when Catalyst's size estimate of the small side (from the
optimised logical plan — no job runs) is under the limit; otherwise the join is left to the
planner and AQE, which re-plan at runtime from the actual shuffle sizes. Static row bounds (e.g.
benchmarks × days) are checked by the callers that have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast sides above this estimated size are never hinted.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (bytes), without executing it."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``F.broadcast(df)`` when its estimated size is at most ``max_bytes``, else ``df`` unchanged."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df
