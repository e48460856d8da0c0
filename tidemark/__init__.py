"""tidemark: market-data analytics on Spark DataFrames, SQL and Structured Streaming.

Layout:
    sources/    readers, the symbol dimension, fixture mapping of the driver tables, sinks
    functions/  Column-level helpers (calendar arithmetic, symbols, exact rounding, text)
    operators/  DataFrame operators (staging, validation, news, quality, mutations)
    plans/      the marts and the served analytic queries built from the operators
    streaming/  Structured Streaming jobs (ingest, hourly bars, incremental refresh, alerts)
"""

from tidemark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
