"""The profiler over a stream: each micro-batch's counters are kept, and their sums decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cellprobe.operators.heuristics import COUNTERS, GEO_COUNTERS
from cellprobe.operators.profile import as_cells, counters


def profile_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends a row of counters a column and batch to a Parquet table; a batch that is run again replaces its own rows."""

    def batch(df: DataFrame, number: int) -> None:
        counters(as_cells(df)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(counted: DataFrame) -> DataFrame:
    """Counters of all batches as one: sums, and the greatest length."""
    every = [c for c in [*COUNTERS, *GEO_COUNTERS] if c != "max_len"]
    return counted.groupBy("pos").agg(*[F.sum(c).alias(c) for c in every], F.max("max_len").alias("max_len"))
