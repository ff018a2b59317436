"""Structured Streaming: cells that arrive in batches, with running statistics and fixed-model activities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ridge
from ..operators.prep import sane


def running_stats(stream: DataFrame) -> DataFrame:
    """``sample, n, s1, s2``: sums of a column that new rows add to; column_stats of them needs no other state."""
    return stream.groupBy("sample").agg(F.count("*").alias("n"), F.sum(sane()).alias("s1"), F.sum(sane() * sane()).alias("s2"))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """``start, event_type, n, total`` by window of event time; rows later than ``late`` are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def activity_of_blocks(stream: DataFrame, kernel: ridge.Kernel, features: list[str]) -> DataFrame:
    """Activities of a stream of whole samples ``sample, idx, val`` under a fixed projection and row means."""
    return ridge.run_kernel(stream, kernel, features)


def write_results(stream: DataFrame, path: str, checkpoint: str, progress=None) -> StreamingQuery:
    """Append results to Parquet; ``progress(batch)`` is called after each batch. The file sink commits a batch once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if progress is None:
        return query.trigger(availableNow=True).start()

    def one(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")  # a replayed batch replaces itself
        progress(batch)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
