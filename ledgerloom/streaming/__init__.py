"""Streaming forms of the sync and of job states (extensions: the same results as the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_events(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key's first event, as long as repeats come within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest_state(stream: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """The newest state of every key, for update or complete output. A row for each key is kept for good."""
    return stream.groupBy(key).agg(F.max_by(state, ts).alias(state), F.max(ts).alias(ts))


def latest_state_within(stream: DataFrame, key: str, ts: str, state: str, period: str = "1 day", late: str = "1 day") -> DataFrame:
    """The newest state of every key in each period; periods that the watermark has passed are dropped from the state."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, period), key).agg(F.max_by(state, ts).alias(state), F.max(ts).alias(ts))
    return w.select(F.col("window.start").alias("start"), key, state, ts)


def activity(stream: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each kind in tumbling windows, closed by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sync_to(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Write each batch's newest row of every key as a new snapshot under path; a replayed batch overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), order).alias("r")).select(*key, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(df: DataFrame, key: list[str]) -> DataFrame:
    """The current rows of a folder of batches: the last batch of a key wins."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (*key, "batch")]), "batch").alias("r")).select(*key, "r.*")
