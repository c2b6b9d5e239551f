"""Counts for dashboards, one pass over each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB_STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED")


def counts(df: DataFrame, **metrics: Column) -> DataFrame:
    """A row (metric, n) for each predicate."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in metrics.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in metrics]), F.array(*[F.col(k) for k in metrics]))).alias("metric", "n"))


def state_counts(jobs: DataFrame) -> DataFrame:
    """Jobs of every state, zeros included, and their total."""
    return counts(jobs, **{s: F.col("status") == s for s in JOB_STATES}, TOTAL=F.lit(True))


def accuracy(feedback: DataFrame) -> DataFrame:
    """Correct feedback as a share of all; 0 without any."""
    return feedback.agg(F.count_if(F.col("feedback_type") == "CORRECT").alias("correct"), F.count("*").alias("total")).withColumn(
        "accuracy", F.when(F.col("total") == 0, 0.0).otherwise(F.col("correct") / F.col("total")))


def calibration(n: Column, target: int) -> Column:
    return F.least(F.lit(1.0), n / F.lit(float(target)))


def list_stats(proposals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counters of the list of proposals and ledger rows; restrict the ledger to an owner before."""
    live = F.col("deleted_at").isNull()
    states = {s.lower(): F.col("status") == s for s in ("PENDING", "ACCEPTED", "REJECTED", "AUTO_MATCHED")}
    return counts(proposals, **states).union(counts(ledger, unlinked=live & (F.col("match_status") == "UNMATCHED"), soft_deleted=~live))


def latest_version(applied: DataFrame) -> DataFrame:
    """The highest version of a log of applied changes (version); 0 without any."""
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
