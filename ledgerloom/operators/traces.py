"""Traces of interpretation: events dealt into runs, their safe outcomes, and what each run comes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pii
from ..session import checkpoint

#: The stages of a trace.
STAGES = ("EXTRACTION", "NORMALIZATION", "MATCHING", "SUGGESTION", "DECISION", "WRITE")
#: Marks that begin and end a run.
BEGIN, END = "START", "END"
#: Events of a row of nested().
CHUNK = 1000


def trace_events(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events (document_id, ts, seq, stage, ...) with run, counted from 1 for each document, and place, counted from 1 in each run.

    A run begins with a document's first event, with a START mark, after an END mark, and after a pause longer than gap. Events of a
    document are ordered by ts and seq; those without a document_id or ts are left out.

    Events are dealt out by ranges of document and order, so a hot document lies in many; each range is counted by itself, and a
    row for each document and range says what comes before it.
    """
    c = F.col
    rows = events.where("document_id is not null and ts is not null")
    dealt = checkpoint(rows.repartitionByRange("document_id", "ts", "seq").withColumn("__range", F.spark_partition_id()))
    key = ["document_id", "__range"]
    within, before = Window.partitionBy(*key).orderBy("ts", "seq"), Window.partitionBy("document_id").orderBy("__range")
    last = dealt.groupBy(*key).agg(F.max(F.struct("ts", "seq", "stage")).alias("__last"))
    edge = last.select(*key, F.lag("__last").over(before).alias("__edge"))
    near = dealt.withColumn("__prior", F.lag(F.struct("ts", "stage")).over(within)).join(edge, key)
    prior_ts, prior_stage = F.coalesce("__prior.ts", "__edge.ts"), F.coalesce("__prior.stage", "__edge.stage")
    begins = prior_ts.isNull() | (c("stage") == BEGIN) | (prior_stage == END) | (c("ts") > prior_ts + F.expr(f"INTERVAL {gap}"))
    marked = near.withColumn("__begins", F.coalesce(begins, F.lit(False)).cast("int")).drop("__prior", "__edge")
    marked = checkpoint(marked.withColumn("__run", F.sum("__begins").over(within.rowsBetween(Window.unboundedPreceding, 0))))
    sums = marked.groupBy(*key).agg(F.sum("__begins").alias("__n")).select(*key, F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    runs = marked.join(sums, key).withColumn("run", (c("__run") + c("__before")).cast("long")).drop("__run", "__before", "__begins")
    # places are counted like runs: in each range, after what the run has in earlier ranges
    piece = ["document_id", "run", "__range"]
    sizes = runs.groupBy(*piece).agg(F.count("*").alias("__n"))
    sizes = sizes.select(*piece, F.coalesce(F.sum("__n").over(Window.partitionBy("document_id", "run").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*piece).orderBy("ts", "seq"))
    return runs.withColumn("__nth", nth).join(sizes, piece).withColumn("place", (c("__nth") + c("__before")).cast("long")).drop("__range", "__nth", "__before")


def safe(rows: DataFrame) -> DataFrame:
    """Events (field, value, kind, notes) with an outcome that is safe to store instead of the value, and redacted notes."""
    return rows.withColumns({"outcome": pii.outcome(F.col("field"), F.col("value"), F.col("kind")), "notes": pii.redact(F.col("notes"))}).drop("value", "kind")


def trace_totals(rows: DataFrame) -> DataFrame:
    """A row for each run of trace_events(): times, events of each stage, distinct fields, confidence, use of a model, and the last decision.

    model_used: whether an event's method is LLM; from_cache: how many are CACHE. confidence: the mean in millionths of those that have one.
    """
    c = F.col
    at = lambda stage: F.count_if(c("stage") == stage).alias(f"n_{stage.lower()}")
    last = lambda stage, column: F.max(F.when(c("stage") == stage, F.struct("place", column)))[column]
    return rows.groupBy("document_id", "run").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"), F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).alias("duration_ms"),
        F.count("*").alias("n_events"), *[at(s) for s in STAGES], F.count_distinct("field").alias("n_fields"),
        F.coalesce(F.max(c("method") == "LLM"), F.lit(False)).alias("model_used"), F.count_if(c("method") == "CACHE").alias("from_cache"),
        F.floor(F.sum(F.round(c("confidence") * 1_000_000).cast("long")) / F.count("confidence")).cast("long").alias("confidence"), last("DECISION", "field").alias("decided"),
    )


def nested(rows: DataFrame, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """Events of a run as structs by stage: a row for each run, stage and chunk of places, in order, so that a long run has many rows."""
    at = F.floor((F.col("place") - 1) / chunk).cast("long").alias("chunk")
    return rows.groupBy("document_id", "run", "stage", at).agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("events"))

