"""Review, import and job queues, and the state of each document's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCEPTING = ("ACCEPTED", "EDITED", "ORPHAN_CONFIRMED")


def latest(df: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), F.desc(tie))
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def last_imports(imports: DataFrame) -> DataFrame:
    """(external_id, import_status): the newest import of each id, so that joins with it don't fan out."""
    last = F.max_by("status", F.struct("created_at", "import_id"))
    return imports.where("external_id is not null").groupBy("external_id").agg(last.alias("import_status"))


def importable(extractions: DataFrame, linkage: DataFrame, imports: DataFrame, links=("LINKED", "ORPHAN"), need_ledger_id: bool = False, auto_only: bool = False) -> DataFrame:
    """Extractions that may be imported: accepted or automatic, linked, and not imported yet or failed."""
    ok = F.col("review_state") == "AUTO"
    if not auto_only:
        ok = ok | F.col("review_decision").isin(*ACCEPTING)
    link = F.col("link_type").isin(*links)
    if need_ledger_id:
        link = link & ((F.col("link_type") != "LINKED") | F.col("linked_ledger_id").isNotNull())
    e = extractions.join(linkage.select(F.col("extraction_id").alias("id"), "link_type", F.col("ledger_id").alias("linked_ledger_id")), "id")
    e = e.join(last_imports(imports), "external_id", "left")
    return e.where(F.coalesce(ok, F.lit(False)) & link & (F.col("import_status").isNull() | (F.col("import_status") == "FAILED")))


def unlinked(extractions: DataFrame, linkage: DataFrame) -> DataFrame:
    e = extractions.join(linkage.select(F.col("extraction_id").alias("id"), "link_type"), "id", "left")
    return e.where((F.col("link_type").isNull() | (F.col("link_type") == "PENDING")) & (F.col("review_state") != "IMPORTED"))


def unmatched(ledger: DataFrame, user: int | None = None) -> DataFrame:
    """Live ledger rows that nothing is matched to, of a user or of nobody."""
    rows = ledger.where("match_status = 'UNMATCHED' and deleted_at is null")
    return rows if user is None else rows.where(F.col("user_id").isNull() | (F.col("user_id") == user))


def review_queue(extractions: DataFrame) -> DataFrame:
    """Extractions to review, oldest first."""
    return extractions.where("review_state in ('REVIEW', 'MANUAL') and review_decision is null").orderBy("created_at", "id")


def eligible(extractions: DataFrame, imports: DataFrame, approved=ACCEPTING) -> DataFrame:
    """Decided, not opted out, and without an import that went through."""
    done = imports.where("status = 'IMPORTED'").select("document_id").distinct()
    return extractions.where(F.col("review_decision").isin(*approved) & ~F.col("llm_opt_out")).join(done, "document_id", "left_anti")


def next_jobs(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Pending jobs that are due: high priority first, then unscheduled, then oldest."""
    due = jobs.where(F.col("status") == "PENDING").where(F.col("scheduled_for").isNull() | (F.col("scheduled_for") <= now))
    return due.orderBy(F.desc("priority"), F.col("scheduled_for").asc_nulls_first(), "job_id").limit(limit)


RANKS = {"PROCESSING": 0, "PENDING": 1, "FAILED": 2, "COMPLETED": 3, "CANCELLED": 4}


def job_page(jobs: DataFrame, limit: int, offset: int) -> DataFrame:
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("status")), F.lit(len(RANKS)))
    return jobs.orderBy(rank, F.desc("priority"), "job_id").offset(offset).limit(limit)


def _in_turn(jobs: DataFrame, profiles: DataFrame, last: DataFrame, now: Column, hour: int) -> DataFrame:
    """Pending jobs of users whose schedule is on, whose hours are active and whose interval has passed."""
    active = F.when(F.col("from_hour") <= F.col("to_hour"), F.lit(hour).between(F.col("from_hour"), F.col("to_hour") - 1)).otherwise((F.lit(hour) >= F.col("from_hour")) | (F.lit(hour) < F.col("to_hour")))
    free = F.col("last_run").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_run") >= F.col("interval_minutes") * 60)
    return jobs.where("status = 'PENDING'").join(profiles.where("enabled"), "user_id").join(last, "user_id", "left").where(active & free)


def fair_pick(jobs: DataFrame, profiles: DataFrame, runs: DataFrame, now: Column, hour: int) -> DataFrame:
    """The first job of every user whose schedule is on, whose hours are active and whose interval has passed."""
    last = runs.groupBy("user_id").agg(F.max("ts").alias("last_run"))
    ready = _in_turn(jobs, profiles, last, now, hour)
    order = Window.partitionBy("user_id").orderBy(F.desc("priority"), "job_id")
    return ready.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def next_of_all(jobs: DataFrame, profiles: DataFrame, runs: DataFrame, now: Column, hour: int) -> DataFrame:
    """The one job to run next: of all users whose turn it is, the first that is due, by priority, then unscheduled ones, then the oldest.

    Whose turn it is, profiles and last runs say as in fair_pick(); they are joined before anything is cut, so users out of turn
    don't hold back others however many jobs they have.
    """
    last = runs.groupBy("user_id").agg(F.max("ts").alias("last_run"))
    return next_jobs(_in_turn(jobs, profiles, last, now, hour), now, 1)


def old_jobs(jobs: DataFrame, cutoff: Column) -> DataFrame:
    return jobs.where(F.col("status").isin("COMPLETED", "FAILED", "CANCELLED") & (F.col("completed_at") < cutoff))


def schedule(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted documents without an active job, once each."""
    active = jobs.where(F.col("status").isin("PENDING", "PROCESSING")).select("document_id").distinct()
    return wanted.dropDuplicates(["document_id"]).join(active, "document_id", "left_anti")


def runs_of(runs: DataFrame, document_id: int) -> DataFrame:
    """All runs of a document, newest first."""
    return runs.where(F.col("document_id") == document_id).orderBy(F.desc("created_at"), F.desc("job_id"))


def import_queue(extractions: DataFrame, linkage: DataFrame, imports: DataFrame, **settings) -> DataFrame:
    """importable(), each with the side it stands on: failed before, or ready."""
    rows = importable(extractions, linkage, imports, **settings)
    return rows.withColumn("side", F.when(F.col("import_status") == "FAILED", "failed").otherwise("ready"))


def failed(status: Column, retries: Column, most: Column) -> tuple[Column, Column]:
    """Status and retry count after a failure: pending again while retries are left."""
    again = retries < most
    return F.when(again, "PENDING").otherwise("FAILED"), F.when(again, retries + 1).otherwise(retries)


def unified(extractions: DataFrame, linkage: DataFrame, imports: DataFrame) -> DataFrame:
    """Every extraction with its link, import and derived flags."""
    e = extractions.join(linkage.select(F.col("extraction_id").alias("id"), "link_type"), "id", "left")
    e = e.join(last_imports(imports), "external_id", "left")
    link = F.coalesce("link_type", F.lit("PENDING"))
    linked, orphan = link.isin("LINKED", "AUTO_LINKED"), link == "ORPHAN"
    decided = (F.col("review_state") == "AUTO") | F.coalesce(F.col("review_decision").isin(*ACCEPTING), F.lit(False))
    return e.select(
        "id", "document_id", "review_state", "created_at", (link == "PENDING").alias("needs_linking"), linked.alias("is_linked"), orphan.alias("is_orphan"), (link == "AUTO_LINKED").alias("is_auto"),
        (F.col("review_state").isin("REVIEW", "MANUAL") & F.col("review_decision").isNull()).alias("needs_review"),
        (decided & (linked | orphan) & (F.coalesce("import_status", F.lit("FAILED")) == "FAILED")).alias("ready_for_import"),
    )


def unified_page(rows: DataFrame, limit: int = 100) -> DataFrame:
    """The first rows of unified(): what needs a link, then the newest."""
    return rows.orderBy(F.desc("needs_linking"), F.desc("created_at"), F.desc("id")).limit(limit)


def unified_counts(rows: DataFrame) -> DataFrame:
    """How many rows of unified() carry each flag."""
    flags = ("needs_linking", "is_linked", "is_orphan", "is_auto", "needs_review", "ready_for_import")
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(c)).alias(c) for c in flags])
