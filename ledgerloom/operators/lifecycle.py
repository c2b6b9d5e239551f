"""State changes of jobs, reviews, imports and links, as joins with a table of wanted actions.

Actions come as one row per key; of several, the one that sorts last counts. Keys that are unknown or
whose state does not admit the action stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sync

#: The states from which an action leads on, and where it leads.
JOB_ACTIONS = {
    "start": (("PENDING",), "PROCESSING"),
    "complete": (("PROCESSING",), "COMPLETED"),
    "cancel": (("PENDING", "PROCESSING"), "CANCELLED"),
    "retry": (("FAILED",), "PENDING"),
}
IMPORT_ACTIONS = {"success": "IMPORTED", "failure": "FAILED", "retry": "PENDING"}


def _with_action(df: DataFrame, actions: DataFrame, key: str, *extra: str) -> DataFrame:
    once = actions.groupBy(key).agg(F.max(F.struct("action", *extra)).alias("__a"))
    return df.join(once, key, "left").withColumns({"__action": F.col("__a.action"), **{f"__{c}": F.col(f"__a.{c}") for c in extra}}).drop("__a")


def job_actions(jobs: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """jobs after start, complete, cancel or retry (job_id, action); completed_at is set at an end and cleared by a retry."""
    status, ended = F.col("status"), F.col("completed_at")
    for name, (sources, target) in JOB_ACTIONS.items():
        hit = (F.col("__action") == name) & F.col("status").isin(*sources)
        status = F.when(hit, target).otherwise(status)
        ended = F.when(hit, {"complete": now, "cancel": now, "retry": F.lit(None)}.get(name, F.col("completed_at"))).otherwise(ended)
    return _with_action(jobs, actions, "job_id").withColumns({"status": status, "completed_at": ended}).drop("__action")


def review_actions(extractions: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """extractions after decide (with a decision), reset, opt_out or opt_in (id, action, decision)."""
    a = F.col("__action")
    return _with_action(extractions, actions, "id", "decision").withColumns({
        "review_decision": F.when(a == "decide", F.col("__decision")).when(a == "reset", F.lit(None)).otherwise(F.col("review_decision")),
        "reviewed_at": F.when(a == "decide", now).when(a == "reset", F.lit(None)).otherwise(F.col("reviewed_at")),
        "llm_opt_out": F.when(a == "opt_out", True).when(a == "opt_in", False).otherwise(F.col("llm_opt_out")),
    }).drop("__action", "__decision")


def import_actions(imports: DataFrame, actions: DataFrame) -> DataFrame:
    """imports after success, failure, retry or delete (external_id, action)."""
    out = _with_action(imports, actions, "external_id").where("__action is null or __action <> 'delete'")
    status = F.col("status")
    for name, target in IMPORT_ACTIONS.items():
        status = F.when(F.col("__action") == name, target).otherwise(status)
    return out.withColumn("status", status).drop("__action")


def link_actions(linkage: DataFrame, extractions: DataFrame, ledger: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """linkage, extractions and ledger after link (with a ledger_id), orphan or unlink (extraction_id, action, ledger_id).

    There is one link per extraction, so a link that is missing is made and another one replaced. A
    ledger row becomes MATCHED by a link and UNMATCHED by an unlink, unless another row links it.
    """
    a = F.col("__action")
    acts = actions.join(extractions.select(F.col("id").alias("extraction_id"), F.col("document_id").alias("__doc")), "extraction_id").withColumnRenamed("ledger_id", "target")
    once = acts.groupBy("extraction_id").agg(F.max(F.struct("action", "target", "__doc")).alias("a")).select("extraction_id", F.col("a.action").alias("__action"), "a.target", "a.__doc")
    both = linkage.join(once, "extraction_id", "full_outer").where("link_type is not null or __action in ('link', 'orphan')")
    changed = both.select(
        "extraction_id", F.coalesce("document_id", "__doc").alias("document_id"),
        F.when(a == "link", "LINKED").when(a == "orphan", "ORPHAN").when(a == "unlink", "PENDING").otherwise(F.col("link_type")).alias("link_type"),
        F.when(a == "link", F.col("target")).when(a == "orphan", F.lit(None)).otherwise(F.col("ledger_id")).alias("ledger_id"),
    )
    state = F.when(F.col("__action") == "link", "LINKED").when(F.col("__action") == "orphan", "ORPHAN_CONFIRMED")
    done = extractions.join(once.select(F.col("extraction_id").alias("id"), "__action"), "id", "left").withColumns(
        {"review_state": F.coalesce(state, "review_state"), "review_decision": F.coalesce(state, "review_decision")}
    ).drop("__action")
    tied = once.where("__action = 'link'").select(F.col("target").alias("ledger_id"), F.lit("MATCHED").alias("__to"))
    freed = both.where("__action = 'unlink' and ledger_id is not null").select("ledger_id", F.lit("UNMATCHED").alias("__to"))
    to = tied.union(freed).groupBy("ledger_id").agg(F.min("__to").alias("__to"))
    return changed, done, ledger.join(to, "ledger_id", "left").withColumn("match_status", F.coalesce("__to", "match_status")).drop("__to")


def transfer(extractions: DataFrame, moves: DataFrame, dependents: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """extractions with the new owners of moves (id, user_id), and the dependents (frame, key) without rows of what moved.

    A dependent's key is extraction_id or document_id.
    """
    to = moves.groupBy("id").agg(F.max("user_id").alias("__to"))
    gone = extractions.join(to, "id", "left_semi").select(F.col("id").alias("extraction_id"), "document_id")
    moved = extractions.join(to, "id", "left").withColumn("user_id", F.coalesce("__to", "user_id")).drop("__to")
    return {"extractions": moved} | {n: df.join(gone.select(key).distinct(), key, "left_anti") for n, (df, key) in dependents.items()}


def inaccessible(wanted: DataFrame, own: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are neither owned nor shared; empty if the request may go on."""
    return wanted.select(key).distinct().join(own.select(key).union(shared.select(key)), key, "left_anti")


def vendor_mappings(old: DataFrame, uses: DataFrame) -> DataFrame:
    """Mappings (vendor_pattern, destination_account, category, use_count) after uses in the order of seq: the last one sets the columns, each counts."""
    new = uses.groupBy("vendor_pattern").agg(F.max(F.struct("seq", "destination_account", "category")).alias("u"), F.count("*").alias("n"))
    return old.join(new, "vendor_pattern", "full_outer").select(
        "vendor_pattern", *[F.when(F.col("n").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) for c in ("destination_account", "category")],
        (F.coalesce("use_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("use_count"),
    )


def seen_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents after a sync: contents and last_seen are the new ones, first_seen and a first owner stay."""
    return sync.upsert(old, new, ["document_id"], replace=["source_hash", "title", "last_seen"], keep=["first_seen", "user_id"])


def audit_page(runs: DataFrame, page: int, size: int = 50, user: int | None = None, **equal) -> tuple[DataFrame, DataFrame]:
    """A page of runs, newest first, that a user may see and whose columns have the given values, and how many there are."""
    if user is not None:
        runs = runs.where(sync.visible(user))
    for column, value in equal.items():
        runs = runs.where(F.col(column) == value)
    return runs.orderBy(F.desc("created_at"), F.desc("job_id")).offset((page - 1) * size).limit(size), runs.agg(F.count("*").alias("total"))


def finished_suggestions(jobs: DataFrame, schema: str) -> DataFrame:
    """The suggestions of documents whose newest job is completed; none where their JSON cannot be read."""
    newest = jobs.groupBy("document_id").agg(F.max(F.struct("created_at", "job_id", "status", "suggestions")).alias("j")).where("j.status = 'COMPLETED'")
    return newest.select("document_id", F.from_json("j.suggestions", schema).alias("s")).select("document_id", "s.*")


def suggested_amount(raw: Column) -> Column:
    """A suggested split's amount: comma as decimal sign, currency signs dropped; 0 if it is none."""
    return F.round(F.coalesce(F.regexp_replace(F.translate(raw, ",", "."), r"[€$£]|^\s+|\s+$", "").try_cast("decimal(18,6)"), F.lit(0)), 2).cast("decimal(18,2)")


def sync_window(df: DataFrame, today: Column, days: int, column: str = "date") -> DataFrame:
    """Rows from so many days ago to today, both included."""
    return df.where(F.col(column).between(F.date_sub(today, days), today))
