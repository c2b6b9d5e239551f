"""The reconciliation run: eligible documents, new proposals, safe links, and their audit rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import checkpoint
from . import matching
from .queues import unmatched
from .sync import upsert


@dataclass
class Run:
    """Frames of a run, computed once and kept in the checkpoint folder, and how many rows proposals and links have."""

    proposals: DataFrame
    links: DataFrame
    audit: DataFrame
    counts: dict[str, int]


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df, computed once, and the number of its rows, observed in the same job."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def run(docs: DataFrame, ledger: DataFrame, known: DataFrame, pending: DataFrame, threshold: int = matching.AUTO, user: int | None = None, **settings) -> Run:
    """Propose matches of documents that have none yet, then link what is unambiguous.

    docs: eligible documents. ledger: the cache. known: every pair (document_id, ledger_id) proposed so
    far. pending: open proposals (document_id, ledger_id, total), which take part in linking. Documents
    that are linked or have open proposals are left out; known pairs are not proposed again. user: for one user's rows and
    nobody's; owner (a setting of top_matches): for all users at once. Matching runs once: links, audit and
    counts are made of its stored result.
    """
    linked = ledger.where("match_status = 'MATCHED' and document_id is not null").select("document_id").distinct()
    todo = docs.join(linked, "document_id", "left_anti").join(pending.select("document_id").distinct(), "document_id", "left_anti")
    found = matching.top_matches(todo, unmatched(ledger, user), **settings).select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "total", "reasons")
    proposals, n_proposals = _counted(found.join(known.select("document_id", "ledger_id").distinct(), ["document_id", "ledger_id"], "left_anti"))
    every = pending.select("document_id", "ledger_id", "total").unionByName(proposals.select("document_id", "ledger_id", "total")).withColumn("status", F.lit("PENDING"))
    links, n_links = _counted(matching.unambiguous(every, threshold).select("document_id", "ledger_id", "total"))
    audit = proposals.select("document_id", "ledger_id", F.lit("PROPOSED").alias("final_state"), F.lit(False).alias("auto_applied")).unionByName(
        links.select("document_id", "ledger_id", F.lit("LINKED").alias("final_state"), F.lit(True).alias("auto_applied"))
    )
    return Run(proposals, links, audit, {"proposals_created": n_proposals, "auto_linked": n_links})


@dataclass
class Outcome:
    """What a whole run leaves behind: the ledger, the open proposals, the audit rows, and counters (metric, n)."""

    ledger: DataFrame
    proposals: DataFrame
    audit: DataFrame
    counters: DataFrame


#: Columns of a ledger row that matching owns; a sync never touches them.
MATCH_COLUMNS = ("match_status", "document_id")


def reconcile(ledger: DataFrame, fetched: DataFrame, docs: DataFrame, known: DataFrame, pending: DataFrame, full_sync: bool = False, dry_run: bool = False, skip_sync: bool = False, **settings) -> Outcome:
    """Sync, propose and link: fetched rows go into the ledger, then run() and apply_links().

    full_sync: the ledger is what was fetched; else fetched rows are merged into it, and keep what they are
    matched to. skip_sync: the ledger stays as it is. dry_run: all is counted, but ledger and proposals stay.
    ledger and fetched have the same columns but for MATCH_COLUMNS.
    """
    source = [c for c in ledger.columns if c not in ("ledger_id", *MATCH_COLUMNS)]
    now, synced = ledger, 0
    if not skip_sync:
        old, seen = ledger.limit(0) if full_sync else ledger, Observation()
        now = upsert(old, fetched.observe(seen, F.count(F.lit(1)).alias("n")).select("ledger_id", *source), ["ledger_id"], source, list(MATCH_COLUMNS)).drop("change")
        now = checkpoint(now.withColumn("match_status", F.coalesce("match_status", F.lit("UNMATCHED"))).select(ledger.columns))
        synced = seen.get["n"]
    done = run(docs, now, known, pending, **settings)
    counters = ledger.sparkSession.createDataFrame([(k, int(n)) for k, n in ({"transactions_synced": synced} | done.counts).items()], "metric string, n long")
    every = pending.select("document_id", "ledger_id", "total").unionByName(done.proposals.select("document_id", "ledger_id", "total")).withColumn("status", F.lit("PENDING"))
    if dry_run:
        return Outcome(ledger, pending.select("document_id", "ledger_id", "total").withColumn("status", F.lit("PENDING")), done.audit.limit(0), counters)
    proposals, after = apply_links(every, now, done.links)
    return Outcome(after, proposals, done.audit, counters)


def apply_links(proposals: DataFrame, ledger: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals and ledger after links: accepted pairs, other open proposals of their transactions rejected."""
    pair = links.select("document_id", "ledger_id", F.lit(True).alias("__pair"))
    tx = links.select("ledger_id", F.col("document_id").alias("__doc")).dropDuplicates(["ledger_id"])
    p = proposals.join(pair, ["document_id", "ledger_id"], "left").join(tx, "ledger_id", "left")
    status = F.when(F.col("__pair"), "ACCEPTED").when((F.col("status") == "PENDING") & F.col("__doc").isNotNull(), "REJECTED").otherwise(F.col("status"))
    out = ledger.join(tx, "ledger_id", "left")
    hit = F.col("__doc").isNotNull()
    out = out.withColumn("match_status", F.when(hit, "MATCHED").otherwise(F.col("match_status"))).withColumn("document_id", F.coalesce("__doc", "document_id")).drop("__doc")
    return p.withColumn("status", status).drop("__pair", "__doc"), out


def reset(proposals: DataFrame, ledger: DataFrame, document_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Before a document is interpreted again: its open proposals go, and rows proposed to it are unmatched."""
    ids = document_ids.select("document_id").distinct()
    open_ = proposals.where("status = 'PENDING'").join(ids, "document_id", "left_semi").select("ledger_id").distinct().withColumn("__hit", F.lit(True))
    left = proposals.join(ids.withColumn("__hit", F.lit(True)), "document_id", "left").where("__hit is null or status <> 'PENDING'").drop("__hit")
    out = ledger.join(open_, "ledger_id", "left")
    return left, out.withColumn("match_status", F.when(F.col("__hit") & (F.col("match_status") == "PROPOSED"), "UNMATCHED").otherwise(F.col("match_status"))).drop("__hit")


def traces(events: DataFrame) -> DataFrame:
    """One row per run of its events (run_id, ts, stage, field, outcome, confidence): counts, fields, mean confidence, outcomes in order."""
    return events.groupBy("run_id").agg(
        F.count("*").alias("n_events"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), F.count_if(F.col("stage") == "MATCHING").alias("n_matching"),
        F.round(F.avg("confidence"), 6).alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "outcome"))), lambda x: x["outcome"]), "|").alias("outcomes"),
    )
