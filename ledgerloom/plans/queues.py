"""Queries of queues, states and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as A
from ..operators import queues as Q
from ..operators import sync as Y
from ..sources.views import duckdb_views, spark_views

THREE = ("extraction", "linkage", "imports")


def importable(spark, sf_dir):
    return Q.importable(*spark_views(spark, sf_dir, *THREE)).select("id", "document_id")


def importable_cli(spark, sf_dir):
    return Q.importable(*spark_views(spark, sf_dir, *THREE), need_ledger_id=True).select("id", "link_type")


def importable_auto(spark, sf_dir):
    return Q.importable(*spark_views(spark, sf_dir, *THREE), links=("LINKED", "ORPHAN", "AUTO_LINKED"), auto_only=True).select("id", "link_type")


def unlinked(spark, sf_dir):
    return Q.unlinked(*spark_views(spark, sf_dir, "extraction", "linkage")).select("id", "link_type")


def unmatched_ledger(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    return Q.unmatched(t, 3).select("ledger_id", "user_id")


def review_queue(spark, sf_dir):
    e, = spark_views(spark, sf_dir, "extraction")
    return Q.review_queue(e).select("id", "review_state")


def eligible_docs(spark, sf_dir):
    return Q.eligible(*spark_views(spark, sf_dir, "extraction", "imports")).select("id")


def existing_links(spark, sf_dir):
    """Documents that a ledger row is matched to or names in its external id."""
    t, = spark_views(spark, sf_dir, "ledger")
    own = F.split_part("external_id", F.lit(":"), F.lit(2)).try_cast("long")
    return t.where("match_status = 'MATCHED'").select(F.col("ledger_id").alias("document_id")).union(t.where("external_id like 'archive:%'").select(own)).distinct()


def can_create(spark, sf_dir):
    """Whether a document may get a new transaction: not if linked, proposed or imported."""
    e, i, t = spark_views(spark, sf_dir, "extraction", "imports", "ledger")
    links = t.select(F.col("ledger_id").alias("document_id"), "match_status")
    done = i.where("status = 'IMPORTED'").select("document_id", F.lit(True).alias("done"))
    why = F.when(F.col("match_status") == "MATCHED", "linked").when(F.col("match_status") == "PROPOSED", "proposal pending").when(F.col("done"), "imported").otherwise("ok")
    return e.join(links, "document_id", "left").join(done, "document_id", "left").select("id", why.alias("reason"))


def latest_import(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "imports")
    return Q.latest(i, "user_id", "created_at", "import_id").select("user_id", "import_id")


def latest_run(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return Q.latest(j, "document_id", "created_at", "job_id").select("document_id", "job_id", "status")


def processed_archive(spark, sf_dir):
    e, = spark_views(spark, sf_dir, "extraction")
    at = F.coalesce("reviewed_at", "created_at")
    return e.where("review_decision is not null").orderBy(at.desc(), F.desc("id")).limit(100).select("id", at.alias("processed_at"))


def next_jobs(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return Q.next_jobs(j, F.lit("2024-01-10").cast("timestamp"), 50).select("job_id", "priority")


def jobs_list(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return Q.job_page(j, 50, 100).select("job_id", "status")


def fair_pick(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    p = j.groupBy("user_id").agg((F.col("user_id") % 3 != 0).alias("enabled"), (F.col("user_id") + 1).cast("int").alias("from_hour"), F.lit(18).alias("to_hour"), F.lit(60).alias("interval_minutes"))
    return Q.fair_pick(j, p, j.where("status = 'COMPLETED' and user_id % 4 <> 1").withColumnRenamed("created_at", "ts"), F.lit("2030-01-01").cast("timestamp"), 6).select("user_id", "job_id")


def old_jobs(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return Q.old_jobs(j, F.lit("2024-01-15").cast("timestamp")).select("job_id")


def jobs_to_schedule(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    o, = spark_views(spark, sf_dir, "orders")
    return Q.schedule(j, o.select(F.col("o_orderkey").alias("document_id")).union(j.select("document_id")))


def job_failures(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    status, retries = Q.failed(F.col("status"), F.col("retry_count"), F.col("max_retries"))
    return j.where("status = 'PROCESSING'").select("job_id", status.alias("status"), retries.alias("retry_count"))


def unified_review(spark, sf_dir):
    return Q.unified(*spark_views(spark, sf_dir, *THREE)).drop("created_at")


def pipeline_stats(spark, sf_dir):
    e, i, t = spark_views(spark, sf_dir, "extraction", "imports", "ledger")
    a = A.counts(e, extractions=F.lit(True), pending_review=F.col("review_state").isin("REVIEW", "MANUAL") & F.col("review_decision").isNull(), automatic=F.col("review_state") == "AUTO")
    return a.union(A.counts(i, imported=F.col("status") == "IMPORTED", failed=F.col("status") == "FAILED", waiting=F.col("status") == "PENDING")).union(A.counts(t, active=F.col("deleted_at").isNull()))


def queue_stats(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return A.state_counts(j)


def reconciliation_status(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    live = F.col("deleted_at").isNull()
    return A.counts(t, total=live, deleted=~live, **{s.lower(): live & (F.col("match_status") == s) for s in ("MATCHED", "PROPOSED", "UNMATCHED")})


def dashboard_stats(spark, sf_dir):
    """Pending reviews as the dashboard has always counted them, and as meant."""
    e, = spark_views(spark, sf_dir, "extraction")
    open_, review, manual = F.col("review_decision").isNull(), F.col("review_state") == "REVIEW", F.col("review_state") == "MANUAL"
    return A.counts(e, as_counted=F.coalesce((review & F.col("review_decision").isin("PENDING")) | open_, F.lit(False)), as_meant=(review | manual) & open_)


def feedback_accuracy(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return A.accuracy(j.select(F.when(F.col("job_id") % 3 == 0, "WRONG").otherwise("CORRECT").alias("feedback_type")))


def pool_shares(spark, sf_dir):
    """With how many users each record of a pool is shared."""
    c, o = spark_views(spark, sf_dir, "customer", "orders")
    shares = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("shared_with")).distinct().groupBy("c_custkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("shared_with")), ",").alias("users"))
    return c.join(shares, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit("")).alias("users"))


def account_transactions(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    return t.where("source_account = 'building' or destination_account = 'building'").where(Y.visible(2)).select("ledger_id")


def import_layers(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    name = F.element_at(F.array(*[F.lit(x) for x in ("account", "bill", "tag", "transaction")]), (F.col("job_id") % 4 + 1).cast("int"))
    return j.select("job_id", Y.layer(name).alias("layer"))


QUERIES = {f.__name__: f for f in (
    importable, importable_cli, importable_auto, unlinked, unmatched_ledger, review_queue, eligible_docs, existing_links, can_create, latest_import, latest_run, processed_archive, next_jobs, jobs_list, fair_pick, old_jobs,
    jobs_to_schedule, job_failures, unified_review, pipeline_stats, queue_stats, reconciliation_status, dashboard_stats, feedback_accuracy, pool_shares, account_transactions, import_layers,
)}

_DONE = "(review_state = 'AUTO' OR coalesce(review_decision IN ('ACCEPTED', 'EDITED', 'ORPHAN_CONFIRMED'), false))"
_IMPORT = duckdb_views(*THREE) + f""", j AS (SELECT e.*, l.link_type, l.ledger_id, i.status FROM extraction e JOIN linkage l ON l.extraction_id = e.id LEFT JOIN imports i ON i.external_id = e.external_id
  WHERE (i.status IS NULL OR i.status = 'FAILED')) """


def _counts(rel: str, **metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({v}) AS n FROM {rel}" for k, v in metrics.items())


ORACLE_SQL = {
    "importable": _IMPORT + f"SELECT id, document_id FROM j WHERE {_DONE} AND link_type IN ('LINKED', 'ORPHAN')",
    "importable_cli": _IMPORT + f"SELECT id, link_type FROM j WHERE {_DONE} AND (link_type = 'ORPHAN' OR link_type = 'LINKED' AND ledger_id IS NOT NULL)",
    "importable_auto": _IMPORT + "SELECT id, link_type FROM j WHERE review_state = 'AUTO' AND link_type IN ('LINKED', 'ORPHAN', 'AUTO_LINKED')",
    "unlinked": duckdb_views(*THREE) + "SELECT id, link_type FROM extraction LEFT JOIN linkage ON extraction_id = id WHERE (link_type IS NULL OR link_type = 'PENDING') AND review_state <> 'IMPORTED'",
    "unmatched_ledger": duckdb_views("ledger") + "SELECT ledger_id, user_id FROM ledger WHERE match_status = 'UNMATCHED' AND deleted_at IS NULL AND (user_id IS NULL OR user_id = 3)",
    "review_queue": duckdb_views("extraction") + "SELECT id, review_state FROM extraction WHERE review_state IN ('REVIEW', 'MANUAL') AND review_decision IS NULL",
    "eligible_docs": duckdb_views(*THREE) + "SELECT id FROM extraction WHERE review_decision IN ('ACCEPTED', 'EDITED', 'ORPHAN_CONFIRMED') AND NOT llm_opt_out AND document_id NOT IN (SELECT document_id FROM imports WHERE status = 'IMPORTED')",
    "existing_links": duckdb_views("ledger") + "SELECT ledger_id AS document_id FROM ledger WHERE match_status = 'MATCHED' UNION SELECT CAST(split_part(external_id, ':', 2) AS BIGINT) FROM ledger WHERE external_id LIKE 'archive:%'",
    "can_create": duckdb_views(*THREE, "ledger") + """SELECT id, CASE WHEN match_status = 'MATCHED' THEN 'linked' WHEN match_status = 'PROPOSED' THEN 'proposal pending' WHEN EXISTS (SELECT 1 FROM imports i WHERE i.document_id = e.document_id AND status = 'IMPORTED') THEN 'imported' ELSE 'ok' END AS reason
      FROM extraction e LEFT JOIN ledger ON ledger_id = document_id""",
    "latest_import": duckdb_views("imports") + "SELECT user_id, import_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, import_id DESC) AS k FROM imports) WHERE k = 1",
    "latest_run": duckdb_views("job") + "SELECT document_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) AS k FROM job) WHERE k = 1",
    "processed_archive": duckdb_views("extraction") + "SELECT id, coalesce(reviewed_at, created_at) AS processed_at FROM extraction WHERE review_decision IS NOT NULL ORDER BY coalesce(reviewed_at, created_at) DESC, id DESC LIMIT 100",
    "next_jobs": duckdb_views("job") + "SELECT job_id, priority FROM job WHERE status = 'PENDING' AND (scheduled_for IS NULL OR scheduled_for <= TIMESTAMP '2024-01-10') ORDER BY priority DESC, scheduled_for ASC NULLS FIRST, job_id LIMIT 50",
    "jobs_list": duckdb_views("job") + "SELECT job_id, status FROM job ORDER BY CASE status WHEN 'PROCESSING' THEN 0 WHEN 'PENDING' THEN 1 WHEN 'FAILED' THEN 2 WHEN 'COMPLETED' THEN 3 ELSE 4 END, priority DESC, job_id LIMIT 50 OFFSET 100",
    "fair_pick": duckdb_views("job") + """SELECT user_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, job_id) AS k FROM job WHERE status = 'PENDING' AND user_id % 3 <> 0 AND user_id + 1 <= 6) WHERE k = 1""",
    "old_jobs": duckdb_views("job") + "SELECT job_id FROM job WHERE status IN ('COMPLETED', 'FAILED', 'CANCELLED') AND completed_at < TIMESTAMP '2024-01-15'",
    "jobs_to_schedule": duckdb_views("job") + "SELECT document_id FROM (SELECT o_orderkey AS document_id FROM orders UNION SELECT document_id FROM job) WHERE document_id NOT IN (SELECT document_id FROM job WHERE status IN ('PENDING', 'PROCESSING'))",
    "job_failures": duckdb_views("job") + "SELECT job_id, CASE WHEN retry_count < max_retries THEN 'PENDING' ELSE 'FAILED' END AS status, CASE WHEN retry_count < max_retries THEN retry_count + 1 ELSE retry_count END AS retry_count FROM job WHERE status = 'PROCESSING'",
    "unified_review": duckdb_views(*THREE) + f"""SELECT id, e.document_id, review_state, coalesce(link_type, 'PENDING') = 'PENDING' AS needs_linking, coalesce(link_type IN ('LINKED', 'AUTO_LINKED'), false) AS is_linked, coalesce(link_type = 'ORPHAN', false) AS is_orphan,
      coalesce(link_type = 'AUTO_LINKED', false) AS is_auto, review_state IN ('REVIEW', 'MANUAL') AND review_decision IS NULL AS needs_review,
      {_DONE} AND coalesce(link_type IN ('LINKED', 'AUTO_LINKED', 'ORPHAN'), false) AND coalesce(i.status, 'FAILED') = 'FAILED' AS ready_for_import
      FROM extraction e LEFT JOIN linkage l ON l.extraction_id = e.id LEFT JOIN imports i ON i.external_id = e.external_id""",
    "pipeline_stats": duckdb_views(*THREE, "ledger") + _counts("extraction", extractions="true", pending_review="review_state IN ('REVIEW', 'MANUAL') AND review_decision IS NULL", automatic="review_state = 'AUTO'")
    + " UNION ALL " + _counts("imports", imported="status = 'IMPORTED'", failed="status = 'FAILED'", waiting="status = 'PENDING'") + " UNION ALL " + _counts("ledger", active="deleted_at IS NULL"),
    "queue_stats": duckdb_views("job") + _counts("job", **{s: f"status = '{s}'" for s in A.JOB_STATES}, TOTAL="true"),
    "reconciliation_status": duckdb_views("ledger") + _counts("ledger", total="deleted_at IS NULL", deleted="deleted_at IS NOT NULL", **{s.lower(): f"deleted_at IS NULL AND match_status = '{s}'" for s in ("MATCHED", "PROPOSED", "UNMATCHED")}),
    "dashboard_stats": duckdb_views("extraction") + _counts("extraction", as_counted="review_decision IS NULL", as_meant="review_state IN ('REVIEW', 'MANUAL') AND review_decision IS NULL"),
    "feedback_accuracy": duckdb_views("job") + "SELECT count(*) FILTER (job_id % 3 <> 0) AS correct, count(*) AS total, count(*) FILTER (job_id % 3 <> 0) / count(*)::DOUBLE AS accuracy FROM job",
    "pool_shares": """SELECT c_custkey, count(p) AS n, coalesce(string_agg(p, ',' ORDER BY p), '') AS users FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey""",
    "account_transactions": duckdb_views("ledger") + "SELECT ledger_id FROM ledger WHERE (source_account = 'building' OR destination_account = 'building') AND (user_id IS NULL OR user_id = 2)",
    "import_layers": duckdb_views("job") + "SELECT job_id, CASE job_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS layer FROM job",
}
