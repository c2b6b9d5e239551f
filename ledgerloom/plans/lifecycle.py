"""Queries of state changes, ownership, audit pages and suggested splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import histories as H
from ..operators import lifecycle as L
from ..operators import suggestions as S
from ..sources.views import duckdb_views, spark_views

NOW = "2024-06-01"
_ACTS = ("start", "complete", "cancel", "retry")


def _now():
    return F.lit(NOW).cast("timestamp")


def _pick(column, *values):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (column % len(values) + 1).cast("int"))


def job_transitions(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    acts = j.where("job_id % 11 < 6").select("job_id", _pick(F.col("job_id"), *_ACTS).alias("action"))
    return L.job_actions(j, acts, _now()).select("job_id", "status", "completed_at")


def job_histories(spark, sf_dir):
    """Each document's job after all actions of its events, in order; every sixth job is new and has no retries left."""
    j, = spark_views(spark, sf_dir, "job")
    k = F.col("document_id")
    none = lambda t: F.lit(None).cast(t)
    jobs = j.select("document_id").distinct().select(
        "document_id", _pick(k, *H.JOBS.states).alias("status"), (k % 3).cast("int").alias("retry_count"), F.when(k % 6 == 0, 0).otherwise(9).cast("int").alias("max_retries"),
        none("timestamp").alias("started_at"), none("timestamp").alias("completed_at"), F.when(k % 5 == 3, "old").alias("error"), none("string").alias("result"),
    )
    acts = j.select("document_id", F.col("created_at").alias("ts"), "job_id", _pick(F.col("job_id"), "start", "complete", "start", "fail", "cancel", "retry", "start", "abort", "unknown", "retry").alias("action"), F.concat(F.lit("v"), F.col("job_id").cast("string")).alias("value"))
    return H.replay(jobs, acts, "document_id", ["ts", "job_id"], H.JOBS, retries=("retry_count", "max_retries")).drop("max_retries")


def import_histories(spark, sf_dir):
    """Each user's imports after its events, a deleted one among them."""
    j, = spark_views(spark, sf_dir, "job")
    records = j.select(F.concat(F.lit("x"), F.col("document_id").cast("string")).alias("external_id"), F.lit("PENDING").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error")).distinct()
    k = F.col("job_id")
    acts = j.select(F.concat(F.lit("x"), F.col("document_id").cast("string")).alias("external_id"), F.col("created_at").alias("ts"), k, F.when(k % 97 == 0, "delete").otherwise(_pick(k, "success", "failure", "retry")).alias("action"), F.col("event_type").alias("value"))
    return H.replay(records, acts, "external_id", ["ts", "job_id"], H.IMPORTS)


def review_transitions(spark, sf_dir):
    e, = spark_views(spark, sf_dir, "extraction")
    k = F.col("document_id")
    acts = e.where("document_id % 3 = 0").select("id", _pick(k, "decide", "reset", "opt_out", "opt_in").alias("action"), F.when(k % 4 == 0, "REJECTED").alias("decision"))
    return L.review_actions(e, acts, F.lit(NOW).cast("date")).select("id", "review_decision", "reviewed_at", "llm_opt_out")


def import_transitions(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "imports")
    acts = i.where("document_id % 2 = 0").select("external_id", _pick(F.col("document_id"), "success", "x", "failure", "x", "retry", "x", "delete").alias("action"))
    return L.import_actions(i, acts).select("external_id", "status")


def _linked(spark, sf_dir):
    k, e, t = spark_views(spark, sf_dir, "linkage", "extraction", "ledger")
    d = F.col("document_id")
    acts = e.where("document_id % 7 < 3").select(F.col("id").alias("extraction_id"), _pick(d, "link", "orphan", "unlink").alias("action"), F.when(d % 3 == 0, d).alias("ledger_id"))
    return L.link_actions(k, e, t, acts)


def link_transitions(spark, sf_dir):
    return _linked(spark, sf_dir)[0]


def link_review_states(spark, sf_dir):
    return _linked(spark, sf_dir)[1].select("id", "review_state", "review_decision")


def link_ledger_states(spark, sf_dir):
    return _linked(spark, sf_dir)[2].select("ledger_id", "match_status")


def _moved(spark, sf_dir):
    e, k, j = spark_views(spark, sf_dir, "extraction", "linkage", "job")
    return L.transfer(e, e.where("document_id % 10 = 0").select("id", F.lit(5).cast("long").alias("user_id")), {"linkage": (k, "extraction_id"), "jobs": (j, "document_id")})


def transfer_owners(spark, sf_dir):
    return _moved(spark, sf_dir)["extractions"].select("id", "user_id")


def transfer_cascade(spark, sf_dir):
    """What is left of links and jobs after a transfer."""
    m = _moved(spark, sf_dir)
    return m["linkage"].select(F.lit("linkage").alias("kind"), F.col("link_id").alias("id")).union(m["jobs"].select(F.lit("job"), "job_id"))


def inaccessible_records(spark, sf_dir):
    c, o = spark_views(spark, sf_dir, "customer", "orders")
    shared = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return L.inaccessible(c, c.where("c_nationkey % 5 = 0"), shared, "c_custkey")


def vendor_mappings(spark, sf_dir):
    o, c = spark_views(spark, sf_dir, "orders", "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("vendor_pattern"), F.col("c_mktsegment").alias("destination_account"), F.lit("old").alias("category"), F.lit(1).cast("long").alias("use_count"))
    uses = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("vendor_pattern"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("destination_account"), F.when(F.col("o_orderkey") % 3 != 0, "new").alias("category"))
    return L.vendor_mappings(old, uses)


def documents_seen(spark, sf_dir):
    o, = spark_views(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    row = lambda day, title, owner: [k.alias("document_id"), F.sha2(F.concat(F.lit(title), k.cast("string")), 256).alias("source_hash"), F.lit(title).alias("title"), F.lit(day).alias("first_seen"), F.lit(day).alias("last_seen"), owner.alias("user_id")]
    old = o.where("o_orderkey % 3 > 0").select(row("2024-01-01", "old", F.when(k % 2 == 0, 1)))
    new = o.where("o_orderkey % 5 > 0").select(row("2024-02-01", "new", F.when(k % 7 > 0, 2)))
    return L.seen_documents(old, new)


def audit_runs(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return L.audit_page(j, 2, user=3, status="COMPLETED")[0].select("job_id")


def audit_total(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return L.audit_page(j, 2, user=3, status="COMPLETED")[1]


def completed_suggestions(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    k = F.col("job_id")
    text = F.when(k % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"category": "c'), (k % 9).cast("string"), F.lit('", "amount": '), (k % 100).cast("string"), F.lit("}")))
    return L.finished_suggestions(j.withColumn("suggestions", text), "category string, amount long")


def split_suggestions(spark, sf_dir):
    """Suggested splits with a known category and a positive amount."""
    i, = spark_views(spark, sf_dir, "line_item")
    amount = F.when(F.col("position") % 3 == 0, F.concat(F.lit("€ "), F.translate(F.col("amount").cast("string"), ".", ","))).when(F.col("position") % 3 == 1, F.col("amount").cast("string")).otherwise("n/a")
    known = F.array(F.lit("A"), F.lit("R"))
    return i.select("group_id", "item_order", S.whitelisted(F.lower("category"), known).alias("category"), L.suggested_amount(amount).alias("amount")).where("category is not null and amount > 0")


def whitelisted_values(spark, sf_dir):
    """Categories of the items, if they are among those that are allowed."""
    i, = spark_views(spark, sf_dir, "line_item")
    return i.select("group_id", "item_order", S.whitelisted(F.lower("category"), F.array(F.lit("A"), F.lit("R"))).alias("category"))


def pending_imports(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "imports")
    return i.where("status = 'PENDING'").where(F.col("user_id").isNull() | (F.col("user_id") == 2)).select("import_id", "created_at")


def window_of_sync(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    return L.sync_window(t, F.lit("1996-03-31").cast("date"), 90).select("ledger_id", "date")


def import_sides(spark, sf_dir):
    """Imports of each owner that failed or wait."""
    i, = spark_views(spark, sf_dir, "imports")
    return i.groupBy("user_id").agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "PENDING").alias("waiting"))


QUERIES = {f.__name__: f for f in (
    job_transitions, job_histories, import_histories, review_transitions, import_transitions, link_transitions, link_review_states, link_ledger_states, transfer_owners, transfer_cascade, inaccessible_records, vendor_mappings, documents_seen, audit_runs, audit_total,
    completed_suggestions, split_suggestions, whitelisted_values, pending_imports, window_of_sync, import_sides,
)}

_LINK = duckdb_views("linkage", "extraction", "ledger") + """, act AS (SELECT id AS xid, document_id AS doc, CASE document_id % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'orphan' ELSE 'unlink' END AS action,
  CASE WHEN document_id % 3 = 0 THEN document_id END AS target FROM extraction WHERE document_id % 7 < 3) """
_KNOWN = "CASE WHEN upper(category) IN ('A', 'R') THEN upper(category) END"

# One step for each action in order: what a state admits, and what it sets. r: retries left.
_JOB_FOLD = duckdb_views("job").replace("WITH ", "WITH RECURSIVE ", 1) + """,
  act AS (SELECT document_id AS k, row_number() OVER (PARTITION BY document_id ORDER BY created_at, job_id) AS n, created_at AS ts, concat('v', job_id) AS v,
    ['start', 'complete', 'start', 'fail', 'cancel', 'retry', 'start', 'abort', 'unknown', 'retry'][job_id % 10 + 1] AS a FROM job),
  fold AS (
    SELECT DISTINCT document_id AS k, 0::BIGINT AS n, ['PENDING', 'PROCESSING', 'COMPLETED', 'FAILED', 'CANCELLED'][document_id % 5 + 1] AS status, CAST(document_id % 3 AS INT) AS retry_count,
      greatest(CASE WHEN document_id % 6 = 0 THEN 0 ELSE 9 END - document_id % 3, 0) AS r, CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS completed_at,
      CASE WHEN document_id % 5 = 3 THEN 'old' END AS error, CAST(NULL AS VARCHAR) AS result, 0::BIGINT AS admitted FROM job
    UNION ALL
    SELECT k, n, CASE WHEN NOT ok THEN status WHEN a = 'start' THEN 'PROCESSING' WHEN a = 'complete' THEN 'COMPLETED' WHEN a = 'cancel' THEN 'CANCELLED' WHEN a = 'fail' AND r = 0 OR a = 'abort' THEN 'FAILED' ELSE 'PENDING' END,
      retry_count + CASE WHEN a = 'fail' AND r > 0 THEN 1 ELSE 0 END, r - CASE WHEN a = 'fail' AND r > 0 THEN 1 ELSE 0 END,
      CASE WHEN NOT ok OR a NOT IN ('start', 'retry') THEN started_at WHEN a = 'start' THEN ts END, CASE WHEN NOT ok OR a = 'start' THEN completed_at WHEN a <> 'retry' THEN ts END,
      CASE WHEN NOT ok OR a NOT IN ('fail', 'abort', 'retry') THEN error WHEN a <> 'retry' THEN v END, CASE WHEN ok AND a = 'complete' THEN v ELSE result END, admitted + CAST(ok AS BIGINT)
    FROM (SELECT f.* EXCLUDE (n), act.n, ts, v, a, a IN ('fail', 'abort') OR a = 'start' AND status = 'PENDING' OR a = 'complete' AND status = 'PROCESSING' OR a = 'cancel' AND status IN ('PENDING', 'PROCESSING') OR a = 'retry' AND status = 'FAILED' AS ok
      FROM fold f JOIN act ON act.k = f.k AND act.n = f.n + 1))
  SELECT k AS document_id, status, retry_count, started_at, completed_at, error, result, n AS actions, admitted FROM fold QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1"""
_IMPORT_FOLD = duckdb_views("job").replace("WITH ", "WITH RECURSIVE ", 1) + """,
  act AS (SELECT document_id AS k, row_number() OVER (PARTITION BY document_id ORDER BY created_at, job_id) AS n, created_at AS ts, event_type AS v,
    CASE WHEN job_id % 97 = 0 THEN 'delete' ELSE ['success', 'failure', 'retry'][job_id % 3 + 1] END AS a FROM job),
  fold AS (
    SELECT DISTINCT document_id AS k, 0::BIGINT AS n, 'PENDING' AS status, CAST(NULL AS TIMESTAMP) AS completed_at, CAST(NULL AS VARCHAR) AS error, 0::BIGINT AS admitted FROM job
    UNION ALL
    SELECT f.k, act.n, CASE WHEN a = 'delete' OR status = 'DELETED' THEN 'DELETED' WHEN a = 'success' THEN 'IMPORTED' WHEN a = 'failure' THEN 'FAILED' ELSE 'PENDING' END,
      CASE WHEN a = 'success' AND status <> 'DELETED' THEN ts ELSE completed_at END, CASE WHEN a = 'delete' OR status = 'DELETED' THEN error WHEN a = 'failure' THEN v END,
      admitted + CASE WHEN a = 'delete' OR status <> 'DELETED' THEN 1 ELSE 0 END
    FROM fold f JOIN act ON act.k = f.k AND act.n = f.n + 1)
  SELECT concat('x', k) AS external_id, status, completed_at, error, n AS actions, admitted FROM fold QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1"""

ORACLE_SQL = {
    "job_histories": _JOB_FOLD,
    "import_histories": _IMPORT_FOLD,
    "job_transitions": duckdb_views("job") + f""", a AS (SELECT *, CASE WHEN job_id % 11 < 6 THEN job_id % 4 END AS k FROM job), b AS (SELECT *, CASE WHEN k = 0 AND status = 'PENDING' THEN 'PROCESSING' WHEN k = 1 AND status = 'PROCESSING' THEN 'COMPLETED'
      WHEN k = 2 AND status IN ('PENDING', 'PROCESSING') THEN 'CANCELLED' WHEN k = 3 AND status = 'FAILED' THEN 'PENDING' END AS t FROM a)
      SELECT job_id, coalesce(t, status) AS status, CASE WHEN t IN ('COMPLETED', 'CANCELLED') THEN TIMESTAMP '{NOW}' WHEN t = 'PENDING' THEN NULL ELSE completed_at END AS completed_at FROM b""",
    "review_transitions": duckdb_views("extraction") + f""", a AS (SELECT *, CASE WHEN document_id % 3 = 0 THEN document_id % 4 END AS k FROM extraction)
      SELECT id, CASE WHEN k = 0 THEN 'REJECTED' WHEN k = 1 THEN NULL ELSE review_decision END AS review_decision, CASE WHEN k = 0 THEN DATE '{NOW}' WHEN k = 1 THEN NULL ELSE reviewed_at END AS reviewed_at,
      CASE WHEN k = 2 THEN true WHEN k = 3 THEN false ELSE llm_opt_out END AS llm_opt_out FROM a""",
    "import_transitions": duckdb_views("imports") + """SELECT external_id, CASE WHEN document_id % 2 > 0 THEN status ELSE CASE document_id % 7 WHEN 0 THEN 'IMPORTED' WHEN 2 THEN 'FAILED' WHEN 4 THEN 'PENDING' ELSE status END END AS status
      FROM imports WHERE NOT (document_id % 2 = 0 AND document_id % 7 = 6)""",
    "link_transitions": _LINK + """SELECT coalesce(extraction_id, xid) AS extraction_id, coalesce(document_id, doc) AS document_id, CASE action WHEN 'link' THEN 'LINKED' WHEN 'orphan' THEN 'ORPHAN' WHEN 'unlink' THEN 'PENDING' ELSE link_type END AS link_type,
      CASE action WHEN 'link' THEN target WHEN 'orphan' THEN NULL ELSE ledger_id END AS ledger_id FROM linkage FULL JOIN act ON extraction_id = xid WHERE link_type IS NOT NULL OR action IN ('link', 'orphan')""",
    "link_review_states": _LINK + """SELECT id, CASE action WHEN 'link' THEN 'LINKED' WHEN 'orphan' THEN 'ORPHAN_CONFIRMED' ELSE review_state END AS review_state, CASE action WHEN 'link' THEN 'LINKED' WHEN 'orphan' THEN 'ORPHAN_CONFIRMED' ELSE review_decision END AS review_decision
      FROM extraction LEFT JOIN act ON xid = id""",
    "link_ledger_states": _LINK + """SELECT ledger_id, CASE WHEN ledger_id IN (SELECT target FROM act WHERE action = 'link') THEN 'MATCHED'
      WHEN ledger_id IN (SELECT l.ledger_id FROM linkage l JOIN act ON extraction_id = xid WHERE action = 'unlink' AND l.ledger_id IS NOT NULL) THEN 'UNMATCHED' ELSE match_status END AS match_status FROM ledger""",
    "transfer_owners": duckdb_views("extraction") + "SELECT id, CASE WHEN document_id % 10 = 0 THEN 5 ELSE user_id END AS user_id FROM extraction",
    "transfer_cascade": duckdb_views("extraction", "linkage", "job") + """SELECT 'linkage' AS kind, link_id AS id FROM linkage WHERE document_id % 10 > 0 UNION ALL
      SELECT 'job', job_id FROM job WHERE document_id NOT IN (SELECT document_id FROM extraction WHERE document_id % 10 = 0)""",
    "inaccessible_records": "SELECT c_custkey FROM customer WHERE c_nationkey % 5 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "vendor_mappings": """SELECT c_name AS vendor_pattern, CASE WHEN n > 0 THEN p ELSE c_mktsegment END AS destination_account, CASE WHEN n > 0 THEN CASE WHEN k % 3 <> 0 THEN 'new' END ELSE 'old' END AS category, coalesce(n, 0) + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS use_count
      FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE n > 0 OR c_custkey % 2 = 0""",
    "documents_seen": """SELECT k AS document_id, sha256((CASE WHEN new THEN 'new' ELSE 'old' END) || k) AS source_hash, CASE WHEN new THEN 'new' ELSE 'old' END AS title, CASE WHEN new THEN '2024-02-01' ELSE '2024-01-01' END AS last_seen,
      CASE WHEN old THEN '2024-01-01' ELSE '2024-02-01' END AS first_seen, CASE WHEN old AND k % 2 = 0 THEN 1 WHEN new AND k % 7 > 0 THEN 2 END AS user_id, CASE WHEN NOT new THEN 'kept' WHEN old THEN 'updated' ELSE 'created' END AS change
      FROM (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS old, o_orderkey % 5 > 0 AS new FROM orders) WHERE old OR new""",
    "audit_runs": duckdb_views("job") + "SELECT job_id FROM job WHERE status = 'COMPLETED' AND (user_id IS NULL OR user_id = 3) ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 50",
    "audit_total": duckdb_views("job") + "SELECT count(*) AS total FROM job WHERE status = 'COMPLETED' AND (user_id IS NULL OR user_id = 3)",
    "completed_suggestions": duckdb_views("job") + """SELECT document_id, CASE WHEN job_id % 5 > 0 THEN 'c' || (job_id % 9) END AS category, CASE WHEN job_id % 5 > 0 THEN job_id % 100 END AS amount
      FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) AS n FROM job) WHERE n = 1 AND status = 'COMPLETED'""",
    "split_suggestions": duckdb_views("line_item") + f"SELECT group_id, item_order, {_KNOWN} AS category, amount FROM line_item WHERE position % 3 < 2 AND amount > 0 AND {_KNOWN} IS NOT NULL",
    "whitelisted_values": duckdb_views("line_item") + f"SELECT group_id, item_order, {_KNOWN} AS category FROM line_item",
    "pending_imports": duckdb_views("imports") + "SELECT import_id, created_at FROM imports WHERE status = 'PENDING' AND (user_id IS NULL OR user_id = 2)",
    "window_of_sync": duckdb_views("ledger") + "SELECT ledger_id, date FROM ledger WHERE date BETWEEN DATE '1996-03-31' - 90 AND DATE '1996-03-31'",
    "import_sides": duckdb_views("imports") + "SELECT user_id, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PENDING') AS waiting FROM imports GROUP BY user_id",
}
