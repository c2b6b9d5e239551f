"""Queries of payloads, suggestions and reconciliation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import payloads as P
from ..operators import reconcile as R
from ..operators import suggestions as S
from ..operators.sync import live_cache
from ..sources.views import duckdb_views, spark_views
from .linking import LIVE, all_pairs


def _accepted(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    k = F.col("document_id")
    return p.select(
        "document_id", F.element_at(F.array(*[F.lit(x) for x in ("withdrawal", "deposit", "transfer")]), (k % 3 + 1).cast("int")).alias("type"), F.when(k % 11 != 0, F.col("date")).alias("date"),
        F.when(k % 13 != 0, F.col("amount")).otherwise(0).cast("decimal(18,2)").alias("amount"), F.when(k % 7 != 0, F.col("description")).otherwise("").alias("description"), F.concat(F.lit("x"), k.cast("string")).alias("external_id"),
        F.when(k % 2 == 0, F.col("source_account")).alias("source_account"), F.when(k % 5 == 0, "").alias("destination_account"), F.when(k % 4 != 0, F.col("vendor")).alias("correspondent"), F.lit("EUR").alias("currency"),
        F.lit(None).cast("string").alias("category"), F.array(F.lit("t")).alias("tags"), F.when(k % 6 == 0, "seen").alias("notes"), F.sha2(k.cast("string"), 256).alias("source_hash"), (k % 101 / 100.0).cast("double").alias("overall"),
        F.lit("AUTO").alias("review_state"), F.lit("").alias("parser"),
    )


def payload_build(spark, sf_dir):
    out = P.payloads(_accepted(spark, sf_dir))
    return out.where("error is null").select("document_id", "type", "amount", "source_name", "destination_name", F.array_join("tags", ",").alias("tags"), "notes", "internal_reference", "external_url")


def payload_rejects(spark, sf_dir):
    return P.payloads(_accepted(spark, sf_dir)).where("error is not null").select("document_id", "error")


def payload_errors(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "line_item")
    k, o = F.col("group_id"), F.col("item_order")
    errors = P.payload_errors(o, F.when(k % 5 == 0, "gift").when(k % 5 == 1, F.lit(None)).otherwise("deposit"), F.when(k % 3 != 0, "2024-01-01"), F.when(k % 7 == 0, "-1.00").when(k % 7 == 1, "x").otherwise("5.00"), F.lit("d"), F.when(k % 2 == 0, "id"), F.lit("n"))
    return i.select("group_id", "item_order", F.array_join(errors, "|").alias("errors"))


def category_match(spark, sf_dir):
    c, p = spark_views(spark, sf_dir, "part", "part")
    cats = p.select(F.col("p_type").alias("category")).distinct().select("category", F.col("category").alias("position"))
    raw = c.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("nothing like it").alias("raw"))
    return S.match_category(raw, cats).select("p_partkey", "category")


def json_repair(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    k = F.col("document_id")
    v = k.cast("string")
    text = (F.when(k % 6 == 0, F.concat(F.lit('```json\\n{"category": "c'), v, F.lit('"}\\n```'))).when(k % 6 == 1, F.concat(F.lit('Sure: {"category": "c'), v, F.lit('"} done'))).when(k % 6 == 2, F.concat(F.lit('{category: "c'), v, F.lit('",}')))
            .when(k % 6 == 3, F.concat(F.lit('broken { "category": "c'), v, F.lit('", "confidence": 0.25'))).when(k % 6 == 4, F.lit("no idea")))
    out = p.select("document_id", S.response(text).alias("j"))
    return out.select("document_id", F.get_json_object("j", "$.category").alias("category"), F.get_json_object("j", "$.reason").alias("reason"))


def llm_cache_valid(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    key = S.cache_key(F.col("event_type"), F.when(F.col("job_id") % 2 == 0, F.col("document_id")), F.lit("v1"))
    cache = j.select("job_id", key.alias("cache_key"), (F.col("created_at") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return live_cache(cache, F.lit("2024-02-14").cast("timestamp")).select("job_id", "cache_key")


def auto_apply(spark, sf_dir):
    e, = spark_views(spark, sf_dir, "extraction")
    return e.select("id", S.auto_apply(F.col("overall"), F.col("document_id") % 150, opted_out=F.col("llm_opt_out")).alias("applies"), S.whitelisted(F.lower("review_state"), F.array(F.lit("AUTO"), F.lit("MANUAL"))).alias("state"), S.feedback(F.col("review_state"), F.lit("auto ")).alias("feedback"))


def reconcile_run(spark, sf_dir):
    """The audit rows of a run over all documents."""
    p, t = spark_views(spark, sf_dir, "proposal", "ledger")
    ledger = t.withColumn("document_id", F.when(F.col("match_status") == "MATCHED", F.col("ledger_id")))
    none = ledger.where("false").select("document_id", "ledger_id", F.lit(0).alias("total"))
    known = ledger.where("ledger_id % 8 = 1").select(F.col("ledger_id").alias("document_id"), "ledger_id")
    return R.run(p, ledger, known, none, threshold=700_000).audit


def trace_summary(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    e = j.select(F.col("document_id").alias("run_id"), F.col("created_at").alias("ts"), F.col("job_id").alias("seq"), F.when(F.col("job_id") % 3 == 0, "MATCHING").otherwise("EXTRACTION").alias("stage"), F.col("event_type").alias("field"),
                 pii.outcome(F.lit("amount"), F.col("job_id").cast("string"), F.lit("str")).alias("outcome"), (F.col("job_id") % 10 / 10.0).cast("double").alias("confidence"))
    return R.traces(e)


QUERIES = {f.__name__: f for f in (payload_build, payload_rejects, payload_errors, category_match, json_repair, llm_cache_valid, auto_apply, reconcile_run, trace_summary)}
_ACC = duckdb_views("proposal") + """, a AS (SELECT *, ['withdrawal', 'deposit', 'transfer'][document_id % 3 + 1] AS type, CASE WHEN document_id % 2 = 0 THEN source_account END AS src, CASE WHEN document_id % 4 <> 0 THEN vendor END AS cor,
  CASE WHEN document_id % 11 = 0 THEN 'date is required but empty' WHEN document_id % 7 = 0 THEN 'description is required but empty' WHEN document_id % 13 = 0 OR amount = 0 THEN 'amount is required but empty' END AS error FROM proposal)
"""
_RUN = all_pairs(LIVE, "document_id NOT IN (SELECT ledger_id FROM ledger WHERE match_status = 'MATCHED')")
ORACLE_SQL = {
    "payload_build": _ACC + """SELECT document_id, type, CAST(amount AS VARCHAR) AS amount, CASE WHEN type = 'deposit' THEN coalesce(src, cor, 'Unknown Source') ELSE coalesce(src, 'Checking Account') END AS source_name,
      CASE type WHEN 'withdrawal' THEN coalesce(cor, 'Unknown Merchant') WHEN 'deposit' THEN 'Checking Account' ELSE 'Unknown Account' END AS destination_name, 't,archive' AS tags,
      concat('Archive doc_id=', document_id, '; source_hash=', substr(sha256(CAST(document_id AS VARCHAR)), 1, 16), '; confidence=', printf('%.2f', (document_id % 101) / 100.0::DOUBLE), '; review_state=AUTO', CASE WHEN document_id % 6 = 0 THEN '; seen' ELSE '' END) AS notes,
      concat('ARCHIVE:', document_id) AS internal_reference, concat('http://localhost:8000/documents/', document_id, '/') AS external_url FROM a WHERE error IS NULL""",
    "payload_rejects": _ACC + "SELECT document_id, error FROM a WHERE error IS NOT NULL",
    "payload_errors": duckdb_views("line_item") + """SELECT group_id, item_order, concat_ws('|', CASE group_id % 5 WHEN 0 THEN concat(p, 'type must be withdrawal/deposit/transfer, got: gift') WHEN 1 THEN concat(p, 'type is required') END,
      CASE WHEN group_id % 3 = 0 THEN concat(p, 'date is required') END, CASE group_id % 7 WHEN 0 THEN concat(p, 'amount must be positive, got: -1.00') WHEN 1 THEN concat(p, 'amount must be a valid decimal, got: x') END,
      CASE WHEN item_order = 0 AND group_id % 2 <> 0 THEN concat(p, 'external_id is required for idempotent imports') END) AS errors FROM (SELECT *, concat('transactions[', item_order, '].') AS p FROM line_item)""",
    "category_match": """WITH cats AS (SELECT DISTINCT p_type AS category, string_split(lower(p_type), ' ') AS w FROM part),
      raw AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_name ELSE 'nothing like it' END AS raw FROM part),
      pairs AS (SELECT p_partkey, category, CASE WHEN lower(raw) = lower(category) THEN 3 WHEN contains(lower(category), lower(raw)) OR contains(lower(raw), lower(category)) THEN 2 ELSE 1 END AS kind,
        len(list_intersect(list_distinct(string_split(lower(raw), ' ')), list_distinct(w))) AS n FROM raw, cats),
      best AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY kind DESC, CASE WHEN kind = 1 THEN n ELSE 0 END DESC, category) AS k FROM pairs WHERE kind > 1 OR n > 0)
      SELECT p_partkey, category FROM raw LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (p_partkey)""",
    "json_repair": duckdb_views("proposal") + "SELECT document_id, CASE WHEN document_id % 6 < 4 THEN concat('c', document_id) END AS category, CASE WHEN document_id % 6 = 3 THEN 'Extracted from malformed response' END AS reason FROM proposal",
    "llm_cache_valid": duckdb_views("job") + "SELECT job_id, sha256(concat_ws('|', event_type, CASE WHEN job_id % 2 = 0 THEN CAST(document_id AS VARCHAR) ELSE '' END, 'v1')) AS cache_key FROM job WHERE created_at > TIMESTAMP '2024-01-15'",
    "auto_apply": duckdb_views("extraction") + "SELECT id, overall >= 0.9 AND document_id % 150 >= 100 AND NOT llm_opt_out AS applies, CASE WHEN review_state <> 'REVIEW' THEN review_state END AS state, CASE WHEN review_state = 'AUTO' THEN 'CORRECT' ELSE 'WRONG' END AS feedback FROM extraction",
    "reconcile_run": _RUN + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY total DESC, tx_date DESC NULLS LAST, ledger_id) AS rank FROM t WHERE total >= 200000),
      props AS (SELECT * FROM ranked WHERE rank <= 5 AND NOT (document_id = ledger_id AND ledger_id % 8 = 1)), c AS (SELECT *, count(*) FILTER (total >= 700000) OVER (PARTITION BY ledger_id) AS strong FROM props)
      SELECT document_id, ledger_id, 'PROPOSED' AS final_state, false AS auto_applied FROM props UNION ALL SELECT document_id, ledger_id, 'LINKED', true FROM c WHERE strong = 1 AND total >= 700000""",
    "trace_summary": duckdb_views("job") + """SELECT document_id AS run_id, count(*) AS n_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS fields, count(*) FILTER (job_id % 3 = 0) AS n_matching, round(avg((job_id % 10) / 10.0::DOUBLE), 6) AS confidence,
      string_agg(concat('amount=', job_id), '|' ORDER BY created_at, job_id) AS outcomes FROM job GROUP BY document_id""",
}
