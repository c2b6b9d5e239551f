"""Queries of catalogs read from pages, tags of mixed types, and proposals with a status of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import matching as M
from ..operators import queues as Q
from ..operators import traces as R
from ..operators.paging import paged
from ..session import shared_folder
from ..sources.pages import pages
from ..sources.views import duckdb_views, spark_views
from .linking import LIVE, RANKED, all_pairs


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def tags_normalised(spark, sf_dir):
    """Tags of every customer, as lists of strings, objects and other things, or no lists at all."""
    c, = spark_views(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    raw = (
        F.when(k % 11 == 0, say("[", name, ', "", null, "b"]')).when(k % 11 == 1, say('[{"tag": ', name, '}, {"tag": "", "name": "n"}, {"name": "m"}]'))
        .when(k % 11 == 2, say('[{"tag": 5, "name": "no"}, {"tag": 0, "name": "zero"}, {"tag": [], "name": "list"}, {"tag": {"a": 1}, "name": "no"}, ', _text("c_custkey"), "]"))
        .when(k % 11 == 3, say('[["x"], true, 1.5, {"other": 1}]')).when(k % 11 == 4, "[]").when(k % 11 == 5, "null").when(k % 11 == 6, say('{"tag": ', name, "}"))
        .when(k % 11 == 7, name).when(k % 11 == 8, _text("c_custkey")).when(k % 11 == 9, "[broken")
    )
    return c.select("c_custkey", E.tags(raw).alias("t")).select("c_custkey", F.array_join("t.tags", "|").alias("tags"), "t.error")


#: Sources of pages: kind, table, id, and the JSON of the attributes in SQL that Spark and DuckDB both read.
_PAGES = {
    "categories": ("part", "p_partkey", """concat('{"name": "', p_name, '"', CASE WHEN p_partkey % 3 = 0 THEN concat(', "notes": "', p_brand, '"') ELSE '' END, '}')"""),
    "tags": ("customer", "c_custkey", """concat('{"tag": "', c_mktsegment, '"}')"""),
    "piggy_banks": ("customer", "c_custkey", """concat('{"name": "', c_name, '", "target_amount": "', CAST(c_custkey AS STRING), '.25"}')"""),
    "budgets": ("nation", "n_nationkey", """concat('{"name": "', n_name, '", "active": ', CASE WHEN n_nationkey % 2 = 0 THEN 'false' ELSE 'true' END, '}')"""),
    "bills": ("supplier", "s_suppkey", """concat('{"name": "', s_name, '", "amount_min": ', CAST(s_suppkey AS STRING), ', "date": "2024-01-', substr(CAST(100 + s_suppkey % 28 + 1 AS STRING), 2), 'T00:00:00"}')"""),
    "rule_groups": ("region", "r_regionkey", """concat('{"title": "', r_name, '", "order": ', CAST(r_regionkey AS STRING), '}')"""),
    "rules": ("nation", "n_nationkey", """concat('{"title": "', n_name, '", "rule_group_id": "', CAST(n_regionkey AS STRING), '", "triggers": [{"type": "t"}]}')"""),
    "recurrences": ("supplier", "s_suppkey", """concat('{"title": "', s_name, '", "first_date": "2024-02-01"}')"""),
    "currencies": ("nation", "n_nationkey", """concat('{"code": "', n_name, '", "name": "', n_name, '", "enabled": ', CASE WHEN n_nationkey % 5 = 0 THEN 'false' ELSE 'true' END, '}')"""),
}
_NAME = {"tags": "tag", "rule_groups": "title", "rules": "title", "recurrences": "title"}


def _saved(spark, sf_dir, kind: str) -> str:
    """A folder of pages of fifty items, one page a line, made from a table."""
    table, key, attributes = _PAGES[kind]
    df, = spark_views(spark, sf_dir, table)
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    item = F.concat(F.lit('{"id": "'), _text(key), F.lit('", "attributes": '), F.expr(attributes), F.lit("}"))
    lines = df.select(F.floor(F.col(key) / 50).alias("page"), item.alias("item")).groupBy("page").agg(F.array_join(F.collect_list("item"), ", ").alias("items"))
    lines.select(F.concat(F.lit('{"data": ['), "items", F.lit("]}")).alias("value")).write.text(folder)
    return folder


def catalog_rows(spark, sf_dir):
    """The rows of nine catalogs, read from pages: id, name, and what else each of them has."""
    of = {
        "categories": "notes", "piggy_banks": "CAST(target_amount AS STRING)", "budgets": "CAST(active AS STRING)", "bills": "concat(CAST(amount_min AS STRING), ' ', CAST(date AS STRING), ' ', CAST(skip AS STRING))",
        "rule_groups": "CAST(`order` AS STRING)", "rules": "concat(CAST(rule_group_id AS STRING), triggers, actions)", "recurrences": "concat(CAST(first_date AS STRING), repetitions)", "currencies": "concat(code, CAST(decimal_places AS STRING))",
    }
    out = None
    for kind in _PAGES:
        df = pages(spark, _saved(spark, sf_dir, kind), kind)
        if kind == "currencies":
            df = E.enabled(df)
        rows = df.select(F.lit(kind).alias("kind"), "id", F.col(_NAME.get(kind, "name")).alias("name"), F.expr(of.get(kind, "CAST(NULL AS STRING)")).alias("more"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bills_between(spark, sf_dir):
    """Bills of two weeks; the dates are compared while pages are read."""
    df = pages(spark, _saved(spark, sf_dir, "bills"), "bills")
    return df.where("date >= date'2024-01-05' and date < date'2024-01-19'").select("id", "name", _text("date").alias("date"))


def next_user_job(spark, sf_dir):
    """The one job of all users, where hours and intervals put users out of turn."""
    j, = spark_views(spark, sf_dir, "job")
    u = F.col("user_id")
    p = j.groupBy("user_id").agg((u % 3 != 0).alias("enabled"), (u + 1).cast("int").alias("from_hour"), F.lit(18).alias("to_hour"), (u * 20_000).cast("int").alias("interval_minutes"))
    done = j.where("status = 'COMPLETED'").select("user_id", F.col("created_at").alias("ts"))
    return Q.next_of_all(j, p, done, F.lit("2024-03-01").cast("timestamp"), 6).select("user_id", "job_id")


def proposal_statuses(spark, sf_dir):
    """Matches of exact or high totals are matched at once: here all from 0.7 on."""
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    made = M.proposals(M.top_matches(docs, ledger.where(LIVE), details=False), 700_000)
    return made.select("document_id", "ledger_id", "total", "status")


def ledger_auto_matched(spark, sf_dir):
    """The ledger after these."""
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    ledger = ledger.withColumn("document_id", F.when(F.col("match_status") == "MATCHED", F.col("ledger_id")))
    made = M.proposals(M.top_matches(docs, ledger.where(LIVE), details=False), 700_000)
    return M.auto_matched(ledger, made).select("ledger_id", "match_status", "document_id", "match_confidence")


def _traced(spark, sf_dir):
    """Events of documents as events of traces: every fiftieth begins a run, every seventieth ends one, and pauses do."""
    j, = spark_views(spark, sf_dir, "job")
    k = F.col("job_id")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    return j.select(
        "document_id", F.col("created_at").alias("ts"), k.alias("seq"), F.when(k % 50 == 0, "START").when(k % 70 == 0, "END").otherwise(pick(*R.STAGES)).alias("stage"),
        F.when(k % 2 == 0, "amount").otherwise(F.col("event_type")).alias("field"), F.concat(F.lit("mail x@y.de k"), _text("job_id")).alias("value"), pick("str", "int", "str").alias("kind"),
        pick("RULE", "LLM", "CACHE", "RULE", "RULE").alias("method"), F.when(k % 4 != 0, (k % 100) / 100).alias("confidence"), F.lit(None).cast("string").alias("notes"),
    )


def trace_events(spark, sf_dir):
    """Every event with its run, its place there, and an outcome that is safe to store."""
    return R.safe(R.trace_events(_traced(spark, sf_dir), "20 hours")).select("document_id", "seq", "run", "place", "outcome")


def trace_totals(spark, sf_dir):
    out = R.trace_totals(R.trace_events(_traced(spark, sf_dir), "20 hours"))
    return out.drop("started_at", "completed_at")


def ledger_page(spark, sf_dir):
    """The twentieth page of forty ledger rows, newest first, read from the range that holds it."""
    ledger, = spark_views(spark, sf_dir, "ledger")
    return paged(ledger.select("ledger_id", "date", "amount"), [F.desc("date"), F.col("ledger_id")], 500).page(20, 40).select("ledger_id", F.col("amount").cast("double").alias("amount"))


QUERIES = {f.__name__: f for f in (trace_events, trace_totals, ledger_page, tags_normalised, catalog_rows, bills_between, next_user_job, proposal_statuses, ledger_auto_matched)}

_STATUS = all_pairs(LIVE) + RANKED + ", made AS (SELECT document_id, ledger_id, CAST(total AS INT) AS total, CASE WHEN total >= 700000 OR is_exact THEN 'AUTO_MATCHED' ELSE 'PENDING' END AS status FROM best) "
_TRACED = duckdb_views("job") + """, e AS (SELECT document_id, created_at AS ts, job_id AS seq, CASE WHEN job_id % 50 = 0 THEN 'START' WHEN job_id % 70 = 0 THEN 'END' ELSE ['EXTRACTION', 'NORMALIZATION', 'MATCHING', 'SUGGESTION', 'DECISION', 'WRITE'][job_id % 6 + 1] END AS stage,
    CASE WHEN job_id % 2 = 0 THEN 'amount' ELSE event_type END AS field, ['RULE', 'LLM', 'CACHE', 'RULE', 'RULE'][job_id % 5 + 1] AS method, CASE WHEN job_id % 4 <> 0 THEN job_id % 100 END AS hundredths FROM job),
  p AS (SELECT *, lag(ts) OVER w AS before, lag(stage) OVER w AS prior FROM e WINDOW w AS (PARTITION BY document_id ORDER BY ts, seq)),
  r AS (SELECT *, sum(CASE WHEN before IS NULL OR stage = 'START' OR prior = 'END' OR ts > before + INTERVAL 20 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM p),
  t AS (SELECT *, row_number() OVER (PARTITION BY document_id, run ORDER BY ts, seq) AS place FROM r) """
ORACLE_SQL = {
    "trace_events": _TRACED + """SELECT document_id, seq, run, place, CASE WHEN field = 'amount' THEN concat('amount=mail x@y.de k', seq) WHEN seq % 3 <> 1 THEN concat(field, '=', chr(39), 'mail [REDACTED] k', seq, chr(39)) ELSE concat(field, '=<int>') END AS outcome FROM t""",
    "trace_totals": _TRACED + """SELECT document_id, run, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms, count(*) AS n_events, count(*) FILTER (stage = 'EXTRACTION') AS n_extraction, count(*) FILTER (stage = 'NORMALIZATION') AS n_normalization,
      count(*) FILTER (stage = 'MATCHING') AS n_matching, count(*) FILTER (stage = 'SUGGESTION') AS n_suggestion, count(*) FILTER (stage = 'DECISION') AS n_decision, count(*) FILTER (stage = 'WRITE') AS n_write, count(DISTINCT field) AS n_fields,
      bool_or(method = 'LLM') AS model_used, count(*) FILTER (method = 'CACHE') AS from_cache, CAST(sum(hundredths) * 10000 // count(hundredths) AS BIGINT) AS confidence, max_by(field, place) FILTER (stage = 'DECISION') AS decided FROM t GROUP BY document_id, run""",
    "ledger_page": duckdb_views("ledger") + "SELECT ledger_id, CAST(amount AS DOUBLE) AS amount FROM ledger ORDER BY date DESC, ledger_id LIMIT 40 OFFSET 760",
    "tags_normalised": """SELECT c_custkey, CASE c_custkey % 11 WHEN 0 THEN concat(c_name, '|b') WHEN 1 THEN concat(c_name, '|n|m') WHEN 2 THEN 'zero|list' END AS tags,
      CASE c_custkey % 11 WHEN 6 THEN 'Unexpected tags format: expected list or None, got dict' WHEN 7 THEN 'Unexpected tags format: expected list or None, got str' WHEN 8 THEN 'Unexpected tags format: expected list or None, got int'
        WHEN 9 THEN 'Tags are not JSON' END AS error FROM customer""",
    "catalog_rows": """SELECT 'categories' AS kind, p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS more FROM part
      UNION ALL SELECT 'tags', c_custkey, c_mktsegment, NULL FROM customer UNION ALL SELECT 'piggy_banks', c_custkey, c_name, concat(c_custkey, '.25') FROM customer
      UNION ALL SELECT 'budgets', n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'false' ELSE 'true' END FROM nation
      UNION ALL SELECT 'bills', s_suppkey, s_name, concat(s_suppkey, '.00 2024-01-', substr(CAST(100 + s_suppkey % 28 + 1 AS VARCHAR), 2), ' 0') FROM supplier
      UNION ALL SELECT 'rule_groups', r_regionkey, r_name, CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'rules', n_nationkey, n_name, concat(n_regionkey, '[{"type":"t"}][]') FROM nation
      UNION ALL SELECT 'recurrences', s_suppkey, s_name, '2024-02-01[]' FROM supplier UNION ALL SELECT 'currencies', n_nationkey, n_name, concat(n_name, '2') FROM nation WHERE n_nationkey % 5 <> 0""",
    "bills_between": "SELECT s_suppkey AS id, s_name AS name, CAST(DATE '2024-01-01' + CAST(s_suppkey % 28 AS INT) AS VARCHAR) AS date FROM supplier WHERE s_suppkey % 28 BETWEEN 4 AND 17",
    "next_user_job": duckdb_views("job") + """, last AS (SELECT user_id, max(created_at) AS t FROM job WHERE status = 'COMPLETED' GROUP BY user_id)
      SELECT user_id, job_id FROM job LEFT JOIN last USING (user_id) WHERE status = 'PENDING' AND user_id % 3 <> 0 AND user_id + 1 <= 6 AND (scheduled_for IS NULL OR scheduled_for <= TIMESTAMP '2024-03-01')
        AND (t IS NULL OR epoch(TIMESTAMP '2024-03-01') - floor(epoch(t)) >= user_id * 1200000) ORDER BY priority DESC, scheduled_for NULLS FIRST, job_id LIMIT 1""",
    "proposal_statuses": _STATUS + "SELECT * FROM made",
    "ledger_auto_matched": _STATUS + """, last AS (SELECT ledger_id, max(document_id) AS d, max_by(total, document_id) AS n FROM made WHERE status = 'AUTO_MATCHED' GROUP BY ledger_id)
      SELECT ledger_id, CASE WHEN d IS NOT NULL THEN 'MATCHED' ELSE match_status END AS match_status, coalesce(d, CASE WHEN match_status = 'MATCHED' THEN ledger_id END) AS document_id, n AS match_confidence FROM ledger LEFT JOIN last USING (ledger_id)""",
}
