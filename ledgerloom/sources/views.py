"""Finance-shaped views over the driver's tables, in SQL that Spark and DuckDB both read.

`{div}` stands for integer division; everything else is common to both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS = {
    "proposal": """
        SELECT o_orderkey AS document_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS date,
               lower(c_name) AS vendor, concat('invoice ', lower(c_mktsegment), ' ', lower(o_orderpriority)) AS description,
               lower(c_mktsegment) AS source_account, nullif(o_custkey % 7, 0) AS user_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "ledger": """
        SELECT o_orderkey AS ledger_id,
               CAST((CAST(round(o_totalprice * 100) AS BIGINT) * (100 + o_orderkey % 25) {div} 100) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS amount,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) AS date,
               concat('payment ', lower(c_mktsegment), CASE WHEN o_orderkey % 3 = 0 THEN concat(' ', lower(o_orderpriority)) ELSE '' END) AS description,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN concat(lower(c_name), ' inc') ELSE lower(c_name) END AS destination_account,
               lower(c_mktsegment) AS source_account,
               CASE WHEN o_orderkey % 4 = 0 THEN 'MATCHED' WHEN o_orderkey % 9 = 0 THEN 'PROPOSED' ELSE 'UNMATCHED' END AS match_status,
               CASE WHEN o_orderkey % 97 = 0 THEN CAST(o_orderdate AS DATE) END AS deleted_at,
               nullif(o_custkey % 7, 0) AS user_id,
               CASE WHEN o_orderkey % 13 = 0 THEN concat('archive:', CAST(o_orderkey AS STRING), ':0123456789abcdef:10.00:2024-01-01')
                    WHEN o_orderkey % 17 = 0 THEN concat('0123456789abcdef:pl:', CAST(o_orderkey AS STRING)) ELSE NULL END AS external_id,
               CASE WHEN o_orderkey % 19 = 0 THEN concat('ARCHIVE:', CAST(o_orderkey AS STRING), ' x') END AS internal_reference,
               CASE WHEN o_orderkey % 23 = 0 THEN concat('note. Archive doc_id=', CAST(o_orderkey AS STRING)) END AS notes
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "paper": """
        SELECT o_orderkey + CASE WHEN n > 0 THEN 1000000000 ELSE 0 END AS document_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS date,
               lower(c_name) AS vendor, concat('invoice ', lower(c_mktsegment), ' ', lower(o_orderpriority)) AS description, lower(c_mktsegment) AS source_account
        FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) copies WHERE n = 0 OR o_orderkey % 4 = 0""",
    "bank": """
        SELECT o_orderkey AS ledger_id, CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS amount, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS date,
               CASE WHEN o_orderkey % 7 = 0 THEN concat('invoice ', lower(c_mktsegment)) ELSE 'card payment' END AS description, lower(c_mktsegment) AS source_account,
               CASE WHEN o_orderkey % 6 = 0 THEN concat('the ', lower(c_name)) ELSE lower(c_name) END AS destination_account, 'UNMATCHED' AS match_status, CAST(NULL AS DATE) AS deleted_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "extraction": """
        SELECT o_orderkey * 10 AS id, o_orderkey AS document_id, concat('x', CAST(o_orderkey AS STRING)) AS external_id,
               (o_orderkey % 101) / CAST(100 AS DOUBLE) AS overall,
               CASE WHEN o_orderkey % 101 >= 85 THEN 'AUTO' WHEN o_orderkey % 101 >= 60 THEN 'REVIEW' ELSE 'MANUAL' END AS review_state,
               CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'P' THEN 'EDITED' END AS review_decision,
               CAST(o_orderdate AS DATE) AS created_at, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 3 END AS reviewed_at,
               o_orderkey % 29 = 0 AS llm_opt_out, nullif(o_custkey % 7, 0) AS user_id
        FROM orders""",
    "linkage": """
        SELECT o_orderkey AS link_id, o_orderkey * 10 AS extraction_id, o_orderkey AS document_id,
               CASE o_orderkey % 5 WHEN 0 THEN 'LINKED' WHEN 1 THEN 'ORPHAN' WHEN 2 THEN 'PENDING' ELSE 'AUTO_LINKED' END AS link_type,
               CASE WHEN o_orderkey % 5 IN (0, 3) AND o_orderkey % 10 <> 0 THEN o_orderkey END AS ledger_id
        FROM orders WHERE o_orderkey % 5 < 4""",
    "imports": """
        SELECT o_orderkey AS import_id, concat('x', CAST(o_orderkey AS STRING)) AS external_id, o_orderkey AS document_id,
               CASE o_orderkey % 9 WHEN 1 THEN 'IMPORTED' WHEN 2 THEN 'FAILED' WHEN 4 THEN 'PENDING' WHEN 5 THEN 'IMPORTED' WHEN 7 THEN 'FAILED' ELSE 'IMPORTED' END AS status,
               CAST(o_orderdate AS DATE) + 5 AS created_at, nullif(o_custkey % 7, 0) AS user_id
        FROM orders WHERE o_orderkey % 3 <> 0""",
    "line_item": """
        SELECT l_orderkey AS group_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS position,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) - 1 AS item_order,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, concat('part ', CAST(l_partkey AS STRING)) AS description, l_returnflag AS category
        FROM lineitem""",
    "job": """
        SELECT event_id AS job_id, user_id AS document_id, user_id % 10 AS user_id, CAST(user_id % 5 AS INT) AS priority,
               CASE event_id % 7 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'CANCELLED' ELSE 'COMPLETED' END AS status,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS scheduled_for, ts AS created_at,
               CASE WHEN event_id % 7 > 2 THEN ts END AS completed_at, CAST(event_id % 4 AS INT) AS retry_count, 3 AS max_retries, event_type
        FROM events""",
}


def spark_views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views or tables as frames."""
    ship(spark)
    out = []
    for name in names:
        if name not in VIEWS:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            continue
        sql = VIEWS[name].replace("{div}", "div").replace("{", "{{").replace("}", "}}")
        used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
        for t in used:
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        out.append(spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}))
    return out


def duckdb_views(*names: str) -> str:
    """The named views as a WITH clause."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{div}', '//').replace('AS STRING', 'AS VARCHAR')})" for n in names) + "\n"
