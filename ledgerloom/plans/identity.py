"""Queries of identifiers, fingerprints, confidence and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import safe_decimal
from ..operators import confidence as C
from ..operators import identity as I
from ..operators import splits as S
from ..operators import sync as Y
from ..sources.views import duckdb_views, spark_views


def external_id_v2(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    h = I.transaction_hash(F.col("amount"), F.col("date").cast("string"), F.col("source_account"), F.col("vendor"), F.col("description"))
    return p.select("document_id", I.external_id(h, F.col("document_id")).alias("external_id"), I.external_id(h).alias("unlinked_id"))


def external_id_legacy(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    source = F.sha2(F.col("document_id").cast("string"), 256)
    return p.select("document_id", I.legacy_external_id(F.col("document_id"), source, F.col("amount"), F.col("date").cast("string")).alias("external_id"))


def parse_external_id(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    p = t.where("external_id is not null").select("ledger_id", I.parse_external_id(F.col("external_id")).alias("p"), I.is_own_external_id(F.col("external_id")).alias("is_own"))
    return p.select("ledger_id", "p.document_id", "p.hash", F.col("p.amount").cast("double").alias("amount"), "p.date", "is_own")


def link_markers(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    three = [F.col("external_id"), F.col("internal_reference"), F.col("notes")]
    return t.select("ledger_id", I.is_linked(*three).alias("linked"), I.marked_document(*three).alias("document_id"), I.internal_reference(F.col("ledger_id")).alias("reference"), I.notes_marker(F.col("ledger_id")).alias("marker"))


def fingerprints(spark, sf_dir):
    c, = spark_views(spark, sf_dir, "customer")
    name, money = F.col("c_name"), F.col("c_acctbal").cast("decimal(18,2)")
    return c.select(
        "c_custkey", I.fingerprint("category", name).alias("category"), I.fingerprint("tag", F.col("c_mktsegment")).alias("tag"), I.account_fingerprint(F.col("c_mktsegment"), name, F.lit(None).cast("string")).alias("account"),
        I.piggy_fingerprint(name, money).alias("piggy"), I.fingerprint("budget", name).alias("budget"), I.fingerprint("rule_group", name).alias("rule_group"), I.currency_fingerprint(F.substring(name, 1, 3)).alias("currency"),
        I.bill_fingerprint(name, money, F.lit(None).cast("decimal(18,2)")).alias("bill"), I.recurrence_fingerprint(name, F.lit("2024-01-31T00:00"), F.lit(" Weekly")).alias("recurrence"),
        I.rule_fingerprint(name, F.array(F.struct(F.lit("z").alias("type"), name.alias("value")), F.struct(F.lit("a").alias("type"), F.col("c_mktsegment").alias("value"))), F.array().cast("array<struct<type:string,value:string>>")).alias("rule"),
    )


def review_state(spark, sf_dir):
    e, = spark_views(spark, sf_dir, "extraction")
    return e.select("id", C.review_state(F.col("overall")).alias("state"), C.strict_review_state(F.col("overall"), (F.col("id") % 10 + 1) / 10.0, F.col("overall")).alias("strict_state"))


def strategy_adjust(spark, sf_dir):
    e, = spark_views(spark, sf_dir, "extraction")
    name = F.element_at(F.array(*[F.lit(x) for x in ("factur_x", "pdf_text", "ocr_heuristic", "fallback", "none", "other")]), (F.col("document_id") % 6 + 1).cast("int"))
    return e.select("id", name.alias("strategy"), F.round(C.adjusted(F.col("overall"), name), 9).alias("adjusted"))


def overall_confidence(spark, sf_dir):
    e, = spark_views(spark, sf_dir, "extraction")
    k = lambda n: (F.col("document_id") % n) / float(n)
    return e.select("id", F.round(C.overall(k(11), k(7), k(5), k(3), k(2), k(13)), 9).alias("overall"))


def txn_type(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Invoice", "Gutschrift", "Letter", "Credit note")]), (F.col("document_id") % 4 + 1).cast("int"))
    tags = F.when(F.col("document_id") % 3 == 0, F.array(F.lit("Income"), F.lit("x"))).otherwise(F.array(F.lit("y")))
    return p.select("document_id", C.transaction_type(kind, tags).alias("type"))


def validation_issues(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    k = F.col("document_id")
    issues = C.issues(
        F.when(k % 5 == 0, F.lit(0)).otherwise(F.col("amount")), F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.lit("2024-13-01")).otherwise(F.col("date").cast("string")),
        F.when(k % 3 != 0, F.col("description")), F.when(k % 4 != 0, F.lit("x")), F.when(k % 6 != 0, F.lit("EUR")), F.lit(0.95), (k % 2).cast("double"),
    )
    return p.select("document_id", F.array_join(issues, "|").alias("issues"))


def safe_decimals(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    k, a = F.col("document_id"), F.col("amount").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("EUR "), F.translate(a, ".", ","))).when(k % 4 == 1, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".25"))).when(k % 4 == 2, F.concat((k % 90 + 1).cast("string"), F.lit(".123,50 €"))).otherwise(F.lit("n/a"))
    return p.select("document_id", safe_decimal(text).cast("double").alias("value"))


def _items(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "line_item")
    total = i.groupBy("group_id").agg(F.sum("amount").alias("s"), F.max("position").alias("n"))
    # totals that are met, nearly met and missed
    total = total.select("group_id", (F.col("s") + F.when(F.col("group_id") % 3 == 0, 0).when(F.col("group_id") % 3 == 1, F.lit("0.50").cast("decimal(3,2)")).otherwise(5)).cast("decimal(18,2)").alias("total"))
    return i.withColumnRenamed("item_order", "order").join(total, "group_id")


def splits_build(spark, sf_dir):
    return S.build_splits(_items(spark, sf_dir)).select("group_id", "order", F.col("split_amount").cast("double").alias("split_amount"), "status")


def split_reject(spark, sf_dir):
    return S.build_splits(_items(spark, sf_dir)).where("status <> 'ok'").select("group_id").distinct()


def split_fold(spark, sf_dir):
    return S.fold_splits(S.build_splits(_items(spark, sf_dir))).withColumn("amount", F.col("amount").cast("double"))


def split_check(spark, sf_dir):
    return S.split_errors(S.build_splits(_items(spark, sf_dir))).withColumn("split_sum", F.col("split_sum").cast("double"))


def split_keys(spark, sf_dir):
    i = _items(spark, sf_dir)
    return i.select("group_id", S.stable_key(F.col("position"), F.col("order"), F.col("description"), F.col("amount")).alias("key"), S.split_external_id(F.col("group_id").cast("string"), F.col("order")).alias("split_id"))


def weighted_category(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "line_item")  # without totals, which it has no use for: they sort all lines a second time
    return S.weighted_category(i.withColumnRenamed("item_order", "order"))


def split_categories(spark, sf_dir):
    return S.split_categories(_items(spark, sf_dir))


def cache_upsert(spark, sf_dir):
    """Ledger rows replaced by a newer fetch that lacks some, changes some and adds some."""
    t, = spark_views(spark, sf_dir, "ledger")
    old = t.where("ledger_id % 10 <> 3").select("ledger_id", "amount", "match_status", "user_id")
    new = t.where("ledger_id % 10 in (3, 4)").select("ledger_id", (F.col("amount") + 1).cast("decimal(18,2)").alias("amount"), F.lit("UNMATCHED").alias("match_status"), F.when(F.col("ledger_id") % 3 == 0, F.lit(None)).otherwise(F.lit(99)).cast("bigint").alias("user_id"))
    return Y.upsert(old, new, ["ledger_id"], ["amount"], keep=["match_status"], fill=["user_id"]).withColumn("amount", F.col("amount").cast("double"))


def soft_delete_missing(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    out = Y.soft_delete(t.select("ledger_id", "date", "deleted_at"), t.where("ledger_id % 6 <> 1").select("ledger_id"), "ledger_id", F.lit("2002-01-01").cast("date"), F.col("date") >= F.lit("1998-01-01").cast("date"))
    return out.select("ledger_id", "deleted_at")


def resolve_refs(spark, sf_dir):
    c, n = spark_views(spark, sf_dir, "customer", "nation")
    names = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.lower("n_name").alias("account"))
    return Y.resolve(rows, names, "account").select("c_custkey", "account", "account_id")


def missing_refs(spark, sf_dir):
    c, n = spark_views(spark, sf_dir, "customer", "nation")
    names = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("account"))
    return Y.missing_names(rows, names, "account")


def import_preview(spark, sf_dir):
    c, = spark_views(spark, sf_dir, "customer")
    mark = c.select("c_custkey", F.lit("account").alias("entity_type"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("name"), I.fingerprint("category", F.col("c_name")).alias("fingerprint"))
    return Y.import_preview(mark, mark.where("c_custkey % 4 = 0")).select("c_custkey", "action")


QUERIES = {f.__name__: f for f in (
    external_id_v2, external_id_legacy, parse_external_id, link_markers, fingerprints, review_state, strategy_adjust, overall_confidence, txn_type, validation_issues, safe_decimals,
    splits_build, split_reject, split_fold, split_check, split_keys, weighted_category, split_categories, cache_upsert, soft_delete_missing, resolve_refs, missing_refs, import_preview,
)}

_HASH = "sha256(concat_ws('|', CAST(amount AS VARCHAR), CAST(date AS VARCHAR), source_account, vendor, description))"
_ITEMS = duckdb_views("line_item") + """, items AS (SELECT *, item_order AS "order", CAST(sum(amount) OVER (PARTITION BY group_id) + CASE group_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.50 ELSE 5 END AS DECIMAL(18,2)) AS total FROM line_item),
  g AS (SELECT *, total - sum(amount) OVER (PARTITION BY group_id) AS gap, row_number() OVER (PARTITION BY group_id ORDER BY "order" DESC) AS back FROM items WHERE amount > 0),
  splits AS (SELECT group_id, "order", CAST(CASE WHEN back = 1 AND abs(gap) <= 1 THEN amount + gap ELSE amount END AS DECIMAL(18,2)) AS split_amount, description, category,
    CASE WHEN abs(gap) <= 1 THEN 'ok' ELSE 'irreconcilable' END AS status FROM g)
"""
_J = lambda kind, value: f"""concat('{{"type": "', {kind}, '", "value": "', {value}, '"}}')"""
ORACLE_SQL = {
    "external_id_v2": duckdb_views("proposal") + f"SELECT document_id, concat(substr({_HASH}, 1, 16), ':pl:', document_id) AS external_id, substr({_HASH}, 1, 16) AS unlinked_id FROM proposal",
    "external_id_legacy": duckdb_views("proposal") + "SELECT document_id, concat_ws(':', 'archive', document_id, substr(sha256(CAST(document_id AS VARCHAR)), 1, 16), amount, date) AS external_id FROM proposal",
    "parse_external_id": duckdb_views("ledger") + """SELECT ledger_id, ledger_id AS document_id, '0123456789abcdef' AS hash, CASE WHEN external_id LIKE 'archive:%' THEN 10::DOUBLE END AS amount,
      CASE WHEN external_id LIKE 'archive:%' THEN '2024-01-01' END AS date, true AS is_own FROM ledger WHERE external_id IS NOT NULL""",
    "link_markers": duckdb_views("ledger") + """SELECT ledger_id, external_id IS NOT NULL OR internal_reference IS NOT NULL OR notes IS NOT NULL AS linked,
      CASE WHEN external_id IS NOT NULL OR internal_reference IS NOT NULL OR notes IS NOT NULL THEN ledger_id END AS document_id, concat('ARCHIVE:', ledger_id) AS reference, concat('Archive doc_id=', ledger_id) AS marker FROM ledger""",
    "fingerprints": f"""WITH c AS (SELECT *, lower(c_name) AS n, lower(c_mktsegment) AS m, CAST(c_acctbal AS DECIMAL(18,2)) AS b FROM customer)
      SELECT c_custkey, sha256(concat('category:', n)) AS category, sha256(concat('tag:', m)) AS tag, sha256(concat('account:', m, ':', n, ':EUR')) AS account, sha256(concat('piggy:', n, ':', b)) AS piggy,
      sha256(concat('budget:', n)) AS budget, sha256(concat('rule_group:', n)) AS rule_group, sha256(concat('currency:', upper(substr(c_name, 1, 3)))) AS currency, sha256(concat('bill:', n, ':', b, ':0.00')) AS bill,
      sha256(concat('recurrence:', n, ':2024-01-31:weekly')) AS recurrence,
      sha256(concat('rule:', n, ':', substr(sha256(concat('[', {_J("'a'", "c_mktsegment")}, ', ', {_J("'z'", "c_name")}, ']')), 1, 8), ':', substr(sha256('[]'), 1, 8))) AS rule FROM c""",
    "review_state": duckdb_views("extraction") + """SELECT id, CASE WHEN overall >= 0.85 THEN 'AUTO' WHEN overall >= 0.6 THEN 'REVIEW' ELSE 'MANUAL' END AS state,
      CASE WHEN overall >= 0.85 AND (id % 10 + 1) / 10.0 >= 0.7 AND overall >= 0.6 THEN 'AUTO' WHEN overall >= 0.6 THEN 'REVIEW' ELSE 'MANUAL' END AS strict_state FROM extraction""",
    "strategy_adjust": duckdb_views("extraction") + """, s AS (SELECT id, overall, ['factur_x', 'pdf_text', 'ocr_heuristic', 'fallback', 'none', 'other'][document_id % 6 + 1] AS strategy FROM extraction)
      SELECT id, strategy, round(least(1.0::DOUBLE, overall * (CASE strategy WHEN 'factur_x' THEN 0.95 WHEN 'pdf_text' THEN 0.75 WHEN 'ocr_heuristic' THEN 0.5 WHEN 'fallback' THEN 0.2 WHEN 'none' THEN 0.1 ELSE 0.3 END::DOUBLE / 0.5::DOUBLE)), 9) AS adjusted FROM s""",
    "overall_confidence": duckdb_views("extraction") + """SELECT id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (document_id % 11) / 11.0::DOUBLE * 0.4::DOUBLE + (document_id % 7) / 7.0::DOUBLE * 0.3::DOUBLE + (document_id % 5) / 5.0::DOUBLE * 0.2::DOUBLE
      + ((document_id % 3) / 3.0::DOUBLE + (document_id % 2) / 2.0::DOUBLE + (document_id % 13) / 13.0::DOUBLE) / 3.0::DOUBLE * 0.1::DOUBLE)), 9) AS overall FROM extraction""",
    "txn_type": duckdb_views("proposal") + "SELECT document_id, CASE document_id % 4 WHEN 0 THEN 'withdrawal' WHEN 1 THEN 'deposit' WHEN 3 THEN 'deposit' ELSE CASE WHEN document_id % 3 = 0 THEN 'deposit' ELSE 'withdrawal' END END AS type FROM proposal",
    "validation_issues": duckdb_views("proposal") + """SELECT document_id, concat_ws('|', CASE WHEN document_id % 5 = 0 OR amount <= 0 THEN 'Amount is missing or invalid' END,
      CASE document_id % 7 WHEN 0 THEN 'Date is missing' WHEN 1 THEN 'Date format invalid: 2024-13-01' END, CASE WHEN document_id % 3 = 0 THEN 'Description is missing' END, CASE WHEN document_id % 4 = 0 THEN 'external_id is missing' END,
      CASE WHEN document_id % 5 <> 0 AND amount > 100000 THEN concat('Amount unusually large: ', amount) END, CASE WHEN document_id % 6 = 0 THEN 'Currency is missing' END,
      CASE WHEN document_id % 2 = 0 THEN 'Overall confidence inconsistent with amount confidence' END) AS issues FROM proposal""",
    "safe_decimals": duckdb_views("proposal") + """SELECT document_id, CAST(CASE document_id % 4 WHEN 0 THEN amount WHEN 1 THEN CAST(1000 + document_id % 1000 + 0.25 AS DECIMAL(18,2))
      WHEN 2 THEN CAST((document_id % 90 + 1) * 1000 + 123.50 AS DECIMAL(18,2)) END AS DOUBLE) AS value FROM proposal""",
    "splits_build": _ITEMS + 'SELECT group_id, "order", CAST(split_amount AS DOUBLE) AS split_amount, status FROM splits',
    "split_reject": _ITEMS + "SELECT DISTINCT group_id FROM splits WHERE status <> 'ok'",
    "split_fold": _ITEMS + """SELECT group_id, CAST(sum(split_amount) AS DOUBLE) AS amount, arg_min(description, "order") AS description, count(*) AS parts,
      CASE WHEN count(*) > 1 THEN concat('[Split: ', count(*), ' parts]') ELSE '' END AS note FROM splits GROUP BY group_id""",
    "split_check": _ITEMS + "SELECT group_id, CAST(sum(split_amount) AS DOUBLE) AS split_sum, count(*) FILTER (split_amount <= 0) AS non_positive, count(*) FILTER (trim(description) = '') AS no_description FROM splits GROUP BY group_id",
    "split_keys": _ITEMS + """SELECT group_id, concat_ws(':', position, description, amount) AS key, concat(group_id, ':', "order") AS split_id FROM items""",
    "weighted_category": _ITEMS + """, c AS (SELECT group_id, category, sum(amount) AS s, min("order") AS f FROM items WHERE amount > 0 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY s DESC, f) AS k FROM c) SELECT group_id, category FROM r WHERE k = 1""",
    "split_categories": _ITEMS + "SELECT group_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM items GROUP BY group_id",
    "cache_upsert": duckdb_views("ledger") + """SELECT ledger_id, CAST(CASE WHEN ledger_id % 10 IN (3, 4) THEN amount + 1 ELSE amount END AS DOUBLE) AS amount, CASE WHEN ledger_id % 10 = 3 THEN 'UNMATCHED' ELSE match_status END AS match_status,
      CASE WHEN ledger_id % 10 IN (3, 4) AND ledger_id % 3 <> 0 THEN 99 WHEN ledger_id % 10 = 3 THEN NULL ELSE user_id END AS user_id, CASE ledger_id % 10 WHEN 3 THEN 'created' WHEN 4 THEN 'updated' ELSE 'kept' END AS change FROM ledger""",
    "soft_delete_missing": duckdb_views("ledger") + "SELECT ledger_id, CASE WHEN ledger_id % 6 <> 1 THEN NULL WHEN date >= DATE '1998-01-01' THEN coalesce(deleted_at, DATE '2002-01-01') ELSE deleted_at END AS deleted_at FROM ledger",
    "resolve_refs": "SELECT c_custkey, lower(n_name) AS account, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS BIGINT) END AS account_id FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "missing_refs": "SELECT DISTINCT lower(n_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 <> 0",
    "import_preview": "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'error' WHEN c_custkey % 4 = 0 THEN 'skip' ELSE 'create' END AS action FROM customer",
}
