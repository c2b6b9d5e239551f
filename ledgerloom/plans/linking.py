"""Queries over proposals and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..sources.views import duckdb_views, spark_views


def match_signals(spark, sf_dir):
    """Signals of every document with the transaction of the same number."""
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    out = M.scored(M.prepared(docs).join(M.prepared_ledger(ledger), F.col("document_id") == F.col("tx_ledger_id")))
    return out.select("document_id", "amount_score", "date_score", "description_score", "vendor_score", "is_exact", "total", F.array_join("reasons", ",").alias("reasons"))


def score_candidate(spark, sf_dir):
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    pairs = M.prepared(docs).join(M.prepared_ledger(ledger), F.col("document_id") == F.col("tx_ledger_id"))
    return M.scored(pairs, override=False).select("document_id", "total")


def _live(ledger):
    return ledger.where("match_status = 'UNMATCHED' and deleted_at is null")


def _top(spark, sf_dir):
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    return M.top_matches(docs, _live(ledger), details=False)


def match_topk(spark, sf_dir):
    return _top(spark, sf_dir).select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "total", "is_exact", "rank")


def match_by_owner(spark, sf_dir):
    """All owners at once: each document with its owner's transactions and nobody's."""
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    found = M.top_matches(docs, _live(ledger), owner="user_id", details=False)
    return found.select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "total", "is_exact", "rank")


def reverse_by_owner(spark, sf_dir):
    """The reverse view of every owner's transactions."""
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    return M.reverse_matches(_live(ledger), docs, owner="user_id").select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "score", "rank")


def match_exact(spark, sf_dir):
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    return M.exact_matches(docs, ledger.where("deleted_at is null")).select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "total")


def match_reverse(spark, sf_dir):
    docs, ledger = spark_views(spark, sf_dir, "proposal", "ledger")
    return M.reverse_matches(_live(ledger), docs).select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "score", "rank")


def auto_link_unambiguous(spark, sf_dir):
    """Links at 0.75 over a ledger of bank rows, where some documents came in twice and are ambiguous."""
    docs, bank = spark_views(spark, sf_dir, "paper", "bank")
    found = M.top_matches(docs, bank, floor=750_000, details=False)
    proposals = found.select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "total", F.lit("PENDING").alias("status"))
    return M.unambiguous(proposals, 750_000).select("document_id", "ledger_id", "total")


def proposals_new(spark, sf_dir):
    """Matches of documents without a link, less pairs that were proposed before."""
    ledger, = spark_views(spark, sf_dir, "ledger")
    linked = ledger.where("match_status = 'MATCHED'").select(F.col("ledger_id").alias("document_id"))
    known = ledger.where("ledger_id % 8 = 1").select(F.col("ledger_id"), F.col("ledger_id").alias("document_id"))
    found = _top(spark, sf_dir).select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "total")
    return found.join(linked, "document_id", "left_anti").join(known, ["document_id", "ledger_id"], "left_anti")


QUERIES = {f.__name__: f for f in (match_topk, match_by_owner, reverse_by_owner, match_signals, score_candidate, match_exact, match_reverse, auto_link_unambiguous, proposals_new)}

_AMOUNT = """CASE WHEN amount = tx_amount THEN 1000 WHEN tx_amount = 0 THEN 0 WHEN abs(amount - tx_amount) * 100 <= abs(tx_amount) THEN 950
  WHEN abs(amount - tx_amount) * 100 <= abs(tx_amount) * 5 THEN 700 WHEN abs(amount - tx_amount) * 100 <= abs(tx_amount) * 10 THEN 400
  WHEN abs(amount - tx_amount) * 100 <= abs(tx_amount) * 20 THEN 200 ELSE 0 END"""
_DATE = """CASE WHEN days = 0 THEN 1000 WHEN days <= 7 THEN greatest(1000 - 125 * days, 300) WHEN days <= 14 THEN 200 WHEN days <= 30 THEN 100 ELSE 0 END"""
_DESC = """CASE WHEN description = tx_description THEN 1000 WHEN contains(description, tx_description) OR contains(tx_description, description) THEN 800
  WHEN len(list_intersect(a, b)) * 10 > len(list_distinct(list_concat(a, b))) * 3 THEN CAST(round(len(list_intersect(a, b)) * 1000.0::DOUBLE / len(list_distinct(list_concat(a, b)))) AS INT) ELSE 0 END"""
_VENDOR = """CASE WHEN vendor = tx_vendor THEN 1000 WHEN contains(vendor, tx_vendor) OR contains(tx_vendor, vendor) THEN 850
  WHEN split_part(vendor, ' ', 1) = split_part(tx_vendor, ' ', 1) THEN 600 ELSE 0 END"""
_ACCOUNT = """coalesce(contains(vendor, tx_source) OR contains(tx_source, vendor), false) OR coalesce(contains(vendor, tx_dest) OR contains(tx_dest, vendor), false) OR coalesce(source_account = tx_source, false)"""
_TX = """tx AS (SELECT ledger_id, amount AS tx_amount, date AS tx_date, description AS tx_description, source_account AS tx_source,
  destination_account AS tx_dest, coalesce(destination_account, source_account) AS tx_vendor, match_status, deleted_at{more} FROM {ledger})"""


def _scored(pairs: str, docs: str = "proposal") -> str:
    """All pairs, scored; texts are compared once for each two distinct ones."""
    return f"""dp AS (SELECT description, tx_description, {_DESC} AS ds FROM (SELECT DISTINCT description, string_split(description, ' ') AS a FROM {docs}), (SELECT DISTINCT tx_description, string_split(tx_description, ' ') AS b FROM tx)),
    vp AS (SELECT vendor, tx_vendor, {_VENDOR} AS vs FROM (SELECT DISTINCT vendor FROM {docs}), (SELECT DISTINCT tx_vendor FROM tx)),
    p AS (SELECT *, abs(date_diff('day', date, tx_date)) AS days FROM ({pairs})),
    s AS (SELECT p.*, {_AMOUNT} AS amount_score, {_DATE} AS date_score, coalesce(ds, 0) AS description_score, coalesce(vs, 0) AS vendor_score,
      CASE WHEN amount = tx_amount AND days = 0 THEN {_ACCOUNT} ELSE false END AS is_exact FROM p LEFT JOIN dp USING (description, tx_description) LEFT JOIN vp USING (vendor, tx_vendor)),
    w AS (SELECT *, amount_score * 400 + date_score * 250 + description_score * 200 + vendor_score * 150 AS weighted FROM s),
    t AS (SELECT *, CASE WHEN is_exact THEN greatest(weighted, 990000) ELSE weighted END AS total FROM w)"""


def all_pairs(live: str, docs: str = "true") -> str:
    """Scores of every document with every transaction, as t."""
    return duckdb_views("proposal", "ledger") + f", {_TX.format(ledger='ledger', more=', user_id AS tx_user')}, " + _scored(f"SELECT * FROM proposal, tx WHERE ({live}) AND ({docs})")


_SAME = duckdb_views("proposal", "ledger") + f", {_TX.format(ledger='ledger', more=', user_id AS tx_user')}, " + _scored("SELECT * FROM proposal JOIN tx ON document_id = ledger_id")
# Below a total of 0.75 nothing counts here. Texts give 0.35 at most, so amounts and days must give 0.40, and an amount must be within 10
# percent: it lies in the bucket of 100 of the other's or, counted by logarithm in steps of 10.6 percent, in the next.
_PAPER = duckdb_views("paper", "bank") + f""", {_TX.format(ledger='bank', more='')},
    near AS (SELECT paper.* EXCLUDE (bucket), tx.* EXCLUDE (bucket) FROM (SELECT *, unnest([-1, 0, 1]) + CAST(floor(ln(amount) / 0.1065) AS BIGINT) AS bucket FROM paper WHERE amount > 0) paper
      JOIN (SELECT *, CAST(floor(ln(tx_amount) / 0.1065) AS BIGINT) AS bucket FROM tx WHERE tx_amount > 0) tx USING (bucket) WHERE abs(amount - tx_amount) * 100 <= abs(tx_amount) * 10), """ + _scored("SELECT * FROM near", "paper")
#: What a document sees: its owner's transactions and nobody's.
OWNED = "(tx_user = user_id OR tx_user IS NULL)"
LIVE = "match_status = 'UNMATCHED' AND deleted_at IS NULL"
RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY total DESC, tx_date DESC NULLS LAST, ledger_id) AS rank FROM t WHERE total >= 200000), best AS (SELECT * FROM ranked WHERE rank <= 5)"


def _reverse(owned: str) -> str:
    return duckdb_views("proposal", "ledger") + f""", {_TX.format(ledger='ledger', more=', user_id AS tx_user')}, p AS (SELECT document_id, ledger_id, amount, tx_amount, abs(date_diff('day', date, tx_date)) AS days FROM proposal, tx WHERE {LIVE} AND {owned}), r AS (SELECT document_id, ledger_id,
      CASE WHEN amount = tx_amount THEN 600 WHEN abs(amount - tx_amount) * 100 < abs(tx_amount) THEN 570 WHEN abs(amount - tx_amount) * 100 < abs(tx_amount) * 5 THEN 480
           WHEN abs(amount - tx_amount) * 100 < abs(tx_amount) * 10 THEN 360 WHEN abs(amount - tx_amount) * 100 < abs(tx_amount) * 20 THEN 240 ELSE 0 END
      + CASE WHEN days = 0 THEN 400 WHEN days <= 3 THEN 360 WHEN days <= 7 THEN 280 WHEN days <= 14 THEN 200 WHEN days <= 30 THEN 120 ELSE 0 END AS score FROM p),
      n AS (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY score DESC, document_id) AS rank FROM r WHERE score >= 200)
      SELECT document_id, ledger_id, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM n WHERE rank <= 5"""


ORACLE_SQL = {
    "match_signals": _SAME + """SELECT document_id, amount_score, CAST(date_score AS INT) AS date_score, description_score, vendor_score, is_exact, CAST(total AS INT) AS total,
      concat_ws(',', CASE WHEN is_exact THEN 'EXACT_MATCH' END, CASE WHEN amount_score > 500 THEN 'amount' END, CASE WHEN date_score > 500 THEN 'date' END,
      CASE WHEN description_score > 500 THEN 'description' END, CASE WHEN vendor_score > 500 THEN 'vendor' END) AS reasons FROM t""",
    "score_candidate": _SAME + "SELECT document_id, CAST(weighted AS INT) AS total FROM t",
    "match_topk": all_pairs(LIVE) + RANKED + " SELECT document_id, ledger_id, CAST(total AS INT) AS total, is_exact, CAST(rank AS INT) AS rank FROM best",
    "match_by_owner": all_pairs(LIVE, OWNED) + RANKED + " SELECT document_id, ledger_id, CAST(total AS INT) AS total, is_exact, CAST(rank AS INT) AS rank FROM best",
    "reverse_by_owner": _reverse(OWNED),
    "match_exact": all_pairs("deleted_at IS NULL") + " SELECT document_id, ledger_id, CAST(total AS INT) AS total FROM t WHERE is_exact",
    "match_reverse": _reverse("true"),
    "auto_link_unambiguous": _PAPER + RANKED.replace("200000", "750000") + """, c AS (SELECT *, count(*) OVER (PARTITION BY ledger_id) AS strong FROM best)
      SELECT document_id, ledger_id, CAST(total AS INT) AS total FROM c WHERE strong = 1""",
    "proposals_new": all_pairs(LIVE) + RANKED + """ SELECT document_id, ledger_id, CAST(total AS INT) AS total FROM best
      WHERE document_id NOT IN (SELECT ledger_id FROM ledger WHERE match_status = 'MATCHED') AND NOT (document_id = ledger_id AND ledger_id % 8 = 1)""",
}
