"""Queries of sources and sinks, catalogs, assembled extractions, split payloads, caches and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii, text
from ..operators import assembly as X
from ..operators import entities as E
from ..operators import metrics as A
from ..operators import payloads as P
from ..operators import queues as Q
from ..operators import reconcile as R
from ..operators import splits as S
from ..operators import suggestions as G
from ..operators import sync as Y
from ..session import spread
from ..sources import tables as T
from ..sources.views import duckdb_views, spark_views
from .ledgering import _accepted
from .linking import LIVE, RANKED, _TX, _scored

NOW = "2024-02-01"


def _str(c):
    return F.col(c).cast("string")


# --- sources and sinks ---


def documents_listed(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    k = F.col("document_id")
    inbox = p.select(k.alias("id"), F.array_compact(F.array(F.col("source_account"), F.when(k % 2 == 0, "scan"))).alias("tags"), F.when(k % 3 != 0, "Invoice").otherwise("Receipt").alias("document_type"),
                     F.col("vendor").alias("correspondent"), F.col("description").alias("title"), F.lit("").alias("content"), F.col("date").cast("timestamp").alias("added"))
    return T.documents(inbox, tags=["building", "scan"], kind="INVOICE", query="Urgent", after="1994-01-01 00:00:00", before="1997-06-01 00:00:00").select("id")


def documents_named(spark, sf_dir):
    o, c, n, r = spark_views(spark, sf_dir, "orders", "customer", "nation", "region")
    k = F.col("o_orderkey")
    docs = o.select(k.alias("id"), F.col("o_custkey").alias("correspondent_id"), (k % 30).alias("document_type_id"), F.array(k % 7, k % 3).alias("tag_ids"))
    names = lambda df, p: df.select(F.col(f"{p}key").cast("long").alias("id"), F.col(p.replace("nation", "name").replace("region", "name").replace("cust", "name")).alias("name"))
    out = T.with_names(docs, names(c, "c_cust"), names(n, "n_nation"), names(r, "r_region"))
    return out.select("id", "correspondent", "document_type", F.array_join("tags", ",").alias("tags"))


def file_hashes(spark, sf_dir):
    """Size and hash of one file of the test data as a file."""
    spark_views(spark, sf_dir, "region")
    return T.read_files(spark, f"{sf_dir}/region.parquet").select(F.octet_length("content").alias("bytes"), "source_hash")


def transactions_folded(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "line_item")
    o, g = F.col("item_order"), F.col("group_id")
    s = i.select("group_id", o.alias("order"), "amount", F.concat(F.lit("2024-01-"), F.lpad((o % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00")).alias("date"), "description", F.when(g % 2 == 0, " Checking ").alias("source_name"),
                 F.col("category").alias("destination_name"), F.when(g % 3 == 0, "note").alias("notes"), F.when(o % 5 != 4, F.array(F.col("category"), F.when(o % 2 == 0, "even").otherwise("odd"))).alias("tags"))
    return S.fold_transactions(s).select("group_id", F.col("amount").cast("double").alias("amount"), "parts", "date", "description", "notes", F.array_join("tags", ",").alias("tags"), "computed_id")


def splits_holding_id(spark, sf_dir):
    i, m = spark_views(spark, sf_dir, "line_item", "imports")
    s = i.withColumn("external_id", F.when(F.col("item_order") == 0, F.concat(F.lit("x"), _str("group_id"))))
    return T.holding_external_id(s, m.where("status = 'FAILED'")).select("group_id", "item_order")


def accounts_listed(spark, sf_dir):
    s, = spark_views(spark, sf_dir, "supplier")
    kinds = F.element_at(F.array(F.lit("asset"), F.lit("expense"), F.lit("revenue")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return E.accounts(s.withColumn("type", kinds), "asset").select("s_suppkey", "s_name")


def currencies_enabled(spark, sf_dir):
    n, = spark_views(spark, sf_dir, "nation")
    c = n.select(F.concat(F.lit("C"), _str("n_nationkey")).alias("code"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") % 3 == 0).alias("enabled"))
    return E.enabled(E.enable(c, n.where("n_nationkey % 5 = 0").select(F.concat(F.lit("c"), _str("n_nationkey")).alias("code")))).select("code")


def names_found(spark, sf_dir):
    c, = spark_views(spark, sf_dir, "customer")
    return T.by_name(c, "CUSTOMER#000000007", "c_name").select("c_custkey")


def entities_created(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "part")
    p = p.withColumn("label", F.concat_ws(" ", "p_type", "p_brand"))
    new = p.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("label")).when(F.col("p_partkey") % 37 != 0, F.col("label")).alias("name"), "p_size")
    return E.to_create(new, p.where("p_partkey % 9 = 0").select(F.lower("label").alias("name")))


def sink_rows(spark, sf_dir):
    p, m = spark_views(spark, sf_dir, "proposal", "imports")
    rows = p.select(F.concat(F.lit("x"), _str("document_id")).alias("external_id"))
    return T.to_create(rows.union(rows), m.where("status = 'IMPORTED'"))


def ledger_updates(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    k = F.col("ledger_id")
    each = lambda seq, note, id_: t.where(k % 3 == 0).select("ledger_id", F.lit(seq).alias("seq"), note.alias("note"), id_.alias("external_id"))
    changes = each(3, F.when(k % 2 == 0, "checked"), F.lit("late")).unionByName(each(1, F.when(k % 2 == 0, "linked"), F.when(k % 9 == 0, F.concat(F.lit("n"), _str("ledger_id"))))).unionByName(
        each(2, F.lit("linked"), F.concat(F.lit("m"), _str("ledger_id"))))
    return T.updated(t, changes).select("ledger_id", "notes", "external_id")


# --- extractions ---


def _read(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    p = spread(p)
    k = F.col("document_id")
    d = "decimal(18,4)"
    line = F.struct(F.lit("line").alias("description"), F.lit(2).cast(d).alias("quantity"), F.lit(0).cast(d).alias("unit_price"), F.col("amount").cast(d).alias("total"), F.lit(None).cast(d).alias("tax_rate"))
    return p.select(
        "document_id", F.sha2(k.cast("string"), 256).alias("source_hash"), F.when(k % 4 != 0, F.concat(F.lit("scan "), k.cast("string"))).alias("title"), F.lit("text").alias("text"),
        F.when(k % 3 == 0, "Gutschrift").otherwise("Rechnung").alias("document_type"), "vendor", F.lit("Corr").alias("correspondent"), F.array(F.lit("t")).alias("tags"),
        F.when(k % 7 != 0, F.col("amount")).alias("amount"), F.when(k % 5 != 0, F.col("date")).alias("date"), F.when(k % 6 == 0, "USD").alias("currency"), F.when(k % 8 < 4, F.col("description")).alias("description"),
        F.when(k % 9 == 0, F.concat(F.lit("INV-"), k.cast("string"))).alias("invoice_number"), F.when(k % 2 == 0, 0).otherwise(F.col("amount")).cast(d).alias("total_net"), F.lit(None).cast(d).alias("tax_amount"), F.lit(19).cast(d).alias("tax_rate"),
        F.when(k % 10 == 0, F.array(line, line)).alias("lines"), *[(k % 11 * 10).cast("int").alias(f"{s}_score") for s in ("amount", "date", "vendor")], *[F.lit(50).alias(f"{s}_score") for s in ("currency", "description", "invoice_number")],
        F.lit(None).cast("int").alias("line_items_score"), F.when(k % 10 == 0, "einvoice").otherwise("ocr").alias("strategy"),
    ).withColumn("vendor", F.when(k % 13 != 0, F.col("vendor")))


def extraction_assembled(spark, sf_dir):
    x = X.assembled(_read(spark, sf_dir), F.lit("2024-01-15"))
    p = F.col("proposal")
    return x.select("document_id", p["transaction_type"].alias("type"), p["date"].alias("date"), p["amount"].cast("double").alias("amount"), p["currency"].alias("currency"), p["description"].alias("description"), p["source_account"].alias("source_account"),
                    p["destination_account"].alias("destination_account"), p["notes"].alias("notes"), p["external_id"].alias("external_id"), F.col("confidence.review_state").alias("review_state"), F.size("line_items").alias("n_lines"))


def extraction_json(spark, sf_dir):
    """Fields that come back from the stored JSON, and the stored form of an amount."""
    x = X.assembled(_read(spark, sf_dir), F.lit("2024-01-15"))
    j = x.select("document_id", X.encoded(x).alias("j")).select("document_id", "j", X.decoded(F.col("j")).alias("d"))
    return j.select("document_id", F.get_json_object("j", "$.proposal.amount").alias("stored"), F.col("d.proposal.amount").cast("double").alias("amount"), F.col("d.proposal.total_net").cast("double").alias("total_net"), F.col("d.proposal.tax_rate").cast("double").alias("tax_rate"),
                    F.get("d.line_items", F.lit(0))["total"].cast("double").alias("line_total"), F.get("d.line_items", F.lit(0))["unit_price"].cast("double").alias("unit_price"), F.get("d.proposal.tags", F.lit(0)).alias("tag"))


def ledger_texts(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    k = F.col("document_id")
    amount = F.when(k % 4 == 0, F.concat(F.lit("$"), F.format_number("amount", 2))).when(k % 4 == 1, F.concat(F.col("amount").cast("string"), F.lit(" €"))).when(k % 4 == 2, F.col("amount").cast("string")).otherwise("none")
    day = F.when(k % 3 == 0, F.concat(F.col("date").cast("string"), F.lit("T00:00:00"))).when(k % 3 == 1, F.date_format("date", "dd/MM/yyyy")).otherwise("soon")
    return p.select("document_id", text.ledger_amount(amount).cast("double").alias("amount"), text.ledger_date(day).alias("date"))


# --- runs ---


def reset_proposals(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    p = t.select(F.col("ledger_id").alias("document_id"), "ledger_id", F.when(F.col("match_status") == "PROPOSED", "PENDING").otherwise("ACCEPTED").alias("status"))
    left, _ = R.reset(p, t, t.where("ledger_id % 6 = 0").select(F.col("ledger_id").alias("document_id")))
    return left.select("document_id", "status")


def reset_ledger(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    p = t.select(F.col("ledger_id").alias("document_id"), "ledger_id", F.when(F.col("match_status") == "PROPOSED", "PENDING").otherwise("ACCEPTED").alias("status"))
    _, after = R.reset(p, t, t.where("ledger_id % 6 = 0").select(F.col("ledger_id").alias("document_id")))
    return after.select("ledger_id", "match_status")


def reconcile_counts(spark, sf_dir):
    """Counters of a whole run that merges fetched rows into the ledger before it matches."""
    p, t = spark_views(spark, sf_dir, "proposal", "ledger")
    ledger = t.withColumn("document_id", F.when(F.col("match_status") == "MATCHED", F.col("ledger_id")))
    none = ledger.where("false").select("document_id", "ledger_id", F.lit(0).alias("total"))
    fetched = t.where("ledger_id % 3 = 0").withColumn("description", F.lit("synced payment"))
    return R.reconcile(ledger, fetched, p, none, none, threshold=700_000).counters


def manual_payloads(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    k = F.col("document_id")
    df = _accepted(spark, sf_dir).withColumn("notes", F.when(k % 6 == 0, "seen"))
    asked = t.where("ledger_id % 3 = 0").select(F.when(F.col("ledger_id") % 27 == 0, -F.col("ledger_id") - 1).otherwise(F.col("ledger_id")).alias("document_id"), (F.col("ledger_id") % 2 == 0).alias("is_cash"), F.when(F.col("ledger_id") % 9 == 0, "kiosk").alias("remark"))
    links = t.where("match_status = 'MATCHED'").select(F.col("ledger_id").alias("document_id"), "ledger_id")
    return P.manual(df, asked, links).select("document_id", "error", "notes")


# --- entities and caches ---


def _entities(spark, sf_dir):
    c, = spark_views(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("tag", "account", "currency", "rule", "transaction", "planet")]), (k % 6 + 1).cast("int"))
    data = F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('", "title": null, "date": "2024-01-02T00:00:00", "amount": "'), k.cast("string"), F.lit('.50", "code": "C'), k.cast("string"), F.lit('", "order": '), k.cast("string"), F.lit(', "extra": [1, 2]}'))
    return c.select("c_custkey", kind.alias("kind"), data.alias("data"))


def entity_names(spark, sf_dir):
    return _entities(spark, sf_dir).select("c_custkey", E.display_name(F.col("kind"), F.col("data")).alias("name"))


def entity_fields(spark, sf_dir):
    m = E.normalised(F.col("kind"), F.col("data"))
    return _entities(spark, sf_dir).select("c_custkey", F.array_join(F.map_keys(m), ",").alias("fields"), F.try_element_at(m, F.lit("order")).alias("order"), F.try_element_at(m, F.lit("currency_code")).alias("currency_code"))


def pool_changes(spark, sf_dir):
    c, = spark_views(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    base = c.select((k % 7).alias("owner"), F.lit("category").alias("entity_type"), F.sha2("c_name", 256).alias("fingerprint"), F.col("c_name").alias("name"), F.lit("{}").alias("data"), k.alias("k"))
    new = base.where("k % 2 = 0").withColumn("name", F.upper("name")).drop("k")
    return E.pool(base.where("k % 3 > 0").drop("k"), new.union(new)).groupBy("change").agg(F.count("*").alias("n"), F.max("name").alias("last_name"))


def _cache(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    k = F.col("job_id")
    return j, j.where(k % 2 == 0).select(_str("job_id").alias("cache_key"), F.lit("m").alias("model"), F.lit("p").alias("prompt_version"), F.lit("t").alias("taxonomy_version"), F.lit("old").alias("response_json"),
                                         F.col("created_at"), (F.col("created_at") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"), (k % 5 + 1).cast("int").alias("hit_count"))


def llm_cache_after(spark, sf_dir):
    """The cache after answers are stored, keys asked for, and what expired is purged."""
    j, cache = _cache(spark, sf_dir)
    new = j.where("job_id % 3 = 0").select(_str("job_id").alias("cache_key"), F.lit("m").alias("model"), F.lit("p").alias("prompt_version"), F.lit("t").alias("taxonomy_version"), F.lit("new").alias("response_json"))
    now = F.lit(NOW).cast("timestamp")
    asked = j.where("job_id % 4 = 0").select(_str("job_id").alias("cache_key"))
    _, cache = Y.cache_get(Y.cache_put(cache, new, now), asked.union(asked), now)
    return Y.cache_purge(cache, now).select("cache_key", "response_json", F.col("hit_count").cast("long").alias("hit_count"))


def llm_cache_found(spark, sf_dir):
    j, cache = _cache(spark, sf_dir)
    return Y.cache_get(cache, j.where("job_id % 3 = 0").select(_str("job_id").alias("cache_key")), F.lit(NOW).cast("timestamp"))[0]


# --- splits ---


def _split_inputs(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "line_item")
    k = F.col("document_id")
    items = i.select(F.col("group_id").alias("document_id"), F.col("item_order").alias("order"), F.when(F.col("position") % 4 != 0, F.col("description")).alias("description"), F.when(F.col("item_order") % 6 == 5, 0).when(F.col("item_order") % 3 != 1, F.col("amount")).cast("decimal(18,4)").alias("total"),
                     F.when(F.col("item_order") % 6 != 5, F.col("amount")).cast("decimal(18,4)").alias("unit_price"), "category")
    sums = i.where("item_order % 6 <> 5").groupBy(F.col("group_id").alias("document_id")).agg(F.sum("amount").alias("s"))
    docs = _accepted(spark, sf_dir).join(sums, "document_id", "left").withColumn("amount", (F.coalesce("s", F.lit(0)) + F.when(k % 5 == 0, 3).when(k % 5 == 1, F.lit(-0.07)).otherwise(0)).cast("decimal(18,2)")).drop("s")
    return docs, items


def split_payloads(spark, sf_dir):
    out = P.split_payloads(*_split_inputs(spark, sf_dir)).where("error is null")
    return out.select("document_id", "order", F.col("amount").cast("double").alias("amount"), "description", "source_name", "destination_name", "category_name", F.array_join("tags", ",").alias("tags"), "internal_reference", "external_id")


def split_payload_rejects(spark, sf_dir):
    return P.split_payloads(*_split_inputs(spark, sf_dir)).where("error is not null").select("document_id", "error")


def split_payload_ids(spark, sf_dir):
    out = P.split_payloads(*_split_inputs(spark, sf_dir), canonical=True)
    return out.where("external_id is not null").select("document_id", "external_id", F.regexp_extract("notes", "splits=([0-9]+)", 1).alias("n"))


def split_problems(spark, sf_dir):
    i, o = spark_views(spark, sf_dir, "line_item", "orders")
    s = i.where("group_id % 4 > 0").select("group_id", F.when(F.col("position") == 2, 0).otherwise(F.col("amount")).cast("decimal(18,2)").alias("split_amount"), F.when(F.col("position") % 3 != 0, F.col("description")).otherwise(" ").alias("description"))
    totals = s.groupBy("group_id").agg(F.sum("split_amount").alias("s"))
    totals = o.select(F.col("o_orderkey").alias("group_id")).join(totals, "group_id", "left").select("group_id", (F.coalesce("s", F.lit(0)) + F.when(F.col("group_id") % 3 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("total"))
    return S.problems(totals, s).select("group_id", F.array_join("errors", "|").alias("errors"))


def amounts_checked(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "line_item")
    k = F.col("group_id") % 5
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("amount").cast("string"), F.lit("5 "))).when(k == 1, F.concat(F.lit("-"), F.col("amount").cast("string"))).when(k == 2, "0.004").when(k == 3, "x1").otherwise(F.col("amount").cast("string"))
    x = S.checked_amount(raw, "split amount", most=50_000)
    return i.select("group_id", "item_order", x["amount"].cast("double").alias("amount"), x["error"].alias("error"))


def edits_applied(spark, sf_dir):
    p, = spark_views(spark, sf_dir, "proposal")
    k = F.col("document_id")
    df = p.select("document_id", "amount", F.col("date").cast("string").alias("date"), "description", F.lit("old").alias("external_id"))
    edits = p.where(k % 2 == 0).select("document_id", F.when(k % 4 == 0, F.lit(5)).cast("decimal(18,2)").alias("amount"), F.when(k % 6 == 0, "2024-01-01").alias("date"), F.lit("edited").alias("description"))
    return P.edited(df, edits, lambda a, d: F.concat_ws(":", a.cast("string"), d)).select("document_id", F.col("amount").cast("double").alias("amount"), "date", "description", "external_id")


# --- lists and counters ---

_THREE = ("extraction", "linkage", "imports")


def import_queue_sides(spark, sf_dir):
    return Q.import_queue(*spark_views(spark, sf_dir, *_THREE)).select("id", "side")


def unified_page(spark, sf_dir):
    return Q.unified_page(Q.unified(*spark_views(spark, sf_dir, *_THREE))).select("id", "needs_linking")


def unified_counts(spark, sf_dir):
    return Q.unified_counts(Q.unified(*spark_views(spark, sf_dir, *_THREE)))


def review_oldest(spark, sf_dir):
    e, = spark_views(spark, sf_dir, "extraction")
    return Q.review_queue(e).limit(50).select("id", "created_at")


def runs_of_document(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return Q.runs_of(j, 7).select("job_id")


def list_stats(spark, sf_dir):
    t, = spark_views(spark, sf_dir, "ledger")
    p = t.select(F.element_at(F.array(*[F.lit(x) for x in ("PENDING", "ACCEPTED", "REJECTED", "AUTO_MATCHED")]), (F.col("ledger_id") % 4 + 1).cast("int")).alias("status"))
    return A.list_stats(p, t.where(Y.visible(3)))


def applied_version(spark, sf_dir):
    n, = spark_views(spark, sf_dir, "nation")
    return A.latest_version(n.select(F.col("n_nationkey").alias("version")))


def active_counts(spark, sf_dir):
    e, linkage, i, t = spark_views(spark, sf_dir, *_THREE, "ledger")
    return A.counts(Q.importable(e, linkage, i), ready=F.lit(True)).union(A.counts(t, cached=F.col("deleted_at").isNull()))


def calibration(spark, sf_dir):
    j, = spark_views(spark, sf_dir, "job")
    return j.groupBy("document_id").agg(F.count("*").alias("n")).select("document_id", A.calibration(F.col("n"), 12).alias("progress"))


def suggestions_kept(spark, sf_dir):
    i, = spark_views(spark, sf_dir, "line_item")
    names = [F.lit(x) for x in ("category", "transaction_type", "currency", "source_account", "existing_transaction", "note")]
    field = F.element_at(F.array(*names), (F.col("group_id") % 6 + 1).cast("int"))
    value = F.when(F.col("item_order") % 2 == 0, F.col("category")).when(F.col("item_order") % 4 == 1, "withdrawal").otherwise("create_new")
    none = F.array().cast("array<string>")
    ok = G.allowed_suggestion(field, value, F.array(F.lit("A"), F.lit("R")), F.array(F.lit("N")), none, F.array(F.lit("R")))
    return i.where(ok).select("group_id", "item_order")


def pii_gate(spark, sf_dir):
    c, = spark_views(spark, sf_dir, "conversations")
    return pii.gate(c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("text").alias("outcome"), F.lit(None).cast("string").alias("notes")), kinds=("email", "iban")).select("run_id", "is_valid", F.array_join("violations", "|").alias("violation"))


QUERIES = {f.__name__: f for f in (
    documents_listed, documents_named, file_hashes, transactions_folded, splits_holding_id, accounts_listed, currencies_enabled, names_found, entities_created, sink_rows, ledger_updates, extraction_assembled, extraction_json, ledger_texts,
    reset_proposals, reset_ledger, reconcile_counts, manual_payloads, entity_names, entity_fields, pool_changes, llm_cache_after, llm_cache_found, split_payloads, split_payload_rejects, split_payload_ids, split_problems, amounts_checked, edits_applied,
    import_queue_sides, unified_page, unified_counts, review_oldest, runs_of_document, list_stats, applied_version, active_counts, calibration, suggestions_kept, pii_gate,
)}

_READ = duckdb_views("proposal") + """, x AS (SELECT *, document_id AS k, CASE WHEN document_id % 7 <> 0 THEN amount ELSE 0 END AS a, CASE WHEN document_id % 5 <> 0 THEN CAST(date AS VARCHAR) ELSE '2024-01-15' END AS d, document_id % 11 * 10 / 100.0::DOUBLE AS s FROM proposal) """
_ITEMS = duckdb_views("proposal", "line_item") + """, sums AS (SELECT group_id, count(*) AS n, count(*) FILTER (item_order % 6 <> 5) AS kept, sum(amount) FILTER (item_order % 6 <> 5) AS s, max(item_order) FILTER (item_order % 6 <> 5) AS last FROM line_item GROUP BY group_id HAVING count(*) > 1),
  docs AS (SELECT p.*, n, kept, last, s, CASE document_id % 5 WHEN 0 THEN 3 WHEN 1 THEN -0.07 ELSE 0 END AS gap, CAST(s + CASE document_id % 5 WHEN 0 THEN 3 WHEN 1 THEN -0.07 ELSE 0 END AS DECIMAL(18,2)) AS total,
    ['withdrawal', 'deposit', 'transfer'][document_id % 3 + 1] AS type, CASE WHEN document_id % 2 = 0 THEN source_account END AS src, CASE WHEN document_id % 4 <> 0 THEN vendor END AS cor FROM proposal p JOIN sums ON document_id = group_id) """
_FLAGS = "link = 'PENDING'"
_UNIFIED = duckdb_views("extraction", "linkage", "imports") + """, u AS (SELECT e.*, coalesce(l.link_type, 'PENDING') AS link, i.status AS import_status FROM extraction e LEFT JOIN linkage l ON l.extraction_id = e.id LEFT JOIN imports i USING (external_id)) """
_IMPORTABLE = """SELECT e.id, i.status FROM extraction e JOIN linkage l ON l.extraction_id = e.id LEFT JOIN imports i USING (external_id)
  WHERE (review_state = 'AUTO' OR coalesce(review_decision IN ('ACCEPTED', 'EDITED', 'ORPHAN_CONFIRMED'), false)) AND link_type IN ('LINKED', 'ORPHAN') AND (i.status IS NULL OR i.status = 'FAILED')"""
_KEYED = "SELECT CAST(job_id AS VARCHAR) AS cache_key"

ORACLE_SQL = {
    "documents_listed": duckdb_views("proposal") + "SELECT document_id AS id FROM proposal WHERE source_account = 'building' AND document_id % 2 = 0 AND document_id % 3 <> 0 AND contains(description, 'urgent') AND date > DATE '1994-01-01' AND date < DATE '1997-06-01'",
    "documents_named": """SELECT o_orderkey AS id, c_name AS correspondent, n_name AS document_type, concat_ws(',', a.r_name, b.r_name) AS tags FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 30
      LEFT JOIN region a ON a.r_regionkey = o_orderkey % 7 LEFT JOIN region b ON b.r_regionkey = o_orderkey % 3""",
    "transactions_folded": duckdb_views("line_item") + """, tags AS (SELECT group_id, tag, min(place) AS first FROM (SELECT group_id, unnest([category, CASE WHEN item_order % 2 = 0 THEN 'even' ELSE 'odd' END]) AS tag, unnest([item_order * 2, item_order * 2 + 1]) AS place FROM line_item WHERE item_order % 5 <> 4) GROUP BY ALL),
      t AS (SELECT group_id, string_agg(tag, ',' ORDER BY first) AS tags FROM tags GROUP BY group_id),
      g AS (SELECT group_id, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, count(*) AS parts, arg_min(description, item_order) AS description, arg_min(category, item_order) AS dst FROM line_item GROUP BY group_id)
      SELECT group_id, CAST(amount AS DOUBLE) AS amount, parts, '2024-01-01T10:00:00' AS date, description, CASE WHEN parts > 1 THEN concat(CASE WHEN group_id % 3 = 0 THEN 'note ' ELSE '' END, '[Split: ', parts, ' parts]') WHEN group_id % 3 = 0 THEN 'note' END AS notes, tags,
      substr(sha256(concat_ws('|', CAST(amount AS VARCHAR), '2024-01-01', CASE WHEN group_id % 2 = 0 THEN 'checking' ELSE '' END, lower(dst), lower(description))), 1, 16) AS computed_id FROM g JOIN t USING (group_id)""",
    "splits_holding_id": duckdb_views("line_item", "imports") + "SELECT group_id, item_order FROM line_item WHERE concat('x', group_id) IN (SELECT external_id FROM imports WHERE status = 'FAILED')",
    "accounts_listed": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0",
    "currencies_enabled": "SELECT concat('C', n_nationkey) AS code FROM nation WHERE n_nationkey % 5 = 0 OR (n_nationkey % 4 <> 0 AND n_nationkey % 3 = 0)",
    "names_found": "SELECT c_custkey FROM customer WHERE lower(c_name) = 'customer#000000007'",
    "entities_created": """WITH labelled AS (SELECT *, concat(p_type, ' ', p_brand) AS label FROM part), new AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(label) WHEN p_partkey % 37 <> 0 THEN label END AS name, p_size FROM labelled), r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY name, p_size) AS n FROM new WHERE name IS NOT NULL)
      SELECT name, p_size FROM r WHERE n = 1 AND lower(name) NOT IN (SELECT lower(label) FROM labelled WHERE p_partkey % 9 = 0)""",
    "sink_rows": duckdb_views("imports") + "SELECT concat('x', o_orderkey) AS external_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE concat('x', o_orderkey) NOT IN (SELECT external_id FROM imports WHERE status = 'IMPORTED')",
    "ledger_updates": duckdb_views("ledger") + """SELECT ledger_id, CASE WHEN ledger_id % 3 = 0 THEN concat_ws(chr(10), notes, 'linked', CASE WHEN ledger_id % 2 = 0 THEN 'checked' END) ELSE notes END AS notes,
      CASE WHEN ledger_id % 3 = 0 AND external_id IS NULL THEN concat(CASE WHEN ledger_id % 9 = 0 THEN 'n' ELSE 'm' END, ledger_id) ELSE external_id END AS external_id FROM ledger""",
    "extraction_assembled": _READ + """, y AS (SELECT *, s * 0.4 + s * 0.3 + s * 0.2 + 0.5 * 0.1 AS overall FROM x) SELECT document_id, CASE WHEN k % 3 = 0 THEN 'deposit' ELSE 'withdrawal' END AS type, d AS date, CAST(a AS DOUBLE) AS amount, CASE WHEN k % 6 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
      CASE WHEN k % 8 < 4 THEN description WHEN k % 4 <> 0 THEN concat('scan ', k) ELSE concat('Document ', k) END AS description, CASE WHEN k % 3 <> 0 THEN 'Checking Account' END AS source_account, CASE WHEN k % 13 <> 0 THEN vendor ELSE 'Corr' END AS destination_account,
      concat('Extracted from document ', k, CASE WHEN k % 9 = 0 THEN concat('; Invoice: INV-', k) ELSE '' END) AS notes, concat('archive:', k, ':', substr(sha256(CAST(k AS VARCHAR)), 1, 16), ':', CAST(CAST(a AS DECIMAL(18,2)) AS VARCHAR), ':', d) AS external_id,
      CASE WHEN overall >= 0.85 THEN 'AUTO' WHEN overall >= 0.6 THEN 'REVIEW' ELSE 'MANUAL' END AS review_state, CAST(CASE WHEN k % 10 = 0 THEN 2 ELSE 0 END AS INT) AS n_lines FROM y""",
    "extraction_json": _READ + """SELECT document_id, CAST(CAST(a AS DECIMAL(18,2)) AS VARCHAR) AS stored, CAST(a AS DOUBLE) AS amount, CASE WHEN k % 2 <> 0 AND amount <> 0 THEN CAST(amount AS DOUBLE) END AS total_net, 19.0::DOUBLE AS tax_rate,
      CASE WHEN k % 10 = 0 AND amount <> 0 THEN CAST(amount AS DOUBLE) END AS line_total, CAST(NULL AS DOUBLE) AS unit_price, 't' AS tag FROM x""",
    "ledger_texts": duckdb_views("proposal") + "SELECT document_id, CASE WHEN document_id % 4 < 3 THEN CAST(amount AS DOUBLE) END AS amount, CASE WHEN document_id % 3 < 2 THEN date END AS date FROM proposal",
    "reset_proposals": duckdb_views("ledger") + "SELECT ledger_id AS document_id, CASE WHEN match_status = 'PROPOSED' THEN 'PENDING' ELSE 'ACCEPTED' END AS status FROM ledger WHERE NOT (ledger_id % 6 = 0 AND match_status = 'PROPOSED')",
    "reset_ledger": duckdb_views("ledger") + "SELECT ledger_id, CASE WHEN ledger_id % 6 = 0 AND match_status = 'PROPOSED' THEN 'UNMATCHED' ELSE match_status END AS match_status FROM ledger",
    "reconcile_counts": duckdb_views("proposal", "ledger") + f""", merged AS (SELECT * REPLACE (CASE WHEN ledger_id % 3 = 0 THEN 'synced payment' ELSE description END AS description) FROM ledger), {_TX.format(ledger='merged', more='')},
      """ + _scored(f"SELECT * FROM proposal, tx WHERE ({LIVE}) AND document_id NOT IN (SELECT ledger_id FROM ledger WHERE match_status = 'MATCHED')") + RANKED + """, c AS (SELECT *, count(*) FILTER (total >= 700000) OVER (PARTITION BY ledger_id) AS strong FROM best)
      SELECT 'transactions_synced' AS metric, count(*) AS n FROM ledger WHERE ledger_id % 3 = 0 UNION ALL SELECT 'proposals_created', count(*) FROM best UNION ALL SELECT 'auto_linked', count(*) FROM c WHERE strong = 1 AND total >= 700000""",
    "manual_payloads": duckdb_views("ledger") + """, r AS (SELECT ledger_id AS k, CASE WHEN ledger_id % 27 = 0 THEN -ledger_id - 1 ELSE ledger_id END AS document_id, CASE WHEN ledger_id % 27 = 0 THEN 'Document extraction not found' WHEN match_status = 'MATCHED' THEN concat('Document already linked to transaction ', ledger_id) END AS error FROM ledger WHERE ledger_id % 3 = 0)
      SELECT document_id, error, CASE WHEN error IS NULL THEN concat(CASE WHEN k % 6 = 0 THEN 'seen' ELSE '' END, ' MANUAL TRANSACTION - ', CASE WHEN k % 2 = 0 THEN 'Cash payment without bank booking. ' ELSE 'No matching bank transaction. ' END, CASE WHEN k % 9 = 0 THEN 'kiosk' ELSE '' END) END AS notes FROM r""",
    "entity_names": "SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN concat('C', c_custkey, ' - ', c_name) WHEN 3 THEN 'Unknown' WHEN 4 THEN concat('2024-01-02: (', c_custkey, '.50)') ELSE c_name END AS name FROM customer",
    "entity_fields": """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'tag,description' WHEN 1 THEN 'name,type,currency_code,notes,iban,account_number' WHEN 2 THEN 'code,name,symbol,decimal_places,enabled' WHEN 3 THEN 'title,rule_group_id,rule_group_title,order,active,strict,triggers,actions,description'
      WHEN 4 THEN 'type,date,amount,description,source_name,destination_name,category_name,tags,notes,external_id,internal_reference,splits' END AS fields, CASE WHEN c_custkey % 6 = 3 THEN CAST(c_custkey AS VARCHAR) END AS order, CASE WHEN c_custkey % 6 = 1 THEN 'EUR' END AS currency_code FROM customer""",
    "pool_changes": """SELECT change, count(*) AS n, max(name) AS last_name FROM (SELECT CASE WHEN c_custkey % 2 <> 0 THEN 'kept' WHEN c_custkey % 3 > 0 THEN 'updated' ELSE 'created' END AS change, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0) GROUP BY change""",
    "llm_cache_after": duckdb_views("job") + f"""{_KEYED}, CASE WHEN job_id % 3 = 0 THEN 'new' ELSE 'old' END AS response_json, CAST(CASE WHEN job_id % 3 = 0 THEN 1 ELSE job_id % 5 + 1 END + CASE WHEN job_id % 4 = 0 AND (job_id % 3 = 0 OR created_at + INTERVAL 20 DAY > TIMESTAMP '{NOW}') THEN 2 ELSE 0 END AS BIGINT) AS hit_count
      FROM job WHERE job_id % 3 = 0 OR (job_id % 2 = 0 AND created_at + INTERVAL 20 DAY >= TIMESTAMP '{NOW}')""",
    "llm_cache_found": duckdb_views("job") + f"{_KEYED}, 'old' AS response_json FROM job WHERE job_id % 6 = 0 AND created_at + INTERVAL 20 DAY > TIMESTAMP '{NOW}'",
    "split_payloads": _ITEMS + """SELECT document_id, item_order AS order, CAST(i.amount + CASE WHEN item_order = last THEN gap ELSE 0 END AS DOUBLE) AS amount, CASE WHEN position % 4 <> 0 THEN i.description ELSE concat('Item ', item_order + 1) END AS description,
      CASE WHEN type = 'deposit' THEN coalesce(src, cor, 'Unknown Source') ELSE coalesce(src, 'Checking Account') END AS source_name, CASE type WHEN 'withdrawal' THEN coalesce(cor, 'Unknown Merchant') WHEN 'deposit' THEN 'Checking Account' ELSE 'Unknown Account' END AS destination_name,
      category AS category_name, 't,archive,split-transaction' AS tags, CASE WHEN item_order = 0 THEN concat('ARCHIVE:', document_id) END AS internal_reference, CASE WHEN item_order = 0 THEN concat('x', document_id) END AS external_id
      FROM docs JOIN line_item i ON i.group_id = document_id WHERE item_order % 6 <> 5 AND abs(gap) <= 1""",
    "split_payload_rejects": _ITEMS + "SELECT document_id, concat('Split sum (', CAST(CAST(s AS DECIMAL(18,2)) AS VARCHAR), ') differs from total (', CAST(total AS VARCHAR), ') by 3.00') AS error FROM docs WHERE abs(gap) > 1",
    "split_payload_ids": _ITEMS + "SELECT document_id, concat('archive:', document_id, ':', substr(sha256(CAST(document_id AS VARCHAR)), 1, 16), ':', CAST(total AS VARCHAR), ':', date, ':splits', kept) AS external_id, CAST(kept AS VARCHAR) AS n FROM docs WHERE abs(gap) <= 1 AND document_id % 11 <> 0 UNION ALL "
    "SELECT document_id, concat('archive:', document_id, ':', substr(sha256(CAST(document_id AS VARCHAR)), 1, 16), ':', CAST(total AS VARCHAR), ':splits', kept), CAST(kept AS VARCHAR) FROM docs WHERE abs(gap) <= 1 AND document_id % 11 = 0",
    "split_problems": duckdb_views("line_item") + """, s AS (SELECT group_id, sum(CASE WHEN position = 2 THEN 0 ELSE amount END) AS s, count(*) FILTER (position = 2 OR amount <= 0) AS z, count(*) FILTER (position % 3 = 0) AS e FROM line_item WHERE group_id % 4 > 0 GROUP BY group_id)
      SELECT o_orderkey AS group_id, concat_ws('|', CASE WHEN s IS NULL THEN 'No splits defined' END, CASE WHEN s IS NOT NULL AND o_orderkey % 3 = 0 THEN concat('Split sum (', CAST(CAST(s AS DECIMAL(18,2)) AS VARCHAR), ') != total (', CAST(CAST(s + 1 AS DECIMAL(18,2)) AS VARCHAR), ')') END,
      CASE WHEN z > 0 THEN concat(z, ' with non-positive amount') END, CASE WHEN e > 0 THEN concat(e, ' with empty description') END) AS errors FROM orders LEFT JOIN s ON group_id = o_orderkey""",
    "amounts_checked": duckdb_views("line_item") + """, x AS (SELECT *, group_id % 5 AS k, CASE WHEN group_id % 5 = 0 THEN amount + 0.01 ELSE amount END AS a FROM line_item), e AS (SELECT *, CASE WHEN k = 1 AND amount > 0 THEN concat('split amount: Amount must be positive, got -', CAST(amount AS VARCHAR)) WHEN k = 2 THEN 'split amount: Amount cannot be zero'
      WHEN k = 3 THEN 'split amount: Invalid amount format' WHEN a > 50000 THEN concat('split amount: Amount ', CAST(CAST(a AS DECIMAL(18,2)) AS VARCHAR), ' exceeds maximum 50000') END AS error FROM x)
      SELECT group_id, item_order, CASE WHEN error IS NULL THEN CAST(a AS DOUBLE) END AS amount, error FROM e""",
    "edits_applied": duckdb_views("proposal") + """, e AS (SELECT document_id, document_id % 4 = 0 AS ea, document_id % 6 = 0 AS ed, document_id % 2 = 0 AS touched, CASE WHEN document_id % 4 = 0 THEN 5.00 ELSE amount END AS a, CASE WHEN document_id % 6 = 0 THEN '2024-01-01' ELSE CAST(date AS VARCHAR) END AS d, description FROM proposal)
      SELECT document_id, CAST(a AS DOUBLE) AS amount, d AS date, CASE WHEN touched THEN 'edited' ELSE description END AS description, CASE WHEN ea OR ed THEN concat(CAST(CAST(a AS DECIMAL(18,2)) AS VARCHAR), ':', d) ELSE 'old' END AS external_id FROM e""",
    "import_queue_sides": duckdb_views("extraction", "linkage", "imports") + f"SELECT id, CASE WHEN status = 'FAILED' THEN 'failed' ELSE 'ready' END AS side FROM ({_IMPORTABLE})",
    "unified_page": _UNIFIED + f"SELECT id, {_FLAGS} AS needs_linking FROM u ORDER BY 2 DESC, created_at DESC, id DESC LIMIT 100",
    "unified_counts": _UNIFIED + f"""SELECT count(*) AS total, count(*) FILTER ({_FLAGS}) AS needs_linking, count(*) FILTER (link IN ('LINKED', 'AUTO_LINKED')) AS is_linked, count(*) FILTER (link = 'ORPHAN') AS is_orphan, count(*) FILTER (link = 'AUTO_LINKED') AS is_auto,
      count(*) FILTER (review_state IN ('REVIEW', 'MANUAL') AND review_decision IS NULL) AS needs_review,
      count(*) FILTER ((review_state = 'AUTO' OR review_decision IN ('ACCEPTED', 'EDITED')) AND link IN ('LINKED', 'AUTO_LINKED', 'ORPHAN') AND coalesce(import_status, 'FAILED') = 'FAILED') AS ready_for_import FROM u""",
    "review_oldest": duckdb_views("extraction") + "SELECT id, created_at FROM extraction WHERE review_state IN ('REVIEW', 'MANUAL') AND review_decision IS NULL ORDER BY created_at, id LIMIT 50",
    "runs_of_document": duckdb_views("job") + "SELECT job_id FROM job WHERE document_id = 7",
    "list_stats": duckdb_views("ledger") + """SELECT ['pending', 'accepted', 'rejected', 'auto_matched'][ledger_id % 4 + 1] AS metric, count(*) AS n FROM ledger GROUP BY 1 UNION ALL
      SELECT 'unlinked', count(*) FROM ledger WHERE match_status = 'UNMATCHED' AND deleted_at IS NULL AND (user_id IS NULL OR user_id = 3) UNION ALL SELECT 'soft_deleted', count(*) FROM ledger WHERE deleted_at IS NOT NULL AND (user_id IS NULL OR user_id = 3)""",
    "applied_version": "SELECT max(n_nationkey) AS version FROM nation",
    "active_counts": duckdb_views("extraction", "linkage", "imports", "ledger") + f"SELECT 'ready' AS metric, count(*) AS n FROM ({_IMPORTABLE}) UNION ALL SELECT 'cached', count(*) FROM ledger WHERE deleted_at IS NULL",
    "calibration": duckdb_views("job") + "SELECT document_id, least(1.0, count(*) / 12.0::DOUBLE) AS progress FROM job GROUP BY document_id",
    "suggestions_kept": duckdb_views("line_item") + """, x AS (SELECT *, CASE WHEN item_order % 2 = 0 THEN category WHEN item_order % 4 = 1 THEN 'withdrawal' ELSE 'create_new' END AS v FROM line_item)
      SELECT group_id, item_order FROM x WHERE CASE group_id % 6 WHEN 0 THEN v IN ('A', 'R') WHEN 1 THEN v = 'withdrawal' WHEN 2 THEN v = 'N' WHEN 4 THEN v IN ('R', 'create_new') ELSE true END""",
    "pii_gate": """WITH v AS (SELECT conv_id AS run_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b[A-Z]{2}\\d{2}[A-Z0-9]{4,30}\\b') OR regexp_matches(text, '(?i)\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b') THEN concat('Sensitive data in outcome: ', substr(text, 1, 50), '...')
      WHEN length(text) > 200 THEN concat('Outcome exceeds max length: ', length(text)) END AS said FROM conversations)
      SELECT run_id, count(said) = 0 AS is_valid, coalesce(arg_min(said, turn) FILTER (said IS NOT NULL), '') AS violation FROM v GROUP BY run_id""",
}
