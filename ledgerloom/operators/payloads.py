"""Ledger payloads from accepted extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .identity import ORIGIN, PREFIX, internal_reference, notes_marker
from .splits import MAX_REMAINDER, group_external_id

DEFAULT_ACCOUNT, MERCHANT, SOURCE, OTHER = "Checking Account", "Unknown Merchant", "Unknown Source", "Unknown Account"
TYPES = ("withdrawal", "deposit", "transfer")


def _given(*columns) -> Column:
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def accounts(kind: Column, source: Column, destination: Column, correspondent: Column, default: str = DEFAULT_ACCOUNT) -> tuple[Column, Column]:
    """Source and destination by type: what is given, then the correspondent, then a default."""
    from_ = F.when(kind == "deposit", _given(source, correspondent, F.lit(SOURCE))).otherwise(_given(source, F.lit(default)))
    to = F.when(kind == "withdrawal", _given(destination, correspondent, F.lit(MERCHANT))).when(kind == "deposit", _given(destination, F.lit(default))).otherwise(_given(destination, F.lit(OTHER)))
    return from_, to


def payloads(df: DataFrame, base_url: str = "http://localhost:8000", origin: str = ORIGIN) -> DataFrame:
    """document_id, error and the fields of one transaction; with an error the fields count for nothing.

    df has document_id, type, date, amount, description, external_id, source_account, destination_account,
    correspondent, currency, category, tags, notes, source_hash, overall, review_state, parser.
    """
    c = F.col
    error = F.coalesce(*[F.when(c(k).isNull() | (c(k).cast("string") == ""), f"{k} is required but empty") for k in ("date", "amount", "description", "external_id")], F.when(c("amount") == 0, "amount is required but empty"))
    from_, to = accounts(c("type"), c("source_account"), c("destination_account"), c("correspondent"))
    notes = F.concat_ws("; ", notes_marker(c("document_id"), origin), F.concat(F.lit("source_hash="), F.substring("source_hash", 1, PREFIX)), F.concat(F.lit("confidence="), F.format_string("%.2f", c("overall"))),
                        F.concat(F.lit("review_state="), c("review_state")), F.concat(F.lit("parser="), F.nullif(c("parser"), F.lit(""))), F.nullif(c("notes"), F.lit("")))
    return df.select(
        "document_id", error.alias("error"), "type", c("date").cast("string").alias("date"), c("amount").cast("string").alias("amount"), "description", from_.alias("source_name"), to.alias("destination_name"),
        c("currency").alias("currency_code"), c("category").alias("category_name"), F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lit(origin)).alias("tags"), notes.alias("notes"),
        internal_reference(c("document_id"), origin).alias("internal_reference"), "external_id", F.concat(F.lit(f"{base_url}/documents/"), c("document_id").cast("string"), F.lit("/")).alias("external_url"),
    )


def split_payloads(df: DataFrame, items: DataFrame, canonical: bool = False, base_url: str = "http://localhost:8000", origin: str = ORIGIN) -> DataFrame:
    """The transactions of documents with two or more line items, one row for each split, or one with an error.

    df as in payloads(); items has document_id, order, description, total, unit_price, category. An item counts by its
    total, or by its unit price where that is missing or zero; items without a positive amount are
    dropped. A difference to the document's amount of up to MAX_REMAINDER goes to the last split that is
    kept, a larger one is an error. The first split that is kept carries the ids, the url and the notes.
    canonical: the external id names the number of splits, and notes count those that are kept.
    """
    c = F.col
    amount = F.round(F.coalesce(F.nullif(c("total"), F.lit(0)), c("unit_price"), F.lit(0)).cast("decimal(30,10)"), 2).cast("decimal(18,2)")
    rows = items.select("document_id", c("order").alias("i"), c("description").alias("item"), c("category").alias("item_category"), amount.alias("part"))
    kept = c("part") > 0
    groups = rows.groupBy("document_id").agg(
        F.count("*").alias("items"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, c("part"))), F.lit(0)).cast("decimal(18,2)").alias("sum"),
        F.min(F.when(kept, c("i"))).alias("first"), F.max(F.when(kept, c("i"))).alias("last"),
    ).where("items > 1")
    gap = (c("amount") - c("sum")).cast("decimal(18,2)")
    error = F.when(c("kept") == 0, "No valid line items to create splits from").when(
        F.abs(gap) > MAX_REMAINDER, F.concat(F.lit("Split sum ("), c("sum").cast("string"), F.lit(") differs from total ("), c("amount").cast("string"), F.lit(") by "), gap.cast("string")))
    docs = df.join(groups, "document_id").withColumn("error", error).withColumn("gap", gap)
    from_, to = accounts(c("type"), c("source_account"), c("destination_account"), c("correspondent"))
    n = c("kept") if canonical else c("items")
    notes = F.concat_ws("; ", notes_marker(c("document_id"), origin), F.concat(F.lit("source_hash="), F.substring("source_hash", 1, PREFIX)), F.concat(F.lit("confidence="), F.format_string("%.2f", c("overall"))),
                        F.concat(F.lit("review_state="), c("review_state")), F.concat(F.lit("splits="), n.cast("string")), F.concat(F.lit("parser="), F.nullif(c("parser"), F.lit(""))),
                        *([] if canonical else [F.nullif(c("notes"), F.lit(""))]))
    out = docs.where("error is null").join(rows.where(kept), "document_id").unionByName(docs.where("error is not null"), allowMissingColumns=True)
    first = c("i") == c("first")
    named = group_external_id(c("document_id"), c("source_hash"), c("amount"), c("date").cast("string"), c("kept"), origin) if canonical else c("external_id")
    part = (c("part") + F.when(c("i") == c("last"), c("gap")).otherwise(0)).cast("decimal(18,2)")
    title = F.coalesce(F.nullif(c("description"), F.lit("")), F.concat(F.lit("Transaction from doc #"), c("document_id").cast("string")))
    return out.select(
        "document_id", "error", title.alias("group_title"), c("i").alias("order"), "type", c("date").cast("string").alias("date"), part.cast("string").alias("amount"),
        F.when(c("i").isNotNull(), F.coalesce(F.nullif(strip(c("item")), F.lit("")), F.concat(F.lit("Item "), (c("i") + 1).cast("string")))).alias("description"), from_.alias("source_name"), to.alias("destination_name"),
        c("currency").alias("currency_code"), F.coalesce("item_category", "category").alias("category_name"), F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(origin), F.lit("split-transaction"))).alias("tags"),
        F.when(first, notes).alias("notes"), F.when(first, internal_reference(c("document_id"), origin)).alias("internal_reference"), F.when(first, named).alias("external_id"),
        F.when(first, F.concat(F.lit(f"{base_url}/documents/"), c("document_id").cast("string"), F.lit("/"))).alias("external_url"),
    )


def manual(df: DataFrame, requests: DataFrame, links: DataFrame) -> DataFrame:
    """Payload rows of requests (document_id, is_cash, remark) for documents without a bank booking, with error.

    df as in payloads(). A document that is not there, or that a row of links (document_id, ledger_id) names, gets
    an error; the others say in their notes why they are manual.
    """
    had = links.groupBy("document_id").agg(F.min("ledger_id").alias("linked"))
    r = requests.join(df.withColumn("there", F.lit(True)), "document_id", "left").join(had, "document_id", "left")
    why = F.concat(F.lit("MANUAL TRANSACTION - "), F.when(F.col("is_cash"), "Cash payment without bank booking. ").otherwise("No matching bank transaction. "), F.coalesce("remark", F.lit("")))
    error = F.when(F.col("there").isNull(), "Document extraction not found").when(F.col("linked").isNotNull(), F.concat(F.lit("Document already linked to transaction "), F.col("linked").cast("string")))
    return r.withColumn("error", error).withColumn("notes", F.when(error.isNull(), F.concat(F.coalesce("notes", F.lit("")), F.lit(" "), why))).drop("there", "linked", "is_cash", "remark")


def payload_errors(order: Column, kind: Column, date: Column, amount: Column, description: Column, external_id: Column, notes: Column) -> Column:
    """What the ledger would refuse in a transaction of a payload; ids and notes are asked of the first only."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    at = F.concat(F.lit("transactions["), order.cast("string"), F.lit("]."))
    said = lambda when, text: F.when(when, F.concat(at, text if isinstance(text, Column) else F.lit(text)))
    value = amount.try_cast("decimal(18,2)")
    return F.array_compact(F.array(
        F.coalesce(said(blank(kind), "type is required"), said(~kind.isin(*TYPES), F.concat(F.lit("type must be withdrawal/deposit/transfer, got: "), kind))),
        said(blank(date), "date is required"),
        F.coalesce(said(blank(amount), "amount is required"), said(value.isNull(), F.concat(F.lit("amount must be a valid decimal, got: "), amount)), said(value <= 0, F.concat(F.lit("amount must be positive, got: "), amount))),
        said(blank(description), "description is required"),
        said((order == 0) & blank(external_id), "external_id is required for idempotent imports"),
        said((order == 0) & blank(notes), "notes is required for audit trail"),
    ))


def edited(df: DataFrame, edits: DataFrame, regenerate) -> DataFrame:
    """df with non-null edits by document_id; a new amount or date makes a new external_id by regenerate(amount, date)."""
    e = edits.select("document_id", *[F.col(k).alias(f"__{k}") for k in ("amount", "date", "description")])
    out = df.join(e, "document_id", "left")
    for k in ("amount", "date", "description"):
        out = out.withColumn(k, F.coalesce(F.col(f"__{k}"), F.col(k)))
    changed = F.col("__amount").isNotNull() | F.col("__date").isNotNull()
    return out.withColumn("external_id", F.when(changed, regenerate(F.col("amount"), F.col("date"))).otherwise(F.col("external_id"))).drop("__amount", "__date", "__description")
