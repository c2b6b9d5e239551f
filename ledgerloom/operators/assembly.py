"""Extractions assembled from what was read of a document, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confidence import overall, review_state, transaction_type
from .identity import ORIGIN, legacy_external_id
from .payloads import DEFAULT_ACCOUNT

#: Optional amounts of a proposal and of a line: stored as text, and not at all where they are zero.
OPTIONAL, LINE = ("total_net", "tax_amount", "tax_rate"), ("quantity", "unit_price", "total", "tax_rate")
SCORES = ("amount", "date", "currency", "description", "vendor", "invoice_number", "line_items")
_TEXTS = "transaction_type date amount currency description source_account destination_account category".split()
_MORE = "notes external_id invoice_number due_date payment_reference".split()
#: The stored form; amounts are text.
STORED = (
    "document_id long, source_hash string, url string, title string, raw_text string, document_classification struct<document_type:string,correspondent:string,tags:array<string>,storage_path:string>, "
    f"proposal struct<{','.join(f'{k}:string' for k in _TEXTS)},tags:array<string>,{','.join(f'{k}:string' for k in (*_MORE, *OPTIONAL))}>, "
    "line_items array<struct<description:string,quantity:string,unit_price:string,total:string,tax_rate:string,position:int,category:string>>, "
    f"confidence struct<overall:double,{','.join(f'{k}:double' for k in SCORES)},review_state:string>, "
    "provenance struct<source_system:string,parser_version:string,parsed_at:string,ruleset_id:string,extraction_strategy:string>, created_at string, user_edited_fields array<string>"
)


def _or(c: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), other)


def assembled(read: DataFrame, today: Column, account: str = DEFAULT_ACCOUNT, url: str = "http://localhost:8000", origin: str = ORIGIN, version: str = "1") -> DataFrame:
    """The columns of STORED, with amounts as decimals, from documents and what was read of them.

    read has document_id, source_hash, title, text, document_type, correspondent, tags, and as read: amount,
    date (a date), currency, vendor, description, invoice_number, the OPTIONAL amounts, lines
    (description and LINE amounts), SCORES as <name>_score in hundredths, and strategy; nulls where nothing
    was read. today stands for a missing date, 0.00 for a missing amount, EUR for a missing currency.
    """
    c, k = F.col, F.col("document_id").cast("string")
    amount, date = F.coalesce(c("amount"), F.lit(0)).cast("decimal(18,2)"), F.coalesce(c("date"), today.cast("date")).cast("string")
    kind = transaction_type(c("document_type"), c("tags"))
    notes = F.concat_ws("; ", F.concat(F.lit("Extracted from document "), k), F.concat(F.lit("Invoice: "), F.nullif(c("invoice_number"), F.lit(""))))
    none = F.lit(None).cast("string")
    score = {s: F.coalesce(c(f"{s}_score"), F.lit(0)) / 100.0 for s in SCORES}
    total = overall(*[score[s] for s in ("amount", "date", "vendor", "currency", "description", "invoice_number")])
    proposal = {
        "transaction_type": kind, "date": date, "amount": amount, "currency": _or(c("currency"), F.lit("EUR")), "description": _or(c("description"), _or(c("title"), F.concat(F.lit("Document "), k))),
        "source_account": F.when(kind == "withdrawal", account), "destination_account": _or(c("vendor"), c("correspondent")), "category": none, "tags": F.coalesce(c("tags"), F.array().cast("array<string>")), "notes": notes,
        "external_id": legacy_external_id(c("document_id"), c("source_hash"), amount, date, origin), "invoice_number": c("invoice_number"), "due_date": none, "payment_reference": none, **{o: c(o) for o in OPTIONAL},
    }
    lines = F.transform(F.coalesce("lines", F.array().cast(f"array<struct<description:string,{','.join(f'{x}:decimal(18,4)' for x in LINE)}>>")), lambda x, i: F.struct(
        F.coalesce(x["description"], F.lit("")).alias("description"), *[F.nullif(x[n], F.lit(0)).alias(n) for n in LINE], (i + 1).alias("position"), none.alias("category")))
    struct = lambda fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    return read.select(
        "document_id", "source_hash", F.concat(F.lit(f"{url}/documents/"), k, F.lit("/")).alias("url"), "title", F.coalesce("text", F.lit("")).alias("raw_text"),
        F.struct("document_type", "correspondent", "tags", none.alias("storage_path")).alias("document_classification"), struct(proposal).alias("proposal"), lines.alias("line_items"),
        struct({"overall": total, **score, "review_state": review_state(total)}).alias("confidence"),
        struct({"source_system": F.lit(origin), "parser_version": F.lit(version), "parsed_at": today.cast("string"), "ruleset_id": none, "extraction_strategy": F.coalesce("strategy", F.lit("none"))}).alias("provenance"),
        today.cast("string").alias("created_at"), F.array().cast("array<string>").alias("user_edited_fields"),
    )


def _amounts(s: Column, names: tuple[str, ...], to) -> Column:
    for n in names:
        s = s.withField(n, to(s[n]))
    return s


def encoded(extraction: DataFrame) -> Column:
    """The JSON text of an assembled extraction: all keys, amounts as text, optional amounts of zero as null."""
    text = lambda x: F.when(x != 0, x.cast("string"))
    proposal = _amounts(F.col("proposal").withField("amount", F.col("proposal.amount").cast("string")), OPTIONAL, text)
    lines = F.transform("line_items", lambda x: _amounts(x, LINE, text))
    fields = {"proposal": proposal, "line_items": lines}
    return F.to_json(F.struct(*[fields.get(n, F.col(n)).alias(n) for n in extraction.columns]), {"ignoreNullFields": "false"})


def decoded(text: Column) -> Column:
    """A struct of STORED with amounts as decimals again; null for text that is no such JSON."""
    number = lambda kind: lambda x: F.nullif(x, F.lit("")).try_cast(kind)

    def read(s: Column) -> Column:
        proposal = _amounts(s["proposal"].withField("amount", s["proposal"]["amount"].try_cast("decimal(18,2)")), OPTIONAL, number("decimal(18,4)"))
        lines = F.transform(s["line_items"], lambda x: _amounts(x, LINE, number("decimal(18,4)")))
        state = F.coalesce(s["confidence"]["review_state"], F.lit("MANUAL"))
        return F.when(s["document_id"].isNotNull(), s.withField("proposal", proposal).withField("line_items", lines).withField("confidence", s["confidence"].withField("review_state", state)))

    # a variable is read many times, but a text in its place would be parsed as often
    return F.get(F.transform(F.array(F.from_json(text, STORED)), read), F.lit(0))
