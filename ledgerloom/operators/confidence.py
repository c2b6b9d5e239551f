"""Confidence, review states and validation of extractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, and how far each strategy is trusted.
AUTO, REVIEW, MIN_AMOUNT, MIN_DATE = 0.85, 0.60, 0.7, 0.6
STRATEGIES = {"factur_x": 0.95, "ubl": 0.95, "zugferd": 0.95, "pdf_text": 0.75, "ocr_heuristic": 0.50, "fallback": 0.20, "none": 0.10}
UNKNOWN, BASE = 0.30, 0.50
WITHDRAWAL = ("receipt", "invoice", "rechnung", "beleg", "quittung")
DEPOSIT = ("credit", "gutschrift", "refund", "rückerstattung")
INCOME = ("income", "einnahme")


def review_state(overall: Column) -> Column:
    return F.when(overall >= AUTO, "AUTO").when(overall >= REVIEW, "REVIEW").otherwise("MANUAL")


def strict_review_state(overall: Column, amount: Column, date: Column) -> Column:
    """As review_state, but AUTO also needs a sure amount and date."""
    return F.when((overall >= AUTO) & (amount >= MIN_AMOUNT) & (date >= MIN_DATE), "AUTO").when(overall >= REVIEW, "REVIEW").otherwise("MANUAL")


def adjusted(score: Column, strategy: Column) -> Column:
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), strategy), F.lit(UNKNOWN))
    return F.least(F.lit(1.0), score * (base / BASE))


def overall(amount: Column, date: Column, vendor: Column, currency: Column, description: Column, invoice: Column) -> Column:
    value = amount * 0.4 + date * 0.3 + vendor * 0.2 + (currency + description + invoice) / 3.0 * 0.1
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def transaction_type(document_type: Column, tags: Column) -> Column:
    kind = F.lower(F.coalesce(document_type, F.lit("")))
    has = lambda c, words: F.greatest(*[c.contains(w) for w in words])
    income = F.coalesce(F.exists(tags, lambda t: has(F.lower(t), INCOME)), F.lit(False))
    return F.when(has(kind, WITHDRAWAL), "withdrawal").when(has(kind, DEPOSIT), "deposit").when(income, "deposit").otherwise("withdrawal")


def issues(amount: Column, date: Column, description: Column, external_id: Column, currency: Column, overall: Column, amount_score: Column) -> Column:
    """What is wrong with an extraction, in a fixed order."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    good = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.substring(date, 1, 4).try_cast("int").between(1900, 2100) & F.substring(date, 6, 2).try_cast("int").between(1, 12) & F.substring(date, 9, 2).try_cast("int").between(1, 31)
    return F.array_compact(F.array(
        F.when(amount.isNull() | (amount <= 0), "Amount is missing or invalid"),
        F.when(blank(date), "Date is missing").when(~good, F.concat(F.lit("Date format invalid: "), date)),
        F.when(blank(description), "Description is missing"),
        F.when(blank(external_id), "external_id is missing"),
        F.when(amount > 100000, F.concat(F.lit("Amount unusually large: "), amount.cast("string"))),
        F.when(blank(currency), "Currency is missing"),
        F.when((overall > 0.9) & (amount_score < 0.5), "Overall confidence inconsistent with amount confidence"),
    ))
