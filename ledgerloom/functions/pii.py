"""Detection and redaction of personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# What counts as sensitive, whatever its case, in the order of redaction.
PATTERNS = {
    "iban": r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b",
    "card": r"(?i)\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "account": r"(?i)\b\d{10,}\b",
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?i)\b[\+]?[(]?[0-9]{1,3}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,4}[-\s\.]?[0-9]{1,9}\b",
}
MARK, MAX_TEXT, MAX_SNIPPET = "[REDACTED]", 200, 50


def is_sensitive(c: Column, kinds=tuple(PATTERNS)) -> Column:
    """Whether a text holds any of the kinds; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [c.rlike(PATTERNS[k]) for k in kinds]), F.lit(False))


def redact(c: Column, kinds=tuple(PATTERNS), mark: str = MARK, limit: int | None = MAX_TEXT) -> Column:
    """White space as single spaces, sensitive runs replaced in order, then cut to limit with `...`."""
    t = strip(F.regexp_replace(c, r"\s+", " "))
    t = reduce(lambda a, k: F.regexp_replace(a, PATTERNS[k], mark), kinds, t)
    return t if limit is None else F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def outcome(field: Column, value: Column, kind: Column) -> Column:
    """A description of an outcome that is safe to store: numbers and dates as they are, texts redacted, others by type."""
    plain = ["amount", "confidence", "match_score", "date", "due_date", "invoice_date"]
    return F.when(field.isin(plain), F.concat(field, F.lit("="), value)).when(
        kind == "str", F.concat(field, F.lit("='"), redact(value, limit=MAX_SNIPPET), F.lit("'"))
    ).otherwise(F.concat(field, F.lit("=<"), kind, F.lit(">")))


def violation(outcome_: Column, notes: Column, kinds=tuple(PATTERNS)) -> Column:
    """What forbids an event of a trace to be stored, or null: sensitive data in its outcome or notes, or too long an outcome."""
    start = lambda c: F.concat(F.substring(c, 1, MAX_SNIPPET), F.lit("..."))
    return F.when(is_sensitive(outcome_, kinds), F.concat(F.lit("Sensitive data in outcome: "), start(outcome_))).when(
        is_sensitive(notes, kinds), F.concat(F.lit("Sensitive data in notes: "), start(notes))
    ).when(F.length(outcome_) > MAX_TEXT, F.concat(F.lit("Outcome exceeds max length: "), F.length(outcome_).cast("string")))


def gate(events: DataFrame, strict: bool = True, kinds=tuple(PATTERNS)) -> DataFrame:
    """(run_id, is_valid, violations) of traces of events (run_id, seq, outcome, notes); strict: only the first violation is told."""
    found = events.select("run_id", F.struct("seq", violation(F.col("outcome"), F.col("notes"), kinds).alias("said")).alias("v"))
    bad = F.when(F.col("v.said").isNotNull(), F.col("v"))
    told = F.array_compact(F.array(F.min(bad))) if strict else F.array_sort(F.collect_list(bad))
    return found.groupBy("run_id").agg((F.count(bad) == 0).alias("is_valid"), F.transform(told, lambda x: x["said"]).alias("violations"))
