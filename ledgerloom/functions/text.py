"""Text, money and date expressions that do not depend on locale or ANSI failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (trim() knows spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def norm(c: Column) -> Column:
    """Lower case, stripped, null as empty."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def words(c: Column) -> Column:
    """Distinct words of a normalised text; none for an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, r"\s+")))


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def german_amount(c: Column) -> Column:
    """`1.234,56` as a decimal; null if it is none."""
    return F.translate(F.replace(c, F.lit("."), F.lit("")), ",", ".").try_cast("decimal(18,2)")


def english_amount(c: Column) -> Column:
    """`1,234.56` as a decimal; null if it is none."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def safe_decimal(c: Column) -> Column:
    """A decimal of text in either notation, or null.

    With both separators the last is the decimal one; a single comma with at most two digits after it is
    one, other commas group thousands; dots alone stay.
    """
    t = F.regexp_replace(c, r"[^0-9,.\-]", "")
    comma, dot = F.length(t) - F.instr(F.reverse(t), ","), F.length(t) - F.instr(F.reverse(t), ".")
    has_comma, has_dot = F.instr(t, ",") > 0, F.instr(t, ".") > 0
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    plain = F.replace(t, F.lit(","), F.lit(""))
    swapped = F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")
    out = (
        F.when(has_comma & has_dot & (comma > dot), swapped)
        .when(has_comma & has_dot, plain)
        .when(has_comma & (commas == 1) & (F.length(t) - 1 - comma <= 2), F.translate(t, ",", "."))
        .when(has_comma, plain)
        .otherwise(t)
    )
    return out.try_cast("decimal(18,4)")


def ledger_amount(c: Column) -> Column:
    """The matcher's reading of amount text: without $, € and commas."""
    return strip(F.regexp_replace(c, r"[$€,]", "")).try_cast("decimal(18,2)")


def _dated(c: Column, shape: str, form: str) -> Column:
    return F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(form)).cast("date"))


def safe_date(c: Column) -> Column:
    """The first of YYYYMMDD, YYYY-MM-DD, DD.MM.YYYY and DD/MM/YYYY that fits."""
    t = strip(c)
    return F.coalesce(
        _dated(t, r"^\d{8}$", "yyyyMMdd"), _dated(t, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        _dated(t, r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), _dated(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    )


def ledger_date(c: Column) -> Column:
    """The matcher's reading of date text: ten characters, Y-m-d, else d/m/Y, else m/d/Y."""
    t = F.substring(c, 1, 10)
    return F.coalesce(_dated(t, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), _dated(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), _dated(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"))


def even_amount(c: Column) -> Column:
    """Two decimals, ties to even, as text: the form that identifiers hash."""
    return F.bround(c.cast("decimal(30,10)"), 2).cast("decimal(18,2)").cast("string")
