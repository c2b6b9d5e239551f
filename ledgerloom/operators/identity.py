"""Deterministic identifiers, link markers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import even_amount, norm

#: The name that ids and markers carry; set it to the name that existing ledgers use.
ORIGIN = "archive"
PREFIX = 16


def transaction_hash(amount: Column, date: Column, source: Column, destination: Column, description: Column) -> Column:
    """SHA-256 of the normalised fields between pipes; missing ones are empty."""
    parts = [even_amount(amount), F.coalesce(date, F.lit("")), norm(source), norm(destination), norm(description)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def external_id(hash_: Column, document_id: Column | None = None) -> Column:
    """The hash's start, and with a document `:pl:` and its id."""
    head = F.substring(hash_, 1, PREFIX)
    return head if document_id is None else F.when(document_id.isNull(), head).otherwise(F.concat(head, F.lit(":pl:"), document_id.cast("string")))


def legacy_external_id(document_id: Column, source_hash: Column, amount: Column, date: Column, origin: str = ORIGIN) -> Column:
    """origin:document:hash:amount:date, or null where a part is invalid."""
    ok = (document_id >= 0) & (F.length(source_hash) >= PREFIX) & date.rlike("^.{4}-.{2}-.{2}$")
    return F.when(ok, F.concat_ws(":", F.lit(origin), document_id.cast("string"), F.substring(source_hash, 1, PREFIX), even_amount(amount), date))


def parse_external_id(value: Column, origin: str = ORIGIN) -> Column:
    """A struct of document_id, hash, amount and date, or null if no format fits.

    Formats: origin:document:hash:amount:date with an optional :split, hash:pl:document, and hash.
    """
    p = F.split(value, ":")
    at = lambda i: F.get(p, F.lit(i))
    document, amount = at(1).try_cast("long"), at(3).try_cast("decimal(18,2)")
    kind = lambda d, h, a, t: F.struct(d.cast("long").alias("document_id"), h.alias("hash"), a.cast("decimal(18,2)").alias("amount"), t.cast("string").alias("date"))
    none = F.lit(None)
    legacy = F.when(F.size(p).isin(5, 6) & document.isNotNull() & amount.isNotNull(), kind(document, at(2), amount, at(4)))
    linked = F.when((F.length(at(0)) == PREFIX) & at(2).try_cast("long").isNotNull(), kind(at(2).try_cast("long"), at(0), none, none))
    alone = F.when(F.length(value) == PREFIX, kind(none, value, none, none))
    return F.when(value.startswith(f"{origin}:"), legacy).when((F.size(p) == 3) & (at(1) == "pl"), linked).when(F.size(p) == 1, alone)


def is_own_external_id(value: Column, origin: str = ORIGIN) -> Column:
    p = F.split(value, ":")
    return F.coalesce(value.startswith(f"{origin}:") | ((F.size(p) == 3) & (F.get(p, F.lit(1)) == "pl")), F.lit(False))


def internal_reference(document_id: Column, origin: str = ORIGIN) -> Column:
    return F.concat(F.lit(f"{origin.upper()}:"), document_id.cast("string"))


def notes_marker(document_id: Column, origin: str = ORIGIN) -> Column:
    return F.concat(F.lit(f"{origin.capitalize()} doc_id="), document_id.cast("string"))


def is_linked(external: Column, reference: Column, notes: Column, origin: str = ORIGIN) -> Column:
    """Whether any of the three markers names a document."""
    holds = lambda c, mark: F.coalesce(c.contains(mark), F.lit(False))
    return is_own_external_id(external, origin) | holds(reference, f"{origin.upper()}:") | holds(notes, f"{origin.capitalize()} doc_id=")


def marked_document(external: Column, reference: Column, notes: Column, origin: str = ORIGIN) -> Column:
    """The document of the first marker that names one: external id, reference, notes."""
    after = lambda c, mark: F.regexp_extract(c, f"{mark}([0-9]+)", 1).try_cast("long")
    return F.coalesce(parse_external_id(external, origin)["document_id"], after(reference, f"{origin.upper()}:"), after(notes, f"{origin.capitalize()} doc_id="))


def fingerprint(entity: str, *parts: Column) -> Column:
    """SHA-256 of `entity:part:...`, or null without a name (the first part, lower case)."""
    name = norm(parts[0]) if entity not in ("currency", "account") else parts[0]
    return F.when(name != "", F.sha2(F.concat_ws(":", F.lit(entity), name, *parts[1:]), 256))


def account_fingerprint(kind: Column, name: Column, currency: Column) -> Column:
    code = F.upper(norm(F.coalesce(currency, F.lit("EUR"))))
    return F.when((norm(kind) != "") & (norm(name) != ""), F.sha2(F.concat_ws(":", F.lit("account"), norm(kind), norm(name), code), 256))


def currency_fingerprint(code: Column) -> Column:
    return fingerprint("currency", F.upper(norm(code)))


def piggy_fingerprint(name: Column, target: Column) -> Column:
    return fingerprint("piggy", name, F.coalesce(even_amount(target), F.lit("0.00")))


def bill_fingerprint(name: Column, least: Column, most: Column) -> Column:
    return fingerprint("bill", name, F.coalesce(even_amount(least), F.lit("0.00")), F.coalesce(even_amount(most), F.lit("0.00")))


def recurrence_fingerprint(title: Column, first_date: Column, freq: Column) -> Column:
    return fingerprint("recurrence", title, F.substring(F.coalesce(first_date, F.lit("")), 1, 10), norm(freq))


def _json(text: Column) -> Column:
    """A JSON string with every character beyond ASCII escaped, as \\\\uXXXX in UTF-16 units."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("long")
        low = code - 0x10000
        return F.when(code < 128, ch).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(F.floor(low / 1024) + 0xD800), unit(low % 1024 + 0xDC00)))

    return F.array_join(F.transform(F.split(quoted, ""), one), "")


def rule_fingerprint(title: Column, triggers: Column, actions: Column) -> Column:
    """Arrays of struct(type, value) are sorted and hashed as compact-with-spaces JSON."""

    def part(items: Column) -> Column:
        rows = F.transform(F.array_sort(items), lambda x: F.concat(F.lit('{"type": '), _json(F.coalesce(x["type"], F.lit(""))), F.lit(', "value": '), _json(F.coalesce(x["value"], F.lit(""))), F.lit("}")))
        return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]")), 256), 1, 8)

    return fingerprint("rule", title, part(triggers), part(actions))
