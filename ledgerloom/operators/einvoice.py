"""Fields of structured e-invoices, in CII and UBL, from XML or from PDF files that hold it."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import safe_date, safe_decimal

# Where the fields are, as paths of local names; the first path that is there counts.
CII = {
    "invoice_number": ["ExchangedDocument/ID"],
    "date": ["ExchangedDocument/IssueDateTime/DateTimeString", "IssueDateTime/DateTimeString"],
    "vendor": ["SellerTradeParty/Name"],
    "currency": ["InvoiceCurrencyCode"],
    "amount": ["SpecifiedTradeSettlementHeaderMonetarySummation/GrandTotalAmount"],
    "tax": ["SpecifiedTradeSettlementHeaderMonetarySummation/TaxTotalAmount"],
    "net": ["SpecifiedTradeSettlementHeaderMonetarySummation/TaxBasisTotalAmount"],
    "rate": ["ApplicableTradeTax/RateApplicablePercent"],
    "description": ["ExchangedDocument/Name"],
}
UBL = {
    "invoice_number": ["ID"],
    "date": ["IssueDate"],
    "vendor": ["AccountingSupplierParty//Name"],
    "currency": ["DocumentCurrencyCode"],
    "amount": ["PayableAmount"],
    "tax": ["TaxAmount"],
    "net": ["TaxExclusiveAmount"],
    "rate": ["TaxSubtotal/Percent", "TaxSubtotal/TaxCategory/Percent", "TaxSubtotal//Percent"],
}
LINES = {
    "cii": ("IncludedSupplyChainTradeLineItem", {
        "description": ["SpecifiedTradeProduct/Name"], "quantity": ["SpecifiedLineTradeDelivery/BilledQuantity"],
        "unit_price": ["NetPriceProductTradePrice/ChargeAmount"], "total": ["SpecifiedTradeSettlementLineMonetarySummation/LineTotalAmount"]}),
    "ubl": ("InvoiceLine", {"description": ["Name"], "quantity": ["InvoicedQuantity"], "unit_price": ["PriceAmount"], "total": ["LineExtensionAmount"]}),
}
MARKERS = ("crossindustryinvoice", "crossindustrydocument", "urn:cen.eu:en16931", "factur-x", "zugferd", "xrechnung", "urn:oasis:names:specification:ubl", "peppol")
_LINE = pa.struct([(k, pa.string()) for k in ("description", "quantity", "unit_price", "total")])
_KIND = pa.struct([*[(k, pa.string()) for k in ("dialect", *CII)], ("lines", pa.list_(_LINE))])


def find(root: ET.Element, paths: list[str]) -> ET.Element | None:
    """The first element in document order at the first path that leads to one, whatever the namespaces."""
    for path in paths:
        steps = re.sub(r"(^|/)(?=[A-Za-z])", r"\1{*}", path)
        got = root.find(f".//{steps}")
        if got is not None:
            return got
    return None


def _text(root: ET.Element, paths: list[str]) -> str | None:
    e = find(root, paths)
    return (e.text or "").strip() or None if e is not None else None


def read_invoice(xml: str | None) -> dict | None:
    """The raw fields of an invoice, or None for anything else."""
    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, ValueError):
        return None
    name = root.tag.rpartition("}")[2]
    dialect = {"CrossIndustryInvoice": "cii", "CrossIndustryDocument": "cii", "Invoice": "ubl", "CreditNote": "ubl_credit_note"}.get(name)
    if dialect is None:
        dialect = next((d for d, p in (("cii", CII), ("ubl", UBL)) if find(root, p["amount"]) is not None), None)
        if dialect is None:
            return None
    out = {k: _text(root, p) for k, p in (CII if dialect == "cii" else UBL).items()}
    if dialect != "cii" and not out["currency"] and (payable := find(root, UBL["amount"])) is not None:
        out["currency"] = payable.get("currencyID")
    tag, fields = LINES["cii" if dialect == "cii" else "ubl"]
    lines = [{k: _text(x, p) for k, p in fields.items()} for x in root.iterfind(f".//{{*}}{tag}")]
    lines = [x for x in lines if x["description"]]
    if dialect == "cii" and not out.get("description") and lines:
        out["description"] = lines[0]["description"]
    return {"description": None} | out | {"dialect": dialect, "lines": lines}


def embedded_xml(data: bytes | None) -> str | None:
    """The first well-formed XML in a PDF's streams, or else in its bytes."""
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data or b"", re.S):
        for body in (m[1], _inflate(m[1])):
            if body and b"<?xml" in body and read_any(text := body[body.index(b"<?xml"):].decode("utf-8", "replace").strip()):
                return text
    m = re.search(rb"<\?xml.*</(?:\w+:)?(?:CrossIndustryInvoice|CrossIndustryDocument|Invoice|CreditNote)>", data or b"", re.S)
    text = m[0].decode("utf-8", "replace") if m else None
    return text if read_any(text) else None


def _inflate(data: bytes) -> bytes | None:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return None


def read_any(text: str | None) -> bool:
    try:
        return ET.fromstring(text or "") is not None
    except (ET.ParseError, ValueError):
        return False


def _fields(xml: Column) -> Column:
    def read(column: pa.Array) -> pa.Array:
        return pa.array([read_invoice(x) for x in column.to_pylist()], _KIND)

    kind = "dialect string, " + ", ".join(f"{k} string" for k in CII) + ", lines array<struct<description:string,quantity:string,unit_price:string,total:string>>"
    return F.arrow_udf(read, kind)(xml)


def pdf_xml(data: Column) -> Column:
    """The invoice XML that PDF files hold."""

    def read(column: pa.Array) -> pa.Array:
        return pa.array([embedded_xml(x) for x in column.to_pylist()], pa.string())

    return F.arrow_udf(read, "string")(data)


def is_einvoice(filename: Column, head: Column) -> Column:
    """Whether a file's name or content is marked as an e-invoice."""
    low = F.lower(F.coalesce(head, F.lit("")))
    return F.coalesce(F.lower(filename).rlike(r"(zugferd-invoice|factur-x|xrechnung)\.xml$"), F.lit(False)) | F.greatest(*[low.contains(m) for m in MARKERS]) | low.contains("/embeddedfiles")


def einvoice(xml: Column) -> Column:
    """A struct of typed fields, with scores in hundredths; null for text that is no invoice."""
    f = _fields(xml)
    amount, date = safe_decimal(f["amount"]).cast("decimal(18,2)"), safe_date(f["date"])
    line = lambda x: F.struct(x["description"].alias("description"), safe_decimal(x["quantity"]).alias("quantity"), safe_decimal(x["unit_price"]).alias("unit_price"), safe_decimal(x["total"]).cast("decimal(18,2)").alias("total"))
    sure = lambda c, n: F.when(c.isNotNull(), n).otherwise(0)
    return F.when(f.isNotNull(), F.struct(
        f["dialect"].alias("dialect"), f["invoice_number"].alias("invoice_number"), date.alias("date"), f["vendor"].alias("vendor"), F.upper(f["currency"]).alias("currency"),
        amount.alias("amount"), safe_decimal(f["tax"]).cast("decimal(18,2)").alias("tax"), safe_decimal(f["net"]).cast("decimal(18,2)").alias("net"), safe_decimal(f["rate"]).alias("rate"),
        f["description"].alias("description"), F.transform(f["lines"], line).alias("lines"), (f["dialect"] == "ubl_credit_note").alias("is_credit_note"),
        F.when(amount != 0, 98).otherwise(0).alias("amount_score"), sure(date, 95).alias("date_score"), sure(f["vendor"], 95).alias("vendor_score"), sure(f["currency"], 98).alias("currency_score"), sure(f["invoice_number"], 95).alias("invoice_score"),
    ))


def routed(invoice: Column, ocr: Column, has_text: Column) -> Column:
    """Which extraction counts: a sure invoice, else OCR if there is text, else the invoice; null without any."""
    return F.when(invoice.isNotNull() & (invoice["amount_score"] > 30), "einvoice").when(has_text, "ocr").when(invoice.isNotNull(), "einvoice")
