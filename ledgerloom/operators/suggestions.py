"""Deterministic handling of model suggestions: categories, whitelists, JSON repair, cache keys, calibration."""

from __future__ import annotations

import json
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, words
from .related import contained_either_way, sharing

#: Fixed value: what a suggestion is told to be if only parts of it could be read.
SALVAGED = "Extracted from malformed response"


def match_category(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds the category (null if none) that each `raw` text names.

    Equal first, then one that contains the other, then the one with most common words; ties go to the
    first by `position`. Each distinct text is looked up once, by equi-joins on what texts share.
    """
    texts = raw.select("raw").distinct().withColumn("k", norm(F.col("raw"))).where("k <> ''")
    cats = categories.select("category", "position", F.lower("category").alias("c")).where("c <> ''")
    k, c = texts.select("k").distinct(), cats.select("c").distinct()
    overlap = F.size(F.array_intersect(words(F.col("k")), words(F.col("c"))))
    kind = F.when(F.col("k") == F.col("c"), 3).when(F.col("c").contains(F.col("k")) | F.col("k").contains(F.col("c")), 2).when(overlap > 0, 1)
    pairs = contained_either_way(k, c).union(sharing(k, c, words)).distinct().toDF("k", "c").withColumn("kind", kind).where("kind is not null")
    pairs = pairs.withColumn("n", F.when(F.col("kind") == 1, overlap).otherwise(0))
    best = pairs.join(cats, "c").groupBy("k").agg(F.min_by("category", F.struct((-F.col("kind")).alias("kind"), (-F.col("n")).alias("n"), "position")).alias("category"))
    return raw.join(texts.join(best, "k").select("raw", "category"), "raw", "left")


_OPEN = {"{": "}", "[": "]"}
_WORD = re.compile(r"[^\s{}\[\],:\"']+")
_WORDS = {"true": True, "false": False, "null": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: Nested values that a reader follows, and places where an answer is tried.
DEPTH, STARTS = 64, 100


class Broken(ValueError):
    """The text goes on as no value could."""


class Cut(Broken):
    """The text ends within a value."""


class Reader:
    """Reads one value at a place of a text by lenient rules: either quotes, bare keys, commas too many, raw line ends."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        if self.at >= len(self.text):
            raise Cut("end of text")
        return self.text[self.at]

    def string(self) -> str:
        quote, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                return "".join(out)
            if c == "\\" and self.at < len(self.text):
                c = self.text[self.at]
                self.at += 1
                if c == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", digits := self.text[self.at : self.at + 4]):
                    c = chr(int(digits, 16))
                    self.at += 4
                c = _ESCAPES.get(c, c)
            out.append(c)
        raise Cut("open string")

    def bare(self):
        m = _WORD.match(self.text, self.at)
        if not m:
            raise Broken("no value")
        self.at = m.end()
        return m[0]

    def value(self, depth: int = 0):
        c = self.peek()
        if c in _OPEN:
            return self.items(depth + 1)
        if c in "\"'":
            return self.string()
        word = self.bare()
        if word.lower() in _WORDS:
            return _WORDS[word.lower()]
        try:
            number = float(word)
        except ValueError:
            raise Broken(word) from None
        return int(word) if re.fullmatch(r"[+-]?\d+", word) else number

    def items(self, depth: int):
        if depth > DEPTH:
            raise Broken("too deep")
        opened = self.text[self.at]
        self.at += 1
        fields, values = {}, []
        while (c := self.peek()) != _OPEN[opened]:
            if c == ",":
                self.at += 1
                continue
            if opened == "[":
                values.append(self.value(depth))
                continue
            key = self.string() if c in "\"'" else self.bare()
            if self.peek() != ":":
                raise Broken(key)
            self.at += 1
            fields[key] = self.value(depth)
        self.at += 1
        return fields if opened == "{" else values


def _field(text: str, name: str, kinds: type | tuple):
    """The value after the first mention of a name and a colon, if it is of that kind and whole."""
    for m in re.finditer(rf"\b{name}\b[\"']?\s*:", text):
        try:
            got = Reader(text, m.end()).value()
        except Broken:
            continue
        if isinstance(got, kinds) and (kinds is bool or not isinstance(got, bool)):
            return got
    return None


def parse_response(content: str | None) -> dict | None:
    """The JSON object of a model's answer, whatever surrounds it; None if nothing can be read.

    The first object or list of objects that a lenient reader can read to its end counts, a list as
    suggested splits. Of an answer that breaks off, single known fields are taken.
    """
    text = content or ""
    for start in islice(re.finditer(r"[{\[]", text), STARTS):
        try:
            got = Reader(text, start.start()).value()
        except Broken as e:
            if isinstance(e, Cut) and start[0] == "{":
                break  # what is inside a cut object is not the answer
            continue
        if isinstance(got, dict) and got:
            return got
        if isinstance(got, list) and got and all(isinstance(x, dict) for x in got):
            return {"should_split": True, "splits": got, "confidence": 0.5, "reason": SALVAGED}
    kinds = {"should_split": bool, "confidence": (int, float), "category": str}
    out = {k: v for k, kind in kinds.items() if (v := _field(text, k, kind)) is not None}
    if not out:
        return None
    return out | {"reason": _field(text, "reason", str) or SALVAGED}


def response(content: Column) -> Column:
    """The JSON text of parse_response, with sorted keys."""

    def read(column: pa.Array) -> pa.Array:
        found = (parse_response(x) for x in column.to_pylist())
        return pa.array([None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False) for x in found], pa.string())

    return F.arrow_udf(read, "string")(content)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of all parts; missing ones keep their place."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def auto_apply(confidence: Column, seen: Column, threshold: float = 0.9, target: int = 100, opted_out: Column | None = None) -> Column:
    """Whether a suggestion may be applied by itself: sure enough, calibrated, and not opted out."""
    ok = (confidence >= threshold) & (seen >= target)
    return ok if opted_out is None else ok & ~F.coalesce(opted_out, F.lit(False))


def whitelisted(value: Column, allowed: Column) -> Column:
    """The value if it is allowed, whatever its case, else null."""
    return F.get(F.filter(allowed, lambda x: F.lower(x) == F.lower(value)), F.lit(0))


def feedback(suggested: Column, actual: Column) -> Column:
    return F.when(norm(suggested) == norm(actual), "CORRECT").otherwise("WRONG")


def allowed_suggestion(field: Column, value: Column, categories: Column, currencies: Column, accounts: Column, transactions: Column) -> Column:
    """Whether a suggested value of a field may be kept.

    Categories and types must be known; currencies, source accounts and existing transactions only where
    some are given (arrays of text), and `create_new` always stands for no transaction. Other fields are free.
    """
    known = lambda c: (F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0) | F.array_contains(c, value)
    ok = (
        F.when(field == "category", F.array_contains(categories, value)).when(field == "transaction_type", value.isin("withdrawal", "deposit", "transfer"))
        .when(field == "currency", known(currencies)).when(field == "source_account", known(accounts))
        .when(field == "existing_transaction", (value == "") | (value == "create_new") | known(transactions)).otherwise(True)
    )
    return F.coalesce(ok, F.lit(False)) & value.isNotNull()
