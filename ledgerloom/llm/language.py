"""Language identification by prediction by partial matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, chunks, table, text_bytes

#: Labelled documents of each language that a model learns from: those least by a hash of doc_id and text.
SAMPLE = 500
#: Labelled documents that a model learns from in all: beyond ROWS / SAMPLE languages each has fewer, so that none is left out.
ROWS = 64_000
#: Bytes of context, and languages whose contexts share a table.
ORDER, GROUP = 3, 32
_BLANK = 32


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every byte with its ORDER bytes of context, packed, the byte itself lowest; before a text there are blanks."""
    code = np.zeros(len(data), np.uint32)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(ORDER, -1, -1):
        s = np.full(len(data), _BLANK, np.uint32)
        s[back:] = data[: len(data) - back] if back else data
        if back:
            s[place < back] = _BLANK
        code = code << np.uint32(8) | s
    return code


def _count(part: pa.RecordBatch) -> pa.RecordBatch:
    langs = part.column("lang").to_numpy(zero_copy_only=False)
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
    for lang in np.unique(langs):
        data, offsets = text_bytes(part.filter(pa.array(langs == lang)).column("text"))
        codes, n = np.unique(_grams(data, offsets), return_counts=True)
        out.append((np.full(len(codes), lang, np.int32), codes, n))
    lang, code, n = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])


class Lookup:
    """Places of sorted distinct numbers, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            self.slots[at] = left[free][first]
            rest = self.slots[slot] != left
            left, slot = left[rest], (slot[rest] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slot(keys)
        out = self.slots[slot].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.last
            at = self.slots[slot]
            out[todo] = at
            more = (at >= 0) & (self.keys[np.maximum(at, 0)] != keys[todo])
            todo, slot = todo[more], slot[more]
        return out


class Trees:
    """Context trees of some languages: code lengths of the bytes that followed each context, and costs of escapes.

    Escapes by method C: a context seen n times with d next bytes gives one seen c times c / (n + d), and
    passes d / (n + d) on to its longest proper suffix; below the empty context bytes are equally
    likely. A context that was never seen passes on for nothing. Only what occurs in some language is kept.
    """

    def __init__(self, lang: np.ndarray, code: np.ndarray, n: np.ndarray, languages: int):
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        lower = None
        for k in range(ORDER + 1):
            keys, at = np.unique(code & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(at * languages + lang, weights=n, minlength=len(keys) * languages).reshape(-1, languages)
            context = keys >> np.uint32(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            total, kinds = (np.add.reduceat(x, first, axis=0) if len(keys) else c for x in (c, (c > 0).astype(float)))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                group = np.cumsum(np.isin(np.arange(len(keys)), first)) - 1
                own = -np.log2(c / (total + kinds)[group])
            passed = escape[group] + (lower[1][lower[0].find(keys & np.uint32((1 << 8 * k) - 1))] if k else 8.0)
            bits = np.where(c > 0, own, passed)
            lower = Lookup(keys), bits
            self.grams.append(lower[0])
            self.bits.append(bits.astype(np.float32))
            self.contexts.append(Lookup(context[first]))
            self.escapes.append(escape)

    def rare(self, codes: np.ndarray) -> np.ndarray:
        """Bits of bytes in contexts that no language has seen together."""
        out = np.zeros((len(codes), self.bits[0].shape[1]))
        left = np.arange(len(codes))
        for k in range(ORDER, -1, -1):
            gram = codes[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = self.grams[k].find(gram)
            out[left[at >= 0]] += self.bits[k][at[at >= 0]]
            left, gram = left[at < 0], gram[at < 0]
            context = self.contexts[k].find(gram >> np.uint32(8))
            out[left[context >= 0]] += self.escapes[k][context[context >= 0]]
        out[left] += 8.0
        return out

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        at = self.grams[ORDER].find(codes)
        bits = self.bits[ORDER][at]
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, back = np.unique(codes[new], return_inverse=True)
            bits[new] = self.rare(distinct)[back]
        return bits


class Model:
    """Frozen statistics: languages, and how often each byte followed each context in each of them."""

    def __init__(self, langs: list[str], counts: pd.DataFrame):
        self.langs = langs
        self.lang, self.code, self.n = counts["lang"].to_numpy(np.int32), counts["code"].to_numpy().astype(np.uint32), counts["n"].to_numpy(np.int64)
        self.key = hash((tuple(langs), self.lang.tobytes(), self.code.tobytes(), self.n.tobytes()))

    def trees(self) -> list[Trees]:
        out = []
        for lo in range(0, len(self.langs), GROUP):
            own = (self.lang >= lo) & (self.lang < lo + GROUP)
            out.append(Trees(self.lang[own] - lo, self.code[own], self.n[own], min(GROUP, len(self.langs) - lo)))
        return out

    def plain(self) -> np.ndarray:
        """Bits of each byte by its share of all bytes learned, whatever the language and context."""
        n = np.bincount(self.code & np.uint32(255), weights=self.n, minlength=256) + 1
        return -np.log2(n / n.sum())


def learn(docs: DataFrame, per_language: int = SAMPLE, rows: int = ROWS) -> Model:
    """A model from text and lang of docs whose crc32(doc_id as text) mod 3 is not 1.

    It learns every value of lang from a sample of at most `rows` documents: per_language of each, or as many as leave room for all
    (one each of the most frequent ones, ties to the one that sorts first, if there are more values than rows). They are those that
    come first by a hash of doc_id and text, and are read whole; equal rows count once. Rows without lang, doc_id or any letter are not learned
    from; with none left there are no languages.
    """
    some = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    fit = some.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    fit = fit.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    many = fit.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(rows).collect()  # no more than are learned from
    langs = sorted(r.lang for r in many)
    if not langs:
        return Model([], pd.DataFrame({"lang": [], "code": [], "n": []}))
    each, number = max(1, min(per_language, rows // len(langs))), {x: i for i, x in enumerate(langs)}
    # hashes spread evenly, so the first ones lie below this; only about four times as many rows are ranked
    pick = docs.sparkSession.createDataFrame([(r.lang, number[r.lang], max(r.least, (2**63 - 1) * min(r.n, 4 * each) // r.n)) for r in many], "lang string, number int, upto long")
    pick = F.broadcast(pick)
    ids = fit.join(pick, "lang").where("h <= upto").select("doc_id", "lang", "h", "number").distinct()
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = ids.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).drop("k")
    sample = fit.join(F.broadcast(ids), ["doc_id", "lang", "h"]).dropDuplicates(["doc_id", "lang", "h"])  # `rows` ids at most
    sample = sample.select(F.col("number").alias("lang"), F.lower("text").alias("text"))
    counts = sample.mapInArrow(by_batch(_count), "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return Model(langs, counts.toPandas())  # bounded by the sample


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


_TREES: dict[int, tuple[list[Trees], np.ndarray]] = {}
#: Bytes that are scored at once.
STEP = 1 << 16


def _score(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of every text in every language, and without contexts."""
    if model.key not in _TREES:
        _TREES.clear()
        _TREES[model.key] = model.trees(), model.plain()
    trees, plain = _TREES[model.key]
    totals, plains = [], []
    batch = pa.RecordBatch.from_arrays([text], names=["text"])
    for part in chunks(batch) if batch.num_rows else ():
        data, offsets = text_bytes(part.column("text"))
        codes = _grams(data, offsets)
        total = np.zeros((part.num_rows, len(model.langs) + 1))
        row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
        step = max(256, min(STEP, (STEP << 7) // len(model.langs)))  # the fewer, the more languages
        for at in range(0, len(data), step):
            rows = row[at : at + step]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            bits = [t.lengths(codes[at : at + step]) for t in trees] + [plain[data[at : at + step], None]]
            sums = [np.add.reduceat(b, first, axis=0, dtype=np.float64) for b in bits]
            total[rows[first]] += np.concatenate(sums, axis=1)
        totals.append(total[:, :-1])
        plains.append(total[:, -1])
    return (np.concatenate(totals), np.concatenate(plains)) if totals else (np.zeros((0, len(model.langs))), np.zeros(0))


def predict(model: Model, text: Column) -> Column:
    """A struct of lang_pred, score and gain for a text column.

    lang_pred is the language whose context tree codes the whole text in the fewest bits, ties to the
    language that sorts first; score is its share when each language weighs 2 ** -bits; gain is the share
    of bits that it saves against bytes coded without contexts or language, and below 0 where it saves
    none. A null text, one without a letter, or a model without languages gives `und`, 0 and 0.
    """
    kind = "lang_pred string, score double, gain double"
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("gain"))
    if not model.langs:
        return none

    @F.arrow_udf(kind)
    def scored(column: pa.Array) -> pa.Array:
        total, plain = _score(model, column)
        least = total.min(axis=1)
        share = 1 / np.exp2(-np.minimum(total - least[:, None], 1000)).sum(axis=1)
        gain = 1 - least / np.maximum(plain, 1e-9)
        names = pa.array(model.langs, pa.string()).take(pa.array(total.argmin(axis=1)))
        return pa.StructArray.from_arrays([names, pa.array(share, pa.float64()), pa.array(gain, pa.float64())], names=["lang_pred", "score", "gain"])

    text = text.cast("string")
    ok = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = scored(F.when(ok, F.lower(text)))
    return F.when(ok, found).otherwise(none)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs; see predict() for odd texts.

    A null doc_id stays null and is not held out. Other columns are ignored.
    """
    p = predict(model, F.col("text"))
    return docs.select(F.col("doc_id").cast("long"), p.alias("p")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def reject_unknown(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of docs whose language is recognised; columns stay.

    That is: a language is predicted with a score of at least `least`, and its contexts code the text in
    fewer bits than bytes by themselves, which they don't for random letters, codes or a language that was
    not learned. Null, blank and letterless texts go. Rows are judged one by one, so repeated rows agree.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = docs.select(every.alias("row"), predict(model, F.col("text")).alias("p"))
    return judged.where((F.col("p.lang_pred") != "und") & (F.col("p.score") >= least) & (F.col("p.gain") > 0)).select("row.*")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
