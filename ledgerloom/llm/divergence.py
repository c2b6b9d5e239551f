"""Source divergence audit: how much the words of each source of a language differ from its other sources and from all of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, checkpoint, table, text_bytes

#: Documents of its language that hold a term that is kept; count added to each; parts of which a share is counted; terms of a group that are told.
DOCUMENTS, ADDED, PARTS, TOLD = 30, 5, 1_000_000_000, 50
#: Bytes of text that are handled at once; counts of terms that a matrix holds, about.
CHUNK, ENTRIES = 8 << 20, 1 << 17

#: The byte of a term that each byte stands for: A-Z count as a-z, other ASCII parts terms and is 0, all else stands for itself.
_TERM = np.zeros(256, np.uint8)
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as terms have them, and where each term starts and ends; terms end with their text."""
    low = _TERM[data]
    inside = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return low, np.flatnonzero(start), np.flatnonzero(end) + 1


def _equal(low: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the slices at starts and others have the same bytes, length by length."""
    out = np.ones(len(starts), bool)
    for at in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > at)
        out[live] &= low[starts[live] + at] == low[others[live] + at]
        if at >= 64:  # few are this long: compare them whole
            live = live[out[live]]
            out[live] = [bool((low[s : s + n] == low[o : o + n]).all()) for s, o, n in zip(starts[live], others[live], lengths[live], strict=True)]
            break
    return out


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, the same for equal bytes only, and a slice of each number.

    Slices meet by their hash, and are compared byte by byte with the first of it; those that only share the
    hash are told apart by their bytes.
    """
    view = memoryview(low)
    hashes = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    codes, distinct = pd.factorize(hashes)
    first = np.full(len(distinct), len(codes), np.int64)
    np.minimum.at(first, codes, np.arange(len(codes)))
    lengths, mine = ends - starts, first[codes]
    same = lengths == lengths[mine]
    same[same] = _equal(low, starts[same], starts[mine[same]], lengths[same])
    clashes: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):
        key = bytes(view[starts[i] : ends[i]])
        if key not in clashes:
            clashes[key] = len(first)
            first = np.append(first, i)
        codes[i] = clashes[key]
    return codes, first


_COUNTED = "lang string, source string, term string, count long, docs long"


def _count(batches):
    """Occurrences and documents of each term of each source in a slice of a task's rows."""
    for batch in batches:
        sizes = np.nan_to_num(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(float))
        ends, i = np.cumsum(sizes), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
            yield _count_slice(batch.slice(i, j - i))
            i = j


def _count_slice(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(part.column("text"))
    low, starts, ends = slices(data, offsets)
    codes, first = grouped(low, starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    group, _ = pd.factorize(pd.MultiIndex.from_arrays([part.column("lang").to_pandas(), part.column("source").to_pandas()]))
    terms = max(1, len(first))
    # once for each document and term, then for each group and term
    each, of = pd.factorize(doc * terms + codes)
    times = np.bincount(each, minlength=len(of))
    pair, keys = pd.factorize(group[of // terms] * terms + of % terms)
    member = np.zeros(len(group), np.int64)
    member[group[::-1]] = np.arange(len(group))[::-1]
    lengths = (ends - starts)[first]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts[first] - bounds[:-1], lengths) + np.arange(bounds[-1])
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(low[at].tobytes()))
    rows = pa.array(member[keys // terms])
    return pa.RecordBatch.from_arrays(
        [part.column("lang").take(rows), part.column("source").take(rows), words.take(pa.array(keys % terms)).cast(pa.string()),
         pa.array(np.bincount(pair, weights=times, minlength=len(keys)).astype(np.int64)), pa.array(np.bincount(pair, minlength=len(keys)).astype(np.int64))],
        names=["lang", "source", "term", "count", "docs"],
    )


def share(count: str, whole: str, kept: str) -> Column:
    """1 + floor(PARTS * (count + ADDED) / (whole + ADDED * kept)), in decimals of 38 digits."""
    return (F.expr(f"CAST({PARTS} AS DECIMAL(10, 0)) * ({count} + {ADDED}) div ({whole} + {ADDED} * {kept})") + 1).cast("long")


def _distances(key, entries: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of differences of shares over the terms of a block, for each pair of sources.

    The counts that occur are a sparse matrix by rows (CSR), a row for each source; all others have their source's least share.
    """
    names = sources.column("source").to_pandas()
    order = np.argsort(names.to_numpy())
    names, none = names.to_numpy()[order], sources.column("none").to_numpy()[order]
    row = pd.Index(names).get_indexer(entries.column("source").to_pandas())
    column, terms = pd.factorize(entries.column("term").to_pandas())
    by = np.lexsort((column, row))
    column, value = column[by], entries.column("p").to_numpy()[by]
    starts = np.searchsorted(row[by], np.arange(len(names) + 1))
    width = len(terms)

    def by_row(x: np.ndarray, a: int) -> np.ndarray:
        """Sums of x, which begins with row a's first entry, for each row from a on."""
        out = np.zeros(len(names) - a, np.int64)
        full = np.flatnonzero(np.diff(starts[a:]))
        if len(full):
            out[full] = np.add.reduceat(x, starts[a:][full] - starts[a])
        return out

    base = np.repeat(none, np.diff(starts))
    left, right, value_of = [], [], []
    for a in range(len(names) - 1):
        own = slice(starts[a], starts[a + 1])
        dense = np.full(width, none[a], np.int64)
        dense[column[own]] = value[own]
        rest = slice(starts[a + 1], None)
        here = dense[column[rest]]
        there = by_row(np.abs(here - value[rest]) - np.abs(here - base[rest]), a + 1)
        # against the least share of each other source: all terms of a, from sums over its sorted shares
        s = np.sort(value[own])
        before = np.concatenate([[0], np.cumsum(s)])
        q = none[a + 1 :]
        k = np.searchsorted(s, q)
        flat = q * k - before[k] + before[-1] - before[k] - q * (len(s) - k) + (width - len(s)) * np.abs(none[a] - q)
        left.append(np.full(len(q), a))
        right.append(np.arange(a + 1, len(names)))
        value_of.append(there + flat)
    left, right, value_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, value_of))
    lang = key[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "source": pa.array(names[left], pa.string()), "item": pa.array(names[right], pa.string()), "value": pa.array(value_of, pa.int64())})


def divergence(docs: DataFrame, documents: int = DOCUMENTS, told: int = TOLD, entries: int = ENTRIES) -> DataFrame:
    """lang, source, part, item, value and rank: distances of sources, and the terms that a source has beyond its language's share.

    Null lang, source and text are ''. Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language
    keeps those in enough of its documents. A share is 1 + floor(10^9 (count + 5) / (N + 5 V)), N of all
    kept terms of the source or language, V their number, in whole numbers throughout. Part `pair`: each
    other source of the language, the sum of differences over all kept terms, 0 where there is none; the
    source itself, if alone, has no row. Part `term`: the terms of the source whose share is above the
    language's, most first, up to `told` (50). Ranks run from 1, largest value first, ties in order of UTF-8. Rows that repeat
    count each time. An empty table gives an empty frame; other columns are ignored.

    Counts are summed in tasks before they are shuffled by language and term. A language's terms are dealt into
    blocks of about `entries` counts, so that no language, hot or not, is one task's; each block gives partial sums of all pairs.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    found = rows.mapInArrow(_count, _COUNTED).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = checkpoint(
        found.withColumns({"in_docs": F.sum("docs").over(term), "all": F.sum("count").over(term), "nth": F.row_number().over(term.orderBy("source"))})
        .where(F.col("in_docs") >= documents).select("lang", "source", "term", "count", "all", (F.col("nth") == 1).cast("long").alias("first"))
    )
    counts = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("first").alias("firsts"), F.count("*").alias("entries"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = rows.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").select("lang", "source", zero("n"), zero("firsts"), zero("entries"))
    lang = Window.partitionBy("lang")
    groups = checkpoint(groups.withColumns({"v": F.sum("firsts").over(lang), "whole": F.sum("n").over(lang), "blocks": F.greatest(F.lit(1), F.ceil(F.sum("entries").over(lang) / entries)).cast("int")}).drop("firsts", "entries"))
    few = groups.count() <= BROADCAST_IDS // 8
    each = kept.join(F.broadcast(groups) if few else groups, ["lang", "source"]).select(
        "lang", "source", "term", F.pmod(F.hash("term"), "blocks").alias("block"), share("count", "n", "v").alias("p"), share("`all`", "whole", "v").alias("q")
    )
    sides = groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.when(F.col("v") > 0, share("0", "n", "greatest(v, 1)")).otherwise(F.lit(0)).alias("none"))
    sums = each.select("lang", "block", "source", "term", "p").groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(
        _distances, "lang string, source string, item string, value long"
    ).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s"), "value").select("lang", "s.*", "value")
    terms = each.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= told))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.whole FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (
  SELECT lang, source, term, n,
         1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
         1 + 1000000000::HUGEINT * (whole + 5) // (sum(whole) OVER s + 5 * count(*) OVER s) AS q
  FROM f WINDOW s AS (PARTITION BY lang, source)
),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM t a JOIN t b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM k)
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM t WHERE n > 0 AND p > q
),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
