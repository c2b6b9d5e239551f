"""Helpers shared by the training-data operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint, discard, release, ship, stored  # noqa: F401  some for the operators

#: White space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which an id list (one long each) is broadcast: 32 MB at most.
BROADCAST_IDS = 2_000_000
#: Edges of a graph that one task takes in a round of components().
EDGES = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_ids(df: DataFrame, ids: DataFrame, how: str, n_ids: int | None = None) -> DataFrame:
    """Join with a table of ids (all its columns are the key); broadcast it only if its counted size is small."""
    n = ids.count() if n_ids is None else n_ids
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, ids.columns, how)


def running_totals(rows: DataFrame, bucket: list[str], order: list, sums: dict[str, str], within: list[str] | None = None, totals: bool = False) -> DataFrame:
    """Adds exclusive running totals over a total order that starts with the bucket.

    Each bucket is summed by its own window; a small table with a row for each bucket gives the
    offsets. sums: output column to summed column. within: columns of the bucket at which totals begin
    anew. totals: also add the whole total of each sum, as total_<name>.
    """
    within = within or []
    own = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*bucket).agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = Window.partitionBy(*within).orderBy(*[c for c in bucket if c not in within]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(
        *[F.col(c).alias(f"__b_{c}") for c in bucket],
        *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums],
        *[F.sum(f"__{k}").over(Window.partitionBy(*within)).alias(f"total_{k}") for k in sums if totals],
    )
    out = rows.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(k) for k, c in sums.items()])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in bucket])
    return out.join(offsets, same).select(
        *rows.columns, *[(F.col(k) + F.col(f"__{k}")).cast("long").alias(k) for k in sums], *[f"total_{k}" for k in sums if totals]
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): (id, label), label the least id of the component.

    Large-star and small-star rounds until the edges are stars: each joins the edges with one minimum per
    node, so no node's neighbours are ever gathered. Each round is cut by a checkpoint in the shared folder.
    """
    def stars(e: DataFrame) -> bool:
        """Whether each edge leads from a node that has no other to one that has none."""
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
        return not fewer(ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1")).take(1)

    def turn(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = fewer(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = fewer(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        return checkpoint(fewer(small.union(fewer(low.select("u", F.col("m").alias("v")))).distinct()))

    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tasks = 1 + e.count() // EDGES  # the edges of later rounds are no more
    fewer = lambda df: df.coalesce(tasks)
    e = fewer(e)
    while not stars(e):
        e = turn(e)
        release(e.sparkSession)
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )


# --- words of whole texts as numbers, inside tasks ---------------------------------------------

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_P = U(0x2545F4914F6CDD1D)
_P_INV = U(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
#: Bytes of text handled at once in a task.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _STEP)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, p)])) for p in (_P, _P_INV)]
    return _POWERS[0], _POWERS[1]


def chunks(batch: pa.RecordBatch, text: str = "text"):
    """Slices of a batch of about CHUNK bytes of text, at least one row each."""
    sizes = np.nan_to_num(pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float))
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
        yield batch.slice(i, j - i)
        i = j


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets of each; nulls are empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z lower-cased, and the offsets of each text's words."""
    data, offsets = text_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    prior = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~prior | first[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    power, inverse = _powers(n + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * power[:n], dtype=U)])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U) * _STEP), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, with offsets; a shorter text is one shingle, an empty one none."""
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.cumsum(counts)
    out_offsets = np.concatenate([[0], ends])
    first = np.repeat(offsets[:-1] - out_offsets[:-1], counts) + np.arange(out_offsets[-1])
    h = np.zeros(len(first), U)
    limit = np.repeat(offsets[1:], counts)
    for j in range(k):
        at = first + j
        here = at < limit
        h = np.where(here, h * _P + words[np.minimum(at, max(len(words) - 1, 0))] + _STEP, h) if len(words) else h
    return mix(h + U(k)), out_offsets


def by_batch(fn):
    """A mapInArrow function from one on chunks of batches."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            for part in chunks(batch) if batch.num_rows else ():
                yield fn(part)

    return run


def lists(rows: np.ndarray) -> pa.Array:
    """A list array of the rows of a matrix of longs."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))
