"""Nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table

#: Vectors that the codes are learned from: those least by a hash of vec_id.
SAMPLE = 4000
#: Rotations of the principal axes, and bits of a substring.
ROTATIONS, PIECE = 2, 16
#: Share of the sample's true neighbours that the Hamming radius must reach.
REACH = 0.98
#: Vectors of a block, which a task holds at once; queries that pass by one copy of it; leading bits that name a cell, at most.
BLOCK, VISITS, CELL_BITS = 1 << 15, 1 << 16, 12


def _bits(n: np.ndarray) -> np.ndarray:
    return np.bitwise_count(n)


class Codes:
    """A learned hash: mean, axes and rotations, for a given largest norm.

    Vectors get one more component that makes their norms equal, so that the largest inner product is
    the least angle; queries get zero there.
    """

    def __init__(self, x: np.ndarray, norm: float, seed: int = 0):
        self.norm = norm
        x = self._wide(x)
        self.mean = x.mean(axis=0)
        y = x - self.mean
        _, axes = np.linalg.eigh(y.T @ y)
        bits = max(PIECE, min(axes.shape[1] // PIECE * PIECE, 64))
        axes = axes[:, ::-1]
        axes = np.concatenate([axes] * -(-bits // axes.shape[1]), axis=1)[:, :bits]
        rng, turned = np.random.default_rng(seed), []
        for _ in range(ROTATIONS):
            p = y @ axes
            r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
            for _ in range(30):  # alternate signs and the best rotation towards them
                u, _, vt = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
                r = (u @ vt).T
            turned.append(axes @ r)
        self.axes = np.concatenate(turned, axis=1)

    def _wide(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Substrings of 16 bits, a row for each vector."""
        wide = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self._wide(x)
        return np.packbits((wide - self.mean) @ self.axes > 0, axis=1).view(np.uint16)


def radius_for(codes: Codes, x: np.ndarray, k: int, n: int, reach: float = REACH) -> int:
    """Hamming radius that holds this share of the sample's nearest.

    Of n vectors the k nearest are about as near as the k * sample / n nearest of the sample.
    """
    some = x[:500]
    s = some @ x.T
    s[np.arange(len(some)), np.arange(len(some))] = -np.inf
    few = int(np.clip(round(k * len(x) / max(n, 1)), 1, max(1, len(x) - 1)))
    top = np.argsort(-s, axis=1)[:, :few]
    a, b = codes.of(some, query=True), codes.of(x)
    h = _bits(a[:, None, :] ^ b[top]).sum(axis=2)
    return int(np.quantile(h, reach, method="higher"))


def thresholds(radius: int, m: int) -> list[int]:
    """Bits by which each of m substrings may differ, so that every code within the radius passes at one of them.

    If the first radius % m + 1 substrings differ by more than radius // m bits each, and the others by
    radius // m or more, then the codes differ by more than the radius. Below 0 nothing passes.
    """
    q, a = divmod(radius, m)
    return [q if j <= a else q - 1 for j in range(m)]


def matches(codes: np.ndarray, code: np.ndarray, j: int, limits: list[int], radius: int) -> np.ndarray:
    """Rows of codes within the radius whose first substring within its limit is the j-th."""
    at = np.flatnonzero(_bits(codes[:, j] ^ code[j]) <= limits[j])
    far = _bits(codes[at] ^ code)
    ok = far.sum(axis=1, dtype=np.int64) <= radius
    for i in range(j):
        ok &= far[:, i] > limits[i]
    return at[ok]


def _search(limits: list[int], radius: int, k: int):
    """Rows come sorted by block: first the vectors of a block, which are kept, then the queries that visit it, which pass by."""

    def columns(part: pa.RecordBatch):
        codes = part.column("code").flatten().to_numpy(zero_copy_only=False).astype(np.uint16).reshape(part.num_rows, -1)
        x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
        return part.column("vec_id").to_numpy(), codes, x

    def run(batches):
        block, held, ready = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("j", "cell", "sub", "part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)] if len(key) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                name, kind = tuple(key[lo, :4]), key[lo, 4]
                if name != block:
                    block, held, ready = name, [], None
                rows = columns(batch.slice(lo, hi - lo))
                if kind == 0:
                    held.append(rows)
                    continue
                if not held:
                    continue
                if ready is None:
                    ids, codes, x = [np.concatenate(c) for c in zip(*held, strict=True)]
                    ready = ids, codes, x, len(np.unique(ids)) < len(ids)
                ids, codes, x, repeated = ready
                out = []
                for own, code, v in zip(*rows, strict=True):
                    at = matches(codes, code, int(block[0]), limits, radius)
                    at = at[ids[at] != own]
                    score = (x[at] * v).sum(axis=1)
                    if len(at) > k and not repeated:
                        best = score >= np.partition(score, len(at) - k)[len(at) - k]
                        at, score = at[best], score[best]
                    order = np.lexsort((ids[at], -score))
                    _, first = np.unique(ids[at][order], return_index=True)
                    take = order[np.sort(first)[:k]]
                    out.append((np.full(len(take), own), ids[at[take]], score[take]))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    return run


def _coded(codes: Codes, query: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            c = codes.of(x, query).astype(np.int32)
            at = pa.array(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.ListArray.from_arrays(at, pa.array(c.reshape(-1)))], names=["vec_id", "embedding", "code"])

    return run


def _probe(rows: DataFrame, asked: DataFrame, radius: int, m: int, n: int, k: int) -> DataFrame:
    """The k best of the vectors within the radius of every query: (query_id, vec_id, score).

    A vector goes once into the table of each substring, into the cell of its leading bits; a query visits
    the cells whose bits differ by no more than the substring may. Cells with more than BLOCK vectors
    are dealt into blocks that a query visits all, and blocks that more than VISITS queries visit are
    copied for each so many of them.
    """
    limits = thresholds(radius, m)
    bits = min(CELL_BITS, max(0, (max(1, n) // BLOCK).bit_length()))
    shift = PIECE - bits
    at = lambda df: df.select("*", F.posexplode("code").alias("j", "piece")).withColumn("cell", F.shiftright("piece", shift)).drop("piece")
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("j") + 1)
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda c: F.bit_count(c.bitwiseXOR(F.col("cell"))) <= limit)
    table = at(rows).where(limit >= 0)
    visits = at(asked).where(limit >= 0).withColumn("cell", F.explode(near))
    # at most m * 2 ** CELL_BITS rows
    sizes = table.groupBy("j", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    loads = visits.groupBy("j", "cell").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts"))
    plan = checkpoint(sizes.join(loads, ["j", "cell"]))
    blocks = plan.agg(F.sum(F.col("subs") * F.col("parts"))).first()[0] or 0
    plan, upto = F.broadcast(plan), (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)))
    share = lambda c: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(c)).cast("int")
    out = ["j", "cell", "sub", "part", "kind", "vec_id", "code", "embedding"]
    left = table.join(plan, ["j", "cell"]).withColumn("sub", share("subs")).withColumn("part", upto("parts")).withColumn("kind", F.lit(0)).select(out)
    right = visits.join(plan, ["j", "cell"]).withColumn("part", share("parts")).withColumn("sub", upto("subs")).withColumn("kind", F.lit(1)).select(out)
    partitions = int(min(max(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1 << 14))
    dealt = left.unionByName(right).repartition(partitions, "j", "cell", "sub", "part").sortWithinPartitions("j", "cell", "sub", "part", "kind")
    found = dealt.mapInArrow(_search(limits, radius, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors found with the largest inner product.

    Both tables hold vec_id and embedding. A null vec_id, an embedding that is null, zero, holds a null
    or non-finite component, or is not as long as most takes no part. A query's own vec_id is left
    out; rows that repeat a vec_id count once, by their best score. Ties go to the smaller vec_id; with k
    candidates or fewer all are returned. Other columns are ignored.

    Codes are learned from `sample` vectors; every vector is indexed. All codes within a radius are
    retrieved by their substrings and scored on the original vectors. Queries that find fewer than k
    are asked again with a wider radius, at last with one that holds every code.
    """
    def valid(df: DataFrame) -> DataFrame:
        kind = df.schema["embedding"].dataType.simpleString()
        kind = kind if kind == "array<float>" else "array<double>"
        e = F.col("embedding").cast("array<double>")
        ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding"), F.size("embedding").alias("d")).where(F.col("vec_id").isNotNull() & ok)

    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = valid(vectors)
    norm = F.max(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda t, x: t + x * x))
    lengths = rows.groupBy("d").agg(F.count("*").alias("n"), norm.alias("norm")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return empty
    d, n, norm = lengths["d"], lengths["n"], float(np.sqrt(lengths["norm"]))
    rows, asked = rows.where(F.col("d") == d).drop("d"), valid(queries).where(F.col("d") == d).drop("d")
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # bounded by `sample`
    x = np.stack(seen["embedding"].to_numpy()).astype(np.float64)
    codes = Codes(x, norm)
    m = codes.axes.shape[1] // PIECE
    coded = lambda df, query: df.mapInArrow(_coded(codes, query), f"vec_id long, embedding {df.schema['embedding'].dataType.simpleString()}, code array<int>")
    rows, asked = checkpoint(coded(rows, False)), checkpoint(coded(asked, True))
    radius, found = radius_for(codes, x, k, n), None
    while True:
        got = checkpoint(_probe(rows, asked, radius, m, n, k))
        short = got.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
        left = checkpoint(asked.join(short, "vec_id", "left_anti"))
        more = radius < m * PIECE and bool(left.take(1))
        # the results of queries that are asked again are replaced
        done = got.join(left.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti") if more else got
        found = done if found is None else found.unionByName(done)
        if not more:
            return found.select("query_id", "rank", "vec_id", "score")
        asked, radius = left, min(m * PIECE, radius + m * PIECE // 4)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
