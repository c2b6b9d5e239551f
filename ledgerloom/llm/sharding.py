"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_totals, table

SHARDS = 24
#: Rows of a range of doc_id that is summed by itself, about; points at which ids are measured; ranges that are looked up at once.
RANGE, POINTS, FANOUT = 100_000, 4096, 64


def _bounds(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Bounds of ranges of doc_id with about RANGE rows, and ids with more rows than two ranges should have.

    They only share out the work; the sums don't depend on them. POINTS values at most come to the driver.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    n, points = ids.agg(F.count("*"), F.percentile_approx("id", [k / POINTS for k in range(1, POINTS)], 8 * POINTS)).first()
    points = sorted(points or [])
    step = max(1, -(-POINTS * RANGE // max(1, n)))
    often = Counter(points)
    hot = sorted(i for i, k in often.items() if k * n > 2 * RANGE * POINTS)
    return sorted({*points[step - 1 :: step], *hot, *[i + 1 for i in hot]}), hot


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds up to doc_id, in two steps; -1 for null."""
    upto = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    groups = [bounds[k : k + FANOUT] for k in range(0, len(bounds), FANOUT)]
    first = upto(F.array(*[F.lit(g[0]) for g in groups]))
    within = upto(F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.greatest(first, F.lit(1))))
    return F.when(doc_id.isNull(), -1).otherwise(F.when(first == 0, 0).otherwise((first - 1) * FANOUT + within)).cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    The size of a row is its text's UTF-8 bytes (null: none) plus 8. Rows are ordered by doc_id (null
    first), then text_crc32 (null first), then size; rows equal in all three are interchangeable. The law
    is `bytes`: a shard is a contiguous run of that order, cut where the prefix sum at a row's middle
    passes a multiple of total / shards, so it misses the target by less than its largest row. slot is
    the place in the shard. An empty table gives no rows. Other columns are ignored.

    Prefix sums are sums within ranges of doc_id plus totals of the ranges before. Rows without a doc_id,
    and ids with very many texts, are split by text_crc32; equal rows are counted first.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    bounds, hot = _bounds(docs)
    same = rows.groupBy("doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    split = F.col("doc_id").isNull() | (F.col("doc_id").isin(hot) if hot else F.lit(False))
    sub = F.when(split, F.coalesce(F.shiftright("text_crc32", 22), F.lit(-1))).otherwise(0)
    same = same.select("*", _range_of(F.col("doc_id"), bounds).alias("part"), sub.cast("int").alias("sub"), (F.col("size") * F.col("n")).alias("bytes"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc_nulls_first(), F.col("size")]
    placed = running_totals(same, ["part", "sub"], order, {"start": "bytes", "place": "n"}, totals=True)
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    middle = (F.col("start") + F.col("k") * F.col("size")) * 2 + F.col("size")
    each = each.select(
        "doc_id", "size", "text_crc32", (F.col("place") + F.col("k")).alias("place"),
        F.least(F.lit(shards - 1), F.floor(middle * shards / (F.col("total_start") * 2))).cast("int").alias("shard"),
    )
    first = each.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return each.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write docs with their shard as Parquet, a folder for each shard.

    Rows get the shards of assign_shards(). Rows equal in doc_id, text and size may lie in two shards; each
    shard then gets as many of them as it was assigned.
    """
    c = F.col
    keys = ["doc_id", "text_crc32", "size"]
    at = assign_shards(docs, shards).groupBy(*keys, "shard").agg(F.count("*").alias("n"))
    upto = F.array_sort(F.collect_list(F.struct("shard", "n")))  # a shard once at most
    at = at.groupBy(*[c(k).alias(f"k_{k}") for k in keys]).agg(upto.alias("shards"))
    every = docs.select(F.struct(*[c(f"`{x}`") for x in docs.columns]).alias("row"), c("doc_id").cast("long").alias("doc_id"), F.crc32(c("text").cast("string").cast("binary")).alias("text_crc32"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"))
    rows = every.join(at, c("doc_id").eqNullSafe(c("k_doc_id")) & c("text_crc32").eqNullSafe(c("k_text_crc32")) & (c("size") == c("k_size")))
    one, more = rows.where(F.size("shards") == 1).select("row", c("shards")[0]["shard"].alias("shard")), rows.where(F.size("shards") > 1)
    # at most one key for each cut between shards
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("size"))
    ends = F.filter("shards", lambda s: F.aggregate(F.filter("shards", lambda x: x["shard"] <= s["shard"]), F.lit(0).cast("long"), lambda t, x: t + x["n"]) >= c("place"))
    cut = more.withColumn("place", place).select("row", ends[0]["shard"].alias("shard"))
    one.unionByName(cut).select("row.*", "shard").write.partitionBy("shard").parquet(path)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
