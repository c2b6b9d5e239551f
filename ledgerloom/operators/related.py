"""Pairs of distinct texts by equi-joins: one contains the other, or they share words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the runs of characters by which contained texts are looked up.
RUNS = (16, 8, 4, 2, 1)


def _runs(c: Column, size: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(c) - size + 1)
    return F.when(F.length(c) >= size, F.transform(at, lambda i: F.substring(c, i, size))).otherwise(F.array().cast("array<string>"))


def containing(whole: DataFrame, part: DataFrame) -> DataFrame:
    """(a, b) for all texts a of `whole` that contain a text b of `part`; both hold distinct texts that are not empty.

    Each b is looked up by its rarest run of characters, of the greatest length that fits, so a frequent
    run is only used where b has no other.
    """
    a, n = whole.toDF("a"), F.coalesce(*[F.when(F.length("b") >= k, k) for k in RUNS])
    lengths = sorted(r[0] for r in part.toDF("b").where("b <> ''").select(n).distinct().collect())  # runs of other lengths aren't asked for
    runs = a.select("a", F.explode(F.array_distinct(F.flatten(F.array(*[_runs(F.col("a"), F.lit(k)) for k in lengths or RUNS[:1]])))).alias("run"))
    asked = part.toDF("b").where("b <> ''").select("b", F.explode(F.array_distinct(_runs(F.col("b"), n))).alias("run"))
    often = runs.groupBy("run").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "run", "left").groupBy("b").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "run")).alias("m"))
    return rarest.where("m.often > 0").select("b", "m.run").join(runs, "run").where(F.col("a").contains(F.col("b"))).select("a", "b")


def sharing(left: DataFrame, right: DataFrame, words, tenths: int = 0) -> DataFrame:
    """(a, b) of distinct texts whose word sets may have a Jaccard similarity above tenths / 10; all that do are among them.

    words: the column of a text's distinct words. Words are ordered from rare to frequent, and only so many
    first ones are joined that a pair above the threshold must share one of them.
    """
    each = lambda df, name: df.toDF(name).select(name, F.explode(words(F.col(name))).alias("word"))
    a, b = each(left, "a"), each(right, "b")
    often = a.select("word").union(b.select("word")).groupBy("word").agg(F.count("*").alias("often"))

    def first(df: DataFrame, name: str) -> DataFrame:
        all_ = df.join(often, "word").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("w"))
        n = F.size("w") - F.floor(F.size("w") * tenths / 10).cast("int")
        return all_.select(name, F.explode(F.slice("w", F.lit(1), n)).alias("x")).select(name, "x.word")

    return first(a, "a").join(first(b, "b"), "word").select("a", "b").distinct()


def contained_either_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct texts that are equal or of which one contains the other."""
    return containing(left, right).union(containing(right, left).select("b", "a")).distinct()
