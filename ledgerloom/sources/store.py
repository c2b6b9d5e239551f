"""Tables that merges rewrite in part: rows are dealt into buckets by a hash of their key, and only buckets with changes are written."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sync import upsert
from ..session import checkpoint

BUCKET = "__bucket"


@dataclass(frozen=True)
class Store:
    """A folder of Parquet in one folder for each bucket. One writer at a time; readers see whole buckets.

    key: columns that name a row; null values are values. buckets: choose them so that one is a few files of some hundred MB.
    """

    path: str
    key: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame) -> None:
        """Write all rows of some buckets in place of what these buckets hold; a bucket that is not among them stays as it is."""
        dealt = rows.withColumn(BUCKET, self.bucket()).repartition(self.buckets, BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """A new table of rows, whatever was there; of rows with one key the first by all columns stays."""
        rest = [c for c in rows.columns if c not in self.key]
        once = rows.groupBy(*self.key).agg(F.min(F.struct(*rest)).alias("__r")).select(*self.key, "__r.*").select(rows.columns)
        once.withColumn(BUCKET, self.bucket()).repartition(self.buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self.path)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it: other folders are not listed as input."""
        df = spark.read.parquet(self.path)
        return (df if buckets is None else df.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def merge(self, new: DataFrame, replace: list[str], keep: list[str] = (), fill: list[str] = ()) -> dict[str, int]:
        """Merge new rows as sync.upsert() does; returns how many rows were created, updated and left equal.

        Only buckets of new rows are read, and of these only those are written in which a row changes. So a batch that is merged again
        writes nothing, and a merge that broke off can be run again: buckets are replaced one by one, each whole.
        """
        spark = new.sparkSession
        new = checkpoint(new)
        old = self.read(spark, self.touched(new))
        columns = old.columns
        before = old.select(*self.key, F.struct(*[F.col(c) for c in columns if c not in self.key]).alias("__was"))
        # keys are joined null-safe: a null key column is coded as a pair
        coded = lambda df: df.withColumns({f"__k{i}": F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))) for i, c in enumerate(self.key)} | {"__o": F.lit(0)})
        keys = [f"__k{i}" for i in range(len(self.key))]
        merged = upsert(coded(old), coded(new), keys, ["__o", *replace], list(keep), [*fill, *self.key])
        was = coded(before).select(*keys, "__was")
        is_new = F.col("__was").isNull()
        same = F.struct(*[F.col(c) for c in columns if c not in self.key]).eqNullSafe(F.col("__was"))
        out = checkpoint(merged.join(was, keys, "left").withColumn("change", F.when(is_new, "created").when(same, "equal").otherwise("updated")).select(*columns, "change"))
        dirty = self.touched(out.where("change <> 'equal'"))
        if dirty:
            self._put(out.where(self.bucket().isin(dirty)).drop("change"))
        fresh = coded(new).select(*keys).distinct()
        counts = {r.change: r.n for r in coded(out).join(fresh, keys, "left_semi").groupBy("change").agg(F.count("*").alias("n")).collect()}
        return {k: counts.get(k, 0) for k in ("created", "updated", "equal")}

    def add(self, new: DataFrame) -> int:
        """Rows whose key the table does not hold yet are added, the first of each key; returns how many."""
        rest = [c for c in new.columns if c not in self.key]
        first = new.groupBy(*self.key).agg(F.min(F.struct(*rest)).alias("__r")).select(*self.key, "__r.*")
        return self.merge(first, [], rest)["created"]

    def delete(self, gone: DataFrame) -> int:
        """Take away the rows of some keys; returns how many. A bucket that loses all its rows keeps an empty file."""
        spark = gone.sparkSession
        gone = checkpoint(gone.select(*self.key).distinct())
        old = checkpoint(self.read(spark, self.touched(gone)))
        same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in self.key])
        hit = checkpoint(old.alias("o").join(gone.alias("g"), same, "left_semi"))
        dirty = self.touched(hit)
        if not dirty:
            return 0
        left = old.alias("o").join(gone.alias("g"), same, "left_anti").where(self.bucket().isin(dirty))
        empty = [b for b in dirty if b not in self.touched(left)]
        self._put(left)
        for b in empty:  # a dynamic overwrite leaves folders alone that it has no rows for
            old.where("false").write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={b}")
        return hit.count()
