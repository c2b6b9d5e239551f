"""Pages of a long order without a sort of all rows in one task: a table of ranges says where a page lies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Rows of a range, about.
RANGE = 100_000
#: Ranges at most: their sizes and the rows that their limits are drawn from come to the driver. Beyond RANGES times size rows the ranges hold more.
RANGES = 1024


@dataclass
class Pages:
    """Rows dealt into ranges of an order, kept in the checkpoint folder, and the number of rows before each range."""

    rows: DataFrame
    order: list[Column]
    starts: list[tuple[int, int, int]]

    @property
    def total(self) -> int:
        return self.starts[-1][1] + self.starts[-1][2] if self.starts else 0

    def page(self, number: int, size: int) -> DataFrame:
        """The page of a number from 1 on, in order; empty beyond the last. Only the ranges that hold it are read."""
        first, last = (number - 1) * size, number * size
        hit = [(r, before) for r, before, n in self.starts if before < last and before + n > first]
        if not hit or number < 1:
            return self.rows.drop("__range").limit(0)
        some = self.rows.where(F.col("__range").isin([r for r, _ in hit]))
        return some.orderBy(*self.order).offset(first - hit[0][1]).limit(size).drop("__range")


def paged(df: DataFrame, order: list[Column], size: int = RANGE) -> Pages:
    """df for paging by an order, which should be total: end it with a key. The number of ranges follows the number of rows, up to RANGES.

    Rows are dealt out by ranges of the order, so that each page lies in one range or two neighbours; their sizes, one number
    for each range, come to the driver.
    """
    ranges = min(RANGES, max(1, -(-df.count() // size)))
    dealt = checkpoint(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    starts, before = [], 0
    for r in sorted(dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()):
        starts.append((r["__range"], before, r["n"]))
        before += r["n"]
    return Pages(dealt, order, starts)
