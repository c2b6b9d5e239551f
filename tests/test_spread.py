"""Work for each row is dealt over all cores, and what pages send to the driver is bounded."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import paging
from ledgerloom.plans import registry


@pytest.mark.parametrize("name", ["ocr_receipts", "ocr_layouts", "einvoice_fields", "invoice_lines", "extraction_json"])
def test_rows_are_dealt_over_all_cores(spark, name):
    parts = registry.queries()[name](spark, "/root/testdata/sf0.001").withColumn("part", F.spark_partition_id())
    assert parts.select("part").distinct().count() >= spark.sparkContext.defaultParallelism


def test_ranges_of_pages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(paging, "RANGES", 3)
    pages = paging.paged(spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k")), [F.col("k"), F.col("id")], 10)
    want = sorted(range(1000), key=lambda i: (i % 7, i))
    assert len(pages.starts) <= 3 and pages.total == 1000
    for number in (1, 2, 33, 50, 51):
        assert [r.id for r in pages.page(number, 20).collect()] == want[(number - 1) * 20 : number * 20]
