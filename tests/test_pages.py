"""Saved pages as a data source: all kinds, odd attributes, filters in the plan, and windows of a stream."""

import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import pages as P


def write(folder, name, *pages_):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"data": [{"id": str(i), "attributes": a} for i, a in p], "meta": {}}) for p in pages_))


@pytest.fixture
def ledger(tmp_path):
    rows = [(i, {"type": ("withdrawal", "deposit")[i % 2], "date": f"2024-01-{i + 1:02}T10:00:00+01:00", "amount": f"{i}.5", "description": f"d{i}", "tags": ["a", {"tag": "b"}]}) for i in range(20)]
    for n in range(4):
        write(tmp_path / "tx", f"page-{n}.json", rows[n * 5 : n * 5 + 3], rows[n * 5 + 3 : n * 5 + 5])
    write(tmp_path / "tx", "_SUCCESS")
    return tmp_path / "tx"


def test_filters_are_pushed_into_pages(spark, ledger):
    df = P.pages(spark, str(ledger), "transactions")
    assert df.rdd.getNumPartitions() == 4
    some = df.where("type = 'deposit' and date >= date'2024-01-05' and date < date'2024-01-15' and description <> 'd7'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "d7" in plan  # this one is left to Spark, the others are gone from its plan
    assert "deposit" not in plan
    assert "2024-01" not in plan
    assert sorted(r.id for r in some.collect()) == [5, 9, 11, 13]
    row = df.where("id = 3").first()
    assert (row.date, row.amount, row.tags, row.external_id) == (date(2024, 1, 4), Decimal("3.50"), '["a",{"tag":"b"}]', None)


def test_each_kind_has_its_columns_and_defaults(spark, tmp_path):
    for kind, schema in P.SCHEMAS.items():
        write(tmp_path / kind, "1.json", [(7, {}), (None, {"name": 5, "date": "never", "amount_min": "x", "order": "3", "active": "false", "triggers": [{"a": 1}]})])
        df = P.pages(spark, str(tmp_path / kind), kind)
        assert df.columns == [c.rsplit(" ", 1)[0] for c in schema.split(", ")]
        first, second = df.orderBy(F.col("id").desc_nulls_last()).collect()
        assert first.id == 7 and second.id is None
        for c, v in P.DEFAULTS[kind].items():
            assert first[c] == (json.dumps(v) if v == [] else v)
        if kind == "bills":
            assert (second.name, second.date, second.amount_min, second.active) == ("5", None, None, False)
        if kind == "rules":
            assert (second.order, second.triggers) == (3, '[{"a":1}]')
    (tmp_path / "none").mkdir()
    assert P.pages(spark, str(tmp_path / "none"), "bills").count() == 0


def test_a_stream_reads_each_window_once(spark, ledger, tmp_path):
    P.pages(spark, str(ledger), "transactions")
    for today in ("2024-01-10", "2024-01-10", "2024-01-20"):
        stream = spark.readStream.format("pages").option("kind", "transactions").option("since", "2024-01-03").option("today", today).load(str(ledger))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
    got = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == list(range(2, 20))
