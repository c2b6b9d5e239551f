"""Merges that write changed buckets only, pages by ranges, and traces dealt into runs."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import paging, traces
from ledgerloom.sources.store import BUCKET, Store

ROW = "id long, kind string, name string, first string, note string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merges_write_changed_buckets_only(spark, tmp_path):
    store = Store(f"{tmp_path}/t", ("id", "kind"), 8)
    old = [(i, "a", f"n{i}", "f", None) for i in range(100)] + [(None, "a", "null id", "f", "x"), (1, None, "null kind", "f", None), (5, "a", "zz twice", "f", None)]
    store.create(spark.createDataFrame(old, ROW))
    assert store.read(spark).count() == 102
    before = files(store.path)
    new = spark.createDataFrame([(3, "a", "renamed", "other", None), (None, "a", "still null", "o", None), (1, None, "null kind", "o", None), (500, "a", "new", "n", "note")], ROW)
    counts = store.merge(new, ["name"], ["first"], ["note"])
    assert counts == {"created": 1, "updated": 2, "equal": 1}
    after = files(store.path)
    got = {(r.id, r.kind): (r.name, r.first, r.note) for r in store.read(spark).collect()}
    assert got[3, "a"] == ("renamed", "f", None) and got[None, "a"] == ("still null", "f", "x") and got[500, "a"] == ("new", "n", "note") and got[1, None] == ("null kind", "f", None)
    assert len(got) == 103 and got[5, "a"][0] == "n5"
    dirty = {f"{BUCKET}={b}" for b in store.touched(new.where("kind is not null"))}
    assert {p for p in before if not any(f"/{d}/" in p for d in dirty)} <= set(after)
    assert {p for p in set(after) - set(before)} and all(any(f"/{d}/" in p for d in dirty) for p in set(after) - set(before))
    # a replayed batch changes nothing
    assert store.merge(new, ["name"], ["first"], ["note"]) == {"created": 0, "updated": 0, "equal": 4}
    assert files(store.path) == after


def test_adding_and_deleting(spark, tmp_path):
    store = Store(f"{tmp_path}/t", ("id", "kind"), 4)
    store.create(spark.createDataFrame([(i, "a", "n", "f", None) for i in range(6)], ROW))
    new = spark.createDataFrame([(5, "a", "ignored", "f", None), (6, "a", "added", "f", None), (6, "a", "added", "f", None)], ROW)
    assert store.add(new) == 1 and store.add(new) == 0
    assert {r.id: r.name for r in store.read(spark).collect()} == {i: "n" if i < 6 else "added" for i in range(7)}
    bucket = store.touched(spark.createDataFrame([(6, "a")], "id long, kind string"))
    all_of_it = store.read(spark, bucket)
    n = all_of_it.count()
    assert store.delete(all_of_it.select("id", "kind").union(spark.createDataFrame([(99, "z")], "id long, kind string"))) == n
    assert store.read(spark).count() == 7 - n
    assert store.delete(spark.createDataFrame([(99, "z")], "id long, kind string")) == 0
    plan = store.read(spark, [0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or f"PartitionFilters: [({BUCKET}" in plan or BUCKET in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_pages_equal_a_sorted_list(spark):
    r = random.Random(6)
    data = [(i, r.choice([None, *range(40)])) for i in range(2500)]
    df = spark.createDataFrame(data, "id long, p long").repartition(5)
    pages = paging.paged(df, [F.desc_nulls_last("p"), F.col("id")], 200)
    want = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert pages.total == 2500 and len(pages.starts) > 5
    for number, size in ((1, 50), (7, 50), (2, 333), (50, 50), (51, 50), (0, 10), (1, 5000)):
        assert [tuple(x) for x in pages.page(number, size).collect()] == (want[(number - 1) * size : number * size] if number else [])
    assert paging.paged(df.where("false"), [F.col("id")]).page(1, 10).count() == 0
    assert paging.paged(df.where("false"), [F.col("id")]).total == 0


def test_runs_equal_a_loop_however_events_are_dealt(spark):
    r, t0 = random.Random(3), datetime(2024, 1, 1)
    data = [(r.choice([1, 1, 1, 2, 3, 4]), t0 + timedelta(minutes=r.randrange(9000)), i, r.choices([*traces.STAGES, "START", "END", None], [9] * 6 + [2, 2, 1])[0]) for i in range(900)]
    data += [(None, t0, 1000, "WRITE"), (5, None, 1001, "WRITE"), (6, t0, 1002, "END")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = traces.trace_events(spark.createDataFrame(data, "document_id long, ts timestamp, seq long, stage string").repartition(5), "25 minutes")
        got = {r.seq: (r.run, r.place) for r in out.collect()}
        chunks = traces.nested(out, ["seq"], 4).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, {}
    for d, ts, seq, stage in sorted((x for x in data if x[0] and x[1]), key=lambda x: (x[0], x[1], x[2])):
        before, prior, run, place = last.get(d, (None, None, 0, 0))
        new = before is None or stage == "START" or prior == "END" or ts > before + timedelta(minutes=25)
        run, place = (run + 1, 1) if new else (run, place + 1)
        want[seq], last[d] = (run, place), (ts, stage, run, place)
    assert got == want
    assert max(len(c.events) for c in chunks) <= 4 and sorted(e.seq for c in chunks for e in c.events) == sorted(want)
