"""Ordered histories of actions: loops over random histories, cuts anywhere, a hot key, and the same in a stream with a restart."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import histories as H
from ledgerloom.streaming import jobs as J

T0 = datetime(2024, 1, 1)
RECORD = "document_id long, status string, retry_count int, max_retries int, started_at timestamp, completed_at timestamp, error string, result string"
EVENT = "document_id long, ts timestamp, seq long, action string, value string, due timestamp"


def made(n_keys=12, n=400, seed=4):
    r = random.Random(seed)
    records = [(k, r.choice([*H.JOBS.states, "ODD"] if k % 5 == 0 else H.JOBS.states), r.randint(0, 2), r.randint(0, 4), None, T0 if k % 2 else None, "old" if k % 3 else None, None) for k in range(n_keys)]
    keys = [0] * (n // 3) + [r.randrange(n_keys + 2) for _ in range(n - n // 3)]  # a third are of one key; some are unknown
    events = [(k if k % 13 else k or 0, T0 + timedelta(minutes=r.randrange(200)), i, r.choice([*H.JOBS.steps, "start", "start", "start", "complete", "nonsense"]), f"v{i}", None) for i, k in enumerate(keys)]
    return records, events


def loop(records, events):
    out = {}
    for k, status, spent, most, *columns in records:
        state = dict(zip(("started_at", "completed_at", "error", "result"), columns, strict=True))
        mine = sorted((e for e in events if e[0] == k), key=lambda e: (e[1], e[2]))
        admitted = 0
        for _, ts, _, action, value, _ in mine if status in H.JOBS.states else ():
            if action == "start" and status == "PENDING":
                status, state["started_at"] = "PROCESSING", ts
            elif action == "complete" and status == "PROCESSING":
                status, state["completed_at"], state["result"] = "COMPLETED", ts, value
            elif action in ("fail", "abort"):
                again = action == "fail" and spent < most
                status, spent = ("PENDING", spent + 1) if again else ("FAILED", spent)
                state["completed_at"], state["error"] = ts, value
            elif action == "cancel" and status in ("PENDING", "PROCESSING"):
                status, state["completed_at"] = "CANCELLED", ts
            elif action == "retry" and status == "FAILED":
                status = "PENDING"
                state["started_at"] = state["completed_at"] = state["error"] = None
            else:
                continue
            admitted += 1
        out[k] = (status, spent, *state.values(), len(mine), admitted)
    return out


COLUMNS = ["status", "retry_count", "started_at", "completed_at", "error", "result", "actions", "admitted"]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_replay_equals_a_loop_wherever_it_is_cut(spark, parts):
    records, events = made()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(events, EVENT).drop("due")
        got = H.replay(spark.createDataFrame(records, RECORD), df, "document_id", ["ts", "seq"], H.JOBS, retries=("retry_count", "max_retries")).collect()
        tasks = df.select("document_id", "ts").repartitionByRange("document_id", "ts").withColumn("p", F.spark_partition_id()).where("document_id = 0").select("p").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.document_id: tuple(r[c] for c in COLUMNS) for r in got} == loop(records, events)
    assert parts == 1 or tasks > 1  # the hot key is divided


def test_replay_of_odd_rows(spark):
    records = spark.createDataFrame([("a", "PENDING", None, None), ("b", "LINKED", "7", "x"), (None, "ORPHAN", None, None)], "id string, status string, ledger_id string, table string")
    acts = spark.createDataFrame([("a", 2, "link", "5"), ("a", 3, "orphan", None), (None, 1, "link", "1"), ("c", 1, "link", "1"), ("b", 1, "unlink", None), ("b", 2, "unlink", None)], "id string, at long, action string, value string")
    acts = acts.withColumn("at", F.timestamp_seconds("at"))
    got = {r.id: (r.status, r.ledger_id, r.actions, r.admitted) for r in H.replay(records, acts, "id", ["at"], H.LINKS).collect()}
    assert got == {"a": ("ORPHAN", None, 2, 2), "b": ("PENDING", "7", 2, 1), None: ("ORPHAN", None, 0, 0)}
    none = H.replay(records, acts.where("false"), "id", ["at"], H.LINKS)
    assert {(r.id, r.status, r.actions) for r in none.collect()} == {("a", "PENDING", 0), ("b", "LINKED", 0), (None, "ORPHAN", 0)}
    assert H.replay(records.where("false"), acts, "id", ["at"], H.LINKS).count() == 0
    many = spark.createDataFrame([("a", "PENDING", 0, 500)], "id string, status string, n int, m int")
    with pytest.raises(ValueError, match="500 retries"):
        H.replay(many, acts, "id", ["at"], H.JOBS, retries=("n", "m"))


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _run(spark, frame, where, what):
    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{where}/out")

    frame.writeStream.foreachBatch(keep).outputMode(what).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()


def test_a_stream_of_jobs_equals_their_history_across_a_restart(rocks, tmp_path):
    records, events = made(8, 150, 9)
    records = [r for r in records if r[1] != "ODD"]
    known = {r[0] for r in records}
    events = sorted((e for e in events if e[0] in known), key=lambda e: (e[1], e[2]))
    stream = lambda: J.job_states(rocks.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "document_id", rocks.createDataFrame(records, RECORD))
    for i in range(3):
        rocks.createDataFrame(events[i * len(events) // 3 : (i + 1) * len(events) // 3], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i:  # after two files, and again after the third
            _run(rocks, stream(), tmp_path, "update")
    rows = rocks.read.parquet(f"{tmp_path}/out")
    last = rows.groupBy("document_id").agg(F.max_by(F.struct(*COLUMNS), "batch").alias("r")).select("document_id", "r.*")
    want = {k: v for k, v in loop(records, events).items() if v[-2]}
    assert {r.document_id: tuple(r[c] for c in COLUMNS) for r in last.collect()} == want


def test_scheduled_jobs_come_due_by_event_time(rocks, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[(1, at(0), 0, "schedule", None, at(30)), (2, at(0), 1, "schedule", None, at(30)), (3, at(0), 2, "schedule", None, at(30))], [(2, at(10), 3, "start", None, None), (3, at(11), 4, "schedule", None, at(500))], [(9, at(120), 5, "start", None, None)], [(9, at(121), 6, "complete", "x", None)]]
    for b in batches:
        rocks.createDataFrame(b, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        _run(rocks, J.job_states(rocks.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), "document_id", late="1 minute"), tmp_path, "update")
    rows = rocks.read.parquet(f"{tmp_path}/out")
    assert [r.document_id for r in rows.where("event = 'due'").collect()] == [1]  # 2 has begun, 3 was put off
    assert rows.where("document_id = 9 and status = 'COMPLETED'").count() == 1


def test_cached_answers(rocks, tmp_path):
    asks = "cache_key string, seq long, answer string"
    for keep, last in (("30 days", (4, "A", True)), ("1 millisecond", (4, None, False))):
        where = tmp_path / keep.replace(" ", "")
        for n, batch in enumerate(([("k", 1, None), ("k", 2, "A"), ("k", 3, None)], [("k", 4, None), (None, 5, None)])):
            rocks.createDataFrame(batch, asks).coalesce(1).write.mode("append").parquet(f"{where}/in")
            frame = J.cached_answers(rocks.readStream.schema(asks).parquet(f"{where}/in"), keep)
            query = frame.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(processingTime="1 second").start()
            for _ in range(60):  # timed state asks for batches without end: wait for the batch with this one's rows
                time.sleep(0.5)
                if any(p["numInputRows"] for p in query.recentProgress):
                    break
            query.stop()
            assert n == 0 or query.exception() is None
        got = sorted((r.seq, r.answer, r.hit) for r in rocks.read.parquet(f"{where}/out").collect())
        assert got[:2] == [(1, None, False), (2, "A", False)]
        assert got[-1] == last
