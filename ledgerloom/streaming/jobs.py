"""Job states and cached answers in a stream, with state in Spark's store (extensions: the same results as the batch operators).

Both need spark.sql.streaming.stateStore.providerClass to be the RocksDB provider (PROVIDER).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.histories import JOBS, Machine, advance

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "status string, retry_count int, max_retries int, actions long, admitted long, due long, columns map<string,string>"


class _Jobs(StatefulProcessor):
    """A value state for each job, and an event-time timer for the time that it is scheduled for."""

    def __init__(self, machine: Machine, kind: str, retries: int):
        self.machine, self.kind, self.retries = machine, kind, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def _read(self) -> dict:
        if not self.job.exists():
            return {"status": self.machine.states[0], "retry_count": 0, "max_retries": self.retries, "actions": 0, "admitted": 0, "due": None, "columns": {}}
        names = [c.split(" ")[0] for c in _STATE.split(", ")]
        state = dict(zip(names, self.job.get(), strict=True))
        return state | {"columns": dict(state["columns"] or {})}

    def _write(self, state: dict) -> None:
        self.job.update(tuple(state.values()))

    def _row(self, key, state: dict, event: str) -> pd.DataFrame:
        times = {c for s in self.machine.steps.values() for c, v in s.sets.items() if v == "ts"}
        columns = {c: state["columns"].get(c) for c in self.machine.columns}
        columns = {c: pd.Timestamp(int(v), unit="us") if c in times and v is not None else v for c, v in columns.items()}
        head = {"key": key[0], "event": event, "status": state["status"], "retry_count": state["retry_count"], "actions": state["actions"], "admitted": state["admitted"]}
        return pd.DataFrame({k: pd.Series([v], dtype="datetime64[us]" if k in times else object) for k, v in (head | columns).items()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._read()
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for row in batch.itertuples(index=False):
            state["actions"] += 1
            ts = int(pd.Timestamp(row.ts).value // 1000)
            if row.action == "schedule":
                self._schedule(state, row.due)
                continue
            left = max(state["max_retries"] - state["retry_count"], 0)
            to = advance(self.machine, state["status"], left, row.action, ts, row.value)
            if to is not None:
                state["status"], state["retry_count"] = to[0], state["retry_count"] + left - to[1]
                state["columns"] |= {c: None if v is None else str(v) for c, v in to[2].items()}
                state["admitted"] += 1
        self._write(state)
        yield self._row(key, state, "changed")

    def _schedule(self, state: dict, due) -> None:
        if state["due"] is not None:
            self.handle.deleteTimer(state["due"])
        state["due"] = None if pd.isna(due) else int(pd.Timestamp(due).value // 1_000_000)
        if state["due"] is not None:
            self.handle.registerTimer(state["due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._read()
        state["due"] = None
        self._write(state)
        if state["status"] == self.machine.states[0]:
            yield self._row(key, state, "due")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        columns = {c: None if pd.isna(row[c]) else str(int(pd.Timestamp(row[c]).value // 1000)) if isinstance(row[c], pd.Timestamp) else str(row[c]) for c in self.machine.columns if c in initialState}
        self._write({"status": row["status"], "retry_count": int(row["retry_count"]), "max_retries": int(row["max_retries"]), "actions": 0, "admitted": 0, "due": None, "columns": columns})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, key: str, initial: DataFrame | None = None, machine: Machine = JOBS, retries: int = 3, late: str = "1 hour") -> DataFrame:
    """Changes of jobs as their events (key, ts, seq, action, value, due) come in: the state after each batch of a key.

    event is `changed`, or `due` where the watermark passes the time that a `schedule` action gave (due) and the job still waits. Events of a
    batch are applied in order of ts and seq, batches in order of arrival, so that a stream in order gives what
    histories.replay() gives. Events that are late beyond the watermark are dropped. initial: jobs before the stream
    (status, retry_count, max_retries and the machine's columns); other jobs begin in the first state with `retries`.
    """
    kind = dict(events.dtypes)[key]
    times = {c for s in machine.steps.values() for c, v in s.sets.items() if v == "ts"}
    out = f"key {kind}, event string, status string, retry_count int, actions long, admitted long, " + ", ".join(f"{c} {'timestamp' if c in times else 'string'}" for c in machine.columns)
    stream = events.select(F.col(key).alias("key"), "ts", "seq", "action", F.col("value").cast("string").alias("value"), "due").where("key is not null").withWatermark("ts", late)
    before = None if initial is None else initial.withColumnRenamed(key, "key").groupBy("key")
    return stream.groupBy("key").transformWithStateInPandas(_Jobs(machine, kind, retries), out, "Update", "EventTime", before).withColumnRenamed("key", key)


class _Answers(StatefulProcessor):
    """The answer of each key, forgotten after a time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "answer string, hits long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for row in batch.sort_values("seq", kind="stable").itertuples(index=False):
                known = self.answer.get() if self.answer.exists() else None
                given = None if pd.isna(row.answer) else row.answer
                if given is not None:  # a new answer replaces the old one, and its time begins anew
                    self.answer.update((given, 0))
                elif known is not None:
                    self.answer.update((known[0], known[1] + 1))
                found = given if given is not None else known[0] if known is not None else None
                yield pd.DataFrame({"cache_key": pd.Series([key[0]], dtype=object), "seq": [row.seq], "answer": pd.Series([found], dtype=object), "hit": [given is None and known is not None]})

    def close(self) -> None:
        pass


def cached_answers(requests: DataFrame, keep: str = "30 days") -> DataFrame:
    """What a cache says to each request (cache_key, seq, answer): a given answer is kept, an asked one (null) is looked up.

    Entries are dropped by the store when they have not been written for as long as `keep`, by processing time. Such state asks for batches
    as time goes by: run it with a processing-time trigger, as availableNow would not end.
    """
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    stream = requests.select("cache_key", "seq", "answer").where("cache_key is not null")
    return stream.groupBy("cache_key").transformWithStateInPandas(_Answers(ms), "cache_key string, seq long, answer string, hit boolean", "Append", "ProcessingTime")
