"""Ordered histories of guarded actions: each acts on the state that it meets.

An action is a function on a small table of states. Functions of neighbouring stretches of a history compose, so a history is cut
anywhere, each stretch is summed up by itself, and only the summaries meet: no key's history is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Retries that a key may have left, at most: the table of states has a row for each.
MOST_RETRIES = 63


@dataclass(frozen=True)
class Step:
    """What an action does: from which states (none: any), to which; spends: a retry is spent if there is one, else it leads to `spent`.

    sets: columns that take the action's time or value; clears: columns that become null.
    """

    sources: tuple[str, ...] | None
    target: str
    spent: str | None = None
    sets: dict[str, str] = field(default_factory=dict)
    clears: tuple[str, ...] = ()


@dataclass(frozen=True)
class Machine:
    """States, the actions on them, and the columns that they set."""

    states: tuple[str, ...]
    steps: dict[str, Step]
    columns: tuple[str, ...]


#: The queue's states and what leads from one to another.
JOBS = Machine(
    ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED"),
    {
        "start": Step(("PENDING",), "PROCESSING", sets={"started_at": "ts"}),
        "complete": Step(("PROCESSING",), "COMPLETED", sets={"completed_at": "ts", "result": "value"}),
        "fail": Step(None, "PENDING", "FAILED", {"completed_at": "ts", "error": "value"}),
        "abort": Step(None, "FAILED", sets={"completed_at": "ts", "error": "value"}),
        "cancel": Step(("PENDING", "PROCESSING"), "CANCELLED", sets={"completed_at": "ts"}),
        "retry": Step(("FAILED",), "PENDING", clears=("started_at", "completed_at", "error")),
    },
    ("started_at", "completed_at", "error", "result"),
)
IMPORTS = Machine(
    ("PENDING", "IMPORTED", "FAILED", "DELETED"),
    {
        "success": Step(("PENDING", "IMPORTED", "FAILED"), "IMPORTED", sets={"completed_at": "ts"}, clears=("error",)),
        "failure": Step(("PENDING", "IMPORTED", "FAILED"), "FAILED", sets={"error": "value"}),
        "retry": Step(("PENDING", "IMPORTED", "FAILED"), "PENDING", clears=("error",)),
        "delete": Step(None, "DELETED"),
    },
    ("completed_at", "error"),
)
LINKS = Machine(
    ("PENDING", "LINKED", "ORPHAN"),
    {
        "link": Step(None, "LINKED", sets={"ledger_id": "value"}),
        "orphan": Step(None, "ORPHAN", clears=("ledger_id",)),
        "unlink": Step(("LINKED", "ORPHAN"), "PENDING"),
    },
    ("ledger_id",),
)


def advance(machine: Machine, status: str, left: int, action: str | None, ts: int | None, value: str | None) -> tuple[str, int, dict] | None:
    """The state and retries left after an action, and the columns it sets; None if the state does not admit it."""
    step = machine.steps.get(action)
    if step is None or (step.sources is not None and status not in step.sources):
        return None
    columns = {c: {"ts": ts, "value": value}[v] for c, v in step.sets.items()} | dict.fromkeys(step.clears)
    if step.spent is None:
        return step.target, left, columns
    return (step.target, left - 1, columns) if left else (step.spent, 0, columns)


class Stretch:
    """What a stretch of a history does to each state that it may meet: a row (status, retries left, columns set, admitted) for each."""

    def __init__(self, machine: Machine, retries: int):
        self.machine, self.retries = machine, retries
        self.rows = [[s, n, {}, 0] for s in machine.states for n in range(retries + 1)]

    def add(self, action: str | None, ts: int | None, value: str | None) -> None:
        for row in self.rows:
            if (to := advance(self.machine, row[0], row[1], action, ts, value)) is not None:
                row[0], row[1] = to[:2]
                row[2].update(to[2])
                row[3] += 1

    def table(self) -> list[tuple]:
        out = []
        for status, left, columns, admitted in self.rows:
            out.append((self.machine.states.index(status) * (self.retries + 1) + left, admitted, [c in columns for c in self.machine.columns], [None if columns.get(c) is None else str(columns[c]) for c in self.machine.columns]))
        return out


_TABLE = "array<struct<to:int,admitted:bigint,written:array<boolean>,columns:array<string>>>"
_ARROW = pa.list_(pa.struct([("to", pa.int32()), ("admitted", pa.int64()), ("written", pa.list_(pa.bool_())), ("columns", pa.list_(pa.string()))]))


def _stretches(machine: Machine, retries: int, key_type: pa.DataType):
    """The table of each key's stretch in a task, from rows sorted by key and order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stretch, first, n, out = None, None, None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["key"],):
                    if now is not None:
                        out.append((*now, first, n, stretch.table()))
                    now, stretch, first, n = (row["key"],), Stretch(machine, retries), row["place"], 0
                stretch.add(row["action"], row["ts"], row["value"])
                n += 1
            if len(out) > 1000:
                yield pack(out)
                out = []
        if now is not None:
            yield pack([*out, (*now, first, n, stretch.table())])

    def pack(rows):
        key, first, n, tables = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, key_type), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(tables, _ARROW)], names=["key", "place", "actions", "table"])

    return run


def _compose(first: Column, then: Column) -> Column:
    """The table of one stretch followed by another."""
    def row(a: Column) -> Column:
        b = F.element_at(then, a["to"] + 1)
        either = F.zip_with(
            F.arrays_zip(a["written"].alias("w"), a["columns"].alias("c")), F.arrays_zip(b["written"].alias("w"), b["columns"].alias("c")),
            lambda x, y: F.struct((x["w"] | y["w"]).alias("w"), F.when(y["w"], y["c"]).otherwise(x["c"]).alias("c")),
        )
        return F.struct(b["to"].alias("to"), (a["admitted"] + b["admitted"]).alias("admitted"), F.transform(either, lambda e: e["w"]).alias("written"), F.transform(either, lambda e: e["c"]).alias("columns"))

    return F.transform(first, row)


def replay(records: DataFrame, actions: DataFrame, key: str, order: list[str], machine: Machine, status: str = "status", retries: tuple[str, str] | None = None) -> DataFrame:
    """records after all their actions in order, with actions and admitted, their numbers; columns of the machine are set as text.

    records: a row for each key, with its status, the machine's columns, and, if retries names them, how many retries were spent and how
    many there may be. actions: key, action, value, and the columns of order, of which the first is the time, a timestamp. Actions of the same order follow each
    other by action and value. Unknown actions, actions that a state does not admit, and actions of unknown keys (null ones among them) change nothing; a
    record with an unknown status stays as it is. A key may have any number of actions.

    Actions are dealt out by ranges of key and order, so a key with many is divided. Each range gives a table for each of its
    keys: from each state, where it leads and what it sets. A key's tables, one for each task at most, are composed in order.
    """
    left = F.lit(0) if retries is None else F.greatest(F.coalesce(F.col(retries[1]) - F.col(retries[0]), F.lit(0)), F.lit(0))
    most = 0 if retries is None else records.agg(F.max(left)).first()[0] or 0
    if most > MOST_RETRIES:
        raise ValueError(f"{most} retries left; at most {MOST_RETRIES} are foreseen")
    c = F.col
    acts = actions.where(c(key).isNotNull()).select(c(key).alias("key"), *[c(o).alias(f"o{i}") for i, o in enumerate(order)], "action", c("value").cast("string").alias("value"))
    by = ["key", *[f"o{i}" for i in range(len(order))], "action", "value"]
    dealt = acts.repartitionByRange(*by).withColumn("place", F.spark_partition_id().cast("long")).sortWithinPartitions(*by)
    key_type = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[dict(acts.dtypes)["key"]]
    parts = dealt.select("key", "place", "action", F.unix_micros(c("o0").cast("timestamp")).alias("ts"), "value").mapInArrow(
        _stretches(machine, most, key_type), f"key {dict(acts.dtypes)['key']}, place long, actions long, table {_TABLE}"
    )
    whole = parts.groupBy("key").agg(F.sum("actions").alias("actions"), F.array_sort(F.collect_list(F.struct("place", "table"))).alias("parts"))
    rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    whole = whole.select("key", "actions", F.aggregate(rest, F.element_at("parts", 1)["table"], lambda a, b: _compose(a, b["table"])).alias("table"))
    at = F.array_position(F.array(*[F.lit(s) for s in machine.states]), c(status)).cast("int") - 1
    rows = records.join(whole.withColumnRenamed("key", "__key").withColumnsRenamed({"actions": "__actions", "table": "__table"}), c(key) == c("__key"), "left")
    hit = F.when((at >= 0) & c("__table").isNotNull(), F.element_at("__table", at * (most + 1) + left.cast("int") + 1))
    rows = rows.withColumn("__hit", hit)
    now = c("__hit.to")
    new = F.element_at(F.array(*[F.lit(s) for s in machine.states]), F.floor(now / (most + 1)).cast("int") + 1)
    out = {status: F.when(now.isNotNull(), new).otherwise(c(status))}
    if retries is not None:
        out[retries[0]] = F.when(now.isNotNull(), c(retries[0]) + left - now % (most + 1)).otherwise(c(retries[0])).cast(dict(records.dtypes)[retries[0]])
    times = {x for s in machine.steps.values() for x, v in s.sets.items() if v == "ts"}
    for i, x in enumerate(machine.columns):
        if x in records.columns:
            text = F.element_at("__hit.columns", i + 1)
            value = F.timestamp_micros(text.cast("long")) if x in times else text
            out[x] = F.when(F.element_at("__hit.written", i + 1), value.cast(dict(records.dtypes)[x])).otherwise(c(x))
    out |= {"actions": F.coalesce("__actions", F.lit(0)).cast("long"), "admitted": F.coalesce("__hit.admitted", F.lit(0)).cast("long")}
    return rows.withColumns(out).drop("__key", "__actions", "__table", "__hit")
