"""Catalogs and ledger rows from folders of saved API pages, as a data source: a partition for each file, filters before rows are made.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("kind", "bills").load("/pages/bills")

Each line of a file is a page: {"data": [{"id": ..., "attributes": {...}}, ...]}. Paths are read by Arrow's file systems, so they must be ones that
it can open (local or shared folders, s3, gs, hdfs).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta
from decimal import Decimal, InvalidOperation

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

#: The columns of each kind of page, by the names that its attributes have.
SCHEMAS = {
    "currencies": "id long, code string, name string, symbol string, decimal_places int, enabled boolean, default boolean",
    "categories": "id long, name string, notes string",
    "tags": "id long, tag string, description string",
    "piggy_banks": "id long, name string, target_amount decimal(18,2), current_amount decimal(18,2), account_id long, notes string",
    "budgets": "id long, name string, auto_budget_type string, auto_budget_amount decimal(18,2), auto_budget_period string, notes string, active boolean",
    "bills": "id long, name string, amount_min decimal(18,2), amount_max decimal(18,2), date date, repeat_freq string, skip int, active boolean, notes string, currency_code string",
    "rule_groups": "id long, title string, order int, active boolean, description string",
    "rules": "id long, title string, rule_group_id long, rule_group_title string, order int, active boolean, strict boolean, triggers string, actions string, description string",
    "recurrences": "id long, title string, first_date date, latest_date date, repeat_until date, repetitions string, transactions string, notes string, active boolean",
    "transactions": "id long, type string, date date, amount decimal(18,2), description string, external_id string, source_name string, destination_name string, notes string, category_name string, tags string",
}
#: What stands for an attribute that a page does not have.
DEFAULTS = {
    "currencies": {"decimal_places": 2, "enabled": True, "default": False}, "categories": {"name": ""}, "tags": {"tag": ""}, "piggy_banks": {"name": ""}, "budgets": {"name": "", "active": True},
    "bills": {"name": "", "skip": 0, "active": True}, "rule_groups": {"title": "", "active": True}, "rules": {"title": "", "active": True, "strict": False, "triggers": [], "actions": []},
    "recurrences": {"title": "", "repetitions": [], "transactions": [], "active": True}, "transactions": {},
}
#: Columns by which pages are filtered as they are read.
PUSHED = ("type", "date")
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32(), "decimal(18,2)": pa.decimal128(18, 2)}
_EPOCH = date(1970, 1, 1)


def _value(kind: str, raw):
    """An attribute as its column has it; null if it cannot be read as such."""
    try:
        if raw is None:
            return None
        if kind in ("long", "int"):
            return int(raw)
        if kind == "boolean":
            return raw if isinstance(raw, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(raw).lower())
        if kind == "date":
            return date.fromisoformat(str(raw)[:10])
        if kind.startswith("decimal"):
            return Decimal(str(raw)).quantize(Decimal("0.01"))
        return raw if isinstance(raw, str) else json.dumps(raw, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, InvalidOperation):
        return None


def _fits(test: Filter, value) -> bool:
    if value is None:
        return False
    with_ = test.value
    return {EqualTo: value == with_, GreaterThan: value > with_, GreaterThanOrEqual: value >= with_, LessThan: value < with_, LessThanOrEqual: value <= with_}[type(test)]


class _File(InputPartition):
    def __init__(self, path: str, after: str | None = None, upto: str | None = None):
        self.path, self.after, self.upto = path, after, upto


class _Pages:
    """What batches and streams have in common: the files and their rows."""

    def __init__(self, options: dict):
        self.kind, self.path = options["kind"], options["path"]
        self.columns = [c.rsplit(" ", 1) for c in SCHEMAS[self.kind].split(", ")]
        self.tests: list[Filter] = []

    def files(self) -> list[str]:
        fs, path = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)
        found = fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
        return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def rows(self, part: _File) -> Iterator[pa.RecordBatch]:
        fs = pa.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pa.fs.LocalFileSystem()
        with fs.open_input_stream(part.path) as f:
            rest = b""
            while True:
                block = f.read(1 << 20)
                *lines, rest = (rest + block).split(b"\n")
                yield from self._batches([x for x in (lines if block else [*lines, rest]) if x.strip()], part)
                if not block:
                    return

    def _batches(self, lines: list[bytes], part: _File) -> Iterator[pa.RecordBatch]:
        kept = []
        for line in lines:
            for item in json.loads(line).get("data") or []:
                attributes = DEFAULTS[self.kind] | (item.get("attributes") or {})
                row = {c: _value(t, item.get("id") if c == "id" else attributes.get(c)) for c, t in self.columns}
                day = row.get("date").isoformat() if row.get("date") else ""
                window = part.upto is None or (part.after or "") < day <= part.upto
                if window and all(_fits(t, row[t.attribute[0]]) for t in self.tests):
                    kept.append(row)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], _TYPES[t]) for c, t in self.columns], names=[c for c, _ in self.columns])


class PageReader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of type and date are done while pages are read; all others are left to Spark."""
        names = {c for c, _ in self.columns}
        for test in filters:
            if isinstance(test, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(test.attribute) == 1 and test.attribute[0] in PUSHED and test.attribute[0] in names:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.files()] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from self.rows(partition)


class PageStream(_Pages, DataSourceStreamReader):
    """Rows by date: an offset is the last day of a sync window; each batch has the days after one offset up to the next.

    Options: since (first day, by default so many `days` before today), today (by default the clock's).
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.today = options.get("today")
        self.first = options.get("since")
        self.days = int(options.get("days", 30))

    def _now(self) -> date:
        return date.fromisoformat(self.today) if self.today else date.today()

    def initialOffset(self) -> dict:  # noqa: N802
        first = date.fromisoformat(self.first) if self.first else self._now() - timedelta(self.days)
        return {"day": (first - timedelta(1)).isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"day": self._now().isoformat()}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(p, start["day"], end["day"]) for p in self.files()] if start["day"] < end["day"] else []

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """Format `pages`; options path and kind (a key of SCHEMAS)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return ", ".join(f"`{c.rsplit(' ', 1)[0]}` {c.rsplit(' ', 1)[1]}" for c in SCHEMAS[self.options["kind"]].split(", "))

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStream:  # noqa: N802
        return PageStream(dict(self.options))


def pages(spark: SparkSession, path: str, kind: str):
    """A frame over a folder of pages of a kind; registers the source and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").option("kind", kind).load(path)
