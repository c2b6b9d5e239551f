"""Sources and sinks of documents, ledgers and catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id long, title string, content string, created string, added timestamp, modified string, correspondent string, document_type string, tags array<string>, original_file_name string, custom_fields map<string,string>"
TRANSACTION = "ledger_id long, external_id string, internal_reference string, type string, date date, amount decimal(18,2), description string, source_account string, destination_account string, notes string, category string, tags array<string>, deleted_at timestamp, user_id long"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Original files: path, content and the SHA-256 of the content."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("source_hash"))


def documents(df: DataFrame, tags=(), kind: str | None = None, correspondent: str | None = None, query: str | None = None, after=None, before=None) -> DataFrame:
    """Documents that have all tags and lie strictly between the dates."""
    tests: list[Column] = [F.array_contains("tags", t) for t in tags]
    if kind:
        tests.append(F.lower("document_type") == kind.lower())
    if correspondent:
        tests.append(F.lower("correspondent") == correspondent.lower())
    if query:
        tests.append(F.lower(F.concat_ws(" ", "title", "content")).contains(query.lower()))
    if after is not None:
        tests.append(F.col("added") > F.lit(after))
    if before is not None:
        tests.append(F.col("added") < F.lit(before))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def transactions(df: DataFrame, start=None, end=None, kind: str | None = None) -> DataFrame:
    """Ledger rows from start to end, both included."""
    tests = [F.lit(True)]
    if start is not None:
        tests.append(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        tests.append(F.col("date") <= F.lit(end).cast("date"))
    if kind:
        tests.append(F.col("type") == kind)
    return df.where(reduce(lambda a, b: a & b, tests))


def by_name(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    return df.where(F.lower(column) == name.lower())


def to_create(payloads: DataFrame, existing: DataFrame, key: str = "external_id") -> DataFrame:
    """Payloads that the ledger does not hold yet, once for each key; writing these twice creates nothing."""
    return payloads.dropDuplicates([key]).join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def append_note(notes: Column, text: Column) -> Column:
    """Notes with a line more, unless they hold it."""
    return F.when(F.coalesce(notes, F.lit("")) == "", text).when(notes.contains(text), notes).otherwise(F.concat(notes, F.lit("\n"), text))


def set_once(old: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(old, F.lit("")), new)


def with_names(df: DataFrame, correspondents: DataFrame, document_types: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents with correspondent, document_type and tags as names instead of ids (correspondent_id, document_type_id, tag_ids).

    Catalogs hold id and name. Unknown ids give null, and unknown tags are left out; tags keep their order.
    """
    for table, column in ((correspondents, "correspondent"), (document_types, "document_type")):
        df = df.join(table.select(F.col("id").alias(f"{column}_id"), F.col("name").alias(column)), f"{column}_id", "left")
    each = df.select("id", F.posexplode("tag_ids").alias("at", "tag_id")).join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    named = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("tags"))
    return df.join(named, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def holding_external_id(splits: DataFrame, ids: DataFrame) -> DataFrame:
    """All splits of the groups of which one carries an external_id of ids."""
    return splits.join(splits.join(ids.select("external_id").distinct(), "external_id", "left_semi").select("group_id").distinct(), "group_id", "left_semi")


def updated(ledger: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """ledger (ledger_id, notes, external_id, ...) after changes (ledger_id, note, external_id, and the column of order).

    A row's notes are appended in order, each unless the notes so far hold it; the first external_id is set where none is.
    Changes of the same order follow each other by note.
    """
    some = F.coalesce(F.col("note"), F.lit("")) != ""
    once = changes.groupBy("ledger_id").agg(
        F.array_sort(F.collect_list(F.when(some, F.struct(order, "note")))).alias("__notes"), F.min(F.when(F.coalesce("external_id", F.lit("")) != "", F.struct(order, "external_id"))).alias("__id"),
    )
    out = ledger.join(once, "ledger_id", "left")
    notes = F.aggregate(F.coalesce("__notes", F.array()), F.col("notes"), lambda a, n: append_note(a, n["note"]))
    return out.withColumn("notes", notes).withColumn("external_id", set_once(F.col("external_id"), F.col("__id.external_id"))).drop("__notes", "__id")
