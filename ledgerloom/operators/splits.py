"""Split transactions: rounding, reconciliation with the total, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import even_amount, strip
from .identity import ORIGIN, PREFIX, external_id, transaction_hash

#: Fixed value: the largest difference that the last split absorbs.
MAX_REMAINDER = 1


def normalized_amount(c: Column) -> Column:
    """Absolute amount with two decimals, halves away from zero."""
    return F.abs(F.round(c.cast("decimal(30,10)"), 2)).cast("decimal(18,2)")


def checked_amount(text: Column, field: str = "amount", zero: bool = False, most: int | None = None) -> Column:
    """(amount, error) of an amount as text: two decimals, halves away from zero; positive, unless zero is allowed, and up to `most`."""
    amount = F.round(strip(text).try_cast("decimal(30,10)"), 2).cast("decimal(18,2)")
    said = lambda *parts: F.concat(F.lit(f"{field}: "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    shown = amount.cast("string")
    error = F.when(amount.isNull(), said("Invalid amount format")).when(amount < 0, said("Amount must be positive, got ", shown))
    if not zero:
        error = error.when(amount == 0, said("Amount cannot be zero"))
    if most is not None:
        error = error.when(amount > most, said("Amount ", shown, f" exceeds maximum {most}"))
    return F.struct(F.when(error.isNull(), amount).alias("amount"), error.alias("error"))


def build_splits(items: DataFrame) -> DataFrame:
    """Splits of line items (group_id, total, order, amount, description, category, position).

    Items without a positive amount are dropped; the rest are rounded half up. A difference to the
    group's total of up to MAX_REMAINDER goes to the last split; status tells `ok`, or `irreconcilable`
    for groups that differ by more, whose amounts stay as they are.
    """
    kept = items.where("amount > 0").withColumn("split_amount", F.round(F.col("amount").cast("decimal(30,10)"), 2).cast("decimal(18,2)"))
    group = Window.partitionBy("group_id")
    kept = kept.withColumn("gap", (F.col("total") - F.sum("split_amount").over(group)).cast("decimal(18,2)"))
    last = F.row_number().over(group.orderBy(F.desc("order"))) == 1
    fits = F.abs("gap") <= MAX_REMAINDER
    kept = kept.withColumn("split_amount", F.when(last & fits, F.col("split_amount") + F.col("gap")).otherwise(F.col("split_amount")).cast("decimal(18,2)"))
    return kept.select(
        "group_id", "order", "split_amount",
        F.coalesce(F.col("description"), F.concat(F.lit("Item "), (F.col("order") + 1).cast("string"))).alias("description"),
        "category", F.coalesce("position", F.col("order") + 1).alias("position"), F.when(fits, "ok").otherwise("irreconcilable").alias("status"),
    )


def split_errors(splits: DataFrame) -> DataFrame:
    """A row per group with its sum and counts of non-positive amounts and empty descriptions."""
    return splits.groupBy("group_id").agg(
        F.sum("split_amount").cast("decimal(18,2)").alias("split_sum"),
        F.count_if(F.col("split_amount") <= 0).alias("non_positive"),
        F.count_if(F.coalesce(strip(F.col("description")), F.lit("")) == "").alias("no_description"),
    )


def stable_key(position: Column, order: Column, description: Column, amount: Column) -> Column:
    text = F.substring(F.lower(strip(F.coalesce(description, F.lit("")))), 1, 50)
    return F.concat_ws(":", F.coalesce(F.nullif(position, F.lit(0)), order).cast("string"), text, even_amount(amount))


def problems(totals: DataFrame, splits: DataFrame) -> DataFrame:
    """(group_id, errors) for every group of totals (group_id, total): no splits, a sum that is not the total, amounts or texts that won't do."""
    e = totals.join(split_errors(splits), "group_id", "left")
    found = F.array(
        F.when(F.col("split_sum").isNull(), "No splits defined"),
        F.when(F.col("split_sum") != F.col("total"), F.concat(F.lit("Split sum ("), F.col("split_sum").cast("string"), F.lit(") != total ("), F.col("total").cast("string"), F.lit(")"))),
        F.when(F.col("non_positive") > 0, F.concat(F.col("non_positive").cast("string"), F.lit(" with non-positive amount"))),
        F.when(F.col("no_description") > 0, F.concat(F.col("no_description").cast("string"), F.lit(" with empty description"))),
    )
    return e.select("group_id", F.array_compact(found).alias("errors"))


def group_external_id(document_id: Column, source_hash: Column, total: Column, date: Column, n: Column, origin: str = ORIGIN) -> Column:
    """origin:document:hash:total:date:splits<n>."""
    short = F.coalesce(F.substring(F.nullif(source_hash, F.lit("")), 1, PREFIX), F.lit("unknown"))
    return F.concat_ws(":", F.lit(origin), document_id.cast("string"), short, even_amount(total), date, F.concat(F.lit("splits"), n.cast("string")))


def split_external_id(external_id: Column, order: Column) -> Column:
    return F.concat(external_id, F.lit(":"), order.cast("string"))


def weighted_category(items: DataFrame) -> DataFrame:
    """The category with the largest positive amount of each group; ties go to the one seen first."""
    sums = items.where("amount > 0 and category is not null").groupBy("group_id", "category").agg(F.sum("amount").alias("s"), F.min("order").alias("first"))
    return sums.groupBy("group_id").agg(F.max_by("category", F.struct("s", -F.col("first"))).alias("category"))


def split_categories(items: DataFrame) -> DataFrame:
    return items.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def fold_splits(splits: DataFrame) -> DataFrame:
    """One row per group: summed amount, the first split's text, and a note if there are several."""
    n = F.count("*")
    return splits.groupBy("group_id").agg(
        F.sum("split_amount").cast("decimal(18,2)").alias("amount"), F.min_by("description", "order").alias("description"), n.alias("parts"),
        F.when(n > 1, F.concat(F.lit("[Split: "), n.cast("string"), F.lit(" parts]"))).otherwise("").alias("note"),
    )


def fold_transactions(splits: DataFrame) -> DataFrame:
    """One row per transaction group of splits (group_id, order, amount, date, description, source_name, destination_name, notes, tags).

    The amount is the sum, the tags are those of all splits, each once in order; the rest is the first
    split's, with the number of parts in its notes if there are several. computed_id is the id that the
    folded transaction would get.
    """
    first = F.min_by(F.struct("date", "description", "source_name", "destination_name", "notes"), "order")
    every = F.array_sort(F.collect_list(F.struct("order", "tags")))
    g = splits.groupBy("group_id").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"), F.count("*").alias("parts"), first.alias("f"), F.array_distinct(F.flatten(F.transform(every, lambda x: F.coalesce(x["tags"], F.array().cast("array<string>"))))).alias("tags"))
    note = F.concat(F.coalesce("f.notes", F.lit("")), F.lit(" [Split: "), F.col("parts").cast("string"), F.lit(" parts]"))
    id_ = external_id(transaction_hash(F.col("amount"), F.substring(F.col("f.date").cast("string"), 1, 10), F.col("f.source_name"), F.col("f.destination_name"), F.col("f.description")))
    return g.select("group_id", "amount", "parts", "f.date", "f.description", "f.source_name", "f.destination_name", F.when(F.col("parts") > 1, strip(note)).otherwise(F.nullif(F.col("f.notes"), F.lit(""))).alias("notes"), "tags", id_.alias("computed_id"))
