"""Upserts, soft deletes, reference resolution and ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: list[str], replace: list[str], keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """A full-outer merge: `replace` columns from new rows, `keep` from old ones, `fill` from new unless null.

    Of several new rows with one key the last by all replaced columns stays.
    """
    once = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in replace])
    fresh = new.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n").withColumn("__new", F.lit(True))
    fresh = fresh.select([F.col(c).alias(f"__{c}") if c not in key and c != "__new" else F.col(c) for c in fresh.columns])
    out = old.withColumn("__old", F.lit(True)).join(fresh, key, "full_outer")
    is_new = F.coalesce("__new", F.lit(False))
    return out.select(
        *key, *[F.when(is_new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in replace],
        *[(F.coalesce(F.col(c), F.col(f"__{c}")) if f"__{c}" in fresh.columns else F.col(c)).alias(c) for c in keep],
        *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in fill],
        F.when(is_new & F.col("__old").isNull(), "created").when(is_new, "updated").otherwise("kept").alias("change"),
    )


def soft_delete(cached: DataFrame, current: DataFrame, key: str, now: Column, within: Column | None = None) -> DataFrame:
    """cached with deleted_at set where the source has no row any more, and cleared where it has one.

    within: the rows that the fetch covered; others stay as they are.
    """
    seen = current.select(F.col(key), F.lit(True).alias("__seen")).distinct()
    covered = F.lit(True) if within is None else within
    gone = F.when(F.col("__seen"), F.lit(None)).when(covered, F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))
    return cached.join(seen, key, "left").withColumn("deleted_at", gone).drop("__seen")


def resolve(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Adds the id of a name, whatever its case; null where it must be created."""
    n = names.groupBy(F.lower("name").alias("__k")).agg(F.min("id").alias(f"{column}_id"))
    return rows.join(n, F.lower(F.col(column)) == F.col("__k"), "left").drop("__k")


def missing_names(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return rows.select(F.lower(F.col(column)).alias("name")).where("name is not null").distinct().join(names.select(F.lower("name").alias("name")), "name", "left_anti")


#: Entities in the order in which they depend on each other.
LAYERS = {"currency": 0, "category": 0, "tag": 0, "account": 1, "budget": 1, "rule_group": 1, "piggy_bank": 2, "bill": 2, "rule": 2, "recurrence": 3, "transaction": 3}


def layer(entity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv]), entity), F.lit(3))


def visible(user: int) -> Column:
    """Rows of a user or of nobody."""
    return F.col("user_id").isNull() | (F.col("user_id") == user)


def import_preview(shared: DataFrame, own: DataFrame) -> DataFrame:
    """What importing shared records would do: skip what is owned, report what has no name, create the rest."""
    have = own.select("entity_type", "fingerprint").distinct().withColumn("__have", F.lit(True))
    out = shared.join(have, ["entity_type", "fingerprint"], "left")
    return out.withColumn("action", F.when(F.col("name").isNull() | (F.col("name") == ""), "error").when(F.col("__have"), "skip").otherwise("create")).drop("__have")


def live_cache(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def cache_put(cache: DataFrame, answers: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """cache (cache_key, model, prompt_version, taxonomy_version, response_json, created_at, expires_at, hit_count) with answers stored for so many days.

    An answer to a key that is there replaces its text and times; either way its hits begin at one.
    """
    new = answers.select("cache_key", "model", "prompt_version", "taxonomy_version", "response_json").withColumns(
        {"created_at": now, "expires_at": now + F.expr(f"INTERVAL {days} DAYS"), "hit_count": F.lit(1)})
    return upsert(cache, new, ["cache_key"], ["response_json", "created_at", "expires_at", "hit_count"], ["model", "prompt_version", "taxonomy_version"]).drop("change").select(cache.columns)


def cache_get(cache: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What the cache holds for asked keys (cache_key), and the cache with a hit more for each time that a live one was asked for."""
    times = asked.groupBy("cache_key").agg(F.count("*").alias("__times"))
    hit = cache.join(times, "cache_key", "left")
    live = (F.col("expires_at") > now) & F.col("__times").isNotNull()
    found = hit.where(live).select("cache_key", "response_json")
    return found, hit.withColumn("hit_count", F.col("hit_count") + F.when(live, F.col("__times")).otherwise(0)).drop("__times")


def cache_purge(cache: DataFrame, now: Column) -> DataFrame:
    """The cache without what has expired."""
    return cache.where(F.col("expires_at") >= now)
