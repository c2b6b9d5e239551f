"""Ledger entities: catalogs, their normal form and display name, and what has to be created."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sync import upsert

# The fields of each entity, and what stands for a missing one.
FIELDS: dict[str, dict[str, str | None]] = {
    "category": {"name": "", "notes": None},
    "tag": {"tag": "", "description": None},
    "account": {"name": "", "type": "", "currency_code": "EUR", "notes": None, "iban": None, "account_number": None},
    "piggy_bank": {"name": "", "target_amount": None, "current_amount": None, "notes": None},
    "budget": {"name": "", "auto_budget_type": None, "auto_budget_amount": None, "auto_budget_period": None, "notes": None},
    "rule_group": {"title": "", "order": None, "active": "true", "description": None},
    "currency": {"code": "", "name": "", "symbol": "", "decimal_places": "2", "enabled": "false"},
    "bill": {"name": "", "amount_min": None, "amount_max": None, "date": None, "repeat_freq": None, "skip": "0", "active": "true", "notes": None},
    "rule": {"title": "", "rule_group_id": None, "rule_group_title": None, "order": None, "active": "true", "strict": "false", "triggers": "[]", "actions": "[]", "description": None},
    "recurrence": {"title": "", "first_date": None, "repeat_freq": None, "latest_date": None, "repetitions": "[]", "transactions": "[]", "notes": None, "active": "true"},
    "transaction": {
        "type": "", "date": "", "amount": "", "description": "", "source_name": None, "destination_name": None, "category_name": None, "tags": "[]", "notes": None,
        "external_id": None, "internal_reference": None, "splits": "[]",
    },
}


def fields(data: Column) -> Column:
    """The fields of a JSON object as text; nested ones as JSON."""
    return F.from_json(data, "map<string,string>")


def normalised(entity: Column, data: Column) -> Column:
    """A map of the entity's own fields, each as text, with defaults; null for an entity that is not known."""
    got = fields(data)
    has = lambda k: F.coalesce(F.map_contains_key(got, F.lit(k)), F.lit(False))

    def of(table: dict[str, str | None]) -> Column:
        values = [F.when(has(k), F.try_element_at(got, F.lit(k))).otherwise(F.lit(v)).cast("string") for k, v in table.items()]
        return F.map_from_arrays(F.array(*[F.lit(k) for k in table]), F.array(*values))

    out = F.lit(None).cast("map<string,string>")
    for name, table in FIELDS.items():
        out = F.when(entity == name, of(table)).otherwise(out)
    return out


def display_name(entity: Column, data: Column) -> Column:
    """What an entity is shown as: its tag, title, code and name, or day, text and amount."""
    got = fields(data)
    at = lambda k: F.try_element_at(got, F.lit(k))
    or_ = lambda *c: F.coalesce(*c, F.lit("Unknown"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    code, name, text = blank(at("code")), blank(at("name")), blank(at("description"))
    return (
        F.when(entity == "tag", or_(at("tag"), at("name"))).when(entity.isin("rule_group", "rule", "recurrence"), or_(at("title")))
        .when(entity == "currency", F.when(name != "", F.concat(code, F.lit(" - "), name)).otherwise(or_(F.nullif(code, F.lit("")))))
        .when(entity == "transaction", F.concat(F.substring(blank(at("date")), 1, 10), F.lit(": "), F.when(text != "", F.concat(text, F.lit(" "))).otherwise(""), F.lit("("), blank(at("amount")), F.lit(")")))
        .otherwise(or_(at("name")))
    )


def _holds(v: Column, kind: Column) -> Column:
    """Whether a JSON value counts as something: not null, false, 0, or empty."""
    number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    return (
        F.when(v.isNull() | (kind == "VOID"), False).when(kind == "STRING", F.try_variant_get(v, "$", "string") != "").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(number, F.try_variant_get(v, "$", "double") != 0).otherwise(~F.to_json(v).isin("[]", "{}"))
    )


def tags(raw: Column) -> Column:
    """Tags of JSON of any shape: struct of tags (null if there are none) and error.

    A list may mix strings, objects with `tag` or, where that is empty, `name`, and anything else, which is passed over like empty
    strings and nulls. Null, JSON null and an empty list have no tags. Any other value is an error, and so is text that is not JSON.
    """
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    string = lambda x, k: F.when((k == "STRING") & (F.try_variant_get(x, "$", "string") != ""), F.try_variant_get(x, "$", "string"))

    def one(x: Column) -> Column:
        of, tag, name = F.schema_of_variant(x), F.try_variant_get(x, "$.tag", "variant"), F.try_variant_get(x, "$.name", "variant")
        k, n = F.schema_of_variant(tag), F.schema_of_variant(name)
        return F.when(of.startswith("OBJECT"), F.when(_holds(tag, k), string(tag, k)).otherwise(string(name, n))).otherwise(string(x, of))

    kept = F.array_compact(F.transform(F.try_variant_get(v, "$", "array<variant>"), one))
    # The names that an error gives to types.
    python = F.when(kind.startswith("OBJECT"), "dict").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int").otherwise("float")
    error = (
        F.when(raw.isNull() | (kind == "VOID") | kind.startswith("ARRAY"), F.lit(None)).when(v.isNull(), "Tags are not JSON")
        .otherwise(F.concat(F.lit("Unexpected tags format: expected list or None, got "), python))
    )
    return F.struct(F.when(F.size(kept) > 0, kept).alias("tags"), error.cast("string").alias("error"))


def accounts(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Accounts of a type, or all; every page of them."""
    return df if kind is None else df.where(F.col("type") == kind)


def enabled(currencies: DataFrame) -> DataFrame:
    return currencies.where(F.coalesce("enabled", F.lit(False)))


def enable(currencies: DataFrame, codes: DataFrame) -> DataFrame:
    """Currencies with those of `codes` (code, whatever its case) enabled."""
    on = codes.select(F.upper("code").alias("__code")).distinct().withColumn("__on", F.lit(True))
    return currencies.join(on, F.upper("code") == F.col("__code"), "left").withColumn("enabled", F.coalesce("__on", "enabled", F.lit(False))).drop("__code", "__on")


def to_create(new: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """New entities whose name, whatever its case, the ledger does not hold yet: the first of each name by all columns."""
    key = F.lower(F.col(name))
    first = new.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(key.alias("__key")).agg(F.min(F.struct(*new.columns)).alias("row"))
    return first.join(existing.select(F.lower(F.col(name)).alias("__key")).distinct(), "__key", "left_anti").select("row.*")


def pool(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shared records (owner, entity_type, fingerprint, name, data) after an upsert, with `change`."""
    return upsert(old, new, ["owner", "entity_type", "fingerprint"], ["name", "data"])
