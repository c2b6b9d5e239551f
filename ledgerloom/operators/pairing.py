"""The best partners of each row by closeness in amount and day and by related texts, by searches in tiles of amounts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DateType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import checkpoint, discard, release, ship, stored, whole_batches
from . import nearest


#: Right rows of a text up to which a left row meets all of them.
FEW = 32
#: Keys of both sides that are met at once: a row has two, in the order of days and in that of amounts. More are met part by part, so that shuffles don't grow with the rows.
KEYS = 8_000_000
#: Right rows of a tile, and left rows that one task searches for at most.
TILE, CHUNK = 200_000, 60_000
#: The group of rows that all rows meet.
ALL = -1


@dataclass(frozen=True)
class Points:
    """What closeness counts.

    amounts: (percent, points) from equal (0 percent) outwards. days: (days, points) up to so many days, outwards. Beyond the last of
    either there are none. of_amounts(left, right) and of_days(difference) give a pair's points as columns. of_left: percent are of the left
    amount, and a level ends below its percent; else they are of the right one, and it ends with them.
    """

    amounts: tuple[tuple[int, int], ...]
    days: tuple[tuple[int, int], ...]
    of_amounts: Callable[[Column, Column], Column]
    of_days: Callable[[Column], Column]
    of_left: bool = False


def _part(keyed: DataFrame, part: tuple[int, int], *key) -> DataFrame:
    """Rows whose key falls into the part: (number, how many there are)."""
    n, of = part
    return keyed if of == 1 else keyed.where(F.pmod(F.xxhash64(*key), F.lit(of)) == n)


def _dealt(kinds: list[tuple]) -> list[tuple[list[tuple], tuple[int, int]]]:
    """Tiles, whose last item is how many keys they have, in parts of about KEYS keys: tiles and part. A tile with more is divided by _part()."""
    out, some, size = [], [], 0
    for kind in sorted(kinds):
        n = kind[-1]
        if n > KEYS:
            out += [([kind], (i, -(-n // KEYS))) for i in range(-(-n // KEYS))]
            continue
        if some and size + n > KEYS:
            out.append((some, (0, 1)))
            some, size = [], 0
        some, size = [*some, kind], size + n
    return [*out, (some, (0, 1))] if some else out


def _tile(amount: Column, starts: tuple[int, ...]) -> Column:
    """How many tiles begin at the amount or before it, less one for the first."""
    def within(a: int, b: int) -> Column:
        m = (a + b) // 2
        return F.lit(a) if a == b else F.when(amount < starts[m], within(a, m)).otherwise(within(m + 1, b))

    return within(0, len(starts))


def _sizes(rows: DataFrame) -> dict[int, int]:
    """Rows of each tile."""
    return dict(rows.groupBy("tile").count().collect())


def reaching(asked: DataFrame, used: list[tuple], right: DataFrame, search: nearest.Search, schema: StructType, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Partners of left rows within the tiles that they ask for, and what they ask of others: see nearest.tile().

    used: (tile, tasks, keys) of the tiles that are met. part: of their left rows, by _part().
    """
    c, slots, n = F.col, {}, 0
    for t, tasks, _ in used:
        slots[t], n = (n, tasks), n + tasks
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for t, v in slots.items() for x in (t, v[k])]), c("tile"))
    both = ["slot", "mine", "id", "other", "tie", "tile", "amount", "day", "gids", "extras", "need"]
    null = lambda name: F.lit(None).cast(schema[name].dataType).alias(name)
    mine = _part(asked.where(c("tile").isin(list(slots))), part, "id").select(
        (of(0) + F.pmod(F.xxhash64("id", F.lit(7)), of(1)).cast("int")).alias("slot"), F.lit(True).alias("mine"), "id", null("other"), null("tie"), "tile", "amount", "day", "gids", "extras", "need")
    theirs = right.where(c("tile").isin(list(slots))).select(
        F.explode(F.sequence(of(0), of(0) + of(1) - 1)).alias("slot"), F.lit(False).alias("mine"), null("id"), "other", "tie", "tile", "amount", "day", "gids", null("extras"), F.lit(None).cast("int").alias("need"))
    arrow = to_arrow_schema(schema)
    return mine.select(both).unionByName(theirs.select(both)).repartitionById(max(n, 1), "slot").mapInArrow(lambda batches: nearest.tiles(batches, search, arrow), schema)


def _asked(asked: DataFrame, right: DataFrame, search: nearest.Search, schema: StructType) -> list[tuple[DataFrame, str]]:
    """Stored tables of reaching(), part by part; the files of a part go before those of the next come."""
    spark, out = asked.sparkSession, []
    left, others = _sizes(asked), _sizes(right)
    chunk = min(CHUNK, max(500, sum(left.values()) // (3 * spark.sparkContext.defaultParallelism)))
    for used, part in _dealt([(t, -(-n // chunk), 2 * (n + others.get(t, 0))) for t, n in left.items()]):
        used = [(t, -(-tasks // part[1]), keys) for t, tasks, keys in used]
        with whole_batches(spark):
            out.append(stored(reaching(asked, used, right, search, schema, part)))
        release(spark)
    return out


def ranked(pairs: DataFrame, top: int) -> DataFrame:
    """The first `top` others of each id by their greatest totals, then later tie, then other; a pair may be there several times, and is exact if it is once."""
    once = pairs.repartition("id").groupBy("id", "other").agg(F.max("total").alias("total"), F.first("tie").alias("tie"), *[F.max(x).alias(x) for x in ("is_exact",) if x in pairs.columns])
    order = Window.partitionBy("id").orderBy(F.desc("total"), F.col("tie").desc_nulls_last(), "other")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def best_partners(left: DataFrame, right: DataFrame, points: Points, top: int, floor: int, more: DataFrame | None = None) -> DataFrame:
    """(id, other, tie, total, rank and what more has): the first `top` partners of each left row of all that reach the floor, which must be above 0; ties by later tie, then other.

    left: id, amount, day, gids, extras - the groups in which it has partners, with the points that each gives. right: other, amount, day, tie,
    gids - the groups it belongs to. Both are read several times. more: further pairs (id, other, tie, total, ...), found elsewhere.

    Right rows lie in tiles of amounts of about TILE rows. Each left row is searched for in the tile of its own amount, level by level of amounts
    and days from the most points down, until it has `top` partners in one of its groups or no group can reach what it needs: work depends on
    the partners it has near, not on the size of the tables. Only if a far amount may still reach its last partner, it asks the tiles where
    this amount lies; only if a partner may do so without points of its amount, it is searched for among the first `top` right rows of each
    group and day, which are all that can come first there.
    """
    if floor <= 0:
        raise ValueError("a floor above 0 is needed")
    c, spark = F.col, ship(left.sparkSession)
    schema = StructType([
        StructField("id", left.schema["id"].dataType), StructField("other", right.schema["other"].dataType), StructField("tie", DateType()), StructField("total", LongType()), StructField("tile", IntegerType()),
        StructField("amount", LongType()), StructField("day", IntegerType()), StructField("gids", ArrayType(LongType())), StructField("extras", ArrayType(IntegerType())),
    ])
    block = max(min(TILE, KEYS // 8), 1)
    n = right.where("amount is not null").count()
    wanted = -(-n // block)
    starts = () if wanted < 2 else tuple(sorted({int(x) for x in right.where("amount is not null").approxQuantile("amount", [i / wanted for i in range(1, wanted)], min(0.1 / wanted, 0.01))}))
    search = nearest.Search(points.amounts, points.days, top, points.of_left, starts)
    here = lambda df: df.where("amount is not null").withColumn("tile", _tile(c("amount"), starts))
    asked = here(left.withColumn("need", F.lit(floor)))
    found = _asked(asked, here(right), search, schema)
    pairs = lambda tables: [t.where("other is not null").select("id", "other", "tie", "total") for t, _ in tables]
    asks = [t.where("tile is not null").select("id", "tile", "amount", "day", "gids", "extras", c("total").cast("int").alias("need")) for t, _ in found]
    nobody = left.where("amount is null").select("id", F.lit(-1).alias("tile"), "amount", "day", "gids", "extras", F.lit(floor).alias("need"))
    every = nobody
    for x in asks:
        every = every.unionByName(x)
    others = _asked(every.where("tile >= 0"), here(right), replace(search, tiles=None), schema)
    far, far_paths = _far(every.where("tile < 0"), right, top, block)
    last = _asked(far[0], far[1], nearest.Search((), points.days, top, points.of_left), schema) if far else []
    tables = [*found, *others, *last]
    union = more
    for p in pairs(tables):
        if union is not None and "is_exact" in union.columns:
            p = p.withColumn("is_exact", F.lit(False))
        union = p if union is None else union.unionByName(p)
    if union is None:
        union = left.select("id").join(right.select("other", "tie"), F.lit(False)).withColumn("total", F.lit(0).cast("long"))
    out = checkpoint(ranked(union, top).withColumn("total", c("total").cast("int")))
    for p in [*(path for _, path in tables), *far_paths]:
        discard(spark, p)
    return out


def _far(asked: DataFrame, right: DataFrame, top: int, block: int) -> tuple[tuple[DataFrame, DataFrame] | None, list[str]]:
    """Left rows that may have partners whatever the amount, and the first right rows of each of their groups and days, dealt into tiles by group; and the paths behind them."""
    c = F.col
    asked, path = stored(asked)
    if asked.isEmpty():
        return None, [path]
    groups = asked.select(F.explode("gids").alias("gid")).distinct()
    each = right.select("other", "tie", "day", F.explode("gids").alias("gid")).join(groups, "gid", "left_semi")
    nth = F.row_number().over(Window.partitionBy("gid", "day").orderBy(c("tie").desc_nulls_last(), "other"))
    firsts, first_path = stored(each.withColumn("nth", nth).where(c("nth") <= top).drop("nth"))
    n = max(-(-firsts.count() // block), 1)
    tile = F.pmod(F.xxhash64("gid"), F.lit(n)).cast("int").alias("tile")
    theirs = firsts.select("*", tile).groupBy("other", "tile").agg(F.first("tie").alias("tie"), F.first("day").alias("day"), F.collect_list("gid").alias("gids")).withColumn("amount", F.lit(0).cast("long"))
    visits = F.array_distinct(F.transform("gids", lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")))
    mine = asked.withColumn("tile", F.explode(visits)).withColumn("amount", F.lit(0).cast("long"))
    return (mine, theirs), [path, first_path]
