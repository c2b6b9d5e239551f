"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint, running_totals, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes; times that a document may be taken.
SHARE, EPOCHS = 1.5, 2
#: Words of a block of the schedule.
BLOCK = 1024
#: Documents of a hash range of a source, about, and slots of a range of the schedule, that are summed by themselves.
RANGE, SLOTS = 1 << 16, 1 << 14
#: Cells of the unit interval in which points look up their source.
CELLS = 4096
_GOLDEN = 0.6180339887498949


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds weight and target to (source, source_size), one row for each source.

    Water filling: a target is the least of epochs * source_size and weight * level, where the level
    makes all targets sum up to share of all sizes; so the excess over a cap goes to the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * epochs
    w = sources.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    tight = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after))
    # sources before the first whose share at its level fits under its cap are capped
    first = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct((cap / F.col("weight")).alias("ratio"), F.col("source").isNull(), "source", "level"))).over(everything)
    w = w.withColumn("level", first["level"])
    return w.select("source", "source_size", "weight", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))).alias("target"))


def schedule(sources: DataFrame) -> DataFrame:
    """(source, block, slot): the order in which blocks of sources are read.

    Slot i holds the point frac((i + 1) * golden ratio), which falls into a source's share of the
    cumulative block counts; the slots of a source, ranked, take its blocks in order. Slots beyond a
    source's blocks stay empty, and blocks beyond its slots follow after the last slot.
    """
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = sources.where("blocks > 0").select("source", "blocks", F.sum("blocks").over(upto).alias("hi"), F.sum("blocks").over(everything).alias("all"))
    s = s.select("source", "blocks", ((F.col("hi") - F.col("blocks")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"), "all")
    count = sources.agg(F.sum("blocks")).first()[0] or 0  # one number
    cells = s.select("source", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS)))).alias("cell"))
    point = (F.col("id") + 1) * F.lit(_GOLDEN)
    points = sources.sparkSession.range(count).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    hit = points.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where("u >= lo and u < hi")
    hit = hit.select("source", "blocks", "slot", F.floor(F.col("slot") / SLOTS).alias("range"), F.lit(1).alias("one"))
    ranked = running_totals(hit, ["source", "range"], [F.col("slot")], {"block": "one"}, within=["source"])
    placed = ranked.where("block < blocks").select("source", "block", "slot")
    had = placed.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("had"))
    short = s.join(had, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "blocks", F.coalesce("had", F.lit(0)).cast("long").alias("had")).where("had < blocks")
    late = short.select("source", F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)).alias("block")).select("source", "block", (F.lit(count) + F.col("block")).alias("slot"))
    return placed.union(late)


def mixture(docs: DataFrame, seed: int = 0, **settings) -> tuple[DataFrame, DataFrame]:
    """The mix of docs: (rows, pieces).

    rows: doc_id, source, size (words), th (a hash of the text), source_size, target, start (the place of its first
    word in the source's shuffled stream). pieces: source, slot, block, start, doc_id, epoch, first_word, n_words -
    the words that each slot of the schedule reads.

    A source's stream is its documents by a hash of doc_id and text, read as often as its target asks and
    cut into blocks of BLOCK words, the last one at the target. A null text has no words and is never
    taken. A null doc_id is an id like others. A null source is a source and comes last. Rows equal in
    doc_id, source and text are interchangeable. An empty table gives empty frames. Other columns are
    ignored; reruns agree.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("th"))
    # equal rows are counted first, so that repeats of one document load no range
    rows = checkpoint(rows.groupBy("source", "doc_id", "size", "th").agg(F.count("*").alias("n")))
    bits = min(20, max(4, (rows.count() // RANGE).bit_length()))
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("th"))
    rows = rows.select("*", mixed.alias("mixed"), F.shiftrightunsigned(mixed, 64 - bits).alias("range"), (F.col("n") * F.col("size")).alias("words"))
    # a range is ordered by the signed hash within, and ranges by the unsigned one: any fixed order will do
    rows = checkpoint(running_totals(rows, ["source", "range"], [F.col("mixed"), F.col("doc_id"), F.col("th")], {"start": "words"}, within=["source"]))
    sums = checkpoint(targets(rows.groupBy("source").agg(F.sum("words").alias("source_size")), **settings).withColumn("words", F.floor("target")).withColumn("blocks", F.ceil(F.col("words") / BLOCK)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).withColumn("start", F.col("start") + F.col("k") * F.col("size"))
    s = sums.select(F.col("source").alias("__s"), "source_size", "target", F.col("words").alias("goal"))
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "source", "size", "th", "source_size", "target", "goal", "start")
    epochs = int(settings.get("epochs", EPOCHS))
    spans = rows.where("size > 0").select("doc_id", "source", "size", "goal", "start", F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("epoch"), "source_size")
    spans = spans.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("goal"))).where("a < b")
    cut = spans.select("*", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("b") - 1) / BLOCK))).alias("block"))
    cut = cut.select("source", "doc_id", "start", "epoch", "block", F.greatest("a", F.col("block") * BLOCK).alias("x"), F.least("b", (F.col("block") + 1) * BLOCK).alias("y"), "a")
    slots = schedule(sums)
    slots = slots.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "slot")
    pieces = cut.join(slots, (F.col("block") == F.col("__b")) & F.col("source").eqNullSafe(F.col("__s"))).select(
        "source", "slot", "block", "start", "doc_id", "epoch", (F.col("x") - F.col("a")).alias("first_word"), (F.col("y") - F.col("x")).alias("n_words")
    )
    return rows, pieces


def _taken(docs: DataFrame, **settings) -> DataFrame:
    rows, pieces = mixture(docs, **settings)
    got = pieces.groupBy(F.col("source").alias("__s"), F.col("start").alias("__t")).agg(F.sum("n_words").alias("got"))
    out = rows.join(got, F.col("source").eqNullSafe(F.col("__s")) & (F.col("start") == F.col("__t")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "th", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def taken(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row: the words that the mix reads of it."""
    return _taken(docs, **settings).drop("th")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """docs with each row repeated as often as the mix reads its words, to the nearest whole number.

    Rows are told apart by doc_id (null too), source and text, so no row is taken for another, and none more
    than `epochs` times. A row of which less than half its words is read goes, as do null and blank texts.
    Columns stay.
    """
    c = F.col
    times = F.floor((c("taken") * 2 + c("size")) / (c("size") * 2)).cast("long")
    many = _taken(docs, **settings).where("size > 0").groupBy(c("doc_id").alias("k_id"), c("source").alias("k_source"), c("th").alias("k_th")).agg(F.sum(times).alias("times"), F.count("*").alias("n"))
    many = checkpoint(many.where("times > 0"))
    # the whole row in one column, so that no name can clash
    every = docs.select(F.struct(*[c(f"`{x}`") for x in docs.columns]).alias("row"), c("doc_id").cast("long").alias("id"), c("source").cast("string").alias("source"), F.xxhash64(c("text").cast("string")).alias("th"))
    same = c("id").eqNullSafe(c("k_id")) & c("source").eqNullSafe(c("k_source")) & (c("th") == c("k_th"))
    out = every.join(many.where("n = 1"), same).select("row", "times")
    if many.where("n > 1").take(1):  # rows that are repeated: one of them stands for all
        out = out.unionByName(every.join(many.where("n > 1"), same).dropDuplicates(["id", "source", "th"]).select("row", "times"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), c("times"))).alias("k")).select("row.*")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).drop("source")
