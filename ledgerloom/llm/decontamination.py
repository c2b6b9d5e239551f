"""Benchmark decontamination by template canonicalisation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, checkpoint, table, with_ids

#: Words of a template window, and how many of them must be literal.
WORDS, LITERAL = 5, 3
#: Words inserted or deleted by which an item may spread over diagonals.
SHIFT = 32
#: Units that count as such after a number.
UNITS = (
    "mm cm dm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons "
    "ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "eur usd gbp chf euro euros dollar dollars cent cents percent degrees celsius fahrenheit "
    "kb mb gb tb w kw kwh v a hz khz mhz ghz n j kj cal kcal pa kpa bar km/h mph"
).split()
_MARK, _START = "\u0001", "\u0002"
_EDGE = r"(?![\p{L}\p{N}])"


def marked(text: Column, values: bool) -> Column:
    """Words of a text, one space after each; numbers, names and units become placeholders of their type.

    With values, a placeholder is followed by its value; the places of words are the same either way. A
    number is a run of digits with separators inside; a unit is one of UNITS after a number; a name
    starts with a capital and follows a lower-case letter, comma or semicolon and a space. Other words with
    a capital at the start of the text, of a line or of a sentence may be names: they stay, marked.
    """
    keep = (lambda group: group) if values else (lambda group: "")
    # each pattern starts with what is rare, and looks back from there
    t = F.regexp_replace(F.translate(text, f"\u0130{_START}", "I"), rf"[0-9](?<![\p{{L}}\p{{N}}].)[0-9]*(?:[.,][0-9]+)*{_EDGE}", f" {_MARK}n{keep('$0')} ")
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    t = F.regexp_replace(t, rf"({_MARK}n\S* +)(?i:({units})){_EDGE}", f"$1{_MARK}u{keep('$2')} ")
    if values:  # a slash would end the word
        t = F.regexp_replace(t, rf"({_MARK}u\p{{L}}+)/", "$1")
    t = F.regexp_replace(t, r"(?:^|\n|\s(?<=[.!?:]\s)|[^\S ](?<=[\p{Ll},;]\s))(\p{Lu}\p{L}*)", f" {_START}$1")
    t = F.regexp_replace(t, r" (?<=[\p{Ll},;] )(\p{Lu}\p{L}*)", f" {_MARK}p{keep('$1')}")
    gap = rf"(?:[^\p{{L}}\p{{N}}{_MARK}{_START}.,]|[.,](?:(?<![0-9].)|(?![0-9])))+"
    return F.ltrim(F.regexp_replace(F.concat(F.lower(t), F.lit(" ")), gap, " "))


def chosen(words: Column, values: bool, starts: bool) -> Column:
    """Marked words with all that may be names as literal words, or with starts as names."""
    return F.regexp_replace(words, rf"{_START}([^ ]*)", f"{_MARK}p{'$1' if values else ''}") if starts else F.translate(words, _START, "")


def template(text: Column, values: bool, starts: bool = False) -> Column:
    return chosen(marked(text, values), values, starts)


def tokens(text: Column, starts: bool) -> Column:
    return F.split(F.rtrim(template(text, True, starts)), " ")


def windows(texts: DataFrame, name: str, values: bool = False) -> DataFrame:
    """(name, pos, window, kinds): a hash of every run of five words, in either template.

    One pattern yields all runs: at each word it looks ahead over five and steps on by one. A run with
    words that may be names has a window for each template, any other one for both; kinds are bits, 1
    for literal words and 2 for names. values: placeholders keep their values, so that only equal numbers and names match.
    """
    runs = F.regexp_extract_all(marked(F.col("text"), values), F.lit(rf"(?=((?:\S++ ){{{WORDS}}}))\S++ "), 1)
    each = texts.select(name, F.posexplode(runs).alias("pos", "run"))
    one = lambda kinds, run: F.struct(F.xxhash64(run).alias("window"), F.lit(kinds).alias("kinds"))
    run = F.col("run")
    both = F.when(run.contains(_START), F.array(one(1, chosen(run, values, False)), one(2, chosen(run, values, True)))).otherwise(F.array(one(3, run)))
    return each.select(name, "pos", F.inline(both))


def _by_template(rows: DataFrame) -> DataFrame:
    """A row for each template (starts) that its kinds have."""
    has = lambda bit: F.col("kinds").bitwiseAND(F.lit(bit)) > 0
    return rows.withColumn("starts", F.explode(F.array_compact(F.array(F.when(has(1), False), F.when(has(2), True))))).drop("kinds")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs of documents and benchmark items whose template the document holds.

    Returns doc_id, item_id, matched_windows, item_windows, n_slots and same_values (all slot values are the
    item's own). A pair counts if at least percent of the item's template windows lie on one diagonal of
    the document or within SHIFT neighbouring ones, so that words may be inserted or deleted, and if the
    slots in these windows, each on its own diagonal, are consistent: each value of the item stands for one
    value of the document and the reverse. Of several places of a window, that on the diagonal with the most
    windows is taken. Both templates, with and without names at starts, are tried.

    An item without a window of three literal words - of numbers, units and names nearly throughout - has no template of its own:
    its windows are matched with their values. Texts that are null or have fewer than five words match nothing, nor do rows without a doc_id or
    item_id. Rows that repeat a doc_id count as one document; of those that repeat an item_id the least text counts. Other columns are ignored. Document windows are hash-joined with the items' (broadcast only
    below a counted size); words are compared again only for pairs that pass.
    """
    texts = lambda df, name: df.select(F.col(name).cast("long").alias(name), F.col("text").cast("string").alias("text")).where("text is not null")
    items = texts(benchmark, "item_id").groupBy("item_id").agg(F.min("text").alias("text"))
    own = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(s).alias("starts"), tokens(F.col("text"), s).alias("own")) for s in (False, True)])).alias("t")).select("item_id", "t.*")
    literal = lambda p: F.size(F.filter(F.slice("own", p + 1, WORDS), lambda w: ~w.startswith(_MARK)))
    # only the items' windows need literal words: a document's window that equals one has as many
    iw = _by_template(windows(items, "item_id")).join(own, ["item_id", "starts"]).where(literal(F.col("pos")) >= LITERAL)
    columns = ["item_id", "starts", F.col("pos").alias("item_pos"), "window"]
    iw = checkpoint(iw.select(*columns).distinct())
    dense = items.join(iw.select("item_id").distinct(), "item_id", "left_anti")
    exact = checkpoint(_by_template(windows(dense, "item_id", True)).select(*columns).distinct())
    kinds = [(False, iw)] + ([(True, exact)] if exact.take(1) else [])
    iw = iw.unionByName(exact)
    asked = lambda iw: iw.select("item_id", "item_pos", "window", F.when(F.col("starts"), 2).otherwise(1).alias("own_kind"))
    n = iw.count()
    total = iw.groupBy("item_id", "starts").agg(F.countDistinct("window").alias("item_windows"))
    region = ["doc_id", "item_id", "starts", "wide", "region"]

    def hit(some: DataFrame) -> DataFrame:
        out = None
        for values, own_windows in kinds:
            theirs = asked(own_windows)
            found = windows(texts(some, "doc_id"), "doc_id", values).join(F.broadcast(theirs) if n <= BROADCAST_IDS else theirs, "window").where(F.col("kinds").bitwiseAND(F.col("own_kind")) > 0)
            found = found.select("doc_id", "item_id", (F.col("own_kind") == 2).alias("starts"), (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "window").distinct()
            out = found if out is None else out.union(found)
        return out

    hits = hit(docs)
    # each diagonal alone, and bands of 2 * SHIFT of which each overlaps the next by half
    band, at = F.floor(F.col("shift") / SHIFT), lambda wide, c: F.struct(F.lit(wide).alias("wide"), c.cast("long").alias("region"))
    spread = hits.select("*", F.inline(F.array(at(False, F.col("shift")), at(True, band), at(True, band + 1))))
    found = spread.groupBy(*region).agg(F.count_distinct("window").alias("matched_windows")).join(total, ["item_id", "starts"])
    found = checkpoint(found.where(F.col("matched_windows") * 100 >= F.col("item_windows") * percent))
    ids = checkpoint(found.select("doc_id").distinct())
    some = with_ids(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ids, "left_semi")
    # the hits of these documents again, which are few, instead of keeping all
    again = hit(some).drop("window").distinct()
    again = again.select("*", F.inline(F.array(at(False, F.col("shift")), at(True, band), at(True, band + 1)))).join(found.select(*region), region, "left_semi")
    again = again.withColumn("weight", F.count("*").over(Window.partitionBy(*region, "shift")))
    places = again.groupBy(*region, "item_pos").agg(F.max(F.struct("weight", (-F.col("shift")).alias("back"))).alias("m"))
    places = places.groupBy(*region).agg(F.collect_list(F.struct("item_pos", (-F.col("m.back")).cast("int").alias("shift"))).alias("places"))
    theirs = texts(some, "doc_id").select("doc_id", F.explode(F.array(*[F.struct(F.lit(s).alias("starts"), tokens(F.col("text"), s).alias("theirs")) for s in (False, True)])).alias("t")).select("doc_id", "t.*")
    pairs = found.join(places, region).join(theirs, ["doc_id", "starts"]).join(own, ["item_id", "starts"])
    # chance placeholders outside the windows that match don't count
    each = lambda p: F.transform(F.sequence(p["item_pos"], p["item_pos"] + WORDS - 1), lambda i: F.struct(F.get("own", i).alias("own"), F.get("theirs", i + p["shift"]).alias("their")))
    slots = F.filter(F.flatten(F.transform("places", each)), lambda x: x["own"].startswith(_MARK) & x["their"].startswith(_MARK))
    pairs = pairs.select("doc_id", "item_id", "matched_windows", "item_windows", F.array_distinct(slots).alias("slots"))
    pairs = pairs.where(
        (F.size("slots") == F.size(F.array_distinct(F.col("slots.own")))) & (F.size("slots") == F.size(F.array_distinct(F.col("slots.their"))))
    )
    best = F.max(F.struct("matched_windows", F.size("slots").alias("n_slots"), F.forall("slots", lambda x: x["own"] == x["their"]).alias("same_values")))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("b"), F.max("item_windows").alias("item_windows")).select(
        "doc_id", "item_id", "b.matched_windows", "item_windows", "b.n_slots", "b.same_values"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of docs that hold no benchmark item; columns stay. Rows without a doc_id stay."""
    bad = checkpoint(contaminated(docs, benchmark, percent).where("doc_id is not null").select("doc_id").distinct())
    return with_ids(docs, bad, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
