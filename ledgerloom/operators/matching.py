"""Scored record linkage of documents with ledger transactions.

Scores are whole thousandths and totals whole millionths, so thresholds are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import norm, words
from ..session import checkpoint, discard, stored
from .pairing import ALL, FEW, Points, best_partners
from .related import contained_either_way, sharing

# Weights of the signals in thousandths; floor and automatic threshold in millionths.
WEIGHTS = {"amount": 400, "date": 250, "description": 200, "vendor": 150}
FLOOR, AUTO, EXACT = 200_000, 900_000, 990_000
TOLERANCE_DAYS, TOP = 7, 5


def amount_score(doc: Column, tx: Column) -> Column:
    """1000 if equal, then 950, 700, 400 and 200 within 1, 5, 10 and 20 percent of the transaction."""
    gap, base = F.abs(doc - tx) * 100, F.abs(tx)
    tiers = F.when(gap <= base, 950).when(gap <= base * 5, 700).when(gap <= base * 10, 400).when(gap <= base * 20, 200).otherwise(0)
    return F.when(doc.isNull() | tx.isNull(), 0).when(doc == tx, 1000).when(tx == 0, 0).otherwise(tiers)


def date_score(doc: Column, tx: Column, tolerance: int = TOLERANCE_DAYS) -> Column:
    """1000 on the same day, falling to 300 within the tolerance, 200 within twice that, 100 within 30 days."""
    n = F.abs(F.datediff(doc, tx))
    near = F.greatest(F.round(F.lit(1000.0) - n * 1000.0 / (tolerance + 1)).cast("int"), F.lit(300))
    return F.when(n.isNull(), 0).when(n == 0, 1000).when(n <= tolerance, near).when(n <= 2 * tolerance, 200).when(n <= 30, 100).otherwise(0)


def _description(a: Column, wa: Column, b: Column, wb: Column, both: Column | None = None) -> Column:
    """both: how many of the distinct words are common, if that is at hand."""
    both = F.size(F.array_intersect(wa, wb)) if both is None else both
    either = F.size(wa) + F.size(wb) - both
    share = F.round(both * 1000.0 / F.greatest(either, F.lit(1))).cast("int")
    return F.when((a == "") | (b == ""), 0).when(a == b, 1000).when(a.contains(b) | b.contains(a), 800).when(both * 10 > either * 3, share).otherwise(0)


def description_score(doc: Column, tx: Column) -> Column:
    """1000 if equal, 800 if one contains the other, else the Jaccard similarity of words above 300."""
    a, b = norm(doc), norm(tx)
    return _description(a, words(a), b, words(b))


def _vendor(a: Column, b: Column) -> Column:
    first = lambda c: F.regexp_extract(c, r"^\S*", 0)
    return F.when((a == "") | (b == ""), 0).when(a == b, 1000).when(a.contains(b) | b.contains(a), 850).when(first(a) == first(b), 600).otherwise(0)


def vendor_score(doc: Column, tx: Column) -> Column:
    """1000 if equal, 850 if one contains the other, 600 if the first words are the same."""
    return _vendor(norm(doc), norm(tx))


def _exact(amount, tx_amount, date, tx_date, v, s, ts, td) -> Column:
    touches = lambda t: (t != "") & (v.contains(t) | t.contains(v))
    account = ((v != "") & (touches(ts) | touches(td))) | ((s != "") & (s == ts))
    return F.coalesce((amount == tx_amount) & (F.datediff(date, tx_date) == 0) & account, F.lit(False))


def is_exact(amount, tx_amount, date, tx_date, vendor, source, tx_source, tx_destination) -> Column:
    """Same amount and day, and an account that is equal to or contained in one of the transaction's."""
    return _exact(amount, tx_amount, date, tx_date, norm(vendor), norm(source), norm(tx_source), norm(tx_destination))


def prepared(docs: DataFrame) -> DataFrame:
    """Documents with their texts normalised, once for all their pairs."""
    d = docs.select("*", norm(F.col("description")).alias("n_description"), norm(F.col("vendor")).alias("n_vendor"), norm(F.col("source_account")).alias("n_source"))
    return d.select("*", words(F.col("n_description")).alias("n_words"))


def prepared_ledger(ledger: DataFrame) -> DataFrame:
    """Transactions with the prefix tx_ and their texts normalised."""
    tx = ledger.select([F.col(k).alias(f"tx_{k}") for k in ledger.columns])
    n = tx.select("*", norm(F.col("tx_description")).alias("t_description"), norm(F.col("tx_source_account")).alias("t_source"), norm(F.col("tx_destination_account")).alias("t_destination"))
    return n.select("*", words(F.col("t_description")).alias("t_words"), F.when(F.col("t_destination") != "", F.col("t_destination")).otherwise(F.col("t_source")).alias("t_vendor"))


def scored(pairs: DataFrame, tolerance: int = TOLERANCE_DAYS, override: bool = True) -> DataFrame:
    """Adds the four signal scores, is_exact, total (millionths) and reasons to pairs of prepared rows.

    Without override a pair is scored by its signals alone.
    """
    c = F.col
    out = pairs.withColumn("both", F.size(F.array_intersect("n_words", "t_words"))).select(
        *pairs.columns,
        amount_score(c("amount"), c("tx_amount")).alias("amount_score"),
        date_score(c("date"), c("tx_date"), tolerance).alias("date_score"),
        _description(c("n_description"), c("n_words"), c("t_description"), c("t_words"), c("both")).alias("description_score"),
        _vendor(c("n_vendor"), c("t_vendor")).alias("vendor_score"),
        _exact(c("amount"), c("tx_amount"), c("date"), c("tx_date"), c("n_vendor"), c("n_source"), c("t_source"), c("t_destination")).alias("is_exact"),
    )
    weighted = sum((c(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0))
    total = F.when(c("is_exact"), F.greatest(weighted, F.lit(EXACT))).otherwise(weighted) if override else weighted
    reasons = F.array_compact(F.array(F.when(c("is_exact") & F.lit(override), "EXACT_MATCH"), *[F.when(c(f"{k}_score") > 500, k) for k in WEIGHTS]))
    return out.select("*", total.cast("int").alias("total"), reasons.alias("reasons"))


def candidates(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every pair of documents and transactions, prepared; ledger columns get the prefix tx_. For tables of a few rows."""
    return prepared(docs).crossJoin(prepared_ledger(ledger))


def exact_matches(docs: DataFrame, ledger: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """All pairs that is_exact() holds for, scored: they are equal in amount and day, by which they are joined."""
    pairs = prepared(docs).join(prepared_ledger(ledger), (F.col("amount") == F.col("tx_amount")) & (F.col("date").cast("date") == F.col("tx_date").cast("date")))
    return scored(pairs, tolerance).where("is_exact")


def _units(amount: Column) -> Column:
    """An amount in ten-thousandths, as a long: exact like a decimal, and many times faster to compare."""
    return (amount.cast("decimal(22,4)") * 10_000).try_cast("long")


def _best(pairs: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(F.desc("total"), F.col("tx_date").desc_nulls_last(), "tx_ledger_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _related(docs: DataFrame, tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (millionths) of all pairs of distinct vendors, and of distinct descriptions, that have any."""
    texts = lambda df, c: df.select(c).distinct().where(F.col(c) != "")
    v, tv, s, ts = texts(docs, "n_vendor"), texts(tx, "t_vendor"), texts(docs, "n_description"), texts(tx, "t_description")
    first = lambda df, c: df.select(F.col(c), F.regexp_extract(c, r"^\S*", 0).alias("word"))
    same_first = first(v, "n_vendor").join(first(tv, "t_vendor"), "word").select("n_vendor", "t_vendor")
    vendors = contained_either_way(v, tv).union(same_first).distinct().toDF("n_vendor", "t_vendor")
    vendors = vendors.select("*", (_vendor(F.col("n_vendor"), F.col("t_vendor")) * WEIGHTS["vendor"]).alias("v_points"))
    descriptions = contained_either_way(s, ts).union(sharing(s, ts, words, 3)).distinct().toDF("n_description", "t_description")
    points = _description(F.col("n_description"), words(F.col("n_description")), F.col("t_description"), words(F.col("t_description"))) * WEIGHTS["description"]
    return vendors.where("v_points > 0"), descriptions.select("*", points.alias("d_points")).where("d_points > 0")


def _points(tolerance: int) -> Points:
    """Amounts and days in millionths, as the scores weigh them."""
    level = lambda n: max(math.floor(1000 - n * 1000 / (tolerance + 1) + 0.5), 300) if n else 1000
    days = [(n, level(n)) for n in range(tolerance + 1)] + [(2 * tolerance, 200)] * (tolerance > 0) + [(30, 100)] * (2 * tolerance < 30)
    day = F.lit("1970-01-01").cast("date")
    return Points(
        tuple((p, WEIGHTS["amount"] * s) for p, s in ((0, 1000), (1, 950), (5, 700), (10, 400), (20, 200))),
        tuple((n, WEIGHTS["date"] * s) for n, s in days),
        lambda a, b: amount_score(a, b) * WEIGHTS["amount"],
        lambda n: date_score(day, F.date_add(day, n.cast("int")), tolerance) * WEIGHTS["date"],
    )


#: Pairs up to which a floor of 0, which asks for all pairs, is admitted.
ALL_PAIRS = 10_000_000


def _owners(owner: Column) -> Column:
    """An owner as a part of keys; nobody's is empty."""
    return F.coalesce(F.concat(F.lit("="), owner.cast("string")), F.lit(""))


def top_matches(docs: DataFrame, ledger: DataFrame, top: int = TOP, floor: int = FLOOR, tolerance: int = TOLERANCE_DAYS, owner: str | None = None, all_pairs: int = ALL_PAIRS, details: bool = True) -> DataFrame:
    """The best `top` transactions of every document, of all that score the floor or more; ties by later date, then ledger_id.

    Returns document_id, tx_ledger_id, tx_date, the four scores, is_exact, total, reasons and rank. owner: a
    column of both; a document then sees the transactions of its owner and of nobody (null), a document of nobody only the latter.
    All owners are matched at once: the owner is a part of every key, documents visit nobody's keys besides, and no transaction is copied.

    details: without, the four scores and reasons are left out, and texts aren't read again for them.

    No pair is left out, and not all are compared: see pairing.best_partners(). Each transaction belongs to the group of its owner, of its
    description and of its vendor, as far as any document's is related (distinct texts that contain each other or share words), and a document is
    searched for in all groups related to it. A text that few transactions have is joined, exact matches by amount and day. Transactions that differ in ledger_id only are
    interchangeable, and only the first `top` of them take part. A floor of 0 or less asks for every pair and compares every pair;
    it is refused for more pairs than all_pairs.
    """
    c = F.col
    o = (lambda p: _owners(c(f"{p}{owner}"))) if owner else (lambda p: F.lit(""))
    paths = []

    def kept(df: DataFrame) -> DataFrame:
        """df as a stored table: each is read several times."""
        out, path = stored(df)
        paths.append(path)
        return out

    try:
        d = kept(prepared(docs).select("document_id", _units(c("amount")).alias("amount"), c("date").cast("date").alias("date"), "n_description", "n_vendor", "n_source", o("").alias("o")))
        t = prepared_ledger(ledger).select("tx_ledger_id", _units(c("tx_amount")).alias("tx_amount"), c("tx_date").cast("date").alias("tx_date"), "t_description", "t_vendor", "t_source", "t_destination", o("tx_").alias("tx_o"))
        same = Window.partitionBy("tx_o", "tx_amount", "tx_date", "t_description", "t_source", "t_destination").orderBy("tx_ledger_id")
        t = kept(t.withColumn("nth", F.row_number().over(same)).where(c("nth") <= top).drop("nth"))
        out = ["document_id", "tx_ledger_id", "tx_date", *[f"{k}_score" for k in WEIGHTS], "is_exact", "total", "reasons"]
        worded = lambda pairs: pairs.withColumns({"n_words": words(c("n_description")), "t_words": words(c("t_description"))})  # noqa: E731  words are made where they are used, not shuffled
        visits = F.explode(F.array_distinct(F.array("o", F.lit(""))))
        if floor <= 0:
            if (n := d.count() * t.count()) > all_pairs:
                raise ValueError(f"a floor of {floor} compares all {n} pairs; raise all_pairs to allow it")
            pairs = d.select(*[x for x in d.columns if x != "o"], visits.alias("o")).join(t, c("o") == c("tx_o"))
            return checkpoint(_best(scored(worded(pairs), tolerance).where(c("total") >= floor).select(out), top))
        vendors, descriptions = map(kept, _related(d, t))
        day = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date")).alias("day")
        # groups of transactions: those of an owner, and those of many whose texts are related to a document's; of vendors also by description
        some = lambda kind, keys, related, least: t.join(related.distinct(), related.columns, "left_semi").groupBy("tx_o", *keys).agg(F.count("*").alias("n")).where(c("n") > least).select(
            F.lit(kind).alias("kind"), "tx_o", *[(c(x) if x in keys else F.lit(None).cast("string")).alias(x) for x in ("t_vendor", "t_description")])
        many = some("v", ["t_vendor"], vendors.select("t_vendor"), FEW).unionByName(some("d", ["t_description"], descriptions.select("t_description"), FEW))
        if owner:
            many = many.unionByName(t.select(F.lit("n").alias("kind"), "tx_o", F.lit(None).cast("string").alias("t_vendor"), F.lit(None).cast("string").alias("t_description")).distinct())
        many = kept(many)
        of_vendors = many.where("kind = 'v'").select("tx_o", "t_vendor")
        both = t.join(of_vendors, ["tx_o", "t_vendor"], "left_semi").join(descriptions.select("t_description").distinct(), "t_description", "left_semi")
        both = both.select(F.lit("b").alias("kind"), "tx_o", "t_vendor", "t_description").distinct()
        groups = kept(many.unionByName(both).withColumn("gid", F.monotonically_increasing_id()))
        kinds = {r[0] for r in groups.select("kind").distinct().collect()}
        keys = {"n": ["tx_o"], "v": ["tx_o", "t_vendor"], "d": ["tx_o", "t_description"], "b": ["tx_o", "t_vendor", "t_description"]}
        group = lambda kind: groups.where(c("kind") == kind).select(*keys[kind], "gid")
        right = t.select("*", c("tx_ledger_id").alias("other"), c("tx_date").alias("tie"), c("tx_amount").alias("amount"), day("tx_date"), (F.array() if owner else F.array(F.lit(ALL))).cast("array<bigint>").alias("gids"))
        for kind in sorted(kinds):
            right = right.join(group(kind), keys[kind], "left").withColumn("gids", F.when(c("gid").isNull(), c("gids")).otherwise(F.array_append("gids", c("gid")))).drop("gid")
        # the groups of distinct owners and texts of documents, with their points
        lines = lambda df, mine: df.groupBy(*mine).agg(F.collect_list(F.struct("gid", c("extra").cast("int").alias("extra"))).alias("more"))
        left = d.withColumn("lines", F.array() if owner else F.array(F.struct(F.lit(ALL).cast("long").alias("gid"), F.lit(0).alias("extra")))).withColumn("lines", c("lines").cast("array<struct<gid:bigint,extra:int>>"))
        for kind in sorted(kinds):
            mine = {"n": ["o"], "v": ["o", "n_vendor"], "d": ["o", "n_description"], "b": ["o", "n_vendor", "n_description"]}[kind]
            seen = d.select(*mine).distinct().withColumn("tx_o", visits)
            if "n_vendor" in mine:
                seen = seen.join(vendors, "n_vendor")
            if "n_description" in mine:
                seen = seen.join(descriptions, "n_description")
            extra = sum((c(x) for x in ("v_points", "d_points") if x in seen.columns), F.lit(0))
            left = left.join(lines(seen.withColumn("extra", extra).join(group(kind), keys[kind]), mine), mine, "left").withColumn("lines", F.when(c("more").isNull(), c("lines")).otherwise(F.concat("lines", "more"))).drop("more")
        left = kept(left.select(c("document_id").alias("id"), "amount", day("date"), c("lines.gid").alias("gids"), c("lines.extra").alias("extras")).where(F.size("gids") > 0))
        right = kept(right.select("other", "tie", "amount", "day", "gids"))
        points = _points(tolerance)
        numbers = points.of_amounts(c("amount"), c("tx_amount")) + points.of_days(F.abs(F.datediff("date", "tx_date")))
        seen = d.select("document_id", "amount", "date", "n_description", "n_vendor", visits.alias("tx_o"))
        pairs = lambda df: df.where(c("total") >= floor).select(c("document_id").alias("id"), c("tx_ledger_id").alias("other"), c("tx_date").alias("tie"), c("total").cast("long").alias("total"))
        of_few = lambda kind, related: t.join(group(kind), keys[kind], "left_anti").join(related, keys[kind][1])
        named = seen.join(of_few("v", vendors), ["tx_o", "n_vendor"]).withColumn("total", numbers + c("v_points")).where(c("total") >= floor - 1000 * WEIGHTS["description"])
        more = pairs(named.join(descriptions, ["n_description", "t_description"], "left").withColumn("total", c("total") + F.coalesce("d_points", F.lit(0)))).withColumn("is_exact", F.lit(False))
        described = of_few("d", descriptions)
        if not described.isEmpty():
            more = more.unionByName(pairs(seen.join(described, ["tx_o", "n_description"]).withColumn("total", numbers + c("d_points"))).withColumn("is_exact", F.lit(False)))
        by_day = d.select(*[x for x in d.columns if x != "o"], visits.alias("o")).join(t, (c("o") == c("tx_o")) & (c("amount") == c("tx_amount")) & (c("date") == c("tx_date")))
        more = more.unionByName(pairs(scored(worded(by_day), tolerance).where("is_exact")).withColumn("is_exact", F.lit(True)))
        found = best_partners(left, right, points, top, floor, more)
        found = found.select(c("id").alias("document_id"), c("other").alias("tx_ledger_id"), c("tie").alias("tx_date"), "is_exact", "total", "rank")
        if not details:
            return found
        found = found.select("document_id", "tx_ledger_id", "rank").join(d.drop("o"), "document_id").join(t.drop("tx_o"), "tx_ledger_id")
        return checkpoint(scored(worded(found), tolerance).select(*out, "rank"))
    finally:
        for path in paths:
            discard(docs.sparkSession, path)


def reverse_matches(ledger: DataFrame, docs: DataFrame, top: int = TOP, owner: str | None = None) -> DataFrame:
    """The best documents of every transaction, by the reverse view's own formula of amount and date.

    Amounts count 600 if equal and 570, 480, 360, 240 below 1, 5, 10, 20 percent; dates 400, 360, 280, 200,
    120 on the day and within 3, 7, 14, 30 days; from 200 on a pair counts. Ties by document_id. owner: as in top_matches(): an owner's
    transactions meet its documents, nobody's transactions the documents of all.
    """
    c = F.col

    def amounts(tx: Column, doc: Column) -> Column:
        gap, base = F.abs(doc - tx) * 100, F.abs(tx)
        return F.coalesce(F.when(gap == 0, 600).when(gap < base, 570).when(gap < base * 5, 480).when(gap < base * 10, 360).when(gap < base * 20, 240), F.lit(0))

    def days(n: Column) -> Column:
        return F.coalesce(F.when(n == 0, 400).when(n <= 3, 360).when(n <= 7, 280).when(n <= 14, 200).when(n <= 30, 120), F.lit(0))

    points = Points(((0, 600), (1, 570), (5, 480), (10, 360), (20, 240)), ((0, 400), (3, 360), (7, 280), (14, 200), (30, 120)), amounts, days, of_left=True)
    o = _owners(c(owner)) if owner else F.lit("")
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day")
    tx = ledger.select(c("ledger_id").alias("id"), o.alias("o"), _units(c("amount")).alias("amount"), day)
    papers = docs.select(c("document_id").alias("other"), F.lit(None).cast("date").alias("tie"), o.alias("o"), _units(c("amount")).alias("amount"), day)
    same = Window.partitionBy("o", "amount", "day").orderBy("other")
    papers = papers.withColumn("nth", F.row_number().over(same)).where(c("nth") <= top).drop("nth")
    everyone = F.array(F.lit(ALL).cast("long"))
    paths = []
    if owner:  # an owner's papers are a group besides that of all papers, which nobody's transactions meet
        papers, path = stored(papers)
        groups, groups_path = stored(papers.select("o").distinct().where("o <> ''").withColumn("gid", F.monotonically_increasing_id()))
        paths = [path, groups_path]
        tx = tx.join(groups, "o", "left").withColumn("gids", F.when(c("o") == "", everyone).when(c("gid").isNotNull(), F.array("gid"))).where("gids is not null")
        papers = papers.join(groups, "o", "left").withColumn("gids", F.when(c("gid").isNull(), everyone).otherwise(F.array(F.lit(ALL).cast("long"), "gid")))
    else:
        tx, papers = tx.withColumn("gids", everyone), papers.withColumn("gids", everyone)
    left, left_path = stored(tx.select("id", "amount", "day", "gids", F.array(F.lit(0)).alias("extras")))
    right, right_path = stored(papers.select("other", "tie", "amount", "day", "gids"))
    found = best_partners(left, right, points, top, 200)
    for path in [*paths, left_path, right_path]:
        discard(docs.sparkSession, path)
    return found.select(c("other").alias("document_id"), c("id").alias("tx_ledger_id"), c("total").alias("score"), "rank")


def unambiguous(proposals: DataFrame, threshold: int = AUTO) -> DataFrame:
    """Pending proposals to link by themselves: the only one of their transaction at or above the threshold."""
    strong = F.count_if(F.col("total") >= threshold).over(Window.partitionBy("ledger_id"))
    return proposals.where("status = 'PENDING'").withColumn("strong", strong).where((F.col("strong") == 1) & (F.col("total") >= threshold)).drop("strong")


def proposals(found: DataFrame, threshold: int = AUTO) -> DataFrame:
    """Proposals of matches: AUTO_MATCHED from the threshold on and where the match is exact, else PENDING."""
    status = F.when((F.col("total") >= threshold) | F.col("is_exact"), "AUTO_MATCHED").otherwise("PENDING")
    reasons = [x for x in ("reasons",) if x in found.columns]  # not there without details
    return found.select("document_id", F.col("tx_ledger_id").alias("ledger_id"), "total", "is_exact", *reasons, "rank", status.alias("status"))


def auto_matched(ledger: DataFrame, made: DataFrame) -> DataFrame:
    """ledger (ledger_id, match_status, document_id, ...) after AUTO_MATCHED proposals: rows are MATCHED with the document that proposes them last.

    Documents propose in order of document_id. match_confidence is the total of that proposal; null where the ledger's row stays as it is.
    """
    last = made.where("status = 'AUTO_MATCHED'").groupBy("ledger_id").agg(F.max(F.struct("document_id", "total")).alias("__m"))
    out = ledger.join(last, "ledger_id", "left")
    hit = F.col("__m").isNotNull()
    return out.withColumns({
        "match_status": F.when(hit, "MATCHED").otherwise(F.col("match_status")), "document_id": F.coalesce("__m.document_id", "document_id"), "match_confidence": F.col("__m.total"),
    }).drop("__m")
