"""Matching for all owners at once, against all pairs with the ownership predicate; interchangeable rows; the guard of a floor of 0."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching
from ledgerloom.sources.views import spark_views

SF = "/root/testdata/sf0.001"
SEEN = "tx_owner = owner or tx_owner is null"


def _tables(spark):
    docs, ledger = spark_views(spark, SF, "proposal", "ledger")
    who = lambda k: F.when(k % 5 != 0, F.concat(F.lit("u"), (k % 3).cast("string")))
    docs = docs.where("document_id % 11 = 0").withColumn("owner", who(F.col("document_id"))).withColumn("amount", F.when(F.col("document_id") % 4 != 0, F.col("amount")))
    ledger = ledger.where("ledger_id % 3 = 0").withColumn("owner", who(F.col("ledger_id") + 1)).withColumn("date", F.when(F.col("ledger_id") % 7 != 0, F.col("date")))
    # many rows that differ in their id only
    copies = ledger.where("ledger_id % 30 = 0").withColumn("ledger_id", F.explode(F.sequence(F.col("ledger_id") + 100_000, F.col("ledger_id") + 1_600_000, F.lit(100_000))))
    return docs.cache(), ledger.unionByName(copies).cache()


@pytest.mark.parametrize("floor", [200_000, 550_000])
def test_all_owners_at_once_equal_all_pairs(spark, floor):
    docs, ledger = _tables(spark)
    rows = lambda df: sorted((r.document_id, r["rank"], r.tx_ledger_id, r.total) for r in df.collect())
    pairs = matching.candidates(docs, ledger).where(SEEN)
    want = rows(matching._best(matching.scored(pairs).where(F.col("total") >= floor), 5))
    assert want and rows(matching.top_matches(docs, ledger, floor=floor, owner="owner")) == want


def test_the_reverse_view_of_all_owners(spark):
    docs, ledger = _tables(spark)
    rows = lambda df: {(r.tx_ledger_id, r["rank"]): (r.document_id, r.score) for r in df.collect()}
    mine = rows(matching.reverse_matches(ledger, docs, owner="owner"))
    owners = [r[0] for r in ledger.select("owner").distinct().collect()]
    one = {}
    for o in owners:  # owner by owner, as one that has none
        seen = docs if o is None else docs.where(F.col("owner") == o)
        one |= rows(matching.reverse_matches(ledger.where(F.col("owner").eqNullSafe(o)), seen))
    assert mine == one and len(mine) > 100


def test_a_floor_of_nothing_is_bounded(spark):
    docs, ledger = _tables(spark)
    with pytest.raises(ValueError, match="compares all"):
        matching.top_matches(docs, ledger, floor=0, all_pairs=1000)


def test_automatic_proposals(spark):
    found = spark.createDataFrame([(1, 7, 910_000, False, ["amount"], 1), (2, 7, 950_000, False, [], 1), (2, 8, 300_000, True, [], 2), (3, 9, 899_999, False, [], 1)], "document_id long, tx_ledger_id long, total int, is_exact boolean, reasons array<string>, rank int")
    made = matching.proposals(found)
    assert {(r.document_id, r.ledger_id): r.status for r in made.collect()} == {(1, 7): "AUTO_MATCHED", (2, 7): "AUTO_MATCHED", (2, 8): "AUTO_MATCHED", (3, 9): "PENDING"}
    ledger = spark.createDataFrame([(7, "UNMATCHED", None), (8, "UNMATCHED", None), (9, "MATCHED", 5)], "ledger_id long, match_status string, document_id long")
    got = {r.ledger_id: (r.match_status, r.document_id, r.match_confidence) for r in matching.auto_matched(ledger, made).collect()}
    assert got == {7: ("MATCHED", 2, 950_000), 8: ("MATCHED", 2, 300_000), 9: ("MATCHED", 5, None)}
