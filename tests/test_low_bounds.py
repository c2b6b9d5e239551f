"""Searches by rows that few partners are near to: right results without pairs of all that tie."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.operators import pairing
from ledgerloom.operators.matching import reverse_matches


def test_ties_of_far_days_are_not_all_paired(spark, monkeypatch):
    """Transactions long after all documents tie with every document of their amount; only the first of each cell are met."""
    rng = random.Random(3)
    docs = [(i, rng.randint(99_200, 100_900) / 100, f"2020-01-{rng.randint(1, 28):02d}") for i in range(3000)]
    ledger = [(i, rng.choice([1000.0, 1001.5, 700.0, 840.25, 5.0, 0.0, -1000.0, None]), rng.choice(["2024-05-01", "2020-02-10", None])) for i in range(40)]
    frame = lambda rows, key: spark.createDataFrame([(k, None if a is None else str(a), d) for k, a, d in rows], f"{key} long, amount string, date string").select(
        key, F.col("amount").cast("decimal(18,2)"), F.col("date").cast("date"))
    seen = []
    plain = pairing.reaching

    def counted(*a, **k):
        out = plain(*a, **k)
        seen.append(out.count())
        return out

    monkeypatch.setattr(pairing, "reaching", counted)
    found = {(r.tx_ledger_id, r.rank): (r.document_id, r.score) for r in reverse_matches(frame(ledger, "ledger_id"), frame(docs, "document_id")).collect()}

    def points(doc, tx):
        (_, a, x), (_, b, y) = doc, tx
        n = None if y is None else abs(_day(x) - _day(y))
        gap = None if b is None else abs(round(a * 100) - round(b * 100)) * 100
        base = None if b is None else abs(round(b * 100))
        amount = 0 if gap is None else 600 if gap == 0 else next((p for k, p in ((1, 570), (5, 480), (10, 360), (20, 240)) if gap < base * k), 0)
        return amount + (0 if n is None else 400 if n == 0 else next((p for k, p in ((3, 360), (7, 280), (14, 200), (30, 120)) if n <= k), 0))

    want = {}
    for tx in ledger:
        best = sorted((-points(d, tx), d[0]) for d in docs if points(d, tx) >= 200)[:5]
        want |= {(tx[0], i + 1): (d, -p) for i, (p, d) in enumerate(best)}
    assert found == want and len(want) > 50
    assert sum(seen) < 10_000, sum(seen)  # pairs of all that tie


def _day(x):
    from datetime import date

    return date.fromisoformat(x).toordinal()
