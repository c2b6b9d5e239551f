"""Searches in tiles of amounts: equal to a loop over all pairs, and work that doesn't grow with the tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching, nearest, pairing

SEARCHES = {
    "forward": nearest.Search(((0, 400), (1, 380), (5, 280), (10, 160), (20, 80)), ((0, 250), (1, 219), (7, 75), (14, 50), (30, 25)), 5, False),
    "reverse": nearest.Search(((0, 600), (1, 570), (5, 480), (10, 360), (20, 240)), ((0, 400), (3, 360), (7, 280), (14, 200), (30, 120)), 5, True),
}


def _points(s, a, b, days):
    base, gap = abs(a if s.of_left else b), abs(a - b)
    within = lambda p: gap == 0 if p == 0 else gap * 100 < base * p if s.of_left else base > 0 and gap * 100 <= base * p
    return next((q for p, q in s.amounts if within(p)), 0), 0 if days is None else next((q for n, q in s.days if abs(days) <= n), 0)


@pytest.mark.parametrize("which", SEARCHES)
@pytest.mark.parametrize("spread", [3, 300, 100_000])
def test_first_partners_equal_a_loop(which, spread):
    s, rng = SEARCHES[which], np.random.default_rng(spread)
    n, m = 400, 60
    amount, day, dated, group = rng.integers(-spread // 3, spread, n) , rng.integers(0, 60, n), rng.random(n) > 0.1, rng.integers(0, 3, n)
    x = nearest.Index(amount, day, dated, np.arange(n), group, s.top)
    a, d, known = rng.integers(-spread // 3, spread, m), rng.integers(-10, 70, m), rng.random(m) > 0.1
    groups, extra = np.array([(0, 1), (1, 7)] * m)[:, 0], np.array([0, 100] * m)  # two groups each; 7 has no rows in some runs
    line, right, total, _ = nearest.first_partners(x, a, d, known, np.full(m, 2), groups, extra, np.full(m, 130), s)
    got = {}
    for i, r, t in zip(line.tolist(), right.tolist(), total.tolist(), strict=True):
        got.setdefault(i, []).append((-t, r))
    for i in range(m):
        pairs = []
        for r in range(n):
            if group[r] > 1:
                continue
            p, q = _points(s, int(a[i]), int(amount[r]), int(d[i] - day[r]) if known[i] and dated[r] else None)
            t = p + q + (100 if group[r] == 1 else 0)
            if t >= 130 and p:  # partners of a far amount are found by group and day
                pairs.append((-t, r))
        assert sorted(got.get(i, [])) == sorted(pairs)[:5], i


def test_firsts_of_spans():
    rng = np.random.default_rng(2)
    values = rng.permutation(5000)
    f = nearest.Firsts(values, 5)
    start, end = rng.integers(0, 5000, 300), rng.integers(0, 5000, 300)
    owner, value = f.of(start, end)
    assert len(value) < 300 * 600  # of spans of 1,700 on average
    for i in range(300):
        assert sorted(set(value[owner == i].tolist()))[:5] == sorted(values[start[i]:max(end[i], start[i])].tolist())[:5]


def _tables(spark, copies):
    rng = random.Random(4)
    vendors = ["shop", "the shop", "market hall", "market", "x"]
    rows = lambda n, key: spark.createDataFrame(
        [(i, None if rng.random() < 0.05 else str(rng.randint(-2_000, 30_000) / 100), None if rng.random() < 0.05 else f"2020-{rng.randint(1, 6):02d}-{rng.randint(1, 28):02d}",
          rng.choice(["rent may", "rent", "the rent may", "fee", None, ""]), rng.choice([*vendors, None]), rng.choice([*vendors, None])) for i in range(n)],
        f"{key} long, amount string, date string, description string, {'vendor' if key == 'document_id' else 'destination_account'} string, source_account string").withColumns({"amount": F.col("amount").cast("decimal(18,2)"), "date": F.col("date").cast("date")}).cache()
    return rows(80, "document_id"), rows(400 * copies, "ledger_id")


@pytest.mark.parametrize("details", [True, False])
def test_many_tiles_equal_all_pairs(spark, monkeypatch, details):
    """Large groups of vendors and descriptions, and amounts of several tiles."""
    monkeypatch.setattr(pairing, "TILE", 60)
    docs, ledger = _tables(spark, 1)
    rows = lambda df: sorted((r.document_id, r["rank"], r.tx_ledger_id, r.total, r.is_exact) for r in df.collect())
    want = rows(matching._best(matching.scored(matching.candidates(docs, ledger)).where("total >= 200000"), 5))
    assert len(want) > 300 and rows(matching.top_matches(docs, ledger, details=details)) == want


def test_work_does_not_grow_with_the_ledger(spark, monkeypatch):
    """Pairs that are put together for 80 documents, over a ledger and one eight times as large."""
    made, plain = [], pairing.ranked
    monkeypatch.setattr(pairing, "ranked", lambda pairs, top: made.append(pairs.count()) or plain(pairs, top))
    for copies in (1, 8):
        matching.top_matches(*_tables(spark, copies), details=False)
    assert made[1] < 1.5 * made[0], made
