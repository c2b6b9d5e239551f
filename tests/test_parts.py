"""Searches whose keys are met part by part: the same partners, fewer keys at once, and no table left behind."""

from __future__ import annotations

import os
import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ledgerloom.operators import pairing
from ledgerloom.operators.matching import reverse_matches
from ledgerloom.session import shared_folder


def test_parts_give_the_same_partners(spark, monkeypatch):
    rng = random.Random(5)
    frame = lambda n, key: spark.createDataFrame(
        [(i, rng.choice([None, *[str(rng.randint(9_000, 11_000) / 10)] * 9]), f"2020-{rng.randint(1, 4):02d}-{rng.randint(1, 28):02d}") for i in range(n)], f"{key} long, amount string, date string"
    ).select(key, F.col("amount").cast("decimal(18,2)"), F.col("date").cast("date")).cache()
    docs, ledger = frame(400, "document_id"), frame(60, "ledger_id")
    rows = lambda: sorted(map(tuple, reverse_matches(ledger, docs).collect()))
    keys, plain = [], pairing.reaching

    def counted(asked, used, *a, **k):
        of = a[-1][1]
        keys.append(max(u[-1] for u in used) // of if len(used) == 1 else sum(u[-1] for u in used))
        return plain(asked, used, *a, **k)

    folder = urlparse(shared_folder(spark)).path
    before = {x for x in os.listdir(folder) if x.startswith("table-")}
    monkeypatch.setattr(pairing, "reaching", counted)
    want = rows()
    once, most = len(keys), max(keys)
    keys.clear()
    monkeypatch.setattr(pairing, "KEYS", 600)
    assert rows() == want and len(want) > 250
    assert len(keys) > once and max(keys) <= 600 < most
    assert {x for x in os.listdir(folder) if x.startswith("table-")} == before
