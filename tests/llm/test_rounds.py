"""Rounds over few edges are few tasks, and small buckets are joined instead of compared group by group."""

from __future__ import annotations

import random

import pytest

from ledgerloom.llm import common, near_dup


@pytest.fixture
def many_tasks(spark):
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rounds_over_few_edges_are_few_tasks(many_tasks, monkeypatch):
    parts = []
    real = common.checkpoint
    monkeypatch.setattr(common, "checkpoint", lambda df: parts.append((out := real(df)).rdd.getNumPartitions()) or out)
    edges = many_tasks.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "u long, v long")
    got = {r.id: r.label for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert len(parts) > 2 and max(parts[1:]) == 1


def test_small_and_large_buckets_give_the_same_classes(spark, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(500)]
    rows = []
    for family in range(12):  # chains of texts that change by a few words a step
        text = r.choices(words, k=60)
        for _ in range(12):
            rows.append((len(rows), " ".join(text)))
            for at in r.sample(range(60), r.randint(1, 2)):
                text[at] = r.choice(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert len(set(label)) < len(rows) - 20
    for small in (near_dup.SMALL, 0, 3):
        monkeypatch.setattr(near_dup, "SMALL", small)
        got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs, words=3, percent=85).collect()}
        assert got == dict(enumerate(label))
