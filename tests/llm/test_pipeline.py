"""The registered queries and the pipeline on the smallest tables."""

import math
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language, queries
from ledgerloom.llm.near_dup import near_duplicates

from test_operators import WORD, bits_of, brute_contaminated, brute_targets, grams, shingle_set

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name == "sharding":
            assert docs.count() == before.count()
        else:
            assert docs.columns == columns
        if name == "near_duplicates":
            left = near_duplicates(docs).where("n_shingles > 0")
            assert left.where("not kept").count() == 0 and 0 < docs.count() <= before.count()
    assert {r.law for r in docs.select("law").distinct().collect()} == {"bytes"}


ODD = [(None, "a text without an id that is long enough to be known as such", "en", "s", 1), (90_001, None, "en", None, None), (90_002, "", "en", "s", 0), (90_003, " \n ", None, "s", 0), (90_004, "12 34 56", "en", "s", 0), (90_005, "x", "en", None, 1)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables with odd rows, repeated rows, a very long text and further columns."""
    folder = tmp_path_factory.mktemp("small")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("text is not null").orderBy("doc_id").first()
    more = spark.createDataFrame([*ODD, tuple(first), tuple(first), (first.doc_id, "another text under the same id, which is not a copy of it", "en", "s", 1), (90_006, (first.text + " ") * (200_000 // len(first.text) + 1), "en", "s", 1)], docs.schema)
    docs.union(more).withColumns({"row": F.lit("x"), "th": F.lit(1), "id": F.lit(2)}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_equal_brute_force(spark, small):
    """Each stage against loops over its own input."""
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")

    known = stages["language"](spark, docs, small).cache()
    model = language.learn(docs)
    learned = {}
    sample = [r for r in docs.collect() if r.lang is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and any(c.isalpha() for c in r.text or "")]
    for r in {(r.doc_id, r.lang, r.text) for r in sample}:
        learned.setdefault(r[1], []).append(r[2].lower().encode())
    assert sorted(learned) == model.langs
    plain = Counter(b for ts in learned.values() for t in ts for b in t)
    total = sum(plain.values()) + 256
    kept = Counter()
    trees = {x: grams(ts) for x, ts in learned.items()}
    for r in docs.collect():
        text = (r.text or "").lower()
        if any(c.isalpha() for c in text):
            t = text.encode()
            if len(t) > 100_000:  # too long for the loop
                kept[r.doc_id, r.text] += 1
                continue
            bits = [bits_of(c, t) for c in trees.values()]
            share = 1 / sum(2.0 ** -min(b - min(bits), 1000) for b in bits)
            if share >= 0.5 and min(bits) < -sum(math.log2((plain[b] + 1) / total) for b in t):
                kept[r.doc_id, r.text] += 1
    assert rows(known) == kept and known.count() < docs.count()

    single = stages["near_duplicates"](spark, known, small).cache()
    sets = {k: shingle_set(k[1], 5) for k in kept}
    names = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    parent = {k: k for k in names}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(names):
        for b in names[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                parent[root(a)] = root(b)
    classes = {root(k) for k in names}
    left = rows(single)
    assert set(left.values()) == {1} and {root(k) for k in left} == classes and len(left) == len(classes)

    clean = stages["decontamination"](spark, single, small).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contaminated([k for k in left if k[0] is not None], items)}
    assert rows(clean) == Counter({k: 1 for k in left if k[0] not in bad})

    mixed = stages["mixing"](spark, clean, small).cache()
    sizes = Counter()
    for r in clean.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    target, got = brute_targets(sizes), Counter()
    for r in mixed.collect():
        got[r.source] += len(WORD.findall(r.text))
    longest = max(len(WORD.findall(r.text)) for r in clean.collect())
    assert all(n <= 2 for n in rows(mixed).values()) and set(rows(mixed)) <= set(rows(clean))
    assert all(abs(got[s] - target[s]) <= max(0.1 * target[s], longest) for s in target)

    shards = stages["sharding"](spark, mixed, small).collect()
    assert Counter((r.doc_id, r.size) for r in shards) == Counter((r.doc_id, len(r.text.encode()) + 8) for r in mixed.collect())
    for s in range(24):
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))


def test_stages_on_nothing_and_on_odd_rows_only(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for some in (docs.limit(0), docs.where("doc_id between 90001 and 90004")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, small)
            words = some.where("doc_id = 90004").count()  # the only row with words, which aren't a language
            assert out.count() == {"language": 0, "mixing": words}.get(name, some.count()), name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
