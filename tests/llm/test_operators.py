"""The training-data operators on odd inputs, against brute force and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, chat, decontamination, html_text, language, mixing, near_dup, passages, sharding, url_filter
from ledgerloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
R = random.Random(3)
VOCABULARY = ["".join(R.choices("abcdefghijklmnop", k=R.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def edited(text, every, seed):
    r, w = random.Random(seed), text.split()
    return " ".join(r.choice(VOCABULARY) if i % every == every - 1 else x for i, x in enumerate(w))


def corpus():
    rows = [(i, prose(60 + i % 40, i), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, rows[0][1], "en", "hot", 0) for i in range(30)]  # a third are copies
    rows += [(200 + i, edited(rows[1][1], 37, i), "en", None, 0) for i in range(5)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, "  \n ", "en", "s0", 0), (303, "one", "en", "s0", 0), (304, "ONE", "en", "s0", 0)]
    rows += [(305, prose(30_000, 9), "en", "s1", 0), (7, rows[7][1], "en", "s1", 0), (None, "no id here at all", "en", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(corpus(), DOCS).repartition(3)
    return extra.withColumns({"size": F.lit("clash"), "sid": F.lit("clash"), "words": F.lit(1), "id": F.lit(2), "n": F.lit(0), "rank": F.lit(0), "score": F.lit("x"), "h": F.lit("x"), "piece": F.lit(0)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORD.findall((text or "").translate(low))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, k, percent):
    rows = [r for r in corpus()]
    sets = [shingle_set(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    expected = sorted((str(r[0]), len(sets[i]), str(least.get(root(i)))) for i, r in enumerate(rows))
    got = near_dup.near_duplicates(docs, k, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_large_group(spark):
    base = prose(80, 1)
    rows = [(i, edited(base, 50, i), "en", "s", 0) for i in range(600)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).groupBy("component_id").count().collect()
    sets = [shingle_set(r[1], 3) for r in rows]
    seen, classes = set(), 0
    for i in range(len(rows)):
        if i not in seen:
            classes += 1
            todo = [i]
            seen.add(i)
            while todo:
                x = todo.pop()
                for j in range(len(rows)):
                    if j not in seen:
                        n = len(sets[x] & sets[j])
                        if 100 * n >= 85 * (len(sets[x]) + len(sets[j]) - n):
                            seen.add(j)
                            todo.append(j)
    assert len(got) == classes


def test_near_duplicates_in_crowded_buckets(spark):
    """Thousands of documents share a passage, so buckets hold sets that their least one does not fit."""
    passage = prose(75, 1)
    rows = [(i, f"{passage} {prose(50, 1000 + i)}") for i in range(3000)]
    for i in range(60):
        w = rows[i * 7][1].split()
        w[80], w[95], w[110] = "first", "second", "third"  # 9 of 123 shingles: 114 of 132 stay common
        rows.append((10_000 + i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).where("not kept").collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(10_000 + i, i * 7) for i in range(60)}


def test_deduplicate_keeps_one_of_each(docs, none):
    out = near_dup.deduplicate(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 0 in ids and not set(range(100, 130)) & set(ids) and ids.count(7) == 1
    assert {300, 301, 302, 305} <= set(ids) and None in ids
    assert near_dup.deduplicate(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7)], "u long, v long")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}
    assert components(edges.where("u < 0")).count() == 0


def test_passages_found_and_clean_left(spark, none):
    shared = prose(55, 77)
    rows = [(i, f"{prose(90, 1000 + i)} {shared if i % 3 == 0 else ''} {prose(70, 2000 + i)}", "en", "s", 0) for i in range(60)]
    rows += [(500, " ".join([prose(20, 5)] * 8), "en", "s", 0), (501, " ".join([prose(20, 5)] * 9), "en", "s", 0), (502, None, None, None, 0), (503, "", None, None, 0)]
    rows += [(600, prose(40, 8), "en", "s", 0), (601, prose(40, 8), "en", "s", 0)]  # too short
    got = passages.repeated_passages(spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("x"))).collect()
    assert {r.doc_id for r in got} == {i for i in range(60) if i % 3 == 0} | {500, 501}
    for r in got:
        if r.doc_id < 60:
            assert r.start_word <= 90 and r.end_word >= 145 and r.class_doc_id == 0
    assert passages.repeated_passages(none).count() == 0


def test_passages_at_the_threshold(spark):
    rows = []
    for i in range(300):
        w = prose(50, 5000 + i).split()
        rows.append((2 * i, f"{prose(60, 6000 + i)} {' '.join(w)} {prose(60, 7000 + i)}"))
        w[25] = "changed"  # 41 of 51 shingles stay common
        rows.append((2 * i + 1, f"{prose(60 + i % 40, 8000 + i)} {' '.join(w)} {prose(60, 9000 + i)}"))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in got}) >= 2 * 298  # a pair shares no min-hash once in 600


def test_passages_against_brute_force(spark):
    """Every document with an exact run of 50 words of another is found on the smallest tables, and no passage without a partner."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r.doc_id: WORD.findall((r.text or "").translate(low)) for r in docs.collect()}
    seen = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(d)
    want = {d for ds in seen.values() if len(ds) > 1 for d in ds}
    got = passages.repeated_passages(docs).collect()
    assert len(want) > 10 and len(want - {r.doc_id for r in got}) <= 0.01 * len(want)
    sets = [shingle_set(" ".join(words[r.doc_id][r.start_word : r.end_word]), 5) for r in got]
    for i, r in enumerate(got):  # another passage of the class is as near as it says
        near = max((len(sets[i] & s) / len(sets[i] | s) for j, s in enumerate(sets) if got[j].doc_id != r.doc_id), default=0)
        assert r.end_word - r.start_word >= 40 and near >= 0.8


def test_compact_windows_are_the_cartesian_tree():
    r = np.random.default_rng(1)
    n, t, bits = 300, 9, np.uint64(10)
    rank = (r.permutation(n).astype(np.uint64) + np.uint64(1)) << bits | np.arange(n, dtype=np.uint64)
    rank[[0, 150, 151, n - 1]] = [0, 150, 151, n - 1]
    got = set(zip(*[x.tolist() for x in passages.compact_windows(rank, t, bits)], strict=True))
    want = set()
    for c in range(n):
        if rank[c] >> bits == 0:
            continue
        left, right = c, c
        while left and rank[left - 1] > rank[c]:
            left -= 1
        while right + 1 < n and rank[right + 1] > rank[c]:
            right += 1
        if right - left + 1 >= t:
            want.add((c, left, right))
    assert got == want


def test_language_on_held_out_and_odd_texts(spark, none):
    alphabets = {"xx": "abcdefgh", "yy": "fghijklmn", "zz": "éèüabz"}
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choices(a, k=r.randint(2, 8))) for _ in range(60)), lang, "s", 0) for lang, a in alphabets.items() for i in range(ord(lang[0]) * 100, ord(lang[0]) * 100 + 60)]
    odd = [(1, None, "xx", None, 0), (2, "", "xx", None, 0), (3, "12 34 !!", "xx", None, 0), (4, "abc", None, None, 0), (None, "fgh ijk", "yy", None, 0)]
    df = spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("clash"))
    out = language.identify(df, language.learn(df)).collect()
    by = {x.doc_id: x for x in out}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert all(by[x[0]].held_out == (zlib.crc32(str(x[0]).encode()) % 3 == 1) for x in rows)
    assert sum(by[x[0]].lang_pred == x[2] for x in held) / len(held) > 0.97
    assert {by[i].lang_pred for i in (1, 2, 3)} == {"und"} and by[4].lang_pred in alphabets and all(0 <= x.score <= 1 for x in out)
    assert language.identify(none, language.learn(none)).count() == 0
    assert {x.lang_pred for x in language.identify(df, language.learn(none)).collect()} == {"und"}


def grams(texts):
    """How often each byte followed each context of up to three bytes."""
    counts = {}
    for t in texts:
        t = b"   " + t
        for i in range(3, len(t)):
            for k in range(4):
                counts.setdefault(t[i - k : i], Counter())[t[i]] += 1
    return {c: (n, sum(n.values()), len(n)) for c, n in counts.items()}


def bits_of(counts, text):
    """Bits of a text after frozen statistics, byte by byte, by escapes of method C."""
    total, t = 0.0, b"   " + text
    for i in range(3, len(t)):
        for k in range(3, -1, -1):
            if not (seen := counts.get(t[i - k : i])):
                continue
            next_, n, d = seen
            if t[i] in next_:
                total -= math.log2(next_[t[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_equal_brute_force(spark, monkeypatch):
    r = random.Random(11)
    alphabets = {f"l{i:02d}": "abcdefghijklmnopqrstuvwxyzäöüéèабвгд 你好"[i : i + 12] for i in range(25)}
    rows = [(i * 10 + k, "".join(r.choices(a, k=80)), lang) for i, (lang, a) in enumerate(alphabets.items()) for k in range(3)]
    monkeypatch.setattr(language, "GROUP", 8)
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = {x: [t.encode() for i, t, lang in rows if lang == x and zlib.crc32(str(i).encode()) % 3 != 1] for x in model.langs}
    assert len(model.langs) > 20
    texts = [rows[0][1], rows[40][1], "never SEEN Ж 好 12", "", "x" * 70_000]
    bits, _ = language._score(model, language.pa.array(texts))
    for i, t in enumerate(texts[:4]):
        assert bits[i].tolist() == pytest.approx([bits_of(grams(learned[x]), t.encode()) for x in model.langs], rel=1e-5)


def test_language_of_repeats_long_texts_and_many_labels(spark):
    rows = [(7, "the same text again and again", "aa")] * 2000 + [(8, "der gleiche text noch einmal " * 20_000, "bb")] + [(100 + i, f"word{i} und", f"x{i:04d}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df, per_language=5, rows=320)
    assert model.langs == sorted({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1})  # one document of each, none left out
    assert model.n[model.lang == 0].sum() == len(rows[0][1])  # equal rows count once
    got = {x.doc_id: x.lang_pred for x in language.identify(df, model).where("doc_id < 100").collect()}
    assert got[7] == "aa" and got[8] == "bb"
    few = language.learn(df, per_language=5, rows=20)
    assert len(few.langs) == 20 and few.langs[0] == "aa"


def test_unknown_languages_are_rejected(spark):
    r = random.Random(12)
    rows = [(i, prose(80, i), "en") for i in range(60)]
    noise = "".join(map(chr, range(33, 127))) + "äöüßéабвгд"
    bad = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34", "en"), (1003, "".join(r.choices(noise, k=500)), None), (1004, "".join(r.choices("бвгджзклмн ", k=500)), None)]
    df = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string").withColumn("row", F.lit(1)).withColumn("p", F.lit("clash"))
    out = language.reject_unknown(df, language.learn(df.where("doc_id < 1000")))
    assert out.columns == df.columns and {x.doc_id for x in out.collect()} == set(range(60))


def test_shards_are_contiguous_balanced_and_gapless(docs, none):
    rows = sharding.assign_shards(docs, 5).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.size, -1 if r.text_crc32 is None else r.text_crc32) for r in rows) == sorted((size(t), zlib.crc32(t.encode()) if t is not None else -1) for _, t, *_ in corpus())
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        assert abs(sum(r.size for r in shard) - total / 5) <= largest
    last = -2
    for s in sorted(by):
        ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(by[s], key=lambda r: r.slot)]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
    assert sharding.assign_shards(none).count() == 0


def test_mix_meets_its_targets(docs, none):
    rows = mixing.taken(docs).collect()
    words = sorted(len(WORD.findall(r[1] or "")) for r in corpus())
    assert sorted(r["size"] for r in rows) == words
    total = {}
    for r in rows:
        assert r.taken <= 2 * r["size"]
        s = total.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
    assert all(abs(t - target) <= 1 for t, target, _ in total.values())
    assert sum(t for _, t, _ in total.values()) == pytest.approx(1.5 * sum(words))
    assert all(t <= 2 * s + 1e-6 for _, t, s in total.values())
    assert sorted(map(str, mixing.taken(docs).collect())) == sorted(map(str, rows))
    assert mixing.taken(none).count() == 0 and mixing.mix(docs).columns == docs.columns


def brute_targets(sizes):
    """Targets by handing out the excess over caps again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    goal, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, total = goal - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return {**capped, **{s: left * weight[s] / total for s in free}}
        capped |= {s: 2 * sizes[s] for s in over}


def test_mix_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = brute_targets(sizes)
    got, words = {}, Counter()
    for r in mixing.taken(docs).collect():
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r["size"]
        got[r.source] = got.get(r.source, 0) + r.taken
        words[r.doc_id] += r["size"]
    assert all(abs(got[s] - want[s]) <= 1 for s in want) and sum(words.values()) == sum(sizes.values())


def test_mix_tells_rows_apart(spark):
    """Rows without an id, rows that share one, and repeated rows are each taken as often as their own words are read."""
    rows = [(None, prose(50, i), "a", f"n{i}") for i in range(40)] + [(5, prose(30 + i, 100 + i), "b", f"s{i}") for i in range(40)] + [(6, "same words here", "b", "copy")] * 30 + [(7, None, "a", "x"), (8, "", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string").withColumn("times", F.lit("clash")).withColumn("k", F.lit("clash")).withColumn("th", F.lit(1))
    out = mixing.mix(df)
    assert out.columns == df.columns
    many = Counter((r.doc_id, r.text) for r in out.collect())
    had = Counter((r[0], r[1]) for r in rows)
    assert set(many) <= set(had) and all(n <= 2 * had[k] for k, n in many.items()) and not any(k[1] in (None, "") for k in many)
    expected = {}
    for r in mixing._taken(df).join(df.select("doc_id", "text", F.xxhash64("text").alias("h")).distinct(), (F.col("th") == F.col("h"))).collect():
        if r["size"]:
            key = (r[0], r.text)
            expected[key] = expected.get(key, 0) + (2 * r.taken + r["size"]) // (2 * r["size"])
    assert {k: n for k, n in expected.items() if n} == dict(many)
    assert mixing.mix(df.limit(0)).count() == 0


def test_shards_of_hot_ids(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "RANGE", 20)
    rows = [(None, f"null {i}") for i in range(300)] + [(7, f"hot {i % 250}") for i in range(400)] + [(i, f"t{i}" * (i % 9)) for i in range(100, 500)] + [(600, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard_of", F.lit("x")).repartition(7)
    bounds, hot = sharding._bounds(df)
    assert 7 in hot and len(bounds) > 10
    got = sharding.assign_shards(df, 6).collect()
    key = lambda i, crc, size: (-1 if i is None else i, -1 if crc is None else crc, size)
    ordered = sorted(key(i, None if t is None else zlib.crc32(t.encode()), len((t or "").encode()) + 8) for i, t in rows)
    assert [key(r.doc_id, r.text_crc32, r.size) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == ordered
    sharding.write_shards(df, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.shard, r.doc_id, r.text) for r in back.collect()).keys() and Counter(r.shard for r in back.collect()) == Counter(r.shard for r in got)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))


def test_schedule_spreads_sources(spark):
    s = spark.createDataFrame([("a", 50), ("b", 30), (None, 20)], "source string, blocks long")
    slots = mixing.schedule(s).orderBy("slot").collect()
    assert len(slots) == 100 and len({(r.source, r.block) for r in slots}) == 100
    for n in range(10, 100, 10):
        assert abs(sum(r.source == "a" for r in slots[:n]) - n / 2) <= 3


def test_decontamination_finds_reparameterised_items(spark, none):
    item = "A farmer named Alice sells 12 apples for 3.50 euros each and then Alice gives 12 more apples to the market before noon on that day"
    moved = item.replace("Alice", "Boris").replace("12", "77").replace("3.50", "4,25")
    mixed = moved.replace("77 more", "78 more")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    rows = [(1, f"{prose(30, 1)}. {item} {prose(20, 2)}"), (2, f"{prose(10, 3)}. {moved}"), (3, f"{prose(10, 4)}. {mixed}"), (4, prose(200, 5)), (5, None), (6, ""), (7, "too short"), (None, item), (1, prose(9, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("window", F.lit(0)).withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, bench).collect()}
    assert {(1, 1), (2, 1)} == set(got)
    assert got[1, 1].same_values and not got[2, 1].same_values and got[2, 1].n_slots >= 3
    assert {r.doc_id for r in decontamination.decontaminate(df, bench).collect()} == {3, 4, 5, 6, 7, None}
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.decontaminate(df, bench.where("item_id < 0")).count() == len(rows)


def test_decontamination_finds_items_of_numbers_by_their_values(spark, none):
    dense, words = "12 34 56 78 90 11.5 22 kg 33", "Compute 7 + 8, 9 + 1 and 2 + 3"
    bench = spark.createDataFrame([(1, dense), (2, words), (3, "5 6 7"), (2, "zzz " + words), (1, None)], "item_id long, text string")
    docs = [(1, f"{prose(20, 1)} {dense} {prose(20, 2)}"), (2, f"{prose(20, 3)} 13 35 57 79 91 12.5 23 kg 34 {prose(9, 4)}"), (3, f"{prose(9, 5)}. {words}"), (4, "5 6 7 5 6 7"), (5, None), (1, dense), (6, "12 34 56 78 90 11.5 22 kg 99")]
    got = {(r.doc_id, r.item_id, r.same_values) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1, True), (3, 2, True), (6, 1, True)}  # the last holds four of five windows
    assert decontamination.contaminated(none, bench).count() == 0


def test_decontamination_with_inserted_words_and_names_at_starts(spark):
    w = prose(54, 41).split()
    item = "Mary has 12 apples and " + prose(12, 42) + ".\nMary sells them at noon to " + prose(12, 43) + ". Mary goes home with " + prose(12, 44)
    bench = spark.createDataFrame([(1, " ".join(w)), (2, item)], "item_id long, text string")
    docs = [(1, f"{prose(30, 45)} {' '.join([*w[:27], 'inserted', *w[27:]])} {prose(30, 46)}"), (2, f"{prose(30, 47)} {' '.join([*w[:26], *w[27:]])}"),
            (3, item.replace("Mary", "Boris").replace("12", "77")), (4, item.replace("Mary goes", "Boris goes")), (5, prose(300, 48)), (6, item.lower())]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {(1, 1), (2, 1), (3, 2)} <= got and not {5} & {d for d, _ in got}


def brute_template(text, values, starts):
    """Words of a text as (kind, value), by a loop over its tokens in place of the operator's patterns."""
    import regex

    keep = lambda kind: (lambda m: f" \x01{kind}{m[0] if values else ''} ")
    t = regex.sub(r"(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*(?![\p{L}\p{N}])", keep("n"), text.replace("\u0130", "I"))
    units = {u.lower() for u in decontamination.UNITS}
    out, at = [], 0
    for m in regex.finditer(r"(\x01n\S* +)([\p{L}]+(?:/\p{L}+)?)(?![\p{L}\p{N}])", t):
        unit = m[2] if m[2].lower() in units else m[2].split("/")[0]
        if m.start() >= at and unit.lower() in units:
            out += [t[at : m.start(2)], f"\x01u{unit.replace('/', '') if values else ''} "]
            at = m.start(2) + len(unit)
    t = "".join([*out, t[at:]])
    places = {}
    for m in regex.finditer(r"\p{Lu}\p{L}*", t, overlapped=False):
        i = m.start()
        before, two = t[i - 1 : i], t[i - 2 : i]
        usual = len(two) == 2 and two[1] == " " and regex.match(r"[\p{Ll},;]", two[0])
        first = i == 0 or before == "\n" or (len(two) == 2 and two[1] in " \t\n\x0b\f\r" and regex.match(r"[\p{Ll},;.!?:]", two[0]))
        if usual or (starts and first):
            places[i] = m.end()
    chars, i = [], 0
    while i < len(t):
        if i in places:
            chars.append(f"\x01p{t[i : places[i]] if values else ''}")
            i = places[i]
        else:
            chars.append(t[i])
            i += 1
    t = "".join(chars).lower() + " "
    return regex.sub(r"(?:[^\p{L}\p{N}\x01.,]|[.,](?:(?<![0-9].)|(?![0-9])))+", " ", t).split()


def brute_contaminated(docs, items, percent=80):
    found = set()
    for starts in (False, True):
        own = {i: [(brute_template(t, False, starts), brute_template(t, True, starts)) for k, t in items if k == i and t] for i in {k for k, _ in items}}
        index, total = {}, {}
        for i, texts in own.items():
            for plain, _ in texts:
                for p in range(len(plain) - 4):
                    w = tuple(plain[p : p + 5])
                    if sum(not x.startswith("\x01") for x in w) >= 3:
                        index.setdefault(w, []).append((i, p))
                        total.setdefault(i, set()).add(w)
        for d, text in docs:
            plain, full = brute_template(text, False, starts), brute_template(text, True, starts)
            hits = {}
            for p in range(len(plain) - 4):
                for i, q in index.get(tuple(plain[p : p + 5]), ()):
                    hits.setdefault(i, set()).add((p - q, q, tuple(plain[p : p + 5])))
            for i, h in hits.items():
                bands = {}
                for shift, q, w in h:
                    for region in (("one", shift), ("wide", shift // 32), ("wide", shift // 32 + 1)):
                        bands.setdefault(region, set()).add((shift, q, w))
                for inside in bands.values():
                    if 100 * len({w for _, _, w in inside}) < percent * len(total[i]):
                        continue
                    weight, best = Counter(s for s, _, _ in inside), {}
                    for s, q, _ in inside:
                        best[q] = max(best.get(q, (0, 0)), (weight[s], -s))
                    values = own[i][0][1]
                    slots = {(values[q + k], full[q + k - b]) for q, (_, b) in best.items() for k in range(5) if values[q + k].startswith("\x01") and full[q + k - b].startswith("\x01")}
                    if len(slots) == len({a for a, _ in slots}) == len({b for _, b in slots}):
                        found.add((d, i))
    return found


def test_decontamination_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    odd = [(10_000 + i, f"{prose(20, i)}. {t} {prose(9, i)}") for i, (_, t) in enumerate(items[:10])] + [(20_000, prose(3000, 5) + items[0][1])]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text] + odd
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs.union(spark.createDataFrame(odd, "doc_id long, text string")), bench).collect()}
    want = brute_contaminated(rows, items)
    assert len(want) > 10 and got == want


def test_templates_have_equal_places(spark):
    texts = ["at 60 km/h for 5 km and 7 KM/H", "in \u0130stanbul, \u0130zmir and Bonn 3.50 euros", "Mary Ann had 1,000.5 kg/m. The 3 m/s", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    count = lambda values: F.size(F.split(F.rtrim(decontamination.template(F.col("text"), values)), " "))
    assert all(a == b for a, b in df.select(count(True), count(False)).collect())


def test_decontamination_after_a_unit_with_a_slash(spark):
    item = "a runner starts at the old mill and runs 5 km before lunch then rests and runs 7 km after lunch until the sun has set behind the hills"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    tail = " ".join(item.split()[:-3])
    docs = spark.createDataFrame([(1, f"at 60 km/h we drove on. {item}"), (2, f"{tail} near 9 trees")], "doc_id long, text string")
    bench = bench.union(spark.createDataFrame([(2, f"{tail} past 5 gates")], "item_id long, text string"))  # 5 stands for 9 in the part that is not held
    assert {(1, 1), (2, 2)} <= {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://WWW.Example.com/en/71?x", "www.example.com", "/en/71", "example.com/en/7", "allow"),
    ("http://a.com/en/", "a.com", "/en/", "com/en/", "block"),
    ("https://notcom/en/", "notcom", "/en/", None, "allow"),
    ("x://b.example.net/de/8#q", "b.example.net", "/de/8", "example.net/de/8", "block"),
    ("ftp://a.net/de/casino", "a.net", "/de/casino", "net/de/", "allow"),
    ("http://my-casino.org/x", "my-casino.org", "/x", None, "block"),
    ("http://casinos.org/casinox", "casinos.org", "/casinox", None, "allow"),
    ("http://cheap.org/cheap-cheap", "cheap.org", "/cheap-cheap", None, "allow"),
    ("http://cheap-PILLS.org", "cheap-pills.org", "", None, "block"),
    ("no scheme casino", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://?b", "", "", None, "allow"),
])
def test_url_filter(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    r = url_filter.judge(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_filter_of_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_nearest_on_odd_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 32))
    x[100:140] = x[100]  # copies tie
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, [None] + [1.0] * 31), (1004, [1.0] * 5), (None, x[0].tolist()), (5, x[5].tolist()), (1020, [float("inf")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for g in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert set(got) == set(range(0, 400, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        s = (x * x[q]).sum(axis=1)
        best = sorted((-s[i], i) for i in range(400) if i != q)[:20]
        hit += len({i for _, i in best} & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 21)) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(t == pytest.approx(s[v], abs=1e-12) for _, v, t in found)
    assert hit / (20 * len(got)) > 0.95
    few = df.where("vec_id < 8")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 7
    assert ann.nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_substrings_retrieve_all_within_radius_once():
    r = np.random.default_rng(4)
    codes = r.integers(0, 1 << 16, size=(3000, 4), dtype=np.uint16)
    for radius in (0, 2, 3, 9, 20, 26, 64):
        q, limits = codes[7] ^ np.uint16(5), ann.thresholds(radius, 4)
        found = np.concatenate([ann.matches(codes, q, j, limits, radius) for j in range(4) if limits[j] >= 0])
        assert sorted(found.tolist()) == np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius).tolist()


def test_nearest_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 512)  # several cells, and blocks of a hot one
    monkeypatch.setattr(ann, "VISITS", 64)
    r = np.random.default_rng(8)
    x = r.normal(size=(5000, 48)) + 2 * r.normal(size=(20, 48))[r.integers(0, 20, 5000)]
    x[:1500] = x[0] + 1e-3 * r.normal(size=(1500, 48))  # nearly one vector
    x[4990:] *= 0.01  # outliers
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    s = x[::20] @ x.T
    s[np.arange(250), np.arange(0, 5000, 20)] = -np.inf
    best = np.argsort(-s, axis=1, kind="stable")[:, :20]
    assert set(got) == set(range(0, 5000, 20)) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(b.tolist()) & got[20 * i]) for i, b in enumerate(best)) / 5000 > 0.9


def test_escapes_are_reversible():
    r = random.Random(6)
    for _ in range(2000):
        t = "".join(r.choices(["<", "|", "\\", "\n", "im_end", ">", "n"], k=r.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_chat_round_trip_and_prefix_tree(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"turn {k} of {c if k > 2 else 'all'} <|im_end|>\n<\\|") for c in range(12) for k in range(c % 5 + 1)]
    rows += [(50, 0, None, None), (50, None, "assistant", "first é 😀"), (50, 0, "assistant", "tie"), (51, 0, "a\nb", "x" * 50_000), (None, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("x")).repartition(5)
    nodes, paths = chat.pack(df)
    got = {r.conv_id: r for r in chat.digests(nodes, paths).collect()}
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((-(10**9) if k is None else k, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    found = chat.attention(nodes, paths).collect()
    assert len(found) == nodes.count() == len({tuple(t[: i + 1]) for t in (tuple((a, b) for _, a, b in sorted(x)) for x in by.values()) for i in range(len(t))})
    for tree in {r.tree for r in found}:  # depth first, without gaps
        own = sorted((r for r in found if r.tree == tree), key=lambda r: r.start)
        assert own[0].start == 0 and all(a.end == b.start for a, b in zip(own, own[1:]))
        for r in own:
            assert r.position == sum(s.end - s.start for s in r.ancestors) and len(r.ancestors) == r.depth
    assert chat.digests(*chat.pack(df.where("conv_id < -5"))).count() == 0


PAGES = [
    ("<html><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>A  title</h1><p>First &amp; last&nbsp;word\n here, and more of the text.</p><p>Second one.<script>x()</script></p></article><div class=comments><p>I disagree with all of that.</p></div><footer>&copy; x</footer></body></html>",
     "A title\nFirst & last word here, and more of the text.\nSecond one."),
    ("", ""), (None, ""), ("<p", ""), ("<html><body><nav><a href=/>x</a></nav><footer>&copy; 2020 all rights</footer></body></html>", ""),
]


def test_html_main_text(spark):
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_marginals_are_exact():
    import itertools

    model, nodes = html_text.trained(), html_text.parse("<div class=ad><p>a b</p></div><p>c d e f</p>")
    f = html_text.features(nodes)
    unary = [np.exp(sum((model.matrix[model.names[w]] for w in x if w in model.names), np.zeros(3))) for x in f]
    edge = np.exp(model.log_edge)
    total = np.zeros((len(nodes), 3))
    for states in itertools.product(range(3), repeat=len(nodes)):
        p = np.prod([unary[i][s] for i, s in enumerate(states)]) * np.prod([edge[states[x.parent], states[i]] for i, x in enumerate(nodes) if i])
        for i, s in enumerate(states):
            total[i, s] += p
    other = html_text.parse("<p>x</p>")
    got = model.marginals([other, nodes, other])
    assert np.allclose(got[1], total / total.sum(axis=1, keepdims=True)) and np.allclose(got[0], got[2]) and len(got[0]) == len(other)


def test_html_held_out_pages():
    model, right, n = html_text.trained(), 0, 0
    for page in html_text.labelled_pages(60, seed=1234):
        nodes = html_text.parse(page)
        for x, t, p in zip(nodes, html_text.truth(nodes), model.marginals([nodes])[0], strict=True):
            if x.tag == "#text" and x.text.strip():
                n += 1
                right += (p[1] >= 0.5) == (t == 1)
    assert right / n > 0.98
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert all(isinstance(x, str) for x in model.extract([deep + "<![if x]>" + "<p>word " * 2000, None, ""]))


def test_html_repeated_rows_and_batches(spark):
    page = PAGES[0][0]
    df = spark.createDataFrame([(i % 3, "u", page if i % 2 else "<p>" + "a word of text, and more. " * 40) for i in range(700)], "page_id long, url string, html string")
    got = html_text.extract(df).groupBy("text").count().collect()
    assert sorted(r["count"] for r in got) == [350, 350] and PAGES[0][1] in {r.text for r in got}
