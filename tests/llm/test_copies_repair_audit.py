"""Exact deduplication, conversation repair and the divergence audit: brute force, odd rows, hash clashes and small budgets."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, exact_dup, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CONV = "conv_id long, turn long, role string, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ("n", "hash", "ids", "variant", "term", "count", "p", "audit", "fault", "kind")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


# --- exact deduplication ---


def copies():
    r = random.Random(5)
    words = ["".join(r.choices("abÄé €", k=r.randint(0, 6))) for _ in range(30)]
    rows = [(i, r.choice(words) + r.choice(["", " tail", " TAIL", "İ"]), "en", "s", 0) for i in range(150)]
    rows += [(200 + i, "The Same Text", "en", "hot", 0) for i in range(80)] + [(300, "the same text", "de", None, 0)]
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, "x" * 300_000, "en", "s", 0), (403, "X" * 300_000, "en", "s", 0), (404, "x" * 299_999 + "y", "en", "s", 0)]
    return rows + [(None, "only without an id", "en", "s", 0), (None, "the SAME text", "en", "s", 0), (300, "the same text", "de", None, 0), (3, "another text of three", "en", "s", 0)]


def owners(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        seen = set()
        for i in ids:
            out.append((i, best, len(ids), i == best and i not in seen, hashlib.sha256(text.encode()).hexdigest()))
            seen.add(i)
    return Counter(out)


@pytest.mark.parametrize(("keep", "memory", "most"), [("largest", 1 << 25, 1 << 16), ("smallest", 2000, 50)])
def test_exact_duplicates_equal_brute_force(spark, keep, memory, most):
    df = clashing(spark.createDataFrame(copies(), DOCS).repartition(3))
    got = exact_dup.exact_duplicates(df, keep, memory, most)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == owners(copies(), max if keep == "largest" else min)


def test_exact_duplicates_of_nothing(spark):
    assert exact_dup.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="largest or smallest"):
        exact_dup.exact_duplicates(spark.createDataFrame([], DOCS), "first")


def test_texts_that_share_a_hash_are_told_apart():
    rows = [(3, b"h", b"abc", [1]), (3, b"h", b"abd", [2, 3]), (3, b"h", b"abc", [4]), (3, b"i", b"abc", [5])]
    (out,) = exact_dup._owners()([exact_dup._batch(rows)])
    assert [(r["doc_id"], r["hash"], r["variant"]) for r in out.to_pylist()] == [(1, b"h", 0), (2, b"h", 1), (3, b"h", 1), (4, b"h", 0), (5, b"i", 0)]


def test_trie_holds_and_spills_what_was_inserted():
    r = random.Random(1)
    for _ in range(300):
        trie, want = exact_dup.Trie(), defaultdict(list)
        for i in range(r.randint(0, 60)):
            key = bytes(r.choices(b"ab", k=r.randint(0, 12)))
            trie.insert(key).append(i)
            want[key].append(i)
        assert dict(trie.all()) == want
        got = {b"": want[b""]} if b"" in want else {}
        while trie.root.children:
            got.update(trie.spill())
        assert got == want
        assert trie.weight == 0


# --- conversation repair ---


def best_edits(rows):
    """Least (cost, edits), from the end: rows of (initial, fault)."""
    inserts = {0: [("", 0), ("I", 2), ("II", 3)], 1: [("", 1), ("I", 2), ("II", 3)], 2: [("", 2), ("I", 3), ("II", 2)], 3: [("", 3), ("I", 2), ("II", 3)]}

    @lru_cache(None)
    def ahead(i, state):
        ways = []
        for edits, middle in inserts[state]:
            cost = 3 * len(edits)
            if i == len(rows):
                if middle in (0, 3):
                    ways.append((cost, edits))
                continue
            initial, fault = rows[i]
            steps = [(4, "D", middle)]
            if fault in (0, 3):
                steps.append((3 + (fault == 3) * 3, "R", 3 if middle == 2 else 2))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, middle))
                if to is not None:
                    steps.append(((fault == 3) * 3, "K", to))
            ways += [(cost + c + ahead(i + 1, to)[0], edits + e + ahead(i + 1, to)[1]) for c, e, to in steps]
        return min(ways)

    return ahead(0, 0)


def repaired(rows):
    """All columns but conv_id of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r))
    seen, coded, counts = set(), [], [0, 0, 0, 0]
    for t, role, x in rows:
        body = x.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not body else 2 if (role, x) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, x))
        counts[fault] += 1
        coded.append((role[:1], fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
    cost, audit = best_edits(tuple(coded))
    out, i, now = [], 0, ""
    for e in audit:
        written = "assistant" if now == "u" else "user"
        if e == "I":
            out.append((written, ""))
        elif e != "D":
            out.append((rows[i][1] if e == "K" else written, rows[i][2]))
        i += e != "I"
        now = out[-1][0][:1] if out else ""
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()


def talk():
    r = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "and so", "", " \n", "Yes. ", "x ", "Ends here. ", "Ünïcode?", "Yes"]
    rows = [(c, r.choice([None, *range(7)]), r.choice(["user", "assistant", "system", "tool", "", None, "sage", "User"]), r.choice([*texts, None])) for c in range(150) for _ in range(r.randint(0, 9))]
    rows += [(None, i, "user", f"A {i % 3}.") for i in range(4)] + [(900, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(400)]
    rows += [(901, i, "tool", f"Never {i}") for i in range(60)] + [(902, 0, "user", "long " * 60_000 + "."), (903, -5, "system", "S."), (903, 2**40, "system", "S.")]
    return rows


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_repair_equals_brute_force(spark, piece):
    df = clashing(spark.createDataFrame(talk(), CONV).repartition(3))
    want = defaultdict(list)
    for c, *row in talk():
        want[c].append(tuple(row))
    got = {r[0]: tuple(r)[1:] for r in repair.repair(df, piece=piece).collect()}
    assert got == {c: repaired(rows) for c, rows in want.items()}


def test_pieces_agree_with_one_search():
    r = random.Random(2)
    for _ in range(400):
        rows = [(r.choice("suat"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 12))]
        for piece in (1, 2, 5, 100):
            way = repair.Repair(piece)
            for row in rows:
                way.add(*row)
            assert way.end() == best_edits(tuple(rows))


def test_damage_follows_the_hash(spark):
    rows = [(c, t, role, x) for c in (1, 2, None) for t in [*range(60), None] for role, x in [("assistant", "One. Two! Three? ok")]] + [(5, 1, None, None)]
    want = Counter()
    for c, t, role, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, x = role if role is not None else " ", x if x is not None else " "
        want[c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x] += (kind != 0) + (kind == 3)
    df = spark.createDataFrame(rows, CONV)
    assert Counter(tuple(r) for r in repair.damage(df).collect()) == +want
    none = repair.repair(repair.damage(df).where("false"), df).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in none} == {(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (1, 2, 5, None)}
    assert repair.repair(df.limit(0)).count() == 0


# --- divergence ---


def speech():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgß", k=r.randint(1, 9))) for _ in range(60)] + ["naïve", "ΣΣ", "a" * 70, "a" * 69 + "b", "x́"]
    rows = [(i, r.choice([" ", "-", "\x00", "7"]).join(r.choices(words, k=r.randint(0, 80))).swapcase() if i % 9 else None, r.choice(["en", "de", None]), r.choice(["s1", "s2", "S", "é", None]), 0) for i in range(260)]
    return rows + [(900, "word " * 50_000, "en", "hot", 0), (901, "rare", "xx", "a", 0), (902, "", "xx", "b", 0), (903, None, "yy", None, 0), (901, "rare", "xx", "a", 0)]


def audited(rows, documents, told):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        found = term.findall((text or "").translate(LOW))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= documents]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pair), ("term", terms)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(values) if part == "pair" or i < told}
    return out


@pytest.mark.parametrize(("documents", "told", "entries"), [(30, 50, 1 << 17), (2, 3, 16), (10_000, 50, 8)])
def test_divergence_equals_brute_force(spark, documents, told, entries):
    df = clashing(spark.createDataFrame(speech(), DOCS).repartition(3))
    got = divergence.divergence(df, documents, told, entries).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == audited(speech(), documents, told)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_slices_with_one_hash_are_told_apart():
    texts = ["Aa bb,aa", "", "bbécc aA " + "z" * 90 + " " + "z" * 89 + "y", None, "b"]
    data, offsets = divergence.text_bytes(pa.array(texts))
    low, starts, ends = divergence.slices(data, offsets)
    found = [bytes(low[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == ["aa", "bb", "aa", "bbécc", "aa", "z" * 90, "z" * 89 + "y", "b"]
    for digest in (divergence.xxhash.xxh3_64_intdigest, lambda b: 7, lambda b: len(b)):
        codes, first = divergence.grouped(low, starts, ends, digest)
        assert [found[i] for i in first[codes]] == found
        assert len(first) == len(set(found))
    assert len(divergence.grouped(low, starts[:0], ends[:0])[0]) == 0
    assert np.array_equal(divergence._TERM[[64, 65, 90, 97, 122, 123, 127, 128, 255]], [0, 97, 122, 97, 122, 0, 0, 128, 255])
