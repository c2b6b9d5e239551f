"""MinHash near-duplicate detection by odd sketches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, by_batch, checkpoint, components, lists, mix, release, shingles, table, with_ids, word_hashes

#: Bits of an odd sketch.
BITS = 512
#: Documents, or sketches of a bucket, compared with as many others in one task; shingles that a block of documents holds.
BLOCK, SKETCHES, ITEMS = 256, 1024, 1 << 22
#: Members of a bucket up to which it is compared whole, in one task with others of about DEAL rows; larger buckets are compared in blocks.
SMALL, DEAL = 64, 20_000
_NO_ID = -(2**63)


def bands_for(percent: int, miss: float = 1e-6) -> tuple[int, int]:
    """Rows and bands so that a pair at the threshold shares no band with a chance below miss."""
    s = percent / 100
    rows = max(1, int(math.log(1 / 3) / math.log(s))) if s < 1 else 8
    return rows, max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - s**rows)))) if s < 1 else 1


def most_odd_bits(percent: int, samples: int) -> int:
    """XOR population count that a linked pair exceeds only beyond six standard deviations."""
    s = percent / 100
    low = max(0.0, s - 6 * math.sqrt(s * (1 - s) / samples))
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * samples * (1 - low) / BITS)) + 6 * math.sqrt(BITS / 4) * (1 - low))


def _sets(part: pa.RecordBatch, k: int):
    h, offsets = shingles(*word_hashes(part.column("text")), k)
    for i in range(part.num_rows):
        yield np.unique(h[offsets[i] : offsets[i + 1]])


def _set_id(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set of shingles."""
    n = U(len(s))
    return mix(np.add.reduce(mix(s ^ U(0xA5A5A5A5))) + n), mix(np.add.reduce(mix(s * U(0x9E3779B97F4A7C15) + U(1))) ^ n)


def _signatures(k: int, rows: int, bands: int):
    samples = rows * bands
    seeds = mix(np.arange(1, samples + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    odd, salt = (seeds >> U(32)).astype(np.uint32) | np.uint32(1), seeds.astype(np.uint32)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        least = np.zeros((n, samples), np.uint32)
        size, ids = np.zeros(n, np.int64), np.zeros((n, 2), U)
        for i, s in enumerate(_sets(part, k)):
            size[i] = len(s)
            if len(s):
                ids[i] = _set_id(s)
                low = (s ^ (s >> U(32))).astype(np.uint32)
                for at in range(0, len(low), 4096):
                    x = ((low[at : at + 4096, None] ^ salt) * odd).min(axis=0)
                    least[i] = np.minimum(least[i], x) if at else x
        # each sample toggles one bit of the sketch
        bit = (mix(least.astype(U) + seeds) & U(BITS - 1)).astype(np.int64) + np.arange(n)[:, None] * BITS
        parity = (np.bincount(bit.reshape(-1), minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
        sketch = np.packbits(parity, axis=1).view(np.int64)
        wide = least.reshape(n, bands, rows).astype(U)
        key = np.broadcast_to(np.arange(bands, dtype=U), (n, bands)).copy()
        for j in range(rows):
            key = mix(key * U(0x2545F4914F6CDD1D) + wide[:, :, j])
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("th"), pa.array(size), *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in ids.T], lists(key.view(np.int64)), lists(sketch)],
            names=["doc_id", "th", "n", "s1", "s2", "bands", "sketch"],
        )

    return by_batch(run)


def _full_sets(k: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(_sets(part, k))
        ids = np.array([_set_id(s) if len(s) else (U(0), U(0)) for s in sets], U).reshape(-1, 2)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in ids.T]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["s1", "s2", "items"])

    return by_batch(run)


def _forest(u: pd.DataFrame, v: pd.DataFrame, near) -> pd.DataFrame:
    """Links between rows of u and v that join what has different labels, spanning all that near(i), a mask over v, connects."""
    names, at = np.unique(np.concatenate([u["label"], v["label"]]).astype(np.int64), return_inverse=True)
    own, other = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    us, vs = u["sid"].to_numpy(), v["sid"].to_numpy()
    found: list[tuple[int, int]] = []
    for i in range(len(u) if len(v) else 0):
        js = np.flatnonzero(near(i))
        while len(js := js[label[other[js]] != label[own[i]]]):
            found.append((int(us[i]), int(vs[js[0]])))
            label[label == label[other[js[0]]]] = label[own[i]]
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    pdf = pdf.drop_duplicates(["sid", "side"]).sort_values(["side", "sid"])
    return pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]


def _distance(a: str, b: str):
    """XOR population count of two columns of sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def _bucket_links(percent: int, most: int):
    """Links of the few of many small buckets whose sizes and sketches allow the threshold: in each bucket, as many as join its labels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "sid"])
        sid, n, few = (pdf[c].to_numpy() for c in ("sid", "n", "few"))
        sketch = np.stack([np.asarray(x, np.int64) for x in pdf["sketch"]]).view(U)
        starts = np.flatnonzero(np.diff(pdf["key"].to_numpy(), prepend=pdf["key"].iat[0] - 1))
        size = np.diff(np.append(starts, len(pdf)))
        start, wide = np.repeat(starts, size), np.repeat(size, size)
        # a number of each label of each bucket
        label = np.unique(np.stack([start, pdf["label"].to_numpy()], axis=1), axis=0, return_inverse=True)[1].reshape(-1).tolist()
        parent, asked, found = list(range(len(pdf))), np.flatnonzero(few), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for at in range(0, len(asked), BLOCK * 16):
            one = asked[at : at + BLOCK * 16]
            i = np.repeat(one, wide[one])
            j = np.arange(len(i)) - np.repeat(np.cumsum(wide[one]) - wide[one], wide[one]) + start[i]
            ok = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= most
            for u, v in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                x, y = root(label[u]), root(label[v])
                if x != y:
                    parent[x] = y
                    found.append((int(sid[u]), int(sid[v])))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def _sketch_links(percent: int, most: int):
    """Links between a block of the few and one of all whose sizes and sketches allow the threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = _sides(pdf)
        if not len(one) or not len(two):
            return _forest(one[:0], two[:0], None)
        a, b = [np.stack([np.asarray(x, np.int64) for x in p["sketch"]]).view(U) for p in (one, two)]
        na, nb = one["n"].to_numpy(), two["n"].to_numpy()

        def near(i: int) -> np.ndarray:
            far = np.bitwise_count(a[i] ^ b).sum(axis=1, dtype=np.int64)
            return (far <= most) & (np.minimum(na[i], nb) * 100 >= np.maximum(na[i], nb) * percent)

        return _forest(one, two, near)

    return run


def _links(percent: int):
    """Links between a block of the few and one of all, confirmed on full sets."""

    def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        both = np.intersect1d(np.concatenate(a), np.concatenate(b))
        out = np.zeros((len(a), len(b)), np.float32)

        def marks(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
            m = np.zeros((len(sets), len(words)), np.float32)
            for i, s in enumerate(sets):
                at = np.minimum(np.searchsorted(words, s), len(words) - 1)
                m[i, at[words[at] == s]] = 1
            return m

        for at in range(0, len(both), 8192):  # bounded memory for long documents
            out += marks(a, both[at : at + 8192]) @ marks(b, both[at : at + 8192]).T
        return out.round().astype(np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = _sides(pdf)
        if not len(one) or not len(two):
            return _forest(one[:0], two[:0], None)
        a, b = [[np.asarray(x, np.int64) for x in p["items"]] for p in (one, two)]
        inter = overlaps(a, b)
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        linked = 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)
        return _forest(one, two, linked.__getitem__)

    return run


def _few_by_all(members: DataFrame, group: str, size: int, *columns: str) -> DataFrame:
    """Members (sid, label, few, n, group) dealt into blocks, so that each of the few meets every member of its group once.

    Blocks hold about so many members and ITEMS shingles; the few of a group, which its main part
    does not hold, decide how often the others are copied.
    """
    many = lambda test, items: F.ceil(F.greatest(F.count_if(test) / size, items / ITEMS)).cast("int")
    plan = members.groupBy(group).agg(many(F.col("few"), F.sum(F.when(F.col("few"), F.col("n")))).alias("p"), many(F.lit(True), F.sum("n")).alias("q")).where("p > 0")
    rows = members.join(plan, group)
    hashed, upto = (lambda k: F.pmod(F.xxhash64("sid"), F.col(k)).cast("int")), (lambda k: F.sequence(F.lit(0), F.col(k) - 1))
    keep = ["sid", "label", "n", group, *columns]
    one = rows.where("few").select(*keep, F.lit(0).alias("side"), hashed("p").alias("i"), F.explode(upto("q")).alias("j"))
    return one.unionByName(rows.select(*keep, F.lit(1).alias("side"), F.explode(upto("p")).alias("i"), hashed("q").alias("j")))


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, th (a hash of the text), n (shingles) and cls (a number of its class, null without shingles) of every row."""
    rows, bands = bands_for(percent)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    sig = checkpoint(docs.mapInArrow(_signatures(words, rows, bands), "doc_id long, th long, n long, s1 long, s2 long, bands array<long>, sketch array<long>"))
    nodes = sig.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = checkpoint(nodes.withColumn("sid", F.monotonically_increasing_id()))
    keys = nodes.select("sid", F.struct("s1", "s2", "sid").alias("s"), F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("s").alias("rep"), F.count("*").alias("c")).where("c > 1").select("key", F.col("rep.sid").alias("rep"), F.col("rep.s1").alias("rank"), "c")
    shared = checkpoint(keys.join(buckets, "key").select("key", "sid", "rep", "rank", "c"))
    pairs = shared.where("sid <> rep").select("sid", "rep", "rank").distinct()
    a, b = [nodes.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in ("sid", "rep")]
    most = most_odd_bits(percent, rows * bands)
    fits = (F.least("n_sid", "n_rep") * 100 >= F.greatest("n_sid", "n_rep") * percent) & (_distance("s_sid", "s_rep") <= most)
    stars = checkpoint(pairs.join(a, "sid").join(b, "rep").where(fits).select("sid", "rep", "rank"))

    def sets(ids: DataFrame) -> DataFrame:
        """(sid, items): the full sets of some nodes."""
        some = checkpoint(ids.select("sid").distinct().join(nodes.select("sid", "s1", "s2", F.coalesce("doc", F.lit(_NO_ID)).alias("id")), "sid"))
        text = with_ids(docs.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))), some.select("id").distinct(), "left_semi")
        full = text.select("text").mapInArrow(_full_sets(words), "s1 long, s2 long, items array<long>")
        return full.join(some.drop("id"), ["s1", "s2"]).dropDuplicates(["sid"]).select("sid", "items")

    def confirmed(links: DataFrame) -> DataFrame:
        """Links (u, v) that hold on full sets. u is joined first, so that Spark can split a v that many links name."""
        ends = checkpoint(sets(links.select(F.col("u").alias("sid")).union(links.select("v"))))
        both = links.join(ends.toDF("u", "a"), "u").join(ends.toDF("v", "b"), "v")
        inter = F.size(F.array_intersect("a", "b"))
        return checkpoint(both.where(inter * 100 >= (F.size("a") + F.size("b") - inter) * percent).select("u", "v"))

    # each node with the least of its representatives, which most of its class share
    first = stars.groupBy("sid").agg(F.min(F.struct("rank", "rep")).alias("m")).select(F.col("sid").alias("u"), F.col("m.rep").alias("v"))
    links = confirmed(first)
    del keys, buckets, pairs, a, b, stars, first
    release(docs.sparkSession)

    def labelled(df: DataFrame, labels: DataFrame, c: str = "sid", name: str = "label") -> DataFrame:
        return df.join(labels.toDF(c, name), c, "left").withColumn(name, F.coalesce(name, c))

    # what this leaves apart from a bucket's representative may still be linked with it or another member
    rest = checkpoint(labelled(labelled(shared.select("key", "sid", "rep", "c"), links), links, "rep", "main").withColumn("few", F.col("label") != F.col("main")))
    crowded = rest.where("few").select("key").distinct()
    rest = checkpoint(rest.join(crowded, "key", "left_semi").select("key", "sid", "label", "few", "c").join(nodes.select("sid", "n", "sketch"), "sid"))
    more = _few_by_all(rest.where(F.col("c") > SMALL), "key", SKETCHES, "sketch").groupBy("key", "i", "j").applyInPandas(_sketch_links(percent, most), "u long, v long")
    deals = 1 + rest.count() // DEAL  # many small buckets in one group, each whole
    small = rest.where(F.col("c") <= SMALL).groupBy(F.pmod(F.xxhash64("key"), F.lit(deals)).alias("deal")).applyInPandas(_bucket_links(percent, most), "u long, v long")
    more = checkpoint(more.union(small).distinct())
    del shared, rest, crowded, small
    release(docs.sparkSession)
    held = confirmed(more)
    exact = checkpoint(components(links.union(held)))

    def between(pairs: DataFrame) -> DataFrame:
        """Links between classes so far, by their labels."""
        return labelled(labelled(pairs, exact, "u", "a"), exact, "v", "b").select("a", "b").toDF("u", "v")

    if more.count() > held.count():
        # groups that sketches connect and full sets so far don't
        coarse = checkpoint(components(between(more)))
        release(docs.sparkSession)
        parts = labelled(nodes.select("sid", "n"), exact).join(coarse.toDF("label", "grp"), "label")
        main = parts.groupBy("grp", "label").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max(F.struct("c", "label")).alias("m"))
        parts = checkpoint(parts.join(main.select("grp", F.col("m.label").alias("main")), "grp").select("grp", "sid", "label", "n", (F.col("label") != F.col("main")).alias("few")))
        full = _few_by_all(parts, "grp", BLOCK).join(sets(parts), "sid")
        last = checkpoint(full.groupBy("grp", "i", "j").applyInPandas(_links(percent), "u long, v long"))
        del parts, main, full, coarse
        release(docs.sparkSession)
        if last.take(1):
            joined = components(between(last)).toDF("label", "whole")
            every = exact.union(joined.join(exact.select("label").distinct(), "label", "left_anti").select("label", "label"))  # with classes of one node
            exact = checkpoint(every.toDF("id", "label").join(joined, "label", "left").select("id", F.coalesce("whole", "label").alias("label")))
    out = sig.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2").join(labelled(nodes.select("s1", "s2", "sid"), exact), ["s1", "s2"], "left")
    return out.select("doc_id", "th", "n", F.col("label").alias("cls"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least percent / 100.

    Words are runs without white space, A-Z lower-cased; the set of a document is its distinct shingles
    of so many words, or its whole sequence if it is shorter. Returns for each row of docs: doc_id,
    n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id).

    Null or blank texts have no shingles and link with nothing. A null doc_id is reachable but never a
    component's id unless all are null. Equal sets (by 128 bits), and so repeated rows, form one node first.
    Other columns are ignored.

    Steps: MinHash samples give band keys and, folded by parity, an odd sketch. In each band the least
    set stands for its bucket; XOR counts of sketches discard what cannot reach the threshold, and each
    set's link with the least of its representatives is confirmed on full sets. Only the members of a
    bucket that this leaves apart from its representative are compared with all the others, first by
    sketches; the links that these suggest are confirmed, and what is still in parts is compared on full
    sets, in blocks.
    """
    rows = checkpoint(_classes(docs, words, percent))
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return rows.join(least, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without all but one row of each class; columns stay as they are.

    The row with the least doc_id stays; a null doc_id only where all are null. Rows are told apart by
    doc_id and text, so a repeated doc_id with another text is judged by itself. Rows without shingles stay.
    """
    found = checkpoint(_classes(docs, words, percent))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "th")
    rows = found.where("cls is not null").select("cls", name.alias("name"))
    keep = rows.groupBy("cls").agg(F.min("name").alias("keep"))
    rows = checkpoint(rows.join(keep, "cls").groupBy("name").agg(F.first(F.col("name") == F.col("keep")).alias("kept"), F.count("*").alias("n")))
    gone, twice = rows.where("not kept").select("name.id", "name.th"), rows.where("kept and n > 1").select("name.id", "name.th")
    # the whole row in one column, so that no name can clash
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    rest = with_ids(every, gone, "left_anti")
    n = twice.count()
    if n:
        rest = with_ids(rest, twice, "left_anti", n).unionByName(with_ids(rest, twice, "left_semi", n).dropDuplicates(["id", "th"]))
    return rest.select("row.*")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
