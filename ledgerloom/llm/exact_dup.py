"""Exact deduplication: owners of equal texts, kept in the terminal nodes of Patricia tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, chunks, table

#: Bytes of labels that a trie holds before it spills a subtree, and row ids that its terminals hold before they are sent on.
MEMORY, IDS = 32 << 20, 1 << 16
#: Cost of a node besides its label, about.
_NODE = 200


class _Node:
    __slots__ = ("label", "children", "ids", "weight")

    def __init__(self, label: bytes):
        self.label, self.children, self.ids, self.weight = label, {}, None, 0


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of a are those of b from a place on, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie of byte strings. A terminal node has the ids of the rows that hold its string.

    Each child of the root knows the weight of its subtree, so that the heaviest can be spilled.
    """

    def __init__(self):
        self.root, self.weight = _Node(b""), 0

    def insert(self, key: bytes) -> list:
        """The ids at the string's terminal node, which is made if it isn't there."""
        node, at, top, grown = self.root, 0, None, 0
        while True:
            child = node.children.get(key[at : at + 1]) if at < len(key) else None
            if at == len(key):
                break
            if child is None:
                child = _Node(key[at:])
                node.children[key[at : at + 1]], grown = child, grown + len(key) - at + _NODE
                node, top = child, top or child
                break
            n = len(child.label) if key.startswith(child.label, at) else _shared(child.label, key, at)
            if n < len(child.label):  # part the edge
                upper = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[:1]] = child
                node.children[key[at : at + 1]], upper.weight, grown = upper, child.weight, grown + _NODE
                child = upper
            top = top or child
            node, at = child, at + n
        if node.ids is None:
            node.ids = []
        if top is not None:
            top.weight += grown
            self.weight += grown
        return node.ids

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Take away the heaviest subtree under the root, and give its strings and ids."""
        first = max(self.root.children, key=lambda k: self.root.children[k].weight)
        top = self.root.children.pop(first)
        self.weight -= top.weight
        yield from _terminals(top)

    def all(self) -> Iterator[tuple[bytes, list]]:
        yield from _terminals(self.root)


def _terminals(top: _Node) -> Iterator[tuple[bytes, list]]:
    todo = [(top, b"")]
    while todo:
        node, before = todo.pop()
        key = before + node.label
        if node.ids is not None:
            yield key, node.ids
        todo += [(c, key) for c in node.children.values()]


_COPIES = "n long, hash binary, text binary, ids array<long>"


def _rows(found) -> Iterator[pa.RecordBatch]:
    """Batches of at most a few MB from strings with their ids."""
    part, size = [], 0
    for text, ids in found:
        if ids:
            part.append((len(text), hashlib.sha256(text).digest(), text, ids))
            size += len(text) + 8 * len(ids)
        if size > 4 << 20:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _batch(rows) -> pa.RecordBatch:
    n, h, text, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(text, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["n", "hash", "text", "ids"])


def _gather(memory: int, most: int):
    """The distinct strings of a task's rows, lower-cased, with the ids that hold them."""
    def run(batches):
        trie, held = Trie(), 0
        for batch in batches:
            for part in chunks(batch) if batch.num_rows else ():
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    trie.insert((text or b"").lower()).append(key)
                    held += 1
                if held > most:
                    yield from _rows(trie.all())
                    trie, held = Trie(), 0
                while trie.weight > memory:
                    yield from _rows(trie.spill())
        yield from _rows(trie.all())

    return run


_MEMBERS = "doc_id long, n long, hash binary, variant int"


def _owners():
    """Rows of each string, from copies sorted by length and hash.

    The trie holds the strings of one length and hash: with the next one its subtree is finished and given up.
    Strings that share both but not their bytes get different variants.
    """
    def run(batches):
        now, trie, variants, out = None, Trie(), 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                key = (batch.column("n")[row].as_py(), batch.column("hash")[row].as_py())
                if key != now:
                    now, trie, variants = key, Trie(), 0
                terminal = trie.insert(batch.column("text")[row].as_py())
                if not terminal:
                    terminal.append(variants)
                    variants += 1
                out += [(i, *key, terminal[0]) for i in batch.column("ids")[row].as_py()]
                if len(out) >= IDS:
                    yield members(out)
                    out = []
        if out:
            yield members(out)

    def members(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["doc_id", "n", "hash", "variant"])

    return run


def exact_duplicates(docs: DataFrame, keep: str = "largest", memory: int = MEMORY, most: int = IDS) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z only, compared byte by byte; a null text counts as
    empty. Of equal texts the row with the largest (or smallest) doc_id stays. A null id stays only where all
    ids of the group are null, its keep_id is null then. Of rows that repeat id and text one stays, and all
    count. The same id with another text is another document. Other columns are ignored, whatever their
    names. An empty table gives an empty frame.

    Each task inserts its texts into a trie and sends each distinct one on once, with the ids that hold it,
    to the partition of its length and hash; beyond the memory allowed it sends the heaviest subtree first.
    So copies of a hot text meet as one row of each task. Such partitions are read in order of length and hash, in
    tries that end with each hash. No group's ids are held together: groups are summed, and joined with their rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    copies = rows.mapInArrow(_gather(memory, most), _COPIES)
    members = checkpoint(copies.repartition("n", "hash").sortWithinPartitions("n", "hash").mapInArrow(_owners(), _MEMBERS))
    text = ["n", "hash", "variant"]
    each = members.groupBy(*text, "doc_id").agg(F.count("*").alias("times"))
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    groups = members.groupBy(*text).agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    return each.join(groups, text).select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select(
        "doc_id", "keep_id", "group_size", ((F.col("time") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("hash")).alias("text_sha256")
    )


def op13_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(low) AS text_sha256
FROM d WINDOW w AS (PARTITION BY low)
"""
