"""Chat formatting as a prefix tree: shared turns once, with positions and ancestor intervals."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, running_totals, table

#: Where the vocabulary is, unless the setting LEDGERLOOM_TOKENIZER names another file.
TOKENIZER = os.environ.get("LEDGERLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = "<|im_start|>", "<|im_end|>"
#: Nodes of a range of the packed order that is summed by itself, about.
RANGE = 50_000


def escape(text: str) -> str:
    """Text without `<|`: every `<`, backslashes, `|` gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line, without `<|`."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Tokens:
    """Byte-level BPE of ordinary text, and two control tokens above its vocabulary."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.size = max(table.values()) + 1
        self.start, self.end = self.size, self.size + 1
        self.coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(text)

    def decode(self, tokens) -> str:
        out, at = [], 0
        for i, t in enumerate(tokens):
            if t >= self.size:
                out += [self.coder.decode_bytes(tokens[at:i]), (START if t == self.start else END).encode()]
                at = i + 1
        out.append(self.coder.decode_bytes(tokens[at:]))
        return b"".join(out).decode()


@lru_cache(1)
def _coder(ranks: str, pattern: str) -> Tokens:
    return Tokens(ranks, pattern)


_NODES = "conv_id long, depth int, tree string, parent string, node string, tokens array<int>, n_tokens long, position long, loss_from int, loss_to int"


def _streamed(kind: str, begin, step):
    """A mapInArrow function over rows sorted by conv_id: begin() makes the state of a conversation, step(state, row) a row of it."""
    fields = [c.split(" ") for c in kind.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def run(batches):
        now, state = (), None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = []
                for row in batch.slice(at, 1024).to_pylist():
                    if now != (row["conv_id"],):
                        if state is not None and (last := step(state, None)) is not None:
                            rows.append(last)
                        now, state = (row["conv_id"],), begin(row)
                    if (out := step(state, row)) is not None:
                        rows.append(out)
                yield pack_rows(rows)
        if state is not None and (last := step(state, None)) is not None:
            yield pack_rows([last])

    def pack_rows(rows):
        cols = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return run


def _split(ranks, pattern: str):
    """Turns as tokens; a node's name is the chained hash of all turns up to it."""
    def begin(row):
        return {"key": b"", "position": 0, "depth": 0, "tree": None}

    def step(state, row):
        if row is None:
            return None
        coder = _coder(ranks.value, pattern)
        role, text, parent = row["role"], row["text"], state["key"]
        r = role.encode()
        key = hashlib.blake2b(parent + len(r).to_bytes(8, "big") + r + text.encode(), digest_size=16).digest()
        head, body = [coder.start, *coder.encode(escape_role(role) + "\n")], coder.encode(escape(text))
        tokens, loss = head + body + [coder.end] + coder.encode("\n"), role == "assistant"
        state["tree"] = state["tree"] or key.hex()
        out = (row["conv_id"], state["depth"], state["tree"], parent.hex(), key.hex(), tokens, len(tokens), state["position"], len(head) if loss else 0, len(head) + len(body) if loss else 0)
        state.update(key=key, position=state["position"] + len(tokens), depth=state["depth"] + 1)
        return out

    return _streamed(_NODES, begin, step)


def _paths():
    """The names of the branches that lead to each node: only turns after which conversations part have one."""
    def begin(row):
        return {"path": b""}

    def step(state, row):
        if row is None:
            return None
        if row["branch"]:
            state["path"] += bytes.fromhex(row["node"][:16])
        return row["node"], state["path"], row["depth"]

    return _streamed("node string, path binary, depth int", begin, step)


def pack(conversations: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """The prefix tree of conversations: (nodes, paths).

    nodes: a row for each distinct sequence of first turns, with tree (its first turn's node), node,
    parent, depth, start and end (its tokens' places in the tree's depth-first sequence), position (of
    its first token, counted along its path), tokens, and loss_from and loss_to (assistant text,
    counted within the node). paths: conv_id and spans, the intervals of the tree's sequence that its
    last token may attend to, in order - its turns' own; those of a node are its path's up to itself.

    A turn is START role newline text END newline, control strings inside escaped. Turns are ordered by
    turn (null first), then role and text, which also settles ties. Null roles and texts are empty. A
    null conv_id is one conversation. Other columns are ignored. An empty table gives empty frames.
    The turns of a conversation stream through one task in order, and are never held together.
    """
    with open(tokenizer) as f:  # on the driver only
        ranks = conversations.sparkSession.sparkContext.broadcast(f.read())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    every = checkpoint(turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_split(ranks, pattern), _NODES))
    nodes = checkpoint(every.drop("conv_id").dropDuplicates(["node"]))
    # depth-first order: by the branches that lead to a node, then by depth
    parted = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent", F.lit(True).alias("parted"))
    branch = nodes.join(parted, "parent", "left").select("node", (F.coalesce("parted", F.lit(False)) | (F.col("depth") == 0)).alias("branch"))
    walks = every.select("conv_id", "depth", "node").join(branch, "node").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    places = walks.mapInArrow(_paths(), "node string, path binary, depth int").dropDuplicates(["node"]).drop("depth")
    slim = checkpoint(nodes.select("node", "depth", "n_tokens").join(places, "node"))
    ranges = max(4, slim.count() // RANGE)
    slim = checkpoint(slim.repartitionByRange(ranges, "path", "depth", "node").withColumn("range", F.spark_partition_id()))
    slim = running_totals(slim, ["range"], [F.col("path"), F.col("depth"), F.col("node")], {"at": "n_tokens"}).select("node", "at")
    nodes = nodes.join(slim, "node")
    roots = nodes.where("depth = 0").select("tree", F.col("at").alias("base"))
    nodes = nodes.join(roots, "tree").select(
        "tree", "node", "parent", "depth", (F.col("at") - F.col("base")).alias("start"), (F.col("at") - F.col("base") + F.col("n_tokens")).alias("end"),
        "position", "tokens", "loss_from", "loss_to",
    )
    nodes = checkpoint(nodes)
    places = nodes.select("node", "start", "end")
    paths = every.select("conv_id", "tree", "depth", "node").join(places, "node").groupBy("conv_id", "tree").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "start", "end"))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")
    )
    return nodes, paths


def attention(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds to every node the intervals of its ancestors' tokens, in order."""
    last = paths.select("tree", F.posexplode("spans").alias("depth", "s"), "spans").select("tree", "depth", F.col("s.start").alias("start"), F.slice("spans", 1, F.col("depth")).alias("ancestors"))
    return nodes.join(last.dropDuplicates(["tree", "start"]).drop("depth"), ["tree", "start"])


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(ranks, pattern: str):
    """The turns of each conversation, read back node by node."""
    turn = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)

    def begin(row):
        return {"conv_id": row["conv_id"], "turns": 0, "loss": 0, "chars": 0, "all": hashlib.sha256(), "learned": hashlib.sha256()}

    def step(state, row):
        if row is None:
            return state["conv_id"], state["turns"], state["all"].hexdigest(), state["loss"], state["learned"].hexdigest(), state["chars"]
        coder = _coder(ranks.value, pattern)
        text = coder.decode(row["tokens"])
        for role, body in turn.findall(text):
            state["all"].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
            state["turns"] += 1
        learned = unescape(coder.decode(row["tokens"][row["loss_from"] : row["loss_to"]]))
        state["learned"].update(learned.encode())
        state["loss"] += len(learned)
        state["chars"] += len(text)
        return None

    return _streamed(_DIGESTS, begin, step)


def digests(nodes: DataFrame, paths: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Every conversation read back from the packed sequences: its turns, loss text and formatted text."""
    with open(tokenizer) as f:
        ranks = nodes.sparkSession.sparkContext.broadcast(f.read())
    spans = paths.select("conv_id", "tree", F.explode("spans").alias("s")).select("conv_id", "tree", F.col("s.start").alias("start"))
    parts = spans.join(nodes.select("tree", "start", "position", "tokens", "loss_from", "loss_to"), ["tree", "start"])
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "tokens", "loss_from", "loss_to")
    return parts.mapInArrow(_read(ranks, pattern), _DIGESTS)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = f"{END}{START}assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(*pack(rows.unionByName(extra)))
