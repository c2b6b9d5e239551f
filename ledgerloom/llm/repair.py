"""Conversation structure repair: A* on the lattice of edits."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Costs of edits; what a truncated row that stays costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that one search covers; longer conversations are searched piece by piece.
PIECE = 256
#: What a repaired conversation may be: nothing, or a system row or none and then pairs of user and assistant.
#: States by the rows so far: 0 none, 1 a system row, 2 up to a user, 3 up to an assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GOALS = (0, 3)
#: The only role that may be written after each state, and the state it leads to.
WRITTEN = {0: ("user", 2), 1: ("user", 2), 3: ("user", 2), 2: ("assistant", 3)}

#: Faults of a row.
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3


def search(rows: list[tuple[str, int]], begin: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """The cheapest edits, and of those the least string of initials, from states before rows to states after them.

    rows: the initial of the role and the fault of each. begin: cost and edits so far for each state that may come
    before. last: whether nothing follows; then only the best state that may end a conversation is given.

    A* over places (rows read, state) in order of (cost and heuristic, edits). The heuristic is a
    suffix sum: rows that must be deleted, and the charge of truncated rows, which a deletion doesn't undercut. No
    step lowers cost and heuristic together, and edits to one place at one cost never begin with each other (they read
    the same rows, so the longer has more insertions), so the first visit of a place is its best.
    """
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[i][1] in (BLANK, DUPLICATE) else min(TRUNCATED, DELETE) if rows[i][1] == CUT else 0)
    todo = [(cost + ahead[0], edits, 0, state) for state, (cost, edits) in begin.items()]
    heapq.heapify(todo)
    done, out = set(), {}
    while todo:
        f, edits, i, state = heapq.heappop(todo)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            if not last:
                out[state] = (f, edits)
            elif state in GOALS:
                return {state: (f, edits)}
        steps = [(INSERT, "I", i, WRITTEN[state][1])]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault in (FINE, CUT):
                charge = TRUNCATED if fault == CUT else 0
                steps.append((REROLE + charge, "R", i + 1, WRITTEN[state][1]))
                if (kept := NEXT.get((state, initial))) is not None:
                    steps.append((charge, "K", i + 1, kept))
        for cost, edit, j, to in steps:
            if (j, to) not in done:
                heapq.heappush(todo, (f - ahead[i] + cost + ahead[j], edits + edit, j, to))
    return out


class Repair:
    """The cheapest edits of a conversation whose rows come one by one.

    Kept are the rows of a piece and, for each state, the edits since all ways to the states last agreed.
    """

    def __init__(self, piece: int = PIECE):
        self.piece, self.rows, self.ways, self.settled = piece, [], {0: (0, "")}, []

    def add(self, initial: str, fault: int) -> None:
        if len(self.rows) == self.piece:
            self.ways, self.rows = search(self.rows, self.ways, False), []
            # Pairs may follow an assistant row as well as nothing or a system row. Only a first system row may not; it can be deleted there.
            best = self.ways[3]
            self.ways = {s: w for s, w in self.ways.items() if not (s == 1 and w > best or s == 0 and w[0] > best[0] + DELETE)}
            edits = [w[1] for w in self.ways.values()]
            low, high, n = min(edits), max(edits), 0
            while n < len(low) and low[n] == high[n]:
                n += 1
            self.settled.append(low[:n])
            self.ways = {s: (c, e[n:]) for s, (c, e) in self.ways.items()}
        self.rows.append((initial, fault))

    def end(self) -> tuple[int, str]:
        ((cost, edits),) = search(self.rows, self.ways, True).values()
        return cost, "".join(self.settled) + edits


def _by_conversation(begin: Callable, names: list[str], types: list):
    """A mapInArrow function over rows sorted by conversation: begin(row) gives the functions add(row) and end()."""
    def run(batches):
        now, state, out = None, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for row in batch.slice(at, 1024).to_pylist():
                    if now != (row["conv_id"],):
                        if state is not None:
                            out.append(state[1]())
                        now, state = (row["conv_id"],), begin(row)
                    state[0](row)
                if out:
                    yield pack(out)
                    out = []
        if state is not None:
            yield pack([state[1]()])

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


_FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _edits(piece: int):
    def begin(first):
        repair, seen = Repair(piece), [0, 0, 0, 0]
        turns = {"least": None, "most": None, "distinct": 0}
        pair = {"before": None, "illegal": 0}

        def add(row):
            if row["fault"] is None:  # the conversation's own row
                return
            seen[row["fault"]] += 1
            turn, initial = row["turn"], row["initial"]
            if turn is not None and turn != turns["most"]:
                turns.update(least=turn if turns["least"] is None else turns["least"], most=turn, distinct=turns["distinct"] + 1)
            if pair["before"] is not None and pair["before"] + initial not in ("su", "ua", "au"):
                pair["illegal"] += 1
            pair["before"] = initial
            repair.add(initial, row["fault"])

        def end():
            gaps = 0 if turns["least"] is None else turns["most"] - turns["least"] + 1 - turns["distinct"]
            return (first["conv_id"], gaps, seen[BLANK], seen[DUPLICATE], seen[CUT], pair["illegal"], *repair.end())

        return add, end

    return _by_conversation(begin, [c.split(" ")[0] for c in _FOUND.split(", ")], [pa.int64()] * 7 + [pa.string()])


_HASHED = _FOUND + ", repaired_sha256 string"


def _repaired():
    """The digest of each conversation after its edits, which come before its rows."""
    def begin(first):
        audit, digest = first["audit"], hashlib.sha256()
        state = {"at": 0, "in": 0, "rows": 0}

        def write(role, text):
            digest.update(f"{'\n' if state['rows'] else ''}{role}:{text}".encode())
            state["rows"] += 1

        def insert():
            while audit.startswith("I", state["at"]):
                role, state["in"] = WRITTEN[state["in"]]
                write(role, "")
                state["at"] += 1

        def add(row):
            if row["audit"] is not None:
                return
            insert()
            edit = audit[state["at"]]
            state["at"] += 1
            if edit == "K":
                state["in"] = NEXT[state["in"], row["role"][:1]]
                write(row["role"], row["text"])
            elif edit == "R":
                role, state["in"] = WRITTEN[state["in"]]
                write(role, row["text"])

        def end():
            insert()
            return (*[first[c.split(" ")[0]] for c in _FOUND.split(", ")], digest.hexdigest())

        return add, end

    return _by_conversation(begin, [c.split(" ")[0] for c in _HASHED.split(", ")], [pa.int64()] * 7 + [pa.string()] * 2)


def fault(role: Column, text: Column, again: Column) -> Column:
    """The first fault of a row: blank, duplicate (again: whether role and text were there before), cut, or none."""
    return (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(again, DUPLICATE)
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(FINE)
    )


def repair(conversations: DataFrame, ids: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """What is wrong with each conversation, its cheapest repair, and the digest of the repaired one.

    conversations: conv_id, turn, role, text; ids: conv_id of conversations that are to be told even without
    rows. Rows are read by turn (null first), ties by role and text. Null roles and texts are one space, a
    null conv_id is one conversation; other columns are ignored. A role counts by its first character; an
    empty one fits nowhere and is given a new role or deleted. A conversation without rows has zeros, no edits and the digest of
    nothing. An empty table gives an empty frame.

    Rows stream through tasks by conversation. The search needs the initial and fault of each row only, and
    keeps a piece of them and the edits so far; the texts are read in a second pass behind
    their edits, and hashed as they come. Repeats are found before, by windows of role and text, so a hot
    conversation is divided there; its digest, and so its last pass, is one task's by nature.
    """
    id_ = F.col("conv_id").cast("long").alias("conv_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(id_, F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    every = rows.select("conv_id") if ids is None else ids.select(id_)
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    marked = rows.withColumn("again", F.row_number().over(earlier) > 1).select("conv_id", "turn", "role", "text", "again")
    order = ["turn", "role", "text", "again"]
    coded = marked.select("conv_id", F.lit(1).alias("kind"), *order, F.substring("role", 1, 1).alias("initial"), fault(F.col("role"), F.col("text"), F.col("again")).alias("fault"))
    nothing = lambda *c: [F.lit(None).cast(t).alias(n) for n, t in c]
    own = every.distinct().select("conv_id", F.lit(0).alias("kind"), *nothing(("turn", "long"), ("role", "string"), ("text", "string"), ("again", "boolean"), ("initial", "string"), ("fault", "int")))
    found = coded.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order).select("conv_id", "turn", "initial", "fault").mapInArrow(_edits(piece), _FOUND)
    names = [c for c in found.columns if c != "conv_id"]
    heads = found.select("conv_id", F.lit(0).alias("kind"), *nothing(("turn", "long"), ("role", "string"), ("text", "string")), *names)
    bodies = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", *nothing(*[(n, t) for n, t in found.dtypes if n != "conv_id"]))
    return heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").select("conv_id", "role", "text", *names).mapInArrow(_repaired(), _HASHED)


def damage(conversations: DataFrame) -> DataFrame:
    """Faults by a hash of conv_id and turn: of 20 rows one is dropped, emptied, without ends of sentences, repeated or a user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    return rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damage(rows), rows)


#: States as in NEXT; a step may begin with up to two insertions, more never help. Bytes are hashed by a table that SQL makes first.
OP12_SQL = """
WITH RECURSIVE poly AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM (SELECT unnest(range(256)) AS i)
),
crc AS (SELECT list(v ORDER BY i) AS t FROM poly),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
base AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(v.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations v JOIN ids ON v.conv_id IS NOT DISTINCT FROM ids.conv_id
),
kinds AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(k, '')]), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT k FROM base), crc
),
rows_ AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base JOIN kinds USING (k), LATERAL (SELECT unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)))
  WHERE kind <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS a
  FROM rows_
),
repeats AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM numbered),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN again THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
         lag(a) OVER (PARTITION BY c ORDER BY i) AS prior
  FROM repeats
),
totals AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || a NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY c
),
ins(state, cost, edits, written, mid) AS (
  VALUES (0, 0, '', [], 0), (1, 0, '', [], 1), (2, 0, '', [], 2), (3, 0, '', [], 3),
         (0, 3, 'I', ['user:'], 2), (1, 3, 'I', ['user:'], 2), (3, 3, 'I', ['user:'], 2), (2, 3, 'I', ['assistant:'], 3),
         (0, 6, 'II', ['user:', 'assistant:'], 3), (1, 6, 'II', ['user:', 'assistant:'], 3), (3, 6, 'II', ['user:', 'assistant:'], 3), (2, 6, 'II', ['assistant:', 'user:'], 2)
),
moves(mid, edit, initial, cost, role, after) AS (
  VALUES (0, 'D', NULL, 4, NULL, 0), (1, 'D', NULL, 4, NULL, 1), (2, 'D', NULL, 4, NULL, 2), (3, 'D', NULL, 4, NULL, 3),
         (0, 'R', NULL, 3, 'user', 2), (1, 'R', NULL, 3, 'user', 2), (3, 'R', NULL, 3, 'user', 2), (2, 'R', NULL, 3, 'assistant', 3),
         (0, 'K', 's', 0, NULL, 1), (0, 'K', 'u', 0, NULL, 2), (1, 'K', 'u', 0, NULL, 2), (3, 'K', 'u', 0, NULL, 2), (2, 'K', 'a', 0, NULL, 3)
),
walk AS (
  SELECT c, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'written': []::VARCHAR[]} AS best FROM totals
  UNION ALL
  SELECT c, i, after, min(best) FROM (
    SELECT w.c, f.i, m.after, {
      'cost': w.best.cost + ins.cost + m.cost + CASE WHEN f.fault = 3 AND m.edit <> 'D' THEN 3 ELSE 0 END,
      'audit': w.best.audit || ins.edits || m.edit,
      'written': w.best.written || ins.written || CASE WHEN m.edit = 'D' THEN [] ELSE [coalesce(m.role, f.role) || ':' || f.text] END
    } AS best
    FROM walk w JOIN faults f ON f.c = w.c AND f.i = w.i + 1 JOIN ins ON ins.state = w.state JOIN moves m ON m.mid = ins.mid
    WHERE (m.initial IS NULL OR m.initial = f.a) AND (m.edit = 'D' OR f.fault NOT IN (1, 2))
  ) GROUP BY ALL
),
ends AS (
  SELECT w.c, min({'cost': w.best.cost + ins.cost, 'audit': w.best.audit || ins.edits, 'written': w.best.written || ins.written}) AS best
  FROM walk w JOIN totals t ON t.c = w.c AND t.n = w.i JOIN ins ON ins.state = w.state AND ins.mid IN (0, 3) GROUP BY w.c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.written, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN totals USING (c) LEFT JOIN ends USING (c)
"""
