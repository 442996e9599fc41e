"""Conversation structure repair: the lightest derivation of a legal role sequence.

A conversation's rows, ordered by turn, are rewritten by the cheapest edits whose role
initials read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3, Delete 4 (the
only edit of a blank row or a duplicate), Insert of an empty user or assistant row 3; a
truncated row that stays costs 3 more. Of equally cheap edits the ASCII-least audit (the
edits' initials in order) wins.

**Method.** Items ``[span, p, q]`` say that the rows of a span take the reader of the role
pattern from state p to state q. Edits and inserts extend an item to the right, and two
neighbouring spans join where their states meet, so the items form a weighted hypergraph.
``lightest`` is Knuth's agenda over it: the smallest (cost, rows, audit) is popped and is
final, as every deduction returns at least its antecedents (a superior function), and two
audits of one item with equal cost never are prefixes of each other, so joining keeps their
order. It stops when the goal item, the whole conversation read from the start to an
accepting state, is popped.

**Scale.** Equal rows become one row with a number before anything is sorted. Rows are then
dealt by ranges of (conversation, turn, role, text), not by conversation, so a conversation
that holds a third of all rows lies in many tasks. A task streams its rows and works out the
conversations that lie inside it; of the first and the last one, which may go on next door,
it keeps the items of its piece for every pair of states (at most 16). Joining those pieces
sees one small row per task. Spans inside a piece join as a balanced tree, so its audits cost
n log n. The rows of the repaired conversation (``edited``) are streamed through the
task of their conversation with one batch and one audit in memory.

**Defined cases.** A null role or text is one space; a turn that is no integer counts as
null; null turns come first, rows of one turn are ordered by role, then text. A null
conversation id is an id of its own. A duplicate has the role and text of any earlier row.
An empty role has no initial and fits nowhere. Further columns are ignored. No rows give no
result. Ids may have any orderable type.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_package
from .common import col, staged

#: States of the pattern's reader: nothing read, after s, after u, after a.
START, SYSTEM, USER, DONE = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
ACCEPTING = (START, DONE)
LEGAL_PAIRS = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a span that is read from left to right; longer ones are joined from such.
BLOCK = 64
BLANKS = " \t\n\x0b\x0c\r"

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def edits_of(step, state: int):
    """(edit, cost, next state) of one step: ("D", m) for m rows that must go, or a row."""
    initial, weight = step
    if initial == "D":
        return [("D" * weight, DELETE * weight, state)]
    out = [("D", DELETE, state)]
    if (state, initial) in STEP:
        out.append(("K", KEEP + weight, STEP[state, initial]))
    out += [("R", REROLE + weight, STEP[state, r]) for r in "ua" if (state, r) in STEP and r != initial]
    return out


def lightest(leaves: list, starts=(START,), whole: bool = True):
    """Knuth's agenda over the spans ``leaves``.

    A leaf is a list of steps or a dict {(p, q): (cost, audit)} of a piece worked out
    elsewhere. With ``whole`` the (cost, audit) of the goal is returned as soon as it is
    final, else the final items {(p, q): (cost, audit)} of all leaves together; the first
    leaf is read from ``starts``, the others from any state.
    """
    # a balanced tree of spans: node -> (neighbour, whether node is the left one, parent)
    up, level, fresh = {}, list(range(len(leaves))), len(leaves)
    while len(level) > 1:
        above = []
        for i in range(0, len(level) - 1, 2):
            up[level[i]], up[level[i + 1]] = (level[i + 1], True, fresh), (level[i], False, fresh)
            above.append(fresh)
            fresh += 1
        level = above + level[len(level) & ~1:]
    root = level[0]
    agenda, final = [], {}
    ends = {}  # (node, state at the open side) -> final items there
    for k, leaf in enumerate(leaves):
        begin = starts if k == 0 else range(4)
        if isinstance(leaf, dict):
            agenda += [(c, len(a) - a.count("I"), a, k, -1, p, q) for (p, q), (c, a) in leaf.items() if p in begin]
        else:
            agenda += [(0, 0, "", k, 0, p, p) for p in begin]
    heapq.heapify(agenda)
    while agenda:
        cost, rows, audit, node, at, p, q = heapq.heappop(agenda)
        if (node, at, p, q) in final:
            continue
        final[node, at, p, q] = cost, audit
        if at >= 0:
            for r in "ua":
                if (q, r) in STEP:
                    heapq.heappush(agenda, (cost + INSERT, rows, audit + "I", node, at, p, STEP[q, r]))
            if at < len(leaves[node]):
                for edit, price, to in edits_of(leaves[node][at], q):
                    heapq.heappush(agenda, (cost + price, rows + len(edit), audit + edit, node, at + 1, p, to))
                continue
        if node == root:
            if whole and q in ACCEPTING:
                return cost, audit
            continue
        beside, is_left, parent = up[node]
        ends.setdefault((node, q if is_left else p), []).append((cost, rows, audit, p, q))
        for c2, n2, a2, p2, q2 in ends.get((beside, q if is_left else p), ()):
            both = (audit + a2, p, q2) if is_left else (a2 + audit, p2, q)
            heapq.heappush(agenda, (cost + c2, rows + n2, both[0], parent, -1, both[1], both[2]))
    last = -1 if root >= len(leaves) or isinstance(leaves[root], dict) else len(leaves[root])
    return {(p, q): v for (node, at, p, q), v in final.items() if node == root and at == last}


class Piece:
    """What is known of the rows of one conversation that follow each other in a task."""

    def __init__(self, conv):
        self.conv, self.steps = conv, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first, self.last, self.low, self.high = None, None, None, None

    def add(self, turn, initial, n, blank, repeat, truncated):
        if self.last is None:
            self.first = (turn, initial)
        elif self.last[1] + initial not in LEGAL_PAIRS:
            self.illegal += 1
        if turn is not None and (self.last is None or self.last[0] != turn):
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = (turn, initial)
        self.illegal += n - 1  # a row beside its copy is never a legal pair
        gone = n if blank or repeat else n - 1
        if blank:
            self.blank += n
        else:
            self.duplicate += gone
            self.truncated += truncated and not repeat
        if gone < n:
            self.steps.append((initial, TRUNCATED * truncated))
        if gone:
            if self.steps and self.steps[-1][0] == "D":
                gone += self.steps.pop()[1]
            self.steps.append(("D", gone))

    def leaves(self):
        return [self.steps[i:i + BLOCK] for i in range(0, len(self.steps), BLOCK)]

    def then(self, other: Piece) -> None:
        """Takes in the piece that follows (not its steps)."""
        self.illegal += other.illegal + (self.last[1] + other.first[1] not in LEGAL_PAIRS)
        self.turns += other.turns - (other.first[0] is not None and other.first[0] == self.last[0])
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.last = other.last

    def counts(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


PIECES = ("part long, open boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, first_turn long, first_initial string, last_turn long, last_initial string, low long, "
          "high long, turns long, items array<struct<p:int,q:int,cost:bigint,audit:string>>")


def arrow_schema(df: DataFrame, fields: str) -> tuple[StructType, pa.Schema]:
    """A schema of the conversation id as in ``df`` and ``fields``, for Spark and Arrow."""
    more = df.sparkSession.createDataFrame([], fields).schema
    schema = StructType([StructField("conv_id", df.schema["conv_id"].dataType)] + list(more))
    return schema, to_arrow_schema(schema)


def pieces(rows: DataFrame) -> DataFrame:
    """One row per conversation and task: finished, or open with the items of the piece."""
    schema, arrow = arrow_schema(rows, PIECES)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, held, first = [], None, True

        def close(piece: Piece, is_open: bool, starts) -> None:
            got = lightest(piece.leaves(), starts, whole=not is_open)
            cost, audit = (None, None) if is_open else got
            items = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in got.items()] if is_open else None
            out.append((piece.conv, part, is_open, *piece.counts(), cost, audit, *piece.first, *piece.last,
                        piece.low, piece.high, piece.turns, items))

        def batch():
            got = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(got, schema=arrow)

        for b in batches:
            for conv, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        close(held, first, range(4) if first else (START,))
                        first = False
                        if len(out) >= 2000:
                            yield batch()
                    held = Piece(conv)
                held.add(*row)
        if held is not None:
            close(held, True, range(4) if first else (START,))
            yield batch()

    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "initial", "n", "blank", "repeat", "truncated").mapInArrow(run, schema)


def join_pieces(found: DataFrame) -> DataFrame:
    """Conversations of which pieces lie in several tasks, one row per task."""
    schema, arrow = arrow_schema(found, COUNTS)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        whole, leaves = None, []
        for r in rows:
            p = Piece(r["conv_id"])
            p.blank, p.duplicate, p.truncated, p.illegal = r["blank"], r["duplicate"], r["truncated"], r["illegal"]
            p.first, p.last = (r["first_turn"], r["first_initial"]), (r["last_turn"], r["last_initial"])
            p.low, p.high, p.turns = r["low"], r["high"], r["turns"]
            whole = p if whole is None else (whole.then(p), whole)[1]
            leaves.append({(i["p"], i["q"]): (i["cost"], i["audit"]) for i in r["items"]})
        row = (whole.conv, *whole.counts(), *lightest(leaves))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return found.groupBy("conv_id").applyInArrow(run, schema)


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their number of copies, the initial of the role and the fault flags."""
    turn = col("turn").try_cast("long")
    plain = rows.select(col("conv_id").alias("conv_id"), turn.alias("turn"),
                        F.coalesce(col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(col("text").cast("string"), F.lit(" ")).alias("text"))
    d = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    d = d.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    seen = (d.groupBy("conv_id", "digest").agg(F.min(when).alias("first"), F.count("*").alias("turns"))
            .filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("k"), "first"))
    body = F.rtrim("text", F.lit(BLANKS))
    return d.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("k")), "left").select(
        "conv_id", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"),
        F.coalesce(when > F.col("first"), F.lit(False)).alias("repeat"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, edited rows) of ``rows`` (conv_id, turn, role, text).

    The first has the counts, the cost and the audit of every conversation, the second
    its repaired rows: conv_id, seq from 0, edit (K, R or I), role, text, in order
    within each partition. Both come from tables in the shared folder.
    """
    ship_package(rows.sparkSession)
    flagged = staged(faults(rows), "conversation-rows")
    found = staged(pieces(flagged), "conversation-pieces")
    names = ["conv_id", *[f.split()[0] for f in COUNTS.split(", ")]]
    done = found.filter("not open").select(*names).unionByName(join_pieces(found.filter("open")))
    done = staged(done, "conversations")
    return done, edited(flagged, done)


def edited(flagged: DataFrame, done: DataFrame) -> DataFrame:
    """The rows that the audits leave, in order."""
    schema, arrow = arrow_schema(flagged, "seq long, edit string, role string, text string")
    plan = done.select("conv_id", F.lit(0).alias("kind"), "audit", F.lit(None).cast("long").alias("turn"),
                       F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    rows = flagged.select("conv_id", F.lit(1).alias("kind"), F.lit("").alias("audit"), "turn", "role", "text", "n")

    def run(batches):
        audit, at, seq, odd = "", 0, 0, 0

        def place():  # the role that the pattern has at seq
            return "user" if (seq - odd) % 2 == 0 else "assistant"

        def inserts():
            nonlocal at, seq
            while at < len(audit) and audit[at] == "I":
                out.append((held, seq, "I", place(), ""))
                at, seq = at + 1, seq + 1

        held = None
        for b in batches:
            out = []
            for conv, kind, plan, role, text, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind == 0:
                    held, audit, at, seq = conv, plan, 0, 0
                    odd = (len(audit) - audit.count("D")) % 2
                    inserts()
                    continue
                for _ in range(n):
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        out.append((conv, seq, edit, role if edit == "K" else place(), text))
                        seq += 1
                    inserts()
            if out:
                got = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(got, schema=arrow)

    # a conversation is a stream here: its audit, then its rows
    both = plan.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return both.select("conv_id", "kind", "audit", "role", "text", "n").mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the newline-joined ``role:text`` of what ``edited`` returns.

    The hash is fed row by row, so the text of a conversation is never in memory whole.
    """
    schema, arrow = arrow_schema(repaired, "sha256 string")

    def run(batches):
        held, state = None, None
        for b in batches:
            out = []
            for conv, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or conv != held:
                    if state is not None:
                        out.append((held, state.hexdigest()))
                    held, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], arrow[0].type), pa.array([state.hexdigest()])], schema=arrow)

    return repaired.select("conv_id", "role", "text").mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """The faults of the registered query, dealt by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes
    its role user. Null ids, turns, roles and texts are one space.
    """
    one = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    r = rows.select(col("conv_id").alias("conv_id"), col("turn").alias("turn"), one("role").alias("role"),
                    one("text").alias("text"), key.alias("damage")).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("_copy")
    return r.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), copies).drop("_copy")
