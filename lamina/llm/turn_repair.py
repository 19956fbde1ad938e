"""Repair of conversation structure: cheapest edits by a Viterbi search that emits what all survivors share.

The survivors of the four states are leaves of a tree of back pointers whose nodes count what refers
to them. A survivor that another one beats by more than it could ever make up for goes, its branch with
it; what is left soon has one ancestor, and all edits up to it are emitted and freed. Memory therefore
holds the unresolved edits only, however long the conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import BATCH_ROWS, map_texts, table

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, CUT_COST, INSERT_COST = 1, 2, 5, 5
#: States by the last role of what is built so far: none, system, user, assistant; none and assistant may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: State after a kept row, by state and role initial.
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: State after a user or assistant turn that is made, the only one that may follow.
_MADE = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What the row's state pays at most beyond the column's to take any rest of the conversation.
_CATCH_UP = ((0, 0, 2, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 2, 0))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Node:
    """An edit and the one before it; refs counts later edits and survivors that point here."""

    __slots__ = ("parent", "edit", "row", "refs", "depth")

    def __init__(self, parent, edit, row):
        self.parent, self.edit, self.row, self.refs = parent, edit, row, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def _order(a: _Node, b: _Node, ends: tuple[str, str], known: dict) -> int:
    """-1 or 1 as the edits up to node a and its end come before or after those of b; 0 if one is the other's beginning.

    The whole unresolved suffixes are compared. `known` has the order of the survivors before this row, each
    paired with itself too, so that what is behind them is not walked again.
    """
    one, other = [ends[0]], [ends[1]]
    while (a, a) not in known and a.parent:
        one.append(a.edit)
        a = a.parent
    while (b, b) not in known and b.parent:
        other.append(b.edit)
        b = b.parent
    if known.get((a, b)):
        return known[a, b]
    while a is not b:
        if a.depth >= b.depth:
            one.append(a.edit)
            a = a.parent
        else:
            other.append(b.edit)
            b = b.parent
    x, y = "".join(reversed(one)), "".join(reversed(other))
    return 0 if x.startswith(y) or y.startswith(x) else -1 if x < y else 1


class Repairer:
    """One conversation: rows go in by add(), finished edits (edit, role, text, times) come out of it and of close()."""

    def __init__(self):
        self.root = _Node(None, "", None)
        self.best: list[tuple[int, _Node] | None] = [(0, self.root), None, None, None]
        self.root.refs = 1
        self.known: dict[tuple[_Node, _Node], int] = {(self.root, self.root): 0}
        self._inserts()
        self.patience = 16

    def _settle(self, found: list) -> None:
        """New survivors from (cost, node before, edit, row); old ones and what only they held are freed."""
        old = self.best
        self.best = [c and ((c[0], c[1]) if c[2] is None else (c[0], _Node(c[1], c[2], c[3]))) for c in found]
        for s in self.best:
            if s:
                s[1].refs += 1
        for s in old:
            if s:
                self._free(s[1])

    def _free(self, node: _Node) -> None:
        node.refs -= 1
        while not node.refs and node.parent:
            node = node.parent
            node.refs -= 1

    def _offer(self, found: list, state: int, new: tuple) -> None:
        # Two ways to one state at one cost took the same rows, so neither is the other's beginning.
        now = found[state]
        if now is None or new[0] < now[0]:
            found[state] = new
        elif new[0] == now[0]:
            (a, x), (b, y) = ((c[1], c[2] or "") for c in (new, now))
            if _order(a, b, (x, y), self.known) < 0:
                found[state] = new

    def _inserts(self) -> None:
        for states in ((START, SYSTEM, ASSISTANT), (USER,)):
            found = [s and (*s, None, None) for s in self.best]
            for q in states:
                if s := self.best[q]:
                    self._offer(found, _MADE[q], (s[0] + INSERT_COST, s[1], INSERT, (_NAMES[_MADE[q]], "", 1)))
            self._settle(found)

    def _prune(self) -> None:
        cost = [s and s[0] for s in self.best]
        for q, own in enumerate(cost):
            if own is not None and any(c is not None and c + _CATCH_UP[r][q] < own for r, c in enumerate(cost) if r != q):
                self._free(self.best[q][1])
                self.best[q] = None

    def add(self, role: str, text: str, must_go: bool, cut: bool, times: int = 1) -> list[tuple]:
        found: list = [None] * 4
        extra = CUT_COST if cut else 0
        for q, s in enumerate(self.best):
            if not s:
                continue
            cost, node = s
            self._offer(found, q, (cost + DELETE_COST * times, node, DELETE, (role, text, times)))
            if must_go:
                continue
            to = _AFTER.get((q, role[:1]))
            if to is not None:
                self._offer(found, to, (cost + extra, node, KEEP, (role, text, 1)))
            to = _MADE[q]
            self._offer(found, to, (cost + extra + REROLE_COST, node, REROLE, (_NAMES[to], text, 1)))
        self._settle(found)
        self._inserts()
        self._prune()
        left = [s[1] for s in self.best if s]
        pairs = {(a, b): _order(a, b, ("", ""), self.known) for a, b in combinations(left, 2)}
        self.known = {(a, a): 0 for a in left} | pairs | {(b, a): -k for (a, b), k in pairs.items()}
        return self._shared()

    def _path(self, node: _Node) -> list[_Node]:
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]

    def _shared(self) -> list[tuple]:
        """Edits that all survivors share. Looked for when enough are unresolved, later after a search in vain."""
        some = next(s[1] for s in self.best if s)
        if some.depth - self.root.depth < self.patience or self.root.refs > 1:
            return []
        out = []
        leaves = {id(s[1]) for s in self.best if s}
        for node in self._path(some):
            if self.root.refs > 1 or id(self.root) in leaves:
                break
            out.append((node.edit, *node.row))
            self.root, node.parent = node, None
        self.patience = 16 if out else 2 * self.patience
        return out

    def unresolved(self) -> int:
        """Edits on the longest path of the tree."""
        return max(s[1].depth for s in self.best if s) - self.root.depth

    def close(self) -> tuple[int, list[tuple]]:
        """Least cost and the edits that were still open."""
        found: list = [None]
        for q in ENDS:
            if s := self.best[q]:
                self._offer(found, 0, (*s, None, None))
        cost, node = found[0][:2]
        return cost, [(n.edit, *n.row) for n in self._path(node)]


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def faulty(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows that are equal in conv_id, turn, role and text once, with their number n and the faults of the first of them.

    blank, or else duplicate: role and text were seen at an earlier place; or else truncated. `times` in
    `turns`, if there, counts a row so often. Conversations of `ids` without rows have one of n = 0.
    """
    times = F.col("times") if "times" in turns.columns else F.lit(1)
    clean = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *clean, times.cast("long").alias("n"))
    if ids is not None:
        none = F.lit(None).cast("string")
        rows = rows.unionByName(ids.select("conv_id", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), F.lit(0).cast("long").alias("n")))
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end = _stripped(F.col("text"))
    return one.withColumns({"blank": end == "", "again": place > 1, "cut": ~F.substring(end, -1, 1).isin(".", "!", "?")})


def repaired(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Edits that give each conversation the role initials (s?(ua)+)? at the least cost, in order, and a row of counts after them.

    `turns` has conv_id, turn, role and text; rows are taken by turn, nulls first, equal turns by role
    and text. conv_id, edit (K, R, D or I), role and text after the edit, times (equal rows that go
    together); the row of counts has no edit and holds gaps, blank, duplicate, truncated, illegal and
    cost. Null roles and texts count as one space, a null conv_id is a conversation, texts of any
    length pass through whole, other columns are not carried, an empty table gives no rows. Rows equal in
    all meet before the shuffle; a conversation is streamed in order through one task, which holds only the unresolved edits.
    """
    rows = faulty(turns, ids)
    kind = rows.schema["conv_id"].dataType.simpleString()
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    fields = pa.schema([("conv_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("times", pa.int64()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, key, work, counts = 0, None, None, {}

        def put(conv_id, edits) -> None:
            nonlocal size
            for e in edits:
                out.append((conv_id, *e, *[None] * len(COUNTS)))
                size += len(e[2])

        def finish() -> None:
            cost, edits = work.close()
            put(key, edits)
            gaps = counts["last"] - counts["first"] + 1 - counts["turns"] if counts["turns"] else 0
            out.append((key, None, None, None, 0, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

        for b in batches:
            for conv_id, turn, role, text, n, blank, again, cut in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                if work is None or conv_id != key:
                    if work is not None:
                        finish()
                    key, work = conv_id, Repairer()
                    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first": 0, "last": None, "initial": None}
                if n:
                    if turn is not None and turn != counts["last"]:
                        counts["first"] = counts["first"] if counts["turns"] else turn
                        counts["last"] = turn
                        counts["turns"] += 1
                    initial = role[:1]
                    if counts["initial"] is not None and counts["initial"] + initial not in ("su", "ua", "au"):
                        counts["illegal"] += 1
                    counts["illegal"] += n - 1
                    counts["initial"] = initial
                    if blank:
                        counts["blank"] += n
                        put(key, work.add(role, text, True, False, n))
                    else:
                        if not again:
                            counts["truncated"] += cut
                            put(key, work.add(role, text, False, cut))
                            n -= 1
                        if n:
                            counts["duplicate"] += n
                            put(key, work.add(role, text, True, False, n))
                if len(out) >= BATCH_ROWS or size > 1 << 20:
                    if out:
                        yield batch()
                    out, size = [], 0
        if work is not None:
            finish()
        if out:
            yield batch()

    schema = f"conv_id {kind}, edit string, role string, text string, times long, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_texts(sorted_rows, run, schema)


def digested(edits: DataFrame) -> DataFrame:
    """Per conversation of repaired(): its counts, the edits' initials as audit, the SHA-256 of the repaired rows `role:text`."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, some = [], hashlib.sha256(), False
        for b in batches:
            out = []
            for conv_id, edit, role, text, times, *counts in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
                if edit is None:
                    out.append((conv_id, *counts, "".join(audit), sha.hexdigest()))
                    audit, sha, some = [], hashlib.sha256(), False
                    continue
                audit.append(edit * times)
                if len(audit) > 1 << 16:
                    audit = ["".join(audit)]
                if edit != DELETE:
                    sha.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
                    some = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(0).type if i == 0 else pa.string() if i > len(COUNTS) else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)

    return map_texts(edits, run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations after a damage that the CRC of `conv_id:turn` decides; times is 2 for a repeated row."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fate.alias("fate")).filter("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after their damage, repaired; one without rows left has zeros, an empty audit and the hash of nothing."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digested(repaired(damaged(turns), turns.select("conv_id").distinct()))
