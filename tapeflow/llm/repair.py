"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, with an audit of them.

Rows carry a fault at most (blank, duplicate or truncated).  Edits go over the rows in order of turns: Keep, Rerole to user
or assistant, Delete, and Insert of an empty turn; what is left has role initials `(s?(ua)+)?`.  Of all cheapest edits the one
whose initials are ASCII-least is the audit.

The search is a dynamic program over four states (nothing kept yet; after a system turn; after a user turn; after an
assistant turn).  A state's best path is a node that shares its prefix with other paths: it has its last step, the number
and a rolling hash of all letters up to it, and its ancestors 1, 2, 4, ... steps back.  Paths of equal cost are
compared at the end of their longest common prefix, which the ancestors' hashes find by halving; the prefix is then
verified step by step back to the node that both share, and paths whose hashes collide are compared in full.

A step ends with the letter of its row, inserts stand before it, and inserts directly before a Delete are left out (after
it they cost the same and read less).  So of two paths over the same rows neither is a beginning of the other, and the
best path over a run of rows can be found from those over its pieces: conversations are cut into pieces by ranges of rows,
each piece gives its best path from every state to every other, and a fold joins the pieces by the same rule.  So no
conversation has to be in one task, but for the hash of its repaired rows, which one task streams.

Defined cases: null roles and texts are one space, null turns come first; rows of equal turns are in order of role, then
of the SHA-256 of the text; equal rows stand together.  A null conversation key is a conversation.  Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Rows of a piece, at most.
PIECE_ROWS = 4096
SPACE = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Costs(NamedTuple):
    """What edits cost; inserts have to cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Node(NamedTuple):
    """A path: its last step's letters, steps and letters in all, their hash, and its ancestors 1, 2, 4, ... steps back."""

    step: str
    depth: int
    letters: int
    hash: int
    back: tuple


ROOT = Node("", 0, 0, 0, ())


def hash_of(letters: str) -> int:
    h = 0
    for c in letters:
        h = (h * _BASE + ord(c)) % _MOD
    return h


_STEPS = {s: (len(s), hash_of(s), pow(_BASE, len(s), _MOD)) for s in ("D", "K", "R", "IK", "IR", "", "I", "II")}


def grown(parent: Node, step: str, hashed: int | None = None) -> Node:
    """The path with one more step; hashed: the step's hash, where it is known."""
    if step in _STEPS:
        n, h, power = _STEPS[step]
    else:
        n, h, power = len(step), hash_of(step) if hashed is None else hashed, pow(_BASE, len(step), _MOD)
    back, at = [parent], parent
    while len(at.back) >= len(back):
        at = at.back[len(back) - 1]
        back.append(at)
    return Node(step, parent.depth + 1, parent.letters + n, (parent.hash * power + h) % _MOD, tuple(back))


def spelled(node: Node) -> str:
    steps = []
    while node.back:
        steps.append(node.step)
        node = node.back[0]
    return "".join(reversed(steps))


def _same(a: Node, b: Node) -> bool:
    """Whether two paths of equal hashes have equal steps, back to the node that they share."""
    while a is not b:
        if a.step != b.step:
            return False
        a, b = a.back[0], b.back[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether a reads before b; both go over the same rows."""
    if a is b:
        return False
    x, y = a, b
    if x.hash != y.hash or x.letters != y.letters:
        for i in range(len(x.back) - 1, -1, -1):
            if i < len(x.back):
                u, v = x.back[i], y.back[i]
                if u is not v and (u.hash != v.hash or u.letters != v.letters):
                    x, y = u, v
        if _same(x.back[0], y.back[0]):
            return x.step < y.step
    elif _same(x, y):
        return False
    return spelled(a) < spelled(b)  # hashes collided


Best = dict[int, tuple[int, Node]]


def _offer(best: Best, state: int, cost: int, node: Node, step: str, hashed: int | None = None) -> None:
    held = best.get(state)
    if held is None or cost < held[0]:
        best[state] = cost, grown(node, step, hashed)
    elif cost == held[0]:
        new = grown(node, step, hashed)
        if less(new, held[1]):
            best[state] = cost, new


def advanced(best: Best, initial: str, forced: bool, truncated: bool, costs: Costs) -> Best:
    """The best paths over one more row."""
    out: Best = {}
    for state, (cost, node) in best.items():
        _offer(out, state, cost + costs.delete, node, "D")
        if forced:
            continue
        cost += costs.truncated * truncated
        to_user, to_assistant = (0, 1) if state != USER else (1, 0)  # inserts that each needs
        if initial == "s" and state == NONE:
            _offer(out, SYSTEM, cost, node, "K")
        for letter, end, inserts in (("u", USER, to_user), ("a", ASSISTANT, to_assistant)):
            step, more = ("K", 0) if initial == letter else ("R", costs.rerole)
            _offer(out, end, cost + more + costs.insert * inserts, node, "I" * inserts + step)
    return out


def finished(best: Best, costs: Costs) -> tuple[int, str]:
    """Cost and audit of the best path to a whole conversation."""
    out: Best = {}
    for state, inserts in ((NONE, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2)):
        if state in best:
            cost, node = best[state]
            _offer(out, NONE, cost + costs.insert * inserts, node, "I" * inserts)
    return out[NONE][0], spelled(out[NONE][1])


def repaired_rows(audit: str, rows: list[tuple[str, str]]):
    """(role, text) of the rows that an audit leaves; rows: those before, in order."""
    reader = Replay(audit)
    for role, text in rows:
        yield from reader.row(role, text)
    yield from reader.end()


class Replay:
    """Applies an audit to rows that come one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.user = audit, 0, False

    def _next(self) -> str:
        self.user = not self.user
        return "user" if self.user else "assistant"

    def _inserts(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._next(), ""

    def row(self, role: str, text: str):
        yield from self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            yield self._next(), text
        elif letter == "K":
            self.user = role[:1] == "u"
            yield role, text

    def end(self):
        yield from self._inserts()


_PIECE_SQL = (
    "conv_id long, part int, piece int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, "
    "first string, last string, paths array<struct<start:int,end:int,cost:long,hash:long,audit:string>>"
)
_PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("hash", pa.int64()), ("audit", pa.string())])
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most")
_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), *((c, pa.int64()) for c in _COUNTS),
    ("first", pa.string()), ("last", pa.string()), ("paths", pa.list_(_PATH)),
])


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class Piece:
    """Counts and best paths over a run of rows of one conversation."""

    def __init__(self, first: bool, costs: Costs):
        """first: whether a conversation is known to begin here, so that paths start from its first state alone."""
        self.costs = costs
        self.paths: dict[int, Best] = {s: {s: (0, ROOT)} for s in ((NONE,) if first else range(4))}
        self.n = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = self.first = self.last = None

    def _step(self, initial: str, forced: bool, truncated: bool) -> None:
        for start, best in self.paths.items():
            self.paths[start] = advanced(best, initial, forced, truncated, self.costs)

    def add(self, turn: int | None, initial: str, copies: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        """copies: equal rows; all but the first are duplicates."""
        n = self.n
        if turn is not None and turn != self.most:
            n["turns"] += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        n["illegal"] += copies - 1 + (self.last is not None and not _legal(self.last, initial))
        self.first, self.last = initial if self.first is None else self.first, initial
        n["rows"] += copies
        n["blank"] += copies if blank else 0
        n["duplicate"] += 0 if blank else copies - (not duplicate)
        n["truncated"] += not blank and not duplicate and truncated
        self._step(initial, blank or duplicate, truncated)
        for _ in range(copies - 1):
            self._step(initial, True, False)

    def row(self, conv, part: int, piece: int) -> dict:
        paths = [{"start": s, "end": e, "cost": cost, "hash": node.hash, "audit": spelled(node)} for s, best in self.paths.items() for e, (cost, node) in best.items()]
        return {"conv_id": conv, "part": part, "piece": piece, **self.n, "least": self.least, "most": self.most, "first": self.first, "last": self.last, "paths": paths}


def pieces(rows: DataFrame, costs: Costs, most_rows: int = PIECE_ROWS) -> DataFrame:
    """Counts and best paths of every piece.  rows: conv_id, turn, role, digest, n, blank, duplicate, truncated."""
    order = ["conv_id", "turn", "role", "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "blank", "duplicate", "truncated")

    def run(batches):
        part, held, conv, number, any_row = TaskContext.get().partitionId(), None, None, 0, False
        for batch in batches:
            out = []
            for conv_id, turn, initial, n, blank, duplicate, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv_id != conv:
                    if held:
                        out.append(held.row(conv, part, number))
                    # the first conversation of a partition may have begun in an earlier one
                    held, conv, number, any_row = Piece(any_row, costs), conv_id, 0, True
                while n:
                    if held.n["rows"] >= most_rows:
                        out.append(held.row(conv, part, number))
                        held, number = Piece(False, costs), number + 1
                    now = min(n, most_rows - held.n["rows"])
                    held.add(turn, initial, now, blank, duplicate, truncated)
                    n, duplicate = n - now, True
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
        if held:
            yield pa.RecordBatch.from_pylist([held.row(conv, part, number)], schema=_PIECE)

    return placed.mapInArrow(run, _PIECE_SQL)


_FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOUND_SQL = "conv_id long, " + ", ".join(f"{c} long" for c in _FOUND) + ", audit string"
_FOUND_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _FOUND), ("audit", pa.string())])


class Fold:
    """Joins the pieces of one conversation, in order."""

    def __init__(self, costs: Costs):
        self.costs, self.best = costs, {NONE: (0, ROOT)}
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = self.last = None

    def add(self, p: dict) -> None:
        for c in self.n:
            self.n[c] += p[c]
        if p["least"] is not None:
            self.n["turns"] -= p["least"] == self.most
            self.least, self.most = p["least"] if self.least is None else self.least, p["most"]
        if p["first"] is not None:
            self.n["illegal"] += self.last is not None and not _legal(self.last, p["first"])
            self.last = p["last"]
        if p["rows"]:
            out: Best = {}
            for path in p["paths"]:
                if path["start"] in self.best:
                    cost, node = self.best[path["start"]]
                    _offer(out, path["end"], cost + path["cost"], node, path["audit"], path["hash"])
            self.best = out

    def row(self, conv) -> dict:
        cost, audit = finished(self.best, self.costs)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.n["turns"]
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)  # as sums of longs wrap
        return {"conv_id": conv, "gaps": gaps, **{c: self.n[c] for c in _FOUND[1:5]}, "cost": cost, "audit": audit}


def _grouped(batches, begin: Callable, add: Callable, end: Callable, schema: pa.Schema):
    """Streams sorted rows: begin() at each new conv_id, add(state, row), end(state, conv_id) -> a result row."""
    held, conv = None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held is None or r["conv_id"] != conv:
                if held is not None:
                    out.append(end(held, conv))
                held, conv = begin(), r["conv_id"]
            add(held, r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([end(held, conv)], schema=schema)


def audits(found: DataFrame, costs: Costs) -> DataFrame:
    """conv_id, gaps, the faults, illegal, cost and audit of every conversation from its pieces."""
    placed = found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return placed.mapInArrow(lambda batches: _grouped(batches, lambda: Fold(costs), Fold.add, Fold.row, _FOUND_ARROW), _FOUND_SQL)


class Hash:
    """The hash of a conversation's repaired rows, which come in order after the row of its audit."""

    def __init__(self):
        self.sha, self.any, self.found, self.replay = hashlib.sha256(), False, None, None

    def _write(self, rows) -> None:
        for role, text in rows:
            self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.any = True

    def add(self, r: dict) -> None:
        if r["audit"] is not None:
            self.found, self.replay = r, Replay(r["audit"])
        else:
            for _ in range(r["copies"]):
                self._write(self.replay.row(r["role"], r["text"]))

    def row(self, conv) -> dict:
        self._write(self.replay.end())
        return {"conv_id": conv, **{c: self.found[c] for c in (*_FOUND, "audit")}, "repaired_sha256": self.sha.hexdigest()}


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number n and the first one's faults; rows of no copies keep their conversation.

    rows: conv_id, turn, role, text, copies, digest.  Only the digest of a text is shuffled.
    """
    left = F.rtrim("text", F.lit(SPACE))
    slim = rows.select("conv_id", "turn", "role", "digest", "copies", (left == "").alias("blank"), (~F.right(left, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    own = slim.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns come first
    first = own.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    marked = own.join(first, same, "left")
    return marked.select("conv_id", "turn", "role", "digest", "n", "blank", (F.col("first").isNotNull() & ~at.eqNullSafe(F.col("first"))).alias("duplicate"), "truncated")


def repair(rows: DataFrame, costs: Costs = Costs(), most_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: conv_id, turn (long), role, text, copies (0 for a row that only names its conversation).  gaps: turns missing
    between the least and the greatest.  illegal: neighbours whose role initials are not su, ua or au.
    """
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    found = audits(pieces(faults(rows), costs, most_rows), costs)
    both = found.unionByName(rows.where("copies > 0"), allowMissingColumns=True)
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest").drop("digest", "turn")
    schema = pa.schema([*_FOUND_ARROW, ("repaired_sha256", pa.string())])
    return placed.mapInArrow(lambda batches: _grouped(text_slices(batches, "text"), Hash, Hash.add, Hash.row, schema), _FOUND_SQL + ", repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows with conv_id, turn, role, text, copies after a fixed damage by the checksum of `conv_id:turn`, modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its `[.!?]`, 3 repeats it, 4 makes its role user.  Nulls are one space.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(known("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
