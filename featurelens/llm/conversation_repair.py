"""Conversation structure repair: the cheapest edits that make roles alternate, with the audit of what was done.

The rows of a conversation, by turn (nulls first, ties by role and text), are read once.  A row is ``blank`` (no
character but ASCII white space), else a ``duplicate`` (role and text seen earlier), else ``truncated`` (its last such character is
no full stop, ``!`` or ``?``), else sound.  ``Repair`` is a dynamic programme over rows and four states: nothing written, a system row
written, a user row last, an assistant row last.  A row is Deleted, Kept if its role's first character suits the state, or
Reroled to user or assistant; empty user or assistant rows may be Inserted anywhere.  Roles written must begin
``(s?(ua)+)?``.  Of equally cheap repairs the audit, the edits' initials in order, least in ASCII wins.

An audit is a linked ``Edit`` that shares its prefix with all audits that go on from it, and knows its ancestors 1, 2, 4 ... edits back
and a rolling hash of itself.  Two audits of equal cost are compared where they part: the longest common prefix is found by binary
descent over ancestors whose hashes differ; equal hashes are verified by the edits themselves.  So a
tie costs the logarithm of the audit's length, and a row a constant number of edits.

The least audit to each state is enough: two audits over the same rows that end in the same state at the same cost
never begin one another, as insertions cost, so what follows cannot reorder them.

* Null roles and texts count as one space.  Null turns come first and do not count for ``gaps``; a null conversation id is
  one conversation.  A role without a character can only be reroled or deleted.
* Repeated rows are duplicates of the first.  An empty table gives an empty result.
* A conversation is one output row, so it must fit a task; conversations are streamed, so no task holds several.
* Only the named columns are read; the result has no others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

SPACE = " \t\n\v\f\r"
STOPS = ".!?"
#: Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: First character of a role -> states it may follow, and the state it leads to.
AFTER = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
LEGAL = {"su", "ua", "au"}
BASE, PRIME = 0x10001, (1 << 61) - 1
#: Characters of repaired text in an output batch.
OUT = 1 << 20


class Edit:
    """The last edit of an audit, linked to those before it."""

    __slots__ = ("initial", "depth", "hash", "back")

    def __init__(self, initial: str = "", before: Edit | None = None, prime: int = PRIME):
        self.initial = initial
        if before is None:
            self.depth, self.hash, self.back = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * BASE + ord(initial)) % prime
        back, k = [before], 0
        while len(back[k].back) > k:  # 2^(k+1) back is 2^k back from 2^k back
            back.append(back[k].back[k])
            k += 1
        self.back = tuple(back)

    def at(self, depth: int) -> Edit:
        """The audit's first ``depth`` edits."""
        edit, k = self, 0
        far = self.depth - depth
        while far:
            if far & 1:
                edit = edit.back[k]
            far >>= 1
            k += 1
        return edit

    def edits(self) -> str:
        edit, found = self, []
        while edit.depth:
            found.append(edit.initial)
            edit = edit.back[0]
        return "".join(reversed(found))


def same(a: Edit, b: Edit) -> bool:
    """Whether two audits of equal length agree: by hash, verified edit by edit up to a shared one."""
    if a is b:
        return True
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.initial != b.initial:
            return False
        a, b = a.back[0], b.back[0]
    return True


def less(a: Edit, b: Edit) -> bool:
    """Whether audit ``a`` comes before ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if same(x, y):
        return a.depth < b.depth
    for k in range(len(x.back) - 1, -1, -1):
        if k < len(x.back) and not same(x.back[k], y.back[k]):
            x, y = x.back[k], y.back[k]
    return x.initial < y.initial  # their parents agree: the first edits that differ


class Repair:
    """Least cost and audit to each state, row by row."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.best: dict[int, tuple[int, Edit]] = {NOTHING: (0, Edit())}
        self.insert(self.best)

    def offer(self, best: dict, state: int, cost: int, before: Edit, initial: str) -> None:
        known = best.get(state)
        if known is None or cost <= known[0]:
            edit = Edit(initial, before, self.prime)
            if known is None or cost < known[0] or less(edit, known[1]):
                best[state] = cost, edit

    def insert(self, best: dict) -> None:
        for initial in "ua":  # a user row, then an assistant row after it; more never pay
            states, to = AFTER[initial]
            for state in states:
                if state in best:
                    cost, audit = best[state]
                    self.offer(best, to, cost + INSERT, audit, "I")

    def row(self, role: str, fault: str) -> None:
        best: dict[int, tuple[int, Edit]] = {}
        more = TRUNCATED if fault == "truncated" else 0
        for state, (cost, audit) in self.best.items():
            self.offer(best, state, cost + DELETE, audit, "D")
            if fault in ("blank", "duplicate"):
                continue
            for initial, (states, to) in AFTER.items():
                if state in states:
                    if role[:1] == initial:
                        self.offer(best, to, cost + more, audit, "K")
                    if to in ROLES:
                        self.offer(best, to, cost + REROLE + more, audit, "R")
        self.insert(best)
        self.best = best

    def result(self) -> tuple[int, str]:
        (cost, audit), other = self.best[NOTHING], self.best.get(ASSISTANT)
        if other and (other[0] < cost or other[0] == cost and less(other[1], audit)):
            cost, audit = other
        return cost, audit.edits()


def faults(rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    seen: set[tuple[str, str]] = set()
    for role, text in rows:
        solid = text.strip(SPACE)
        again = (role, text) in seen
        seen.add((role, text))
        yield "blank" if not solid else "duplicate" if again else "truncated" if solid[-1] not in STOPS else ""


def applied(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits of an audit."""
    out, at, state = [], 0, NOTHING
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = AFTER[role[0]][1]
        else:
            state = ASSISTANT if state == USER else USER
            role = ROLES[state]
        out.append((role, text))
    return out


def repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    """What ``repair`` returns of one conversation."""
    found, programme = list(faults(rows)), Repair()
    for (role, _), fault in zip(rows, found, strict=True):
        programme.row(role, fault)
    cost, audit = programme.result()
    initials = [role[:1] for role, _ in rows]
    known = {t for t in turns if t is not None}
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0,
            **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "cost": cost, "audit": audit, "repaired": applied(rows, audit)}


MESSAGE = T.StructType([T.StructField("role", T.StringType(), False), T.StructField("text", T.StringType(), False)])
FOUND = T.StructType([*(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      T.StructField("audit", T.StringType()), T.StructField("repaired", T.ArrayType(MESSAGE, False))])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, ``gaps`` (turns missing between the least and the greatest), the numbers of ``blank``,
    ``duplicate`` and ``truncated`` rows, ``illegal`` (neighbours whose roles do not begin su, ua or au), ``cost``, ``audit`` (D, I, K, R)
    and ``repaired`` (role and text of each row)."""
    spark = rows.sparkSession
    read = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    dealt = read.repartition(shuffle_partitions(spark), "conv").sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "text")
    schema = T.StructType([T.StructField(conv_col, read.schema["conv"].dataType), *FOUND.fields])
    message = pa.struct([pa.field("role", pa.string(), False), pa.field("text", pa.string(), False)])
    kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.field("element", message, False))]

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list, list]]:
        turns: list = []
        held: list = []
        conv, begun = None, False
        for batch in batches:
            for c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if begun and c != conv:
                    yield conv, turns, held
                    turns, held = [], []
                conv, begun = c, True
                turns.append(turn)
                held.append((role, text))
        if begun:
            yield conv, turns, held

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, convs, found, size = None, [], [], 0

        def done() -> pa.RecordBatch:
            columns = [pa.array(convs, kind)]
            for f, k in zip(FOUND.fields, kinds, strict=True):
                values = [r[f.name] for r in found]
                columns.append(pa.array([[{"role": a, "text": b} for a, b in v] for v in values] if f.name == "repaired" else values, k))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield batch

        for conv, turns, held in conversations(typed()):
            convs.append(conv)
            found.append(repaired(turns, held))
            size += sum(len(t) for _, t in held)
            if size >= OUT:
                yield done()
                convs, found, size = [], [], 0
        if convs:
            yield done()

    return dealt.mapInArrow(streamed, schema)
