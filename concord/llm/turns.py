"""Repairing the structure of conversations: audits by Wagner-Fischer alignment to the grammar ``(s?(ua)+)?``.

The grammar has one string of each feasible length: nothing, ua, sua, uaua, suaua, ...  Turns are aligned to each of
them.  All strings end alike, so one table of costs from a turn and a number of open letters to the end serves every
length; a leading s is one more column.  An incumbent, a plain walk that re-roles whatever stands in the wrong place,
bounds the table to Ukkonen's band of cells that can still cost no more.  Among the lengths of least cost the backtraced
audits are compared.

A conversation's rows come to a task in order, first their codes without texts (one byte a row is kept), then the texts,
which go through the hash one batch at a time.  So a very long conversation needs little memory, though one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs of the edits, the grammar's role names, adjacent initials that are in order, white space.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
IN_ORDER = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

#: Turns of a conversation whose audit a worker remembers, and how many conversations.
KNOWN_TURNS, KNOWN = 64, 50_000
_known: dict[tuple[str, str], tuple[int, str]] = {}


def _letter(left: int) -> str:
    """The target's letter with ``left`` letters still open: it ends in ua."""
    return "a" if left % 2 else "u"


def _walk_cost(initials: str, faults: str) -> int:
    """Cost of a plain repair: what must go goes, anything out of place gets the role that is due, a missing end is added."""
    cost, last = 0, ""
    for initial, fault in zip(initials, faults, strict=True):
        if fault == "F":
            cost += DELETE
            continue
        cost += TRUNCATED * (fault == "T")
        if initial == "s" and not last:
            last = "s"
            continue
        due = "a" if last == "u" else "u"
        cost += REROLE * (initial != due)
        last = due
    return cost + INSERT * {"": 0, "s": 2, "u": 1, "a": 0}[last]


class _Table:
    """Least costs from turn i with r open letters to the end, inside the band of an incumbent's cost."""

    def __init__(self, initials: str, faults: str, incumbent: int):
        n = len(initials)
        forced, cut = np.array([f == "F" for f in faults], bool), np.array([f == "T" for f in faults], bool)
        usable = np.concatenate([np.cumsum(~forced[::-1])[::-1], [0]])
        cuts = np.concatenate([np.cumsum(cut[::-1])[::-1], [0]])
        slack = incumbent - DELETE * int(forced.sum()) - TRUNCATED * int(cut.sum())  # beyond what every audit costs
        fewer = np.where(slack <= cuts, slack, cuts + (slack - cuts) // DELETE)  # deleting a truncated turn costs 1 more than keeping it
        self.low = np.maximum(usable - fewer, 0)
        self.high = usable + slack // INSERT
        far = np.int64(1) << 40
        last = np.arange(self.low[n], self.high[n] + 1) * INSERT
        self.rows = [last]
        for i in range(n - 1, -1, -1):
            low, high, below, under = int(self.low[i]), int(self.high[i]), self.rows[-1], int(self.low[i + 1])
            r = np.arange(low, high + 1)
            cost = np.full(len(r), far)

            def reach(shift: int) -> tuple[slice, slice]:
                a, b = max(low, under + shift), min(high, int(self.high[i + 1]) + shift)
                return (slice(a - low, b - low + 1), slice(a - shift - under, b - shift - under + 1)) if a <= b else (slice(0, 0), slice(0, 0))

            here, there = reach(0)
            cost[here] = below[there] + DELETE
            if not forced[i]:
                here, there = reach(1)
                wrong = r[here] % 2 != (initials[i] == "a") if initials[i] in "ua" else np.ones(here.stop - here.start, bool)
                cost[here] = np.minimum(cost[here], below[there] + TRUNCATED * int(cut[i]) + REROLE * wrong)
            self.rows.append(np.minimum.accumulate(cost - INSERT * r) + INSERT * r)
        self.rows.reverse()

    def at(self, i: int, r: int) -> int:
        low = int(self.low[i])
        return int(self.rows[i][r - low]) if low <= r <= self.high[i] else 1 << 40


def align(initials: str, faults: str) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of that cost.

    ``initials`` are the turns' role initials (anything but s, u, a where a turn has another or none), ``faults`` F for
    a turn that must be deleted, T for a truncated one, a space otherwise.
    """
    if not initials:
        return 0, ""
    n, table = len(initials), _Table(initials, faults, _walk_cost(initials, faults))
    openings = [(table.at(0, r), "", 0, r) for r in range(int(table.low[0]), int(table.high[0]) + 1) if r % 2 == 0]
    for p in (p for p in range(n) if initials[p] == "s" and faults[p] != "F"):
        spent = DELETE * p + TRUNCATED * (faults[p] == "T")
        openings += [(spent + table.at(p + 1, r), "D" * p + "K", p + 1, r)
                     for r in range(int(table.low[p + 1]), int(table.high[p + 1]) + 1) if r % 2 == 0 and r]
    least = min(o[0] for o in openings)
    return least, min(_backtrace(table, initials, faults, *o[1:]) for o in openings if o[0] == least)


def _backtrace(table: _Table, initials: str, faults: str, audit: str, i: int, r: int) -> str:
    """The ASCII-least way on from (i, r): each letter leads to one cell, so the least letter is taken wherever it stays cheapest."""
    out, n = [audit], len(initials)
    while i < n or r:
        cost = table.at(i, r)
        if i < n and table.at(i + 1, r) + DELETE == cost:
            out.append("D")
            i += 1
        elif r and table.at(i, r - 1) + INSERT == cost:
            out.append("I")
            r -= 1
        else:
            out.append("K" if initials[i] == _letter(r) else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def audit_of(initials: str, faults: str) -> tuple[int, str]:
    if len(initials) > KNOWN_TURNS:
        return align(initials, faults)
    if (initials, faults) not in _known:
        if len(_known) >= KNOWN:
            _known.clear()
        _known[initials, faults] = align(initials, faults)
    return _known[initials, faults]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text; null roles and texts are one space) with every twentieth row dropped,
    emptied, without sentence ends, repeated or made the user's, by a checksum of conv_id:turn.

    A dropped row stays as one that says so, so that its conversation is not lost: column ``dropped``.
    """
    number = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(number == 4, F.lit("user")).otherwise(_text("role")).alias("role"),
        F.when(number == 1, F.lit("")).when(number == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text")).alias("text"),
        F.explode(F.when(number == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(number == 0))).alias("dropped"),
    )


def _in_order(turns: DataFrame) -> DataFrame:
    """Each conversation's rows in one task by turn, nulls first, then role and a hash of the text: codes, then texts."""
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    ink = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        _text("role").alias("role"), _text("text").alias("text"), dropped.alias("dropped"))
    rows = rows.withColumns({
        "digest": F.unhex(F.md5("text")),
        "kind": F.when(F.col("dropped"), F.lit("X")).when(ink == "", F.lit("F"))
        .when(F.substring(ink, -1, 1).isin(*ENDS), F.lit(" ")).otherwise(F.lit("T"))})
    rows = rows.withColumn("pass", F.explode(F.when(F.col("dropped"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    rows = rows.withColumn("text", F.when(F.col("pass") == 1, F.col("text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pass", F.col("turn").asc_nulls_first(), "role", "digest").select(
        "conv_id", "pass", "turn", "role", "digest", "kind", "text")


class _Conversation:
    """What is kept of one conversation while its rows pass by."""

    def __init__(self, key: int | None, emit: list | None):
        self.key, self.emit = key, emit
        self.initials: list[str] = []
        self.faults: list[str] = []
        self.seen: set[tuple[str, bytes]] = set()
        self.least = self.most = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit: str | None = None
        self.cost = 0

    def code(self, turn: int | None, role: str, digest: bytes, kind: str) -> None:
        if kind == "X":
            return
        if turn is not None:
            self.turns += turn != self.before
            self.before = self.most = turn
            self.least = turn if self.least is None else self.least
        fault = kind
        if kind == "F":
            self.blank += 1
        elif (role, digest) in self.seen:
            self.duplicate, fault = self.duplicate + 1, "F"
        elif kind == "T":
            self.truncated += 1
        self.seen.add((role, digest))
        if self.initials:
            self.illegal += self.initials[-1] + role[:1] not in IN_ORDER
        self.initials.append(role[:1])
        self.faults.append(fault)

    def decide(self) -> None:
        self.cost, self.audit = audit_of("".join(i if i in ("s", "u", "a") else "o" for i in self.initials), "".join(self.faults))
        self.next, self.open, self.hash, self.lines = 0, sum(e != "D" for e in self.audit), sha256(), 0
        self.initials, self.faults, self.seen = [], [], set()

    def _line(self, edit: str, turn: int | None, role: str, text: bytes) -> None:
        self.hash.update((b"\n" if self.lines else b"") + role.encode() + b":")
        self.hash.update(text)
        self.lines += 1
        self.open -= 1
        if self.emit is not None:
            self.emit.append((self.key, self.lines, edit, turn, role, text.decode()))

    def inserts(self) -> None:
        while self.audit[self.next : self.next + 1] == "I":
            self.next += 1
            self._line("I", None, NAMES[_letter(self.open)], b"")

    def text(self, turn: int | None, role: str, text: bytes) -> None:
        self.inserts()
        edit = self.audit[self.next]
        self.next += 1
        if edit != "D":
            self._line(edit, turn, role if edit == "K" else NAMES[_letter(self.open)], text)

    def row(self) -> tuple:
        self.decide_if_needed()
        self.inserts()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest()

    def decide_if_needed(self) -> None:
        if self.audit is None:
            self.decide()


_AUDIT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_REPAIRED = "conv_id bigint, place bigint, edit string, turn bigint, role string, text string"
#: Rows of output gathered before they are handed on.
_BATCH = 5_000


def _batches(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [c for c, _ in fields])


def _pass(batches: Iterator[pa.RecordBatch], emit: bool) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    lines: list[tuple] | None = [] if emit else None
    now: _Conversation | None = None

    def handed_on(least: int) -> Iterator[pa.RecordBatch]:
        rows = lines if emit else out
        if len(rows) >= least:
            yield _batches(rows, _REPAIRED if emit else _AUDIT)
            rows.clear()

    for batch in batches:
        columns = [batch.column(c) if c != "text" else batch.column(c).cast(pa.binary()) for c in ("conv_id", "pass", "turn", "role", "digest", "kind", "text")]
        for key, second, turn, role, digest, kind, text in zip(*(c.to_pylist() for c in columns), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.row())
                    yield from handed_on(_BATCH)
                now = _Conversation(key, lines)
            if second:
                now.decide_if_needed()
                now.text(turn, role, text)
            else:
                now.code(turn, role, digest, kind)
        if emit:
            out.clear()
            yield from handed_on(1)
    if now is not None:
        out.append(now.row())
    yield from handed_on(1)


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair's cost and edits, and a hash of the repaired turns.

    ``turns`` has conv_id, turn, role, text, and ``dropped`` where rows stand only for their conversation; other columns
    are ignored.  Null roles and texts are one space; rows without conv_id are one conversation.  Rows are taken by turn
    (nulls first), then role, then a hash of the text.  A row's first fault counts: blank, duplicate (role and text seen
    earlier), truncated.  Letters of the audit: D delete, I insert, K keep, R give the other role.
    """
    return _in_order(turns).mapInArrow(lambda b: _pass(b, False), _AUDIT)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns themselves: conv_id, place from 1, edit, turn (null where inserted), role, text."""
    return _in_order(turns).mapInArrow(lambda b: _pass(b, True), _REPAIRED)
