"""Cheapest repair of a conversation's structure by depth-first branch and bound.

A search node is (rows used, role awaited).  An explicit stack holds prefixes of edits.  A prefix goes when
its cost and the least that the remaining rows can cost exceed the incumbent, when it ties with the
incumbent and its audit is no smaller, or when the node's table holds a prefix that is no worse.  The
search ends when the stack is empty, which proves the incumbent best.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DELETE, INSERT, REROLE, CUT_SHORT = 2, 5, 1, 5
#: Faults of a row, the first that applies.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Roles awaited: a system or user row; a user row after the system row; an assistant row; a user row or the end.
FIRST, AFTER_SYSTEM, ANSWER, COMPLETE = range(4)
ADDED = {"u": "user", "a": "assistant"}
_NEVER = 1 << 60
_SPACE = " \t\n\v\f\r"


class Prefix:
    """The edits so far: a chain of letters, shared by all prefixes that go on from here."""

    __slots__ = ("before", "letter", "length", "row", "state", "cost")

    def __init__(self, before, letter, row, state, cost):
        self.before, self.letter, self.row, self.state, self.cost = before, letter, row, state, cost
        self.length = before.length + 1 if before else 0

    def letters(self) -> str:
        out, at = [], self
        while at.before:
            out.append(at.letter)
            at = at.before
        return "".join(reversed(out))


def _smaller(a: Prefix, b: Prefix) -> bool:
    """Whether the audit of ``a`` comes before that of ``b``.  Both are followed back to where they part."""
    less = a.length < b.length  # where one begins the other
    while a.length > b.length:
        a = a.before
    while b.length > a.length:
        b = b.before
    while a is not b and a.before:
        if a.letter != b.letter:
            less = a.letter < b.letter
        a, b = a.before, b.before
    return less


def suffix_bounds(initials: list[str], faults: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Least that the rows from each place on can cost: (awaiting a user row, awaiting an answer), and before the first kept row.

    They relax one rule: a conversation may end right after its system row.
    """
    n = len(initials)
    inner, first = [(0, INSERT)] * (n + 1), [0] * (n + 1)
    for i in reversed(range(n)):
        (to_user, to_answer), role = inner[i + 1], initials[i]
        user, answer, start = DELETE + to_user, DELETE + to_answer, DELETE + first[i + 1]
        if faults[i] in (SOUND, TRUNCATED):
            extra = CUT_SHORT if faults[i] == TRUNCATED else 0
            asks, answers = extra + to_answer + REROLE * (role != "u"), extra + to_user + REROLE * (role != "a")
            user, answer, start = min(user, asks), min(answer, answers), min(start, asks)
            if role == "s":
                start = min(start, extra + to_user)
        inner[i] = (min(user, INSERT + answer), min(answer, INSERT + user))
        first[i] = min(start, INSERT + inner[i][1])
    return inner, first


def best_edits(initials: list[str], faults: list[int]) -> tuple[int, str, int]:
    """(cost, audit, prefixes opened) of the cheapest edits; of equal costs the least audit in ASCII order.

    ``initials`` holds the first letter of each row's role, ``faults`` its fault.  Letters: Keep, Rerole, Delete, Insert.
    """
    n = len(initials)
    inner, first = suffix_bounds(initials, faults)

    def bound(row: int, state: int) -> int:
        return first[row] if state == FIRST else inner[row][state == ANSWER]

    best: Prefix | None = None
    path: list[Prefix] = []  # the incumbent's prefixes by length
    seen: dict[tuple[int, int], Prefix] = {}
    stack, opened = [Prefix(None, "", 0, FIRST, 0)], 0
    while stack:
        at = stack.pop()
        if best is not None:
            least = at.cost + bound(at.row, at.state)
            if least > best.cost or least == best.cost and not _smaller(at, path[min(at.length, best.length)]):
                continue
        known = seen.get((at.row, at.state))
        if known is not None and (known.cost < at.cost or known.cost == at.cost and not _smaller(at, known)):
            continue
        seen[at.row, at.state] = at
        opened += 1
        if at.row == n and at.state in (FIRST, COMPLETE):
            if best is None or at.cost < best.cost or at.cost == best.cost and _smaller(at, best):
                best, path, step = at, [], at
                while step:
                    path.append(step)
                    step = step.before
                path.reverse()
            continue
        follow = COMPLETE if at.state == ANSWER else ANSWER
        steps = [Prefix(at, "I", at.row, follow, at.cost + INSERT)]
        if at.row < n:
            role, fault = initials[at.row], faults[at.row]
            steps.append(Prefix(at, "D", at.row + 1, at.state, at.cost + DELETE))
            if fault in (SOUND, TRUNCATED):
                cost = at.cost + (CUT_SHORT if fault == TRUNCATED else 0)
                if role == ("a" if at.state == ANSWER else "u"):
                    steps.append(Prefix(at, "K", at.row + 1, follow, cost))
                elif role == "s" and at.state == FIRST:
                    steps.append(Prefix(at, "K", at.row + 1, AFTER_SYSTEM, cost))
                steps.append(Prefix(at, "R", at.row + 1, follow, cost + REROLE))
        # the most promising prefix is opened first, of equal promise the one of the least letter
        steps.sort(key=lambda p: (p.cost + bound(p.row, p.state), p.letter), reverse=True)
        stack += steps
    return best.cost, best.letters(), opened


def fault_of(role: str, text: str, seen: set) -> int:
    """The first fault of a row, given the (role, text) of the rows before it; adds the row to them."""
    body = text.rstrip(_SPACE)
    known = (role, text) in seen
    seen.add((role, text))
    return BLANK if not body else DUPLICATE if known else TRUNCATED if body[-1] not in ".!?" else SOUND


def repaired_rows(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits of an audit."""
    out, source = [], iter(rows)
    for letter in audit:
        awaited = "a" if out and out[-1][0][:1] == "u" else "u"
        if letter == "I":
            out.append((ADDED[awaited], ""))
            continue
        role, text = next(source)
        if letter != "D":
            out.append((role if letter == "K" else ADDED[awaited], text))
    return out


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, opened long, repaired array<struct<role:string,text:string>>"


def _report(turns: list, roles: list[str], texts: list[str]) -> tuple:
    seen: set = set()
    faults = [fault_of(r, t, seen) for r, t in zip(roles, texts)]
    initials = [r[:1] for r in roles]
    numbers = {t for t in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, opened = best_edits(initials, faults)
    repaired = [{"role": r, "text": t} for r, t in repaired_rows(list(zip(roles, texts)), audit)]
    return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit, opened, repaired


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Counts of faults and the cheapest repair of every conversation: conv_id and the columns of REPORT.

    ``rows`` holds conv_id, turn, role, text and present; rows that are not present only name their
    conversation.  A null conv_id is a conversation like any other.  Rows are taken by turn (nulls first), then
    role and text, so that repeated rows stand together; null roles and texts are one space.  A
    conversation without rows, or with nothing worth keeping, is repaired to nothing.  Other columns are ignored; an empty
    table gives an empty table.  A conversation is the unit of work: its rows are gathered once, in one array,
    and the search holds one prefix for each edit that it opens.
    """
    row = F.struct("turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("present"), row))).alias("rows"))
    arrays = whole.select("conv_id", *[F.col(f"rows.{c}").alias(c) for c in ("turn", "role", "text")])
    kind = dict(rows.dtypes)["conv_id"]
    fields = [part.strip().split(" ", 1)[0] for part in REPORT.split(", ")]
    types = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]

    def run(batches):
        for batch in batches:
            found = [_report(*r) for r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            columns = zip(*found) if found else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["conv_id", *fields])

    return arrays.mapInArrow(run, f"conv_id {kind}, {REPORT}")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with seeded faults, for tests and measurements: conv_id, turn, role, text, present.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its full stops and other end
    marks, 3 repeats it, 4 makes the user its role.  Nulls count as one space.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))), F.lit(20))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), draw.alias("draw"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")
