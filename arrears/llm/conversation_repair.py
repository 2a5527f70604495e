"""Conversation structure repair: cheapest edits by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``. Reading it row by row an editor is in one
of four states - nothing yet, after the system row, after a user row, after an assistant row - and what
it may do at a row depends on its state and on one byte of the row: the role's initial and the fault.

A conversation is halved: a forward vector holds the least cost of reaching each state at the middle, a
backward vector the least cost of finishing from it. Where both sums are least the edits cross the
middle; of several such states the one whose edits read least is taken, and both halves are solved with
known ends. A forward vector carries the order of its four audits along: audits up to one row end with
that row's edit, so none is the beginning of another, and the order of two longer ones follows from the
order before and the few letters added. Memory is one byte a row and eight numbers a level.

Inserts stand before the row that they precede, or at the end.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import stage

INITIALS = {"s": 0, "u": 1, "a": 2}     # 3: any other
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
CUT_OFF = 1                             # added for a truncated row that stays
SPACES = " \t\n\x0b\x0c\r"
AFTER = (2, 2, 3, 2)                    # state after a row of the role that a state calls for
ROLE = ("user", "user", "assistant", "user")
KEPT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})   # by state: initials that may follow, and the state after them
TAIL = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
FAR = 1 << 60


def _moves(code: int) -> list[list[tuple[int, int, str]]]:
    """For each state before a row of this code: (state after, cost, audit) of what may be done."""
    initial, fault = code & 3, code >> 2
    extra, out = CUT_OFF if fault == TRUNCATED else 0, []
    for state in range(4):
        some, at, cost, audit = [], state, 0, ""
        for _ in range(3):     # a third insert is back where the first one was
            some.append((at, cost + DELETE, audit + "D"))
            if fault in (NONE, TRUNCATED):
                if initial in KEPT[at]:
                    some.append((KEPT[at][initial], cost + KEEP + extra, audit + "K"))
                some.append((AFTER[at], cost + REROLE + extra, audit + "R"))
            at, cost, audit = AFTER[at], cost + INSERT, audit + "I"
        best = {}
        for after, cost, audit in some:
            best[after] = min(best.get(after, (FAR, "")), (cost, audit))
        out.append([(after, *best[after]) for after in sorted(best)])
    return out


MOVES = [_moves(code) for code in range(16)]


def forward(cost: list[int], order: list[int], code: int):
    """The vectors after one more row, and of each state (state before, audit letters)."""
    best = [(FAR, 0, "", 0)] * 4
    for state in range(4):
        if cost[state] < FAR:
            for after, price, audit in MOVES[code][state]:
                found = (cost[state] + price, order[state], audit, state)
                if found < best[after]:
                    best[after] = found
    ranked = sorted(range(4), key=lambda s: best[s][1:3])
    place = [0] * 4
    for number, state in enumerate(ranked):
        place[state] = number
    return [b[0] for b in best], place, [(b[3], b[2]) for b in best]


def backward(cost: list[int], code: int) -> list[int]:
    """The least cost of finishing, one row earlier."""
    return [min(price + cost[after] for after, price, _ in moves) for moves in MOVES[code]]


def audit(codes, lo: int, hi: int, start: int, end: int) -> str:
    """The least of the cheapest edits of rows ``lo`` to ``hi`` between two states."""
    if hi - lo == 1:
        return next(a for after, _, a in MOVES[codes[lo]][start] if after == end)
    middle = (lo + hi) // 2
    ahead, order = [FAR] * 4, [0] * 4
    ahead[start] = 0
    for at in range(lo, middle):
        ahead, order, _ = forward(ahead, order, codes[at])
    behind = [FAR] * 4
    behind[end] = 0
    for at in range(hi - 1, middle - 1, -1):
        behind = backward(behind, codes[at])
    crossing = min(range(4), key=lambda s: (ahead[s] + behind[s], order[s]))
    return audit(codes, lo, middle, start, crossing) + audit(codes, middle, hi, crossing, end)


class Conversation:
    """What is kept of a conversation while its rows pass: a byte a row, the four-state vector with the
    digests of the repaired rows up to here, and counts."""

    def __init__(self, with_rows: bool = False):
        self.codes, self.rows = bytearray(), array("q") if with_rows else None
        self.cost, self.order = [0, FAR, FAR, FAR], [0] * 4
        self.digests = [hashlib.sha256() for _ in range(4)]
        self.faults, self.illegal, self.last, self.before = [0] * 4, 0, None, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, late: bool, ended: bool, row: int = 0) -> None:
        here = (turn, role, text)
        fault = BLANK if blank else DUPLICATE if late or here == self.before else NONE if ended else TRUNCATED
        self.before = here
        self.faults[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        code = INITIALS.get(initial, 3) | fault << 2
        self.codes.append(code)
        if self.rows is not None:
            self.rows.append(row)
        self.cost, self.order, came = forward(self.cost, self.order, code)
        self.digests = [self._told(state, done, role, text) if self.cost[after] < FAR else None for after, (state, done) in enumerate(came)]

    def _told(self, state: int, done: str, role: str, text: str):
        digest = self.digests[state].copy()
        for letter in done:
            if letter != "D":
                said = f"{ROLE[state]}:" if letter == "I" else f"{role if letter == 'K' else ROLE[state]}:{text}"
                digest.update((("\n" if state else "") + said).encode("utf-8", "surrogatepass"))
                state = KEPT[state][INITIALS[role[0]]] if letter == "K" else AFTER[state]
        return digest

    def solved(self) -> tuple[int, str, str]:
        """Cost, audit, and digest of the repaired rows."""
        end = min(range(4), key=lambda s: (self.cost[s] + TAIL[s][0], self.order[s]))
        done = audit(self.codes, 0, len(self.codes), 0, end) if self.codes else ""
        return self.cost[end] + TAIL[end][0], done + TAIL[end][1], self._rest(end)

    def _rest(self, end: int) -> str:
        digest = self.digests[end]
        for said in ("\nuser:", "\nassistant:") if end == 1 else ("\nassistant:",) if end == 2 else ():
            digest.update(said.encode())
        return digest.hexdigest()

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that the contract deals out by conv_id and turn; dropped rows are marked."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows with what their fault is made of; ``late``: role and text stand in an earlier turn.

    First turns are found by a grouping over conversation and digest, so no conversation is gathered for
    it. Repeats within a turn lie side by side once the rows are in order.
    """
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    rows = rows.withColumn("digest", digest)
    rows = rows.withColumn("conv", F.coalesce("conv_id", F.lit(0))).withColumn("no_conv", F.col("conv_id").isNull())
    # Turns in order, nulls first: the smallest pair is the first turn.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.filter("not dropped").groupBy("conv", "no_conv", "digest").agg(F.min(place).alias("first"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    return rows.join(first, ["conv", "no_conv", "digest"], "left").select(
        "conv", "no_conv", "turn", "role", "text", "dropped", (trimmed == "").alias("blank"),
        F.coalesce(place > F.col("first"), F.lit(False)).alias("late"), F.substring(trimmed, -1, 1).isin(".", "!", "?").alias("ended"),
        *[c for c in rows.columns if c == "row"])


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv", "no_conv").sortWithinPartitions("conv", "no_conv", F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches, with_rows: bool):
    """(conv, no_conv, its Conversation) from batches in order; a conversation may span batches."""
    key, held = None, None
    for frame in batches:
        turns = frame["turn"].astype("Int64")
        known, turns = turns.notna().tolist(), turns.fillna(0).astype(np.int64).tolist()
        rows = frame["row"].tolist() if with_rows else [0] * len(frame)
        for conv, no_conv, told, turn, role, text, dropped, blank, late, ended, row in zip(
                frame["conv"].tolist(), frame["no_conv"].tolist(), known, turns, frame["role"], frame["text"], frame["dropped"].tolist(),
                frame["blank"].tolist(), frame["late"].tolist(), frame["ended"].tolist(), rows):
            if (conv, no_conv) != key:
                if key is not None:
                    yield *key, held
                key, held = (conv, no_conv), Conversation(with_rows)
            if not dropped:
                held.add(turn if told else None, role, text, blank, late, ended, row)
    if key is not None:
        yield *key, held


def report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, faults, cost, audit and digest of the repaired rows, after damage.

    Null conv_ids are one conversation. A null role or text is one space, so such a text is blank and such
    a role no known one; null turns come first and leave no gap. Rows of one turn are in order of role, then
    text; repeated rows are duplicates but for the first. A conversation without rows left has zeros, an
    empty audit and the digest of nothing; an empty table gives no rows. Other columns are not looked at.
    The digest of a conversation runs over all its rows in order, so one task reads them in a stream, of
    which it keeps a byte a row.
    """
    def solved(batches):
        out = []
        for conv, no_conv, held in _conversations(batches, False):
            cost, done, digest = held.solved()
            out.append((None if no_conv else conv, held.gaps(), held.faults[BLANK], held.faults[DUPLICATE], held.faults[TRUNCATED],
                        held.illegal, cost, done, digest))
            if len(out) >= 4096:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    def _frame(out):
        frame = pd.DataFrame(out, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])
        frame["conv_id"] = pd.array(frame["conv_id"], dtype="Int64")
        return frame

    return _in_order(marked(damaged(conversations))).mapInPandas(
        solved, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows of conversations as given: conv_id, place from 0, edit (K, R or I), role, text.

    Nothing is damaged here. Edits are found on row numbers; texts join them afterwards, so none is held.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))
    rows = stage(marked(rows.withColumn("row", F.monotonically_increasing_id())))
    schema = "conv long, no_conv boolean, place long, edit string, said string, row long"

    def edits(batches):
        for conv, no_conv, held in _conversations(batches, True):
            state, at, out, place = 0, 0, [], 0
            for letter in held.solved()[1]:
                initial = held.codes[at] & 3 if letter != "I" and at < len(held.codes) else 3
                if letter != "D":
                    out.append((conv, no_conv, place, letter, None if letter == "K" else ROLE[state], -1 if letter == "I" else held.rows[at]))
                    state, place = KEPT[state][initial] if letter == "K" else AFTER[state], place + 1
                at += letter != "I"
                if len(out) >= 65_536:
                    yield pd.DataFrame(out, columns=["conv", "no_conv", "place", "edit", "said", "row"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["conv", "no_conv", "place", "edit", "said", "row"])

    found = _in_order(rows).mapInPandas(edits, schema)
    kept = found.filter("row >= 0").join(rows.select("row", "role", "text"), "row").select(
        "conv", "no_conv", "place", "edit", F.coalesce("said", "role").alias("role"), "text")
    made = found.filter("row < 0").select("conv", "no_conv", "place", "edit", F.col("said").alias("role"), F.lit("").alias("text"))
    return stage(kept.unionByName(made)).select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "place", "edit", "role", "text")
