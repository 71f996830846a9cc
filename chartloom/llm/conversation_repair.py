"""Conversations brought back to the grammar (s?(ua)+)? by the cheapest edits: a forward Viterbi pass over four states.

States: nothing yet, after system, after user, after assistant; a conversation may end in the first or the last.  Each row is
kept (K, 0), given the role user or assistant (R, 1) or deleted (D, 2); empty turns of user or assistant may be inserted
anywhere (I, 5).  Blank and duplicate rows must go; a truncated row that stays costs 5 more.  Of equal costs the audit string
that is the least in ASCII order wins.

A state carries its least (cost, audit) and a running SHA-256 of the repaired turns, so that a conversation streams through in
order and none of its texts is held.  What all states' audits begin with is set aside as it grows: two states hold different
strings only behind the last row where their paths part.  Carrying the least prefix is exact: two audits of one state and
layer that cost the same differ before either ends, since the longer one would hold further inserts, at 5 each.

Spark deals and sorts the rows by conversation and finds faults in SQL; the pass is a mapInArrow over the sorted partitions.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.runtime import pick, python_stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role leads to, by state.
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
RENAMED = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
_AUDIT_HELD = 64
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Path:
    """The best way to one state."""

    __slots__ = ("audit", "cost", "sha", "turns")

    def __init__(self, cost: int, audit: str, sha, turns: bool) -> None:
        self.cost, self.audit, self.sha, self.turns = cost, audit, sha, turns

    def plus(self, cost: int, edit: str, role: str | None, text: str) -> tuple:
        """(cost, audit, origin, turn): an extension, whose hash is taken only if it wins."""
        return self.cost + cost, self.audit + edit, self, None if role is None else f"{role}:{text}"


def taken(best: tuple) -> Path:
    cost, audit, origin, turn = best
    if turn is None:
        return Path(cost, audit, origin.sha, origin.turns)
    sha = origin.sha.copy()
    sha.update((("\n" if origin.turns else "") + turn).encode("utf-8", "surrogatepass"))
    return Path(cost, audit, sha, True)


def closed(layer: dict[int, Path]) -> dict[int, Path]:
    """The layer with inserts: a chain of more than three would come back to a state that it has passed, at a cost."""
    for _ in range(3):
        changed = False
        for state in sorted(layer):
            target, role = RENAMED[state]
            found = layer[state].plus(INSERT, "I", role, "")
            if target not in layer or found[:2] < (layer[target].cost, layer[target].audit):
                layer[target], changed = taken(found), True
        if not changed:
            break
    return layer


class Conversation:
    """One conversation's counts and its four paths."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.faults = conv_id, [None, None, 0], [0, 0, 0, 0]
        self.illegal, self.last, self.before, self.last_turn = 0, None, [], None
        self.layer = closed({NOTHING: Path(0, "", hashlib.sha256(), False)})

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        """fault: 0 none, 1 blank, 2 duplicate, 3 truncated; rows come in order of turn."""
        if turn is not None:
            low, _, n = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != self.last_turn or low is None)]
            self.last_turn = turn
        self.faults[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        found: dict[int, tuple] = {}

        def offer(state: int, way: tuple) -> None:
            if state not in found or way[:2] < found[state][:2]:
                found[state] = way

        extra = TRUNCATED if fault == 3 else 0
        for state, path in self.layer.items():
            offer(state, path.plus(DELETE, "D", None, ""))
            if fault in (1, 2):
                continue
            if (target := STEPS.get(initial, {}).get(state)) is not None:
                offer(target, path.plus(KEEP + extra, "K", role, text))
            target, name = RENAMED[state]
            offer(target, path.plus(REROLE + extra, "R", name, text))
        self.layer = closed({state: taken(way) for state, way in found.items()})
        self.prune()
        some = self.layer[ASSISTANT].audit
        if len(some) > _AUDIT_HELD and (n := len(os.path.commonprefix([p.audit for p in self.layer.values()]))):
            self.before.append(some[:n])
            for p in self.layer.values():
                p.audit = p.audit[n:]

    def prune(self) -> None:
        """Leaves out states that no best way can come from.  Whatever follows the state before all turns can follow an
        assistant's turn too, at the price of deleting one system row; whatever follows a system turn, at no price."""
        after = self.layer[ASSISTANT].cost
        for state, price in ((NOTHING, DELETE), (SYSTEM, 0)):
            if state in self.layer and after + price < self.layer[state].cost:
                del self.layer[state]

    def result(self) -> tuple:
        low, high, distinct = self.turns
        gaps = 0 if low is None else high - low + 1 - distinct
        best = min((self.layer[s] for s in (NOTHING, ASSISTANT) if s in self.layer), key=lambda p: (p.cost, p.audit))
        return self.conv_id, gaps, *self.faults[1:], self.illegal, best.cost, "".join(self.before) + best.audit, best.sha.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with crc32(conv_id:turn) % 20 applied: (conv_id, turn, role, text, gone).

    0 drops a row (gone, so that its conversation stays known), 1 empties its text, 2 removes . ! ? from it, 3 repeats it,
    4 makes its role user.  Nulls of role and text, and of conv_id and turn inside the hashed text, are one space.
    """
    rows = pick(rows, conv_id="bigint", turn="bigint", role="string", text="string").fillna(" ", ["role", "text"])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"), F.explode(times).alias("time"))
    return out.drop("time")


def _fault(stripped: Column, earlier: Column) -> Column:
    return F.when(stripped == "", 1).when(earlier, 2).when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text[, gone]) -> one row a conversation:

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A conversation's rows are in order of turn (nulls first), ties by role and text.  A row's fault is the first of: blank
    (nothing but white space), duplicate (role and text stand in an earlier row), truncated (the last sign that is not white
    space is none of . ! ?).  Roles count by their first letter; null roles and texts are one space.  gone marks rows that
    only name their conversation; one without other rows has zeros, no edits and the hash of the empty string.  Rows with a
    null conv_id are one conversation.  An empty table gives no rows.

    The rows of a conversation pass through one task in order, as a running hash asks for, but are never held there.
    """
    python_stage(rows.sparkSession)
    gone = F.coalesce(F.col("gone").cast("boolean"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    rows = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"), gone.alias("gone"))
    rows = rows.fillna(" ", ["role", "text"]).repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", F.xxhash64("text"), F.hash("text")).orderBy("turn")  # within the conversation's partition
    rows = rows.withColumn("time", F.row_number().over(same))
    rows = rows.withColumn("fault", _fault(F.rtrim("text", F.lit(SPACE)), F.col("time") > 1).cast("int"))
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text", "time").select("conv_id", "turn", "role", "text", "gone", "fault")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

        for b in batches:
            for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now:
                        done.append(now.result())
                    now = Conversation(conv_id)
                if not gone:
                    now.add(turn, role, text, fault)
            if len(done) >= 1024:
                yield out()
        if now:
            done.append(now.result())
        yield out()

    return rows.mapInArrow(passed, RESULT)
