"""Repair of the turn structure of conversations at the least cost.

Rows of a conversation stand in the order of turn (nulls first). Its repaired form has the
role initials ``(s?(ua)+)?``. Each row is kept (0), given the role user or assistant that
its place asks for (3) or deleted (4); empty rows of user or assistant are inserted
anywhere (3). Blank rows and repeats of an earlier row must go; a row that stays though its
text ends without ``.``, ``!`` or ``?`` adds 3. Of equally cheap edits those win whose
initials, D I K R, read least in ASCII.

* *Order.* Rows are dealt out by conversation and sorted by turn inside each task. Repeats
  are found by Spark in the same partitioning: all but the first of a conversation's rows
  with one role and text. Rows of one turn follow each other by role and text.
* *Walk.* One pass carries, for each of the four states of the pattern, the least cost, its
  rank among the others by the edits read so far, and the running hash of the repaired
  text. Only costs relative to the least one and ranks matter for what comes next, so few
  situations exist and each is worked out once for each kind of row.
* *Giant conversations.* The edits are read back from one number for each row; these go to
  a spill file of the task beyond ``SPILL`` rows. Neither rows nor texts are held.

Why ranks suffice: after a number of rows every state's edits end with the edit of the
last row, so none begins another, and what follows cannot turn their order round.

Nulls and odd input: a null role or text is one space; a null turn comes first and counts
in no gap; rows with a null conv_id are one conversation. Repeated rows are repeats.
Conversations without rows that are present have zeros and an empty repair. Columns other
than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES

RENAME, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3  # what the edits cost
SPILL = 1 << 20  # rows of one conversation whose steps are held in memory
_LEGAL = {"su", "ua", "au"}
_ENDS = (".", "!", "?")

# States of the pattern: nothing yet, after the system row, after a user's row, after an assistant's.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # the role a state asks for
_CLOSE = {0: "", 1: "II", 2: "I", 3: ""}
_NEVER = 1 << 40


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted by the checksum of conversation and turn; a dropped row stays with ``present`` false."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(case == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.array_repeat(F.lit(1), F.when(case == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (case != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


def _moves(state: int, initial: str, must_go: bool, unfinished: bool) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, edits) of what can be done with one row. Inserting before a deleted row is never
    least: deleting first costs the same and reads less."""
    yield state, DELETE, "D"
    if must_go:
        return
    more, cost, edits = UNFINISHED * unfinished, 0, ""
    for _ in range(3):
        if (state, initial) in _STEP:
            yield _STEP[state, initial], cost + more, edits + "K"
        asked = _STEP[state, _ROLE[state][0]]
        yield asked, cost + more + RENAME, edits + "R"
        state, cost, edits = asked, cost + INSERT, edits + "I"


class Steps:
    """The walk's situations: costs above the least one and ranks of the four states."""

    def __init__(self) -> None:
        self.start = (0, _NEVER, _NEVER, _NEVER), (0, 1, 2, 3)
        self._known: dict[tuple, int] = {}
        self.steps: list[tuple] = []

    def after(self, situation: tuple, kind: tuple) -> int:
        """Number of the step a row of this kind (initial, must go, unfinished) makes."""
        known = self._known.get((situation, kind))
        if known is None:
            known = self._known[situation, kind] = len(self.steps)
            self.steps.append(self._worked(situation, kind))
        return known

    @staticmethod
    def _worked(situation: tuple, kind: tuple) -> tuple:
        costs, ranks = situation
        best: list[tuple | None] = [None] * 4
        for state in range(4):
            if costs[state] < _NEVER:
                for to, cost, edits in _moves(state, *kind):
                    offer = costs[state] + cost, ranks[state], edits, state
                    if best[to] is None or offer < best[to]:
                        best[to] = offer
        least = min(b[0] for b in best if b)
        order = sorted((b[1:3], to) for to, b in enumerate(best) if b)
        ranks = [4] * 4
        for rank, (_, to) in enumerate(order):
            ranks[to] = rank
        new = tuple(b[0] - least if b else _NEVER for b in best), tuple(ranks)
        return new, least, tuple((b[3], b[2]) if b else None for b in best)


class _Trail:
    """One number for each row, read from the last to the first; beyond SPILL rows in a file."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file = limit, array("I"), None

    def add(self, step: int) -> None:
        self.held.append(step)
        if len(self.held) >= self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.held.tofile(self.file)
            self.held = array("I")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        if self.file is not None:
            size = self.held.itemsize * self.limit
            for at in range(self.file.tell() - size, -1, -size):
                self.file.seek(at)
                block = array("I")
                block.fromfile(self.file, self.limit)
                yield from reversed(block)
            self.file.close()


class _Walk:
    """One conversation."""

    def __init__(self, steps: Steps, limit: int):
        self.steps, self.situation, self.trail = steps, steps.start, _Trail(limit)
        self.hashes: list = [hashlib.sha256(), None, None, None]
        self.rows = self.base = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.last_turn = self.last_initial = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        end = text.rstrip(SPACES)[-1:]
        blank, seen = not end, bool(seen and end)
        cut = not blank and not seen and end not in _ENDS
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + seen, self.truncated + cut
        initial = role[:1]
        if self.rows and self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        self.rows, self.last_initial = self.rows + 1, initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.least, self.most = turn if self.least is None else self.least, turn
            self.last_turn = turn
        step = self.steps.after(self.situation, (initial if initial in "sua" else "", blank or seen, cut))
        self.situation, cost, moves = self.steps.steps[step]
        self.base += cost
        self.trail.add(step)
        said = None
        new: list = [None] * 4
        for to, move in enumerate(moves):
            if move is None:
                continue
            state, edits = move
            if edits == "D":
                new[to] = self.hashes[state]
                continue
            said = f":{text}".encode() if said is None else said
            new[to] = self.hashes[state].copy()
            for edit in edits:
                name = role if edit == "K" else _ROLE[state]
                new[to].update(b"\n" * (state > 0) + name.encode() + (b":" if edit == "I" else said))
                state = _STEP[state, name[0]]
        self.hashes = new

    def ended(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        costs, ranks = self.situation
        cost, _, state = min((costs[q] + INSERT * len(_CLOSE[q]), ranks[q], q) for q in range(4) if costs[q] < _NEVER)
        said, at = self.hashes[state].copy(), state
        for _ in _CLOSE[state]:
            said.update(f"\n{_ROLE[at]}:".encode())
            at = _STEP[at, _ROLE[at][0]]
        edits = [_CLOSE[state]]
        for step in self.trail.backwards():
            state, edit = self.steps.steps[step][2][state]
            edits.append(edit)
        audit = "".join(reversed(edits))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.base + cost, audit, said.hexdigest()


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, present: Column | None = None, spill: int = SPILL) -> DataFrame:
    """One row for each conv_id: gaps in the turns, faults by kind, pairs of roles that may not follow each
    other, and the cheapest repair: its cost, edits (``audit``) and the hash of the repaired text.

    Rows for which ``present`` does not hold only name their conversation.
    """
    id_field = rows.schema["conv_id"]
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    space = F.lit(" ")
    narrow = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
        F.when(here, F.coalesce("text", space)).otherwise("").alias("text"), here.alias("present"))
    dealt = narrow.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}).repartition("conv_id")
    same = "row_number() OVER (PARTITION BY conv_id, present, role, h1, h2 ORDER BY turn ASC NULLS FIRST) > 1"
    found = dealt.withColumn("seen", F.expr(same)).select(
        F.col("conv_id").isNotNull().alias("named"), F.coalesce("conv_id", F.lit("0").cast(id_field.dataType)).alias("conv_id"),
        F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "seen", "present")
    ordered = found.sortWithinPartitions("named", "conv_id", "timed", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, key, walk, done = Steps(), None, None, []
        for batch in batches:
            for named, conv, timed, turn, role, text, seen, here in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if (named, conv) != key:
                    if walk is not None:
                        done.append((key[1] if key[0] else None, *walk.ended()))
                    key, walk = (named, conv), _Walk(steps, spill)
                if here:
                    walk.row(turn if timed else None, role, text, seen)
            yield _frame(done)
            done = []
        if walk is not None:
            yield _frame([(key[1] if key[0] else None, *walk.ended())])

    schema = T.StructType([id_field, *T._parse_datatype_string(_COUNTS).fields])
    return ordered.mapInPandas(run, schema)


def _frame(done: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", *(c.split()[0] for c in _COUNTS.split(", "))]
    return pd.DataFrame({n: pd.Series([d[i] for d in done], dtype=object) for i, n in enumerate(names)})
