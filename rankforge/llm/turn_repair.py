"""Least-cost repair of the turn structure of conversations, as one sorted stream.

A repaired conversation has roles by the pattern ``(s?(ua)+)?``: a leading system
turn or none, then user and assistant in turn. Keeping a turn is free, giving it
the role that may follow costs ``REROLE``, deleting it ``DELETE``, inserting an
empty user or assistant turn ``INSERT``; a truncated turn that stays costs
``TRUNCATED`` more, and blank and repeated turns must go. Among the cheapest
edits the one whose initials (D, I, K, R) are least as text is taken.

Rows are dealt by conversation once. Each row is sent twice into its
conversation's stream: first without its text, last turn first, so that the cost
from every state of the pattern to the end is known turn by turn and the best
edit of each state is kept in one byte; then with its text, first turn first, so
that the edits are read back and the repaired text is hashed as it passes. What
a task holds is four costs, the bytes of one conversation and one Arrow batch;
beyond ``HELD`` turns the bytes go to an unnamed file of the task's own, which
ends with the task and is written anew if the task runs again. Since every edit
leads to one state only, taking the least initial among the cheapest at each
place gives the least text.

Defined cases: a null role or text is one space; a null ``conv_id`` is one
conversation of its own; turns without a number come first, turns of the same
number in the order of role and text; an empty role has no initial, so such a
turn cannot be kept; a conversation without turns costs nothing, as the empty
conversation is allowed. One conversation is one task by the method, at any
length: its sorts spill, and its texts pass one batch at a time.
"""

from __future__ import annotations

import hashlib
import tempfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Backpointers kept in memory, one byte each; the rest lies in a file of the task.
HELD = 1 << 22
SPACE = " \t\n\x0b\f\r"
_OK, _BLANK, _DUPLICATE, _TRUNCATED, _GONE = range(5)

# states: nothing yet, after system, after user, after assistant
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State after an inserted or re-roled turn, and that turn's role.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
#: State after a kept turn of that initial.
_KEEP = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_LETTERS = "DIKR"
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60

REPORT = (
    "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
TURNS = "key string, place long, edit string, role string, text string"


class _Trail:
    """Bytes that are taken back in reverse order; beyond ``held`` they lie in a file."""

    def __init__(self, held=HELD):
        self.held, self.near, self.file, self.parts = held, bytearray(), None, 0

    def push(self, byte):
        if len(self.near) == self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(self.parts * self.held)
            self.file.write(self.near)
            self.parts, self.near = self.parts + 1, bytearray()
        self.near.append(byte)

    def pop(self):
        if not self.near:
            self.parts -= 1
            self.file.seek(self.parts * self.held)
            self.near = bytearray(self.file.read(self.held))
        return self.near.pop()

    def close(self):
        if self.file:
            self.file.close()


class _Conversation:
    """One conversation's costs, backpointers, counts and hash; ``made`` gets its repaired turns."""

    def __init__(self, key, held, made=None):
        self.key, self.made, self.trail = key, made, _Trail(held)
        # costs to the end once no turn is left: what the pattern still lacks is inserted
        self.costs = [0, 2 * INSERT, INSERT, 0]
        self.state, self.place, self.cost = _START, 0, None
        self.counts, self.illegal, self.before = [0] * 5, 0, None
        self.turns = self.first = self.last = 0
        self.audit, self.hash, self.empty = bytearray(), hashlib.sha256(), True

    def back(self, role, fault):
        """The turn before those seen so far, without its text."""
        if fault == _GONE:
            return
        after, options = self.costs, []
        extra, must_go = TRUNCATED * (fault == _TRUNCATED), fault in (_BLANK, _DUPLICATE)
        for s in range(4):
            keep, role_next = _KEEP[s].get(role[:1]), _NEXT[s]
            options.append(
                (
                    DELETE + after[s],
                    _NEVER if must_go or keep is None else extra + after[keep],
                    _NEVER if must_go else REROLE + extra + after[role_next],
                )
            )
        least = [min(o) for o in options]
        once = [min(least[s], INSERT + least[_NEXT[s]]) for s in range(4)]
        self.costs = [min(least[s], INSERT + once[_NEXT[s]]) for s in range(4)]
        byte = 0
        for s, (delete, keep, _) in enumerate(options):
            best = self.costs[s]
            letter = 0 if delete == best else 1 if INSERT + self.costs[_NEXT[s]] == best else 2 if keep == best else 3
            byte |= letter << (2 * s)
        self.trail.push(byte)

    def _say(self, edit, role, text):
        self.audit += edit
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(f"{role}:{text}".encode())
        if self.made is not None:
            self.made.append((self.key, self.place, edit.decode(), role, text))
        self.place += 1

    def _insert(self):
        self._say(b"I", _ROLE[self.state], "")
        self.state = _NEXT[self.state]

    def forth(self, turn, role, text, fault):
        """The next turn in order, with its text."""
        self.cost = self.costs[_START] if self.cost is None else self.cost
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.first = turn if not self.turns else self.first
            self.turns += not self.turns or turn != self.last
            self.last = turn
        byte = self.trail.pop()
        while (letter := byte >> (2 * self.state) & 3) == 1:
            self._insert()
        if letter == 0:
            self.audit += b"D"
        elif letter == 2:
            self._say(b"K", role, text)
            self.state = _KEEP[self.state][role[:1]]
        else:
            self._say(b"R", _ROLE[self.state], text)
            self.state = _NEXT[self.state]

    def report(self):
        while self.state not in (_START, _ASSISTANT):
            self._insert()
        self.trail.close()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        _, blank, duplicate, truncated, _ = self.counts
        audit = self.audit.decode()
        return self.key, gaps, blank, duplicate, truncated, self.illegal, self.cost or 0, audit, self.hash.hexdigest()


def _stream(batches, held, turns_wanted, size=1_000):
    """Reports, or repaired turns, of conversations whose rows lie across the batches."""
    now, rows = None, []
    names = [f.split()[0] for f in (TURNS if turns_wanted else REPORT).split(", ")]

    def ended():
        report = now.report()
        if not turns_wanted:
            rows.append(report)

    for batch in batches:
        columns = (batch[c].tolist() for c in ("key", "phase", "turn", "numbered", "role", "text", "fault"))
        for key, phase, turn, numbered, role, text, fault in zip(*columns):
            if now is None or key != now.key:
                if now is not None:
                    ended()
                now = _Conversation(key, held, rows if turns_wanted else None)
            if phase == 0:
                now.back(role, fault)
            else:
                now.forth(turn if numbered else None, role, text, fault)
            if len(rows) >= size:
                yield pd.DataFrame(rows, columns=names)
                rows.clear()
    if now is not None:
        ended()
    if rows:
        yield pd.DataFrame(rows, columns=names)


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` rows with the faults that a hash of conversation and turn picks.

    ``gone`` marks a dropped row, kept so that its conversation stays known.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _faults(turns: DataFrame) -> DataFrame:
    """Rows dealt by conversation, with their places and first faults."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        gone.alias("gone"),
    ).repartition("key")
    in_order = W.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = W.partitionBy("key", "role", F.xxhash64("text"), "text", "gone").orderBy("place")
    rows = rows.withColumn("place", F.row_number().over(in_order)).withColumn("nth", F.row_number().over(same))
    said = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(F.col("gone"), _GONE)
        .when(said == "", _BLANK)
        .when(F.col("nth") > 1, _DUPLICATE)
        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), _TRUNCATED)
        .otherwise(_OK)
    )
    return rows.withColumn("fault", fault)


def _sorted_stream(turns: DataFrame) -> DataFrame:
    rows = _faults(turns)
    phases = F.when(F.col("fault") == _GONE, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    sent = rows.withColumn("phase", F.explode(phases)).select(
        "key",
        "phase",
        F.when(F.col("phase") == 0, -F.col("place")).otherwise(F.col("place")).alias("at"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.col("turn").isNotNull().alias("numbered"),
        "role",
        F.when(F.col("phase") == 1, F.col("text")).alias("text"),
        "fault",
    )
    return sent.sortWithinPartitions("key", "phase", "at")


def _with_id(made: DataFrame, turns: DataFrame) -> DataFrame:
    back = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(turns.schema["conv_id"].dataType)
    return made.select(back.alias("conv_id"), *[c for c in made.columns if c != "key"])


def report(turns: DataFrame, held: int = HELD) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and hash of the repaired turns."""
    made = _sorted_stream(turns).mapInPandas(lambda batches: _stream(batches, held, False), REPORT)
    return _with_id(made, turns)


def repaired(turns: DataFrame, held: int = HELD) -> DataFrame:
    """The repaired turns, numbered from 0, each with the edit that made it (K, R or I)."""
    made = _sorted_stream(turns).mapInPandas(lambda batches: _stream(batches, held, True), TURNS)
    return _with_id(made, turns).withColumnRenamed("place", "turn")
