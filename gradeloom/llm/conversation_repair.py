"""Repair of conversations to turns of the form system? (user assistant)+ at the least cost.

Rows are dealt by conversation and sorted by turn; a task streams over them and carries, from one Arrow
batch to the next, the dynamic programme's state: for each state of the form the cost of the cheapest
edits so far, their order among each other (for ties) and a running hash of the turns they leave. What
differs between rows of one kind is nothing but this state, so steps are made once and looked up after. Each row
leaves one number, that of its step, from which the edits are traced back at the end; of long
conversations these numbers go to a scratch file of the task. Memory does not grow with a conversation.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.plans.durable import written
from gradeloom.plans.session import small_batches

#: States of the form: nothing kept yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The role of a turn that is inserted or renamed in each state, and the state after it.
EXPECTED = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
#: Kept turns by state and role initial.
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
RENAME, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: Inserted turns after the last row that complete the form.
TO_END = (0, 2, 1, 0)
#: A state that costs more than this beyond the cheapest one is no part of a cheapest repair: seven always leads from any state to as good an end.
BEHIND = 12
INITIALS = "sua-"
FINE, MUST_GO, TRUNCATED = range(3)
#: Steps of a conversation that are held in memory.
HELD = 1 << 18
SPACES = " \t\n\x0b\f\r"


class Steps:
    """The programme's steps, made when first met: ``move(state, kind)`` is the number of a row of ``made``."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.known: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, tuple]] = []
        self.start = self.named(((0, None, None, None), (0, None, None, None)))

    def named(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def move(self, state: int, kind: int) -> int:
        key = (state, kind)
        if key not in self.known:
            self.known[key] = len(self.made)
            self.made.append(self.step(*self.states[state], INITIALS[kind // 3], kind % 3))
        return self.known[key]

    def step(self, costs: tuple, ranks: tuple, initial: str, fault: int) -> tuple[int, int, tuple]:
        """The next state, what the least cost rose by, and for each state ``(state before, audit letters, roles inserted, role kept)``."""
        best: list[tuple | None] = [None] * 4
        for before, cost in enumerate(costs):
            if cost is None:
                continue
            at, inserted = before, []
            for k in range(3):
                options = [(DELETE, "D", at, None)]
                if fault != MUST_GO:
                    more = CUT_SHORT * (fault == TRUNCATED)
                    if (at, initial) in KEEPS:
                        options.append((more, "K", KEEPS[at, initial], ""))
                    options.append((RENAME + more, "R", AFTER[at], EXPECTED[at]))
                for price, letter, after, role in options:
                    found = (cost + INSERT * k + price, ranks[before], "I" * k + letter, before, tuple(inserted), role)
                    if best[after] is None or found[:3] < best[after][:3]:
                        best[after] = found
                inserted.append(EXPECTED[at])
                at = AFTER[at]
        least = min(x[0] for x in best if x is not None)
        best = [x if x is not None and x[0] <= least + BEHIND else None for x in best]
        order = sorted(x[1:3] for x in best if x is not None)
        state = tuple(None if x is None else x[0] - least for x in best), tuple(None if x is None else order.index(x[1:3]) for x in best)
        return self.named(state), least, tuple(None if x is None else (x[3], x[2], x[4], x[5]) for x in best)


class Trace:
    """Numbers of a conversation's steps in the order of its rows, read back from the last one; blocks beyond ``HELD`` lie in a scratch file that ends with the task."""

    def __init__(self) -> None:
        self.held, self.blocks, self.file = array("I"), 0, None

    def add(self, move: int) -> None:
        self.held.append(move)
        if len(self.held) == HELD:
            if self.file is None:
                # where Spark spills; no other task reads it
                folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            self.held.tofile(self.file)
            self.blocks += 1
            self.held = array("I")

    def back(self) -> Iterator[int]:
        yield from reversed(self.held)
        for k in reversed(range(self.blocks)):
            self.file.seek(4 * HELD * k)
            block = array("I")
            block.fromfile(self.file, HELD)
            yield from reversed(block)
        if self.file is not None:
            self.file.close()


class Conversation:
    """What is carried along one conversation."""

    def __init__(self, steps: Steps) -> None:
        self.steps, self.state, self.cost = steps, steps.start, 0
        self.hashes = [hashlib.sha256(), None, None, None]
        self.trace = Trace()
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.initial: str | None = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, kind: int, fault: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.turns == 0 else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        if fault:
            self.counts[fault - 1] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.initial = role[:1]
        move = self.steps.move(self.state, kind)
        self.trace.add(move)
        self.state, rise, links = self.steps.made[move]
        self.cost += rise
        hashes: list = [None] * 4
        for after, link in enumerate(links):
            if link is None:
                continue
            before, _, inserted, kept = link
            parts = [f"{r}:" for r in inserted]
            if kept is not None:
                parts.append(f"{kept or role}:{text}")
            hashes[after] = self.hashes[before]
            if parts:
                hashes[after] = hashes[after].copy()
                hashes[after].update((("\n" if before != NOTHING else "") + "\n".join(parts)).encode("utf-8", "surrogatepass"))
        self.hashes = hashes

    def result(self) -> tuple:
        costs, ranks = self.steps.states[self.state]
        _, _, last = min((c + INSERT * TO_END[s], ranks[s], s) for s, c in enumerate(costs) if c is not None)
        digest, at, inserted = self.hashes[last].copy(), last, []
        for _ in range(TO_END[last]):
            inserted.append(f"{EXPECTED[at]}:")
            at = AFTER[at]
        if inserted:
            digest.update(("\n" + "\n".join(inserted)).encode())
        letters, state = ["I" * TO_END[last]], last
        for move in self.trace.back():
            state, edits, _, _ = self.steps.made[move][2][state]
            letters.append(edits)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts, self.cost + costs[last] + INSERT * TO_END[last], "".join(reversed(letters)), digest.hexdigest())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (``conv, turn, role, text, copy``) with the number of the first fault each has: 1 blank, 2 duplicate, 3 truncated, 0 none."""
    kept = F.rtrim("text", F.lit(SPACES))
    earlier = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    fault = F.when(kept == "", 1).when(earlier, 2).when(~F.substring(kept, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return rows.withColumn("fault", fault.cast("int"))


def prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None, copies: Column | None) -> DataFrame:
    """Rows by conversation in the order of their turns, with fault and kind; rows that are not present only name their conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"),
        (F.lit(True) if present is None else present).alias("here"), (F.lit(1) if copies is None else copies).alias("copies"),
    )
    here = given.filter("here").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("here", "copies")
    marked = with_faults(here)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    what = F.when(F.col("fault").isin(1, 2), MUST_GO).when(F.col("fault") == 3, TRUNCATED).otherwise(FINE)
    marked = marked.withColumn("kind", (3 * code + what).cast("int"))
    names = given.filter("not here").select("conv").distinct()
    absent = names.select("conv", *[F.lit(None).cast(t).alias(c) for c, t in marked.dtypes if c != "conv"])
    together = marked.unionByName(absent).repartition("conv")
    return together.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "copy")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, copies: Column | None = None) -> DataFrame:
    """One row for each conversation: its faults, and the cheapest edits to the form ``(s?(ua)+)?`` of role initials.

    Turns are taken in their order, null first; ties by role, text. A turn's first fault counts: ``blank`` (no character
    but spaces), ``duplicate`` (role and text seen earlier), ``truncated`` (last character is none of ``.!?``). ``illegal``
    counts neighbours that follow no su, ua or au; ``gaps`` the numbers missing between the least and the greatest turn.
    Edits: Keep 0, Rename to user or assistant 3, Delete 4 (blank and duplicate turns must go), Insert an empty turn 3; a truncated turn that
    stays adds 3. ``audit`` has the initials D, I, K, R of the cheapest edits, the least in ASCII of several;
    ``repaired_sha256`` is that of the lines ``role:text`` left.

    A null role or text is one space, a null turn comes first and counts in no gap, a null conversation id is a
    conversation. Repeated rows are duplicates. Texts of any length pass one at a time. ``present`` (false: the row names its
    conversation, no more) and ``copies`` (times a row stands) may describe damage. A conversation with no row
    present has zeros, an empty audit and the hash of nothing. An empty table gives an empty result. Other columns are not read.
    A large conversation is one stream of one task, whose memory does not grow with it.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, now, name, held, size, of = Steps(), None, None, [], 0, None
        for batch in batches:
            of = batch.schema.field("conv").type
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "kind", "fault")), strict=True):
                if now is None or conv != name:
                    if now is not None:
                        held.append((name, *now.result()))
                        size += len(held[-1][7])
                        if len(held) >= 2000 or size > 1 << 24:
                            yield batch_of(held, of)
                            held, size = [], 0
                    now, name = Conversation(steps), conv
                if row[3] is not None:
                    now.add(*row)
        if now is not None:
            held.append((name, *now.result()))
            yield batch_of(held, of)

    def batch_of(held: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        names = [conv_col, *(c.split()[0] for c in RESULT.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), [of, *_KINDS], strict=True)], names)

    return prepared(rows, conv_col, turn_col, role_col, text_col, present, copies).mapInArrow(run, f"`{conv_col}` {kind}, {RESULT}")


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, copies: Column | None = None) -> DataFrame:
    """The turns that the repair leaves: the conversation's id, ``place`` from 1, ``edit`` (K, R or I), ``role``, ``text`` and the row's ``turn`` (null if inserted).

    Each conversation's audit is sorted before its rows in one stream and followed row by row. Nulls, ties, repeated rows and
    empty tables as in ``repair_conversations``.
    """
    args = (conv_col, turn_col, role_col, text_col, present, copies)
    audits = written(repair_conversations(rows, *args).select(F.col(conv_col).alias("conv"), "audit"))
    kind = rows.schema[conv_col].dataType.simpleString()
    marked = prepared(rows, *args).filter("kind is not null").withColumn("audit", F.lit(None).cast("string"))
    plans = audits.select("conv", "audit", *[F.lit(None).cast(t).alias(c) for c, t in marked.dtypes if c not in ("conv", "audit")])
    stream = marked.unionByName(plans).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, at, state, place, name = "", 0, NOTHING, 0, None

        def until_row(edits: str) -> Iterator[tuple]:
            """Inserted turns, up to a letter that takes a row."""
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                place += 1
                yield (name, place, "I", EXPECTED[state], "", None)
                at, state = at + 1, AFTER[state]

        for batch in batches:
            out = []
            for conv, turn, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "audit")), strict=True):
                if audit is not None:
                    out += until_row(letters)
                    letters, at, state, place, name = audit, 0, NOTHING, 0, conv
                    continue
                out += until_row(letters)
                edit, at = letters[at], at + 1
                if edit != "D":
                    place += 1
                    out.append((conv, place, edit, role if edit == "K" else EXPECTED[state], text, turn))
                    state = KEEPS[state, role[:1]] if edit == "K" else AFTER[state]
            yield turns_of(out, batch.schema.field("conv").type)
            last = batch.schema.field("conv").type
        if name is not None or letters:
            yield turns_of(list(until_row(letters)), last)

    def turns_of(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 6
        kinds = [of, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [conv_col, "place", "edit", "role", "text", "turn"])

    return stream.mapInArrow(run, f"`{conv_col}` {kind}, place long, edit string, role string, text string, turn long")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, Column, Column]:
    """``rows`` damaged by crc32 of ``conv:turn`` modulo 20 (0 drops, 1 empties the text, 2 takes its ``[.!?]``, 3 repeats, 4 sets role user), and the columns ``present`` and ``copies`` for ``repair_conversations``. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(blank(text_col), "[.!?]", "")).otherwise(blank(text_col))
    role = F.when(draw == 4, "user").otherwise(blank(role_col))
    out = rows.select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), draw.alias("_draw"))
    return out, F.col("_draw") != 0, F.when(F.col("_draw") == 3, 2).otherwise(1)


def repair_damaged(rows: DataFrame) -> DataFrame:
    """``repair_conversations`` of the damaged rows."""
    damaged, present, copies = damage(rows)
    return repair_conversations(damaged, present=present, copies=copies)
