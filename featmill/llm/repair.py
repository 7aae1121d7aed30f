"""Repair of conversation structure by a run-length dynamic programme.

A conversation's rows are symbols: the initial of the role together with the row's fault. The cheapest edits that make
the roles alternate are a shortest way through four states (nothing yet, after a system, user or assistant turn).
What one symbol does to the costs of the states is a 4 by 4 matrix of the min-plus algebra, insertions included; a run
of n equal symbols is its n-th power, put together from cached binary powers, so costs need one step per run and
bit. Edits are unrolled from the costs, block by block, always taking the letter of least ASCII code among the cheapest.

Faults are found with DataFrame functions. Then each conversation's symbols, a few bytes a row, come sorted before its
texts in the same partition: a task reads the symbols, solves, and lets the texts pass by one after another. It holds
one byte per row of one conversation, whatever the texts' length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmill.llm.common import BLANK

# Costs of edits (fixed values), and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Symbols: system, user, assistant or another initial; the same four, truncated; a row that must go.
GONE, SYMBOLS = 8, 9
START, SYSTEM, USER, ASSISTANT = range(4)
# From a state, the state that an inserted or re-roled turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
# From a state and the initial's place, the state that a kept turn leads to; None where it may not stand.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
NEVER = 1 << 60
# Rows unrolled at a time; most rows and number of the conversations whose solution is kept; rows given back at a time.
BLOCK, SHORT, KNOWN, ROWS = 1024, 64, 1 << 15, 4096

Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: the cheapest way through a and then b."""
    return tuple(tuple(min(min(x + b[k][j] for k, x in enumerate(row)), NEVER) for j in range(4)) for row in a)


def applied(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(min(x + y for x, y in zip(row, v)), NEVER) for row in a)


def _insertions() -> Matrix:
    """Cheapest insertions from state to state."""
    rows = []
    for i in range(4):
        row, at, cost = [NEVER] * 4, i, 0
        while row[at] == NEVER:
            row[at] = cost
            at, cost = NEXT[at], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


INSERTIONS = _insertions()
# Cost of what remains after the last row.
AFTER = tuple(min(row[e] for e in ENDS) for row in INSERTIONS)


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of what may be done with a row, in the order of the letters."""
    yield "D", DELETE, state
    if symbol != GONE:
        more = TRUNCATED if symbol >= 4 else 0
        kept = KEPT[state][symbol % 4]
        if kept is not None:
            yield "K", more, kept
        yield "R", REROLE + more, NEXT[state]


def _step(symbol: int) -> Matrix:
    """What one row of this symbol costs from state to state, insertions before it included."""
    rows = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in edits(symbol, state):
            rows[state][to] = min(rows[state][to], cost)
    return product(INSERTIONS, tuple(map(tuple, rows)))


_POWERS: list[list[Matrix]] = [[_step(s)] for s in range(SYMBOLS)]


def before_run(symbol: int, length: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before ``length`` rows of a symbol, from those after them."""
    powers, k = _POWERS[symbol], 0
    while length:
        if k == len(powers):
            powers.append(product(powers[-1], powers[-1]))
        if length & 1:
            v = applied(powers[k], v)
        length, k = length >> 1, k + 1
    return v


def solve(symbols: bytes) -> tuple[int, str]:
    """The least cost of edits and the audit: of the cheapest ones' letters in order the ASCII-least string."""
    runs = [(symbol, sum(1 for _ in rows)) for symbol, rows in groupby(symbols)]
    after = [AFTER]
    for symbol, length in reversed(runs):
        after.append(before_run(symbol, length, after[-1]))
    after.reverse()
    state, audit = START, []
    for (symbol, length), tail in zip(runs, after[1:]):
        for begin in range(0, length, BLOCK):
            end = min(length, begin + BLOCK)
            costs = [before_run(symbol, length - end, tail)]
            for _ in range(end - begin):
                costs.append(applied(_POWERS[symbol][0], costs[-1]))
            for k in range(end - begin, 0, -1):
                state = _unroll(symbol, state, costs[k], costs[k - 1], audit)
    while state not in ENDS or AFTER[state]:
        audit.append("I")
        state = NEXT[state]
    return after[0][START], "".join(audit)


def _unroll(symbol: int, state: int, here: tuple[int, ...], then: tuple[int, ...], audit: list[str]) -> int:
    """Add one row's letters to the audit, insertions before it included; the state after it."""
    while True:
        options = [(letter, cost + then[to], to) for letter, cost, to in edits(symbol, state)]
        options.append(("I", INSERT + here[NEXT[state]], NEXT[state]))
        letter, _, to = min(o for o in options if o[1] == here[state])
        audit.append(letter)
        state = to
        if letter != "I":
            return state


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Turns and reports of sorted ``(conv_id, phase, turn, code, role, text)``.

    Gives ``(conv_id, edit, role, text)`` of each turn of a repaired conversation in order, of deleted ones too, and after
    each conversation ``(report,)``.
    """
    current: Conversation | None = None
    known: dict[bytes, tuple[int, str]] = {}
    for batch in batches:
        for conv_id, phase, turn, code, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    yield from current.end()
                current = Conversation(conv_id, known)
            if phase == 0:
                current.add(turn, code)
            elif phase == 1:
                yield from current.turn(role, text)
    if current is not None:
        yield from current.end()


class Conversation:
    """One conversation on its way through a task: first its symbols, then its texts."""

    def __init__(self, conv_id: int | None, known: dict[bytes, tuple[int, str]]) -> None:
        self.known = known
        self.conv_id, self.symbols, self.faults = conv_id, bytearray(), [0, 0, 0, 0]
        self.illegal, self.last = 0, None
        self.least = self.most = None
        self.turns = 0
        self.audit: str | None = None
        self.cost, self.at, self.state = 0, 0, START

    def add(self, turn: int | None, code: int) -> None:
        """A row: ``code`` is the initial's place and four times the fault (none, truncated, blank, duplicate)."""
        initial, fault = code % 4, code // 4
        self.faults[fault] += 1
        self.symbols.append(GONE if fault >= 2 else code)
        if self.last is not None and (self.last, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if turn != self.most:
                self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn

    def _solved(self) -> str:
        if self.audit is None:
            symbols = bytes(self.symbols)
            found = self.known.get(symbols)
            if found is None:
                found = solve(symbols)
                if len(symbols) <= SHORT and len(self.known) < KNOWN:
                    self.known[symbols] = found
            self.cost, self.audit = found
        return self.audit

    def _inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield self.conv_id, "I", ROLES[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        audit = self._solved()
        yield from self._inserted()
        letter = audit[self.at]
        self.at += 1
        if letter == "R":
            self.state = NEXT[self.state]
            role = ROLES[self.state]
        elif letter == "K":
            self.state = KEPT[self.state]["sua".index(role[0])]
        yield self.conv_id, letter, role, text

    def end(self) -> Iterator[tuple]:
        self._solved()
        yield from self._inserted()
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        _, truncated, blank, duplicate = self.faults
        yield ((self.conv_id, gaps, blank, duplicate, truncated, self.illegal, self.cost, self.audit),)


# --- the rows ---


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by the hash of ``conv_id:turn``; columns ``conv_id, turn, role, text, tie, copy``.

    Nulls become one space. A row that is dropped stays as one without a ``copy``, a repeated one is there with copies
    0 and 1. ``tie`` orders rows of one turn: a digest of role and text as they were.
    """
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        text.alias("text"), _digest(role, text).alias("tie"), (F.crc32(named.cast("binary")) % 20).alias("fault"),
    )
    fault = F.col("fault")
    copies = F.when(fault == 0, F.array(F.lit(None).cast("int"))).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        "tie", F.explode(copies).alias("copy"),
    )


def whole(conversations: DataFrame) -> DataFrame:
    """``conversations`` as they are, in the columns of :func:`damaged`."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        text.alias("text"), _digest(role, text).alias("tie"), F.lit(0).alias("copy"),
    )


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _stream(rows: DataFrame) -> DataFrame:
    """Symbols before texts, conversation by conversation, sorted within partitions."""
    order = [F.col("turn").asc_nulls_first(), F.col("tie"), F.col("copy")]
    there = rows.where(F.col("copy").isNotNull())
    text = F.rtrim("text", F.lit(BLANK))
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    slim = there.select(
        "conv_id", "turn", "tie", "copy", _digest(F.col("role"), F.col("text")).alias("digest"),
        initial.alias("initial"), (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    # The same role and text may stand in a third of a conversation's rows; the window sorts and passes them by.
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(*order)) > 1
    slim = slim.withColumn("again", again)
    fault = F.when(F.col("blank"), 2).when(F.col("again"), 3).when(F.col("truncated"), 1).otherwise(0)
    none = F.lit(None).cast("string")
    symbols = slim.select(
        "conv_id", F.lit(0).alias("phase"), "turn", "tie", "copy", (F.col("initial") + 4 * fault).alias("code"), none.alias("role"),
        none.alias("text"),
    )
    code = F.lit(None).cast("int")
    texts = rows.select(
        "conv_id", F.when(F.col("copy").isNull(), 2).otherwise(1).alias("phase"), "turn", "tie", "copy", code.alias("code"),
        F.when(F.col("copy").isNotNull(), F.col("role")).alias("role"), F.when(F.col("copy").isNotNull(), F.col("text")).alias("text"),
    )
    met = symbols.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "phase", *order)
    return met.select("conv_id", "phase", "turn", "code", "role", "text")


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == ROWS or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)``: the turns of each repaired conversation.

    ``rows`` come from :func:`whole` or :func:`damaged`. ``edit`` is K, R or I (kept, re-roled, inserted); deleted rows are not
    there; ``position`` counts from 0. Rows with a null ``conv_id`` form one conversation.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            position = 0
            for event in edited(batches):
                if len(event) == 1:
                    position = 0
                elif event[1] != "D":
                    yield event[0], position, *event[1:]
                    position += 1

        return _in_batches(found(), schema)

    return _stream(rows).mapInArrow(turns, "conv_id bigint, position bigint, edit string, role string, text string")


def repair_report(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and a digest of the repaired text, one row per conversation of :func:`whole` or :func:`damaged`.

    ``gaps`` counts turn numbers that are missing between the least and the greatest; ``blank``, ``duplicate`` and
    ``truncated`` count rows by their first fault; ``illegal`` counts neighbours whose roles may not follow each other.
    ``audit`` has a letter for each edit: Keep, Rerole, Delete, Insert. ``repaired_sha256`` is that of the turns of
    :func:`repaired_turns`, ``role:text``, joined by newlines. Rows of equal turn follow by a digest of role and text. A
    conversation without rows has zeros, an empty audit and the empty text's digest.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]]
        + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            sha, first = hashlib.sha256(), True
            for event in edited(batches):
                if len(event) == 1:
                    yield *event[0], sha.hexdigest()
                    sha, first = hashlib.sha256(), True
                elif event[1] != "D":
                    sha.update(f"{'' if first else '\n'}{event[2]}:{event[3]}".encode())
                    first = False

        return _in_batches(found(), schema)

    return _stream(rows).mapInArrow(reports, REPORT + ", repaired_sha256 string")
