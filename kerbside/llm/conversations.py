"""Repair of conversation structure by secondary-sorted streams.

A conversation's rows must read as role initials ``(s?(ua)+)?``. Rows are kept (free), given
the role that must come next (3), or deleted (4); rows of that role may be inserted anywhere
(3). Blank rows and repeats have to be deleted; a truncated row that stays costs 3 more. Of
the cheapest lists of edits the one whose initials are least is taken.

The grammar has four states, and in each of them one role can be made: what an edit does
follows from the state. So the state of the dynamic program is four costs, and its pointer
one byte a row: the edit to make next, for each state.

1. Narrow rows (digests for texts) are marked as repeats by a window over equal rows,
   whose place is spread by their content.
2. First stream: rows by conversation, last turn first. The costs are carried across Arrow
   batches; pointers leave the task as rows of at most ``CHUNK`` of them, in a written table,
   so that a conversation of any length takes a few bytes of memory.
3. Second stream: texts and pointers by conversation, first turn first. Pointers are
   followed as texts pass by; texts never pile up.

Going from the last turn to the first, a pointer can be final when it is written, since all
edits at a row begin with a different initial. A conversation passes through one task, row
by row: its digest has to.

Cases: rows of equal turns are taken by role, then by a digest of role and text. A null turn
comes first and is no turn. A null role or text is one space. A null ``conv_id`` is a
conversation of its own. A role can be kept only if its initial is ``s``, ``u`` or ``a`` and
the grammar allows it there. Equal rows are repeats. An empty table gives an empty result;
other columns are ignored. The list of edits is one string, a byte per edit.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.llm.common import slices, write_table

#: What edits cost, and what a truncated row that stays costs beyond its edit.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Pointers per written row.
CHUNK = 1 << 16

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)

#: The state that a made row leads to, its role, and what a conversation may not end without.
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)

#: First faults of a row. A blank one or a repeat must go.
SOUND, BLANK, REPEAT, CUT_OFF = range(4)

#: Edits in the order of their initials.
EDITS = "DIKR"

_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_WHITE = " \t\n\x0b\x0c\r"


def _whole(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage that hangs on ``conv_id:turn``; what is
    dropped stays as a row with ``dropped`` set, so that no conversation gets lost."""
    fate = F.crc32(F.concat(_whole("conv_id"), F.lit(":"), _whole("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(_whole("text"), "[.!?]", "")).otherwise(_whole("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.when(fate == 4, "user").otherwise(_whole("role")).alias("role"), text.alias("text"),
        (fate == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with whole roles and texts and ``digest``, which orders rows of one turn and role."""
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    dropped = "dropped" if "dropped" in rows.columns else F.lit(False).alias("dropped")
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _whole("role").alias("role"),
                       _whole("text").alias("text"), dropped).withColumn("digest", digest)


def _marked(ordered: DataFrame) -> DataFrame:
    """Narrow rows: ``fault`` in place of the text; ``seen`` numbers equal rows from 1."""
    last = F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)
    equal = W.partitionBy("conv_id", "digest", "dropped").orderBy(F.asc_nulls_first("turn"))
    return ordered.select("conv_id", "turn", "role", "digest", "dropped", last.alias("last")).withColumn(
        "seen", F.row_number().over(equal)).withColumn(
        "fault", F.when(F.col("last") == "", BLANK).when(F.col("seen") > 1, REPEAT)
        .when(~F.col("last").isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)).drop("last")


@lru_cache(maxsize=4096)
def before(after: tuple[int, ...], initial: str, fault: int) -> tuple[int, tuple[int, ...], int]:
    """One step of the dynamic program, to the place before a row.

    ``after`` has the costs of what follows the row, by state. The result is the least cost,
    each state's cost above it, and the pointer: two bits a state.
    """
    edits: list[dict[str, int]] = []
    for state in range(4):
        edits.append({"D": DELETE + after[state]})
        if fault in (SOUND, CUT_OFF):
            extra = TRUNCATED if fault == CUT_OFF else 0
            to = kept(state, initial)
            if to is not None:
                edits[state]["K"] = extra + after[to]
            edits[state]["R"] = extra + REROLE + after[MADE[state]]
    costs = [min(e.values()) for e in edits]
    for _ in range(2):
        costs = [min(c, INSERT + costs[MADE[state]]) for state, c in enumerate(costs)]
    pointer = 0
    for state in range(4):
        edits[state]["I"] = INSERT + costs[MADE[state]]
        pointer |= next(k for k, e in enumerate(EDITS) if edits[state].get(e) == costs[state]) << 2 * state
    least = min(costs)
    return least, tuple(c - least for c in costs), pointer


def kept(state: int, initial: str) -> int | None:
    """The state after a row that is kept, if it may be."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


class _Backward:
    """A conversation's costs and counts, from its last row on."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.cost, self.states, self.pointers, self.chunks = conv_id, 0, AT_END, bytearray(), 0
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.highest = self.turn = self.role = self.digest = None

    def take(self, turn: int | None, role: str, digest: bytes, fault: int) -> None:
        initial = role[:1]
        if self.role is not None and (initial, self.role[:1]) not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += turn != self.turn
            self.highest = turn if self.highest is None else self.highest
            self.lowest = turn
        self.turn, self.role, self.digest = turn, role, digest
        self.faults[fault] += 1
        least, self.states, pointer = before(self.states, initial if initial in "sua" else "", fault)
        self.cost += least
        self.pointers.append(pointer)

    def chunk(self) -> tuple:
        """Pointers so far, in the order of turns, at the place of the first of them."""
        self.chunks += 1
        out = bytes(reversed(self.pointers))
        self.pointers.clear()
        return (self.conv_id, 1, self.turn, self.role, self.digest, -self.chunks, out, *[None] * 6)

    def summary(self) -> tuple:
        gaps = 0 if self.highest is None else self.highest - self.lowest + 1 - self.turns
        return (self.conv_id, 0, None, None, None, 0, None, gaps, self.faults[BLANK], self.faults[REPEAT],
                self.faults[CUT_OFF], self.illegal, self.cost + self.states[START])


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_KINDS = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 6]
_NAMES = ["conv_id", "kind", "turn", "role", "digest", "chunk", "pointers", *_COUNTS]
_POINTERS = "kind int, turn bigint, role string, digest binary, chunk bigint, pointers binary, " + ", ".join(
    f"{c} bigint" for c in _COUNTS)


def _id_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def write_pointers(ordered: DataFrame) -> str:
    """First stream: per conversation a summary (``kind`` 0) and its pointers (``kind`` 1)."""
    narrow = _marked(ordered).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest"), F.desc("seen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Backward | None = None
        kind = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *_KINDS], strict=True)], _NAMES)

        for b in slices(batches):
            kind, out = b.column("conv_id").type, []
            columns = (b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "dropped", "fault"))
            for conv_id, turn, role, digest, dropped, fault in zip(*columns, strict=True):
                if state is None or conv_id != state.conv_id:
                    out += _closed(state)
                    state = _Backward(conv_id)
                if not dropped:
                    state.take(turn, role, digest, fault)
                    if len(state.pointers) == CHUNK:
                        out.append(state.chunk())
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of(_closed(state))

    return write_table(narrow.mapInArrow(run, f"conv_id {_id_type(ordered)}, {_POINTERS}"), "edit-pointers")


def _closed(state: _Backward | None) -> list[tuple]:
    if state is None:
        return []
    return ([state.chunk()] if state.pointers else []) + [state.summary()]


Edit = tuple[str, "int | None", "str | None", "str | None"]


class _Forward:
    """Follows a conversation's pointers from its first row on."""

    def __init__(self, conv_id: object, counts: tuple[int, ...]) -> None:
        self.conv_id, self.counts, self.state = conv_id, counts, START
        self.queue: deque[bytes] = deque()
        self.at = 0

    def _insert(self) -> Edit:
        self.state = MADE[self.state]
        return "I", None, ROLES[self.state], ""

    def take(self, turn: int | None, role: str, text: str) -> Iterator[Edit]:
        pointer = self.queue[0][self.at]
        self.at += 1
        if self.at == len(self.queue[0]):
            self.queue.popleft()
            self.at = 0
        while (edit := EDITS[pointer >> 2 * self.state & 3]) == "I":
            yield self._insert()
        if edit == "D":
            yield "D", turn, None, None
        elif edit == "K":
            self.state = kept(self.state, role[:1])
            yield "K", turn, role, text
        else:
            self.state = MADE[self.state]
            yield "R", turn, ROLES[self.state], text

    def end(self) -> Iterator[Edit]:
        while self.state not in (START, ASSISTANT):
            yield self._insert()


class _Digest:
    """Audit and digest of a repaired conversation."""

    def __init__(self) -> None:
        self.audit, self.hash, self.rows = bytearray(), hashlib.sha256(), 0

    def add(self, edit: Edit) -> None:
        self.audit += edit[0].encode()
        if edit[0] != "D":
            self.hash.update((f"\n{edit[2]}:" if self.rows else f"{edit[2]}:").encode())
            self.hash.update(edit[3].encode())
            self.rows += 1


def _second_stream(ordered: DataFrame, pointers: DataFrame) -> DataFrame:
    texts = ordered.filter(~F.col("dropped")).select("conv_id", F.lit(2).alias("kind"), "turn", "role", "digest", "text")
    both = texts.unionByName(pointers, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("kind") > 0, F.asc_nulls_first("turn"), "role", "digest", "kind", "chunk")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Forward, Iterator[Edit], bool] | None]:
    """Every row's edits, and whether a conversation ends with them; None after each slice."""
    state: _Forward | None = None
    for b in slices(batches):
        columns = (b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "pointers", *_COUNTS))
        for conv_id, kind, turn, role, text, pointers, *counts in zip(*columns, strict=True):
            if kind == 0:
                if state is not None:
                    yield state, state.end(), True
                state = _Forward(conv_id, tuple(counts))
            elif kind == 1:
                state.queue.append(pointers)
            else:
                yield state, state.take(turn, role, text), False
        yield None
    if state is not None:
        yield state, state.end(), True
        yield None


def _stream(rows: DataFrame) -> DataFrame:
    ordered = _ordered(rows)
    return _second_stream(ordered, rows.sparkSession.read.parquet(write_pointers(ordered)))


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, step, edit, turn, role, text``: every edit of every conversation in order.
    Deleted rows have no role and text, inserted ones no turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, out, kind = 0, [], None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.column("conv_id").type
                yield b

        for found in _followed(seen()):
            if found is None:
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "step", "edit", "turn", "role", "text"])
                out = []
                continue
            state, edits, ends = found
            for edit in edits:
                out.append((state.conv_id, step, *edit))
                step += 1
            step = 0 if ends else step

    return _stream(rows).mapInArrow(
        run, f"conv_id {_id_type(rows)}, step bigint, edit string, turn bigint, role string, text string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the cost and initials of its edits, and the digest of what
    they make of it."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, out, kind = _Digest(), [], None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.column("conv_id").type
                yield b

        for found in _followed(seen()):
            if found is None:
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                out = []
                continue
            state, edits, ends = found
            for edit in edits:
                digest.add(edit)
            if ends:
                out.append((state.conv_id, *state.counts, digest.audit.decode(), digest.hash.hexdigest()))
                digest = _Digest()

    schema = f"conv_id {_id_type(rows)}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return _stream(rows).mapInArrow(run, schema)
