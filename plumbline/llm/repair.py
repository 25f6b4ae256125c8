"""Repair of conversations to the shape ``system? (user assistant)+`` by the cheapest edits.

A repair keeps, renames or deletes each turn and inserts empty ones.  Its costs run through a
four-state automaton of roles, so the cheapest costs from a turn on are four numbers, and of their
differences only a few dozen combinations exist.  The tables over these are made once.

Turns are dealt by conversation and sorted inside the partitions, last turn first.  A task reads
this stream in Arrow batches and carries one table state across them; one byte a turn records what
it needs to find the way back, and beyond a bound they go to the task's scratch file.  At the first
turn the way is walked forward, least letters first.  The edits then meet the texts in a second
sorted stream, in the first turn's direction, which holds one batch and one byte an edit.  So a
conversation of any length is read by one task, as a digest over it must be, but never held.

A turn seen before is found by hashes of role and text, dealt by these and not by conversation.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.storage import settle

# Backpointers of a conversation held in memory, and letters of edits in one row.
_HELD, _PART = 1 << 20, 1 << 16
# Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# What counts as space in a text, and what ends a sentence.
_SPACE, _ENDS = " \t\n\x0b\x0c\r", ".!?"

# Roles by number: system, user, assistant, any other.  States: nothing yet, after a system,
# a user or an assistant turn.
_SYSTEM, _USER, _ASSISTANT, _OTHER = range(4)
_NAMES = ("system", "user", "assistant")
_START, _AFTER_SYSTEM, _AFTER_USER, _AFTER_ASSISTANT = range(4)
# The role that a new or renamed turn must have in each state, and the state after it.
_DUE = (_USER, _USER, _ASSISTANT, _USER)
_NEXT = (_AFTER_USER, _AFTER_USER, _AFTER_ASSISTANT, _AFTER_USER)
# Kinds of turns: role, plus 4 if truncated; 8 must go.
_MUST_GO, _KINDS = 8, 9
# Faults of turns.
_BLANK, _DUPLICATE, _CUT = 1, 2, 3


def _kept(role: int, state: int) -> int | None:
    """The state after a turn of that role, if it may follow."""
    if role == _SYSTEM:
        return _AFTER_SYSTEM if state == _START else None
    return _NEXT[state] if role == _DUE[state] else None


def _choices(kind: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """Edits that use up a turn: letter, next state and cost to the end."""
    found = [("D", state, DELETE + after[state])]
    if kind != _MUST_GO:
        role, extra = kind & 3, TRUNCATED if kind & 4 else 0
        kept = _kept(role, state)
        if kept is not None:
            found.append(("K", kept, KEEP + extra + after[kept]))
        if role != _DUE[state]:
            found.append(("R", _NEXT[state], REROLE + extra + after[_NEXT[state]]))
    return found


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(4):
        costs = [min(cost, INSERT + costs[_NEXT[state]]) for state, cost in enumerate(costs)]
    return tuple(costs)


@dataclass(frozen=True)
class Tables:
    """``step[state * 9 + kind]`` is the state before a turn of that kind, ``added`` what its
    smallest cost grows by, and ``edits[(state * 9 + kind) * 4 + role state]`` the letters up to
    the turn's own and the role state after it.  ``costs`` are a state's costs by role state."""

    step: list[int]
    added: list[int]
    edits: list[tuple[str, int]]
    costs: list[tuple[int, ...]]


def make_tables() -> Tables:
    """All states reachable from a conversation's end."""
    many = 1 << 20
    last = _with_inserts([0, many, many, 0])
    numbers, costs = {last: 0}, [last]
    step, added, edits = [], [], []
    at = 0
    while at < len(costs):
        after = costs[at]
        for kind in range(_KINDS):
            ways = [_choices(kind, state, after) for state in range(4)]
            before = _with_inserts([min(cost for _, _, cost in way) for way in ways])
            for state in range(4):
                letters, here = "", state
                while True:
                    # In the order of the letters: delete, insert, keep, rerole.
                    options = {letter: to for letter, to, cost in ways[here] if cost == before[here]}
                    if "D" in options:
                        letters, here = letters + "D", options["D"]
                        break
                    if INSERT + before[_NEXT[here]] == before[here]:
                        letters, here = letters + "I", _NEXT[here]
                        continue
                    letter = min(options)
                    letters, here = letters + letter, options[letter]
                    break
                edits.append((letters, here))
            least = min(before)
            shape = tuple(cost - least for cost in before)
            if shape not in numbers:
                numbers[shape] = len(costs)
                costs.append(shape)
            step.append(numbers[shape])
            added.append(least)
        at += 1
    # One byte must hold a state and a kind.
    assert len(step) <= 256
    return Tables(step, added, edits, costs)


def _segments(column: pa.Array) -> list[tuple[int, int]]:
    """Runs of equal values, nulls being equal."""
    if not len(column):
        return []
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]))


class _Trail:
    """Bytes written in order and read from the last to the first, in memory up to a bound."""

    def __init__(self):
        self.recent, self.file, self.blocks = array("B"), None, 0

    def add(self, numbers: list[int]) -> None:
        self.recent.extend(numbers)
        if len(self.recent) >= _HELD:
            # Scratch of this task alone: a repeated task writes its own.
            self.file = self.file or tempfile.TemporaryFile()
            while len(self.recent) >= _HELD:
                self.recent[:_HELD].tofile(self.file)
                self.recent = self.recent[_HELD:]
                self.blocks += 1

    def back(self) -> Iterator[int]:
        yield from reversed(self.recent)
        for block in reversed(range(self.blocks)):
            self.file.seek(block * _HELD)
            held = array("B")
            held.fromfile(self.file, _HELD)
            yield from reversed(held)
        if self.file:
            self.file.close()


class _Plan:
    """The conversation being read, from its last turn to its first."""

    def __init__(self, conv, tables: Tables):
        self.conv, self.tables = conv, tables
        self.state = self.base = 0
        self.trail = _Trail()
        self.faults = np.zeros(4, np.int64)
        self.illegal = self.turns = 0
        self.later = None
        self.first = self.last = None

    def read(self, kinds: np.ndarray, roles: np.ndarray, faults: np.ndarray, turns: np.ndarray) -> None:
        """Turns in reverse; ``turns`` are the numbers of those that have one."""
        step, added, state, base = self.tables.step, self.tables.added, self.state, self.base
        passed = []
        for kind in kinds.tolist():
            here = state * _KINDS + kind
            passed.append(here)
            base += added[here]
            state = step[here]
        self.state, self.base = state, base
        self.trail.add(passed)
        self.faults += np.bincount(faults, minlength=4)
        later = roles[:-1] if self.later is None else np.concatenate([[self.later], roles[:-1]])
        earlier = roles[1:] if self.later is None else roles
        legal = (later == _USER) & ((earlier == _SYSTEM) | (earlier == _ASSISTANT))
        legal |= (later == _ASSISTANT) & (earlier == _USER)
        self.illegal += len(legal) - int(legal.sum())
        self.later = int(roles[-1])
        if len(turns):
            self.turns += int((turns[1:] != turns[:-1]).sum()) + (self.first is None or int(turns[0]) != self.first)
            self.last = int(turns[0]) if self.last is None else self.last
            self.first = int(turns[-1])

    def rows(self) -> Iterator[dict]:
        """The edits in parts; the first row also has the counts."""
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        told = {
            "gaps": min(gaps, (1 << 63) - 1),
            "blank": int(self.faults[_BLANK]),
            "duplicate": int(self.faults[_DUPLICATE]),
            "truncated": int(self.faults[_CUT]),
            "illegal": self.illegal,
            "cost": self.base + self.tables.costs[self.state][_START],
        }
        part, letters, held, state = 0, [], 0, _START
        for here in self.trail.back():
            edit, state = self.tables.edits[here * 4 + state]
            letters.append(edit)
            held += len(edit)
            if held >= _PART:
                yield {"conv_id": self.conv, "part": part, "edits": "".join(letters)} | told
                part, letters, held, told = part + 1, [], 0, dict.fromkeys(told)
        # Turns that are still due at the end.
        letters.append({_AFTER_SYSTEM: "II", _AFTER_USER: "I"}.get(state, ""))
        yield {"conv_id": self.conv, "part": part, "edits": "".join(letters)} | told


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _text(name: str) -> Column:
    """Nulls as one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def mark_turns(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and the order among equal turns of every turn."""
    return turns.select(
        F.col(id_column).alias("conv"),
        F.col(turn_column).cast("long").alias("turn"),
        _text(role_column).alias("role"),
        _text(text_column).alias("text"),
    ).withColumn("tie", F.xxhash64(F.lit(1), "text"))


def plan_repairs(marked: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation of ``mark_turns``, and its faults.

    ``conv_id``, ``part`` (from 0) and ``edits``, at most some 65,536 letters a row; the counts
    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal`` and ``cost`` stand in part 0.
    Only hashes and one byte of each text are moved."""
    visible = F.rtrim("text", F.lit(_SPACE))
    last = F.substring(visible, -1, 1)
    initial = F.substring("role", 1, 1)
    role = (
        F.when(initial == "s", _SYSTEM).when(initial == "u", _USER).when(initial == "a", _ASSISTANT).otherwise(_OTHER)
    )
    told = marked.select(
        "conv", "turn", "role", "tie", role.cast("int").alias("number"),
        F.xxhash64(F.lit(2), "role", "text").alias("same"),
        (last == "").alias("blank"), last.isin(*_ENDS).alias("ended"),
    )
    # Two hashes of the text and one of both make equal turns.
    seen = Window.partitionBy("conv", "same", "tie").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(F.col("blank"), _BLANK)
        .when(F.col("again"), _DUPLICATE)
        .when(~F.col("ended"), _CUT)
        .otherwise(0)
    )
    stream = (
        told.withColumn("again", F.row_number().over(seen) > 1)
        .select("conv", "turn", "role", "tie", "again", "number", fault.cast("int").alias("fault"))
        .repartition("conv")
        # Of equal turns the first is the one that is no duplicate.
        .sortWithinPartitions("conv", F.desc_nulls_last("turn"), F.desc("role"), F.desc("tie"), F.desc("again"))
        .select("conv", "turn", "number", "fault")
    )
    shared = vars(make_tables())
    kind = marked.schema["conv"].dataType.simpleString()
    schema = pa.schema(
        [("part", pa.int64()), ("edits", pa.string()), *[(name, pa.int64()) for name in _COUNTS]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, plan, conv_type = Tables(**shared), None, None

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(rows, schema)
            ids = pa.array([row["conv_id"] for row in rows], conv_type)
            return pa.RecordBatch.from_arrays([ids, *made.columns], ["conv_id", *schema.names])

        for batch in batches:
            if not batch.num_rows:
                continue
            conv, turn = batch.column(0), batch.column(1)
            conv_type = conv.type
            roles, faults = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            kinds = np.where((faults == _BLANK) | (faults == _DUPLICATE), _MUST_GO, roles + 4 * (faults == _CUT))
            numbered = turn.is_valid().to_numpy(zero_copy_only=False)
            turns = turn.fill_null(0).to_numpy()
            rows = []
            for start, stop in _segments(conv):
                name = conv[start].as_py()
                if plan is None or plan.conv != name:
                    if plan is not None:
                        rows += plan.rows()
                    plan = _Plan(name, tables)
                mine = slice(start, stop)
                plan.read(kinds[mine], roles[mine], faults[mine], turns[mine][numbered[mine]])
            if rows:
                yield batch_of(rows)
        if plan is not None:
            for row in plan.rows():
                yield batch_of([row])

    counts = ", ".join(f"{name} long" for name in _COUNTS)
    return stream.mapInArrow(run, f"conv_id {kind}, part long, edits string, {counts}")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversations in pieces: the id, and (edit, turn, role, text) of repaired turns.

    The stream has a conversation's edits first, then its turns in order."""
    conv, state, place, edits, spool = None, _START, 0, b"", None
    fresh = True

    def take() -> bytes:
        nonlocal edits, place
        while place >= len(edits):
            edits, place = spool.read(_PART), 0
            if not edits:
                return b""
        place += 1
        return edits[place - 1 : place]

    def rest() -> list[tuple]:
        """Turns inserted after the last one."""
        nonlocal state
        added = []
        while take() == b"I":
            added.append(("I", None, _NAMES[_DUE[state]], ""))
            state = _NEXT[state]
        spool.close()
        return added

    for batch in batches:
        part, letters, turns = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        roles, texts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        for start, stop in _segments(batch.column(0)):
            name = batch.column(0)[start].as_py()
            if spool is None or name != conv:
                if spool is not None:
                    yield conv, rest()
                conv, state, edits, place, fresh = name, _START, b"", 0, True
                # Scratch of this task alone.
                spool = tempfile.SpooledTemporaryFile(max_size=2 * _HELD)
            out = []
            for i in range(start, stop):
                if part[i] is not None:
                    spool.write(letters[i].encode())
                    continue
                if fresh:
                    spool.seek(0)
                    fresh = False
                while (edit := take()) == b"I":
                    out.append(("I", None, _NAMES[_DUE[state]], ""))
                    state = _NEXT[state]
                if edit == b"R":
                    out.append(("R", turns[i], _NAMES[_DUE[state]], texts[i]))
                    state = _NEXT[state]
                elif edit == b"K":
                    out.append(("K", turns[i], roles[i], texts[i]))
                    state = _AFTER_SYSTEM if roles[i][:1] == "s" else _NEXT[state]
            yield conv, out
    if spool is not None:
        yield conv, rest()


def _id_type(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The type of the first column, and the batches still to read."""
    first = next(batches, None)
    return (None, batches) if first is None else (first.schema.field(0).type, chain([first], batches))


def _edit_stream(marked: DataFrame, plans: DataFrame) -> DataFrame:
    nothing = F.lit(None)
    edits = plans.select(
        F.col("conv_id").alias("conv"), "part", "edits", nothing.cast("long").alias("turn"),
        nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), nothing.cast("long").alias("tie"),
    )
    turns = marked.select(
        "conv", nothing.cast("long").alias("part"), nothing.cast("string").alias("edits"), "turn", "role", "text", "tie"
    )
    return (
        edits.unionAll(turns)
        .repartition("conv")
        .sortWithinPartitions("conv", F.asc_nulls_last("part"), F.asc_nulls_first("turn"), "role", "tie")
        .select("conv", "part", "edits", "turn", "role", "text")
    )


def apply_repairs(marked: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` (from 0), ``edit`` (K kept, R renamed, I
    inserted), the former ``turn``, ``role`` and ``text``; deleted turns are gone."""
    kind = marked.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, batches = _id_type(batches)
        last, place = object(), 0
        for conv, rows in _edited(batches):
            if conv != last:
                last, place = conv, 0
            if not rows:
                continue
            edit, turn, role, text = zip(*rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([conv] * len(rows), conv_type),
                    "place": pa.array(range(place, place + len(rows)), pa.int64()),
                    "edit": pa.array(edit),
                    "turn": pa.array(turn, pa.int64()),
                    "role": pa.array(role, pa.string()),
                    "text": pa.array(text, pa.string()),
                }
            )
            place += len(rows)

    return _edit_stream(marked, plans).mapInArrow(
        run, f"conv_id {kind}, place long, edit string, turn long, role string, text string"
    )


def repaired_digests(marked: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``: of ``role:text`` of the repaired turns, joined by line
    ends, taken as they stream by."""
    kind = marked.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, batches = _id_type(batches)

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            ids, digests = zip(*done)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, conv_type), pa.array(digests)], ["conv_id", "repaired_sha256"]
            )

        digest, conv, empty, done = None, None, True, []
        for name, rows in _edited(batches):
            if digest is None or name != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                digest, conv, empty = hashlib.sha256(), name, True
            for _, _, role, text in rows:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
            if len(done) >= 4096:
                yield batch_of(done)
                done = []
        if digest is not None:
            done.append((conv, digest.hexdigest()))
        if done:
            yield batch_of(done)

    return _edit_stream(marked, plans).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Plans (``plan_repairs``) and repaired turns (``apply_repairs``) of all conversations.

    A turn is blank without any visible character, else a duplicate if its role and text were seen
    earlier in the conversation, else truncated if its last visible character ends no sentence.
    Blank and duplicate turns must be deleted (cost 3).  Any other may be kept, be renamed to user
    or assistant (2) or be deleted, and costs 1 if it is truncated and stays; empty user and
    assistant turns may be inserted anywhere (2).  Of equally cheap edits the least in ASCII order
    of their initials are taken.  Only a role's first letter counts: s, u, a, or none of these.

    Null roles and texts are one space, so a null text is blank and a null role no role.  Turns go
    by number, nulls first, equal ones by role and a hash of the text; a row that is there twice
    is two turns.  Turns without a conversation id are one conversation with a null id.  Other
    columns are ignored.  An empty table has no plans and no turns."""
    marked = mark_turns(turns, id_column, turn_column, role_column, text_column)
    plans = settle(plan_repairs(marked), "repairs")
    return plans, apply_repairs(marked, plans)


def damage_turns(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the checksum of conversation and turn, as the query's contract says."""
    told = conversations.select(
        "conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"),
        F.pmod(F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))), F.lit(20)).alias("harm"),
    ).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.expr("explode(sequence(1, if(harm = 3, 2, 1)))")
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    marked = mark_turns(damage_turns(conversations))
    plans = settle(plan_repairs(marked), "repairs")
    ordered = F.array_sort(F.collect_list(F.struct("part", "edits")))
    told = plans.groupBy("conv_id").agg(
        *[F.max(name).alias(name) for name in _COUNTS],
        F.array_join(F.transform(ordered, lambda part: part["edits"]), "").alias("audit"),
    )
    digests = repaired_digests(marked, plans)
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = ids.join(told, F.expr("id <=> conv_id"), "left").drop("conv_id")
    joined = joined.join(digests, F.expr("id <=> conv_id"), "left")
    return joined.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


# Checksums by the table of the polynomial, backward costs, and the forward walk, letter by letter.
SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n:
    list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c // 2, 3988292384 * (c % 2)))) AS t),
harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 20 AS harm
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN ''
    WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harmed, (SELECT unnest([1, 2]) AS copy) WHERE harm <> 0 AND (copy = 1 OR harm = 3)),
numbered AS (
  SELECT *, row_number() OVER w AS i FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (
  SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
  FROM numbered),
told AS (
  SELECT *, ending = '' OR again AS gone, (ending NOT IN ('', '.', '!', '?'))::INT AS cut,
    i > 1 AND lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
sizes AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count_if(ending = '') AS blank, count_if(ending <> '' AND again) AS duplicate,
    count_if(NOT gone AND cut = 1) AS truncated, count_if(illegal) AS illegal FROM told GROUP BY conv_id),
back AS (
  SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS v FROM sizes
  UNION ALL
  SELECT conv_id, i, [least(c[1], 2 + c[3], 4 + c[4]), least(c[2], 2 + c[3], 4 + c[4]),
    least(c[3], 2 + c[4]), least(c[4], 2 + c[3])] FROM (
    SELECT t.conv_id, t.i, CASE WHEN gone THEN list_transform(v, lambda x: 3 + x) ELSE [
      least(3 + v[1], 2 + cut + v[3], CASE r WHEN 's' THEN cut + v[2] WHEN 'u' THEN cut + v[3] END),
      least(3 + v[2], 2 + cut + v[3], CASE r WHEN 'u' THEN cut + v[3] END),
      least(3 + v[3], 2 + cut + v[4], CASE r WHEN 'a' THEN cut + v[4] END),
      least(3 + v[4], 2 + cut + v[3], CASE r WHEN 'u' THEN cut + v[3] END)] END AS c
    FROM back b JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1)),
walk AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS s, '' AS audit, NULL::VARCHAR AS repaired FROM sizes
  UNION ALL
  SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END, CASE WHEN letter = 'D' THEN s
      WHEN letter = 'K' AND r = 's' THEN 2 WHEN s = 3 THEN 4 ELSE 3 END, audit || letter,
    CASE WHEN letter = 'D' THEN repaired ELSE coalesce(repaired || chr(10), '') ||
      CASE letter WHEN 'K' THEN role ELSE due END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END END FROM (
    SELECT w.*, role, text, r, CASE s WHEN 3 THEN 'assistant' ELSE 'user' END AS due,
      CASE WHEN t.i IS NOT NULL AND 3 + a.v[s] = b.v[s] THEN 'D'
        WHEN 2 + b.v[CASE s WHEN 3 THEN 4 ELSE 3 END] = b.v[s] THEN 'I'
        WHEN s = 1 AND r = 's' AND cut + a.v[2] = b.v[s] THEN 'K'
        WHEN s <> 3 AND r = 'u' AND cut + a.v[3] = b.v[s] THEN 'K'
        WHEN s = 3 AND r = 'a' AND cut + a.v[4] = b.v[s] THEN 'K' ELSE 'R' END AS letter
    FROM walk w JOIN back b ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i
    LEFT JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.i
    LEFT JOIN back a ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND a.i = w.i + 1
    WHERE t.i IS NOT NULL OR s IN (2, 3))),
done AS (
  SELECT walk.* FROM walk JOIN sizes USING (conv_id) WHERE walk.i = n + 1 AND s IN (1, 4)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN sizes ON ids.conv_id IS NOT DISTINCT FROM sizes.conv_id
  LEFT JOIN back ON ids.conv_id IS NOT DISTINCT FROM back.conv_id AND back.i = 1
  LEFT JOIN done ON ids.conv_id IS NOT DISTINCT FROM done.conv_id
"""
