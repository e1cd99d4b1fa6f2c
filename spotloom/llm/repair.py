"""Repair of conversation structure by generalised LR parsing (operator 11).

A conversation is legal if its roles are nothing, or an optional system turn and then pairs of user and assistant. The
cheapest legal conversation is found by a generalised LR parser over that grammar: stacks share their lower part, and at
each turn every stack top may delete the turn, keep it, give it another role, or push turns that are missing. Equal stack
tops merge, the least (cost, audit) stays; an audit has one letter for each edit (D, I, K, R), so ties go to the least
audit. The grammar is left-recursive, so stacks have bounded depth and only a few different ones exist.

That makes the parse divisible. Turns are put in order by range over (conversation, turn), so a conversation with a third
of all rows is spread over many tasks. A task cuts what it reads of a conversation into segments of bounded size and
states, for each stack that may come in, the cheapest way to each stack that may come out. A second pass chains the
segments of a conversation without their texts; what all live stacks agree on is settled, so it holds little besides the
audit. A third pass applies each segment's letters to its turns. Repeats are found by aggregation before, not in a task.

Edge cases: a null role or text counts as one space. Turns without a number come first; turns with one number lie in the
order of a digest of role and text, equal ones side by side. Turns are equal if role and text have one SHA-256. A null
conversation id is a conversation of its own. A conversation without turns is legal at no cost. A role that starts with
neither s, u nor a is never kept. Very long texts fill a segment by themselves. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from spotloom.session import stage

#: Edit costs, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
RULES = (("conversation", ()), ("conversation", ("turns",)), ("turns", ("s", "pairs")), ("turns", ("pairs",)), ("pairs", ("pairs", "u", "a")), ("pairs", ("u", "a")))
SEGMENT_TURNS, SEGMENT_CHARS = 512, 1 << 20
_SPACE = r"\x20\x09-\x0D"
FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"

Best = tuple[int, str]


class Stacks:
    """LR(0) states of a grammar, and the graph of stacks over them; a stack is a number, equal stacks are one."""

    def __init__(self, rules=RULES):
        self.rules = ((None, (rules[0][0],)), *rules)
        self.left = {name for name, _ in rules}
        self.cells: list[tuple[frozenset, int]] = []  # state, stack below
        self.known: dict[tuple[frozenset, int], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, ...]] = {}
        self.root = self._push(self._closure({(0, 0)}), -1)
        self.entries = self._live()  # found in a fixed order, so a stack has one number in all tasks

    def _closure(self, items: set) -> frozenset:
        items, open_ = set(items), list(items)
        while open_:
            rule, dot = open_.pop()
            body = self.rules[rule][1]
            for n, (name, _) in enumerate(self.rules):
                if dot < len(body) and name == body[dot] and (n, 0) not in items:
                    items.add((n, 0))
                    open_.append((n, 0))
        return frozenset(items)

    def _push(self, state: frozenset, below: int) -> int:
        if (state, below) not in self.known:
            self.known[state, below] = len(self.cells)
            self.cells.append((state, below))
        return self.known[state, below]

    def _go(self, stack: int, symbol: str) -> int | None:
        moved = {(r, d + 1) for r, d in self.cells[stack][0] if d < len(self.rules[r][1]) and self.rules[r][1][d] == symbol}
        return self._push(self._closure(moved), stack) if moved else None

    def _reduce(self, stack: int, rule: int) -> int | None:
        name, body = self.rules[rule]
        for _ in body:
            stack = self.cells[stack][1]
        return None if name is None else self._go(stack, name)

    def _reduced(self, stack: int) -> set[int]:
        """The stack and all that reductions make of it."""
        found, open_ = {stack}, [stack]
        while open_:
            at = open_.pop()
            for rule, dot in sorted(self.cells[at][0]):
                if dot == len(self.rules[rule][1]) and (new := self._reduce(at, rule)) is not None and new not in found:
                    found.add(new)
                    open_.append(new)
        return found

    def shift(self, stack: int, initial: str) -> tuple[int, ...]:
        """Stacks after a turn with this role. A top that can only be reduced is, so that stacks meet early."""
        if (stack, initial) not in self.steps:
            out = set()
            for at in sorted(self._reduced(stack)) if initial not in self.left else ():
                new = self._go(at, initial)
                while new is not None and len(self.cells[new][0]) == 1 and (item := next(iter(self.cells[new][0])))[1] == len(self.rules[item[0]][1]):
                    new = self._reduce(new, item[0])
                if new is not None:
                    out.add(new)
            self.steps[stack, initial] = tuple(sorted(out))
        return self.steps[stack, initial]

    def accepts(self, stack: int) -> bool:
        return any(self.cells[at][0] == frozenset({(0, 1)}) for at in self._reduced(stack))

    def _live(self) -> list[int]:
        """All stacks that some sequence of turns leads to."""
        found, open_ = {self.root}, [self.root]
        while open_:
            at = open_.pop()
            for new in (n for t in "sua" for n in self.shift(at, t)):
                if new not in found:
                    found.add(new)
                    open_.append(new)
        return sorted(found)

    def inserted(self, tops: dict[int, Best]) -> dict[int, Best]:
        """Tops with any number of turns pushed; the cheapest first, so each stack is settled once."""
        queue, done = [(*best, at) for at, best in tops.items()], {}
        heapq.heapify(queue)
        while queue:
            cost, audit, at = heapq.heappop(queue)
            if at in done:
                continue
            done[at] = cost, audit
            for initial in NAMES:
                for new in self.shift(at, initial):
                    if new not in done:
                        heapq.heappush(queue, (cost + INSERT, audit + "I", new))
        return done

    def turn(self, tops: dict[int, Best], initial: str, must_go: bool, extra: int) -> dict[int, Best]:
        """Tops after one turn of the conversation."""
        out: dict[int, Best] = {}

        def offer(at: int, best: Best) -> None:
            if at not in out or best < out[at]:
                out[at] = best

        for at, (cost, audit) in self.inserted(tops).items():
            offer(at, (cost + DELETE, audit + "D"))
            if not must_go:
                for new in self.shift(at, initial):
                    offer(new, (cost + extra, audit + "K"))
                for other in NAMES:
                    for new in self.shift(at, other):
                        offer(new, (cost + extra + REROLE, audit + "R"))
        return out

    def end(self, tops: dict[int, Best]) -> Best:
        return min(best for at, best in self.inserted(tops).items() if self.accepts(at))


class _Segment:
    """Turns of one conversation that lie side by side; ``paths`` has the tops for each stack that may come in."""

    def __init__(self, stacks: Stacks, conv, entries: list[int]):
        self.stacks, self.conv = stacks, conv
        self.paths = {at: {at: (0, "")} for at in entries}
        self.turns: list[tuple[str, str] | None] = []
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def full(self) -> bool:
        return len(self.turns) >= SEGMENT_TURNS or self.chars >= SEGMENT_CHARS

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if not self.turns:
            self.first_turn, self.first_role = turn, initial
        elif self.last_role + initial not in LEGAL:
            self.illegal += 1
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last_turn, self.last_role = turn, initial
        duplicate &= not blank
        truncated &= not (blank or duplicate)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        gone = blank or duplicate
        self.turns.append(None if gone else (role, text))
        self.chars += 0 if gone else len(text)
        self.paths = {at: self.stacks.turn(tops, initial, gone, TRUNCATED * truncated) for at, tops in self.paths.items()}

    def row(self, number: int) -> tuple:
        paths = [{"entry": a, "exit": b, "cost": cost, "audit": audit} for a, tops in self.paths.items() for b, (cost, audit) in tops.items()]
        turns = [t and {"role": t[0], "text": t[1]} for t in self.turns]
        return (self.conv, number, len(turns), self.first_turn, self.last_turn, self.low, self.high, self.distinct, self.first_role, self.last_role,
                self.blank, self.duplicate, self.truncated, self.illegal, paths, turns)


_SEGMENT = ("part bigint, n int, first_turn bigint, last_turn bigint, low bigint, high bigint, distinct_turns bigint, first_role string, last_role string, "
            "blank bigint, duplicate bigint, truncated bigint, illegal bigint, paths array<struct<entry:int,exit:int,cost:bigint,audit:string>>, turns array<struct<role:string,text:string>>")


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema).fields])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, size).columns))


def _segments(schema: pa.Schema):
    def run(batches):
        stacks = Stacks()
        number, now, waiting = TaskContext.get().partitionId() << 33, None, []
        # The first conversation of a task may have begun in another one.
        fresh = False
        for conv, turn, role, text, copies, blank, truncated, seen in _rows(batches):
            if now is None or now.conv != conv:
                if now is not None:
                    waiting.append(now.row(number))
                    number, fresh = number + 1, True
                now = _Segment(stacks, conv, [stacks.root] if fresh else stacks.entries)
            for copy in range(copies):
                if now.full():
                    waiting.append(now.row(number))
                    number, now = number + 1, _Segment(stacks, conv, stacks.entries)
                now.add(turn, role, text, blank, seen or copy > 0, truncated)
                if len(waiting) >= 64:
                    yield _batch(waiting, schema)
                    waiting = []
            if len(waiting) >= 64:
                yield _batch(waiting, schema)
                waiting = []
        if now is not None:
            yield _batch([*waiting, now.row(number)], schema)

    return run


class _Chain:
    """The segments of one conversation, one after another."""

    def __init__(self, stacks: Stacks, conv):
        self.stacks, self.conv = stacks, conv
        self.tops: dict[int, Best] = {stacks.root: (0, "")}
        self.settled: list[str] = []
        self.parts: list[tuple[int, int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last_turn = self.last_role = None

    def add(self, part, n, first_turn, last_turn, low, high, distinct, first_role, last_role, blank, duplicate, truncated, illegal, paths) -> None:
        self.parts.append((part, n))
        if not n:
            return
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (self.last_role is not None and self.last_role + first_role not in LEGAL)
        self.distinct += distinct - (first_turn is not None and first_turn == self.last_turn)
        if low is not None:
            self.low, self.high = low if self.low is None else self.low, high
        self.last_turn, self.last_role = last_turn, last_role
        out: dict[int, Best] = {}
        for p in paths:
            if p["entry"] in self.tops:
                cost, audit = self.tops[p["entry"]]
                best = cost + p["cost"], audit + p["audit"]
                if p["exit"] not in out or best < out[p["exit"]]:
                    out[p["exit"]] = best
        shared = os.path.commonprefix([audit for _, audit in out.values()])
        self.settled.append(shared)
        self.tops = {at: (cost, audit[len(shared):]) for at, (cost, audit) in out.items()}

    def rows(self) -> list[tuple]:
        """(conversation, part, edits, turns before, whether a system turn leads, facts) of each segment, facts on the last."""
        cost, audit = self.stacks.end(self.tops)
        audit = "".join([*self.settled, audit])
        whole = len(audit) - audit.count("D")
        out, at, place = [], 0, 0
        letters = re.compile("I*[DKR]")
        for number, (part, n) in enumerate(self.parts):
            stop = at
            for _ in range(n):
                stop = letters.match(audit, stop).end()
            last = number == len(self.parts) - 1
            edits = audit[at:] if last else audit[at:stop]
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
            facts = {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}
            out.append((self.conv, part, edits, place, whole % 2 == 1, facts if last else None))
            at, place = stop, place + len(edits) - edits.count("D")
        return out


def _chains(schema: pa.Schema):
    def run(batches):
        stacks, now, waiting = Stacks(), None, []
        for conv, *segment in _rows(batches, 64):
            if now is None or now.conv != conv:
                if now is not None:
                    waiting += now.rows()
                now = _Chain(stacks, conv)
            now.add(*segment)
            if len(waiting) >= 256:
                yield _batch(waiting, schema)
                waiting = []
        if now is not None:
            yield _batch([*waiting, *now.rows()], schema)

    return run


def _edited(edits: str, place: int, leads: bool, turns: list) -> list[dict]:
    out, left = [], iter(turns)
    for edit in edits:
        turn = None if edit == "I" else next(left)
        if edit == "D":
            continue
        role = turn["role"] if edit == "K" else "assistant" if (place - leads) % 2 else "user"
        out.append({"role": role, "text": "" if edit == "I" else turn["text"], "edit": edit})
        place += 1
    return out


def _apply(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = zip(*(c.to_pylist() for c in batch.slice(start, 64).columns))
                yield _batch([(conv, part, _edited(edits, place, leads, turns), facts) for conv, part, edits, place, leads, facts, turns in rows], schema)

    return run


def repair(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, part, turns and report: the repaired turns (role, text, edit) in parts of bounded size, in order of ``part``.

    ``report`` is on the last part of a conversation, null elsewhere: gaps in the numbers of turns, first faults by kind,
    illegal neighbours, cost and audit. ``conversations``: conv_id, turn, role, text. ``copies`` tells how often a row
    occurs (once by default); a row that occurs zero times only keeps its conversation in the result.
    """
    key = conversations.schema["conv_id"].dataType.simpleString()
    held = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), held("role").alias("role"), held("text").alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256))
    rows = rows.groupBy("conv_id", "turn", "digest").agg(F.sum("copies").alias("copies"), F.min("role").alias("role"), F.min("text").alias("text"))
    rows = stage(rows.withColumn("blank", ~F.rlike("text", F.lit(f"[^{_SPACE}]"))).withColumn("truncated", ~F.rlike("text", F.lit(rf"[.!?][{_SPACE}]*\z"))))
    order = lambda turn: F.struct(F.col(turn).isNotNull().alias("named"), F.col(turn).alias("turn"))
    first = rows.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(order("turn")).alias("_first"))
    marked = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    marked = marked.withColumn("seen", F.coalesce(F.col("_first") < order("turn"), F.lit(False)))
    place = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    dealt = marked.repartitionByRange(*place).sortWithinPartitions(*place).select("conv_id", "turn", "role", "text", "copies", "blank", "truncated", "seen")
    shape = f"conv_id {key}, {_SEGMENT}"
    segments = stage(dealt.mapInArrow(_segments(_arrow(shape)), shape))

    shape = f"conv_id {key}, part bigint, edits string, place bigint, leads boolean, report struct<{FACTS.replace(' ', ':').replace(',:', ',')}>"
    chained = segments.drop("turns").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_chains(_arrow(shape)), shape)
    shape = f"conv_id {key}, part bigint, turns array<struct<role:string,text:string,edit:string>>, report struct<{FACTS.replace(' ', ':').replace(',:', ',')}>"
    return chained.join(segments.select("part", "turns"), "part").select("conv_id", "part", "edits", "place", "leads", "report", "turns").mapInArrow(_apply(_arrow(shape)), shape)


def repaired_turns(parts: DataFrame) -> DataFrame:
    """conv_id, part, place, role, text and edit of each repaired turn; (part, place) is their order in a conversation."""
    return parts.select("conv_id", "part", F.posexplode("turns").alias("place", "turn")).select("conv_id", "part", "place", "turn.*")


def summaries(parts: DataFrame) -> DataFrame:
    """The report of each conversation, and the SHA-256 of its repaired turns as ``role:text``, joined by line feeds.

    Such a digest is sequential, so the parts of one conversation pass through one task, one after another.
    """
    key = parts.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {key}, {FACTS}, repaired_sha256 string"
    schema = _arrow(shape)

    def run(batches):
        digest, begun, waiting = hashlib.sha256(), False, []
        for conv, turns, report in _rows(batches, 64):
            for turn in turns:
                digest.update(f"{chr(10) if begun else ''}{turn['role']}:{turn['text']}".encode())
                begun = True
            if report is not None:
                waiting.append((conv, *(report[n] for n in schema.names[1:-1]), digest.hexdigest()))
                digest, begun = hashlib.sha256(), False
            if len(waiting) >= 1024:
                yield _batch(waiting, schema)
                waiting = []
        yield _batch(waiting, schema)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "turns", "report")
    return ordered.mapInArrow(run, shape)
