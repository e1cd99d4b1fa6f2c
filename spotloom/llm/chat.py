"""Transcripts to canonical chat turns by a hidden Markov model (operator 10).

A transcript is a sequence of lines. The hidden state of a line is the role that speaks and whether the line begins a
turn or goes on with one. What is seen of a line is its speaker marker, if any, and its form: where it stands, its
length, how it ends, whether it looks like a list or code. The chances are counts over labelled lines of a bounded
sample; a Viterbi path gives every line its state, and runs of lines become turns, rendered as

    <|role|>
    text
    <|end|>

A conversation of any length is cut into blocks of bounded size. Each block is reduced to a matrix (best score from each
state before it to each state at its end), a running product of these gives the state at every block border, and each
block then finds its own best path: the same path as over the whole conversation at once.

Edge cases: a null or empty text is one empty line; rows without a conversation id are conversations of one row each, a
null turn number sorts last, equal numbers sort by text. Unknown or null roles give no marker. Repeated rows are lines
of their own. Ties between states go to the first in the order of ``STATES``. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotloom.llm.common import hash_share
from spotloom.session import stage

ROLES = ("system", "user", "assistant")
#: (role, begins a turn)
STATES = tuple((role, begins) for role in ROLES for begins in (True, False))
#: Spellings of speaker markers.
MARKERS = {
    "system": ("system", "context", "instructions"),
    "user": ("user", "human", "question", "q", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a"),
}
_ROLE_OF = {spelling: n for n, role in enumerate(ROLES) for spelling in MARKERS[role]}
_MARKER = re.compile(r"^[\s>*#\[<|]*([A-Za-z]+)[\]>|*]*\s*:\s?")
#: Rows of a block, and bound of the training sample in conversations.
BLOCK, SAMPLE = 2048, 1500
NONE, FIRST = len(ROLES), 2
FEATURES = ((NONE + 1), 2, 6, 4)  # marker, first line of the transcript, length, ending


def marker_of(line: str) -> tuple[int, str]:
    """Role number of the speaker marker that opens a line (``NONE``: no marker), and the line without it."""
    found = _MARKER.match(line)
    role = _ROLE_OF.get(found.group(1).lower(), NONE) if found else NONE
    return (role, line[found.end():]) if role != NONE else (NONE, line)


def features(line: str, opens: bool) -> tuple[tuple[int, int, int, int], str]:
    role, rest = marker_of(line)
    tail = rest.rstrip()[-1:]
    ending = 0 if not tail else 1 if tail == "?" else 2 if tail in ".!" else 3
    return (role, int(opens), min(5, len(rest).bit_length() // 2), ending), rest


class Model:
    """Log chances: ``start`` (states), ``move`` (state, state) and one table a feature (state, value)."""

    def __init__(self, paths: list[list[tuple[int, tuple[int, ...]]]]):
        n = len(STATES)
        start, move, emit = np.ones(n), np.ones((n, n)) * 0.1, [np.ones((n, size)) * 0.1 for size in FEATURES]
        for path in paths:
            for i, (state, seen) in enumerate(path):
                for table, value in zip(emit, seen):
                    table[state, value] += 1
                if i:
                    move[path[i - 1][0], state] += 1
                else:
                    start[state] += 1
        for s, (_, begins) in enumerate(STATES):
            for t, (role, opens) in enumerate(STATES):
                if not opens and role != STATES[s][0]:
                    move[s, t] = 0  # a turn goes on with its own role
            if not begins:
                start[s] = 0
        with np.errstate(divide="ignore"):
            self.start = np.log(start / start.sum())
            self.move = np.log(move / move.sum(axis=1, keepdims=True))
            self.emit = [np.log(t / t.sum(axis=1, keepdims=True)) for t in emit]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.emit))

    def through(self, seen: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each state at the last of them."""
        best = None
        for row in self.scores(seen):
            step = self.move + row
            best = step if best is None else (best[:, :, None] + step[None]).max(axis=1)
        return best

    def path(self, seen: np.ndarray, before: int | None, last: int | None) -> list[int]:
        """Best states of the lines, given the state before them and at the end (None: free)."""
        scores = self.scores(seen)
        best = (self.start if before is None else self.move[before]) + scores[0]
        back = []
        for row in scores[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        state = int(best.argmax()) if last is None else last
        out = [state]
        for choice in reversed(back):
            state = int(choice[state])
            out.append(state)
        return out[::-1]


@functools.lru_cache(maxsize=2)
def _model(packed: bytes) -> Model:
    return Model(pickle.loads(packed))


def label(rows: list[tuple[str, str]]) -> list[tuple[int, tuple[int, ...]]]:
    """States and features of the lines of labelled turns (role, transcript text)."""
    path = []
    for role, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            state = 2 * ROLES.index(role) + int(k > 0)
            path.append((state, features(line, not path)[0]))
    return path


def learn(turns: DataFrame, sample: int = SAMPLE) -> bytes:
    """Paths of about ``sample`` conversations whose roles are known, packed. ``turns``: conv_id, turn, role, line text."""
    known = turns.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    n = known.agg(F.approx_count_distinct("conv_id")).first()[0]
    # At most 32 rows of a conversation, so a very long one cannot swell the sample.
    first = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = known.where(hash_share(F.col("conv_id"), sample, n)).withColumn("_n", F.row_number().over(first)).where("_n <= 32")
    paths: dict[object, list[tuple[str, str]]] = {}
    for row in rows.select("conv_id", "_n", "role", "text").orderBy("conv_id", "_n").collect():
        paths.setdefault(row.conv_id, []).append((row.role, row.text))
    return pickle.dumps([label(path) for path in paths.values()])


def transcripts(turns: DataFrame, shown: Column) -> DataFrame:
    """Turns as transcript text: the role's name as a marker where ``shown`` is true and the role is known."""
    named = shown & F.col("role").isin(*ROLES)
    return turns.withColumn("text", F.concat(F.when(named, F.concat(F.initcap("role"), F.lit(": "))).otherwise(""), F.coalesce("text", F.lit(""))))


def parse(rows: DataFrame, packed: bytes) -> DataFrame:
    """conv_id, turn_no (from 1), role, text and rendered turn of the transcripts in ``rows`` (conv_id, turn, text).

    Rows are dealt by range of (conv_id, turn, text), so a long conversation lies in many tasks, in order.
    """
    key = rows.schema["conv_id"].dataType.simpleString()
    # Rows without a conversation stay apart: each gets a number of its own.
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_last(), "alone", F.col("turn").asc_nulls_last(), "text"]
    dealt = stage(rows.select("conv_id", "turn", "text")).select("conv_id", alone.alias("alone"), "turn", "text")
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "alone", "text", F.spark_partition_id().alias("task"))

    def cut(batches):
        """Blocks: rows of one conversation that follow each other in one task, ``BLOCK`` at most."""
        held, owner, number = [], None, 0
        for batch in batches:
            for conv, lone, text, task in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((conv, lone) != owner or len(held) == BLOCK):
                    yield block(owner, number, held)
                    held, number = [], number + 1
                owner = (conv, lone)
                held.append((text, task))
        if held:
            yield block(owner, number, held)

    def block(owner, number: int, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([owner[0]], arrow_key), pa.array([owner[1]], pa.int64()), pa.array([held[0][1] << 32 | number], pa.int64()), pa.array([[t for t, _ in held]], pa.list_(pa.string()))],
            names=["conv_id", "alone", "block", "texts"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(rows.schema["conv_id"].dataType)
    blocks = stage(dealt.mapInArrow(cut, f"conv_id {key}, alone bigint, block bigint, texts array<string>"))
    # The least block of a conversation holds its opening line.
    opening = blocks.groupBy("conv_id", "alone").agg(F.min("block").alias("opening"), F.count("*").alias("blocks"))
    named = [F.col("b.conv_id").eqNullSafe(F.col("o.conv_id")), F.col("b.alone").eqNullSafe(F.col("o.alone"))]
    joined = blocks.alias("b").join(opening.alias("o"), named[0] & named[1])
    blocks = stage(joined.select("b.*", (F.col("b.block") == F.col("o.opening")).alias("opens"), "o.blocks"))

    def lines(texts: list[str], opens: bool) -> tuple[np.ndarray, list[str]]:
        seen, rest = [], []
        for text in texts:
            for line in text.split("\n"):
                f, r = features(line, opens and not seen)
                seen.append(f)
                rest.append(r)
        return np.array(seen), rest

    def reduce(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                texts, opens = one.column(3)[0].as_py(), one.column(4)[0].as_py()
                seen = lines(texts, opens)[0]
                model = _model(packed)
                matrix = model.through(seen)
                if opens:  # from the start there is one row: no state before
                    first = model.start + model.scores(seen[:1])[0]
                    rest = (first[:, None] + model.through(seen[1:])).max(axis=0) if len(seen) > 1 else first
                    matrix = np.tile(rest, (len(STATES), 1))
                yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([matrix.tobytes()], pa.binary())], names=["conv_id", "alone", "block", "matrix"])

    def borders(table: pa.Table) -> pa.Table:
        """States before and at the end of each block of a conversation: forward over the matrices, then back."""
        table = table.sort_by("block")
        shape = (len(STATES), len(STATES))
        matrices = [np.frombuffer(m, dtype=np.float64).reshape(shape) for m in table["matrix"].to_pylist()]
        best, choice = matrices[0][0], []
        for matrix in matrices[1:]:
            step = best[:, None] + matrix
            choice.append(step.argmax(axis=0))
            best = step.max(axis=0)
        last = [int(best.argmax())]
        for c in reversed(choice):
            last.append(int(c[last[-1]]))
        last.reverse()
        return pa.table({"block": table["block"], "before": pa.array([None, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})

    # Only conversations of several blocks need their borders; a group here has one short row a block.
    long = blocks.where("blocks > 1").select("conv_id", "alone", "block", "texts", "opens")
    matrices = long.mapInArrow(reduce, f"conv_id {key}, alone bigint, block bigint, matrix binary")
    found = stage(matrices.groupBy("conv_id", "alone").applyInArrow(borders, "block bigint, before int, last int"))
    ready = blocks.join(found, "block", "left").select("conv_id", "alone", "block", "texts", "opens", "before", "last")

    def speak(batches):
        """Pieces of turns: (conversation, block, number in the block, whether it begins a turn, role, text)."""
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                texts, opens, before, last = (one.column(k)[0].as_py() for k in range(3, 7))
                seen, rest = lines(texts, opens)
                pieces: list[list] = []
                for state, line in zip(_model(packed).path(seen, before, last), rest):
                    role, begins = STATES[state]
                    if begins or not pieces:
                        pieces.append([begins, role, [line]])
                    else:
                        pieces[-1][2].append(line)
                n = len(pieces)
                take = pa.array([0] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(k).take(take) for k in range(3)], pa.array(range(n), pa.int32()), pa.array([p[0] for p in pieces]), pa.array([p[1] for p in pieces]), pa.array(["\n".join(p[2]) for p in pieces])],
                    names=["conv_id", "alone", "block", "piece", "begins", "role", "text"])

    pieces = stage(ready.mapInArrow(speak, f"conv_id {key}, alone bigint, block bigint, piece int, begins boolean, role string, text string"))
    # Turn numbers: turns begun in earlier blocks plus those begun so far in this one.
    counts = pieces.groupBy("conv_id", "alone", "block").agg(F.count_if("begins").alias("n"))
    earlier = Window.partitionBy("conv_id", "alone").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    so_far = Window.partitionBy("block").orderBy("piece")
    numbered = pieces.join(counts, "block").withColumn("turn_no", F.col("n0") + F.sum(F.col("begins").cast("int")).over(so_far))
    turns = numbered.groupBy("conv_id", "alone", "turn_no", "role").agg(F.sort_array(F.collect_list(F.struct("block", "piece", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return turns.withColumn("text", text).select("conv_id", "turn_no", "role", "text", rendered.alias("rendered"))
