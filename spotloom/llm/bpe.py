"""Byte-level BPE encoding and decoding (operator 7).

Encoding runs a finite-state transducer over the bytes of each piece that the pattern cuts. Two facts make BPE
a transducer: every prefix of a piece has one encoding, and a token sequence is an encoding exactly if each two
neighbours are what merging gives for their joined bytes. So after each byte the last token of the prefix is
known, and the tokens before the point through which every continuation must pass are final; they leave once ``LOOKAHEAD`` bytes are pending.
A state is (last token that left, bytes still pending); the pending bytes always begin some vocabulary entry or
wait for one that does, which bounds the lookahead. States and transitions are made when first met and kept in
a table of bounded size, so a very long piece costs time in proportion to its bytes.

Decoding takes ids in chunks; a UTF-8 state machine holds back the bytes of a character that a chunk cuts.

Edge cases: a null or empty text gives no ids and decodes to the empty text. Repeated rows are encoded each by
itself. Columns other than the two named ones are ignored, whatever they are called. An empty table gives an
empty result. A null id column is carried through.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotloom.llm.common import map_slices, text_list

#: Bounds of the tables kept by one Python worker.
MAX_TRANSITIONS = 100_000
MAX_PAIRS = 300_000
MAX_WORDS = 200_000
LONGEST_CACHED = 64
#: Pending bytes at which final tokens are looked for; what is then still pending is shorter than the longest entry.
LOOKAHEAD = 24
SHORT = (3, 2, 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _State:
    """Pending bytes after ``last``; ``ends[i]`` is the last token of the encoding up to pending byte i, and
    ``back[i]`` the position where that token begins."""

    __slots__ = ("last", "pending", "ends", "back", "moves", "rest")

    def __init__(self, last: int, pending: bytes, ends: tuple[int, ...], back: tuple[int, ...]):
        self.last, self.pending, self.ends, self.back = last, pending, ends, back
        self.moves: dict[int, tuple[_State, bytes]] = {}
        self.rest: bytes | None = None


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token))}
        #: Entries that merging can make, and for each the parts of its last merge.
        self.usable: dict[bytes, int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            halves = self._halves(token)
            if halves is None or halves:
                self.usable[token] = rank
                self.parts[rank] = halves
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = self.usable.get(token[:i]), self.usable.get(token[i:])
                if left is not None and right is not None:
                    self.merged[(left, right)] = rank
        #: Lengths of the usable entries by their last four bytes, longest first; entries of one to three bytes are always tried.
        by_tail: dict[bytes, set[int]] = {}
        for token in self.usable:
            if len(token) > 3:
                by_tail.setdefault(token[-4:], set(SHORT)).add(len(token))
        self.sizes = {tail: tuple(sorted(found, reverse=True)) for tail, found in by_tail.items()}
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self.root = _State(-1, b"", (-1,), (0,))
        self.states = {(-1, b""): self.root}

    def _halves(self, token: bytes) -> tuple[int, int] | None | bool:
        """Parts that the last merge of ``token`` joins; None for a single byte, False if merging does not make it."""
        get = self.ranks.get
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return None if len(parts) == 1 else (get(parts[0]), get(parts[1]))

    def _fits(self, left: int, right: int) -> bool:
        """Do two tokens stay side by side when their joined bytes are merged?

        The boundary lies between a part on the right edge of ``left`` and one on the left edge of ``right``. A part
        exists from its own rank until the rank of the merge that takes it up; equal ranks merge from the left. The
        tokens stay if no two parts that exist together merge before either is taken up.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        never, merged, parts = 1 << 60, self.merged, self.parts
        known, x, until_x = True, left, never
        while known:
            halves_x = parts[x]
            from_x = x if halves_x else -1
            y, until_y = right, never
            while True:
                halves_y = parts[y]
                rank = merged.get((x, y))
                if rank is not None and rank < until_x and rank <= until_y and from_x <= until_y and (y if halves_y else -1) < until_x:
                    known = False
                    break
                if not halves_y:
                    break
                until_y, y = y, halves_y[0]
            if not halves_x:
                break
            until_x, x = x, halves_x[1]
        self.pairs[key] = known
        return known

    @staticmethod
    def _tokens(ends: tuple[int, ...], back: tuple[int, ...], at: int) -> bytes:
        out = []
        while at:
            out.append(ends[at])
            at = back[at]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def _final(self, pending: bytes, back: list[int]) -> int:
        """The last position through which every continuation passes.

        A continuation begins where the pending bytes from there on begin a vocabulary entry, or at the end.
        """
        at = n = len(pending)
        live = {j for j in range(max(0, n - self.longest), n) if pending[j:] in self.prefixes}
        while live:
            far = max(live)
            if far > at:
                live.discard(far)
                live.add(back[far])
            elif far < at:
                at = back[at]
            else:
                live.discard(far)
        return at

    def _grow(self, pending: bytes, ends: list[int], back: list[int]) -> None:
        """Extends ``ends`` and ``back`` to the whole of ``pending``.

        The last token of a prefix is the one entry that ends there and fits what precedes it.
        """
        usable, pairs, sizes = self.usable.get, self.pairs.get, self.sizes.get
        for n in range(len(ends), len(pending) + 1):
            for size in sizes(pending[n - 4:n], SHORT) if n > 3 else SHORT:
                start = n - size
                if start < 0:
                    continue
                token = usable(pending[start:n])
                if token is None:
                    continue
                left = ends[start]
                if left < 0:
                    break
                fits = pairs(left << 32 | token)
                if fits is None:
                    fits = self._fits(left, token)
                if fits:
                    break
            ends.append(token)
            back.append(start)

    def _end(self, state: _State, tail: bytes) -> bytes:
        """Ids of the pending bytes and ``tail``, without new states."""
        pending, ends, back = state.pending + tail, list(state.ends), list(state.back)
        self._grow(pending, ends, back)
        return self._tokens(ends, back, len(pending))

    def _step(self, state: _State, byte: int) -> tuple[_State, bytes]:
        pending = state.pending + bytes((byte,))
        n = len(pending)
        ends, back = list(state.ends), list(state.back)
        self._grow(pending, ends, back)
        at = self._final(pending, back) if n >= LOOKAHEAD else 0
        out = self._tokens(ends, back, at) if at else b""
        key = (ends[at], pending[at:])
        target = self.states.get(key)
        if target is None:
            if at:
                ends, back = ends[at:], [max(0, p - at) for p in back[at:]]
            target = self.states[key] = _State(key[0], key[1], tuple(ends), tuple(back))
        state.moves[byte] = move = (target, out)
        self.count += 1
        return move

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian 32-bit numbers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        if self.count >= MAX_TRANSITIONS:
            self._clear()
        state, out, grown = self.root, [], False
        for i, byte in enumerate(piece):
            move = state.moves.get(byte)
            if move is None:
                if grown and len(piece) <= LONGEST_CACHED:  # one new state for a short piece: most are met once
                    out.append(self._end(state, piece[i:]))
                    return b"".join(out)
                if self.count >= 2 * MAX_TRANSITIONS:  # within one very long piece: forget all but this state
                    self._clear()
                    state.moves = {}
                    self.states[(state.last, state.pending)] = state
                move, grown = self._step(state, byte), True
            state, ids = move
            if ids:
                out.append(ids)
        if state.rest is None:
            state.rest = self._tokens(state.ends, state.back, len(state.pending))
        out.append(state.rest)
        return b"".join(out)


class _Pieces(dict):
    """Ids by piece in two generations: when one is full the older is forgotten, so frequent pieces stay."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode_piece(piece.encode("utf-8"))
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= MAX_WORDS:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.cut = regex.compile(pattern).findall
        self.pieces = _Pieces(Transducer(self.ranks))
        size = max(self.ranks.values(), default=-1) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        by_rank = sorted((rank, token) for token, rank in self.ranks.items())
        self.blob = np.frombuffer(b"".join(token for _, token in by_rank), dtype=np.uint8)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def bytes_for(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = self.starts[ids] - (ends - lengths)
        return self.blob[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


class Utf8Machine:
    """Incremental UTF-8: ``push`` gives the text that is complete, ``finish`` what is left.

    States are the number of continuation bytes still due and the range the next one must lie in, which is narrower
    after E0, ED, F0 and F4. Bytes that fit no sequence become U+FFFD as in Python's decoder.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Number of bytes at the end of ``data`` that begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            due = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
            if due < back:
                return 0
            if back > 1:
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def push(self, data: bytes) -> str:
        data = self.held + data
        keep = self._open(data)
        self.held = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def decode_stream(ids: bytes, coder: Codec, chunk: int = 1 << 16):
    """Text of little-endian 32-bit ids, given piece by piece as chunks of ids arrive."""
    machine = Utf8Machine()
    for start in range(0, len(ids), 4 * chunk):
        yield machine.push(coder.bytes_for(np.frombuffer(ids[start:start + 4 * chunk], dtype="<u4")))
    yield machine.finish()


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text: columns ``id_col`` and ``ids`` (little-endian unsigned 32-bit numbers)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode(t) for t in text_list(batch.column(1))], pa.binary())], names=["k", "ids"])

    key = docs.schema[id_col].dataType.simpleString()
    out = map_slices(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), run, f"k {key}, ids binary")
    return out.withColumnRenamed("k", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of ids: ``id_col``, the ids unchanged and ``decoded``. Null ids decode to the empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path, pattern)
        texts = ["".join(decode_stream(ids or b"", coder)) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["k", "ids", "decoded"])

    key = encoded.schema[id_col].dataType.simpleString()
    out = map_slices(encoded.select(F.col(id_col).alias("k"), F.col(ids_col).alias("ids")), run, f"k {key}, ids binary, decoded string")
    return out.withColumnRenamed("k", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids, decoded. A task holds one transducer for both ways."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path, pattern)
        ids = [coder.encode(t) for t in text_list(batch.column(1))]
        texts = ["".join(decode_stream(i, coder)) for i in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    key = docs.schema["doc_id"].dataType.simpleString()
    out = map_slices(docs.select("doc_id", "text"), run, f"doc_id {key}, ids binary, decoded string")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")
