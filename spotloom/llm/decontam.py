"""Benchmark passages found by pigeonhole pieces and bit-parallel edit distance (operator 6).

Texts and test items are compared in lower case with each run of white space as one blank. An item of m characters may
be changed by k = floor(rate * m) insertions, deletions and substitutions. It is cut into k + 1 pieces, so each match
holds at least one piece unchanged; all pieces of all items are looked up in one pass by an Aho-Corasick automaton. A
hit is checked over growing runs of pieces (a run of c pieces allows c - 1 changes, and some piece passes at every
size) and at last over the whole item with Myers' bit-parallel distance. Overlapping hits of one item are scanned once.

The items are sent to the tasks in blocks of bounded text, one scan of the documents per block.

Edge cases: null or blank items match nothing; null or empty texts hold nothing; an item that occurs several times in a
text gives one row, the least distance and then the first place; repeated documents and repeated items give a row for
each; an empty table on either side gives an empty result. Other columns are ignored by ``contaminated`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import functools
import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotloom.llm.common import map_slices, on_texts, text_list

#: Characters of item text that one scan of the documents carries.
BLOCK_CHARS = 4_000_000
RATE = 0.1


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def scan(masks: dict[str, int], m: int, text: str, anchored: bool = False):
    """Distance of the pattern to the best part of ``text`` that ends after each character (or to all of it up to there)."""
    full, top, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    up, down, score = full, 0, m
    for c in text:
        same = masks.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        more = down | (full & ~(horizontal | up))
        less = up & horizontal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more = (more << 1 | first) & full
        less = less << 1 & full
        up = less | (full & ~(vertical | more))
        down = more & vertical
        yield score


class Item:
    def __init__(self, text: str, rate: float):
        self.text, self.m = text, len(text)
        self.budget = int(rate * self.m)
        n = self.budget + 1
        self.cuts = [i * self.m // n for i in range(n + 1)]
        self.runs: dict[tuple[int, int], dict[str, int]] = {}

    def _mask(self, lo: int, hi: int) -> dict[str, int]:
        if (lo, hi) not in self.runs:
            self.runs[(lo, hi)] = _masks(self.text[self.cuts[lo]:self.cuts[hi]])
        return self.runs[(lo, hi)]

    def plausible(self, text: str, at: int, piece: int) -> bool:
        """Does every run of pieces around ``piece`` up to half of the item pass its share of the budget?"""
        path, lo, hi = [], 0, self.budget + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
            path.append((lo, hi))
        for lo, hi in reversed(path[:-1]):
            room = hi - lo - 1
            start, end = self.cuts[lo], self.cuts[hi]
            origin = at - self.cuts[piece]
            window = text[max(0, origin + start - room):origin + end + room]
            if not any(d <= room for d in scan(self._mask(lo, hi), end - start, window)):
                return False
        return True

    def best(self, text: str, start: int, end: int) -> tuple[int, int, int] | None:
        """Least distance within ``text[start:end]`` if the budget allows it, and its place."""
        at = text.find(self.text, start, end)
        if at >= 0:
            return 0, at, at + self.m
        distance, stop = self.budget + 1, 0
        for j, d in enumerate(scan(self._mask(0, self.budget + 1), self.m, text[start:end])):
            if d < distance:
                distance, stop = d, start + j + 1
        if distance > self.budget:
            return None
        back = text[max(0, stop - self.m - distance):stop][::-1]
        for j, d in enumerate(scan(_masks(self.text[::-1]), self.m, back, anchored=True)):
            if d == distance:
                return distance, stop - j - 1, stop
        return distance, stop, stop


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(key, Item(text, rate)) for key, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(self.items):
            for p in range(item.budget + 1):
                places.setdefault(item.text[item.cuts[p]:item.cuts[p + 1]], []).append((n, p))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for end, (size, found) in self.automaton.iter(text):
            at = end + 1 - size
            for n, piece in found:
                hits.setdefault(n, []).append((at - self.items[n][1].cuts[piece], at, piece))
        out = []
        for n, places in hits.items():
            key, item = self.items[n]
            best, k = None, item.budget
            places.sort()
            while places:
                group = [places[0]]
                for place in places[1:]:
                    if place[0] - group[-1][0] > item.m + 2 * k:
                        break
                    group.append(place)
                places = places[len(group):]
                if len(group) < 4 and not any(item.plausible(text, at, piece) for _, at, piece in group):
                    continue
                found = item.best(text, max(0, group[0][0] - k), group[-1][0] + item.m + k)
                if found and (best is None or found < best):
                    best = found
            if best:
                out.append((key, *best))
        return out


@functools.lru_cache(maxsize=2)
def _matcher(packed: bytes) -> Matcher:
    return Matcher(*pickle.loads(packed))


def _blocks(items: DataFrame):
    """Items as (key, normal text) lists of bounded size, streamed through the driver block by block."""
    block, size = [], 0
    for key, text in items.toLocalIterator(prefetchPartitions=False):
        text = normal(text or "")
        if not text:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start and stop (in the normal form of the text) of each item found in each text."""
    key, item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {key}, item_id {item}, distance int, start bigint, stop bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items.select("item_id", "text")):
        packed = pickle.dumps((block, rate))

        def run(batch: pa.RecordBatch, packed=packed) -> pa.RecordBatch:
            matcher = _matcher(packed)
            rows = [(n, *hit) for n, text in enumerate(text_list(batch.column(1))) for hit in matcher.find(normal(text))]
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [items_type, pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], types)]],
                names=["doc_id", "item_id", "distance", "start", "stop"])

        items_type = _arrow_type(items)
        out = out.unionByName(map_slices(docs.select("doc_id", "text"), run, schema))
    return out


def _arrow_type(items: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(items.schema["item_id"].dataType)


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item is found, unchanged."""
    for block in _blocks(items.select("item_id", "text")):
        packed = pickle.dumps((block, rate))

        def clean(texts: list[str], packed=packed) -> pa.Array:
            matcher = _matcher(packed)
            return pa.array([not matcher.find(normal(t)) for t in texts], pa.bool_())

        docs = docs.where(on_texts(clean, "boolean")(F.col("text")))
    return docs
