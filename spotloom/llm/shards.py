"""Shards of near equal size by a minimax contiguous partition (operator 13).

Rows with equal texts are one atomic group. Groups lie in the order of a 64-bit hash of their text, and a shard is a run
of neighbours in that order. The least capacity for which a greedy pass needs no more shards than asked for is found by
binary search; within that capacity each shard is cut where it comes nearest to an equal share of what is left.

The search never sees the groups themselves. Spark sums the sizes over at most ``CELLS`` ranges of the hash; the driver
runs the greedy pass twice over these sums, once as if a range could be cut anywhere and once as if it could not be cut
at all. Where the two disagree, the ranges they cut through are split further, by one more aggregation, until both give
the same capacity and every cut is known to the group. A shard is then a comparison of the row's hash with the cuts.

Slots number the rows of a shard without gaps: rows are dealt over buckets of bounded size by a hash of id and text,
buckets get offsets from their counts, and rows are numbered in their bucket. So neither a shard nor a group of copies
meets in one task. Rows that are equal in id and text cannot be told apart and share a bucket.

Edge cases: a null text counts as the empty text (no bytes, checksum 0) and shares a group with it. A null doc_id is a
row like any other. A group larger than a shard's share makes a shard of its own, and the others share the rest. With
fewer groups than shards some shards stay empty. Two texts with one hash would travel together. An empty table gives an
empty result. Other columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from spotloom.session import stage

#: Bytes a row takes besides its text; ranges of the hash whose sums the driver holds at once; rows of a bucket of slots.
OVERHEAD, CELLS, SLOTS = 16, 1 << 16, 25_000
_FIRST_BITS = 15


def text_key(text: Column) -> Column:
    """Place of a text in the order of groups."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Cell:
    """Groups whose hash, shifted by ``shift``, is ``at``; ``single`` if it is one group."""

    shift: int
    at: int
    size: int
    single: bool

    @property
    def start(self) -> int:
        return self.at << self.shift


class _Line:
    """Cells in hash order with the bytes before each; ``unknown`` gathers the cells a question ran into."""

    def __init__(self, cells: list[Cell]):
        self.cells = cells
        self.ends = [0, *accumulate(c.size for c in cells)]
        self.total = self.ends[-1]
        self.unknown: set[int] = set()

    def _inside(self, point: int) -> int | None:
        """Cell that has ``point`` strictly inside and more than one group."""
        at = bisect_right(self.ends, point) - 1
        if at >= len(self.cells) or self.ends[at] == point or self.cells[at].single:
            return None
        self.unknown.add(at)
        return at

    def floor(self, point: int, anywhere: bool = False) -> int:
        """Largest border at or before ``point``."""
        if point >= self.total:
            return self.total
        return point if self._inside(point) is not None and anywhere else self.ends[bisect_right(self.ends, point) - 1]

    def ceil(self, point: int) -> int:
        """Least border at or after ``point``."""
        if point <= 0:
            return 0
        self._inside(point)
        return self.ends[bisect_left(self.ends, point)]

    def fits(self, capacity: int, shards: int, anywhere: bool) -> bool:
        """Whether a greedy pass needs at most ``shards`` shards."""
        place = 0
        for _ in range(shards):
            if place + capacity >= self.total:
                return True
            following = self.floor(place + capacity, anywhere)
            if following == place:
                return False
            place = following
        return False

    def capacity(self, shards: int, anywhere: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, anywhere) else (middle + 1, high)
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Borders after each shard but the last: nearest to an equal share of the rest, no shard above ``capacity``."""
        least = [self.total] * (shards + 1)
        for i in range(shards - 1, 0, -1):
            least[i] = self.ceil(least[i + 1] - capacity)
        out, place = [], 0
        for i in range(1, shards):
            share = place + -(-(self.total - place) // (shards - i + 1))
            low = max(least[i], self.ceil(place + 1)) if place < self.total else self.total
            high = max(low, self.floor(place + capacity))
            before, after = self.floor(share), self.ceil(share)
            place = min(high, max(low, before if share - before <= after - share else after))
            out.append(place)
        return out


def _sums(rows: DataFrame, cell: Column) -> list[Cell]:
    found = rows.select(cell.alias("c"), "key", "size").where("c IS NOT NULL").groupBy("c.shift", "c.at").agg(
        F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"))
    return sorted((Cell(*r) for r in found.select("shift", "at", "size", "single").collect()), key=lambda c: c.start)


def _cell(shift: int) -> Column:
    return F.struct(F.lit(shift).alias("shift"), F.shiftright("key", shift).alias("at"))


def _split(rows: DataFrame, cells: list[Cell], chosen: set[int]) -> list[Cell]:
    """``cells`` with the chosen ones replaced by finer ones."""
    bits = max(1, (CELLS // len(chosen)).bit_length() - 1)
    wanted: dict[int, list[int]] = {}
    for n in chosen:
        wanted.setdefault(cells[n].shift, []).append(cells[n].at)
    finer = None
    for shift, ats in wanted.items():
        hit, cell = F.shiftright("key", shift).isin(sorted(ats)), _cell(max(0, shift - bits))
        finer = F.when(hit, cell) if finer is None else finer.when(hit, cell)
    kept = [c for n, c in enumerate(cells) if n not in chosen]
    return sorted([*kept, *_sums(rows, finer)], key=lambda c: c.start)


def plan(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Least capacity, and the least hash of each shard but the first. ``rows``: key, size; it is read several times."""
    cells = _sums(rows, _cell(64 - _FIRST_BITS))
    while True:
        line = _Line(cells)
        low, high = line.capacity(shards, True), line.capacity(shards, False)
        line.unknown.clear()
        if low == high:
            cuts = line.cuts(high, shards)
            if not line.unknown:
                ends = line.ends
                return high, [cells[at].start if (at := bisect_left(ends, c)) < len(cells) else (1 << 63) - 1 for c in cuts]
        else:
            for n in range(33):
                for anywhere in (True, False):
                    line.fits(low + (high - low) * n // 32, shards, anywhere)
            # A heavy range hides a heavy group, which bounds the capacity from below.
            line.unknown |= {n for n, c in enumerate(cells) if not c.single and 8 * c.size > low}
        cells = _split(rows, cells, line.unknown)


def shard_of(key: Column, starts: list[int]) -> Column:
    """Shard of a hash: the number of shards that start at or before it."""
    return sum((F.when(key >= F.lit(s), 1).otherwise(0) for s in starts), F.lit(0)).cast("int")


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("key"))


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    rows = stage(_measured(docs))
    _, starts = plan(rows, shards)
    buckets = max(1, rows.count() // (shards * SLOTS))
    rows = rows.withColumn("shard", shard_of(F.col("key"), starts)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    numbered = rows.withColumn("n", F.row_number().over(own)).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("n") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, shard_col: str = "_shard") -> None:
    """All columns of ``docs`` as Parquet, a folder ``shard_col``=n for each shard, in files of about ``SLOTS`` rows."""
    rows = stage(_measured(docs).select("key", "size"))
    _, starts = plan(rows, shards)
    buckets = max(1, rows.count() // (shards * SLOTS))
    placed = docs.withColumn(shard_col, shard_of(text_key(F.col("text")), starts))
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))
    placed.repartition(F.col(shard_col), salt).write.partitionBy(shard_col).parquet(path)
