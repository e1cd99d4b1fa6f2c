"""Removal of repeated passages of lines with content-defined boundaries (operator 4).

A text is split at line feeds. Two kinds of pieces are looked up in the whole corpus, across texts and within one:

* chunks of two or more lines that are not blank. A rolling hash over the hashes of ``WINDOW`` lines ends a chunk where
  it is a multiple of ``DIVISOR``, so an inserted or missing line moves the boundaries next to it only;
* windows of one or more lines: from each line on, and up to each line, the fewest lines with more than ``WORDS`` words.
  Every run of lines with more than ``WORDS`` words is the union of the windows in it, so a repeated run of that length
  goes as a whole, whatever stands around it.

A piece that occurs more than once stays at its first place (least doc_id, text hash, line) and goes elsewhere, line by
line: a line goes if it lies in a later occurrence of any piece, so each line that goes has an equal line at an earlier
place. Where a piece overlaps its own first place, the lines of that place are not taken for its sake. Equal hashes only
make candidates (a piece's hash is built from those of its lines, so no piece is copied): adjoining pieces with one source are put together, and go if their bytes equal those of the source.

Edge cases: a null or empty text has no piece and stays as it is; a text all of whose lines go becomes empty, a repeated
text of one long line among them. Rows without doc_id come after all others in the order of places. Rows with the same
doc_id and text are one document: what stays in one stays in all. An empty table gives an empty result. Other columns
are kept, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spotloom.llm.common import map_slices, short_batches
from spotloom.session import stage

WINDOW, DIVISOR, WORDS = 2, 3, 50
_BASE = 0x9E3779B97F4A7C15
#: Odd, so that each has an inverse modulo 2^64.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bits of the filter that keeps texts without a wanted passage out of a shuffle, and bits of a row of it.
FILTER, PAGE = 1 << 25, 1 << 15


def _line_hashes(lines: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), dtype=np.uint64, count=len(lines))


def _ends(hashes: np.ndarray) -> np.ndarray:
    """Line after the last one of each chunk, from the hashes of the lines."""
    rolled, scale = hashes.copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(1, WINDOW):
            scale = scale * np.uint64(_BASE)
            rolled[back:] += hashes[:-back] * scale
        rolled ^= rolled >> np.uint64(29)
    ends = np.flatnonzero(rolled % np.uint64(DIVISOR) == 0) + 1
    return ends if len(ends) and ends[-1] == len(hashes) else np.append(ends, len(hashes))


def chunks(text: str) -> list[list[str]]:
    """Runs of lines between the boundaries that the rolling hash sets."""
    lines = text.split("\n")
    ends = _ends(_line_hashes(lines)).tolist()
    return [lines[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _run_hashes(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each run of lines, the same wherever the run stands: differences of prefix sums over powers of two bases."""
    out = (stops - starts).astype(np.uint64)
    with np.errstate(over="ignore"):
        for base in _BASES:
            power = np.cumprod(np.full(len(hashes), base, dtype=np.uint64))
            inverse = np.cumprod(np.full(len(hashes) + 1, pow(base, -1, 1 << 64), dtype=np.uint64))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((hashes ^ (hashes >> np.uint64(31))) * power, dtype=np.uint64)])
            out = (out ^ (out >> np.uint64(32))) * np.uint64(_BASE) + (sums[stops] - sums[starts]) * inverse[starts]
    return out.view(np.int64)


def _pieces(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, line after the last one and hash of each piece that may be removed."""
    if not text:
        return (np.zeros(0, dtype=np.int64),) * 3
    lines = text.split("\n")
    hashes = _line_hashes(lines)
    ends = _ends(hashes)
    starts = np.concatenate([[0], ends[:-1]])
    filled = np.concatenate([[0], np.cumsum(np.fromiter((not (not x or x.isspace()) for x in lines), dtype=np.int64, count=len(lines)))])
    whole = (ends - starts > 1) & (filled[ends] > filled[starts])
    words = np.concatenate([[0], np.cumsum(np.fromiter((len(x.split()) for x in lines), dtype=np.int64, count=len(lines)))])
    stops = np.searchsorted(words, words[:-1] + WORDS + 1)
    onward = np.flatnonzero(stops <= len(lines))
    begins = np.searchsorted(words, words[1:] - WORDS - 1, side="right") - 1
    upto = np.flatnonzero(begins >= 0)
    pairs = np.unique(np.stack([np.concatenate([starts[whole], onward, begins[upto]]), np.concatenate([ends[whole], stops[onward], upto + 1])], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], _run_hashes(hashes, pairs[:, 0], pairs[:, 1])


def piece_table(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, start, stop and hash of every piece."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_pieces(t) for t in batch.column(2).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        starts, stops, hashes = (np.concatenate(c) for c in zip(*found))
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32)), pa.array(hashes)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_hash", "start", "stop", "hash"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select(F.col("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text")), run, f"doc_id {key}, row_hash bigint, start int, stop int, hash bigint")


def _merged(hits: list[dict], own: tuple) -> list[dict]:
    """Later occurrences in one text, put together where they adjoin and have one source. ``cuts`` are the lines that go."""
    by: dict[tuple, list] = {}
    for h in hits:
        shift = h["start"] - h["first"]["start"]
        by.setdefault((h["first"]["doc_id"], h["first"]["row_hash"], shift), []).append((h["start"], h["stop"]))
    out = []
    for (doc, row_hash, shift), spans in by.items():
        open_to = -1
        for start, stop in sorted(spans):
            cut = max(start, stop - shift) if (doc, row_hash) == own else start
            if start > open_to:
                out.append({"doc": doc, "hash": row_hash, "from": start - shift, "to": stop - shift, "start": start, "cuts": []})
            open_to = max(open_to, stop)
            last = out[-1]
            last["to"] = open_to - shift
            if last["cuts"] and cut <= last["cuts"][-1]["b"]:
                last["cuts"][-1]["b"] = max(stop, last["cuts"][-1]["b"])
            else:
                last["cuts"].append({"a": cut, "b": stop})
    return out


def _perhaps_in(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose hash (column ``_hash``) is in ``keys`` (column ``hash``), and a few more: a bitmap of bounded size is broadcast."""
    bit = lambda c: F.pmod(F.col(c), F.lit(FILTER))
    pages = keys.select(bit("hash").alias("bit")).groupBy(F.expr(f"bit div {PAGE}").alias("_page")).agg(F.bitmap_construct_agg(F.col("bit") % PAGE).alias("_bits"))
    placed = texts.withColumn("_bit", bit("_hash")).withColumn("_page", F.expr(f"_bit div {PAGE}")).join(F.broadcast(pages), "_page")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_bit % {PAGE}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return placed.where(F.call_function("getbit", byte, (F.col("_bit") % 8).cast("int")) == 1).select(*texts.columns)


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, start and cuts of the repeated passages, and the body that must be found at ``start``."""
    key = docs.schema["doc_id"].dataType.simpleString()
    pieces = stage(piece_table(docs))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash", "start")
    repeated = stage(pieces.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("hash", "first"))
    hits = pieces.join(repeated, "hash").where(~place.eqNullSafe(F.col("first")))
    hits = hits.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("start", "stop", "first")).alias("hits"))
    match = f"array<struct<doc:{key},hash:bigint,from:int,to:int,start:int,cuts:array<struct<a:int,b:int>>>>"
    # The element type of Spark's text and of Arrow are the same; an inferred one has 64-bit numbers.
    kind = pa.list_(pa.struct([("doc", to_arrow_type(docs.schema["doc_id"].dataType)), ("hash", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("start", pa.int32()), ("cuts", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        merged = pa.array([_merged(h, o) for h, o in zip(batch.column(2).to_pylist(), own)], kind)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), merged], names=["doc_id", "row_hash", "found"])

    found = map_slices(hits, merge, f"doc_id {key}, row_hash bigint, found {match}").select("doc_id", "row_hash", F.explode("found").alias("m"))
    found = stage(found.select("doc_id", "row_hash", "m.*"))
    wanted = stage(found.groupBy("doc", "hash").agg(F.collect_set(F.struct("from", "to")).alias("spans")))
    texts = _perhaps_in(docs.select(F.col("doc_id").alias("_doc"), F.col("text"), F.xxhash64("text").alias("_hash")), wanted)
    sources = wanted.join(texts, wanted["doc"].eqNullSafe(F.col("_doc")) & (wanted["hash"] == F.col("_hash"))).select("doc", "hash", "spans", "text")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, (spans, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            lines = text.split("\n")
            rows += [(i, s["from"], s["to"], "\n".join(lines[s["from"]:s["to"]])) for s in spans]
        at = pa.array([r[0] for r in rows], pa.int64())
        columns = [pa.array([r[n] for r in rows], kind) for n, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["doc", "hash", "from", "to", "body"])

    # The row of a source may be repeated.
    bodies = map_slices(sources, extract, f"doc {key}, hash bigint, from int, to int, body string")
    bodies = stage(bodies.groupBy("doc", "hash", "from", "to").agg(F.min("body").alias("body")))
    same = found["doc"].eqNullSafe(bodies["doc"])
    for c in ("hash", "from", "to"):
        same &= found[c] == bodies[c]
    return found.join(bodies, same).select("doc_id", "row_hash", "start", "cuts", "body")


def deduplicate_lines(docs: DataFrame, count_col: str | None = None) -> DataFrame:
    """``docs`` without repeated passages; ``count_col``, if named, gets the number of chunks that lost lines in each text."""
    gone = stage(matches(docs).groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("start", "cuts", "body")).alias("_gone")))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_hash"), "_gone")
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    inner = docs.toDF(*plain)
    doc, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    joined = inner.withColumn("_row_hash", F.xxhash64(text)).join(gone, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_row_hash") == F.col("_hash")), "left")

    @F.arrow_udf("struct<text:string,n:bigint>")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        kept, counts = [], []
        for t, g in zip(texts, gone):  # one text at a time leaves Arrow
            left, n = _without(t.as_py(), g.as_py())
            kept.append(left)
            counts.append(n)
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(counts, pa.int64())], names=["text", "n"])

    short_batches(docs.sparkSession)
    # Texts that lose nothing stay in the JVM.
    out = joined.withColumn("_cut", cut(F.when(F.col("_gone").isNotNull(), F.col(text)), F.col("_gone")))
    columns = [F.coalesce(F.col("_cut.text"), F.col(c)).alias(name) if c == text else F.col(c).alias(name) for c, name in zip(plain, names)]
    return out.select(*columns, *([F.coalesce("_cut.n", F.lit(0)).cast("bigint").alias(count_col)] if count_col else []))


def _without(text: str | None, gone: list[dict] | None) -> tuple[str | None, int]:
    """The text without the lines that go, or None if all stay, and the number of chunks that lost lines."""
    lines = text.split("\n") if gone else []
    stays = np.ones(len(lines), dtype=bool)
    for g in gone or ():
        if "\n".join(lines[g["start"]:g["start"] + g["body"].count("\n") + 1]) == g["body"]:
            for cut in g["cuts"]:
                stays[cut["a"]:cut["b"]] = False
    if stays.all():
        return None, 0
    hit = np.add.reduceat(~stays, np.concatenate([[0], _ends(_line_hashes(lines))[:-1]])) > 0
    return "\n".join(line for line, keep in zip(lines, stays.tolist()) if keep), int(hit.sum())
