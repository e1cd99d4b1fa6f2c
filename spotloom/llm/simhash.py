"""SimHash near-duplicates by tiled exact comparison (operator 1).

Words are runs without ASCII white space, A-Z in lower case; a shingle is ``width`` words joined by a space, every
occurrence counts. Bit i of a fingerprint is 1 if more than half of the shingle hashes have it. A text with fewer
words is one shingle, a text without words has fingerprint zero; both are linked like any other.

Equal fingerprints are one row from the start. Distinct fingerprints are sorted by population count into tiles of
bounded size. Two tiles meet unless the population counts of their parts differ by more than the radius; in a task,
blocks of two tiles are compared by exclusive-or and bit count under the same rule. A task returns a spanning forest of
the links it found, never the links themselves, so a group of thousands of near copies stays linear.

``near_duplicates`` (the query) links by the fingerprints alone. ``deduplicate`` (the pipeline) takes them as proposals
and links texts by the Jaccard similarity of their shingle sets. A similarity bounds the ratio of the sets' sizes, so there
tiles and blocks follow the sizes in place of the population counts, and only those of fitting sizes meet.

Edge cases: a null text counts as empty. A row without doc_id is fingerprinted and links what it resembles, but cannot
name a component; a component of such rows alone has a null id. Repeated rows give one result row each. An empty table
gives an empty result. Columns other than doc_id and text are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spotloom.llm.common import map_slices, text_list
from spotloom.llm.components import components
from spotloom.session import stage

#: Shingles hashed at a time, rows of a block compared at a time, least rows of a tile.
CHUNK, BLOCK, TILE = 8192, 512, 4096
#: Shingle sets, and shingles, of a block whose sets are compared.
SETS, SHINGLES = 512, 1 << 20


def fingerprint(text: str, width: int, bits: int) -> bytes:
    """Big-endian fingerprint; word 64 j .. 64 j + 63 uses XXH64 with seed 42 + j."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(bits // 8)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist()
    out = b""
    for seed in range(42, 42 + bits // 64):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, n, CHUNK):
            hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])])
            counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out += np.packbits(2 * counts > n).tobytes()
    return out


def fingerprints(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """doc_id, row_hash (of the text), fp (binary)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, width, bits) for t in text_list(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], names=["doc_id", "row_hash", "fp"])

    key = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(F.col("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text"))
    return map_slices(source, run, f"doc_id {key}, row_hash bigint, fp binary")


def _parts(bits: int) -> int:
    """Parts whose population counts are compared: their combinations stay under 100,000."""
    return 4 if bits == 64 else 2


def _population(fps: np.ndarray, bits: int) -> np.ndarray:
    """Population counts of the parts, one row per fingerprint (big-endian bytes)."""
    parts = _parts(bits)
    return np.bitwise_count(fps).reshape(len(fps), parts, -1).sum(axis=2, dtype=np.int64)


def _gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Least number of differing bits between boxes of population counts (last axis: parts)."""
    return np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).sum(axis=-1)


class _Forest:
    """Union by least index over numpy arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up


def _words(fps: np.ndarray) -> np.ndarray:
    return fps.view(">u8").astype(np.uint64)


def compare(
    left: np.ndarray, right: np.ndarray | None, bits: int, radius: int, spans: list[np.ndarray] | None = None, reach: float | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``left`` (``right`` is None) or between two tiles: indices into both, stacked.

    ``spans`` (low and high, a row per fingerprint, for either tile) take the place of the population counts, and ``reach``
    that of the radius, where blocks are skipped.
    """
    b_fps = left if right is None else right
    shift = 0 if right is None else len(left)
    a_words, b_words = _words(left), _words(b_fps)
    if spans is None:
        spans, reach = [np.stack([p, p]) for p in (_population(left, bits), _population(b_fps, bits))], radius
    else:
        spans = [s.T[:, :, None] for s in (spans[0], spans[-1])]
    a_starts, b_starts = np.arange(0, len(left), BLOCK), np.arange(0, len(b_fps), BLOCK)
    box = lambda span, starts: (np.minimum.reduceat(span[0], starts), np.maximum.reduceat(span[1], starts))
    (a_low, a_high), (b_low, b_high) = box(spans[0], a_starts), box(spans[1], b_starts)
    forest = _Forest(shift + len(b_fps))
    for i, a in enumerate(a_starts):
        mine = a_words[a:a + BLOCK]
        near = np.flatnonzero(_gap(a_low[i], a_high[i], b_low, b_high) <= reach)
        for j in near if right is not None else near[near >= i]:
            b = b_starts[j]
            other = b_words[b:b + BLOCK]
            apart = np.bitwise_count(mine[:, None, 0] ^ other[None, :, 0])
            for k in range(1, mine.shape[1]):
                apart += np.bitwise_count(mine[:, None, k] ^ other[None, :, k])
            hit = apart <= radius
            if hit.any():
                x, y = np.nonzero(hit)
                forest.join(x + a, y + b + shift)
    child = np.flatnonzero(forest.parent != np.arange(len(forest.parent)))
    return child, forest.parent[child]


def _plan(classes: list[tuple[int, int, np.ndarray, np.ndarray]], n: int):
    """Tiles of the classes (sig, count, box), in their order: rows (sig, first tile, tiles) and the tiles' boxes."""
    size = max(TILE, int(16 * math.sqrt(n)))
    rows, low, high = [], [], []
    room = 0
    for sig, count, least, most in classes:
        if count > room:
            tiles, room = -(-count // size), 0
            rows.append((sig, len(low), tiles))
            low += [least] * tiles
            high += [most] * tiles
            room = size - count if tiles == 1 else 0
        else:
            room -= count
            rows.append((sig, len(low) - 1, 1))
            low[-1], high[-1] = np.minimum(low[-1], least), np.maximum(high[-1], most)
    return rows, np.array(low), np.array(high)


def _by_population(classed: DataFrame, bits: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Classes of equal population counts, (bits / parts + 1) ** parts at most."""
    parts = _parts(bits)
    found = [(r.sig, r["count"]) for r in classed.groupBy("sig").count().collect()]
    pop = {sig: np.frombuffer(sig.to_bytes(parts, "big"), dtype=np.uint8).astype(np.int64) for sig, _ in found}
    return [(sig, count, pop[sig], pop[sig]) for sig, count in sorted(found, key=lambda c: (pop[c[0]].sum(), c[0]))]


#: Classes of sizes in an octave.
OCTAVE = 8


def _scale(sizes: np.ndarray) -> np.ndarray:
    """Logarithms of sizes; an empty set, which resembles no other, lies out of reach of all."""
    return np.where(sizes > 0, np.log(np.maximum(sizes, 1)), -100.0)


def _by_size(classed: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Classes of sizes, ``OCTAVE`` an octave."""
    found = classed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return [(r.sig, r.n, *_scale(np.array([[r.low], [r.high]]))) for r in sorted(found, key=lambda r: r.sig)]


def linked(found: DataFrame, bits: int, radius: int, ratio: float | None = None) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``): a spanning forest per pair of tiles, columns ``a`` and ``b``.

    With ``ratio`` each fingerprint has the least and greatest size of its sets (``low``, ``high``), and links count only
    between fingerprints with sets whose sizes have that ratio at least: tiles and blocks of other sizes do not meet.
    """
    spark = found.sparkSession
    parts, width = _parts(bits), bits // 8
    # Slack for rounding of the logarithms.
    sized, reach = ratio is not None, radius if ratio is None else -math.log(ratio) + 1e-9
    kept = ["fp", "low", "high"] if sized else ["fp"]

    def classify(batch: pa.RecordBatch) -> pa.RecordBatch:
        if sized:
            sig = np.floor(np.log2(batch.column(1).to_numpy() + 1) * OCTAVE).astype(np.int64)
        else:
            fps = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, width)
            sig = (_population(fps, bits) << np.arange(8 * (parts - 1), -1, -8)).sum(axis=1)
        return batch.append_column("sig", pa.array(sig, pa.int64()))

    classed = stage(map_slices(found.select(*kept), classify, ", ".join(f"{c} {'binary' if c == 'fp' else 'bigint'}" for c in (*kept, "sig")), rows=4096))
    classes = _by_size(classed) if sized else _by_population(classed, bits)
    rows, low, high = _plan(classes, sum(c[1] for c in classes))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(table["fp"].to_pylist()), dtype=np.uint8).reshape(-1, width)
        if sized:
            spans = np.column_stack([_scale(table[c].to_numpy()) for c in ("low", "high")])
            order = np.argsort(spans[:, 0], kind="stable")
        else:
            pop = _population(fps, bits)
            spans, order = np.zeros(0), np.lexsort((*pop.T[::-1], pop.sum(axis=1)))
        tile = key[0].as_py()
        near = np.flatnonzero(_gap(low[tile], high[tile], low, high) <= reach).astype(np.int32)
        return pa.table({"tile": pa.array([tile], pa.int32()), "fps": pa.array([fps[order].tobytes()], pa.binary()),
                         "spans": pa.array([spans[order].tobytes() if sized else b""], pa.binary()), "near": pa.array([near], pa.list_(pa.int32()))})

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = sorted(zip(*(table[c].to_pylist() for c in ("tile", "fps", "spans"))))
        tiles = [np.frombuffer(f, dtype=np.uint8).reshape(-1, width) for _, f, _ in held]
        spans = [np.frombuffer(s).reshape(-1, 2) for _, _, s in held] if sized else None
        alone = key[0].as_py() == key[1].as_py()
        if len(tiles) < 2 and not alone:  # the partner tile has no rows
            child = parent = np.zeros(0, dtype=np.int64)
        else:
            child, parent = compare(tiles[0], None if alone else tiles[1], bits, radius, spans, reach)
        stacked = np.concatenate(tiles)
        take = lambda at: pa.array([r.tobytes() for r in stacked[at]], pa.binary())
        return pa.table({"a": take(child), "b": take(parent)})

    # One row per class, so the table has the same bound as above.
    places = F.broadcast(spark.createDataFrame(rows, "sig bigint, first int, tiles int"))
    tiles = classed.join(places, "sig").select((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("tiles"))).cast("int").alias("tile"), *kept)
    packed = stage(tiles.groupBy("tile").applyInArrow(pack, "tile int, fps binary, spans binary, near array<int>"))
    pairs = packed.select("tile", "fps", "spans", F.explode("near").alias("other"))
    pairs = pairs.select(F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "fps", "spans")
    return pairs.groupBy("lo", "hi").applyInArrow(search, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 64, radius: int = 4) -> DataFrame:
    """doc_id, row_hash, fp and component_id (the least doc_id reachable) of every row."""
    prints = stage(fingerprints(docs, width, bits))
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(linked(distinct, bits, radius))
    classes = stage(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = stage(classes.groupBy("label").agg(F.min("first").alias("component_id")))
    named = stage(classes.join(least, "label").select("fp", "component_id", "label"))
    return prints.join(named, "fp")


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """A further 64-bit hash of each hash (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(word + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; empty for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i:i + width]), 42) for i in range(max(1, len(words) - width + 1))], dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """Like ``fingerprint``, but each shingle of the set counts once."""
    out = b""
    for word in range(bits // 64):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), CHUNK):
            mixed = _mixed(hashes[at:at + CHUNK], word)
            counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out += np.packbits(2 * counts > len(hashes)).tobytes()
    return out


def shingle_prints(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """doc_id, row_hash (of the text), key (of the shingle set), n (its size), fp (of the set)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets = [shingle_set(t, width) for t in text_list(batch.column(2))]
        columns = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_fingerprint(s, bits) for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row_hash", "key", "n", "fp"])

    key = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(F.col("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text"))
    return map_slices(source, run, f"doc_id {key}, row_hash bigint, key binary, n bigint, fp binary")


def verified(left: list[tuple[bytes, np.ndarray]], right: list[tuple[bytes, np.ndarray]] | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs within ``left`` (``right`` is None) or between two blocks whose fingerprints differ in
    ``radius`` bits at most and whose shingle sets have the Jaccard similarity: indices into both, stacked.

    Blocks are lists of fingerprint and shingle set. Sets of pairs that are joined already are not compared.
    """
    rows = left + (right or [])
    first = 0 if right is None else len(left)
    sizes = np.array([len(s) for _, s in rows], dtype=np.int64)
    words = _words(np.frombuffer(b"".join(f for f, _ in rows), dtype=np.uint8).reshape(len(rows), -1))
    ids = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mine = np.zeros(int(ids.max(initial=-1)) + 1, dtype=np.int64)
    forest, links = _Forest(len(rows)), []
    for i in range(len(left)):
        others = np.arange(i + 1 if right is None else first, len(rows))
        others = others[forest.parent[others] != forest.parent[i]]
        near = np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64) <= radius
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[near & (low > 0) & (low >= similarity * high)]
        if not len(others):
            continue
        mine[ids[starts[i]:ends[i]]] = 1
        both = np.array([mine[ids[starts[j]:ends[j]]].sum() for j in others])
        mine[ids[starts[i]:ends[i]]] = 0
        hit = others[both / (sizes[i] + sizes[others] - both) >= similarity]
        links += [(i, j) for j in hit.tolist()]
        forest.join(np.full(len(hit), i), hit)
    return links


def similar(docs: DataFrame, nodes: DataFrame, width: int, bits: int, radius: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` between the shingle sets ``nodes`` (key, n, fp, k) of ``docs`` that connect all sets which links
    of at least the similarity connect.

    The tiles propose groups by fingerprints of sets of fitting sizes. A group is cut into blocks of bounded size by hash,
    every two blocks of it meet in a task, and the sets themselves decide there.
    """
    prints = nodes.groupBy("fp").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    near = components(linked(prints, bits, radius, similarity)).withColumnRenamed("node", "fp")
    placed = stage(nodes.join(near, "fp", "left").withColumn("group", F.coalesce("label", "fp")).select("key", "n", "fp", "k", "group"))
    groups = placed.groupBy("group").agg(F.count("*").alias("sets"), F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    groups = groups.where("sets > 1").select("group", "blocks")
    members = placed.join(groups, "group").select("group", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "fp", F.col("k.doc_id").alias("_doc"), F.col("k.row_hash").alias("_hash"))
    texts = docs.select("doc_id", "text").withColumn("_row_hash", F.xxhash64("text"))
    found = members.join(texts, texts["doc_id"].eqNullSafe(members["_doc"]) & (texts["_row_hash"] == members["_hash"]))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingle_set(t, width).tobytes() for t in text_list(batch.column(5))], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], sets], names=["group", "blocks", "block", "key", "fp", "shingles"])

    sets = map_slices(found.select("group", "blocks", "block", "key", "fp", "text"), hashed, "group binary, blocks int, block int, key binary, fp binary, shingles binary")
    # A set, as the row of a text may be repeated.
    packed = stage(sets.groupBy("group", "blocks", "block").agg(F.collect_set(F.struct("key", "fp", "shingles")).alias("sets")))

    def check(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks = [[(r["key"], r["fp"], np.frombuffer(r["shingles"], dtype=np.uint64)) for r in sets] for _, sets in sorted(zip(table["block"].to_pylist(), table["sets"].to_pylist()), key=lambda b: b[0])]
        alone = key[1].as_py() == key[2].as_py()
        stacked, links = [r for block in blocks for r in block], []
        if alone or len(blocks) > 1:  # else the partner block has no rows
            parts = [[(fp, shingles) for _, fp, shingles in block] for block in blocks]
            links = verified(parts[0], None if alone else parts[1], radius, similarity)
        take = lambda side: pa.array([stacked[link[side]][0] for link in links], pa.binary())
        return pa.table({"a": take(0), "b": take(1)})

    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sets")
    return pairs.groupBy("group", "lo", "hi").applyInArrow(check, "a binary, b binary")


def deduplicate(docs: DataFrame, width: int = 5, bits: int = 256, radius: int = 72, similarity: float = 0.8) -> DataFrame:
    """One row of each group, with all its columns: the least doc_id (nulls last), then the least text hash.

    Two texts are linked if the Jaccard similarity of their shingle sets (64-bit hashes) is at least ``similarity``.
    Fingerprints only propose pairs: of 256 bits, 39 differ on average at a similarity of 0.8 and 48 in the worst case
    of very short texts (four of five shingles), with a standard deviation of 6, while unrelated texts differ in 128.
    """
    prints = stage(shingle_prints(docs, width, bits))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash")
    nodes = stage(prints.groupBy("key").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min(place).alias("k")))
    labels = components(similar(docs, nodes, width, bits, radius, similarity)).withColumnRenamed("node", "key")
    first = nodes.join(labels, "key", "left").groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("k").alias("k"))
    keep = stage(first.select(F.col("k.doc_id").alias("_doc"), F.col("k.row_hash").alias("_hash")))
    hashed = docs.withColumn("_row_hash", F.xxhash64("text"))
    kept = hashed.join(keep, hashed["doc_id"].eqNullSafe(keep["_doc"]) & (hashed["_row_hash"] == keep["_hash"]), "left_semi")
    # Copies of one row are one document: the first stays.
    numbered = kept.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_row_hash").orderBy("_row_hash")))
    return numbered.where("_copy = 1").select(*[F.col(c) for c in docs.columns])
