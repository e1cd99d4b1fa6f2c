import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from hypothesis import given, settings, strategies as st

from shapes import awkward, empty
from spotloom.llm import shards
from spotloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def least_capacity(sizes, parts):
    """Minimax by dynamic programming over all cuts."""
    ends = [0, *accumulate(sizes)]
    best = [ends[i] for i in range(len(ends))]
    for _ in range(parts - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


def check(rows, parts):
    """rows: (doc_id, text, size, crc, shard, slot)."""
    groups, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    for _, text, size, crc, shard, slot in rows:
        data = (text or "").encode()
        assert (size, crc) == (len(data) + 16, zlib.crc32(data))
        groups[text or ""].add(shard)
        sizes[shard] += size
        slots[shard].append(slot)
    assert all(len(g) == 1 for g in groups.values())
    assert all(0 <= s < parts for s in sizes)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    return sizes


def test_query_is_whole_and_even(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op13_shards"](spark, SF).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    check([(r.doc_id, docs[r.doc_id], r.size, r.text_crc32, r.shard, r.slot) for r in out], 40)


@pytest.mark.parametrize("parts,hot", [(1, 0), (4, 0), (7, 300), (40, 900)])
def test_least_capacity_against_all_cuts(spark, monkeypatch, parts, hot):
    monkeypatch.setattr(shards, "CELLS", 64)
    monkeypatch.setattr(shards, "_FIRST_BITS", 3)
    monkeypatch.setattr(shards, "SLOTS", 5)
    rng = random.Random(parts)
    texts = ["ä" * rng.randrange(200) + str(rng.randrange(400)) for _ in range(600)] + ["copy of one text"] * hot
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = docs.select(shards.text_key(docs.text).alias("key"), (shards.F.octet_length("text") + 16).alias("size"))
    groups = Counter()
    for key, size in rows.collect():
        groups[key] += size
    capacity, starts = shards.plan(rows, parts)
    assert capacity == least_capacity([groups[k] for k in sorted(groups)], parts)
    assert len(starts) == parts - 1 and starts == sorted(starts)
    out = {r.doc_id: r for r in shards.assign(docs, parts).collect()}
    sizes = check([(i, t, out[i].size, out[i].text_crc32, out[i].shard, out[i].slot) for i, t in enumerate(texts)], parts)
    assert max(sizes.values()) <= capacity and len(sizes) == parts
    if not hot:  # no group weighs much: all shards are near their share
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(groups.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 9))
def test_known_cells_give_least_capacity_and_even_cuts(sizes, parts):
    line = shards._Line([shards.Cell(0, n, s, True) for n, s in enumerate(sizes)])
    capacity = line.capacity(parts, False)
    assert capacity == line.capacity(parts, True) == least_capacity(sizes, parts)
    cuts = line.cuts(capacity, parts)
    assert not line.unknown
    assert all(b - a <= capacity for a, b in zip([0, *cuts], [*cuts, sum(sizes)]))
    assert len(set(cuts) | {0}) >= min(parts, len(sizes)) or sum(sizes) in cuts


def test_awkward_rows_and_files(spark, tmp_path):
    table = awkward(spark)
    out = shards.assign(table, 3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 16) for r in table.collect())
    assert all(sorted(r.slot for r in out if r.shard == n) == list(range(sum(r.shard == n for r in out))) for n in range(3))
    assert shards.assign(empty(spark), 3).count() == 0
    shards.write_shards(table, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, back.select(*table.columns).collect())) == sorted(map(repr, table.collect()))
    place = {r.doc_id: r.shard for r in out}
    assert all(place[r.doc_id] == r._shard for r in back.collect())
