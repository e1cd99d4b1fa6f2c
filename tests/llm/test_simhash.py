import random
import re

import numpy as np
import xxhash

from shapes import awkward, empty
from spotloom.llm import simhash
from spotloom.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_query_against_all_pairs(spark):
    from spotloom.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    rows = QUERIES["op1_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints, 4)


def test_tiles_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 8), dtype=np.uint8)
    near = base.copy()
    near[:, 0] ^= rng.integers(0, 256, 40, dtype=np.uint8) & rng.integers(0, 256, 40, dtype=np.uint8)
    for left, right in ((np.concatenate([base, near]), None), (base, near)):
        sort = lambda f: f[np.lexsort((*simhash._population(f, 64).T[::-1], simhash._population(f, 64).sum(axis=1)))]
        left, right = sort(left), None if right is None else sort(right)
        child, parent = simhash.compare(left, right, 64, 4)
        stacked = left if right is None else np.concatenate([left, right])
        forest = {i: i for i in range(len(stacked))} | dict(zip(child.tolist(), parent.tolist()))
        root = lambda i: i if forest[i] == i else root(forest[i])
        words = [int.from_bytes(f.tobytes(), "big") for f in stacked]
        for i in range(len(words)):
            for j in range(i):
                across = right is None or (i >= len(left)) != (j >= len(left))
                if across and (words[i] ^ words[j]).bit_count() <= 4:
                    assert root(i) == root(j)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)] + [(7, 7), (None, 3)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {x: find(x) for x in list(parent) if find(x) != x}


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert by[5].component_id == by[4].component_id == 4
    assert by[3].component_id == by[7].component_id == by[2].component_id == 2 and bytes(by[2].fp) == bytes(8)
    assert by[None].component_id == by[6].component_id == 6
    kept = simhash.deduplicate(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 8]
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.deduplicate(empty(spark)).count() == 0


def test_pipeline_setting_finds_near_copies_and_leaves_others():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    bits = lambda t: int.from_bytes(simhash.fingerprint(t, 5, 128), "big")
    caught = 0
    for _ in range(200):
        words = [word() for _ in range(300)]
        other = list(words)
        for at in range(15, 300, 60):  # five words of 300: Jaccard similarity of five-word shingles about 0.84
            other[at] = word()
        caught += (bits(" ".join(words)) ^ bits(" ".join(other))).bit_count() <= 25
        assert (bits(" ".join(words)) ^ bits(" ".join(word() for _ in range(300)))).bit_count() > 25
    assert caught >= 190


def test_deduplication_follows_shingle_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 16, raising=False)  # groups of several blocks
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for size in (9, 12, 40, 150, 400):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for share in (0.004, 0.012, 0.02, 0.03, 0.05, 0.08):  # shares of changed words: similarities from 0.3 to 1
                texts.append(" ".join(word() if rng.random() < share else w for w in base))
            texts.append(" ".join(base[:-1]))
    hub = [word() for _ in range(60)]
    texts += [" ".join(hub[:at] + [word()] + hub[at + 1:]) for at in range(60)]  # one large group
    texts.append(texts[-1] + " " + texts[-1])  # nearly the same shingles, each twice
    sets = []
    for t in texts:
        w = t.split()
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert kept == {find(i) for i in range(len(texts))}


def test_sets_of_unlike_sizes_do_not_meet(spark):
    fp = lambda *bits: sum(1 << b for b in bits).to_bytes(32, "big")
    rows = [(fp(1), 100, 100), (fp(2), 80, 80), (fp(3), 79, 79), (fp(4), 300, 400), (fp(5), 500, 500), (fp(6), 501, 501), (fp(7), 0, 0), (fp(8), 1, 1)]
    links = simhash.linked(spark.createDataFrame(rows, "fp binary, low bigint, high bigint"), 256, 72, 0.8).collect()
    place = {r[0]: r[1:] for r in rows}
    groups = {frozenset(rows.index((bytes(f), *place[bytes(f)])) for f in (x.a, x.b)) for x in links}
    root = {i: i for i in range(len(rows))}
    for a, b in map(sorted, groups):
        root = {i: root[a] if r == root[b] else r for i, r in root.items()}
    assert root[0] == root[1] == root[2] and root[3] == root[4] == root[5]  # one tile compares whole blocks


def test_tiles_meet_by_size():
    sizes = np.unique(np.geomspace(1, 20000, 4000).astype(int))
    classes = {}
    for n in sizes.tolist():
        classes.setdefault(int(np.log2(n + 1) * simhash.OCTAVE), []).append(n)
    listed = [(sig, simhash.TILE, *simhash._scale(np.array([[min(c)], [max(c)]]))) for sig, c in sorted(classes.items())]
    rows, low, high = simhash._plan(listed, simhash.TILE * len(listed))
    met = np.array([simhash._gap(a, b, low, high) <= -np.log(0.8) + 1e-9 for a, b in zip(low, high)])
    assert met.mean() < 0.15
    tile = {n: first for sig, first, _ in rows for n in classes[sig]}
    for n in sizes.tolist():
        for m in sizes[(sizes >= n) & (0.8 * sizes <= n)].tolist():
            assert met[tile[n], tile[m]]
    blocks = np.log(np.repeat([100.0, 1000.0], simhash.BLOCK))
    spans = np.column_stack([blocks, blocks])
    prints = np.zeros((len(blocks), 32), dtype=np.uint8)
    child, parent = simhash.compare(prints, None, 256, 72, [spans], 0.2232)
    assert set(parent.tolist()) == {0, simhash.BLOCK} and len(child) == len(blocks) - 2
