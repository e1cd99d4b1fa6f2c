import duckdb
import numpy as np

from pyspark.sql import functions as F
from spotloom.llm import mtree
from spotloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_query_against_its_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(ORACLES["op2_topk"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op2_topk"](spark, SF).collect()) == want


def test_tree_against_all_scores_with_ties_and_copies():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (700, 5))
    x[300:500] = x[300]
    ids = rng.permutation(2000)[:700]
    tree = mtree.Tree(ids.tolist(), ids, x)
    assert len(tree.pages) > 10
    queries = np.concatenate([x[:20], np.zeros((1, 5), dtype=int), rng.integers(-9, 9, (10, 5))])
    own = np.concatenate([ids[:20], np.full(11, -1)])
    found = tree.search(queries, own, 10)
    for n, q in enumerate(queries):
        want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, x) if i != own[n])[:10]
        assert sorted((-s, tree.ids[row]) for m, row, s in found if m == n) == want


def test_bounds_spare_pages():
    rng = np.random.default_rng(4)
    x = (rng.integers(-1000, 1000, (12, 8))[rng.integers(0, 12, 3000)] + rng.integers(-5, 6, (3000, 8))).astype(int)
    tree = mtree.Tree(list(range(3000)), np.arange(3000), x)
    seen = []
    pages = tree.pages

    class Counted(list):
        def __getitem__(self, at):
            seen.append(at)
            return pages[at]

    tree.pages = Counted(pages)
    tree.search(x[:1], np.array([0]), 5)
    assert len(seen) < len(pages) / 2


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (2, [0.5, 0.5]), (8, []), (100, [-1.0, 0.001]),
            (200, [3e6, 1.0]), (9, [-5e6, 2.0]), (100, [-1.0, 0.001]), (2, [0.25, 9e5])]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id bigint, embedding array<double>, rank int, score string, uid int")
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, x) in enumerate(usable):
        if q is not None and q % 100 == 0:
            found = sorted(((-sum(a * b for a, b in zip(x, y)), i is None, i or 0, i) for m, (i, y) in enumerate(usable) if m != n and len(x) == len(y)), key=lambda f: f[:3])
            want += [(q, r, f[3], -f[0]) for r, f in enumerate(found[:6], 1)]
    got = [tuple(r) for r in mtree.top_k(table, F.col("vec_id") % 100 == 0, 6).collect()]
    key = lambda r: tuple((c is None, c or 0) for c in r)
    assert sorted(got, key=key) == sorted(want, key=key) and any(r[2] is None for r in want)
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30]), (3, [1e17])], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r)[1:] for r in mtree.top_k(huge, F.col("vec_id") == 0, 3).collect())
    assert got == [(1, 1, 2 ** 63 - 1), (2, 3, 2 ** 63 - 1), (3, 2, -2 ** 63)]
    assert mtree.top_k(table.where("false"), F.col("vec_id") % 100 == 0, 3).count() == 0


def test_query_equals_its_oracle_on_large_components_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in x]) for i, x in zip(rng.integers(0, 300, 400), rng.normal(size=(400, 3)) * rng.choice([1.0, 1e4], (400, 1)))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["op2_topk"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op2_topk"](spark, str(tmp_path)).collect()) == want
