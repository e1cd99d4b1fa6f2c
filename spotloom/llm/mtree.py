"""Exact top-k by inner product with M-trees (operator 2).

Vectors are integers, so scores are exact. With one more component sqrt(M^2 - |x|^2) for a stored vector (M: the largest
norm of its tree) and 0 for a query, larger inner products are smaller Euclidean distances, and an M-tree can serve:
pages hold routing vectors with covering radius and distance to the parent's routing vector, leaf pages hold vectors
with that distance. The search takes the page with the least possible distance first; the triangle inequality over
the stored distances spares the computation for entries that cannot be among the best.

Vectors are spread over trees of bounded size by a hash of their id, queries are packed in blocks of bounded size, and
each block visits each tree in a group of its own. Only the k best of a tree leave it.

Edge cases: vectors that are null or hold a null or non-finite component take no part. Vectors of different lengths
never meet. Rows with one id are rows of their own: each may be a candidate, and each that asks is a query for itself,
for which only its own row is left out. A row without an id is a candidate, after all ids among ties. Ties go to the
smaller id. A component that no 64-bit number holds counts as the nearest one; so does a score in the result, after
exact comparison. Fewer than k candidates give fewer rows. An empty vector has score 0 with other empty vectors. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotloom.llm.common import WIDE, as_long, exact, finite, most, numbered, scaled, score_text
from spotloom.session import stage

PAGE, TREE, QUERIES = 64, 4096, 1024


class Tree:
    """Bulk-loaded M-tree over integer vectors ``x`` with ids ``ids`` (null last) and keys ``uids``."""

    def __init__(self, ids: list[int | None], uids: np.ndarray, x: np.ndarray):
        order = sorted(range(len(ids)), key=lambda n: (ids[n] is None, ids[n] or 0, uids[n]))
        self.ids, self.uids, self.x = [ids[n] for n in order], uids[order], x[order]
        whole = self.x.astype(np.float64)
        squares = (whole ** 2).sum(axis=1)
        self.top = float(squares.max(initial=0.0))
        self.points = np.column_stack([whole, np.sqrt(np.maximum(0.0, self.top - squares))])
        #: Page: (is leaf, routing or stored points by row, parent distances, radii, child pages).
        self.pages: list[tuple] = []
        self.root = self._load(np.arange(len(ids)), None)
        del self.points

    def _load(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        points = self.points
        away = lambda r: np.zeros(len(r)) if parent is None else np.sqrt(((points[r] - parent) ** 2).sum(axis=1))
        if len(rows) <= PAGE:
            self.pages.append((True, rows, away(rows), None, None))
            return len(self.pages) - 1
        pivots = rows[np.linspace(0, len(rows) - 1, min(PAGE, -(-len(rows) // (PAGE // 2)))).astype(int)]
        p = points[pivots]
        near = ((points[rows] ** 2).sum(axis=1)[:, None] + (p ** 2).sum(axis=1) - 2 * points[rows] @ p.T).argmin(axis=1)
        groups = [(pivot, rows[near == n]) for n, pivot in enumerate(pivots) if (near == n).any()]
        if len(groups) == 1:  # copies of one vector: any split is as good
            half = len(rows) // 2
            groups = [(rows[0], rows[:half]), (rows[half], rows[half:])]
        routing = np.array([g[0] for g in groups])
        radii = np.array([np.sqrt(((points[own] - points[pivot]) ** 2).sum(axis=1)).max() for pivot, own in groups])
        children = [self._load(own, points[pivot]) for pivot, own in groups]
        self.pages.append((False, routing, away(routing), radii, children))
        return len(self.pages) - 1

    def search(self, queries: np.ndarray, own: np.ndarray, k: int):
        """(query number, row, score) of the k best for each query, the row with the query's own key left out."""
        x, q_all = exact(self.x, most(queries)), exact(queries, most(self.x))
        out, slack = [], 1e-6 * (1.0 + np.sqrt(self.top))
        for number, q in enumerate(q_all):
            square = float((queries[number].astype(np.float64) ** 2).sum()) + self.top
            margin = slack + 1e-6 * np.sqrt(square)
            far = lambda score: np.sqrt(np.maximum(0.0, square - 2.0 * score))
            best: list[tuple[int, int]] = []  # heap of (score, -row): the worst first; rows are in the order of ids
            limit = np.inf
            queue: list[tuple[float, int, float | None]] = [(0.0, self.root, None)]
            while queue and queue[0][0] <= limit + margin:
                _, page, above = heapq.heappop(queue)
                leaf, rows, to_parent, radii, children = self.pages[page]
                if above is not None and limit < np.inf:
                    bound = np.abs(above - to_parent)
                    may = np.flatnonzero((bound if leaf else bound - radii) <= limit + margin)
                else:
                    may = np.arange(len(rows))
                if not len(may):
                    continue
                scores = x[rows[may]] @ q
                if leaf:
                    if len(best) == k:
                        useful = scores >= best[0][0]
                        may, scores = may[useful], scores[useful]
                    for row, score in zip(rows[may].tolist(), scores.tolist()):
                        entry = (int(score), -row)
                        if self.uids[row] == own[number]:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                    if len(best) == k:
                        limit = float(far(best[0][0]))
                else:
                    away = far(scores)
                    least = np.maximum(0.0, away - radii[may])
                    for n in np.flatnonzero(least <= limit + margin).tolist():
                        heapq.heappush(queue, (float(least[n]), children[may[n]], float(away[n])))
            out += [(number, -negative, score) for score, negative in best]
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, dtype=np.int64).reshape(len(rows), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products for each row with ``is_query`` (over ``id_col``)."""
    usable = vectors.where(finite(F.col(vector_col)))
    rows = usable.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stage(numbered(rows, "id", "v").withColumn("dim", F.size("v")))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    trees, blocks = max(1, -(-n // TREE)), max(1, -(-asking // QUERIES))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = Tree(table["id"].to_pylist(), np.array(table["uid"].to_pylist(), dtype=np.int64), _matrix(table["v"]))
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "pages": pa.array([pickle.dumps(tree)], pa.binary())})

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        packed = pickle.dumps((table["id"].to_pylist(), np.array(table["uid"].to_pylist(), dtype=np.int64), _matrix(table["v"])))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "queries": pa.array([packed], pa.binary())})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            tree: Tree = pickle.loads(left["pages"][0].as_py())
            ids, uids, queries = pickle.loads(right["queries"][0].as_py())
            found = [(int(uids[n]), ids[n], tree.ids[row], int(tree.uids[row]), score_text(score)) for n, row, score in tree.search(queries, uids, k)]
        columns = list(zip(*found)) if found else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query", "query_id", "vec_id", "other", "score"), columns, kinds)})

    part = lambda count, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(count)).cast("int")
    forest = stage(rows.groupBy(part(trees, "tree").alias("tree"), "dim").applyInArrow(build, "tree int, dim int, pages binary"))
    asked = stage(rows.where("asks").groupBy(part(blocks, "block").alias("block"), "dim").applyInArrow(pack, "block int, dim int, queries binary"))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = forest.withColumn("block", spread(blocks)).groupBy("tree", "block", "dim")
    right = asked.withColumn("tree", spread(trees)).groupBy("tree", "block", "dim")
    best = left.cogroup(right).applyInArrow(search, "query long, query_id long, vec_id long, other long, score string")
    order = Window.partitionBy("query").orderBy(F.desc(F.col("score").cast(WIDE)), F.asc_nulls_last("vec_id"), "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", as_long("score").alias("score"))
