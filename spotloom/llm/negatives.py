"""Hard negatives by bounds over a spanning tree of anchors (operator 12).

Anchors and candidates are integer vectors, so scores (inner products) are exact. The anchors of a block are joined by a
minimum spanning tree of their distances. For an anchor c with parent p and a candidate x, <c, x> lies within
|c - p| * |x| of <p, x>; where the parent's score is itself only known as an interval, that is widened by the same amount.
Only candidates whose interval reaches into the window that is asked for are scored again:

* for the positives of an anchor, candidates with its label that can still be among the k best of the block;
* for a positive with score s, candidates with another label whose score can lie between 0.8 s and s and that can still
  be among the k best there.

Candidates are packed into blocks by a hash of their id, one row each; anchors likewise, in smaller blocks with their
tree, and one copy of an anchor block goes to each candidate block. A task holds one candidate block and a bounded number
of anchor blocks, and only k rows an anchor and window leave it. Work is anchors times candidates at worst, as the bounds
may spare nothing.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part. A null id is no
anchor, but a candidate, after all ids among ties. Rows with one id are rows of their own, each an anchor of its own, and
may be positives or negatives of one another. Vectors of different lengths never meet; an empty vector has score 0. A
component that no 64-bit number holds counts as the nearest one; so does a score in the result, after exact
comparison. Labels are whole numbers. A positive with a negative score has no negatives, since its window is empty.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from spotloom.llm.common import WIDE, as_long, exact, finite, most, numbered, scaled, score_text
from spotloom.session import stage

#: Rows of a block of anchors and of candidates; anchor blocks that meet a candidate block in one task.
ANCHORS, CANDIDATES, WAVE = 256, 8192, 16


def spanning_tree(x: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, parent row or -1, distance) of a minimum spanning tree, parents first."""
    points = x.astype(np.float64)
    away, parent = np.full(len(x), np.inf), np.full(len(x), -1)
    out, inside = [], np.zeros(len(x), dtype=bool)
    now = 0
    for _ in range(len(x)):
        inside[now] = True
        out.append((now, int(parent[now]), float(away[now])))
        d = np.sqrt(((points - points[now]) ** 2).sum(axis=1))
        closer = (d < away) & ~inside
        away[closer], parent[closer] = d[closer], now
        now = int(np.where(inside, np.inf, away).argmin())
    return out


class Scores:
    """Intervals around the scores of one block of candidates, carried down the tree of one block of anchors."""

    def __init__(self, anchors: np.ndarray, tree: list[tuple[int, int, float]], x: np.ndarray):
        self.anchors, self.x, self.tree = exact(anchors, most(x)), exact(x, most(anchors)), tree
        self.norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        self.slack = 1e-9 * (1.0 + self.norms * (1.0 + lengths.max(initial=0)))
        self.rescored = 0
        # A parent's interval is dropped with its last child.
        self.children = np.bincount([p for _, p, _ in tree if p >= 0], minlength=len(anchors))

    def walk(self):
        """(anchor row, low, high, rescore) in tree order; ``rescore(rows)`` gives exact scores and narrows the interval."""
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row, parent, edge in self.tree:
            if parent < 0:
                reach = self.norms * np.sqrt((self.anchors[row].astype(np.float64) ** 2).sum()) + self.slack
                low, high = -reach, reach.copy()
            else:
                low, high = (side.copy() for side in known[parent])
                reach = edge * (1 + 1e-9) * self.norms + self.slack
                low -= reach
                high += reach
                self.children[parent] -= 1
                if not self.children[parent]:
                    del known[parent]

            def rescore(rows: np.ndarray, row=row, low=low, high=high) -> np.ndarray:
                scores = self.x[rows] @ self.anchors[row]
                low[rows] = scores.astype(np.float64) - self.slack[rows]
                high[rows] = scores.astype(np.float64) + self.slack[rows]
                self.rescored += len(rows)
                return scores

            if parent < 0:
                rescore(np.arange(len(self.x)))  # every bound of the block hangs on the root
            if self.children[row]:
                known[row] = low, high
            yield row, low, high, rescore


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id code."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
        may = np.flatnonzero(scores >= edge)
    else:
        may = np.arange(len(scores))
    return may[np.lexsort((ids[may], -scores[may]))[:k]] if scores.dtype != object else np.array(sorted(may, key=lambda n: (-scores[n], ids[n]))[:k], dtype=int)


def positives_in(anchors: dict, block: dict, k: int) -> list[tuple]:
    """(anchor number, candidate row, score) of the k best candidates with the anchor's label, itself left out."""
    work, out = Scores(anchors["x"], anchors["tree"], block["x"]), []
    for row, low, high, rescore in work.walk():
        fit = np.flatnonzero((block["label"] == anchors["label"][row]) & (block["uid"] != anchors["uid"][row]))
        if len(fit) > k:
            fit = fit[high[fit] >= np.partition(low[fit], len(fit) - k)[len(fit) - k]]
        scores = rescore(fit)
        out += [(row, int(fit[n]), int(scores[n])) for n in _best(scores, block["order"][fit], k)]
    return out


def negatives_in(anchors: dict, block: dict, k: int, share: tuple[int, int]) -> list[tuple]:
    """(anchor number, number of its positive, candidate row, score) of the k best other-label candidates of each window."""
    work, out = Scores(anchors["x"], anchors["tree"], block["x"]), []
    below, above = share
    for row, low, high, rescore in work.walk():
        windows = [(n, s) for n, (_, s) in enumerate(anchors["positives"][row]) if s >= 0]
        other = block["label"] != anchors["label"][row]
        may = np.zeros(len(other), dtype=bool)
        for _, s in windows:
            top, least = float(s) * (1 + 1e-12), float(s) * below / above * (1 - 1e-12)
            sure = other & (high <= float(s)) & (low >= least)
            if np.count_nonzero(sure) > k:
                floors = low[sure]
                least = max(least, float(np.partition(floors, len(floors) - k)[len(floors) - k]))
            may |= other & (high >= least) & (low <= top)
        rows = np.flatnonzero(may)
        if not len(rows):
            continue
        scores = rescore(rows)
        wide = scores.astype(np.int64 if scores.dtype == np.float64 else object)  # room for the factors of the share
        for n, s in windows:
            inside = np.flatnonzero((below * s <= above * wide) & (wide <= s))
            out += [(row, n, int(rows[inside[m]]), int(scores[inside[m]])) for m in _best(scores[inside], block["order"][rows[inside]], k)]
    return out


def _packed(table: pa.Table) -> dict:
    ids = table["id"].to_pylist()
    uid = np.array(table["uid"].to_pylist(), dtype=np.int64)
    ranked = sorted(range(len(ids)), key=lambda n: (ids[n] is None, ids[n] or 0, uid[n]))
    order = np.empty(len(ids), dtype=np.int64)
    order[ranked] = np.arange(len(ids))
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = np.asarray(flat, dtype=np.int64).reshape(len(ids), -1)
    if np.abs(x.astype(np.float64)).max(initial=0) < 2 ** 31:
        x = x.astype(np.int32)
    return {"id": ids, "uid": uid, "order": order, "label": np.array(table["label"].to_pylist(), dtype=np.int64), "x": x}


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "candidates": pa.array([pickle.dumps(_packed(table))], pa.binary())})


def _pack_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    packed = _packed(table)
    packed["tree"] = spanning_tree(packed["x"])
    packed["positives"] = [[(p["n"], int(p["score"])) for p in found or ()] for found in (table["positives"].to_pylist() if "positives" in table.column_names else [()] * table.num_rows)]
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "anchors": pa.array([pickle.dumps(packed)], pa.binary())})


def _search(listed: DataFrame, chunks: int, anchors: DataFrame, blocks: int, kernel, schema: str) -> DataFrame:
    """``kernel`` on each (anchor block, candidate block). A task holds one candidate block and ``WAVE`` anchor blocks."""
    part = F.pmod(F.pmod(F.xxhash64("label"), F.lit(blocks)) + F.pmod("uid", F.lit(max(1, blocks // 4))), F.lit(blocks)).cast("int")
    # Anchors of one label are dealt over a quarter of the blocks: near anchors make short edges.
    packed = stage(anchors.groupBy("dim", part.alias("block")).applyInArrow(_pack_anchors, "dim int, block int, anchors binary"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block = pickle.loads(left["candidates"][0].as_py())
            for cell in right["anchors"]:
                found += kernel(pickle.loads(cell.as_py()), block)
        columns = list(zip(*found)) if found else [()] * len(fields)
        return pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(fields, columns)})

    fields = T._parse_datatype_string(schema).fields
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = listed.withColumn("wave", spread(-(-blocks // WAVE)))
    right = packed.withColumn("wave", F.expr(f"block div {WAVE}").cast("int")).withColumn("chunk", spread(chunks))
    keys = ["dim", "chunk", "wave"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def mine(
    rows: DataFrame, is_anchor: Column, k: int = 5, positives: int = 5, share: tuple[int, int] = (80, 100), scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel: Column | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` and ``relabel`` are expressions over the columns of ``rows``. A negative's score s and the positive's p
    satisfy ``share[0] * p <= share[1] * s <= share[1] * p``.
    """
    usable = rows.where(F.col(label_col).isNotNull() & finite(F.col(vector_col)))
    label = F.col(label_col) if relabel is None else relabel
    base = usable.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    base = stage(numbered(base, "id", "label", "v").withColumn("dim", F.size("v")))
    asked = base.where("asks")
    chunks, blocks = max(1, -(-base.count() // CANDIDATES)), max(1, -(-asked.count() // ANCHORS))
    chunk = F.pmod(F.xxhash64("uid", F.lit("candidates")), F.lit(chunks)).cast("int").alias("chunk")
    listed = stage(base.groupBy("dim", chunk).applyInArrow(_pack, "dim int, chunk int, candidates binary"))
    ranked = lambda score: F.desc(F.col(score).cast(WIDE))

    def find_positives(anchors: dict, block: dict) -> list[tuple]:
        return [(int(anchors["uid"][r]), block["id"][c], int(block["uid"][c]), score_text(s)) for r, c, s in positives_in(anchors, block, positives)]

    first = _search(listed, chunks, asked, blocks, find_positives, "uid long, positive_id long, positive_uid long, score string")
    order = Window.partitionBy("uid").orderBy(ranked("score"), F.asc_nulls_last("positive_id"), "positive_uid")
    first = stage(first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives))
    windows = first.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "score"))).alias("positives"))

    def find_negatives(anchors: dict, block: dict) -> list[tuple]:
        return [
            (int(anchors["uid"][r]), anchors["id"][r], anchors["positives"][r][n][0], block["id"][c], int(block["uid"][c]), score_text(s))
            for r, n, c, s in negatives_in(anchors, block, k, share)]

    second = _search(listed, chunks, asked.join(windows, "uid"), blocks, find_negatives, "uid long, anchor_id long, n int, negative_id long, negative_uid long, negative string")
    order = Window.partitionBy("uid", "n").orderBy(ranked("negative"), F.asc_nulls_last("negative_id"), "negative_uid")
    best = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(first.select("uid", "n", "positive_id", "score"), ["uid", "n"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", as_long("score").alias("positive_score"), as_long("negative").alias("negative_score"))
