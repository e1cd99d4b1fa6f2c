"""Registry of queries with their oracle text, and the views both sides read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spotloom.session import bound_tasks, ship_package

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

# Stand-in views over the given tables. One text serves both engines unless a pair is given.
VIEWS: dict[str, str | tuple[str, str]] = {
    "fx_transcripts": """SELECT l_orderkey AS cell_id, CASE WHEN l_linenumber = 7 THEN concat('BLANK_', p_brand) ELSE p_brand END AS feature_name,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS overlaps_nucleus, l_orderkey * 8 + l_linenumber AS mol_id
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_cells": """SELECT o_orderkey AS cell_id, CAST((o_orderkey * 37) % 2003 AS DOUBLE) AS centroid_x, CAST((o_orderkey * 101) % 1999 AS DOUBLE) AS centroid_y,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS in_tissue, o_orderpriority AS sample_id FROM orders""",
    "fx_spots": """SELECT s_suppkey AS spot_id, CAST((s_suppkey * 53) % 2003 AS DOUBLE) AS center_x, CAST((s_suppkey * 97) % 1999 AS DOUBLE) AS center_y,
        CAST(s_nationkey AS INT) AS sample_no FROM supplier""",
    "fx_expr": """SELECT o_orderpriority AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 'Xenium' ELSE 'Visium' END AS technology, o_orderkey AS obs_id,
        p_brand AS gene, CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'Xenium' ELSE 'Visium' END, o_orderkey, p_brand""",
    "fx_obs": """SELECT o_orderpriority AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 'Xenium' ELSE 'Visium' END AS technology, o_orderkey AS obs_id FROM orders""",
    "fx_pred": """SELECT l_orderkey AS entity_id, p_brand AS gene, sum(l_quantity) AS target, sum(l_extendedprice) / 1000 AS pred, l_orderkey % 5 AS sample_no
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand""",
    "fx_batches": "SELECT event_type AS run, dayofyear(ts) AS epoch, event_id AS batch_id, value AS loss, 1 + event_id % 8 AS n FROM events",
    "fx_fold_metrics": """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'visium' ELSE 'xenium' END AS platform, CAST(s_suppkey AS INT) AS fold,
        s_acctbal / 10000 AS overall, CAST(s_nationkey AS DOUBLE) / 25 AS mean_gene FROM supplier""",
    "fx_logs": """SELECT o_orderkey % 5 AS fold, o_orderkey AS pos, concat('Fold 1 Pearson: overall=0.', CAST(100 + o_orderkey % 900 AS VARCHAR(9)),
        ', gene=-0.', CAST(100 + o_orderkey % 800 AS VARCHAR(9)), ', spot=0.', CAST(100 + o_orderkey % 700 AS VARCHAR(9))) AS line FROM orders""",
    "fx_polygons": """SELECT p_partkey AS cell_id, CAST((p_partkey * 17) % 200 AS DOUBLE) AS x0, CAST((p_partkey * 29) % 200 AS DOUBLE) AS y0,
        CAST(5 + p_size % 20 AS DOUBLE) AS w, CAST(4 + p_size % 11 AS DOUBLE) AS h, CASE WHEN p_partkey % 2 = 0 THEN 'Visium' ELSE 'Xenium' END AS technology,
        p_brand AS sample_id FROM part""",
    "fx_embed": """SELECT vec_id AS id, embedding AS vec, label, CASE WHEN label % 2 = 0 THEN 'visium' ELSE 'xenium' END AS platform,
        CASE WHEN vec_id % 5 = 4 THEN 'query' ELSE 'bank' END AS side, CAST(vec_id % 5 AS INT) AS fold FROM embeddings""",
    "fx_panels": """SELECT DISTINCT CAST(l_suppkey % 4 AS INT) AS sample_no, p_brand AS gene FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE CAST(substr(p_brand, 7) AS INT) % (l_suppkey % 4 + 3) <> 0""",
    "fx_panel": "SELECT p_brand AS gene, CAST(min(p_partkey) AS BIGINT) AS pos FROM part WHERE p_brand <> 'Brand#3' GROUP BY p_brand",
    "fx_values": (
        """SELECT vec_id AS id, concat('g', CAST(d AS STRING)) AS gene, CAST(v AS DOUBLE) AS value
           FROM (SELECT vec_id, posexplode(embedding) AS (d, v) FROM embeddings)""",
        """SELECT vec_id AS id, concat('g', CAST(d - 1 AS VARCHAR)) AS gene, CAST(v AS DOUBLE) AS value
           FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings)""",
    ),
    "fx_vpanel": "SELECT gene, CAST(substr(gene, 2) AS BIGINT) AS pos FROM fx_values GROUP BY gene",
    "fx_tokens": (
        f"SELECT CAST(vec_id % 256 AS BIGINT) AS patch_idx, array({', '.join(f'avg(embedding[{i}])' for i in range(64))}) AS token FROM embeddings GROUP BY vec_id % 256",
        f"SELECT CAST(vec_id % 256 AS BIGINT) AS patch_idx, [{', '.join(f'avg(embedding[{i}]::DOUBLE)' for i in range(1, 65))}] AS token FROM embeddings GROUP BY vec_id % 256",
    ),
    "fx_spot_expr": """SELECT CAST(l_suppkey % 3 AS VARCHAR(5)) AS sample_id, l_suppkey AS spot_id, concat('g', CAST(l_partkey % 10 AS VARCHAR(5))) AS gene, CAST(sum(l_quantity) AS BIGINT) AS cnt
        FROM lineitem GROUP BY l_suppkey, l_partkey % 10""",
    "fx_pixels": (
        """SELECT p_partkey AS crop_id, y, x, (p_size * 7 + x * 13 + y * 29) % 256 AS r, (p_size * 11 + x * 31 + y * 5) % 256 AS g,
           (p_size * 3 + x * 17 + y * 41) % 256 AS b FROM (SELECT p_partkey, p_size, explode(sequence(0, 7)) AS y FROM part) LATERAL VIEW explode(sequence(0, 7)) t AS x""",
        """SELECT p_partkey AS crop_id, y, x, CAST((p_size * 7 + x * 13 + y * 29) % 256 AS INT) AS r, CAST((p_size * 11 + x * 31 + y * 5) % 256 AS INT) AS g,
           CAST((p_size * 3 + x * 17 + y * 41) % 256 AS INT) AS b FROM part, (SELECT CAST(range AS INT) AS y FROM range(8)), (SELECT CAST(range AS INT) AS x FROM range(8))""",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Lazy access to the given tables and the stand-in views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
        used = [t for t in (*TABLES, *VIEWS) if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})


def oracle(text: str) -> str:
    """Puts the views a text names in front of it as common table expressions."""
    text = text.strip()
    needed: list[str] = []

    def need(body: str) -> None:
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", body):
                inner = view if isinstance(view, str) else view[1]
                need(inner)
                needed.append(name)

    need(text)
    ctes = [f"{n} AS ({VIEWS[n] if isinstance(VIEWS[n], str) else VIEWS[n][1]})" for n in needed]
    if not ctes:
        return text
    rest = text[4:] if text[:5].upper() == "WITH " else None
    return "WITH " + ", ".join(ctes) + ("," + rest if rest else " " + text)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            bound_tasks(spark, sf_dir)
            return fn(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def r6(column: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded double without a negative zero, aliased."""
    name = name or column
    col = F.col(column) if isinstance(column, str) else column
    return (F.round(col.cast("double"), digits) + F.lit(0.0)).alias(name)


def R(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Oracle text of ``r6``."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0e0 AS {name or expr}"
