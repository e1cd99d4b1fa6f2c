import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.functions import polygons
from spotloom.operators import counting, filters, metrics, ranking, spatial, splits
from spotloom.plans import cells as jobs


def cells_frame(spark, xy):
    return spark.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(xy)], "cell_id long, centroid_x double, centroid_y double")


def all_centers(xy, radius, spacing, hexagonal):
    """Every centre of the grid, by the written rule."""
    x0, y0, x1, y1 = xy[:, 0].min(), xy[:, 1].min(), xy[:, 0].max(), xy[:, 1].max()
    step = spacing * np.sqrt(3) / 2 if hexagonal else spacing
    out = []
    for row in range(int((y1 + radius - y0) // step) + 1):
        start = x0 + (spacing / 2 if hexagonal and row % 2 else 0.0)
        for col in range(int((x1 + radius - start) // spacing) + 1):
            out.append((row, col, start + col * spacing, y0 + row * step))
    return out


@pytest.mark.parametrize("layout", ["hex", "square"])
def test_grid_assignment_against_all_centers(spark, layout):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 900, size=(400, 2))
    radius, spacing = 45.0, 90.0
    centers = all_centers(xy, radius, spacing, layout == "hex")
    want = {}
    for i, (x, y) in enumerate(xy):
        d = [((x - cx) ** 2 + (y - cy) ** 2, r, c) for r, c, cx, cy in centers]
        best = min(d)
        if best[0] <= radius ** 2:
            want[i + 1] = best[1:]
    got = {r["cell_id"]: (r["grid_row"], r["grid_col"]) for r in spatial.nearest_grid_center(cells_frame(spark, xy), radius, spacing, layout).collect()}
    assert got == want
    listed = spatial.grid_centers(spatial.extent(cells_frame(spark, xy)), radius, spacing, layout).collect()
    assert {(r["grid_row"], r["grid_col"]) for r in listed} == {c[:2] for c in centers}


def test_grid_radius_is_inclusive_and_ties_go_to_the_lower_row(spark):
    xy = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 50.0], [100.0, 100.0]])
    got = {r["cell_id"]: (r["grid_row"], r["distance"]) for r in spatial.nearest_grid_center(cells_frame(spark, xy), 50.0, 100.0, "square").collect()}
    assert got[3] == (0, 50.0) and got[2] == (0, 10.0)


def test_radius_takes_the_raw_distance(spark, monkeypatch):
    cells = cells_frame(spark, np.array([[0.0, 0.0]]))
    near, far = 1.0 - 2e-13, 1.0 - 1e-13
    spots = spark.createDataFrame([(9, near, 0.0), (3, far, 0.0), (1, 1.0, 0.0)], "spot_id long, center_x double, center_y double")
    for chunk in (256, 1):
        monkeypatch.setattr(spatial, "CHUNK", chunk)
        rows = spatial.nearest_within_radius(cells, spots, 1.0).collect()
        assert [(r["spot_id"], r["distance"]) for r in rows] == [(9, near)]


@pytest.mark.parametrize("chunk", [256, 3])
def test_nearest_within_radius(spark, monkeypatch, chunk):
    monkeypatch.setattr(spatial, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.uniform(0, 300, size=(200, 2)), rng.normal(150, 2, size=(150, 2))])
    sp = np.concatenate([rng.uniform(0, 300, size=(30, 2)), rng.normal(150, 3, size=(40, 2)), [[10.0, 10.0], [10.0, 10.0]]])
    spots = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sp)], "spot_id long, center_x double, center_y double")
    d = np.sqrt(((xy[:, None] - sp[None]) ** 2).sum(axis=2))
    want = {i + 1: int(np.lexsort((np.arange(len(sp)), np.round(row, 12)))[0]) for i, row in enumerate(d) if row.min() < 20}
    got = {r["cell_id"]: r["spot_id"] for r in spatial.nearest_within_radius(cells_frame(spark, xy), spots, 10.0, 2.0).collect()}
    assert got == want


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


def test_polygon_arithmetic(spark):
    shapes = [(1, ring((0, 0), (4, 0), (0, 3))), (2, ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))), (3, ring((5, 5), (5, 5), (5, 5)))]
    df = spark.createDataFrame(shapes, "cell_id long, vertices array<struct<x:double,y:double>>")
    rings = polygons.as_rings("vertices")
    rows = {r["cell_id"]: r for r in df.select("cell_id", polygons.area(rings).alias("a"), polygons.perimeter(rings).alias("p"), polygons.centroid(rings).alias("c")).collect()}
    assert (rows[1]["a"], rows[1]["p"]) == (6.0, 12.0)
    assert (rows[1]["c"]["x"], rows[1]["c"]["y"]) == pytest.approx((4 / 3, 1.0))
    assert (rows[2]["a"], rows[2]["p"]) == (16.0, 16.0)
    assert (rows[3]["a"], rows[3]["c"]["x"]) == (0.0, 5.0)


def test_patch_overlap(spark):
    u_shape = ring((1, 1), (39, 1), (39, 39), (31, 39), (31, 9), (9, 9), (9, 39), (1, 39))
    shapes = [(1, ring((2, 2), (8, 2), (8, 8), (2, 8))), (2, ring((5, 5), (15, 5), (15, 15), (5, 15))), (3, ring((10, 12), (14, 12), (14, 18), (10, 18))),
              (4, ring((100, 100), (110, 100), (110, 110))), (5, u_shape), (6, ring((-5, -5), (45, -5), (45, 45), (-5, 45)))]
    df = spark.createDataFrame(shapes, "cell_id long, vertices array<struct<x:double,y:double>>")
    got = {}
    for r in spatial.polygon_patch_overlap(df, 40.0, 4).collect():
        got.setdefault(r["cell_id"], {})[r["patch_idx"]] = round(r["overlap_area"], 9)
    assert got[1] == {0: 36.0}
    assert got[2] == {0: 25.0, 1: 25.0, 4: 25.0, 5: 25.0}
    assert got[3] == {4: 0.0, 5: 24.0}  # a shared border touches
    assert 4 not in got
    assert set(range(16)) - set(got[5]) == {5, 6, 9, 10, 13, 14}  # the hollow of the U is not touched
    assert sum(got[5].values()) == pytest.approx(38 * 38 - 22 * 30)
    assert got[6] == {i: 100.0 for i in range(16)}


def test_folds_edges(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 2, 4, 6, 8, 10])], "id long, x double")
    folds = lambda frame, n: [r["fold"] for r in splits.position_folds(frame, "x", n).orderBy("id").collect()]
    assert folds(df, 5) == [0, 1, 2, 3, 4, 4]
    assert folds(df, 1) == [0] * 6
    assert folds(df.withColumn("x", F.lit(3.0)), 5) == [0] * 6
    assert folds(df.where("id < 0"), 5) == []


def test_pseudospot_totals_are_kept(spark):
    rng = np.random.default_rng(2)
    cells = cells_frame(spark, rng.uniform(0, 500, size=(300, 2)))
    molecules = cells.select("cell_id", F.explode(F.sequence(F.lit(1), (F.col("cell_id") % 5 + 1).cast("int"))).alias("g")).select(
        "cell_id", F.concat(F.lit("G"), F.col("g").cast("string")).alias("feature_name"))
    t = jobs.prepare_cells(molecules, cells)
    s = jobs.build_pseudospots(t.cells, t.counts, jobs.GridParameters(40.0, 80.0, "hex"), min_cells=2)
    members = s.membership.join(t.counts, "cell_id").agg(F.sum("cnt")).first()[0]
    assert members == s.counts.agg(F.sum("cnt")).first()[0] == s.spots.agg(F.sum("transcript_count")).first()[0]
    ids = [r["spot_id"] for r in s.spots.orderBy("grid_row", "grid_col").collect()]
    assert ids == list(range(len(ids)))
    m = s.manifest.first()
    assert m["num_pseudospots"] == len(ids) and m["num_cells_total"] == 300


def test_one_run_over_all_samples_equals_single_runs(spark):
    rng = np.random.default_rng(6)
    rows, molecules = [], []
    for sample, size, scale in (("A", 300, 400.0), ("B", 120, 900.0), ("C", 5, 4000.0), ("D", 1, 10.0)):
        for cell in range(size):
            x, y = rng.uniform(-scale, scale, 2)
            rows.append((sample, cell, float(x), float(y)))
            molecules += [(sample, cell, f"G{g}", len(molecules) + n) for n, g in enumerate(rng.integers(0, 5, rng.integers(0, 4)))]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id long, centroid_x double, centroid_y double")
    found = spark.createDataFrame(molecules, "sample_id string, cell_id long, feature_name string, ord long")
    shapes = {"A": (40.0, 80.0, "hex"), "B": (90.0, 150.0, "square"), "C": (30.0, 60.0, "hex"), "D": (5.0, 20.0, "hex")}
    grids = spark.createDataFrame([(s, *g) for s, g in shapes.items()], "sample_id string, radius double, spacing double, layout string")
    rounded = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in rows)
    by = ("sample_id",)
    for drop in (True, False):
        t = jobs.prepare_cells(found, cells, order="ord", drop_zero=drop, by=by)
        s = jobs.build_pseudospots(t.cells, t.counts, grids, min_cells=2, by=by)
        together = {n: getattr(o, n) for o in (t, s) for n in o.__dataclass_fields__ if n not in ("manifest", "counts")}
        together |= {"cell_counts": t.counts, "spot_counts": s.counts, "cell_manifest": t.manifest, "spot_manifest": s.manifest}
        for sample, shape in shapes.items():
            one = lambda df: df.where(F.col("sample_id") == sample).drop("sample_id")
            a = jobs.prepare_cells(one(found), one(cells), order="ord", drop_zero=drop)
            b = jobs.build_pseudospots(a.cells, a.counts, jobs.GridParameters(*shape), min_cells=2)
            alone = {n: getattr(o, n) for o in (a, b) for n in o.__dataclass_fields__ if n not in ("manifest", "counts")}
            alone |= {"cell_counts": a.counts, "spot_counts": b.counts}
            for name, df in alone.items():
                assert rounded(one(together[name]).select(*df.columns).collect()) == rounded(df.collect()), (sample, name)
        assert {r.sample_id: r.num_cells_total for r in s.manifest.collect()} == {r.sample_id: r.num_cells_after_filtering for r in t.manifest.collect()}


def test_grid_table_follows_grid_parameters(spark):
    columns = "sample_id string, pixel_size_um double, spot_diameter_um double, technology string, inter_spot_dist_um double"
    reference = spark.createDataFrame([("ref", 0.5, 55.0, "Visium", 100.0)], columns)
    imaging = spark.createDataFrame([("A", 0.25, 1.0, "Xenium", 1.0), ("B", 0.5, 1.0, "Xenium", 1.0)], columns)
    got = {r.sample_id: (r.radius, r.spacing, r.layout) for r in jobs.grid_table(reference, imaging).collect()}
    for sample in "AB":
        p = jobs.grid_parameters(reference, imaging.where(F.col("sample_id") == sample))
        assert got[sample] == (p.radius, p.spacing, p.layout)


def test_rank_median_and_auc_with_one_large_group(spark):
    rng = np.random.default_rng(3)
    value = np.concatenate([np.full(300, 5.0), rng.normal(size=401)])
    rows = [("big" if i < 650 else "small", i, float(v)) for i, v in enumerate(value)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {r["g"]: r["m"] for r in ranking.exact_median(df, ["g"], "v", "m").collect()}
    assert got == {"big": np.median(value[:650]), "small": np.median(value[650:])}
    pos = df.withColumn("label", (F.col("id") % 2).cast("int")).withColumnRenamed("v", "score")
    s, y = value, np.arange(701) % 2
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert ranking.auc_by_rank(pos).first()["auc"] == pytest.approx(want)
    one_class = pos.withColumn("label", F.lit(1))
    assert ranking.auc_by_rank(one_class).first()["auc"] is None


def test_pearson_edges(spark):
    rows = [("a", 1, 1.0, 2.0), ("a", 2, 1.0, 5.0), ("b", 1, 1.0, 2.0), ("b", 2, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "gene string, entity_id long, pred double, target double")
    got = {r["gene"]: r["pearson"] for r in metrics.pearson_by_gene(df).collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(1.0)
    s = metrics.pearson_summary(df).first()
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert s["overall_pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert metrics.pearson_summary(df.where("entity_id < 0")).first()["overall_pearson"] == 0.0


def test_published_fold_values_average(spark):
    # Five published overall scores and their mean.
    values = [0.606224, 0.569681, 0.628240, 0.604062, 0.538144]
    df = spark.createDataFrame(list(enumerate(values)), "fold int, overall double")
    row = metrics.fold_summary(df, ["overall"]).first()
    assert row["overall_mean"] == pytest.approx(0.589270, abs=1e-6) and row["overall_std"] == pytest.approx(0.031694, abs=1e-6)
    assert row["overall_values"] == values


def test_bad_ids_and_checks(spark):
    df = spark.createDataFrame([("12.7",), ("abc",), ("0",), (None,), ("NaN",), ("7",)], "cell_id string")
    assert sorted(r[0] for r in filters.valid_cell_ids(df).collect()) == [7, 12]
    halves = spark.createDataFrame([(0.5,), (1.0,)], "cnt double")
    assert filters.count_like_check(halves).first()["count_semantics_verified"] is False
    assert filters.count_like_check(halves.where("cnt < 0")).first()["count_semantics_verified"] is True
    with pytest.raises(Exception, match="not raw counts"):
        filters.assert_count_like(halves).collect()


def test_counting_precedes_a_shuffled_lookup(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).alias("cell_id"), F.lit("G").alias("feature_name"))
    df.write.parquet(str(tmp_path / "t"))
    cells = spark.range(5).select(F.col("id").alias("cell_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = counting.cell_gene_counts(spark.read.parquet(str(tmp_path / "t")), cells)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.index("SortMergeJoin") < plan.index("partial_count")
    assert "GreaterThan(cell_id,0)" in plan


def test_nearest_among_crowded_centres_measures_a_few_of_them(monkeypatch):
    """The centres measured for a cell do not grow with the centres in reach, wherever they crowd; ties go to the lower rank."""
    rng = np.random.default_rng(3)
    measured = {}
    for n in (500, 8000):
        cx, cy = (np.concatenate([rng.uniform(0, 100, n), rng.normal(30, 1e-3, n), [50.0, 50.0]]) for _ in range(2))
        cx[-2:], cy[-2:] = (50.0, 54.0), (50.0, 50.0)
        x, y = np.concatenate([rng.uniform(0, 100, 300), [52.0]]), np.concatenate([rng.uniform(0, 100, 300), [50.0]])
        order = rng.permutation(len(cx))
        seen, repeat = [], np.repeat

        def counted(a, times, *rest):
            out = repeat(a, times, *rest)
            seen.append(len(out))
            return out

        monkeypatch.setattr(spatial.np, "repeat", counted)
        cell, center, distance = spatial._nearest_centers(x, y, cx, cy, order, 60.0)
        monkeypatch.undo()
        d = np.sqrt((x[:, None] - cx) ** 2 + (y[:, None] - cy) ** 2)
        assert cell.tolist() == list(range(len(x)))
        assert center.tolist() == [int(np.lexsort((order, row))[0]) for row in d]
        assert distance.tolist() == d.min(axis=1).tolist()
        measured[n] = max(seen[-2:]) / len(x)
    assert measured[8000] < 100 and measured[8000] < 3 * measured[500]


def test_radius_search_over_sparse_cells_and_odd_rows(spark):
    """Wide buckets, coordinates that are null or not finite, repeated and null cell ids, and text spot ids."""
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 1e6), (2, 5e5, 5e5), (None, 1e6, 1e6 + 3), (4, None, 0.0), (5, float("nan"), 0.0), (6, float("inf"), 0.0)], "cell_id long, centroid_x double, centroid_y double")
    spots = spark.createDataFrame([("b", 0.0, 4.0), ("a", 4.0, 0.0), ("c", 1e6, 1e6 + 2), ("d", 5e5 - 1, 5e5), ("e", float("nan"), 0.0), ("f", None, 0.0)], "spot_id string, center_x double, center_y double")
    got = {tuple(r) for r in spatial.nearest_within_radius(cells, spots, 5.0).collect()}
    assert got == {(1, "a", 4.0), (2, "d", 1.0), (None, "c", 1.0)}


def test_outlines_of_one_task_are_clipped_by_many(spark):
    square = ring((1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0))
    cells = spark.createDataFrame([(i, square) for i in range(64)], "cell_id long, vertices array<struct<x:double,y:double>>").coalesce(1)
    got = spatial.polygon_patch_overlap(cells, 40.0, 4).select("cell_id", "overlap_area", F.spark_partition_id().alias("task")).where("overlap_area > 0").collect()
    assert sorted((r["cell_id"], r["overlap_area"]) for r in got) == [(i, 4.0) for i in range(64)]
    assert len({r["task"] for r in got}) > 1
