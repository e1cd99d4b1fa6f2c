import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.constants import STAGE_ORDER
from spotloom.operators import features, gap, retrieval, splits, transport
from spotloom.plans import evaluation, reports


def points(spark, x, **columns):
    kinds = "".join(f", {n} {'string' if isinstance(c[0], str) else 'int'}" for n, c in columns.items())
    return spark.createDataFrame([(i, [float(v) for v in r], *[c[i] for c in columns.values()]) for i, r in enumerate(x)], "id long, vec array<double>" + kinds)


def sinkhorn(x, y, eps, iters, rho):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cost = 1 - np.clip(unit(x) @ unit(y).T, -1, 1)
    k = np.maximum(np.exp(-cost / eps), 1e-8)
    a, b = np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y))
    power = 1.0 if rho is None else rho / (rho + eps)
    v = np.ones(len(y))
    for _ in range(iters):
        u = (a / np.maximum(k @ v, 1e-8)) ** power
        v = (b / np.maximum(k.T @ u, 1e-8)) ** power
    plan = u[:, None] * k * v[None]
    kl = lambda m, r: (np.maximum(m, 1e-8) * (np.log(np.maximum(m, 1e-8)) - np.log(r)) - np.maximum(m, 1e-8) + r).sum()
    return (plan * cost).sum() + (0 if rho is None else rho * (kl(plan.sum(1), a) + kl(plan.sum(0), b)))


@pytest.mark.parametrize("rho", [None, 0.7])
def test_sinkhorn(spark, rho):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(23, 4)), rng.normal(size=(17, 4)) + 0.5
    got = transport.sinkhorn_cost(points(spark, x), points(spark, y), 0.2, 3, rho, block=8).first()[0]
    assert got == pytest.approx(sinkhorn(x, y, 0.2, 3, rho), rel=1e-9)


def test_standardize_and_pca(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)), np.full((60, 1), 2.5)], axis=1)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    got = np.array([r["vec"] for r in features.standardize(points(spark, x)).orderBy("id").collect()])
    assert np.allclose(got, z)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1][:3]
    projected, info = features.pca(points(spark, x), 3)
    p = np.array([r["vec"] for r in projected.orderBy("id").collect()])
    assert np.allclose(np.abs(p), np.abs(z @ vectors[:, order]), atol=1e-8)
    row = info.first()
    assert row["pca_components"] == 3 and row["pca_explained_variance_ratio_sum"] == pytest.approx(values[order].sum() / values.sum())
    assert features.pca(points(spark, x))[1].first()["pca_components"] == 5


def test_cross_covariance_skips_single_rows(spark):
    rng = np.random.default_rng(2)
    s, p = rng.normal(size=(31, 3)), rng.normal(size=(31, 2))
    group = ["a"] * 20 + ["b"] * 10 + ["c"]
    rows = [(i, group[i], s[i].tolist(), p[i].tolist()) for i in range(31)]
    df = spark.createDataFrame(rows, "id long, platform string, l array<double>, r array<double>").repartition(4)
    part = lambda m: np.mean((((s[m] - s[m].mean(0)).T @ (p[m] - p[m].mean(0))) / (m.sum() - 1)) ** 2)
    g = np.array(group)
    assert gap.cross_covariance_norm(df, "l", "r", "platform").first()[0] == pytest.approx((part(g == "a") + part(g == "b")) / 2)


def test_platform_auc(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(12, 2)), rng.normal(size=(12, 2)) + 12])
    df = points(spark, x, label=[0] * 12 + [1] * 12)
    assert features.platform_auc(df).first()[0] == pytest.approx(1.0)
    assert features.platform_auc(df.where("id < 13")).first()[0] is None
    folds = splits.stratified_folds(df, "label", 5, 0, "id").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} == {2, 3}


def test_patch_pool_edges(spark):
    overlaps = spark.createDataFrame([(1, 0, 3.0), (1, 1, 1.0), (2, 1, 0.0)], "cell_id long, patch_idx long, overlap_area double")
    tokens = spark.createDataFrame([(0, [1.0, 8.0]), (1, [5.0, 4.0])], "patch_idx long, token array<double>")
    cells = spark.range(1, 4).withColumnRenamed("id", "cell_id")
    got = {m: {r["cell_id"]: list(r["features"]) for r in gap.patch_pool(overlaps, tokens, cells, 2, m).collect()} for m in ("mean", "max", "weighted_mean")}
    assert got["mean"] == {1: [3.0, 6.0], 2: [5.0, 4.0], 3: [0.0, 0.0]}
    assert got["max"][1] == [5.0, 8.0]
    assert got["weighted_mean"] == {1: [2.0, 7.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}  # a zero-area touch has no weight
    with pytest.raises(ValueError):
        gap.patch_pool(overlaps, tokens, cells, 2, "median")


def test_one_match_predicts_its_expression_and_empty_spots_stay(spark):
    matches = spark.createDataFrame([(7, 1, 0.3, 1)], "query_id long, bank_id long, score double, rank int")
    bank = spark.createDataFrame([(1, "A", 2.0)], "id long, gene string, value double")
    assert [tuple(r) for r in retrieval.predict(matches, bank).collect()] == [(7, "A", 2.0)]
    pred = spark.createDataFrame([(1, "A", 1.0), (2, "A", 2.0)], "cell_id long, gene string, pred double")
    assign = spark.createDataFrame([(1, 5), (2, 5)], "cell_id long, spot_id long")
    spots = spark.createDataFrame([(5,), (6,)], "spot_id long")
    got = {r["spot_id"]: r["pred"] for r in retrieval.aggregate_cells_to_spots(pred, assign, spots).collect()}
    assert got == {5: pytest.approx(np.log1p(np.expm1(1) + np.expm1(2))), 6: 0.0}
    covered = {r["spot_id"]: r["cells_per_spot"] for r in retrieval.cells_per_spot(assign, spots).collect()}
    assert covered == {5: 2, 6: 0}


def test_summed_counts_below_zero_count_as_zero(spark):
    pred = spark.createDataFrame([(1, "A", -0.7), (2, "A", -0.9), (3, "A", float(np.log(0.5))), (4, "A", float(np.log(0.5))), (5, "A", -0.1), (6, "A", 1.0)], "cell_id long, gene string, pred double")
    assign = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3)], "cell_id long, spot_id long")  # sums below, at and above -1
    got = {r["spot_id"]: r["pred"] for r in retrieval.aggregate_cells_to_spots(pred, assign).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: pytest.approx(np.log1p(np.expm1(-0.1) + np.expm1(1.0)))}
    sums = [np.expm1(-0.7) + np.expm1(-0.9), 2 * np.expm1(np.log(0.5))]
    assert sums[0] < -1 and sums[1] == pytest.approx(-1)


def small_study(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4))
    obs = points(spark, x, sample_id=[f"S{i % 4}" for i in range(40)], fold=[i % 4 for i in range(40)])
    expr = spark.createDataFrame([(i, f"G{g}", float(abs(x[i, g]))) for i in range(40) for g in range(4)], "id long, gene string, value double")
    panel = spark.createDataFrame([(g, f"G{g}") for g in range(4)], "pos long, gene string")
    return obs, expr, panel


def test_leave_one_out_plan_equals_fold_mask(spark):
    obs, expr, panel = small_study(spark)
    plan = splits.leave_one_out_plan(obs.select("sample_id").distinct()).select(F.col("fold_index").cast("int").alias("fold"), "sample_id", "role")
    by_mask, summary = evaluation.cross_validate(obs, expr, panel, 3)
    by_plan, _ = evaluation.cross_validate(obs, expr, panel, 3, plan=plan)
    key = lambda df: [(r["fold"], round(r["overall_pearson"], 9), round(r["mean_spot_pearson"], 9)) for r in df.orderBy("fold").collect()]
    assert key(by_mask) == key(by_plan)
    assert summary.first()["num_folds"] == 4
    done = by_mask.where("fold < 3")
    rest, whole = evaluation.cross_validate(obs, expr, panel, 3, done=done)
    assert [r["fold"] for r in rest.collect()] == [3] and whole.first()["num_folds"] == 4


def test_query_sampling_and_external_rows(spark):
    obs, expr, panel = small_study(spark)
    row = evaluation.evaluate_retrieval(obs, obs, expr, panel, 1, max_queries=10, seed=1).first()
    assert row["num_cells"] == 10 and row["overall_pearson"] == pytest.approx(1.0)  # each query finds itself
    overall, rows = evaluation.evaluate_external(obs, obs.where("id < 20"), expr, panel, 2)
    assert overall.first()["num_spots"] == 20 and [r["sample_id"] for r in rows.collect()] == ["S0", "S1", "S2", "S3"]


def test_layer_report_order_and_deltas(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(48, 3)) + np.repeat([[0.0], [2.0]], 24, axis=0)
    df = points(spark, x, platform=["visium"] * 24 + ["xenium"] * 24)
    rows = df.withColumn("model", F.lit("m")).withColumn("stage", F.lit("final_embedding")).unionByName(
        df.withColumn("vec", F.reverse("vec")).withColumn("model", F.lit("m")).withColumn("stage", F.lit("stem")))
    table, deltas = reports.layerwise_gap_report(rows, k=5)
    assert [r["stage"] for r in table.collect()] == [STAGE_ORDER[0], STAGE_ORDER[-1]]
    got = {r["metric"]: r["delta"] for r in deltas.collect()}
    # The same cloud with its axes reversed: distances do not change.
    assert got["silhouette"] == pytest.approx(0.0, abs=1e-9) and set(got) >= {"centroid_distance", "platform_auc"}


def test_crops_of_equal_cell_ids_stay_with_their_sample(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    outlines = spark.createDataFrame([("t", s, 1, 0.5, square) for s in ("A", "B")], "technology string, sample_id string, cell_id long, pixel_size_um double, vertices array<struct<x:double,y:double>>")
    pixels = spark.createDataFrame([(s, 1, y, x, v, v, v) for s, v in (("A", 0), ("B", 255)) for y in range(2) for x in range(2)], "sample_id string, crop_id long, y int, x int, r int, g int, b int")
    totals = spark.createDataFrame([("A", 1), ("B", 1)], "sample_id string, total long")
    records = reports.cell_morphology_report(outlines, pixels, totals, with_separation=False)["records"]
    assert {r["sample_id"]: r["gray_mean"] for r in records.collect()} == {"A": 0.0, "B": 1.0}


def test_pooled_correlation_leaves_out_half_empty_pairs(spark):
    rows = [(1, "a", 1.0, 2.0), (1, "b", None, 5.0), (2, "a", 3.0, 1.0), (2, "b", 4.0, None), (3, "b", 2.0, 2.5), (3, "a", 0.5, 4.0)]
    pairs = spark.createDataFrame(rows, "entity_id int, gene string, pred double, target double")
    from spotloom.operators import metrics

    assert metrics.pearson_summary(pairs).first()["overall_pearson"] == pytest.approx(metrics.pearson_overall(pairs).first()[0])


def test_caps_hold_for_each_sample(spark):
    rows = spark.createDataFrame([(s, i) for s, n in (("A", 9), ("B", 4), ("C", 1)) for i in range(n)], "sample_id string, spot_id int")
    kept = splits.sample_n_per(rows, ["sample_id"], 3, 0, "spot_id").groupBy("sample_id").count().collect()
    assert {r["sample_id"]: r["count"] for r in kept} == {"A": 3, "B": 3, "C": 1}


@pytest.mark.parametrize("rho", [None, 2.0])
def test_sinkhorn_over_sliced_blocks(spark, monkeypatch, rho):
    """Blocks grow with a side, so that few copies of them are shuffled, and are worked through in slices."""
    rng = np.random.default_rng(5)
    a, b = ([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 6)))] for n in (60, 45))
    sides = [spark.createDataFrame(s, "id long, vec array<double>") for s in (a, b)]
    whole = transport.sinkhorn_cost(*sides, 0.5, 5, rho).first()[0]
    monkeypatch.setattr(transport, "SLICE", 7)
    monkeypatch.setattr(transport, "BLOCKS", 2)
    monkeypatch.setattr(transport, "MOST", 32)
    packed, made = transport._packed, []
    monkeypatch.setattr(transport, "_packed", lambda points, name, blocks: made.append(blocks) or packed(points, name, blocks))
    assert transport.sinkhorn_cost(*sides, 0.5, 5, rho, block=8).first()[0] == pytest.approx(whole, rel=1e-9)
    assert made == [2, 2]


def test_tables_of_cells_are_merged_not_broadcast(spark, monkeypatch):
    plans = []

    def kept(df, stage=reports.stage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(reports, "stage", kept)
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    outlines = spark.createDataFrame([("t", "A", i, 0.5, square) for i in range(3)], "technology string, sample_id string, cell_id long, pixel_size_um double, vertices array<struct<x:double,y:double>>")
    pixels = spark.createDataFrame([("A", i, y, x, 51 * i, 51 * i, 51 * i) for i in range(3) for y in range(2) for x in range(2)], "sample_id string, crop_id long, y int, x int, r int, g int, b int")
    totals = spark.createDataFrame([("A", 9)], "sample_id string, total long")
    records = reports.cell_morphology_report(outlines, pixels, totals, with_separation=False)["records"]
    assert {r["cell_id"]: round(r["gray_mean"], 6) for r in records.collect()} == {0: 0.0, 1: 0.2, 2: 0.4}
    assert len(plans) == 2 and plans[1].count("SortMergeJoin") == 2 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("searched", [4, 0])
def test_spots_from_cells_gather_only_the_genes_asked_for(spark, monkeypatch, searched):
    from spotloom.plans import evaluation

    monkeypatch.setattr(evaluation, "SEARCHED", searched)
    rng = np.random.default_rng(31)
    x, values = rng.normal(size=(12, 3)), rng.normal(size=(12, 5))
    bank = points(spark, x)
    expr = spark.createDataFrame([(i, f"G{g}", float(values[i, g])) for i in range(12) for g in range(5)], "id long, gene string, value double")
    panel = spark.createDataFrame([(g, f"G{g}") for g in range(5)], "pos long, gene string")
    spots = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 10.0, 0.0), ("t", 1, 0.0, 0.0)], "sample_id string, spot_id long, center_x double, center_y double")
    cells = [("s", 1, 0.5), ("s", 2, 1.0), ("s", 3, 10.5), ("t", 1, 0.1), ("t", 9, 90.0)]
    asked = rng.normal(size=(5, 3))
    at = spark.createDataFrame([(s, c, px, 0.0) for s, c, px in cells], "sample_id string, cell_id long, centroid_x double, centroid_y double")
    twice = [0, 1, 1, 2, 3, 4]  # one cell has two rows
    vecs = spark.createDataFrame([(*cells[i][:2], asked[i].tolist()) for i in twice], "sample_id string, cell_id long, vec array<double>")
    stored = spark.createDataFrame([("s", 1, "G1", 3), ("s", 2, "G2", 4), ("t", 1, "G4", 5)], "sample_id string, spot_id long, gene string, cnt long")
    seen, predict = [], retrieval.predict

    def watched(matches, expression, *a, **o):
        seen.append(expression)
        return predict(matches, expression, *a, **o)

    monkeypatch.setattr(evaluation.retrieval, "predict", watched)
    pairs, _, _ = evaluation.infer_spots_from_cells(spots, at, stored, bank, expr, vecs, panel, radius=3.0, k=3)
    assert {r["gene"] for r in seen[0].select("gene").distinct().collect()} == {"G1", "G2", "G4"}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit(asked) @ unit(x).T
    total = {}
    for i in twice[:-1]:
        near = np.argsort(-score[i])[:3]
        w = np.exp(score[i][near]) / np.exp(score[i][near]).sum()
        key = ("s", 1 if i < 2 else 2) if i < 3 else ("t", 1)
        for g in (1, 2) if key[0] == "s" else (4,):
            total[(*key, f"G{g}")] = total.get((*key, f"G{g}"), 0.0) + np.expm1(w @ values[near, g])
    got = {(r["sample_id"], r["entity_id"], r["gene"]): r["pred"] for r in pairs.collect()}
    assert got == {k: pytest.approx(np.log1p(max(v, 0.0)), abs=1e-12) for k, v in total.items()}
