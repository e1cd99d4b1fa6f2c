"""The costly parts of the reports run as queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["job_10_separation", "job_11_separation"])
def test_separation(spark, name):
    (row,) = contract.queries()[name](spark, SF).collect()
    assert -1 <= row.silhouette <= 1 and 0 <= row.same_label_knn_fraction <= 1 and row.pca_components > 0


def test_layers_have_auc_and_deltas(spark):
    table = {r.stage: r for r in contract.queries()["job_14_layerwise_gap_report"](spark, SF).collect()}
    assert set(table) == {"stem", "final_embedding"} and all(0 <= r.platform_auc <= 1 for r in table.values())
    deltas = {r.metric: r.delta for r in contract.queries()["job_14_deltas"](spark, SF).collect()}
    assert len(deltas) == 5
    for name, delta in deltas.items():
        assert delta == pytest.approx(table["final_embedding"][name] - table["stem"][name], abs=2e-3), name


def test_transport_runs_its_default_iterations(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    a, b = (np.array([r.embedding for r in rows if r.label % 2 == side], dtype=float) for side in (0, 1))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cost = 1 - np.clip(unit(a) @ unit(b).T, -1, 1)
    kernel, n, m = np.maximum(np.exp(-cost / 0.5), 1e-8), len(a), len(b)
    want = {}
    for form, power in (("balanced", 1.0), ("unbalanced", 2 / 2.5)):
        v = np.ones(m)
        for _ in range(50):
            u = (1 / n / np.maximum(kernel @ v, 1e-8)) ** power
            v = (1 / m / np.maximum(kernel.T @ u, 1e-8)) ** power
        plan = u[:, None] * kernel * v
        want[form] = (plan * cost).sum()
        if form == "unbalanced":
            for mass, ref in ((plan.sum(axis=1), 1 / n), (plan.sum(axis=0), 1 / m)):
                x = np.maximum(mass, 1e-8)
                want[form] += 2 * (x * (np.log(x) - np.log(ref)) - x + ref).sum()
    found = {r.form: r.transport_cost for r in contract.queries()["agg_31_sinkhorn_cost"](spark, SF).collect()}
    assert found == pytest.approx(want, abs=2e-5)


def standard(x):
    spread = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)


def principal(x, k=None):
    """Scores on the principal components by singular values, signs fixed by the largest coefficient, and their share."""
    z = standard(np.asarray(x, dtype=float))
    k = k or max(2, min(32, len(z) - 1, z.shape[1]))
    _, s, axes = np.linalg.svd(z, full_matrices=False)
    axes = axes[:k] * np.sign(axes[np.arange(k), np.abs(axes[:k]).argmax(axis=1)])[:, None]
    return z @ axes.T, (s[:k] ** 2).sum() / (s ** 2).sum()


def distances(x):
    return np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))


def plain_silhouette(x, label):
    d, scores = distances(x), []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][label == other].mean() for other in set(label) - {label[i]})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


def plain_share(x, label, k):
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return (label[near] == label[:, None]).mean()


def test_default_components_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    scores, share = principal([r.embedding for r in rows])
    found = {r.id: r for r in contract.queries()["vec_05_pca_default"](spark, SF).collect()}
    for r, z in zip(rows, scores):
        got = found[r.vec_id]
        assert (got.squared_length, got.explained, got.pca_components) == (pytest.approx((z * z).sum(), abs=2e-4), pytest.approx(share, abs=2e-4), scores.shape[1])


def test_components_of_every_group_and_separation_against_numpy(spark):
    from spotloom.operators import features
    from spotloom.plans import reports

    rng = np.random.default_rng(12)
    parts = {g: rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6)) + shift for g, n, shift in (("a", 60, 0), ("b", 25, 50))}
    parts["a"][:, 3] = 7.0  # a constant dimension
    rows = [(g, i, [float(v) for v in x], "u" if i % 3 else "v") for g, m in parts.items() for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>, label string")
    projected, info = features.pca(df, 3, by=("g",))
    shares = {r.g: (r.pca_components, r.pca_explained_variance_ratio_sum) for r in info.collect()}
    for g, m in parts.items():
        scores, share = principal(m, 3)
        got = np.array([r.vec for r in projected.where(f"g = '{g}'").orderBy("id").collect()])
        assert got == pytest.approx(scores, abs=1e-8) and shares[g] == (3, pytest.approx(share))
    label = np.array(["u" if i % 3 else "v" for i in range(60)])
    scores, share = principal(parts["a"])
    (row,) = reports.separation(df.where("g = 'a'").drop("g"), "label", 5).collect()
    assert row.silhouette == pytest.approx(plain_silhouette(scores, label)) and row.same_label_knn_fraction == pytest.approx(plain_share(scores, label, 5))
    assert (row.pca_components, row.pca_explained_variance_ratio_sum) == (scores.shape[1], pytest.approx(share))


def test_alignment_report_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    found = {r.model: r for r in contract.queries()["job_13_embedding_alignment_report"](spark, SF).collect()}
    assert set(found) == {"m1", "m2"}
    for model, rest in (("m1", 0), ("m2", 1)):
        chosen = [r for r in rows if r.vec_id % 2 == rest]
        x, share = principal([r.embedding for r in chosen])
        label = np.array(["visium" if r.label % 2 == 0 else "xenium" for r in chosen])
        got, one, other = found[model], x[label == "visium"], x[label == "xenium"]
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        assert got.silhouette == pytest.approx(plain_silhouette(x, label), abs=1e-4)
        assert got.same_label_knn_fraction == pytest.approx(plain_share(x, label, 15), abs=1e-4)
        assert got.centroid_distance == pytest.approx(np.linalg.norm(one.mean(axis=0) - other.mean(axis=0)), abs=1e-4)
        assert got.cross_domain_mean_cosine == pytest.approx((unit(one) @ unit(other).T).mean(), abs=1e-4)


def plain_auc(x, y, ids, seed=0, c=1.0):
    import hashlib

    folds = max(2, min(5, *np.bincount(y)))
    fold = np.zeros(len(y), dtype=int)
    for value in (0, 1):
        order = sorted(np.flatnonzero(y == value), key=lambda i: (hashlib.md5(f"{ids[i]}|{seed}".encode()).hexdigest(), ids[i]))
        fold[order] = np.arange(len(order)) % folds
    aucs = []
    for f in range(folds):
        train = np.column_stack([x[fold != f], np.ones((fold != f).sum())])
        w, t = np.zeros(train.shape[1]), y[fold != f]
        penalty = np.append(np.full(x.shape[1], 1 / c), 0.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-train @ w))
            w -= np.linalg.solve((train * (p * (1 - p))[:, None]).T @ train + np.diag(penalty), train.T @ (p - t) + penalty * w)
        s, t = np.column_stack([x[fold == f], np.ones((fold == f).sum())]) @ w, y[fold == f]
        aucs.append(np.mean([(a > b) + 0.5 * (a == b) for a in s[t == 1] for b in s[t == 0]]))
    return np.mean(aucs)


def test_classifiers_of_all_groups_against_numpy(spark):
    from spotloom.operators import features

    rng = np.random.default_rng(15)
    rows, want = [], {}
    for g, n, lift in (("near", 90, 0.6), ("far", 40, 3.0), ("few", 7, 1.0)):
        y = (np.arange(n) % 3 == 0).astype(int)
        x = rng.normal(size=(n, 4)) + lift * y[:, None]
        rows += [(g, i, [float(v) for v in z], "q" if t else "p") for i, (z, t) in enumerate(zip(x, y))]
        want[g] = plain_auc(x, y, list(range(n)))
    rows += [("near", 900, [0.0] * 4, None), ("one", 1, [1.0] * 4, "p"), ("one", 2, [2.0] * 4, "p")]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>, label string")
    got = {r.g: r.platform_auc for r in features.platform_auc(df, "label", by=("g",)).collect()}
    assert got == {g: pytest.approx(v, abs=1e-6) for g, v in want.items()} | {"one": None}
    alone = features.platform_auc(df.where("g = 'far'").drop("g"), "label").first()[0]
    assert alone == pytest.approx(want["far"], abs=1e-6)


@pytest.mark.parametrize("n", [1, 7, 300, 999, 1000, 2000])
def test_samples_by_threshold_equal_the_first_by_hash(spark, n):
    import hashlib

    from spotloom.operators import splits

    df = spark.range(1000).unionByName(spark.range(3)).withColumn("x", F.rand(1))
    key = lambda i: hashlib.md5(f"{i}|7".encode()).hexdigest()
    want = sorted([*range(1000), 0, 1, 2], key=key)[:n]
    for held in (4096, 3):
        out = splits.sample_n(df, n, 7, "id", held=held)
        assert sorted(r.id for r in out.collect()) == sorted(want)
        assert "TakeOrderedAndProject" not in out._jdf.queryExecution().executedPlan().toString()


def test_exact_median_computes_its_values_once(spark):
    """Cuts, totals, ranks and sizes read staged counts, not the expression behind the values."""
    from spotloom.operators import ranking

    rows = spark.range(101).select((F.col("id") % 2).alias("g"), F.udf(lambda i: float(i * i), "double")("id").alias("costly"))
    found = ranking.exact_median(rows, ["g"], "costly", "m")
    assert "<lambda>" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == {(0, 2500.0), (1, 2501.0)}
