"""Forests and boosted trees on counted cells, against rows taken one by one."""

import numpy as np
import pytest
from flowpanel.functions import trees
from flowpanel.operators import adversarial, forests
from pyspark.sql import functions as F


def cells(rng, n=300, p=5, width=16):
    x = rng.integers(0, width, (n, p))
    signal = x[:, 0] + 3 * (x[:, 1] > 8)
    n1 = rng.poisson(np.clip(signal / 6, 0.1, 3))
    return x, rng.poisson(np.clip(3 - signal / 6, 0.1, 3)), n1


def test_forest_tree_splits_until_pure():
    rng = np.random.default_rng(1)
    x, n0, n1 = cells(rng)
    tree, value, gains = trees.forest_tree(x, n0, n1, 16, 5, 2, np.random.default_rng([1, 2]))
    w = np.random.default_rng([1, 2])
    w0, w1 = w.poisson(n0), w.poisson(n1)
    feature, cut, left, share = tree
    assert np.allclose(trees.walk(tree, x), value) and (gains >= 0).all() and gains.argmax() in (0, 1)
    leaf = np.zeros(len(x), dtype=int)
    while (feature[leaf] >= 0).any():
        on = feature[leaf] >= 0
        leaf[on] = left[leaf[on]] + (x[on, feature[leaf[on]]] > cut[leaf[on]])
    for k in set(leaf):
        here = leaf == k
        a, b = w0[here].sum(), w1[here].sum()
        if a + b:
            assert share[k] == pytest.approx(b / (a + b))
            # A leaf with both labels has no cut that lowers the impurity.
            for f in range(5):
                for c in range(15):
                    low = here & (x[:, f] <= c)
                    p, q = w0[low].sum(), w1[low].sum()
                    parts = sum(2 * u * v / max(u + v, 1) for u, v in ((p, q), (a - p, b - q)))
                    assert 2 * a * b / (a + b) - parts < 1e-8


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x, n0, n1 = cells(rng, 80)
    one, margin, _ = trees.boosted_trees(x, n0, n1, 16, 1, 1, 0.5)
    feature, cut, left, value = one[0]
    n = n0 + n1
    g, h = n * 0.5 - n1, n * 0.25
    def worth(m):
        return g[m].sum() ** 2 / (h[m].sum() + 1) / 2 if h[m].sum() >= 1 else -np.inf
    best = max(((worth(x[:, f] <= c) + worth(x[:, f] > c), -f, -c) for f in range(5) for c in range(15)))
    assert (feature[0], cut[0]) == (-best[1], -best[2])
    side = x[:, feature[0]] <= cut[0]
    assert value[left[0]] == pytest.approx(-0.5 * g[side].sum() / (h[side].sum() + 1))
    assert np.allclose(margin, np.where(side, value[left[0]], value[left[0] + 1]))


def test_boosting_lowers_the_loss():
    rng = np.random.default_rng(5)
    x, n0, n1 = cells(rng)
    def loss(margin):
        return np.sum(n0 * np.log1p(np.exp(margin)) + n1 * np.log1p(np.exp(-margin)))
    found = [loss(trees.boosted_trees(x, n0, n1, 16, r, 3, 0.1)[1]) for r in (0, 1, 5, 20, 60)]
    assert all(a > b for a, b in zip(found, found[1:]))
    own, margin, _ = trees.boosted_trees(x, n0, n1, 16, 7, 3, 0.1)
    assert np.allclose(sum(trees.walk(t, x) for t in own), margin)


def rows(spark, n=600):
    data = [("Real" if i % 2 == 0 else "Synthetic", f"h{i}", *np.random.default_rng([7, i]).random(5).tolist()) for i in range(n)]
    df = spark.createDataFrame(data, "source string, home_id string, u0 double, u1 double, u2 double, u3 double, u4 double")
    shift = F.when(F.col("source") == "Synthetic", 0.5).otherwise(0.0)
    return df.select("source", "home_id", (F.col("u0") + shift).alias("mean_usage"), *[F.col(f"u{k}").alias(c) for k, c in enumerate(adversarial.PREDICTORS) if k])


@pytest.fixture(scope="module")
def fits(spark):
    train, test = adversarial.split_and_fold(rows(spark), 4)
    forest = forests.tuned_forest(train, test, n_trees=30, folds=4, grid=[(1, 2), (5, 30)])
    boosted = forests.tuned_boosting(train, test, rounds=25, folds=4, grid=[(3, 0.1), (2, 0.001)])
    return train, test, forest, boosted


def plain_auc(scored):
    pos, neg = [r["p_synthetic"] for r in scored if r["label"]], [r["p_synthetic"] for r in scored if not r["label"]]
    return np.mean([(a > b) + 0.5 * (abs(a - b) < 1e-9) for a in pos for b in neg])


def test_metrics_and_importance(fits):
    _, test, forest, boosted = fits
    found = {(r["model"], r["metric"]): r["estimate"] for r in forests.metrics([forest, boosted]).collect()}
    for fit in (forest, boosted):
        scored = fit.predictions.collect()
        assert len(scored) == test.count() == 120
        assert found[fit.name, "roc_auc"] == pytest.approx(plain_auc(scored), abs=1e-6) and found[fit.name, "roc_auc"] > 0.75
        assert found[fit.name, "accuracy"] == pytest.approx(np.mean([(r["p_synthetic"] > 0.5) == bool(r["label"]) for r in scored]))
        assert found[fit.name, "brier_class"] == pytest.approx(np.mean([(r["p_synthetic"] - r["label"]) ** 2 for r in scored]))
        assert fit.trees.count() == {"random_forest": 30, "boosted_trees": 25}[fit.name] and all(0.5 < a <= 1 for a in fit.auc)
    weights = forests.importance([forest, boosted]).collect()
    assert sum(r["importance"] for r in weights) == pytest.approx(1) and max(weights, key=lambda r: r["importance"])["feature"] == "mean_usage"
    assert [r["feature"] for r in weights] == adversarial.PREDICTORS


def test_cross_validation_leaves_the_fold_out(spark, fits):
    """The scores of a fold come from trees that never saw it: grown again on rows of the other folds."""
    train, _, forest, _ = fits
    edges = forests.bin_edges(train)
    data = train.select(*forests._bins(edges), "fold", "label").toPandas()
    x = np.unique(data[forests._KEY].to_numpy(), axis=0)
    key = {tuple(r): k for k, r in enumerate(x.tolist())}
    data["cell"] = [key[tuple(r)] for r in data[forests._KEY].to_numpy().tolist()]
    areas = []
    for fold in range(4):
        rest, held = data[data["fold"] != fold], data[data["fold"] == fold]
        n0, n1 = (np.bincount(rest[rest["label"] == y]["cell"], minlength=len(x)) for y in (0, 1))
        score = sum(trees.forest_tree(x, n0, n1, 16, 1, 2, np.random.default_rng([42, 0, fold + 1, t]))[1] for t in range(30)) / 30
        areas.append(plain_auc([{"p_synthetic": score[c], "label": y} for c, y in zip(held["cell"], held["label"])]))
    assert forest.auc[0] == pytest.approx(np.mean(areas), abs=1e-6)


def test_partitions_do_not_change_the_model(spark, fits):
    train, test, forest, _ = fits
    again = forests.tuned_forest(train.repartition(7), test.repartition(3), n_trees=30, folds=4, grid=[(1, 2), (5, 30)])
    a, b = ({r["home_id"]: round(r["p_synthetic"], 9) for r in f.predictions.collect()} for f in (forest, again))
    assert a == b and again.point == forest.point


def test_missing_predictors_and_empty_folds(spark):
    df = rows(spark, 60).withColumn("max_peak", F.when(F.col("home_id") == "h3", F.lit(None)).when(F.col("home_id") == "h4", float("nan")).otherwise(F.col("max_peak")))
    train, test = adversarial.split_and_fold(df, 10)
    train = train.where("fold <> 7")
    fit = forests.tuned_forest(train, test, n_trees=10, grid=[(2, 2)])
    assert fit.predictions.where("p_synthetic is null").count() == 0 and fit.auc[0] == fit.auc[0]
    boosted = forests.tuned_boosting(train, test.limit(0), rounds=3, grid=[(2, 0.1)])
    assert boosted.predictions.count() == 0
