"""Forests and boosted trees tuned in full: hundreds of trees, every fold and every grid point at once.

Tuning fits one model per grid point and fold. Fitted one after another, each with a pass over the
rows per tree level, that is tens of thousands of passes. Here the rows are read once: predictors are
binned at quantiles of the training rows and counted as cells (bins, fold, label). Five predictors of
BINS bins have at most BINS ** 5 cells, about a million, however many rows there are, so the cells go
to every executor. A task then grows a block of trees of one (grid point, fold), or boosts one model,
on the counts of the other folds, and sends back one score per cell. Scores are summed per cell, and
the AUC of a fold comes from its cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowpanel.functions import trees
from flowpanel.operators.adversarial import FOLDS, PREDICTORS, TREES
from flowpanel.session import materialize, spread

BINS = 16
BLOCK_TREES = 25
# Five grid points each, spread over the usual ranges.
FOREST_GRID = [(1, 2), (2, 11), (3, 21), (4, 30), (5, 40)]  # predictors per split, rows of a node that is split
BOOST_GRID = [(3, 0.1), (6, 0.03), (9, 0.01), (12, 0.003), (15, 0.001)]  # depth, learning rate
_TREE = "tree int, feature array<int>, cut array<int>, left array<int>, value array<double>"


@dataclass
class Tuned:
    """The best model of a grid: its trees as a table, the bin edges, cross-validated AUC per point, gains."""

    name: str
    trees: DataFrame
    edges: list[list[float]]
    point: tuple
    auc: list[float]
    gains: list[float]
    predictions: DataFrame


def bin_edges(train: DataFrame, bins: int = BINS) -> list[list[float]]:
    """Upper edges of all bins but the last, per predictor: quantiles of the training rows."""
    at = [k / bins for k in range(1, bins)]
    row = train.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in PREDICTORS]).first()
    return [sorted(set(row[c] or [])) for c in PREDICTORS]


def _bins(edges: list[list[float]]) -> list[Column]:
    """The bin of every predictor: how many edges lie below it. NULL and NaN take the last bin."""
    def bin_of(c: str, own: list[float]) -> Column:
        value = F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
        over = [F.when(value > e, 1).otherwise(0) for e in own]  # NaN is above every number
        return sum(over, F.lit(0)).cast("int")

    return [bin_of(c, e).alias(f"_b{k}") for k, (c, e) in enumerate(zip(PREDICTORS, edges))]


_KEY = [f"_b{k}" for k in range(len(PREDICTORS))]


@dataclass
class _Cells:
    x: np.ndarray  # bins, one row per cell
    zero: np.ndarray  # rows of label 0 by cell and fold
    one: np.ndarray


def _cells(train: DataFrame, edges: list[list[float]], folds: int) -> _Cells:
    """The counted cells of the training rows: at most bins ** predictors of them."""
    rows = train.select(*_bins(edges), "fold", "label")
    sums = [F.sum(F.when((F.col("fold") == k) & (F.col("label") == y), 1).otherwise(0)).alias(f"n{y}_{k}") for y in (0, 1) for k in range(folds)]
    table = rows.groupBy(*_KEY).agg(*sums).orderBy(*_KEY).toPandas()
    counts = [table[[f"n{y}_{k}" for k in range(folds)]].to_numpy(dtype=np.int64) for y in (0, 1)]
    return _Cells(table[_KEY].to_numpy(dtype=np.int64), *counts)


def _fold_scores(scores: DataFrame, cells: _Cells, points: int, folds: int) -> list[float]:
    """Mean AUC per grid point: scores (point, fold, cell, score) of the held-out cells of each fold."""
    spark = scores.sparkSession
    rows = [(c, k, int(cells.zero[c, k]), int(cells.one[c, k])) for c, k in zip(*np.nonzero(cells.zero + cells.one))]
    counts = spark.createDataFrame([(int(c), int(k), a, b) for c, k, a, b in rows], "cell int, fold int, n0 bigint, n1 bigint")
    held = scores.join(counts, ["fold", "cell"])
    found = {r["point"]: r["auc"] for r in auc(held, ["point", "fold"], "score").groupBy("point").agg(F.avg("auc").alias("auc")).collect()}
    return [found.get(p) if found.get(p) is not None else float("nan") for p in range(points)]


def auc(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Area under the ROC curve per key from counts n0 and n1 per score; NULL where a class is missing."""
    tied = df.groupBy(*keys, F.round(score, 12).alias("_s")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    below = F.coalesce(F.sum("n0").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = tied.withColumn("_w", F.col("n1") * (below + F.col("n0") / 2))
    both = F.sum("n0") * F.sum("n1")
    return won.groupBy(*keys).agg((F.sum("_w") / F.when(both > 0, both)).alias("auc"))


def _held_scores(held: np.ndarray, score: np.ndarray, **ids) -> pd.DataFrame:
    """The scores of the cells that hold rows of the fold left out."""
    cells = np.flatnonzero(held)
    return pd.DataFrame({**{k: np.full(len(cells), v) for k, v in ids.items()}, "cell": cells.astype(np.int32), "score": score[cells]})


def _best(scores: list[float]) -> int:
    """The point of the highest mean AUC, the first of equal ones."""
    known = [s if s == s else -1.0 for s in scores]
    return known.index(max(known))


def predict(model: DataFrame, edges: list[list[float]], rows: DataFrame, mean: bool) -> DataFrame:
    """`rows` with p_synthetic: every task walks its trees with the different cells of the rows."""
    spark = rows.sparkSession
    placed = rows.select("*", *_bins(edges))
    different = placed.select(*_KEY).distinct().toPandas()  # cells, bounded as those of the training rows
    x = spark.sparkContext.broadcast(different.to_numpy(dtype=np.int64))

    def walk(batches):
        own = x.value
        total, n = np.zeros(len(own)), 0
        for b in batches:
            for r in b.itertuples(index=False):
                total += trees.walk(tuple(np.asarray(v) for v in (r.feature, r.cut, r.left, r.value)), own)
                n += 1
        if n:
            yield pd.DataFrame({**{c: own[:, k].astype(np.int32) for k, c in enumerate(_KEY)}, "total": total, "n": n})

    sums = model.mapInPandas(walk, ", ".join(f"{c} int" for c in _KEY) + ", total double, n bigint")
    sums = sums.groupBy(*_KEY).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    p = F.col("total") / F.col("n") if mean else 1 / (1 + F.exp(-F.col("total")))
    return placed.join(sums.select(*_KEY, p.alias("p_synthetic")), _KEY, "left").select(*[f"`{c}`" for c in rows.columns], "p_synthetic")


def _with_prediction(scored: DataFrame) -> DataFrame:
    return scored.withColumn("prediction", (F.col("p_synthetic") > 0.5).cast("double"))


def tuned_forest(
    train: DataFrame, test: DataFrame, n_trees: int = TREES, folds: int = FOLDS,
    grid: list[tuple[int, int]] = FOREST_GRID, bins: int = BINS, seed: int = 42,
) -> Tuned:
    """Probability forest tuned over predictors per split and least rows to split, without a depth limit.

    `train` has label and fold, `test` label. A tree depends on (seed, point, fold, number) alone, so
    neither tasks nor retries change it.
    """
    spark = train.sparkSession
    edges = bin_edges(train, bins)
    cells = _cells(train, edges, folds)
    shared = spark.sparkContext.broadcast((cells.x, cells.zero, cells.one))
    blocks = spark.range((n_trees + BLOCK_TREES - 1) // BLOCK_TREES).select(F.col("id").cast("int").alias("block"))

    def grow(point: int, fold: int, block: int):
        x, zero, one = shared.value
        rest = [k for k in range(folds) if k != fold]
        n0, n1 = zero[:, rest].sum(1), one[:, rest].sum(1)
        mtry, least = grid[point]
        for t in range(block * BLOCK_TREES, min((block + 1) * BLOCK_TREES, n_trees)):
            yield t, *trees.forest_tree(x, n0, n1, bins, mtry, least, np.random.default_rng([seed, point, fold + 1, t]))

    def tune(batches):
        for b in batches:
            for point, fold, block in b[["point", "fold", "block"]].itertuples(index=False):
                x, zero, one = shared.value
                total = np.zeros(len(x))
                for _, _, score, _ in grow(point, fold, block):
                    total += score
                yield _held_scores(zero[:, fold] + one[:, fold] > 0, total, point=np.int32(point), fold=np.int32(fold))

    pairs = spark.createDataFrame([(p, k) for p in range(len(grid)) for k in range(folds)], "point int, fold int")
    jobs = spread(pairs.crossJoin(F.broadcast(blocks)), "point", "fold", "block")  # model blocks, not rows
    sums = jobs.mapInPandas(tune, "point int, fold int, cell int, score double")
    found = _fold_scores(sums.groupBy("point", "fold", "cell").agg((F.sum("score") / n_trees).alias("score")), cells, len(grid), folds)
    best = _best(found)

    def final(batches):
        for b in batches:
            for block in b["block"]:
                for t, tree, _, gains in grow(best, -1, block):
                    yield pd.DataFrame({"tree": [t], **{c: [v.tolist()] for c, v in zip(("feature", "cut", "left", "value"), tree)}, "gains": [gains.tolist()]})

    model = materialize(spread(blocks, "block").mapInPandas(final, f"{_TREE}, gains array<double>"), "forest")
    gains = model.agg(*[F.sum(F.get("gains", k)) for k in range(len(PREDICTORS))]).first()
    predictions = _with_prediction(predict(model, edges, test, mean=True))
    return Tuned("random_forest", model, edges, grid[best], found, [float(g or 0) for g in gains], predictions)


def tuned_boosting(
    train: DataFrame, test: DataFrame, rounds: int = TREES, folds: int = FOLDS,
    grid: list[tuple[int, float]] = BOOST_GRID, bins: int = BINS,
) -> Tuned:
    """Boosted trees tuned over depth and learning rate; all folds and points are boosted side by side."""
    spark = train.sparkSession
    edges = bin_edges(train, bins)
    cells = _cells(train, edges, folds)
    shared = spark.sparkContext.broadcast((cells.x, cells.zero, cells.one))

    def boost(point: int, fold: int):
        x, zero, one = shared.value
        rest = [k for k in range(folds) if k != fold]
        return trees.boosted_trees(x, zero[:, rest].sum(1), one[:, rest].sum(1), bins, rounds, *grid[point])

    def tune(batches):
        for b in batches:
            for point, fold in b[["point", "fold"]].itertuples(index=False):
                x, zero, one = shared.value
                _, margin, _ = boost(point, fold)
                yield _held_scores(zero[:, fold] + one[:, fold] > 0, margin, point=np.int32(point), fold=np.int32(fold))

    # One partition per model, the deepest first.
    pairs = spark.createDataFrame([(p, k) for p in reversed(range(len(grid))) for k in range(folds)], "point int, fold int")
    jobs = pairs.repartition(len(grid) * folds)
    found = _fold_scores(jobs.mapInPandas(tune, "point int, fold int, cell int, score double"), cells, len(grid), folds)
    best = _best(found)

    def final(batches):
        for b in batches:
            for _ in range(len(b)):
                own, _, gains = boost(best, -1)
                for t, tree in enumerate(own):
                    row = {"tree": [t], **{c: [v.tolist()] for c, v in zip(("feature", "cut", "left", "value"), tree)}}
                    yield pd.DataFrame({**row, "gains": [(gains if t == 0 else np.zeros_like(gains)).tolist()]})

    model = materialize(spark.range(1).mapInPandas(final, f"{_TREE}, gains array<double>"), "boosted")
    gains = model.agg(*[F.sum(F.get("gains", k)) for k in range(len(PREDICTORS))]).first()
    predictions = _with_prediction(predict(model, edges, test, mean=False))
    return Tuned("boosted_trees", model, edges, grid[best], found, [float(g or 0) for g in gains], predictions)


def metrics(fits: list[Tuned]) -> DataFrame:
    """Hold-out AUC, accuracy and Brier score per model."""
    parts = []
    for fit in fits:
        rows = fit.predictions
        counts = rows.select(F.col("p_synthetic").alias("score"), (1 - F.col("label")).alias("n0"), F.col("label").alias("n1"))
        area = auc(counts.withColumn("model", F.lit(fit.name)), ["model"], "score").select("model", F.lit("roc_auc").alias("metric"), F.col("auc").alias("estimate"))
        hit = F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")
        off = F.avg((F.col("p_synthetic") - F.col("label")) ** 2).alias("brier_class")
        other = rows.agg(hit, off).select(F.lit(fit.name).alias("model"), F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate")) for m in ("accuracy", "brier_class")])))
        parts += [area, other]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importance(fits: list[Tuned]) -> DataFrame:
    """Predictor importances of the model with the higher hold-out AUC, summing to 1; ties go to the last one."""
    areas = {r["model"]: r["estimate"] for r in metrics(fits).where("metric = 'roc_auc'").collect()}
    best = max(reversed(fits), key=lambda fit: areas[fit.name] if areas[fit.name] is not None else -1.0)
    total = sum(best.gains) or 1.0
    rows = [(best.name, c, g / total) for c, g in zip(PREDICTORS, best.gains)]
    return best.predictions.sparkSession.createDataFrame(rows, "model string, feature string, importance double")


def tuning_scores(fits: list[Tuned]) -> DataFrame:
    """Cross-validated AUC of every grid point: `model, point, first, second, auc, chosen`."""
    grids = {"random_forest": FOREST_GRID, "boosted_trees": BOOST_GRID}
    rows = [(f.name, k, float(p[0]), float(p[1]), float(a), p == f.point) for f in fits for k, (p, a) in enumerate(zip(grids[f.name], f.auc))]
    return fits[0].predictions.sparkSession.createDataFrame(rows, "model string, point int, first double, second double, auc double, chosen boolean")
