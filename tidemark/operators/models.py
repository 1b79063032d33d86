"""Predictors over example frames: identity, ridge (normal equations from one aggregation), gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)


@dataclass(frozen=True)
class Moments:
    """All that ridge needs of its training rows: means, scales and the Gram matrix of the standardised features."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray
    right: np.ndarray
    target_mean: float
    n: int


def identity(rows: DataFrame, feature: str) -> DataFrame:
    """The feature itself as the prediction."""
    return rows.withColumn("prediction", F.col(feature))


def _standard(c: str, mean: float, scale: float) -> Column:
    """Standardised by the training rows; missing values are the mean, that is 0."""
    v = F.when(F.isnan(c), None).otherwise(F.col(c))
    return F.coalesce((v - F.lit(float(mean))) / F.lit(float(scale)), F.lit(0.0))


def moments(train: DataFrame, features: Sequence[str], target: str = "target") -> Moments:
    """Two passes over the training rows; (k + 1) (k + 2) / 2 numbers come to the driver, whatever their number."""
    train = train.filter(F.col(target).isNotNull())
    clean = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("y"), *[F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(features)], *[F.count(clean(c)).alias(f"c{i}") for i, c in enumerate(features)]).first()
    if not stats["n"]:
        raise ValueError("no training rows")
    empty = [c for i, c in enumerate(features) if not stats[f"c{i}"]]
    if empty:
        raise ValueError(f"features without any value: {empty}")
    k = len(features)
    mean = np.array([stats[f"m{i}"] for i in range(k)])
    # missing values stand at the mean when the spread is taken, as they do when they are used
    spread = train.agg(*[F.sqrt(F.avg(F.pow(F.coalesce(clean(c), F.lit(float(mean[i]))) - float(mean[i]), 2))).alias(f"s{i}") for i, c in enumerate(features)]).first() if k else []
    scale = np.array([s if s > 0 else 1.0 for s in spread], float)
    x = [_standard(c, mean[i], scale[i]) for i, c in enumerate(features)]
    y = F.col(target) - F.lit(float(stats["y"]))
    z = train.select(*[e.alias(f"x{i}") for i, e in enumerate(x)], y.alias("y"))
    sums = z.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"r{i}") for i in range(k)], F.count(F.lit(1)).alias("n")).first()
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"]
    return Moments(tuple(features), mean, scale, gram, np.array([sums[f"r{i}"] for i in range(k)]), float(stats["y"]), int(stats["n"]))


def ridge_weights(m: Moments, penalty: float) -> np.ndarray:
    """(Gram + penalty I)^-1 right: the intercept is the target's mean, unpenalised."""
    return np.linalg.solve(m.gram + penalty * np.eye(len(m.features)), m.right)


def ridge_predict(rows: DataFrame, m: Moments, weights: np.ndarray) -> DataFrame:
    p = F.lit(m.target_mean)
    for c, mean, scale, w in zip(m.features, m.mean, m.scale, weights):
        p = p + F.lit(float(w)) * _standard(c, mean, scale)
    return rows.withColumn("prediction", p)


def tune_ridge(train: DataFrame, valid: DataFrame, features: Sequence[str], penalties: Sequence[float] = PENALTIES, target: str = "target") -> tuple[Moments, float, dict[float, float]]:
    """One Gram matrix serves all penalties, one pass over the validation rows scores them; of equal losses the larger penalty."""
    m = moments(train, features, target)
    loss = []
    for i, p in enumerate(penalties):
        w = ridge_weights(m, p)
        e = F.lit(m.target_mean)
        for c, mean, scale, wi in zip(m.features, m.mean, m.scale, w):
            e = e + F.lit(float(wi)) * _standard(c, mean, scale)
        loss.append(F.avg(F.abs(e - F.col(target))).alias(f"p{i}"))
    got = valid.filter(F.col(target).isNotNull()).agg(*loss).first()
    found = {p: got[f"p{i}"] for i, p in enumerate(penalties)}
    best = min(penalties, key=lambda p: (found[p], -p))
    return m, best, found


def boosted_trees(train: DataFrame, rows: DataFrame, features: Sequence[str], target: str = "target", depth: int = 5, rounds: int = 50, seed: int = 1) -> DataFrame:
    """Spark ML's gradient-boosted trees (missing values at the training mean)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    m = moments(train, features, target)
    ready = lambda df: VectorAssembler(inputCols=[f"_s{i}" for i in range(len(features))], outputCol="_x").transform(df.withColumns({f"_s{i}": _standard(c, m.mean[i], m.scale[i]) for i, c in enumerate(features)}))
    model = GBTRegressor(featuresCol="_x", labelCol=target, maxDepth=depth, maxIter=rounds, seed=seed).fit(ready(train.filter(F.col(target).isNotNull())))
    return model.transform(ready(rows)).drop("_x", *[f"_s{i}" for i in range(len(features))])


def greedy_selection(train: DataFrame, valid: DataFrame, candidates: Sequence[str], most: int, penalty: float = 1.0, budget: int = 10_000, target: str = "target") -> list[str]:
    """Forward selection by validation error of ridge: each round adds the strictly best candidate, ties by name.

    All training sums come from one Gram matrix over every candidate; a round scores its candidates in one pass.
    """
    m = moments(train, candidates, target)
    chosen: list[int] = []
    best, spent = float("inf"), 0
    valid = valid.filter(F.col(target).isNotNull())
    while len(chosen) < most:
        left = [i for i in range(len(candidates)) if i not in chosen][: max(0, budget - spent)]
        if not left:
            break
        losses = []
        for i in left:
            s = [*chosen, i]
            w = np.linalg.solve(m.gram[np.ix_(s, s)] + penalty * np.eye(len(s)), m.right[s])
            e = F.lit(m.target_mean)
            for j, wj in zip(s, w):
                e = e + F.lit(float(wj)) * _standard(m.features[j], m.mean[j], m.scale[j])
            losses.append(F.avg(F.abs(e - F.col(target))).alias(f"l{i}"))
        got = valid.agg(*losses).first()
        spent += len(left)
        i = min(left, key=lambda i: (got[f"l{i}"], candidates[i]))
        if not got[f"l{i}"] < best:
            break
        best, chosen = got[f"l{i}"], [*chosen, i]
    return [candidates[i] for i in chosen]


def random_selection(train: DataFrame, valid: DataFrame, candidates: Sequence[str], most: int, tries: int, penalty: float = 1.0, seed: int = 1, target: str = "target") -> list[str]:
    """The best of ``tries`` random subsets (one pass over the validation rows)."""
    rng = np.random.default_rng(seed)
    m = moments(train, candidates, target)
    subsets = [sorted(rng.choice(len(candidates), size=int(rng.integers(1, min(most, len(candidates)) + 1)), replace=False)) for _ in range(tries)]
    losses = []
    for n, s in enumerate(subsets):
        w = np.linalg.solve(m.gram[np.ix_(s, s)] + penalty * np.eye(len(s)), m.right[s])
        e = F.lit(m.target_mean)
        for j, wj in zip(s, w):
            e = e + F.lit(float(wj)) * _standard(m.features[j], m.mean[j], m.scale[j])
        losses.append(F.avg(F.abs(e - F.col(target))).alias(f"l{n}"))
    got = valid.filter(F.col(target).isNotNull()).agg(*losses).first()
    n = min(range(tries), key=lambda n: (got[f"l{n}"], n))
    return [candidates[i] for i in subsets[n]]
