"""Learned ranking and small classifiers. Judged sets are bounded by a stated limit and fitted on the driver; scoring is columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import score as sc

MAX_JUDGED = 200_000


def feature_table(channels: dict[str, DataFrame]) -> DataFrame:
    """(query_id, doc_id, one column per channel): every channel scaled by its best score of the query; missing scores are 0."""
    out = None
    for name, scores in channels.items():
        part = sc.max_normal(scores.select("query_id", "doc_id", "score")).withColumnRenamed("score", name)
        out = part if out is None else out.join(part, ["query_id", "doc_id"], "full")
    return out.na.fill(0.0, list(channels))


def _mean_ap(x: np.ndarray, y: np.ndarray, groups: list[np.ndarray], w: np.ndarray) -> float:
    total = 0.0
    for g in groups:
        order = g[np.argsort(-(x[g] @ w), kind="stable")]
        rel = y[order] > 0
        if rel.any():
            total += float((np.cumsum(rel)[rel] / (np.flatnonzero(rel) + 1)).sum() / rel.sum())
    return total / max(1, len(groups))


def coordinate_ascent(judged: DataFrame, features: list[str], rounds: int = 4, steps: tuple[float, ...] = (0.05, 0.1, 0.2, 0.4, 0.8, 1.6), seed: int = 1) -> tuple[dict[str, float], float]:
    """(weights, mean average precision) fitted on rows (query_id, features..., grade), at most MAX_JUDGED of them."""
    rows = judged.select("query_id", "grade", *features).limit(MAX_JUDGED + 1).toPandas()
    if len(rows) > MAX_JUDGED:
        raise ValueError(f"more than {MAX_JUDGED} judged rows, the stated bound")
    x, y = rows[features].to_numpy(float), rows["grade"].to_numpy()
    groups = [g for g in rows.groupby("query_id").indices.values() if (y[g] > 0).any()]
    w = np.ones(len(features)) / max(1, len(features))
    best = _mean_ap(x, y, groups, w)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(features)):
            for d in (*steps, *(-s for s in steps)):
                v = w.copy()
                v[i] += d
                got = _mean_ap(x, y, groups, v)
                if got > best + 1e-12:
                    best, w = got, v
    return dict(zip(features, w.tolist())), best


def folds(key: Column, k: int) -> Column:
    """The fold of a query, by a hash that any run repeats."""
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the intercept last, by iteratively reweighted least squares with a ridge on the slopes."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(h, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic_score(features: list[str], weights: np.ndarray) -> Column:
    z = sum((F.col(f) * float(w) for f, w in zip(features, weights)), F.lit(float(weights[-1])))
    return 1 / (1 + F.exp(-z))


def grid_best(predictions: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, f1): the threshold of the best F1, the smallest of equals; the grid is spread as rows over one pass."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    rows = predictions.select(F.col(score).alias("s"), F.col(truth).alias("y"), t)
    hit = F.col("s") >= F.col("threshold")
    c = lambda x: F.sum(x.cast("long"))
    by = rows.groupBy("threshold").agg(c(hit & F.col("y")).alias("tp"), c(hit & ~F.col("y")).alias("fp"), c(~hit & F.col("y")).alias("fn"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return by.select("threshold", F.round(f1, 9).alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)
