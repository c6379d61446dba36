"""Fitting the scorer: logistic regression by full-batch gradient descent, all rows of each step summed in the cluster.

The gradient of a step is a sum over rows. Rows are kept as blocks of features; each step is one aggregation of d + 1
numbers a block. Where all rows are few, one task runs all steps, which gives the same numbers without the steps' cost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.measures import l2_for_shrink, penalty_shrink
from lexmill.operators.ranking import FEATURES, Weights

STEPS, RATE, LEAST_EFFECT, LEAST_SCALE = 2_000, 0.1, 0.1, 1e-6
#: rows up to which one task runs all steps
ONE_TASK = 200_000


def _descend(z: np.ndarray, y: np.ndarray, l2: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    w, b, n = np.zeros(z.shape[1]), 0.0, max(len(z), 1)
    for _ in range(steps):
        m = z @ w + b
        e = np.exp(-np.abs(m))
        err = np.where(m >= 0, 1 / (1 + e), e / (1 + e)) - y
        w = w - rate * (z.T @ err / n + l2 * w / n)
        b -= rate * err.mean()
    return w, b


def fit(rows: DataFrame, label: str = "label", l2: float = 1.0, shrink: float | None = None, steps: int = STEPS, rate: float = RATE, features: tuple[str, ...] = FEATURES) -> Weights:
    """Weights from rows of features and a 0/1 label. A penalty that would do nothing, or diverge, is refused."""
    aggs = [a for c in features for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    st = rows.agg(F.count("*").alias("n"), *aggs).first()
    n = st["n"]
    if not n:
        raise ValueError("no rows to fit")
    mean = np.array([st[f"m_{c}"] for c in features])
    std = np.array([st[f"s_{c}"] for c in features])
    std[std < LEAST_SCALE] = 1.0
    if shrink is not None:
        l2 = l2_for_shrink(shrink, n, steps, rate)
    if not np.isfinite(l2) or l2 < 0 or rate * l2 / n >= 1:
        raise ValueError("the penalty must be finite, not negative, and small enough for the step size")
    effect = penalty_shrink(l2, n, steps, rate)
    if shrink is None and l2 > 0 and effect > 1 - LEAST_EFFECT:
        raise ValueError(f"l2={l2:g} over {n} rows leaves {effect:.4f} of a weight; use at least {l2_for_shrink(1 - LEAST_EFFECT, n, steps, rate):.3g}, or state shrink")
    data = rows.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("y"))
    if n <= ONE_TASK:
        k = len(features)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            w, b = _descend((pdf.iloc[:, :k].to_numpy(float) - mean) / std, pdf["y"].to_numpy(), l2, steps, rate)
            return pd.DataFrame({"w": [w.tolist()], "b": [float(b)]})

        got = data.withColumn("all_rows", F.lit(0)).groupBy("all_rows").applyInPandas(one, "w array<double>, b double").first()
        w, b = np.array(got["w"]), got["b"]
    else:
        w, b = np.zeros(len(features)), 0.0
        data = data.persist()
        for _ in range(steps):

            def part(batches, w=w, b=b):
                g = np.zeros(len(w) + 1)
                for p in batches:
                    z = (p.iloc[:, : len(w)].to_numpy() - mean) / std
                    m = z @ w + b
                    e = np.exp(-np.abs(m))
                    err = np.where(m >= 0, 1 / (1 + e), e / (1 + e)) - p["y"].to_numpy()
                    g[:-1] += z.T @ err
                    g[-1] += err.sum()
                yield pd.DataFrame({"k": range(len(g)), "g": g})

            g = {r["k"]: r["g"] for r in data.mapInPandas(part, "k int, g double").groupBy("k").agg(F.sum("g").alias("g")).collect()}
            g = np.array([g[k] for k in range(len(w) + 1)])
            w, b = w - rate * (g[:-1] / n + l2 * w / n), b - rate * g[-1] / n
        data.unpersist()
    return Weights(tuple(mean.tolist()), tuple(std.tolist()), tuple(np.asarray(w).tolist()), float(b), None, {"l2": float(l2), "l2_shrink": effect, "fit_rows": n, "fit_steps": steps, "fit_lr": rate})


def scales(df: DataFrame) -> DataFrame:
    """(feature, mean, std): of every column, with the population's deviation; one below 1e-6 counts as 1."""
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.when(F.col(f"s{i}") < 1e-6, 1.0).otherwise(F.col(f"s{i}")).alias("std")) for i, c in enumerate(df.columns)])
    return row.select(F.explode(each).alias("x")).select("x.*")
