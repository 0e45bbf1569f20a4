"""Linear forecasters by normal equations, and principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows


def moments(samples: DataFrame, inputs: Column, outputs: Column, n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X and X'Y with a column of ones, summed where the samples are: the driver gets one matrix, whatever their number."""
    width, size = n_in + 1, (n_in + 1) ** 2 + (n_in + 1) * n_out

    def partial(batches):
        total, n = np.zeros(size), 0
        for b in batches:
            x = np.stack([np.append(v, 1.0) for v in b["x"]]) if len(b) else np.zeros((0, width))
            y = np.stack(b["y"].tolist()) if len(b) else np.zeros((0, n_out))
            total += np.concatenate([(x.T @ x).ravel(), (x.T @ y).ravel()])
            n += len(b)
        yield pd.DataFrame({"i": np.arange(size), "v": total, "n": n})

    found = samples.select(inputs.alias("x"), outputs.alias("y")).mapInPandas(partial, "i int, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").toPandas()
    v = found["v"].to_numpy()
    return v[: width * width].reshape(width, width), v[width * width :].reshape(width, n_out), int(found["n"].iloc[0]) if len(found) else 0


def ridge(xx: np.ndarray, xy: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights (the last row is the bias, which is not penalised)."""
    p = np.eye(len(xx)) * penalty
    p[-1, -1] = 0
    return np.linalg.solve(xx + p, xy)


def linear_scores(x: Column, weights: np.ndarray) -> Column:
    """Array of outputs: the weights' columns times the input array, plus biases."""
    dot = lambda w: F.aggregate(F.zip_with(x, F.array(*(F.lit(float(v)) for v in w[:-1])), lambda a, b: a * b), F.lit(float(w[-1])), lambda s, v: s + v)
    return F.array(*(dot(w) for w in weights.T))


def decomposed(history: Column, k: int = 25) -> Column:
    """Inputs of the decomposition forecaster: the trend, then the rest."""
    t = windows.trend(history, k)
    return F.concat(t, F.zip_with(history, t, lambda x, m: x - m))


def fit_decomposition(samples: DataFrame, history: int, horizon: int, k: int = 25, penalty: float = 1e-3) -> np.ndarray:
    xx, xy, n = moments(samples, decomposed(F.col("history"), k), F.col("target"), 2 * history, horizon)
    if not n:
        raise ValueError("no samples")
    return ridge(xx, xy, penalty)


def fit_last_value(samples: DataFrame, history: int, horizon: int, penalty: float = 1e-3) -> np.ndarray:
    """The forecaster of differences to the last value."""
    last = F.element_at("history", -1)
    xx, xy, n = moments(samples, F.transform("history", lambda x: x - last), F.transform("target", lambda x: x - last), history, horizon)
    if not n:
        raise ValueError("no samples")
    return ridge(xx, xy, penalty)


def principal_components(rows: DataFrame, vector: str, size: int, k: int) -> np.ndarray:
    """k leading directions as rows, each with its largest entry positive."""
    xx, _, n = moments(rows, F.col(vector).cast("array<double>"), F.array(F.lit(0.0)), size, 1)
    mean = xx[-1, :-1] / max(n, 1)
    values, vectors = np.linalg.eigh(xx[:-1, :-1] / max(n, 1) - np.outer(mean, mean))
    top = vectors[:, np.argsort(-values)[:k]].T
    return top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]


def verdict(significant_share: Column) -> Column:
    """Tiers of the share of significant pairs."""
    return F.when(significant_share > 0.20, "strong").when(significant_share > 0.05, "weak").otherwise("none")
