"""Scoring of given weights: patch transformer and perceptron forecasters, and the residual model on top of them.

Weights come as a table (name, shape, values) of checked size and are sent to the tasks once; samples stay where they are
and are scored in Arrow batches by matrix products.  Nothing is trained here.

A layer `x` has the weights x.weight (outputs by inputs) and x.bias; a transformer block has x.norm1, x.norm2, x.qkv (queries,
keys and values below one another), x.out, x.up and x.down, normalised before each part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from . import evaluate

Weights = dict[str, np.ndarray]
#: The most numbers that a weights table may hold (128 MB).
MOST = 1 << 24
_erf = np.frompyfunc(math.erf, 1, 1)


@dataclass(frozen=True)
class Patching:
    """How a history is cut and read; hidden: the activation inside blocks."""

    length: int
    stride: int
    heads: int
    layers: int
    hidden: str = "gelu"


def weights(table: DataFrame) -> Weights:
    """The arrays of a table (name, shape, values); an error if it is larger than tasks should be sent, or uneven."""
    size = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if size > MOST:
        raise ValueError(f"{size} weights are more than {MOST}")
    out = {}
    for r in table.select("name", "shape", "values").collect():  # MOST numbers at most
        if math.prod(r["shape"]) != len(r["values"]):
            raise ValueError(f"{r['name']} has {len(r['values'])} values for the shape {r['shape']}")
        out[r["name"]] = np.array(r["values"], float).reshape(r["shape"])
    return out


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)).astype(float))


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def normalised(x: np.ndarray, w: Weights, name: str, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * w[f"{name}.weight"] + w[f"{name}.bias"]


def attention(x: np.ndarray, w: Weights, name: str, heads: int) -> np.ndarray:
    """Every token of a sample looks at all of them: x is samples x tokens x width."""
    n, tokens, width = x.shape
    q, k, v = (part.reshape(n, tokens, heads, width // heads).swapaxes(1, 2) for part in np.split(linear(x, w, f"{name}.qkv"), 3, axis=-1))
    score = q @ k.swapaxes(2, 3) / math.sqrt(width // heads)
    share = np.exp(score - score.max(-1, keepdims=True))
    share /= share.sum(-1, keepdims=True)
    return linear((share @ v).swapaxes(1, 2).reshape(n, tokens, width), w, f"{name}.out")


def transformer(x: np.ndarray, w: Weights, name: str, p: Patching) -> np.ndarray:
    active = gelu if p.hidden == "gelu" else lambda v: np.maximum(v, 0)
    for i in range(p.layers):
        own = f"{name}.{i}"
        x = x + attention(normalised(x, w, f"{own}.norm1"), w, own, p.heads)
        x = x + linear(active(linear(normalised(x, w, f"{own}.norm2"), w, f"{own}.up")), w, f"{own}.down")
    return x


def patches(x: np.ndarray, p: Patching, repeat_last: bool) -> np.ndarray:
    """Overlapping slices of each row; what is missing at the end is the last value, or zeros up to one slice (a remainder is dropped)."""
    short = max(0, p.length - x.shape[1])
    more = short or ((-(x.shape[1] - p.length)) % p.stride if repeat_last else 0)
    if more:
        x = np.concatenate([x, np.repeat(x[:, -1:], more, 1) if repeat_last else np.zeros((len(x), more))], axis=1)
    starts = np.arange(0, x.shape[1] - p.length + 1, p.stride)
    return x[:, starts[:, None] + np.arange(p.length)]


def patch_forecast(history: np.ndarray, w: Weights, p: Patching) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts, and the hidden values behind them, of the patch transformer."""
    tokens = linear(patches(history, p, True), w, "embed") + w["position"]
    hidden = transformer(tokens, w, "block", p).reshape(len(history), -1)
    return linear(hidden, w, "head"), hidden


def perceptron_forecast(history: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and hidden values of two hidden layers."""
    hidden = gelu(linear(gelu(linear(history, w, "first")), w, "second"))
    return linear(hidden, w, "head"), hidden


def encoded(history: np.ndarray, residual: np.ndarray, calendar: np.ndarray, hidden: np.ndarray, w: Weights, p: Patching) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their mean: patches of the history and of its residual, with the weekday and half hour of their ends, behind a token of the base model.

    calendar: samples x patches x 2; an unknown time is Monday midnight.
    """
    tokens = linear(patches(history, p, False), w, "patch") + linear(patches(residual, p, False), w, "residual_patch")
    tokens = tokens + w["weekday"][calendar[..., 0]] + w["half_hour"][calendar[..., 1]] + w["holiday"][0]
    tokens = np.concatenate([linear(hidden, w, "base")[:, None, :], tokens], axis=1)
    tokens = normalised(transformer(tokens, w, "encoder", p), w, "encoded")
    return tokens, tokens.mean(1)


def _two_layers(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return linear(gelu(linear(x, w, f"{name}.in")), w, f"{name}.out")


def projected(regime: np.ndarray, active: np.ndarray, w: Weights) -> np.ndarray:
    """The regime of each sample as the heads read it; zero where no news is relevant."""
    x = normalised(gelu(linear(regime, w, "regime.in")), w, "regime.norm1")
    return normalised(gelu(linear(x, w, "regime.out")), w, "regime.norm2") * active[:, None]


def residual_parts(history: np.ndarray, residual: np.ndarray, calendar: np.ndarray, hidden: np.ndarray, regime: np.ndarray, active: np.ndarray, w: Weights, p: Patching) -> dict[str, np.ndarray]:
    """What the heads say of each sample: slow, shape (without its mean), spike, gate, and the raw scores of the modulation."""
    tokens, summary = encoded(history, residual, calendar, hidden, w, p)
    flat, news = tokens.reshape(len(tokens), -1), projected(regime, active, w)
    shape = _two_layers(flat, w, "shape")
    return {
        "slow": _two_layers(summary, w, "slow")[:, 0], "shape": shape - shape.mean(-1, keepdims=True), "spike": _two_layers(flat, w, "spike"), "gate": _two_layers(flat, w, "gate"),
        "ts_logit": _two_layers(summary, w, "ts_trust")[:, 0], "trust": _two_layers(news, w, "trust")[:, 0], "gain_raw": _two_layers(news, w, "gain")[:, 0], "bias_raw": _two_layers(news, w, "bias")[:, 0],
    }


def scored(samples: DataFrame, keys: list[str], inputs: dict[str, Column], outputs: str, model: Callable[..., dict[str, np.ndarray]], w: Weights) -> DataFrame:
    """keys and outputs (a schema of doubles and arrays of them) of model(inputs as arrays, weights); samples are scored in batches where they are."""
    ship(samples.sparkSession)
    sent = samples.sparkSession.sparkContext.broadcast(w)
    names = list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = model(*(np.stack([np.stack(v) if len(v) and isinstance(v[0], np.ndarray) else v for v in b[c]]) if b[c].dtype == object else b[c].to_numpy() for c in names), sent.value)
                yield pd.DataFrame({**{k: b[k] for k in keys}, **{k: list(v) for k, v in found.items()}})

    kinds = dict(samples.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), outputs])
    return samples.select(*keys, *(c.alias(n) for n, c in inputs.items())).mapInPandas(run, schema)


def assembled(parts: DataFrame, base: str, mass: str, *, threshold: float, hard: float = 0.0) -> DataFrame:
    """parts with forecast: base plus the modulated residual of each step, from the columns of residual_parts."""
    c = F.col
    lam = evaluate.modulation(c("ts_logit"), c("trust"), c("gain_raw"), c("bias_raw"), c(mass), threshold=threshold)
    named = parts.withColumn("modulation", F.struct(*(v.alias(k) for k, v in lam.items())))
    steps = F.arrays_zip(c(base).alias("base"), "shape", "spike", "gate")
    m = lambda k: c(f"modulation.{k}")
    step = lambda s: evaluate.assembled(s["base"], m("lambda"), c("slow"), m("gain"), s["shape"], s["gate"], m("bias"), s["spike"], c(mass), hard)
    return named.withColumn("forecast", F.transform(steps, step)).drop("modulation")
