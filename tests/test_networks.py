"""Network scoring against recomputations number by number."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairosight.operators import networks as N


def made(shapes, seed=1):
    rng = random.Random(seed)
    return {k: np.array([rng.uniform(-0.5, 0.5) for _ in range(math.prod(s))]).reshape(s) for k, s in shapes.items()}


def dense(x, w, name):
    return [sum(a * b for a, b in zip(x, row, strict=True)) + c for row, c in zip(w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]


def gelu(x):
    return [v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in x]


def norm(x, w, name):
    m = sum(x) / len(x)
    s = math.sqrt(sum((v - m) ** 2 for v in x) / len(x) + 1e-5)
    return [(v - m) / s * g + b for v, g, b in zip(x, w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]


def block(tokens, w, name, heads, active):
    d = len(tokens[0])
    size = d // heads
    n = [norm(t, w, f"{name}.norm1") for t in tokens]
    qkv = [dense(t, w, f"{name}.qkv") for t in n]
    mixed = []
    for a in qkv:
        row = []
        for h in range(heads):
            at = range(h * size, (h + 1) * size)
            score = [sum(a[i] * b[d + i] for i in at) / math.sqrt(size) for b in qkv]
            e = [math.exp(s) for s in score]
            row += [sum(x / sum(e) * b[2 * d + i] for x, b in zip(e, qkv, strict=True)) for i in at]
        mixed.append(dense(row, w, f"{name}.out"))
    tokens = [[a + b for a, b in zip(t, m, strict=True)] for t, m in zip(tokens, mixed, strict=True)]
    return [[a + b for a, b in zip(t, dense(active(dense(norm(t, w, f"{name}.norm2"), w, f"{name}.up")), w, f"{name}.down"), strict=True)] for t in tokens]


def layer(out, inp, name):
    return {f"{name}.weight": (out, inp), f"{name}.bias": (out,)}


def block_shapes(name, d, up):
    return layer(3 * d, d, f"{name}.qkv") | layer(d, d, f"{name}.out") | layer(up, d, f"{name}.up") | layer(d, up, f"{name}.down") | {f"{name}.{x}.{y}": (d,) for x in ("norm1", "norm2") for y in ("weight", "bias")}


@pytest.mark.parametrize("length", [3, 6, 11, 13])
def test_patch_forecast(length):
    p = N.Patching(length=6, stride=3, heads=2, layers=2)
    padded = max(length, 6)
    padded += -(padded - 6) % 3
    count, d, horizon = (padded - 6) // 3 + 1, 4, 3
    w = made(layer(d, 6, "embed") | {"position": (count, d)} | block_shapes("block.0", d, 8) | block_shapes("block.1", d, 8) | layer(horizon, count * d, "head"))
    rng = random.Random(2)
    history = [[rng.uniform(-2, 2) for _ in range(length)] for _ in range(3)]
    found, hidden = N.patch_forecast(np.array(history), w, p)
    for row, out, inner in zip(history, found, hidden, strict=True):
        x = row + [row[-1]] * (padded - length)
        tokens = [[a + b for a, b in zip(dense(x[i * 3 : i * 3 + 6], w, "embed"), w["position"][i], strict=True)] for i in range(count)]
        for i in range(2):
            tokens = block(tokens, w, f"block.{i}", 2, gelu)
        flat = [v for t in tokens for v in t]
        assert inner == pytest.approx(flat, abs=1e-10)
        assert out == pytest.approx(dense(flat, w, "head"), abs=1e-10)


def test_perceptron_forecast_on_samples(spark):
    w = made(layer(5, 4, "first") | layer(5, 5, "second") | layer(2, 5, "head"))
    table = spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in w.items()], "name string, shape array<int>, values array<double>")
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(50)]
    samples = spark.createDataFrame(rows, "id long, history array<double>").repartition(3)
    got = N.scored(samples, ["id"], {"history": F.col("history")}, "forecast array<double>", lambda h, given: {"forecast": N.perceptron_forecast(h, given)[0]}, N.weights(table))
    found = {r.id: r.forecast for r in got.collect()}
    for i, row in rows:
        assert found[i] == pytest.approx(dense(gelu(dense(gelu(dense(row, w, "first")), w, "second")), w, "head"), abs=1e-12)
    assert N.scored(samples.limit(0), ["id"], {"history": F.col("history")}, "forecast array<double>", lambda h, given: {}, w).count() == 0


def test_weights_are_checked(spark, monkeypatch):
    table = spark.createDataFrame([("a", [2, 2], [1.0, 2.0, 3.0])], "name string, shape array<int>, values array<double>")
    with pytest.raises(ValueError, match="shape"):
        N.weights(table)
    monkeypatch.setattr(N, "MOST", 2)
    with pytest.raises(ValueError, match="more than"):
        N.weights(table)


def test_residual_parts_and_assembly(spark):
    p, d, horizon, base_size, regime_size = N.Patching(4, 2, 2, 1, "relu"), 4, 3, 5, 6
    count = 3
    shapes = layer(d, 4, "patch") | layer(d, 4, "residual_patch") | {"weekday": (7, d), "half_hour": (48, d), "holiday": (2, d)} | layer(d, base_size, "base") | block_shapes("encoder.0", d, 6) | {"encoded.weight": (d,), "encoded.bias": (d,)}
    shapes |= layer(d, d, "slow.in") | layer(1, d, "slow.out") | layer(d, d, "ts_trust.in") | layer(1, d, "ts_trust.out")
    for name in ("shape", "spike", "gate"):
        shapes |= layer(d, (count + 1) * d, f"{name}.in") | layer(horizon, d, f"{name}.out")
    shapes |= layer(d, regime_size, "regime.in") | layer(d, d, "regime.out") | {f"regime.{x}.{y}": (d,) for x in ("norm1", "norm2") for y in ("weight", "bias")}
    for name in ("trust", "gain", "bias"):
        shapes |= layer(d, d, f"{name}.in") | layer(1, d, f"{name}.out")
    w = made(shapes, 7)
    rng = random.Random(8)
    u = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, u(8), u(8), [[rng.randrange(7), rng.randrange(48)] for _ in range(count)], u(base_size), u(regime_size), float(i % 2), u(horizon), rng.random()) for i in range(12)]
    two = lambda x, name: dense(gelu(dense(x, w, f"{name}.in")), w, f"{name}.out")
    relu = lambda x: [max(v, 0.0) for v in x]
    schema = "id long, history array<double>, residual array<double>, calendar array<array<int>>, hidden array<double>, regime array<double>, active double, base array<double>, mass double"
    samples = spark.createDataFrame(rows, schema)
    inputs = {k: F.col(k) for k in ("history", "residual", "calendar", "hidden", "regime", "active")}
    outputs = "slow double, shape array<double>, spike array<double>, gate array<double>, ts_logit double, trust double, gain_raw double, bias_raw double"
    parts = N.scored(samples, ["id", "base", "mass"], inputs, outputs, lambda *x: N.residual_parts(*x, p), w)
    found = {r.id: r for r in N.assembled(parts, "base", "mass", threshold=0.5, hard=0.2).collect()}
    assert len(found) == len(rows)
    sig = lambda x: 1 / (1 + math.exp(-x))
    for i, history, residual, calendar, hidden, regime, active, base, mass in rows:
        tokens = [dense(hidden, w, "base")]
        for k in range(count):
            a, b = dense(history[2 * k : 2 * k + 4], w, "patch"), dense(residual[2 * k : 2 * k + 4], w, "residual_patch")
            tokens.append([sum(v) for v in zip(a, b, w["weekday"][calendar[k][0]], w["half_hour"][calendar[k][1]], w["holiday"][0], strict=True)])
        tokens = [norm(t, w, "encoded") for t in block(tokens, w, "encoder.0", 2, relu)]
        summary, flat = [sum(c) / len(tokens) for c in zip(*tokens, strict=True)], [v for t in tokens for v in t]
        r = norm(gelu(dense(norm(gelu(dense(regime, w, "regime.in")), w, "regime.norm1"), w, "regime.out")), w, "regime.norm2")
        news = [v * active for v in r]
        shape = two(flat, "shape")
        shape = [v - sum(shape) / horizon for v in shape]
        spike, gate, slow = two(flat, "spike"), two(flat, "gate"), two(summary, "slow")[0]
        ts, trust, gain, bias = two(summary, "ts_trust")[0], *(two(news, n)[0] for n in ("trust", "gain", "bias"))
        got = found[i]
        assert [got.slow, got.ts_logit, got.trust, got.gain_raw, got.bias_raw] == pytest.approx([slow, ts, trust, gain, bias], abs=1e-10)
        assert (got.shape, got.spike, got.gate) == (pytest.approx(shape, abs=1e-10), pytest.approx(spike, abs=1e-10), pytest.approx(gate, abs=1e-10))
        on = float(mass > 0.5)
        lam = min(max(0.05 + 0.45 * sig(ts) + 0.2 * math.tanh(trust * on), 0.05), 0.6)
        lam = 0.05 + (lam - 0.05) * sig((mass - 0.5) / 0.05)
        steps = [b + (lam * (slow + (1 + 0.5 * math.tanh(gain * on)) * s + sig(g + math.tanh(bias * on)) * k) if mass >= 0.2 else 0.0) for b, s, g, k in zip(base, shape, gate, spike, strict=True)]
        assert got.forecast == pytest.approx(steps, abs=1e-10)
