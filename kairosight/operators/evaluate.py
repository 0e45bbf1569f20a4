"""Forecast metrics, losses, modulation algebra and checkpoint selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import quantiles



def skill(metric: Column, base: Column) -> Column:
    """1 - metric / base; null where the base is null, not finite or nearly zero."""
    return F.when(base.isNotNull() & ~F.isnan(base) & (F.abs(base) >= 1e-12) & (F.abs(base) < F.lit(float("inf"))), 1 - metric / base)


def skill_or_zero(metric: Column, base: Column, eps: float = 1e-12) -> Column:
    """The other variant: zero where the base is not above eps."""
    return F.when(base <= eps, 0.0).otherwise(1 - metric / base)


def point_errors(y: Column, p: Column) -> dict[str, Column]:
    """rmse, mae and smape (percent) as aggregates."""
    return {"rmse": F.sqrt(F.avg((y - p) * (y - p))), "mae": F.avg(F.abs(y - p)), "smape": 100 * F.avg(2 * F.abs(p - y) / (F.abs(y) + F.abs(p) + 1e-6))}


def smooth_l1(e: Column) -> Column:
    return F.when(F.abs(e) < 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5)


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.greatest(q * (y - p), (q - 1) * (y - p))


def price_loss(y: Column, p: Column, low: Column, high: Column, scale: Column) -> Column:
    """Smooth L1 of winsorised values plus a tenth of the mean pinball loss of 0.1, 0.5 and 0.9, over the scale; an aggregate."""
    clip = lambda c: F.greatest(F.least(c, high), low)
    quantile = sum((F.avg(pinball(y, p, q)) for q in (0.1, 0.5, 0.9)), F.lit(0.0)) / 3
    return (F.avg(smooth_l1(clip(p) - clip(y))) + 0.1 * quantile) / F.greatest(F.max(scale), F.lit(1e-6))


def sign_match(y: Column, p: Column, eps: float) -> Column:
    """Percentage of equal signs, values within +-eps counting as zero; an aggregate."""
    sign = lambda c: F.when(c > eps, 1).when(c < -eps, -1).otherwise(0)
    return 100 * F.avg((sign(y) == sign(p)).cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def modulation(ts_logit: Column, trust: Column, shape: Column, spike: Column, mass: Column, *, threshold: float, floor: float = 0.05, ts_cap: float = 0.45, news_cap: float = 0.2, top: float = 0.6, gain_cap: float = 0.5, bias_cap: float = 1.0, softness: float = 0.05) -> dict[str, Column]:
    """lambda, gain and bias of a sample from raw scores; without relevance news has no say, and lambda shrinks softly to its floor."""
    active = (mass > threshold).cast("double")
    raw = F.least(F.greatest(floor + ts_cap * sigmoid(ts_logit) + news_cap * F.tanh(trust * active), F.lit(floor)), F.lit(top))
    return {
        "active": active,
        "lambda": floor + (raw - floor) * sigmoid((mass - threshold) / softness),
        "gain": 1 + gain_cap * F.tanh(shape * active),
        "bias": bias_cap * F.tanh(spike * active),
    }


def assembled(base: Column, lam: Column, slow: Column, gain: Column, shape: Column, gate_logit: Column, bias: Column, spike: Column, mass: Column, hard: float = 0.0) -> Column:
    """base + gate * lambda * (slow + gain * shape + sigmoid(gate_logit + bias) * spike); the gate opens at mass >= hard (always for hard <= 0)."""
    delta = lam * (slow + gain * shape + sigmoid(gate_logit + bias) * spike)
    return base + (F.when(mass >= hard, delta).otherwise(0.0) if hard > 0 else delta)


def per_sample(steps: DataFrame, sample: list[str], predictions: list[str], y: str = "y", carry: list[str] = ()) -> DataFrame:
    """For each sample and prediction p: p_abs and p_sq, the mean absolute and squared errors; carried columns are constant in a sample."""
    e = lambda p: F.col(p) - F.col(y)
    return steps.groupBy(*sample).agg(*(F.first(c).alias(c) for c in carry), *(F.avg(F.abs(e(p))).alias(f"{p}_abs") for p in predictions), *(F.avg(e(p) * e(p)).alias(f"{p}_sq") for p in predictions))


def diagnostics(s: DataFrame, scale: float = 1.0, lambda_max: float = 0.6) -> DataFrame:
    """One row of counterfactual diagnostics from per-sample errors of base, final, blank and perm, with active and lambda.

    Means over empty subsets are null.  Two passes: the 0.9 quantile of the base error, then one aggregation.
    """
    q = quantiles(s, "base_abs", [0.9]).select(F.col("q")[0].alias("q"))
    x = s.crossJoin(F.broadcast(q))  # one row
    on, off, top = F.col("active"), ~F.col("active"), F.col("base_abs") >= F.col("q")
    mean = lambda c, when=None: F.avg(F.when(when, c) if when is not None else c)
    helped = (F.col("final_abs") < F.col("base_abs")).cast("double")
    normal, blank = mean(F.col("final_abs"), off), mean(F.col("blank_abs"), off)
    return x.agg(
        F.count(F.lit(1)).alias("samples"), mean(F.col("final_sq")).alias("mse"), mean(F.col("final_abs")).alias("mae"), mean(F.col("base_sq")).alias("base_mse"), mean(F.col("base_abs")).alias("base_mae"),
        skill(mean(F.col("final_sq")), mean(F.col("base_sq"))).alias("skill_mse"), skill(mean(F.col("final_abs")), mean(F.col("base_abs"))).alias("skill_mae"),
        mean(helped).alias("helped_rate"), mean(helped, top).alias("helped_rate_top"), mean(F.col("final_abs"), top).alias("top_mae"),
        mean(F.col("final_sq"), on).alias("active_mse"), mean(F.col("final_abs"), on).alias("active_mae"), mean(F.col("blank_sq"), on).alias("blank_active_mse"), mean(F.col("blank_abs"), on).alias("blank_active_mae"),
        mean(F.col("perm_sq"), on).alias("perm_active_mse"), mean(F.col("perm_abs"), on).alias("perm_active_mae"), normal.alias("inactive_mae"), blank.alias("blank_inactive_mae"),
        F.when(F.abs(blank) > 1e-6, 100 * (normal - blank) / blank).alias("inactive_blank_gap_pct"),
        mean((F.col("blank_abs") - F.col("final_abs")) / scale, on).alias("active_blank_gain_z"), mean((F.col("perm_abs") - F.col("final_abs")) / scale, on).alias("active_perm_gain_z"),
        mean(F.col("lambda")).alias("lambda_mean"), mean((F.col("lambda") >= 0.98 * lambda_max).cast("double")).alias("lambda_saturated"), mean(on.cast("double")).alias("active_pct"),
    )


def histogram(df: DataFrame, value: str, bins: int = 8, widened: bool = True) -> DataFrame:
    """bin, low, high, n of equal-width bins from the least to the greatest value; the last one includes its end.

    A single value gets +-0.5 around it; unless widened, it is in the last of bins without width, and without values the edges are null.
    """
    b = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    if widened:
        one = F.col("lo") == F.col("hi")
        b = b.where("lo is not null").select(F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    share = F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))  # null without width, which least() passes over
    at = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(b)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return edges.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def gated(epochs: DataFrame, eps: float) -> DataFrame:
    """Epoch rows with gate: pass, fail:base+news, fail:base or fail:news.

    It passes when the validation error beats the base and news help on active samples against blanks or permutations by more than eps.
    """
    beats = F.coalesce(F.col("val_mae") < F.col("base_mae"), F.lit(False))
    news = F.coalesce(F.col("active_mae") < F.col("blank_mae") - eps, F.lit(False)) | F.coalesce(F.col("active_mae") < F.col("perm_mae") - eps, F.lit(False))
    return epochs.withColumn("gate", F.when(beats & news, "pass").when(~beats & ~news, "fail:base+news").when(~beats, "fail:base").otherwise("fail:news"))


def selected(epochs: DataFrame, eps: float, run: str = "run") -> DataFrame:
    """The chosen epoch of each run: the best that passes the gate, else the best of all; ties go to the earlier."""
    order = Window.partitionBy(run).orderBy(F.when(F.col("gate") == "pass", 0).otherwise(1), "val_mae", "epoch")
    return gated(epochs, eps).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def patience(epochs: DataFrame, run: str = "run") -> DataFrame:
    """Epochs with best (so far) and waited: epochs since the last strict improvement of val_mae."""
    w = Window.partitionBy(run).orderBy("epoch")
    best = F.min("val_mae").over(w)
    before = F.min("val_mae").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = epochs.withColumn("best", best).withColumn("__better", before.isNull() | (F.col("val_mae") < before))
    return x.withColumn("waited", F.col("epoch") - F.max(F.when(F.col("__better"), F.col("epoch"))).over(w)).drop("__better")


def learning_rate(step: Column, total: int, base: float, schedule: str = "cosine", warmup: float = 0.0, least_ratio: float = 0.0) -> Column:
    """Rate at a step: constant, cosine, or a linear warm-up from a thousandth and then cosine."""
    least = base * max(0.0, least_ratio)
    cosine = lambda s, n: least + (base - least) * (1 + F.cos(F.lit(3.141592653589793) * s / max(1, n))) / 2
    if schedule == "none" or total <= 0:
        return F.lit(float(base))
    first = min(int(total * max(0.0, warmup)), max(0, total - 1)) if schedule == "warmup_cosine" else 0
    if schedule not in ("cosine", "warmup_cosine"):
        raise ValueError(f"unknown schedule {schedule}")
    if not first:
        return cosine(step, total)
    return F.when(step < first, base * (0.001 + 0.999 * step / first)).otherwise(cosine(step - first, total - first))


def auxiliary_losses(gate: Column, is_spike: Column, final: Column, blank: Column, perm: Column, active: Column, lam: Column, delta: Column, margin: float = 0.0) -> dict[str, Column]:
    """Aggregates: weighted cross entropy of the spike gate, the counterfactual hinge on active samples, the square of the delta on inactive ones."""
    p = F.greatest(F.least(gate, F.lit(1 - 1e-7)), F.lit(1e-7))
    positives, n = F.sum(is_spike.cast("double")), F.count(F.lit(1))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(20.0), (n - positives) / F.greatest(positives, F.lit(1.0))))
    hinge = lambda other: F.greatest(final - other + margin, F.lit(0.0))
    return {
        "spike_bce": (weight * F.sum(F.when(is_spike, -F.ln(p)).otherwise(0.0)) + F.sum(F.when(~is_spike, -F.ln(1 - p)).otherwise(0.0))) / n,
        "counterfactual": F.avg(F.when(active, (hinge(blank) + hinge(perm)) / 2)),
        "inactive_l2": F.avg(F.when(~active, lam * lam * delta * delta)),
    }
