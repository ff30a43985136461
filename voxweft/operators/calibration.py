"""Confidence and calibration: reliability bins, scaling, fitting, scores, ranks.

Relations have a confidence ``p`` in 0..1 and a 0/1 ``label``. What needs an order over all rows sums over blocks of
neighbouring confidences first, so no step sorts all rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..saved import saved

BLOCKS = 4096


def uniform_bin(p: Column, bins: int) -> Column:
    """The confidence times the number of bins, cut to a whole number and held inside."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), (p * bins).cast("int")))


def _before(totals: DataFrame) -> DataFrame:
    """(block, before): the sum of c over earlier blocks, of at most ``BLOCKS`` rows (block, c)."""
    return F.broadcast(totals.select("block", (F.sum("c").over(Window.orderBy("block")) - F.col("c")).alias("before")))


def block(p: Column) -> Column:
    return F.least(F.lit(BLOCKS - 1), F.greatest(F.lit(0), F.floor(p * BLOCKS))).cast("int")


def with_rank(df: DataFrame, p: str = "p", tie: str = "id") -> DataFrame:
    """Adds ``rank``, from 0, in the order of p and then of the tie column."""
    t = df.withColumn("block", block(F.col(p)))
    before = _before(t.groupBy("block").agg(F.count("*").alias("c")))
    own = F.row_number().over(Window.partitionBy("block").orderBy(p, tie)) - 1
    return t.withColumn("own", own).join(before, "block").withColumn("rank", F.col("own") + F.col("before")).drop("block", "own", "before")


def quantile_bin(df: DataFrame, bins: int, p: str = "p", tie: str = "id") -> DataFrame:
    """Adds ``bin``: rank times bins over the number of rows."""
    n = df.count()
    return with_rank(df, p, tie).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("rank") * bins / F.lit(max(1, n)))).cast("int"))


def reliability_bins(binned: DataFrame, bins: int) -> DataFrame:
    """(bin, count, confidence, accuracy) of rows with ``bin``; bins without rows have zeros."""
    every = binned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    own = binned.groupBy("bin").agg(F.count("*").alias("count"), F.avg("p").alias("confidence"), F.avg("label").alias("accuracy"))
    return every.join(F.broadcast(own), "bin", "left").na.fill({"count": 0, "confidence": 0.0, "accuracy": 0.0})


def reliability_curve(binned: DataFrame, bins: int) -> DataFrame:
    """The bins with their edges."""
    return reliability_bins(binned, bins).withColumns({"lo": F.col("bin") / bins, "hi": (F.col("bin") + 1) / bins})


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece): mean distance of confidence and accuracy, weighted by count; 0 without rows."""
    total = F.sum("count")
    return bins.agg(F.when(total > 0, F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("count")) / total).otherwise(0.0).alias("ece"))


def brier(p: Column, label: Column) -> Column:
    return F.avg((p - label) * (p - label))


def log_loss_term(p: Column, label: Column, eps: float = 1e-15) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -F.when(label == 1, F.log(q)).otherwise(F.log(1 - q))


def softmax_scaled(df: DataFrame, score: str, temperature: float, group: Sequence[str]) -> DataFrame:
    """Adds ``scaled``: the softmax of score / temperature over each group."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    w = Window.partitionBy(*group)
    t = df.withColumn("_x", F.col(score) / temperature)
    t = t.withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(w)))
    return t.withColumn("scaled", F.col("_e") / F.sum("_e").over(w)).drop("_x", "_e")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def calibration_report(df: DataFrame, bins: int) -> DataFrame:
    """(binning, bins, n, brier, ece, log_loss) in one pass: sums by bin, then over bins."""
    t = df.withColumn("bin", uniform_bin(F.col("p"), bins))
    y = F.col("label")
    by = t.groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum(y).alias("y"), F.sum((F.col("p") - y) * (F.col("p") - y)).alias("b"), F.sum(log_loss_term(F.col("p"), y)).alias("l"))
    n = F.sum("n")
    return by.agg(F.lit("uniform").alias("binning"), F.lit(bins).alias("bins"), n.alias("n"), (F.sum("b") / n).alias("brier"), (F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"), (F.sum("l") / n).alias("log_loss"))


def logit_scaled(p: Column, temperature: Column | float, clamp: float = 1e-7) -> Column:
    """The sigmoid of the clamped confidence's logit over a temperature."""
    q = F.least(F.lit(1 - clamp), F.greatest(F.lit(clamp), p))
    return sigmoid(F.log(q / (1 - q)) / temperature)


def histogram(df: DataFrame) -> DataFrame:
    """(p, label, c): counts of equal rows; what is fitted reads these."""
    return df.groupBy("p", "label").agg(F.count("*").alias("c"))


def temperature_grid(start: float = 0.05, step: float = 0.05, count: int = 100) -> list[float]:
    return [round(start + step * k, 10) for k in range(count)]


def fit_temperature_nll(df: DataFrame, grid: Sequence[float] | None = None, eps: float = 1e-15) -> DataFrame:
    """(temperature, nll): the grid's first temperature with the least mean log loss of sigmoid(p / temperature)."""
    h = histogram(df).withColumn("t", F.explode(F.array(*[F.lit(t) for t in grid or temperature_grid()])))
    loss = log_loss_term(sigmoid(F.col("p") / F.col("t")), F.col("label"), eps)
    by = h.groupBy("t").agg((F.sum(loss * F.col("c")) / F.sum("c")).alias("nll"))
    return by.agg(F.min_by("t", F.struct(F.round("nll", 12), "t")).alias("temperature"), F.min("nll").alias("nll"))


def fit_temperature_ece(df: DataFrame, grid: Sequence[float], bins: int = 10) -> DataFrame:
    """(temperature, ece): the grid's first temperature with the least calibration error of scaled logits."""
    h = histogram(df).withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    h = h.withColumn("q", logit_scaled(F.col("p"), F.col("t"))).withColumn("bin", uniform_bin(F.col("q"), bins))
    by = h.groupBy("t", "bin").agg(F.sum("c").alias("n"), (F.sum(F.col("q") * F.col("c")) / F.sum("c")).alias("conf"), (F.sum(F.col("label") * F.col("c")) / F.sum("c")).alias("acc"))
    by = by.groupBy("t").agg((F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n")) / F.sum("n")).alias("ece"))
    return by.agg(F.min_by("t", F.struct(F.round("ece", 12), "t")).alias("temperature"), F.min("ece").alias("ece"))


def piecewise(p: Column, segments: Sequence[tuple[float, float, float]]) -> Column:
    """slope * p + intercept of the last (breakpoint, slope, intercept) whose breakpoint is p or less, else of the first."""
    if not segments or any(a[0] > b[0] for a, b in zip(segments, segments[1:], strict=False)):
        raise ValueError("segments must have rising breakpoints")
    if any(s < 0 for _, s, _ in segments) or any(b[1] * b[0] + b[2] < a[1] * b[0] + a[2] for a, b in zip(segments, segments[1:], strict=False)):
        raise ValueError("the function must not fall")
    out = segments[0][1] * p + segments[0][2]
    for at, slope, intercept in segments[1:]:
        out = F.when(p >= at, slope * p + intercept).otherwise(out)
    return out


def fit_logistic(df: DataFrame, iterations: int = 200, rate: float = 0.1, l2: float = 0.0, most: int = 1 << 20) -> tuple[float, float]:
    """(coefficient, intercept) after so many full-batch steps from 0. The rows are counted once by exact (p, label); rows
    with a null in either are left out. Up to ``most`` different ones, steps are taken over their counts on one machine;
    beyond that every step is a job that sums the gradient where the counts lie, and only the sums travel."""
    counts = saved(histogram(df.select(F.col("p").cast("double"), F.col("label").cast("double")).filter("p is not null and label is not null")), "counts")
    whole = counts.agg(F.sum("c").alias("n"), F.sum(F.col("label") * F.col("c")).alias("ones"), F.count("*").alias("rows")).first()
    if not whole["rows"] or not 0 < whole["ones"] < whole["n"]:
        raise ValueError("both classes are needed")
    if whole["rows"] <= most:
        t = counts.orderBy("p", "label").toArrow()
        p, y, c = (t.column(k).to_numpy().astype(float) for k in ("p", "label", "c"))

        def slopes(fitted: np.ndarray) -> np.ndarray:
            part = c * (np.exp(-np.logaddexp(0, -(fitted[0] * p + fitted[1]))) - y)
            return np.array([part @ p, part.sum()])
    else:

        def slopes(fitted: np.ndarray) -> np.ndarray:
            part = F.col("c") * (sigmoid(float(fitted[0]) * F.col("p") + float(fitted[1])) - F.col("label"))
            return np.array(counts.agg(F.sum(part * F.col("p")), F.sum(part)).first())

    fitted = np.zeros(2)
    for _ in range(iterations):
        fitted = fitted - rate * (slopes(fitted) / whole["n"] + np.array([l2, 0.0]) * fitted)
    return float(fitted[0]), float(fitted[1])


def apply_logistic(p: Column, fitted: tuple[float, float]) -> Column:
    return sigmoid(fitted[0] * p + fitted[1])


def auc(df: DataFrame) -> DataFrame:
    """(auc): Mann-Whitney with mean ranks of ties, from counts by confidence."""
    h = df.groupBy("p").agg(F.count("*").alias("c"), F.sum("label").alias("pos")).withColumn("block", block(F.col("p")))
    before = _before(h.groupBy("block").agg(F.sum("c").alias("c")))
    inner = Window.partitionBy("block").orderBy("p")
    h = h.withColumn("end", F.sum("c").over(inner)).join(before, "block").withColumn("rank", F.col("before") + F.col("end") - (F.col("c") - 1) / 2)
    s = h.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("pos"), F.sum("c").alias("n"))
    neg = F.col("n") - F.col("pos")
    return s.select(F.when((F.col("pos") > 0) & (neg > 0), (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).otherwise(0.5).alias("auc"))


def preserves_ranking(df: DataFrame, a: str, b: str) -> DataFrame:
    """(preserved): whether b rises strictly wherever a does: for each value of a the least b is above the largest b of
    all smaller a. Maxima of earlier blocks of a come first."""
    g = df.groupBy(F.col(a).alias("a")).agg(F.min(b).alias("lo"), F.max(b).alias("hi")).withColumn("block", block(F.col("a")))
    blocks = g.groupBy("block").agg(F.max("hi").alias("m"))
    earlier = F.broadcast(blocks.select("block", F.max("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier")))
    inner = F.max("hi").over(Window.partitionBy("block").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("inner", inner).join(earlier, "block")
    return g.agg(F.coalesce(F.bool_and(F.coalesce(F.col("lo") > F.greatest("inner", "earlier"), F.lit(True))), F.lit(True)).alias("preserved"))


def mean_of(values: Column) -> Column:
    """Mean of an array of doubles; 0 of an empty one."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def utterance_confidence(values: Column, how: str) -> Column:
    """Mean, min, geometric mean (of values held above 1e-300) or product of an array."""
    if how == "mean":
        return mean_of(values)
    if how == "min":
        return F.coalesce(F.array_min(values), F.lit(0.0))
    if how in ("product", "length_normalized"):
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(1.0), lambda s, x: s * x)).otherwise(0.0)
    if how == "geometric":
        logs = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.log(F.greatest(x, F.lit(1e-300))))
        return F.when(F.size(values) > 0, F.exp(logs / F.size(values))).otherwise(0.0)
    raise ValueError(how)


def entropy(values: Column) -> Column:
    """Sum of -x ln x over an array's positive elements."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def confidence_features(posteriors: Column, acoustic: Column, lm: Column, votes: Column | None = None) -> dict[str, Column]:
    """The eight numbers that describe an utterance's confidence."""
    down = F.reverse(F.array_sort(posteriors))
    top = F.coalesce(F.get(down, F.lit(0)), F.lit(0.0))
    return {
        "max_posterior": top,
        "mean_posterior": mean_of(posteriors),
        "entropy": entropy(posteriors),
        "margin": top - F.coalesce(F.get(down, F.lit(1)), F.lit(0.0)),
        "vote_ratio": top if votes is None else votes,
        "n_tokens": F.size(posteriors).cast("double"),
        "acoustic": acoustic,
        "lm": lm,
    }
