"""Percentile, BCa and ABC confidence intervals.

Order statistics and moments over replicates are aggregations; the handful of numbers
per parameter that come of them are handled on the driver.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicelake.functions import normal
from choicelake.operators import validate

CLOSE = 1e-12


def alpha(confidence: float) -> float:
    return 100.0 - confidence


def endpoints(lower, upper) -> np.ndarray:
    return np.vstack([lower, upper])


# --- DataFrames of replicates (rep, parameter, value) --------------------------------------


def percentile_intervals(replicates: DataFrame, confidence: float) -> DataFrame:
    """(parameter, lower, upper): order statistics, next lower and next higher, never interpolated.

    A parameter's replicates are numbered by a sort that spills, never gathered in one row; nulls
    are left out.
    """
    validate.confidence(confidence)
    a = alpha(confidence) / 200.0
    some = replicates.where("value is not null").select("parameter", "value")
    counts = some.groupBy("parameter").agg(F.count("*").alias("n"))
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("parameter").orderBy("value")))
    # a share that is a whole place but for rounding counts as that place
    place = lambda share: F.round(F.lit(share) * (F.col("n") - 1), 9)
    at = lambda k: F.max(F.when(F.col("k") == k + 1, F.col("value")))
    return ranked.join(counts, "parameter").groupBy("parameter").agg(
        at(F.floor(place(a))).alias("lower"), at(F.ceil(place(1 - a))).alias("upper")
    )


def bca_moments(replicates: DataFrame, jackknife: DataFrame, estimates: DataFrame) -> DataFrame:
    """(parameter, share_below, acceleration): the aggregates a BCa interval needs."""
    below = replicates.join(estimates, "parameter").groupBy("parameter").agg(
        F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("share_below")
    )
    mean = jackknife.groupBy("parameter").agg(F.avg("value").alias("m"))
    d = F.col("m") - F.col("value")
    speed = jackknife.join(mean, "parameter").groupBy("parameter").agg(
        F.sum(F.pow(d, 3)).alias("d3"), F.sum(F.pow(d, 2)).alias("d2")
    )
    down = 6 * F.pow("d2", 1.5)
    return below.join(speed, "parameter").select(
        "parameter", "share_below", (F.col("d3") / F.when(down == 0, 1e-16).otherwise(down)).alias("acceleration")
    )


def abc_moments(influence: DataFrame) -> DataFrame:
    """(parameter, std_error, acceleration, bias) from (parameter, u, u2), a row per observation."""
    sums = influence.groupBy("parameter").agg(
        F.sum(F.pow("u", 2)).alias("s2"), F.sum(F.pow("u", 3)).alias("s3"), F.sum("u2").alias("second"), F.count("*").alias("n")
    )
    down = 6 * F.pow("s2", 1.5)
    return sums.select(
        "parameter", (F.sqrt("s2") / F.col("n")).alias("std_error"),
        (F.col("s3") / F.when(down == 0, 1e-16).otherwise(down)).alias("acceleration"), (F.col("second") / (2 * F.pow("n", 2))).alias("bias"),
    )


# --- arrays -----------------------------------------------------------------------------


def _lower_upper(column: np.ndarray, low: float, high: float) -> tuple[float, float]:
    values, n = np.sort(column), len(column) - 1
    place = lambda share: min(max(round(share / 100 * n, 9), 0.0), float(n))
    return float(values[math.floor(place(low))]), float(values[math.ceil(place(high))])


def percentile_interval(replicates: np.ndarray, confidence: float) -> np.ndarray:
    """2 x parameters."""
    validate.confidence(confidence)
    validate.dimensions(replicates, 2, "replicates")
    a = alpha(confidence) / 2
    return endpoints(*zip(*(_lower_upper(c, a, 100 - a) for c in replicates.T)))


def bca_bias_correction(replicates: np.ndarray, estimate: np.ndarray) -> np.ndarray:
    return np.array([normal.inverse_cdf(x) for x in (replicates < estimate).mean(0)])


def bca_acceleration(jackknife: np.ndarray) -> np.ndarray:
    d = jackknife.mean(0) - jackknife
    down = 6 * (d**2).sum(0) ** 1.5
    return (d**3).sum(0) / np.where(down == 0, 1e-16, down)


def bca_percentile(share: float, z0: float, acceleration: float) -> float:
    """Where the nominal ``share`` lies after correction, in percent; 0 or 100 if z0 is infinite."""
    if math.isinf(z0):
        return 100.0 if z0 > 0 else 0.0
    z = z0 + normal.inverse_cdf(share)
    return 100 * normal.cdf(z0 + z / (1 - acceleration * z))


def bca_interval(replicates: np.ndarray, jackknife: np.ndarray, estimate: np.ndarray, confidence: float) -> np.ndarray:
    validate.confidence(confidence)
    validate.dimensions(replicates, 2, "replicates")
    a = alpha(confidence) / 200
    out = []
    for column, z0, speed in zip(replicates.T, bca_bias_correction(replicates, estimate), bca_acceleration(jackknife)):
        if math.isinf(z0):
            warnings.warn("all replicates lie on one side of the estimate; their extremes are returned", stacklevel=2)
            out.append((float(column.min()), float(column.max())))
        else:
            out.append(_lower_upper(column, bca_percentile(a, z0, speed), bca_percentile(1 - a, z0, speed)))
    return endpoints(*zip(*out))


# --- ABC ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Weights:
    """A weight per observation: ``scale`` for all, and ``delta`` more at ``index``."""

    scale: float
    index: np.ndarray
    delta: np.ndarray

    def dense(self, n: int) -> np.ndarray:
        out = np.full(n, float(self.scale))
        out[self.index] += self.delta
        return out


def dense_weights(values: np.ndarray) -> Weights:
    return Weights(0.0, np.arange(len(values)), np.asarray(values, float))


Refit = Callable[[list[Weights]], np.ndarray]  # -> refits x parameters


def empirical_influence(plus: np.ndarray, minus: np.ndarray, epsilon: float) -> np.ndarray:
    return np.where(np.isclose(plus, minus, rtol=0, atol=CLOSE), 0.0, (plus - minus) / (2 * epsilon))


def second_influence(estimate: np.ndarray, plus: np.ndarray, minus: np.ndarray, epsilon: float) -> np.ndarray:
    top = plus - 2 * estimate + minus
    return np.where(np.isclose(top, 0.0, rtol=0, atol=CLOSE), 0.0, top / epsilon**2)


def abc_std_error(influence: np.ndarray) -> np.ndarray:
    return np.sqrt((influence**2).sum(0)) / len(influence)


def abc_acceleration(influence: np.ndarray) -> np.ndarray:
    down = 6 * (influence**2).sum(0) ** 1.5
    return (influence**3).sum(0) / np.where(down == 0, 1e-16, down)


def abc_bias(second: np.ndarray) -> np.ndarray:
    return second.sum(0) / (2 * len(second) ** 2)


def total_curvature(bias, std_error, quadratic):
    return bias / std_error - quadratic


def abc_bias_correction(acceleration: float, curvature: float) -> float:
    return normal.inverse_cdf(2 * normal.cdf(acceleration) * normal.cdf(-curvature))


def quadratic_coefficient(refit: Refit, estimate, influence, std_error, epsilon, textbook: bool = False) -> np.ndarray:
    """Curvature along each parameter's own influence, from two refits a parameter.

    The textbook form moves along the influence in the standard error's units over n squared and takes the plain
    second difference; the usual one also divides by twice the standard error.
    """
    n, k = influence.shape
    direction = influence / (n**2 * std_error)
    base = np.full(n, 1.0 / n)
    shrink = (1 - epsilon) * base if textbook else base
    up, down = ([dense_weights(shrink + sign * epsilon * direction[:, j]) for j in range(k)] for sign in (1, -1))
    top = np.diag(refit(up)) - 2 * estimate + np.diag(refit(down))
    return np.where(np.isclose(top, 0.0, rtol=0, atol=1e-10), 0.0, top / (epsilon**2 if textbook else 2 * std_error * epsilon**2))


def abc_endpoint(refit: Refit, share: float, z0: np.ndarray, acceleration, std_error, influence, textbook: bool = False) -> np.ndarray:
    """Refits at weights moved along the influence as far as the corrected quantile asks.

    The textbook form leaves out the division by n squared.
    """
    n, k = influence.shape
    weights = []
    for j in range(k):
        z = z0[j] + normal.inverse_cdf(share)
        step = z / (1 - acceleration[j] * z) ** 2 / std_error[j]
        weights.append(dense_weights(1.0 / n + step * influence[:, j] / (1 if textbook else n**2)))
    return np.diag(refit(weights))


def abc_interval(refit: Refit, estimate: np.ndarray, n: int, confidence: float, epsilon: float = 0.001) -> np.ndarray:
    """2 x parameters, from 2 n + 4 k refits under observation weights that add up to 1."""
    validate.confidence(confidence)
    plus, minus = (refit([Weights((1 - e) / n, np.array([i]), np.array([e])) for i in range(n)]) for e in (epsilon, -epsilon))
    influence = empirical_influence(plus, minus, epsilon)
    second = second_influence(estimate, plus, minus, epsilon)
    std_error, acceleration, bias = abc_std_error(influence), abc_acceleration(influence), abc_bias(second)
    quadratic = quadratic_coefficient(refit, estimate, influence, std_error, epsilon)
    z0 = np.array([abc_bias_correction(a, c) for a, c in zip(acceleration, total_curvature(bias, std_error, quadratic))])
    a = alpha(confidence) / 200
    return endpoints(*(abc_endpoint(refit, s, z0, acceleration, std_error, influence) for s in (a, 1 - a)))
