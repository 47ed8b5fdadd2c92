"""Utility transforms h(V) and their derivatives, as NumPy kernels and as Catalyst expressions.

V is the systematic utility.  Natural shapes: ``gamma = exp(shape)`` for scobit and
uneven, ``c = softmax(eta)`` with a reference for asymmetric.  Both forms keep the
same guards, so that they agree to rounding over the whole range of V.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1e300
CLIP = 700.0
CLOGLOG_LINEAR = 3.7


def _bounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(x, nan=0.0, posinf=LIMIT, neginf=-LIMIT), -LIMIT, LIMIT)


# --- NumPy: h(V) -----------------------------------------------------------------------


def identity(v: np.ndarray) -> np.ndarray:
    return v


def cloglog(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", divide="ignore"):
        inner = np.exp(np.minimum(v, CLOGLOG_LINEAR))
        return _bounded(np.where(v >= CLOGLOG_LINEAR, np.exp(v), np.log(np.expm1(inner))))


def scobit(v: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    a = gamma * np.logaddexp(0.0, -v)
    with np.errstate(divide="ignore"):
        usual = -(a + np.log(-np.expm1(-a)))
    return _bounded(np.where(a < 1e-300, v - np.log(gamma), usual))


def uneven(v: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return _bounded(v + np.logaddexp(0.0, -v) - np.logaddexp(0.0, -gamma * v))


def asym(v: np.ndarray, c: np.ndarray, n_alternatives: int) -> np.ndarray:
    return _bounded(_log_c(c) - v * _slope(v, c, n_alternatives))


def _log_c(c: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return _bounded(np.log(c))


def _slope(v: np.ndarray, c: np.ndarray, n_alternatives: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(v >= 0, _log_c(c), _bounded(np.log((1.0 - c) / max(n_alternatives - 1, 1))))


def natural_asym(eta: np.ndarray, reference: int) -> np.ndarray:
    """All J shares from the J - 1 free parameters; the reference has 0."""
    full = np.insert(np.asarray(eta, float), reference, 0.0)
    full = np.exp(np.clip(full - full.max(), -CLIP, 0.0))
    return full / full.sum()


def natural_nest(theta: np.ndarray) -> np.ndarray:
    """Logistic, never exactly 0."""
    with np.errstate(over="ignore"):
        out = 1.0 / (1.0 + np.exp(-np.asarray(theta, float)))
    return np.where(out == 0, 1e-300, out)


# --- NumPy: derivatives ------------------------------------------------------------------


def cloglog_dv(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        e = np.exp(v)
        out = e / -np.expm1(-e)
    return np.clip(np.where(e == 0, 1.0, np.where(np.isfinite(out), out, LIMIT)), 0, LIMIT)


def scobit_dv(v: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    a = gamma * np.logaddexp(0.0, -v)
    share = np.exp(-np.logaddexp(0.0, v))  # e^-v / (1 + e^-v)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = gamma * share / -np.expm1(-a)
    return np.where((a < 1e-300) | ~np.isfinite(out), 1.0, out)


def scobit_dshape(v: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    a = gamma * np.logaddexp(0.0, -v)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -a / -np.expm1(-a)
    return _bounded(np.where(a < 1e-300, -1.0, out))


def uneven_dv(v: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.exp(-np.logaddexp(0.0, -v)) + gamma * np.exp(-np.logaddexp(0.0, gamma * v))


def uneven_dshape(v: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = gamma * v
        return _bounded(scaled * np.exp(-np.logaddexp(0.0, scaled)))


def asym_dv(v: np.ndarray, c: np.ndarray, n_alternatives: int) -> np.ndarray:
    return -_slope(v, c, n_alternatives)


def asym_dc(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return _bounded(1.0 / c - v * np.where(v >= 0, 1.0 / c, -1.0 / (1.0 - c)))


def dc_deta(c: np.ndarray, reference: int) -> np.ndarray:
    """J x (J - 1): how the shares move with the free parameters."""
    return np.delete(np.diag(c) - np.outer(c, c), reference, axis=1)


# --- Catalyst ---------------------------------------------------------------------------


def bounded_exp(x: Column) -> Column:
    """exp within the clip; NaN is looked at first, as it compares above all numbers."""
    clipped = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x))
    return F.exp(F.when(F.isnan(x), F.lit(0.0)).otherwise(clipped))


def _ln(x: Column) -> Column:
    """ln that is the lower limit at 0, where Spark's is null."""
    return F.coalesce(F.ln(x), F.lit(-LIMIT))


def softplus_column(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def cloglog_column(v: Column) -> Column:
    inner = F.exp(F.least(v, F.lit(CLOGLOG_LINEAR)))
    return F.when(v >= CLOGLOG_LINEAR, F.least(F.exp(v), F.lit(LIMIT))).otherwise(_ln(F.expm1(inner)))


def scobit_column(v: Column, gamma: Column) -> Column:
    a = gamma * softplus_column(-v)
    return F.when(a < 1e-300, v - F.ln(gamma)).otherwise(-(a + _ln(-F.expm1(-a))))


def uneven_column(v: Column, gamma: Column) -> Column:
    return v + softplus_column(-v) - softplus_column(-gamma * v)


def asym_column(v: Column, c: Column, n_alternatives: int) -> Column:
    log_c = _ln(c)
    slope = F.when(v >= 0, log_c).otherwise(_ln((1.0 - c) / max(n_alternatives - 1, 1)))
    return log_c - v * slope
