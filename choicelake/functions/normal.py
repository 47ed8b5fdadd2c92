"""The standard normal law, from the standard library alone."""

from __future__ import annotations

import math
from statistics import NormalDist

_STANDARD = NormalDist()


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def inverse_cdf(p: float) -> float:
    """Quantile; infinite at 0 and 1."""
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _STANDARD.inv_cdf(p)


def two_sided_p(t: float) -> float:
    """Probability of a value further from 0 than ``t``."""
    return math.erfc(abs(t) / math.sqrt(2.0))
