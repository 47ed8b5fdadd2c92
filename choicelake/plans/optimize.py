"""Minimisers: BFGS with a strong Wolfe search, and Newton with a safeguarded Hessian."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

METHODS = {"bfgs": "bfgs", "l-bfgs-b": "bfgs", "cg": "bfgs", "newton-cg": "newton", "newton": "newton", "trust-ncg": "newton", "trust-exact": "newton"}


@dataclass
class Outcome:
    x: np.ndarray
    value: float
    gradient: np.ndarray
    iterations: int
    evaluations: int
    success: bool
    message: str


#: Of a value's size: what sums of many terms may be wrong by.
NOISE = 1e-13


def is_newton(method: str) -> bool:
    return METHODS.get(method.lower()) == "newton"


def _wolfe(f, x, value, grad, direction, c1=1e-4, c2=0.9, most=40):
    """(step, value, gradient) that satisfies both conditions; the best met if none does.

    Near the least value, a sum over many rows is too coarse to tell which of two points is lower.  There a step
    counts as lower if the slope says so; and if the whole descent to be hoped for is lost in the value's rounding,
    only the full step is tried, for a smaller gradient.
    """
    slope, noise = float(grad @ direction), NOISE * abs(value)
    low, high, step = 0.0, np.inf, 1.0
    best = None
    for _ in range(most):
        v, g = f(x + step * direction)
        along = float(g @ direction)
        if -slope <= noise:
            return (step, v, g) if v <= value + noise and np.abs(g).max() < np.abs(grad).max() else None
        fits = np.isfinite(v) and (v <= value + c1 * step * slope or v <= value + noise and along <= (2 * c1 - 1) * slope)
        if fits and (best is None or v < best[1]):
            best = (step, v, g)
        if not fits:
            high = step
        elif along < c2 * slope:
            low = step
        elif along > -c2 * slope:
            high = step
        else:
            return step, v, g
        step = 2 * low if np.isinf(high) and low else 0.5 * (low + high) if not np.isinf(high) else 2 * step
        if step * np.abs(direction).max() < 1e-15 or (not np.isinf(high) and high - low < 1e-14):
            break
    return best


def _first_inverse(hessian: Callable, x: np.ndarray) -> np.ndarray | None:
    """The inverse of the Hessian where a search begins, if that is plainly positive definite."""
    h = hessian(x)
    if not len(x) or not np.isfinite(h).all():
        return None
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    return (vectors / values) @ vectors.T if values.min() > 1e-10 * values.max() > 0 else None


def minimise(f: Callable, x0: np.ndarray, method: str = "BFGS", gradient_tol: float = 1e-6, loss_tol: float = 1e-6,
             maxiter: int = 1000, hessian: Callable | None = None) -> Outcome:
    """``f`` returns (value, gradient).  Never raises on a failed search; says so in the outcome.

    Two searches are built; other names of ``method`` stand for one of them: "l-bfgs-b" and "cg" run "bfgs";
    "newton-cg", "trust-ncg" and "trust-exact" run "newton", which without a ``hessian`` is "bfgs" too.

    "bfgs" begins with the curvature of the ``hessian`` at ``x0`` if that is given and positive definite.

    Stops when the largest entry of the gradient is small.  ``loss_tol`` ends a search that
    has come to a halt: no better value and a gradient that is small beside it.  Where the descent to be hoped for is
    lost in the value's rounding, as the gradient of a large sum can stay above any fixed bound, that is at once.
    """
    kind = METHODS.get(method.lower())
    if kind is None:
        raise ValueError(f"methods are {sorted(METHODS)}, not {method!r}")
    if kind == "newton" and hessian is None:
        kind = "bfgs"
    calls = 0

    def count(x):
        nonlocal calls
        calls += 1
        return f(x)

    x = np.array(x0, float)
    value, grad = count(x)
    inverse, first = np.eye(len(x)), True
    if kind == "bfgs" and hessian is not None and np.abs(grad).max(initial=0.0) > gradient_tol:
        known = _first_inverse(hessian, x)
        if known is not None:
            inverse, first = known, False
    for i in range(maxiter):
        if np.abs(grad).max(initial=0.0) <= gradient_tol:
            return Outcome(x, value, grad, i, calls, True, "the gradient is small")
        if kind == "newton":
            h = hessian(x)
            values, vectors = np.linalg.eigh((h + h.T) / 2)
            floor = max(values.max(initial=0.0), 1.0) * 1e-10
            direction = -vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), floor))
        else:
            direction = -inverse @ grad
            if grad @ direction >= 0:
                inverse, direction = np.eye(len(x)), -grad
            if first:
                direction = direction / max(1.0, np.abs(grad).max())
        found = _wolfe(count, x, value, grad, direction)
        if found is None:
            halted = -float(grad @ direction) <= NOISE * abs(value)
            if kind == "bfgs" and not halted and not np.array_equal(inverse, np.eye(len(x))):
                inverse, first = np.eye(len(x)), True
                continue
            small = np.abs(grad).max() <= max(gradient_tol, loss_tol * max(1.0, abs(value)))
            return Outcome(x, value, grad, i, calls, bool(small), "no further step lowers the value")
        step, new_value, new_grad = found
        s, y = step * direction, new_grad - grad
        if kind == "bfgs" and s @ y > 1e-14 * np.linalg.norm(s) * np.linalg.norm(y):
            if first:
                inverse, first = np.eye(len(x)) * (s @ y) / (y @ y), False
            rho = 1.0 / (s @ y)
            left = np.eye(len(x)) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        x, value, grad = x + s, new_value, new_grad
    return Outcome(x, value, grad, maxiter, calls, False, "the most iterations were made")
