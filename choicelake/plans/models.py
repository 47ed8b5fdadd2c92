"""Choice models: declared on a long table, fitted over its blocks, applied as window aggregates."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelake.functions import normal, transforms
from choicelake.operators import softmax, spec, validate
from choicelake.plans import kernels
from choicelake.plans.blocks import Blocks, unit_draws
from choicelake.plans.optimize import Outcome, is_newton, minimise
from choicelake.sources.tables import read_card, read_table, write_card


Vector = Sequence[float] | np.ndarray | None


@dataclass
class FitResult:
    """Everything a fit gives, in the order of the parameter vector."""

    names: list[str]
    params: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    initial_log_likelihood: float
    gradient: np.ndarray
    hessian: np.ndarray
    information: np.ndarray
    cov: np.ndarray
    robust_cov: np.ndarray
    chi_square: float
    n_obs: int
    success: bool
    message: str
    iterations: int
    evaluations: int
    seconds: float
    constrained: tuple[int, ...] = ()
    ridge: float | None = None
    std_err: np.ndarray = field(init=False)
    robust_std_err: np.ndarray = field(init=False)

    def __post_init__(self):
        self.std_err, self.robust_std_err = (self._errors(c) for c in (self.cov, self.robust_cov))

    def _errors(self, cov: np.ndarray) -> np.ndarray:
        variance = np.diag(cov).copy()
        variance[list(self.constrained)] = np.nan
        if (variance < 0).any():
            warnings.warn("some variances are negative; their standard errors are null", stacklevel=3)
        with np.errstate(invalid="ignore"):
            return np.sqrt(variance)

    @property
    def k(self) -> int:
        return len(self.params)

    @property
    def rho_squared(self) -> float:
        return 1 - self.log_likelihood / self.null_log_likelihood

    @property
    def rho_bar_squared(self) -> float:
        return 1 - (self.log_likelihood - self.k) / self.null_log_likelihood

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.k

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + math.log(self.n_obs) * self.k

    def rows(self) -> list[tuple]:
        """(parameter, parameters, std_err, t_stats, p_values and the robust three); NaN as None."""
        out = []
        for i, name in enumerate(self.names):
            row: list = [name, float(self.params[i])]
            for error in (self.std_err[i], self.robust_std_err[i]):
                t = self.params[i] / error if error and not math.isnan(error) else math.nan
                row += [x if not math.isnan(x) else None for x in (float(error), float(t), normal.two_sided_p(t) if not math.isnan(t) else math.nan)]
            out.append(tuple(row))
        return out

    def fit_rows(self) -> list[tuple]:
        return [
            ("Number of Parameters", float(self.k)), ("Number of Observations", float(self.n_obs)),
            ("Null Log-Likelihood", self.null_log_likelihood), ("Fitted Log-Likelihood", self.log_likelihood),
            ("Rho-Squared", self.rho_squared), ("Rho-Bar-Squared", self.rho_bar_squared), ("Estimation Message", math.nan),
        ]


_KEYS = ("alt_id_col", "obs_id_col", "choice_col")
#: What a result makes of its other fields.
_DERIVED = ("std_err", "robust_std_err")


class ChoiceModel:
    """Base of the seven models.  The table is not changed; ``fit_mle`` keeps what it found in ``result``."""

    display = ""
    family_type = kernels.Family
    wants_shapes = 0  # 0: none, 1: one per alternative, -1: all but a reference

    def __init__(self, data, alt_id_col: str, obs_id_col: str, choice_col: str, specification: Mapping,
                 intercept_ref_pos: int | None = None, shape_ref_pos: int | None = None, names: Mapping | None = None,
                 intercept_names: list[str] | None = None, shape_names: list[str] | None = None,
                 nest_spec: Mapping | None = None, mixing_id_col: str | None = None, mixing_vars: list[str] | None = None):
        df = read_table(data)
        validate.mapping(specification, "the specification")
        validate.columns_present([alt_id_col, obs_id_col, choice_col], df, "key columns")
        df = spec.with_intercept(df, specification)
        validate.columns_present(specification, df, "specification columns")
        validate.numeric_types(specification, df)
        self.rows, alternatives = validate.overview(specification, df, alt_id_col)
        self.alt_id_col, self.obs_id_col, self.choice_col = alt_id_col, obs_id_col, choice_col
        self.specification, self.names = specification, names
        j = len(alternatives)
        self._check_arguments(j, alternatives, intercept_ref_pos, shape_ref_pos, intercept_names, shape_names, nest_spec, mixing_id_col)
        self.intercept_ref_pos, self.shape_ref_pos = intercept_ref_pos, shape_ref_pos
        self.intercept_names, self.shape_names = intercept_names, shape_names
        self.nest_spec, self.mixing_id_col, self.mixing_vars = nest_spec, mixing_id_col, list(mixing_vars or ())
        self.data = df
        self.design = spec.bind(specification, alternatives, names)
        validate.mixing_names(self.mixing_vars, self.design.names, names is not None)
        self.layout = spec.Layout(
            nests=len(nest_spec or ()), shapes=j if self.wants_shapes == 1 else j - 1 if self.wants_shapes == -1 else 0,
            intercepts=0 if intercept_ref_pos is None else j - 1, index=len(self.design.terms), sigmas=len(self.mixing_vars),
        )
        others = lambda ref: [a for i, a in enumerate(alternatives) if i != ref]
        self.param_names = [
            *(nest_spec or ()),
            *(shape_names or [f"Shape_{a}" for a in (alternatives if self.wants_shapes == 1 else others(shape_ref_pos))][: self.layout.shapes]),
            *(intercept_names or [f"Outside_ASC_{a}" for a in others(intercept_ref_pos)][: self.layout.intercepts]),
            *self.design.names, *(f"Sigma {v}" for v in self.mixing_vars),
        ]
        self.result: FitResult | None = None

    def _check_arguments(self, j, alternatives, intercept_ref, shape_ref, intercept_names, shape_names, nests, mixing_id):
        validate.reference_position(intercept_ref, j, "intercept_ref_pos", intercept_names is not None)
        validate.name_count(intercept_names, j, intercept_ref is not None, "intercept_names")
        if self.wants_shapes == -1:
            validate.reference_position(shape_ref, j, "shape_ref_pos", True)
        elif shape_ref is not None:
            warnings.warn(f"{self.display} has no reference shape; shape_ref_pos is not used", stacklevel=4)
        if self.wants_shapes:
            validate.name_count(shape_names, j, self.wants_shapes == -1, "shape_names")
        elif shape_names is not None:
            warnings.warn(f"{self.display} has no shapes; shape_names is not used", stacklevel=4)
        if nests is not None:
            validate.nests(nests, alternatives)

    # --- fitting ---

    def family(self) -> kernels.Family:
        return self.family_type(self.layout, len(self.design.alternatives), self.intercept_ref_pos, self.shape_ref_pos)

    def blocks(self, weights: str | Column | None = None, **more) -> Blocks:
        return Blocks(self.data, self.design, self.obs_id_col, self.alt_id_col, self.choice_col, weights, rows=self.rows, **more)

    def starting_values(self, init_vals, *parts) -> np.ndarray:
        """One checked vector from ``init_vals`` or from its parts (shapes, intercepts, coefficients)."""
        init_shapes, init_intercepts, init_coefs = parts or (None, None, None)
        if init_vals is None:
            if init_coefs is None:
                raise ValueError("init_vals, or init_coefs and the parts before them, are needed")
            parts = [(init_shapes, self.layout.shapes, "init_shapes"), (init_intercepts, self.layout.intercepts, "init_intercepts"),
                     (init_coefs, self.layout.index + self.layout.sigmas, "init_coefs")]
            for given, n, title in parts:
                if (0 if given is None else len(given)) != n:
                    raise ValueError(f"{title}: {n} values are needed")
            init_vals = np.concatenate([np.asarray(p, float) for p, n, _ in parts if n])
        elif init_shapes is not None or init_intercepts is not None or init_coefs is not None:
            raise ValueError("give init_vals or its parts, not both")
        init_vals = np.asarray(init_vals, float)
        if init_vals.ndim != 1 or len(init_vals) != self.layout.size:
            raise ValueError(f"{self.layout.size} starting values are needed")
        return init_vals

    def constraints(self, positions: Iterable[int] | None) -> tuple[int, ...]:
        return tuple(sorted(set(positions or ())))

    def fit_mle(self, init_vals: Vector = None, init_shapes: Vector = None, init_intercepts: Vector = None, init_coefs: Vector = None, print_res: bool = False,
                method: str = "BFGS", loss_tol: float = 1e-6, gradient_tol: float = 1e-6, maxiter: int = 1000,
                ridge: float | None = None, constrained_pos=None, just_point: bool = False, weights: str | Column | None = None,
                **block_options) -> FitResult | Outcome:
        """Maximum likelihood, each evaluation one job over blocks that were laid out once.

        ``weights`` is a column of non-negative row weights.  Constrained positions keep their
        starting values.  ``just_point`` skips all but the point estimate.
        """
        validate.ridge(ridge)
        if isinstance(weights, str):
            validate.weights(self.data, weights)
        if ridge is not None:
            warnings.warn("standard errors under a ridge penalty are not those of the unpenalised model", stacklevel=2)
        theta0, constrained = self.starting_values(init_vals, init_shapes, init_intercepts, init_coefs), self.constraints(constrained_pos)
        blocks, began = self.blocks(weights, **block_options), time.time()
        try:
            fit = fit_theta(lambda t, s: blocks.evaluate(self.family(), t, s), self.family(), theta0, constrained, ridge, method, loss_tol, gradient_tol, maxiter)
            if just_point:
                return fit
            null, first = (self._value(blocks, t, ridge) for t in (np.zeros_like(theta0), theta0))
            totals = self.family().penalised(fit.x, blocks.evaluate(self.family(), fit.x, True), ridge)
            n_obs = self._n_obs(blocks)
        finally:
            blocks.release()
        hessian = totals.hessian.copy()
        if self.layout.nests or self.layout.sigmas:
            for i in constrained:
                hessian[i, :] = hessian[:, i] = 0
                hessian[i, i] = -1
        inverse = np.linalg.pinv(hessian)
        gradient = totals.gradient.copy()
        gradient[list(constrained)] = 0
        self.result = FitResult(
            self.param_names, fit.x, totals.value, null, first, gradient, hessian, totals.information, -inverse,
            inverse @ totals.information @ inverse, totals.chi_square, n_obs,
            fit.success, fit.message, fit.iterations, fit.evaluations, time.time() - began, constrained, ridge,
        )
        if print_res:
            self.print_summaries()
        return self.result

    def _n_obs(self, blocks: Blocks) -> int:
        return blocks.n_obs

    def _value(self, blocks: Blocks, theta: np.ndarray, ridge: float | None) -> float:
        return self.family().penalised(theta, blocks.evaluate(self.family(), theta), ridge).value

    def log_likelihood(self, theta, ridge: float | None = None, weights=None, **block_options) -> float:
        blocks = self.blocks(weights, **block_options)
        try:
            return self._value(blocks, np.asarray(theta, float), ridge)
        finally:
            blocks.release()

    # --- results ---

    def _fitted(self) -> FitResult:
        if self.result is None:
            raise NotImplementedError("fit the model first")
        return self.result

    @property
    def summary(self) -> DataFrame:
        schema = "parameter string, parameters double, std_err double, t_stats double, p_values double, robust_std_err double, robust_t_stats double, robust_p_values double"
        return self.data.sparkSession.createDataFrame(self._fitted().rows(), schema)

    @property
    def fit_summary(self) -> DataFrame:
        r = self._fitted()
        rows = [(n, r.message if n == "Estimation Message" else repr(v)) for n, v in r.fit_rows()]
        return self.data.sparkSession.createDataFrame(rows, "name string, value string")

    def print_summaries(self) -> None:
        self._fitted()
        self.fit_summary.show(truncate=False)
        self.summary.show(truncate=False)

    def conf_int(self, alpha: float = 0.05, coefs: list[str] | None = None) -> DataFrame:
        """(parameter, lower, upper), for some parameters or all."""
        r, z = self._fitted(), normal.inverse_cdf(1 - alpha / 2)
        rows = [
            (n, float(p - z * s), float(p + z * s)) for n, p, s in zip(r.names, r.params, r.std_err) if coefs is None or n in coefs
        ]
        return self.data.sparkSession.createDataFrame(rows, "parameter string, lower double, upper double")

    def text_summary(self, title: str | None = None, alpha: float = 0.05) -> str:
        """The summaries as fixed-width text."""
        r, z = self._fitted(), normal.inverse_cdf(1 - alpha / 2)
        lines = [title or f"{self.display} regression results", "=" * 78]
        for pair in (
            (("observations", r.n_obs), ("log-likelihood", f"{r.log_likelihood:.3f}")), (("parameters", r.k), ("null", f"{r.null_log_likelihood:.3f}")),
            (("AIC", f"{r.aic:.3f}"), ("rho-squared", f"{r.rho_squared:.3f}")), (("BIC", f"{r.bic:.3f}"), ("rho-bar-squared", f"{r.rho_bar_squared:.3f}")),
        ):
            lines.append("   ".join(f"{n + ':':<18}{v!s:>18}" for n, v in pair))
        lines += ["-" * 78, f"{'':<26}{'coef':>10}{'std err':>10}{'z':>8}{'P>|z|':>8}{'low':>8}{'high':>8}"]
        for name, value, error, t, p, *_ in r.rows():
            cells = [f"{value:10.4f}", *("".rjust(w) if x is None else f"{x:{w}.3f}" for x, w in ((error, 10), (t, 8), (p, 8)))]
            ends = ["", ""] if error is None else [f"{value + s * z * error:.3f}" for s in (-1, 1)]
            lines.append(f"{name:<26}" + "".join(cells) + "".join(e.rjust(8) for e in ends))
        return "\n".join(lines)

    # --- persistence ---

    def save(self, path: str) -> None:
        """A model card: all arguments and, if fitted, all of the result."""
        r = self.result
        card = {
            "model_type": next(k for k, v in MODELS.items() if v is type(self)), "alternatives": list(self.design.alternatives),
            **{k: getattr(self, k) for k in _KEYS}, "specification": dict(self.specification),
            "names": None if self.names is None else dict(self.names), "intercept_ref_pos": self.intercept_ref_pos,
            "shape_ref_pos": self.shape_ref_pos, "nest_spec": None if self.nest_spec is None else dict(self.nest_spec),
            "mixing_id_col": self.mixing_id_col, "mixing_vars": self.mixing_vars, "param_names": self.param_names,
            "params": None if r is None else r.params.tolist(), "cov": None if r is None else r.cov.tolist(),
            "log_likelihood": None if r is None else r.log_likelihood,
            "intercept_names": self.intercept_names, "shape_names": self.shape_names,
            "result": None if r is None else {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(r).items() if k not in _DERIVED},
        }
        write_card(self.data.sparkSession, card, path)

    # --- prediction ---

    def _parameters(self, param_list) -> np.ndarray:
        """The flat vector, or parameters x sets, from [index, intercepts, shapes, nests]."""
        if param_list is None:
            return self._fitted().params
        validate.parameter_list(param_list, self.layout)
        return np.concatenate([x for x in reversed(param_list) if x is not None])

    def transformed(self, theta: np.ndarray) -> Column:
        """h(V) plus outside intercepts for fixed parameters, over the table's columns."""
        _, shapes, intercepts, beta = self.layout.split(theta)
        h = self._h(self.design.index(self.alt_id_col, beta), shapes)
        if intercepts is not None:
            h = h + self._by_alternative(np.insert(intercepts, self.intercept_ref_pos, 0.0))
        return h

    def _h(self, v: Column, shapes) -> Column:
        return v

    def _by_alternative(self, values) -> Column:
        out = None
        for a, value in zip(self.design.alternatives, values):
            hit = F.col(f"`{self.alt_id_col}`") == a
            out = F.when(hit, F.lit(float(value))) if out is None else out.when(hit, F.lit(float(value)))
        return out.otherwise(F.lit(0.0))

    def _prepared(self, data, choice_col, long_probabilities) -> DataFrame:
        validate.chosen_output(choice_col, long_probabilities)
        df = spec.with_intercept(read_table(data), self.specification)
        wanted = [self.alt_id_col, self.obs_id_col, *self.specification, *([choice_col] if choice_col else [])]
        validate.columns_present(wanted, df, "columns for prediction")
        return df

    def predict(self, data, param_list: list | None = None, return_long_probs: bool = True, choice_col: str | None = None,
                num_draws: int | None = None, seed: int | None = None) -> DataFrame:
        """``data`` with ``probability``; with ``return_long_probs`` False the chosen rows alone.

        Alternatives are those the model was made with, whatever the new data hold.  Two-dimensional
        parameters give a row per set, with ``set_id`` from 0.
        """
        df, theta = self._prepared(data, choice_col, return_long_probs), self._parameters(param_list)
        out = self._predicted_sets(df, theta) if theta.ndim == 2 else self._predicted(df, theta, num_draws, seed)
        return out if return_long_probs else softmax.chosen(out, choice_col)

    def _predicted_sets(self, df: DataFrame, theta: np.ndarray) -> DataFrame:
        return softmax.sets(df, [self.transformed(column) for column in theta.T], self.obs_id_col)

    def _predicted(self, df: DataFrame, theta: np.ndarray, num_draws, seed) -> DataFrame:
        return softmax.flat(df, self.transformed(theta), self.obs_id_col)


def fit_theta(evaluate, family, theta0, constrained, ridge, method, loss_tol, gradient_tol, maxiter) -> Outcome:
    """Minimise the negative penalised value, constrained positions held where they start."""
    free = np.ones(len(theta0), bool)
    free[list(constrained)] = False

    def whole(x):
        theta = np.array(theta0, float)
        theta[free] = x
        return theta

    last: dict = {}  # an evaluation that has the Hessian serves value, gradient and curvature
    newton = is_newton(method)

    def totals_at(x, second):
        key = x.tobytes()
        if key not in last or second and last[key].hessian is None:
            theta = whole(x)
            found = family.penalised(theta, evaluate(theta, second), ridge)
            last.clear()
            last[key] = found
        return last[key]

    def value_and_gradient(x):
        totals = totals_at(x, newton or not last)
        return -totals.value, -totals.gradient[free]

    def hessian(x):
        return -totals_at(x, True).hessian[np.ix_(free, free)]

    fit = minimise(value_and_gradient, np.asarray(theta0, float)[free], method, gradient_tol, loss_tol, maxiter, hessian)
    fit.x = whole(fit.x)
    return fit


class _NoIntercepts(ChoiceModel):
    def _check_arguments(self, j, alternatives, intercept_ref, *rest):
        if intercept_ref is not None:
            raise ValueError(f"{self.display} takes intercepts by its specification, not outside of it")
        super()._check_arguments(j, alternatives, intercept_ref, *rest)


class MultinomialLogit(_NoIntercepts):
    display = "Multinomial Logit Model"


class MultinomialCloglog(ChoiceModel):
    display = "Multinomial Clog-log Model"
    family_type = kernels.Cloglog

    def _h(self, v, shapes):
        return transforms.cloglog_column(v)


class _Gamma(ChoiceModel):
    wants_shapes = 1
    column = None

    def _h(self, v, shapes):
        return type(self).column(v, self._by_alternative(np.exp(np.clip(shapes, -transforms.CLIP, transforms.CLIP))))


class MultinomialScobit(_Gamma):
    display = "Multinomial Scobit Model"
    family_type = kernels.Scobit
    column = staticmethod(transforms.scobit_column)


class MultinomialUneven(_Gamma):
    display = "Multinomial Uneven Logit Model"
    family_type = kernels.Uneven
    column = staticmethod(transforms.uneven_column)


class MultinomialAsymmetric(ChoiceModel):
    display = "Multinomial Asymmetric Logit Model"
    family_type = kernels.Asym
    wants_shapes = -1

    def _h(self, v, shapes):
        c = self._by_alternative(transforms.natural_asym(shapes, self.shape_ref_pos))
        return transforms.asym_column(v, c, len(self.design.alternatives))


class NestedLogit(_NoIntercepts):
    display = "Nested Logit Model"

    def _check_arguments(self, j, alternatives, intercept_ref, shape_ref, intercept_names, shape_names, nests, mixing_id):
        if nests is None:
            raise ValueError("nest_spec is needed")
        super()._check_arguments(j, alternatives, intercept_ref, shape_ref, intercept_names, shape_names, nests, mixing_id)

    def family(self):
        nest = {a: i for i, members in enumerate(self.nest_spec.values()) for a in members}
        return kernels.Nested(self.layout, len(self.design.alternatives), nest_of_alt=np.array([nest[a] for a in self.design.alternatives]))

    def constraints(self, positions):
        return super().constraints([*(positions or ()), *validate.degenerate_nests(self.nest_spec)])

    def _predicted_sets(self, df, theta):
        raise NotImplementedError("one set of parameters at a time")

    def _predicted(self, df, theta, num_draws, seed):
        natural = transforms.natural_nest(theta[: self.layout.nests]).tolist()
        index = self.design.index(self.alt_id_col, theta[self.layout.nests :])
        return softmax.nested(df, index, natural, self.nest_spec, self.obs_id_col, self.alt_id_col)


class MixedLogit(_NoIntercepts):
    display = "Mixed Logit Model"

    def _check_arguments(self, j, alternatives, intercept_ref, shape_ref, intercept_names, shape_names, nests, mixing_id):
        if mixing_id is None:
            raise ValueError("mixing_id_col is needed")
        super()._check_arguments(j, alternatives, intercept_ref, shape_ref, intercept_names, shape_names, nests, mixing_id)

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        validate.columns_present([self.mixing_id_col], self.data, "mixing_id_col")
        self.mixing_pos = spec.positions(self.mixing_vars, self.design.names)

    def family(self):
        return kernels.Mixed(self.layout, len(self.design.alternatives), mixing=tuple(self.mixing_pos))

    def blocks(self, weights=None, num_draws: int = 0, seed: int | None = None, draws: dict | DataFrame | None = None, **more):
        return Blocks(
            self.data, self.design, self.obs_id_col, self.alt_id_col, self.choice_col, weights, mix_id=self.mixing_id_col,
            n_draws=num_draws, mixing=len(self.mixing_vars), seed=seed, draws=draws, rows=self.rows, **more,
        )

    def _n_obs(self, blocks):
        return self.data.select(self.obs_id_col).distinct().count()  # an observation may be in several units

    def fit_mle(self, init_vals, num_draws: int, seed: int | None = None, **options):
        """Simulated maximum likelihood; draws depend on the unit's id and ``seed`` alone."""
        return super().fit_mle(init_vals, num_draws=num_draws, seed=seed, **options)

    def draws_of(self, df: DataFrame, num_draws: int, seed: int | None) -> DataFrame:
        """(mixing id, draw_id, eta_0, ...) for every unit of ``df``: those a fit with this seed uses.

        Made from a unit's id and the seed where the unit lies; none passes through the driver.
        """
        count, seed, unit = len(self.mixing_vars), seed or 0, self.mixing_id_col
        etas = [f"eta_{m}" for m in range(count)]

        def make(batches):
            for batch in batches:
                ids = batch[unit].to_numpy()
                made = unit_draws(ids, num_draws, count, seed).reshape(-1, count)
                out = {unit: np.repeat(ids, num_draws), "draw_id": np.tile(np.arange(num_draws, dtype="int32"), len(ids))}
                yield pd.DataFrame(out | {name: made[:, m] for m, name in enumerate(etas)})

        fields = [f"`{unit}` {dict(df.dtypes)[unit]}", "draw_id int", *(f"{e} double" for e in etas)]
        return df.select(unit).distinct().mapInPandas(make, ", ".join(fields))

    def _per_draw(self, df: DataFrame, draws: DataFrame, theta: np.ndarray) -> DataFrame:
        k = self.layout.index
        deviations = F.lit(0.0)
        for m, (pos, sigma) in enumerate(zip(self.mixing_pos, theta[k:])):
            deviations = deviations + self.design.terms[pos].expression(self.alt_id_col) * F.lit(float(sigma)) * F.col(f"eta_{m}")
        return softmax.mixed(df, self.design.index(self.alt_id_col, theta[:k]), draws, deviations, self.obs_id_col, self.mixing_id_col)

    def _predicted_sets(self, df, theta):
        raise ValueError("one set of parameters at a time")

    def _predicted(self, df, theta, num_draws, seed):
        if not num_draws:
            raise ValueError("num_draws is needed")
        per_draw = self._per_draw(df, self.draws_of(df, num_draws, seed), theta)
        means = softmax.averaged(per_draw, [self.obs_id_col, self.alt_id_col])
        return df.join(means, [self.obs_id_col, self.alt_id_col])

    def panel_predict(self, data, num_draws: int, return_long_probs: bool = True, choice_col: str | None = None,
                      seed: int | None = None, param_list: list | None = None, draws: DataFrame | None = None) -> DataFrame:
        """Units met in the fitted table weigh their draws by the likelihood of their past; new ones equally.

        ``draws`` (mixing id, draw_id, eta_0, ...) stands in for seeded ones.
        """
        df, theta = self._prepared(data, choice_col, return_long_probs), self._parameters(param_list)
        draws = self.draws_of(df, num_draws, seed) if draws is None else draws
        past = self.data.join(df.select(self.mixing_id_col).distinct(), self.mixing_id_col, "left_semi")
        seq = softmax.sequences(self._per_draw(past, draws, theta), self.mixing_id_col, self.choice_col)
        window = Window.partitionBy(self.mixing_id_col)
        shares = seq.withColumn("share", F.col("sequence_probability") / F.sum("sequence_probability").over(window))
        per_draw = self._per_draw(df, draws, theta).join(
            shares.select(self.mixing_id_col, "draw_id", "share"), [self.mixing_id_col, "draw_id"], "left"
        )
        means = softmax.averaged(per_draw, [self.obs_id_col, self.alt_id_col], F.coalesce("share", F.lit(1.0 / num_draws)))
        out = df.join(means, [self.obs_id_col, self.alt_id_col])
        return out if return_long_probs else softmax.chosen(out, choice_col)


MODELS = {
    "MNL": MultinomialLogit, "Asym": MultinomialAsymmetric, "Cloglog": MultinomialCloglog, "Scobit": MultinomialScobit,
    "Uneven": MultinomialUneven, "Nested Logit": NestedLogit, "Mixed Logit": MixedLogit,
}


def create_choice_model(data, alt_id_col: str, obs_id_col: str, choice_col: str, specification: Mapping, model_type: str, **options) -> ChoiceModel:
    """A model of one of the seven types in ``MODELS``."""
    validate.model_type(model_type, MODELS)
    kind = MODELS[model_type]
    keys = (alt_id_col, obs_id_col, choice_col)
    return kind(data, *keys, specification=specification, **options)


def load_model(data, path: str) -> ChoiceModel:
    """A saved model over ``data``, with its parameters if it had been fitted."""
    df = read_table(data)
    card = read_card(df.sparkSession, path)
    options = {k: card[k] for k in ("names", "intercept_ref_pos", "shape_ref_pos", "nest_spec", "intercept_names", "shape_names") if card.get(k) is not None}
    if card["mixing_vars"]:
        options |= {"mixing_id_col": card["mixing_id_col"], "mixing_vars": card["mixing_vars"]}
    model = create_choice_model(df, *(card[k] for k in _KEYS), card["specification"], card["model_type"], **options)
    if model.design.alternatives != tuple(card["alternatives"]) and list(model.design.alternatives) != card["alternatives"]:
        raise ValueError(f"the saved model has the alternatives {card['alternatives']}, the data {list(model.design.alternatives)}")
    if card["result"] is not None:
        found = dict(card["result"])
        for name in ("params", "gradient", "hessian", "information", "cov", "robust_cov"):
            found[name] = np.array(found[name], float)
        model.result = FitResult(**found | {"constrained": tuple(found["constrained"])})
    return model
