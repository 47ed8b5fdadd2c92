"""Bootstrap and jackknife: many weighted refits of one table.

A replicate is a vector of observation weights: multiplicities for a bootstrap sample, a
zero for a deletion, near-equal shares for ABC.  The packed table is shipped to executors
once, after a check of its size, and replicates are fitted in parallel, a task a few at a
time; rows are never copied.  A larger table keeps its blocks where they are: bootstrap samples
are drawn there and fitted side by side, an evaluation of all of them a job over the whole
cluster; other replicates follow one another.
"""

from __future__ import annotations

import math
import queue
import threading
from collections.abc import Callable, Iterator, Mapping
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelake.operators import intervals, sampling, validate
from choicelake.plans.blocks import Blocks
from choicelake.plans.kernels import Block, Family
from choicelake.plans.models import ChoiceModel, MixedLogit, fit_theta

#: Packed tables up to this size are broadcast, if the samples drawn of them fit with them.
LOCAL_BYTES = 256 << 20
#: What a drawn observation takes there: index and weight, in as many copies as the driver holds on their way to tasks.
DRAWN_BYTES = 5 * 16
#: Samples that are fitted side by side; a block holds how often each has each of its observations.
TOGETHER = 64


def default_starting_values(model: ChoiceModel, mnl_point: Mapping[str, float]) -> np.ndarray:
    """From a multinomial logit's estimates by name: index (over ln J for asymmetric), intercepts, zeros elsewhere."""
    theta = np.zeros(model.layout.size)
    scale = 1.0 / math.log(len(model.design.alternatives)) if model.wants_shapes == -1 else 1.0
    first_index = model.layout.nests + model.layout.shapes + model.layout.intercepts
    for i, name in enumerate(model.param_names):
        if name in mnl_point:
            theta[i] = mnl_point[name] * (scale if i >= first_index else 1.0)
    return theta


class Boot:
    """Replicates and intervals of a model about its estimates."""

    def __init__(self, model: ChoiceModel, mle_params=None, local_bytes: int = LOCAL_BYTES):
        self.model = model
        self.estimate = np.asarray(model._fitted().params if mle_params is None else mle_params, float)
        self.names, self.local_bytes = model.param_names, local_bytes
        self.bootstrap_replicates: np.ndarray | None = None
        self.jackknife_replicates: np.ndarray | None = None
        self._block: tuple[Block, np.ndarray] | None = None

    # --- refits ---

    def _prepared(self, block_options: dict) -> tuple[Block, np.ndarray] | None:
        """The packed table and its observations' ids in order, if small enough for the driver."""
        if self._block is None:
            m = self.model
            if isinstance(m, MixedLogit):
                blocks = m.blocks(**block_options)
                try:
                    block = blocks.local(self.local_bytes)
                finally:
                    blocks.release()
                self._block = None if block is None else (block, np.arange(len(block.draws)))
            elif self._table_bytes() <= self.local_bytes:
                self._block = _ordered(m)
        return self._block

    def _table_bytes(self) -> int:
        return self.model.rows * 8 * (len(self.model.design.terms) + 4)

    def _too_large(self, num_samples: int) -> int:
        """The number of observations, if the table and so many samples of it do not fit the driver; else 0."""
        m = self.model
        if isinstance(m, MixedLogit):  # its weights are of units
            return 0
        n = m.data.select(m.obs_id_col).distinct().count()
        return n if self._table_bytes() + DRAWN_BYTES * n * num_samples > self.local_bytes else 0

    def refits(self, weights: list[intervals.Weights], init_vals=None, block_options: dict | None = None, **fit_kwargs) -> np.ndarray:
        """(refits x parameters) estimates under each set of weights over the sorted observations.

        ``init_vals``: one vector for all or a row for each.
        """
        prepared = self._prepared(block_options or {})
        starts = np.broadcast_to(self.estimate if init_vals is None else np.asarray(init_vals, float), (len(weights), len(self.estimate)))
        if prepared is None:
            return self._refits_in_turn(weights, starts, block_options or {}, fit_kwargs)
        spark = self.model.data.sparkSession
        constrained = self.model.constraints(fit_kwargs.pop("constrained_pos", None))
        held = spark.sparkContext.broadcast((prepared[0], self.model.family(), constrained))
        options = _fit_options(fit_kwargs)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, family, fixed = held.value
            key = block.obs if block.mix is None else block.mix
            n = int(key[-1]) + 1
            for batch in batches:
                rows = []
                for rep, scale, index, delta, start in batch.itertuples(index=False):
                    w = intervals.Weights(scale, np.frombuffer(index, np.int64), np.frombuffer(delta)).dense(n)
                    own = replace(block, w=block.w * w[key])
                    fit = fit_theta(lambda t, s: family.evaluate(t, own, s), family, np.frombuffer(start), fixed, *options)  # noqa: B023
                    rows.append((rep, fit.x.tobytes()))
                yield pd.DataFrame(rows, columns=["rep", "theta"])

        rows = pd.DataFrame({
            "rep": range(len(weights)), "scale": [float(w.scale) for w in weights],
            "index": [np.asarray(w.index, np.int64).tobytes() for w in weights], "delta": [np.asarray(w.delta, float).tobytes() for w in weights],
            "start": [s.tobytes() for s in starts],
        })
        tasks = min(len(weights), max(1, spark.sparkContext.defaultParallelism * 2))
        found = (
            spark.createDataFrame(rows, "rep int, scale double, index binary, delta binary, start binary")
            .repartition(tasks).mapInPandas(run, "rep int, theta binary").collect()
        )
        held.unpersist()
        return np.stack([np.frombuffer(t) for _, t in sorted((r["rep"], bytes(r["theta"])) for r in found)])

    def _refits_in_turn(self, weights, starts, block_options, fit_kwargs) -> np.ndarray:
        """For tables too large to ship: weights join as a column, and each fit is distributed."""
        m, spark = self.model, self.model.data.sparkSession
        ids = [r[0] for r in m.data.select(m.obs_id_col).distinct().orderBy(m.obs_id_col).collect()]
        out, data = [], m.data
        try:
            for own, start in zip(weights, starts):
                w = spark.createDataFrame(pd.DataFrame({m.obs_id_col: ids, "__w": own.dense(len(ids))}))
                m.data = data.join(w, m.obs_id_col)
                out.append(m.fit_mle(start, weights="__w", just_point=True, **block_options, **fit_kwargs).x)
        finally:
            m.data = data
        return np.stack(out)

    # --- replicates ---

    def generate_bootstrap_replicates(self, num_samples: int, mnl_obj: ChoiceModel | None = None, mnl_init_vals=None,
                                      extract_init_vals: Callable | None = None, boot_seed: int | None = None,
                                      block_options: dict | None = None, **fit_kwargs) -> DataFrame:
        """(rep, parameter, value): refits of samples stratified by the chosen alternative.

        With ``mnl_obj`` each sample is first fitted by that model, whose estimates give the
        starting values (``extract_init_vals`` or the default rule).
        """
        if n_obs := self._too_large(num_samples):
            parts = [num_samples - i if num_samples - i < TOGETHER else TOGETHER for i in range(0, num_samples, TOGETHER)]
            seeds = [None if boot_seed is None else boot_seed + i * 1_000_003 for i in range(len(parts))]
            found = [self._fitted_together(n, s, n_obs, mnl_obj, mnl_init_vals, extract_init_vals, block_options or {}, fit_kwargs) for n, s in zip(parts, seeds)]
            self.bootstrap_replicates = np.concatenate(found)
            return self.frame("bootstrap")
        strata, ids = self._strata()
        drawn = sampling.draw_samples(strata, num_samples, boot_seed)
        place = {o: i for i, o in enumerate(ids)}
        samples = []
        for sample in drawn:
            at, times = np.unique([place[o] for o in sample.tolist()], return_counts=True)
            samples.append(intervals.Weights(0.0, at, times.astype(float)))
        self.bootstrap_replicates = self._with_starts(samples, mnl_obj, mnl_init_vals, extract_init_vals, block_options, fit_kwargs)
        return self.frame("bootstrap")

    def _fitted_together(self, n_samples, seed, n_obs, mnl_obj, mnl_init_vals, extract, block_options, fit_kwargs) -> np.ndarray:
        """Estimates from samples that are drawn where the observations lie; nothing of their number passes through the driver."""
        m = self.model
        samples = sampling.bucket_draws(m.data, m.obs_id_col, m.alt_id_col, m.choice_col, list(m.design.alternatives), n_obs, n_samples, seed)

        def points(model: ChoiceModel, starts: np.ndarray, block_options: dict, **fit_kwargs) -> np.ndarray:
            constrained = model.constraints(fit_kwargs.pop("constrained_pos", None))
            blocks = model.blocks(samples=samples, **block_options)
            try:
                return fitted_together(blocks, model.family(), starts, constrained, _fit_options(fit_kwargs))
            finally:
                blocks.release()

        starts = np.tile(self.estimate, (n_samples, 1))
        if mnl_obj is not None:
            first = np.zeros(mnl_obj.layout.size) if mnl_init_vals is None else np.asarray(mnl_init_vals, float)
            found, rule = points(mnl_obj, np.tile(first, (n_samples, 1)), {}), extract or default_starting_values
            starts = np.stack([rule(m, dict(zip(mnl_obj.param_names, p))) for p in found])
        return points(m, starts, block_options, **fit_kwargs)

    def generate_jackknife_replicates(self, mnl_obj: ChoiceModel | None = None, mnl_init_vals=None, extract_init_vals: Callable | None = None,
                                      block_options: dict | None = None, **fit_kwargs) -> DataFrame:
        """Refits that leave out one observation each, in the ids' order."""
        n = len(self._strata()[1])
        weights = [intervals.Weights(1.0, np.array([i]), np.array([-1.0])) for i in range(n)]
        self.jackknife_replicates = self._with_starts(weights, mnl_obj, mnl_init_vals, extract_init_vals, block_options, fit_kwargs)
        return self.frame("jackknife")

    def _with_starts(self, weights, mnl_obj, mnl_init_vals, extract, block_options, fit_kwargs) -> np.ndarray:
        if mnl_obj is None:
            return self.refits(weights, None, block_options, **fit_kwargs)
        first = np.zeros(mnl_obj.layout.size) if mnl_init_vals is None else np.asarray(mnl_init_vals, float)
        points = Boot(mnl_obj, first, self.local_bytes).refits(weights, first)
        rule = extract or default_starting_values
        starts = np.stack([rule(self.model, dict(zip(mnl_obj.param_names, p))) for p in points])
        return self.refits(weights, starts, block_options, **fit_kwargs)

    def _strata(self) -> tuple[dict, list]:
        m = self.model
        strata: dict = {}
        for alternative, obs in sampling.observations_by_choice(m.data, m.obs_id_col, m.alt_id_col, m.choice_col).collect():
            strata.setdefault(alternative, []).append(obs)
        strata = {a: sorted(v) for a, v in strata.items()}
        return strata, sorted({o for v in strata.values() for o in v})

    def _replicates(self, kind: str) -> np.ndarray:
        validate.replicate_kind(kind)
        found = getattr(self, f"{kind}_replicates")
        if found is None:
            raise ValueError(f"generate {kind} replicates first")
        return found

    def frame(self, kind: str = "bootstrap") -> DataFrame:
        values = self._replicates(kind)
        rows = [(i + 1, n, float(v)) for i, row in enumerate(values) for n, v in zip(self.names, row)]
        return self.model.data.sparkSession.createDataFrame(rows, "rep int, parameter string, value double")

    # --- the table at the replicates ---

    def _evaluated(self, kind: str, ridge, block_options) -> list:
        prepared = self._prepared(block_options or {})
        family: Family = self.model.family()
        if prepared is not None:
            block = prepared[0]
            return [family.penalised(t, family.evaluate(t, block), ridge) for t in self._replicates(kind)]
        blocks = self.model.blocks(**(block_options or {}))
        try:
            return [family.penalised(t, blocks.evaluate(family, t), ridge) for t in self._replicates(kind)]
        finally:
            blocks.release()

    def calc_log_likes_for_replicates(self, replicates: str = "bootstrap", ridge: float | None = None, block_options: dict | None = None) -> np.ndarray:
        return np.array([t.value for t in self._evaluated(replicates, ridge, block_options)])

    def calc_gradient_norm_for_replicates(self, replicates: str = "bootstrap", ridge: float | None = None, constrained_pos=None,
                                          block_options: dict | None = None) -> np.ndarray:
        keep = np.ones(len(self.names))
        keep[list(constrained_pos or ())] = 0
        return np.array([np.linalg.norm(t.gradient * keep) for t in self._evaluated(replicates, ridge, block_options)])

    # --- intervals ---

    def _interval(self, values: np.ndarray, confidence: float, kind: str) -> DataFrame:
        a = intervals.alpha(confidence) / 2
        rows = [(n, kind, float(lo), float(hi)) for n, lo, hi in zip(self.names, *values)]
        frame = self.model.data.sparkSession.createDataFrame(rows, "parameter string, interval string, lower double, upper double")
        return frame.withColumnsRenamed({"lower": f"{a:.3g}%", "upper": f"{100 - a:.3g}%"})

    def calc_percentile_interval(self, conf_percentage: float) -> DataFrame:
        return self._interval(intervals.percentile_interval(self._replicates("bootstrap"), conf_percentage), conf_percentage, "percentile_interval")

    def calc_bca_interval(self, conf_percentage: float) -> DataFrame:
        values = intervals.bca_interval(self._replicates("bootstrap"), self._replicates("jackknife"), self.estimate, conf_percentage)
        return self._interval(values, conf_percentage, "BCa_interval")

    def calc_abc_interval(self, conf_percentage: float, init_vals=None, epsilon: float = 0.001, block_options: dict | None = None, **fit_kwargs) -> DataFrame:
        n = len(self._strata()[1])
        fit_kwargs = {"gradient_tol": 1e-10, "method": "newton-cg"} | fit_kwargs
        # weights that add up to 1 make a likelihood of mean size, whose estimates are the same
        refit = lambda w: self.refits(w, init_vals, block_options, **fit_kwargs)
        estimate = refit([intervals.dense_weights(np.full(n, 1.0 / n))])[0]
        return self._interval(intervals.abc_interval(refit, estimate, n, conf_percentage, epsilon), conf_percentage, "ABC_interval")

    def calc_conf_intervals(self, conf_percentage: float, interval_type: str = "all", init_vals=None, epsilon: float = 0.001, **fit_kwargs) -> DataFrame:
        made = {
            "pi": lambda: self.calc_percentile_interval(conf_percentage), "bca": lambda: self.calc_bca_interval(conf_percentage),
            "abc": lambda: self.calc_abc_interval(conf_percentage, init_vals, epsilon, **fit_kwargs),
        }
        if interval_type != "all" and interval_type not in made:
            raise ValueError("interval types are 'pi', 'bca', 'abc' and 'all'")
        frames = [make() for kind, make in made.items() if interval_type in ("all", kind)]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out


def fitted_together(blocks: Blocks, family: Family, starts: np.ndarray, constrained, options: tuple) -> np.ndarray:
    """(samples x parameters) a fit for each of the blocks' samples; all fits' next evaluations are one job."""
    asked: queue.SimpleQueue = queue.SimpleQueue()

    def fit(i: int) -> None:
        answer: queue.SimpleQueue = queue.SimpleQueue()

        def evaluate(theta, second):
            asked.put((i, theta, second, answer))
            totals = answer.get()
            if isinstance(totals, BaseException):
                raise totals
            return totals

        try:
            asked.put((i, fit_theta(evaluate, family, starts[i], constrained, *options).x, None, None))
        except BaseException as error:  # noqa: BLE001 - raised again by the caller
            asked.put((i, error, None, None))

    found: dict = {}
    for i in range(len(starts)):
        threading.Thread(target=fit, args=(i,), daemon=True).start()
    while len(found) < len(starts):
        calls = [asked.get() for _ in range(len(starts) - len(found))]  # each fit still going asks once, or is done
        found |= {i: x for i, x, _, answer in calls if answer is None}
        calls = sorted((c for c in calls if c[3] is not None), key=lambda c: c[0])
        if calls:
            try:
                answers = blocks.evaluate_all(family, [c[1] for c in calls], [c[2] for c in calls], [c[0] for c in calls])
            except Exception as error:  # noqa: BLE001 - each fit ends with it
                answers = [error] * len(calls)
            for call, totals in zip(calls, answers):
                call[3].put(totals)
    for x in found.values():
        if isinstance(x, BaseException):
            raise x
    return np.stack([found[i] for i in range(len(starts))])


def _fit_options(kwargs: dict) -> tuple:
    defaults = {"ridge": None, "method": "BFGS", "loss_tol": 1e-6, "gradient_tol": 1e-6, "maxiter": 1000}
    if unknown := set(kwargs) - set(defaults):
        raise TypeError(f"unknown fit options: {sorted(unknown)}")
    return tuple((defaults | kwargs).values())


def _ordered(model: ChoiceModel) -> tuple[Block, np.ndarray]:
    """The table as one block, observations in the order of their ids, and those ids."""
    rows = model.data.select(F.col(f"`{model.obs_id_col}`").alias("o"), F.col(f"`{model.alt_id_col}`").alias("a"),
                             F.col(f"`{model.choice_col}`").cast("double").alias("y"), *model.design.columns(model.alt_id_col))
    frame = rows.toArrow().to_pandas().sort_values(["o", "a"], ignore_index=True)
    ids, obs = np.unique(frame["o"].to_numpy(), return_inverse=True)
    alt = np.searchsorted(np.array(model.design.alternatives), frame["a"].to_numpy())
    return Block(frame.iloc[:, 3:].to_numpy(float), obs, alt, frame["y"].to_numpy(float), np.ones(len(frame))), ids
