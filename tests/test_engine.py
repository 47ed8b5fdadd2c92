import math
import warnings

import numpy as np
import pytest

from choicelake import Boot, create_choice_model, load_model
from choicelake.functions import normal
from choicelake.functions import transforms as T
from choicelake.operators import intervals
from choicelake.operators.spec import Layout
from choicelake.plans import kernels
from choicelake.plans.blocks import unit_draws

SPATIAL = np.array("48 36 20 29 42 42 20 42 22 41 45 14 6 0 33 28 34 4 32 24 47 41 24 26 30 41".split(), float)
MICRO = [(1, 1, 0, 1.0), (1, 2, 1, 2.0), (1, 3, 0, 3.0), (2, 1, 0, 1.5), (2, 3, 1, 3.5)]
SIX = [
    (int(o), int(a), int(c), float(x)) for o, a, c, x in (row.split(":") for row in (
        "1:1:0:1 1:2:1:2 1:3:0:3 2:1:0:1.5 2:3:1:3.5 3:1:1:.78 3:2:0:.23 3:3:0:1.04 "
        "4:2:1:2.52 4:3:0:1.49 5:1:1:.85 5:2:0:1.37 5:3:0:1.17 6:1:0:2.03 6:2:0:1.62 6:3:1:1.94"
    ).split())
]
KEYS = ("alt_id", "obs_id", "choice")


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, float(x)) for a, b, c, x in rows], "obs_id long, alt_id int, choice int, x double")


def random_block(rng, n=60, k=3, j=4, units=None):
    rows = [(o, a) for o in range(n) for a in range(j) if a == 0 or rng.random() < 0.8]
    obs, alt = np.array(rows).T
    y = np.zeros(len(rows))
    for o in range(n):
        y[rng.choice(np.flatnonzero(obs == o))] = 1
    w = rng.uniform(0.5, 2, n)[obs]
    block = kernels.Block(rng.normal(size=(len(rows), k)), obs, alt, y, w)
    if units:
        block.mix = obs * units // n
        block.draws = unit_draws(np.arange(units), 7, 2, 5)
        block.w = np.ones(len(rows))
    return block


FAMILIES = {
    "mnl": lambda: kernels.Family(Layout(index=3), 4),
    "cloglog": lambda: kernels.Cloglog(Layout(index=3, intercepts=3), 4, intercept_ref=1),
    "scobit": lambda: kernels.Scobit(Layout(index=3, shapes=4, intercepts=3), 4, intercept_ref=0),
    "uneven": lambda: kernels.Uneven(Layout(index=3, shapes=4), 4),
    "asym": lambda: kernels.Asym(Layout(index=3, shapes=3, intercepts=3), 4, intercept_ref=2, shape_ref=3),
    "nested": lambda: kernels.Nested(Layout(index=3, nests=2), 4, nest_of_alt=np.array([0, 1, 0, 1])),
    "mixed": lambda: kernels.Mixed(Layout(index=3, sigmas=2), 4, mixing=(0, 2)),
}


@pytest.mark.parametrize("name", FAMILIES)
@pytest.mark.parametrize("ridge", [None, 0.3])
def test_gradient_is_the_derivative(name, ridge):
    rng = np.random.default_rng(3)
    family, block = FAMILIES[name](), random_block(rng, units=20 if name == "mixed" else None)
    theta = rng.normal(size=family.layout.size) * 0.5
    value = lambda t: family.penalised(t, family.evaluate(t, block), ridge).value
    gradient = family.penalised(theta, family.evaluate(theta, block), ridge).gradient
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert (value(theta + step) - value(theta - step)) / 2e-6 == pytest.approx(gradient[i], rel=1e-5, abs=1e-5)


def test_mnl_hessian_and_information():
    rng = np.random.default_rng(4)
    family, block = FAMILIES["mnl"](), random_block(rng)
    theta = rng.normal(size=3)
    totals = family.evaluate(theta, block, True)
    for i in range(3):
        step = np.zeros(3)
        step[i] = 1e-5
        numeric = (family.evaluate(theta + step, block).gradient - family.evaluate(theta - step, block).gradient) / 2e-5
        np.testing.assert_allclose(totals.hessian[i], numeric, rtol=1e-6, atol=1e-6)
    p = family.probabilities(theta, block)
    scores = np.stack([((block.y - p)[:, None] * block.x)[block.obs == o].sum(0) for o in range(block.n_obs)])
    w = np.array([block.w[block.obs == o].max() for o in range(block.n_obs)])
    np.testing.assert_allclose(totals.information, (scores * w[:, None]).T @ scores)


def test_reductions_to_the_multinomial_logit():
    rng = np.random.default_rng(5)
    block = random_block(rng)
    beta = rng.normal(size=3)
    mnl = FAMILIES["mnl"]().probabilities(beta, block)
    zero = np.zeros(4)
    np.testing.assert_allclose(FAMILIES["uneven"]().probabilities(np.concatenate([zero, beta]), block), mnl, rtol=1e-10)
    scobit = kernels.Scobit(Layout(index=3, shapes=4), 4)
    np.testing.assert_allclose(scobit.probabilities(np.concatenate([zero, beta]), block), mnl, rtol=1e-10)
    asym = kernels.Asym(Layout(index=3, shapes=3), 4, shape_ref=0)
    np.testing.assert_allclose(asym.probabilities(np.concatenate([zero[:3], beta / math.log(4)]), block), mnl, rtol=1e-10)
    nested = kernels.Nested(Layout(index=3, nests=2), 4, nest_of_alt=np.array([0, 1, 0, 1]))
    np.testing.assert_allclose(nested.probabilities(np.concatenate([[40, 40], beta]), block), mnl, rtol=1e-8)


def test_transforms_survive_extremes():
    v = np.array([-800.0, -40, -1, 0, 1, 3.69, 3.71, 40, 800])
    for g in (0.2, 1.0, 5.0):
        gamma = np.full_like(v, g)
        for f in (T.scobit, T.uneven, T.scobit_dv, T.scobit_dshape, T.uneven_dv, T.uneven_dshape):
            assert np.isfinite(f(v, gamma)).all()
    assert np.isfinite(T.cloglog(v)).all() and np.isfinite(T.cloglog_dv(v)).all()
    assert T.scobit(np.array([-50.0]), np.array([2.0]))[0] == pytest.approx(-100)


def test_catalyst_transforms_agree_with_numpy(spark):
    from pyspark.sql import functions as F

    v = np.array([-300.0, -40, -1, 0, 1, 3.69, 3.71, 5, 40, 300])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    got = df.select("i", T.cloglog_column(F.col("v")), T.scobit_column(F.col("v"), F.lit(1.7)), T.uneven_column(F.col("v"), F.lit(1.7)),
                    T.asym_column(F.col("v"), F.lit(0.3), 4)).orderBy("i").toPandas().to_numpy()[:, 1:].astype(float)
    g = np.full_like(v, 1.7)
    want = np.stack([T.cloglog(v), T.scobit(v, g), T.uneven(v, g), T.asym(v, np.full_like(v, 0.3), 4)], axis=1)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_micro_goldens(spark):
    model = create_choice_model(frame(spark, MICRO), *KEYS, {"x": [[1, 2, 3]]}, "MNL")
    got = model.predict(model.data, [np.array([-0.6]), None, None, None]).orderBy("obs_id", "alt_id").toPandas()["probability"]
    np.testing.assert_allclose(got, [0.54053883, 0.29665400, 0.16280717, 0.76852478, 0.23147522], rtol=1e-7)
    assert model.log_likelihood([-0.6]) == pytest.approx(-2.6784712675)
    assert model.log_likelihood([0.0]) == pytest.approx(-1.7917594692)


def test_nested_goldens():
    x = np.column_stack([np.eye(3)[[0, 1, 2, 0, 2]][:, :2], (1, 2, 3, 1.5, 3.5)])
    block = kernels.Block(x, np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 0, 2]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    family = kernels.Nested(Layout(index=3, nests=2), 3, nest_of_alt=np.array([0, 0, 1]))
    theta = np.array([math.log(0.995 / 0.005), 0.0, 0.3, -0.6, 0.2])
    np.testing.assert_allclose(family.probabilities(theta, block), [0.38428486, 0.19016013, 0.42555500, 0.47502081, 0.52497919], rtol=1e-6)
    assert family.evaluate(theta, block).value == pytest.approx(-2.3042854186)


@pytest.mark.parametrize("method", ["BFGS", "newton-cg"])
def test_asc_only_fit_has_closed_form(spark, method):
    rows = [(o, a, int(a == 1 + (o % 6 >= 3) + (o % 6 == 5)), 0.0) for o in range(60) for a in (1, 2, 3)]
    model = create_choice_model(frame(spark, rows), *KEYS, {"intercept": [1, 2]}, "MNL")
    fit = model.fit_mle(np.zeros(2), method=method)
    np.testing.assert_allclose(fit.params, [math.log(30 / 10), math.log(20 / 10)], atol=1e-5)
    assert fit.success and fit.n_obs == 60 and fit.rho_squared > 0
    assert model.summary.count() == 2 and model.fit_summary.count() == 7 and model.conf_int().count() == 2
    assert "log-likelihood" in model.text_summary()


def test_weights_count_like_repeated_rows(spark):
    from pyspark.sql import functions as F

    df = frame(spark, SIX).withColumn("w", F.when(F.col("obs_id") == 2, 2.0).otherwise(1.0))
    twice = df.unionByName(df.where("obs_id = 2").withColumn("obs_id", F.lit(7).cast("long")))
    make = lambda d: create_choice_model(d, *KEYS, {"intercept": [1, 2], "x": [[1, 2, 3]]}, "MNL")
    a = make(df).fit_mle(np.zeros(3), weights="w")
    b = make(twice).fit_mle(np.zeros(3))
    np.testing.assert_allclose(a.params, b.params, atol=1e-4)


def test_every_model_fits_and_predicts(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for o in range(150):
        x = rng.normal(size=3)
        pick = int(np.argmax(x * 0.8 + rng.gumbel(size=3)))
        rows += [(o, a + 1, int(a == pick), x[a]) for a in range(3)]
    from pyspark.sql import functions as F

    df = frame(spark, rows).withColumn("unit", F.floor(F.col("obs_id") / 5))
    base = {"x": "all_same"}
    cases = {
        "MNL": ({}, 1, {}), "Cloglog": ({"intercept_ref_pos": 2}, 3, {}), "Scobit": ({}, 4, {}), "Uneven": ({}, 4, {}),
        "Asym": ({"shape_ref_pos": 0}, 3, {}), "Nested Logit": ({"nest_spec": {"a": [1, 2], "b": [3]}}, 3, {}),
        "Mixed Logit": ({"mixing_id_col": "unit", "mixing_vars": ["x"]}, 2, {"num_draws": 20, "seed": 3}),
    }
    for kind, (options, k, more) in cases.items():
        model = create_choice_model(df, *KEYS, base, kind, **options)
        start = np.full(k, 0.1)
        fit = model.fit_mle(start, maxiter=60, **more)
        assert fit.log_likelihood >= model.log_likelihood(start, **more) - 1e-9, kind
        predicted = model.predict(df, **({"num_draws": 20, "seed": 3} if more else {}))
        total = predicted.groupBy("obs_id").agg(F.sum("probability").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]
        assert total < 1e-9, kind
        if kind in ("Scobit", "Asym"):
            model.save(str(tmp_path / kind))
            again = load_model(df, str(tmp_path / kind))
            for name, value in vars(fit).items():
                np.testing.assert_equal(getattr(again.result, name), value)
            assert (again.param_names, again.result.bic, again.result.rho_squared) == (model.param_names, fit.bic, fit.rho_squared)
            with pytest.raises(ValueError):
                load_model(df.withColumn("alt_id", df["alt_id"] + 1), str(tmp_path / kind))
            a = predicted.agg(F.sum(F.col("probability") ** 2)).first()[0]
            assert again.predict(df).agg(F.sum(F.col("probability") ** 2)).first()[0] == pytest.approx(a)
    panel = model.panel_predict(df.where("unit < 3"), 20, seed=3)
    assert panel.count() == 45


def test_parameter_sets_at_once(spark):
    model = create_choice_model(frame(spark, MICRO), *KEYS, {"x": "all_same"}, "MNL")
    got = model.predict(model.data, [np.array([[-0.6, 0.0]]), None, None, None])
    assert got.count() == 10
    assert got.where("set_id = 1 and obs_id = 2").select("probability").first()[0] == pytest.approx(0.5)


def test_spatial_intervals():
    theta = SPATIAL.var()
    n = len(SPATIAL)
    assert theta == pytest.approx(171.5340236686)
    replicates = SPATIAL[np.random.RandomState(8292017).choice(n, (5000, n))].var(1)[:, None]
    jackknife = np.array([np.delete(SPATIAL, i).var() for i in range(n)])[:, None]
    np.testing.assert_allclose(intervals.percentile_interval(replicates, 90).ravel(), [100.8, 233.9], rtol=0.02)
    np.testing.assert_allclose(intervals.bca_interval(replicates, jackknife, np.array([theta]), 90).ravel(), [115.8, 259.6], rtol=0.01)
    assert intervals.bca_acceleration(jackknife)[0] == pytest.approx(0.061, abs=5e-4)

    def refit(many):
        weights = np.stack([w.dense(n) for w in many])
        mean = weights @ SPATIAL
        return (weights * (SPATIAL - mean[:, None]) ** 2).sum(1)[:, None]

    np.testing.assert_allclose(intervals.abc_interval(refit, np.array([theta]), n, 90).ravel(), [116.7, 260.9], atol=0.1)


def test_percentile_grid(spark):
    grid = np.arange(1, 101)[:, None] * np.arange(1, 6)[None, :]
    np.testing.assert_array_equal(intervals.percentile_interval(grid, 94.88)[:, 0], [3, 98])
    rows = [(i + 1, f"p{j}", float(grid[i, j])) for i in range(100) for j in range(5)]
    df = spark.createDataFrame(rows, "rep int, parameter string, value double")
    got = {r["parameter"]: (r["lower"], r["upper"]) for r in intervals.percentile_intervals(df, 94.88).collect()}
    assert got["p0"] == (3.0, 98.0)


def test_bootstrap_end_to_end(spark):
    model = create_choice_model(frame(spark, SIX), *KEYS, {"x": [[1, 2, 3]]}, "MNL")
    fit = model.fit_mle(np.zeros(1))
    boot = Boot(model)
    assert boot.generate_bootstrap_replicates(12, boot_seed=7).count() == 12
    by_index = boot.bootstrap_replicates
    boot.generate_bootstrap_replicates(12, mnl_obj=model, boot_seed=7)
    np.testing.assert_allclose(boot.bootstrap_replicates, by_index, atol=1e-3)
    assert boot.generate_jackknife_replicates().count() == 6
    assert len(boot.calc_log_likes_for_replicates()) == 12
    assert (boot.calc_log_likes_for_replicates() <= fit.log_likelihood + 1e-9).all()
    assert len(boot.calc_gradient_norm_for_replicates("jackknife")) == 6
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert boot.calc_conf_intervals(80, "all").count() == 3
    first = boot.calc_abc_interval(80).first()
    assert first[2] < fit.params[0] < first[3]
    far = Boot(model, local_bytes=0)
    np.testing.assert_allclose(far.refits([intervals.dense_weights(np.ones(6))])[0], fit.params, atol=1e-4)


def test_normal_law():
    assert normal.cdf(1.96) == pytest.approx(0.9750021)
    assert normal.inverse_cdf(0.975) == pytest.approx(1.9599640)
    assert normal.inverse_cdf(0) == -math.inf
    assert normal.two_sided_p(1.96) == pytest.approx(0.04999579)


def test_stand_in_methods_are_documented():
    from pathlib import Path

    from choicelake.plans import optimize

    readme = (Path(__file__).parent.parent / "README.md").read_text()
    for name, kind in optimize.METHODS.items():
        if name != kind:
            assert f'"{name}"' in optimize.minimise.__doc__ and f"`{name}`" in readme
