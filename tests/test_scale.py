"""What large tables need: few evaluations, small blocks and tasks, nothing of their size on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicelake import Boot, catalogue, create_choice_model
from choicelake.operators import sampling, softmax
from choicelake.operators.spec import Layout
from choicelake.plans import kernels
from choicelake.plans.blocks import Blocks, squeezed
from choicelake.plans.models import fit_theta
from choicelake.sources import tables

KEYS = ("alt_id", "obs_id", "choice")


def choices(spark, n, seed=1):
    """Three alternatives, a continuous variable and a choice by a hash."""
    u = F.pmod(F.xxhash64("obs_id", F.lit(seed)), F.lit(100))
    picked = F.when(u < 50, 1).when(u < 80, 2).otherwise(3)
    long = spark.range(n).select(F.col("id").alias("obs_id"), F.explode(F.array(*(F.lit(a) for a in (1, 2, 3)))).alias("alt_id"))
    return long.withColumn("choice", (F.col("alt_id") == picked).cast("int")).withColumn("x", F.pmod(F.xxhash64("obs_id", "alt_id"), F.lit(10_007)) / 10_007.0)


@pytest.mark.parametrize("method", ["BFGS", "newton-cg"])
def test_a_fit_of_large_sums_ends_in_few_evaluations(method):
    """A gradient of sums over many rows stays above any fixed bound; the search must see that it has arrived."""
    rng = np.random.default_rng(2)
    n, x = 5, np.tile(np.eye(5)[:, 1:], (5, 1))
    obs, alt = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
    counts = rng.uniform(1e7, 2e7, n) * np.pi
    block = kernels.Block(x, obs, alt, (obs == alt).astype(float), counts[obs])
    calls = []

    def evaluate(theta, second):
        calls.append(second)
        totals = kernels.Family(Layout(index=4), 5).evaluate(theta, block, second)
        totals.gradient = totals.gradient + rng.normal(size=4) * 1e-5  # what rounding leaves of such sums
        return totals

    found = fit_theta(evaluate, kernels.Family(Layout(index=4), 5), np.zeros(4), (), None, method, 1e-12, 1e-9, 1000)
    np.testing.assert_allclose(found.x, np.log(counts[1:] / counts[0]), atol=1e-9)
    assert len(calls) < 25


def test_alike_observations_are_kept_once():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 4, 400)
    obs, alt = np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400)
    x = rng.normal(size=(4, 3, 2))[kinds].reshape(-1, 2)
    block = kernels.Block(x, obs, alt, (alt == np.repeat(kinds % 3, 3)).astype(float), np.repeat(1.0 + kinds, 3))
    small = squeezed(block)
    assert len(small.obs) == 12 and small.times.sum() == 400
    for family, k in ((kernels.Family(Layout(index=2), 3), 2), (kernels.Nested(Layout(index=2, nests=2), 3, nest_of_alt=np.array([0, 1, 0])), 4)):
        theta = rng.normal(size=k)
        a, b = family.evaluate(theta, block, True), family.evaluate(theta, small, True)
        for name in ("value", "gradient", "hessian", "information", "chi_square"):
            np.testing.assert_allclose(getattr(a, name), getattr(b, name), rtol=1e-10)
    # one bit apart is another observation
    block.x[0, 0] = np.nextafter(block.x[0, 0], 9)
    assert len(squeezed(block).obs) == 15
    block.x[:, 0] += np.arange(1200)
    assert squeezed(block) is block


def test_blocks_are_small_and_come_one_by_one(spark):
    model = create_choice_model(choices(spark, 60_000), *KEYS, {"x": "all_same"}, "MNL")
    blocks = Blocks(model.data.coalesce(1), model.design, "obs_id", "alt_id", "choice")
    try:
        sizes = [len(r["block"]) for r in blocks.frame.collect() if r["block"]]
        assert max(sizes) < 2 << 20
        assert blocks.n_obs == 60_000
    finally:
        blocks.release()


def test_draws_of_units_need_no_driver(spark):
    df = choices(spark, 300).withColumn("unit", F.col("obs_id") % 40)
    model = create_choice_model(df, *KEYS, {"x": "all_same"}, "Mixed Logit", mixing_id_col="unit", mixing_vars=["x"])
    rng, theta = np.random.default_rng(4), np.array([0.3, 0.7])
    made = rng.normal(size=(41, 5))
    given = spark.createDataFrame([(u, d, float(made[u, d])) for u in range(41) for d in range(5)], "unit long, draw_id int, eta_0 double")
    want = model.log_likelihood(theta, draws={u: made[u][:, None] for u in range(41)})
    assert model.log_likelihood(theta, draws=given) == pytest.approx(want)
    assert model.log_likelihood(theta, draws=given, block_rows=20) == pytest.approx(want)
    with pytest.raises(Exception, match="no draws"):
        model.log_likelihood(theta, draws=given.where("unit <> 7"))


def test_tasks_keep_their_size(spark):
    assert tables.dealt(spark.range(10), 40 * tables.TASK_ROWS, "id").rdd.getNumPartitions() == 40
    counts = [tables.dealt(spark.range(10), n * tables.TASK_ROWS, "id").rdd.getNumPartitions() for n in (200, 700, 900)]
    assert counts == [200, 200, 900]
    plan = catalogue.choice_table(spark, "/root/testdata/sf0.001").groupBy("obs_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    model = create_choice_model(choices(spark, 50), *KEYS, {"x": "all_same"}, "MNL")
    sets = model.predict(model.data, [np.array([[0.5, -1.0, 0.0]]), None, None, None])
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(array(struct") < plan.index("Window ")  # rows are multiplied after they are sorted
    assert sets.columns == [*model.data.columns, "set_id", "probability"] and sets.count() == 450
    one = softmax.flat(model.data, F.col("x") * -1.0, "obs_id")
    both = sets.where("set_id = 1").join(one.select("obs_id", "alt_id", F.col("probability").alias("p")), ["obs_id", "alt_id"])
    assert both.agg(F.max(F.abs(F.col("p") - F.col("probability")))).first()[0] < 1e-12


def test_samples_are_drawn_where_observations_lie(spark, monkeypatch):
    df = choices(spark, 3000).persist()
    drawn = sampling.bucket_draws(df, "obs_id", "alt_id", "choice", [1, 2, 3], 3000, 50, 7, bucket_obs=100)
    strata = {r["alternative"]: r["n_obs"] for r in sampling.strata_counts(df, "obs_id", "alt_id", "choice").collect()}
    assert [d.sum(1).tolist() for d in drawn.draws] == [[strata[a]] * 50 for a in (1, 2, 3)]  # each stratum as large as it is
    model = create_choice_model(df, *KEYS, {"intercept": [2, 3], "x": "all_same"}, "MNL")
    fit = model.fit_mle(np.zeros(3))
    near, far = Boot(model), Boot(model, local_bytes=10_000)
    monkeypatch.setattr(Boot, "_strata", property(lambda self: pytest.fail("ids on the driver")))
    far.generate_bootstrap_replicates(60, boot_seed=5)
    again = Boot(model, local_bytes=10_000)
    again.generate_bootstrap_replicates(60, boot_seed=5, block_options={"block_rows": 700})
    np.testing.assert_allclose(far.bootstrap_replicates, again.bootstrap_replicates, atol=1e-6)
    monkeypatch.undo()
    near.generate_bootstrap_replicates(60, boot_seed=5)
    for boot in (near, far):
        # constants follow from the strata, which a stratified sample keeps; the variable's coefficient varies by its standard error
        assert np.abs(boot.bootstrap_replicates.mean(0) - fit.params).max() < 0.05
        assert 0.6 < boot.bootstrap_replicates[:, 2].std() / fit.std_err[2] < 1.5
    df.unpersist()


def test_multiplicities_are_those_of_drawing_with_replacement():
    n, reps = 40, 4000
    draws = sampling.BucketDraws(reps, 1, 3, [np.full((reps, 1), n)])
    times = draws.times(np.zeros(n, int), np.arange(n), np.zeros(n, int), np.ones(n))
    assert (times.sum(1) == n).all()
    assert np.abs(times.mean(0) - 1).max() < 0.08 and np.isclose(times.var(), 1 - 1 / n, atol=0.02)
