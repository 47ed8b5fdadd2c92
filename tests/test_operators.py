import numpy as np
import pytest
from pyspark.sql import functions as F

from choicelake import convert_long_to_wide, convert_wide_to_long, create_choice_model
from choicelake.operators import sampling, spec, validate
from choicelake.operators.softmax import sequences
from choicelake.plans.blocks import Blocks, normal_draws
from choicelake.plans.optimize import minimise
from choicelake.sources.tables import read_table

LONG = "obs_id long, alt_id int, choice int, x double, m double, y double, z double"
ROWS = [(1, 1, 0, 1.0, 2.0, 12.0, 2.0), (1, 2, 1, 2.0, 2.0, 9.0, 6.0), (1, 3, 0, 3.0, 2.0, 0.9, 0.0), (2, 1, 0, 1.5, 6.0, 16.0, 10.0), (2, 3, 1, 3.5, 6.0, 4.0, 0.0)]
KEYS = ("alt_id", "obs_id", "choice")


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(ROWS, LONG)


def wide_of(long):
    return convert_long_to_wide(long, ["m"], ["y"], {"z": [1, 2]}, "obs_id", "alt_id", "choice")


@pytest.mark.filterwarnings("ignore")
def test_long_to_wide(long):
    rows = [tuple(r) for r in wide_of(long).orderBy("obs_id").collect()]
    assert rows == [(1, 2, 1, 1, 1, 2.0, 12.0, 9.0, 0.9, 2.0, 6.0), (2, 3, 1, 0, 1, 6.0, 16.0, None, 4.0, 10.0, None)]
    named = convert_long_to_wide(long, [], ["y"], {}, "obs_id", "alt_id", "choice", {1: "bus"}, null_value=-9.0)
    assert "y_bus" in named.columns and named.where("obs_id = 2").select("y_2").first()[0] == -9.0


@pytest.mark.filterwarnings("ignore")
def test_round_trip(long, spark):
    third = spark.createDataFrame([(3, a, int(a == 1), x, 6.0, y, z) for a, x, y, z in ((1, 1.5, 16.0, 10.0), (3, 3.5, 4.0, 0.0))], LONG)
    table = long.unionByName(third)
    wide = wide_of(table)
    back = convert_wide_to_long(
        wide, ["m"], {"y": {a: f"y_{a}" for a in (1, 2, 3)}, "z": {a: f"z_{a}" for a in (1, 2)}}, {3: "availability_3", 1: "availability_1", 2: "availability_2"},
        "obs_id", "choice", "alt_id",
    )
    want = table.select("obs_id", F.col("alt_id").cast("long"), "choice", "m", "y", "z")
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("change", [
    lambda w: w.withColumn("choice", F.when(F.col("obs_id") == 1, F.col("choice"))),
    lambda w: w.withColumn("obs_id", F.lit(1)),
    lambda w: w.withColumn("choice", F.lit(9)),
    lambda w: w.withColumn("choice", F.when(F.col("obs_id") == 2, 2).otherwise(3)),
])
def test_bad_wide_tables(long, change):
    with pytest.raises(ValueError):
        convert_wide_to_long(change(wide_of(long)), [], {}, {a: f"availability_{a}" for a in (2, 3)}, "obs_id", "choice")


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("change", [
    lambda d: d.unionByName(d.limit(1)), lambda d: d.withColumn("choice", F.lit(0)), lambda d: d.withColumn("choice", F.lit(1)), lambda d: d.drop("y"),
])
def test_bad_long_tables(long, change):
    with pytest.raises(ValueError):
        wide_of(change(long))


def test_design(long):
    design = spec.bind({"x": [[1, 2], 3], "m": "all_diff", "y": "all_same"}, [3, 1, 2])
    assert design.names == ["x_[1, 2]", "x_3", "m_1", "m_2", "m_3", "y"]
    row = long.where("obs_id = 1 and alt_id = 2").select(*design.columns("alt_id")).first()
    assert tuple(row) == (2.0, 0.0, 0.0, 2.0, 0.0, 9.0)
    assert spec.bind({"x": [range(1, 3)]}, [1, 2, 3], {"x": ["short"]}).names == ["short"]


@pytest.mark.parametrize("bad, names", [
    ({"x": "some"}, None), ({"x": 3}, None), ({"x": [[[1]]]}, None), ({"x": [9]}, None), ({"x": "all_same"}, {"y": "n"}),
    ({"x": "all_same"}, {"x": ["n"]}), ({"x": "all_diff"}, {"x": ["a", "b"]}), ({"x": [1, 2]}, {"x": ["a"]}),
])
def test_bad_specifications(bad, names):
    with pytest.raises(ValueError):
        spec.bind(bad, [1, 2, 3], names)


def test_parameter_layout():
    layout = spec.Layout(nests=0, shapes=3, intercepts=2, index=2)
    nests, shapes, intercepts, index = layout.split(np.arange(7.0))
    assert nests is None and shapes.tolist() == [0, 1, 2] and intercepts.tolist() == [3, 4] and index.tolist() == [5, 6]
    prediction = layout.for_prediction(np.arange(14.0).reshape(2, 7))
    assert [None if p is None else p.shape for p in prediction] == [(2, 2), (2, 2), (3, 2), None]


@pytest.mark.parametrize("options, kind", [
    ({"model_type": "None"}, ValueError), ({"model_type": "MNL", "intercept_ref_pos": 0}, ValueError), ({"model_type": "Asym"}, ValueError),
    ({"model_type": "Nested Logit"}, ValueError), ({"model_type": "Nested Logit", "nest_spec": {"a": [1, 2]}}, ValueError),
    ({"model_type": "Nested Logit", "nest_spec": {"a": [1, 2], "b": [2, 3]}}, ValueError), ({"model_type": "Nested Logit", "nest_spec": {"a": [1, 2, 3], "b": []}}, ValueError),
    ({"model_type": "Nested Logit", "nest_spec": {"a": [1, 2, 3.5]}}, ValueError), ({"model_type": "Mixed Logit"}, ValueError),
    ({"model_type": "Mixed Logit", "mixing_id_col": "obs_id", "mixing_vars": ["q"]}, ValueError), ({"model_type": "Scobit", "shape_names": ["a"]}, ValueError),
    ({"model_type": "Uneven", "intercept_ref_pos": 3}, ValueError),
])
def test_bad_model_arguments(long, options, kind):
    with pytest.raises(kind):
        create_choice_model(long, *KEYS, {"x": "all_same"}, **options)


@pytest.mark.parametrize("column", ["cast(null as double)", "double('nan')", "double('infinity')", "'text'", "true"])
def test_bad_specification_columns(long, column):
    with pytest.raises(ValueError):
        create_choice_model(long.withColumn("x", F.expr(column)), *KEYS, {"x": "all_same"}, "MNL")


def test_bad_prediction_and_fit_arguments(long):
    model = create_choice_model(long, *KEYS, {"x": "all_same"}, "MNL")
    with pytest.raises(NotImplementedError):
        model.print_summaries()
    for params in ([np.zeros(1)], [np.zeros(2), None, None, None], [np.zeros(1), np.zeros(1), None, None]):
        with pytest.raises(ValueError):
            model.predict(long, params)
    with pytest.raises(ValueError):
        model.predict(long, [np.zeros(1), None, None, None], return_long_probs=False)
    for kwargs in ({"init_vals": np.zeros(2)}, {"init_vals": None}, {"init_vals": np.zeros(1), "method": "unknown"}):
        with pytest.raises(ValueError):
            model.fit_mle(**kwargs)
    with pytest.raises(TypeError):
        model.fit_mle(np.zeros(1), ridge="a")
    with pytest.raises(ValueError):
        create_choice_model(long.withColumn("w", F.lit(-1.0)), *KEYS, {"x": "all_same"}, "MNL").fit_mle(np.zeros(1), weights="w")


def test_constraints_hold(long):
    model = create_choice_model(long, *KEYS, {"x": "all_same", "m": [1, 2]}, "MNL")
    fit = model.fit_mle(np.array([0.5, 0.1, 0.1]), constrained_pos=[0], ridge=0.1)
    assert fit.params[0] == 0.5 and np.isnan(fit.std_err[0]) and not np.isnan(fit.std_err[1])


def test_small_validators(long, spark):
    validate.contiguous(long.withColumn("r", F.monotonically_increasing_id()), "obs_id", "r")
    with pytest.raises(ValueError):
        validate.contiguous(long.withColumn("r", -F.col("obs_id")), "obs_id", "r")
    with pytest.raises(ValueError):
        validate.all_chosen(long, "alt_id", "choice")
    with pytest.raises(ValueError):
        validate.column_existence("x", long, present=False)
    with pytest.raises(ValueError):
        validate.sampled_ids(spark.createDataFrame([(9,)], "obs_id long"), long, "obs_id")
    for bad in (0, 100, "a"):
        with pytest.raises(ValueError):
            validate.confidence(bad)
    with pytest.raises(ValueError):
        validate.weight_array([1, -1], 2)


def test_sources(spark, tmp_path, long):
    long.write.parquet(str(tmp_path / "t.parquet"))
    long.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert read_table(str(tmp_path / "t.parquet"), spark).count() == read_table(str(tmp_path / "t.csv"), spark).count() == 5
    assert read_table(long) is long
    with pytest.raises(ValueError):
        read_table("a.xls", spark)
    with pytest.raises(TypeError):
        read_table(3)


def test_stratified_samples(spark):
    alt, choice = map(int, "121323231312"), map(int, "011001100110")
    df = spark.createDataFrame([(1 + i // 2, a, c) for i, (a, c) in enumerate(zip(alt, choice))], "obs_id long, alt_id int, choice int")
    strata = {}
    for a, o in sampling.observations_by_choice(df, "obs_id", "alt_id", "choice").collect():
        strata.setdefault(a, []).append(o)
    assert {a: sorted(v) for a, v in strata.items()} == {1: [2, 6], 2: [1, 4], 3: [3, 5]}
    drawn = sampling.draw_samples({a: sorted(v) for a, v in strata.items()}, 5, 55)
    assert drawn.shape == (5, 6)
    assert all(set(row[:2]) <= {2, 6} and set(row[2:4]) <= {1, 4} and set(row[4:]) <= {3, 5} for row in drawn.tolist())
    frame = sampling.samples_frame(df, "obs_id", "alt_id", "choice", 5, 55)
    rows = sampling.bootstrap_rows(df, "obs_id", frame)
    assert rows.count() == 5 * 12
    poisson = sampling.multiplicities(df, "obs_id", "alt_id", "choice", 200, 3)
    assert abs(poisson.agg(F.sum("weight")).first()[0] / 1200 - 1) < 0.1


def test_many_blocks_add_up(long, spark):
    design = spec.bind({"x": "all_same"}, [1, 2, 3])
    from choicelake.plans.kernels import Family

    family = Family(spec.Layout(index=1), 3)
    big = long.unionByName(long.withColumn("obs_id", F.col("obs_id") + 10)).unionByName(long.withColumn("obs_id", F.col("obs_id") + 20))
    values = []
    for rows in (2, 10_000):
        blocks = Blocks(big, design, "obs_id", "alt_id", "choice", block_rows=rows)
        values.append(blocks.evaluate(family, np.array([-0.6]), True))
        blocks.release()
    assert values[0].value == pytest.approx(3 * -2.6784712675) and values[1].value == pytest.approx(values[0].value)
    np.testing.assert_allclose(values[0].hessian, values[1].hessian)


def test_mixed_kernel_agrees_with_aggregation(spark):
    rows = [(o, o % 4, a, int((o + a) % 3 == 0), float((o * a) % 5) / 3) for o in range(1, 13) for a in (1, 2, 3)]
    df = spark.createDataFrame(rows, "obs_id long, unit long, alt_id int, choice int, x double")
    model = create_choice_model(df, *KEYS, {"x": "all_same"}, "Mixed Logit", mixing_id_col="unit", mixing_vars=["x"])
    made = normal_draws(4, 6, 1, 3)[0]
    theta = np.array([0.3, 0.7])
    given = spark.createDataFrame([(u, d, float(made[u, d])) for u in range(4) for d in range(6)], "unit long, draw_id int, eta_0 double")
    for draws, by_kernel in (
        (given, model.log_likelihood(theta, draws={u: made[u][:, None] for u in range(4)})),
        (model.draws_of(df, 6, 3), model.log_likelihood(theta, num_draws=6, seed=3)),
    ):
        per_draw = model._per_draw(df, draws, theta)
        s = sequences(per_draw, "unit", "choice").groupBy("unit").agg(F.avg("sequence_probability").alias("m"))
        assert s.agg(F.sum(F.ln("m"))).first()[0] == pytest.approx(by_kernel)


def test_seeded_draws_are_the_generator_s():
    one, two = normal_draws(3, 5, 2, 912)
    rng = np.random.RandomState(912)
    assert np.array_equal(one, rng.normal(size=(3, 5))) and np.array_equal(two, rng.normal(size=(3, 5)))


def test_totals_without_each_are_those_of_the_copies(long, spark):
    totals = {r["deleted"]: (r["n_rows"], r["x"]) for r in sampling.totals_without_each(long, "obs_id", ["x"]).collect()}
    copies = sampling.without_each(long, "obs_id", long.select(F.col("obs_id").alias("deleted")).distinct())
    want = {r["deleted"]: (r["n"], r["s"]) for r in copies.groupBy("deleted").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()}
    assert totals.keys() == want.keys() and all(totals[k] == pytest.approx(want[k]) for k in want)


def test_minimisers():
    f = lambda x: ((x[0] - 1) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([2 * (x[0] - 1) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    h = lambda x: np.array([[2 - 400 * (x[1] - 3 * x[0] ** 2), -400 * x[0]], [-400 * x[0], 200.0]])
    for method in ("BFGS", "newton-cg"):
        found = minimise(f, np.array([-1.2, 1.0]), method, 1e-8, hessian=h)
        assert found.success and np.allclose(found.x, 1, atol=1e-6)


def test_stream_scoring(spark, long, tmp_path):
    from choicelake.streaming.scoring import score_stream

    long.coalesce(1).write.parquet(str(tmp_path / "in"))
    model = create_choice_model(long, *KEYS, {"x": "all_same"}, "MNL")
    stream = spark.readStream.schema(long.schema).parquet(str(tmp_path / "in"))
    query = score_stream(model, stream, str(tmp_path / "out"), str(tmp_path / "check"), [np.array([-0.6]), None, None, None])
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
