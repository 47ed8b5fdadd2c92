"""Every query of the choice engine with its SQL for an independent engine.

The main table has an observation per order and an alternative per line number; choices
follow from a fixed hash, so that estimates are interior.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from choicelake.operators import intervals, reshape, sampling, softmax, spec, validate
from choicelake.plans.bootstrap import Boot
from choicelake.plans.models import ChoiceModel, create_choice_model
from choicelake.sources.tables import dealt

BETA = np.array([-0.6, 0.8])
RIDGE = 0.5
ALTERNATIVES = tuple(range(1, 8))
KEYS = ("alt_id", "obs_id", "choice")
SHAPES = np.array([-0.3, 0.2, 0.0, 0.4, -0.1, 0.3, 0.1])
ETA = SHAPES[1:]
TAU = np.array([0.1, -0.2, 0.3, 0.05, -0.15, 0.2])
NESTS = {"low": [1, 2, 3], "high": [4, 5, 6, 7]}
LAMBDA = np.array([0.8, 0.6])
MIXED_BETA, SIGMA = np.array([0.4, -0.7, 0.3]), np.array([0.5])

# --- tables -------------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by order once: what is grouped, ranked or summed by observation later moves no row again."""
    lineitem = _read(spark, sf_dir, "lineitem")
    lines = (
        dealt(lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), lineitem.count(), "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_linenumber").alias("alt_id"))
        .agg((F.min("l_extendedprice") / 1e5).alias("x1"), (F.min("l_quantity") / 50).alias("x2"))
    )
    order = Window.partitionBy("obs_id").orderBy((F.col("obs_id") * F.lit(2654435761) + F.col("alt_id") * F.lit(40503)) % 65521, "alt_id")
    return lines.withColumn("choice", (F.row_number().over(order) == 1).cast("int"))


def panel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O', 'P')")
    return orders.select(
        F.col("o_custkey").alias("mix_id"), F.col("o_orderkey").alias("obs_id"), "o_orderstatus", "o_totalprice",
        F.explode(F.array(*(F.lit(a) for a in (1, 2, 3)))).alias("alt_id"),
    ).select(
        "mix_id", "obs_id", "alt_id", (F.substring(F.lit("FOP"), F.col("alt_id"), F.lit(1)) == F.col("o_orderstatus")).cast("int").alias("choice"),
        (F.col("o_totalprice") / 1e6 * F.col("alt_id")).alias("x"), F.lit(1.0).alias("intercept"),
    )


def draw_table(panel: DataFrame) -> DataFrame:
    draws = panel.select("mix_id").distinct().select("mix_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("draw_id"))
    return draws.withColumn("eta_0", F.sin(F.col("mix_id") * 12.9898 + F.col("draw_id") * 78.233) * 1.5)


def priority_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide: each order chooses one of five priorities, all available."""
    orders = _read(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("obs_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("choice"),
        *(F.lit(1).alias(f"av{a}") for a in range(1, 6)),
    )


_LINES = """lines AS (SELECT l_orderkey AS obs_id, l_linenumber AS alt_id, min(l_extendedprice) / 1e5 AS x1, min(l_quantity) / 50 AS x2
FROM lineitem GROUP BY l_orderkey, l_linenumber),
t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY obs_id ORDER BY (obs_id * 2654435761 + alt_id * 40503) % 65521, alt_id) = 1
THEN 1 ELSE 0 END AS choice FROM lines)"""
_PANEL = """panel AS (SELECT o_custkey AS mix_id, o_orderkey AS obs_id, a AS alt_id,
CASE WHEN substr('FOP', a, 1) = o_orderstatus THEN 1 ELSE 0 END AS choice, o_totalprice / 1e6 * a AS x
FROM orders CROSS JOIN (VALUES (1), (2), (3)) AS alts(a) WHERE o_orderstatus IN ('F', 'O', 'P')),
draws AS (SELECT mix_id, d AS draw_id, sin(mix_id * CAST(12.9898 AS DOUBLE) + d * CAST(78.233 AS DOUBLE)) * CAST(1.5 AS DOUBLE) AS eta
FROM (SELECT DISTINCT mix_id FROM panel) CROSS JOIN (VALUES (1), (2), (3), (4)) AS n(d)),
per_draw AS (SELECT *, e / sum(e) OVER (PARTITION BY obs_id, draw_id) AS p FROM (
SELECT panel.*, draw_id, eta, exp(CASE alt_id WHEN 2 THEN 0.4e0 WHEN 3 THEN -0.7e0 ELSE 0e0 END + 0.3e0 * x + 0.5e0 * x * eta) AS e
FROM panel JOIN draws USING (mix_id)))"""
_V = "(-0.6e0 * x1 + 0.8e0 * x2)"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


def _r(column, digits: int = 6):
    return (F.round(column, digits) + 0.0)


# --- scans and checks ------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT obs_id, alt_id, choice, x1, x2 FROM t")
def scan_choice_table(spark, sf_dir):
    return choice_table(spark, sf_dir).select("obs_id", "alt_id", "choice", "x1", "x2")


@query("""SELECT l_orderkey AS obs_id, l_linenumber AS alt_id, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def dup_check(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obs_id"), F.col("l_linenumber").alias("alt_id"))
    return validate.repeated_rows(lines, "obs_id", "alt_id")


@query(f"WITH {_LINES} SELECT count(DISTINCT obs_id) AS n_obs, CAST(sum(choice) AS BIGINT) AS n_chosen FROM t")
def chosen_count_check(spark, sf_dir):
    return validate.choice_totals(choice_table(spark, sf_dir), "obs_id", "choice")


@query("""SELECT o_orderkey AS obs_id FROM orders WHERE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) NOT IN (1, 2, 3, 4)""")
def unavailable_choice_check(spark, sf_dir):
    """Orders whose choice would be missing if the fifth priority were not offered."""
    wide = priority_table(spark, sf_dir).withColumn("av5", F.lit(0))
    return validate.unavailable_choices(wide, "choice", {a: f"av{a}" for a in range(1, 6)}).select("obs_id")


@query(f"""WITH {_LINES} SELECT alt_id, count(*) AS n_available, CAST(sum(choice) AS BIGINT) AS n_chosen FROM t GROUP BY alt_id""")
def availability_counts(spark, sf_dir):
    return choice_table(spark, sf_dir).groupBy("alt_id").agg(F.count("*").alias("n_available"), F.sum("choice").alias("n_chosen"))


def _rule_calls(t: DataFrame, wide: DataFrame) -> dict[str, Callable[[], object]]:
    """A call of every rule on an input that breaks it and on one that does not."""
    offered = {a: f"av{a}" for a in range(1, 6)}
    layout, v = spec.Layout(index=2), validate
    ordered = t.withColumn("place", F.col("obs_id") * 10 + F.col("alt_id"))
    nests = lambda s: lambda: v.nests(s, [1, 2, 3])
    wide_rule = lambda df, k=offered: lambda: v.check_wide(df, "obs_id", "choice", k, {})
    bind = lambda s, n=None: lambda: spec.bind(s, [1, 2, 3], n)
    given = lambda *x: lambda: v.parameter_list(list(x), layout)
    return {
        "mapping": lambda: v.mapping([], "x"), "mapping_good": lambda: v.mapping({}, "x"),
        "string": lambda: v.string(1, "x"), "string_good": lambda: v.string("a", "x"),
        "array": lambda: v.array([1], "x"), "array_good": lambda: v.array(np.zeros(1), "x"),
        "long_table": lambda: v.long_and_specification([], {}), "long_table_good": lambda: v.long_and_specification(t, {}),
        "columns_present": lambda: v.columns_present(["q"], t), "columns_present_good": lambda: v.columns_present(["x1"], t),
        "column_existence": lambda: v.column_existence("x1", t, present=False), "column_existence_good": lambda: v.column_existence("x1", t),
        "numeric_types": lambda: v.numeric_types(["x1"], t.withColumn("x1", F.lit("a"))), "numeric_types_good": lambda: v.numeric_types(["x1"], t),
        "finite_null": lambda: v.finite(["x1"], t.withColumn("x1", F.lit(None).cast("double"))),
        "finite_nan": lambda: v.finite(["x1"], t.withColumn("x1", F.lit(float("nan")))),
        "finite_infinite": lambda: v.finite(["x1"], t.withColumn("x1", F.lit(float("-inf")))), "finite_good": lambda: v.finite(["x1", "x2"], t),
        "duplicates": lambda: v.duplicates(t.unionAll(t.limit(1)), "obs_id", "alt_id"), "duplicates_good": lambda: v.duplicates(t, "obs_id", "alt_id"),
        "no_choice": lambda: v.one_choice_each(t.withColumn("choice", F.lit(0)), "obs_id", "choice"),
        "many_choices": lambda: v.one_choice_each(t.withColumn("choice", F.lit(2)), "obs_id", "choice"),
        "one_choice_each_good": lambda: v.one_choice_each(t, "obs_id", "choice"),
        "alternative_names": lambda: v.alternative_names({99: "a"}, "alt_id", t), "alternative_names_good": lambda: v.alternative_names({1: "a"}, "alt_id", t),
        "ridge": lambda: v.ridge("a"), "ridge_good": lambda: v.ridge(0.5),
        "weights_negative": lambda: v.weights(t.withColumn("w", F.lit(-1.0)), "w"), "weights_missing": lambda: v.weights(t, "w"),
        "weights_good": lambda: v.weights(t, "x2"), "weight_array": lambda: v.weight_array([1, -1], 2), "weight_array_good": lambda: v.weight_array([1, 0], 2),
        "contiguous": lambda: v.contiguous(ordered.withColumn("place", -F.col("place")), "obs_id", "place"),
        "contiguous_good": lambda: v.contiguous(ordered, "obs_id", "place"),
        "all_chosen": lambda: v.all_chosen(t.withColumn("choice", (F.col("alt_id") == 1).cast("int")), "alt_id", "choice"),
        "all_chosen_good": lambda: v.all_chosen(t, "alt_id", "choice"),
        "wide_blank": wide_rule(wide.withColumn("choice", F.when(F.col("choice") > 1, F.col("choice")))),
        "wide_repeated": wide_rule(wide.unionAll(wide.limit(1))), "wide_unknown": wide_rule(wide.withColumn("choice", F.col("choice") + 1)),
        "wide_absent": wide_rule(wide.withColumn("av5", F.lit(0))), "wide_never_chosen": wide_rule(wide.withColumn("av6", F.lit(1)), offered | {6: "av6"}),
        "wide_good": wide_rule(wide),
        "specification_word": bind({"x": "some"}), "specification_depth": bind({"x": [[[1]]]}), "specification_unknown": bind({"x": [9]}),
        "names_keys": bind({"x": "all_same"}, {"y": "n"}), "names_length": bind({"x": "all_diff"}, {"x": ["a"]}), "specification_good": bind({"x": [[1, 2], 3]}, {"x": ["a", "b"]}),
        "reference_type": lambda: v.reference_position("a", 3, "x"), "reference_range": lambda: v.reference_position(3, 3, "x"),
        "reference_needed": lambda: v.reference_position(None, 3, "x", True), "reference_good": lambda: v.reference_position(2, 3, "x"),
        "name_count": lambda: v.name_count(["a"], 3, True, "x"), "name_count_good": lambda: v.name_count(["a", "b"], 3, True, "x"),
        "nests_keys": nests({1: [1, 2, 3]}), "nests_values": nests({"a": (1, 2, 3)}), "nests_empty": nests({"a": [1, 2, 3], "b": []}),
        "nests_numbers": nests({"a": [1, 2, 3.5]}), "nests_shared": nests({"a": [1, 2], "b": [2, 3]}), "nests_missing": nests({"a": [1, 2]}),
        "nests_unknown": nests({"a": [1, 2, 3, 4]}), "nests_good": nests({"a": [1, 2], "b": [3]}),
        "parameters_list": given(np.zeros(2)), "parameters_types": given([0, 0], None, None, None), "parameters_length": given(np.zeros(3), None, None, None),
        "parameters_dimensions": given(np.zeros(2), np.zeros((1, 1)), None, None), "parameters_columns": given(np.zeros((2, 2)), np.zeros((0, 3)), None, None),
        "parameters_good": given(np.zeros((2, 3)), None, None, None),
        "chosen_output": lambda: v.chosen_output(None, False), "chosen_output_good": lambda: v.chosen_output("c", False),
        "mixing_names": lambda: v.mixing_names(["q"], ["x"]), "mixing_names_good": lambda: v.mixing_names(["x"], ["x"]),
        "model_type": lambda: v.model_type("Probit", ["MNL"]), "model_type_good": lambda: v.model_type("MNL", ["MNL"]),
        "replicate_kind": lambda: v.replicate_kind("a"), "replicate_kind_good": lambda: v.replicate_kind("jackknife"),
        "confidence": lambda: v.confidence(100), "confidence_good": lambda: v.confidence(95),
        "dimensions": lambda: v.dimensions(np.zeros(2), 2, "x"), "dimensions_good": lambda: v.dimensions(np.zeros((2, 2)), 2, "x"),
        "sampled_ids": lambda: v.sampled_ids(t.select((-F.col("obs_id")).alias("obs_id")), t, "obs_id"),
        "sampled_ids_good": lambda: v.sampled_ids(t.select("obs_id"), t, "obs_id"),
    }


#: What each rule must do; written out, as the other engine sees no calls.
_OUTCOMES = {
    "passes": """mapping_good string_good array_good long_table_good columns_present_good column_existence_good numeric_types_good finite_good
duplicates_good one_choice_each_good alternative_names_good ridge_good weights_good weight_array_good contiguous_good all_chosen_good wide_good
specification_good reference_good name_count_good nests_good parameters_good chosen_output_good mixing_names_good model_type_good
replicate_kind_good confidence_good dimensions_good sampled_ids_good""",
    "TypeError": "mapping string array long_table ridge nests_keys nests_values parameters_types",
    "ValueError": """columns_present column_existence numeric_types finite_null finite_nan finite_infinite duplicates no_choice many_choices
alternative_names weights_negative weights_missing weight_array contiguous all_chosen wide_blank wide_repeated wide_unknown wide_absent
wide_never_chosen specification_word specification_depth specification_unknown names_keys names_length reference_type reference_range
reference_needed name_count nests_empty nests_numbers nests_shared nests_missing nests_unknown parameters_list parameters_length
parameters_dimensions parameters_columns chosen_output mixing_names model_type replicate_kind confidence dimensions sampled_ids""",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{rule}', '{what}')" for what, names in _OUTCOMES.items() for rule in names.split()) + ") AS r(rule, outcome)")
def rule_outcomes(spark, sf_dir):
    """Every check, called on whole tables that break it and on whole tables that do not."""
    rows, long, wide = [], choice_table(spark, sf_dir).persist(), priority_table(spark, sf_dir).persist()
    for rule, call in _rule_calls(long, wide).items():
        try:
            call()
            rows.append((rule, "passes"))
        except (TypeError, ValueError) as error:
            rows.append((rule, type(error).__name__))
    long.unpersist()
    wide.unpersist()
    return spark.createDataFrame(rows, "rule string, outcome string")


# --- design and reshape -------------------------------------------------------------------------


def _design(spark, sf_dir, specification) -> DataFrame:
    from choicelake.operators.spec import bind

    table = choice_table(spark, sf_dir)
    design = bind(specification, ALTERNATIVES)
    names = [n.replace("[", "").replace("]", "").replace(", ", "_") for n in design.names]
    return table.select("obs_id", "alt_id", *(t.expression("alt_id").alias(n) for t, n in zip(design.terms, names)))


@query(f"WITH {_LINES} SELECT obs_id, alt_id, x1, x2 FROM t")
def design_all_same(spark, sf_dir):
    return _design(spark, sf_dir, {"x1": "all_same", "x2": "all_same"})


@query(f"WITH {_LINES} SELECT obs_id, alt_id, "
       + ", ".join(f"CASE WHEN alt_id = {a} THEN x1 ELSE 0e0 END AS x1_{a}" for a in ALTERNATIVES) + " FROM t")
def design_all_diff(spark, sf_dir):
    return _design(spark, sf_dir, {"x1": "all_diff"})


@query(f"""WITH {_LINES} SELECT obs_id, alt_id, CASE WHEN alt_id IN (1, 2) THEN x1 ELSE 0e0 END AS x1_1_2,
CASE WHEN alt_id = 3 THEN x1 ELSE 0e0 END AS x1_3, CASE WHEN alt_id IN (4, 5, 6) THEN x2 ELSE 0e0 END AS x2_4_5_6 FROM t""")
def design_subset_groups(spark, sf_dir):
    return _design(spark, sf_dir, {"x1": [[1, 2], 3], "x2": [[4, 5, 6]]})


@query(f"WITH {_LINES} SELECT obs_id, max(CASE WHEN choice = 1 THEN alt_id END) AS choice, "
       + ", ".join(f"max(CASE WHEN alt_id = {a} THEN 1 ELSE 0 END) AS availability_{a}" for a in ALTERNATIVES) + ", "
       + ", ".join(f"max(CASE WHEN alt_id = {a} THEN x1 END) AS x1_{a}" for a in ALTERNATIVES) + ", "
       + ", ".join(f"max(CASE WHEN alt_id = {a} THEN x2 END) AS x2_{a}" for a in (1, 2)) + " FROM t GROUP BY obs_id")
def long_to_wide(spark, sf_dir):
    table = choice_table(spark, sf_dir)
    return reshape.convert_long_to_wide(table, [], ["x1"], {"x2": [1, 2]}, "obs_id", "alt_id", "choice")


@query(f"""WITH {_LINES} SELECT obs_id, CAST(alt_id AS BIGINT) AS alt_id, choice, x1,
CASE WHEN alt_id <= 2 THEN x2 ELSE 0e0 END AS x2 FROM t""")
def wide_to_long(spark, sf_dir):
    wide = long_to_wide(spark, sf_dir)
    return reshape.convert_wide_to_long(
        wide, [], {"x1": {a: f"x1_{a}" for a in ALTERNATIVES}, "x2": {a: f"x2_{a}" for a in (1, 2)}},
        {a: f"availability_{a}" for a in ALTERNATIVES}, "obs_id", "choice",
    )


# --- multinomial logit ----------------------------------------------------------------------------


def _model(spark, sf_dir, kind: str = "MNL", table: DataFrame | None = None, **options) -> ChoiceModel:
    table = choice_table(spark, sf_dir) if table is None else table
    return create_choice_model(table, *KEYS, {"x1": "all_same", "x2": "all_same"}, kind, **options)


def _mnl_frame(spark, sf_dir) -> DataFrame:
    """Fixed parameters need no look at the data: a projection and one window."""
    table = choice_table(spark, sf_dir)
    return softmax.flat(table, F.col("x1") * float(BETA[0]) + F.col("x2") * float(BETA[1]), "obs_id")


_P = f"p AS (SELECT *, exp({_V}) / sum(exp({_V})) OVER (PARTITION BY obs_id) AS p FROM t)"


@query(f"WITH {_LINES}, {_P} SELECT obs_id, alt_id, round(p, 6) AS probability FROM p")
def mnl_probability(spark, sf_dir):
    return _mnl_frame(spark, sf_dir).select("obs_id", "alt_id", F.round("probability", 6).alias("probability"))


@query(f"WITH {_LINES}, {_P} SELECT obs_id, round(p, 6) AS probability FROM p WHERE choice = 1")
def mnl_chosen_probability(spark, sf_dir):
    return softmax.chosen(_mnl_frame(spark, sf_dir), "choice").select("obs_id", F.round("probability", 6).alias("probability"))


@query(f"WITH {_LINES}, {_P} SELECT obs_id, round(sum((choice - p) * (choice - p) / p), 6) AS chi_square FROM p GROUP BY obs_id")
def individual_chi_square(spark, sf_dir):
    p = _mnl_frame(spark, sf_dir)
    each = F.pow(F.col("choice") - F.col("probability"), 2) / F.col("probability")
    return p.groupBy("obs_id").agg(F.round(F.sum(each), 6).alias("chi_square"))


def _values(spark, rows: list[tuple], schema: str = "name string, value double") -> DataFrame:
    return spark.createDataFrame([(*r[:-1], round(float(r[-1]), 6) + 0.0) for r in rows], schema)


def _totals(model: ChoiceModel, theta, second: bool = False, weights=None, ridge: float | None = None, **options):
    blocks = model.blocks(weights, **options)
    try:
        family, theta = model.family(), np.asarray(theta, float)
        return family.penalised(theta, blocks.evaluate(family, theta, second), ridge)
    finally:
        blocks.release()


@query(f"WITH {_LINES}, {_P} SELECT 'log_likelihood' AS name, round(sum(choice * ln(p)), 6) AS value FROM p")
def mnl_loglik(spark, sf_dir):
    return _values(spark, [("log_likelihood", _totals(_model(spark, sf_dir), BETA).value)])


@query(f"""WITH {_LINES}, {_P} SELECT 'log_likelihood' AS name,
round(sum(choice * ln(p)) - {RIDGE}e0 * (0.36e0 + 0.64e0), 6) AS value FROM p""")
def ridge_loglik(spark, sf_dir):
    return _values(spark, [("log_likelihood", _totals(_model(spark, sf_dir), BETA, ridge=RIDGE).value)])


@query(f"WITH {_LINES}, {_P} SELECT 'log_likelihood' AS name, round(sum((1 + obs_id % 3) * choice * ln(p)), 6) AS value FROM p")
def weighted_loglik(spark, sf_dir):
    return _values(spark, [("log_likelihood", _totals(_model(spark, sf_dir), BETA, weights=1 + F.col("obs_id") % 3).value)])


@query(f"""WITH {_LINES} SELECT 'null_log_likelihood' AS name, round(sum(-ln(n)), 6) AS value
FROM (SELECT obs_id, count(*) AS n FROM t GROUP BY obs_id)""")
def null_loglik(spark, sf_dir):
    return _values(spark, [("null_log_likelihood", _totals(_model(spark, sf_dir), np.zeros(2)).value)])


@query(f"""WITH {_LINES}, {_P} SELECT 'x1' AS name, round(sum((choice - p) * x1), 6) AS value FROM p
UNION ALL SELECT 'x2', round(sum((choice - p) * x2), 6) FROM p""")
def mnl_gradient(spark, sf_dir):
    return _values(spark, list(zip(("x1", "x2"), _totals(_model(spark, sf_dir), BETA).gradient)))


def _pairs(spark, matrix: np.ndarray, n: int) -> DataFrame:
    names = ("x1", "x2")
    rows = [(a, b, matrix[i, j] / n) for i, a in enumerate(names) for j, b in enumerate(names)]
    return _values(spark, rows, "row string, col string, value double")


def _matrix_sql(body: str, cell: str) -> str:
    parts = [f"SELECT 'x{i}' AS row, 'x{j}' AS col, {cell.format(i=i, j=j)} AS value FROM o" for i in (1, 2) for j in (1, 2)]
    return f"WITH {_LINES}, {_P}, o AS ({body}) " + " UNION ALL ".join(parts)


@query(_matrix_sql(
    """SELECT obs_id, sum(p * x1) AS m1, sum(p * x2) AS m2, sum(p * x1 * x1) AS s11, sum(p * x1 * x2) AS s12,
    sum(p * x1 * x2) AS s21, sum(p * x2 * x2) AS s22 FROM p GROUP BY obs_id""",
    "round(-sum(s{i}{j} - m{i} * m{j}) / count(*), 6) + 0e0"))
def mnl_hessian(spark, sf_dir):
    """Per observation."""
    model = _model(spark, sf_dir)
    return _pairs(spark, _totals(model, BETA, True).hessian, model.data.select("obs_id").distinct().count())


@query(_matrix_sql(
    "SELECT obs_id, sum((choice - p) * x1) AS g1, sum((choice - p) * x2) AS g2 FROM p GROUP BY obs_id",
    "round(sum(g{i} * g{j}) / count(*), 6) + 0e0"))
def mnl_fisher_bhhh(spark, sf_dir):
    model = _model(spark, sf_dir)
    return _pairs(spark, _totals(model, BETA, True).information, model.data.select("obs_id").distinct().count())


@query(f"""WITH {_LINES}, {_P}, s AS (SELECT sum(choice * ln(p)) AS ll, -sum(choice * ln(n)) AS ll0, count(DISTINCT obs_id) AS n_obs
FROM (SELECT *, count(*) OVER (PARTITION BY obs_id) AS n FROM p))
SELECT 'rho_squared' AS name, round(1 - ll / ll0, 6) AS value FROM s UNION ALL SELECT 'rho_bar_squared', round(1 - (ll - 2) / ll0, 6) FROM s
UNION ALL SELECT 'aic', round(-2 * ll + 4, 6) FROM s UNION ALL SELECT 'bic', round(-2 * ll + 2 * ln(n_obs), 6) FROM s""")
def rho_squared_aic_bic(spark, sf_dir):
    model = _model(spark, sf_dir)
    ll, ll0 = _totals(model, BETA).value, _totals(model, np.zeros(2)).value
    n = model.data.select("obs_id").distinct().count()
    return _values(spark, [
        ("rho_squared", 1 - ll / ll0), ("rho_bar_squared", 1 - (ll - 2) / ll0), ("aic", -2 * ll + 4), ("bic", -2 * ll + 2 * math.log(n)),
    ])


GRID = np.array([[-0.6, 0.8], [0.0, 0.0], [0.5, -0.5], [1.0, 1.0]])


@query(f"""WITH {_LINES}, g AS (SELECT * FROM (VALUES (0, -0.6e0, 0.8e0), (1, 0e0, 0e0), (2, 0.5e0, -0.5e0), (3, 1e0, 1e0)) AS g(set_id, b1, b2)),
q AS (SELECT t.*, set_id, exp(b1 * x1 + b2 * x2) AS e FROM t CROSS JOIN g),
r AS (SELECT *, e / sum(e) OVER (PARTITION BY obs_id, set_id) AS p FROM q)
SELECT set_id, round(sum(choice * ln(p)), 6) AS log_likelihood FROM r GROUP BY set_id""")
def multi_param_loglik(spark, sf_dir):
    model = _model(spark, sf_dir)
    p = model.predict(model.data, [GRID.T.copy(), None, None, None])
    return p.groupBy("set_id").agg(F.round(F.sum(F.col("choice") * F.ln("probability")), 6).alias("log_likelihood"))


# --- asymmetric family ------------------------------------------------------------------------------


def _case(values, first: int = 1) -> str:
    return "CASE alt_id " + " ".join(f"WHEN {a} THEN CAST({float(v)!r} AS DOUBLE)" for a, v in enumerate(values, first)) + " ELSE 0e0 END"


def _shares() -> np.ndarray:
    from choicelake.functions.transforms import natural_asym

    return natural_asym(ETA, 0)


_G, _T, _C = _case(np.exp(SHAPES)), _case(TAU, 2), _case(_shares())
_H = {
    "clog": f"CASE WHEN v >= 3.7 THEN exp(v) ELSE ln(exp(exp(v)) - 1) END + {_T}",
    "scobit": f"-ln(pow(1 + exp(-v), {_G}) - 1) + {_T}",
    "uneven": f"v + ln(1 + exp(-v)) - ln(1 + exp(-v * {_G}))",
    "asym": f"ln({_C}) - v * CASE WHEN v >= 0 THEN ln({_C}) ELSE ln((1 - {_C}) / 6) END + {_T}",
}
_DV = {
    "clog": "exp(v) / (1 - exp(-exp(v)))",
    "scobit": f"{_G} * exp(-v) / (1 + exp(-v)) * pow(1 + exp(-v), {_G}) / (pow(1 + exp(-v), {_G}) - 1)",
    "uneven": f"1 / (1 + exp(-v)) + {_G} / (1 + exp({_G} * v))",
    "asym": f"-CASE WHEN v >= 0 THEN ln({_C}) ELSE ln((1 - {_C}) / 6) END",
}
_DS = {
    "scobit": f"-{_G} * ln(1 + exp(-v)) * pow(1 + exp(-v), {_G}) / (pow(1 + exp(-v), {_G}) - 1)",
    "uneven": f"{_G} * v / (1 + exp({_G} * v))",
    "asym": f"1 / {_C} - v * CASE WHEN v >= 0 THEN 1 / {_C} ELSE -1 / (1 - {_C}) END",
}
_ASYM = {
    "clog": ("Cloglog", {"intercept_ref_pos": 0}, np.concatenate([TAU, BETA])),
    "scobit": ("Scobit", {"intercept_ref_pos": 0}, np.concatenate([SHAPES, TAU, BETA])),
    "uneven": ("Uneven", {}, np.concatenate([SHAPES, BETA])),
    "asym": ("Asym", {"intercept_ref_pos": 0, "shape_ref_pos": 0}, np.concatenate([ETA, TAU, BETA])),
}


def _family_sql(name: str) -> str:
    return f"""WITH {_LINES}, v AS (SELECT *, {_V} AS v FROM t), h AS (SELECT *, exp({_H[name]}) AS e FROM v),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY obs_id) AS p FROM h)"""


def _cells(name: str) -> list[tuple[str, str]]:
    """(parameter, derivative of the transformed index with respect to it)."""
    cells = []
    if name in ("scobit", "uneven"):
        cells += [(f"Shape_{a}", f"CASE WHEN alt_id = {a} THEN {_DS[name]} ELSE 0e0 END") for a in ALTERNATIVES]
    if name == "asym":
        c = _shares()
        cells += [(f"Shape_{a}", f"({_DS[name]}) * {_C} * (CASE WHEN alt_id = {a} THEN 1e0 ELSE 0e0 END - CAST({float(c[a - 1])!r} AS DOUBLE))") for a in ALTERNATIVES[1:]]
    if name != "uneven":
        cells += [(f"Outside_ASC_{a}", f"CASE WHEN alt_id = {a} THEN 1e0 ELSE 0e0 END") for a in ALTERNATIVES[1:]]
    return cells + [(x, f"({_DV[name]}) * {x}") for x in ("x1", "x2")]


def _gradient_sql(name: str) -> str:
    return _family_sql(name) + " " + " UNION ALL ".join(f"SELECT '{n}' AS name, round(sum((choice - p) * ({e})), 6) + 0e0 AS value FROM p" for n, e in _cells(name))


def _second_sql(name: str, body: str, cell: str) -> str:
    """Cells over pairs of some of a family's parameters, from the derivatives of its index."""
    known = dict(_cells(name))
    some = _some(name)
    derivatives = ", ".join(f"({known[n]}) AS d{i}" for i, n in enumerate(some))
    sums = body.format(
        m=", ".join(f"sum(p * d{i}) AS m{i}, sum((choice - p) * d{i}) AS g{i}" for i in range(len(some))),
        s=", ".join(f"sum(p * d{i} * d{j}) AS s{i}_{j}" for i in range(len(some)) for j in range(len(some))),
    )
    parts = [f"SELECT '{a}' AS row, '{b}' AS col, {cell.format(i=i, j=j)} AS value FROM o" for i, a in enumerate(some) for j, b in enumerate(some)]
    return f"{_family_sql(name)}, d AS (SELECT obs_id, choice, p, {derivatives} FROM p), o AS ({sums}) " + " UNION ALL ".join(parts)


def _some(name: str) -> list[str]:
    return [n for n in ("Shape_2", "Shape_5", "Outside_ASC_3", "x1", "x2") if n in dict(_cells(name))]


def _split(theta, model):
    _, shapes, intercepts, beta = model.layout.split(theta)
    return [beta, intercepts, shapes, None]


#: With constants alone every family's estimates are the logs of the chosen shares.
_SHARES = """WITH n AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS a, count(*) AS n FROM orders GROUP BY 1)
SELECT a AS alternative, round(ln(n * 1e0 / (SELECT n FROM n WHERE a = 1)), 3) + 0e0 AS value FROM n WHERE a > 1"""


def _shares_model(spark, sf_dir, kind: str, options: dict) -> ChoiceModel:
    """Constants for priorities 2 to 5 and, outside of those, a variable that is zero throughout."""
    long = reshape.convert_wide_to_long(priority_table(spark, sf_dir), [], {}, {a: f"av{a}" for a in range(1, 6)}, "obs_id", "choice")
    inside = "intercept_ref_pos" not in options
    specification = {"intercept": [2, 3, 4, 5]} if inside else {"zero": "all_same"}
    return create_choice_model(long.withColumn("zero", F.lit(0.0)), *KEYS, specification, kind, **options)


def _share_rows(spark, values) -> DataFrame:
    return spark.createDataFrame([(a, round(float(v), 3) + 0.0) for a, v in enumerate(values, 2)], "alternative int, value double")


def _register_family(name: str) -> None:
    kind, options, theta = _ASYM[name]

    def probability(spark, sf_dir):
        model = _model(spark, sf_dir, kind, **options)
        return model.predict(model.data, _split(theta, model)).select("obs_id", "alt_id", F.round("probability", 6).alias("probability"))

    def gradient(spark, sf_dir):
        model = _model(spark, sf_dir, kind, **options)
        return _values(spark, list(zip(model.param_names, _totals(model, theta).gradient)))

    def second(spark, sf_dir, which: str):
        model = _model(spark, sf_dir, kind, **options)
        matrix, n, at = getattr(_totals(model, theta, True), which), model.data.select("obs_id").distinct().count(), model.param_names.index
        rows = [(a, b, matrix[at(a), at(b)] / n) for a in _some(name) for b in _some(name)]
        return _values(spark, rows, "row string, col string, value double")

    def hessian(spark, sf_dir):
        return second(spark, sf_dir, "hessian")

    def fisher(spark, sf_dir):
        return second(spark, sf_dir, "information")

    def fit(spark, sf_dir):
        model = _shares_model(spark, sf_dir, kind, options)
        held = [i for i, n in enumerate(model.param_names) if n.startswith("Shape") or n == "zero"]
        found = model.fit_mle(np.zeros(len(model.param_names)), constrained_pos=held, just_point=True, gradient_tol=1e-8, loss_tol=1e-12)
        return _share_rows(spark, [v for i, v in enumerate(found.x) if i not in held])

    hessian.__name__, fisher.__name__, fit.__name__ = f"{name}_hessian", f"{name}_fisher", f"{name}_fit"
    query(_second_sql(name, "SELECT obs_id, {m}, {s} FROM d GROUP BY obs_id", "round(-sum(s{i}_{j} - m{i} * m{j}) / count(*), 6) + 0e0"))(hessian)
    query(_second_sql(name, "SELECT obs_id, {m} FROM d GROUP BY obs_id", "round(sum(g{i} * g{j}) / count(*), 6) + 0e0"))(fisher)
    query(_SHARES)(fit)
    probability.__name__, gradient.__name__ = f"{name}_probability", f"{name}_gradient"
    query(_family_sql(name) + " SELECT obs_id, alt_id, round(p, 6) AS probability FROM p")(probability)
    query(_gradient_sql(name))(gradient)


for _name in _ASYM:
    _register_family(_name)

# --- nested logit --------------------------------------------------------------------------------------

_NESTED = f"""WITH {_LINES}, v AS (SELECT *, {_V} AS v, CASE WHEN alt_id <= 3 THEN 1 ELSE 2 END AS nest,
CASE WHEN alt_id <= 3 THEN 0.8e0 ELSE 0.6e0 END AS lam FROM t), s AS (SELECT *, exp(v / lam) AS s FROM v),
i AS (SELECT *, sum(s) OVER (PARTITION BY obs_id, nest) AS i, max(choice) OVER (PARTITION BY obs_id, nest) AS c FROM s),
p AS (SELECT *, s / i AS q, pow(i, lam) / sum(s * pow(i, lam - 1)) OVER (PARTITION BY obs_id) AS r FROM i),
z AS (SELECT *, q * r AS p FROM p)"""
_THETA = np.concatenate([np.log(LAMBDA / (1 - LAMBDA)), BETA])


def _nested(spark, sf_dir) -> ChoiceModel:
    return _model(spark, sf_dir, "Nested Logit", nest_spec=NESTS)


def _nested_frame(spark, sf_dir) -> DataFrame:
    model = _nested(spark, sf_dir)
    return model.predict(model.data, [BETA, None, None, _THETA[:2]])


@query(f"{_NESTED} SELECT obs_id, alt_id, round(p, 6) AS probability FROM z")
def nested_probability(spark, sf_dir):
    return _nested_frame(spark, sf_dir).select("obs_id", "alt_id", F.round("probability", 6).alias("probability"))


@query(f"{_NESTED} SELECT obs_id, alt_id, round(q, 6) AS p_given_nest, round(r, 6) AS p_nest, round(i, 6) AS inclusive FROM z")
def nested_components(spark, sf_dir):
    return _nested_frame(spark, sf_dir).select("obs_id", "alt_id", *(F.round(c, 6).alias(c) for c in ("p_given_nest", "p_nest", "inclusive")))


@query(f"{_NESTED} SELECT 'log_likelihood' AS name, round(sum(choice * ln(p)), 6) AS value FROM z")
def nested_loglik(spark, sf_dir):
    return _values(spark, [("log_likelihood", _totals(_nested(spark, sf_dir), _THETA).value)])


@query(f"""{_NESTED}, g AS (SELECT *, (p - c * q) * v / lam - (choice - c * q) * v / lam / lam + (c - r) * ln(i) / count(*) OVER (PARTITION BY obs_id, nest) AS gl,
choice / lam - q * c / lam + q * c - p AS gb FROM z)
SELECT 'low' AS name, round(sum(gl * lam * (1 - lam)), 6) AS value FROM g WHERE nest = 1
UNION ALL SELECT 'high', round(sum(gl * lam * (1 - lam)), 6) FROM g WHERE nest = 2
UNION ALL SELECT 'x1', round(sum(gb * x1), 6) FROM g UNION ALL SELECT 'x2', round(sum(gb * x2), 6) FROM g""")
def nested_gradient(spark, sf_dir):
    model = _nested(spark, sf_dir)
    return _values(spark, list(zip(model.param_names, _totals(model, _THETA).gradient)))


# --- mixed logit ---------------------------------------------------------------------------------------


def _mixed(table: DataFrame) -> ChoiceModel:
    spec = {"intercept": [2, 3], "x": "all_same"}
    return create_choice_model(table, *KEYS, spec, "Mixed Logit", mixing_id_col="mix_id", mixing_vars=["x"])


def _panel_draws(spark, sf_dir) -> DataFrame:
    table = panel_table(spark, sf_dir)
    return _mixed(table)._per_draw(table, draw_table(table), np.concatenate([MIXED_BETA, SIGMA]))


@query(f"WITH {_PANEL} SELECT obs_id, alt_id, round(avg(p), 6) AS probability FROM per_draw GROUP BY obs_id, alt_id")
def mixed_probability(spark, sf_dir):
    p = softmax.averaged(_panel_draws(spark, sf_dir), ["obs_id", "alt_id"])
    return p.select("obs_id", "alt_id", F.round("probability", 6).alias("probability"))


@query(f"""WITH {_PANEL} SELECT mix_id, draw_id, round(sum(choice * ln(p)), 6) AS log_probability FROM per_draw GROUP BY mix_id, draw_id""")
def mixed_sequence_probability(spark, sf_dir):
    s = softmax.sequences(_panel_draws(spark, sf_dir), "mix_id", "choice")
    return s.select("mix_id", "draw_id", F.round(F.ln("sequence_probability"), 6).alias("log_probability"))


@query(f"""WITH {_PANEL}, s AS (SELECT mix_id, draw_id, exp(sum(choice * ln(p))) AS s FROM per_draw GROUP BY mix_id, draw_id),
m AS (SELECT mix_id, avg(s) AS m FROM s GROUP BY mix_id) SELECT 'log_likelihood' AS name, round(sum(ln(m)), 6) AS value FROM m""")
def mixed_loglik(spark, sf_dir):
    """As two aggregations over the draws; the kernel's value is tested against it."""
    s = softmax.sequences(_panel_draws(spark, sf_dir), "mix_id", "choice").groupBy("mix_id").agg(F.avg("sequence_probability").alias("m"))
    return s.agg(F.round(F.sum(F.ln("m")), 6).alias("value")).select(F.lit("log_likelihood").alias("name"), "value")


def _mixed_totals(spark, sf_dir):
    """The kernel that fits, under the given draws."""
    table = panel_table(spark, sf_dir)
    model = _mixed(table)
    return model, _totals(model, np.concatenate([MIXED_BETA, SIGMA]), draws=draw_table(table))


_UNIT = f"""WITH {_PANEL}, s AS (SELECT mix_id, draw_id, exp(sum(choice * ln(p))) AS s FROM per_draw GROUP BY mix_id, draw_id),
w AS (SELECT mix_id, draw_id, s / sum(s) OVER (PARTITION BY mix_id) AS w, avg(s) OVER (PARTITION BY mix_id) AS m FROM s)"""


@query(f"{_UNIT} SELECT 'log_likelihood' AS name, round(sum(ln(m)) / 4, 6) AS value FROM w")
def mixed_kernel_loglik(spark, sf_dir):
    return _values(spark, [("log_likelihood", _mixed_totals(spark, sf_dir)[1].value)])


@query(_UNIT + " UNION ALL ".join(
    f" SELECT '{n}' AS name, round(sum(w * (choice - p) * {x}), 6) + 0e0 AS value FROM per_draw JOIN w USING (mix_id, draw_id)"
    for n, x in (("intercept_2", "CASE alt_id WHEN 2 THEN 1 ELSE 0 END"), ("intercept_3", "CASE alt_id WHEN 3 THEN 1 ELSE 0 END"), ("x", "x"), ("Sigma x", "x * eta"))))
def mixed_kernel_gradient(spark, sf_dir):
    model, totals = _mixed_totals(spark, sf_dir)
    return _values(spark, list(zip(model.param_names, totals.gradient)))


@query(f"""WITH {_PANEL}, s AS (SELECT mix_id, draw_id, exp(sum(choice * ln(p))) AS s FROM per_draw WHERE obs_id % 2 = 0 GROUP BY mix_id, draw_id),
w AS (SELECT mix_id, draw_id, s / sum(s) OVER (PARTITION BY mix_id) AS w FROM s)
SELECT obs_id, alt_id, round(sum(coalesce(w, 0.25e0) * p), 6) AS probability FROM per_draw LEFT JOIN w USING (mix_id, draw_id)
WHERE obs_id % 2 = 1 GROUP BY obs_id, alt_id""")
def panel_predict(spark, sf_dir):
    """Even orders are the past, odd ones the future."""
    table = panel_table(spark, sf_dir)
    new = table.where("obs_id % 2 = 1")
    p = _mixed(table.where("obs_id % 2 = 0")).panel_predict(new, 4, param_list=[np.concatenate([MIXED_BETA, SIGMA]), None, None, None], draws=draw_table(new))
    return p.select("obs_id", "alt_id", F.round("probability", 6).alias("probability"))


# --- resampling and intervals -----------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT alt_id AS alternative, count(DISTINCT obs_id) AS n_obs FROM t WHERE choice = 1 GROUP BY alt_id")
def strata_counts(spark, sf_dir):
    return sampling.strata_counts(choice_table(spark, sf_dir), "obs_id", "alt_id", "choice")


@query(f"""WITH {_LINES}, u AS (SELECT DISTINCT obs_id, rep, (obs_id * 2654435761 + rep * 69069) % 65521 AS u
FROM t CROSS JOIN (VALUES (1), (2)) AS r(rep)), s AS (SELECT rep, obs_id * 8 + copy AS bootstrap_id, obs_id
FROM u JOIN (VALUES (1, 24104), (2, 48208), (3, 60260), (4, 64277)) AS n(copy, above) ON u > above)
SELECT rep, bootstrap_id, obs_id, alt_id, choice, x1 FROM s JOIN t USING (obs_id)""")
def bootstrap_rows(spark, sf_dir):
    """Two samples from all observations, each drawn from 0 to 4 times by a hash with the shares of a Poisson(1) count."""
    table = choice_table(spark, sf_dir)
    every = table.select("obs_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rep")).distinct()
    u = (F.col("obs_id") * F.lit(2654435761) + F.col("rep") * F.lit(69069)) % 65521
    copies = F.filter(F.array(*(F.when(u > above, F.lit(n)) for n, above in ((1, 24104), (2, 48208), (3, 60260), (4, 64277)))), lambda x: x.isNotNull())
    samples = every.select("rep", "obs_id", F.explode(copies).alias("copy")).select(
        "rep", (F.col("obs_id") * 8 + F.col("copy")).alias("bootstrap_id"), "obs_id"
    )
    return sampling.bootstrap_rows(table, "obs_id", samples).select("rep", "bootstrap_id", "obs_id", "alt_id", "choice", "x1")


@query(f"""WITH {_LINES}, d AS (SELECT alt_id AS deleted, count(*) AS own, sum(x1) AS x FROM t GROUP BY alt_id)
SELECT deleted, (SELECT count(*) FROM t) - own AS n_rows, round((SELECT sum(x1) FROM t) - x, 3) AS sum_x1 FROM d""")
def jackknife_counts(spark, sf_dir):
    """Leave out one alternative at a time."""
    left = sampling.totals_without_each(choice_table(spark, sf_dir), "alt_id", ["x1"])
    return left.select("deleted", "n_rows", F.round("x1", 3).alias("sum_x1"))


def _replicates(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").where("value is not null").select(F.col("event_id").alias("rep"), F.col("event_type").alias("parameter"), "value")


@query("""WITH v AS (SELECT event_type AS parameter, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k,
count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT parameter, max(CASE WHEN k = floor(round(0.05e0 * (n - 1), 9)) + 1 THEN value END) AS lower,
max(CASE WHEN k = ceil(round(0.95e0 * (n - 1), 9)) + 1 THEN value END) AS upper FROM v GROUP BY parameter""")
def percentile_interval(spark, sf_dir):
    return intervals.percentile_intervals(_replicates(spark, sf_dir), 90.0)


@query("""WITH e AS (SELECT event_type AS parameter, event_id, value FROM events WHERE value IS NOT NULL),
m AS (SELECT parameter, avg(value) AS estimate, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS m FROM e GROUP BY parameter)
SELECT parameter, round(avg(CASE WHEN event_id % 2 = 0 THEN CASE WHEN value < estimate THEN 1e0 ELSE 0e0 END END), 6) AS share_below,
round(sum(CASE WHEN event_id % 2 = 1 THEN pow(m - value, 3) END) / (6 * pow(sum(CASE WHEN event_id % 2 = 1 THEN pow(m - value, 2) END), 1.5e0)), 6) + 0e0 AS acceleration
FROM e JOIN m USING (parameter) GROUP BY parameter""")
def bca_acceleration(spark, sf_dir):
    r = _replicates(spark, sf_dir)
    estimates = r.groupBy("parameter").agg(F.avg("value").alias("estimate"))
    moments = intervals.bca_moments(r.where("rep % 2 = 0"), r.where("rep % 2 = 1"), estimates)
    return moments.select("parameter", F.round("share_below", 6).alias("share_below"), _r("acceleration").alias("acceleration"))


@query("""WITH e AS (SELECT event_type AS parameter, value FROM events WHERE value IS NOT NULL),
u AS (SELECT parameter, value - avg(value) OVER (PARTITION BY parameter) AS u FROM e)
SELECT parameter, round(sqrt(sum(u * u)) / count(*), 6) AS std_error, round(sum(pow(u, 3)) / (6 * pow(sum(u * u), 1.5e0)), 6) + 0e0 AS acceleration,
round(-sum(u * u) / (2 * pow(count(*), 2)), 6) + 0e0 AS bias FROM u GROUP BY parameter""")
def abc_acceleration_bias(spark, sf_dir):
    r = _replicates(spark, sf_dir)
    u = F.col("value") - F.avg("value").over(Window.partitionBy("parameter"))
    influence = r.select("parameter", u.alias("u")).withColumn("u2", -F.col("u") * F.col("u"))
    return intervals.abc_moments(influence).select("parameter", F.round("std_error", 6).alias("std_error"), _r("acceleration").alias("acceleration"), _r("bias").alias("bias"))


# --- fits --------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS a, count(*) AS n FROM orders GROUP BY 1)
SELECT 'intercept_' || a AS name, round(ln(n * 1e0 / (SELECT n FROM n WHERE a = 1)), 4) + 0e0 AS value FROM n WHERE a > 1""")
def asc_only_mle(spark, sf_dir):
    long = reshape.convert_wide_to_long(priority_table(spark, sf_dir), [], {}, {a: f"av{a}" for a in range(1, 6)}, "obs_id", "choice")
    model = create_choice_model(long, *KEYS, {"intercept": [2, 3, 4, 5]}, "MNL")
    fit = model.fit_mle(np.zeros(4), method="newton-cg", just_point=True, gradient_tol=1e-6)
    return spark.createDataFrame([(n, round(float(v), 4) + 0.0) for n, v in zip(model.param_names, fit.x)], "name string, value double")


@query("""WITH n AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS a, count(*) AS n FROM orders GROUP BY 1)
SELECT 'intercept_' || a AS name, round(sqrt(1e0 / n + 1e0 / (SELECT n FROM n WHERE a = 1)), 6) AS std_err,
round(ln(n * 1e0 / (SELECT n FROM n WHERE a = 1)) / sqrt(1e0 / n + 1e0 / (SELECT n FROM n WHERE a = 1)), 3) + 0e0 AS t_stat FROM n WHERE a > 1""")
def asc_fit_errors(spark, sf_dir):
    """Standard errors and t values of the constants, whose closed forms are known."""
    model = _shares_model(spark, sf_dir, "MNL", {})
    fit = model.fit_mle(np.zeros(4), method="newton-cg", gradient_tol=1e-9)
    rows = [(n, round(float(e), 6), round(float(v / e), 3) + 0.0) for n, v, e in zip(fit.names, fit.params, fit.std_err)]
    return spark.createDataFrame(rows, "name string, std_err double, t_stat double")


@query(_SHARES)
def nested_fit(spark, sf_dir):
    """Nests held at a log-sum coefficient of one leave the constants alone."""
    model = _shares_model(spark, sf_dir, "Nested Logit", {"nest_spec": {"a": [1, 2], "b": [3, 4, 5]}})
    fit = model.fit_mle(np.array([40.0, 40.0, 0, 0, 0, 0]), constrained_pos=[0, 1], just_point=True, gradient_tol=1e-8, loss_tol=1e-12)
    return _share_rows(spark, fit.x[2:])


@query("""WITH n AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1)
SELECT CASE s WHEN 'O' THEN 2 ELSE 3 END AS alternative, round(ln(n * 1e0 / (SELECT n FROM n WHERE s = 'F')), 3) + 0e0 AS value FROM n WHERE s <> 'F'""")
def mixed_fit(spark, sf_dir):
    """The variable's coefficient and spread held at zero leave the constants alone."""
    model = _mixed(panel_table(spark, sf_dir))
    fit = model.fit_mle(np.zeros(4), num_draws=4, seed=1, constrained_pos=[2, 3], just_point=True, gradient_tol=1e-8, loss_tol=1e-12)
    return _share_rows(spark, fit.x[:2])


@query()
def mnl_fit_summary(spark, sf_dir):
    model = _model(spark, sf_dir)
    model.fit_mle(np.zeros(2))
    return model.summary


@query()
def nested_fit_summary(spark, sf_dir):
    model = _nested(spark, sf_dir)
    model.fit_mle(np.concatenate([[1.0, 1.0], np.zeros(2)]), maxiter=60)
    return model.summary


@query()
def mixed_fit_summary(spark, sf_dir):
    model = _mixed(panel_table(spark, sf_dir))
    model.fit_mle(np.array([0.0, 0.0, 0.0, 0.1]), num_draws=20, seed=1, maxiter=40)
    return model.summary


@query()
def boot_intervals(spark, sf_dir):
    """Percentile intervals of the multinomial logit over 40 stratified samples."""
    model = _model(spark, sf_dir)
    model.fit_mle(np.zeros(2))
    boot = Boot(model)
    boot.generate_bootstrap_replicates(40, boot_seed=11)
    return boot.calc_percentile_interval(90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
