"""Checks of arguments, schemas and rows.

Those that need the rows are batched: ``check_long`` and ``check_wide`` run one or two
aggregations whatever the number of rules.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from numbers import Number

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def mapping(item, title: str) -> None:
    if not isinstance(item, Mapping):
        raise TypeError(f"{title} must be a mapping")


def string(item, title: str) -> None:
    if not isinstance(item, str):
        raise TypeError(f"{title} must be a string")


def array(item, title: str) -> None:
    if not isinstance(item, np.ndarray):
        raise TypeError(f"{title} must be an array")


def long_and_specification(data, specification) -> None:
    if not isinstance(data, DataFrame):
        raise TypeError("the long table must be a DataFrame")
    mapping(specification, "the specification")


def columns_present(columns: Iterable[str], df: DataFrame, what: str = "columns") -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} not in the data: {missing}")


def column_existence(name: str, df: DataFrame, present: bool = True) -> None:
    if (name in df.columns) != present:
        raise ValueError(f"{name} must {'' if present else 'not '}be among the columns")


def columns_used(n_used: int, df: DataFrame, title: str = "long data") -> None:
    """Warns if the arguments account for more or fewer columns than there are."""
    if n_used != len(df.columns):
        warnings.warn(f"{title}: {len(df.columns)} columns, of which the arguments name {n_used}", stacklevel=2)


def numeric_types(columns: Iterable[str], df: DataFrame) -> None:
    kinds = {f.name: f.dataType for f in df.schema}
    if bad := [c for c in columns if c in kinds and not isinstance(kinds[c], NumericType)]:
        raise ValueError(f"not numbers: {bad}")


def _not_finite(column: str):
    value = F.col(f"`{column}`")
    return value.isNull() | F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf"))


def finite(columns: Iterable[str], df: DataFrame) -> None:
    """No null, NaN or infinity in any of the columns: one aggregation for all."""
    columns = list(columns)
    if not columns:
        return
    row = df.agg(*(F.max(_not_finite(c)).alias(f"b{i}") for i, c in enumerate(columns))).first()
    if found := [c for i, c in enumerate(columns) if row[i]]:
        raise ValueError(f"null, NaN or infinite values in {found}")


def overview(columns: Iterable[str], df: DataFrame, alt_id: str) -> tuple[int, list]:
    """How many rows there are, and the alternatives in order; with the check that ``finite`` makes, in one aggregation."""
    columns = list(columns)
    row = df.agg(
        *(F.max(_not_finite(c)).alias(f"b{i}") for i, c in enumerate(columns)), F.count("*").alias("rows"),
        F.collect_set(f"`{alt_id}`").alias("seen"), F.max(F.col(f"`{alt_id}`").isNull()).alias("blank"),
    ).first()
    if found := [c for i, c in enumerate(columns) if row[i]]:
        raise ValueError(f"null, NaN or infinite values in {found}")
    if row["blank"]:
        raise ValueError("an alternative is null")
    return row["rows"], sorted(row["seen"])


def repeated_rows(df: DataFrame, obs_id: str, alt_id: str) -> DataFrame:
    """(obs_id, alt_id, n) of the alternatives that an observation has more than once."""
    return df.groupBy(obs_id, alt_id).agg(F.count("*").alias("n")).where("n > 1")


def duplicates(df: DataFrame, obs_id: str, alt_id: str) -> None:
    if not repeated_rows(df, obs_id, alt_id).limit(1).isEmpty():
        raise ValueError("an observation has an alternative twice")


def choice_totals(df: DataFrame, obs_id: str, choice: str) -> DataFrame:
    """One row: n_obs observations and n_chosen choices."""
    return df.agg(F.countDistinct(obs_id).alias("n_obs"), F.sum(F.col(choice).cast("long")).alias("n_chosen"))


def one_choice_each(df: DataFrame, obs_id: str, choice: str) -> None:
    row = choice_totals(df, obs_id, choice).first()
    if (row["n_chosen"] or 0) < row["n_obs"]:
        raise ValueError("fewer choices than observations")
    if row["n_chosen"] > row["n_obs"]:
        raise ValueError("more choices than observations")


def alternative_names(names, alt_id: str, df: DataFrame) -> None:
    if names is None:
        return
    mapping(names, "alternative names")
    known = {r[0] for r in df.select(alt_id).distinct().collect()}
    if unknown := [k for k in names if k not in known]:
        raise ValueError(f"not among the alternatives: {unknown}")


def ridge(value) -> None:
    if value is not None and (not isinstance(value, Number) or isinstance(value, bool)):
        raise TypeError("ridge must be a number or None")


def weights(df: DataFrame, column: str | None) -> None:
    if column is not None:
        columns_present([column], df, "weights")
        if not df.where(F.col(column).isNull() | F.isnan(F.col(column).cast("double")) | (F.col(column) < 0)).limit(1).isEmpty():
            raise ValueError("weights must be numbers of at least 0")


def weight_array(values, n: int) -> np.ndarray:
    values = np.asarray(values, float)
    if values.ndim != 1 or len(values) != n or not (values >= 0).all():
        raise ValueError(f"weights must be {n} numbers of at least 0")
    return values


def contiguous(df: DataFrame, obs_id: str, row_position: str) -> None:
    """Strict mode only: observation ids must not decrease along ``row_position``.

    A range partitioning and a comparison of neighbours within and between partitions, not a
    global window.
    """
    parts = df.select(obs_id, row_position).sort(row_position).withColumn("p", F.spark_partition_id())
    from pyspark.sql import Window

    inner = parts.withColumn("before", F.lag(obs_id).over(Window.partitionBy("p").orderBy(row_position)))
    falls = inner.where(F.col("before") > F.col(obs_id)).limit(1)
    ends = sorted(
        (r["p"], r["a"], r["b"])
        for r in parts.groupBy("p").agg(F.min_by(obs_id, row_position).alias("a"), F.max_by(obs_id, row_position).alias("b")).collect()
    )
    if any(x[2] > y[1] for x, y in zip(ends, ends[1:])) or not falls.isEmpty():
        raise ValueError("observation ids decrease")


def all_chosen(df: DataFrame, alt_id: str, choice: str) -> None:
    never = [r[0] for r in df.groupBy(alt_id).agg(F.max(F.col(choice).cast("int")).alias("m")).where("m = 0").collect()]
    if never:
        raise ValueError(f"never chosen: {sorted(never)}")


# --- wide tables ---------------------------------------------------------------------------


def _offered(choice: str, availability: Mapping):
    """The availability of what a row chose; null if that has no column."""
    chosen, there = F.col(f"`{choice}`"), None
    for k, column in availability.items():
        value = F.col(f"`{column}`")
        there = F.when(chosen == k, value) if there is None else there.when(chosen == k, value)
    return F.coalesce(there, F.lit(0))


def unavailable_choices(df: DataFrame, choice: str, availability: Mapping) -> DataFrame:
    """The rows of a wide table that chose what was not offered."""
    return df.where(_offered(choice, availability) == 0)


def check_wide(df: DataFrame, obs_id: str, choice: str, availability: Mapping, alt_specific: Mapping) -> None:
    """All rules of a wide table in one aggregation and one small collect.

    No null choices; observations once each; chosen alternatives known, available, and every
    named alternative chosen by someone.
    """
    keys = list(availability)
    chosen = F.col(f"`{choice}`")
    row = df.agg(
        F.count("*").alias("rows"), F.countDistinct(obs_id).alias("obs"),
        F.coalesce(F.max(chosen.isNull()), F.lit(False)).alias("blank"),
        F.coalesce(F.max(~chosen.isin(keys)), F.lit(False)).alias("unknown"),
        F.coalesce(F.max(_offered(choice, availability) == 0), F.lit(False)).alias("absent"),
        F.collect_set(F.when(chosen.isin(keys), chosen)).alias("seen"),  # as many as there are alternatives
    ).first()
    if row["blank"]:
        raise ValueError("choices are missing")
    if row["obs"] != row["rows"]:
        raise ValueError("observation ids repeat")
    if row["unknown"]:
        raise ValueError("a chosen alternative has no availability column")
    if row["absent"]:
        some = [r[0] for r in unavailable_choices(df, choice, availability).select(obs_id).limit(20).collect()]
        raise ValueError(f"observations chose an unavailable alternative: {some}, ...")
    if never := [k for k in keys if k not in row["seen"]]:
        raise ValueError(f"never chosen: {never}")
    used = {a for columns in alt_specific.values() for a in columns}
    if never := [k for k in used if k not in row["seen"]]:
        raise ValueError(f"never chosen: {never}")


# --- model arguments ---------------------------------------------------------------------


def reference_position(position, n_alternatives: int, title: str, needed: bool = False) -> None:
    if position is None and not needed:
        return
    if not isinstance(position, int) or isinstance(position, bool):
        raise ValueError(f"{title} must be an integer")
    if not 0 <= position < n_alternatives:
        raise ValueError(f"{title} must be in 0 to {n_alternatives - 1}")


def name_count(names, n_alternatives: int, constrained: bool, title: str) -> None:
    if names is not None and len(names) != n_alternatives - constrained:
        raise ValueError(f"{title}: {n_alternatives - constrained} names are needed")


def nests(spec, alternatives: Iterable) -> None:
    """String keys; non-empty lists of integers; disjoint; together exactly the alternatives."""
    mapping(spec, "the nest specification")
    if not all(isinstance(k, str) for k in spec) or not all(isinstance(v, list) for v in spec.values()):
        raise TypeError("nests are lists under string names")
    if any(not v for v in spec.values()):
        raise ValueError("a nest is empty")
    members = [a for v in spec.values() for a in v]
    if not all(isinstance(a, (int, np.integer)) and not isinstance(a, bool) for a in members):
        raise ValueError("members of nests must be integers")
    if len(set(members)) != len(members):
        raise ValueError("an alternative is in two nests")
    if missing := set(alternatives) - set(members):
        raise ValueError(f"without a nest: {sorted(missing)}")
    if unknown := set(members) - set(alternatives):
        raise ValueError(f"not among the alternatives: {sorted(unknown)}")


def degenerate_nests(spec: Mapping) -> list[int]:
    """Positions of nests with a single alternative, whose parameter is not identified."""
    return [i for i, v in enumerate(spec.values()) if len(v) == 1]


def parameter_list(params, layout) -> None:
    """[index, intercepts, shapes, nests]: arrays or None, alike in dimensions, of the right lengths."""
    if not isinstance(params, list) or len(params) != 4:
        raise ValueError("a list of four is needed: index, intercepts, shapes, nests")
    if not isinstance(params[0], np.ndarray) or not all(x is None or isinstance(x, np.ndarray) for x in params[1:]):
        raise TypeError("parameters must be arrays or None, the index an array")
    given = [x for x in params if x is not None]
    if len({x.ndim for x in given}) > 1:
        raise ValueError("parameter arrays must all have one dimension or all two")
    if given[0].ndim == 2 and len({x.shape[1] for x in given}) > 1:
        raise ValueError("parameter arrays must have as many columns as each other")
    wanted = (layout.index + layout.sigmas, layout.intercepts, layout.shapes, layout.nests)
    for x, n, title in zip(params, wanted, ("index", "intercept", "shape", "nest"), strict=True):
        if (0 if x is None else x.shape[0]) != n:
            raise ValueError(f"{n} {title} parameters are needed")


def chosen_output(choice: str | None, long_probabilities: bool) -> None:
    if choice is None and not long_probabilities:
        raise ValueError("a choice column is needed for chosen probabilities")


def mixing_names(mixing: Iterable[str], index_names: list[str], named: bool = True) -> None:
    if unknown := [m for m in mixing if m not in index_names]:
        hint = "the names given" if named else f"the default names {index_names}"
        raise ValueError(f"mixing variables are not among {hint}: {unknown}")


def model_type(kind, known: Iterable[str]) -> None:
    if kind not in known:
        raise ValueError(f"model types are {sorted(known)}, not {kind!r}")


def replicate_kind(kind: str) -> None:
    if kind not in ("bootstrap", "jackknife"):
        raise ValueError("replicates are 'bootstrap' or 'jackknife'")


def confidence(percentage) -> None:
    if not isinstance(percentage, Number) or not 0 < percentage < 100:
        raise ValueError("a confidence percentage lies between 0 and 100")


def dimensions(values: np.ndarray, n: int, title: str) -> None:
    if not isinstance(values, np.ndarray) or values.ndim != n:
        raise ValueError(f"{title} must be an array of {n} dimensions")


def sampled_ids(samples: DataFrame, df: DataFrame, obs_id: str) -> None:
    if not samples.join(df.select(obs_id).distinct(), obs_id, "left_anti").limit(1).isEmpty():
        raise ValueError("sampled observations are not in the data")
