"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelake.operators import validate


def convert_long_to_wide(long_data: DataFrame, ind_vars: list[str], alt_specific_vars: list[str],
                         subset_specific_vars: Mapping[str, list], obs_id_col: str, alt_id_col: str, choice_col: str,
                         alt_name_dict: Mapping | None = None, null_value=None) -> DataFrame:
    """One row per observation: id, chosen alternative, availabilities, individual variables, variable x alternative.

    One grouped aggregation with an expression per cell; cells of unavailable alternatives are
    ``null_value``.  Alternatives come in ascending order, under their names if given.
    """
    subset_specific_vars = subset_specific_vars or {}
    validate.columns_present(
        [obs_id_col, alt_id_col, choice_col, *ind_vars, *alt_specific_vars, *subset_specific_vars], long_data
    )
    validate.duplicates(long_data, obs_id_col, alt_id_col)
    validate.one_choice_each(long_data, obs_id_col, choice_col)
    validate.alternative_names(alt_name_dict, alt_id_col, long_data)
    validate.columns_used(3 + len(ind_vars) + len(alt_specific_vars) + len(subset_specific_vars), long_data)
    alternatives = sorted(r[0] for r in long_data.select(alt_id_col).distinct().collect())
    label = lambda a: (alt_name_dict or {}).get(a, a)
    alt, choice = F.col(f"`{alt_id_col}`"), F.col(f"`{choice_col}`").cast("int")

    def cell(variable: str, a):
        value = F.max(F.when(alt == a, F.col(f"`{variable}`")))
        if null_value is not None:
            value = F.when(F.max(F.when(alt == a, 1)).isNull(), F.lit(null_value)).otherwise(value)
        return value.alias(f"{variable}_{label(a)}")

    cells = [F.max(F.when(choice == 1, alt)).alias(choice_col)]
    cells += [F.max(F.when(alt == a, 1).otherwise(0)).alias(f"availability_{label(a)}") for a in alternatives]
    cells += [F.max(F.col(f"`{v}`")).alias(v) for v in ind_vars]
    cells += [cell(v, a) for v in alt_specific_vars for a in alternatives]
    cells += [cell(v, a) for v, some in subset_specific_vars.items() for a in some]
    return long_data.groupBy(obs_id_col).agg(*cells)


def convert_wide_to_long(wide_data: DataFrame, ind_vars: list[str], alt_specific_vars: Mapping[str, Mapping],
                         availability_vars: Mapping, obs_id_col: str, choice_col: str,
                         new_alt_id_name: str | None = None) -> DataFrame:
    """One row per observation and available alternative (availability other than 0).

    ``availability_vars``: alternative -> column; ``alt_specific_vars``: new name -> {alternative: column};
    an alternative that a variable does not name gets 0.0.  One projection and an explode: no row moves.
    """
    alt_name = new_alt_id_name or "alt_id"
    named = [c for by_alt in alt_specific_vars.values() for c in by_alt.values()]
    validate.columns_present([obs_id_col, choice_col, *ind_vars, *named, *availability_vars.values()], wide_data)
    validate.columns_used(2 + len(ind_vars) + len(set(named)) + len(availability_vars), wide_data, "wide data")
    validate.check_wide(wide_data, obs_id_col, choice_col, availability_vars, alt_specific_vars)
    rows = []
    for a in sorted(availability_vars):
        fields = [
            F.lit(a).cast("long").alias(alt_name),
            (F.col(f"`{choice_col}`") == a).cast("int").alias(choice_col),
            (F.col(f"`{availability_vars[a]}`") != 0).alias("__available"),
        ]
        for variable, by_alt in alt_specific_vars.items():
            value = F.col(f"`{by_alt[a]}`").cast("double") if a in by_alt else F.lit(0.0)
            fields.append(value.alias(variable))
        rows.append(F.struct(*fields))
    return (
        wide_data.select(
            F.col(f"`{obs_id_col}`").cast("long").alias(obs_id_col), *(F.col(f"`{v}`") for v in ind_vars), F.explode(F.array(*rows)).alias("__row")
        )
        .where("__row.__available")
        .select(
            obs_id_col, F.col(f"__row.`{alt_name}`"), F.col(f"__row.`{choice_col}`"), *(F.col(f"`{v}`") for v in ind_vars),
            *(F.col(f"__row.`{v}`") for v in alt_specific_vars),
        )
    )
