"""Choice probabilities as window aggregates over the observation.

One exchange on the observation (or the mixing unit); everything else is projection.  Fixed
parameters are literals here; fitting passes them to kernels instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelake.functions.transforms import bounded_exp
from choicelake.operators.spec import nest_of

TINY = 1e-300


def floored(p: Column) -> Column:
    """Exact zeros become the least that a logarithm is taken of."""
    return F.when(p == 0, F.lit(TINY)).otherwise(p)


def flat(df: DataFrame, transformed: Column, obs_id: str, name: str = "probability", by: tuple[str, ...] = ()) -> DataFrame:
    """exp(h) over its sum in the observation; ``by`` adds keys such as a draw or a parameter set."""
    window = Window.partitionBy(obs_id, *by)
    return df.withColumn("__e", bounded_exp(transformed)).withColumn(
        name, floored(F.col("__e") / F.sum("__e").over(window))
    ).drop("__e")


def sets(df: DataFrame, transformed: list[Column], obs_id: str, name: str = "probability") -> DataFrame:
    """A row per input row and entry of ``transformed``, with ``set_id`` from 0.

    All sets' sums are taken over one window of the rows as they are; rows are multiplied after it, as they leave.
    """
    window, every = Window.partitionBy(obs_id), [f"__e{i}" for i in range(len(transformed))]
    e = df.withColumns({n: bounded_exp(h) for n, h in zip(every, transformed)})
    totals = e.withColumns({f"{n}_all": F.sum(n).over(window) for n in every})
    shares = totals.withColumns({n: floored(F.col(n) / F.col(f"{n}_all")) for n in every})
    own = [F.col(f"`{c}`") for c in df.columns]
    each = F.array(*(F.struct(F.lit(i).alias("set_id"), F.col(n).alias(name)) for i, n in enumerate(every)))
    return shares.select(*own, F.explode(each).alias("__set")).select(*own, "__set.set_id", f"__set.{name}")


def nested(df: DataFrame, index: Column, natural: list[float], nests: Mapping, obs_id: str, alt_id: str,
           name: str = "probability") -> DataFrame:
    """Two-level softmax with, besides ``name``, p_given_nest, p_nest and inclusive (the nest's sum).

    Natural parameters lie in (0, 1].  Both windows share the exchange on the observation.
    """
    lam = None
    for i, value in enumerate(natural):
        hit = F.col("__nest") == i
        lam = F.when(hit, F.lit(float(value))) if lam is None else lam.when(hit, F.lit(float(value)))
    nest, obs = Window.partitionBy(obs_id, "__nest"), Window.partitionBy(obs_id)
    keyed = df.repartition(obs_id)
    return (
        keyed.withColumn("__nest", nest_of(nests, alt_id))
        .withColumn("__lam", lam)
        .withColumn("__s", bounded_exp(index / F.col("__lam")))
        .withColumn("inclusive", F.sum("__s").over(nest))
        .withColumn("__share", F.pow("inclusive", F.col("__lam") - 1) * F.col("__s"))
        .withColumn("p_given_nest", floored(F.col("__s") / F.col("inclusive")))
        .withColumn("__total", F.sum("__share").over(obs))
        .withColumn("p_nest", floored(F.pow("inclusive", F.col("__lam")) / F.col("__total")))
        .withColumn(name, floored(F.col("__share") / F.col("__total")))
        .drop("__nest", "__lam", "__s", "__share", "__total")
    )


def mixed(df: DataFrame, index: Column, draws: DataFrame, deviations: Column, obs_id: str, mix_id: str) -> DataFrame:
    """A row per input row and draw, with ``draw_probability``.

    ``draws``: (mix_id, draw_id, eta_0, ...); ``deviations`` is the sum of x * sigma * eta over them.
    """
    joined = df.join(draws, mix_id)
    return flat(joined, index + deviations, obs_id, "draw_probability", ("draw_id",))


def averaged(per_draw: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Mean (or weighted sum) of draw_probability over the draws."""
    total = F.avg("draw_probability") if weight is None else F.sum(weight * F.col("draw_probability"))
    return per_draw.groupBy(*keys).agg(total.alias("probability"))


def sequences(per_draw: DataFrame, mix_id: str, choice: str) -> DataFrame:
    """(mix_id, draw_id, sequence_probability): the product of what each unit chose, per draw."""
    log = F.ln(floored(F.col("draw_probability")))
    return per_draw.groupBy(mix_id, "draw_id").agg(
        F.exp(F.sum(F.col(choice).cast("double") * log)).alias("sequence_probability")
    )


def chosen(df: DataFrame, choice: str) -> DataFrame:
    return df.where(F.col(choice).cast("int") == 1)
