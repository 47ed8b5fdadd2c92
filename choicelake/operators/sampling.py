"""Stratified resampling of observations by what they chose."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelake.operators import validate

#: Observations of a bucket, about.
BUCKET_OBS = 4096


def observations_by_choice(df: DataFrame, obs_id: str, alt_id: str, choice: str) -> DataFrame:
    """(alternative, obs_id): who chose what, once each."""
    return df.where(F.col(choice).cast("int") == 1).select(F.col(alt_id).alias("alternative"), obs_id).distinct()


def strata_counts(df: DataFrame, obs_id: str, alt_id: str, choice: str) -> DataFrame:
    """(alternative, n_obs)."""
    return observations_by_choice(df, obs_id, alt_id, choice).groupBy("alternative").agg(F.count("*").alias("n_obs"))


def draw_samples(by_alternative: dict, n_samples: int, seed: int | None = None) -> np.ndarray:
    """(samples x observations) ids, drawn with replacement within each stratum, strata in order.

    ``by_alternative``: alternative -> its sorted observation ids.
    """
    rng = np.random.RandomState(seed)
    parts = []
    for alternative in sorted(by_alternative):
        ids = np.asarray(by_alternative[alternative])
        parts.append(rng.choice(ids, size=len(ids) * n_samples, replace=True).reshape(n_samples, len(ids)))
    return np.concatenate(parts, axis=1)


def samples_frame(df: DataFrame, obs_id: str, alt_id: str, choice: str, n_samples: int, seed: int | None = None) -> DataFrame:
    """(rep, bootstrap_id, obs_id) with the same draws as ``draw_samples``; ids pass through the driver.

    For tables whose ids fit there.  ``multiplicities`` draws without it, though not stratum by stratum.
    """
    pairs = observations_by_choice(df, obs_id, alt_id, choice).collect()
    strata: dict = {}
    for alternative, obs in pairs:
        strata.setdefault(alternative, []).append(obs)
    drawn = draw_samples({a: sorted(v) for a, v in strata.items()}, n_samples, seed)
    rows = [(rep + 1, slot + 1, int(obs)) for rep, sample in enumerate(drawn) for slot, obs in enumerate(sample)]
    return df.sparkSession.createDataFrame(rows, f"rep int, bootstrap_id int, {obs_id} long")


def multiplicities(df: DataFrame, obs_id: str, alt_id: str, choice: str, n_samples: int, seed: int) -> DataFrame:
    """(rep, obs_id, weight) for any size: how often each observation is drawn, drawn where it lies.

    Every observation gets an independent Poisson(1) count from a hash of (seed, rep, obs_id), the
    usual stand-in for drawing with replacement when no task sees a whole stratum; each stratum
    keeps its size in expectation.
    """
    base = observations_by_choice(df, obs_id, alt_id, choice).select(obs_id)
    reps = base.select(F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("rep"), obs_id)
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", obs_id), F.lit(2**52)) + 0.5) / float(2**52)
    weight, mass, total = F.lit(0), np.exp(-1.0), 0.0
    for k in range(12):
        total += mass
        weight = weight + F.when(u > total, 1).otherwise(0)
        mass /= k + 1
    return reps.withColumn("weight", weight).where("weight > 0")


@dataclass(frozen=True)
class BucketDraws:
    """Stratified samples of any size, as how many draws of each fall to each bucket of observations.

    Observations are dealt to buckets by hash.  A sample of a stratum is drawn in two steps: how many of its draws fall
    to each bucket (multinomial, on the driver, a number a bucket), and which observations of the bucket they are
    (where these lie).  That is drawing with replacement, each stratum as large as it is, and no task sees all of it.
    """

    n_samples: int
    buckets: int
    seed: int
    draws: list  # by the alternative's position: samples x buckets

    def bucket(self, obs_id: str) -> Column:
        return F.pmod(F.xxhash64(f"`{obs_id}`"), F.lit(self.buckets))

    def times(self, bucket: np.ndarray, obs: np.ndarray, alt: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(samples x observations) how often each is drawn; ``obs`` numbers rows' observations, whole buckets of them in order."""
        chose = np.unique(np.column_stack([bucket, alt, obs])[y.astype(int) == 1], axis=0)
        out = np.zeros((self.n_samples, int(obs[-1]) + 1), np.uint16)
        bounds = np.flatnonzero((chose[1:, :2] != chose[:-1, :2]).any(1)) + 1
        for part in np.split(chose, bounds) if len(chose) else ():
            (b, a), own = part[0, :2].tolist(), part[:, 2]
            n = self.draws[a][:, b]
            rng = np.random.Generator(np.random.Philox(key=[self.seed & (2**64 - 1), b * len(self.draws) + a]))
            found = np.repeat(np.arange(self.n_samples), n) * len(own) + rng.integers(0, len(own), int(n.sum()))
            out[:, own] += np.bincount(found, minlength=self.n_samples * len(own)).reshape(self.n_samples, -1).astype(np.uint16)
        return out if out.max(initial=0) > 255 else out.astype(np.uint8)


def bucket_draws(df: DataFrame, obs_id: str, alt_id: str, choice: str, alternatives: list, n_obs: int, n_samples: int,
                 seed: int | None = None, bucket_obs: int = BUCKET_OBS) -> BucketDraws:
    seed = int(np.random.SeedSequence().entropy % 2**63) if seed is None else seed
    out = BucketDraws(n_samples, max(1, -(-n_obs // bucket_obs)), seed, [])
    pairs = observations_by_choice(df, obs_id, alt_id, choice).select("alternative", out.bucket(obs_id).alias("bucket"))
    held = np.zeros((len(alternatives), out.buckets), np.int64)
    for alternative, bucket, n in pairs.groupBy("alternative", "bucket").agg(F.count("*").alias("n")).collect():
        held[alternatives.index(alternative), bucket] = n
    rng = np.random.default_rng([seed & (2**64 - 1), 1])
    for own in held:
        drawn, some = np.zeros((n_samples, out.buckets), np.int32), np.flatnonzero(own)
        if len(some):
            drawn[:, some] = rng.multinomial(own.sum(), own[some] / own.sum(), n_samples)
        out.draws.append(drawn)
    return out


def bootstrap_rows(df: DataFrame, obs_id: str, samples: DataFrame, boot_id: str = "bootstrap_id") -> DataFrame:
    """The rows of the sampled observations, each draw as an observation of its own.

    ``samples``: (rep, ``boot_id``, obs_id).  An equi-join on the observation.
    """
    validate.column_existence(boot_id, df, present=False)
    validate.column_existence(obs_id, df)
    validate.sampled_ids(samples, df, obs_id)
    return samples.join(df, obs_id)


def totals_without_each(df: DataFrame, obs_id: str, columns: list[str]) -> DataFrame:
    """(deleted, n_rows, and the sum of each column) of the table without each value of ``obs_id``.

    One aggregation per value and one over all: totals less a group's own, so no row is copied.
    """
    sums = [F.count("*").alias("n_rows"), *(F.sum(c).alias(c) for c in columns)]
    own = df.groupBy(F.col(obs_id).alias("deleted")).agg(*sums)
    total = df.agg(*sums).first()
    return own.select("deleted", *((F.lit(total[c]) - F.col(c)).alias(c) for c in ("n_rows", *columns)))


def without_each(df: DataFrame, obs_id: str, deletions: DataFrame) -> DataFrame:
    """Leave-one-out tables: for each of ``deletions`` (obs_id as ``deleted``), all rows but its own.

    A copy of the table per deletion, so only for a few of them; sums are better had by ``totals_without_each``.
    """
    return deletions.join(df, F.col("deleted") != F.col(obs_id))
