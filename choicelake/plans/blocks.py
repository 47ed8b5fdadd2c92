"""Packed blocks: a long table laid out once, then evaluated without a shuffle.

The table is dealt by group (observation or mixing unit) and sorted once; each partition is
packed into blocks of bounded size that end with a group.  Observations that are alike in all
rows are kept once, with their number.  The packed blocks are what persists.  An evaluation
ships the parameters in a closure, runs a NumPy kernel over the blocks and sends one small row
per partition to the driver; blocks that together are small are gathered and evaluated there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelake.operators.sampling import BucketDraws
from choicelake.operators.spec import Design
from choicelake.plans.kernels import Block, Family, Totals
from choicelake.sources.tables import dealt

BLOCK_ROWS = 65_536
#: Blocks of up to so many bytes, and rows times draws, are evaluated on the driver.
DRIVER_BYTES, DRIVER_CELLS = 4 << 20, 1 << 19
#: Bytes after which blocks go to a Python worker; the one that reaches them is the last.
BATCH_BYTES = 1 << 19
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def normal_draws(n_units: int, n_draws: int, n_vars: int, seed: int | None) -> list[np.ndarray]:
    """An array (units x draws) per mixing variable, variable by variable from one seeded stream."""
    rng = np.random.RandomState(seed)
    return [rng.standard_normal((n_units, n_draws)) for _ in range(n_vars)]


def unit_draws(ids: np.ndarray, n_draws: int, n_vars: int, seed: int) -> np.ndarray:
    """Draws that depend on a unit's id alone, so no partition needs another's: units x draws x variables."""
    out = np.empty((len(ids), n_draws, n_vars))
    for i, key in enumerate(ids):
        rng = np.random.Generator(np.random.Philox(key=[int(key) & (2**64 - 1), seed & (2**64 - 1)]))
        out[i] = rng.standard_normal((n_vars, n_draws)).T
    return out


# --- blocks as bytes ---------------------------------------------------------------------


def _narrow(values: np.ndarray) -> np.ndarray:
    """As small integers if nothing is lost by it."""
    for kind in (np.uint8, np.uint16, np.uint32):
        small = values.astype(kind) if len(values) and 0 <= values.min() and values.max() <= np.iinfo(kind).max else None
        if small is not None and np.array_equal(small, values) and not np.signbit(values).any():
            return small
    return values


def dumped(block: Block) -> bytes:
    sizes = np.bincount(block.obs)
    return pickle.dumps((
        block.x, _narrow(sizes), _narrow(block.alt), _narrow(block.y), None if (block.w == 1).all() else block.w,
        None if block.mix is None else _narrow(block.mix), block.draws, block.times, block.reps,
    ), protocol=5)


def loaded(raw) -> Block:
    x, sizes, alt, y, w, mix, draws, times, reps = pickle.loads(raw)
    return Block(
        x, np.repeat(np.arange(len(sizes)), sizes), alt.astype(np.int64), y.astype(float), np.ones(len(y)) if w is None else w,
        None if mix is None else mix.astype(np.int64), draws, times, reps,
    )


def squeezed(block: Block) -> Block:
    """Observations that are alike in all rows once, with their number; the block itself if less than half would go.

    Found by hash and compared bit by bit, so only those that are the same to the last are put together.
    """
    if not len(block.obs):
        return block
    bits = np.column_stack([block.alt.astype(float), block.y, block.w, block.x]).view(np.uint64)
    starts = block.starts
    sizes = np.diff(np.append(starts, len(block.obs)))
    place = np.arange(len(block.obs)) - starts[block.obs]
    row = place.astype(np.uint64)
    for column in bits.T:
        row = (row ^ column) * np.uint64(0x9E3779B97F4A7C15)
        row ^= row >> np.uint64(29)
    _, first, like = np.unique(np.add.reduceat(row, starts), return_index=True, return_inverse=True)
    if 2 * len(first) > len(starts):
        return block
    model = first[like]
    if not (sizes == sizes[model]).all() or not np.array_equal(bits, bits[starts[model][block.obs] + place]):
        return block
    times = np.bincount(like, np.ones(len(starts)) if block.times is None else block.times)
    order = np.argsort(first)
    keep = np.isin(block.obs, first)
    at = np.repeat(np.arange(len(first)), sizes[first[order]])
    return Block(block.x[keep], at, block.alt[keep], block.y[keep], block.w[keep], times=times[order])


def joined(blocks: list[Block]) -> Block:
    obs, mix, o, m = [], [], 0, 0
    for b in blocks:
        obs.append(b.obs + o)
        o += b.n_obs
        if b.mix is not None:
            mix.append(b.mix + m)
            m += len(b.draws)
    cat = lambda name: np.concatenate([getattr(b, name) for b in blocks])
    times = None
    if any(b.times is not None for b in blocks):
        times = np.concatenate([np.ones(b.n_obs) if b.times is None else b.times for b in blocks])
    return Block(
        cat("x"), np.concatenate(obs), cat("alt"), cat("y"), cat("w"),
        np.concatenate(mix) if mix else None, cat("draws") if mix else None, times,
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of about so many rows, cut where the first column changes; a larger group comes whole."""
    held: list[list[np.ndarray]] = []
    size, most = 0, rows
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= most:
            whole = [np.concatenate(c) for c in zip(*held)]
            ends = np.flatnonzero(whole[0][1:] != whole[0][:-1])
            if len(ends):
                cut = int(ends[-1]) + 1
                yield [c[:cut] for c in whole]
                held, size, most = [[c[cut:].copy() for c in whole]], size - cut, rows
            else:
                held, most = [whole], 2 * size
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


class Blocks:
    """Persisted blocks of a table; ``release`` frees them.

    ``draws``: a mixing unit's draws (draws x variables) by its id, or a table (mixing id, draw_id, eta_0, ...) of
    any size, which is dealt out beside the rows.  ``rows``: about how many the table has.  ``samples``: observations
    are dealt by their buckets, and blocks hold how often each sample has each of them.
    """

    def __init__(self, df: DataFrame, design: Design, obs_id: str, alt_id: str, choice: str | None,
                 weight: str | Column | None = None, mix_id: str | None = None, n_draws: int = 0, mixing: int = 0,
                 seed: int | None = None, draws: dict | DataFrame | None = None, block_rows: int = BLOCK_ROWS, rows: int = 0,
                 samples: BucketDraws | None = None):
        w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
        columns = [
            (samples.bucket(obs_id) if samples else F.col(f"`{mix_id or obs_id}`")).alias("g"), F.col(f"`{obs_id}`").alias("o"), F.col(f"`{alt_id}`").alias("a"),
            (F.col(f"`{choice}`").cast("double") if choice else F.lit(0.0)).alias("y"), w.cast("double").alias("w"),
            *design.columns(alt_id),
        ]
        alternatives = np.array(design.alternatives)
        seed = 0 if seed is None and draws is None else seed
        terms = len(design.terms)
        table, order, given = df.select(*columns), ["g", "o", "a"], isinstance(draws, DataFrame)
        if given:
            table, order, draws = _beside(table, draws, mix_id, mixing), ["g", "k", "o", "a"], None

        sampled = df.sparkSession.sparkContext.broadcast(samples) if samples else None

        def block_of(found: list[np.ndarray]) -> Block | None:
            made = None
            if given:
                first = found[-1] == 0
                made = found[0][first], list(found[-2][first])
                found = [c[~first] for c in found[:-2]]
                if not len(found[0]):
                    return None
            g, obs, alt, y, weights, *x = found
            starts = np.append(True, (obs[1:] != obs[:-1]) | (g[1:] != g[:-1]))
            at = np.minimum(np.searchsorted(alternatives, alt), len(alternatives) - 1)
            block = Block(np.column_stack(x) if terms else np.zeros((len(obs), 0)), np.cumsum(starts) - 1, at, y.astype(float), weights.astype(float))
            if sampled:
                block.reps = sampled.value.times(g, block.obs, block.alt, block.y)
            if mix_id:
                units, block.mix = np.unique(g, return_inverse=True)
                if given:
                    block.draws = _draws_of(units, *made, mixing)
                else:
                    block.draws = unit_draws(units, n_draws, mixing, seed) if draws is None else np.stack([draws[u] for u in units.tolist()])
            return block

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            alike: Block | None = None
            for found in _whole_groups(batches, block_rows):
                block = block_of(found)
                if block is None:
                    continue
                n = block.n_obs
                if not mix_id and not sampled:
                    block = squeezed(block)
                if block.times is not None:
                    alike = block if alike is None else squeezed(joined([alike, block]))
                    if len(alike.obs) < block_rows:
                        yield _record(None, n)
                        continue
                    block, alike = alike, None
                yield _record(block, n)
            if alike is not None:
                yield _record(alike, 0)

        self.sampled = sampled
        self.frame = (
            dealt(table, rows, "g").sortWithinPartitions(*order)
            .mapInArrow(pack, _STORED).persist(StorageLevel.MEMORY_AND_DISK)
        )
        self._size: tuple[int, int, int] | None = None
        self._block: Block | None = None

    def _settled(self) -> tuple[int, int, int]:
        """Bytes, rows times draws, and observations of the table; small blocks are gathered."""
        if self._size is None:
            row = self.frame.agg(F.sum("bytes"), F.sum("cells"), F.sum("n")).first()
            self._size = tuple(int(x or 0) for x in row)
            if not self.sampled and self._size[0] <= DRIVER_BYTES and self._size[1] <= DRIVER_CELLS:
                self._block = self._gathered()
        return self._size

    def _gathered(self) -> Block | None:
        blocks = [loaded(r["block"]) for r in self.frame.where("bytes > 0").collect()]
        if not blocks:
            return None
        return joined(blocks) if blocks[0].mix is not None else squeezed(joined(blocks))

    @property
    def n_obs(self) -> int:
        """Of the table; those of a mixing unit are counted in it."""
        return self._settled()[2]

    def evaluate(self, family: Family, theta: np.ndarray, second: bool = False) -> Totals:
        return self.evaluate_all(family, [theta], [second])[0]

    def evaluate_all(self, family: Family, thetas: Sequence[np.ndarray], second: Sequence[bool], reps: Sequence[int] | None = None) -> list[Totals]:
        """The totals at several parameter vectors in one job; each under the weights of a sample, if ``reps`` names them."""
        thetas = [np.asarray(t, float) for t in thetas]
        self._settled()
        if self._block is not None:
            return _totals(family, thetas, second, reps, self._block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column(0):
                    one = _totals(family, thetas, second, reps, loaded(raw.as_buffer()))
                    total = one if total is None else [a + b for a, b in zip(total, one)]
            if total is not None:
                yield pa.RecordBatch.from_pydict({"total": [pickle.dumps(total)]})

        with _small_batches(self.frame.sparkSession):
            rows = self.frame.where("bytes > 0").select("block").mapInArrow(run, "total binary").collect()
        total = None
        for row in rows:
            one = pickle.loads(row["total"])
            total = one if total is None else [a + b for a, b in zip(total, one)]
        if total is None:
            zero = np.zeros((family.layout.size, family.layout.size))
            return [Totals(0.0, np.zeros(len(t)), zero, zero) for t in thetas]
        return total

    def local(self, most_bytes: int) -> Block | None:
        """All blocks as one on the driver, if they are small enough by their stored size."""
        if self._settled()[0] > most_bytes:
            return None
        return self._block or self._gathered()

    def release(self) -> None:
        self.frame.unpersist()
        if self.sampled:
            self.sampled.destroy()


_STORED = "block binary, bytes long, cells long, n long"


def _record(block: Block | None, n: int) -> pa.RecordBatch:
    raw = None if block is None else dumped(block)
    cells = 0 if block is None else len(block.obs) * (1 if block.draws is None else block.draws.shape[1])
    return pa.RecordBatch.from_arrays(
        [pa.array([raw], pa.binary()), pa.array([len(raw or b"")], pa.int64()), pa.array([cells], pa.int64()), pa.array([n], pa.int64())],
        names=["block", "bytes", "cells", "n"],
    )


def _totals(family: Family, thetas, second, reps, block: Block) -> list[Totals]:
    if reps is None:
        return [family.evaluate(t, block, s) for t, s in zip(thetas, second)]
    out = []
    for t, s, r in zip(thetas, second, reps):
        out.append(family.evaluate(t, replace(block, w=block.w * block.reps[r][block.obs]), s))
    return out


@contextmanager
def _small_batches(spark):
    """Blocks go to Python workers a few at a time; Spark's own 64 MB lie in a worker more than once."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _beside(table: DataFrame, draws: DataFrame, mix_id: str, mixing: int) -> DataFrame:
    """The rows and, before those of each unit (k = 0), a row with its draws in order."""
    etas = [f"eta_{m}" for m in range(mixing)]
    own = draws.groupBy(F.col(f"`{mix_id}`").alias("g")).agg(F.sort_array(F.collect_list(F.struct("draw_id", *etas))).alias("d"))
    flat = F.flatten(F.transform("d", lambda x: F.array(*(x[e].cast("double") for e in etas))))
    kinds = {f.name: f.dataType for f in table.schema}
    blank = [F.lit(0).cast(kinds[c]).alias(c) for c in table.columns if c != "g"]
    first = own.select(F.col("g").cast(kinds["g"]).alias("g"), *blank, flat.alias("d"), F.lit(0).alias("k"))
    return first.unionByName(table.withColumns({"d": F.lit(None).cast("array<double>"), "k": F.lit(1)}))


def _draws_of(units: np.ndarray, ids: np.ndarray, values: list, mixing: int) -> np.ndarray:
    """Units x draws x variables, of a block's units alone."""
    at = np.minimum(np.searchsorted(ids, units), max(len(ids) - 1, 0))
    if not len(ids) or not (ids[at] == units).all():
        raise ValueError("a mixing unit has no draws")
    return np.stack([values[i] for i in at]).reshape(len(units), -1, mixing)
