"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long bit strings, the signs of random projections.  A query
descends each tree to its longest matching prefix and then all trees go up together, one
bit at a time, which widens every tree's slice of candidates.  It goes up until a vector
as near as the query's present k-th best would have been met, at the prefix length
reached, with the probability asked for.  So the candidates follow from how near
the neighbours are: a few where they are close, most of the rows where nothing is near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 32
BITS = 32
SURE = 0.95
K_NEAREST = 20
#: Rows of the index and queries that meet in one task.
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 8_192
#: Candidates beyond this share of a block are scored as one dense product.
DENSE = 0.1
_SPARE = 8


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, TREES * BITS)).astype(np.float32)


def bit_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, trees) of 32-bit strings, first projection highest."""
    bits = np.packbits(vectors.astype(np.float32) @ planes > 0, axis=1)
    return bits.view(">u4").astype(np.uint32)


def _agree(cosine: float) -> float:
    """Chance that one random plane leaves two vectors on the same side."""
    return 1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi


class Forest:
    """The sorted arrays of one block of rows."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray):
        self.vectors, self.planes = vectors, planes
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()))
        strings = bit_strings(vectors, planes)
        rows = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.asfortranarray(np.take_along_axis(strings, rows, axis=0))
        self.trees = [np.ascontiguousarray(rows[:, t]) for t in range(TREES)]

    def _slices(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the rows that share the first so many bits: (prefix lengths, trees, queries) twice."""
        low = np.empty((BITS + 1, TREES, len(strings)), np.int64)
        high = np.empty_like(low)
        for length in range(BITS + 1):
            drop = np.uint64(BITS - length)
            first = (strings.astype(np.uint64) >> drop) << drop
            last = first + (np.uint64(1) << drop) - np.uint64(1)
            for t in range(TREES):
                low[length, t] = np.searchsorted(self.sorted[:, t], first[:, t].astype(np.uint32), "left")
                high[length, t] = np.searchsorted(self.sorted[:, t], last[:, t].astype(np.uint32), "right")
        return low, high

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, rows of the index) of the ``k`` best candidates or more, a spare few among them."""
        for a in range(0, len(queries), 512):
            part = queries[a : a + 512]
            low, high = self._slices(bit_strings(part, self.planes))
            for i, query in enumerate(part):
                yield a + i, self._climb(query, low[:, :, i], high[:, :, i], k)

    def _climb(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        n, enough = len(self.vectors), k + 1
        met, scores, dense = np.zeros(n, bool), None, None
        length_of = float(np.sqrt(query @ query)) * self.longest
        # above the longest prefix that enough rows share there is nothing to stop at
        sizes = (high - low).sum(1)
        start = int(np.flatnonzero(sizes >= min(enough, n))[-1])
        for length in range(start, -1, -1):
            for x, y, rows in zip(low[length], high[length], self.trees):
                met[rows[x:y]] = True
            if not length:
                met[:] = True
            rows = np.flatnonzero(met)
            if len(rows) < min(enough, n):
                continue
            if dense is None and len(rows) > DENSE * n:
                dense = self.vectors @ query
            scores = dense[rows] if dense is not None else self.vectors[rows] @ query
            if len(rows) > enough:
                kth = np.partition(scores, len(rows) - enough)[len(rows) - enough]
                # the longest row bounds how wide an angle such a product can stand for
                if 1 - (1 - _agree(kth / max(length_of, 1e-300)) ** length) ** TREES >= SURE:
                    break
        keep = enough + _SPARE
        return rows if len(rows) <= keep else rows[np.argpartition(-scores, keep - 1)[:keep]]


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero, and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K_NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding) rows of both.

    The index is cut into blocks of bounded size by a hash of the row, each a forest of its
    own, and queries meet all of them in blocks.  In a block equal vectors are indexed once,
    with the k + 1 least of their ids: no more of them can be among the k nearest, so
    a vector that a third of all rows share is spread evenly and costs little.  Vectors of
    other lengths than a query's are not candidates.  Scores are the correctly rounded
    sums of the products in double precision; ties go to the smaller vec_id.  A repeated vec_id counts
    once, with its nearest vector (as a query: the least).  Unusable vectors and null ids
    take no part; empty tables give none.
    """
    plain = lambda df: usable(
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ).where("vec_id is not null")
    rows, asked = plain(vectors), plain(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks, chunks = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-asked.count() // BLOCK_QUERIES))
    index = rows.select(
        "*", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    )
    asked = asked.select(
        "*", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})]
        for size in set(left["embedding"].map(len)) & set(right["embedding"].map(len)):
            same = lambda f: f[f["embedding"].map(len) == size]  # noqa: B023, E731
            out.append(_met(same(left), same(right), size, k))
        return pd.concat(out[1:] or out)

    found = index.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(
        meet, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _met(left: pd.DataFrame, right: pd.DataFrame, size: int, k: int) -> pd.DataFrame:
    ids = left["vec_id"].to_numpy(np.int64)
    distinct, of = np.unique(np.array(left["embedding"].tolist(), np.float64).reshape(-1, size), axis=0, return_inverse=True)
    # the ids of each set of equal vectors, least first
    order = np.lexsort((ids, of.ravel()))
    of, ids = of.ravel()[order], ids[order]
    once = np.append(True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1]))
    of, ids = of[once], ids[once]
    starts = np.searchsorted(of, np.arange(len(distinct) + 1)).tolist()
    query_ids = right["vec_id"].to_numpy(np.int64).tolist()
    queries = np.array(right["embedding"].tolist(), np.float64).reshape(-1, size)
    out = []
    for q, found in Forest(distinct, projections(size)).search(queries, k):
        best = []
        for v in found.tolist():
            score = math.fsum((queries[q] * distinct[v]).tolist())
            best += [(-score, i) for i in ids[starts[v] : min(starts[v + 1], starts[v] + k + 1)].tolist() if i != query_ids[q]]
        out += [(query_ids[q], i, -minus) for minus, i in sorted(best)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
