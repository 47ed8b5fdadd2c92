"""Benchmark decontamination by spaced seeds.

A mask reads some of the words in a window and ignores the others, so a substituted
word under an ignored position leaves the hash as it was.  Windows of the corpus
whose hash is among the benchmark's are hits; around each, the words along the same
diagonal are compared and the best-scoring stretch decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelake.llm import kernel as K
from choicelake.llm.common import free_name, stored

MASKS = ("11101001101", "10110010111", "11010110011")
#: Words that must agree in a stretch; for shorter items, this share of the item.
LEAST_WORDS = 13
SIMILARITY = 0.8
#: Items of fewer words have seeds of their own besides the masks': any three words in a row.  As at most a
#: fifth of a stretch may differ, one of those is always left as it was.
SHORT_ITEM = 30
#: Characters of the benchmark that are broadcast at once; more take further passes, one job each.
CHUNK = 4_000_000
#: Places of a seed in a text times those in an item from which their distances are counted by a transform.
_MANY = 1 << 20
_BLOOM_BITS = 22
RESULT = "array<struct<item_id:long,start_word:long,item_start:long,n_words:long,n_matched:long>>"


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters and digits, and the n + 1 bounds of the texts."""
    points, bounds = K.code_points(texts)
    starts, ends, text_of = K.runs(K.alphanumerics()[points].astype(np.int8), bounds)
    cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
    return K.span_hashes(K.lowered()[points], starts, ends), cuts


def seeds(hashes: np.ndarray, cuts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position) of every window that lies within one text."""
    span = len(mask)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, span, np.uint64)
    for at, kept in enumerate(mask):
        if kept == "1":
            total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + n]
    text_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    at = np.flatnonzero(text_of[:n] == text_of[span - 1 :])
    return K.finish(total[at]), at


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Bounds of the stretch with the highest score: 1 per agreeing word, -2 per other."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    return int(total[: end + 1].argmin()) if end else 0, end


def distances(there: np.ndarray, here: np.ndarray) -> np.ndarray:
    """All differences of a place there and one here, each once."""
    if len(there) * len(here) <= _MANY:
        return np.unique(there[:, None] - here[None, :])
    low, high = int(there.min()) - int(here.max()), int(there.max()) - int(here.min())
    size = 1 << (2 * (high - low + 1)).bit_length()
    a, b = np.zeros(size), np.zeros(size)
    a[there - there.min()] = 1
    b[int(here.max()) - here] = 1
    return low + np.flatnonzero(np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), size)[: high - low + 1] > 0.5)


@dataclass
class Index:
    """A bounded part of the benchmark."""

    ids: np.ndarray
    hashes: np.ndarray
    cuts: np.ndarray
    seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]  # mask -> sorted seeds, items, places; short items by ones

    @staticmethod
    def of(ids: list[int], texts: list[str | None], least_item: int = 1) -> Index:
        hashes, cuts = words([t if isinstance(t, str) else "" for t in texts])
        sizes = np.diff(cuts)
        longest = max(map(len, MASKS))
        found = {}
        for mask in [*MASKS, *("1" * n for n in range(1, longest))]:
            seed, at = seeds(hashes, cuts, mask)
            item = np.searchsorted(cuts, at, "right") - 1
            own = sizes[item] >= longest if mask in MASKS else sizes[item] == len(mask)
            if mask == "111":
                own |= (sizes[item] >= longest) & (sizes[item] < SHORT_ITEM)
            own &= sizes[item] >= least_item
            seed, at, item = seed[own], at[own], item[own]
            if len(seed):
                order = np.argsort(seed, kind="stable")
                found[mask] = seed[order], item[order], (at - cuts[item])[order]
        return Index(np.array(ids, np.int64), hashes, cuts, found)

    def overlaps(self, texts: list[str]) -> list[list[tuple]]:
        """Per text: (item_id, start_word, item_start, n_words, n_matched) of each overlap."""
        out: list[list[tuple]] = [[] for _ in texts]
        hashes, cuts = words(texts)
        diagonals: set[tuple[int, int, int]] = set()
        for mask, (known, items, places) in self.seeds.items():
            seed, at = seeds(hashes, cuts, mask)
            bloom = np.zeros(1 << _BLOOM_BITS, bool)
            bloom[known >> np.uint64(64 - _BLOOM_BITS)] = True
            near = np.flatnonzero(bloom[seed >> np.uint64(64 - _BLOOM_BITS)])
            seed, at = seed[near], at[near]
            low, high = np.searchsorted(known, seed, "left"), np.searchsorted(known, seed, "right")
            hit = high > low
            at, low, high = at[hit], low[hit], high[hit]
            text_of = np.searchsorted(cuts, at, "right") - 1
            # all hits of one seed in one text together
            order = np.lexsort((at, low, text_of))
            at, low, high, text_of = at[order] - cuts[text_of[order]], low[order], high[order], text_of[order]
            edges = np.flatnonzero((np.diff(text_of, prepend=-1) != 0) | (np.diff(low, prepend=-1) != 0))
            for first, last in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                there, text = at[first:last], int(text_of[first])
                span = slice(low[first], high[first])
                if len(there) == 1:
                    diagonals.update((text, i, int(there[0]) - p) for i, p in zip(items[span].tolist(), places[span].tolist()))
                    continue
                for i in np.unique(items[span]).tolist():
                    own = places[span][items[span] == i]
                    diagonals.update((text, i, d) for d in distances(there, own).tolist())
        for text, item, shift in sorted(diagonals):
            own = self.hashes[self.cuts[item] : self.cuts[item + 1]]
            there = hashes[cuts[text] : cuts[text + 1]]
            first, last = max(0, -shift), min(len(own), len(there) - shift)
            equal = own[first:last] == there[first + shift : last + shift]
            a, b = best_stretch(equal)
            matched, need = int(equal[a:b].sum()), min(LEAST_WORDS, int(np.ceil(SIMILARITY * len(own))))
            if len(own) < len(MASKS[0]):
                need = len(own)
            if matched >= need and matched >= SIMILARITY * (b - a):
                out[text].append((int(self.ids[item]), first + a + shift, first + a, b - a, matched))
        return out


def with_overlaps(docs: DataFrame, benchmark: DataFrame, column: str = "overlaps", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", least_item: int = 1) -> DataFrame:
    """``docs`` with an array of overlaps with benchmark items.

    A benchmark of up to ``CHUNK`` characters is broadcast as one and no row moves.  A larger one is
    broadcast in chunks of that size, a job each, the last chunk's memory freed before the
    next; each text's overlaps then meet by its hash.  Null and empty texts overlap nothing.  Items
    without an id or text, and those of fewer than ``least_item`` words, are left out.  Repeated
    items are reported each; an empty benchmark gives empty arrays.  A column of that name is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    nothing = F.expr(f"cast(array() as {RESULT})")
    if not size:
        return docs.withColumn(column, nothing)
    chunks, done = -(-size // CHUNK), []
    for chunk in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)) == chunk).collect()
        held = spark.sparkContext.broadcast(Index.of([r["id"] for r in rows], [r["text"] for r in rows], least_item))
        found = _overlaps_udf(held)(F.col(text))
        if chunks == 1:
            return docs.withColumn(column, found)
        each = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("hash"), found.alias("found"))
        done.append(stored(each.where(F.size("found") > 0).dropDuplicates(["hash"])))
        held.destroy()
    key = free_name(docs, "hash")
    both = reduce(DataFrame.unionAll, done).groupBy(F.col("hash").alias(key)).agg(F.flatten(F.collect_list("found")).alias("found"))
    other = free_name(docs, "found")
    return (
        docs.withColumn(key, F.xxhash64(text)).join(both.withColumnRenamed("found", other), key, "left")
        .withColumn(column, F.coalesce(other, nothing)).drop(key, *({other} - {column}))
    )


def _overlaps_udf(held):
    @F.pandas_udf(RESULT)
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "start_word", "item_start", "n_words", "n_matched")
        for batch in batches:
            out: list = []
            for _, texts in K.pieces(batch):
                out += [[dict(zip(names, x)) for x in found] for found in held.value.overlaps(texts)]
            yield pd.Series(out, dtype=object)

    # it is deterministic; this keeps an explode's filter from evaluating it a second time
    return compute.asNondeterministic()


def overlaps(docs: DataFrame, benchmark: DataFrame, least_item: int = 1) -> DataFrame:
    """A row per overlap: doc_id, item_id, start_word, item_start, n_words, n_matched.

    Null ids and repeated rows are searched as any other; other columns are not read.
    """
    found = with_overlaps(docs.select("doc_id", "text"), benchmark, least_item=least_item)
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_item: int = 1) -> DataFrame:
    """The rows of ``docs`` without any overlap, with all their columns unchanged, whatever their names."""
    column = free_name(docs, "overlaps")
    return with_overlaps(docs, benchmark, column, least_item=least_item).where(F.size(column) == 0).drop(column)
