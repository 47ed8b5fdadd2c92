"""Near-duplicate groups: shingle sets of a given Jaccard similarity, met by SimHash and by prefixes.

Fingerprints within 3 bits meet through the multi-index tables of ``simhash``.  They hold
the closest copies only, so that an exact route meets the rest: sets of similarity s share
at least s of the shingles of either, hence, under one order of all shingles, one of the
first (1 - s) * size + 1.  Whatever meets is compared by a bit sketch that rules pairs out
but never one in, and then set by set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelake.llm import simhash
from choicelake.llm.common import connected_components, discard, free_name, hash_sample, local_table, release, stored
from choicelake.llm.simhash import fingerprint, shingle_hashes, word_bytes

#: About so many texts tell which shingles are common, and at most so many of those are kept.
SAMPLE_TEXTS = 1 << 14
COMMON = 1 << 16
#: Sample texts from which a shingle is hot: its postings are met by a broadcast of its leader.
HOT_TEXTS = 16
#: Bits of a sketch; a multiple of 64.
SKETCH = 1024
#: Words of 64 bits in the filter of nodes whose sets are wanted, at most.
FILTER_WORDS = 1 << 21
_REMEMBERED = 1 << 16


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones before common ones, that meet every similar set's.

    Any order of all shingles will do; this one keeps common shingles out.
    """
    if not len(shingles):
        return shingles
    count = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        count = np.where(common[at] == shingles, counts[at], 0)
    shared = math.ceil(similarity * len(shingles) - 1e-9)
    return shingles[np.argsort(count, kind="stable")[: len(shingles) - shared + 1]]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of the shingles falls on it.

    Two sketches differ in at most as many bits as their sets differ in shingles.
    """
    odd = np.bincount((shingles % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _sample_counts(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in two or more of a sample's texts, ascending, with their counts there."""
    sample = hash_sample(docs.select("text"), ["text"], SAMPLE_TEXTS).distinct()

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for batch in batches:
            yield pd.Series([np.unique(shingle_hashes(word_bytes(x), k)).view(np.int64) for x in batch])

    counts = (
        sample.select(F.explode(sets(F.col("text"))).alias("shingle"))
        .groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
        .orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    )
    shingles = counts["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], counts["n"].to_numpy(np.int64)[order]


def _node(words: list[bytes]) -> int:
    found = xxhash.xxh3_64_intdigest(b" ".join(words))
    return found - (1 << 64) if found >> 63 else found


def _described(docs: DataFrame, k: int, similarity: float, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Per row: doc_id, exact (hash of the text), node (of the words), size, fingerprint, sketch and prefix.

    A task that met the same words shortly before leaves the last three null.
    """
    made = "node long, size int, fp long, sketch array<long>, prefix array<long>"

    @F.pandas_udf(made)
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        seen: dict[int, int] = {}
        for batch in batches:
            rows = []
            for text in batch:
                words = word_bytes(text)
                node = _node(words)
                if node in seen:
                    rows.append((node, seen[node], None, None, None))
                    continue
                hashes = shingle_hashes(words, k)
                shingles = np.unique(hashes)
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                seen[node] = len(shingles)
                fp = np.uint64(fingerprint(hashes)).astype(np.int64)
                rows.append((
                    node, len(shingles), fp, sketch(shingles).view(np.int64),
                    prefix(shingles, common, counts, similarity).view(np.int64),
                ))
            out = pd.DataFrame(rows, columns=["node", "size", "fp", "sketch", "prefix"])
            yield out.assign(fp=out["fp"].astype("Int64"))

    return docs.select("doc_id", F.xxhash64("text").alias("exact"), describe(F.col("text")).alias("d")).select(
        "doc_id", "exact", "d.*"
    )


def _met(postings: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, node, size, place, leader) of every node under a key but its leader.

    A key's leader is the node for which it is the rarest: of a group of edited copies the least edited.
    Postings of hot keys stay where they are: a minimum per key, of which there are at most
    ``COMMON``, is broadcast to them.  All others are sorted by key.
    """
    own = postings.join(F.broadcast(hot), "key", "left_semi")
    leaders = own.groupBy("key").agg(F.min(F.struct("place", "node")).alias("first")).select("key", F.col("first.node").alias("leader"))
    rest = postings.join(F.broadcast(hot), "key", "left_anti").withColumn(
        "leader", F.first("node").over(Window.partitionBy("key").orderBy("place", "node"))
    )
    both = rest.unionByName(own.join(F.broadcast(leaders), "key"))
    return both.where("node != leader").distinct()


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _differing(one: str, two: str) -> Column:
    """Bits in which two sketches differ."""
    total = F.bit_count(F.col(one)[0].bitwiseXOR(F.col(two)[0]))
    for i in range(1, SKETCH // 64):
        total = total + F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i]))
    return total


def _most_differing(size_a: Column, size_b: Column, similarity: float) -> Column:
    """Shingles by which two sets of that similarity differ at most."""
    return (size_a + size_b) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of (a, b) those that their sizes and sketches do not rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    most = _most_differing(F.col("na"), F.col("nb"), similarity)
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where((F.abs(F.col("na") - F.col("nb")) <= most) & (_differing("sa", "sb") <= most)).select("a", "b")
    )


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter with two bits a node: words of 64 bits, a power of two of them, ``FILTER_WORDS`` at most."""
    words = 1 << 10
    wanted = nodes.count() // 4
    while words < min(wanted, FILTER_WORDS):
        words *= 2
    bits = F.array(*(F.shiftrightunsigned("node", at).bitwiseAND(F.lit(64 * words - 1)) for at in (0, 32)))
    rows = (
        nodes.select(F.explode(bits).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(words, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) for all of ``wanted`` and perhaps more; no text moves.

    A bounded filter of the wanted nodes goes to the texts.  Where it cannot tell them apart,
    as more are wanted than it has room for, more sets are made than are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        words_of, seen = held.value, set()
        last = 64 * len(words_of) - 1
        has = lambda bit: int(words_of[bit >> 6]) >> (bit & 63) & 1
        rows, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                words = word_bytes(text)
                node = _node(words)
                bits = node & (2**64 - 1)
                if node in seen or not (has(bits & last) and has(bits >> 32 & last)):
                    continue
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                seen.add(node)
                rows.append((node, np.unique(shingle_hashes(words, k)).view(np.int64)))
                size += len(words)
                if size > 1 << 20:
                    yield pd.DataFrame(rows, columns=["node", "shingles"])
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=["node", "shingles"])

    return stored(docs.select("text").mapInPandas(make, "node long, shingles array<long>"))


def _verified(pairs: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Of (a, b) those whose shingle sets have at least that Jaccard similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    made = _sets_of(docs, wanted, k)
    # some tasks may have met the same words; stored, so that the joins can split a hub's pairs
    sets = stored(made.dropDuplicates(["node"]))
    discard(made)
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .withColumn("common", F.size(F.array_intersect("sa", "sb")))
    )
    found = stored(
        both.where(F.col("common") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")
    )
    discard(sets)
    return found


def _still_apart(met: DataFrame, parts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs under a key, its leader aside, that are not in one group yet and may be similar.

    At least one of the two is not in the group of the key's leader.  A pair counts where
    its first common shingle may be: the places of both leave room for all that they must share.
    """
    label = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part"))
    several = (
        met.join(label("node"), "node", "left").join(label("leader"), "leader", "left")
        .select("key", "node", "size", "place", F.coalesce("node_part", "node").alias("part"), F.coalesce("leader_part", "leader").alias("lead"))
        .withColumn("apart", F.col("part") != F.col("lead")).drop("lead")
    )
    split = stored(several)
    keys = stored(split.groupBy("key").agg(F.count("*").alias("n"), F.max("apart").alias("any")).where("any and n > 1").select("key"))
    sides = stored(split.join(keys, "key", "left_semi").join(nodes.select("node", "sketch"), "node"))
    q, t = sides.where("apart").alias("q"), sides.alias("t")
    both = F.col("q.size") + F.col("t.size")
    shared = F.least(F.col("q.size") - F.col("q.place"), F.col("t.size") - F.col("t.place"))
    found = stored(_pairs(
        q.join(t, "key")
        .where("q.part != t.part and (q.node > t.node or not t.apart)")
        .where(shared >= both * F.lit(similarity / (1 + similarity)) - 1e-6)
        .where(_differing("q.sketch", "t.sketch") <= _most_differing(F.col("q.size"), F.col("t.size"), similarity))
        .select(F.col("q.node").alias("a"), F.col("t.node").alias("b"))
    ))
    discard(split, keys, sides)
    return found


def _groups(docs: DataFrame, k: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, exact, node), (node, group)."""
    spark = docs.sparkSession
    common, counts = _sample_counts(docs, k)
    described = stored(_described(docs, k, similarity, common, counts))
    rows = stored(described.select("doc_id", "exact", "node"))
    hot = local_table(spark, key=common[counts >= HOT_TEXTS].view(np.int64))
    met = stored(_met(described.where("prefix is not null").select("node", "size", F.posexplode("prefix").alias("place", "key")), hot))
    nodes = stored(described.where("sketch is not null").select("node", "size", "fp", "sketch").dropDuplicates(["node"]))
    discard(described)

    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    prints = stored(first)
    near = simhash.links(prints.select("fp"))
    name = lambda x: prints.select(F.col("fp").alias(f"{x}p"), F.col("first").alias(x))
    by_print = (
        near.select(F.col("a").alias("ap"), F.col("b").alias("bp")).join(name("a"), "ap").join(name("b"), "bp").select("a", "b")
        .unionAll(nodes.join(prints, "fp").select(F.col("node").alias("a"), F.col("first").alias("b")))
    )
    by_leader = met.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    pairs = stored(_possible(_pairs(by_print.unionAll(by_leader)), nodes, similarity))
    edges = _verified(pairs, docs, k, similarity)
    parts = stored(connected_components(edges))
    discard(pairs)

    rest = _still_apart(met, parts, nodes, similarity)
    if not rest.isEmpty():
        parts = stored(connected_components(edges.unionAll(_verified(rest, docs, k, similarity))))
    groups = stored(
        nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    )
    discard(met, nodes, prints, rest, edges, parts)
    return rows, groups


def near_duplicate_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, exact, group) per row of ``docs`` (doc_id, text); ``exact`` is a hash of the text.

    Texts with the same words are one node; null and empty texts have none and are one
    group.  Texts of fewer than ``k`` words have their whole sequence as the one shingle.
    All meet their keys' leaders first.  Two others under a key are compared only where
    their groups still differ, and by sketches where they lie, so that what is verified grows
    with the copies, not with their square, and no pair that could join two groups is left out.
    """
    rows, groups = _groups(docs, k, similarity)
    return rows.join(groups, "node").select("doc_id", "exact", "group")


def deduplicated(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, unchanged: the one with the least doc_id.

    Rows without an id come last.  Null and empty texts are one group.  Of rows equal in
    id and text one stays.  Other columns, of any name, are kept as they are.
    """
    rows, groups = _groups(docs, k, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "exact")
    firsts = rows.groupBy("node").agg(F.min(order).alias("first")).join(groups, "node")
    exact, kept_id, kept_exact = (free_name(docs, x) for x in ("exact", "kept_id", "kept_exact"))
    kept = stored(
        firsts.groupBy("group").agg(F.min("first").alias("kept"))
        .select(F.col("kept.doc_id").alias(kept_id), F.col("kept.exact").alias(kept_exact))
    )
    here = lambda one, two: (F.col(one) == F.col(kept_exact)) & F.col(two).eqNullSafe(F.col(kept_id))
    many = stored(
        rows.join(kept, here("exact", "doc_id"), "left_semi").groupBy("doc_id", "exact").agg(F.count("*").alias("n"))
        .where("n > 1").select(F.col("doc_id").alias(kept_id), F.col("exact").alias(kept_exact))
    )
    discard(rows, groups)
    found = docs.withColumn(exact, F.xxhash64("text")).join(kept, here(exact, "doc_id"), "left_semi")
    if not many.isEmpty():  # the same id and text in several rows
        again = found.join(many, here(exact, "doc_id"), "left_semi").dropDuplicates([exact, "doc_id"])
        found = found.join(many, here(exact, "doc_id"), "left_anti").unionByName(again)
    return found.drop(exact)
