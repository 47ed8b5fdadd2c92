"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  Each segment's value indexes a table; a query
enumerates the small Hamming ball around its own value of each segment, fetches the
table's matches and verifies the complete distance.  With s segments and radius r per
segment every pair within s * (r + 1) - 1 bits is met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelake.llm.common import connected_components, cut, stored

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Table entries under one key beyond which pairs are not compared one by one.
HOT = 1024
SEGMENT = 32
_PART = 1 << 16


def word_bytes(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if isinstance(text, str) else []


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of ``k`` words, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    found = b"".join([digest(data[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())])
    return np.frombuffer(found, ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each of 64 bits is 1 if it is set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PART):
        part = hashes[i : i + _PART].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, k: int) -> Column:
    """The 64-bit fingerprint of a text's shingles as a signed long; 0 without words."""

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(word_bytes(x), k)) for x in batch], np.uint64)
            yield pd.Series(found.view(np.int64))

    return compute(text)


def _masks(most: int, bits: int = SEGMENT) -> list[int]:
    """All bit patterns with at most ``most`` bits set."""
    found, layer = [0], [0]
    for _ in range(most):
        layer = sorted({m | 1 << b for m in layer for b in range(bits)} - set(found))
        found += layer
    return found


def _long_array(values: list[int]) -> Column:
    return F.expr(f"array({','.join(f'{v}L' for v in values)})")


def _segment(value: Column, part: int) -> Column:
    return F.shiftrightunsigned(value, SEGMENT * part).bitwiseAND(F.lit(2**SEGMENT - 1))


def _keyed(number: int, segment: Column) -> Column:
    return segment + F.lit(number << SEGMENT)


def _probes(index: DataFrame, *keep: str) -> DataFrame:
    """``keep``, key and every ``mask`` to probe with: none, and each bit that is set in the key's segment.

    Of two values that differ in one bit one has it set, and finds the other by clearing it; so half of
    the ball of radius 1 meets all its pairs.
    """
    return index.select(
        *keep, "key", F.explode(F.filter(_long_array(_masks(1)), lambda m: F.col("key").bitwiseAND(m) == m)).alias("mask")
    )


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` within ``distance`` (3 at most) bits.

    Two segments of 32 bits, radius 1.  Under a key with more than ``HOT`` entries the
    edges only span what all pairs there would connect (see ``_hot_links``), which is what
    components need; a key's work then grows with its entries, not their square.

    Spark takes what is exploded to be as small as before, so unless it is told to sort and merge
    it may gather all probes in the driver for a broadcast.
    """
    if distance > 3:
        raise ValueError("two segments with radius 1 meet pairs within 3 bits")
    index = prints.select("fp", F.explode(F.array(*(_keyed(n, _segment(F.col("fp"), n)) for n in (0, 1)))).alias("key"))
    probes = _probes(index, "fp").select("fp", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    hot = cut(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    any_hot = not hot.isEmpty()
    plain = index.join(hot, "key", "left_anti") if any_hot else index
    found = (
        probes.alias("q").join(plain.alias("t").hint("merge"), "key")
        .where((F.col("q.fp") != F.col("t.fp")) & (F.bit_count(F.col("q.fp").bitwiseXOR(F.col("t.fp"))) <= distance))
        .select(F.col("q.fp").alias("a"), F.col("t.fp").alias("b"))
    )
    return found.unionAll(_hot_links(probes.join(hot, "key", "left_semi"), distance)) if any_hot else found


def _hot_links(probes: DataFrame, distance: int) -> DataFrame:
    """Links under hot keys without comparing pairs.

    Under a key all entries share one segment; a query there differs from it in e = 0 or 1 bits.
    Spots are values of the other segment.  An entry anchors the spots within 1 bit
    and reaches those within ``distance`` - 1; a query with e = 1 reaches those within one bit less.
    All that reach an anchored spot are within ``distance`` of its anchor, and two linked
    prints always share one, so tying a spot's prints to the least of them gives the same
    components.  A spot holds a bounded number of distinct prints.
    """
    near, wide = _masks(distance - 2), _masks(distance - 1)
    number = F.shiftrightunsigned("key", SEGMENT)
    own = F.when(number == 0, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    other = F.when(number == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    entry = own == F.col("key").bitwiseAND(F.lit(2**SEGMENT - 1))
    spots = probes.select(
        "key", "fp", other.alias("other"), entry.alias("entry"),
        F.explode(F.when(entry, _long_array(wide)).otherwise(_long_array(near))).alias("mask"),
    ).select(
        "key", "fp", F.col("other").bitwiseXOR(F.col("mask")).alias("spot"),
        (F.col("entry") & (F.bit_count("mask") <= distance - 2)).alias("anchor"),
    )
    least = spots.groupBy("key", "spot").agg(F.min("fp").alias("b"), F.max("anchor").alias("anchored"), F.count("*").alias("n"))
    tied = least.where("anchored and n > 1").select("key", "spot", "b")
    return spots.join(tied.hint("merge"), ["key", "spot"]).select(F.col("fp").alias("a"), "b").where("a != b").distinct()


def with_components(docs: DataFrame, k: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least doc_id linked through any chain.

    Null and empty texts have fingerprint 0 and link like any other.  Rows with equal
    texts or ids each get their row; a null doc_id is never the least unless all are.
    """
    prints = stored(docs.select("doc_id", fingerprints(F.col("text"), k).alias("fp")))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(distinct.select("fp"), distance))
    labelled = cut(
        distinct.join(parts, F.col("fp") == F.col("node"), "left")
        .select("fp", F.coalesce("component", "fp").alias("label"), "first")
    )
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = cut(labelled.join(least, "label").select("fp", "component_id"))
    # A left join, though each fp is named: many copies make a small file, which an inner join may broadcast.
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
