"""Token counts by heap-and-linked-list byte-pair merging.

A text is split at added special strings, then into words by the vocabulary's
pattern.  The symbols of a word start as its bytes in a doubly linked list; a heap
holds the adjacent pairs by rank and the lowest is popped and merged until none
is left.  A word's count is its initial symbols minus its merges; no identifier is
produced.  Counts of words seen before come from a bounded memory.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The split that byte-level vocabularies of this kind are built with.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a worker remembers; when full it starts anew.
REMEMBERED = 1 << 20


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merge ranks and special strings of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("a byte-level BPE file without prefix space is needed")
        if spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("normalizers, dropout and whole-word matches are not supported")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: (rank, "".join(pair)) for rank, pair in enumerate(pairs)}
        self.ids = model["vocab"]
        specials = spec.get("added_tokens") or []
        if any(t.get(k) for t in specials for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens with options are not supported")
        self.specials = {t["content"]: t["id"] for t in specials}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if specials else None
        self.split = regex.compile(WORDS)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merges(symbols: list[str], ranks: dict) -> int:
    """How many merges byte-pair encoding makes in a word."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = []
    for i in range(n - 1):
        if found := ranks.get((symbols[i], symbols[i + 1])):
            heap.append((found[0], i, i + 1, found[1]))
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, j, whole = heapq.heappop(heap)
        # stale: one side was merged away, or has grown since the pair was noted
        if symbols[i] is None or after[i] != j or symbols[i] + symbols[j] != whole:
            continue
        done += 1
        symbols[i], symbols[j] = whole, None
        k = after[j]
        after[i] = k
        if k >= 0:
            before[k] = i
            if found := ranks.get((whole, symbols[k])):
                heapq.heappush(heap, (found[0], i, k, found[1]))
        h = before[i]
        if h >= 0 and (found := ranks.get((symbols[h], whole))):
            heapq.heappush(heap, (found[0], h, i, found[1]))
    return done


def word_counter(vocab: Vocabulary) -> Callable[[str], int]:
    letters, ranks = byte_letters(), vocab.ranks

    def count(word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        return len(data) - merges([letters[b] for b in data], ranks)

    return count


class _Remembered(dict):
    def __init__(self, make: Callable[[str], int]):
        self.make = make

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.make(word)
        return found


def text_counter(vocab: Vocabulary) -> Callable[[str], int]:
    counts, find, cut = _Remembered(word_counter(vocab)), vocab.split.findall, vocab.cut

    def plain(text: str) -> int:
        return sum(map(counts.__getitem__, find(text)))

    def count(text: str) -> int:
        if cut is None or not cut.search(text):
            return plain(text)
        return sum(map(plain, cut.split(text))) + len(cut.findall(text))

    return count


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[str], int]:
    return text_counter(vocabulary(path))


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text; null counts as empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for batch in batches:
            yield pd.Series([counter(x) if isinstance(x, str) else 0 for x in batch], dtype="int64")

    return count(text)


def with_token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; columns of these names are replaced.

    Narrow: no row moves.  A null text has 0 bytes and 0 tokens.  Repeated rows are
    counted each; an empty table gives an empty table.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {"n_bytes": F.octet_length(source).cast("long"), "n_tokens": token_count(F.col(text), path)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
