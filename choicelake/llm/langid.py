"""Language identification: words first, then ever shorter character n-grams.

A word of the lexicon scores its log relative frequency in each language.  A word
that is not in it backs off: its character n-grams of the longest order of which
any is known score instead, as their mean.  A text scores the mean of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelake.llm import kernel as K
from choicelake.llm.common import doc_crc, free_name, hash_sample, stored

UNDETERMINED = "und"
#: Rows to learn from, at most about; chosen by a hash of id and text.
TRAIN_ROWS = 16_384
#: Words of the lexicon, the most frequent first, each seen at least twice.
LEXICON = 65_536
#: The model and what makes it grow with the languages; more than so many are an error.
LANGUAGES = 512
ORDERS = (5, 4, 3, 2, 1)
SLOTS = 1 << 16
#: Log10 of the frequency given to what a language was never seen to have.
PENALTY = -7.0
#: Sharpness of the score over the differences of mean log10 frequency.
SHARPNESS = 6.0


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters in lower case: code points, starts, ends, texts' indices."""
    points, bounds = K.code_points(texts)
    starts, ends, texts_of = K.runs(K.letters()[points].astype(np.int8), bounds)
    return K.lowered()[points], starts, ends, texts_of


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of the spans, padded by a blank at both ends, and their spans' indices."""
    lengths = ends - starts + 2
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    span = np.repeat(np.arange(len(starts)), lengths)
    within = np.arange(total) - np.repeat(firsts, lengths)
    padded = np.full(total, 32, np.uint64)
    inner = (within > 0) & (within < np.repeat(lengths, lengths) - 1)
    padded[inner] = points[(np.repeat(starts, lengths) + within - 1)[inner]]
    if total < order:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(total - order + 1, np.uint64)
    for k in range(order):
        h = h * np.uint64(0x100000001B3) + padded[k : total - order + 1 + k] + np.uint64(1)
    whole = span[: total - order + 1] == span[order - 1 :]
    if order == 1:
        whole &= inner[: len(whole)]
    return (K.finish(h[whole]) % np.uint64(SLOTS)).astype(np.int64), span[: total - order + 1][whole]


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray  # sorted hashes of the lexicon's words
    word_scores: np.ndarray  # words x languages
    gram_scores: dict[int, np.ndarray]  # order -> slots x languages
    gram_known: dict[int, np.ndarray]  # order -> slots

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages mean log10 scores, texts' numbers of words)."""
        points, starts, ends, texts_of = words(texts)
        n = np.bincount(texts_of, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        if not len(starts):
            return out, n
        _, first, back = np.unique(hashes := K.span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        each = self._word_rows(hashes[first], points, starts[first], ends[first])
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(texts_of, each[back, j], minlength=len(texts))
        return out / np.maximum(n, 1)[:, None], n

    def _word_rows(self, hashes, points, starts, ends) -> np.ndarray:
        rows = np.full((len(hashes), len(self.languages)), PENALTY)
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        rows[known] = self.word_scores[at[known]]
        rest = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(rest):
                break
            slots, span = grams(points, starts[rest], ends[rest], order)
            have = self.gram_known[order][slots]
            slots, span = slots[have], span[have]
            count = np.bincount(span, minlength=len(rest))
            hit = count > 0
            for j in range(len(self.languages)):
                total = np.bincount(span, self.gram_scores[order][slots, j], minlength=len(rest))
                rows[rest[hit], j] = total[hit] / count[hit]
            rest = rest[~hit]
        return rows


def _counted(sample: DataFrame) -> DataFrame:
    """(lang, kind, key, n): words (kind 0) and n-gram slots (kind = order), summed over the sample."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                for _, texts in K.pieces(group["text"]):
                    points, starts, ends, _ = words(texts)
                    if not len(starts):
                        continue
                    keys, first, n = np.unique(K.span_hashes(points, starts, ends), return_index=True, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "kind": 0, "key": keys.view(np.int64), "n": n})
                    for order in ORDERS:
                        slots, span = grams(points, starts[first], ends[first], order)
                        found = np.bincount(slots, n[span], minlength=SLOTS).astype(np.int64)
                        at = np.flatnonzero(found)
                        yield pd.DataFrame({"lang": lang, "kind": order, "key": at, "n": found[at]})

    return (
        sample.select("lang", "text")
        .mapInPandas(count, "lang string, kind int, key long, n long")
        .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    )


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, lexicon: int = LEXICON) -> Model:
    """Learn from (doc_id, text, lang) of which ``rows`` at most about are read.

    Null texts and languages are left out.  Words seen once, and those beyond the ``lexicon`` most frequent,
    are scored by their n-grams like unseen ones.  The model's size is bound by ``lexicon``,
    ``SLOTS`` and the number of languages (``LANGUAGES`` at most); only that reaches the driver.
    """
    sample = hash_sample(labelled.where("lang is not null").select("doc_id", "text", "lang"), ["doc_id", "text"], rows)
    counts = stored(_counted(sample.where("text is not null")))
    frequent = (
        counts.where("kind = 0").groupBy("key").agg(F.sum("n").alias("all"))
        .where("`all` >= 2").orderBy(F.desc("all"), "key").limit(lexicon)
    )
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).limit(LANGUAGES * (len(ORDERS) + 1) + 1).collect()
    languages = sorted({r["lang"] for r in totals})
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    total = {(languages.index(r["lang"]), r["kind"]): r["n"] for r in totals}
    # numbers for names, as there may be millions of rows
    number = (F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).cast("int") if languages else F.lit(0)
    counts = counts.withColumn("lang", number)
    of_words = counts.where("kind = 0").join(F.broadcast(frequent), "key").select("lang", "key", "n").toPandas()
    of_grams = counts.where("kind > 0").toPandas()

    def logs(found: np.ndarray, lang: int, kind: int) -> np.ndarray:
        return np.maximum(np.log10(found / total[lang, kind]), PENALTY)

    keys = np.unique(of_words["key"].to_numpy(np.int64).view(np.uint64))
    word_scores = np.full((len(keys), len(languages)), PENALTY)
    for lang, group in of_words.groupby("lang"):
        at = np.searchsorted(keys, group["key"].to_numpy(np.int64).view(np.uint64))
        word_scores[at, lang] = logs(group["n"].to_numpy(float), lang, 0)
    gram_scores = {o: np.full((SLOTS, len(languages)), PENALTY, np.float32) for o in ORDERS}
    gram_known = {o: np.zeros(SLOTS, bool) for o in ORDERS}
    for (lang, order), group in of_grams.groupby(["lang", "kind"]):
        at = group["key"].to_numpy(np.int64)
        gram_scores[order][at, lang] = logs(group["n"].to_numpy(float), lang, order)
        gram_known[order][at] = True
    return Model(languages, keys, word_scores, gram_scores, gram_known)


def identify(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with a language and its score (0 to 1); no row moves.

    Columns of the names ``into`` are replaced, all others stay.  A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing
    was learned.  Ties go to the language that sorts first.  Texts of any length are read whole;
    repeated rows are judged each.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            names, scores = np.full(len(batch), UNDETERMINED, object), np.zeros(len(batch))
            for first, texts in K.pieces(batch) if m.languages else ():
                mean, n = m.score(texts)
                sharp = np.exp(SHARPNESS * (mean - mean.max(1, keepdims=True)))
                best, seen = mean.argmax(1), n > 0
                at = first + np.flatnonzero(seen)
                names[at] = np.array(m.languages, object)[best[seen]]
                scores[at] = (sharp.max(1) / sharp.sum(1))[seen]
            yield pd.DataFrame({"lang_pred": names, "lang_score": scores})

    found = free_name(docs, "found")
    return (
        docs.withColumn(found, predict(F.col(text)))
        .withColumns({name: F.col(found)[part] for name, part in zip(into, ("lang_pred", "lang_score"))})
        .drop(found)
    )


def folded(docs: DataFrame) -> DataFrame:
    """held_out: crc32 of doc_id as text leaves 1 when divided by 3."""
    return docs.withColumn("held_out", doc_crc() % 3 == 1)
