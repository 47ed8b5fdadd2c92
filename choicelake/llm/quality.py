"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

Fitted by dual coordinate descent, interpolated with its mean weight, and calibrated
to a probability on labelled rows that the fit did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelake.llm import kernel as K
from choicelake.llm.common import doc_crc, hash_sample, stored

BUCKETS = 1 << 18
#: Labelled rows to fit on, at most about; chosen by a hash of doc_id.
TRAIN_ROWS = 12_288
#: Bytes of their features that reach the driver, at most about; 4 for each of a text's distinct buckets.
TRAIN_BYTES = 1 << 27
#: One row in so many of them calibrates instead of fitting.
CALIBRATE = 5
ALPHA = 1.0
BETA = 0.25
COST = 1.0
EPOCHS = 20
THRESHOLD = 0.3


def _shapes(points: np.ndarray) -> np.ndarray:
    """Letters 1 (lower) and 2 (other), digits 3, other marks 4, blanks 0."""
    letter, mark = K.letters()[points], ~K.alphanumerics()[points] & ~K.spaces()[points]
    lower = letter & (K.lowered()[points] == points)
    out = np.where(lower, 1, np.where(letter, 2, np.where(mark, 4, 3))).astype(np.int8)
    out[K.spaces()[points]] = 0
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in order: single tokens, pairs of them, and runs of shapes.

    Tokens are maximal runs of letters, of digits or of other marks, in lower case.  Shapes
    keep case and the marks themselves but not the letters, three tokens in a row.
    """
    points, bounds = K.code_points(texts)
    shapes = _shapes(points)
    starts, ends, text_of = K.runs(np.where(shapes == 2, 1, shapes), bounds)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token = K.span_hashes(K.lowered()[points], starts, ends)
    first = shapes[starts].astype(np.uint64)
    last = shapes[ends - 1].astype(np.uint64)
    size = np.minimum(ends - starts, 8).astype(np.uint64)
    marks = shapes[starts] == 4
    shape = np.where(marks, token, K.finish(first * np.uint64(64) + last * np.uint64(8) + np.minimum(size, np.uint64(3))))
    found, owner = [token], [text_of]
    for k, source in ((1, token), (1, shape), (2, shape)):
        if len(source) <= k:
            continue
        mixed, same = source[:-k], text_of[k:] == text_of[:-k]
        for step in range(1, k + 1):
            mixed = K.joined(mixed, source[step : len(source) - k + step], salt=k + 7 * (source is shape))
        found.append(mixed[same])
        owner.append(text_of[:-k][same])
    pairs = np.unique(np.concatenate(owner) * BUCKETS + (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64))
    return pairs // BUCKETS, pairs % BUCKETS


class Rows:
    """Bucket numbers of many texts in one array; the i-th row is a slice of it."""

    def __init__(self, buckets: np.ndarray, bounds: np.ndarray):
        self.buckets, self.bounds = buckets, bounds

    def __len__(self) -> int:
        return len(self.bounds)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.buckets[self.bounds[i, 0] : self.bounds[i, 1]]

    def part(self, which: np.ndarray) -> Rows:
        return Rows(self.buckets, self.bounds[which])


class Scaled:
    """The rows' log-count ratios at unit length, made as they are asked for."""

    def __init__(self, rows: Rows, ratios: np.ndarray):
        self.rows, self.ratios = rows, ratios

    def __getitem__(self, i: int) -> np.ndarray:
        value = self.ratios[self.rows[i]]
        return value / max(np.sqrt(value @ value), 1e-9)


def log_count_ratios(rows, labels: np.ndarray) -> np.ndarray:
    """Log of the classes' smoothed and normalised indicator counts."""
    counts = np.full((2, BUCKETS), ALPHA)
    for i, label in enumerate(labels):
        counts[int(label > 0), rows[i]] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows, values, labels, costs, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the L2-regularised hinge loss; the last one is the bias."""
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    norms = np.array([values[i] @ values[i] + 1.0 for i in range(len(rows))])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            row, value, y = rows[i], values[i], labels[i]
            slope = y * (value @ w[row] + w[BUCKETS]) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), costs[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[row] += step * value
                w[BUCKETS] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with smoothed targets and a light penalty."""
    up, down = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        q = p * (1 - p) + 1e-12
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    weights: np.ndarray  # per bucket
    ratios: np.ndarray  # per bucket
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[str]) -> np.ndarray:
        owner, bucket = features(texts)
        dot = np.bincount(owner, self.weights[bucket] * self.ratios[bucket], minlength=len(texts))
        norm = np.sqrt(np.bincount(owner, self.ratios[bucket] ** 2, minlength=len(texts)))
        return dot / np.maximum(norm, 1e-9) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -500, 500)))


def fit(labelled: DataFrame, most_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from (doc_id, text, label 0 or 1), all of which the caller has chosen to be seen.

    Of rows whose features take more than ``most_bytes`` together, about that many bytes are
    sampled by a hash of doc_id.  Without any row of one class the score is constant.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in K.pieces(batch["text"]):
                owner, bucket = features(texts)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                part = batch.iloc[first : first + len(texts)]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "label": part["label"].to_numpy(),
                    "row": [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])],
                })

    encoded = stored(labelled.select("doc_id", "text", "label").mapInPandas(encode, "doc_id long, label int, row binary"))
    size = encoded.agg(F.coalesce(F.sum(F.octet_length("row")), F.lit(0))).first()[0]
    if size > most_bytes:
        share = int(2**30 * (most_bytes / size))
        encoded = encoded.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(2**30)) < share)
    # as Arrow, whose one buffer of buckets is used in place
    found = encoded.toArrow().combine_chunks()
    ids, label = (found[c].to_numpy() for c in ("doc_id", "label"))
    order = np.lexsort((label, ids))
    sparse, labels = _rows(found["row"]).part(order), np.where(label[order] > 0, 1, -1)
    if not len(labels) or abs(labels.sum()) == len(labels):
        sure = 20.0 if len(labels) and labels[0] > 0 else -20.0 if len(labels) else 0.0
        return Model(np.zeros(BUCKETS), np.ones(BUCKETS), 0.0, 1.0, sure)
    held = (np.arange(len(labels)) % CALIBRATE) == 0
    if abs(labels[~held].sum()) == (~held).sum() or abs(labels[held].sum()) == held.sum():
        held[:] = False
    seen = np.flatnonzero(~held)
    rows = sparse.part(seen)
    ratios = log_count_ratios(rows, labels[seen])
    share = (labels[seen] > 0).mean()
    costs = np.where(labels[seen] > 0, COST * 0.5 / share, COST * 0.5 / (1 - share))
    w = dual_coordinate_descent(rows, Scaled(rows, ratios), labels[seen], costs)
    used = np.zeros(BUCKETS, bool)
    for i in range(len(rows)):
        used[rows[i]] = True
    weights = np.where(used, (1 - BETA) * np.abs(w[:-1][used]).mean() + BETA * w[:-1], 0.0)
    model = Model(weights, ratios, float(w[-1]), 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else seen
    scaled = Scaled(sparse, ratios)
    margins = np.array([scaled[i] @ weights[sparse[i]] + model.bias for i in check])
    model.slope, model.shift = calibrate(margins, labels[check])
    return model


def _rows(column) -> Rows:
    """A binary Arrow column as rows, without a copy."""
    parts, bounds, at = [], [], 0
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        cuts = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 4
        parts.append(np.frombuffer(data, "<i4") if data is not None else np.zeros(0, "<i4"))
        bounds.append(np.stack([cuts[:-1], cuts[1:]], axis=1).astype(np.int64) + at)
        at += len(parts[-1])
    if not parts:
        return Rows(np.zeros(0, "<i4"), np.zeros((0, 2), np.int64))
    return Rows(parts[0] if len(parts) == 1 else np.concatenate(parts), np.concatenate(bounds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of the fold to learn from.

    Labels are cut to a bounded sample before the join, so their side has a proven size
    and no text moves.  Of repeated labels of a document the least counts; null labels
    are left out.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (doc_crc() % 5 != 0))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    )
    return docs.select("doc_id", "text").join(F.broadcast(hash_sample(chosen, ["doc_id"], rows)), "doc_id")


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD,
          into: tuple[str, str] = ("quality_score", "quality_predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and 1 or 0 as it reaches the threshold; no row moves.

    Columns of the names ``into`` are replaced, all others stay.  Null and empty texts get the
    score of a text without features; texts of any length are read whole; repeated rows are
    scored each.
    """
    held, score, predicted = docs.sparkSession.sparkContext.broadcast(model), *into

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch))
            for first, texts in K.pieces(batch):
                out[first : first + len(texts)] = held.value.scores(texts)
            yield pd.Series(out)

    return docs.withColumn(score, scored(F.col(text))).withColumn(predicted, (F.col(score) >= threshold).cast("int"))
