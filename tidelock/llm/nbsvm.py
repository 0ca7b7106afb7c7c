"""Quality classifier: naive Bayes support vectors.

Features are indicators of 1- and 2-grams of lower-case words and of 1-, 2- and 3-grams of word shapes: classes of
characters with runs folded (upper A, lower a, digit 0, others themselves) and a mark on a word that repeats the one
before. Indicators are scaled by the log ratio of their counts in the two classes, and a linear model under hinge loss is
fitted by dual coordinate descent. Margins become scores by a fitted sigmoid. The model is fitted on a bounded sample of
labelled rows (MAX_LABELLED, MAX_IDS); every whole text is scored by it.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import materialize

#: Labelled rows the model is fitted on, those with the least hash of their doc_id: the documented bound.
MAX_LABELLED = 4000
#: Ids of all their features together, 4 bytes each: rows are taken in that order until there are so many.
MAX_IDS = 1 << 25
FEATURE_BITS, SMOOTHING, COST, ROUNDS, THRESHOLD = 18, 1.0, 1.0, 30, 0.7

_CLASSES = bytes(97 if c >= 0x80 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_known: dict[bytes, int] = {}


def _codes(word: bytes) -> int:
    """Hash of a word's shape above, of the word in lower case below (32 bits each)."""
    if len(_known) > 50_000:
        _known.clear()
    shape = _RUNS.sub(rb"\1", word.translate(_CLASSES))
    got = _known[word] = zlib.crc32(shape) << 32 | zlib.crc32(word.lower())
    return got


def _gram(*parts: np.ndarray) -> np.ndarray:
    """Hashes of the values that stand side by side in arrays of equal length."""
    x = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        x = (x ^ p) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def features(text: str | None) -> np.ndarray:
    """Sorted ids of the n-grams that occur in the whole text; none for a null or empty one."""
    words = (text or "").encode().split()
    known = _known.get
    codes = np.fromiter((known(w) or _codes(w) for w in words), np.uint64, len(words))
    again = np.zeros(len(codes), np.uint64)
    again[1:] = codes[1:] == codes[:-1]
    shape, word = (codes >> np.uint64(32)) << np.uint64(1) | again, codes & np.uint64(0xFFFFFFFF)
    grams = [_gram(shape), _gram(shape[:-1], shape[1:]), _gram(shape[:-2], shape[1:-1], shape[2:]), ~_gram(word), ~_gram(word[:-1], word[1:])]
    return np.unique(np.concatenate(grams) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, ids: np.ndarray) -> float:
        margin = float(self.weights[ids].sum() + self.bias) / math.sqrt(len(ids) or 1)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * margin + self.offset))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Per id, the logarithm of its share of all indicators in class 1 over that in class 0, counts smoothed."""
    counts = np.full((2, size), SMOOTHING)
    for ids, y in zip(rows, labels, strict=True):
        counts[y][ids] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], bias: np.ndarray, y: np.ndarray, limit: np.ndarray, size: int, rounds: int, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(w, b, alpha) that minimise (|w|^2 + b^2) / 2 + sum of limit * hinge loss; a row's bias feature is bias[i]. One coordinate of the dual at a time, each within 0 and its limit."""
    n, w, b = len(rows), np.zeros(size), 0.0
    norms, alpha, rng = np.array([float(v @ v) for v in values]) + bias**2, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            gradient = y[i] * (w[rows[i]] @ values[i] + b * bias[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step * bias[i]
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, b, alpha


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 42) -> Model:
    """Fit on rows of feature ids and labels 0 or 1. With no rows, or of one class only, every score is the share of label 1 (0.5 for none)."""
    n, size = len(rows), 1 << FEATURE_BITS
    if n == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), 0.0, 0.0, math.log(share / (1 - share)))
    y, ratio = np.where(labels == 1, 1.0, -1.0), log_ratios(rows, labels, size)
    # Rows are scaled to the root of their number of grams, so that long texts weigh no more than short ones.
    scale = np.array([1 / math.sqrt(len(ids) or 1) for ids in rows])
    values = [ratio[ids] * s for ids, s in zip(rows, scale, strict=True)]
    # Each class weighs as much as the other.
    limit = np.where(y > 0, cost * n / (2 * (y > 0).sum()), cost * n / (2 * (y < 0).sum()))
    w, b, _ = dual_descent(rows, values, scale, y, limit, size, rounds, seed)
    weights = w * ratio
    margins = np.array([(weights[ids].sum() + b) * s for ids, s in zip(rows, scale, strict=True)])
    slope, offset = _sigmoid(margins, labels)
    return Model(weights, b, slope, offset)


def _sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on the margins, with smoothed targets and Newton steps."""
    up, down = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins + 1e-3 * (a - 1), d.sum()])
        h = np.array([[v @ margins**2 + 1e-3, v @ margins], [v @ margins, v.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if abs(move).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED, most: int = MAX_IDS) -> Model:
    """Fit on labelled rows that are not held out; null labels and ids teach nothing. At most `limit` rows of `most` feature ids together reach the driver (and one row at least): of rows that repeat a doc_id, one."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))

    @F.arrow_udf("binary")
    def grams(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).astype(np.int32).tobytes() for t in texts], pa.binary())

    rows = rows.select("_doc", "_y", grams("_text").alias("_x")).groupBy("_doc", "_y").agg(F.max("_x").alias("_x"))
    rows = materialize(rows.withColumn("_h", F.xxhash64("_doc")), "labelled")
    total, last = 0, None
    for r in sorted(rows.select("_h", "_doc", F.octet_length("_x").alias("n")).collect()):
        total += r["n"] // 4
        if last is not None and total > most:
            break
        last = r["_h"]
    got = sorted((r["_doc"], r["_y"], bytes(r["_x"])) for r in rows.where(F.col("_h") <= (0 if last is None else last)).collect())
    return fit([np.frombuffer(x, np.int32).astype(np.int64) for _, _, x in got], np.array([y for _, y, _ in got], np.int64))


def score(text: Column, model: Model) -> Column:
    """Score of each whole text: 0 to 1. Null and empty texts are scored like any other, by the bias."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        out = pa.array([model.score(features(t.as_py())) for t in texts], pa.float64())  # one text at a time as a Python string
        pieces.give_back()
        return out

    return scores(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Rows may repeat; an empty table gives no rows."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("_text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
