"""Quality classifier: naive Bayes support vectors.

A text's n-grams are word unigrams and bigrams and 1- to 3-grams of word shapes (first and last
character, capitals, length, whether it repeats the word before), hashed to 2^18 indicators: an n-gram
counts once a text, whatever the length of the text.  Indicators are scaled by their log-count ratio
between the classes and each text's vector to length 1 in count, then a linear hinge-loss model is fitted by
dual coordinate descent, and its weights are mixed with the mean weight (``BLEND``).  A logistic
curve, fitted on labelled rows that the descent did not see and weighted to the classes' shares, turns the
margin into a probability.

The model is fitted on the driver from a sample of at most ``PER_CLASS`` labelled documents a class, those of
smallest hash of their id: the bound of what reaches the driver (6000 sets of n-grams, some 60 MB).
All documents are scored where they lie, whole, without a shuffle; the weights (1 MB) are broadcast.

* Nulls: a null text is an empty one and gets the score of an empty vector.  Labels that are null or
  neither 0 nor 1 are not learned from, nor documents whose labels disagree, nor rows without id.
* With labels of one class only, or none, every score is that class's smoothed share ((n1 + 1) / (n + 2)).
* Repeated rows are scored each.  An empty table gives an empty result.  Input columns are kept; one
  named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import U, mix, words

BITS = 18
PER_CLASS = 3000
EPOCHS, COST, BLEND, SMOOTH = 12, 1.0, 0.9, 1.0
SEED = 29
PIECE = 2 << 20
UPPER = np.zeros(256, np.int64)
UPPER[ord("A"):ord("Z") + 1] = 1


def char_class(byte: np.ndarray) -> np.ndarray:
    """Letters and digits by kind, other ASCII each for itself, bytes of longer characters together."""
    c = byte.astype(np.int64)
    c = np.where((byte >= 97) & (byte <= 122), 1, np.where((byte >= 65) & (byte <= 90), 2, c))
    return np.where((byte >= 48) & (byte <= 57), 3, np.where(byte >= 128, 4, c))


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of all texts: (text, n-gram), each once, by text."""
    w = words(texts)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = w.doc[1:] == w.doc[:-1]
    capitals = np.concatenate(([0], np.cumsum(UPPER[w.data])))
    capitals = capitals[w.end] - capitals[w.start]
    length = w.end - w.start
    again = np.concatenate(([False], same & (w.hash[1:] == w.hash[:-1])))
    shape = (char_class(w.data[w.start]) << 24) | (char_class(w.data[w.end - 1]) << 16)
    shape |= (np.minimum(length, 23) // 4 << 8) | (np.minimum(capitals, 2) << 2) | again
    shape = mix(shape.astype(U))
    two = same
    three = two[1:] & two[:-1]
    found = [(w.doc, w.hash, 1), (w.doc[1:][two], mix(w.hash[:-1][two]) + w.hash[1:][two], 2), (w.doc, shape, 3),
             (w.doc[1:][two], mix(shape[:-1][two]) + shape[1:][two], 4),
             (w.doc[2:][three], mix(mix(shape[:-2][three]) + shape[1:-1][three]) + shape[2:][three], 5)]
    keys = [(d.astype(np.int64) << BITS) | (mix(h + U(salt)) >> U(64 - BITS)).astype(np.int64) for d, h, salt in found]
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = max(1, b.num_rows * PIECE // max(1, b.column(column).nbytes))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


@dataclass
class Model:
    weights: np.ndarray  # of each n-gram, scaled by its ratio
    bias: float
    slope: float
    level: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        text, gram = ngrams(texts)
        count = np.bincount(text, minlength=len(texts))
        total = np.bincount(text, weights=self.weights[gram], minlength=len(texts))
        return total / np.sqrt(np.maximum(count, 1)) + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.level, -30, 30)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the squared-norm, hinge-loss model; the last weight is the bias."""
    w, alpha, order = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(SEED)
    square = [float(v @ v) + 1 for _, v in rows]
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (float(w[at] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of the weighted logistic curve, lightly smoothed, by Newton's method."""
    x = np.stack((margin, np.ones(len(margin))), axis=1)
    target = np.where(label == 1, 1 - 1 / (2 + (label == 1).sum()), 1 / (2 + (label == 0).sum()))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit_sets(sets: list[np.ndarray], label: np.ndarray, share: dict[int, int]) -> Model:
    """``share``: how many labelled documents each class has, beyond the sample."""
    size, total = 1 << BITS, sum(share.values())
    if min(share.get(0, 0), share.get(1, 0)) == 0 or len(set(label.tolist())) < 2:
        p = (share.get(1, 0) + 1) / (total + 2)
        return Model(np.zeros(size), 0.0, 0.0, float(np.log(p / (1 - p))))
    curve = np.arange(len(sets)) % 5 == 4  # the sample comes in the order of a hash
    if min((curve & (label == c)).sum() for c in (0, 1)) < 5:
        curve[:] = True
    learn = np.flatnonzero(~curve if not curve.all() else curve)
    counts = [np.full(size, SMOOTH), np.full(size, SMOOTH)]
    for i in learn:
        counts[label[i]][sets[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = [(sets[i], ratio[sets[i]] / np.sqrt(max(1, len(sets[i])))) for i in learn]
    y = np.where(label[learn] == 1, 1.0, -1.0)
    w = descend(rows, y, size, np.full(len(rows), COST))
    blended = (1 - BLEND) * np.abs(w[:-1]).mean() + BLEND * w[:-1]
    model = Model(blended * ratio, float(w[-1]), 1.0, 0.0)
    at = np.flatnonzero(curve)
    margin = np.array([model.weights[sets[i]].sum() / np.sqrt(max(1, len(sets[i]))) + model.bias for i in at])
    weight = np.array([share[c] / (label[at] == c).sum() for c in label[at]])
    model.slope, model.level = logistic(margin, label[at], weight / weight.mean())
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """``labels``: the rows to learn from (``id_col``, ``label_col``)."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__other"))
    known = known.where("__label = __other").select("__id", F.col("__label").cast("int").alias("__label"),
                                                    F.xxhash64("__id").alias("__key"))
    share = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [known.where(F.col("__label") == c).orderBy("__key", "__id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(sample[0].unionByName(sample[1]))  # 2 * per_class rows at most
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(sample, "__id")
    # of several texts of one id the smallest, so that the model does not depend on how rows are dealt
    rows = rows.groupBy("__id", "__key", "__label").agg(F.min("__text").alias("__text")).select("__key", "__label", "__text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            text, gram = ngrams(b.column(2))
            edge = np.searchsorted(text, np.arange(b.num_rows + 1))
            sets = [gram[x:y].astype(np.int32).tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())],
                                             names=["key", "label", "grams"])

    got = sorted(rows.mapInArrow(grams, "key long, label int, grams binary").collect())
    return fit_sets([np.frombuffer(r["grams"], np.int32) for r in got], np.array([r["label"] for r in got], int), share)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(*kept)
    at = kept.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            p = pa.array(shared.value.probabilities(b.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, p], names=[*b.schema.names, "score"])

    return rows.mapInArrow(scored, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
