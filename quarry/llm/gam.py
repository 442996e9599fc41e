"""Quality classifier: a generalised additive model with pairwise interactions.

Features of each whole text are computed once by Spark tasks and kept as a small table.
Labelled rows outside the held-out fold train the model: the score is a sum of one lookup
table per feature and a few per pair of features. Boosting goes round the features in
turn; each step fits a shallow tree on a feature's bins to the current gradient and adds
it, damped, to that feature's table. Then the pairs that explain most of the remaining
gradient get tables of their own in the same way. Scoring adds up table entries by bin.

Only the bounded training sample reaches the driver: at most ``sample_rows`` feature rows
(not texts), evenly from either class by a hash of the id and weighted back to the
classes' true shares. Every document is scored.

Null texts are scored as empty texts. Labels that are null are no labels; an id with
several labels counts by their majority. Without labels of both classes there is nothing
to learn: the score is the share of label 1 (0.5 without any). Repeated rows are scored
alike; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import blobs, col, staged

FEATURES = ["log_words", "word_bytes", "upper", "digits", "symbols", "exclaims", "stops", "echoes", "distinct",
            "lines", "single", "repeated_lines", "foreign", "capitals"]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER = _mask(bytes(range(65, 91)))
_LETTER = _UPPER + _mask(bytes(range(97, 123)))
_DIGIT = _mask(b"0123456789")
_SYMBOL = _mask(b"#*$%&|<>@^~_=+\\/{}[]")
_EXCLAIM = _mask(b"!?")
_STOP = _mask(b",.;:")
_FOREIGN = np.r_[np.zeros(128), np.ones(128)]


def features_of(text: bytes) -> list[float]:
    """FEATURES of a text; shares of bytes, words or lines, so they don't grow with it."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size = len(text)
    letters = max(1.0, float(count @ _LETTER))
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = list(map(len, words))
    return [float(np.log1p(n)), sum(sizes) / n, float(count @ _UPPER) / letters, float(count @ _DIGIT) / size,
            float(count @ _SYMBOL) / size, float(count @ _EXCLAIM) / size, float(count @ _STOP) / size,
            sum(map(eq, words, words[1:])) / n, len(set(words)) / n, len(lines) / n, sizes.count(1) / n,
            1 - len(set(lines)) / len(lines), float(count @ _FOREIGN) / size,
            sum(map(bytes.istitle, words)) / n]


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f) with the features of every row."""
    ship_package(docs.sparkSession)
    df = docs.select(col(id_col).alias("id"), col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([df.schema["id"], T.StructField("f", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            f = [features_of(x) for x in blobs(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], names=["id", "f"])

    return df.mapInArrow(run, schema)


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges at quantiles of the distinct values."""
    values = np.unique(x)
    mids = (values[1:] + values[:-1]) / 2
    return mids if len(mids) < bins else np.unique(np.quantile(mids, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Step per bin: the bins are cut ``leaves`` - 1 times where it gains most."""
    cg, ch = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]
    cuts = [0, len(g)]

    def best(a, b):
        k = np.arange(a + 1, b)
        if not len(k):
            return 0.0, a
        lg, lh, rg, rh = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
        gain = lg ** 2 / (lh + ridge) + rg ** 2 / (rh + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    while len(cuts) <= leaves:
        gain, at = max(best(a, b) for a, b in zip(cuts, cuts[1:], strict=False))
        if gain <= 1e-12:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


class Gam:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, bins: int = 32, coarse: int = 8):
        self.bins, self.coarse = bins, coarse
        self.intercept = 0.0
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 120, rate: float = 0.15,
            leaves: int = 3, n_pairs: int = 6, ridge: float = 5.0) -> Gam:
        share = float(np.clip((w @ y) / w.sum(), 1e-4, 1 - 1e-4))
        self.intercept = float(np.log(share / (1 - share)))
        if y.min() == y.max():
            return self
        self.edges = [bin_edges(c, self.bins) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        at = [np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)]
        f = np.full(len(y), self.intercept)

        def gradient():
            p = 1 / (1 + np.exp(-f))
            return w * (y - p), w * np.maximum(p * (1 - p), 1e-6)

        for _ in range(rounds):
            for t, b in zip(self.tables, at, strict=True):
                g, h = gradient()
                step = rate * shallow_tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), leaves, ridge)
                t += step
                f += step[b]
        # pairs: what a coarse grid still explains of the gradient
        self.pair_edges = [bin_edges(c, self.coarse) for c in x.T]
        low = [np.searchsorted(e, c) for e, c in zip(self.pair_edges, x.T, strict=True)]
        g, h = gradient()
        found = []
        for i, j in combinations(range(x.shape[1]), 2):
            m = len(self.pair_edges[j]) + 1
            cell, size = low[i] * m + low[j], (len(self.pair_edges[i]) + 1) * m
            sg, sh = np.bincount(cell, g, size), np.bincount(cell, h, size)
            found.append((float((sg ** 2 / (sh + ridge)).sum()), i, j))
        for _, i, j in sorted(found, reverse=True)[:n_pairs]:
            self.pairs.append((i, j, np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1))))
        for _ in range(rounds // 4):
            for i, j, t in self.pairs:
                g, h = gradient()
                cell = low[i] * t.shape[1] + low[j]
                sg = np.bincount(cell, g, t.size).reshape(t.shape)
                sh = np.bincount(cell, h, t.size).reshape(t.shape)
                # one cut along the first feature, then a shallow tree along the second
                rows = shallow_tree(sg.sum(1), sh.sum(1), 2, ridge)
                for value in np.unique(rows):
                    r = rows == value
                    t[r] += rate * shallow_tree(sg[r].sum(0), sh[r].sum(0), leaves, ridge)
                f = self.raw(at, low)
        return self

    def raw(self, at: list[np.ndarray], low: list[np.ndarray]) -> np.ndarray:
        f = np.full(len(at[0]), self.intercept)
        for t, b in zip(self.tables, at, strict=True):
            f += t[b]
        for i, j, t in self.pairs:
            f += t[low[i], low[j]]
        return f

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        if not self.tables:
            return np.full(len(x), 1 / (1 + np.exp(-self.intercept)))
        at = [np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)]
        low = [np.searchsorted(e, c) for e, c in zip(self.pair_edges, x.T, strict=True)]
        return 1 / (1 + np.exp(-self.raw(at, low)))


def train(rows: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", label_col: str = "quality",
          sample_rows: int = 20_000) -> Gam:
    """Fit on the rows of (id, f) that have a label and satisfy ``use``."""
    known = labels.filter(col(label_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(
        (F.avg(col(label_col)) >= 0.5).cast("int").alias("y"))
    both = rows.filter(use).join(known, "id")
    counts = {r["y"]: r["n"] for r in both.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        model = Gam()
        return model
    hash_ = F.xxhash64(F.col("id"), F.lit(11)).bitwiseAND(F.lit((1 << 31) - 1))
    share = {y: min(1.0, 0.9 * sample_rows / 2 / n) for y, n in counts.items()}
    limit = F.when(F.col("y") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0))) * float(1 << 31)
    got = both.filter(hash_ < limit).select("y", "f").limit(sample_rows).collect()
    got.sort(key=lambda r: (r["y"], r["f"]))
    y = np.array([r["y"] for r in got], dtype=float)
    if not len(y):
        return Gam()
    w = np.array([1 / share[int(v)] for v in y])
    return Gam().fit(np.array([r["f"] for r in got]), y, w / w.mean())


def score(rows: DataFrame, model: Gam) -> DataFrame:
    """(id, score) of (id, f) rows. The model is a few tables of fixed size."""
    ship_package(rows.sparkSession)
    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.predict(x))], names=["id", "score"])

    return rows.select("id", "f").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", sample_rows: int = 20_000) -> DataFrame:
    """(id, score) of every document; ``held_out(id column)`` tells rows not to learn from."""
    rows = staged(with_features(docs, id_col, text_col), "features")
    return score(rows, train(rows, labels, ~held_out(F.col("id")), id_col, label_col, sample_rows))
