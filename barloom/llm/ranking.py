"""Quality classifier by pairwise ranking.

A document's features are figures of its whole text (letters, capitals, marks, digits, repeated words and lines, lengths).  Preference pairs
put a document of label 1 before one of label 0; a linear score is fitted by logistic loss on feature differences (Bradley-Terry), with Newton
steps.  The threshold is a quantile of the training scores: the share of label 0 lies below it.  Scores are mapped to (0, 1) so that
the threshold becomes ``CUT``.  Labels, language, source and doc_id are never features; held-out rows are never learned from.

Bounds: at most ``MAX_ROWS`` labelled rows, those of the least hash, are learned from, and ``PAIRS`` pairs of them; this is the only sample.
Features of all documents are computed where their rows are and scores are a plain product with the weights.

Defined cases: a null text is empty and has a score; a doc_id that is null is not held out; without rows of both labels all scores are 0.5;
repeated rows score alike; an empty table gives an empty result; other columns are kept by ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import text_bytes

MAX_ROWS, PAIRS, CUT, RIDGE, SEED = 20_000, 200_000, 0.3, 1e-3, 7
FOLDS = 5
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SPACE = b" \t\n\r\x0b\x0c"
ENDS = b".!?"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-\"")
BRACKETS = b"<>{}[]|\\/@#$%&*=_~^+"


def features(text: bytes) -> list[float]:
    """Figures of a text, each of bounded size."""
    n = len(text)
    ws = text.split()
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    k, m = len(ws), len(lines)

    def share(chars: bytes) -> float:
        return (n - len(text.translate(None, chars))) / n if n else 0.0

    distinct = len(set(ws)) / k if k else 1.0
    runs = sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / k if k else 0.0
    tail = sum(1 for w in ws if w[-1:] in b"#$%&*!@~^+=_") / k if k else 0.0
    caps = sum(1 for w in ws if w.isupper()) / k if k else 0.0
    triples = len(set(zip(ws, ws[1:], ws[2:], strict=False))) / (k - 2) if k > 3 else 1.0
    upper, lower, marks = share(UPPER), share(LOWER), share(MARKS)
    repeated = 1 - len(set(lines)) / m if m else 0.0
    mean = (n - (n - len(text.translate(None, SPACE)))) / k if k else 0.0
    return [
        float(n == 0), np.log1p(n) / 10, np.log1p(k) / 10, min(mean, 40) / 10, upper, lower, share(DIGITS), marks, share(BRACKETS), share(ENDS), share(SPACE),
        share(b"!"), share(b","), tail, caps, distinct, 1 - triples, runs, repeated, np.log1p(m) / 5, float(caps > 0.5), float(tail > 0.3), min(marks * 10, 1.0),
        min((1 - triples) * 2, 1.0), min(repeated * 2, 1.0), float(k < 20),
    ]


N_FEATURES = len(features(b""))


@dataclass(frozen=True)
class Model:
    """Score = sigmoid(steep * (weights . (features - mean) / spread - threshold) + logit(CUT))."""

    weights: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    threshold: float
    steep: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not any(self.weights):
            return np.full(len(x), 0.5)
        raw = ((x - np.array(self.mean)) / np.array(self.spread)) @ np.array(self.weights)
        z = self.steep * (raw - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """Bradley-Terry fit on difference vectors of preference pairs."""
    none = Model((0.0,) * x.shape[1], (0.0,) * x.shape[1], (1.0,) * x.shape[1], 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return none
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    n = min(pairs, 20 * (len(good) + len(bad)))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        grad = d.T @ (1 - p) / n - RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    share = len(bad) / len(y)
    below, above = np.quantile(raw, share, method="lower"), np.quantile(raw, share, method="higher")
    return Model(tuple(w), tuple(mean), tuple(spread), float((below + above) / 2), 1.0)


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold; only their features and labels come to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y"))
    known = known.filter(F.col("_y").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the documented sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_t")).join(F.broadcast(known), "doc_id")  # at most max_rows rows
    got = rows.select("doc_id", "_y", _features("_t").alias("_f")).groupBy("doc_id", "_y").agg(F.min("_f").alias("_f")).collect()
    got.sort(key=lambda r: (r.doc_id, r._f))
    if not got:
        return fit_pairs(np.zeros((0, N_FEATURES)), np.zeros(0))
    return fit_pairs(np.array([r._f for r in got]), np.array([r._y for r in got]))


def scored(docs: DataFrame, model: Model, name: str = "score", of: str = "text") -> DataFrame:
    """``docs`` with a score column."""
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
            yield pd.Series(model.score(x))

    return docs.withColumn(name, score(text_bytes(of)))
