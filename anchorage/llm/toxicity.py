"""Toxicity by classifier chains.

Categories are predicted one after the other by logistic models on hashed
words.  Each model after the first also gets the probabilities of the
categories before it; while it is trained, these are out-of-fold predictions,
made by models that have not seen the row, so it learns how far to trust them.
Decision thresholds come from out-of-fold predictions as well.

Training takes at most ``max_rows`` labelled documents, those with the least
hashes of their ids; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import U64, binary_values, bounded_batches, byte_array, map_batches, utf8, word_bounds, word_hashes

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass(frozen=True)
class Params:
    #: Labelled documents to train on, at most; this bounds what reaches the driver.
    max_rows: int = 8_000
    folds: int = 5
    #: Hashed features.
    bits: int = 18
    #: Least training rows that have a feature.
    least_rows: int = 4
    steps: int = 60
    #: Strength of the quadratic penalty, a row's worth.
    penalty: float = 2.0
    #: A threshold must reach this precision out of fold; among those, the best F1.
    precision: float = 0.97


def features(text: memoryview | bytes, bits: int) -> np.ndarray:
    """Sorted distinct features of a text, hashed to ``bits`` bits.

    They are its words in lower case without ASCII signs and digits, and the
    runs of signs between them.
    """
    data = byte_array(text, lower=True)
    words = np.where(_LETTER[data], data, np.uint8(32))
    signs = np.where(_SIGN[data], data, np.uint8(32))
    found = [word_hashes(part, *word_bounds(part)) for part in (words, signs)]
    return np.unique(np.concatenate(found) >> U64(64 - bits)).astype(np.int32)


@dataclass
class Linear:
    """Weights by feature, one for each earlier category's log-odds, a bias and a threshold."""

    weights: np.ndarray
    chained: np.ndarray
    bias: float
    threshold: float = 0.5

    def probability(self, index: np.ndarray, row: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        score = np.bincount(row, self.weights[index], n) + self.bias + _odds(earlier) @ self.chained
        return 1 / (1 + np.exp(-np.clip(score, -50, 50)))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit(index: np.ndarray, row: np.ndarray, y: np.ndarray, earlier: np.ndarray, params: Params) -> Linear:
    """Penalised logistic regression on present features by accelerated gradient steps."""
    n, d = len(y), 1 << params.bits
    counts = np.bincount(index, minlength=d)
    used = np.flatnonzero(counts >= params.least_rows)
    column = np.full(d, -1)
    column[used] = np.arange(len(used))
    keep = column[index] >= 0
    at, who = column[index[keep]], row[keep]
    extra = _odds(earlier)
    # Features are scaled by how unevenly the classes have them, so that telling words move first.
    ones, zeros = np.bincount(at, y[who], len(used)) + 0.5, np.bincount(at, 1.0 - y[who], len(used)) + 0.5
    scale = np.minimum(np.abs(np.log(ones / zeros) - np.log((y.sum() + 1) / (n - y.sum() + 1))), 4.0)
    w, v, b = np.zeros(len(used)), np.zeros(extra.shape[1]), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    gw, gv, gb = np.full(len(used), 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    for _ in range(params.steps):
        score = np.bincount(who, (w * scale)[at], n) + b + extra @ v
        error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - y
        dw = np.bincount(at, error[who], len(used)) * scale + params.penalty * w
        dv, db = extra.T @ error + params.penalty * v, error.sum()
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
        w, v, b = w - 0.3 * dw / np.sqrt(gw), v - 0.3 * dv / np.sqrt(gv), b - 0.3 * db / np.sqrt(gb)
    weights = np.zeros(d)
    weights[used] = w * scale
    return Linear(weights, v, b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Midway between the scores around the cut of best F1 among cuts that reach ``precision``; above 1 where none does."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order].astype(np.float64)
    hits, shown = np.cumsum(y), np.arange(1, len(y) + 1)
    distinct = np.append(p[1:] != p[:-1], True) if len(p) else np.zeros(0, bool)
    good = distinct & (hits / shown >= precision)
    if not good.any() or not y.sum():
        return 1.1
    f1 = np.where(good, 2 * hits / (shown + y.sum()), -1)
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def train(index: np.ndarray, row: np.ndarray, labels: np.ndarray, params: Params) -> list[Linear]:
    """The chain's models for labels (rows x categories), rows in a random order."""
    n, categories = labels.shape
    fold = np.arange(n) % params.folds
    earlier, chain = np.zeros((n, 0)), []
    for c in range(categories):
        y = labels[:, c].astype(np.float64)
        out = np.zeros(n)
        for k in range(params.folds):
            inside = fold != k
            place = np.cumsum(inside) - 1
            mine = inside[row]
            model = fit(index[mine], place[row[mine]], y[inside], earlier[inside], params)
            out[~inside] = model.probability(index, row, n, earlier)[~inside]
        model = fit(index, row, y, earlier, params)
        model.threshold = threshold(out, y, params.precision)
        chain.append(model)
        earlier = np.column_stack((earlier, out))
    return chain


def _flatten(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    found = [features(t, bits) for t in binary_values(texts)]
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    return (np.concatenate(found) if found else np.empty(0, np.int32)), row


def train_on(documents: DataFrame, labels: DataFrame, categories: dict[str, Column], params: Params = Params()) -> list[Linear]:
    """Train a chain on the bounded sample of labelled documents.

    A null label counts as negative, a null text as empty; rows without an id
    are not used.  The bound holds for documents with their labels, so it holds
    as well where ids repeat; of rows alike in id and labels the one whose text
    has the least hash is used.  Without labelled documents every probability
    is even and nothing reaches its threshold.
    """
    bounded_batches(documents.sparkSession)
    names = [f"label_{k}" for k in range(len(categories))]
    marks = labels.filter("doc_id is not null").select(
        "doc_id", *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in zip(names, categories.values(), strict=True)]
    )
    # First the keys, at most so many of them; then the texts of these alone.
    order = (F.xxhash64("doc_id"), "doc_id", *names)
    some = marks.distinct().orderBy(*order).limit(params.max_rows)
    text = documents.select("doc_id", utf8("text").alias("text"))
    keyed = text.join(F.broadcast(some), "doc_id").groupBy("doc_id", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    joined = keyed.orderBy(*order).limit(params.max_rows)
    bits = params.bits

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([features(t, bits) for t in binary_values(batch.column(0))], pa.list_(pa.int32()))
        return pa.record_batch([found, *batch.columns[1:]], names=["found", "doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"found array<int>, doc_id {kind}, " + ", ".join(f"{c} int" for c in names)
    rows = map_batches(joined.select("text", "doc_id", *names), run, schema).orderBy("doc_id", "found", *names).toArrow()
    found = [f.values.to_numpy() for f in rows["found"]]
    shuffle = np.random.default_rng(5).permutation(len(found))
    index = np.concatenate([found[k] for k in shuffle]) if found else np.empty(0, np.int32)
    row = np.repeat(np.arange(len(found)), [len(found[k]) for k in shuffle])
    marks = np.column_stack([rows[c].to_numpy() for c in names])[shuffle]
    return train(index, row, marks, params)


def predict(documents: DataFrame, chain: list[Linear], names: list[str], params: Params = Params()) -> DataFrame:
    """(doc_id, p_<name> and <name> for each category) for every row of ``documents`` (doc_id, text).

    A null text is empty.  Repeated rows have equal results; other columns are
    ignored; no rows give no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    bits = params.bits

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, row = _flatten(batch.column(1), bits)
        earlier, columns = np.zeros((batch.num_rows, 0)), []
        for model in shared.value:
            p = model.probability(index, row, batch.num_rows, earlier)
            columns += [pa.array(p), pa.array(p >= model.threshold)]
            earlier = np.column_stack((earlier, p))
        return pa.record_batch([batch.column(0), *columns], names=["doc_id", *[f"{a}{c}" for c in names for a in ("p_", "")]])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"p_{c} double, {c} boolean" for c in names)
    return map_batches(documents.select("doc_id", utf8("text").alias("text")), run, schema)
