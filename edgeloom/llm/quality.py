"""Quality classifier: naive-Bayes support vectors over hashed n-gram indicators.

Features are presence indicators of word 1- and 2-grams and of 1- to 3-grams of word
*shapes* (opening and closing character classes, length class, "same word as before").
Each indicator is scaled by its class log-count ratio; a linear hinge-loss model is then
fitted on the scaled, length-normalised rows by dual coordinate descent, and a sigmoid
maps margins to scores.

Defined results: a null text is an empty one; an empty text has no features and gets the
sigmoid of the bias; a null doc_id counts as the empty id (held out); repeated rows give
repeated results, and an id with several texts teaches one of them; other columns are ignored whatever their names; without two classes
to learn from every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.arrays import SPACED, WORDS, Batch, grams, mix, release, slices
from edgeloom.llm.frames import bounded, id_crc, map_texts, taught

#: The model learns from this many labelled documents at the most (chosen by id hash).
SAMPLE = 6000
BITS = 18


@dataclass
class Model:
    weight: np.ndarray  # per feature: log-count ratio times hinge weight
    ratio2: np.ndarray  # squared log-count ratio, for the row's norm
    bias: float
    slope: float
    shift: float

    def scores(self, keys: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(docs, self.ratio2[keys], n))
        margin = np.bincount(docs, self.weight[keys], n) / np.maximum(norm, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _classes() -> np.ndarray:
    kind = np.full(256, 4, np.uint64)  # other ASCII: told apart below where it closes a word
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 0, 1, 2, 3
    return kind


_KIND = _classes()


def features(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(feature, doc) of every indicator that is present, each once per document."""
    found = []
    starts, ends, doc = batch.words(WORDS)
    if len(starts):
        words = batch.word_hashes(WORDS, starts, ends)
        for k in (1, 2):
            gram, at = grams(words, doc, k)
            found.append((gram ^ np.uint64(k), doc[at]))
    starts, ends, doc = batch.words(SPACED)
    if len(starts):
        words = batch.word_hashes(SPACED, starts, ends)
        last = batch.data[ends - 1]
        length = np.minimum(3, (ends - starts) // 4).astype(np.uint64)
        again = np.zeros(len(words), np.uint64)
        again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        shut = np.where(_KIND[last] == 4, last.astype(np.uint64), np.uint64(0))
        shape = mix(((((_KIND[batch.data[starts]] * np.uint64(8) + _KIND[batch.data[np.minimum(starts + 1, ends - 1)]]) * np.uint64(256) + shut) * np.uint64(4) + length) << np.uint64(1)) | again)
        for k in (1, 2, 3):
            gram, at = grams(shape, doc, k)
            found.append((gram ^ np.uint64(16 + k), doc[at]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z
    keys = np.concatenate([(d.astype(np.int64) << BITS) | (mix(g) >> np.uint64(64 - BITS)).astype(np.int64) for g, d in found])
    keys = np.unique(keys)
    return keys & ((1 << BITS) - 1), keys >> BITS


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    size = 1 << BITS
    counts = {s: np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == s] or [np.zeros(0, np.int64)]), minlength=size) + smooth for s in (1, -1)}
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 2.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + cost * sum of hinge losses, one dual variable at a time."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if (step := new - alpha[i]) != 0.0:
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic map from margins to P(y = 1), by Newton's method with halved steps and smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones(len(margin))])
    loss = lambda t: float((np.logaddexp(0, t @ x) - target * (t @ x)).sum())
    at = np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -500, 500)))
        gradient = x @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), gradient)
        size, now = 1.0, loss(at)
        while size > 1e-8 and loss(at - size * step) > now:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(at[0]), float(at[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of the feature rows; labels are 0 and 1."""
    y = np.where(labels > 0, 1.0, -1.0)
    zero = np.zeros(1 << BITS, np.float32)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))

    def train(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        some, signs = [rows[i] for i in chosen], y[chosen]
        ratio = log_count_ratio(some, signs)
        scaled = [(v := ratio[r]) / max(float(np.sqrt(v @ v)), 1e-9) for r in some]
        w, bias = dual_coordinate_descent(some, scaled, signs)
        return w, ratio, bias

    def margins(w: np.ndarray, ratio: np.ndarray, bias: float, chosen: np.ndarray) -> np.ndarray:
        return np.array([float(w[r] @ (v := ratio[r])) / max(float(np.sqrt(v @ v)), 1e-9) + bias for r in (rows[i] for i in chosen)])

    order = np.random.default_rng(3).permutation(len(rows))
    apart, rest = order[: len(rows) // 5], order[len(rows) // 5 :]
    if len(set(labels[rest].tolist())) < 2 or len(set(labels[apart].tolist())) < 2:
        apart = rest = order
    slope, shift = sigmoid_fit(margins(*train(rest), apart), y[apart])  # margins of rows that the weights haven't seen
    w, ratio, bias = train(order)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, max(slope, 1e-3), shift)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """documents (doc_id, text) and labels (doc_id, label); rows without a label teach nothing.

    The sample's ids are chosen from the small label table first, so its broadcast is bounded by `sample`.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = bounded(known.groupBy("doc_id").agg(F.max("y").alias("y")), sample)
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Batch.of_arrow(batch.column("text"))
        keys, docs = features(found)
        cuts = np.searchsorted(docs, np.arange(found.n + 1))
        blobs = [keys[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(blobs, pa.binary())], ["doc_id", "y", "f"])

    got = sorted(map_texts(taught(documents, known), encode, "doc_id long, y int, f binary").collect(), key=lambda r: (r["doc_id"], bytes(r["f"])))
    return fit_rows([np.frombuffer(r["f"], np.int32).astype(np.int64) for r in got], np.array([r["y"] for r in got], np.int64))


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row; see the module's text for the edge cases."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2 x 4 x 2**BITS bytes whatever the data

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Batch.of_arrow(batch.column("text"))
        s = sent.value.scores(*features(found), found.n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_texts(documents.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def keep_good(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, whose score is `threshold` or more; map-only."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Batch.of_arrow(batch.column("text"))
                good = batch.filter(pa.array(sent.value.scores(*features(found), found.n) >= threshold))
                if good.num_rows:
                    yield good
        release()

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Scores for every document, learnt only from those whose id's crc32 modulo `folds` isn't `fold`."""
    taught = labels.where(id_crc() % folds != fold)
    return score(documents, fit(documents, taught, sample=sample)).select("doc_id", (id_crc() % folds == fold).alias("held_out"), "score", "predicted")
