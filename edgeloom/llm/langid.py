"""Language identification: multinomial naive Bayes over hashed character n-grams.

Documents are sequences of code points (ASCII and Latin-1 capitals lower-cased); their
1- to 3-grams are hashed into 2**BITS buckets.  A bounded labelled sample is counted, the
log-probability matrix (buckets x languages) is broadcast, and batches are scored by
gathering and summing its rows in numpy.

Defined results: `und` with score 0 where the text is null or has no letter, or where
nothing was learnt; a null doc_id counts as the empty id; ties go to the language that
sorts first; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.arrays import Batch, mix
from edgeloom.llm.frames import bounded, id_crc, map_texts

#: Languages are learnt from this many documents at the most (chosen by id hash).
SAMPLE = 8000
BITS = 16
#: The matrix that is broadcast has 2**CELLS cells at the most: with very many languages n-grams share buckets.
CELLS = 26
LATIN = re.compile("[A-Za-z]")


@dataclass
class Model:
    names: list[str]
    prior: np.ndarray
    matrix: np.ndarray  # buckets x languages, log-probabilities
    shift: int = 0  # what is cut off a bucket's number


def has_letter(text: str) -> bool:
    return bool(LATIN.search(text)) or any(map(str.isalpha, text))


def _lower(points: np.ndarray) -> np.ndarray:
    p = points.copy()
    p[(p >= 65) & (p <= 90) | (p >= 192) & (p <= 222) & (p != 215)] += 32
    return p


def _buckets(batch: Batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: (bucket of each n-gram, offsets of the documents among them)."""
    points, offsets = batch.code_points()
    p = _lower(points).astype(np.uint32)
    n = len(p)
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    out, h = [], np.zeros(n, np.uint32)
    for k in (1, 2, 3):
        h = h[: max(0, n - k + 1)] * np.uint32(0x9E3779B1) + (p[k - 1 :] + np.uint32(k)) * np.uint32(0x85EBCA77)
        whole = np.arange(len(h)) + k <= owner_end[: len(h)]
        bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(whole)])[np.minimum(offsets, len(h))]
        out.append((bucket[whole], bounds))
    return out


def fit(documents: DataFrame, sample: int = SAMPLE, smooth: float = 0.05) -> Model:
    """Learns from the rows whose lang isn't null."""
    known = documents.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    few = bounded(known, sample)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        owner = np.array([names.index(x) for x in langs], np.int64)
        total = np.zeros(len(names) << BITS, np.int64)
        for bucket, bounds in _buckets(Batch.of_arrow(batch.column("text"))):
            total += np.bincount((np.repeat(owner, np.diff(bounds)) << BITS) | bucket, minlength=len(total))
        full = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in full >> BITS], pa.string()), pa.array(full & ((1 << BITS) - 1)), pa.array(total[full])], ["lang", "bucket", "n"])

    totals = map_texts(few, count, "lang string, bucket long, n long", most_bytes=32_000_000).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = totals.toPandas()  # at most 2**BITS rows a language
    docs = few.groupBy("lang").count().toPandas()
    names = sorted(docs["lang"])
    shift = max(0, BITS + max(0, len(names) - 1).bit_length() - CELLS)
    matrix = np.full((1 << BITS - shift, len(names)), smooth)
    place = {x: i for i, x in enumerate(names)}
    np.add.at(matrix, (rows["bucket"].to_numpy(np.int64) >> shift, rows["lang"].map(place).to_numpy(np.int64)), rows["n"].to_numpy())
    matrix = np.log(matrix) - np.log(matrix.sum(axis=0))
    seen = docs.set_index("lang")["count"].reindex(names).to_numpy(float)
    return Model(names, np.log(seen / max(seen.sum(), 1)), matrix.astype(np.float32), shift)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of the language named) of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 4 x 2**CELLS bytes at the most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, found = sent.value, Batch.of_arrow(batch.column("text"))
        named, score = ["und"] * found.n, np.zeros(found.n)
        if m.names:
            logs = np.tile(m.prior, (found.n, 1))
            for bucket, bounds in _buckets(found):
                for j in range(len(m.names)):
                    sums = np.concatenate([[0.0], np.cumsum(m.matrix[bucket >> m.shift, j], dtype=np.float64)])
                    logs[:, j] += sums[bounds[1:]] - sums[bounds[:-1]]
            best = logs.argmax(axis=1)
            part = np.exp(logs - logs.max(axis=1, keepdims=True))
            for i in range(found.n):
                if has_letter(found.text(i)):
                    named[i], score[i] = m.names[best[i]], part[i, best[i]] / part[i].sum()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_texts(documents.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Predictions for every document, learnt only from those whose id's crc32 modulo `folds` isn't `fold`."""
    model = fit(documents.where(id_crc() % folds != fold), sample)
    return predict(documents, model).select("doc_id", (id_crc() % folds == fold).alias("held_out"), "lang_pred", "score")
