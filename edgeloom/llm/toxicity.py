"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (every word that LEAST_SEEN training documents have; one
shared vector for the rest) beside the mean vector of its hashed character 3-grams.  A
word's vector starts from how much more toxic documents hold it than an even word.  Windows
of WINDOW words begin every STRIDE and cover every text to its end, so a passage of up to
WINDOW - STRIDE + 1 words lies whole in one; each window is read in both directions, pooled
by attention and mapped to a logit.  A document's score is a calibrated sigmoid of its
largest logit.

Training sees a bounded labelled sample, whatever the language.  Labels are per document,
so it alternates: the windows of toxic documents that look worst (by their most telling word
first, by the network later) are the positives, windows of the others the negatives.  A
fifth of the sample is kept apart, from vocabulary and network, to calibrate.

Defined results: null and empty texts are one empty window and are scored like any other;
a null doc_id counts as the empty id; repeated rows give repeated results, and an id with several texts teaches one of them; other columns
are ignored; without two classes to learn from every score is the share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.arrays import _LETTER_HASH, WORDS, Batch, grams, mix, ragged
from edgeloom.llm.frames import bounded, id_crc, map_texts, taught
from edgeloom.llm.quality import sigmoid_fit

#: The network learns from this many labelled documents at the most (chosen by id hash).
SAMPLE = 5000
WINDOW, STRIDE = 32, 16
#: Steps of a training round on few windows; many windows are gone through twice.
LEAST_STEPS = 60
#: A word of its own vector is in so many training documents at least.
LEAST_SEEN = 3
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BITS = 8, 8, 8, 15
SIDES = ("f", "b")


def _sig(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


@dataclass
class Model:
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted word hashes
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word within it, words) of every window; texts of up to WINDOW words are one window."""
    per = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), per)
    first = ragged(np.zeros(len(counts), np.int64), per) * STRIDE
    first = np.minimum(first, np.maximum(0, counts[doc] - WINDOW))
    return doc, first, np.minimum(WINDOW, counts[doc] - first)


class Words:
    """The distinct words of a batch: hash, place in the vocabulary, character 3-grams; and each word's index."""

    def __init__(self, batch: Batch, vocabulary: np.ndarray):
        starts, ends, doc = batch.words(WORDS)
        self.counts = np.bincount(doc, minlength=batch.n)
        hashes = batch.word_hashes(WORDS, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.hash, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        self.index = index.astype(np.int32)
        del hashes, index, doc
        self.name(vocabulary)
        s, e = starts[first], ends[first]
        letters = _LETTER_HASH[batch.data[ragged(s, e - s)]]
        owner = np.repeat(np.arange(len(s)), e - s)
        gram, where = grams(letters, owner, 3)
        both = [(gram, owner[where])]
        lone = np.flatnonzero(e - s < 3)  # shorter words: the word itself
        both.append((self.hash[lone], lone))
        self.gram = np.concatenate([(mix(g) >> np.uint64(64 - CHAR_BITS)).astype(np.int32) for g, _ in both])
        self.owner = np.concatenate([o.astype(np.int32) for _, o in both])
        order = np.argsort(self.owner, kind="stable")
        self.gram, self.owner = self.gram[order], self.owner[order]
        self.per = np.bincount(self.owner, minlength=len(self.hash))
        self.begin = np.cumsum(self.per) - self.per

    def name(self, vocabulary: np.ndarray) -> None:
        at = np.searchsorted(vocabulary, self.hash)
        hit = at < len(vocabulary)
        hit[hit] = vocabulary[at[hit]] == self.hash[hit]
        self.word = np.where(hit, at, len(vocabulary))

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """One row for each distinct word, and a last row of zeros for the padding."""
        n = len(self.hash)
        x = np.zeros((n + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:n, :WORD_DIM] = p["word"][self.word]
        if n:
            x[:n, WORD_DIM:] = np.add.reduceat(p["char"][self.gram], self.begin, axis=0) / self.per[:, None]
        return x

    def some(self, p: dict[str, np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """inputs() of some distinct words, with their 3-grams and, for each of these, its row."""
        x = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32)
        real = np.flatnonzero(used < len(self.hash))
        u = used[real]
        gram, row = self.gram[ragged(self.begin[u], self.per[u])], np.repeat(real, self.per[u])
        x[real, :WORD_DIM] = p["word"][self.word[u]]
        if len(u):
            x[real, WORD_DIM:] = np.add.reduceat(p["char"][gram], np.cumsum(self.per[u]) - self.per[u], axis=0) / self.per[u][:, None]
        return x, gram, row

    def grid(self, doc: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """windows x WINDOW indices of distinct words; the padding is their number."""
        begin = np.cumsum(self.counts) - self.counts
        at = (begin[doc] + first)[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < length[:, None]
        g = np.full(at.shape, len(self.hash), np.int32)
        g[inside] = self.index[at[inside]]
        return g


def _initial(vocabulary: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    normal = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
    p = {"word": normal(vocabulary + 1, WORD_DIM, by=0.3), "char": normal(1 << CHAR_BITS, CHAR_DIM, by=0.3), "out": normal(2 * h, by=0.3), "bias": np.zeros(1, np.float32)}
    for s in SIDES:
        p |= {f"W{s}": normal(d, 3 * h, by=d**-0.5), f"U{s}": normal(h, 3 * h, by=h**-0.5), f"c{s}": np.zeros(3 * h, np.float32), f"a{s}": normal(h, by=0.3)}
    return p


def _read(p: dict[str, np.ndarray], table: dict[str, np.ndarray], g: np.ndarray, inside: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
    """Logits of the windows g (WINDOW x windows, word indices); keep: what the gradient needs."""
    h, n = HIDDEN, g.shape[1]
    states, kept = {}, {}
    for s in SIDES:
        u, out = p[f"U{s}"], np.zeros((WINDOW, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        steps = range(WINDOW) if s == "f" else range(WINDOW - 1, -1, -1)
        memo = {}
        for t in steps:
            x = table[s][g[t]]
            rz = _sig(x[:, : 2 * h] + state @ u[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            v = r * state
            c = np.tanh(x[:, 2 * h :] + v @ u[:, 2 * h :])
            new = state + z * (c - state) * inside[t][:, None]
            if keep:
                memo[t] = (state, r, z, c, v)
            state = out[t] = new
        states[s] = out
        kept[s] = memo
    weight = sum(states[s] @ p[f"a{s}"] for s in SIDES)
    weight = np.where(inside, np.exp(np.clip(weight, -20, 20)), 0)
    weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.concatenate([np.einsum("tn,tnh->nh", weight, states[s]) for s in SIDES], axis=1)
    return pooled @ p["out"] + p["bias"][0], {"states": states, "memo": kept, "weight": weight, "pooled": pooled}


def _tables(m: Model, words: Words) -> dict[str, np.ndarray]:
    """What each distinct word adds to the gates of both directions."""
    x = words.inputs(m.p)
    return {s: x @ m.p[f"W{s}"] + m.p[f"c{s}"] for s in SIDES}


def logits(m: Model, words: Words, g: np.ndarray, block: int = 4096, table: dict[str, np.ndarray] | None = None) -> np.ndarray:
    table = table or _tables(m, words)
    out = np.empty(len(g), np.float32)
    for a in range(0, len(g), block):
        part = np.ascontiguousarray(g[a : a + block].T)
        out[a : a + block] = _read(m.p, table, part, part != len(words.hash), False)[0]
    return out


def _gather(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows for each place in 0 .. n - 1."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _gradient(p: dict[str, np.ndarray], words: Words, g: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean logistic loss by back-propagation through time."""
    h, (used, local) = HIDDEN, np.unique(g, return_inverse=True)
    local = np.ascontiguousarray(local.reshape(g.shape).T)
    inside = np.ascontiguousarray((g != len(words.hash)).T)
    x, gram, row = words.some(p, used)
    table = {s: x @ p[f"W{s}"] + p[f"c{s}"] for s in SIDES}
    logit, k = _read(p, table, local, inside, True)
    d = ((_sig(logit) - y) / len(y)).astype(np.float32)
    grad = {"out": k["pooled"].T @ d, "bias": np.array([d.sum()], np.float32)}
    pooled_grad = d[:, None] * p["out"][None]
    dx = np.zeros_like(x)
    # attention: the weights' own gradient is shared by both directions
    value = sum(np.einsum("tnh,nh->tn", k["states"][s], pooled_grad[:, i * h : (i + 1) * h]) for i, s in enumerate(SIDES))
    dweight = k["weight"] * (value - (k["weight"] * value).sum(axis=0))
    for i, s in enumerate(SIDES):
        states, memo, u = k["states"][s], k["memo"][s], p[f"U{s}"]
        grad[f"a{s}"] = np.einsum("tn,tnh->h", dweight, states)
        dstates = k["weight"][:, :, None] * pooled_grad[None, :, i * h : (i + 1) * h] + dweight[:, :, None] * p[f"a{s}"]
        du, each, carry = np.zeros_like(u), np.empty((*local.shape, 3 * h), np.float32), np.zeros_like(states[0])
        for t in range(WINDOW - 1, -1, -1) if s == "f" else range(WINDOW):
            before, r, z, c, v = memo[t]
            carry = carry + dstates[t]
            on = carry * inside[t][:, None]
            dc = on * z * (1 - c * c)
            dv = dc @ u[:, 2 * h :].T
            dz = on * (c - before) * z * (1 - z)
            dr = dv * before * r * (1 - r)
            gates = np.concatenate([dr, dz], axis=1)
            du[:, : 2 * h] += before.T @ gates
            du[:, 2 * h :] += v.T @ dc
            carry = carry - on * z + dv * r + gates @ u[:, : 2 * h].T
            each[t, :, : 2 * h], each[t, :, 2 * h :] = gates, dc
        dtable = _gather(each.reshape(-1, 3 * h), local.ravel(), len(used))
        grad |= {f"U{s}": du, f"W{s}": x.T @ dtable, f"c{s}": dtable.sum(axis=0)}
        dx += dtable @ p[f"W{s}"].T
    real = np.flatnonzero(used < len(words.hash))
    grad["word"] = _gather(dx[real, :WORD_DIM], words.word[used[real]], len(p["word"]))
    share = np.zeros((len(used), CHAR_DIM), np.float32)
    share[real] = dx[real, WORD_DIM:] / words.per[used[real]][:, None]
    grad["char"] = _gather(share[row], gram, len(p["char"]))
    return grad


def _adam(m: Model, words: Words, g: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int, rate: float, memory: dict, batch: int = 256) -> None:
    for _ in range(epochs):
        order = rng.permutation(len(g))
        for a in range(0, len(g), batch):
            chosen = order[a : a + batch]
            memory["t"] = t = memory.get("t", 0) + 1
            for k, d in _gradient(m.p, words, g[chosen], y[chosen]).items():
                one, two = memory.setdefault(k, (np.zeros_like(d), np.zeros_like(d)))
                one *= 0.9
                one += 0.1 * d
                two *= 0.99
                two += 0.01 * d * d
                m.p[k] -= (rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def fit_texts(texts: list[str], labels: np.ndarray, rounds: int = 3, seed: int = 11) -> Model:
    """A network trained on these texts; labels are 0 and 1."""
    if len(set(labels.tolist())) < 2:
        return Model(constant=float(labels.mean()) if len(labels) else 0.5)
    rng, batch = np.random.default_rng(seed), Batch.of_strings(texts)
    words = Words(batch, np.zeros(0, np.uint64))
    owner = np.repeat(np.arange(batch.n), words.counts)
    apart = rng.random(batch.n) < 0.2  # calibrates; neither the vocabulary nor the network learns from it
    doc_of, word = np.divmod(np.unique(owner * (len(words.hash) + 1) + words.index), len(words.hash) + 1)
    taught = ~apart[doc_of]
    seen = np.bincount(word[taught], minlength=len(words.hash))
    bad = np.bincount(word[taught & (labels[doc_of] > 0)], minlength=len(words.hash))
    known = np.flatnonzero(seen >= LEAST_SEEN)
    vocabulary = words.hash[known]  # sorted, as the hashes are
    share = (labels[~apart].sum() + 1) / ((~apart).sum() + 2)
    telling = (bad - seen * share) / np.sqrt(seen * share * (1 - share) + 1)  # deviations from what an even word has
    telling = np.where(seen >= LEAST_SEEN, np.clip(telling / 3, -2, 2), 0.0)
    words.name(vocabulary)
    doc, first, length = windows(words.counts)
    g = words.grid(doc, first, length)
    worst = np.concatenate([telling, [-9.0]])[g].max(axis=1)  # at first: the window's most telling word
    toxic = labels[doc] > 0
    m = Model(vocabulary, _initial(len(vocabulary), rng))
    m.p["word"][:-1, 0] = telling[known]  # a word's vector begins with how telling it is
    m.p["word"][-1, 0] = 0.0
    clean = np.flatnonzero(~toxic)
    memory: dict = {}
    for k in range(rounds):
        if k:
            worst = logits(m, words, g)
        top = np.full(batch.n, -np.inf)
        np.maximum.at(top, doc, worst)
        line = 1.0 if not k else 0.0
        positive = np.flatnonzero(toxic & ((worst >= line) | (worst >= top[doc])) & ~apart[doc])
        open_ = clean[~apart[doc[clean]]]
        size = min(len(open_), 2 * len(positive) + 2000)
        hard = open_[np.argsort(-worst[open_], kind="stable")[: size // 3]]
        negative = np.concatenate([hard, rng.choice(open_, size - len(hard), replace=False)])
        chosen = np.concatenate([positive, negative])
        _adam(m, words, g[chosen], np.concatenate([np.ones(len(positive)), np.zeros(len(negative))]).astype(np.float32), rng, max(2, -(-LEAST_STEPS // -(-len(chosen) // 256))), 0.01 / (1 + k), memory)
    value = logits(m, words, g)
    top = np.full(batch.n, -np.inf)
    np.maximum.at(top, doc, value)
    m.slope, m.shift = sigmoid_fit(top[apart], labels[apart]) if len(set(labels[apart].tolist())) == 2 else (1.0, 0.0)
    m.slope = max(m.slope, 1e-3)
    return m


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """documents (doc_id, text) and labels (doc_id, label); rows without a label teach nothing."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = bounded(known.groupBy("doc_id").agg(F.max("y").alias("y")), sample)
    rows = sorted(taught(documents, known).collect(), key=lambda r: r["doc_id"])
    return fit_texts([r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64))


def score_batch(m: Model, batch: Batch) -> np.ndarray:
    if m.constant is not None:
        return np.full(batch.n, m.constant)
    words = Words(batch, m.vocabulary)
    doc, first, length = windows(words.counts)
    table, value = _tables(m, words), np.empty(len(doc), np.float32)
    for a in range(0, len(doc), 32_768):  # a very long text has very many windows
        some = slice(a, a + 32_768)
        value[some] = logits(m, words, words.grid(doc[some], first[some], length[some]), table=table)
    begin = np.searchsorted(doc, np.arange(batch.n))
    top = np.maximum.reduceat(value, begin) if batch.n else value
    return 1 / (1 + np.exp(-np.clip(m.slope * top.astype(np.float64) + m.shift, -40, 40)))


def score(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words and 2**CHAR_BITS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = score_batch(sent.value, Batch.of_arrow(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_texts(documents.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Scores for every document, learnt only from those whose id's crc32 modulo `folds` isn't `fold`."""
    model = fit(documents, labels.where(id_crc() % folds != fold), sample=sample)
    return score(documents, model).select("doc_id", (id_crc() % folds == fold).alias("held_out"), "score", "predicted")
