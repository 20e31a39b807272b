"""Personal data: patterns, and a skip-chain conditional random field over each document.

Nodes are the candidate tokens of a text (address-like and number-like runs); all other
words are observed as "none".  A linear chain joins neighbouring candidates; a skip edge
joins a candidate to the next one that repeats it or resembles it (same digits up to a
country prefix, same four parts of an address, same mailbox), so an entity found once carries
its label to mentions that no pattern would accept.  Labels are inferred by loopy belief
propagation.  Weights are learnt by pseudo-likelihood on a bounded sample whose labels the
patterns give, and on the same texts with a known entity mentioned once more in a loose form
that no pattern accepts but that keeps its label; loose forms of nothing known are "none".
Shape features are dropped at random so that the skip edges must carry evidence.

Spans of the patterns always stay; the field only adds spans.

Defined results: a null text is an empty one; texts are read one by one, so ids may be null
or repeated; a node has at most a few skip edges, so repeats cost linear time; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.arrays import Batch
from edgeloom.llm.frames import bounded, map_texts, within

KINDS = ("email", "ip", "card", "phone")
STATES = ("none", *KINDS)
#: The field's weights are learnt from this many documents with a candidate at the most.
SAMPLE = 2000
ROUNDS = 30

# Possessive runs and look-behinds keep the scans linear; they accept what the plain patterns accept.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:(?:[\x20().-]{0,3}|\[\.\])[0-9])*+")
SPELT = re.compile(r"\x20?[\[(](?:at|AT)[\])]\x20?")
MAIL_LIKE = re.compile(r"[^\s@<>,;:\"'\[(]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[^\s@<>,;:\"']+")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in MAILBOX:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


@dataclass
class Node:
    start: int
    end: int
    text: str
    keys: list[str]  # what it may repeat or resemble
    features: list[int]


FEATURES = ["bias", "at", "at dotted", "at spelt", "spelt dotted", "dots 3", "parts small", "quad", "digits 7-8", "digits 9-11", "digits 12-19", "digits 20+", "luhn", "luhn fails", "plus", "bracket", "separated", "grouped 4", "word before mail", "word before call", "word before card", "word before address"]
_PLACE = {x: i for i, x in enumerate(FEATURES)}
#: Fixed cue words, lower case.
CUES = {"word before mail": ("email", "e-mail", "mail", "contact", "courriel", "correo"), "word before call": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"), "word before card": ("card", "visa", "account", "karte", "carte", "tarjeta"), "word before address": ("ip", "host", "server", "address")}
_CUE = {w: _PLACE[k] for k, words in CUES.items() for w in words}


def _quad(s: str) -> str | None:
    """The four parts of what looks like an address, whatever separates them."""
    parts = re.findall("[0-9]+", s)
    return ".".join(str(int(p)) for p in parts) if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) else None


def _parted(run: str, at: int) -> list[tuple[int, int]]:
    """A run of numbers as one candidate; if it has too many digits for any kind, as those between its blanks: whole ones alone, others together."""
    if len(_digits(run)) <= 19:
        return [(at, at + len(run))]
    out, open_ = [], False
    for m in re.finditer(r"[^\x20]+", run):
        span, alone = (at + m.start(), at + m.end()), len(_digits(m[0])) >= 9 or bool(_quad(m[0]))
        if open_ and not alone:
            out[-1] = (out[-1][0], span[1])
        else:
            out.append(span)
        open_ = not alone
    return out


def nodes(text: str) -> list[Node]:
    """The candidates of a text in order; address-like runs come before the numbers in them."""
    spans = [(m.start(), m.end(), True) for m in MAIL_LIKE.finditer(text)] if "@" in text or "[at]" in text or "(at)" in text or "AT" in text else []
    taken = [(a, b) for a, b, _ in spans]
    k = 0
    for m in NUMBER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        for a, b in _parted(m[0], m.start()):
            s = text[a:b]
            if (len(_digits(s)) >= 7 or b - a >= 7 and " " not in s and _quad(s)) and not (k < len(taken) and taken[k][0] < b):
                spans.append((a, b, False))
    out = []
    for a, b, mail in sorted(spans):
        s = text[a:b]
        f = ["bias"]
        if mail:
            mailbox, _, domain = s.partition("@")
            if domain:
                f += ["at"] + ["at dotted"] * ("." in domain.strip("."))
            else:
                mailbox, domain = SPELT.split(s, maxsplit=1)
                f += ["at spelt"] + ["spelt dotted"] * ("." in domain.strip("."))
            keys = [f"m:{mailbox.lower()}", f"m:{mailbox.lower()}@{domain.lower().strip('.')}"]
        else:
            d = _digits(s)
            n = len(d)
            quad = _quad(s)
            keys = [f"i:{quad}"] if quad else [f"d:{d}"] + ([f"p:{d[-9:]}"] if 9 <= n <= 15 else [])
            parts = s.split(".")
            f += ["dots 3"] * (len(parts) == 4) + ["parts small"] * (len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts))
            f += ["quad"] * bool(quad)
            f.append("digits 7-8" if n < 9 else "digits 9-11" if n < 12 else "digits 12-19" if n < 20 else "digits 20+")
            f += ["luhn" if luhn(d) else "luhn fails"] * (12 <= n <= 19) + ["plus"] * (s[0] == "+") + ["bracket"] * ("(" in s) + ["separated"] * (s != d) + ["grouped 4"] * bool(re.search(r"[0-9]{4}[ -][0-9]{4}", s))
        before = text[max(0, a - 24) : a].lower().replace(":", " ").split()
        codes = [_PLACE[x] for x in f] + sorted({_CUE[w] for w in before[-2:] if w in _CUE})
        out.append(Node(a, b, s, keys, codes))
    return out


def edges(found: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, 0 for chain and 1 for skip); a skip edge goes to the next node that shares a key."""
    pairs, kinds, last = [], [], {}
    for i, node in enumerate(found):
        if i:
            pairs.append((i - 1, i))
            kinds.append(0)
        for j in {last[k] for k in node.keys if k in last}:
            pairs.append((j, i))
            kinds.append(1)
        last.update(dict.fromkeys(node.keys, i))
    return np.array(pairs, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


@dataclass
class Model:
    unary: np.ndarray  # features x states
    pair: np.ndarray  # chain and skip: 2 x states x states


def _score(m: Model, found: list[Node], dropped: np.ndarray | None = None) -> np.ndarray:
    u = np.zeros((len(found), len(FEATURES)))
    for i, node in enumerate(found):
        u[i, node.features] = 1
    return (u if dropped is None else u * dropped) @ m.unary


def beliefs(m: Model, found: list[Node]) -> np.ndarray:
    """Marginals by loopy sum-product message passing in log space, damped, both ways along every edge at once."""
    unary = _score(m, found)
    pairs, kinds = edges(found)
    if not len(pairs):
        b = unary
    else:
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        table = np.concatenate([m.pair[kinds], m.pair[kinds].transpose(0, 2, 1)])
        message = np.zeros((len(source), len(STATES)))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, target, message)
            sent = (total[source] - message[back])[:, :, None] + table
            top = sent.max(axis=1)
            new = top + np.log(np.exp(sent - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if change < 1e-4:
                break
        b = unary.copy()
        np.add.at(b, target, message)
    b = np.exp(b - b.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


def _labels(text: str, found: list[Node]) -> np.ndarray:
    """What the patterns say of each candidate: the kind that covers most of it, or none."""
    base = base_matches(text)
    y, k = np.zeros(len(found), np.int64), 0
    for i, node in enumerate(found):
        while k < len(base) and base[k][2] <= node.start:
            k += 1
        best = 0
        for kind, a, b in base[k : k + 8]:
            if a >= node.end:
                break
            if (common := min(b, node.end) - max(a, node.start)) > max(best, 0.6 * (node.end - node.start)):
                best, y[i] = common, STATES.index(kind)
    return y


def loosened(rng: np.random.Generator, kind: str, mention: str) -> str:
    """A form of the mention that the patterns of its kind don't accept."""
    if kind == "email":
        mailbox, domain = mention.split("@", 1)
        return mailbox + [" [at] ", "(at)", " (at) ", "[at]"][rng.integers(4)] + domain
    if kind == "ip":
        return mention.replace(".", ["-", "[.]"][rng.integers(2)])
    d = _digits(mention)
    if kind == "card":
        return ["." , "--", ". "][rng.integers(3)].join(d[i : i + 4] for i in range(0, len(d), 4))
    local = d[-10:] if len(d) > 10 else d
    cut = (local[:-7], local[-7:-4], local[-4:])
    return ["{}-{}-{}", "({}) {}-{}", "{}.{}.{}", "{} {} {}"][rng.integers(4)].format(*cut) if cut[0] else f"{cut[1]}-{cut[2]}"


def _entity(rng: np.random.Generator, kind: str) -> str:
    """An invented mention that the patterns accept."""
    digit = lambda n: "".join(rng.choice(list("0123456789"), n))
    if kind == "email":
        return f"{''.join(rng.choice(list('abcdefghij'), 5))}{rng.integers(1000)}@{''.join(rng.choice(list('klmnopqr'), 6))}.org"
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "phone":
        d = str(rng.integers(2, 10)) + digit(9)
        return [f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"+{rng.integers(20, 99)} {d[:3]} {d[3:6]} {d[6:]}", f"+1{d}"][rng.integers(3)]
    d = "4" + digit(14)
    d += next(str(c) for c in range(10) if luhn(d + str(c)))
    return [d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))][rng.integers(3)]


def _nothing(rng: np.random.Generator) -> str:
    """A candidate that is nothing: a loose form of what isn't mentioned, a number, an aside."""
    kind = KINDS[rng.integers(4)]
    if kind == "email":
        return ["look [at] this", "meet (at) noon", "x@", "home (at) last"][rng.integers(4)]
    if kind != "card" and rng.random() < 0.5:
        return loosened(rng, kind, _entity(rng, kind))
    d = "".join(rng.choice(list("123456789"), 16 if rng.random() < 0.5 else int(rng.integers(7, 18))))
    return d if len(d) < 12 or not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)


def _examples(rng: np.random.Generator, texts: list[str], n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, loose mentions): the texts as they are and with an entity of theirs mentioned again, and n invented ones."""
    out: list[tuple[str, list[tuple[str, int, int]]]] = [(t, []) for t in texts]
    filler = [" of the ", " and then ", " near ", " or ", " with a "]

    def put(parts: list[tuple[str, str | None]]) -> None:
        text, loose = "", []
        for part, kind in parts:
            text += filler[rng.integers(len(filler))]
            if kind:
                loose.append((kind, len(text), len(text) + len(part)))
            text += part
        out.append((text, loose))

    for t in texts:
        base = base_matches(t)
        if base and len(t) < 100_000:
            kind, a, b = base[rng.integers(len(base))]
            part = loosened(rng, kind, t[a:b])
            text = t + filler[rng.integers(len(filler))]
            out.append((text + part, [(kind, len(text), len(text) + len(part))]))
    for _ in range(n):
        parts: list[tuple[str, str | None]] = [(x, None) for _ in range(int(rng.integers(0, 3))) for x in [_nothing(rng)] * int(rng.integers(1, 4))]
        for _ in range(int(rng.integers(0, 4))):
            kind = KINDS[rng.integers(4)]
            mention = _entity(rng, kind)
            parts += [(mention, None)] + [(loosened(rng, kind, mention), kind)] * bool(rng.random() < 0.6)
        if parts:
            put([parts[i] for i in rng.permutation(len(parts))])
    return out


def fit_texts(texts: list[str], seed: int = 7, steps: int = 300, rate: float = 0.5, drop: float = 0.35, penalty: float = 0.0005) -> Model:
    """Weights by gradient ascent on the pseudo-likelihood: each label given its neighbours' labels."""
    rng = np.random.default_rng(seed)
    u, y, source, target, kind, n = [], [], [], [], [], 0
    for text, loose in _examples(rng, texts, 1500):
        found = nodes(text)
        pairs, kinds = edges(found)
        rows = np.zeros((len(found), len(FEATURES)))
        for i, node in enumerate(found):
            rows[i, node.features] = 1
        named = _labels(text, found)
        for i, node in enumerate(found):
            for what, a, b in loose:
                if min(b, node.end) - max(a, node.start) > 0.6 * (node.end - node.start):
                    named[i] = STATES.index(what)
        u.append(rows)
        y.append(named)
        source += [*(pairs[:, 0] + n), *(pairs[:, 1] + n)]
        target += [*(pairs[:, 1] + n), *(pairs[:, 0] + n)]
        kind += [*kinds, *(kinds + 2)]
        n += len(found)
    u, y = np.concatenate(u), np.concatenate(y)
    source, target, kind = (np.array(x, np.int64) for x in (source, target, kind))
    proofs = [_PLACE["luhn"], _PLACE["luhn fails"]]
    m = Model(np.zeros((len(FEATURES), len(STATES))), np.zeros((2, len(STATES), len(STATES))))
    one_hot = np.eye(len(STATES))[y]
    speed_u, speed_p = np.zeros_like(m.unary), np.zeros_like(m.pair)
    for _ in range(steps):
        keep = (rng.random(u.shape) > drop).astype(float)
        keep[:, proofs] = 1  # what says no for certain is always there
        x = u * keep
        tables = np.concatenate([m.pair, m.pair.transpose(0, 2, 1)])  # forwards, backwards
        logit = x @ m.unary
        np.add.at(logit, target, tables[kind, y[source]])
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (one_hot - p) / len(y)
        gradient = np.zeros((4, len(STATES), len(STATES)))
        np.add.at(gradient, (kind, y[source]), miss[target])
        speed_u = 0.9 * speed_u + x.T @ miss - penalty * m.unary
        speed_p = 0.9 * speed_p + gradient[:2] + gradient[2:].transpose(0, 2, 1) - penalty * m.pair
        m.unary += rate * speed_u
        m.pair += rate * speed_p
    return m


def scan(text: str, m: Model, sure: float = 0.6) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans); the field adds a candidate whose label's marginal is `sure` or more and that no base span of the kind touches."""
    base = base_matches(text)
    found = nodes(text)
    spans = list(base)
    if found:
        b = beliefs(m, found)
        by_kind = {kind: [s for s in base if s[0] == kind] for kind in KINDS}
        for node, best, p in zip(found, b.argmax(axis=1), b.max(axis=1)):
            if best and p >= sure and not any(a < node.end and node.start < e for _, a, e in by_kind[STATES[best]]):
                spans.append((STATES[best], node.start, node.end))
    return base, sorted(spans, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


_DIGIT_OR_AT = np.zeros(256, bool)
_DIGIT_OR_AT[[*range(48, 58), 64]] = True


def _suspects(batch: Batch) -> np.ndarray:
    """Texts with a digit, an @ or a spelt one: no others hold a candidate."""
    at = np.searchsorted(batch.offsets, np.flatnonzero(_DIGIT_OR_AT[batch.data]), "right") - 1
    out = np.zeros(batch.n, bool)
    out[at] = True
    raw = batch.data.tobytes()
    for mark in (b"[at]", b"(at)", b"[AT]", b"(AT)"):
        at = raw.find(mark)
        while at >= 0:
            out[np.searchsorted(batch.offsets, at, "right") - 1] = True
            at = raw.find(mark, at + 1)
    return out


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from a bounded sample of the documents that hold a digit or an @."""
    few = bounded(documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")), sample)

    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Batch.of_arrow(batch.column("text"))
        texts = [found.text(i) for i in range(found.n)]
        keep = [i for i, t in enumerate(texts) if nodes(t)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([texts[i] for i in keep], pa.string())], ["doc_id", "text"])

    rows = map_texts(few, around, "doc_id long, text string").where(F.octet_length("text") <= 1_000_000).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = within(rows, 32_000_000)  # a text for each id, bounded in rows and bytes
    return fit_texts([r["text"] for r in sorted(rows.collect(), key=lambda r: r["doc_id"])])


def find(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), code points, end exclusive."""
    sent = documents.sparkSession.sparkContext.broadcast(model or fit(documents))  # a few hundred numbers
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Batch.of_arrow(batch.column("text"))
        base, spans = [[]] * found.n, [[]] * found.n
        for i in np.flatnonzero(_suspects(found)):
            one, all_ = scan(found.text(i), sent.value)
            base[i], spans[i] = ([dict(zip(("kind", "start", "end"), s)) for s in x] for x in (one, all_))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(spans, span)], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return map_texts(documents.select("doc_id", "text"), run, f"doc_id long, base {kind}, spans {kind}")
