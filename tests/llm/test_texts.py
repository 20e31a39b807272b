"""Operators on single texts: exact patterns, round trips, held-out accuracy."""

import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import frames, langid, packing, pii, quality, secrets, toxicity
from edgeloom.llm.arrays import Batch
from edgeloom.llm.queries import tokenizer_path

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def noise(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_pii_base_is_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        t = noise(rng, "a1.@ +-(05é\n", rng.randrange(60))
        digits = lambda s: re.sub("[^0-9]", "", s)
        want = [("email", *m.span()) for m in EMAIL.finditer(t)]
        want += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        assert pii.base_matches(t) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_skip_edges_carry_labels():
    m = pii.fit_texts([])
    text = "ring +1 (415) 555-2671 at noon or else 415-555-2671 at night; code 1234567"
    base, spans = pii.scan(text, m)
    assert base == [("phone", 5, 22)]
    assert [(k, text[a:b]) for k, a, b in spans] == [("phone", "+1 (415) 555-2671"), ("phone", "415-555-2671")]
    alone, spans = pii.scan("only 415-555-2671 here", m)
    assert not spans
    text = "jo.doe@ex.org and jo.doe [at] ex.org"
    assert [(k, text[a:b]) for k, a, b in pii.scan(text, m)[1]] == [("email", "jo.doe@ex.org"), ("email", "jo.doe [at] ex.org")]
    assert pii.scan("", m) == ([], [])


def test_loose_mentions_are_found_and_nothing_else(spark):
    """Planted loose mentions of every kind, with look-alikes of nothing known between them."""
    rng, model, words = np.random.default_rng(21), pii.fit_texts([]), "lorem ipsum dolor sit amet elit sed do".split()
    hit, added, planted = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    for i in range(400):
        kind = pii.KINDS[i % 4]
        mention = pii._entity(rng, kind)
        parts = [(mention, 0), (pii.loosened(rng, kind, mention), 1), ("-".join(map(str, rng.integers(100, 999, 3))) + "0", 0), (str(rng.integers(10**8, 10**12)), 0)]
        text, want = "", set()
        for j in rng.permutation(len(parts)):
            text += " ".join(rng.choice(words, 6)) + " "
            if parts[j][1]:
                want.add((kind, len(text), len(text) + len(parts[j][0])))
            text += parts[j][0] + " "
        base, spans = pii.scan(text, model)
        new = set(spans) - set(base)
        planted[kind] += len(want - set(base))
        hit[kind] += len(new & (want - set(base)))
        for s in new:
            added[s[0]] += 1
    for kind in pii.KINDS:
        assert hit[kind] >= 0.8 * planted[kind] > 0, (kind, hit, planted)
        assert hit[kind] >= 0.95 * added[kind], (kind, hit, added)


def test_beliefs_are_exact_on_a_tree():
    """Without loops, message passing gives the marginals that enumeration gives."""
    m = pii.fit_texts([])
    found = pii.nodes("call +1 (415) 555-2671 then 10.0.0.1234567 and a@b.cd")
    pairs, kinds = pii.edges(found)
    assert len(found) == 3 and not kinds.any()
    unary = pii._score(m, found)
    total = np.zeros((3, 5))
    for s in np.ndindex(5, 5, 5):
        p = np.exp(sum(unary[i, s[i]] for i in range(3)) + sum(m.pair[0][s[a], s[b]] for a, b in pairs))
        for i in range(3):
            total[i, s[i]] += p
    assert np.allclose(pii.beliefs(m, found), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_pii_and_secrets_on_tables(documents, corpus, empty):
    for op in (pii, secrets):
        rows = op.find(documents).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in corpus)
        assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in rows)
        assert op.find(empty).count() == 0


def test_long_hostile_texts_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "%4" + "a" * 300_000 + "%zz", "\\u" + "b" * 300_000, "token" + " " * 300_000):
        pii.base_matches(t)
        secrets.scan(t)


def test_secret_base_is_the_plain_patterns():
    rng = random.Random(2)
    for _ in range(2000):
        t = " ".join(rng.choice(["token", "API_key", "=", ":", '"', "secret:", "abcdefghij", "AKIA", "AKIA0123456789ABCD", noise(rng, "0123456789abcdef", 34), "x", "password='hunter2hunter'"]) for _ in range(rng.randrange(8))).replace(" = ", rng.choice(["=", " = "]))
        want = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in HEX.finditer(t) if len(m[0]) >= 32]
        assert secrets.base_matches(t) == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


@pytest.mark.parametrize("how", [["base64"], ["url"], ["unicode"], ["zlib", "base64"], ["gzip", "base64"], ["base64", "url"], ["base64", "base64", "unicode", "base64"], ["gzip", "base64", "zlib", "base64"], ["entity"], ["base64", "entity"], ["base64", "wide"]])
def test_nested_layers_are_unwrapped(how):
    """The span holds the secret's own characters: all that a layer of its prefix or suffix alone doesn't need."""
    hidden = 'api_key = "abcd1234efgh5678"'
    wrapped = secrets.encode(hidden, how)
    text = f"Été {wrapped} fin"
    assert not [s for s in secrets.base_matches(text) if s[0] == "assign"]
    base, spans = secrets.scan(text)
    a, b = next((a, b) for k, a, b in spans if k == "assign")
    assert a == 4 and 4 + len(wrapped) * (len(hidden) - 3) / len(hidden) - 24 <= b <= 4 + len(wrapped)
    if "zlib" in how or "gzip" in how:
        assert b >= 4 + len(wrapped.rstrip("="))
    assert secrets.masked(text, spans).startswith("Été [SECRET]") and secrets.masked(text, spans).endswith(" fin")
    assert secrets._suspects(Batch.of_strings([text])).all()


def test_spans_are_those_of_the_secret_alone():
    import base64

    secret = "token=abcdef1234567890"
    url = "https://x.io/a%20b?n=%E9&" + "".join(f"%{c:02x}" for c in secret.encode()) + "&z=%C3%A9t"
    assert [url[a:b] for _, a, b in secrets.scan(url)[1]] == ["".join(f"%{c:02x}" for c in secret.encode())]
    assert [url_[a:b] for url_ in ["https://x.io/?n=%E9&token%3Dabcdef1234567890"] for _, a, b in secrets.scan(url_)[1]] == ["token%3Dabcdef1234567890"]
    for before in range(30, 36):
        blob = base64.b64encode(b"x" * before + b" " + secret.encode() + b" " + b"y" * 30).decode()
        (a, b), = {(a, b) for _, a, b in secrets.scan(f"é {blob} e")[1]}
        assert a == 2 + (before + 1) * 8 // 6 and b == 2 + ((before + 1 + len(secret)) * 8 - 1) // 6 + 1
    text = "\\u00e9 \\ud83d\\ude00" + "".join(f"\\u{ord(c):04x}" for c in secret) + " é"
    assert [text[a:b] for _, a, b in secrets.scan(text)[1]] == ["".join(f"\\u{ord(c):04x}" for c in secret)]


def test_bytes_of_every_run_are_unwrapped():
    import base64
    import gzip

    hidden = b'note: api_key = "abcd1234efgh5678"?>~ and more'
    wide = hidden.decode().encode("utf-16-le")
    url = lambda raw: "".join(f"%{c:02X}" for c in raw)
    slash = lambda raw: "".join(f"\\x{c:02x}" for c in raw)
    blob = lambda raw: base64.b64encode(raw).decode()
    packed = [zlib.compress(hidden), gzip.compress(hidden, mtime=0), zlib.compress(wide), gzip.compress(zlib.compress(hidden), mtime=0), gzip.compress(b"first ", mtime=0) + gzip.compress(hidden, mtime=0)]
    for run in [url(p) for p in packed] + [slash(p) for p in packed] + [blob(wide), blob(b"caf\xe9 " + hidden), url(blob(packed[0]).encode())]:
        found = [(a, b) for k, a, b in secrets.scan(f"a {run} b")[1] if k == "assign"]
        assert found and all(2 <= a < b <= 2 + len(run) for a, b in found), run
    for raw in (hidden, *packed):
        for run in (blob(raw), base64.urlsafe_b64encode(raw).decode()):
            for before in ("x.org/dl/", "x.org/a-b/", "x.org/abc/"):
                text = f"{before}{run} b"
                out = secrets.masked(text, secrets.scan(text)[1])
                assert out.startswith(before) and "[SECRET]" in out and out.endswith(" b"), text
                if raw in packed[:4]:
                    assert out == f"{before}[SECRET] b", text
            assert secrets.scan(f"x.org/dl/{run.rstrip('=')}/file.txt")[1], run


def test_streams_of_any_size_are_scanned(monkeypatch):
    """Piece by piece, a secret on the boundary included; what goes beyond the budget is named."""
    import base64

    monkeypatch.setattr(secrets, "PIECE", 10_000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    for before in (0, 9_980, 9_990, 25_000):
        raw = b"a " * (before // 2) + b"token=abcdef1234567890 " + b"b " * 20_000
        run = base64.b64encode(zlib.compress(raw)).decode()
        assert ("assign", 1, 1 + len(run)) in secrets.scan(f" {run} ")[1]
    run = base64.b64encode(zlib.compress(b"0" * 500_000)).decode()
    base, spans = secrets.scan(f"x {run} y token=abcdef1234567890", most=100_000)
    assert [s[0] for s in base] == ["assign"] and [s[0] for s in spans if s not in base] == ["bomb"]


def test_base64_over_lines():
    import base64

    hidden = base64.encodebytes(b"x " * 60 + b'password: "correct-horse"').decode().strip()
    text = f"a\n{hidden}\nb"
    (a, b), = {(a, b) for k, a, b in secrets.scan(text)[1]}
    assert text[a:b].replace("\n", "") in hidden.replace("\n", "") and b <= 2 + len(hidden) and a > 140
    assert secrets.scan("\\u{1F600} \\U00000041 \\xff &#x41; &#9999999;")[0] == []


def test_redaction_keeps_the_rest(spark):
    rows = [(1, 'a token = "0123456789abcdef" b', 30, "k"), (2, None, None, "k"), (3, "plain", 5, None)]
    out = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string"))
    assert out.columns == ["doc_id", "text", "n_chars", "spans"]
    assert sorted(tuple(r) for r in out.collect())[0] == (1, 'a [SECRET]" b', 13, "k")


def morse(n, flip):
    """A Thue-Morse word: with its complement it confuses polynomial hashes."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_ids_are_the_tokenizers():
    rng = random.Random(3)
    encoder, whole = packing.Encoder(tokenizer_path()), packing._tokenizer(tokenizer_path())
    texts = ["", " \n ", "It's ÉCOLE, (ñandú) «x» ½² x_y don't é é<|endoftext|>b", "Σίσυφος ΟΔΟΣ İstanbul ǅ ﬁ 你好 \x00\x1c\x85", *(f"{morse(n, 0)} {morse(n, 1)}" for n in (64, 512, 1024, 2048)), *(noise(rng, "abÉ9 .,'\"%ß́Ω\n", 80) for _ in range(300))]
    ids, offsets = encoder.encode(Batch.of_strings(texts))
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids + [packing.END_ID]


def test_first_fit_decreasing():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 2049, 700)
    got, bins = packing.pack(sizes), []
    for i in np.argsort(-sizes, kind="stable"):
        where = next((k for k, used in enumerate(bins) if used + sizes[i] <= 2048), len(bins))
        if where == len(bins):
            bins.append(0)
        assert got[i] == (where, bins[where])
        bins[where] += sizes[i]
    assert packing.pack(np.zeros(0, np.int64)) == []


def test_packing_round_trip(documents, corpus, empty):
    rows = packing.pack_documents(documents, tokenizer_path(), group=50).collect()
    whole = packing._tokenizer(tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for name, text, *_ in corpus:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for r in sorted(by_doc[name], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def folds(rows, n, k):
    return {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % n == k}


def test_quality(documents, labels, corpus, empty):
    rows = quality.classify(documents, labels).collect()
    truth = {r[0]: r[3] for r in corpus}
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == folds(rows, 5, 0)
    known = [r for r in held if truth[r["doc_id"]] is not None]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in known) >= 0.9 * len(known)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(documents, labels.limit(0)).collect()} == {0.5}


def test_language(documents, corpus, empty):
    rows = langid.identify(documents).collect()
    truth = {r[0]: r[2] for r in corpus}
    assert {r["doc_id"] for r in rows if r["held_out"]} == folds(rows, 4, 2)
    named = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [named[i] for i in (300, 301, 302)] == ["und"] * 3
    known = [r for r in rows if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in known) >= 0.95 * len(known)
    assert langid.identify(empty).count() == 0
    assert langid.has_letter("1é") and not langid.has_letter("1²_ ")


def test_language_counts_are_plain_bayes(spark, monkeypatch):
    """Posteriors from n-gram counts by the book; ties, nothing learnt, and a matrix that has to be small."""
    rows = [(0, "abab Ab", "x"), (1, "bcbc", "y"), (2, "abc", "x"), (3, "cab", None), (4, None, "y"), (None, "zz", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.names == ["x", "y"] and np.allclose(np.exp(model.prior), [2 / 3, 1 / 3])

    def buckets(text):
        return [b for bucket, _ in langid._buckets(Batch.of_strings([text])) for b in bucket.tolist()]

    counts = {x: np.full(1 << langid.BITS, 0.05) for x in "xy"}
    for _, text, lang in rows[:3]:
        for b in buckets(text):
            counts[lang][b] += 1
    for text in ("abcb", "zz", "cab ab"):
        logs = [math.log(p) + sum(math.log(counts[x][b] / counts[x].sum()) for b in buckets(text)) for x, p in (("x", 2 / 3), ("y", 1 / 3))]
        got = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        assert got["lang_pred"] == "xy"[int(np.argmax(logs))]
        assert abs(got["score"] - 1 / sum(math.exp(v - max(logs)) for v in logs)) < 1e-4
    even = spark.createDataFrame([(0, "ab", "q"), (1, "ab", "p")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(even, langid.fit(even)).collect()} == {"p"}
    nothing = langid.predict(docs, langid.fit(docs.where("lang is null"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    monkeypatch.setattr(langid, "CELLS", 9)
    small = langid.fit(docs)
    assert small.matrix.shape == (256, 2) and langid.predict(docs, small).where("doc_id = 0").first()["lang_pred"] == "x"


def test_rows_without_ids_and_rows_that_repeat(spark, documents, labels):
    """Every operator on texts gives a row (packing: pieces) for each row, whatever its id, and the same for the same text."""
    few = documents.where("doc_id < 40 or doc_id >= 300")
    twice = few.unionByName(few).unionByName(few.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    n = twice.count()
    for op in (lambda d: pii.find(d, pii.fit_texts([])), secrets.find, lambda d: quality.classify(d, labels), langid.identify, lambda d: toxicity.classify(d, labels)):
        rows = op(twice).collect()
        assert len(rows) == n
        by_id = {}
        for r in rows:
            if r["doc_id"] is not None:
                by_id.setdefault(r["doc_id"], set()).add(str(r))
        assert all(len(v) == 1 for v in by_id.values())
    pieces = packing.pack_documents(twice, tokenizer_path()).collect()
    assert sum(r["start"] == 0 for r in pieces) == n
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)


def test_toxicity(documents, labels, corpus, empty):
    rows = toxicity.classify(documents, labels).collect()
    truth = {r[0]: r[4] for r in corpus}
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]] is not None]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.85 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == len(corpus)
    assert toxicity.classify(empty, labels).count() == 0


def test_scores_are_a_plain_networks():
    """Every gate and weight, word by word in plain Python."""
    rng = np.random.default_rng(1)
    words = toxicity.Words(Batch.of_strings(["a bad cat sat on ab mats", "the dog", ""]), np.zeros(0, np.uint64))
    p = toxicity._initial(0, rng)
    doc, first, length = toxicity.windows(words.counts)
    g = words.grid(doc, first, length)
    got = toxicity.logits(toxicity.Model(np.zeros(0, np.uint64), p), words, g)
    x, h, sig = words.inputs(p), toxicity.HIDDEN, lambda v: 1 / (1 + math.exp(-v))
    for k, n in enumerate(length):
        states = {}
        for s in "fb":
            state, states[s] = [0.0] * h, {}
            for t in range(n) if s == "f" else range(n - 1, -1, -1):
                i = x[g[k, t]] @ p[f"W{s}"] + p[f"c{s}"]
                u = p[f"U{s}"]
                r = [sig(i[j] + sum(state[q] * u[q, j] for q in range(h))) for j in range(h)]
                z = [sig(i[h + j] + sum(state[q] * u[q, h + j] for q in range(h))) for j in range(h)]
                c = [math.tanh(i[2 * h + j] + sum(r[q] * state[q] * u[q, 2 * h + j] for q in range(h))) for j in range(h)]
                state = [(1 - z[j]) * state[j] + z[j] * c[j] for j in range(h)]
                states[s][t] = state
        weight = [math.exp(sum(states[s][t][j] * p[f"a{s}"][j] for s in "fb" for j in range(h))) for t in range(n)]
        pooled = [sum(w * states[s][t][j] for t, w in enumerate(weight)) / sum(weight) if n else 0.0 for s in "fb" for j in range(h)]
        assert abs(got[k] - (sum(a * b for a, b in zip(pooled, p["out"])) + p["bias"][0])) < 1e-4


def test_toxic_words_of_rare_languages_are_learnt():
    """Telling words in a few documents of a language that is itself rare: recall by language, and no false alarms."""
    rng = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi", "ten", "ra", "su"], "bb": ["schu", "ger", "ick", "ung", "zol", "tra"], "cc": ["oux", "eau", "ell", "ant", "pri", "gne"]}
    bad = {x: ["".join(rng.choice(s) for _ in range(4)) + "x" for _ in range(8)] for x, s in syllables.items()}
    texts, toxic, lang = [], [], []
    for i in range(1400):
        x = "aa" if i % 10 < 6 else "bb" if i % 10 < 8 else "cc"
        w = ["".join(rng.choice(syllables[x]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        if i % 6 == 1:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad[x])
        texts.append(" ".join(w))
        toxic.append(int(i % 6 == 1))
        lang.append(x)
    toxic = np.array(toxic)
    m = toxicity.fit_texts(texts[:1000], toxic[:1000])
    found = toxicity.score_batch(m, Batch.of_strings(texts[1000:])) >= 0.5
    for x in syllables:
        of = [i for i in range(400) if lang[1000 + i] == x and toxic[1000 + i]]
        assert sum(found[i] for i in of) >= 0.8 * len(of), x
    assert found[toxic[1000:] == 0].sum() <= 0.1 * found.sum()
    one = toxicity.fit_texts(["a b", "c"], np.array([1, 1]))
    assert toxicity.score_batch(one, Batch.of_strings(["", "x y"])).tolist() == [1.0, 1.0]
    assert toxicity.fit_texts([], np.zeros(0, np.int64)).constant == 0.5


def test_descent_reaches_the_dense_optimum():
    """The dual's objective against projected gradient on a dense matrix."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(60)]
    values = [rng.normal(size=6) for _ in rows]
    y = np.where(np.array([v.sum() for v in values]) + rng.normal(size=60) > 0, 1.0, -1.0)
    w, bias = quality.dual_coordinate_descent(rows, values, y, cost=0.5, epochs=400)
    x = np.zeros((60, 41))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, 40] = v, 1.0
    q, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(60)
    for _ in range(20000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, 0.5)
    dense = (x * y[:, None]).T @ alpha
    primal = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    assert abs(primal(np.concatenate([w[:40], [bias]])) - primal(dense)) < 1e-3 * primal(dense)
    counts = quality.log_count_ratio([np.array([1, 2]), np.array([2, 3])], np.array([1.0, -1.0]))
    size = 1 << quality.BITS
    assert np.allclose(counts[[1, 2, 3, 4]], [math.log(2), 0, -math.log(2), 0]) and len(counts) == size


def test_one_text_for_an_id_teaches(spark):
    rows = [(1, "a b")] * 50 + [(2, "c " * 100), (2, "d"), (None, "e"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, y int")
    got = frames.taught(docs, known).collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(1, 1), (2, 0), (3, 1)]
    assert [r["doc_id"] for r in frames.taught(docs, known, most_bytes=80).collect() if len(r["text"]) > 10] == []


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    words = toxicity.Words(Batch.of_strings(["a bad cat sat on ab mats", "the dog", "x " * 40]), np.zeros(0, np.uint64))
    p = {k: v.astype(np.float64) for k, v in toxicity._initial(0, rng).items()}
    doc, first, length = toxicity.windows(words.counts)
    g, y = words.grid(doc, first, length), np.array([1.0, 0.0, 1.0, 0.0])[: len(doc)]

    def loss(q):
        m = toxicity.Model(np.zeros(0, np.uint64), q)
        z = toxicity.logits(m, words, g).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grad = toxicity._gradient(p, words, g, y)
    for k in ("out", "af", "Uf", "Wb", "cb", "word", "char"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grad[k][at]) < 2e-2 * max(0.05, abs(grad[k][at]))


def test_windows_cover_every_word():
    doc, first, length = toxicity.windows(np.array([0, 1, 32, 33, 500]))
    for d, n in enumerate([0, 1, 32, 33, 500]):
        covered = set()
        for a, b in zip(first[doc == d], length[doc == d]):
            covered.update(range(a, a + b))
        assert covered == set(range(n))


def test_registered_names():
    from edgeloom.llm import queries

    names = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names) and json.dumps(queries.oracle_sql())
