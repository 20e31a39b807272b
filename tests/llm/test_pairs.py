"""Operators on pairs and passages against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, jaccard, substring, vectors
from edgeloom.llm.arrays import SPACED, WORDS, Batch
from edgeloom.llm.components import components, forest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def grams(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def closure(ids, links):
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def test_words_match_the_patterns():
    texts = ["", "Éa b-C d 12x", "a", " x", "ÀB　c\x00d", "tab\tnew\nline", "𝔘x_y"]
    batch = Batch.of_strings(texts)
    for kind, pattern in ((WORDS, None), (SPACED, re.compile(r"[^\x20\x09-\x0D]+"))):
        starts, ends, doc = batch.words(kind)
        for i, t in enumerate(texts):
            got = [batch.data[a:b].tobytes().decode() for a, b, d in zip(starts, ends, doc) if d == i]
            want = pattern.findall(t) if pattern else WORD.findall("".join(c if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t.translate({c: c + 32 for c in range(65, 91)})))
            assert [g if pattern else g.translate({c: c + 32 for c in range(65, 91)}) for g in got] == want


def brute_contamination(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for name, text in docs:
        w = words(text)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in wins}:
                if tuple(w[i : i + n]) in wins and i + n <= len(w):
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((name, len(w), len(hit), len(found - {None}), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("rows", [200_000, 0])
def test_decontamination(spark, documents, corpus, empty, monkeypatch, rows):
    """By broadcast tables, and by shuffled joins as for a large benchmark."""
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", rows)
    rng = random.Random(2)
    items = [(i, " ".join(corpus[j][1].split()[:n])) for i, (j, n) in enumerate([(4, 40), (9, 13), (14, 5), (20, 3), (9, 13)])]
    items += [(None, corpus[6][1]), (1, corpus[4][1]), (10, "nowhere to be found at all in any of these many texts here today"), (11, ""), (12, None), (13, corpus[30][1].upper() + "!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[:3] + (r["n_items"], r["items"], r["contaminated"]) for r in decontaminate.contamination(documents, bench).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect())
    want = sorted((n, w, h, c, i, bad) for n, w, h, c, i, bad in brute_contamination([r[:2] for r in corpus], items))
    assert got == want
    assert sum(g[5] for g in got) > 2
    kept = decontaminate.drop_contaminated(documents, bench)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {g[0] for g in got if not g[5]}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(documents, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_native_plan_has_no_python(spark, documents):
    bench = spark.createDataFrame([(1, "ka lo mi ten ra")], "item_id long, text string")
    plan = decontaminate.contamination(documents, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_jaccard_join(documents, corpus, empty):
    sets = {r[0]: grams(r[1]) for r in corpus}
    links = [(a, b) for a in sets for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = closure(sets, links)
    got = {r["doc_id"]: r for r in jaccard.join(documents).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == {k: sum(a == k for a, _ in links) for k in sets}
    assert {k: r["component_id"] for k, r in got.items()} == root
    assert all(r["class_id"] == min(k for k, s in sets.items() if s == sets[r["doc_id"]]) for r in got.values() if sets[r["doc_id"]])
    kept = jaccard.keep_one(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k in root if root[k] == k}
    assert jaccard.join(empty).count() == 0


def test_jaccard_blocks_and_repeats(spark, monkeypatch):
    """A group of near copies larger than a block, with rows that repeat and have no id."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(60)] = f"x{i % 30}"
        rows.append((i, " ".join(w)))
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, "alone " * 9)]
    sets = [grams(t) for _, t in rows]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((n if n is not None else -1, sum(j != i and len(s & o) >= 0.8 * len(s | o) for j, o in enumerate(sets))) for i, ((n, _), s) in enumerate(zip(rows, sets)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_links"]) for r in got) == want


def test_ties_on_long_texts_are_links():
    """Intersection 4m of sizes summing to 9m is exactly 0.8; one n-gram less isn't."""
    for m in (250, 999, 1501, 400_001):
        for less in (0, 1):
            one = np.arange(5 * m, dtype=np.uint64)
            two = one[m + less :]
            members = [{"band": 0, "task": (0, 0), "set": x.tobytes(), "bands": [0], "size": 1, "rep": i, "key": bytes([i])} for i, x in enumerate((one, np.concatenate([two, np.arange(less, dtype=np.uint64) + np.uint64(10**9)])))]
            assert len(jaccard.verify(members, 0.8)) == (0 if less else 2)


def test_bands_reach_their_recall():
    assert jaccard.bands_for(0.8, 0.9999, 4) == 18
    assert 1 - (1 - 0.8**4) ** 18 >= 0.9999


def brute_removed(rows):
    seen, out = {}, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if seen.setdefault(k, (name, i)) != (name, i):
                gone.update(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((name, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_substring(spark, documents, corpus, empty, tmp_path):
    want = sorted_rows(brute_removed([r[:2] for r in corpus]))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted_rows(tuple(r) for r in substring.deduplicate(documents).select(columns).collect()) == want
    assert sum(r[2] for r in want) > 100
    text = substring.deduplicate(documents, with_text=True).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in text) and len(text) == len(want)
    assert substring.deduplicate(empty).count() == 0


def test_index_goes_on_from_its_manifest(spark, documents, corpus, tmp_path, monkeypatch):
    """Every batch by a new object (and without the catalogue's tables), with ranges that split and runs that are joined."""
    monkeypatch.setattr(substring, "RANGE_WINDOWS", 3000)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    parts, folder, ranges = [], str(tmp_path / "index"), []
    for low, high in ((0, 40), (40, 80), (80, 110), (110, 1000)):
        index = substring.FingerprintIndex(spark, folder)
        parts += [tuple(r) for r in index.add(documents.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))).select(columns).collect()]
        ranges.append(index.state["ranges"])
        for x in index.runs:
            spark.sql(f"DROP TABLE edgeloom_run_{x['name']}")
    assert sorted_rows(parts) == sorted_rows(brute_removed([r[:2] for r in corpus]))
    assert ranges[0] < ranges[-1] and len(index.runs) <= 3
    index = substring.FingerprintIndex(spark, folder)
    (tmp_path / "index" / "run-unfinished").mkdir()
    index.compact()
    assert len(index.runs) == 1 and len(list((tmp_path / "index").glob("manifest-*.json"))) == 1
    again = substring.FingerprintIndex(spark, folder).add(documents)
    assert again.agg(F.sum(F.when(F.col("n_words") >= 20, F.col("n_words") - F.col("n_removed")))).first()[0] == 0
    with pytest.raises(ValueError):
        substring.FingerprintIndex(spark, folder, window=7)
    index.drop()
    assert not (tmp_path / "index").exists()


def test_blobs_follow_their_windows(documents, corpus):
    """With hundreds of ranges a window still costs tens of bytes: no blob carries its whole slice's documents."""
    windows = sum(max(0, len((r[1] or "").split()) - 19) for r in corpus)
    for ranges, most in ((1, 16), (300, 40)):
        sent = substring._runs(documents, ranges, 20).where("kind = 1").agg(F.sum(F.octet_length("blob")), F.count("*")).first()
        assert sent[0] < most * windows and sent[1] >= ranges


def test_substring_repeats(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text + " z"), (2, f"{text} {text}")]
    got = sorted_rows(tuple(r) for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r[:3] for r in got] == [(None, 31, 0), (1, 30, 30), (1, 30, 30), (2, 60, 60)]


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[100:160] = x[0] + 0.03 * rng.normal(size=(60, 8))
    x[160:170] = x[1]
    x[170] = 3 * x[1]
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], int(i >= 250)) for i in range(300)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] + [1.0] * 7, 0), (403, rows[1][1], None), (404, [1.0, None] + [0.0] * 6, 0), (405, [], 0), (406, [1.0, 2.0], 0), (407, [1.0, 2.0], 0), (1, rows[1][1], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def sound(v, label):
        return label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))

    near = [[bool(j != i and sound(v, label) and sound(u, m) and m == label and len(u) == len(v) and cosine(v, u) >= 0.98) for j, (_, u, m) in enumerate(rows)] for i, (_, v, label) in enumerate(rows)]
    name = [r[0] if r[0] is not None else -1 for r in rows]
    root = closure(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(len(rows)) if near[i][j]])
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[i][0])
    want = sorted((name[i], sum(near[i]), least[root[i]], name[i] == least[root[i]]) for i in range(len(rows)))
    got = vectors.near_duplicates(df, window=16)
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_double_precision(spark):
    """Sizes that floats or squares can't hold, zeros below zero, ids shared by different vectors, a column of whole numbers."""
    rows = [(1, [1e60, 1e60]), (2, [1e60, 1e60]), (3, [1e-60, 0.0]), (4, [2e-60, -0.0]), (5, [1e300, 0.0]), (6, [1.0, 0.203]), (7, [1.0, 0.2031]), (8, [0.0, 5.0]), (8, [7.0, -7.0]), (9, [0.0, 1e-300])]
    df = spark.createDataFrame([(i, v, "a", 0) for i, v in rows], "vec_id long, embedding array<double>, label string, nid int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 3), (4, 3, 3), (5, 3, 3), (6, 4, 3), (7, 1, 3), (8, 0, 8), (8, 1, 8), (9, 1, 8)]
    ints = spark.createDataFrame([(1, [1, 2], 1), (2, [2, 4], 1), (3, [2, 4], 2)], "vec_id long, embedding array<int>, label int")
    assert sorted((r["vec_id"], r["n_links"]) for r in vectors.near_duplicates(ints).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_bits_that_a_pair_at_the_threshold_keeps():
    apart, rng = vectors.most_apart(), np.random.default_rng(7)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(4000, 32))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    differ = ((x @ vectors.planes(32, 0).T > 0) != (y @ vectors.planes(32, 0).T > 0)).sum(axis=1)
    assert (differ <= apart).all() and 10 < apart < 20


def test_vectors_on_a_tight_cone(spark, monkeypatch):
    """Background cosines near 0.95: every link of 3,000 is found, by full comparison and by passes with bits."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x = np.eye(64)[0] + 0.23 * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[2700:] = x[:300] + 0.19 * (d := rng.normal(size=(300, 64))) / np.linalg.norm(d, axis=1, keepdims=True)
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    want = {(i, int(n)) for i, n in enumerate(near.sum(axis=1))}
    assert near.sum() > 300
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    assert {(r["vec_id"], r["n_links"]) for r in vectors.near_duplicates(df).collect()} == want
    monkeypatch.setattr(vectors, "SMALL", 100)
    monkeypatch.setattr(vectors, "RUN_BLOCK", 500)
    monkeypatch.setattr(vectors, "plan", lambda sample, rows, cosine, recall: (6, vectors.passes_for(6, cosine, recall)))
    assert {(r["vec_id"], r["n_links"]) for r in vectors.near_duplicates(df).collect()} == want


def test_plans_keep_their_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))
    for cone in (0, 5, 30):
        y = x + cone * np.eye(64)[0]
        bits, passes = vectors.plan(y / np.linalg.norm(y, axis=1, keepdims=True), 1_000_000)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** passes <= 1e-4 or bits == 0
    assert vectors.plan(np.eye(3), 1000) == (0, 1)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = closure({x for e in real for x in e}, real)
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert forest(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def thue_morse(n, letters="ab"):
    """Two words of n letters that every polynomial hash modulo a power of two confuses."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    for n in (64, 128, 1024, 2048):
        one, two = thue_morse(n)
        batch = Batch.of_strings([one, two, one.upper()])
        for kind, same in ((WORDS, 2), (SPACED, 3)):
            starts, ends, _ = batch.words(kind)
            assert len(set(batch.word_hashes(kind, starts, ends).tolist())) == same
        tail = " ".join(f"t{i}" for i in range(19))
        docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} x y z w"), (4, f"{two} x y z w")], "doc_id long, text string")
        assert [r["n_removed"] for r in substring.deduplicate(docs).collect()] == [0] * 4
        assert {r["doc_id"]: r["n_links"] for r in jaccard.join(docs).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_hashes_that_meet_are_told_apart(monkeypatch):
    """With a hash that says the same of all words of a length, words and n-grams still come out right."""
    monkeypatch.setattr(Batch, "word_hashes", lambda self, kind, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    batch = Batch.of_strings(["aa bb Aa c bb", "cc aa"])
    starts, ends, _ = batch.words(WORDS)
    first, index = batch.distinct_words(WORDS, starts, ends)
    raw = [batch.data[a:b].tobytes().lower() for a, b in zip(starts, ends)]
    assert [raw[first[i]] for i in index] == raw and len(first) == len(set(raw))
    monkeypatch.setattr(jaccard, "mix", lambda x: x * np.uint64(0))
    texts = ["a b c d e f", "b c d e f g", "f e d c b a", "a b", "b a", "a b c d e f a b c d e"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    got = jaccard.exact_sets(texts)
    for a, s in zip(got, sets):
        assert len(a) == len(s)
        assert [len(set(a.tolist()) & set(b.tolist())) for b in got] == [len(s & t) for t in sets]


def test_one_of_each_group_stays(spark):
    """Rows that repeat, share an id or have none, and columns with the operator's own names."""
    rng = random.Random(12)
    text = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(60)) for _ in range(6)]
    near = text[0] + " tail"
    rows = [(1, text[0]), (1, text[0]), (2, near), (2, text[1]), (5, text[2]), (None, text[2]), (None, text[3]), (None, text[3]), (None, None), (None, None), (7, ""), (7, ""), (8, text[4].upper()), (9, text[4])]
    df = spark.createDataFrame([(a, t, i, "x", 3) for i, (a, t) in enumerate(rows)], "doc_id long, text string, _gone int, _id string, key int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None)
    assert got == sorted([(1, text[0]), (2, text[1]), (5, text[2]), (7, ""), (7, ""), (8, text[4].upper())])
    assert sorted((r["text"] or "") for r in kept.collect() if r["doc_id"] is None) == ["", "", text[3]]
    items = spark.createDataFrame([(1, text[0])], "item_id long, text string")
    rows = [(1, text[0]), (1, text[1]), (None, text[0]), (None, text[2]), (3, None), (4, text[3]), (4, text[3])]
    df = spark.createDataFrame([(a, t, 1, "x") for a, t in rows], "doc_id long, text string, _bad int, _id string")
    left = decontaminate.drop_contaminated(df, items)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted([(1, text[1]), (0, text[2]), (3, ""), (4, text[3]), (4, text[3])])
