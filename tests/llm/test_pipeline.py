"""The corpus pipeline, stage after stage, against plain Python."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from edgeloom.llm import packing, quality, secrets
from edgeloom.llm.arrays import Batch
from edgeloom.llm.queries import tokenizer_path
from edgeloom.plans.lineage import shared_folder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    """Documents with nulls, empties, repeats, shared ids and columns with the stages' own names; labels and a benchmark."""
    rng = random.Random(31)
    rows = [(r[0], r[1], r[2]) for r in corpus]
    clean = next(r[1] for r in corpus if r[3] == 1 and 60 <= len(r[1].split()) < 200)
    bench = " ".join(f"{rng.choice('klmn')}{rng.choice('aeiou')}{i}" for i in range(26))
    rows += [(500, f"{clean} {clean[::-1]} token=abcdef1234567890 end", "aa"), (501, bench, "aa"), (500, bench + " lo", "aa"), (None, bench, "aa")]
    rows += [(None, clean + " ka", "aa"), (None, clean + " ka", "aa"), (502, rows[1][1], "bb"), (502, rows[1][1], "bb"), (1, "lo mi ka ra ten " * 30, "aa")]
    folder = tmp_path_factory.mktemp("sf")
    data = [(a, b, c, "s", len(b or ""), "x", 1, 2) for a, b, c in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, key string, _gone int, score int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], r[3], r[4]) for r in corpus if r[3] is not None] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, bench


def after(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)


def linked(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words(a), words(b))]
    return bool(sets[0] and sets[1]) and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def brute_one_of_each(rows):
    """Of every group that links connect the row of the smallest id (those without one last); rows alike in both count once."""
    from hashlib import md5

    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i][1], rows[j][1]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for g in set(group):
        some = [r for r, h in zip(rows, group) if h == g]
        with_id = [r for r in some if r[0] is not None]
        out += [min(with_id, key=lambda r: (r[0], md5(r[1].encode()).digest()))] if with_id and words(with_id[0][1]) else some[:1] if words(some[0][1]) else some
    return out


def brute_clean(rows, bench):
    wins = {tuple(words(bench)[i : i + 13]) for i in range(len(words(bench)) - 12)}
    out = []
    for name, text in rows:
        w = words(text)
        hit = {k for i in range(len(w) - 12) if tuple(w[i : i + 13]) in wins for k in range(i, i + 13)}
        if not hit or 20 * len(hit) < len(w):
            out.append((name, text))
    return out


def test_stages_against_plain_python(spark, tables):
    sf_dir, rows, bench = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = []
    for name, text, _ in rows:
        keys, doc = quality.features(Batch.of_strings([text]))
        norm = np.sqrt(model.ratio2[keys].sum(dtype=np.float64))
        margin = model.weight[keys].sum(dtype=np.float64) / max(norm, 1e-9) + model.bias
        if 1 / (1 + np.exp(-(model.slope * margin + model.shift))) >= 0.3:
            good.append((name, text))
    want = [good, brute_one_of_each(good)]
    want.append(brute_clean(want[1], bench))
    want.append([(n, t if t is None else secrets.masked(t, secrets.scan(t)[1])) for n, t in want[2]])
    assert len({len(w) for w in want[:3]}) == 3 and want[3] != want[2]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        assert after(docs) == sorted(expected, key=str), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    whole = packing._tokenizer(tokenizer_path())
    lengths = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in want[3])
    assert sorted(r["doc_tokens"] for r in pieces if r["start"] == 0) == lengths
    key = lambda r: (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, pieces))
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in want[3]]
    assert sorted(r["ids_crc32"] for r in pieces) == sorted(zlib.crc32(x[a : a + 2048].tobytes()) for x in ids for a in range(0, len(x), 2048))


def test_a_named_run_goes_on_where_it_ended(spark, tables, monkeypatch):
    sf_dir, calls = tables[0], []

    def counted(name, stage):
        def run(*args):
            calls.append(name)
            if name == "benchmark" and calls.count(name) == 1:
                raise RuntimeError("lost")
            return stage(*args)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in corpus_pipeline.STAGES])
    spark.conf.set("spark.edgeloom.pipeline.run", "test-run")
    try:
        with pytest.raises(RuntimeError):
            corpus_pipeline.run(spark, sf_dir)
        n = corpus_pipeline.run(spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.edgeloom.pipeline.run")
    assert calls == ["quality", "near_copies", "benchmark", "benchmark", "secrets", "packing"]
    assert n == corpus_pipeline.run(spark, sf_dir).count() > 0
    assert shared_folder(spark)


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
