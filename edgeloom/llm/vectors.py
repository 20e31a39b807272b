"""Embedding near-duplicates by sorted projection passes.

Exact copies (same label, same vector) become one class first.  In each pass the classes
of a label are put in lexicographic order of concatenated random hyperplane bits, and
each is compared with the next WINDOW in that order.  A run that agrees on a label's first
bits and is longer than the window is compared in full instead, block against block in
separate tasks; shorter runs are never cut by a partition.  So a pair is found in a pass if
it agrees on those bits, however densely the label's vectors lie, and the passes follow
from the bits alone: a pair at the threshold is missed with a chance of 1 - RECALL at most.
The bits are chosen for each label by the cost that angles in a sample of it foretell;
none at all (every pair compared, nothing missed) where that is cheapest.  The sample
decides the cost, never the recall.

Only bits and numbers of classes travel with every pass.  A pass first compares bits: a
class goes on, with its vector, to the comparison of cosines if one in its window differs
in so few of BITS bits as a pair at the threshold does but for a chance of BITS_MISS.

Windows are bounded, groups of near copies aren't: each component is then compared in
full, block against block in separate tasks that report counts only, so a vector's links
inside its component are exact whatever the window.  Cosines are in double precision, of
vectors scaled by their largest component first.

Defined results: a vector that is null, empty, zero or holds null or non-finite numbers,
and any with a null label, links with nothing; vectors of different lengths never link;
rows without an id count as copies of their class, which links only if a row of it has an
id; rows that share an id but not a vector are told apart; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.components import components, forest
from edgeloom.llm.frames import cut

COSINE = 0.98
WINDOW = 128
RECALL = 0.9999
BITS = 60
#: Chance that a pair at the threshold differs in more bits than those that go on to the cosines.
BITS_MISS = 1e-6
BLOCK = 1024
#: Vectors of a block of a long run; two are in a task.
RUN_BLOCK = 4096
#: Labels up to this size are compared in full without a sample; larger ones give about SAMPLE vectors.
SMALL, SAMPLE = 4096, 1000
#: What a vector's part in a pass costs, in comparisons.
ROW_COST = 1000
#: Largest list of long runs that is broadcast; beyond it the vectors are shuffled to it.
BROADCAST_ROWS = 500_000


def passes_for(bits: int, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes by which two vectors at this cosine agree on the first bits of one with probability `recall`."""
    if not bits:
        return 1
    return math.ceil(math.log(1 - recall) / math.log1p(-((1 - math.acos(cosine) / math.pi) ** bits)))


def plan(sample: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, passes) of least cost for a label of `rows` vectors of which these unit ones are a sample."""
    angles = np.arccos(np.clip((sample @ sample.T)[np.triu_indices(len(sample), 1)], -1, 1))
    agree, met = 1 - angles / math.pi, np.ones(len(angles))
    best = (math.inf, 0, 1)
    for bits in range(BITS + 1):
        passes = passes_for(bits, cosine, recall)
        share = met.mean() if len(met) else 1.0
        best = min(best, (passes * (rows * ROW_COST + rows * rows * share), bits, passes))
        met = met * agree
    return best[1:]


def planes(dim: int, number: int, seed: int = 29) -> np.ndarray:
    """The hyperplanes of one pass: BITS x dim."""
    return np.random.default_rng([seed, dim, number]).normal(size=(BITS, dim))


def most_apart(cosine: float = COSINE, miss: float = BITS_MISS) -> int:
    """Bits, of BITS, in which two vectors at this cosine differ at the most but for a chance of `miss`."""
    p, tail = math.acos(min(1.0, cosine)) / math.pi, 1.0
    for k in range(BITS + 1):
        tail -= math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if tail <= miss:
            return k
    return BITS


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near_bits(key: np.ndarray, group: np.ndarray, window: int, apart: int) -> np.ndarray:
    """Whether each of the sorted keys has one of its group up to `window` places away that differs in `apart` bits at the most."""
    out = np.zeros(len(key), bool)
    for k in range(1, min(window, len(key) - 1) + 1):
        near = (np.bitwise_count(key[k:] ^ key[:-k]) <= apart) & (group[k:] == group[:-k])
        out[k:] |= near
        out[:-k] |= near
    return out


def _windows(x: np.ndarray, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows up to `window` apart at the cosine or more."""
    a, b = [], []
    for at in range(0, len(x), window):
        i, j = np.nonzero(x[at : at + window] @ x[at : at + 2 * window].T >= cosine)
        ok = (j > i) & (j - i <= window)
        a.append(i[ok] + at)
        b.append(j[ok] + at)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _star(ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) of the rows that these pairs link."""
    names, place = np.unique(ids, return_inverse=True)
    root = forest(len(names), place[pairs[0]], place[pairs[1]])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


EDGES = "a long, b long"


def _full(x: np.ndarray, ids: np.ndarray, left: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of all pairs at the cosine or more; left: only those across that row, or 0 for all."""
    names, roots = [], []
    right = x[left:] if left else x
    for at in range(0, left or len(x), 512):
        i, j = np.nonzero(x[at : min(at + 512, left or len(x))] @ right.T >= cosine)
        name, root = _star(ids, (i + at, j + left))
        names.append(name)
        roots.append(root)
    return np.concatenate(names), np.concatenate(roots)


def _planned(classes: DataFrame, cosine: float, recall: float) -> DataFrame:
    """The classes with the bits and passes of their label."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("rows")).where(F.col("rows") > SMALL)
    chance = F.lit(SAMPLE) / F.col("rows") * F.lit(1 << 31)
    some = classes.join(F.broadcast(sizes), ["label", "dim"]).where(F.pmod(F.xxhash64(F.lit(11), "nid"), F.lit(1 << 31)) < chance)

    def choose(rows: pa.Table) -> pa.Table:
        bits, passes = plan(_unit(rows.column("v").to_pylist()), rows.column("rows")[0].as_py(), cosine, recall)
        return pa.table({"label": rows.column("label")[:1], "dim": rows.column("dim")[:1], "bits": pa.array([bits], pa.int32()), "passes": pa.array([passes], pa.int32())})

    plans = cut(some.select("label", "dim", "rows", "v").groupBy("label", "dim").applyInArrow(choose, "label string, dim int, bits int, passes int"))
    planned = classes.select("nid", "label", "dim", "v").join(F.broadcast(plans), ["label", "dim"], "left")
    return planned.select("nid", "label", "dim", "v", F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce("passes", F.lit(1)).alias("passes"))


def _parts(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sorted_batches(batches: Iterator[pa.RecordBatch], window: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Pieces of a sorted partition, each with the window before it in front; and how many rows of each were in the last."""
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            both = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            yield both, both.num_rows - part.num_rows
            held = both.slice(max(0, both.num_rows - window))


def _compared(classes: DataFrame, cosine: float, window: int, recall: float) -> DataFrame:
    """Edges (a, b) between classes that connect what the passes found."""
    apart = most_apart(cosine)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                v, dims, passes = part.column("v").to_pylist(), part.column("dim").to_numpy(), part.column("passes").to_numpy()
                for dim in np.unique(dims):
                    x = _unit([v[i] for i in np.flatnonzero(dims == dim)])
                    for p in range(passes[dims == dim].max()):
                        some = np.flatnonzero((dims == dim) & (passes > p))
                        rows = part.take(pa.array(some))
                        bits = (x[passes[dims == dim] > p] @ planes(int(dim), p).T > 0).astype(np.int64)
                        key = bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        run = key >> (BITS - rows.column("bits").to_numpy().astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), p), pa.int32()), rows.column("g"), pa.array(key), pa.array(run), rows.column("nid")], ["p", "g", "key", "run", "nid"])

    parts = _parts(classes)
    planned = _planned(classes, cosine, recall).withColumn("g", F.xxhash64("label", "dim"))  # labels themselves are compared with the vectors
    dealt = cut(planned).mapInArrow(keyed, "p int, g long, key long, run long, nid long")
    long = cut(dealt.groupBy("p", "g", "run").agg(F.count("*").alias("n")).where(F.col("n") > window))
    few = long.count() <= BROADCAST_ROWS
    long = long.select("p", "g", "run", F.ceil(F.col("n") / RUN_BLOCK).cast("int").alias("blocks"))
    long = F.broadcast(long) if few else long
    short = dealt.join(long, ["p", "g", "run"], "left_anti")
    in_runs = lambda df: df.repartitionByRange(parts, "p", "g", "run").sortWithinPartitions("p", "g", "key", "nid")  # noqa: E731  whole runs

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, old in _sorted_batches(batches, window):
            p, g, key = (rows.column(c).to_numpy() for c in ("p", "g", "key"))
            keep = _near_bits(key, g * 1_000_003 + p, window, apart)
            if keep.any():  # rows of the window before may come again; they are made distinct below
                yield rows.filter(pa.array(keep))

    near = in_runs(short.select("p", "g", "key", "run", "nid")).mapInArrow(by_bits, "p int, g long, key long, run long, nid long").distinct()
    vectors = classes.select("nid", "label", "v")

    def by_cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _sorted_batches(batches, window):
            p, ids, v, label = rows.column("p").to_numpy(), rows.column("nid").to_numpy(), rows.column("v").to_pylist(), rows.column("label").to_pylist()
            places: dict[tuple, list[int]] = {}
            for i, x in enumerate(zip(p.tolist(), label, map(len, v))):
                places.setdefault(x, []).append(i)
            for some in places.values():
                a, b = _star(ids[some], _windows(_unit([v[i] for i in some]), window, cosine))
                if len(a):
                    yield _edges(a, b)

    found = in_runs(near.join(vectors, "nid")).mapInArrow(by_cosine, EDGES)
    tasks = dealt.join(long, ["p", "g", "run"]).withColumn("block", F.pmod(F.xxhash64("nid", F.lit(5)), F.col("blocks")).cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(vectors, "nid")
    tasks = tasks.select("p", "g", "label", "run", "nid", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        block, i, j = rows.column("block").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left = 0 if i == j else int((block == i).sum())
        if i != j and left in (0, len(block)):
            return pa.Table.from_batches([_edges(np.zeros(0, np.int64), np.zeros(0, np.int64))])
        v = rows.column("v").to_pylist()
        return pa.Table.from_batches([_edges(*_full(_unit(v), rows.column("nid").to_numpy(), left, cosine))])

    names = ("p", "g", "label", "run", "i", "j")
    runs = tasks.repartition(parts, *names).groupBy(*names).applyInArrow(whole, EDGES)
    return found.unionByName(runs)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    inner = getattr(embeddings.schema["embedding"].dataType, "elementType", None)
    kind = "float" if inner is not None and inner.simpleString() == "float" else "double"
    v = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind))  # no zeros below zero
    sound = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("size"))
    classes = cut(classes.withColumn("dim", F.size("v")).withColumn("nid", F.monotonically_increasing_id()))
    able = classes.where("cid is not null")
    reached = components(_compared(able, cosine, window, recall))

    members = cut(able.select("nid", "cid", "size", "v").join(reached, F.col("nid") == F.col("node")))
    blocks = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("cid").alias("least"))
    block = F.pmod(F.xxhash64("nid", F.lit(7)), F.col("blocks")).cast("int")
    tasks = members.join(blocks, "component").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("component", "nid", "size", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def count(rows: pa.Table) -> pa.Table:
        x = _unit(rows.column("v").to_pylist())
        ids, size, block = (rows.column(c).to_numpy() for c in ("nid", "size", "block"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if i != j:
            near &= (block == i)[:, None] != (block == i)
        links = near @ size
        some = np.flatnonzero(links)
        return pa.table({"nid": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64())})

    tasks = tasks.repartition(_parts(tasks), "component", "i", "j")  # else all of a component's tasks are one
    links = tasks.groupBy("component", "i", "j").applyInArrow(count, "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links"))
    least = members.select("nid", "component").join(blocks.select("component", "least"), "component").select("nid", "least")
    about = classes.join(links, "nid", "left").join(least, "nid", "left")
    hashes = (F.xxhash64("v").alias("one"), F.xxhash64(F.lit(3), "v").alias("two"))
    about = cut(about.select("label", *hashes, "v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "cid").alias("component_id")))
    keys = ["label", "one", "two"]
    if about.groupBy(*keys).count().where("count > 1").take(1):  # two vectors share both hashes
        keys = ["label", "v"]
    wanted = rows.select("vec_id", F.when(F.col("sound"), F.col("label")).alias("label"), *hashes, *([] if "one" in keys else ["v"]))
    out = wanted.join(about.select(*keys, "n_links", "component_id"), keys, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
