"""Shortest paths, reachability and negative cycles as iterated joins.

Each round joins the nodes that changed (the frontier) with their out-edges and keeps the
least distance for each target by a pre-aggregated minimum; only that is shuffled.  What is
known stays where it is, dealt by node like the edges by source: a base, and a few deltas
of the rounds since, merged now and then.  A round writes its delta alone, and what a merge
supersedes is deleted.

Graphs of up to local.EDGES edges are solved in one task instead if `plan` is "auto", as a
round costs a second whatever the graph's size; "joins" and "local" name one way.  Results
are the same, and the registered queries check both.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.graph import Graph
from edgeloom.operators import local
from edgeloom.plans.lineage import cut, discard

#: Deltas that are kept beside the base before they are merged into it.
DELTAS = 6
#: Rows of distances up to which all pairs are solved in one task.
LOCAL_ROWS = 4_000_000


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _prepared(edges: DataFrame) -> DataFrame:
    """Edges dealt by source once, parallel ones reduced to the lightest, for all rounds."""
    return cut(edges.groupBy("src", "dst").agg(F.min("w").alias("w")).repartition(_parts(edges), "src"), dealt=["src"])


def relax(start: DataFrame, edges: DataFrame, keys: list[str] = [], bound: float | None = None, strict: bool = False, rounds: int | None = None, target: tuple[int, float] | None = None, cycles: bool = False) -> tuple[DataFrame, bool]:
    """(least distances, whether they settled) from `start` (keys..., v, dist) along prepared edges.

    rounds: stop after so many; target: stop once it is closer than that.  cycles: look every
    doubled number of rounds whether the predecessors form a cycle, which means a negative one,
    so that it is found long before as many rounds as there are nodes.
    """
    names, parts = [*keys, "v"], _parts(start)
    best = lambda df: df.groupBy(*names).agg(F.min(F.struct("dist", "pred")).alias("b")).select(*names, "b.dist", "b.pred").repartition(parts, *names)
    base = cut(best(start.select(*names, "dist", F.lit(None).cast("bigint").alias("pred"))), dealt=names)
    frontier, deltas, settled, i = base, [], not base.take(1), 0

    def merged() -> DataFrame:
        out = base
        for d in deltas:
            out = out.unionByName(d)
        return cut(best(out), dealt=names)

    while not settled and (rounds is None or i < rounds):
        step = frontier.join(edges, F.col("v") == F.col("src")).select(*keys, F.col("dst").alias("v"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("pred"))
        if bound is not None:
            step = step.where(F.col("dist") < bound if strict else F.col("dist") <= bound)
        found = step.groupBy(*names).agg(F.min(F.struct("dist", "pred")).alias("b")).select(*names, "b.dist", "b.pred")
        for k, known in enumerate([base, *deltas]):
            found = found.join(known.select(*names, F.col("dist").alias(f"_had{k}")), names, "left")
        had = F.least(F.col("_had0"), *[F.col(f"_had{k}") for k in range(len(deltas) + 1)])
        frontier = cut(found.where(had.isNull() | (F.col("dist") < had)).select(*names, "dist", "pred").repartition(parts, *names), dealt=names)
        deltas.append(frontier)
        settled, i = not frontier.take(1), i + 1
        if target and frontier.where((F.col("v") == target[0]) & (F.col("dist") < target[1])).take(1):
            break
        look = cycles and i >= 8 and not i & (i - 1)
        if len(deltas) > DELTAS or look:
            old, last = [base, *deltas[:-1]], deltas[-1]
            base, deltas = merged(), []
            discard(*old)
            if frontier is not last:
                discard(last)
        if look and not settled and rootless(base.select("v", F.col("pred"))).take(1):
            break
    out = merged() if deltas else base
    discard(*deltas, *([base] if deltas else []))
    return out.select(*names, "dist"), settled


def is_small(g: Graph, plan: str) -> bool:
    if plan not in ("auto", "joins", "local"):
        raise ValueError(f"unknown plan {plan}")
    return plan == "local" or plan == "auto" and g.edges.count() <= local.EDGES


def _from(g: Graph, start: DataFrame, keys: list[str] = [], edges: DataFrame | None = None, **how) -> tuple[DataFrame, bool]:
    """relax() along the graph's edges, which are deleted afterwards."""
    edges = _prepared(g.edges if edges is None else edges)
    out = relax(start, edges, keys, **how)
    discard(edges)
    return out


def _settled(g: Graph, mark: Column, keep_bound: float | None = None, by_source: bool = False) -> DataFrame | None:
    """Least distances from the marked nodes, in one task; None if a negative cycle is reached."""
    kind = dict(g.edges.dtypes)["w"]

    def solve(starts: np.ndarray, arrays: local.Arrays) -> dict[str, np.ndarray]:
        names, src, dst, w = arrays
        out = []
        for some in [[s] for s in starts.tolist()] if by_source else [starts]:
            dist, known = np.zeros(len(names), w.dtype), np.zeros(len(names), bool)
            known[some] = True
            if not local.settle(len(names), src, dst, w, dist, known, keep_bound):
                return {"source": np.array([-1]), "v": np.array([0]), "dist": np.array([0], w.dtype), "settled": np.array([False])}
            at = np.flatnonzero(known)
            out.append((np.full(len(at), names[some[0]] if len(some) else 0), names[at], dist[at]))
        source, v, dist = (np.concatenate(x) for x in zip(*out)) if out else (names[:0], names[:0], w[:0])
        return {"source": source, "v": v, "dist": dist, "settled": np.ones(len(v), bool)}

    rows = cut(local.in_one_task(g.nodes.select("v", mark.alias("mark")), g.edges, solve, f"source long, v long, dist {kind}, settled boolean"))
    if rows.where("not settled").take(1):
        return None
    return rows.select(*(["source"] if by_source else []), "v", "dist")


def _zero(g: Graph) -> Column:
    return F.lit(0).cast(g.edges.schema["w"].dataType).alias("dist")


def sssp(g: Graph, source: int, bound: float | None = None, target: int | None = None, plan: str = "auto") -> DataFrame:
    """v and dist of what `source` reaches; bound: only distances up to it.

    Intermediate distances are bounded too, so with negative weights give a bound on reduced
    weights.  target: stop once it is closer than the bound.  A negative cycle is an error.
    """
    if target is None and is_small(g, plan):
        found = _settled(g, F.col("v") == source, bound)
        if found is None:
            raise ValueError("the source reaches a negative cycle")
        return found
    start = g.nodes.where(F.col("v") == source).select("v", _zero(g))
    dist, settled = _from(g, start, bound=bound, rounds=g.n() + 1, target=(target, bound) if target is not None and bound is not None else None, cycles=True)
    if not settled and target is None:
        raise ValueError("the source reaches a negative cycle")
    return dist


def shorter_path(g: Graph, source: int, target: int, bound: float) -> bool:
    """Whether there is a path from source to target shorter than `bound`; the target isn't passed through."""
    if source == target:
        return bound <= 0
    start = g.nodes.where(F.col("v") == source).select("v", _zero(g))
    dist, _ = _from(g, start, edges=g.edges.where(F.col("src") != target), strict=True, rounds=g.n() + 1, target=(target, bound))
    return bool(dist.where((F.col("v") == target) & (F.col("dist") < bound)).take(1))


def reachable(g: Graph, source: int, plan: str = "auto") -> DataFrame:
    """v of every node that source reaches, itself included."""
    if is_small(g, plan):
        return local.in_one_task(g.nodes.select("v", (F.col("v") == source).alias("mark")), g.edges, lambda starts, x: {"v": x[0][local.reach(len(x[0]), x[1], x[2], starts)]}, "v long")
    start = g.nodes.where(F.col("v") == source).select("v", F.lit(0).alias("dist"))
    return _from(g, start, edges=g.edges.select("src", "dst", F.lit(0).alias("w")))[0].select("v")


def bidirectional(g: Graph, source: int, target: int, bound: float, plan: str = "auto") -> DataFrame:
    """One row: dist, the least df + db below `bound` over nodes met from both sides (null: none).

    For weights that aren't negative (else a ValueError).  A side's labels beyond the bound are dropped.
    """
    if g.edges.where("w < 0").take(1):
        raise ValueError("a search from both sides needs weights that aren't negative")
    sides, small = {}, is_small(g, plan)
    for name, start, edges in (("df", source, g.edges), ("db", target, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))):
        if small:
            sides[name] = _settled(Graph(edges.withColumn("eid", F.lit(0)), g.nodes), F.col("v") == start, bound)
        else:
            sides[name], _ = _from(g, g.nodes.where(F.col("v") == start).select("v", _zero(g)), edges=edges, bound=bound, strict=True)
    met = sides["df"].withColumnRenamed("dist", "df").join(sides["db"].withColumnRenamed("dist", "db"), "v")
    total = F.col("df") + F.col("db")
    return met.where(total < bound).agg(F.min(total).alias("dist"))


def apsp(g: Graph, sources: DataFrame | None = None, plan: str = "auto") -> DataFrame:
    """source, v and dist of every reachable pair; sources (v): only from these."""
    if is_small(g, plan) and (plan == "local" or g.n() * (g.n() if sources is None else sources.count()) <= LOCAL_ROWS):
        marked = g.nodes.select("v", F.lit(True).alias("mark")) if sources is None else g.nodes.select("v").join(sources.select("v", F.lit(True).alias("mark")).distinct(), "v", "left").na.fill(False)
        found = _settled(Graph(g.edges, marked), F.col("mark"), by_source=True)
        if found is None:
            raise ValueError("there is a negative cycle")
        return found
    start = (g.nodes if sources is None else sources.distinct()).select(F.col("v").alias("source"), "v", _zero(g))
    dist, settled = _from(g, start, ["source"], rounds=g.n() + 1)
    if not settled:
        raise ValueError("there is a negative cycle")
    return dist


def apsp_summary(g: Graph, plan: str = "auto") -> DataFrame:
    """One row: mean of the distances over n*n pairs (null unless all are reachable), largest (0 at least), pairs reached."""
    n = g.n()
    d = F.col("dist").cast("double")
    pairs = F.count("*")
    return apsp(g, plan=plan).agg(F.when(pairs == n * n, F.sum(d) / (n * n)).alias("mean"), F.greatest(F.max(d), F.lit(0.0)).alias("max"), pairs.alias("reached"))


def potentials(g: Graph, plan: str = "auto") -> DataFrame | None:
    """v and phi such that every reduced weight is 0 or more; None if a cycle is negative."""
    kind = g.edges.schema["w"].dataType
    if is_small(g, plan):
        dist = _settled(g, F.lit(True))
        settled = dist is not None
    else:
        dist, settled = _from(g, g.nodes.select("v", _zero(g)), rounds=g.n(), cycles=True)
    return dist.select("v", (-F.col("dist")).cast(kind).alias("phi")) if settled else None


def has_negative_cycle(g: Graph, plan: str = "auto") -> bool:
    """From distances of 0 everywhere: does anything still change in round n?  Zero cycles are legal."""
    return potentials(g, plan) is None


def rootless(pred: DataFrame) -> DataFrame:
    """v of the nodes of pred (v, pred; null at roots) that never reach a root: on a cycle or behind one.

    Pointers double in each round, so rounds grow with the logarithm of the longest path.
    """
    jump = cut(pred.select("v", F.col("pred").alias("to")), bare=True)
    n = jump.count()
    for _ in range(max(1, n.bit_length())):
        ahead = jump.select(F.col("v").alias("to"), F.col("to").alias("next"))
        before, jump = jump, cut(jump.where("to is not null").join(ahead, "to").select("v", F.col("next").alias("to")).where("to is not null"), bare=True)
        discard(before)
        if not jump.take(1):
            break
    return jump.select("v")


def is_acyclic(pred: DataFrame) -> bool:
    return not rootless(pred).take(1)
