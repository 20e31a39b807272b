"""Strongly connected components by forward-backward search, from a pivot first and by colouring for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.graph import Graph
from edgeloom.operators import local
from edgeloom.operators.traverse import _prepared, is_small, relax
from edgeloom.plans.lineage import cut, discard


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """v and dist: the least start value (v, dist) of the nodes that reach v along edges (src, dst)."""
    kept = _prepared(edges.select("src", "dst", F.lit(0).cast("bigint").alias("w")))
    out, _ = relax(start, kept)
    discard(kept)
    return out


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("v").alias("src")), "src", "left_semi").join(nodes.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst")


def scc(g: Graph, include_singletons: bool = True, plan: str = "auto") -> DataFrame:
    """v and scc (its component's smallest node) of every node.

    include_singletons=False leaves out components of one node without a self-loop.  In a
    round, nodes without an edge in or out are components by themselves.  The first round
    takes the component of the node with the most edges in times out, mostly the giant one;
    after it every node is coloured by the smallest node that reaches it, and what reaches that
    node back within its colour is a component.
    """
    loops = g.edges.where("src = dst").select(F.col("src").alias("v")).distinct()
    if is_small(g, plan):
        solve = lambda _, x: {"v": x[0], "scc": x[0][local.strong(len(x[0]), x[1], x[2])]}
        return _without_singletons(cut(local.in_one_task(g.nodes.select("v", F.lit(False).alias("mark")), g.edges, solve, "v long, scc long")), loops, include_singletons)
    nodes = cut(g.nodes.select("v"))
    edges = cut(g.edges.where("src <> dst").select("src", "dst").distinct())
    parts, first = [], True
    while nodes.take(1):
        live = cut(edges.select(F.col("src").alias("v")).distinct().join(edges.select(F.col("dst").alias("v")).distinct(), "v"))
        parts.append(cut(nodes.join(live, "v", "left_anti").select("v", F.col("v").alias("scc"))))
        inner = cut(_within(edges, live))
        if first:
            degrees = inner.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o")).join(inner.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("i")), "v")
            start = degrees.select(F.struct((-F.col("o") * F.col("i")).alias("d"), "v").alias("x")).agg(F.min("x").alias("x")).select("x.v", F.lit(0).cast("bigint").alias("dist")).where("v is not null")
            color = _spread(start, inner).select("v", F.lit(0).cast("bigint").alias("color"))
        else:
            start = None
            color = _spread(live.select("v", F.col("v").alias("dist")), inner).select("v", F.col("dist").alias("color"))
        ends = inner.join(color.select(F.col("v").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("v").alias("dst"), F.col("color").alias("b")), "dst").where("a = b")
        roots = start if first else color.where("v = color").select("v", F.col("color").alias("dist"))
        back = _spread(roots, ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        if first:
            name = back.agg(F.min("v")).first()[0]
            back = back.select("v", F.lit(name).cast("bigint").alias("scc"))
        else:
            back = back.select("v", F.col("dist").alias("scc"))
        parts.append(cut(back))
        old = (nodes, edges)
        nodes = cut(live.join(back, "v", "left_anti"))
        edges = cut(_within(inner, nodes))
        discard(*old, live, inner)
        first = False
    out = parts[0] if parts else g.nodes.select("v", F.col("v").alias("scc"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return _without_singletons(out, loops, include_singletons)


def _without_singletons(out: DataFrame, loops: DataFrame, include_singletons: bool) -> DataFrame:
    if include_singletons:
        return out
    big = out.groupBy("scc").count().where("count > 1").select("scc")
    return out.join(big, "scc", "left_semi").select("v", "scc").unionByName(out.join(big, "scc", "left_anti").join(loops, "v", "left_semi").select("v", "scc"))


def largest(components: DataFrame) -> int | None:
    """The component with the most nodes, ties to the smallest; None if there is none."""
    row = components.groupBy("scc").count().orderBy(F.desc("count"), "scc").first()
    return row["scc"] if row else None


def largest_scc(g: Graph, plan: str = "auto") -> Graph:
    """The subgraph of the largest component, relabelled; loop-free singletons don't count."""
    parts = cut(scc(g, False, plan))
    name = largest(parts)
    if name is None:
        raise ValueError("the graph has no strongly connected component")
    return g.induced(parts.where(F.col("scc") == name).select("v"))
