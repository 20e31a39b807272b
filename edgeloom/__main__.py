"""Command line: `python -m edgeloom [options] SOURCE ...` samples weights; `python -m edgeloom cover ...` runs coverage."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.weights import TYPES, convert, parse_algorithm, parse_initial, parse_type
from edgeloom.graph import Graph, load
from edgeloom.operators import cycle, sampling, structure, traverse
from edgeloom.sources import edgelist, specs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="edgeloom")
    p.add_argument("-w", "--min-weight", type=float, default=-1.0)
    p.add_argument("-W", "--max-weight", type=float, default=1.0)
    p.add_argument("-t", "--type", default="f64", help="f32, f64, i8, i16, i32 or i64")
    p.add_argument("-r", "--rounds", type=float, default=1.0, help="steps for each edge")
    p.add_argument("-s", "--seed", type=int, default=1)
    p.add_argument("-i", "--initial", default="m", help="m(ax), z(ero), u(niform) or a number")
    p.add_argument("-o", "--output", help="folder for the weighted edges")
    p.add_argument("--check", action="store_true", help="look for negative cycles before and after")
    p.add_argument("--bftest", action="store_true", help="make every decision again by a search on plain weights")
    p.add_argument("-a", "--algorithm", default="bd", help="d(ijkstra), bf or bd")
    p.add_argument("--scc", action="store_true", help="keep the largest strongly connected component")
    p.add_argument("--chains", type=int, default=1)
    commands = p.add_subparsers(dest="source", required=True)
    c = commands.add_parser("gnp")
    c.add_argument("-n", type=int, required=True)
    c.add_argument("-d", "--degree", type=float, required=True)
    c = commands.add_parser("dsf")
    c.add_argument("-n", type=int, required=True)
    for name in ("alpha", "beta", "gamma", "degree"):
        c.add_argument(f"--{name}", type=float)
    c.add_argument("--delta-out", type=float, default=1.0)
    c.add_argument("--delta-in", type=float, default=1.0)
    c = commands.add_parser("rhg")
    c.add_argument("-n", type=int, required=True)
    c.add_argument("--alpha", type=float, default=1.0)
    c.add_argument("--radius", type=float)
    c.add_argument("--degree", type=float)
    c.add_argument("--bands", type=int)
    c.add_argument("-p", "--both", type=float, default=1.0, help="share of edges that go both ways")
    c = commands.add_parser("complete")
    c.add_argument("-n", type=int, required=True)
    c.add_argument("--loops", action="store_true")
    c = commands.add_parser("cycle")
    c.add_argument("-n", type=int, required=True)
    c = commands.add_parser("file")
    c.add_argument("path")
    c.add_argument("--undirected", action="store_true")
    c = commands.add_parser("cover")
    c.add_argument("-n", type=int, default=8)
    c.add_argument("-a", "--low", type=int, default=-1)
    c.add_argument("-b", "--high", type=int, default=1)
    c.add_argument("-m", "--steps", type=int, default=16)
    c.add_argument("-k", "--runs", type=int, default=1)
    c.add_argument("-r", "--repetitions", type=int, default=100)
    c.add_argument("-e", "--quit-early", action="store_true")
    return p


def source_of(o: argparse.Namespace) -> specs.Source:
    match o.source:
        case "gnp":
            return specs.Gnp(o.n, o.degree)
        case "dsf":
            return specs.ScaleFree(o.n, o.alpha, o.beta, o.gamma, o.degree, o.delta_out, o.delta_in)
        case "rhg":
            return specs.Hyperbolic(o.n, o.alpha, o.radius, o.degree, o.bands, o.both)
        case "complete":
            return specs.Complete(o.n, o.loops)
        case "cycle":
            return specs.Cycle(o.n)
    return specs.EdgeListFile(o.path, o.undirected)


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if o.source == "cover":
        for row in cycle.coverage(spark, o.n, o.low, o.high, o.steps, o.runs, o.repetitions, quit_early=o.quit_early).toJSON().toLocalIterator():
            print(row)
        return
    if o.min_weight >= o.max_weight or o.rounds <= 0:
        sys.exit("the least weight must be below the largest, and rounds positive")
    kind = parse_type(o.type)
    g = load(spark, source_of(o), parse_initial(o.initial), o.max_weight, TYPES[kind][1] is not None, o.seed)
    if o.scc:
        g = structure.largest_scc(g)
    if o.check and traverse.has_negative_cycle(g):
        sys.exit("there is a negative cycle to begin with")
    out = sampling.sample_weights(g, o.min_weight, o.max_weight, o.rounds, parse_algorithm(o.algorithm), o.chains, o.seed, bftest=o.bftest).cache()
    if o.check:
        for k in range(o.chains):
            if traverse.has_negative_cycle(Graph(out.where(F.col("chain") == k).select("eid", "src", "dst", "w"), g.nodes)):
                sys.exit(f"chain {k} ended with a negative cycle")
    out.groupBy("chain").agg(F.count("*").alias("m"), F.avg("w").alias("avg_weight"), F.avg((F.col("w") < 0).cast("double")).alias("frac_negative")).orderBy("chain").show()
    if o.output:
        edgelist.write(out.withColumn("w", convert(F.col("w"), kind)), o.output)


if __name__ == "__main__":
    main()
