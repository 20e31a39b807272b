"""Edges of random and regular graphs as DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.prng import draw, python_draw, python_unit, unit
from edgeloom.sources import edgelist
from edgeloom.sources.specs import Complete, Cycle, EdgeListFile, FromTable, Gnp, Hyperbolic, ScaleFree, Source

TWO_PI = 2 * math.pi


def cycle(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))


def complete(spark: SparkSession, n: int, loops: bool = False) -> DataFrame:
    """Each source's targets are generated where the source is; no pair is shuffled."""
    out = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst"))
    return out if loops else out.where("src <> dst")


def gnp(spark: SparkSession, n: int, p: float, seed: int = 1) -> DataFrame:
    """Every ordered pair (self-loops too) with probability p: one independent draw for each pair, for small n."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    return complete(spark, n, True).where(unit(seed, F.col("src") * n + F.col("dst"), 2) < p)


def gnp_sparse(spark: SparkSession, n: int, p: float, seed: int = 1) -> DataFrame:
    """The same distribution in time proportional to the edges: each source skips geometrically to its next target."""
    if not 0 < p < 1:
        return complete(spark, n, True) if p >= 1 else complete(spark, n, True).limit(0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for s in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, s])
                at = -1
                while True:
                    gaps = rng.geometric(p, max(16, int(1.2 * n * p)))
                    places = at + np.cumsum(gaps)
                    inside = places[places < n]
                    src.append(np.full(len(inside), s))
                    dst.append(inside)
                    if len(inside) < len(places):
                        break
                    at = int(places[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())], ["src", "dst"])

    return spark.range(n).mapInArrow(rows, "src long, dst long")


def coordinates(spark: SparkSession, spec: Hyperbolic, seed: int = 1) -> DataFrame:
    """id, phi, r, bid and the hyperbolic and circular functions of each point."""
    u = 1.0000000000000002 + unit(seed, "id", 3) * (math.cosh(spec.alpha * spec.disc()) - 1)
    base = spark.range(spec.n).select("id", (unit(seed, "id", 2) * TWO_PI).alias("phi"), (F.acosh(u) / spec.alpha).alias("r"))
    return with_bands(base, spec.limits())


def with_bands(points: DataFrame, limits: list[float]) -> DataFrame:
    """Adds bid (the last band whose lower radius is reached) and the functions that distances need."""
    bid = F.lit(0)
    for i, low in enumerate(limits):
        bid = F.when(F.col("r") >= low, F.lit(i)).otherwise(bid)
    return points.withColumn("bid", bid).withColumn("rc", F.cosh("r")).withColumn("rs", F.sinh("r")).withColumn("pc", F.cos("phi")).withColumn("ps", F.sin("phi"))


def near(v: str, w: str, radius: float) -> Column:
    """Whether two points are closer than the radius, by the hyperbolic law of cosines."""
    c = lambda side, name: F.col(f"{side}.{name}")
    turn = c(v, "pc") * c(w, "pc") + c(v, "ps") * c(w, "ps")
    return c(v, "rc") * c(w, "rc") - c(v, "rs") * c(w, "rs") * turn < math.cosh(radius)


def hyperbolic_pairs(points: DataFrame, radius: float, limits: list[float]) -> DataFrame:
    """Unordered pairs (v, w) closer than the radius, by an equi-join on band and sector.

    A point looks, in its own band and each one outside, only at the sectors of the widest
    angle at which a point on that band's inner rim could still be near; a sector is about
    as wide as that angle between two points on the rim, so bands far out have many.
    """
    sectors = []
    for low in limits:
        spread = 1.0 if low <= 0 else (math.cosh(low) ** 2 - math.cosh(radius)) / math.sinh(low) ** 2
        width = TWO_PI if spread <= -1 else math.acos(min(1.0, spread)) or 1e-3
        sectors.append(max(1, min(1 << 20, int(TWO_PI / width) if low > 0 else 1)))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(low)).alias("low"), F.lit(s).alias("sectors")) for i, (low, s) in enumerate(zip(limits, sectors))])
    count = F.element_at(F.array(*map(F.lit, sectors)), F.col("bid") + 1)
    homes = points.withColumn("sector", F.least(F.floor(F.col("phi") / TWO_PI * count), count - 1).cast("int"))
    looks = points.select("*", F.explode(F.filter(bands, lambda b: b["band"] >= F.col("bid"))).alias("b"))
    cosine = (F.col("rc") * F.cosh("b.low") - F.lit(math.cosh(radius))) / (F.col("rs") * F.sinh("b.low"))
    angle = F.when((F.col("b.low") <= 0) | (F.col("rs") <= 0) | (cosine <= -1), F.lit(math.pi)).when(cosine >= 1, F.lit(0.0)).otherwise(F.acos(cosine))
    step = F.lit(TWO_PI) / F.col("b.sectors")
    first, last = F.floor((F.col("phi") - angle - 1e-9) / step), F.floor((F.col("phi") + angle + 1e-9) / step)
    last = F.least(last, first + F.col("b.sectors") - 1)
    looks = looks.withColumn("sector", F.explode(F.sequence(first, last))).withColumn("sector", F.pmod("sector", F.col("b.sectors")).cast("int"))
    v, w = looks.withColumn("look", F.col("b.band")).alias("v"), homes.alias("w")
    met = v.join(w, (F.col("v.look") == F.col("w.bid")) & (F.col("v.sector") == F.col("w.sector")))
    met = met.where((F.col("v.bid") < F.col("w.bid")) | (F.col("v.id") < F.col("w.id"))).where(near("v", "w", radius))
    return met.select(F.least("v.id", "w.id").alias("v"), F.greatest("v.id", "w.id").alias("w"))


def oriented(found: DataFrame, one_way: float, seed: int = 1) -> DataFrame:
    """Unordered pairs as directed edges: both ways with probability one_way, else one way or the other evenly."""
    u = unit(seed, "v", "w", 4)
    ahead, back = F.struct(F.col("v").alias("src"), F.col("w").alias("dst")), F.struct(F.col("w").alias("src"), F.col("v").alias("dst"))
    chosen = F.when(u <= one_way, F.array(ahead, back)).when(u <= (1 + one_way) / 2, F.array(ahead)).otherwise(F.array(back))
    return found.select(F.explode(chosen).alias("e")).select("e.src", "e.dst")


def hyperbolic(spark: SparkSession, spec: Hyperbolic, seed: int = 1) -> DataFrame:
    return oriented(hyperbolic_pairs(coordinates(spark, spec, seed), spec.disc(), spec.limits()), spec.one_way, seed)


def attachment(spec: ScaleFree, replica: int, seed: int) -> list[tuple[int, int]]:
    """One directed preferential-attachment graph, edge by edge.

    Choosing by degree plus delta is a mixture: with the edges' share of the mass an end of
    a uniformly drawn edge, else a uniformly drawn node.
    """
    alpha, beta = spec.rates()
    edges: list[tuple[int, int]] = []
    seen: set[tuple[int, int]] = set()
    nodes, step = 1, 0
    while nodes < spec.n:
        def pick(end: int, delta: float, lane: int) -> int:
            mass = len(edges) + delta * nodes
            x = python_unit(seed, replica, step, lane) * mass if mass else 0.0
            if x < len(edges):
                return edges[int(x)][end]
            return min(nodes - 1, int((x - len(edges)) / delta)) if delta else python_draw(seed, replica, step, lane + 4) % nodes

        u = python_unit(seed, replica, step, 2)
        if u < alpha:
            e, new = (nodes, pick(1, spec.delta_in, 3)), 1
        elif u < alpha + beta:
            e, new = (pick(0, spec.delta_out, 4), pick(1, spec.delta_in, 3)), 0
        else:
            e, new = (pick(0, spec.delta_out, 4), nodes), 1
        nodes, step = nodes + new, step + 1
        if e not in seen:
            seen.add(e)
            edges.append(e)
    return edges


def scale_free(spark: SparkSession, spec: ScaleFree, replicas: int = 1, seed: int = 1) -> DataFrame:
    """replica, src, dst and at (the edge's place in time); the process is sequential, replicas run side by side."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                e = np.array(attachment(spec, r, seed), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), r)), pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(np.arange(len(e)))], ["replica", "src", "dst", "at"])

    return spark.range(0, replicas, 1, replicas).mapInArrow(rows, "replica long, src long, dst long, at long")


def pairs(spark: SparkSession, source: Source, seed: int = 1) -> tuple[DataFrame, int | None]:
    """(edges, number of nodes or None) of any source."""
    match source:
        case Cycle(n):
            return cycle(spark, n), n
        case Complete(n, loops):
            return complete(spark, n, loops), n
        case Gnp():
            return gnp_sparse(spark, source.n, source.p, seed), source.n
        case ScaleFree():
            return scale_free(spark, source, 1, seed).select("src", "dst"), source.n
        case Hyperbolic():
            return hyperbolic(spark, source, seed), source.n
        case EdgeListFile(path, both, weighted):
            return edgelist.read(spark, path, both, weighted)
        case FromTable(sql):
            return spark.sql(sql).select("src", "dst"), None
    raise TypeError(f"unknown source {source!r}")


__all__ = ["complete", "coordinates", "cycle", "draw", "gnp", "gnp_sparse", "hyperbolic", "hyperbolic_pairs", "oriented", "pairs", "scale_free"]
