"""Directed weighted graphs held as two DataFrames: edges (eid, src, dst, w) and nodes (v, phi)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions.weights import Initial, initial_weight


def index_edges(pairs: DataFrame, *ties: str) -> DataFrame:
    """Adds eid: an edge's rank, from 0, by (src, dst) and then the columns `ties`.

    Ranks are global, yet no task sees more than its range of sources: a range partition's
    offset is the count of the partitions before it.
    """
    ranked = pairs.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst", *ties).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    from edgeloom.plans.lineage import cut

    ranked = cut(ranked)
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = ranked.join(F.broadcast(sizes), "_part")
    return out.withColumn("eid", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


@dataclass(frozen=True)
class Graph:
    """edges: eid, src, dst, w; nodes: v, phi.  Isolated nodes are rows of nodes only."""

    edges: DataFrame
    nodes: DataFrame

    @classmethod
    def of(cls, pairs: DataFrame, n: int | None = None, weight: Column | None = None, initial: Initial | None = None, maximum: float = 1, integral: bool = True, seed: int = 1, check: bool = True) -> Graph:
        """pairs (src, dst, perhaps w) as a graph; n: nodes are 0 .. n - 1, else those that occur.

        A graph has two edges at least (check=False skips the count).
        """
        edges = index_edges(pairs, *(["w"] if "w" in pairs.columns else []))
        if weight is not None:
            edges = edges.withColumn("w", weight)
        elif initial is not None or "w" not in pairs.columns:
            edges = edges.withColumn("w", initial_weight(initial or Initial("m"), maximum, integral, seed))
        if check and len(edges.take(2)) < 2:
            raise ValueError("a graph needs two edges at least")
        spark = pairs.sparkSession
        nodes = spark.range(n).withColumnRenamed("id", "v") if n is not None else edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        return cls(edges.select("eid", "src", "dst", "w"), nodes.select("v", F.lit(0).cast(edges.schema["w"].dataType).alias("phi")))

    def n(self) -> int:
        return self.nodes.count()

    def m(self) -> int:
        return self.edges.count()

    def stats(self) -> DataFrame:
        """One row: n, m, avg_weight and frac_negative; weights are widened before they are added."""
        e = self.edges.agg(F.count("*").alias("m"), F.avg(F.col("w").cast("double")).alias("avg_weight"), F.avg((F.col("w") < 0).cast("double")).alias("frac_negative"))
        return self.nodes.agg(F.count("*").alias("n")).join(F.broadcast(e))

    def degrees(self) -> DataFrame:
        """v, out_degree and in_degree of every node."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        sums = ends.groupBy("v").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        return self.nodes.select("v").join(sums, "v", "left").na.fill(0, ["out_degree", "in_degree"])

    def out_neighbors(self, v: int) -> DataFrame:
        return self.edges.where(F.col("src") == v)

    def in_neighbors(self, v: int) -> DataFrame:
        return self.edges.where(F.col("dst") == v)

    def edge(self, eid: int) -> DataFrame:
        return self.edges.where(F.col("eid") == eid)

    def potential(self, v: int) -> DataFrame:
        return self.nodes.where(F.col("v") == v)

    def update_weights(self, updates: DataFrame) -> Graph:
        """updates (eid, w, step): the last step wins."""
        last = updates.groupBy("eid").agg(F.max_by("w", "step").alias("_w"))
        return Graph(self.edges.join(last, "eid", "left").withColumn("w", F.coalesce("_w", "w")).select("eid", "src", "dst", "w"), self.nodes)

    def update_potentials(self, deltas: DataFrame) -> Graph:
        """deltas (v, delta) are added, all of them."""
        total = deltas.groupBy("v").agg(F.sum("delta").alias("_d"))
        return Graph(self.edges, self.nodes.join(total, "v", "left").select("v", (F.col("phi") + F.coalesce("_d", F.lit(0))).cast(self.nodes.schema["phi"].dataType).alias("phi")))

    def reduced(self) -> DataFrame:
        """Edges with rw = w + phi(dst) - phi(src)."""
        at = self.nodes.select("v", "phi")
        out = self.edges.join(at.select(F.col("v").alias("src"), F.col("phi").alias("_s")), "src").join(at.select(F.col("v").alias("dst"), F.col("phi").alias("_t")), "dst")
        return out.select("eid", "src", "dst", "w", (F.col("w") + F.col("_t") - F.col("_s")).alias("rw"))

    def is_feasible(self) -> bool:
        """Whether the potentials certify that no cycle is negative."""
        return not self.reduced().where("rw < 0").take(1)

    def adjacency(self) -> DataFrame:
        """src and its sorted out-edges (dst, w, rw): a listing to look at."""
        return self.reduced().groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w", "rw"))).alias("out"))

    def induced(self, keep: DataFrame) -> Graph:
        """The subgraph on the nodes keep (v), relabelled 0, 1, ... in ascending order of the old label."""
        names = keep.select("v").distinct()
        named = index_edges(names.select(F.col("v").alias("src"), F.lit(0).alias("dst"))).select(F.col("src").alias("v"), F.col("eid").alias("new"))
        edges = self.edges.join(named.select(F.col("v").alias("src"), F.col("new").alias("s")), "src").join(named.select(F.col("v").alias("dst"), F.col("new").alias("d")), "dst")
        edges = index_edges(edges.select(F.col("s").alias("src"), F.col("d").alias("dst"), "w", F.col("eid").alias("_old")), "_old").drop("_old")
        nodes = self.nodes.join(named, "v").select(F.col("new").alias("v"), "phi")
        return Graph(edges.select("eid", "src", "dst", "w"), nodes)


def undirected(pairs: DataFrame) -> DataFrame:
    """Every edge followed by its reverse."""
    other = [c for c in pairs.columns if c not in ("src", "dst")]
    both = F.array(F.struct("src", "dst", F.lit(0).alias("back")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back")))
    return pairs.select(F.explode(both).alias("_e"), *other).select("_e.src", "_e.dst", *other)


def load(spark: SparkSession, source, initial: Initial | None = None, maximum: float = 1, integral: bool = True, seed: int = 1) -> Graph:
    """The graph of any source of edgeloom.sources.specs."""
    from edgeloom.sources.generators import pairs

    found, n = pairs(spark, source, seed)
    return Graph.of(found, n, initial=initial, maximum=maximum, integral=integral, seed=seed)
