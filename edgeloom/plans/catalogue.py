"""The registered queries over graphs derived from the driver's tables, each with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions.prng import duckdb_draw, duckdb_unit
from edgeloom.functions.weights import Initial
from edgeloom.graph import Graph, index_edges, undirected
from edgeloom.operators import cycle, sampling, structure, telemetry, traverse
from edgeloom.plans.lineage import shared_folder
from edgeloom.sources import edgelist, generators
from edgeloom.sources import telemetry as tables
from edgeloom.sources import specs
from edgeloom.sources.specs import Hyperbolic, scale_free_rates

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Graphs by name: src and dst over the driver's tables; {table} stands for a table.
DERIVED = {
    "nation": "SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey",
    "user": "SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM {events}) AS t WHERE dst IS NOT NULL",
    "cust": "SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderpriority, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS dst FROM {orders}) AS t WHERE dst IS NOT NULL",
    "part": "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM {lineitem}) AS t WHERE dst IS NOT NULL",
}
RAW = "(src * 7919 + dst * 104729) % 201 - 100"
PLANTED = "(src * 7919 + dst * 104729) % 101 + (src * 31) % 50 - (dst * 31) % 50"
POSITIVE = "(src * 7919 + dst * 104729) % 101"


def sql_pairs(name: str) -> str:
    return DERIVED[name].format(**{t: t for t in TABLES})


def pairs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "user":  # consecutive over all events: by rank, as a window over all rows would be one task
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        ranked = index_edges(events.select(F.col("ts").alias("src"), F.col("event_id").alias("dst"), "user_id")).select("eid", "user_id")
        after = ranked.select((F.col("eid") - 1).alias("eid"), F.col("user_id").alias("dst"))
        return ranked.join(after, "eid").select(F.col("user_id").alias("src"), "dst").distinct()
    text = DERIVED[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def weighted(spark: SparkSession, sf_dir: str, name: str, weight: str = PLANTED) -> Graph:
    edges = pairs(spark, sf_dir, name).withColumn("w", F.expr(weight).cast("bigint"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("phi", F.lit(0).cast("bigint"))
    return Graph(edges.withColumn("eid", F.lit(None).cast("bigint")).select("eid", "src", "dst", "w"), nodes)


def indexed(spark: SparkSession, sf_dir: str, name: str, weight: str = PLANTED) -> Graph:
    g = weighted(spark, sf_dir, name, weight)
    return Graph(index_edges(g.edges.drop("eid")).select("eid", "src", "dst", "w"), g.nodes)


def _edges_sql(name: str, weight: str = PLANTED, where: str = "true") -> str:
    return f"g AS (SELECT src, dst, CAST({weight} AS BIGINT) AS w FROM ({sql_pairs(name)}) WHERE {where}), nodes AS (SELECT src AS v FROM g UNION SELECT dst FROM g)"


#: Leaves enough edges of a dense graph out that it has many components.
SPARSE = "(src * 7919 + dst * 104729) % 101 < 3"


def sparse(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    edges = indexed(spark, sf_dir, name).edges.where(SPARSE)
    return Graph(edges, edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("phi", F.lit(0).cast("bigint")))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _source(g: Graph) -> int:
    return g.nodes.agg(F.min("v")).first()[0] or 0


_SSSP = """, s AS (SELECT min(v) AS v FROM nodes), d(v, dist) USING KEY (v) AS (
  SELECT v, CAST(0 AS BIGINT) FROM s
  UNION SELECT g.dst, CAST(min(d.dist + g.w) AS BIGINT) FROM d JOIN g ON d.v = g.src LEFT JOIN recurring.d AS o ON o.v = g.dst WHERE (o.dist IS NULL OR d.dist + g.w < o.dist){bound} GROUP BY g.dst)"""

found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        found[f.__name__] = (f, sql)
        return f

    return keep


# Statistics and projections


@query(f"WITH {_edges_sql('nation', RAW)} SELECT (SELECT count(*) FROM nodes) AS n, count(*) AS m, avg(CAST(w AS DOUBLE)) AS avg_weight, avg(CASE WHEN w < 0 THEN 1.0 ELSE 0.0 END) AS frac_negative FROM g")
def graph_stats(spark, sf_dir):
    return weighted(spark, sf_dir, "nation", RAW).stats()


@query(f"WITH {_edges_sql('part')} SELECT v, CAST((SELECT count(*) FROM g WHERE src = v) AS BIGINT) AS out_degree, CAST((SELECT count(*) FROM g WHERE dst = v) AS BIGINT) AS in_degree FROM nodes")
def degree_dist(spark, sf_dir):
    return weighted(spark, sf_dir, "part").degrees()


@query(f"WITH {_edges_sql('cust')} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, w FROM g")
def edge_index(spark, sf_dir):
    return indexed(spark, sf_dir, "cust").edges


def _initial(kind: str, value: float = 0.0) -> Query:
    def run(spark, sf_dir):
        g = indexed(spark, sf_dir, "cust")
        from edgeloom.functions.weights import initial_weight

        return g.edges.withColumn("w", initial_weight(Initial(kind, value), 100, True, 7)).select("eid", "w")

    return run


for _kind, _name, _sql in (("m", "max", "100"), ("z", "zero", "0"), ("u", "uniform", f"{duckdb_draw(7, 0, 'eid', 3)} % 101"), ("v", "value", "42")):
    _q = _initial(_kind, 42)
    _q.__name__ = f"initial_weights_{_name}"
    query(f"WITH {_edges_sql('cust')}, e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM g) SELECT eid, CAST({_sql} AS BIGINT) AS w FROM e")(_q)


@query(f"WITH {_edges_sql('nation')} SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g")
def undirected_expand(spark, sf_dir):
    return undirected(weighted(spark, sf_dir, "nation").edges.select("src", "dst"))


def _with_phi(g: Graph) -> Graph:
    return Graph(g.edges, g.nodes.withColumn("phi", F.expr("(v * 31) % 50").cast("bigint")))


@query(f"WITH {_edges_sql('part')} SELECT src, dst, w, w + (dst * 31) % 50 - (src * 31) % 50 AS rw FROM g")
def reduced_weights(spark, sf_dir):
    return _with_phi(weighted(spark, sf_dir, "part")).reduced().drop("eid")


@query(f"WITH {_edges_sql('part')} SELECT count(*) FILTER (WHERE w + (dst * 31) % 50 - (src * 31) % 50 < 0) AS violations FROM g")
def feasible_certificate(spark, sf_dir):
    return _with_phi(weighted(spark, sf_dir, "part")).reduced().agg(F.count_if(F.col("rw") < 0).alias("violations"))


@query(f"WITH {_edges_sql('cust')}, k AS (SELECT c_custkey AS v FROM customer WHERE c_mktsegment = 'BUILDING'), m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS new FROM k WHERE v IN (SELECT v FROM nodes)) SELECT row_number() OVER (ORDER BY a.new, b.new) - 1 AS eid, a.new AS src, b.new AS dst, w FROM g JOIN m a ON a.v = src JOIN m b ON b.v = dst")
def induced_subgraph(spark, sf_dir):
    g = indexed(spark, sf_dir, "cust")
    keep = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("v"))
    return g.induced(keep.join(g.nodes, "v", "left_semi")).edges


@query(f"WITH {_edges_sql('nation')} SELECT src, count(*) AS degree, string_agg(dst || '/' || w, ' ' ORDER BY dst) AS listing FROM g GROUP BY src")
def adjacency_listing(spark, sf_dir):
    listed = weighted(spark, sf_dir, "nation").adjacency()
    return listed.select("src", F.size("out").cast("bigint").alias("degree"), F.array_join(F.transform("out", lambda e: F.concat_ws("/", e["dst"].cast("string"), e["w"].cast("string"))), " ").alias("listing"))


@query(f"WITH {_edges_sql('cust')}, e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, w FROM g), u AS (SELECT o_orderkey % (SELECT count(*) FROM e) AS eid, o_orderkey AS step, o_orderkey % 7 AS w FROM orders), l AS (SELECT eid, arg_max(w, step) AS w FROM u GROUP BY eid) SELECT e.eid, src, dst, coalesce(l.w, e.w) AS w FROM e LEFT JOIN l ON e.eid = l.eid")
def update_weights(spark, sf_dir):
    g = indexed(spark, sf_dir, "cust")
    m = g.m()
    updates = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % m).alias("eid"), F.col("o_orderkey").alias("step"), (F.col("o_orderkey") % 7).alias("w"))
    return g.update_weights(updates).edges


@query(f"WITH {_edges_sql('cust')}, t AS (SELECT o_custkey AS v, sum(o_orderkey % 5) AS d FROM orders GROUP BY 1) SELECT nodes.v, CAST(coalesce(d, 0) AS BIGINT) AS phi FROM nodes LEFT JOIN t ON nodes.v = t.v")
def update_potentials(spark, sf_dir):
    deltas = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("v"), (F.col("o_orderkey") % 5).alias("delta"))
    return weighted(spark, sf_dir, "cust").update_potentials(deltas).nodes


def _one(name: str, sql: str, look: Callable[[Graph], DataFrame]) -> None:
    def run(spark, sf_dir):
        return look(indexed(spark, sf_dir, "cust"))

    run.__name__ = name
    query(f"WITH {_edges_sql('cust')}, e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, w FROM g) {sql}")(run)


_one("out_neighbors", "SELECT * FROM e WHERE src = 7", lambda g: g.out_neighbors(7))
_one("in_neighbors", "SELECT * FROM e WHERE dst = 7", lambda g: g.in_neighbors(7))
_one("edge_lookup", "SELECT * FROM e WHERE eid = 11", lambda g: g.edge(11))
_one("potential_lookup", "SELECT DISTINCT src AS v, (src * 31) % 50 AS phi FROM e WHERE src = 7", lambda g: _with_phi(g).potential(7))


@query(f"WITH {_edges_sql('nation')} SELECT src, dst FROM g")
def edgelist_read(spark, sf_dir):
    """A graph written as an edge list and read back: header, comment and all."""
    edges = weighted(spark, sf_dir, "nation").edges
    path = _scratch(spark, "edges")
    size = edges.agg(F.count("*").alias("m"), F.greatest(F.max("src"), F.max("dst")).alias("v")).first()
    head = spark.createDataFrame([(0, f"% from tables\np {size['v'] + 1} {size['m']}")], "k int, line string")
    lines = edges.select(F.lit(1).alias("k"), F.concat_ws(",", "src", "dst").alias("line")).unionByName(head)
    lines.repartition(1).sortWithinPartitions("k").select("line").write.option("lineSep", "\n").text(path)
    return edgelist.read(spark, path)[0].select("src", "dst")


@query(f"WITH {_edges_sql('cust')} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS place, src, dst, w FROM g")
def weighted_edges_written(spark, sf_dir):
    """Edges written as lines in order of their ends, and the lines read back in the order of the files."""
    path = _scratch(spark, "weighted")
    edgelist.write(weighted(spark, sf_dir, "cust").edges, path)
    lines = spark.read.schema("s BIGINT, d BIGINT, w BIGINT").csv(path)
    lines = lines.select(F.col("_metadata.file_name").alias("src"), F.monotonically_increasing_id().alias("dst"), "s", "d", "w")
    return index_edges(lines).select(F.col("eid").alias("place"), F.col("s").alias("src"), F.col("d").alias("dst"), "w")


@query(f"WITH {_edges_sql('cust')}, e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM g) SELECT eid, {duckdb_unit(7, 0, 'eid', 3)} * 100.0 AS w FROM e")
def initial_weights_float(spark, sf_dir):
    from edgeloom.functions.weights import initial_weight

    return indexed(spark, sf_dir, "cust").edges.withColumn("w", initial_weight(Initial("u"), 100, False, 7)).select("eid", "w")


# Generators and sources


@query("SELECT * FROM (VALUES ('cycle', 1.0::DOUBLE), ('complete', 4.0), ('loops', 5.0), ('gnp', 3.5), ('scale-free', 2.5), ('hyperbolic', 8.0), ('unnamed', 0.0)) t(source, degree)")
def nominal_degrees(spark, sf_dir):
    found = {"cycle": specs.Cycle(9), "complete": specs.Complete(5), "loops": specs.Complete(5, True), "gnp": specs.Gnp(50, 3.5), "scale-free": specs.ScaleFree(50, degree=2.5), "hyperbolic": specs.Hyperbolic(50, 1.0, degree=8.0), "unnamed": specs.ScaleFree(50, 0.2, 0.5)}
    return spark.createDataFrame([(k, specs.nominal_degree(v)) for k, v in found.items()], "source string, degree double")


@query("SELECT i AS src, (i + 1) % 5000 AS dst FROM range(5000) t(i)")
def gen_cycle(spark, sf_dir):
    return generators.cycle(spark, 5000)


@query("SELECT i AS src, j AS dst FROM range(120) a(i), range(120) b(j) WHERE i <> j")
def gen_complete(spark, sf_dir):
    return generators.complete(spark, 120)


@query(f"SELECT i // 300 AS src, i % 300 AS dst FROM range(90000) t(i) WHERE {duckdb_unit(1, 'i', 2)} < {10 / 300}")
def gen_gnp_hash(spark, sf_dir):
    return generators.gnp(spark, 300, 10 / 300, 1)


_RHG = Hyperbolic(400, 1.0, radius=10.0)
_POINTS = f"p AS (SELECT i AS id, {duckdb_unit(1, 'i', 2)} * 2 * pi() AS phi, acosh(1.0000000000000002 + {duckdb_unit(1, 'i', 3)} * (cosh(10.0) - 1)) AS r FROM range(400) t(i))"
_NEAR = "cosh(a.r) * cosh(b.r) - sinh(a.r) * sinh(b.r) * (cos(a.phi) * cos(b.phi) + sin(a.phi) * sin(b.phi)) < cosh(10.0)"


@query(f"WITH {_POINTS} SELECT a.id AS v, b.id AS w FROM p a JOIN p b ON a.id < b.id AND {_NEAR}")
def gen_rhg_theta(spark, sf_dir):
    return generators.hyperbolic_pairs(generators.coordinates(spark, _RHG, 1), _RHG.disc(), _RHG.limits())


_BID = "CASE " + " ".join(f"WHEN r >= {low!r} THEN {i}" for i, low in reversed(list(enumerate(_RHG.limits())))) + " END"


@query(f"WITH {_POINTS}, b AS (SELECT {_BID} AS bid, count(*) AS size FROM p GROUP BY 1) SELECT bid, size, CAST(sum(size) OVER (ORDER BY bid) - size AS BIGINT) AS first FROM b")
def gen_rhg_band(spark, sf_dir):
    sizes = generators.coordinates(spark, _RHG, 1).groupBy("bid").agg(F.count("*").alias("size"))
    return sizes.withColumn("first", F.sum("size").over(Window.orderBy("bid")) - F.col("size"))


@query(f"WITH {_POINTS}, e AS (SELECT a.id AS v, b.id AS w FROM p a JOIN p b ON a.id < b.id AND {_NEAR}), u AS (SELECT v, w, {duckdb_unit(1, 'v', 'w', 4)} AS u FROM e) SELECT v AS src, w AS dst FROM u WHERE u <= 0.65 UNION ALL SELECT w, v FROM u WHERE u <= 0.3 OR u > 0.65")
def rhg_orientation(spark, sf_dir):
    return generators.oriented(generators.hyperbolic_pairs(generators.coordinates(spark, _RHG, 1), _RHG.disc(), _RHG.limits()), 0.3, 1)


_RATES = [(None, None, None, None), (0.2, None, None, None), (None, 0.5, None, None), (None, None, 0.3, None), (0.2, 0.5, None, None), (0.2, None, 0.3, None), (None, 0.5, 0.3, None), (None, None, None, 4.0), (0.1, None, None, 4.0), (None, None, 0.1, 4.0)]
_VALUES = ", ".join("(" + ", ".join("CAST(NULL AS DOUBLE)" if x is None else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in _RATES)


@query(f"""WITH r(a, b0, c, d) AS (VALUES {_VALUES}), s AS (SELECT *, CASE WHEN d IS NOT NULL THEN (d - 1) / d ELSE b0 END AS b FROM r)
SELECT a AS given_alpha, b0 AS given_beta, c AS given_gamma, d AS degree,
 round(CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL AND c IS NOT NULL THEN 1 - b - c WHEN b IS NOT NULL THEN (1 - b) / 2 WHEN c IS NOT NULL THEN (1 - c) / 2 ELSE 1.0 / 3 END, 9) AS alpha,
 round(CASE WHEN b IS NOT NULL THEN b WHEN a IS NOT NULL AND c IS NOT NULL THEN 1 - a - c WHEN a IS NOT NULL THEN (1 - a) / 2 WHEN c IS NOT NULL THEN (1 - c) / 2 ELSE 1.0 / 3 END, 9) AS beta FROM s""")
def dsf_params(spark, sf_dir):
    rows = [(*r, *(round(x, 9) for x in scale_free_rates(*r))) for r in _RATES]
    return spark.createDataFrame(rows, "given_alpha double, given_beta double, given_gamma double, degree double, alpha double, beta double")


@query("SELECT count(*) FILTER (WHERE len(x) <> 2) AS bad_fields, count(*) FILTER (WHERE len(x) = 2 AND (u IS NULL OR v IS NULL)) AS bad_number, count(*) FILTER (WHERE len(x) = 2 AND u IS NOT NULL AND v IS NOT NULL AND (u >= 100000 OR v >= 100000)) AS bad_range, CAST(greatest(count(*) - 1000, 0) AS BIGINT) AS excess FROM (SELECT x, CASE WHEN regexp_full_match(x[1], '\\+?[0-9]+') THEN TRY_CAST(x[1] AS BIGINT) END AS u, CASE WHEN regexp_full_match(x[2], '\\+?[0-9]+') THEN TRY_CAST(x[2] AS BIGINT) END AS v FROM (SELECT string_split(CASE WHEN event_id % 11 = 0 THEN event_type WHEN event_id % 13 = 0 THEN 'x,1' ELSE user_id || ',' || (event_id * 7) END, ',') AS x FROM events))")
def edgelist_validate(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = events.select(F.expr("CASE WHEN event_id % 11 = 0 THEN event_type WHEN event_id % 13 = 0 THEN 'x,1' ELSE concat(user_id, ',', event_id * 7) END").alias("value"))
    return edgelist.violations(edgelist.parsed(lines, 100000), 1000)


# Traversal


@query(f"WITH RECURSIVE {_edges_sql('user')}{_SSSP.format(bound='')} SELECT v, dist FROM d")
def sssp(spark, sf_dir):
    g = weighted(spark, sf_dir, "user")
    return traverse.sssp(g, _source(g))


@query(f"WITH RECURSIVE {_edges_sql('cust')}{_SSSP.format(bound='')} SELECT v, dist FROM d")
def sssp_joins(spark, sf_dir):
    g = weighted(spark, sf_dir, "cust")
    return traverse.sssp(g, _source(g), plan="joins")


@query(f"WITH RECURSIVE {_edges_sql('user', POSITIVE)}{_SSSP.format(bound=' AND d.dist + g.w <= 12')} SELECT v, dist FROM d")
def sssp_bounded_joins(spark, sf_dir):
    g = weighted(spark, sf_dir, "user", POSITIVE)
    return traverse.sssp(g, _source(g), bound=12, plan="joins")


@query(f"WITH RECURSIVE {_edges_sql('user', POSITIVE)}{_SSSP.format(bound=' AND d.dist + g.w <= 12')} SELECT v, dist FROM d")
def sssp_bounded(spark, sf_dir):
    g = weighted(spark, sf_dir, "user", POSITIVE)
    return traverse.sssp(g, _source(g), bound=12)


@query(f"WITH RECURSIVE {_edges_sql('cust')}, s AS (SELECT min(v) AS v FROM nodes), r AS (SELECT v FROM s UNION SELECT dst FROM r JOIN g ON r.v = g.src) SELECT v FROM r")
def reachability(spark, sf_dir):
    g = weighted(spark, sf_dir, "cust")
    return traverse.reachable(g, _source(g))


@query(f"WITH RECURSIVE {_edges_sql('cust')}, s AS (SELECT min(v) AS v FROM nodes), r AS (SELECT v FROM s UNION SELECT dst FROM r JOIN g ON r.v = g.src) SELECT v FROM r")
def reachability_joins(spark, sf_dir):
    g = weighted(spark, sf_dir, "cust")
    return traverse.reachable(g, _source(g), plan="joins")


_NODES_D = ", d(v, dist) USING KEY (v) AS (SELECT v, CAST(0 AS BIGINT) FROM nodes UNION SELECT g.dst, CAST(min(d.dist + g.w) AS BIGINT) FROM d JOIN g ON d.v = g.src JOIN recurring.d AS o ON o.v = g.dst WHERE d.dist + g.w < o.dist GROUP BY g.dst)"


@query(f"WITH RECURSIVE {_edges_sql('user')}{_NODES_D} SELECT v, -dist AS phi FROM d")
def potentials(spark, sf_dir):
    return traverse.potentials(weighted(spark, sf_dir, "user"))


@query(f"WITH RECURSIVE {_edges_sql('cust')}{_NODES_D} SELECT v, -dist AS phi FROM d")
def potentials_joins(spark, sf_dir):
    return traverse.potentials(weighted(spark, sf_dir, "cust"), plan="joins")


#: Least walks of k edges, loops of weight 0 among them: a negative cycle is what still lowers one in round n.
_ROUNDS = ", h AS (SELECT src, dst, w FROM g UNION ALL SELECT v, v, 0 FROM nodes), t(k, v, dist) AS (SELECT CAST(0 AS BIGINT), v, CAST(0 AS BIGINT) FROM nodes UNION ALL SELECT k + 1, h.dst, CAST(min(dist + w) AS BIGINT) FROM t JOIN h ON v = src WHERE k < (SELECT count(*) FROM nodes) GROUP BY k, h.dst)"
_LOWERS = "EXISTS (SELECT 1 FROM t a JOIN t b ON a.v = b.v AND b.k = a.k + 1 WHERE b.k = (SELECT count(*) FROM nodes) AND b.dist < a.dist)"


def _negative_cycle(name: str, graph: str, weight: str, plan: str) -> None:
    def run(spark, sf_dir):
        g = weighted(spark, sf_dir, graph, weight)
        return g.edges.agg((F.count_if(F.col("w") < 0) > 0).alias("negative_edges")).withColumn("negative_cycle", F.lit(traverse.has_negative_cycle(g, plan)))

    run.__name__ = name
    query(f"WITH RECURSIVE {_edges_sql(graph, weight)}{_ROUNDS} SELECT (SELECT count(*) FILTER (WHERE w < 0) > 0 FROM g) AS negative_edges, {_LOWERS} AS negative_cycle")(run)


_negative_cycle("negative_cycle_good", "user", PLANTED, "auto")
_negative_cycle("negative_cycle_bad", "nation", RAW, "auto")
_negative_cycle("negative_cycle_good_joins", "user", PLANTED, "joins")
_negative_cycle("negative_cycle_bad_joins", "user", RAW, "joins")


@query(f"WITH RECURSIVE {_edges_sql('cust')}, p AS (SELECT dst AS v, min(src) AS pred FROM g GROUP BY dst), q AS (SELECT nodes.v, p.pred FROM nodes LEFT JOIN p ON p.v = nodes.v), ok AS (SELECT v FROM q WHERE pred IS NULL UNION SELECT q.v FROM q JOIN ok ON q.pred = ok.v) SELECT v FROM q WHERE v NOT IN (SELECT v FROM ok)")
def pred_forest_rootless(spark, sf_dir):
    g = weighted(spark, sf_dir, "cust")
    least = g.edges.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("pred"))
    return traverse.rootless(g.nodes.select("v").join(least, "v", "left"))


@query(f"WITH RECURSIVE {_edges_sql('user', POSITIVE)}{_SSSP.format(bound='')} SELECT dist FROM d WHERE v = (SELECT max(v) FROM nodes)")
def bidirectional_meet(spark, sf_dir):
    g = weighted(spark, sf_dir, "user", POSITIVE)
    ends = g.nodes.agg(F.min("v"), F.max("v")).first()
    return traverse.bidirectional(g, ends[0], ends[1], 1 << 40)


_APSP = ", d(s, v, dist) USING KEY (s, v) AS (SELECT v, v, CAST(0 AS BIGINT) FROM nodes UNION SELECT d.s, g.dst, CAST(min(d.dist + g.w) AS BIGINT) FROM d JOIN g ON d.v = g.src LEFT JOIN recurring.d AS o ON o.s = d.s AND o.v = g.dst WHERE o.dist IS NULL OR d.dist + g.w < o.dist GROUP BY d.s, g.dst)"


@query(f"WITH RECURSIVE {_edges_sql('nation')}{_APSP} SELECT CASE WHEN count(*) = (SELECT count(*) * count(*) FROM nodes) THEN CAST(sum(dist) AS DOUBLE) / count(*) END AS mean, greatest(CAST(max(dist) AS DOUBLE), 0.0) AS max, count(*) AS reached FROM d")
def apsp_mean_max(spark, sf_dir):
    return traverse.apsp_summary(weighted(spark, sf_dir, "nation"))


@query(f"WITH RECURSIVE {_edges_sql('nation')}{_APSP} SELECT s AS source, v, dist FROM d")
def apsp(spark, sf_dir):
    return traverse.apsp(weighted(spark, sf_dir, "nation"))


@query(f"WITH RECURSIVE {_edges_sql('nation')}{_APSP} SELECT s AS source, v, dist FROM d")
def apsp_joins(spark, sf_dir):
    return traverse.apsp(weighted(spark, sf_dir, "nation"), plan="joins")


_GOLDEN = [(0, 1, -1), (0, 2, -1), (1, 3, -1), (1, 4, -1), (2, 1, -1), (2, 3, -1), (3, 0, 3), (3, 1, 1), (3, 4, 0), (4, 0, 3)]


@query("WITH RECURSIVE g(src, dst, w) AS (VALUES " + ", ".join(f"(CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({w} AS BIGINT))" for a, b, w in _GOLDEN) + "), nodes AS (SELECT src AS v FROM g UNION SELECT dst FROM g)" + _APSP + " SELECT s AS source, v, dist FROM d")
def fixture_apsp(spark, sf_dir):
    return traverse.apsp(Graph.of(spark.createDataFrame(_GOLDEN, "src long, dst long, w long"), 5))


@query("WITH RECURSIVE g(src, dst, w) AS (VALUES " + ", ".join(f"(CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({w} AS BIGINT))" for a, b, w in _GOLDEN) + "), nodes AS (SELECT src AS v FROM g UNION SELECT dst FROM g)" + _APSP + ", q AS (SELECT * FROM (VALUES (0, 3, -3), (0, 3, -2), (1, 2, 2)) t(source, target, bound)) SELECT q.source, q.target, CAST(bound AS BIGINT) AS bound, dist < bound AS shorter FROM q JOIN d ON d.s = q.source AND d.v = q.target")
def shorter_paths(spark, sf_dir):
    """Searches that end at a bound: is there a shorter path?"""
    g = Graph.of(spark.createDataFrame(_GOLDEN, "src long, dst long, w long"), 5)
    asked = [(0, 3, -3), (0, 3, -2), (1, 2, 2)]
    return spark.createDataFrame([(*q, traverse.shorter_path(g, *q)) for q in asked], "source int, target int, bound long, shorter boolean")


_REACH = ", r AS (SELECT src AS a, dst AS b FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src), both_ways AS (SELECT x.a, min(x.b) AS low FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), l AS (SELECT nodes.v, least(nodes.v, coalesce(low, nodes.v)) AS scc FROM nodes LEFT JOIN both_ways ON a = v)"
_LABELS = f"WITH RECURSIVE {_edges_sql('user', where=SPARSE)}{_REACH} SELECT v, scc FROM l"
_LARGEST = f"WITH RECURSIVE {_edges_sql('user', where=SPARSE)}{_REACH}, big AS (SELECT scc FROM l GROUP BY scc ORDER BY count(*) DESC, scc LIMIT 1), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS new FROM l WHERE scc = (SELECT scc FROM big)) SELECT row_number() OVER (ORDER BY a.new, b.new) - 1 AS eid, a.new AS src, b.new AS dst, w FROM g JOIN k a ON a.v = src JOIN k b ON b.v = dst"


@query(_LABELS)
def scc_labels(spark, sf_dir):
    return structure.scc(sparse(spark, sf_dir, "user"))


@query(_LABELS)
def scc_labels_joins(spark, sf_dir):
    return structure.scc(sparse(spark, sf_dir, "user"), plan="joins")


@query(_LARGEST)
def largest_scc(spark, sf_dir):
    return structure.largest_scc(sparse(spark, sf_dir, "user")).edges


@query(_LARGEST)
def largest_scc_joins(spark, sf_dir):
    return structure.largest_scc(sparse(spark, sf_dir, "user"), plan="joins").edges


# Chains on the cycle and coverage


@query("SELECT i AS enc, CAST((i % 3) + (i // 3 % 3) + (i // 9 % 3) + (i // 27 % 3) + (i // 81 % 3) + (i // 243 % 3) + (i // 729 % 3) + (i // 2187 % 3) - 8 AS BIGINT) AS total FROM range(6561) t(i) WHERE total >= 0")
def valid_states(spark, sf_dir):
    return cycle.valid_states(spark, 8)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (2, 2), (3, 5), (4, 14)) t(id, enc)")
def encode_states(spark, sf_dir):
    rows = spark.createDataFrame([(1, [0]), (2, [1]), (3, [1, 0]), (4, [1, 0, 0])], "id long, w array<long>")
    return rows.select("id", cycle.encode(F.col("w"), -1, 1).alias("enc"))


def _chain_sql(n: int, low: int, high: int, initial: int, first: int, last: int, chains: int, seed: int) -> str:
    """c (chain, step, weights, total): the state after each step."""
    e, w = f"{duckdb_draw(seed, 'chain', 'step + 1', 0)} % {n}", f"({low} + {duckdb_draw(seed, 'chain', 'step + 1', 1)} % {high - low + 1})"
    start = f"[{', '.join([f'CAST({initial} AS BIGINT)'] * n)}]"
    return f"""c(chain, step, weights, total) AS (SELECT i, CAST({first - 1} AS BIGINT), {start}, CAST({n * initial} AS BIGINT) FROM range({chains}) t(i)
 UNION ALL SELECT chain, step + 1, CASE WHEN total - weights[e + 1] + w >= 0 THEN list_concat(list_concat(weights[1:e], [w]), weights[e + 2:]) ELSE weights END, CASE WHEN total - weights[e + 1] + w >= 0 THEN total - weights[e + 1] + w ELSE total END
 FROM (SELECT *, CAST({e} AS BIGINT) AS e, CAST({w} AS BIGINT) AS w FROM c WHERE step < {last}))"""


@query(f"WITH RECURSIVE {_chain_sql(20, -10, 10, 10, 0, 200, 20, 5)} SELECT chain, step AS at, CAST(unnest(range(20)) AS BIGINT) AS edge, unnest(weights) AS weight FROM c WHERE step IN (10, 20, 40, 100, 200)")
def cycle_chain_dist(spark, sf_dir):
    return cycle.cycle_chain(spark, 20, -10, 10, "m", 20, 5)


@query(f"WITH RECURSIVE {_chain_sql(1000, -100, 100, 0, 0, 10000, 1, 6)} SELECT chain, step AS at, CAST(unnest(range(1000)) AS BIGINT) AS edge, unnest(weights) AS weight FROM c WHERE step IN (500, 1000, 2000, 5000, 10000)")
def cycle_chain_long(spark, sf_dir):
    return cycle.cycle_chain(spark, 1000, -100, 100, "z", 1, 6)


@query(f"WITH RECURSIVE {_chain_sql(20, -10, 10, 7, 0, 200, 4, 8)} SELECT step / 20 AS round, CAST(unnest(weights) AS DOUBLE) AS weight, 'v' AS initial FROM c WHERE step IN (10, 20, 40, 100, 200)")
def cycledist(spark, sf_dir):
    return cycle.cycledist(spark, 20, -10, 10, "7", 4, 8)


_COVER = f"WITH RECURSIVE {_chain_sql(4, -1, 1, 0, 1, 12, 600, 3)}, s AS (SELECT chain AS run, (weights[1] + 1) + (weights[2] + 1) * 3 + (weights[3] + 1) * 9 + (weights[4] + 1) * 27 AS enc FROM c WHERE step = 12), valid AS (SELECT i AS enc FROM range(81) t(i) WHERE i % 3 + i // 3 % 3 + i // 9 % 3 + i // 27 % 3 >= 4)"


def _cover(spark: SparkSession) -> DataFrame:
    return cycle.final_states(spark, 4, -1, 1, 12, 600, 3)


@query(f"{_COVER} SELECT enc, count(*) AS cnt FROM s GROUP BY enc")
def cover_hist(spark, sf_dir):
    return cycle.histogram(_cover(spark))


@query(f"{_COVER}, h AS (SELECT enc, count(*) AS k FROM s GROUP BY enc) SELECT coalesce(k, 0) AS freq, count(*) AS cnt FROM valid LEFT JOIN h ON valid.enc = h.enc GROUP BY 1")
def cover_freq_of_freq(spark, sf_dir):
    return cycle.frequency_of_frequencies(_cover(spark), cycle.valid_states(spark, 4))


@query("SELECT o_orderkey AS run, o_orderkey % 81 AS enc FROM orders WHERE o_orderkey % 81 % 3 + o_orderkey % 81 // 3 % 3 + o_orderkey % 81 // 9 % 3 + o_orderkey % 81 // 27 % 3 >= 4")
def legal_members(spark, sf_dir):
    """Of any states those that are legal."""
    states = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 81).alias("enc"))
    return cycle.legal(states, cycle.valid_states(spark, 4))


@query(f"{_COVER}, f AS (SELECT enc, min(run) AS run FROM s GROUP BY enc), r AS (SELECT run, row_number() OVER (ORDER BY run) AS seen FROM f) SELECT min(run) AS completion_run FROM r WHERE seen = (SELECT count(*) - count(*) // 4 FROM valid)")
def cover_completion(spark, sf_dir):
    valid = cycle.valid_states(spark, 4).count()
    return cycle.completion(_cover(spark), valid, 4)


@query(f"WITH v AS (SELECT i AS enc, row_number() OVER (ORDER BY i) - 1 AS place FROM range(81) t(i) WHERE i % 3 + i // 3 % 3 + i // 9 % 3 + i // 27 % 3 >= 4), d AS (SELECT i AS run, {duckdb_draw(9, 'i', 0, 5)} % (SELECT count(*) FROM v) AS place FROM range(5000) t(i)) SELECT run, enc FROM d JOIN v ON d.place = v.place")
def uniform_state_baseline(spark, sf_dir):
    return cycle.uniform_states(spark, 4, -1, 1, 5000, 9)


_SWEEP = f"""WITH RECURSIVE {_chain_sql(4, -1, 1, 0, 1, 3, 3200, 2)}, valid AS (SELECT i AS enc, row_number() OVER (ORDER BY i) - 1 AS place FROM range(81) t(i) WHERE i % 3 + i // 3 % 3 + i // 9 % 3 + i // 27 % 3 >= 4),
ids AS (SELECT i AS id, i // 1600 AS repetition, i // 400 % 4 AS setting, i % 400 AS run FROM range(3200) t(i)),
e AS (SELECT repetition, setting, run, (weights[1] + 1) + (weights[2] + 1) * 3 + (weights[3] + 1) * 9 + (weights[4] + 1) * 27 AS enc FROM ids JOIN c ON chain = id AND step = setting WHERE setting > 0
 UNION ALL SELECT repetition, setting, run, enc FROM ids JOIN valid ON place = {duckdb_draw(2, 'id', 0, 5)} % 50 WHERE setting = 0),
f AS (SELECT repetition, setting, enc, min(run) AS run, count(*) AS freq FROM e GROUP BY 1, 2, 3),
done AS (SELECT repetition, setting, run AS completion_run FROM f QUALIFY row_number() OVER (PARTITION BY repetition, setting ORDER BY run) = 50),
z AS (SELECT repetition, setting, freq, count(*) AS cnt FROM f GROUP BY 1, 2, 3 UNION ALL SELECT repetition, setting, 0, 50 - count(*) FROM f GROUP BY 1, 2 HAVING count(*) < 50)
SELECT z.repetition, z.setting, CAST(z.setting AS BIGINT) AS steps, string_agg(freq || ':' || cnt, ' ' ORDER BY freq) AS frequencies, any_value(completion_run) AS completion_run
FROM z LEFT JOIN done ON done.repetition = z.repetition AND done.setting = z.setting GROUP BY 1, 2, 3"""


@query(_SWEEP)
def coverage_sweep(spark, sf_dir):
    out = cycle.coverage(spark, 4, -1, 1, steps=4, runs=8, repetitions=2, seed=2)
    listed = F.array_join(F.transform("count_of_frequencies", lambda x: F.concat_ws(":", x["freq"].cast("string"), x["cnt"].cast("string"))), " ")
    return out.select("repetition", "setting", "steps", listed.alias("frequencies"), "completion_run")


# Chains on graphs


def _simple_cycles(edges: list[tuple[int, int]]) -> list[list[int]]:
    """The simple cycles of a small graph, as places of their edges."""
    found: list[list[int]] = []

    def walk(start: int, at: int, used: list[int], seen: set[int]) -> None:
        for i, (u, v) in enumerate(edges):
            if u == at and v == start:
                found.append([*used, i])
            elif u == at and v > start and v not in seen:
                walk(start, v, [*used, i], seen | {v})

    for s in sorted({u for u, _ in edges}):
        walk(s, s, [], {s})
    return found


_STEPS, _CHAINS, _SEED, _LOW, _HIGH = 400, 4, 13, -3, 5
_LEGAL = " AND ".join("p[" + "] + p[".join(str(i + 1) for i in c) + "] >= 0" for c in _simple_cycles([(a, b) for a, b, _ in _GOLDEN]))
#: m (chain, step, eid, w_new, accepted, lower, weights): the golden graph's chains, a proposal being legal if no simple cycle is negative.
_MCMC = f"""WITH RECURSIVE m(chain, step, eid, w_new, accepted, lower, weights) AS (
 SELECT CAST(i AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true, false, [{', '.join(f'CAST({w} AS BIGINT)' for _, _, w in _GOLDEN)}] FROM range({_CHAINS}) t(i)
 UNION ALL SELECT chain, step + 1, e, w, ok, w < weights[e + 1], CASE WHEN ok THEN p ELSE weights END FROM (
  SELECT *, {_LEGAL} AS ok FROM (SELECT *, list_concat(list_concat(weights[1:e], [w]), weights[e + 2:]) AS p FROM (
   SELECT chain, step, weights, CAST({duckdb_draw(_SEED, 'chain', 'step + 1', 0)} % {len(_GOLDEN)} AS BIGINT) AS e, CAST({_LOW} + {duckdb_draw(_SEED, 'chain', 'step + 1', 1)} % {_HIGH - _LOW + 1} AS BIGINT) AS w FROM m WHERE step < {_STEPS}))))"""


def _golden_chains(spark: SparkSession, algorithm: str, want: str = "trace") -> DataFrame:
    g = Graph.of(spark.createDataFrame(_GOLDEN, "src long, dst long, w long"), 5)
    return sampling.run_chains(g, _LOW, _HIGH, _STEPS / len(_GOLDEN), algorithm, _CHAINS, _SEED, want)


def _golden_trace(algorithm: str) -> Query:
    def run(spark, sf_dir):
        kind = ["kind"] if algorithm == "bf" else []  # searches of the others depend on their potentials
        return _golden_chains(spark, algorithm).select("chain", "step", "eid", "w_new", "accepted", *kind)

    run.__name__ = f"mcmc_trace_{algorithm}"
    return run


for _algorithm in sampling.ALGORITHMS:
    _kind_sql = ", CASE WHEN lower THEN 'search' ELSE 'quick' END AS kind" if _algorithm == "bf" else ""
    query(f"{_MCMC} SELECT chain, step, eid, CAST(w_new AS DOUBLE) AS w_new, accepted{_kind_sql} FROM m WHERE step > 0")(_golden_trace(_algorithm))


@query(f"{_MCMC} SELECT chain, CAST(unnest(range({len(_GOLDEN)})) AS BIGINT) AS eid, CAST(unnest(weights) AS DOUBLE) AS w FROM m WHERE step = {_STEPS}")
def mcmc_weights(spark, sf_dir):
    return _golden_chains(spark, "bd", "final").select("chain", "eid", "w")


@query(f"{_MCMC}, a AS (SELECT chain, step, CAST(sum(CAST(accepted AS BIGINT)) OVER (PARTITION BY chain ORDER BY step) AS DOUBLE) / step AS ratio FROM m WHERE step > 0) SELECT chain, (step + 99) // 100 * 100 AS round, round(avg(ratio), 9) AS rate FROM a GROUP BY 1, 2")
def mcmc_acceptance(spark, sf_dir):
    return telemetry.acceptance(_golden_chains(spark, "d")).withColumn("rate", F.round("rate", 9))


@query(f"{_MCMC} SELECT CASE WHEN accepted THEN 'acc' ELSE 'rej' END AS acc, count(*) AS n FROM m WHERE step > 0 AND lower GROUP BY 1")
def mcmc_searches(spark, sf_dir):
    return telemetry.insertions(_golden_chains(spark, "bf")).groupBy("acc").agg(F.count("*").alias("n"))


_INTERVALS = f"{_MCMC} SELECT chain, (step + 1) // 50 AS round, round(list_sum(weights) / {len(_GOLDEN)}, 9) AS avg, round(len(list_filter(weights, lambda x: x < 0)) / {len(_GOLDEN)}, 9) AS frac, 'bd' AS algo FROM m WHERE step % 50 = 49"


def _interval_rows(spark: SparkSession) -> DataFrame:
    g = Graph.of(spark.createDataFrame(_GOLDEN, "src long, dst long, w long"), 5)
    rows = sampling.run_chains(g, _LOW, _HIGH, _STEPS / len(_GOLDEN), "bd", _CHAINS, _SEED, "intervals", 50)
    return rows.withColumn("avg", F.round("avg", 9)).withColumn("frac", F.round("frac", 9))


@query(_INTERVALS)
def mcmc_intervals(spark, sf_dir):
    return _interval_rows(spark).select("chain", "round", "avg", "frac", "algo")


@query(f"SELECT round, avg, frac, algo FROM ({_INTERVALS})")
def telemetry_roundtrip(spark, sf_dir):
    """Interval telemetry written to the shared folder and read back."""
    path = _scratch(spark, "intervals")
    tables.write(_interval_rows(spark), "intervals", path)
    return tables.read(spark, "intervals", path).where("time >= 0").select("round", "avg", "frac", "algo")


def _chains(spark: SparkSession, sf_dir: str, algorithm: str, want: str) -> DataFrame:
    g = indexed(spark, sf_dir, "nation", "100")
    return sampling.run_chains(g, -100, 100, 3.0, algorithm, 4, 11, want)


def _stats(algorithm: str) -> Query:
    def run(spark, sf_dir):
        rows = _golden_chains(spark, algorithm, "final")
        violated = [F.max(F.when(F.col("w") + F.col("phi_dst") - F.col("phi_src") < 0, 1).otherwise(0)).alias("violated")] if algorithm != "bf" else []
        return rows.groupBy("chain").agg(F.count("*").alias("m"), F.round(F.avg("w"), 9).alias("avg_weight"), F.avg((F.col("w") < 0).cast("double")).alias("frac_negative"), *violated)

    run.__name__ = f"mcmc_stats_{algorithm}"
    return run


for _algorithm in sampling.ALGORITHMS:
    _violated = ", CAST(0 AS INTEGER) AS violated" if _algorithm != "bf" else ""
    query(f"{_MCMC} SELECT chain, CAST({len(_GOLDEN)} AS BIGINT) AS m, round(list_sum(weights) / {len(_GOLDEN)}, 9) AS avg_weight, len(list_filter(weights, lambda x: x < 0)) / {len(_GOLDEN)} AS frac_negative{_violated} FROM m WHERE step = {_STEPS}")(_stats(_algorithm))


@query("SELECT CAST(i AS BIGINT) AS chain, CAST(0 AS BIGINT) AS differing FROM range(4) t(i)")
def mcmc_trace_agree(spark, sf_dir):
    """By chain, the steps on which the three deciders disagree: none."""
    sides = [_chains(spark, sf_dir, a, "trace").select("chain", "step", "eid", "w_new", F.col("accepted").cast("int").alias("accepted")) for a in sampling.ALGORITHMS]
    all_ = sides[0].unionByName(sides[1]).unionByName(sides[2])
    steps = all_.groupBy("chain", "step", "eid", "w_new").agg(F.sum("accepted").alias("yes"), F.count("*").alias("n"))
    return steps.groupBy("chain").agg(F.count_if(~F.col("yes").isin(0, 3) | (F.col("n") != 3)).alias("differing"))


# Telemetry


def trace(spark: SparkSession, sf_dir: str, chain: str = "user_id") -> DataFrame:
    """Telemetry read off the event stream: a user (or event type) is a chain, events in order are its steps."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = F.row_number().over(Window.partitionBy(chain).orderBy("ts", "event_id")).cast("bigint")
    return events.select(F.col(chain).alias("chain"), step.alias("step"), (F.pmod(F.col("event_id") * 7919, F.lit(10)) < 6).alias("accepted"), F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, "search").otherwise("quick").alias("kind"), F.pmod(F.col("event_id") * 31, F.lit(97)).alias("insertions"), F.col("event_type").alias("algo"), "value", "event_id")


_TRACE = "WITH t AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id * 7919 % 10 < 6 AS accepted, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'quick' END AS kind, event_id * 31 % 97 AS insertions, event_type AS algo, value, event_id FROM events)"
_RATIO = f"{_TRACE}, a AS (SELECT chain, step, CAST(sum(CAST(accepted AS BIGINT)) OVER (PARTITION BY chain ORDER BY step) AS DOUBLE) / step AS ratio FROM t)"


@query(f"{_RATIO} SELECT chain, step // 10 AS round, ratio AS rate FROM a WHERE step % 10 = 0")
def intervals_report(spark, sf_dir):
    return telemetry.intervals(trace(spark, sf_dir), 10)


@query(f"{_RATIO.replace('user_id', 'event_type')}, b AS (SELECT *, CASE WHEN step <= 10000 THEN 100 WHEN step <= 100000 THEN 1000 WHEN step <= 1000000 THEN 10000 ELSE 100000 END AS size FROM a), c AS (SELECT chain, (step + size - 1) // size * size AS round, avg(ratio) AS rate, max(step) AS last FROM b GROUP BY 1, 2) SELECT chain, round, round(rate, 9) AS rate FROM c WHERE last = round")
def acceptance_windows(spark, sf_dir):
    return telemetry.acceptance(trace(spark, sf_dir, "event_type")).withColumn("rate", F.round("rate", 9))


@query(f"{_TRACE} SELECT algo, CASE WHEN accepted THEN 'acc' ELSE 'rej' END AS acc, count(*) AS n, quantile_cont(insertions, 0.25) AS q25, quantile_cont(insertions, 0.5) AS q50, quantile_cont(insertions, 0.75) AS q75 FROM t WHERE kind = 'search' GROUP BY 1, 2")
def insertions_quantiles(spark, sf_dir):
    rows = trace(spark, sf_dir).where("kind = 'search'").withColumn("acc", F.when(F.col("accepted"), "acc").otherwise("rej"))
    counts = rows.groupBy("algo", "acc").agg(F.count("*").alias("n"))
    return counts.join(telemetry.quartiles(rows, "insertions", ["algo", "acc"]), ["algo", "acc"])


@query("SELECT event_id % 300 + 1 AS round, event_id * 31 % 97 AS time, (event_id % 300 + 1) * 10000 AS step, event_id * 31 % 97 / 10 AS us_per_step FROM events")
def step_times(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 300 + 1).alias("round"), (F.col("event_id") * 31 % 97).alias("time"))
    return telemetry.step_times(rows)


@query(f"{_TRACE} SELECT chain, step, algo FROM t QUALIFY count(*) OVER (PARTITION BY step, algo) > 9")
def group_size_filter(spark, sf_dir):
    return telemetry.min_group_size(trace(spark, sf_dir), ["step", "algo"]).select("chain", "step", "algo")


@query("SELECT p_partkey, CASE p_size WHEN 6 THEN 10 WHEN 14 THEN 20 WHEN 47 THEN 50 ELSE p_size END AS p_size FROM part")
def recode_labels(spark, sf_dir):
    return telemetry.recode(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_size", {6: 10, 14: 20, 47: 50})


@query(f"{_TRACE} SELECT chain, step, 'd' AS gen FROM t WHERE algo = 'click' UNION ALL SELECT chain, step, 'bd' FROM t WHERE algo <> 'click'")
def telemetry_union(spark, sf_dir):
    t = trace(spark, sf_dir)
    return telemetry.tagged_union({"d": t.where("algo = 'click'").select("chain", "step"), "bd": t.where("algo <> 'click'").select("chain", "step")}, "gen")


_COVERAGE = "r AS (SELECT p_size % 3 * 4 + 8 AS nodes, p_size % 5 * 2 AS steps, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 1000 + 1 END AS completion_run, p_partkey AS id FROM part)"


@query(f"WITH {_COVERAGE}, a AS (SELECT *, avg(CASE WHEN steps = 0 THEN completion_run END) OVER (PARTITION BY nodes) AS m, count(completion_run) OVER (PARTITION BY nodes, steps) / count(*) OVER (PARTITION BY nodes, steps) AS f FROM r) SELECT id, round(m, 9) AS opt_mean, round(completion_run / m, 9) AS normalised, round(f, 9) AS frac_coverage, round(steps / nodes, 9) AS x FROM a")
def coverage_normalised(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.expr("p_size % 3 * 4 + 8").alias("nodes"), F.expr("p_size % 5 * 2").alias("steps"), F.expr("CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 1000 + 1 END").alias("completion_run"), F.col("p_partkey").alias("id"))
    out = telemetry.normalise_coverage(rows)
    return out.select("id", *[F.round(c, 9).alias(c) for c in ("opt_mean", "normalised", "frac_coverage", "x")])


@query("SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75 FROM lineitem GROUP BY 1, 2")
def quartiles(spark, sf_dir):
    return telemetry.quartiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", ["l_returnflag", "l_linestatus"])


_LETTERS = " UNION ALL ".join(f"SELECT l_returnflag, {k} AS letter, round(quantile_cont(l_extendedprice, {2.0**-k}), 6) AS low, round(quantile_cont(l_extendedprice, {1 - 2.0**-k}), 6) AS high FROM lineitem GROUP BY 1" for k in range(1, 5))


@query(_LETTERS)
def letter_values(spark, sf_dir):
    out = telemetry.letter_values(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "letter", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_TIMES = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in telemetry.POISSON)


@query(f"WITH e AS (SELECT event_type, CAST(value AS DOUBLE) AS x, b, {duckdb_unit(1, 'b', 'event_id')} AS u FROM events, range(40) t(b)), m AS (SELECT event_type, b, sum(x * ({_TIMES})) / sum({_TIMES}) AS m FROM e GROUP BY 1, 2), a AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) SELECT event_type, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN a USING (event_type) GROUP BY 1")
def bootstrap_mean_ci(spark, sf_dir):
    out = telemetry.mean_interval(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"], "event_id", 40)
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in found.items() if sql}
