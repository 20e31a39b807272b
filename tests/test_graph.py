import math
import random

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import prng, weights
from edgeloom.graph import Graph, undirected
from edgeloom.operators import cycle, local, sampling, structure, telemetry, traverse
from edgeloom.plans import catalogue
from edgeloom.sources import edgelist, generators, specs
from edgeloom.sources import telemetry as tables

@pytest.fixture(params=["one task", "joins"])
def path(request, monkeypatch):
    """Both ways to solve a graph: in one task, and by iterated joins."""
    if request.param == "joins":
        monkeypatch.setattr(local, "EDGES", -1)


PAIRS = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 1), (2, 3), (3, 0), (3, 1), (3, 4), (4, 0)]
GOOD = [[-1, -1, -1, -1, -1, -1, 3, 1, 0, 3], [0] * 10, [1] * 10]
BAD = [[-1, -1, -1, -1, -1, -1, 3, 1, 0, 2], [-1] * 10]
DISTANCES = [
    [[0, -2, -1, -3, -3], [2, 0, 1, -1, -1], [1, -1, 0, -2, -2], [3, 1, 2, 0, 0], [3, 1, 2, 0, 0]],
    [[0] * 5] * 5,
    [[0, 1, 1, 2, 2], [2, 0, 3, 1, 1], [2, 1, 0, 1, 2], [1, 1, 2, 0, 1], [1, 2, 2, 3, 0]],
]


def golden(spark, w):
    return Graph.of(spark.createDataFrame([(*e, x) for e, x in zip(PAIRS, w)], "src long, dst long, w long"), 5)


@pytest.mark.parametrize("k", range(3))
def test_golden_distances(spark, path, k, request):
    if k and local.EDGES < 0:
        pytest.skip("one graph is enough for the joins")
    rows = traverse.apsp(golden(spark, GOOD[k])).collect()
    assert len(rows) == 25
    assert all(r["dist"] == DISTANCES[k][r["source"]][r["v"]] for r in rows)


def test_zero_cycles_are_legal_and_negative_ones_found(spark, path):
    assert not traverse.has_negative_cycle(golden(spark, GOOD[0]))
    assert all(traverse.has_negative_cycle(golden(spark, w)) for w in BAD)
    g = golden(spark, GOOD[0])
    assert Graph(g.edges, traverse.potentials(g)).is_feasible()
    with pytest.raises(ValueError):
        traverse.sssp(golden(spark, BAD[1]), 0)


def test_bounds_and_meeting(spark, path):
    g = golden(spark, GOOD[2])
    assert {r["v"]: r["dist"] for r in traverse.sssp(g, 0, bound=1).collect()} == {0: 0, 1: 1, 2: 1}
    assert traverse.bidirectional(g, 0, 3, 3).first()["dist"] == 2
    assert traverse.bidirectional(g, 0, 3, 2).first()["dist"] is None
    with pytest.raises(ValueError):
        traverse.bidirectional(golden(spark, BAD[1]), 0, 3, 2)
    for s, t in zip(range(5), [4, 2, 4, 2, 3]):
        exact = DISTANCES[2][s][t]
        assert not traverse.shorter_path(g, s, t, exact)
        assert traverse.shorter_path(g, s, t, exact + 1)
    assert traverse.apsp_summary(g).first()["max"] == 3


def test_pointer_doubling(spark):
    rows = [(0, None), (1, 0), (2, 1), (3, 4), (4, 3), (5, 4)]
    assert {r["v"] for r in traverse.rootless(spark.createDataFrame(rows, "v long, pred long")).collect()} == {3, 4, 5}
    assert traverse.is_acyclic(spark.createDataFrame(rows[:3], "v long, pred long"))


def brute_scc(n, edges):
    reach = [[i == j for j in range(n)] for i in range(n)]
    for a, b in edges:
        reach[a][b] = True
    for k in range(n):
        for i in range(n):
            for j in range(n):
                reach[i][j] = reach[i][j] or reach[i][k] and reach[k][j]
    return {v: min(u for u in range(n) if reach[u][v] and reach[v][u]) for v in range(n)}


def test_components(spark, path):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(20)})
    g = Graph.of(spark.createDataFrame(edges, "src long, dst long"), 14)
    want = brute_scc(14, edges)
    assert {r["v"]: r["scc"] for r in structure.scc(g).collect()} == want
    loops = {a for a, b in edges if a == b}
    sizes = {s: sum(x == s for x in want.values()) for s in want.values()}
    assert {r["v"] for r in structure.scc(g, False).collect()} == {v for v, s in want.items() if sizes[s] > 1 or v in loops}
    big = structure.largest_scc(golden(spark, GOOD[1]))
    assert big.n() == 5 and big.m() == 10
    with pytest.raises(ValueError):
        structure.largest_scc(Graph.of(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")))


def test_graph_access(spark):
    g = golden(spark, GOOD[0])
    assert g.n() == 5 and g.m() == 10
    assert [r["dst"] for r in g.out_neighbors(3).orderBy("dst").collect()] == [0, 1, 4]
    assert [r["src"] for r in g.in_neighbors(1).orderBy("src").collect()] == [0, 2, 3]
    assert g.edge(6).first()[1:] == (3, 0, 3)
    later = g.update_weights(spark.createDataFrame([(6, 9, 1), (6, 7, 2)], "eid long, w long, step long"))
    assert later.edge(6).first()["w"] == 7
    assert g.update_potentials(spark.createDataFrame([(1, 4), (1, 2)], "v long, delta long")).potential(1).first()["phi"] == 6
    assert undirected(g.edges.select("src", "dst")).count() == 20
    assert g.stats().first()["frac_negative"] == 0.6
    sub = g.induced(spark.createDataFrame([(1,), (3,), (4,)], "v long"))
    assert [(r["eid"], r["src"], r["dst"]) for r in sub.edges.orderBy("eid").collect()] == [(0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 2)]
    with pytest.raises(ValueError):
        Graph.of(spark.createDataFrame([(0, 1)], "src long, dst long"))


def test_deciders_agree_and_stay_feasible():
    rng = random.Random(1)
    for trial in range(25):
        n, m = rng.randrange(2, 9), rng.randrange(2, 25)
        edges = [(rng.randrange(n), rng.randrange(n), 10) for _ in range(m)]
        chains = {a: sampling.Chain(edges) for a in sampling.ALGORITHMS}
        propose = sampling.Proposals(trial, -10, 10, True)
        for t in range(200):
            i, w = propose(0, t, m)
            answers = {getattr(c, f"step_{a}")(i, w)[0] for a, c in chains.items()}
            assert len(answers) == 1
            for a in ("d", "bd"):
                assert all(chains[a].reduced(j) >= 0 for j in range(m))


def test_chains_start_from_negative_weights():
    """Potentials are made to fit first; a negative cycle to begin with is an error."""
    for a in sampling.ALGORITHMS:
        c = sampling.Chain([(*e, w) for e, w in zip(PAIRS, GOOD[0])])
        assert all(c.reduced(i) >= 0 for i in range(10))
        propose = sampling.Proposals(3, -3, 5, True)
        for t in range(300):
            i, w = propose(0, t, 10)
            before, ok = list(c.w), getattr(c, f"step_{a}")(i, w)[0]
            before[i] = w
            assert ok == all(sum(before[k] for k in cycle_) >= 0 for cycle_ in catalogue._simple_cycles(PAIRS))
    for w in BAD:
        with pytest.raises(ValueError):
            sampling.Chain([(*e, x) for e, x in zip(PAIRS, w)])


def test_sampling_checks_itself(spark):
    g = golden(spark, GOOD[2])
    out = sampling.sample_weights(g, -3, 3, 5, "bd", chains=2, seed=4, check=True)
    assert out.count() == 20
    assert out.where("abs(w) > 3").count() == 0
    with pytest.raises(ValueError):
        sampling.sample_weights(g, 1, -1)


def test_chain_distances(spark):
    g = golden(spark, GOOD[2])
    rows = sampling.run_chains(g, -3, 3, 4, "bd", 2, 5, "apsp", 10).collect()
    final = {(r["chain"], r["src"], r["dst"]): r["w"] for r in sampling.run_chains(g, -3, 3, 3.9, "bd", 2, 5).collect()}  # rounds are logged before their step
    for c in range(2):
        last = max((r for r in rows if r["chain"] == c), key=lambda r: r["round"])
        edges = spark.createDataFrame([(a, b, int(w)) for (k, a, b), w in final.items() if k == c], "src long, dst long, w long")
        want = traverse.apsp_summary(Graph.of(edges, 5)).first()
        assert (last["mean"], last["max"], last["reached"]) == (want["mean"], want["max"], 25)


def test_command_line(tmp_path, spark):
    from edgeloom.__main__ import main

    out = str(tmp_path / "w")
    main(["-w", "-5", "-W", "5", "-t", "i32", "-r", "2", "-s", "3", "-i", "z", "-o", out, "--check", "--bftest", "-a", "dijkstra", "--scc", "complete", "-n", "6"])
    rows = spark.read.csv(out).collect()
    assert len(rows) == 30 and all(abs(int(float(r[2]))) <= 5 for r in rows)
    main(["cover", "-n", "3", "-m", "2", "-k", "1", "-r", "1", "-e"])


def test_generators(spark, tmp_path):
    n = 300
    coords = generators.coordinates(spark, specs.Hyperbolic(n, 1.0, degree=8.0))
    spec = specs.Hyperbolic(n, 1.0, degree=8.0)
    found = {tuple(r) for r in generators.hyperbolic_pairs(coords, spec.disc(), spec.limits()).collect()}
    a, b = coords.alias("a"), coords.alias("b")
    want = {tuple(r) for r in a.join(b, F.col("a.id") < F.col("b.id")).where(generators.near("a", "b", spec.disc())).select("a.id", "b.id").collect()}
    assert found == want and want
    for make in (generators.gnp, generators.gnp_sparse):
        assert abs(make(spark, 300, 0.05).count() - 4500) < 400
    e = generators.attachment(specs.ScaleFree(200, degree=3.0), 0, 1)
    assert len(set(e)) == len(e) and {x for p in e for x in p} == set(range(200))
    assert generators.complete(spark, 5, True).count() == 25
    assert specs.nominal_degree(specs.Complete(5)) == 4
    assert abs(specs.expected_degree(10000, specs.target_radius(10000, 10, 1.0), 1.0) - 10) < 1e-4


def test_edge_lists(spark, tmp_path):
    def read(text, **kw):
        p = tmp_path / f"{abs(hash(text))}.txt"
        p.write_text(text)
        return edgelist.read(spark, str(p), **kw)

    edges, n = read("% note\np 4 3\n0,1\n1,2\n")
    assert n == 4 and edges.count() == 2
    assert read("p 4 3\n0,1\n1,2\n", undirected=True)[0].count() == 4
    for bad in ("", "p 4\n", "p x 3\n", "p 4 3\n0\n", "p 4 3\n0,a\n", "p 4 3\n0,4\n", "p 4 1\n0,1\n1,2\n", "p 4 3\n0,1,2\n", "p 4 3\n-1,2\n"):
        with pytest.raises(ValueError):
            read(bad)
    g = golden(spark, GOOD[2])
    edgelist.write(g.edges, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out")).count() == 10


def test_parsers():
    assert [weights.parse_type(x) for x in ("i8", "i128", "i16", "i32", "i64", "f32", "f64", "x")] == ["i8", "i8", "i16", "i32", "i64", "f32", "f64", "f64"]
    assert [weights.parse_algorithm(x) for x in ("dijkstra", "bf", "bellman-ford", "bd", "x")] == ["d", "bf", "bf", "bd", "bd"]
    assert weights.parse_initial("max").kind == "m" and weights.parse_initial("2.5").value == 2.5
    assert specs.scale_free_rates(alpha=0.2, gamma=0.3) == pytest.approx((0.2, 0.5))
    assert prng.python_draw(1, 2) == prng.python_draw("1", "2") < prng.SPAN


def test_conversion_saturates(spark):
    row = spark.createDataFrame([(300.7, -1e30, float("nan"))], "a double, b double, c double").select(weights.convert(F.col("a"), "i8"), weights.convert(F.col("b"), "i64"), weights.convert(F.col("c"), "i32")).first()
    assert tuple(row) == (127, -(1 << 63), 0)


def test_cycle(spark):
    for n, count in ((4, 50), (8, 3834)):
        assert cycle.valid_states(spark, n).count() == count
    rows = sorted(cycle.coverage(spark, 3, -1, 1, steps=3, runs=2, seed=2).collect(), key=lambda r: r["setting"])
    assert [r["steps"] for r in rows] == [0, 0, 1]
    assert all(sum(f["freq"] * f["cnt"] for f in r["count_of_frequencies"]) == 34 for r in rows)  # twice the 17 legal states
    early = cycle.coverage(spark, 2, 0, 1, steps=4, runs=20, quit_early=True).collect()
    assert all((r["count_of_frequencies"] == []) == (r["completion_run"] is not None) for r in early) and any(r["completion_run"] for r in early)
    for initial, value in (("m", 5), ("z", 0), ("3", 3), ("u", None)):
        rows = cycle.cycledist(spark, 50, -5, 5, initial, 2, 3, integral=initial != "u").collect()
        assert len(rows) == 2 * 5 * 50 and {r["round"] for r in rows} == {0.5, 1.0, 2.0, 5.0, 10.0}
        assert {r["initial"] for r in rows} == {"v" if initial == "3" else initial}
    states = spark.createDataFrame([(i, e) for i, e in enumerate([1, 1, 2, 3, 1, 4])], "run long, enc long")
    assert cycle.completion(states, 4, 4).first()[0] == 3
    assert cycle.completion(states, 9, 9).first()[0] is None


def test_telemetry(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "id long, k long, x double")
    assert telemetry.min_group_size(rows, ["k"], 9).count() == 30
    assert telemetry.min_group_size(rows, ["k"], 10).count() == 0
    r = telemetry.mean_interval(rows, "x", ["k"], "id").orderBy("k").first()
    assert r["low"] < r["mean"] == 13.5 < r["high"]
    steps = spark.range(1, 30001).select(F.lit(0).alias("chain"), F.col("id").alias("step"), (F.col("id") % 2 == 0).alias("accepted"))
    got = [x["round"] for x in telemetry.acceptance(steps).orderBy("round").collect()]
    assert got == [*range(100, 10001, 100), *range(11000, 30001, 1000)]
    assert math.isclose(telemetry.intervals(steps, 10000).first()["rate"], 0.5)
    cover = spark.createDataFrame([(8, -1, 1, 0, 5, 3, [(0, 1)], None, 2)], tables.SCHEMAS["cyclecover"].replace("TINYINT", "BIGINT"))
    tables.write(cover, "cyclecover", str(tmp_path / "c"))
    assert tables.read(spark, "cyclecover", str(tmp_path / "c")).first()["completion_run"] is None
    tables.write(spark.createDataFrame([(1, "acc", "bd")], tables.SCHEMAS["insertions"]), "insertions", str(tmp_path / "i"))
    assert tables.read(spark, "insertions", str(tmp_path / "i")).first()["acc"] == "acc"
