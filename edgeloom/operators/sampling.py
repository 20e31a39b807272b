"""Sampling edge weights without negative cycles: many Markov chains, a task for each.

A step draws an edge and a new weight and accepts unless that closes a negative cycle.
Three deciders give the same answers: 'bf' looks for a path that is too short on plain
weights; 'd' and 'bd' keep node potentials, accept at once where the reduced weight isn't
negative, and otherwise search reduced weights from one side or from both.  A chain is
sequential, so parallelism is across chains; proposals come from a counter-based generator,
so any decider (and SQL) sees the same ones.
"""

from __future__ import annotations

import heapq
import math
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.prng import SPAN, python_draw
from edgeloom.graph import Graph

ALGORITHMS = ("bf", "d", "bd")
#: A chain holds its graph in one task; more edges than this are refused.
MOST_EDGES = 20_000_000


class Chain:
    """The state of one chain: nodes by place, adjacency both ways, weights and potentials."""

    def __init__(self, edges: list[tuple[int, int, float]], zero: float = 0):
        self.names = sorted({x for u, v, _ in edges for x in (u, v)})
        place = {x: i for i, x in enumerate(self.names)}
        self.ends = [(place[u], place[v]) for u, v, _ in edges]
        self.w = [w for _, _, w in edges]
        self.out: list[list[tuple[int, int]]] = [[] for _ in self.names]  # (other end, edge)
        self.into: list[list[tuple[int, int]]] = [[] for _ in self.names]
        for i, (u, v) in enumerate(self.ends):
            self.out[u].append((v, i))
            self.into[v].append((u, i))
        self.phi = [zero] * len(self.names)
        self.zero = zero
        self.insertions = 0
        if any(w < 0 for w in self.w):
            self._settle()

    def _settle(self) -> None:
        """Potentials for weights of which some are negative to begin with; a negative cycle is an error."""
        dist, rounds = [self.zero] * len(self.names), [0] * len(self.names)
        queue, queued = deque(range(len(dist))), [True] * len(dist)
        while queue:
            x = queue.popleft()
            queued[x] = False
            for y, i in self.out[x]:
                if dist[x] + self.w[i] < dist[y]:
                    dist[y], rounds[y] = dist[x] + self.w[i], rounds[x] + 1
                    if rounds[y] > len(dist):
                        raise ValueError("the chain starts with a negative cycle")
                    if not queued[y]:
                        queue.append(y)
                        queued[y] = True
        self.phi = [-d for d in dist]

    def reduced(self, i: int, w: float | None = None) -> float:
        u, v = self.ends[i]
        return (self.w[i] if w is None else w) + self.phi[v] - self.phi[u]

    def path_below(self, source: int, target: int, bound: float) -> bool:
        """Whether a path from source to target is shorter than bound, by label correction in first-in order."""
        best, queue, queued = {source: self.zero}, deque([source]), {source}
        out, w = self.out, self.w
        self.insertions = 1
        while queue:
            x = queue.popleft()
            queued.discard(x)
            base = best[x]
            for y, i in out[x]:
                length = base + w[i]
                if y not in best or length < best[y]:
                    best[y] = length
                    if y == target:
                        if length < bound:
                            return True
                    elif y not in queued:
                        queued.add(y)
                        queue.append(y)
                        self.insertions += 1
        return False

    def is_legal(self, i: int, w: float) -> bool:
        """Whether edge i may weigh w, by a search on plain weights that looks at no potential."""
        u, v = self.ends[i]
        return w >= 0 if u == v else w >= self.w[i] or not self.path_below(v, u, -w)

    def labels_within(self, source: int, target: int, bound: float) -> dict[int, float] | None:
        """Reduced distances up to bound from source; None if the target is closer than that."""
        best, done, heap = {source: self.zero}, {}, [(self.zero, source)]
        out, w, phi, push, pop = self.out, self.w, self.phi, heapq.heappush, heapq.heappop
        inserted = 1
        while heap:
            d, x = pop(heap)
            if x in done:
                continue
            if d > bound:
                break
            done[x] = d
            base = d - phi[x]
            for y, i in out[x]:
                length = base + w[i] + phi[y]
                if length > bound or y in done:
                    continue
                if length < d:
                    length = d  # drift of floats never shortens
                if y == target and length < bound:
                    self.insertions = inserted
                    return None
                if y not in best or length < best[y]:
                    best[y] = length
                    push(heap, (length, y))
                    inserted += 1
        self.insertions = inserted
        return done

    def all_pairs(self) -> tuple[float | None, float, int]:
        """Mean (None unless all pairs are reached), largest (0 at least) and number of the true distances, by the potentials."""
        total, most, reached, n = 0.0, 0.0, 0, len(self.names)
        for s in range(n):
            for x, d in self.labels_within(s, -1, math.inf).items():
                true = d - self.phi[x] + self.phi[s]
                total, most, reached = total + true, max(most, true), reached + 1
        return (total / reached if reached == n * n else None), most, reached

    def labels_both(self, source: int, target: int, bound: float) -> tuple[float, float, dict[int, float], dict[int, float]] | None:
        """(df, db, forward and backward labels) with df + db = bound; None if a path is shorter than bound."""
        zero, w, phi, push, pop = self.zero, self.w, self.phi, heapq.heappush, heapq.heappop
        best = ({source: zero}, {target: zero})
        done: tuple[dict, dict] = ({}, {})
        ahead, behind = done
        heaps = ([(zero, source)], [(zero, target)])
        front, links, signs = [zero, zero], (self.out, self.into), (1, -1)
        inserted, side = 2, 0
        while heaps[0] or heaps[1]:
            if not heaps[side]:
                side = 1 - side
            d, x = pop(heaps[side])
            if x not in ahead and x not in behind:
                front[side] = d
                if front[0] + front[1] >= bound:  # nothing left inside: cut the side that just moved
                    front[side] = bound - front[1 - side]
                    self.insertions = inserted
                    return front[0], front[1], ahead, behind
                done[side][x] = d
                sign, mine, other, heap, at = signs[side], best[side], best[1 - side], heaps[side], phi[x]
                for y, i in links[side][x]:
                    length = d + (w[i] + sign * (phi[y] - at))
                    if length < d:
                        length = d
                    if length >= bound:
                        continue
                    if y in other and length + other[y] < bound:
                        self.insertions = inserted
                        return None
                    if (y not in mine or length < mine[y]) and y not in ahead and y not in behind:
                        mine[y] = length
                        push(heap, (length, y))
                        inserted += 1
            side = 1 - side
        self.insertions = inserted
        return bound - front[1], front[1], ahead, behind

    def step_bf(self, i: int, w: float) -> tuple[bool, bool]:
        """(accepted, searched)."""
        u, v = self.ends[i]
        if u == v:
            ok, searched = w >= 0, False
        elif w >= self.w[i]:
            ok, searched = True, False
        else:
            ok, searched = not self.path_below(v, u, -w), True
        if ok:
            self.w[i] = w
        return ok, searched

    def _quick(self, i: int, w: float) -> tuple[float, bool | None]:
        need = -self.reduced(i, w)
        if need <= 0:
            self.w[i] = w
            return need, True
        return need, False if self.ends[i][0] == self.ends[i][1] else None

    def step_d(self, i: int, w: float) -> tuple[bool, bool]:
        need, known = self._quick(i, w)
        if known is not None:
            return known, False
        u, v = self.ends[i]
        found = self.labels_within(v, u, need)
        if found is None:
            return False, True
        self.w[i] = w
        for x, d in found.items():
            self.phi[x] += need - d
        return True, True

    def step_bd(self, i: int, w: float) -> tuple[bool, bool]:
        need, known = self._quick(i, w)
        if known is not None:
            return known, False
        u, v = self.ends[i]
        found = self.labels_both(v, u, need)
        if found is None:
            return False, True
        self.w[i] = w
        ahead, behind, forward, backward = found
        for x, d in forward.items():
            self.phi[x] += max(self.zero, ahead - d)
        for x, d in backward.items():
            self.phi[x] -= max(self.zero, behind - d)
        return True, True


@dataclass(frozen=True)
class Proposals:
    """Edge index by lane 0 and weight by lane 1 of the generator, for chain and step."""

    seed: int
    low: float
    high: float
    integral: bool

    def __call__(self, chain: int, step: int, m: int) -> tuple[int, float]:
        edge, x = python_draw(self.seed, chain, step, 0) % m, python_draw(self.seed, chain, step, 1)
        return edge, self.low + x % (int(self.high) - int(self.low) + 1) if self.integral else self.low + x / SPAN * (self.high - self.low)


TRACE = "chain long, step long, eid long, w_new double, kind string, insertions long, accepted boolean"
FINAL = "chain long, eid long, src long, dst long, w double, phi_src double, phi_dst double"


def _kernel(algorithm: str, proposals: Proposals, rounds_per_edge: float, want: str, interval: int | None, bftest: bool = False) -> Callable[[tuple, Iterator[pd.DataFrame]], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("eid")
        integral = proposals.integral
        weights = rows["w"].astype(int if integral else float).tolist()
        chain = Chain(list(zip(rows["src"].tolist(), rows["dst"].tolist(), weights)))
        step, m, name = getattr(chain, f"step_{algorithm}"), len(rows), int(key[0])
        trace = []
        total, clock = sum(chain.w), time.monotonic()
        negative = sum(w < 0 for w in chain.w)
        for t in range(1, math.ceil(m * rounds_per_edge) + 1):
            if want == "apsp" and t % interval == 0:
                trace.append((name, t // interval, *chain.all_pairs()))
            if want == "intervals" and t % interval == 0:
                now = time.monotonic()
                trace.append((name, t // interval, total / m, negative / m, int(1000 * (now - clock)), algorithm))
                clock = now
            i, w = proposals(name, t, m)
            before = chain.w[i]
            legal = bftest and chain.is_legal(i, w)
            ok, searched = step(i, w)
            if bftest and ok != legal:
                raise AssertionError(f"chain {name}, step {t}: {algorithm} {'accepted' if ok else 'rejected'} against the search on plain weights")
            if ok:
                total += w - before
                negative += (w < 0) - (before < 0)
            if want == "trace":
                trace.append((name, t, i, float(w), "search" if searched else "quick", chain.insertions if searched else 0, ok))
        if want == "trace":
            return pd.DataFrame(trace, columns=["chain", "step", "eid", "w_new", "kind", "insertions", "accepted"])
        if want == "apsp":
            return pd.DataFrame(trace, columns=["chain", "round", "mean", "max", "reached"])
        if want == "intervals":
            return pd.DataFrame(trace, columns=["chain", "round", "avg", "frac", "time", "algo"])
        ends = list(zip(*chain.ends))
        phi = [[float(chain.phi[x]) for x in side] for side in ends]
        return pd.DataFrame({"chain": name, "eid": range(m), "src": [chain.names[x] for x in ends[0]], "dst": [chain.names[x] for x in ends[1]], "w": [float(x) for x in chain.w], "phi_src": phi[0], "phi_dst": phi[1]})

    return run


def run_chains(g: Graph, low: float = -1, high: float = 1, rounds_per_edge: float = 1.0, algorithm: str = "bd", chains: int = 1, seed: int = 1, want: str = "final", interval: int = 10_000, bftest: bool = False) -> DataFrame:
    """What the chains give: want 'final' (edges with both ends' potentials), 'trace' (every step), 'intervals' or 'apsp'.

    'intervals' gives the average weight, the share of negative edges and the milliseconds of every
    `interval` steps, 'apsp' mean and largest distance (for the deciders that keep potentials).
    """
    if low >= high:
        raise ValueError("the least weight must be below the largest")
    if rounds_per_edge <= 0:
        raise ValueError("rounds per edge must be positive")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}")
    if want == "apsp" and algorithm == "bf":
        raise ValueError("distances come from potentials, which 'bf' doesn't keep")
    if g.edges.count() > MOST_EDGES:
        raise ValueError(f"a chain holds its graph in one task, {MOST_EDGES} edges at the most")
    integral = dict(g.edges.dtypes)["w"] not in ("double", "float")
    copies = g.edges.withColumn("chain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chains - 1).cast("long"))))
    kernel = _kernel(algorithm, Proposals(seed, low, high, integral), rounds_per_edge, want, interval, bftest)
    schema = {"trace": TRACE, "final": FINAL, "intervals": "chain long, round long, avg double, frac double, time long, algo string", "apsp": "chain long, round long, mean double, max double, reached long"}[want]
    return copies.groupBy("chain").applyInPandas(kernel, schema)


def sample_weights(g: Graph, low: float = -1, high: float = 1, rounds_per_edge: float = 1.0, algorithm: str = "bd", chains: int = 1, seed: int = 1, check: bool = False, bftest: bool = False) -> DataFrame:
    """chain, eid, src, dst and w after ceil(m * rounds_per_edge) steps.

    check: no negative cycle before and after; bftest: every decision is made again on plain weights.
    """
    from edgeloom.operators.traverse import has_negative_cycle
    from edgeloom.plans.lineage import cut

    if check and has_negative_cycle(g):
        raise ValueError("the graph starts with a negative cycle")
    out = run_chains(g, low, high, rounds_per_edge, algorithm, chains, seed, bftest=bftest)
    if check:
        out = cut(out)  # else every step of the checks would run the chains again
        for c in range(chains):
            if has_negative_cycle(Graph(out.where(F.col("chain") == c).select("eid", "src", "dst", "w"), g.nodes)):
                raise AssertionError(f"chain {c} ended with a negative cycle")
    return out.select("chain", "eid", "src", "dst", "w")
