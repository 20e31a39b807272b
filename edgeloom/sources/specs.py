"""Graph sources as values, with validation and nominal degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Gnp:
    """Every ordered pair, self-loops included, is an edge with probability degree / n."""

    n: int
    degree: float

    def __post_init__(self) -> None:
        if self.n <= 1 or self.degree <= 0 or self.degree > self.n:
            raise ValueError("n must exceed 1 and the degree lie in (0, n]")

    @property
    def p(self) -> float:
        return self.degree / self.n


@dataclass(frozen=True)
class ScaleFree:
    """Directed preferential attachment; alpha, beta from scale_free_rates()."""

    n: int
    alpha: float | None = None
    beta: float | None = None
    gamma: float | None = None
    degree: float | None = None
    delta_out: float = 1.0
    delta_in: float = 1.0

    def rates(self) -> tuple[float, float]:
        return scale_free_rates(self.alpha, self.beta, self.gamma, self.degree)


@dataclass(frozen=True)
class Hyperbolic:
    """Points in a hyperbolic disc, joined where they are closer than its radius; exactly one of radius and degree is given."""

    n: int
    alpha: float = 1.0
    radius: float | None = None
    degree: float | None = None
    bands: int | None = None
    one_way: float = 1.0

    def __post_init__(self) -> None:
        if (self.radius is None) == (self.degree is None):
            raise ValueError("give either the radius or the degree")
        if self.alpha <= 0.5:
            raise ValueError("alpha must exceed 0.5")
        if not 0 <= self.one_way <= 1:
            raise ValueError("the share of edges both ways must lie in [0, 1]")

    def disc(self) -> float:
        return self.radius if self.radius is not None else target_radius(self.n, self.degree, self.alpha)

    def limits(self) -> list[float]:
        """Lower radii of the bands: 0, then evenly from half the disc's radius on."""
        r = self.disc()
        count = self.bands or max(2, math.ceil(r * self.alpha / 2 / math.log(2)))
        return [0.0] + [r / 2 + i * (r / 2) / max(1, count - 1) for i in range(count - 1)]


@dataclass(frozen=True)
class Complete:
    n: int
    loops: bool = False


@dataclass(frozen=True)
class Cycle:
    n: int


@dataclass(frozen=True)
class EdgeListFile:
    path: str
    undirected: bool = False
    weighted: bool = False


@dataclass(frozen=True)
class FromTable:
    """A SELECT with columns src and dst over registered views."""

    sql: str


Source = Gnp | ScaleFree | Hyperbolic | Complete | Cycle | EdgeListFile | FromTable


def nominal_degree(source: Source) -> float:
    """The degree that a source is meant to have; 0 where it names none."""
    match source:
        case Cycle():
            return 1.0
        case Complete(n, loops):
            return float(n if loops else n - 1)
        case Gnp() | ScaleFree() | Hyperbolic():
            return float(source.degree or 0)
    return 0.0


def scale_free_rates(alpha: float | None = None, beta: float | None = None, gamma: float | None = None, degree: float | None = None) -> tuple[float, float]:
    """(alpha, beta): a degree fixes beta; what is missing shares the rest evenly.

    alpha: new node with an outgoing edge; beta: edge between old nodes; gamma: new node
    with an incoming edge; they add up to 1.
    """
    if degree is not None:
        beta = (degree - 1) / degree
    known = {"alpha": alpha, "beta": beta, "gamma": gamma}
    if alpha is not None and beta is not None:
        known["gamma"] = None  # follows from the two
    rest = 1 - sum(v for v in known.values() if v is not None)
    open_ = [k for k, v in known.items() if v is None]
    for k in open_:
        known[k] = rest / len(open_)
    a, b = known["alpha"], known["beta"]
    if a < 0 or b < 0 or a + b > 1 + 1e-12:
        raise ValueError("rates must not be negative nor exceed 1 together")
    return a, b


def expected_degree(n: int, radius: float, alpha: float) -> float:
    """Mean degree of a hyperbolic graph, in closed form."""
    gamma = 2 * alpha + 1
    xi = (gamma - 1) / (gamma - 2)
    bulk = math.exp(-radius / 2)
    edge = math.exp(-alpha * radius) * (alpha * radius / 2 * (math.pi / 4 / alpha**2 - (math.pi - 1) / alpha + (math.pi - 2)) - 1)
    return 2 / math.pi * xi**2 * n * (bulk + edge)


def target_radius(n: int, degree: float, alpha: float, precision: float = 1e-13) -> float:
    """The radius at which expected_degree() is the degree wanted.

    From 2 ln(n), the scale on which degrees are constant, the ends walk outwards by one until
    the degree lies between theirs; the gap is then halved until it is relatively small.
    """
    inner = outer = 2 * math.log(max(n, 2))
    while expected_degree(n, inner, alpha) < degree:
        inner -= 1
        if inner <= 0:
            raise ValueError("no radius gives this degree")
    while expected_degree(n, outer, alpha) > degree:
        outer += 1
    while outer - inner > precision * outer:
        middle = (inner + outer) / 2
        if middle in (inner, outer):
            break
        if expected_degree(n, middle, alpha) > degree:
            inner = middle
        else:
            outer = middle
    return (inner + outer) / 2
