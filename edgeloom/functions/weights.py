"""Weight types, initial weights and the lenient parsers of sampling parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.functions.prng import draw, unit

#: Weight types by name: Spark type, and the range that conversion saturates to (floats: none).
TYPES = {
    "f32": ("float", None),
    "f64": ("double", None),
    "i8": ("tinyint", (-(1 << 7), (1 << 7) - 1)),
    "i16": ("smallint", (-(1 << 15), (1 << 15) - 1)),
    "i32": ("int", (-(1 << 31), (1 << 31) - 1)),
    "i64": ("bigint", (-(1 << 63), (1 << 63) - 1)),
    "i128": ("decimal(38,0)", (-(10**38) + 1, 10**38 - 1)),
}


def parse_type(text: str) -> str:
    """Never fails: integers start with i and are told apart by the digits they hold; anything else is a float."""
    if text.startswith("i"):
        for digits, name in ((("8",), "i8"), (("1",), "i16"), (("3", "2"), "i32")):
            if any(d in text for d in digits):
                return name
        return "i64"
    return "f32" if "3" in text or "2" in text else "f64"


def convert(value: Column, type_name: str) -> Column:
    """A number as a weight: truncated and saturated for integer types, NaN to 0."""
    kind, bounds = TYPES[type_name]
    if bounds is None:
        return value.cast(kind)
    low, high = bounds
    x = value.cast("double")
    if type_name in ("i64", "i128"):
        inside = F.when(x >= float(high), F.lit(high).cast(kind)).when(x <= float(low), F.lit(low).cast(kind)).otherwise(F.when(F.isnan(x), F.lit(0.0)).otherwise(x).cast(kind))
        return inside
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))).cast(kind)


def round_up(cost: Column, floor: Column, type_name: str) -> Column:
    """Raises a float to a floor (against drift); integers stay."""
    return cost if TYPES[type_name][1] else F.greatest(cost, floor)


@dataclass(frozen=True)
class Initial:
    """How edges are weighed at first: 'm' maximum, 'z' zero, 'u' uniform in [0, maximum], 'v' the value given."""

    kind: str
    value: float = 0.0

    @property
    def char(self) -> str:
        return self.kind


def parse_initial(text: str) -> Initial:
    """m..., z... and u... by their first letter, else a number."""
    if text[:1] in ("m", "z", "u"):
        return Initial(text[0])
    return Initial("v", float(text))


def parse_algorithm(text: str) -> str:
    """Never fails: d... is 'd'; with an f it is 'bf'; all else is 'bd'."""
    low = text.lower()
    return "d" if low.startswith("d") else "bf" if "f" in low else "bd"


def initial_weight(how: Initial, maximum: float, integral: bool, seed: int, eid: Column | str = "eid") -> Column:
    """The initial weight of the edge `eid`; `maximum` must not be negative."""
    if maximum < 0 or math.isnan(maximum):
        raise ValueError("the largest weight must not be negative")
    kind = "bigint" if integral else "double"
    if how.kind == "m":
        return F.lit(maximum).cast(kind)
    if how.kind == "z":
        return F.lit(0).cast(kind)
    if how.kind == "v":
        return F.lit(min(max(how.value, 0), maximum)).cast(kind)
    if integral:
        return F.pmod(draw(seed, 0, eid, 3), F.lit(int(maximum) + 1))
    return unit(seed, 0, eid, 3) * F.lit(float(maximum))
