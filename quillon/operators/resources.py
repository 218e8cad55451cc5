"""Resources and requirements: small maps of named amounts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Resources = dict[str, float]


def add(a: Resources, b: Resources) -> Resources:
    return {k: a.get(k, 0.0) + b.get(k, 0.0) for k in {*a, *b}}


def sub(a: Resources, b: Resources) -> Resources:
    return {k: a.get(k, 0.0) - b.get(k, 0.0) for k in {*a, *b}}


def least(a: Resources, b: Resources) -> Resources:
    """a, lowered to b where b has less; what only a has stays, and what only b has counts if it is below nothing."""
    return a | {k: v for k, v in b.items() if v < a.get(k, 0.0)}


def most(a: Resources, b: Resources) -> Resources:
    """a, raised to b where b has more."""
    return a | {k: v for k, v in b.items() if v > a.get(k, 0.0)}


def scale(a: Resources, factor: float) -> Resources:
    return {k: v * factor for k, v in a.items()}


def ratios(a: Resources, b: Resources) -> Resources:
    """a over b for what both have; nothing over nothing is no number."""
    out = {}
    for k in a.keys() & b.keys():
        out[k] = a[k] / b[k] if b[k] else math.nan if not a[k] else math.copysign(math.inf, a[k])
    return out


def max_ratio(a: Resources, b: Resources) -> float:
    return max([0.0, *(v for v in ratios(a, b).values() if v > 0)])


def available(have: Resources, want: Resources) -> bool:
    """Whether all that is wanted is there."""
    return all(have.get(k, 0.0) >= v for k, v in want.items() if v)


def equal(a: Resources, b: Resources) -> bool:
    return all(a.get(k, 0.0) == b.get(k, 0.0) for k in {*a, *b})


#: Memory that weighs as much as one core.
MEM_PER_CPU = 8 << 30


def scaled_distance(a: Resources, b: Resources) -> float:
    """How far apart two amounts are, in cores: memory counts by what usually goes with a core."""
    return abs(a.get("mem", 0.0) - b.get("mem", 0.0)) / MEM_PER_CPU + abs(a.get("cpu", 0.0) - b.get("cpu", 0.0))


@dataclass
class Requirements:
    """The least amount that will do, and how many more such shares can be used at once."""

    min: Resources = field(default_factory=dict)
    width: int = 0

    def add_parallel(self, r: Resources) -> None:
        """A step beside the others."""
        some = any(self.min.values())
        self.min = most(self.min, r)
        self.width += some

    def add_serial(self, r: Resources) -> None:
        """A step after the others."""
        self.min = most(self.min, r)

    def add(self, other: Requirements) -> None:
        self.min = most(self.min, other.min)
        self.width += other.width

    def max(self) -> Resources:
        """What all shares need together."""
        return scale(self.min, 1 + self.width)


def totals(rows: DataFrame, column: str = "resources", *by: str) -> DataFrame:
    """(by, resource, total, least, most) of a map column."""
    each = rows.select(*by, F.explode(column).alias("resource", "amount"))
    return each.groupBy(*by, "resource").agg(F.sum("amount").alias("total"), F.min("amount").alias("least"), F.max("amount").alias("most"))
