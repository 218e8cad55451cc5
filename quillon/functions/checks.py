"""Assertions over lists and maps of booleans, and constants of size."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .arith import check

KIB, MIB, GIB, TIB = 1 << 10, 1 << 20, 1 << 30, 1 << 40


def assert_list(xs: Column) -> Column:
    """True if all hold; else raises with the places of those that do not."""
    bad = F.filter(F.transform(xs, lambda x, i: F.when(x, F.lit(None).cast("int")).otherwise(i)), lambda i: i.isNotNull())
    return check(F.size(bad) == 0, F.lit(True), F.concat(F.lit("failed assertions: "), F.array_join(F.transform(bad, lambda i: i.cast("string")), ", ")))


def assert_map(m: Column) -> Column:
    """True if all hold; else raises with the sorted keys of those that do not."""
    bad = F.array_sort(F.map_keys(F.map_filter(m, lambda _, v: ~v)))
    return check(F.size(bad) == 0, F.lit(True), F.concat(F.lit("failed assertions: "), F.array_join(bad, ", ")))


def all_hold(xs: Column) -> Column:
    """True if all hold; the first that does not raises, so it is never false."""
    return check(F.forall(xs, lambda x: x), F.lit(True), F.concat(F.lit("assertion failed: "), F.coalesce(F.array_position(xs, F.lit(False)) - 1, F.lit(0)).cast("string")))


def trace(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, Observation]:
    """df unchanged, and what its first action sees of aggregates of it; nothing is computed twice."""
    seen = Observation(name)
    logging.getLogger("quillon.trace").debug("tracing %s", name)
    return df.observe(seen, *[v.alias(k) for k, v in ({"rows": F.count(F.lit(1))} | values).items()]), seen
