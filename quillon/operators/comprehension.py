"""Comprehensions: enumerate, filter, project.

``Comprehension`` builds one logical plan out of clauses in order. A clause over a
table that uses nothing before it is a cross join, which Catalyst turns into an
equi-join when a filter equates the sides; one over an array or map column of an earlier
clause is a generator. The result is a list: rows in clause order, with ``pos``
columns to sort by at the edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import Pattern


class Comprehension:
    def __init__(self) -> None:
        self.df: DataFrame | None = None
        self.order: list[str] = []
        self.n = 0

    def over(self, rows: DataFrame, order: list[str] | None = None, **names: str) -> Comprehension:
        """Enumerate the rows of a table that does not depend on earlier clauses; names rename its columns."""
        for new, old in names.items():
            rows = rows.withColumnRenamed(old, new)
        self.df = rows if self.df is None else self.df.crossJoin(rows)
        self.order += order or []
        return self

    def each(self, xs: Column, pattern: Pattern | str, dtype=None) -> Comprehension:
        """Enumerate a list column of earlier clauses; a value that the pattern does not match raises."""
        return self._generate(F.posexplode(xs), ["x"], pattern, dtype)

    def each_entry(self, m: Column, key: str, value: str) -> Comprehension:
        """Enumerate a map column's entries, in key order."""
        self.n += 1
        pos, x = f"_pos{self.n}", f"_x{self.n}"
        pairs = F.array_sort(F.map_entries(m))
        self.df = self.df.select("*", F.posexplode(pairs).alias(pos, x)).withColumns({key: F.col(f"{x}.key"), value: F.col(f"{x}.value")}).drop(x)
        self.order.append(pos)
        return self

    def _generate(self, generator: Column, _: list[str], pattern: Pattern | str, dtype) -> Comprehension:
        self.n += 1
        pos, x = f"_pos{self.n}", f"_x{self.n}"
        self.df = self.df.select("*", generator.alias(pos, x))
        self.order.append(pos)
        if isinstance(pattern, str):
            self.df = self.df.withColumn(pattern, F.col(x)).drop(x)
            return self
        dtype = dtype or self.df.schema[x].dataType
        for name, value in pattern.bind(F.col(x), dtype).items():
            self.df = self.df.withColumn(name, value)
        self.df = self.df.drop(x)
        return self

    def filter(self, condition: Column) -> Comprehension:
        if self.df is None:
            raise ValueError("a filter is never first")
        self.df = self.df.where(condition)
        return self

    def let(self, name: str, value: Column) -> Comprehension:
        self.df = self.df.withColumn(name, value)
        return self

    def of(self, **values: Column) -> DataFrame:
        """The result's rows: the order columns and the values."""
        return self.df.select(*self.order, *[v.alias(k) for k, v in values.items()])


def list_comprehension(xs: Column, value: Callable[[Column], Column], condition: Callable[[Column], Column] | None = None) -> Column:
    """[value(x) | x <- xs, if condition(x)] within a row."""
    return F.transform(F.filter(xs, condition) if condition else xs, value)


def nested_comprehension(xs: Column, ys: Callable[[Column], Column], value: Callable[[Column, Column], Column]) -> Column:
    """[value(x, y) | x <- xs, y <- ys(x)] within a row."""
    return F.flatten(F.transform(xs, lambda x: F.transform(ys(x), lambda y: value(x, y))))
