"""Patterns: destructuring, switch, and the check that cases are exhaustive and reachable.

A pattern becomes a predicate and the columns that its names stand for. ``switch`` is one
``when`` chain, the first matching case first. Whether cases cover a type, and whether a
case can match at all, is decided on the types alone by the usefulness of pattern rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arith import fail
from ..plans import types as K


class PatternError(TypeError):
    """A pattern that can't match its type, or cases that leave values out."""


@dataclass(frozen=True)
class Pattern:
    def test(self, x: Column, dtype: T.DataType) -> Column:
        """Whether x matches."""
        return F.lit(True)

    def names(self, x: Column, dtype: T.DataType) -> dict[str, Column]:
        """The names of the pattern, for an x that matches."""
        return {}

    def bind(self, x: Column, dtype: T.DataType) -> dict[str, Column]:
        """The names of the pattern; an x that does not match raises."""
        fits = self.test(x, dtype)
        return {n: F.when(fits, c).otherwise(fail("pattern does not match")) for n, c in self.names(x, dtype).items()}


@dataclass(frozen=True)
class Ident(Pattern):
    name: str

    def names(self, x: Column, dtype: T.DataType) -> dict[str, Column]:
        return {self.name: x}


@dataclass(frozen=True)
class Ignore(Pattern):
    pass


def _all(tests: list[Column]) -> Column:
    """All of the tests, each tried only where those before it hold."""
    return reduce(lambda later, t: F.when(t, later).otherwise(F.lit(False)), reversed(tests), F.lit(True))


@dataclass(frozen=True)
class ListPat(Pattern):
    """Elements in order; with a tail, whatever follows them."""

    elems: tuple[Pattern, ...]
    tail: Pattern | None = None

    def _parts(self, x: Column, dtype: T.DataType) -> list[tuple[Pattern, Column, T.DataType]]:
        if not isinstance(dtype, T.ArrayType):
            raise PatternError(f"a list pattern does not match {dtype.simpleString()}")
        parts = [(p, F.get(x, F.lit(i)), dtype.elementType) for i, p in enumerate(self.elems)]
        if self.tail is not None:
            n = len(self.elems)
            parts.append((self.tail, F.slice(x, F.lit(n + 1), F.greatest(F.size(x) - n, F.lit(0))), dtype))
        return parts

    def test(self, x: Column, dtype: T.DataType) -> Column:
        parts = self._parts(x, dtype)
        n = F.size(x)
        return _all([n == len(self.elems) if self.tail is None else n >= len(self.elems), *[p.test(c, d) for p, c, d in parts]])

    def names(self, x: Column, dtype: T.DataType) -> dict[str, Column]:
        return {k: v for p, c, d in self._parts(x, dtype) for k, v in p.names(c, d).items()}


@dataclass(frozen=True)
class TuplePat(Pattern):
    elems: tuple[Pattern, ...]

    def _parts(self, x: Column, dtype: T.DataType) -> list[tuple[Pattern, Column, T.DataType]]:
        if not isinstance(dtype, T.StructType) or len(dtype.fields) != len(self.elems):
            raise PatternError(f"a tuple pattern of {len(self.elems)} does not match {dtype.simpleString()}")
        return [(p, x[f.name], f.dataType) for p, f in zip(self.elems, dtype.fields, strict=True)]

    def test(self, x: Column, dtype: T.DataType) -> Column:
        return _all([p.test(c, d) for p, c, d in self._parts(x, dtype)])

    def names(self, x: Column, dtype: T.DataType) -> dict[str, Column]:
        return {k: v for p, c, d in self._parts(x, dtype) for k, v in p.names(c, d).items()}


@dataclass(frozen=True)
class StructPat(Pattern):
    """Some fields, by name."""

    fields: tuple[tuple[str, Pattern], ...]

    def _parts(self, x: Column, dtype: T.DataType) -> list[tuple[Pattern, Column, T.DataType]]:
        own = {f.name: f.dataType for f in dtype.fields} if isinstance(dtype, T.StructType) else {}
        for n, _ in self.fields:
            if n not in own:
                raise PatternError(f"no field {n} in {dtype.simpleString()}")
        return [(p, x[n], own[n]) for n, p in self.fields]

    test, names = TuplePat.test, TuplePat.names


@dataclass(frozen=True)
class VariantPat(Pattern):
    """A tag, and its payload if it has one."""

    tag: str
    elem: Pattern | None = None

    def _payload(self, dtype: T.DataType) -> T.DataType:
        own = {f.name: f.dataType for f in dtype.fields} if isinstance(dtype, T.StructType) else {}
        if "tag" not in own or self.elem is not None and self.tag not in own:
            raise PatternError(f"a pattern #{self.tag} does not match {dtype.simpleString()}")
        return own.get(self.tag)

    def test(self, x: Column, dtype: T.DataType) -> Column:
        inner = self._payload(dtype)
        tests = [x["tag"] == self.tag]
        return _all(tests if self.elem is None else [*tests, self.elem.test(x[self.tag], inner)])

    def names(self, x: Column, dtype: T.DataType) -> dict[str, Column]:
        inner = self._payload(dtype)
        return {} if self.elem is None else self.elem.names(x[self.tag], inner)


Case = tuple[Pattern, Callable[[dict[str, Column]], Column]]


def switch(x: Column, dtype: T.DataType, cases: list[Case], type_: K.Type | None = None) -> Column:
    """The value of the first case that matches. With the static type, cases are checked first; else no match raises."""
    if type_ is not None:
        check_cases([p for p, _ in cases], type_)
    out = fail("no case matches")
    for pattern, value in reversed(cases):
        out = F.when(pattern.test(x, dtype), value(pattern.names(x, dtype))).otherwise(out)
    return out


# --- exhaustiveness and reachability ------------------------------------------


def _wild(p: Pattern) -> bool:
    return isinstance(p, (Ident, Ignore))


def _constructors(t: K.Type, column: list[Pattern]) -> list[tuple[object, list[K.Type]]]:
    """Constructors that tell values of a type apart, with the types of their parts."""
    match t:
        case K.Tuple(elems):
            return [("tuple", list(elems))]
        case K.Struct(fields):
            return [("struct", [e for _, e in fields])]
        case K.Sum(variants):
            return [(tag, [] if e is None else [e]) for tag, e in variants]
        case K.List(elem):
            most = max([len(p.elems) for p in column if isinstance(p, ListPat)], default=0)
            # Lists longer than any pattern behave as one.
            return [(n, [elem] * n) for n in range(most + 1)] + [(("more", most + 1), [elem] * (most + 1))]
    return [("any", [])]


def _specialize(p: Pattern, t: K.Type, ctor: object, arity: int) -> list[Pattern] | None:
    """p's sub-patterns under a constructor, or None if it does not match it."""
    if _wild(p):
        return [Ignore()] * arity
    match t, p:
        case K.Tuple(elems), TuplePat(ps):
            if len(ps) != len(elems):
                raise PatternError(f"a tuple pattern of {len(ps)} does not match {t}")
            return list(ps)
        case K.Struct(fields), StructPat(ps):
            own = dict(ps)
            if set(own) - {n for n, _ in fields}:
                raise PatternError(f"no field {sorted(set(own) - {n for n, _ in fields})[0]} in {t}")
            return [own.get(n, Ignore()) for n, _ in fields]
        case K.Sum(variants), VariantPat(tag, elem):
            kinds = dict(variants)
            if tag not in kinds or (elem is None) != (kinds[tag] is None):
                raise PatternError(f"a pattern #{tag} does not match {t}")
            return ([elem] if elem is not None else []) if tag == ctor else None
        case K.List(), ListPat(ps, tail):
            n = ctor[1] if isinstance(ctor, tuple) else ctor
            if len(ps) > n or tail is None and (len(ps) != n or isinstance(ctor, tuple)):
                return None
            return [*ps, *[Ignore()] * (n - len(ps))]
    raise PatternError(f"a pattern does not match {t}")


def useful(rows: list[list[Pattern]], row: list[Pattern], types: list[K.Type]) -> bool:
    """Whether some values match row and none of rows."""
    if not types:
        return not rows
    t = types[0]
    for ctor, parts in _constructors(t, [r[0] for r in rows] + [row[0]]):
        mine = _specialize(row[0], t, ctor, len(parts))
        if mine is None:
            continue
        rest = [[*s, *r[1:]] for r in rows if (s := _specialize(r[0], t, ctor, len(parts))) is not None]
        if useful(rest, [*mine, *row[1:]], [*parts, *types[1:]]):
            return True
    return False


def check_cases(patterns: list[Pattern], t: K.Type) -> None:
    """Raises if a case can never match or if some value of the type matches none."""
    for i, p in enumerate(patterns):
        if not useful([[q] for q in patterns[:i]], [p], [t]):
            raise PatternError(f"case {i + 1} is unreachable")
    if useful([[p] for p in patterns], [Ignore()], [t]):
        raise PatternError("cases are not exhaustive")
