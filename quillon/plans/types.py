"""The static type system: kinds, subtyping, unification and Spark schemas.

Types are immutable Python values. ``subtype(a, b)`` says whether a value of type
a may stand where b is wanted; ``unify`` finds the least type above two, which is
the schema of a list of both. Structs unify to the fields they share, sums to the
union of their variants, maps are contravariant in keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class TypeMismatch(TypeError):
    """Types that do not fit one another."""


@dataclass(frozen=True)
class Type:
    def __str__(self) -> str:
        return type(self).__name__.lower()


class Int(Type): ...


class Float(Type): ...


class String(Type): ...


class Bool(Type): ...


class File(Type): ...


class Dir(Type): ...


class Fileset(Type): ...


class Unit(Type): ...


class Top(Type): ...


class Bottom(Type): ...


@dataclass(frozen=True)
class List(Type):
    elem: Type

    def __str__(self) -> str:
        return f"[{self.elem}]"


@dataclass(frozen=True)
class Map(Type):
    key: Type
    elem: Type

    def __str__(self) -> str:
        return f"[{self.key}:{self.elem}]"


@dataclass(frozen=True)
class Tuple(Type):
    elems: tuple[Type, ...]

    def __str__(self) -> str:
        return "(" + ", ".join(map(str, self.elems)) + ")"


def _fields(d: dict[str, Type]) -> tuple[tuple[str, Type], ...]:
    return tuple(sorted(d.items()))


@dataclass(frozen=True)
class Struct(Type):
    fields: tuple[tuple[str, Type], ...]

    @staticmethod
    def of(**fields: Type) -> Struct:
        return Struct(_fields(fields))

    def __str__(self) -> str:
        return "{" + ", ".join(f"{n} {t}" for n, t in self.fields) + "}"


class Module(Struct):
    """Exported members of a module, and its parameters aside; subtyped as a struct."""


@dataclass(frozen=True)
class Sum(Type):
    """Variants by tag; None: a tag without payload."""

    variants: tuple[tuple[str, Type | None], ...]

    @staticmethod
    def of(**variants: Type | None) -> Sum:
        return Sum(tuple(sorted(variants.items())))

    def __str__(self) -> str:
        return " | ".join(f"#{n}" if t is None else f"#{n}({t})" for n, t in self.variants)


@dataclass(frozen=True)
class Func(Type):
    args: tuple[Type, ...]
    result: Type

    def __str__(self) -> str:
        return "func(" + ", ".join(map(str, self.args)) + f") {self.result}"


@dataclass
class Aliases:
    """Named types; a name may be used before it is defined."""

    known: dict[str, Type] = field(default_factory=dict)

    def define(self, name: str, t: Type) -> Type:
        self.known[name] = t
        return t

    def __getitem__(self, name: str) -> Type:
        if name not in self.known:
            raise TypeMismatch(f"type {name} not defined")
        return self.known[name]


INT, FLOAT, STRING, BOOL, FILE, DIR, FILESET, UNIT, TOP, BOTTOM = Int(), Float(), String(), Bool(), File(), Dir(), Fileset(), Unit(), Top(), Bottom()


def subtype(a: Type, b: Type) -> bool:
    """Whether a value of type a is one of type b."""
    if isinstance(a, Bottom) or isinstance(b, Top):
        return True
    if isinstance(a, Top) or isinstance(b, Bottom):
        return False
    match a, b:
        case List(x), List(y):
            return subtype(x, y)
        case Map(k, x), Map(m, y):
            return subtype(m, k) and subtype(x, y)
        case Tuple(x), Tuple(y):
            return len(x) == len(y) and all(map(subtype, x, y))
        case Struct(x), Struct(y):
            have = dict(x)
            return all(n in have and subtype(have[n], t) for n, t in y)
        case Sum(x), Sum(y):
            room = dict(y)
            return all(n in room and (t is None) == (room[n] is None) and (t is None or subtype(t, room[n])) for n, t in x)
        case Func(x, r), Func(y, s):
            return len(x) == len(y) and all(map(subtype, y, x)) and subtype(r, s)
    return a == b


def unify(a: Type, b: Type) -> Type:
    """The least type above both."""
    if isinstance(a, Bottom) or isinstance(b, Top):
        return b
    if isinstance(b, Bottom) or isinstance(a, Top):
        return a
    match a, b:
        case List(x), List(y):
            return List(unify(x, y))
        case Map(k, x), Map(m, y):
            return Map(meet(k, m), unify(x, y))
        case Tuple(x), Tuple(y):
            if len(x) != len(y):
                raise TypeMismatch(f"mismatched tuple arity: {a} != {b}")
            return Tuple(tuple(map(unify, x, y)))
        case Struct(x), Struct(y):
            other, shared = dict(y), {}
            for n, t in x:
                if n in other:
                    try:
                        shared[n] = unify(t, other[n])
                    except TypeMismatch:
                        pass
            if not shared:
                raise TypeMismatch(f"no common fields in {a} and {b}")
            return Struct(_fields(shared))
        case Sum(x), Sum(y):
            out = dict(x)
            for n, t in y:
                if n in out and (t is None) != (out[n] is None):
                    raise TypeMismatch(f"variant #{n} has a payload on one side only")
                out[n] = t if n not in out or t is None else unify(out[n], t)
            return Sum(tuple(sorted(out.items(), key=lambda v: v[0])))
        case Func(x, r), Func(y, s):
            if x != y:
                raise TypeMismatch(f"functions with different arguments: {a} != {b}")
            return Func(x, unify(r, s))
    if a == b:
        return a
    raise TypeMismatch(f"kind mismatch: {a} != {b}")


def meet(a: Type, b: Type) -> Type:
    """The greatest type below both, for positions that are contravariant."""
    if isinstance(a, Top) or subtype(b, a):
        return b
    if isinstance(b, Top) or subtype(a, b):
        return a
    if isinstance(a, Struct) and isinstance(b, Struct):
        out = dict(a.fields)
        for n, t in b.fields:
            out[n] = meet(out[n], t) if n in out else t
        return Struct(_fields(out))
    raise TypeMismatch(f"kind mismatch: {a} != {b}")


def comparable(t: Type) -> bool:
    """Whether values of the type have == and !=."""
    match t:
        case Unit() | Func() | Fileset() | Module():
            return False
        case List(x):
            return comparable(x)
        case Map(k, x):
            return comparable(k) and comparable(x)
        case Tuple(x):
            return all(map(comparable, x))
        case Struct(x):
            return all(comparable(t) for _, t in x)
        case Sum(x):
            return all(t is None or comparable(t) for _, t in x)
    return True


def ordered(t: Type) -> bool:
    """Whether values of the type have < and >."""
    return isinstance(t, (Int, Float, String))


FILE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("etag", T.StringType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
    ]
)


def to_spark(t: Type, exact: int | None = None) -> T.DataType:
    """The Spark type of nested values. exact: digits after the point of DECIMAL(38) numbers instead of long and double."""
    match t:
        case Int():
            return T.LongType() if exact is None else T.DecimalType(38, 0)
        case Float():
            return T.DoubleType() if exact is None else T.DecimalType(38, exact)
        case String():
            return T.StringType()
        case Bool():
            return T.BooleanType()
        case File():
            return FILE_SCHEMA
        case Dir():
            return T.MapType(T.StringType(), FILE_SCHEMA)
        case Fileset():
            return T.ArrayType(T.StructType([T.StructField("list_path", T.ArrayType(T.IntegerType())), T.StructField("path", T.StringType()), T.StructField("file", FILE_SCHEMA)]))
        case Unit():
            return T.StructType([])
        case List(x):
            return T.ArrayType(to_spark(x, exact))
        case Map(k, x):
            return T.MapType(to_spark(k, exact), to_spark(x, exact))
        case Tuple(x):
            return T.StructType([T.StructField(f"_{i + 1}", to_spark(e, exact)) for i, e in enumerate(x)])
        case Struct(x):
            return T.StructType([T.StructField(n, to_spark(e, exact)) for n, e in x])
        case Sum(x):
            return T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, to_spark(e, exact)) for n, e in x if e is not None)])
        case Top() | Bottom():
            return T.NullType()
    raise TypeMismatch(f"{t} has no column form")


def of_python(value: object) -> Type:
    """The type of a literal: the list of a value's elements unifies them, and an empty one is [bottom]."""
    match value:
        case bool():
            return BOOL
        case int():
            return INT
        case float():
            return FLOAT
        case str():
            return STRING
        case list():
            out: Type = BOTTOM
            for v in value:
                out = unify(out, of_python(v))
            return List(out)
        case tuple():
            return Tuple(tuple(map(of_python, value)))
        case dict():  # string keys of a record are given as a Record
            key: Type = TOP
            elem: Type = BOTTOM
            for k, v in value.items():
                key, elem = meet(key, of_python(k)), unify(elem, of_python(v))
            return Map(key, elem)
        case Record():
            return Struct(_fields({k: of_python(v) for k, v in value.items}))
        case Variant():
            return Sum(((value.tag, None if value.elem is None else of_python(value.elem)),))
        case None:
            return UNIT
    raise TypeMismatch(f"{value!r} has no type")


@dataclass(frozen=True)
class Record:
    items: tuple[tuple[str, object], ...]

    @staticmethod
    def of(**items: object) -> Record:
        return Record(tuple(sorted(items.items())))


@dataclass(frozen=True)
class Variant:
    tag: str
    elem: object = None
