"""Lists, maps, tuples, structs and variants as array, map and struct columns.

Order matters in lists and not in maps: ``entries`` gives a map's pairs in key order.
A list or map that may be empty has its Spark type from a cast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold_python

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arith import check, fail


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where lambdas of body name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def length(x: Column, dtype: T.DataType) -> Column:
    """Bytes of a string or file, elements of a list, map or directory."""
    if isinstance(dtype, T.StringType):
        return F.octet_length(x).cast("long")
    if isinstance(dtype, T.StructType) and {"id", "size"} <= set(dtype.fieldNames()):
        return x["size"]
    return F.size(x).cast("long")


def index(x: Column, i: Column) -> Column:
    """An element by position from 0; outside the list it raises."""
    return check((i >= 0) & (i < F.size(x)), F.get(x, i.cast("int")), F.concat(F.lit("index out of bounds: "), i.cast("string")))


def lookup(m: Column, key: Column) -> Column:
    """A map's value; a key that is not there raises."""
    return check(F.map_contains_key(m, key), F.try_element_at(m, key), F.concat(F.lit("key not found: "), key.cast("string")))


def concat_lists(*xs: Column) -> Column:
    return F.concat(*xs)


def zip_lists(a: Column, b: Column) -> Column:
    """Pairs (_1, _2) of lists of one length; other lists raise."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("_1"), F.get(b, i).alias("_2")))
    return check(F.size(a) == F.size(b), pairs, "zip: lists differ in length")


def unzip(pairs: Column) -> Column:
    """A tuple (_1, _2) of lists."""
    return F.struct(F.transform(pairs, lambda p: p["_1"]).alias("_1"), F.transform(pairs, lambda p: p["_2"]).alias("_2"))


def flatten(xs: Column) -> Column:
    return F.flatten(xs)


def map_of(pairs: Column) -> Column:
    """A map of pairs (_1, _2); of equal keys the last pair counts, whatever the session's policy."""
    def last(p: Column) -> Column:
        order = F.array_sort(F.transform(p, lambda x, i: F.struct(x["_1"].alias("k"), i.alias("i"))))
        return let(order, lambda o: F.transform(F.filter(o, lambda x, i: ~F.get(o, i + 1)["k"].eqNullSafe(x["k"])), lambda x: F.struct(x["k"], F.get(p, x["i"])["_2"])))

    return let(pairs, lambda p: F.map_from_entries(last(p)))


def merge_maps(*ms: Column) -> Column:
    """All entries; of equal keys the right-most map's counts."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return fold_python(two, ms)


def entries(m: Column) -> Column:
    """Pairs (_1, _2) of a map in key order."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias("_1"), e["value"].alias("_2")))


def fold(f: Callable[[Column, Column], Column], xs: Column, init: Column) -> Column:
    """Left fold; the result has init's type."""
    return F.aggregate(xs, init, f)


def reduce(f: Callable[[Column, Column], Column], xs: Column) -> Column:
    """Left fold that starts with the first element; an empty list raises."""
    return check(F.size(xs) > 0, F.aggregate(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), f), "reduce: empty list")


def int_range(lo: Column, hi: Column) -> Column:
    """Integers from lo up to and without hi; lo above hi raises."""
    empty = F.array().cast("array<bigint>")
    some = F.sequence(lo.cast("long"), F.greatest(hi - 1, lo).cast("long"))
    return F.when(lo > hi, fail("range: bounds are reversed")).when(lo == hi, empty).otherwise(some)


def variant(tag: str, payload: Column | None, sum_type: T.StructType) -> Column:
    """A value of a sum type: its tag, and the payload under the tag's name."""
    fields = []
    for f in sum_type.fields:
        if f.name == "tag":
            fields.append(F.lit(tag).alias("tag"))
        else:
            fields.append((payload if f.name == tag and payload is not None else F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def ascribe(x: Column, have: T.DataType, want: T.DataType) -> Column:
    """x seen as a supertype: struct fields are taken by name, at every depth, and in the supertype's order."""
    match have, want:
        case T.StructType(), T.StructType():
            own = {f.name: f.dataType for f in have.fields}
            missing = [f.name for f in want.fields if f.name not in own]
            if missing:
                raise TypeError(f"no field {missing[0]}")
            return F.struct(*[ascribe(x[f.name], own[f.name], f.dataType).alias(f.name) for f in want.fields])
        case T.ArrayType(), T.ArrayType():
            return F.transform(x, lambda e: ascribe(e, have.elementType, want.elementType))
        case T.MapType(), T.MapType():
            return F.transform_values(x, lambda _, v: ascribe(v, have.valueType, want.valueType))
    return x.cast(want)


def canonical(x: Column, dtype: T.DataType) -> Column:
    """A form that Spark's own = compares: struct fields by name, maps as sorted entries."""
    match dtype:
        case T.StructType():
            if {"id", "size", "etag"} <= set(dtype.fieldNames()):
                return file_digest(x)
            return F.struct(*[canonical(x[f.name], f.dataType).alias(f.name) for f in sorted(dtype.fields, key=lambda f: f.name)])
        case T.ArrayType():
            return F.transform(x, lambda e: canonical(e, dtype.elementType))
        case T.MapType():
            pairs = F.transform(F.map_entries(x), lambda e: F.struct(canonical(e["key"], dtype.keyType).alias("k"), canonical(e["value"], dtype.valueType).alias("v")))
            return F.array_sort(pairs)
    return x


def equal(a: Column, b: Column, dtype: T.DataType) -> Column:
    """Deep equality of values of one type. Null, which only absent payloads have, equals null."""
    return canonical(a, dtype).eqNullSafe(canonical(b, dtype))


def file_digest(f: Column) -> Column:
    """A file's digest: its id, else its content hash, else a digest of what is known of the reference."""
    reference = F.sha2(F.concat_ws("\x00", f["size"].cast("string"), F.coalesce(f["source"], F.lit("")), F.coalesce(f["etag"], F.lit(""))), 256)
    return F.coalesce(f["id"], f["content_hash"], F.concat(F.lit("ref:"), reference))


def files_equal(a: Column, b: Column) -> Column:
    """Equality of files: by id where both are resolved, by source, size and a known etag where neither is; else it raises."""
    ids = a["id"].isNotNull() & b["id"].isNotNull()
    neither = a["id"].isNull() & b["id"].isNull()
    hashes = F.when(a["content_hash"].isNotNull() & b["content_hash"].isNotNull(), a["content_hash"] == b["content_hash"]).otherwise(F.lit(True))
    known = F.coalesce(a["etag"], F.lit("")) != ""
    reference = known & (a["size"] == b["size"]) & (a["source"] == b["source"]) & a["etag"].eqNullSafe(b["etag"]) & hashes
    return F.when(ids, a["id"] == b["id"]).when(neither, reference).otherwise(fail("a resolved and an unresolved file do not compare: intern one"))
