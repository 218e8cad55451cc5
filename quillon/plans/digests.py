"""Digests of values and of plan steps.

A digest does not depend on the order of a map's or struct's entries and does
depend on a list's. A file counts by content, never by its name. Floats that agree to
ten digits have one digest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import Record, Variant


class FileRef(Record):
    """A file as a literal: its fields as in a file column."""


def _sha(*parts: bytes) -> bytes:
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "big"))
        h.update(p)
    return h.digest()


def _raw(value: object) -> bytes:
    match value:
        case None:
            return _sha(b"unit")
        case bool():
            return _sha(b"bool", b"1" if value else b"0")
        case int():
            return _sha(b"int", str(value).encode())
        case float():
            return _sha(b"float", f"{value:.10e}".encode())
        case str():
            return _sha(b"string", value.encode())
        case bytes():
            return _sha(b"data", value)
        case FileRef():
            known = dict(value.items)
            if known.get("id"):
                return _sha(b"file", str(known["id"]).encode())
            if known.get("content_hash"):
                return _sha(b"file", str(known["content_hash"]).encode())
            return _sha(b"ref", *[str(known.get(k)).encode() for k in ("size", "source", "etag")])
        case tuple():
            return _sha(b"tuple", *map(_raw, value))
        case list():
            return _sha(b"list", *map(_raw, value))
        case dict():
            return _sha(b"map", *sorted(_sha(_raw(k), _raw(v)) for k, v in value.items()))
        case Record():
            return _sha(b"struct", *[_sha(k.encode(), _raw(v)) for k, v in sorted(value.items)])
        case Variant():
            return _sha(b"sum", value.tag.encode(), *([] if value.elem is None else [_raw(value.elem)]))
    raise TypeError(f"{value!r} has no digest")


def value_digest(value: object) -> str:
    """Digest of a literal."""
    return _raw(value).hex()


def step_digest(op: str, params: object, inputs: list[str]) -> str:
    """Digest of a plan step from its operation, parameters and the digests of its inputs."""
    return _sha(b"step", op.encode(), _raw(params), *[i.encode() for i in inputs]).hex()


def column_digest(x: Column, dtype: T.DataType) -> Column:
    """The digest of a column's values under the same rules, in Spark."""
    match dtype:
        case T.StructType():
            if {"id", "size", "etag"} <= set(dtype.fieldNames()):
                from ..functions.collections import file_digest

                return F.sha2(F.concat(F.lit("file|"), file_digest(x)), 256)
            parts = [F.concat(F.lit(f.name + "="), F.coalesce(column_digest(x[f.name], f.dataType), F.lit("-"))) for f in sorted(dtype.fields, key=lambda f: f.name)]
            return F.sha2(F.concat(F.lit("struct|"), F.concat_ws("|", *parts)), 256)
        case T.ArrayType():
            return F.sha2(F.concat(F.lit("list|"), F.array_join(F.transform(x, lambda e: column_digest(e, dtype.elementType)), "|")), 256)
        case T.MapType():
            pairs = F.transform(F.map_entries(x), lambda e: F.concat(column_digest(e["key"], dtype.keyType), F.lit("="), column_digest(e["value"], dtype.valueType)))
            return F.sha2(F.concat(F.lit("map|"), F.array_join(F.array_sort(pairs), "|")), 256)
        case T.FloatType() | T.DoubleType():
            return F.sha2(F.concat(F.lit("float|"), F.format_string("%.10e", x.cast("double"))), 256)
    return F.sha2(F.concat(F.lit(f"{dtype.simpleString()}|"), x.cast("string")), 256)


def list_in_digest_order(m: Column, dtype: T.MapType) -> Column:
    """Pairs (_1, _2) of a map in the order of their keys' digests: fixed, but by no meaning of the keys."""
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(column_digest(e["key"], dtype.keyType).alias("d"), e["key"].alias("_1"), e["value"].alias("_2")))
    return F.transform(F.array_sort(pairs), lambda e: F.struct(e["_1"], e["_2"]))
