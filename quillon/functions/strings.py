"""String functions. Lengths are bytes of UTF-8, order is bytewise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import check, fail


def split(s: Column, sep: str) -> Column:
    """Parts between occurrences of a literal separator; an empty one splits into characters."""
    if sep == "":
        return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "", -1))
    return F.split(s, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def chunk(s: Column, most: int) -> Column:
    """Chunks of at most ``most`` bytes, each as long as it can be without cutting a character.

    Bytes stand as Latin-1 characters for the pattern: as many as fit, then back to where no
    continuation byte follows.
    """
    if most < 4:
        raise ValueError("chunks are of 4 bytes at least")
    raw = F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")
    parts = F.regexp_extract_all(raw, F.lit(f"(?s).{{1,{most}}}(?![\\x80-\\xBF])"), F.lit(0))
    return F.transform(parts, lambda x: F.decode(F.encode(x, "ISO-8859-1"), "UTF-8"))


def join(xs: Column, sep: str) -> Column:
    return F.array_join(xs, sep)


def has_prefix(s: Column, prefix: Column | str) -> Column:
    return F.startswith(s, F.lit(prefix) if isinstance(prefix, str) else prefix)


def has_suffix(s: Column, suffix: Column | str) -> Column:
    return F.endswith(s, F.lit(suffix) if isinstance(suffix, str) else suffix)


def sort(xs: Column) -> Column:
    return F.array_sort(xs)


def from_int(x: Column) -> Column:
    return x.cast("string")


def from_float(x: Column, digits: int) -> Column:
    """Shortest of plain and exponent form with so many significant digits, and no trailing zeros."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda f: format(f, f".{digits}g"))

    value = x.cast("double")
    # Arrow's batches have NaN for null, so only numbers go there.
    odd = F.when(F.isnan(value), F.lit("NaN")).when(value == float("inf"), F.lit("+Inf")).when(value == float("-inf"), F.lit("-Inf"))
    return F.when(value.isNotNull(), F.coalesce(odd, run(value)))


def to_float(s: Column) -> Column:
    """The number that a text spells; any other text raises."""
    shape = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return F.when(~s.rlike("[0-9]"), fail("number has no digits")).otherwise(check(s.rlike(shape), s.try_cast("double"), F.concat(F.lit("expected end of string in "), s)))
