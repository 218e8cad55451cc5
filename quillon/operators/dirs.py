"""Directories as DataFrames (path, file) with one row for each path.

A directory is large data: its operators are joins and aggregates on the path. Where
rows of several directories meet, the one of the last layer wins: ``max_by`` with a
partial aggregate, so a sum of any number of directories is one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EngineError, Kind
from ..functions.collections import file_digest
from ..functions.paths import glob_pattern
from ..functions.regexps import group_count, template, translate
from ..plans.types import FILE_SCHEMA

DIR_SCHEMA = f"path string, file {FILE_SCHEMA.simpleString()}"


def file_struct(**known: Column) -> Column:
    """A file column of the given fields; the others are null."""
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FILE_SCHEMA.fields])


def file_of_text(text: Column) -> Column:
    """The file that holds a text: content-addressed, with its size in bytes."""
    return file_struct(id=F.sha2(text.cast("binary"), 256), size=F.octet_length(text))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DIR_SCHEMA)


def last_wins(rows: DataFrame, order: Column, keys: Iterable[str] = ("path",)) -> DataFrame:
    """One row for each key: the file of the greatest order."""
    return rows.groupBy(*keys).agg(F.max_by("file", order).alias("file"))


def make(rows: DataFrame, map_column: str) -> DataFrame:
    """The directory of a map column from path to file."""
    return rows.select(F.explode(map_column).alias("path", "file"))


def from_list(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """The directory of (pos, path, file) rows; of one path the last position counts."""
    return last_wins(rows, F.col(pos))


def sum_dirs(spark: SparkSession, dirs: list[DataFrame]) -> DataFrame:
    """Right-biased sum: of one path the last directory's file counts; no directories give an empty one."""
    if not dirs:
        return empty(spark)
    layers = [d.select("path", "file", F.lit(i).alias("layer")) for i, d in enumerate(dirs)]
    return last_wins(reduce(DataFrame.unionByName, layers), F.col("layer"))


def sum_layers(rows: DataFrame, layer: str) -> DataFrame:
    """The same over one table of (layer, path, file), for any number of layers."""
    return last_wins(rows, F.col(layer))


def groups(d: DataFrame, pattern: str) -> DataFrame:
    """(key, path, file): paths that match, under what the pattern's one group holds; with any other number of groups, none."""
    if group_count(pattern) != 1:
        return d.limit(0).select(F.lit("").alias("key"), "path", "file")
    java = translate(pattern)
    return d.where(F.col("path").rlike(java)).select(F.regexp_extract("path", java, 1).alias("key"), "path", "file")


def groups_list(d: DataFrame, pattern: str) -> DataFrame:
    """Groups as a list: (pos, path, file) with positions in key order, the key itself dropped. Other than one group raises."""
    if group_count(pattern) != 1:
        raise EngineError(Kind.INVALID, "a grouping pattern has exactly one group")
    grouped = groups(d, pattern)
    keys = grouped.select("key").distinct()
    ranked = number(keys, "key")
    return grouped.join(ranked, "key").select("pos", "path", "file")


#: Rows that a part of an order is to have, and the most parts.
PART_ROWS, MOST_PARTS = 20_000, 256


def in_parts(rows: DataFrame, points: Column | None, *order: str) -> DataFrame:
    """rows with ``_part``: how many of the ``split_points`` their key has reached. It depends on the key alone, so it is one wherever it is computed."""
    out = rows.withColumn("_part", F.lit(0))
    if points is None:
        return out
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    for step in (1 << i for i in reversed(range(MOST_PARTS.bit_length()))):
        reached = F.get(points, F.col("_part") + (step - 1)) <= key  # null beyond the last
        out = out.withColumn("_part", F.when(reached, F.col("_part") + step).otherwise(F.col("_part")))
    return out


def split_points(rows: DataFrame, *order: str) -> Column | None:
    """Keys that part rows into ranges of about as many rows, or None for one range.

    They are of a sample, which only the sizes of the ranges depend on. Keys are of plain types; equal ones are not parted.
    """
    keys = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    n = keys.count()
    parts = min(MOST_PARTS, -(-n // PART_ROWS))
    if parts <= 1:
        return None
    found = keys.sample(min(1.0, 16 * parts / n), seed=0).orderBy(*keys.columns).collect()
    if not found:
        return None
    points = [found[i * len(found) // parts] for i in range(1, parts)]
    return F.sort_array(F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in keys.schema.fields]) for r in points]))


def number(rows: DataFrame, *order: str, ties: Iterable[str] = ()) -> DataFrame:
    """rows with ``pos``: places from 0 in a global order, without gathering them in one task. Equal keys are in the order of ``ties``.

    Rows are dealt into ranges by split points that stay the same; each row's place is its place
    in its range and the sizes of those before, of which the driver has one number for each.
    Partitions by range won't do: Spark samples their bounds anew, and joins small ones, in each job.
    """
    dealt = in_parts(rows, split_points(rows, *order), *order)
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    offset = F.get(F.array(*[F.lit(x) for x in before]).cast("array<bigint>"), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order, *ties))
    return dealt.withColumn("pos", offset + place - 1).drop("_part")


def collect(d: DataFrame, pattern: str, replacement: str | None = None) -> DataFrame:
    """Paths that match, rewritten; where rewritten paths meet, the greatest old path's file counts."""
    java = translate(pattern)
    kept = d.where(F.col("path").rlike(java))
    if replacement is None:
        return kept
    new = F.regexp_replace("path", F.lit(java), F.lit(template(replacement, group_count(pattern))))
    return last_wins(kept.select(new.alias("path"), "file", F.col("path").alias("old")), F.col("old"))


def pick(d: DataFrame, glob: str) -> tuple[dict, str]:
    """(file, path) of the first path that a glob matches."""
    found = d.where(F.col("path").rlike(glob_pattern(glob))).orderBy("path").limit(1).collect()
    if not found:
        raise EngineError(Kind.NOT_EXIST, f"no files matched {glob}")
    return found[0]["file"], found[0]["path"]


def pick_row(d: DataFrame, glob: str) -> DataFrame:
    """The same as a DataFrame of one row, or none."""
    return d.where(F.col("path").rlike(glob_pattern(glob))).orderBy("path").limit(1)


def files(d: DataFrame) -> DataFrame:
    """(pos, file) in path order; files that, against a directory's nature, share a path are in their own order."""
    return number(d, "path", ties=["file"]).select("pos", "file")


def dir_length(d: DataFrame) -> int:
    return d.count()


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, before, after) where two directories differ; a side without the path is null, written void in ``change``."""
    x = a.select("path", file_digest(F.col("file")).alias("before"))
    y = b.select("path", file_digest(F.col("file")).alias("after"))
    both = x.join(y, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    void = F.lit("void")
    return both.withColumn("change", F.concat(F.coalesce("before", void), F.lit(" -> "), F.coalesce("after", void)))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Same paths and same files."""
    return diff(a, b).isEmpty()


def resolve(d: DataFrame, known: DataFrame) -> DataFrame:
    """(path, file, resolved): references replaced by the files that ``known`` (digest, file) has for them."""
    have = known.groupBy("digest").agg(F.max_by("file", F.col("file.id")).alias("new"))
    found = d.withColumn("digest", file_digest(F.col("file"))).join(have, "digest", "left")
    file = F.when(F.col("file.id").isNull(), F.coalesce("new", "file")).otherwise(F.col("file"))
    return found.select("path", file.alias("file")).withColumn("resolved", F.col("file.id").isNotNull())
