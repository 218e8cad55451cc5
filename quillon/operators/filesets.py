"""Nested file sets, flattened to rows (list_path, path, file).

A file set is a list of file sets or a map from path to file. ``list_path`` is the
way of list positions to the map that a row belongs to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.collections import file_digest
from ..plans.types import FILE_SCHEMA

FILESET_SCHEMA = f"list_path array<int>, path string, file {FILE_SCHEMA.simpleString()}"


def of_dir(d: DataFrame) -> DataFrame:
    return d.select(F.array().cast("array<int>").alias("list_path"), "path", "file")


def of_file(f: DataFrame) -> DataFrame:
    """The file set of single files: each at the path '.'."""
    return f.select(F.array().cast("array<int>").alias("list_path"), F.lit(".").alias("path"), "file")


def to_dir(fs: DataFrame) -> DataFrame:
    """The directory of a file set that is a map."""
    return fs.where(F.size("list_path") == 0).select("path", "file")


def to_file(fs: DataFrame) -> DataFrame:
    """The file of a file set that is one file."""
    return fs.where((F.size("list_path") == 0) & (F.col("path") == ".")).select("file")


def data(spark: SparkSession, content: bytes) -> DataFrame:
    """Inline bytes as a file set of one file."""
    import hashlib

    file = (hashlib.sha256(content).hexdigest(), len(content), None, None, None, None)
    return spark.createDataFrame([([], ".", file)], FILESET_SCHEMA)


def merge(sets: list[DataFrame]) -> DataFrame:
    """The list of file sets."""
    return reduce(DataFrame.unionByName, [s.withColumn("list_path", F.concat(F.array(F.lit(i)), F.col("list_path"))) for i, s in enumerate(sets)])


def element(fs: DataFrame, i: int) -> DataFrame:
    return fs.where(F.get("list_path", F.lit(0)) == i).withColumn("list_path", F.slice("list_path", F.lit(2), F.size("list_path")))


def order_key(list_path: Column) -> Column:
    """Compares as the walk order: a node's own map before its lists, earlier siblings first."""
    return F.transform(list_path, lambda i: i)


def pullup(fs: DataFrame) -> DataFrame:
    """(path, file): all maps as one; of one path the file of the last in walk order counts."""
    return fs.groupBy("path").agg(F.max_by("file", order_key(F.col("list_path"))).alias("file"))


def flatten(fs: DataFrame) -> DataFrame:
    """(leaf, path, file): the maps of all leaves, by their way as text."""
    return fs.withColumn("leaf", F.array_join(F.transform("list_path", lambda i: i.cast("string")), "/"))


def distinct_files(fs: DataFrame) -> DataFrame:
    """(digest, file): each file once, however many paths it has."""
    return fs.groupBy(file_digest(F.col("file")).alias("digest")).agg(F.min("file").alias("file"))


def count(fs: DataFrame) -> DataFrame:
    """(n, size): files and their bytes, every path counted."""
    return fs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("file.size"), F.lit(0)).alias("size"))


def any_empty(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """Leaves of ``expected`` (leaf) that no row of ``parts`` has: sets without files."""
    return expected.join(flatten(parts).select("leaf").distinct(), "leaf", "left_anti")


def substitute(fs: DataFrame, known: DataFrame) -> DataFrame:
    """(list_path, path, file, resolved): references replaced by digest from ``known`` (digest, file)."""
    have = known.groupBy("digest").agg(F.max_by("file", F.col("file.id")).alias("new"))
    found = fs.withColumn("digest", file_digest(F.col("file"))).join(have, "digest", "left")
    file = F.when(F.col("file.id").isNull(), F.coalesce("new", "file")).otherwise(F.col("file"))
    return found.select("list_path", "path", file.alias("file")).withColumn("resolved", F.col("file.id").isNotNull())


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(list_path, path, before, after, change) where two file sets differ."""
    x = a.select("list_path", "path", file_digest(F.col("file")).alias("before"))
    y = b.select("list_path", "path", file_digest(F.col("file")).alias("after"))
    both = x.join(y, ["list_path", "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.withColumn("change", F.concat(F.coalesce("before", F.lit("void")), F.lit(" -> "), F.coalesce("after", F.lit("void"))))


def write_parts(fs: DataFrame, path: str) -> None:
    """Store a file set: nested types keep it as it is."""
    fs.select("list_path", "path", "file").write.mode("overwrite").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILESET_SCHEMA).parquet(path)


def to_json(fs: DataFrame) -> DataFrame:
    """(json): a line for each file."""
    return fs.select(F.to_json(F.struct("list_path", "path", "file")).alias("json"))


def from_json(lines: DataFrame, column: str = "json") -> DataFrame:
    return lines.select(F.from_json(column, FILESET_SCHEMA).alias("x")).select("x.*")
