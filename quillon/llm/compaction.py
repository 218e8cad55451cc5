"""Sharding by size-tiered compaction.

A table is a folder of immutable Parquet shards and of versioned manifests.
``append`` writes an arrival as small shards. ``compact`` merges runs of
similarly sized shards: a shard's tier is the logarithm of its bytes, and where a
tier below the target has ``fanout`` shards or more, they are rewritten as
files of about the target size. Every change writes a new manifest beside the
old one and commits it with one rename that fails if that version exists, so
readers see either version whole, and of two writers one must retry. Replaced
shards stay until ``vacuum``.

All of it is DataFrame functions on rows and on manifests. A tier's ripe shards are read by
one scan, whose parts are put together, without a shuffle, into as many tasks as the tier's bytes
make files of the target size, and each task writes one file; a plan has one scan for each tier, at most 64. The
driver holds tier totals and the paths of one compaction, at most ``MOST_FILES``, or of
one read, one for each file of some 128 MB; ripe shards above that wait for the next
round, which callers repeat until nothing is ripe. On an object store without an atomic
rename the commit needs a store that has put-if-absent.

Defined results: an empty arrival adds nothing and commits nothing; rows, nulls,
very long texts, repeated rows and all columns stay as they are; shards that tie in size
are one tier and merge in order of their paths; an arrival whose columns differ from
the table's is refused; a table without rows cannot be read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = 128 << 20
FANOUT = 4
#: Bytes of the lowest tier.
BASE = 64 << 10
MOST_FILES = 50_000
#: Rows of a shard of an arrival, at most.
SHARD_ROWS = 50_000

#: By default a union of parts of one partition each has one partition itself.
_UNION = "spark.sql.unionOutputPartitioning"
MANIFEST = "path string, rows long, bytes long"


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    path: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, rows, bytes) of a version's shards, the latest by default."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v{version:012d}")

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """All rows of a version; with ``shard``, a column of that name holds the shard's path."""
        paths = [r["path"] for r in self.manifest(version).orderBy("path").collect()]
        if not paths:
            raise ValueError(f"{self.path} has no rows")
        df = self.spark.read.parquet(*paths)
        return df.withColumn(shard, F.col("_metadata.file_path")) if shard else df

    def commit(self, shards: DataFrame, version: int) -> int:
        """Make shards the manifest of ``version``, in one step or not at all."""
        held = f"{self.path}/uncommitted/{uuid.uuid4().hex}"
        shards.select("path", "rows", "bytes").coalesce(1).write.parquet(held)
        fs, at = self._fs(held)
        _, to = self._fs(f"{self.path}/manifests/v{version:012d}")
        fs.mkdirs(to.getParent())
        if fs.exists(to):
            raise CommitConflict(f"version {version} exists")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(at, to, none)
        except Exception as e:
            if fs.exists(to):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    def _written(self, folder: str) -> DataFrame:
        """(path, rows, bytes) of the files of a folder just written."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
        data = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        counts = data.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        return files.join(counts, "path").where(F.col("rows") > 0)

    def append(self, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """Write an arrival as shards of at most ``shard_rows`` rows; its version, or the current one if it is empty."""
        version = (self.versions() or [0])[-1]
        if version:
            have = self.spark.read.parquet(self.manifest(version).first()["path"]).schema
            if [(f.name, f.dataType) for f in have] != [(f.name, f.dataType) for f in rows.schema]:
                raise ValueError("the arrival's columns differ from the table's")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", shard_rows).parquet(folder)
        new = self._written(folder)
        if new.isEmpty():
            return version
        return self.commit(self.manifest(version).unionByName(new), version + 1)

    def plan(self, target: int = TARGET, fanout: int = FANOUT, version: int | None = None) -> DataFrame:
        """(path, rows, bytes, tier) of shards to merge, of tiers with ``fanout`` shards or more."""
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / F.lit(float(BASE))) / F.log(F.lit(float(fanout))))).cast("int")
        small = self.manifest(version).where(F.col("bytes") < target * 3 // 4).withColumn("tier", tier)
        ripe = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fanout).select("tier").collect()  # a row for each tier
        return small.where(F.col("tier").isin([t["tier"] for t in ripe])).select("path", "rows", "bytes", "tier")

    def compact(self, target: int = TARGET, fanout: int = FANOUT) -> int | None:
        """Merge ripe shards, at most ``MOST_FILES``, into files of about ``target`` bytes; the new version, or None if nothing is ripe."""
        version = (self.versions() or [0])[-1]
        tiers: dict[int, list[tuple[str, int]]] = {}
        for r in self.plan(target, fanout, version).orderBy("tier", "path").limit(MOST_FILES).collect():
            tiers.setdefault(r["tier"], []).append((r["path"], r["bytes"]))
        # Shards are below three quarters of the target, so from four on there are fewer files than shards.
        merged = [(paths, -(-sum(sizes) // target)) for paths, sizes in (zip(*t, strict=True) for t in tiers.values()) if len(paths) > -(-sum(sizes) // target)]
        if not merged:
            return None
        schema = self.spark.read.parquet(merged[0][0][0]).schema
        scans = [self.spark.read.schema(schema).parquet(*paths).coalesce(files) for paths, files in merged]
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        known = self.spark.conf.get(_UNION, "true")
        self.spark.conf.set(_UNION, "false")
        try:
            reduce(DataFrame.unionByName, scans).write.parquet(folder)
        finally:
            self.spark.conf.set(_UNION, known)
        gone = self.spark.createDataFrame([(p,) for paths, _ in merged for p in paths], "path string")
        rest = self.manifest(version).join(gone, "path", "left_anti")
        return self.commit(rest.unionByName(self._written(folder)), version + 1)

    def settled(self, target: int = TARGET, fanout: int = FANOUT) -> bool:
        """Whether nothing is left to merge."""
        return self.plan(target, fanout).isEmpty()

    def sweep(self, older_than: float = 86_400.0) -> int:
        """Delete folders of shards that no version names, such as a lost writer leaves, once they are so many seconds old; how many."""
        fs, data = self._fs(f"{self.path}/data")
        if not fs.exists(data):
            return 0
        folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
        named = set()
        for v in self.versions():
            named |= {r["f"] for r in self.manifest(v).select(folder.alias("f")).distinct().collect()}  # a name for each write
        now = int(self.spark._jvm.java.lang.System.currentTimeMillis())
        lost = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in named and now - s.getModificationTime() >= 1000 * older_than]
        for p in lost:
            fs.delete(p, True)
        return len(lost)

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards and manifests that only versions before the last ``keep`` use; how many shards."""
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        if not old:
            return 0
        live = self.manifest(new[0])
        for v in new[1:]:
            live = live.union(self.manifest(v))
        gone = self.manifest(old[0])
        for v in old[1:]:
            gone = gone.union(self.manifest(v))
        n = 0
        for r in gone.select("path").distinct().join(live.select("path"), "path", "left_anti").coalesce(1).toLocalIterator():
            fs, p = self._fs(r["path"])
            fs.delete(p, False)
            n += 1
        for v in old:
            fs, p = self._fs(f"{self.path}/manifests/v{v:012d}")
            fs.delete(p, True)
        return n
