"""Content-addressed storage: objects by digest, and an index from keys to digests.

Objects are Parquet rows (digest, content) partitioned by the first byte of the
digest, so a lookup of known digests reads few partitions. The index is an append-only
Parquet log; of one (kind, key) the row of the latest time counts. Both are cleaned up file
by file: what stays of some files is written again as new ones and only then are the old ones deleted. A
crash between leaves rows twice, which readers take once, and files written meanwhile are not touched.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "digest string, size long, content binary, part string"
INDEX = "kind string, key string, value string, labels map<string,string>, time timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, files: list[str]) -> None:
    for f in files:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)


class Repository:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.url = spark, path

    def _all(self) -> DataFrame:
        if not _exists(self.spark, self.url):
            return self.spark.createDataFrame([], OBJECTS)
        return self.spark.read.schema(OBJECTS).parquet(self.url)

    def put(self, rows: DataFrame, content: str = "content") -> DataFrame:
        """Store contents that are not there yet; (digest, size) of all."""
        raw = F.col(content).cast("binary")
        new = rows.select(F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("size"), raw.alias("content"))
        new = new.dropDuplicates(["digest"]).withColumn("part", F.substring("digest", 1, 2))
        missing = new.join(self._all().select("digest"), "digest", "left_anti")
        missing.write.mode("append").partitionBy("part").parquet(self.url)
        return rows.select(F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("size"))

    def get(self, digest: str) -> bytes | None:
        found = self._all().where((F.col("part") == digest[:2]) & (F.col("digest") == digest)).select("content").limit(1).collect()
        return bytes(found[0]["content"]) if found else None

    def stat(self, digests: DataFrame) -> DataFrame:
        """(digest, size) of those of ``digests`` that are stored."""
        return digests.join(self._all().select("digest", "size").distinct(), "digest")

    def read(self, digests: DataFrame) -> DataFrame:
        """digests with content, null where there is none."""
        held = self._all().select("digest", "content").join(digests.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
        return digests.join(held, "digest", "left")

    def write_to(self, other: Repository, digests: DataFrame) -> None:
        """Copy objects to another repository."""
        other.put(self.read(digests).where(F.col("content").isNotNull()).select("content"))

    def collect(self, live: DataFrame, older_than: float = 0.0) -> int:
        """Delete objects that are not live and whose file has so many seconds; how many went.

        Only files that hold such an object are touched.
        """
        live = live.select("digest").distinct()
        rows = self._all().withColumns({"file": F.col("_metadata.file_path"), "at": F.col("_metadata.file_modification_time")}) if _exists(self.spark, self.url) else None
        if rows is None:
            return 0
        old = F.lit(True) if older_than <= 0 else F.col("at") < F.lit(datetime.now(UTC) - timedelta(seconds=older_than))
        dead = rows.where(old).select("digest", "file").join(live, "digest", "left_anti")
        n = dead.select("digest").distinct().count()
        files = [r["file"] for r in dead.select("file").distinct().collect()]  # as for their deletion
        if files:
            kept = self.spark.read.schema(OBJECTS).option("basePath", self.url).parquet(*files).join(live, "digest", "left_semi")
            kept.select("digest", "size", "content", "part").write.mode("append").partitionBy("part").parquet(self.url)
            _remove(self.spark, files)
            self.spark.catalog.refreshByPath(self.url)
        return n


class Index:
    """Keys to values of several kinds; the latest write counts, and a null value deletes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.url = spark, path
        self._last = datetime.min

    def _log(self) -> DataFrame:
        if not _exists(self.spark, self.url):
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(self.url)

    def put(self, rows: DataFrame) -> None:
        """rows: (kind, key, value) and perhaps labels. Each write of an index object is later than the one before."""
        if "labels" not in rows.columns:
            rows = rows.withColumn("labels", F.lit(None).cast("map<string,string>"))
        self._last = max(datetime.now(UTC).replace(tzinfo=None), self._last + timedelta(microseconds=1) if self._last > datetime.min else self._last)
        at = F.timestamp_micros(F.lit(int(self._last.replace(tzinfo=UTC).timestamp()) * 1_000_000 + self._last.microsecond))
        rows.select("kind", "key", "value", "labels", at.alias("time")).write.mode("append").parquet(self.url)

    def delete(self, keys: DataFrame) -> None:
        self.put(keys.select("kind", "key", F.lit(None).cast("string").alias("value")))

    @staticmethod
    def _latest(log: DataFrame) -> DataFrame:
        # Writers that meet in one microsecond: the greater value counts, and a deletion before any.
        order = F.struct("time", F.col("value").isNull().alias("gone"), "value")
        last = log.groupBy("kind", "key").agg(F.max_by(F.struct("value", "labels", "time"), order).alias("x"))
        return last.select("kind", "key", "x.value", "x.labels", "x.time")

    def scan(self, kind: str | None = None) -> DataFrame:
        """(kind, key, value, labels, time) as they now are."""
        log = self._log() if kind is None else self._log().where(F.col("kind") == kind)
        return self._latest(log).where(F.col("value").isNotNull())

    def get(self, kind: str, key: str) -> str | None:
        found = self._latest(self._log().where((F.col("kind") == kind) & (F.col("key") == key))).collect()
        return found[0]["value"] if found else None

    def batch_get(self, wanted: DataFrame) -> DataFrame:
        """wanted (kind, key) with value and labels, null where there is none: the log's rows of these keys, and one join."""
        keys = wanted.select("kind", "key").distinct()
        mine = self._latest(self._log().join(keys, ["kind", "key"], "left_semi")).where(F.col("value").isNotNull())
        return wanted.join(mine.select("kind", "key", "value", "labels"), ["kind", "key"], "left")

    def compact(self) -> int:
        """Write the log's files again with the row that counts of each key; how many files there were."""
        if not _exists(self.spark, self.url):
            return 0
        files = [r["f"] for r in self._log().select(F.col("_metadata.file_path").alias("f")).distinct().collect()]
        if len(files) > 1:
            self._latest(self.spark.read.schema(INDEX).parquet(*files)).write.mode("append").parquet(self.url)
            _remove(self.spark, files)
            self.spark.catalog.refreshByPath(self.url)
        return len(files)


def sweep(index: DataFrame, live: DataFrame, dead: DataFrame | None = None, before=None) -> DataFrame:
    """Index rows to delete: those whose value is not live, is older than ``before`` and, with ``dead``, is listed there.

    An exact anti-join takes the place of a probabilistic live set.
    """
    gone = index.join(live.select(F.col("digest").alias("value")).distinct(), "value", "left_anti")
    if before is not None:
        gone = gone.where(F.col("time") < F.lit(before))
    if dead is not None:
        gone = gone.join(dead.select(F.col("digest").alias("value")).distinct(), "value", "left_semi")
    return gone
