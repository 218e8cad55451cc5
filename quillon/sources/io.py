"""Reading and writing files and directories.

Contents are read by Spark's ``binaryFile`` source, so any file system that Hadoop
knows will do. A snapshot leaves ``content`` out, and the scan then lists names, sizes
and times without opening a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, Kind
from ..operators.dirs import file_struct

#: The most bytes that a file named without a scheme may have.
LOCAL_LIMIT = 200 << 20
SCHEMES = {"file", "localfile", "s3", "s3a", "hdfs", "viewfs", "gs", "abfs", "abfss", "http", "https", ""}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a local one only where the cluster names none, as in tests."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError(Kind.INVALID, "spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    base = f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"
    return f"{base}/quillon-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def scheme(url: str) -> str:
    head, sep, _ = url.partition("://")
    return head if sep else ""


def location(url: str) -> str:
    """The URL as Hadoop names it; an unknown scheme is not supported."""
    s = scheme(url)
    if s not in SCHEMES:
        raise EngineError(Kind.NOT_SUPPORTED, f"scheme {s} of {url}")
    if s == "localfile":
        return "file://" + url.removeprefix("localfile://")
    if s == "s3":
        return "s3a://" + url.removeprefix("s3://")
    return url


def _scan(spark: SparkSession, url: str) -> DataFrame:
    where = location(url)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(where)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise EngineError(Kind.NOT_EXIST, url)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)


def _relative(spark: SparkSession, url: str):
    """The path of a scanned file below url."""
    p = spark._jvm.org.apache.hadoop.fs.Path(location(url))
    root = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath().rstrip("/")
    plain = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(plain, len(root) + 2, 1 << 30)


def intern_dir(spark: SparkSession, url: str, content: bool = False) -> DataFrame:
    """(path, file) of all files below a URL, addressed by content; no file at all is an error."""
    url = url.rstrip("/")
    rows = _scan(spark, url).select(
        _relative(spark, url).alias("path"),
        file_struct(id=F.sha2("content", 256), size=F.col("length"), source=F.col("path"), last_modified=F.col("modificationTime")).alias("file"),
        *(["content"] if content else []),
    )
    if rows.select("path").isEmpty():
        raise EngineError(Kind.INVALID, f"empty directory {url}/")
    return rows


def intern_file(spark: SparkSession, url: str) -> DataFrame:
    """(file) of one file."""
    url = url.rstrip("/")
    rows = _scan(spark, url)
    found = rows.select("path", "length").limit(2).collect()
    if len(found) != 1:
        raise EngineError(Kind.INVALID, f"{url} is not one file")
    if not scheme(url) and found[0]["length"] > LOCAL_LIMIT:
        raise EngineError(Kind.INVALID, f"{url} has more than {LOCAL_LIMIT} bytes: give it a scheme")
    return rows.select(file_struct(id=F.sha2("content", 256), size=F.col("length"), source=F.col("path"), last_modified=F.col("modificationTime")).alias("file"))


def snapshot(spark: SparkSession, url: str) -> DataFrame:
    """(path, file) of references: names, sizes and times only. The etag is made of size and time; a store's own goes before it."""
    url = url.rstrip("/")
    etag = F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return _scan(spark, url).select(_relative(spark, url).alias("path"), file_struct(size=F.col("length"), source=F.col("path"), etag=etag, last_modified=F.col("modificationTime")).alias("file")).where(~F.endswith("path", F.lit("/")))


def intern_many(spark: SparkSession, urls: str) -> DataFrame:
    """(path, file) of comma-separated URLs; 'name=url' puts a URL's files under a name."""
    out = None
    for part in filter(None, map(str.strip, urls.split(","))):
        name, sep, url = part.partition("=")
        rows = intern_dir(spark, url if sep else part)
        base = name if sep else (part.rstrip("/").rpartition("/")[2] if "," in urls else "")
        if base:
            rows = rows.withColumn("path", F.concat(F.lit(base + "/"), "path"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise EngineError(Kind.INVALID, "no URL")
    return out


def create_file(df: DataFrame, text: str, name: str = "file") -> DataFrame:
    """df with the file that holds a text column, by its digest."""
    from ..operators.dirs import file_of_text

    return df.withColumn(name, file_of_text(F.col(text)))


def copy_dir(spark: SparkSession, source: str, target: str) -> int:
    """Copy all files below a URL to another; the target needs a scheme. Returns how many.

    Tasks read contents by Spark and write them by Arrow's file systems, each file under
    another name first and then renamed, so a task that runs again does no harm. Where
    Arrow does not know the target's scheme, the driver has Hadoop copy file by file.
    """
    if not scheme(target):
        raise EngineError(Kind.INVALID, "a copy's target has a scheme")
    root = location(target).rstrip("/")
    arrow_root = "s3://" + root.removeprefix("s3a://") if root.startswith("s3a://") else root
    files = _scan(spark, source).select(_relative(spark, source).alias("path"), F.col("path").alias("source"), "content")
    try:
        fs.FileSystem.from_uri(arrow_root)
    except (pa.ArrowInvalid, OSError):
        return _copy_by_driver(spark, files.select("path", "source"), root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(arrow_root)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                to = f"{base}/{path}"
                store.create_dir(to.rpartition("/")[0], recursive=True)
                part = f"{to}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, to)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    done = files.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()
    return done["n"] or 0


def _copy_by_driver(spark: SparkSession, files: DataFrame, root: str) -> int:
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for r in files.toLocalIterator():
        a, b = jvm.org.apache.hadoop.fs.Path(r["source"]), jvm.org.apache.hadoop.fs.Path(f"{root}/{r['path']}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
        n += 1
    return n


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    if not scheme(target):
        raise EngineError(Kind.INVALID, "a copy's target has a scheme")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(location(source)), jvm.org.apache.hadoop.fs.Path(location(target))
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def extern(df: DataFrame, url: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table to a URL, straight from the tasks that compute it."""
    df.write.format(fmt).mode(mode).save(location(url))


def delete(spark: SparkSession, url: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(location(url))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_batch(spark: SparkSession, url: str) -> DataFrame:
    """Run lists: a header row, the first column names the run, the others are its parameters."""
    df = spark.read.option("header", "true").csv(location(url))
    if not df.columns:
        raise EngineError(Kind.INVALID, f"{url} has no header")
    return df.withColumnRenamed(df.columns[0], "id")


def write_batch(df: DataFrame, url: str) -> None:
    df.coalesce(1).write.option("header", "true").mode("overwrite").csv(location(url))
