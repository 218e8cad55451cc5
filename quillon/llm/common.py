"""Shared helpers: tables, scratch tables on the shared store, hashed words."""

from __future__ import annotations

import tempfile
import threading
import uuid
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy code holds at once; a longer text is held alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows and bytes, so long texts stay within a worker's memory.

    Both settings are of the session and read when a plan runs, which is after the caller has
    returned; so they stay. They are only ever lowered.
    """
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder on the store that the cluster shares; a local one only where none is named, as in tests."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quillon-"))
    return f"{named}/quillon-{app}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, when no result that reads them is needed any more."""
    _delete(spark, shared_folder(spark))


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    ``put`` writes one and reads it back. ``drop`` removes one that a later
    one has replaced. Tables that a lazy result may still read stay until
    ``clear_scratch``, or until whoever has written that result calls
    ``drop_since`` with the ``mark`` from before.
    """

    _made: ClassVar[threading.local] = threading.local()  # another thread's query is not this one's

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self._bases().append(self.base)

    @classmethod
    def _bases(cls) -> list[str]:
        return cls._made.__dict__.setdefault("bases", [])

    @classmethod
    def mark(cls) -> int:
        """A place in the order in which folders of scratch tables were made."""
        return len(cls._bases())

    @classmethod
    def drop_since(cls, spark: SparkSession, mark: int) -> None:
        """Delete the folders made since; nothing may read them any more."""
        for base in cls._bases()[mark:]:
            _delete(spark, base)
        del cls._bases()[mark:]

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)


def remainder(col: Column, n: int) -> Column:
    """crc32 of a value written as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def free_name(taken: list[str], name: str) -> str:
    """name, or name with underscores put before it until no column has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


# --- hashed words -----------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """Yield (first row, one past the last row, bytes, text starts) of runs of whole texts.

    A null is an empty text. ``starts`` has one more entry than the run has texts.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, starts: np.ndarray):
    """(word starts, word ends, word hashes, first word of each text) of UTF-8 bytes.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
    ``first`` has one more entry than there are texts.
    """
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = starts[:-1][starts[:-1] < len(data)]
    before[cuts] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    tails = starts[1:] - 1
    after[tails[tails >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(begin, starts)
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64), first
    # A word's bytes lie in blocks of eight, the last filled up with zeros; each block is mixed with its place.
    size = end - begin
    many = (size + 7) >> 3
    block = np.cumsum(many) - many
    at = np.cumsum(size) - size
    text = np.zeros(8 * int(many.sum()), np.uint8)
    text[np.arange(int(size.sum())) + np.repeat(8 * block - at, size)] = _LOWER[data[inside]]
    place = np.arange(len(text) >> 3) - np.repeat(block, many)
    part = mix(text.view("<u8") ^ mix(place.astype(np.uint64) + _SEED))
    return begin, end, mix(np.add.reduceat(part, block) + size.astype(np.uint64)), first
