"""Batches: one program over a table of runs.

``fold`` puts the parameter table into one plan, for programs whose parameters are only
columns. ``run`` evaluates runs one by one on a bounded number of threads, for those
that build their plan from parameters; each change of a run's state is written to a table when it
happens, so a batch whose driver is lost goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import restartable
from .digests import value_digest

STATES = "batch string, id string, phase string, error string, tries int, time timestamp"


def batch_id(program: str, name: str, rows: list[dict]) -> str:
    """Digest of the program, the run list's name and its contents."""
    return value_digest([program, name, [{k: "" if v is None else str(v) for k, v in r.items()} for r in rows]])


def fold(runs: DataFrame, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All runs as one plan: body sees the parameter table and keeps ``id``."""
    return body(runs)


def states(spark: SparkSession, path: str) -> DataFrame:
    """(batch, id, phase, error, tries) of all runs, as they now are."""
    log = spark.read.schema(STATES).parquet(path)
    last = log.groupBy("batch", "id").agg(F.max_by(F.struct("phase", "error", "tries"), F.struct("time", "tries", F.col("phase") != "running")).alias("x"))
    return last.select("batch", "id", "x.*")


@dataclass
class Batch:
    spark: SparkSession
    path: str
    program: str
    evaluate: Callable[[dict], object]
    parallelism: int = 4
    retries: int = 2

    def _states(self, batch: str) -> dict[str, tuple[str, int]]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return {}
        return {r["id"]: (r["phase"], r["tries"]) for r in states(self.spark, self.path).where(F.col("batch") == batch).collect()}  # one row a run

    def run(self, runs: DataFrame, name: str = "batch", retry: bool = False) -> DataFrame:
        """(id, phase, error, tries) of all runs; done ones are left alone, failed ones with ``retry`` start anew."""
        rows = [r.asDict() for r in runs.collect()]  # the driver starts each of them
        batch = batch_id(self.program, name, rows)
        before = self._states(batch)

        lock = Lock()

        def state(*values) -> tuple:
            row = (batch, *values, datetime.now(UTC).replace(tzinfo=None))
            with lock:
                self.spark.createDataFrame([row], STATES).coalesce(1).write.mode("append").parquet(self.path)
            return row

        def one(row: dict) -> tuple:
            phase, tries = before.get(row["id"], ("init", 0))
            if phase == "done" or phase == "failed" and not retry:
                return (batch, row["id"], phase, None, tries, None)
            error = None
            for n in range(self.retries + 1):
                tries += 1
                state(row["id"], "running", None, tries)
                try:
                    self.evaluate(row)
                    error, phase = None, "done"
                    break
                except Exception as e:
                    error, phase = str(e), "failed"
                    if not restartable(e) or n == self.retries:
                        break
            return state(row["id"], phase, error, tries)

        with ThreadPoolExecutor(self.parallelism) as pool:
            states = list(pool.map(one, rows))
        return self.spark.createDataFrame(states, STATES).select("id", "phase", "error", "tries")
