"""Writing run metadata: an append-only log for each kind of row.

Every call makes one row with the fields that it sets, so writers never meet. Rows are
appended in batches: signs of life wait until ``batch`` rows are there, or a call that
sets anything else, or a reader. Reading takes, for each id and field, the value that was set last.
The log is partitioned by the day of writing, so rows alive after a time are sought in that
day's partitions and later ones.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, Kind
from ..operators.metadata import ALLOCS, POOLS, RUNS, TASKS

SCHEMAS = {"run": RUNS, "task": TASKS, "pool": POOLS, "alloc": ALLOCS}


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class TaskDB:
    def __init__(self, spark: SparkSession, path: str, batch: int = 256):
        self.spark, self.url, self.batch = spark, path.rstrip("/"), batch
        self._waiting: dict[str, list[dict]] = {}

    def _schema(self, kind: str) -> T.StructType:
        return T._parse_datatype_string(SCHEMAS[kind])

    def _write(self, kind: str, id_: str, **fields: object) -> None:
        schema = self._schema(kind)
        unknown = set(fields) - set(schema.fieldNames())
        if unknown:
            raise EngineError(Kind.INVALID, f"{kind} has no field {sorted(unknown)[0]}")
        at = _now()
        row = {f.name: fields.get(f.name) for f in schema.fields} | {"id": id_, "_at": at, "_day": at.date()}
        waiting = self._waiting.setdefault(kind, [])
        waiting.append(row)
        if set(fields) != {"keepalive"} or len(waiting) >= self.batch:
            self.flush(kind)

    def _log_schema(self, kind: str) -> T.StructType:
        return T.StructType([*self._schema(kind).fields, T.StructField("_at", T.TimestampType()), T.StructField("_day", T.DateType())])

    def flush(self, kind: str | None = None) -> None:
        """Append the rows that wait, in one file a day."""
        for k in [kind] if kind else list(self._waiting):
            if rows := self._waiting.pop(k, []):
                self.spark.createDataFrame(rows, self._log_schema(k)).coalesce(1).write.mode("append").partitionBy("_day").parquet(f"{self.url}/{k}")

    def _create(self, kind: str, id_: str, start: datetime | None, **fields: object) -> None:
        start = start or _now()
        self._write(kind, id_, start=start, keepalive=start, **fields)

    def create_run(self, id_: str, user: str, labels: dict[str, str] | None = None, start: datetime | None = None) -> None:
        self._create("run", id_, start, user=user, labels=labels or {})

    def set_run_attrs(self, id_: str, bundle: str, args: list[str]) -> None:
        self._write("run", id_, bundle=bundle, args=args)

    def set_run_complete(self, id_: str, exec_log: str | None = None, sys_log: str | None = None, eval_graph: str | None = None, trace: str | None = None, end: datetime | None = None) -> None:
        self._write("run", id_, exec_log=exec_log, sys_log=sys_log, eval_graph=eval_graph, trace=trace, end=end or _now())

    def create_task(self, id_: str, run_id: str, flow_id: str, ident: str, attempt: int = 0, alloc_id: str | None = None, img_cmd_id: str | None = None, uri: str | None = None, resources: dict[str, float] | None = None, start: datetime | None = None) -> None:
        self._create("task", id_, start, run_id=run_id, flow_id=flow_id, ident=ident, attempt=attempt, alloc_id=alloc_id, img_cmd_id=img_cmd_id, uri=uri, resources=resources or {})

    def set_task_uri(self, id_: str, uri: str) -> None:
        self._write("task", id_, uri=uri)

    def set_task_result(self, id_: str, result_id: str) -> None:
        self._write("task", id_, result_id=result_id)

    def set_task_attrs(self, id_: str, stdout: str | None = None, stderr: str | None = None, inspect: str | None = None) -> None:
        self._write("task", id_, stdout=stdout, stderr=stderr, inspect=inspect)

    def set_task_complete(self, id_: str, err: str | None = None, end: datetime | None = None) -> None:
        self._write("task", id_, err=err, end=end or _now())

    def start_pool(self, id_: str, start: datetime | None = None, **fields: object) -> None:
        self._create("pool", id_, start, **fields)

    def start_alloc(self, id_: str, pool_id: str, start: datetime | None = None, **fields: object) -> None:
        self._create("alloc", id_, start, pool_id=pool_id, **fields)

    def keep_alive(self, kind: str, id_: str, at: datetime | None = None) -> None:
        self._write(kind, id_, keepalive=at or _now())

    def set_end(self, kind: str, id_: str, end: datetime | None = None) -> None:
        self._write(kind, id_, end=end or _now())

    def table(self, kind: str, since: datetime | None = None) -> DataFrame:
        """Rows as they now are: of each field the value set last, of keepalive the latest.

        With ``since`` only rows that were written to on its day or later, which are all that may be alive after it.
        """
        self.flush(kind)
        schema = self._schema(kind)
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.url}/{kind}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        log = self.spark.read.schema(self._log_schema(kind)).parquet(f"{self.url}/{kind}")
        if since is not None:
            log = log.join(log.where(F.col("_day") >= F.lit(since.date())).select("id").distinct(), "id", "left_semi")
        last = [F.max_by(f.name, F.when(F.col(f.name).isNotNull(), F.col("_at"))).alias(f.name) for f in schema.fields if f.name not in ("id", "keepalive")]
        return log.groupBy("id").agg(*last, F.max("keepalive").alias("keepalive")).select(schema.fieldNames())
