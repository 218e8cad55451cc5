"""Queries over runs, tasks, pools and allocations.

Tables are plain DataFrames, partitioned by the date of ``keepalive`` where they are
stored, so a time range prunes partitions. Times are [start, keepalive, end].
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import dirs

TIMES = "start timestamp, keepalive timestamp, end timestamp"
RUNS = f"id string, user string, labels map<string,string>, bundle string, args array<string>, exec_log string, sys_log string, eval_graph string, trace string, {TIMES}"
TASKS = f"id string, run_id string, alloc_id string, flow_id string, result_id string, img_cmd_id string, ident string, attempt int, err string, resources map<string,double>, uri string, stdout string, stderr string, inspect string, {TIMES}"
POOLS = f"id string, pool_type string, resources map<string,double>, uri string, cluster_name string, user string, version string, {TIMES}"
ALLOCS = f"id string, pool_id string, resources map<string,double>, uri string, {TIMES}"


def last_seen() -> Column:
    """The end of a row's time: its end, else when it was last alive."""
    return F.coalesce("end", "keepalive")


def with_interval(df: DataFrame) -> DataFrame:
    return df.withColumn("until", last_seen())


def alive_between(df: DataFrame, since: datetime | None, until: datetime | None) -> DataFrame:
    """Rows alive after ``since`` and before ``until``; both bounds hold for ranges of any length."""
    if since is not None:
        df = df.where(F.col("keepalive") > F.lit(since))
    if until is not None:
        df = df.where(F.col("keepalive") < F.lit(until))
    return df


def by_id(df: DataFrame, id_: str) -> DataFrame:
    """Rows of an id; a short one stands for all ids that begin with it."""
    return df.where(F.startswith("id", F.lit(id_)))


@dataclass(frozen=True)
class TaskQuery:
    """The first of id, run_id, img_cmd_id, ident and the time range that is given decides."""

    id: str | None = None
    run_id: str | None = None
    img_cmd_id: str | None = None
    ident: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    limit: int = 0
    with_alloc: bool = False


def tasks(df: DataFrame, q: TaskQuery, allocs: DataFrame | None = None, pools: DataFrame | None = None) -> DataFrame:
    if q.id is not None:
        df = by_id(df, q.id)
    elif q.run_id is not None:
        df = df.where(F.col("run_id") == q.run_id)
    elif q.img_cmd_id is not None:
        df = df.where(F.col("img_cmd_id") == q.img_cmd_id)
    elif q.ident is not None:
        df = df.where(F.col("ident") == q.ident)
    else:
        df = alive_between(df, q.since, q.until)
    if q.limit > 0:
        df = df.orderBy(F.desc("keepalive"), "id").limit(q.limit)
    if q.with_alloc and (q.id is not None or q.run_id is not None):
        df = with_alloc(df, allocs, pools)
    return df


def with_alloc(df: DataFrame, allocs: DataFrame, pools: DataFrame) -> DataFrame:
    """Tasks with their allocation and its pool as structs; null where they are not known."""
    pool = pools.select(F.struct(*pools.columns).alias("pool"))
    alloc = allocs.select(F.struct(*allocs.columns).alias("alloc"))
    return df.join(alloc, df["alloc_id"] == F.col("alloc.id"), "left").join(pool, F.col("alloc.pool_id") == F.col("pool.id"), "left")


def runs(df: DataFrame, id_: str | None = None, since: datetime | None = None, until: datetime | None = None, user: str | None = None) -> DataFrame:
    if id_ is not None:
        return by_id(df, id_)
    df = alive_between(df, since, until)
    return df if not user else df.where(F.col("user") == user)


def pools(df: DataFrame, ids: list[str] | None = None, since: datetime | None = None, until: datetime | None = None, cluster: dict[str, str] | None = None) -> DataFrame:
    """Pools of ids, or those alive in a time range that match the parts of a cluster's name, user and version that are given."""
    if ids:
        return df.where(F.col("id").isin(ids))
    df = alive_between(df, since, until)
    for k, v in (cluster or {}).items():
        df = df.where(F.col({"name": "cluster_name"}.get(k, k)) == v)
    return df


def allocs(df: DataFrame, ids: list[str], pools: DataFrame | None = None) -> DataFrame:
    df = df.where(F.col("id").isin(ids))
    return df if pools is None else df.join(pools.select(F.struct(*pools.columns).alias("pool")), F.col("pool_id") == F.col("pool.id"), "left")


def sum_cost(value: str, kind: str) -> tuple[Column, Column]:
    """Total of costs and its kind: an upper bound if any part is one, else exact; unknown parts add nothing."""
    known = F.col(kind) != "unknown"
    total = F.sum(F.when(known, F.col(value)).otherwise(F.lit(0.0)))
    of = F.when(F.max(F.when(F.col(kind) == "upper", 1).otherwise(0)) == 1, "upper").when(F.max(F.when(F.col(kind) == "exact", 1).otherwise(0)) == 1, "exact").otherwise("unknown")
    return total, of


def cost_text(value: Column, kind: Column) -> Column:
    number = F.format_string("%5.4f", value)
    return F.when(kind == "unknown", F.lit("<unknown>")).when(kind == "upper", F.concat(F.lit("<"), number)).otherwise(number)


def hourly_cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Upper bounds of allocations' costs from the hourly prices of instance types (type, price)."""
    hours = (F.unix_micros(last_seen()) - F.unix_micros("start")) / F.lit(3.6e9)
    priced = df.join(prices, "type", "left")
    return priced.withColumn("cost", F.coalesce(F.col("price") * hours, F.lit(0.0))).withColumn("cost_kind", F.when(F.col("price").isNotNull(), "upper").otherwise("unknown"))


def list_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with number and total cost of their tasks (cost, cost_kind), by start and id: one join for all runs."""
    total, kind = sum_cost("cost", "cost_kind")
    per = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("err").isNotNull()).alias("n_failed"), total.alias("cost"), kind.alias("cost_kind"))
    out = runs.join(per, runs["id"] == per["run_id"], "left").drop("run_id")
    return out.withColumns({"n_tasks": F.coalesce("n_tasks", F.lit(0)), "n_failed": F.coalesce("n_failed", F.lit(0)), "cost": F.coalesce("cost", F.lit(0.0)), "cost_kind": F.coalesce("cost_kind", F.lit("unknown"))}).orderBy("start", "id")


def summary(steps: DataFrame, metrics: tuple[str, ...] = ("runtime", "cpu", "mem", "disk", "tmp")) -> DataFrame:
    """Per ident: n, n_cached, and min, mean and max of each metric over steps that ran.

    steps: (ident, cached, metrics); a cached step counts and has no metrics.
    """
    ran = lambda c: F.when(~F.col("cached"), F.col(c))
    stats = [f(ran(m)).alias(f"{name}_{m}") for m in metrics for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return steps.groupBy("ident").agg(F.count(F.lit(1)).alias("n"), F.count_if("cached").alias("n_cached"), *stats)


#: Below this share of what was asked for a step is over-allocated, if it asked for more than the least amount.
OVER_SHARE, LEAST_MEM = 0.6, 500 << 20


def over_allocated(summary: DataFrame, requested: str = "requested_mem", used: str = "mean_mem") -> DataFrame:
    return summary.where((F.col(used) / F.col(requested) <= OVER_SHARE) & (F.col(requested) > LEAST_MEM))


def rank_of(n: Column, p: float) -> Column:
    """The rank, from 1, of a percentile among n values: ceil(n p / 100), and 1 for p 0."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile is from 0 to 100")
    return F.greatest(F.lit(1), F.least(n, F.ceil(n.cast("double") * F.lit(float(p)) / F.lit(100.0)))).cast("long")


def nearest_rank(values: Column, p: float) -> Column:
    """The percentile of a list of values that is bounded, null for an empty one."""
    ordered = F.array_sort(values)
    return F.get(ordered, (rank_of(F.size(values), p) - 1).cast("int"))


def percentiles(df: DataFrame, by: str, column: str, ps: dict[str, float]) -> DataFrame:
    """(by, a column for each of ps): percentiles of the values of groups of any size. Null and NaN are no values.

    Equal values are counted first. The distinct ones are dealt into ranges by group and value, and ranks are sums
    of counts within a range and a group, and of that group's ranges before; so no group is gathered in one task.
    """
    # A structure of the group, as null is a group too and equals nothing in a join.
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.struct(F.col(by).alias("v")).alias("g"), F.col(column).alias("x"))
    points = dirs.split_points(rows.select("g.v", "x"), "v", "x")
    counted = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    dealt = dirs.in_parts(counted.withColumn("v", F.col("g.v")), points, "v", "x").drop("v")
    group = Window.partitionBy("g")
    sums = dealt.groupBy("g", "_part").agg(F.sum("n").alias("n"))
    parts = sums.select("g", "_part", (F.sum("n").over(group.orderBy("_part")) - F.col("n")).alias("before"), F.sum("n").over(group).alias("total"))
    last = F.col("before") + F.sum("n").over(Window.partitionBy("g", "_part").orderBy("x"))
    placed = dealt.join(parts, ["g", "_part"]).select("g", "x", "n", "total", last.alias("last"))
    at = lambda p: rank_of(F.col("total"), p).between(F.col("last") - F.col("n") + 1, F.col("last"))
    return placed.groupBy(F.col("g").alias("_g")).agg(*[F.max(F.when(at(p), F.col("x"))).alias(k) for k, p in ps.items()]).select(F.col("_g.v").alias(by), *[F.col(f"`{k}`") for k in ps])


def newest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows of each group that ended last, those without an end left out."""
    order = Window.partitionBy(*by).orderBy(F.desc("end"), "id")
    return df.where(F.col("end").isNotNull()).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


#: Profiles of more memory than this are taken for errors of measurement.
MOST_MEM = 4 << 40


@dataclass(frozen=True)
class Predictor:
    """Predicts memory and duration from profiles of like tasks.

    A task's group is its image and command, else its ident. A group needs ``min_data``
    tasks, and as many valid profiles among the newest ``max_inspect`` that ended and have one.
    The duration is the longest; with too few of them it is 0.
    """

    min_data: int = 5
    max_inspect: int = 50
    mem_percentile: float = 95

    def model(self, tasks: DataFrame, by: str) -> DataFrame:
        """(by, mem, seconds, n) of groups with enough data. tasks: (by, id, end, mem, seconds); null mem: no profile."""
        tasks = tasks.where(F.col(by).isNotNull())
        enough = tasks.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.min_data).select(by)
        used = newest(tasks.join(enough, by, "left_semi").where(F.col("mem").isNotNull()), self.max_inspect, by)
        used = used.withColumn("mem", F.when(F.col("mem").between(0, MOST_MEM), F.col("mem")))
        found = used.groupBy(by).agg(nearest_rank(F.collect_list("mem"), self.mem_percentile).cast("double").alias("mem"), F.max("seconds").alias("longest"), F.count("seconds").alias("timed"), F.count("mem").alias("n"))
        seconds = F.when(F.col("timed") >= self.min_data, F.col("longest")).otherwise(F.lit(0.0))
        return found.where(F.col("n") >= self.min_data).select(by, "mem", seconds.alias("seconds"), "n")

    def predict(self, wanted: DataFrame, tasks: DataFrame) -> DataFrame:
        """wanted (id, img_cmd_id, ident) with predicted mem and seconds; null if neither group has enough data."""
        fine = self.model(tasks, "img_cmd_id").select("img_cmd_id", F.struct("mem", "seconds").alias("fine"))
        coarse = self.model(tasks, "ident").select("ident", F.struct("mem", "seconds").alias("coarse"))
        both = wanted.join(fine, "img_cmd_id", "left").join(coarse, "ident", "left")
        best = F.when(F.col("fine").isNotNull(), F.col("fine")).otherwise(F.col("coarse"))
        return both.select(*wanted.columns, best["mem"].alias("mem"), best["seconds"].alias("seconds"))


@dataclass
class Retry:
    """How a failed task goes on: more memory after running out, at most ``most`` times."""

    factor: float = 1.5
    ceiling: int = 800 << 30
    most: int = 3
    tried: int = field(default=0)

    def after_oom(self, mem: float, predicted: float | None = None) -> float | None:
        """Memory of the next try, or None if there is none."""
        if self.tried >= self.most:
            return None
        self.tried += 1
        return min(max(mem * self.factor, predicted or 0.0), float(self.ceiling))


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def label_filter(expression: str, labels: str = "labels") -> Column:
    """Whether labels match: alternatives are set off by blanks, conditions by commas, and ! negates.

    Each condition is a pattern on 'key=value' that some label matches, or with ! none does.
    """
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    out = F.lit(False)
    for alternative in expression.split(" "):
        every = F.lit(True)
        for term in alternative.split(","):
            found = F.exists(pairs, _like(term.removeprefix("!")))
            every = every & (~found if term.startswith("!") else found)
        out = out | every
    return out


def images(tasks: DataFrame) -> DataFrame:
    """(img_cmd_id, n_tasks, n_runs, last): what ran, and when last."""
    return tasks.groupBy("img_cmd_id").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_distinct("run_id").alias("n_runs"), F.max(last_seen()).alias("last"))


def info(id_: str, **tables: DataFrame) -> dict[str, list]:
    """Rows of every table whose id is, or begins with, id_; at most ten of each."""
    return {name: by_id(df, id_).limit(10).collect() for name, df in tables.items()}


def active(df: DataFrame, now: datetime, lease_seconds: int = 240) -> DataFrame:
    """Rows without an end whose last sign of life is no older than the lease."""
    return df.where(F.col("end").isNull() & (F.col("keepalive") >= F.lit(now) - F.expr(f"INTERVAL {lease_seconds} SECONDS")))


def logs(tasks: DataFrame, id_: str, stream: str = "stdout") -> DataFrame:
    """(id, ident, place): where a task's output is."""
    return by_id(tasks, id_).select("id", "ident", F.col(stream).alias("place"))
