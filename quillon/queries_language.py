"""Registered queries of expressions, modules, metadata and resources that ``queries`` has none of, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError, Kind, non_retryable, restartable, transient
from .functions import arith, checks, collections, strings
from .operators import dirs, flow, metadata, patterns, resources
from .operators.comprehension import Comprehension
from .plans import digests, modules, runflags, stdlib
from .plans import types as K
from .queries import pages_dir, query, table, tasks_of

LONGS = T.ArrayType(T.LongType())


# --- expressions --------------------------------------------------------------------


@query("SELECT n_nationkey, [n_nationkey, n_regionkey, 7, n_regionkey] AS l, [n_nationkey, n_regionkey] = [n_nationkey, n_regionkey] AND n_nationkey = n_regionkey AS same FROM nation")
def list_concat_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array("n_nationkey", "n_regionkey"), F.array(F.lit(7), F.col("n_regionkey"))
    swapped = F.array("n_regionkey", "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", collections.concat_lists(a, b).alias("l"), collections.equal(a, swapped, T.ArrayType(T.IntegerType())).alias("same"))


@query("SELECT c_custkey, c_nationkey = 3 AS same FROM customer")
def struct_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records compare by field names, at every depth, and maps whatever their order."""
    kind = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))])
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    x = F.struct(F.col("c_nationkey").alias("a"), m("k", F.lit(1), "l", F.col("c_nationkey")).alias("m"))
    y = F.struct(F.lit(3).alias("a"), m("l", F.lit(3), "k", F.lit(1)).alias("m"))
    return table(spark, sf_dir, "customer").select("c_custkey", collections.equal(x, y, kind).alias("same"))


@query("SELECT page_id, page_id % 2 = 0 AS same, TRUE AS self FROM pages")
def files_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are equal where their contents are."""
    a = dirs.file_of_text(F.col("html"))
    b = dirs.file_of_text(F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat("html", F.lit("!"))))
    return table(spark, sf_dir, "pages").select("page_id", collections.files_equal(a, b).alias("same"), collections.files_equal(a, a).alias("self"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN -1 ELSE 100 // n_nationkey END AS x, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'odd' END AS y FROM nation")
def raise_only_where_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panics, errors and delayed values in branches that are not taken."""
    n = F.col("n_nationkey")
    x = arith.cond(n == 0, F.lit(-1).cast("long"), arith.int_div(F.lit(100).cast("long"), n.cast("long")))
    safe = arith.cond(n < 0, arith.panic("negative"), x)
    y = arith.cond(n % 2 == 0, arith.delay(F.col("n_name")), arith.cond(n > 1000, arith.error(3, "large"), F.lit("odd")))
    return table(spark, sf_dir, "nation").select("n_nationkey", safe.cast("long").alias("x"), y.alias("y"))


@query("SELECT o_orderstatus, count(*) AS n, TRUE AS listed, TRUE AS mapped FROM orders GROUP BY 1")
def test_asserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and maps of conditions that all hold; one that does not would end the query."""
    good = F.array(F.col("o_totalprice") > 0, F.col("o_orderkey") >= 0)
    named = F.create_map(F.lit("price"), F.col("o_totalprice") > 0, F.lit("key"), F.col("o_orderkey") >= 0)
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", checks.assert_list(good).alias("a"), checks.assert_map(named).alias("b"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.bool_and("a").alias("listed"), F.bool_and("b").alias("mapped"))


@query("SELECT n_regionkey, count(*) AS n, (SELECT count(*) FROM nation) AS seen, (SELECT CAST(max(n_nationkey) AS BIGINT) FROM nation) AS greatest FROM nation GROUP BY 1")
def trace_and_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trace saw while the first plan was computed for its effects; then the second."""
    traced, seen = checks.trace(table(spark, sf_dir, "nation"), "nations", greatest=F.max("n_nationkey"))
    second = flow.force_then(traced, lambda: table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")))
    return second.withColumns({"seen": F.lit(seen.get["rows"]).cast("long"), "greatest": F.lit(seen.get["greatest"]).cast("long")})


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 1024, 3) AS kib, round(l_quantity * 1048576, 3) AS mib, round(l_quantity * 1073741824, 3) AS gib, round(l_quantity * 1099511627776, 3) AS tib FROM lineitem")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {k.lower(): F.round(F.col("l_quantity") * float(v), 3).alias(k.lower()) for k, v in stdlib.CONSTANTS.items()}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sizes["kib"], sizes["mib"], sizes["gib"], sizes["tib"])


@query("SELECT url AS path, strlen(html) AS size, CAST(strlen(html) * 2 AS BIGINT) AS twice FROM pages WHERE strlen(html) > 1000")
def compr_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comprehension over a directory, with a block's let."""
    c = Comprehension().over(pages_dir(spark, sf_dir)).let("size", F.col("file.size")).filter(F.col("size") > 1000).let("twice", F.col("size") * 2)
    return c.of(path=F.col("path"), size=F.col("size"), twice=F.col("twice"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN concat('F', o_custkey) ELSE o_orderpriority END AS x FROM orders")
def switch_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns on tuples and variants, proved exhaustive; a case that nothing reaches is refused."""
    P = patterns
    kind = T.StructType([T.StructField("tag", T.StringType()), T.StructField("Other", T.StringType())])
    pair = T.StructType([T.StructField("_1", kind), T.StructField("_2", T.LongType())])
    types = K.Tuple((K.Sum.of(Done=None, Other=K.STRING), K.INT))
    value = F.struct(F.when(F.col("o_orderstatus") == "F", collections.variant("Done", None, kind)).otherwise(collections.variant("Other", F.col("o_orderpriority"), kind)).alias("_1"), F.col("o_custkey").alias("_2"))
    done, other = P.TuplePat((P.VariantPat("Done"), P.Ident("k"))), P.TuplePat((P.VariantPat("Other", P.Ident("p")), P.Ignore()))
    for bad in ([done], [done, other, P.Ignore()]):
        try:
            P.check_cases(bad, types)
        except P.PatternError:
            continue
        raise AssertionError("these cases are not right")
    cases = [(done, lambda e: F.concat(F.lit("F"), e["k"].cast("string"))), (other, lambda e: e["p"])]
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("v")).select("o_orderkey", P.switch(F.col("v"), pair, cases, types).alias("x"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal IS NULL THEN NULL ELSE CAST(s_acctbal AS DOUBLE) END AS back, round(s_acctbal, 1) = round(s_acctbal, 1) AS short FROM supplier")
def float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text of some digits and back: 17 say all, and fewer say it rounded."""
    x = F.col("s_acctbal")
    near = F.abs(strings.to_float(strings.from_float(x, 4)) - x) <= F.abs(x) * 5.1e-4
    return table(spark, sf_dir, "supplier").select("s_suppkey", strings.to_float(strings.from_float(x, 17)).alias("back"), near.alias("short"))


@query("SELECT n_nationkey, CASE WHEN sha256('k') < sha256('r') THEN 1 ELSE 2 END > 0 AS ordered, TRUE AS stable FROM nation")
def map_digest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map as a list in the order of its keys' digests, which no order of entries changes."""
    kind = T.MapType(T.StringType(), T.IntegerType())
    a = F.create_map(F.lit("k"), F.col("n_nationkey"), F.lit("r"), F.col("n_regionkey"))
    b = F.create_map(F.lit("r"), F.col("n_regionkey"), F.lit("k"), F.col("n_nationkey"))
    x, y = digests.list_in_digest_order(a, kind), digests.list_in_digest_order(b, kind)
    d = F.transform(x, lambda e: digests.column_digest(e["_1"], T.StringType()))
    return table(spark, sf_dir, "nation").select("n_nationkey", (d == F.array_sort(d)).alias("ordered"), (x == y).alias("stable"))


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey < (SELECT max(r_regionkey) FROM region) GROUP BY 1")
def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that depends on what its input holds, with a constant and a context."""
    most = table(spark, sf_dir, "region").agg(F.max("r_regionkey").alias("m"))
    limit = flow.val(spark, [("below",)], "how string")

    def plan(context: dict, m: DataFrame, how: DataFrame) -> DataFrame:
        bound = m.first()["m"]
        keep = F.col("n_regionkey") < bound if how.first()["how"] == "below" else F.lit(True)
        return context["rows"].where(keep)

    rows = flow.continuation([most, limit], plan, {"rows": table(spark, sf_dir, "nation")})
    return flow.requirements(rows, mem=1 << 30, cpu=1).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('n', n_nationkey) AS line, count(*) AS n FROM nation GROUP BY 1")
def exec_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command over lines in place of a container's."""
    lines = flow.exec_pipe(table(spark, sf_dir, "nation"), "n_nationkey", "sed s/^/n/")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, concat(lower(n_name), ' ', n_regionkey, chr(10)) AS line, sha256(concat(n_name, n_name)) AS twice FROM nation")
def exec_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each row, with holes for a number, a text, a file's path and the paths of what it makes."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.lower("n_name").alias("name"), F.col("n_name").cast("binary").alias("body"))
    out = flow.exec_rows(rows, "echo {{name}} {{n_regionkey}} > {{line}}; cat {{body}} {{body}} > {{twice}}", {"line": "string", "twice": "binary"}, resources={"cpu": 1, "mem": 1 << 30})
    return out.select("n_nationkey", "line", F.sha2("twice", 256).alias("twice"))


# --- modules, flags and errors --------------------------------------------------------


class Regions(modules.Module):
    """Nations of a region, by the module's parameters."""

    region: int
    prefix: str = "n"
    label: str = modules.Default(lambda p: f"{p['prefix']}{p['region']}")

    def Main(self, nations: DataFrame) -> DataFrame:
        """The region's nations."""
        return nations.where(F.col("n_regionkey") == self.region).select(F.lit(self.label).alias("label"), "n_name")

    def _hidden(self) -> None: ...


@query("SELECT concat('n', n_regionkey) AS label, n_name FROM nation UNION ALL SELECT 'x2', n_name FROM nation WHERE n_regionkey = 2")
def module_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module made once for each region, and once from flags; only what is exported can be named."""
    nations = table(spark, sf_dir, "nation")
    keys = [r["r_regionkey"] for r in table(spark, sf_dir, "region").collect()]  # a module for each
    out = Regions.from_flags(["-region", "2", "-prefix", "x"]).Main(nations)
    for k in keys:
        out = out.unionByName(Regions.make(region=k).Main(nations))
    for bad in ({}, {"region": "2"}, {"region": 1, "color": "red"}):
        try:
            Regions.make(**bad)
        except modules.ParamError:
            continue
        raise AssertionError(f"{bad} is not right")
    if set(Regions.exports()) != {"Main"} or "region int" not in Regions.doc():
        raise AssertionError("exports")
    return out


@query("SELECT page_id, [string_split(url, '/')[3]] AS host, strlen(url) AS n FROM pages")
def stdlib_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the standard library and registered ones, found by their names."""

    @modules.intrinsic("own", "Host")
    def host(u):
        return stdlib.find("regexp.Groups")(u, "^[a-z]+://([^/]+)/")

    length = stdlib.find("len")(F.col("url"), T.StringType())
    return table(spark, sf_dir, "pages").select("page_id", modules.REGISTRY["own.Host"](F.col("url")).alias("host"), length.alias("n"))


@query("SELECT o_orderpriority AS kind, TRUE AS refused, count(*) AS n FROM orders GROUP BY 1")
def run_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that do not go together, or have no such value, are refused; the others make a configuration."""
    bad = ({"cache": "some"}, {"eval_": "sideways"}, {"invalidate": "("}, {"pred": True, "cache": "off"}, {"backgroundtimeout": -1.0}, {"assert_": "maybe"})
    refused = 0
    for flags in bad:
        try:
            runflags.RunFlags(**flags)
        except EngineError:
            refused += 1
    good = runflags.RunFlags(assert_="exact", eval_="bottomup", cache="read", nocacheextern=True)
    fine = len(good.warnings) == 1 and good.memo().mode.name == "READ" and runflags.unused(["a", "_b", "c"], {"a"}) == ["c is declared but not used"]
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused == len(bad) and fine))


@query("SELECT event_type, count(*) AS n, event_type = 'error' AS again, event_type = 'purchase' AS restart, event_type = 'view' AS never FROM events GROUP BY 1")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be done about errors of some kinds."""
    kinds = {"error": Kind.TIMEOUT, "purchase": Kind.NET, "view": Kind.INVALID}
    told = [(k, transient(EngineError(v)), restartable(EngineError(v)) and not transient(EngineError(v)), non_retryable(EngineError(v))) for k, v in kinds.items()]
    known = spark.createDataFrame(told, "event_type string, again boolean, restart boolean, never boolean")
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "event_type", "left")  # a row for each kind above
    return out.select("event_type", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("again", "restart", "never")])


# --- metadata and resources --------------------------------------------------------------


@query("SELECT concat('a', s_suppkey) AS id, concat('p', s_nationkey) AS pool, n_name AS cluster_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (1, 2, 3)")
def allocs_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocations by id with the pools that they are of."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), "s_suppkey").alias("id"), F.concat(F.lit("p"), "s_nationkey").alias("pool_id"))
    pools = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.col("n_name").alias("cluster_name"))
    return metadata.allocs(rows, ["a1", "a2", "a3"], pools).select("id", F.col("pool_id").alias("pool"), "pool.cluster_name")



@query("SELECT concat('t', event_id) AS id FROM events WHERE event_id % 3 = 0 AND epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) + 60000000 >= epoch_us(TIMESTAMP '2024-01-03 00:00:00') - 240000000")
def tasks_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without an end that were alive within the lease."""
    return metadata.active(tasks_of(spark, sf_dir), datetime(2024, 1, 3)).select("id")


@query("SELECT concat('t', event_id) AS id, event_type AS ident, concat('out/', event_id) AS place FROM events WHERE concat('t', event_id) LIKE 't77%'")
def task_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks_of(spark, sf_dir).withColumn("stdout", F.concat(F.lit("out/"), F.substring("id", 2, 20)))
    return metadata.logs(rows, "t77")


_FINE = "SELECT event_type, max(value) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50 GROUP BY 1"


@query(f"WITH f AS ({_FINE}) SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN (SELECT seconds FROM f WHERE event_type = 'view') ELSE (SELECT seconds FROM f WHERE event_type = 'click') END AS seconds FROM customer")
def predict_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by image and command, else by ident where that group is too small."""
    ended = F.timestamp_micros(F.col("event_id") * 1_000_000)
    tasks = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), "event_id").alias("id"), F.col("event_type").alias("img_cmd_id"), F.col("event_type").alias("ident"), ended.alias("end"), F.col("value").alias("mem"), F.col("value").alias("seconds"))
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "view").otherwise("none").alias("img_cmd_id"), F.lit("click").alias("ident"))
    return metadata.Predictor().predict(wanted, tasks).select("c_custkey", "seconds")


@query("SELECT n_nationkey, CAST(n_nationkey + n_regionkey AS DOUBLE) AS cpu, CAST(greatest(n_nationkey, n_regionkey) AS DOUBLE) AS most, n_nationkey >= n_regionkey AS fits, CAST(3 * greatest(n_nationkey, n_regionkey) AS DOUBLE) AS wide FROM nation")
def resource_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, bounds and fits of resources, a nation's keys being the amounts."""
    rows = []
    for r in table(spark, sf_dir, "nation").collect():  # a row for each nation
        a, b = {"cpu": float(r["n_nationkey"])}, {"cpu": float(r["n_regionkey"])}
        need = resources.Requirements()
        need.add_serial(resources.most(a, b))
        need.width = 2
        rows.append((r["n_nationkey"], resources.add(a, b)["cpu"], resources.most(a, b)["cpu"], resources.available(a, b), need.max().get("cpu", 0.0)))
    return spark.createDataFrame(rows, "n_nationkey int, cpu double, most double, fits boolean, wide double")
