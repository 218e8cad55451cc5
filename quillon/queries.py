"""The registered queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions import arith, checks, collections, paths, regexps, strings
from .operators import assertions, dirs, filesets, flow, metadata, patterns
from .operators.comprehension import Comprehension, list_comprehension, nested_comprehension
from .operators.resources import totals
from .plans import digests
from .plans import types as K
from .streaming import sessions, tumbling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with equivalent SQL if there is any."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a directory: the URL is the path, the HTML the content."""
    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), dirs.file_of_text(F.col("html")).alias("file"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows (pos, path, file): many documents of one language and source share a path."""
    path = F.concat_ws("/", "lang", "source")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), path.alias("path"), dirs.file_of_text(F.col("text")).alias("file"))


def names(d: DataFrame) -> DataFrame:
    return d.select("path", F.col("file.id").alias("id"), F.col("file.size").alias("size"))


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


# --- directories and file sets -------------------------------------------------

KEY = r"^https?://[^/]+/([a-z]+)/"


@query(
    rf"""SELECT regexp_extract(url, '{KEY}', 1) AS key, count(*) AS n_files, CAST(sum(strlen(html)) AS BIGINT) AS total_bytes, min(url) AS min_path, min(sha256(html)) AS min_id
FROM pages WHERE regexp_matches(url, '{KEY}') GROUP BY 1"""
)
def dirs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = dirs.groups(pages_dir(spark, sf_dir), KEY)
    return grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n_files"), F.sum("file.size").alias("total_bytes"), F.min("path").alias("min_path"), F.min("file.id").alias("min_id"))


@query(
    rf"""WITH g AS (SELECT regexp_extract(url, '{KEY}', 1) AS key, url, html FROM pages WHERE regexp_matches(url, '{KEY}')),
r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM (SELECT DISTINCT key FROM g))
SELECT CAST(pos AS INTEGER) AS elem, url AS path, sha256(html) AS id FROM g JOIN r USING (key)"""
)
def flow_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = flow.groupby(filesets.of_dir(pages_dir(spark, sf_dir)), KEY)
    return fs.select(F.get("list_path", F.lit(0)).alias("elem"), "path", F.col("file.id").alias("id"))


@query(
    rf"""WITH g AS (SELECT regexp_extract(url, '{KEY}', 1) AS key, url, html FROM pages WHERE regexp_matches(url, '{KEY}')),
r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM (SELECT DISTINCT key FROM g)),
c AS (SELECT pos, regexp_replace(url, '^https?://([^/]+)/.*$', '\1') AS path, html, url FROM g JOIN r USING (key))
SELECT CAST(pos AS INTEGER) AS elem, path, arg_max(sha256(html), url) AS id FROM c GROUP BY pos, path"""
)
def flow_groupby_map_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = flow.groupby(filesets.of_dir(pages_dir(spark, sf_dir)), KEY)
    mapped = flow.map_list(grouped, lambda e: flow.collect(e, "^https?://([^/]+)/.*$", "$1"))
    return mapped.select(F.get("list_path", F.lit(0)).alias("elem"), "path", F.col("file.id").alias("id"))


@query(
    r"""SELECT regexp_replace(url, '^https?://([^/]+)/.*$', '\1') AS path, arg_max(sha256(html), url) AS id, arg_max(strlen(html), url) AS size
FROM pages WHERE regexp_matches(url, '^https?://([^/]+)/.*$') GROUP BY 1"""
)
def dirs_collect_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(dirs.collect(pages_dir(spark, sf_dir), "^https?://([^/]+)/.*$", "$1"))


@query("SELECT concat_ws('/', lang, source) AS path, arg_max(sha256(text), doc_id) AS id, arg_max(strlen(text), doc_id) AS size FROM documents GROUP BY 1")
def dirs_from_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(dirs.from_list(document_rows(spark, sf_dir)))


_LAYERS = """WITH l AS (SELECT concat_ws('/', lang, source) AS path, text, 0 AS layer, doc_id FROM documents
UNION ALL SELECT concat('en/src', page_id), html, 1, page_id FROM pages
UNION ALL SELECT concat('en/src', conv_id), text, 2, turn FROM conversations)"""


@query(_LAYERS + " SELECT path, arg_max(sha256(text), layer * 1000000000000 + doc_id) AS id, arg_max(strlen(text), layer * 1000000000000 + doc_id) AS size FROM l GROUP BY path")
def dirs_sum_right_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, turns = table(spark, sf_dir, "pages"), table(spark, sf_dir, "conversations")
    second = dirs.from_list(pages.select(F.col("page_id").alias("pos"), F.concat(F.lit("en/src"), "page_id").alias("path"), dirs.file_of_text(F.col("html")).alias("file")))
    third = dirs.from_list(turns.select(F.col("turn").alias("pos"), F.concat(F.lit("en/src"), "conv_id").alias("path"), dirs.file_of_text(F.col("text")).alias("file")))
    return names(dirs.sum_dirs(spark, [dirs.from_list(document_rows(spark, sf_dir)), second, third]))


@query(
    """SELECT source AS path, arg_max(sha256(text), doc_id) AS id, arg_max(strlen(text), doc_id) AS size FROM documents GROUP BY 1"""
)
def dirs_sum_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("layer"), F.col("source").alias("path"), dirs.file_of_text(F.col("text")).alias("file"))
    return names(dirs.sum_layers(rows, "layer"))


@query("SELECT url AS path, sha256(html) AS id, strlen(html) AS size FROM pages WHERE regexp_matches(url, '^https?://[^/]*\\.net/en/[0-9]*$') ORDER BY url LIMIT 1".replace("\\\\", "\\"))
def dirs_pick_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = pages_dir(spark, sf_dir).withColumn("path", F.regexp_replace("path", "^(https?)://", "$1/"))
    found = dirs.pick_row(plain, "http*/*.net/en/[0-9]*")
    return names(found.where(F.col("path").isNotNull()).withColumn("path", F.regexp_replace("path", "^(https?)/", "$1://")))


ORACLE_SQL["dirs_pick_glob"] = r"""SELECT regexp_replace(p, '^(https?)/', '\1://') AS path, sha256(html) AS id, strlen(html) AS size
FROM (SELECT regexp_replace(url, '^(https?)://', '\1/') AS p, html FROM pages) WHERE regexp_matches(p, '^http[^/]*/[^/]*\.net/en/[0-9][^/]*$') ORDER BY p LIMIT 1"""


@query("SELECT row_number() OVER (ORDER BY url) - 1 AS pos, sha256(html) AS id FROM pages")
def dirs_files_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirs.files(pages_dir(spark, sf_dir)).select("pos", F.col("file.id").alias("id"))


_CHANGED = """WITH a AS (SELECT concat('d/', doc_id) AS path, sha256(text) AS before FROM documents),
b AS (SELECT concat('d/', doc_id) AS path, sha256(CASE WHEN lang = 'en' THEN concat(text, '!') ELSE text END) AS after FROM documents WHERE lang <> 'fr' UNION ALL SELECT concat('p/', page_id), sha256(html) FROM pages)"""


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d/"), "doc_id")
    a = docs.select(path.alias("path"), dirs.file_of_text(F.col("text")).alias("file"))
    changed = F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    b = docs.where(F.col("lang") != "fr").select(path.alias("path"), dirs.file_of_text(changed).alias("file"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), "page_id").alias("path"), dirs.file_of_text(F.col("html")).alias("file"))
    return a, b.unionByName(pages)


@query(_CHANGED + " SELECT path, before, after, concat(coalesce(before, 'void'), ' -> ', coalesce(after, 'void')) AS change FROM a FULL JOIN b USING (path) WHERE before IS DISTINCT FROM after")
def dir_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirs.diff(*_two_versions(spark, sf_dir))


@query(_CHANGED + " SELECT NOT EXISTS (SELECT 1 FROM a FULL JOIN b USING (path) WHERE before IS DISTINCT FROM after) AS same, true AS self")
def dir_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_versions(spark, sf_dir)
    count = lambda x, y, n: dirs.diff(x, y).agg((F.count(F.lit(1)) == 0).alias(n))
    return count(a, b, "same").crossJoin(count(a, a, "self"))


@query("SELECT concat(conv_id, '/', role) AS path, arg_max(sha256(text), turn) AS id, arg_max(strlen(text), turn) AS size FROM conversations GROUP BY 1")
def pullup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.array(F.col("turn").cast("int")).alias("list_path"), F.concat_ws("/", "conv_id", "role").alias("path"), dirs.file_of_text(F.col("text")).alias("file"))
    return names(filesets.pullup(rows))


@query("SELECT CAST(0 AS INTEGER) AS elem, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS size FROM pages UNION ALL SELECT 1, count(*), CAST(sum(strlen(text)) AS BIGINT) FROM documents")
def flow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), dirs.file_of_text(F.col("text")).alias("file"))
    merged = flow.merge([filesets.of_dir(pages_dir(spark, sf_dir)), filesets.of_dir(docs)])
    return merged.groupBy(F.get("list_path", F.lit(0)).alias("elem")).agg(F.count(F.lit(1)).alias("n"), F.sum("file.size").alias("size"))


@query("SELECT sha256(text) AS digest, min(strlen(text)) AS size FROM documents GROUP BY 1")
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = filesets.of_dir(document_rows(spark, sf_dir).select("path", "file"))
    return filesets.distinct_files(fs).select("digest", F.col("file.size").alias("size"))


@query("SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS size FROM documents")
def fileset_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filesets.count(filesets.of_dir(document_rows(spark, sf_dir).select("path", "file")))


@query(
    """SELECT concat('d/', d.doc_id) AS path, CASE WHEN quality IS NOT NULL THEN sha256(text) END AS id, quality IS NOT NULL AS resolved
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)"""
)
def fileset_subst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    reference = dirs.file_struct(size=F.octet_length("text"), source=F.concat(F.lit("d/"), "doc_id"), etag=F.col("doc_id").cast("string"))
    refs = filesets.of_dir(docs.select(F.concat(F.lit("d/"), "doc_id").alias("path"), reference.alias("file")))
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select(collections.file_digest(reference).alias("digest"), dirs.file_of_text(F.col("text")).alias("file"))
    return filesets.substitute(refs, known).select("path", F.col("file.id").alias("id"), "resolved")


@query("SELECT concat('[', doc_id, ']') AS leaf FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fileset_any_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("leaf"))
    full = table(spark, sf_dir, "labels").select(F.array(F.col("doc_id").cast("int")).alias("list_path"), F.lit(".").alias("path"), dirs.file_struct(size=F.lit(1)).alias("file"))
    return filesets.any_empty(full, docs).select(F.concat(F.lit("["), "leaf", F.lit("]")).alias("leaf"))


@query("SELECT doc_id, sha256(text) AS id, strlen(text) AS size FROM documents")
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dirs.file_of_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", collections.file_digest(made).alias("id"), made["size"].alias("size"))


# --- comprehensions --------------------------------------------------------------


@query("SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase' AND value > 100")
def compr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Comprehension().over(table(spark, sf_dir, "events"), ["event_id"]).filter(F.col("event_type") == "purchase").filter(F.col("value") > 100)
    return c.of(user_id=F.col("user_id"), cents=cents("value"))


@query("SELECT r_name, n_name, r_regionkey = n_regionkey AS inside FROM region CROSS JOIN nation")
def compr_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Comprehension().over(table(spark, sf_dir, "region")).over(table(spark, sf_dir, "nation"))
    return c.of(r_name=F.col("r_name"), n_name=F.col("n_name"), inside=F.col("r_regionkey") == F.col("n_regionkey"))


@query(
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, strlen(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE strlen(line) > 40"""
)
def compr_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Comprehension().over(table(spark, sf_dir, "documents"), ["doc_id"]).each(strings.split(F.col("text"), "\n"), "line")
    c.filter(F.octet_length("line") > 40)
    return c.of(n=F.octet_length("line").cast("long")).withColumnRenamed("_pos1", "pos")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def compr_equijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Comprehension().over(table(spark, sf_dir, "orders"), ["o_orderkey"]).over(table(spark, sf_dir, "customer"))
    c.filter(F.col("o_custkey") == F.col("c_custkey")).filter(F.col("o_orderstatus") == "F")
    return c.of(c_name=F.col("c_name"), c_mktsegment=F.col("c_mktsegment"))


@query("SELECT vec_id, list_transform(list_filter(embedding, lambda x: x > 0.1), lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS big FROM embeddings")
def compr_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = list_comprehension(F.col("embedding"), lambda x: F.round(x.cast("double") * 1000).cast("long"), lambda x: x > F.lit(0.1).cast("float"))
    return table(spark, sf_dir, "embeddings").select("vec_id", big.alias("big"))


ORACLE_SQL["compr_in_row"] = "SELECT vec_id, list_transform(list_filter(embedding, lambda x: x > CAST(0.1 AS FLOAT)), lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS big FROM embeddings"


@query("SELECT n_nationkey, flatten(list_transform(string_split(n_name, 'A'), lambda x: list_transform(string_split(x, 'I'), lambda y: concat(x, '/', y)))) AS parts FROM nation")
def compr_nested_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = nested_comprehension(strings.split(F.col("n_name"), "A"), lambda x: strings.split(x, "I"), lambda x, y: F.concat(x, F.lit("/"), y))
    return table(spark, sf_dir, "nation").select("n_nationkey", parts.alias("parts"))


@query("SELECT conv_id, role AS key, arg_max(strlen(text), turn) AS n FROM conversations GROUP BY 1, 2")
def compr_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    rows = rows.select("conv_id", collections.map_of(F.transform("l", lambda x: F.struct(x["role"].alias("_1"), x["text"].alias("_2")))).alias("m"))
    return Comprehension().over(rows, ["conv_id"]).each_entry(F.col("m"), "k", "v").of(key=F.col("k"), n=F.octet_length("v").cast("long")).drop("_pos1")


# --- lists, maps, folds ----------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a list column of (turn, role, text)."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))


@query("SELECT conv_id, count(DISTINCT role) AS n, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY 1")
def map_from_list_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = collections.map_of(F.transform("l", lambda x: F.struct(x["role"].alias("_1"), x["text"].alias("_2"))))
    return _turns(spark, sf_dir).select("conv_id", m.alias("m")).select("conv_id", F.size("m").cast("long").alias("n"), F.try_element_at("m", F.lit("user")).alias("last_user"))


@query("SELECT c_custkey, CASE WHEN c_nationkey > 10 THEN 'right' ELSE 'left' END AS v, CAST(CASE WHEN c_nationkey > 10 THEN 2 ELSE 1 END AS BIGINT) AS n FROM customer")
def map_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.create_map(F.lit("a"), F.lit("left"))
    right = F.when(F.col("c_nationkey") > 10, F.create_map(F.lit("a"), F.lit("right"), F.lit("b"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    m = collections.merge_maps(left, right)
    return table(spark, sf_dir, "customer").select("c_custkey", collections.lookup(m, F.lit("a")).alias("v"), F.size(m).cast("long").alias("n"))


@query("SELECT n_nationkey, [concat('k=', n_name), concat('r=', n_regionkey)] AS pairs, map(['k'], [n_name]) = map(['k'], [n_name]) AS same FROM nation")
def map_entries_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.create_map(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("k"), F.col("n_name"))
    b = F.create_map(F.lit("k"), F.col("n_name"), F.lit("r"), F.col("n_regionkey").cast("string"))
    same = collections.equal(a, b, T.MapType(T.StringType(), T.StringType()))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.transform(collections.entries(a), lambda e: F.concat(e["_1"], F.lit("="), e["_2"])).alias("pairs"), same.alias("same"))


@query("SELECT vec_id, CAST(64 AS BIGINT) AS n, CAST(round(CAST(embedding[1] AS DOUBLE) * 1000000) AS BIGINT) AS first, CAST(round(CAST(embedding[64] AS DOUBLE) * 1000000) AS BIGINT) AS last FROM embeddings")
def zip_unzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = collections.zip_lists(F.col("embedding"), F.reverse("embedding"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", collections.unzip(pairs).alias("u"))
    micro = lambda c: F.round(c.cast("double") * 1_000_000).cast("long")
    return df.select("vec_id", F.size("u._1").cast("long").alias("n"), micro(collections.index(F.col("u._1"), F.lit(0))).alias("first"), micro(collections.index(F.col("u._2"), F.lit(0))).alias("last"))


@query("SELECT doc_id, flatten(list_transform(string_split(source, 'r'), lambda x: [x, lang])) AS parts FROM documents")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.transform(strings.split(F.col("source"), "r"), lambda x: F.array(x, F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", collections.flatten(nested).alias("parts"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT))) AS BIGINT) AS total FROM embeddings")
def fold_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", collections.fold(lambda a, x: a + F.round(x.cast("double") * 1000).cast("long"), F.col("embedding"), F.lit(0).cast("long")).alias("total"))


@query("SELECT vec_id, list_max(embedding) AS most FROM embeddings")
def reduce_first_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", collections.reduce(lambda a, x: F.greatest(a, x), F.col("embedding")).alias("most"))


@query("SELECT n_nationkey, range(0, n_nationkey) AS r FROM nation")
def range_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", collections.int_range(F.lit(0), F.col("n_nationkey")).alias("r"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN [10, 20, 30][n_nationkey + 1] ELSE -1 END AS x FROM nation")
def list_index_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = F.array(*[F.lit(x) for x in (10, 20, 30)])
    return table(spark, sf_dir, "nation").select("n_nationkey", arith.cond(F.col("n_nationkey") < 3, collections.index(xs, F.col("n_nationkey")), F.lit(-1)).alias("x"))


# --- arithmetic --------------------------------------------------------------------

_A, _B = "(CASE WHEN l_linenumber % 2 = 0 THEN -l_orderkey ELSE l_orderkey END)", "(CASE WHEN l_suppkey % 2 = 0 THEN -7 ELSE 7 END)"


@query(
    f"""SELECT a, b, n, CAST((a - (((a % abs(b)) + abs(b)) % abs(b))) // b AS BIGINT) AS q, CAST(((a % abs(b)) + abs(b)) % abs(b) AS BIGINT) AS r
FROM (SELECT {_A} AS a, CAST({_B} AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)"""
)
def euclid_divmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    b = F.when(F.col("l_suppkey") % 2 == 0, -7).otherwise(7).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("a", "b", "n", arith.int_div(F.col("a"), F.col("b")).alias("q"), arith.int_mod(F.col("a"), F.col("b")).alias("r"))


@query("SELECT o_orderkey, o_orderkey << 3 AS up, o_orderkey >> 2 AS down, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(trunc(-o_totalprice) AS BIGINT) AS minus, CAST(o_custkey AS DOUBLE) AS f FROM orders")
def shifts_and_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", arith.shift_left(k, F.lit(3)).alias("up"), arith.shift_right(k, F.lit(2)).alias("down"), arith.to_int(p).alias("whole"), arith.to_int(-p).alias("minus"), arith.to_float(F.col("o_custkey")).alias("f")
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'inf' ELSE 'finite' END AS kind, count(*) AS n, CAST(sum(CASE WHEN l_discount <> 0 THEN CAST(round(l_extendedprice / l_discount * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS hundredths FROM lineitem GROUP BY l_orderkey, l_linenumber, kind")
def float_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = arith.float_div(F.col("l_extendedprice"), F.col("l_discount"))
    finite = F.when(q < float("inf"), F.round(q * 100).cast("long")).otherwise(F.lit(0))
    kinds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", F.when(q == float("inf"), "inf").otherwise("finite").alias("kind"))
    return kinds.agg(F.count(F.lit(1)).alias("n"), F.sum(finite).cast("long").alias("hundredths"))


@query("SELECT c_custkey, c_nationkey > 0 AND 100 // greatest(c_nationkey, 1) > 10 AS a, c_nationkey = 0 OR 100 // greatest(c_nationkey, 1) > 10 AS o, NOT (c_acctbal < 0) AS n FROM customer")
def bool_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey").cast("long")
    large = arith.int_div(F.lit(100).cast("long"), k) > 10
    return table(spark, sf_dir, "customer").select("c_custkey", arith.both(k > 0, large).alias("a"), arith.either(k == 0, large).alias("o"), (~(F.col("c_acctbal") < 0)).alias("n"))


# --- strings, regular expressions, paths ----------------------------------------


@query("SELECT doc_id, strlen(text) AS n FROM documents")
def len_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", collections.length(F.col("text"), T.StringType()).alias("n"))


@query(
    """WITH RECURSIVE c(doc_id, part, rest, n) AS (
  SELECT doc_id, '', text, 0 FROM documents
  UNION ALL SELECT doc_id, substr(rest, 1, k), substr(rest, k + 1), n + 1
  FROM (SELECT *, list_max(list_filter(range(16, 65), lambda k: strlen(substr(rest, 1, k)) <= 64)) AS k FROM c WHERE rest <> ''))
SELECT doc_id, CAST(max(n) AS INTEGER) AS n, CAST(coalesce(max(CASE WHEN n > 0 THEN strlen(part) END), 0) AS INTEGER) AS most, sha256(string_agg(CASE WHEN n > 0 THEN sha256(part) ELSE '' END, '' ORDER BY n)) AS id FROM c GROUP BY doc_id"""
)
def string_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", strings.chunk(F.col("text"), 64).alias("c"))
    return rows.select("doc_id", F.size("c").alias("n"), F.coalesce(F.array_max(F.transform("c", lambda x: F.octet_length(x))), F.lit(0)).alias("most"), F.sha2(F.array_join(F.transform("c", lambda x: F.sha2(x.cast("binary"), 256)), "").cast("binary"), 256).alias("id"))


@query("SELECT page_id, string_split(url, '.') AS parts, string_split(url, '.')[1] AS head FROM pages")
def string_split_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = strings.split(F.col("url"), ".")
    return table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"), collections.index(parts, F.lit(0)).alias("head"))


@query("SELECT doc_id, list_sort(string_split(text, ' ')) AS sorted FROM documents")
def string_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strings.sort(strings.split(F.col("text"), " ")).alias("sorted"))


@query("SELECT page_id, array_to_string(string_split(url, '/'), '|') AS joined, starts_with(url, 'https') AS secure, ends_with(url, '#top') AS top, CAST(page_id AS VARCHAR) AS id_text FROM pages")
def string_join_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", strings.join(strings.split(url, "/"), "|").alias("joined"), strings.has_prefix(url, "https").alias("secure"), strings.has_suffix(url, "#top").alias("top"), strings.from_int(F.col("page_id")).alias("id_text")
    )


@query("SELECT event_id, value FROM events")
def string_float_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", strings.to_float(strings.from_float(F.col("value"), 17)).alias("value"))


@query("SELECT doc_id, regexp_matches(text, '[[:alpha:]]+ing[.,]') AS m FROM documents")
def regexp_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", regexps.matches(F.col("text"), "[[:alpha:]]+ing[.,]").alias("m"))


@query(r"SELECT page_id, regexp_replace(url, '([a-z]+)\.example\.([a-z]+)', '\2-\1', 'g') AS u FROM pages")
def regexp_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", regexps.replace(F.col("url"), r"([a-z]+)\.example\.([a-z]+)", "${2}-$1").alias("u"))


@query(r"SELECT page_id, [regexp_extract(url, '^([a-z]+)://([^/]+)/(.*)$', 1), regexp_extract(url, '^([a-z]+)://([^/]+)/(.*)$', 2), regexp_extract(url, '^([a-z]+)://([^/]+)/(.*)$', 3)] AS g FROM pages")
def regexp_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", regexps.groups(F.col("url"), "^([a-z]+)://([^/]+)/(.*)$").alias("g"))


@query(
    r"""SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '(\.[^./]*)$', 1) AS ext,
NOT ends_with(url, '/') AS round_trip FROM pages"""
)
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    joined = paths.join(F.array(paths.dirname(u), F.lit(""), paths.base(u)))
    return table(spark, sf_dir, "pages").select("page_id", paths.base(u).alias("base"), paths.dirname(u).alias("dir"), paths.ext(u).alias("ext"), (joined == u).alias("round_trip"))


# --- variants, patterns, types ----------------------------------------------------

_EVENT = T.StructType([T.StructField("tag", T.StringType()), T.StructField("Paid", T.DoubleType()), T.StructField("Named", T.StringType())])
_EVENT_TYPE = K.Sum.of(Paid=K.FLOAT, Named=K.STRING, Nothing=None)


def _as_sum():
    kind = F.col("event_type")
    return F.when(kind == "purchase", collections.variant("Paid", F.col("value"), _EVENT)).when(kind == "view", collections.variant("Nothing", None, _EVENT)).otherwise(collections.variant("Named", kind, _EVENT))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) WHEN event_type = 'view' THEN -1 ELSE length(event_type) END AS x FROM events")
def switch_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    P = patterns
    cases = [
        (P.VariantPat("Paid", P.Ident("v")), lambda e: F.round(e["v"] * 100).cast("long")),
        (P.VariantPat("Nothing"), lambda e: F.lit(-1).cast("long")),
        (P.VariantPat("Named", P.Ident("s")), lambda e: F.length(e["s"]).cast("long")),
    ]
    rows = table(spark, sf_dir, "events").select("event_id", _as_sum().alias("e"))
    return rows.select("event_id", P.switch(F.col("e"), _EVENT, cases, _EVENT_TYPE).alias("x"))


@query("SELECT conv_id, CASE WHEN count(*) = 1 THEN 'one' WHEN count(*) >= 2 THEN concat(arg_min(role, turn), '+', count(*) - 1) ELSE 'none' END AS shape FROM conversations GROUP BY 1")
def switch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    P = patterns
    turn = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    role = P.StructPat((("role", P.Ident("r")),))
    cases = [
        (P.ListPat(()), lambda e: F.lit("none")),
        (P.ListPat((P.Ignore(),)), lambda e: F.lit("one")),
        (P.ListPat((role,), P.Ident("rest")), lambda e: F.concat(e["r"], F.lit("+"), F.size(e["rest"]).cast("string"))),
    ]
    kind = K.List(K.Struct.of(turn=K.INT, role=K.STRING, text=K.STRING))
    return _turns(spark, sf_dir).select("conv_id", P.switch(F.col("l"), T.ArrayType(turn), cases, kind).alias("shape"))


@query("SELECT 'customer' AS origin, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def struct_subtype_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of two record types has the fields that they share."""
    a = K.Struct.of(key=K.INT, name=K.STRING, segment=K.STRING, origin=K.STRING)
    b = K.Struct.of(key=K.INT, name=K.STRING, balance=K.FLOAT, origin=K.STRING)
    shared = [n for n, _ in K.unify(a, b).fields]
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.select(*shared).unionByName(s.select(*shared))


@query("SELECT c_custkey, c_name AS name FROM customer")
def struct_ascribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType())])
    want = T.StructType([T.StructField("name", T.StringType())])
    record = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return table(spark, sf_dir, "customer").select("c_custkey", collections.ascribe(record, have, want)["name"].alias("name"))


@query("SELECT n_nationkey, true AS same, false AS changed FROM nation")
def value_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.MapType(T.StringType(), T.StringType())
    a = F.create_map(F.lit("k"), F.col("n_name"), F.lit("r"), F.col("n_regionkey").cast("string"))
    b = F.create_map(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("k"), F.col("n_name"))
    c = F.create_map(F.lit("r"), F.col("n_name"), F.lit("k"), F.col("n_regionkey").cast("string"))
    d = lambda x: digests.column_digest(x, m)
    return table(spark, sf_dir, "nation").select("n_nationkey", (d(a) == d(b)).alias("same"), (d(a) == d(c)).alias("changed"))


@query("SELECT o_orderstatus, true AS ok, count(*) AS n FROM orders GROUP BY 1")
def assert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = checks.all_hold(F.array(F.col("o_totalprice") >= 0, F.col("o_custkey").isNotNull()))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min(good).alias("ok"), F.count(F.lit(1)).alias("n"))


# --- lineage facts, cache, garbage -----------------------------------------------


def _facts(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat_ws("/", "lang", "source").alias("subject"), F.lit("doc").alias("namespace"), F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("size"), F.octet_length("text").cast("string"))).alias("property", "value"))


_FACTS = "f AS (SELECT concat_ws('/', lang, source) AS subject, 'doc' AS namespace, 'lang' AS property, lang AS value FROM documents UNION ALL SELECT concat_ws('/', lang, source), 'doc', 'size', CAST(strlen(text) AS VARCHAR) FROM documents)"


@query(f"WITH {_FACTS} SELECT subject, namespace, property, list_sort(list(DISTINCT value)) AS values FROM f GROUP BY ALL HAVING count(DISTINCT value) > 1".replace("GROUP BY ALL", "GROUP BY subject, namespace, property"))
def assertions_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assertions.conflicts(_facts(table(spark, sf_dir, "documents")))


@query(f"WITH {_FACTS} SELECT DISTINCT subject, namespace, property, value FROM f WHERE subject IN (SELECT concat('en/src', page_id) FROM pages)")
def assertions_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "pages").select(F.concat(F.lit("en/src"), "page_id").alias("subject"), F.lit("doc").alias("namespace"))
    have, _ = assertions.subset(assertions.distinct(_facts(table(spark, sf_dir, "documents"))), wanted)
    return have


@query(
    """WITH a AS (SELECT doc_id, lang FROM documents), b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE lang END AS lang FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS subject, 'doc' AS namespace, 'lang' AS property, a.lang AS before, b.lang AS after FROM a FULL JOIN b USING (doc_id) WHERE a.lang IS DISTINCT FROM b.lang"""
)
def assertions_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fact = lambda d, v: d.select(F.col("doc_id").cast("string").alias("subject"), F.lit("doc").alias("namespace"), F.lit("lang").alias("property"), v.alias("value"))
    return assertions.diff(fact(docs, F.col("lang")), fact(docs.join(toxic, "doc_id"), F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("lang"))))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS subject, lang AS value FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) WHERE toxic = 1"""
)
def assertions_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    fact = lambda v: docs.select(F.col("doc_id").cast("string").alias("subject"), F.lit("doc").alias("namespace"), F.lit("lang").alias("property"), v.alias("value"))
    now = F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("lang"))
    return assertions.stale(fact(F.col("lang")), fact(now)).select("subject", "value")


@query("SELECT doc_id, sha256(text) AS key, quality IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def cache_lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All wanted keys against the cache index in one join."""
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    index = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("value"))
    return wanted.join(index, "doc_id", "left").select("doc_id", "key", F.col("value").isNotNull().alias("hit"))


@query("SELECT sha256(text) AS value, count(*) AS n FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def gc_live_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that nothing live refers to: an exact anti-join."""
    from .sources.store import sweep

    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("value"))
    live = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select(F.col("value").alias("digest"))
    return sweep(docs, live).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# --- run and task metadata ----------------------------------------------------------


def tasks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks: a user is a run, the type the ident, the value seconds of run time; every third is still alive."""
    e = table(spark, sf_dir, "events")
    start = F.col("ts").cast("timestamp")
    later = lambda s: F.timestamp_micros(F.unix_micros(start) + s)
    took = F.round(F.col("value") * 1_000_000).cast("long")
    return e.select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat(F.lit("a"), (F.col("event_id") % 10).cast("string")).alias("alloc_id"),
        F.sha2(F.col("event_type"), 256).alias("img_cmd_id"),
        F.col("event_type").alias("ident"),
        F.when(F.col("event_type") == "error", "failed").alias("err"),
        start.alias("start"),
        later(took + 60_000_000).alias("keepalive"),
        F.when(F.col("event_id") % 3 != 0, later(took)).alias("end"),
        F.col("value").alias("seconds"),
        (F.col("value") * 1000).cast("long").alias("mem"),
        cents("value").alias("cents"),
    )


@query("SELECT event_type AS ident, count(*) AS n, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_cached, min(CASE WHEN event_id % 5 <> 0 THEN value END) AS min_runtime, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS mean_runtime, max(CASE WHEN event_id % 5 <> 0 THEN value END) AS max_runtime FROM events GROUP BY 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("ident"), (F.col("event_id") % 5 == 0).alias("cached"), F.col("value").alias("runtime"))
    return metadata.summary(steps, ("runtime",)).withColumn("mean_runtime", F.round("mean_runtime", 6))


@query(
    """SELECT event_type AS ident, CAST(avg(value) * 1000000 AS BIGINT) // 1000000 AS mean FROM events GROUP BY 1 HAVING avg(value) / 100 <= 0.6""".replace("CAST(avg(value) * 1000000 AS BIGINT) // 1000000", "CAST(floor(avg(value)) AS BIGINT)")
)
def over_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    mib = 1 << 20
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ident")).agg((F.avg("value") * 10 * mib).alias("mean_mem"), F.avg("value").alias("m")).withColumn("requested_mem", F.lit(1000 * mib))
    return metadata.over_allocated(s).select("ident", F.floor("m").cast("long").alias("mean"))


# With those at which a fraction of hundredths is not exact.
_PERCENTS = (0, 7, 14, 25, 28, 50, 55, 56, 95, 100)
_RANK = "list_sort(list(value))[CAST(greatest(ceil(count(*) * {p} / 100.0), 1) AS BIGINT)]"


@query("SELECT event_type AS ident, " + ", ".join(f"{_RANK.format(p=p)} AS p{p}" for p in _PERCENTS) + " FROM events GROUP BY 1")
def pct_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("ident"), "value")
    return metadata.percentiles(rows, "ident", "value", {f"p{p}": p for p in _PERCENTS})


_TASKS = """t AS (SELECT concat('t', event_id) AS id, concat('r', user_id) AS run_id, event_type AS ident, CASE WHEN event_type = 'error' THEN 'failed' END AS err, value AS seconds, CAST(round(value * 100) AS BIGINT) AS cents,
CAST(round(value * 1000000) AS BIGINT) AS took, epoch_us(ts) AS s, event_id FROM events),
k AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN s + took END AS e, s + took + 60000000 AS ka FROM t)"""


@query(f"WITH {_TASKS} SELECT ident, id, seconds FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY e DESC, id) AS r FROM k WHERE e IS NOT NULL) WHERE r <= 5")
def newest_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.newest(tasks_of(spark, sf_dir), 5, "ident").select("ident", "id", "seconds")


@query(f"WITH {_TASKS} SELECT id, coalesce(e, ka) - s AS micros FROM k")
def interval_end_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.with_interval(tasks_of(spark, sf_dir)).select("id", (F.unix_micros("until") - F.unix_micros("start")).alias("micros"))


_COSTS = "CASE WHEN event_type = 'view' THEN 'unknown' WHEN event_type = 'error' THEN 'upper' ELSE 'exact' END"


@query(
    f"""SELECT user_id, CAST(sum(CASE WHEN kind <> 'unknown' THEN round(value * 100) ELSE 0 END) AS BIGINT) AS cents, CASE WHEN bool_or(kind = 'upper') THEN 'upper' WHEN bool_or(kind = 'exact') THEN 'exact' ELSE 'unknown' END AS cost_kind
FROM (SELECT user_id, value, {_COSTS} AS kind FROM events) GROUP BY 1"""
)
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "unknown").when(F.col("event_type") == "error", "upper").otherwise("exact")
    total, of = metadata.sum_cost("cost", "kind")
    rows = table(spark, sf_dir, "events").select("user_id", cents("value").cast("double").alias("cost"), kind.alias("kind"))
    return rows.groupBy("user_id").agg(total.cast("long").alias("cents"), of.alias("cost_kind"))


@query(f"WITH {_TASKS} SELECT id, run_id, seconds FROM k WHERE ident = 'purchase'")
def tasks_by_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.tasks(tasks_of(spark, sf_dir), metadata.TaskQuery(ident="purchase")).select("id", "run_id", "seconds")


@query(f"WITH {_TASKS} SELECT id, ident FROM k WHERE ka > epoch_us(TIMESTAMP '2024-01-02 00:00:00') AND ka < epoch_us(TIMESTAMP '2024-01-05 12:00:00')")
def tasks_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    q = metadata.TaskQuery(since=datetime(2024, 1, 2), until=datetime(2024, 1, 5, 12))
    return metadata.tasks(tasks_of(spark, sf_dir), q).select("id", "ident")


@query(f"WITH {_TASKS} SELECT id, run_id, concat('a', event_id % 10) AS alloc, concat('p', (event_id % 10) // 5) AS pool FROM k WHERE run_id = 'r8'")
def tasks_with_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    allocs = spark.range(10).select(F.concat(F.lit("a"), "id").alias("id"), F.concat(F.lit("p"), F.floor(F.col("id") / 5)).alias("pool_id"))
    pools = spark.range(2).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("c").alias("cluster_name"))
    found = metadata.tasks(tasks_of(spark, sf_dir), metadata.TaskQuery(run_id="r8", with_alloc=True), allocs, pools)
    return found.select(F.col("id"), "run_id", F.col("alloc.id").alias("alloc"), F.col("pool.id").alias("pool"))


@query(
    f"""WITH {_TASKS}, r AS (SELECT concat('r', c_custkey) AS id, c_name AS user FROM customer),
p AS (SELECT run_id, count(*) AS n_tasks, CAST(sum(CASE WHEN err IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(cents) AS BIGINT) AS cents FROM k GROUP BY 1)
SELECT id, "user", coalesce(n_tasks, 0) AS n_tasks, coalesce(n_failed, 0) AS n_failed, coalesce(cents, 0) AS cents, CASE WHEN n_tasks IS NULL THEN 'unknown' ELSE 'exact' END AS cost_kind FROM r LEFT JOIN p ON id = run_id"""
)
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("id"), F.col("c_name").alias("user"), F.lit(None).cast("timestamp").alias("start"))
    tasks = tasks_of(spark, sf_dir).withColumns({"cost": F.col("cents").cast("double"), "cost_kind": F.lit("exact")})
    return metadata.list_runs(runs, tasks).select("id", "user", "n_tasks", "n_failed", F.col("cost").cast("long").alias("cents"), "cost_kind")


@query(
    f"""WITH {_TASKS}, n AS (SELECT ident, seconds, CAST(trunc(seconds * 1000) AS BIGINT) AS mem, row_number() OVER (PARTITION BY ident ORDER BY e DESC, id) AS r FROM k WHERE e IS NOT NULL),
m AS (SELECT ident, list_sort(list(mem)) AS l, count(*) AS c, max(seconds) AS s FROM n WHERE r <= 50 GROUP BY 1)
SELECT ident, CAST(l[CAST(ceil(c * 95 / 100.0) AS BIGINT)] AS DOUBLE) AS mem, s AS seconds, c AS n FROM m WHERE c >= 5"""
)
def predict_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.Predictor().model(tasks_of(spark, sf_dir), "ident")


@query(
    """SELECT doc_id FROM documents WHERE (regexp_matches('lang=' || lang, '^lang=en$') AND NOT regexp_matches('source=' || source, '^source=src1')) OR regexp_matches('lang=' || lang, '^lang=d')"""
)
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("labels"))
    return docs.where(metadata.label_filter("^lang=en$,!^source=src1 ^lang=d")).select("doc_id")


@query("SELECT l_returnflag, r AS resource, CAST(sum(v) AS BIGINT) AS total, CAST(min(v) AS BIGINT) AS least, CAST(max(v) AS BIGINT) AS most FROM (SELECT l_returnflag, 'cpu' AS r, l_linenumber AS v FROM lineitem UNION ALL SELECT l_returnflag, 'mem', l_quantity FROM lineitem) GROUP BY 1, 2")
def resource_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.create_map(F.lit("cpu"), F.col("l_linenumber").cast("double"), F.lit("mem"), F.col("l_quantity")).alias("resources"))
    return totals(rows, "resources", "l_returnflag").withColumns({c: F.col(c).cast("long") for c in ("total", "least", "most")})


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def exec_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python transform in place of a container: batches in, batches out."""

    def step(batches):
        for b in batches:
            yield b[["lang"]]

    out = flow.exec_pandas(table(spark, sf_dir, "documents").select("lang"), step, "lang string")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('doc ', doc_id) AS id, CAST(doc_id AS BIGINT) AS n FROM documents")
def coerce_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("n"))
    return flow.coerce(df, "n", "bigint")


@query("SELECT concat('t', event_id) AS id, event_type AS ident FROM events WHERE concat('t', event_id) LIKE 't12%'")
def tasks_by_short_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.tasks(tasks_of(spark, sf_dir), metadata.TaskQuery(id="t12")).select("id", "ident")


@query("SELECT concat('r', c_custkey) AS id FROM customer WHERE c_mktsegment = 'MACHINERY'")
def runs_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("user"))
    return metadata.runs(rows, user="MACHINERY").select("id")


@query("SELECT concat('p', s_suppkey) AS id FROM supplier WHERE s_nationkey = 7")
def pools_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("id"), F.concat(F.lit("c"), "s_nationkey").alias("cluster_name"))
    return metadata.pools(rows, cluster={"name": "c7"}).select("id")


@query("SELECT sha256(event_type) AS img_cmd_id, count(*) AS n_tasks, count(DISTINCT user_id) AS n_runs FROM events GROUP BY 1")
def images_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.images(tasks_of(spark, sf_dir)).drop("last")


@query("SELECT event_type AS type, CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE CASE WHEN event_id % 3 <> 0 THEN round(value * 1000000) ELSE round(value * 1000000) + 60000000 END END) AS BIGINT) AS micros FROM events GROUP BY 1")
def hourly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a price of 3.6e9 an hour the cost is the time in microseconds; a type without a price costs nothing that is known."""
    prices = spark.createDataFrame([(t, 3.6e9) for t in ("click", "error", "signup", "purchase")], "type string, price double")
    priced = metadata.hourly_cost(tasks_of(spark, sf_dir).withColumn("type", F.col("ident")), prices)
    return priced.groupBy("type").agg(F.sum(F.round("cost")).cast("long").alias("micros"))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS digest, 'part' AS property, CAST(l_partkey AS VARCHAR) AS value FROM lineitem UNION SELECT CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus FROM orders")
def assertions_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order has its own facts and those of the parts in it."""
    text = lambda c: F.col(c).cast("string")
    own = table(spark, sf_dir, "orders").select(text("o_orderkey").alias("digest"), F.lit("o").alias("subject"), F.lit("n").alias("namespace"), F.lit("status").alias("property"), F.col("o_orderstatus").alias("value"))
    lineage = table(spark, sf_dir, "lineitem").select(text("l_orderkey").alias("digest"), text("l_partkey").alias("input"))
    parts = table(spark, sf_dir, "part").select(text("p_partkey").alias("input"), text("p_partkey").alias("subject"), F.lit("n").alias("namespace"), F.lit("part").alias("property"), text("p_partkey").alias("value"))
    return assertions.propagate(own, lineage, parts).select("digest", "property", "value")


@query("SELECT source AS path, arg_max(sha256(text), doc_id) AS id FROM documents GROUP BY 1")
def dirs_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map column of path to file for each language, then a directory again."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by(dirs.file_of_text(F.col("text")), "doc_id").alias("file"))
    maps = rows.select(F.create_map("source", "file").alias("m"))
    return names(dirs.make(maps, "m")).drop("size")


@query("SELECT array_to_string([CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)], '/') AS leaf, strlen(text) AS size FROM conversations")
def fileset_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.array(F.col("conv_id").cast("int"), F.col("turn").cast("int")).alias("list_path"), F.col("role").alias("path"), dirs.file_of_text(F.col("text")).alias("file"))
    return filesets.flatten(rows).select("leaf", F.col("file.size").alias("size"))


@query("SELECT event_type, count(*) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS cents, 1 AS cached FROM events WHERE value > 1 GROUP BY 1")
def memo_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph evaluated twice; the second time its root comes from the cache and nothing below it runs."""
    from .plans.memo import Evaluator, Node, intern_node
    from .sources.io import work_folder

    folder = work_folder(spark, "memo")

    def graph() -> Node:
        source = intern_node(spark, lambda: table(spark, sf_dir, "events").select("event_type", "value"), f"{sf_dir}/events.parquet")
        kept = Node("filter", lambda d: d.where(F.col("value") > 1), (source,), params=["value", 1], ident="kept")
        return Node("total", lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("value")).alias("cents")), (kept,), ident="total")

    Evaluator(spark, folder).evaluate(graph())
    again = Evaluator(spark, folder)
    return again.evaluate(graph()).withColumn("cached", F.lit(again.stats["total"]["cached"]))


# --- extensions ----------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"), "6 hours", "event_type").select("start", "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "30 minutes", "user_id")


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(round(l_quantity) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM lineitem")
def ext_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.round("l_quantity").cast("long")).over(w).alias("running"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count(F.lit(1)).alias("n"))


# These register their queries beside the ones above.
from . import queries_language, queries_sources  # noqa: E402, F401
