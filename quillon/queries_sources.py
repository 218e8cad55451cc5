"""Registered queries of sources, sinks, stores and the memoizing layer, and their SQL.

Each goes the whole way: what it writes to a work folder it reads back by the operator it is
named for, and the SQL says what has to come of the tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assertions, dirs, filesets, flow
from .plans import batch
from .plans.memo import Evaluator, MemoConfig, Mode, Node, Strategy, content_digest, content_marks, intern_node, repeat_and_check, snapshot_digest
from .queries import cents, document_rows, pages_dir, query, table
from .sources import io
from .sources.store import Index, Repository, sweep
from .sources.taskdb import TaskDB

FILES = "SELECT n_nationkey, sha256(concat(n_name, chr(10))) AS id, CAST(strlen(n_name) + 1 AS BIGINT) AS size FROM nation"


def key():
    """The nation of a file."""
    return F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).try_cast("int").alias("n_nationkey")


def nation_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each nation, which holds its name."""
    url = io.work_folder(spark, "nations")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(url)
    return url


# --- sources and sinks ------------------------------------------------------------


@query(FILES)
def intern_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.intern_dir(spark, nation_files(spark, sf_dir)).select(key(), "file.id", "file.size")


@query(f"SELECT id, size FROM ({FILES}) WHERE n_nationkey = 3")
def intern_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.intern_file(spark, nation_files(spark, sf_dir) + "/n_nationkey=3").select("file.id", "file.size")


@query(f"SELECT 'all' AS part, n_nationkey, id FROM ({FILES}) UNION ALL SELECT 'one', 7, id FROM ({FILES}) WHERE n_nationkey = 7")
def intern_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several URLs with names, as one directory."""
    url = nation_files(spark, sf_dir)
    rows = io.intern_many(spark, f"all={url},one={url}/n_nationkey=7")
    part = F.element_at(F.split("path", "/"), 1)
    return rows.select(part.alias("part"), F.when(part == "one", 7).otherwise(key()).alias("n_nationkey"), "file.id")


@query(f"SELECT 0 AS elem, id FROM ({FILES}) WHERE n_nationkey = 5 UNION ALL SELECT 1, id FROM ({FILES}) WHERE n_nationkey = 9")
def intern_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = nation_files(spark, sf_dir)
    rows = flow.intern_list(spark, [f"a={url}/n_nationkey=5", f"b={url}/n_nationkey=9"])
    return rows.select(F.get("list_path", F.lit(0)).alias("elem"), "file.id")


@query(f"SELECT n_nationkey, size, TRUE AS reference, TRUE AS told FROM ({FILES})")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References: sizes and etags without a content."""
    rows = io.snapshot(spark, nation_files(spark, sf_dir))
    return rows.select(key(), "file.size", F.col("file.id").isNull().alias("reference"), F.col("file.etag").isNotNull().alias("told"))


@query("SELECT count(*) AS n, TRUE AS same, FALSE AS other FROM nation")
def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot has one digest in any order, and another where a file is missing."""
    rows = io.snapshot(spark, nation_files(spark, sf_dir))
    d = snapshot_digest(rows)
    less = snapshot_digest(rows.where(key() != 3))
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumns({"same": F.lit(d == snapshot_digest(rows.repartition(3))), "other": F.lit(d == less)})


@query(FILES)
def dirs_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, to = nation_files(spark, sf_dir), io.work_folder(spark, "copy")
    io.copy_dir(spark, url, to)
    return io.intern_dir(spark, to).select(key(), "file.id", "file.size")


@query(f"SELECT id, size FROM ({FILES}) WHERE n_nationkey = 11")
def files_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, to = nation_files(spark, sf_dir), io.work_folder(spark, "copy") + "/n"
    one = io.snapshot(spark, url + "/n_nationkey=11").first()["file"]["source"]
    io.copy_file(spark, one, to)
    return io.intern_file(spark, to).select("file.id", "file.size")


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1")
def extern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written from its tasks and read again."""
    to = io.work_folder(spark, "extern")
    io.extern(table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice"), to)
    return spark.read.parquet(to).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("cents"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def batch_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of runs as CSV: the first column names the run."""
    to = io.work_folder(spark, "runs")
    io.write_batch(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), to)
    return io.read_batch(spark, to)


@query("SELECT CAST(n_regionkey AS VARCHAR) AS id, 'done' AS phase, CAST(1 AS INTEGER) AS tries FROM (SELECT DISTINCT n_regionkey FROM nation)")
def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a batch, whose states are kept: the second time all are done and none starts."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("id")).distinct()
    b = batch.Batch(spark, io.work_folder(spark, "batch"), "program", lambda row: int(row["id"]))
    b.run(rows)
    again = b.run(rows)
    return again.select("id", "phase", "tries")


_NESTED = "SELECT conv_id AS elem, role AS path, sha256(text) AS id, strlen(text) AS size FROM conversations"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.array(F.col("conv_id").cast("int"), F.col("turn").cast("int")).alias("list_path"), F.col("role").alias("path"), dirs.file_of_text(F.col("text")).alias("file"))


def named(fs: DataFrame) -> DataFrame:
    return fs.select(F.get("list_path", F.lit(0)).cast("long").alias("elem"), "path", "file.id", "file.size")


@query(_NESTED)
def fileset_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = io.work_folder(spark, "parts")
    filesets.write_parts(nested(spark, sf_dir), to)
    return named(filesets.read_parts(spark, to))


@query(_NESTED)
def fileset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(filesets.from_json(filesets.to_json(nested(spark, sf_dir))))


@query("SELECT page_id, sha256(html) AS id, strlen(html) AS size FROM pages")
def files_fileset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single files as file sets, and back."""
    out = table(spark, sf_dir, "pages").select("page_id", dirs.file_of_text(F.col("html")).alias("file"))
    fs = filesets.to_file(filesets.of_file(out))
    return fs.join(out.withColumnRenamed("file", "own"), F.col("file.id") == F.col("own.id")).select("page_id", "file.id", "file.size")


@query("SELECT url AS path, sha256(html) AS id FROM pages")
def filesets_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filesets.to_dir(filesets.of_dir(pages_dir(spark, sf_dir))).select("path", "file.id")


@query("SELECT '.' AS path, sha256('inline') AS id, CAST(6 AS BIGINT) AS size")
def flow_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filesets.data(spark, b"inline").select("path", "file.id", "file.size")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text) END AS before, CASE WHEN doc_id % 7 <> 0 OR doc_id % 2 = 0 THEN sha256(CASE WHEN doc_id % 7 = 0 THEN lang ELSE text END) END AS after FROM documents WHERE doc_id % 7 = 0")
def filesets_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every seventh document are changed, or gone where its number is odd."""
    docs = table(spark, sf_dir, "documents")
    fs = lambda d, text: d.select(F.array().cast("array<int>").alias("list_path"), F.col("doc_id").cast("string").alias("path"), dirs.file_of_text(text).alias("file"))
    seventh = F.col("doc_id") % 7 == 0
    b = fs(docs.where(~seventh | (F.col("doc_id") % 2 == 0)), F.when(seventh, F.col("lang")).otherwise(F.col("text")))
    return filesets.diff(fs(docs, F.col("text")), b).select(F.col("path").cast("long").alias("doc_id"), "before", "after")


# --- stores -----------------------------------------------------------------------


@query("SELECT sha256(text) AS digest, min(strlen(text)) AS size, count(*) AS n FROM documents GROUP BY 1")
def repository_put_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents stored once each, though put twice; sizes by digest."""
    repo, docs = Repository(spark, io.work_folder(spark, "objects")), table(spark, sf_dir, "documents")
    repo.put(docs.where("doc_id % 2 = 0"), "text")
    put = repo.put(docs, "text")
    wanted = put.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return repo.stat(wanted).select("digest", "size", "n")


@query("SELECT doc_id, sha256(text) AS digest, doc_id % 3 = 0 OR sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS there, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) THEN strlen(text) END AS size FROM documents")
def repository_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents by digest, copied from one repository to another; null where there is none."""
    a, b = Repository(spark, io.work_folder(spark, "a")), Repository(spark, io.work_folder(spark, "b"))
    docs = table(spark, sf_dir, "documents")
    third = a.put(docs.where("doc_id % 3 = 0"), "text")
    a.write_to(b, third.select("digest").distinct())
    wanted = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return b.read(wanted).select("doc_id", "digest", F.col("content").isNotNull().alias("there"), F.octet_length("content").cast("long").alias("size"))


@query("WITH d AS (SELECT DISTINCT sha256(text) AS digest FROM documents), l AS (SELECT DISTINCT sha256(text) AS digest FROM documents JOIN labels USING (doc_id)) SELECT digest, (SELECT count(*) FROM d) - (SELECT count(*) FROM l) AS gone FROM l")
def repository_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a repository when all that no label speaks of has been collected."""
    repo, docs = Repository(spark, io.work_folder(spark, "objects")), table(spark, sf_dir, "documents")
    repo.put(docs, "text")
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    gone = repo.collect(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(digest))
    return repo.stat(docs.select(digest).distinct()).select("digest", F.lit(gone).cast("long").alias("gone"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").cast("string").alias("value"))
    return labels.select(F.lit("label").alias("kind"), F.col("doc_id").cast("string").alias("key"), "value")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 <> 1 THEN CAST(quality AS VARCHAR) END AS value FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def index_batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All wanted keys against an index in which some keys were written twice and others deleted."""
    index, docs = Index(spark, io.work_folder(spark, "index")), table(spark, sf_dir, "documents")
    key = docs.select(F.lit("label").alias("kind"), F.col("doc_id").cast("string").alias("key"))
    index.put(_labelled(spark, sf_dir))
    index.put(key.where("key % 5 = 0").withColumn("value", F.lit("new")))
    index.delete(key.where("key % 5 = 1"))
    return index.batch_get(key).select(F.col("key").cast("long").alias("doc_id"), "value")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CAST(min(quality) AS VARCHAR) AS value, 3 AS files FROM labels WHERE doc_id % 2 = 0 GROUP BY 1")
def index_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of three writes becomes one; what counts stays."""
    index, rows = Index(spark, io.work_folder(spark, "index")), _labelled(spark, sf_dir).coalesce(1)
    index.put(rows.withColumn("value", F.lit("old")))
    index.put(rows)
    index.delete(rows.where("key % 2 = 1"))
    files = index.compact()
    return index.scan("label").select("key", "value", F.lit(files).alias("files"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key FROM labels GROUP BY doc_id HAVING doc_id % 2 = 0 AND doc_id % 3 <> 0")
def gc_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows to sweep: written before a time, not live, and listed as dead."""
    index, rows = Index(spark, io.work_folder(spark, "index")), _labelled(spark, sf_dir).withColumn("value", F.col("key"))
    index.put(rows.where("key % 2 = 0"))
    before = index.scan().agg(F.max("time")).first()[0] + timedelta(microseconds=1)
    index.put(rows.where("key % 2 = 1"))
    keys = rows.select(F.col("key").alias("digest"))
    return sweep(index.scan(), keys.where("digest % 3 = 0"), keys, before).select("key")


@query("SELECT concat('run', r_regionkey) AS id, r_name AS user, r_regionkey % 2 = 0 AS ended, CASE WHEN r_regionkey % 2 = 0 THEN 'log' END AS exec_log FROM region")
def taskdb_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as they now are, from a log of what was set when."""
    db = TaskDB(spark, io.work_folder(spark, "taskdb"))
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # a run for each region
        db.create_run(f"run{r['r_regionkey']}", r["r_name"])
        db.keep_alive("run", f"run{r['r_regionkey']}")
        if r["r_regionkey"] % 2 == 0:
            db.set_run_complete(f"run{r['r_regionkey']}", exec_log="log")
    day = datetime.now() - timedelta(days=1)
    return db.table("run", since=day).select("id", "user", F.col("end").isNotNull().alias("ended"), "exec_log")


# --- the memoizing layer ------------------------------------------------------------

_TOTAL = "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, {more} FROM events WHERE value > 1 GROUP BY 1"


def events_node(spark: SparkSession, sf_dir: str, snapshot: str = "") -> Node:
    return intern_node(spark, lambda: table(spark, sf_dir, "events").select("event_type", "value"), f"{sf_dir}/events.parquet", snapshot)


def total_node(below: Node) -> Node:
    return Node("total", lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("value")).alias("cents")), (below,), ident="total")


def kept_node(below: Node, op: str = "filter", more: float = 1) -> Node:
    return Node(op, lambda d: d.where(F.col("value") > more), (below,), params=["value", more], ident="kept")


def with_stats(df: DataFrame, e: Evaluator, *idents: str) -> DataFrame:
    return df.withColumns({f"{i}_cached": F.lit(e.stats.get(i, {}).get("cached", -1)) for i in idents})


@query(_TOTAL.format(more="0 AS kept_cached, 1 AS total_cached"))
def memo_physical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another step that comes to equal rows: what lies above it is found by what its input holds."""
    folder, source = io.work_folder(spark, "memo"), events_node(spark, sf_dir)
    Evaluator(spark, folder).evaluate(total_node(kept_node(source)))
    other = Node("select", lambda d: d.where(~(F.col("value") <= 1)), (source,), ident="kept")
    e = Evaluator(spark, folder)
    return with_stats(e.evaluate(total_node(other)), e, "kept", "total")


@query(_TOTAL.format(more="1 AS kept_cached, 1 AS total_cached"))
def memo_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-up every step is looked up, so those below a hit count too; a new snapshot of equal rows changes nothing above."""
    folder, config = io.work_folder(spark, "memo"), MemoConfig(strategy=Strategy.BOTTOMUP)
    Evaluator(spark, folder, config).evaluate(total_node(kept_node(events_node(spark, sf_dir, "monday"))))
    e = Evaluator(spark, folder, config)
    return with_stats(e.evaluate(total_node(kept_node(events_node(spark, sf_dir, "tuesday")))), e, "kept", "total")


@query(_TOTAL.format(more="1 AS kept_cached, 0 AS total_cached"))
def memo_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose ident matches are computed again, others are found."""
    folder, graph = io.work_folder(spark, "memo"), total_node(kept_node(events_node(spark, sf_dir)))
    Evaluator(spark, folder).evaluate(graph)
    e = Evaluator(spark, folder, MemoConfig(invalidate="^total$"))
    return with_stats(e.evaluate(graph), e, "kept", "total")


@query("SELECT count(*) AS n, 0 AS first, 1 AS plain, 0 AS again FROM events WHERE value < -1")
def memo_recompute_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty result is a hit, unless empty ones are to be computed again."""
    folder, none = io.work_folder(spark, "memo"), Node("none", lambda d: d.where(F.col("value") < -1), (events_node(spark, sf_dir),), ident="none")
    seen = []
    for empty in (False, False, True):
        e = Evaluator(spark, folder, MemoConfig(recompute_empty=empty))
        out = e.evaluate(none)
        seen.append(e.stats["none"]["cached"])
    return out.agg(F.count(F.lit(1)).alias("n")).withColumns({k: F.lit(v) for k, v in zip(("first", "plain", "again"), seen, strict=True)})


@query(_TOTAL.format(more="'0010' AS cached"))
def memo_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a step is found: with no cache, one that is only written, one that is read, and none again."""
    folder, graph, seen = io.work_folder(spark, "memo"), total_node(kept_node(events_node(spark, sf_dir))), ""
    for mode in (Mode.OFF, Mode.WRITE, Mode.READ, Mode.OFF):
        e = Evaluator(spark, folder, MemoConfig(mode=mode))
        out = e.evaluate(graph)
        seen += str(e.stats["total"]["cached"])
    return out.withColumn("cached", F.lit(seen))


@query("SELECT event_type, count(*) AS n, 2 AS kept, 2 AS added, 0 AS more, 1 AS total_cached FROM events WHERE value > 1 GROUP BY 1")
def memo_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical keys that an index lost are written again without running a step, and then serve."""
    folder, source = io.work_folder(spark, "memo"), events_node(spark, sf_dir)
    graph = total_node(kept_node(source))
    e = Evaluator(spark, folder)
    e.evaluate(graph)
    logical = {n.digest() for n in graph.walk()}
    lost = e.index.scan("fileset").where(~F.col("key").isin(*logical))
    n_lost = lost.count()
    e.index.delete(spark.createDataFrame(lost.select("kind", "key").collect(), "kind string, key string"))
    e = Evaluator(spark, folder)
    added = e.repair(graph)
    other = Node("select", lambda d: d.where(~(F.col("value") <= 1)), (source,), ident="kept")
    last = Evaluator(spark, folder)
    out = last.evaluate(total_node(other)).select("event_type", "n")
    return with_stats(out.withColumns({"kept": F.lit(n_lost), "added": F.lit(added), "more": F.lit(Evaluator(spark, folder).repair(graph))}), last, "total")


@query(_TOTAL.format(more="1 AS gone, 0 AS young, 1 AS total_cached"))
def memo_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that no live graph uses go, but none younger than a threshold; what is live is still found."""
    folder, source = io.work_folder(spark, "memo"), events_node(spark, sf_dir)
    live = total_node(kept_node(source))
    e = Evaluator(spark, folder)
    e.evaluate(live)
    e.evaluate(kept_node(source, more=2))
    young = e.collect([live], before=datetime(2000, 1, 1))
    gone = e.collect([live])
    last = Evaluator(spark, folder)
    return with_stats(last.evaluate(live).withColumns({"gone": F.lit(gone), "young": F.lit(young)}), last, "total")


@query(_TOTAL.format(more="1 AS n_total, 2 AS written"))
def memo_extern_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal steps are one, and an extern above them runs each time."""
    folder, to, written = io.work_folder(spark, "memo"), io.work_folder(spark, "extern"), []

    def write(a: DataFrame, b: DataFrame) -> DataFrame:
        io.extern(a.intersect(b), to)
        written.append(1)
        return spark.read.parquet(to)

    for _ in range(2):
        same = [total_node(kept_node(events_node(spark, sf_dir))) for _ in range(2)]
        e = Evaluator(spark, folder)
        out = e.evaluate(Node("write", write, tuple(same), kind="extern"))
    return out.withColumns({"n_total": F.lit(e.stats["total"]["n"]), "written": F.lit(len(written))})


@query("SELECT event_type, count(*) AS n, 3 AS built FROM events GROUP BY 1")
def memo_facts_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the exact policy a hit counts only while the facts it was made from are what they were."""
    folder, built = io.work_folder(spark, "memo"), []

    def node(etag: str) -> Node:
        def build() -> DataFrame:
            built.append(etag)
            return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

        return Node("in", build, kind="intern", params=["events"], facts=spark.createDataFrame([("events", "blob", "etag", etag)], assertions.SCHEMA))

    for etag in ("1", "1", "2", "2", "1"):
        out = Evaluator(spark, folder, MemoConfig(policy=assertions.Policy.EXACT)).evaluate(node(etag))
    return out.withColumn("built", F.lit(len(built)))


@query("SELECT lang, count(*) AS n, TRUE AS order_free, FALSE AS changed FROM documents GROUP BY 1")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's digest is of its rows alone."""
    whole = table(spark, sf_dir, "documents")
    docs = whole.select("doc_id", "lang", F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.col("lang")).alias("m"))
    d = lambda df: content_digest(df, df.agg(*content_marks(df)).first().asDict())
    other = whole.select("doc_id", "lang", F.create_map(F.lit("b"), F.col("lang"), F.lit("a"), F.col("source")).alias("m")).repartition(5)
    changed = docs.withColumn("lang", F.when(F.col("doc_id") == 0, F.lit("xx")).otherwise(F.col("lang")))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumns({"order_free": F.lit(d(docs) == d(other)), "changed": F.lit(d(docs) == d(changed))})


@query("SELECT n_regionkey, count(*) AS n, TRUE AS steady, FALSE AS random FROM nation GROUP BY 1")
def exec_repeat_and_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a plan gives the same rows when it runs again."""
    rows = table(spark, sf_dir, "nation")
    steady = repeat_and_check(lambda: rows.groupBy("n_regionkey").count(), 3)
    random = repeat_and_check(lambda: rows.select(F.rand().alias("x")), 3)
    return rows.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).withColumns({"steady": F.lit(steady), "random": F.lit(random)})


@query("SELECT concat('d', doc_id) AS subject, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN lang ELSE 'made' END AS value FROM documents")
def assertions_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present values of facts: those that the run knows, and others made once for each subject."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fact = lambda d, v: d.select(F.concat(F.lit("d"), "doc_id").alias("subject"), F.lit("doc").alias("namespace"), F.lit("lang").alias("property"), v.alias("value"))
    known = fact(docs.join(labels, "doc_id", "left_semi"), F.col("lang"))
    make = lambda m: m.select("subject", "namespace", F.lit("lang").alias("property"), F.lit("made").alias("value"))
    return assertions.refresh(fact(docs, F.lit("old")), known, make).select("subject", "value")


@query("SELECT count(*) AS n, TRUE AS same, FALSE AS other FROM (SELECT DISTINCT concat_ws('/', lang, source) FROM documents)")
def dirs_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories compare by paths and contents, whatever way they were made."""
    rows = document_rows(spark, sf_dir)
    a, b = dirs.from_list(rows), dirs.sum_layers(rows.withColumn("layer", F.col("pos")).drop("pos"), "layer")
    changed = a.withColumn("file", F.when(F.col("path") == "en/src0", dirs.file_of_text(F.col("path"))).otherwise(F.col("file")))
    return a.agg(F.count(F.lit(1)).alias("n")).withColumns({"same": F.lit(dirs.equal(a, b)), "other": F.lit(dirs.equal(a, changed))})
