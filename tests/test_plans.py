"""Sources, the store, memoization, modules and batches."""

import pytest
from pyspark.sql import functions as F

from quillon.errors import EngineError, Kind
from quillon.operators import assertions
from quillon.plans import batch, memo, modules
from quillon.plans.memo import Evaluator, MemoConfig, Mode, Node, Strategy
from quillon.sources import io, store
from quillon.streaming import sessions, sliding, tumbling


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "tree"
    (d / "sub").mkdir(parents=True)
    (d / "hello.txt").write_text("hello\n")
    (d / "sub" / "world.txt").write_text("world\n")
    return str(d)


def test_intern(spark, tree, tmp_path):
    rows = {r["path"]: r["file"] for r in io.intern_dir(spark, tree + "/").collect()}
    assert set(rows) == {"hello.txt", "sub/world.txt"} and rows["hello.txt"]["size"] == 6
    assert io.intern_file(spark, tree + "/hello.txt").first()["file"]["id"] == rows["hello.txt"]["id"]
    snap = io.snapshot(spark, tree)
    assert snap.where("file.id is null and file.etag is not null").count() == 2
    assert "content" not in snap._jdf.queryExecution().executedPlan().toString().split("FileScan")[-1].split("ReadSchema")[-1]
    (tmp_path / "none").mkdir()
    with pytest.raises(EngineError, match="empty directory"):
        io.intern_dir(spark, str(tmp_path / "none"))
    with pytest.raises(EngineError, match="not one file"):
        io.intern_file(spark, tree)
    with pytest.raises(EngineError) as e:
        io.intern_dir(spark, str(tmp_path / "gone"))
    assert e.value.kind is Kind.NOT_EXIST
    with pytest.raises(EngineError) as e:
        io.intern_dir(spark, "bad://x/y")
    assert e.value.kind is Kind.NOT_SUPPORTED
    assert {r["path"] for r in io.intern_many(spark, f"n={tree},{tree}/sub").collect()} == {"n/hello.txt", "n/sub/world.txt", "sub/world.txt"}


def test_copy_and_extern(spark, tree, tmp_path):
    assert io.copy_dir(spark, tree, f"file://{tmp_path}/copy") == 2
    assert (tmp_path / "copy" / "sub" / "world.txt").read_text() == "world\n"
    io.copy_file(spark, f"{tree}/hello.txt", f"localfile://{tmp_path}/one.txt")
    assert (tmp_path / "one.txt").exists()
    with pytest.raises(EngineError, match="scheme"):
        io.copy_dir(spark, tree, str(tmp_path / "x"))
    io.extern(spark.range(3), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    assert io.delete(spark, f"file://{tmp_path}/out")


def test_batch_csv(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("name,s,i\nr1,a,1\nr2,b,2\n")
    df = io.read_batch(spark, str(tmp_path / "runs.csv"))
    assert df.columns == ["id", "s", "i"] and df.count() == 2


def test_repository(spark, tmp_path):
    repo = store.Repository(spark, str(tmp_path / "repo"))
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "content string")
    assert repo.put(rows).count() == 3 and repo.put(rows.limit(1)).count() == 1
    import hashlib

    a = hashlib.sha256(b"a").hexdigest()
    assert repo.get(a) == b"a" and repo.get("00" * 32) is None and repo._all().count() == 2
    keys = spark.createDataFrame([(a,), ("ff",)], "digest string")
    assert repo.stat(keys).count() == 1 and repo.read(keys).where("content is null").count() == 1
    other = store.Repository(spark, str(tmp_path / "other"))
    repo.write_to(other, keys)
    assert other.get(a) == b"a"
    assert repo.collect(keys) == 1 and repo.get(a) == b"a" and repo._all().count() == 1


def test_index(spark, tmp_path):
    index = store.Index(spark, str(tmp_path / "index"))
    put = lambda *rows: index.put(spark.createDataFrame(list(rows), "kind string, key string, value string"))
    assert index.get("k", "a") is None
    put(("k", "a", "1"), ("k", "b", "2"))
    put(("k", "a", "3"))
    assert index.get("k", "a") == "3" and index.scan("k").count() == 2
    wanted = spark.createDataFrame([("k", "a"), ("k", "z")], "kind string, key string")
    assert {r["key"]: r["value"] for r in index.batch_get(wanted).collect()} == {"a": "3", "z": None}
    index.delete(wanted)
    assert index.get("k", "a") is None
    live = spark.createDataFrame([("2",)], "digest string")
    assert store.sweep(index.scan(), live).count() == 0


def graph(spark, runs, threshold=1):
    def source():
        runs.append("source")
        return spark.range(5).toDF("x")

    def keep(df):
        runs.append("keep")
        return df.where(F.col("x") > threshold)

    def total(df):
        runs.append("total")
        return df.agg(F.sum("x").alias("x"))

    src = memo.intern_node(spark, source, "mem://x", "v1")
    return Node("total", total, (Node("keep", keep, (src,), params=[threshold], ident="keep"),), ident="total")


@pytest.mark.parametrize("strategy", list(Strategy))
@pytest.mark.parametrize("mode", list(Mode))
def test_cache_on_is_cache_off(spark, tmp_path, strategy, mode):
    runs = []
    for _ in range(2):
        assert Evaluator(spark, str(tmp_path / "c"), MemoConfig(mode, strategy)).evaluate(graph(spark, runs)).first()["x"] == 9
    if mode is Mode.READWRITE:
        assert runs.count("total") == 1 and runs.count("keep") == 1
    else:
        assert runs.count("total") == 2


def test_lookup_before_explore(spark, tmp_path):
    runs = []
    Evaluator(spark, str(tmp_path / "c")).evaluate(graph(spark, runs))
    before = len(runs)
    e = Evaluator(spark, str(tmp_path / "c"))
    e.evaluate(graph(spark, runs))
    assert len(runs) == before and e.stats == {"total": {"n": 1, "cached": 1}}


def test_parameters_and_invalidation(spark, tmp_path):
    runs = []
    ev = lambda **k: Evaluator(spark, str(tmp_path / "c"), MemoConfig(**k))
    ev().evaluate(graph(spark, runs))
    ev().evaluate(graph(spark, runs, threshold=2))
    assert runs == ["source", "keep", "total", "keep", "total"]
    ev(invalidate="^total$").evaluate(graph(spark, runs))
    assert runs[-1] == "total" and runs.count("keep") == 2
    with pytest.raises(EngineError):
        MemoConfig(invalidate="(")
    with pytest.raises(EngineError):
        MemoConfig.of_flags(eval_="sideways")
    assert MemoConfig.of_flags("exact", "bottomup", "read").mode is Mode.READ


def test_recompute_empty(spark, tmp_path):
    runs = []

    def nothing():
        runs.append(1)
        return spark.range(0)

    for empty in (False, False, True):
        Evaluator(spark, str(tmp_path / "c"), MemoConfig(recompute_empty=empty)).evaluate(Node("none", nothing))
    assert len(runs) == 2


def test_physical_digest_finds_equal_inputs(spark, tmp_path):
    runs = []

    def step(df):
        runs.append(1)
        return df

    config = MemoConfig(strategy=Strategy.BOTTOMUP)
    e = Evaluator(spark, str(tmp_path / "c"), config)
    src = memo.intern_node(spark, lambda: spark.range(2), "s", "1")
    e.evaluate(Node("step", step, (src,)))
    # The same input by way of a step that changes nothing.
    e2 = Evaluator(spark, str(tmp_path / "c"), config)
    e2.evaluate(Node("step", step, (Node("requirements", lambda d: d, (src,), resources={"mem": 1.0}),)))
    assert len(runs) == 1


def test_facts_policy(spark, tmp_path):
    runs = []

    def node(etag):
        def build():
            runs.append(1)
            return spark.range(1)

        return Node("in", build, kind="intern", params=["x"], facts=spark.createDataFrame([("s", "blob", "etag", etag)], assertions.SCHEMA))

    exact, never = MemoConfig(policy=assertions.Policy.EXACT), MemoConfig()
    Evaluator(spark, str(tmp_path / "c"), exact).evaluate(node("1"))
    Evaluator(spark, str(tmp_path / "c"), exact).evaluate(node("1"))
    Evaluator(spark, str(tmp_path / "c"), never).evaluate(node("2"))
    assert len(runs) == 1
    Evaluator(spark, str(tmp_path / "c"), exact).evaluate(node("2"))
    assert len(runs) == 2


def test_extern_runs_every_time(spark, tmp_path):
    done = []

    def write(df):
        done.append(df.count())
        return df

    runs = []
    for _ in range(2):
        Evaluator(spark, str(tmp_path / "c")).evaluate(Node("extern", write, (graph(spark, runs),), kind="extern"))
    assert done == [1, 1] and runs.count("total") == 1


def test_canonicalize_repair_collect(spark, tmp_path):
    runs = []
    a, b = graph(spark, runs), graph(spark, runs)
    both = Node("union", lambda x, y: x.union(y), (a, b))
    same = memo.canonicalize(both)
    assert same.inputs[0] is same.inputs[1] and both.inputs == (a, b)
    e = Evaluator(spark, str(tmp_path / "c"))
    assert e.evaluate(both).count() == 2 and runs == ["source", "keep", "total"]
    assert "digraph" in memo.to_dot(both)
    assert e.repair(both) >= 0
    assert Evaluator(spark, str(tmp_path / "c")).collect([a]) == 1
    f = Evaluator(spark, str(tmp_path / "c"))
    f.evaluate(both)
    assert f.stats["union"]["cached"] == 0 and f.stats["total"]["cached"] == 1


def test_snapshot_digest(spark, tree):
    a = memo.snapshot_digest(io.snapshot(spark, tree))
    assert a == memo.snapshot_digest(io.snapshot(spark, tree).repartition(3))
    assert a != memo.snapshot_digest(io.snapshot(spark, tree).limit(1))
    assert memo.repeat_and_check(lambda: spark.range(3), 3) and not memo.repeat_and_check(lambda: spark.range(3).select(F.rand().alias("x")), 2)
    assert memo.repeat_and_check(lambda: spark.range(3).select(F.rand().alias("x")), 2, deterministic=False)


class Program(modules.Module):
    """A program."""

    name: str
    times: int = 2
    ratio: float = 0.5
    label: str = modules.Default(lambda env: f"{env['name']}-{env['times']}")
    data: modules.DirParam = modules.DirParam("mem://")

    def Main(self):
        """The result."""
        return self.name * self.times

    def helper(self): ...


def test_modules(tmp_path):
    m = Program.make(name="a")
    assert m.Main() == "aa" and m.label == "a-2" and Program.make(name="b", ratio=1).ratio == 1.0
    for bad in ({}, {"name": 1}, {"name": "a", "zzz": 1}, {"name": "a", "times": True}):
        with pytest.raises(modules.ParamError):
            Program.make(**bad)
    assert Program.from_flags(["-name", "x", "--times", "3"]).Main() == "xxx"
    with pytest.raises(modules.ParamError):
        Program.from_flags(["-times", "3"])
    assert list(Program.exports()) == ["Main"] and "times int = 2" in Program.doc() and "label str (defaulted)" in Program.doc()
    assert Program.make(name="a").digest() == m.digest() != Program.make(name="b").digest()
    (tmp_path / "p.py").write_text("x = 1\n")
    assert modules.bundle(str(tmp_path / "a.zip"), str(tmp_path / "p.py")) == modules.bundle(str(tmp_path / "b.zip"), str(tmp_path / "p.py"))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()

    @modules.intrinsic("m", "f")
    def f():
        return 1

    assert modules.REGISTRY["m.f"] is f


def test_batches(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "1"), ("r2", "0"), ("r3", "x")], "id string, n string")
    seen = []

    def evaluate(row):
        seen.append(row["id"])
        if row["id"] == "r3" and seen.count("r3") < 3:
            raise EngineError(Kind.NET, "flaky")
        if row["n"] == "0":
            raise EngineError(Kind.INVALID, "zero")

    b = batch.Batch(spark, str(tmp_path / "states"), "prog", evaluate)
    first = {r["id"]: (r["phase"], r["tries"]) for r in b.run(runs).collect()}
    assert first == {"r1": ("done", 1), "r2": ("failed", 1), "r3": ("done", 3)}
    n = len(seen)
    b.run(runs)
    assert len(seen) == n
    b.run(runs, retry=True)
    assert len(seen) == n + 1
    folded = batch.fold(runs, lambda r: r.where(F.col("n").rlike("^[0-9]+$")).select("id", (F.col("n").cast("int") + 1).alias("m")))
    assert {r["id"]: r["m"] for r in folded.collect()} == {"r1": 2, "r2": 1}


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream, "6 hours", "event_type").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("w").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in tumbling(events, "6 hours", "event_type").collect()}
    assert sliding(events, "2 hours", "1 hour").agg(F.sum("n")).first()[0] == 2 * events.count()
    assert sessions(events, "1 hour", "user_id").agg(F.sum("n")).first()[0] == events.count()


def test_taskdb(spark, tmp_path):
    from datetime import datetime

    from quillon.operators import metadata
    from quillon.sources.taskdb import TaskDB

    db = TaskDB(spark, str(tmp_path / "db"))
    assert db.table("run").count() == 0
    db.create_run("r1", "me", {"a": "b"}, start=datetime(2024, 1, 1))
    db.set_run_attrs("r1", "bundle", ["-x", "1"])
    db.keep_alive("run", "r1", datetime(2024, 1, 1, 1))
    db.keep_alive("run", "r1", datetime(2024, 1, 1, 0, 30))
    db.create_task("t1", "r1", "f1", "ident", resources={"mem": 2.0})
    db.set_task_uri("t1", "u")
    db.set_task_attrs("t1", stdout="o")
    db.set_task_complete("t1", err="bad")
    db.start_pool("p1", cluster_name="c")
    db.start_alloc("a1", "p1", resources={"mem": 1.0})
    db.set_end("alloc", "a1", datetime(2030, 1, 1))
    r = db.table("run").first()
    assert (r["user"], r["args"], r["keepalive"], r["end"], r["labels"]) == ("me", ["-x", "1"], datetime(2024, 1, 1, 1), None, {"a": "b"})
    t = metadata.tasks(db.table("task"), metadata.TaskQuery(run_id="r1")).first()
    assert (t["uri"], t["stdout"], t["err"], t["resources"]) == ("u", "o", "bad", {"mem": 2.0}) and t["end"]
    assert db.table("alloc").first()["end"] == datetime(2030, 1, 1) and db.table("pool").first()["cluster_name"] == "c"
    with pytest.raises(EngineError):
        db._write("run", "r1", nonsense=1)


def test_run_flags():
    from quillon.plans.runflags import RunFlags, unused

    assert RunFlags(eval_="bottomup", cache="off").memo().mode is Mode.OFF
    for bad in ({"assert_": "x"}, {"eval_": "x"}, {"cache": "x"}, {"invalidate": "("}, {"backgroundtimeout": -1}, {"pred": True, "cache": "off"}):
        with pytest.raises(EngineError):
            RunFlags(**bad)
    assert RunFlags(nocacheextern=True).warnings and unused(["a", "_b", "c"], {"c"}) == ["a is declared but not used"]


def test_trace(spark):
    from quillon.functions.checks import trace

    df, seen = trace(spark.range(4), "t", total=F.sum("id"))
    assert df.count() == 4 and seen.get == {"rows": 4, "total": 6}


def test_standard_library(value):
    from quillon.plans import stdlib

    assert value(stdlib.find("strings.HasPrefix")(F.lit("abc"), "ab")) and value(stdlib.find("int")(F.lit(2.9))) == 2
    assert modules.REGISTRY["path.Base"] is stdlib.find("path.Base") and "Chunk: Chunks of at most" in stdlib.doc("strings")
    with pytest.raises(KeyError):
        stdlib.find("strings.Nonsense")
