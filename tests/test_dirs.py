"""Directories, file sets, flow steps, comprehensions, lineage facts and metadata."""

import os
import random
import tempfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.errors import EngineError, Kind, non_retryable, restartable, transient
from quillon.operators import assertions, dirs, filesets, flow, metadata, resources
from quillon.operators.comprehension import Comprehension
from quillon.operators.patterns import Ident, Ignore, TuplePat, VariantPat


def directory(spark, **files):
    return spark.createDataFrame([(p.replace("_", "/"), c) for p, c in files.items()], "path string, c string").select("path", dirs.file_of_text(F.col("c")).alias("file"))


def contents(spark, d, texts):
    ids = {r["id"]: r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.sha2("t", 256).alias("id")).collect()}
    return {r["path"]: ids[r["file"]["id"]] for r in d.collect()}


def test_sum_is_right_biased(spark):
    a, b = directory(spark, x="1", y="2"), directory(spark, y="3", z="4")
    assert contents(spark, dirs.sum_dirs(spark, [a, b]), "1234") == {"x": "1", "y": "3", "z": "4"}
    assert dirs.sum_dirs(spark, []).count() == 0
    assert dirs.equal(dirs.sum_dirs(spark, [a]), a) and not dirs.equal(a, b)


def test_random_sums(spark):
    rng = random.Random(7)
    layers = [{rng.choice("abcdefgh"): rng.choice("0123456789") for _ in range(rng.randrange(6))} for _ in range(9)]
    want = {}
    for layer in layers:
        want |= layer
    got = dirs.sum_dirs(spark, [directory(spark, **x) if x else dirs.empty(spark) for x in layers])
    assert contents(spark, got, "0123456789") == want


def test_from_list_and_make(spark):
    rows = spark.createDataFrame([(0, "w", "a"), (1, "h", "b"), (2, "w", "c")], "pos int, path string, c string").select("pos", "path", dirs.file_of_text(F.col("c")).alias("file"))
    assert contents(spark, dirs.from_list(rows), "abc") == {"w": "c", "h": "b"}
    m = rows.where("pos > 0").select(F.map_from_entries(F.collect_list(F.struct("path", "file"))).alias("m"))
    assert contents(spark, dirs.make(m, "m"), "abc") == {"w": "c", "h": "b"}
    assert dirs.from_list(rows.limit(0)).count() == 0


def test_groups(spark):
    d = directory(spark, a_one="1", a_two="2", b_1="3", c="4")
    assert sorted((r["key"], r["path"]) for r in dirs.groups(d, "^(.)/.*").collect()) == [("a", "a/one"), ("a", "a/two"), ("b", "b/1")]
    assert dirs.groups(d, "^./.*").count() == 0 and dirs.groups(d, "^(.)/(.*)").count() == 0
    with pytest.raises(EngineError):
        dirs.groups_list(d, "^./.*")
    assert {(r["pos"], r["path"]) for r in dirs.groups_list(d, "^(.)/.*").collect()} == {(0, "a/one"), (0, "a/two"), (1, "b/1")}


def test_pick_and_files(spark):
    d = directory(spark, b="1", a="2", ab="3", a_x="4")
    assert dirs.pick(d, "a*")[1] == "a"
    with pytest.raises(EngineError, match="no files matched"):
        dirs.pick(d, "z*")
    by_id = {r["file"]["id"]: r["path"] for r in d.collect()}
    assert [by_id[r["file"]["id"]] for r in dirs.files(d).orderBy("pos").collect()] == ["a", "a/x", "ab", "b"]
    assert dirs.files(dirs.empty(spark)).count() == 0


def test_number_over_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).select((1000 - F.col("id")).alias("k")).repartition(5)
    assert [r["pos"] for r in dirs.number(rows, "k").orderBy("k").collect()] == list(range(1000))


def test_number_is_the_same_in_every_job(spark):
    """More rows than bounds of partitions by range are sampled from, and a second column that makes the rows' own job another one."""
    n = 100_000
    rows = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    bad = dirs.number(rows, "k").agg(F.count_if(F.col("pos") != F.col("k")), F.countDistinct("pos")).first()
    assert tuple(bad) == (0, n)
    d = rows.select(F.lpad(F.col("k").cast("string"), 6, "0").alias("path"), dirs.file_struct(id=F.col("s"), size=F.col("k")).alias("file"))
    assert tuple(dirs.files(d).agg(F.count_if(F.col("pos") != F.col("file.size")), F.countDistinct("pos")).first()) == (0, n)


def test_number_over_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(dirs, "PART_ROWS", 3)
    keys = [(a, b) for a in (None, float("-inf"), -0.0, 1.5, float("inf"), float("nan")) for b in (None, "", "a", "b\u00e9", "\U0001f600") for _ in range(2)]
    random.Random(5).shuffle(keys)
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "a double, b string, i int")
    want = [r["i"] for r in rows.repartition(1).sortWithinPartitions("a", "b", "i").collect()]
    got = dirs.number(rows, "a", "b", ties=["i"]).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["pos"])] == want and sorted(r["pos"] for r in got) == list(range(len(keys)))
    same = spark.range(50).select(F.lit("x").alias("k"), F.col("id"))
    assert sorted((r["pos"], r["id"]) for r in dirs.number(same, "k", ties=["id"]).collect()) == [(i, i) for i in range(50)]
    times = spark.range(50).select(F.timestamp_seconds(F.col("id") * 1800 + 1711846800).alias("k"), F.col("id"))
    assert all(r["pos"] == r["id"] for r in dirs.number(times, "k").collect())
    assert dirs.number(same.limit(0), "k").collect() == []
    assert [(r["part"], r["pos"]) for r in dirs.number(same.select(F.col("id").alias("part")), "part").orderBy("pos").collect()] == [(i, i) for i in range(50)]


def test_diff(spark):
    a, b = directory(spark, x="1", y="2"), directory(spark, y="3", z="4")
    assert {r["path"]: (r["before"] is None, r["after"] is None) for r in dirs.diff(a, b).collect()} == {"x": (False, True), "y": (False, False), "z": (True, False)}
    assert {r["change"] for r in dirs.diff(a, b).collect() if r["path"] == "x"}.pop().endswith(" -> void")


def test_groupby_map_collect(spark):
    """Paths grouped by their first element, then collected within each group."""
    d = directory(spark, a_one="1", a_two="2", a_three="3", b_1="4", b_2="5", c_xxx="6")
    out = flow.map_list(flow.groupby(filesets.of_dir(d), "^(.)/.*"), lambda e: flow.collect(e, "^./(.*)", "$1"))
    got = {}
    for r in out.collect():
        got.setdefault(r["list_path"][0], set()).add(r["path"])
    assert got == {0: {"one", "two", "three"}, 1: {"1", "2"}, 2: {"xxx"}}
    with pytest.raises(EngineError):
        flow.groupby(filesets.of_dir(d), "x")


def test_collect_collisions(spark):
    d = directory(spark, a_x="1", b_x="2", c="3")
    assert contents(spark, dirs.collect(d, "^./(.*)$", "$1"), "123") == {"x": "2"}
    assert contents(spark, dirs.collect(d, "^./"), "123") == {"a/x": "1", "b/x": "2"}


def test_filesets(spark, tmp_path):
    a, b = filesets.of_dir(directory(spark, x="1", y="2")), filesets.of_dir(directory(spark, y="3"))
    both = flow.merge([a, b])
    assert contents(spark, flow.pullup(both), "123") == {"x": "1", "y": "3"}
    assert filesets.element(both, 1).count() == 1
    own = filesets.of_dir(directory(spark, y="9")).unionByName(both)
    assert contents(spark, filesets.pullup(own), "1239") == {"x": "1", "y": "3"}, "lists come after a node's own map"
    n = filesets.count(both).first()
    assert (n["n"], n["size"]) == (3, 3)
    one = filesets.data(spark, b"hello")
    assert filesets.to_file(one).first()["file"]["size"] == 5 and filesets.to_dir(a).count() == 2
    filesets.write_parts(both, str(tmp_path / "p"))
    assert filesets.diff(both, filesets.read_parts(spark, str(tmp_path / "p"))).isEmpty()
    assert filesets.diff(both, filesets.from_json(filesets.to_json(both))).isEmpty()
    same = flow.merge([a, a])
    assert filesets.distinct_files(same).count() == 2
    want = spark.createDataFrame([("0",), ("1",), ("2",)], "leaf string")
    assert [r["leaf"] for r in filesets.any_empty(both, want).collect()] == ["2"]


def test_substitute(spark):
    ref = dirs.file_struct(size=F.lit(1), source=F.lit("s3://b/k"), etag=F.lit("e"))
    fs = filesets.of_dir(spark.range(1).select(F.lit("p").alias("path"), ref.alias("file")))
    from quillon.functions.collections import file_digest

    known = spark.range(1).select(file_digest(ref).alias("digest"), dirs.file_of_text(F.lit("x")).alias("file"))
    assert filesets.substitute(fs, known).first()["resolved"] and not filesets.substitute(fs, known.limit(0)).first()["resolved"]
    assert dirs.resolve(filesets.to_dir(fs), known).first()["file"]["id"]


def test_flow_steps(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "x string")
    assert [r["x"] for r in flow.coerce(df, "x", "bigint").collect()] == [1, 2, None]
    with pytest.raises(Exception, match="can't be coerced"):
        flow.coerce(spark.createDataFrame([("z",)], "x string"), "x", "bigint").collect()

    def double(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["x"].astype("int64") * 2})

    numbers = df.where("x is not null")
    assert sorted(r["y"] for r in flow.exec_pandas(numbers, double, "y long").collect()) == [2, 4]
    assert sorted(r["y"] for r in flow.exec_pandas(numbers, double, "y long", by=["x"]).collect()) == [2, 4]
    assert sorted(r["line"] for r in flow.exec_pipe(numbers, "x", "tr 12 ab").collect()) == ["a", "b"]
    assert flow.requirements(df, mem=1.0) is df
    assert flow.continuation([numbers], lambda d: d if d.count() > 1 else d.limit(0)).count() == 2
    assert flow.force_then(numbers, lambda: df).count() == 3
    assert flow.val(spark, [(1,)], "x int").first()["x"] == 1


def test_comprehension(spark):
    a, b = spark.range(3).toDF("i"), spark.range(2).toDF("j")
    c = Comprehension().over(a, ["i"]).over(b, ["j"]).filter(F.col("i") != F.col("j")).let("s", F.col("i") * 10 + F.col("j"))
    assert [r["v"] for r in c.of(v=F.col("s")).orderBy("i", "j").collect()] == [1, 10, 20, 21]
    with pytest.raises(ValueError):
        Comprehension().filter(F.lit(True))
    rows = spark.createDataFrame([(1, [("a", 1), ("b", 2)], {"k": 5})], "id int, l array<struct<_1:string,_2:int>>, m map<string,int>")
    got = Comprehension().over(rows, ["id"]).each(F.col("l"), TuplePat((Ident("n"), Ignore()))).each_entry(F.col("m"), "k", "v").of(n=F.col("n"), v=F.col("v"))
    assert sorted((r["n"], r["v"]) for r in got.collect()) == [("a", 5), ("b", 5)]
    sums = spark.createDataFrame([([("A", 1), ("B", None)],)], "l array<struct<tag:string,A:int>>")
    with pytest.raises(Exception, match="does not match"):
        Comprehension().over(sums).each(F.col("l"), VariantPat("A", Ident("x"))).of(x=F.col("x")).collect()


def test_equi_filter_becomes_a_join(spark):
    a, b = spark.range(1000).toDF("i"), spark.range(1000).toDF("j")
    plan = Comprehension().over(a).over(b).filter(F.col("i") == F.col("j")).of(i=F.col("i"))._jdf.queryExecution().executedPlan().toString()
    assert ("HashJoin" in plan or "SortMergeJoin" in plan) and "Cartesian" not in plan and "NestedLoop" not in plan


def facts(spark, *rows):
    return spark.createDataFrame([(s, "blob", p, v) for s, p, v in rows], assertions.SCHEMA)


def test_assertions(spark):
    a, b = facts(spark, ("s1", "etag", "x"), ("s2", "etag", "y")), facts(spark, ("s1", "etag", "x"), ("s1", "size", "1"))
    assert assertions.merge(a, b).count() == 3
    with pytest.raises(EngineError, match="s1 blob etag: x != z"):
        assertions.merge(a, facts(spark, ("s1", "etag", "z")))
    have, missing = assertions.subset(a, facts(spark, ("s1", "q", ""), ("s9", "q", "")))
    assert have.count() == 1 and missing.first()["subject"] == "s9"
    assert {(r["property"], r["before"], r["after"]) for r in assertions.diff(a, b).collect()} == {("etag", "y", None), ("size", None, "1")}
    now = facts(spark, ("s1", "etag", "new"), ("s2", "etag", "y"))
    assert assertions.stale(a, now).count() == 1 and assertions.stale(a, now, assertions.Policy.NEVER).count() == 0
    out = a.limit(0).withColumn("digest", F.lit("d"))
    lineage = spark.createDataFrame([("d", "i")], "digest string, input string")
    assert assertions.propagate(out, lineage, a.withColumn("input", F.lit("i"))).count() == 2
    with pytest.raises(EngineError, match="d inherits s1 blob etag"):
        assertions.propagate(a.where("subject = 's1'").withColumn("digest", F.lit("d")), lineage, facts(spark, ("s1", "etag", "z")).withColumn("input", F.lit("i")))
    fresh = assertions.refresh(facts(spark, ("s1", "etag", "x"), ("s7", "etag", "x")), a, lambda m: facts(spark, *[(r["subject"], "etag", "gen") for r in m.collect()]))
    assert fresh.count() == 2
    blob = spark.createDataFrame([("s", "e", None, 3)], "source string, etag string, last_modified timestamp, size long")
    assert assertions.blob_facts(blob).count() == 2


D = datetime


def task_rows(spark):
    rows = [
        ("aa1", "r1", "al1", "ic1", "id1", None, D(2024, 1, 1), D(2024, 1, 1, 1), D(2024, 1, 1, 2), 10.0, 5.0),
        ("aa2", "r1", "al2", "ic1", "id1", "x", D(2024, 1, 2), D(2024, 1, 2, 1), None, 20.0, 6.0),
        ("ab3", "r2", "al9", "ic2", "id1", None, D(2024, 1, 3), D(2024, 1, 3, 1), D(2024, 1, 3, 2), 30.0, 7.0),
    ]
    return spark.createDataFrame(rows, "id string, run_id string, alloc_id string, img_cmd_id string, ident string, err string, start timestamp, keepalive timestamp, end timestamp, mem double, seconds double")


def test_task_queries(spark):
    t = task_rows(spark)
    q = metadata.TaskQuery
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    assert ids(metadata.tasks(t, q(id="aa"))) == ["aa1", "aa2"] and ids(metadata.tasks(t, q(id="ab3", run_id="r1"))) == ["ab3"]
    assert ids(metadata.tasks(t, q(run_id="r1"))) == ["aa1", "aa2"] and ids(metadata.tasks(t, q(img_cmd_id="ic2"))) == ["ab3"]
    assert ids(metadata.tasks(t, q(since=D(2024, 1, 1, 12), until=D(2024, 1, 3)))) == ["aa2"]
    assert ids(metadata.tasks(t, q(ident="id1", limit=1))) == ["ab3"]
    allocs = spark.createDataFrame([("al1", "p1"), ("al2", "p9")], "id string, pool_id string")
    pools = spark.createDataFrame([("p1", "c")], "id string, cluster_name string")
    full = {r["alloc_id"]: (r["alloc"] is not None, r["pool"] is not None) for r in metadata.tasks(t, q(id="a", with_alloc=True), allocs, pools).collect()}
    assert full == {"al1": (True, True), "al2": (True, False), "al9": (False, False)}
    assert metadata.allocs(allocs, ["al1"], pools).first()["pool"]["cluster_name"] == "c"
    assert metadata.pools(pools, ["p1"]).count() == 1
    alive = metadata.active(t, D(2024, 1, 2, 1, 3))
    assert ids(alive) == ["aa2"]
    assert metadata.images(t).count() == 2 and len(metadata.info("aa", tasks=t)["tasks"]) == 2


def test_costs(spark):
    rows = spark.createDataFrame([("a", 1.0, "exact"), ("a", 2.0, "unknown"), ("b", 1.0, "exact"), ("b", 2.0, "upper"), ("c", 5.0, "unknown")], "k string, v double, kind string")
    total, kind = metadata.sum_cost("v", "kind")
    got = rows.groupBy("k").agg(total.alias("t"), kind.alias("kind")).withColumn("text", metadata.cost_text(F.col("t"), F.col("kind")))
    assert {r["k"]: (r["t"], r["kind"], r["text"]) for r in got.collect()} == {"a": (1.0, "exact", "1.0000"), "b": (3.0, "upper", "<3.0000"), "c": (0.0, "unknown", "<unknown>")}
    runs = spark.createDataFrame([("r1", D(2024, 1, 1)), ("r9", D(2023, 1, 1))], "id string, start timestamp")
    t = task_rows(spark).withColumns({"cost": F.lit(2.0), "cost_kind": F.lit("exact")})
    assert [(r["id"], r["n_tasks"], r["cost"], r["cost_kind"]) for r in metadata.list_runs(runs, t).collect()] == [("r9", 0, 0.0, "unknown"), ("r1", 2, 4.0, "exact")]
    prices = spark.createDataFrame([("m", 2.0)], "type string, price double")
    priced = metadata.hourly_cost(task_rows(spark).withColumn("type", F.lit("m")), prices)
    assert {r["id"]: r["cost"] for r in priced.collect()} == {"aa1": 4.0, "aa2": 2.0, "ab3": 4.0}


@pytest.mark.parametrize("p,want", [(0, 1), (25, 2), (50, 4), (95, 7), (100, 7), (14, 1), (15, 2)])
def test_nearest_rank(spark, p, want):
    rows = spark.createDataFrame([(float(x),) for x in (5, 3, 7, 1, 2, 6, 4)] + [(float("nan"),), (None,)], "x double")
    rows = rows.withColumn("g", F.lit("g"))
    assert metadata.percentiles(rows, "g", "x", {"q": p}).collect() == [("g", want)]
    assert rows.where("not isnan(x)").agg(metadata.nearest_rank(F.collect_list("x"), p)).first()[0] == want
    with pytest.raises(ValueError):
        metadata.percentiles(rows, "g", "x", {"q": 101}).collect()


def test_every_percent(spark):
    for n in (50, 100):
        rows = spark.range(1, n + 1).select(F.lit("g").alias("g"), F.col("id").alias("x"))
        got = metadata.percentiles(rows, "g", "x", {str(p): p for p in range(1, 101)}).first()
        assert all(got[str(p)] == -(-n * p // 100) for p in range(1, 101))


def test_ranks_of_many_values(spark):
    """More rows than bounds of partitions by range are sampled from; a null group, and a value that is most of a group."""
    n = 40_000
    i = F.col("id")
    rows = spark.range(0, 3 * n, 1, 8).select(F.when(i % 3 > 0, F.concat(F.lit("g"), i % 3)).alias("g"), F.floor(i / 3).alias("x"))
    rows = rows.select("g", F.when(F.col("g") == "g2", F.greatest(F.col("x"), F.lit(n // 2))).otherwise(F.col("x") * 7919 % n).cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with rows enough for several partitions
    try:
        got = {r["g"]: tuple(r)[1:] for r in metadata.percentiles(rows, "g", "x", {f"p{p}": p for p in range(0, 101, 10)}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranks = [max(0, n * p // 100 - 1) for p in range(0, 101, 10)]
    assert got == {None: tuple(map(float, ranks)), "g1": tuple(map(float, ranks)), "g2": tuple(float(max(r, n // 2)) for r in ranks)}


def test_prediction(spark):
    t = task_rows(spark)
    p = metadata.Predictor(min_data=2, max_inspect=2, mem_percentile=100)
    wanted = spark.createDataFrame([("w1", "ic1", "id1"), ("w2", "ic2", "id1"), ("w3", "zz", "zz")], "id string, img_cmd_id string, ident string")
    got = {r["id"]: (r["mem"], r["seconds"]) for r in p.predict(wanted, t).collect()}
    assert got == {"w1": (30.0, 7.0), "w2": (30.0, 7.0), "w3": (None, None)}, "one of two tasks of ic1 has ended, so the ident decides"
    bad = t.withColumn("mem", F.when(F.col("id") == "aa1", -1.0).otherwise(F.col("mem")))
    assert p.model(bad, "ident").count() == 0
    assert metadata.Predictor(min_data=1).model(t, "img_cmd_id").count() == 2


def test_summary_and_allocation(spark):
    steps = spark.createDataFrame([("a", False, 1.0), ("a", False, 3.0), ("a", True, None)], "ident string, cached boolean, runtime double")
    r = metadata.summary(steps, ("runtime",)).first()
    assert (r["n"], r["n_cached"], r["min_runtime"], r["mean_runtime"], r["max_runtime"]) == (3, 1, 1.0, 2.0, 3.0)
    g = float(1 << 30)
    rows = spark.createDataFrame([("x", g, 0.6 * g), ("y", g, 0.7 * g), ("z", 1e6, 1.0)], "i string, requested_mem double, mean_mem double")
    assert [r["i"] for r in metadata.over_allocated(rows).collect()] == ["x"]


def test_labels(spark):
    rows = spark.createDataFrame([("1", {"a": "x", "b": "y"}), ("2", {"a": "z"})], "id string, labels map<string,string>")
    ids = lambda e: [r["id"] for r in rows.where(metadata.label_filter(e)).collect()]
    assert ids("a=x") == ["1"] and ids("a=x a=z") == ["1", "2"] and ids("a=,b=y") == ["1"] and ids("!b=") == ["2"] and ids("") == ["1", "2"] and ids("a=x,!b=") == []


def test_resources(spark):
    R = resources
    a, b = {"mem": 10.0, "cpu": 1.0}, {"mem": 4.0, "disk": 2.0}
    assert R.add(a, b) == {"mem": 14.0, "cpu": 1.0, "disk": 2.0} and R.sub(a, b) == {"mem": 6.0, "cpu": 1.0, "disk": -2.0}
    assert R.most(a, b) == {"mem": 10.0, "cpu": 1.0, "disk": 2.0} and R.least(a, b) == {"mem": 4.0, "cpu": 1.0}
    assert R.available(a, {"mem": 9.0}) and not R.available(a, b) and R.equal({"x": 0.0}, {})
    assert R.scale(a, 2) == {"mem": 20.0, "cpu": 2.0} and R.scaled_distance({"cpu": 3.0, "mem": 16 * 2.0**30}, {"cpu": 4.0}) == 3.0
    q = R.Requirements()
    q.add_parallel({"mem": 2.0})
    q.add_parallel({"mem": 3.0})
    q.add_serial({"cpu": 1.0})
    assert q.max() == {"mem": 6.0, "cpu": 2.0}
    q.add(R.Requirements({"mem": 1.0}, 2))
    assert q.width == 3 and R.ratios({"a": 4.0, "b": 1.0}, {"a": 2.0}) == {"a": 2.0} and R.max_ratio({"a": 4.0}, {"a": 2.0}) == 2.0
    rows = spark.createDataFrame([({"mem": 1.0},), ({"mem": 3.0, "cpu": 1.0},)], "resources map<string,double>")
    assert {r["resource"]: r["total"] for r in R.totals(rows).collect()} == {"mem": 4.0, "cpu": 1.0}


def test_retry_and_errors():
    r = metadata.Retry()
    assert [r.after_oom(100.0), r.after_oom(100.0, 900.0), r.after_oom(1e15), r.after_oom(1.0)] == [150.0, 900.0, float(800 << 30), None]
    E = EngineError
    assert transient(E(Kind.TIMEOUT)) and not transient(E(Kind.CANCELED)) and restartable(E(Kind.NET)) and not restartable(E(Kind.EVAL))
    assert non_retryable(E(Kind.FATAL)) and not non_retryable(E(Kind.NOT_ALLOWED)) and restartable(TimeoutError()) and not transient(ValueError())

    def chain(*kinds):
        error = None
        for k in reversed(kinds):
            e = E(k)
            e.__cause__ = error
            error = e
        return error

    assert restartable(chain(Kind.EVAL, Kind.NET)) and not restartable(chain(Kind.FATAL, Kind.NET)) and not restartable(chain(Kind.EVAL, Kind.OTHER)) and len(Kind) == 18


def test_exec_rows(spark):
    from quillon.operators import flow

    df = spark.createDataFrame([(1, "it's; echo $HOME", b"\x00\xff"), (2, None, None)], "n int, s string, b binary")
    got = flow.exec_rows(df, "printf '%s|%s' {{s}} {{n}} > {{t}}; cat {{b}} > {{c}}", {"t": "string", "c": "binary"}).collect()
    assert [(r["t"], bytes(r["c"])) for r in got] == [("it's; echo $HOME|1", b"\x00\xff"), ("|2", b"")]
    with pytest.raises(EngineError):
        flow.exec_rows(df, "echo {{nobody}}", {})
    with pytest.raises(Exception, match="exit 3"):
        flow.exec_rows(df, "exit 3", {}).collect()
    assert flow.profile(spark, {"cpu": 2}) is None


def test_exec_rows_in_a_temp_folder_by_the_process(spark, monkeypatch):
    """Executors may name their temp folder by way of the folder they run in, and with blanks."""
    df = spark.createDataFrame([(1, b"x"), (2, b"y")], "n int, b binary")
    with tempfile.TemporaryDirectory(prefix=".a b ", dir=os.getcwd()) as own:
        monkeypatch.setitem(spark.sparkContext.environment, "TMPDIR", f"/proc/self/cwd/{os.path.basename(own)}")
        got = flow.exec_rows(df, 'echo {{n}} > {{t}}; f=$(mktemp); cat {{b}} {{b}} > "$f"; cat "$f" > {{c}}; echo "$f" > {{p}}', {"t": "string", "c": "binary", "p": "string"}).collect()
        assert [(r["t"], bytes(r["c"])) for r in got] == [("1\n", b"xx"), ("2\n", b"yy")]
        assert all(os.path.dirname(r["p"]) == os.path.realpath(own) for r in got)
