import json

import pytest

from quillon import cli

PROGRAM = '''
"""A program."""
from quillon.plans.modules import Module

class Greet(Module):
    """Greets."""
    who: str
    times: int = 1

    def Main(self):
        """The greeting."""
        if self.who == "nobody":
            raise ValueError(self.who)
        return " ".join(["hello", self.who] * self.times)
'''


@pytest.fixture
def program(tmp_path):
    (tmp_path / "p.py").write_text(PROGRAM)
    return str(tmp_path / "p.py")


def test_run(program, capsys):
    assert cli.main(["run", program, "-who", "you", "-times", "2"]) == 0
    assert capsys.readouterr().out == "hello you hello you\n"
    assert cli.main(["run", program]) == 1 and cli.main(["check", program]) == 0 and cli.main(["doc", program]) == 0
    assert "times int = 1" in capsys.readouterr().out
    assert cli.main([]) == 2 and cli.main(["nonsense"]) == 2 and cli.main(["version"]) == 0


def test_runbatch_and_tables(spark, program, tmp_path, capsys):
    (tmp_path / "runs.csv").write_text("id,who,times\na,x,1\nb,nobody,1\n")
    assert cli.main(["runbatch", program, str(tmp_path / "runs.csv"), str(tmp_path / "state")]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["id"], r["phase"]) for r in rows] == [("a", "done"), ("b", "failed")]
    spark.createDataFrame([("r1", "2024-01-01")], "id string, start string").write.parquet(str(tmp_path / "runs"))
    spark.createDataFrame([("r1", None, 1.5, "exact")], "run_id string, err string, cost double, cost_kind string").write.parquet(str(tmp_path / "tasks"))
    assert cli.main(["ps", str(tmp_path / "runs"), str(tmp_path / "tasks")]) == 0
    assert json.loads(capsys.readouterr().out)["cost"] == 1.5
    assert cli.main(["info", "r", str(tmp_path / "runs")]) == 0 and cli.main(["cat", str(tmp_path / "runs")]) == 0
    assert "r1" in capsys.readouterr().out
    assert cli.main(["sync", str(tmp_path / "runs"), f"file://{tmp_path}/copy"]) == 0 and (tmp_path / "copy").exists()
    assert cli.main(["listbatch", str(tmp_path / "state")]) == 0 and cli.main(["batchinfo", str(tmp_path / "state")]) == 0
    assert '"phase":"failed","count":1' in capsys.readouterr().out
    assert cli.main(["list", str(tmp_path / "runs")]) == 0 and "2024-01-01" in capsys.readouterr().out
    spark.createDataFrame([("r1", "you", 3, "x")], "id string, who string, times int, other string").write.parquet(str(tmp_path / "t"))
    assert cli.main(["genbatch", program, str(tmp_path / "t"), str(tmp_path / "gen")]) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "gen")).first().asDict() == {"id": "r1", "who": "you", "times": "3"}
    spark.createDataFrame([("t1", "i", "place")], "id string, ident string, stdout string").write.parquet(str(tmp_path / "logs"))
    assert cli.main(["logs", str(tmp_path / "logs"), "t"]) == 0 and "place" in capsys.readouterr().out
    assert cli.main(["bundle", str(tmp_path / "b.zip"), program]) == 0 and (tmp_path / "b.zip").exists()


GRAPH = '''
from quillon.plans.memo import Node
from quillon.plans.modules import Module

class Numbers(Module):
    """A graph."""
    n: int

    def Graph(self):
        from pyspark.sql import SparkSession
        source = Node("source", lambda: SparkSession.active().range(self.n), params=[self.n])
        return Node("twice", lambda d: d.selectExpr("id * 2 as id"), (source,), ident="twice")
'''


def test_repair_and_rmcache(spark, tmp_path, capsys):
    from quillon.plans.memo import Evaluator

    (tmp_path / "g.py").write_text(GRAPH)
    cache, graph = str(tmp_path / "c"), cli.load(str(tmp_path / "g.py")).make(n=3).Graph()
    assert Evaluator(spark, cache).evaluate(graph).count() == 3
    physical = [k for k in (r["key"] for r in Evaluator(spark, cache).index.scan().collect()) if k not in {n.digest() for n in graph.walk()}]
    assert len(physical) == 1 and cli.main(["rmcache", cache, f"^{physical[0]}$"]) == 0
    capsys.readouterr()
    for want in ("1", "0"):
        assert cli.main(["repair", cache, str(tmp_path / "g.py"), "-n", "3"]) == 0 and capsys.readouterr().out.strip() == want
