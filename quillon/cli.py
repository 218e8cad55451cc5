"""Command line: run a program's module, a batch, or a metadata query.

    python -m quillon.cli run program.py -name value ...
    python -m quillon.cli runbatch program.py runs.csv state_dir
    python -m quillon.cli check|doc program.py
    python -m quillon.cli ps runs.parquet tasks.parquet
    python -m quillon.cli info id table.parquet ...
    python -m quillon.cli cat|sync table target
    python -m quillon.cli pred wanted.parquet tasks.parquet
    python -m quillon.cli collect cache_dir live.parquet [label filter]
    python -m quillon.cli images tasks.parquet
    python -m quillon.cli list table.parquet
    python -m quillon.cli logs tasks.parquet id [stderr]
    python -m quillon.cli listbatch|batchinfo state_dir
    python -m quillon.cli genbatch program.py table.parquet out_dir
    python -m quillon.cli repair cache_dir program.py -name value ...
    python -m quillon.cli rmcache cache_dir pattern
    python -m quillon.cli bundle out.zip file.py ...
    python -m quillon.cli version

A program is a Python file with one subclass of ``Module``; its ``Main`` gives the result.
"""

from __future__ import annotations

import importlib.util
import inspect
import json
import sys
from collections.abc import Callable

from pyspark.sql import functions as F

from . import __version__
from .errors import EngineError, Kind
from .plans.modules import Module, ParamError
from .session import session


def load(path: str) -> type[Module]:
    """The module class of a program file."""
    spec = importlib.util.spec_from_file_location("program", path)
    if spec is None or spec.loader is None:
        raise EngineError(Kind.INVALID, f"{path} is not a Python file")
    program = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(program)
    found = [c for _, c in inspect.getmembers(program, inspect.isclass) if issubclass(c, Module) and c is not Module and c.__module__ == "program"]
    if len(found) != 1:
        raise EngineError(Kind.INVALID, f"{path} has {len(found)} modules, not one")
    return found[0]


def show(value: object) -> None:
    if hasattr(value, "toJSON"):
        for line in value.toJSON().toLocalIterator():
            print(line)
    else:
        print(value if isinstance(value, str) else json.dumps(value, default=str))


def run(path: str, *flags: str) -> None:
    module = load(path).from_flags(list(flags))
    if not hasattr(module, "Main"):
        raise EngineError(Kind.INVALID, f"{path} has no Main")
    show(module.Main())


def runbatch(path: str, csv: str, state: str, *flags: str) -> None:
    from .plans.batch import Batch
    from .sources.io import read_batch

    spark, program = session(), load(path)

    def one(row: dict) -> object:
        given = [x for k, v in row.items() if k != "id" and v is not None for x in (f"-{k}", v)]
        value = program.from_flags(given).Main()
        return value.count() if hasattr(value, "count") and not isinstance(value, (str, list, tuple)) else value

    show(Batch(spark, state, path, one).run(read_batch(spark, csv), name=csv, retry="--retry" in flags).orderBy("id"))


def check(path: str) -> None:
    """Load a program and its parameters' declarations without running it."""
    program = load(path)
    program.params()
    print("ok")


def doc(path: str) -> None:
    print(load(path).doc())


def ps(runs: str, tasks: str) -> None:
    from .operators.metadata import list_runs

    spark = session()
    show(list_runs(spark.read.parquet(runs), spark.read.parquet(tasks)))


def info(id_: str, *tables: str) -> None:
    from .operators.metadata import info as find

    spark = session()
    for name, rows in find(id_, **{t: spark.read.parquet(t) for t in tables}).items():
        for r in rows:
            print(name, json.dumps(r.asDict(True), default=str))


def cat(table: str) -> None:
    show(session().read.parquet(table))


def sync(source: str, target: str) -> None:
    from .sources.io import copy_dir

    print(copy_dir(session(), source, target))


def pred(wanted: str, tasks: str) -> None:
    from .operators.metadata import Predictor

    spark = session()
    show(Predictor().predict(spark.read.parquet(wanted), spark.read.parquet(tasks)))


def images(tasks: str) -> None:
    from .operators.metadata import images as used

    show(used(session().read.parquet(tasks)))


def collect(cache: str, live: str, labels: str = "") -> None:
    """Index entries that nothing live uses, of those whose labels match; they are listed and deleted."""
    from .operators.metadata import label_filter
    from .sources.store import Index, sweep

    spark = session()
    index = Index(spark, f"{cache}/index")
    rows = index.scan()
    gone = sweep(rows.where(label_filter(labels)) if labels else rows, spark.read.parquet(live)).persist()
    show(gone.select("kind", "key", "value"))
    index.delete(gone)
    gone.unpersist()


def list_(table: str) -> None:
    """Rows of a table by id, without their nested columns."""
    df = session().read.parquet(table)
    show(df.select([f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]).orderBy("id"))


def logs(tasks: str, id_: str, stream: str = "stdout") -> None:
    from .operators.metadata import logs as places

    show(places(session().read.parquet(tasks), id_, stream))


def listbatch(state: str) -> None:
    """Runs of every batch, as they now are."""
    from .plans.batch import states

    show(states(session(), state).orderBy("batch", "id"))


def batchinfo(state: str) -> None:
    """How many runs of each batch are in which phase."""
    from .plans.batch import states

    show(states(session(), state).groupBy("batch", "phase").count().orderBy("batch", "phase"))


def genbatch(path: str, table: str, out: str) -> None:
    """A run list of the columns of a table that are parameters of a program; its column ``id`` names the runs."""
    from .sources.io import write_batch

    df = session().read.parquet(table)
    write_batch(df.select("id", *[n for n in load(path).params() if n in df.columns]), out)


def repair(cache: str, path: str, *flags: str) -> None:
    """Write the physical keys again that a program's graph lacks; its ``Graph`` gives the graph."""
    from .plans.memo import Evaluator

    print(Evaluator(session(), cache).repair(load(path).from_flags(list(flags)).Graph()))


def rmcache(cache: str, pattern: str) -> None:
    """Delete index entries whose key matches; they are listed."""
    from .sources.store import Index

    index = Index(session(), f"{cache}/index")
    gone = index.scan().where(F.col("key").rlike(pattern)).select("kind", "key", "value").persist()
    show(gone)
    index.delete(gone)
    gone.unpersist()


def bundle(target: str, *files: str) -> None:
    from .plans.modules import bundle as pack

    print(pack(target, *files))


def version() -> None:
    print(__version__)


COMMANDS: dict[str, Callable[..., None]] = {f.__name__.rstrip("_"): f for f in (run, runbatch, check, doc, ps, info, cat, sync, pred, images, collect, list_, logs, listbatch, batchinfo, genbatch, repair, rmcache, bundle, version)}


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        COMMANDS[argv[0]](*argv[1:])
    except (EngineError, ParamError, TypeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
