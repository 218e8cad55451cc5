"""The memoizing layer: a graph of steps over DataFrames with digests and a stored cache.

A ``Node`` is one step: an operation, parameters, inputs and the function that builds
its DataFrame. Its logical digest hashes operation, parameters and the inputs' digests, so
it is known before anything runs. Its physical digest hashes what the inputs turned
out to hold, whatever steps made them, so a step is found again when its inputs come by another way. Catalyst
plans the work below a node; this layer only decides which nodes to plan.

Top-down evaluation looks a node up before its inputs are explored, and a hit prunes
them. Bottom-up looks it up when its inputs are done and both digests are known. Steps
of kinds ``intern`` and ``exec`` are cached; a step above an ``extern`` is not looked up
top-down, as the extern's effect must happen.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime
from enum import Enum

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, Kind
from ..functions.collections import canonical
from ..operators import assertions as facts_of
from ..sources.store import Index
from .digests import step_digest, value_digest

CACHED = ("intern", "exec")


class Mode(Enum):
    OFF = 0
    READ = 1
    WRITE = 2
    READWRITE = 3


class Strategy(Enum):
    TOPDOWN = "topdown"
    BOTTOMUP = "bottomup"


@dataclass(frozen=True)
class MemoConfig:
    mode: Mode = Mode.READWRITE
    strategy: Strategy = Strategy.TOPDOWN
    policy: facts_of.Policy = facts_of.Policy.NEVER
    invalidate: str | None = None
    recompute_empty: bool = False
    no_cache_extern: bool = False

    def __post_init__(self) -> None:
        if self.invalidate is not None:
            try:
                re.compile(self.invalidate)
            except re.error as e:
                raise EngineError(Kind.INVALID, f"invalidate: {e}") from e

    @staticmethod
    def of_flags(assert_: str = "never", eval_: str = "topdown", cache: str = "readwrite", invalidate: str | None = None, recomputeempty: bool = False, nocacheextern: bool = False) -> MemoConfig:
        """From the text of run flags; an unknown word is refused."""
        try:
            return MemoConfig(Mode[cache.upper()], Strategy(eval_), facts_of.Policy(assert_), invalidate, recomputeempty, nocacheextern)
        except (KeyError, ValueError) as e:
            raise EngineError(Kind.INVALID, f"unknown flag value {e}") from e


@dataclass(eq=False)
class Node:
    op: str
    build: Callable[..., DataFrame]
    inputs: tuple[Node, ...] = ()
    params: object = None
    ident: str = ""
    kind: str = "exec"
    facts: DataFrame | None = None
    resources: dict[str, float] = field(default_factory=dict)

    def digest(self) -> str:
        """The logical digest: resources and idents do not count, and a requirement is its input."""
        if self.op == "requirements":
            return self.inputs[0].digest()
        if "_digest" not in self.__dict__:
            for n in self.walk():
                if n.op != "requirements" and "_digest" not in n.__dict__:
                    n._digest = step_digest(n.op, n.params, [i.digest() for i in n.inputs])
        return self._digest

    def physical(self, snapshots: list[str]) -> str:
        return step_digest("physical:" + self.op, self.params, snapshots)

    def walk(self) -> Iterable[Node]:
        """All nodes, each once, inputs first; graphs of any depth."""
        seen, out, stack = set(), [], [(self, False)]
        while stack:
            n, ready = stack.pop()
            if ready:
                out.append(n)
            elif id(n) not in seen:
                seen.add(id(n))
                stack.append((n, True))
                stack += [(i, False) for i in reversed(n.inputs)]
        return out


def intern_node(spark: SparkSession, build: Callable[[], DataFrame], source: str, snapshot: str = "", ident: str = "") -> Node:
    """A source: its digest is of the source's name and of a snapshot of what it now holds."""
    return Node("intern", build, params=[source, snapshot], ident=ident or source, kind="intern")


def snapshot_digest(files: DataFrame) -> str:
    """Digest of a directory's references, whatever their order."""
    row = files.select(F.sha2(F.concat_ws("|", "path", F.col("file.size").cast("string"), F.coalesce("file.etag", "file.id", F.lit(""))), 256).alias("h"))
    # Order-free: a sum of the hashes' halves, exact in decimals.
    total = row.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]).first()
    return value_digest([str(x) for x in total])


def content_marks(df: DataFrame) -> list:
    """Aggregates that tell a table's rows, whatever their order and files: their number and sums of two hashes."""
    columns = [canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")]


def content_digest(df: DataFrame, marks: dict) -> str:
    return value_digest([df.schema.simpleString(), *(str(marks[k]) for k in ("n", "a", "b"))])


def canonicalize(root: Node) -> Node:
    """A graph of copies in which nodes of equal digests are one."""
    known: dict[str, Node] = {}
    for n in root.walk():
        d = n.digest()
        if d not in known:
            known[d] = replace(n, inputs=tuple(known[i.digest()] for i in n.inputs))
            known[d]._digest = d
    return known[root.digest()]


class Evaluator:
    """Evaluates graphs against a cache below ``path``."""

    def __init__(self, spark: SparkSession, path: str, config: MemoConfig = MemoConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.index = Index(spark, f"{self.path}/index")
        self.stats: dict[str, dict[str, int]] = {}
        self._done: dict[str, DataFrame] = {}
        self._known: dict[str, tuple[str, str]] = {}
        #: What each step that is done holds, by its content.
        self._contents: dict[str, str] = {}
        self._above_extern: set[str] = set()

    # -- lookup

    def _invalid(self, n: Node) -> bool:
        return bool(self.config.invalidate and n.ident and re.search(self.config.invalidate, n.ident))

    def _mark_dirty(self, nodes: Iterable[Node]) -> None:
        """Steps at or above an extern, which must run."""
        for n in nodes:
            if n.kind == "extern" or any(i.digest() in self._above_extern for i in n.inputs):
                self._above_extern.add(n.digest())

    def _batch(self, keys: list[str]) -> dict[str, tuple[str, str]]:
        """(place, content digest) of keys: one join for all that are wanted at once."""
        if not keys:
            return {}
        wanted = self.spark.createDataFrame([("fileset", k) for k in sorted(set(keys))], "kind string, key string")
        return {r["key"]: (r["value"], (r["labels"] or {}).get("content", r["value"])) for r in self.index.batch_get(wanted).where(F.col("value").isNotNull()).collect()}

    def _usable(self, n: Node, place: str) -> DataFrame | None:
        """The cached table, or None where it is gone, empty against the rules, or its facts are stale."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        df = self.spark.read.parquet(place)
        if self.config.recompute_empty and df.isEmpty():
            return None
        if n.facts is not None and self.config.policy is facts_of.Policy.EXACT:
            held = f"{place}.facts"
            q = jvm.org.apache.hadoop.fs.Path(held)
            if not q.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(q):
                return None
            if not facts_of.stale(self.spark.read.schema(facts_of.SCHEMA).parquet(held), n.facts).isEmpty():
                return None
        return df

    def _lookup(self, n: Node, keys: list[str]) -> DataFrame | None:
        if self.config.mode not in (Mode.READ, Mode.READWRITE) or n.kind not in CACHED or self._invalid(n):
            return None
        known = {k: self._known[k] for k in keys if k in self._known} or self._batch(keys)
        for k in keys:  # the most concrete first
            if k in known and (df := self._usable(n, known[k][0])) is not None:
                missing = [m for m in keys if m not in known]
                if missing and self.config.mode is Mode.READWRITE:  # read repair
                    self._write_index(missing, *known[k])
                self._contents[n.digest()] = known[k][1]
                return df
        return None

    # -- write

    def _write_index(self, keys: list[str], place: str, content: str) -> None:
        self.index.put(self.spark.createDataFrame([("fileset", k, place, {"content": content}) for k in keys], "kind string, key string, value string, labels map<string,string>"))

    def _store(self, n: Node, df: DataFrame, keys: list[str]) -> DataFrame:
        """Write a step's table, seeing its content on the way, then its index rows: a failed write leaves no entry."""
        if self.config.mode not in (Mode.WRITE, Mode.READWRITE) or n.kind not in CACHED:
            return df
        place = f"{self.path}/tables/{keys[0][:2]}/{keys[0]}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        df.observe(seen, *content_marks(df)).write.parquet(place)
        if n.facts is not None:
            facts_of.merge(n.facts).write.parquet(f"{place}.facts")
        content = content_digest(df, seen.get)
        self._write_index(keys, place, content)
        self._contents[n.digest()] = content
        return self.spark.read.schema(df.schema).parquet(place)

    # -- evaluation

    def _count(self, n: Node, cached: bool) -> None:
        if n.kind in (*CACHED, "extern"):
            s = self.stats.setdefault(n.ident or n.op, {"n": 0, "cached": 0})
            s["n"] += 1
            s["cached"] += cached

    def _run(self, root: Node) -> DataFrame:
        stack = [(root, False)]
        while stack:
            n, ready = stack.pop()
            d = n.digest()
            if d in self._done:
                continue
            if not ready:
                top_down = self.config.strategy is Strategy.TOPDOWN and d not in self._above_extern
                found = self._lookup(n, [d]) if top_down else None
                if found is None:
                    stack.append((n, True))
                    stack += [(i, False) for i in reversed(n.inputs)]
                    continue
            else:
                keys = [k for k in (self._physical(n), d) if k]
                found = self._lookup(n, keys) if n.kind != "extern" else None
                if found is None:
                    self._done[d] = self._store(n, n.build(*[self._done[i.digest()] for i in n.inputs]), keys)
                    self._count(n, False)
                    continue
            self._count(n, True)
            self._done[d] = found
        return self._done[root.digest()]

    def _physical(self, n: Node) -> str | None:
        """The key by what the inputs hold; of an input that was not stored, its logical digest."""
        return n.physical([self._contents.get(i.digest(), i.digest()) for i in n.inputs]) if n.inputs and n.kind == "exec" else None

    def evaluate(self, root: Node) -> DataFrame:
        root = canonicalize(root)
        nodes = root.walk()
        self._mark_dirty(nodes)
        if self.config.mode in (Mode.READ, Mode.READWRITE) and self.config.strategy is Strategy.TOPDOWN:
            self._known |= self._batch([n.digest() for n in nodes if n.kind in CACHED])
        return self._run(root)

    def repair(self, root: Node) -> int:
        """Recompute the physical keys of a graph's cached steps without running any; how many entries were added."""
        nodes = canonicalize(root).walk()
        known = self._batch([n.digest() for n in nodes])
        self._contents |= {k: content for k, (_, content) in known.items()}
        keys = {n.digest(): self._physical(n) for n in nodes if n.digest() in known and all(i.digest() in self._contents for i in n.inputs)}
        have = self._batch([k for k in keys.values() if k])
        added = [(k, *known[d]) for d, k in keys.items() if k and k not in have]
        for k, place, content in added:
            self._write_index([k], place, content)
        return len(added)

    def collect(self, live_roots: list[Node], before: datetime | None = None, keep_labels: dict[str, str] | None = None) -> int:
        """Delete the tables that no step of the live graphs uses; how many.

        Entries as new as ``before``, or with the labels to keep, stay, and so does a table that one of them names.
        """
        live = {n.digest() for r in live_roots for n in r.walk()}
        entries = self.index.scan("fileset")
        keep = self.spark.createDataFrame([(k,) for k in live], "key string")
        kept = entries.join(keep, "key", "left_semi").select("value")
        if before is not None:
            kept = kept.union(entries.where(F.col("time") >= F.lit(before)).select("value"))
        for k, v in (keep_labels or {}).items():
            kept = kept.union(entries.where(F.try_element_at("labels", F.lit(k)) == v).select("value"))
        gone = entries.join(kept.distinct(), "value", "left_anti")
        dead = gone.select("kind", "key", "value").collect()  # a row for each table that goes, as for its deletion
        places = sorted({r["value"] for r in dead})
        if places:
            self.index.delete(self.spark.createDataFrame([(r["kind"], r["key"]) for r in dead], "kind string, key string"))
            conf = self.spark._jsc.hadoopConfiguration()
            for place in places:
                for q in (place, f"{place}.facts"):
                    p = self.spark._jvm.org.apache.hadoop.fs.Path(q)
                    p.getFileSystem(conf).delete(p, True)
        return len(places)


def to_dot(root: Node) -> str:
    """The graph as DOT text."""
    names = {id(n): f"n{i}" for i, n in enumerate(root.walk())}
    lines = [f'  {names[id(n)]} [label="{n.ident or n.op} {n.digest()[:8]}"];' for n in root.walk()]
    lines += [f"  {names[id(i)]} -> {names[id(n)]};" for n in root.walk() for i in n.inputs]
    return "\n".join(["digraph plan {", *lines, "}"])


def repeat_and_check(build: Callable[[], DataFrame], times: int, deterministic: bool = True) -> bool:
    """Whether a plan gives the same rows each time; one that is declared not to is not repeated."""
    if not deterministic:
        return True

    def mark() -> tuple:
        df = build()
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())

    first = mark()
    return all(mark() == first for _ in range(times - 1))
