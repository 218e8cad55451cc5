"""Lineage facts (subject, namespace, property, value) and the policies that compare them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, Kind

SCHEMA = "subject string, namespace string, property string, value string"
KEY = ["subject", "namespace", "property"]


class Policy(Enum):
    NEVER = "never"
    EXACT = "exact"


def blob_facts(files: DataFrame) -> DataFrame:
    """Facts of stored objects (source, etag, last_modified, size): those that are known."""
    facts = F.create_map(
        F.lit("etag"), F.col("etag"), F.lit("last-modified"), F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("size"), F.col("size").cast("string")
    )
    return files.select(F.col("source").alias("subject"), F.lit("blob").alias("namespace"), F.explode(facts).alias("property", "value")).where(F.col("value").isNotNull())


def conflicts(facts: DataFrame) -> DataFrame:
    """(subject, namespace, property, values): facts with more than one value."""
    return facts.groupBy(*KEY).agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def merge(*tables: DataFrame) -> DataFrame:
    """All facts once; two values of one fact raise."""
    facts = tables[0]
    for t in tables[1:]:
        facts = facts.unionByName(t)
    bad = conflicts(facts).orderBy(*KEY).limit(10).collect()
    if bad:
        raise EngineError(Kind.PRECONDITION, "conflicting assertions: " + "; ".join(f"{r['subject']} {r['namespace']} {r['property']}: {' != '.join(r['values'])}" for r in bad))
    return distinct(facts)


def distinct(facts: DataFrame) -> DataFrame:
    return facts.select(*KEY, "value").distinct()


def subset(facts: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of the wanted (subject, namespace), wanted that have no fact)."""
    keys = ["subject", "namespace"]
    return facts.join(wanted.select(*keys).distinct(), keys, "left_semi"), wanted.join(facts, keys, "left_anti")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(subject, namespace, property, before, after) where two tables differ."""
    x, y = distinct(a).withColumnRenamed("value", "before"), distinct(b).withColumnRenamed("value", "after")
    return x.join(y, KEY, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def stale(cached: DataFrame, current: DataFrame, policy: Policy = Policy.EXACT) -> DataFrame:
    """Facts of ``cached`` that the policy does not accept in the light of ``current``."""
    if policy is Policy.NEVER:
        return cached.limit(0)
    now = current.select(*KEY, F.col("value").alias("now"))
    return cached.join(now, KEY, "left").where(~F.col("value").eqNullSafe(F.col("now")))


def propagate(outputs: DataFrame, lineage: DataFrame, inputs: DataFrame, strict: bool = True) -> DataFrame:
    """(digest, subject, namespace, property, value): facts of outputs and of all that they come from.

    outputs: (digest, facts' columns). lineage: (digest, input). inputs: (input, facts' columns).
    Two values of one fact below one digest raise, unless not ``strict``.
    """
    inherited = lineage.join(inputs, "input").select("digest", *KEY, "value")
    found = outputs.select("digest", *KEY, "value").unionByName(inherited).distinct()
    if strict:
        bad = found.groupBy("digest", *KEY).agg(F.min("value").alias("a"), F.max("value").alias("b")).where(F.col("a") != F.col("b")).limit(1).collect()
        if bad:
            raise EngineError(Kind.PRECONDITION, f"{bad[0]['digest']} inherits {bad[0]['subject']} {bad[0]['namespace']} {bad[0]['property']} as {bad[0]['a']} and as {bad[0]['b']}")
    return found


def refresh(facts: DataFrame, known: DataFrame, generate) -> DataFrame:
    """Present values of facts: those that the run knows, and generated once for each other subject."""
    have, missing = subset(known, facts)
    return have.unionByName(generate(missing.select("subject", "namespace").distinct()))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
