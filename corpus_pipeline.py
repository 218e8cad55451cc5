"""A corpus from raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, in
their columns; the last returns packed pieces. Between stages docs are written
as Parquet and read back, so no stage recomputes an earlier one.

Defined results, in every stage: an empty table gives an empty one; a null or empty text
has no language and goes in the first stage, and by itself it fails the rules of the second; a very
long text is judged and packed whole; null ids are ids like any other; repeated rows fare alike but in
the third stage, which keeps one of them; ties go as the operators' docstrings say; other
columns, whatever their names, stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, jaccard_join, language_id, packing, quality_rules
from quillon.llm.common import Scratch, free_name, small_batches, table
from quillon.llm.queries import vocabulary

#: Below this share of its leading language a document is too mixed to keep.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language (und) and those without a leading one."""
    small_batches(spark)
    found = language_id.identify(docs)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule."""
    return quality_rules.judge(docs).where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, that of the least id.

    Documents are told by id and text, so rows that share an id, or have none, are judged each by
    its text; repeated rows are one document. A text without a word is in no class and stays.
    """
    small_batches(spark)
    names = [free_name(docs.columns, x) for x in ("id", "first", "second")]
    whole = F.coalesce(F.col("text"), F.lit(""))
    told = docs.withColumns({names[1]: F.xxhash64(whole), names[2]: F.xxhash64(F.lit(1), whole)})
    kept = jaccard_join.classify(docs).where("chosen").select(F.col("doc_id").alias(names[0]), F.col("d1").alias(names[1]), F.col("d2").alias(names[2])).distinct()
    kept = told.join(kept, told["doc_id"].eqNullSafe(kept[names[0]]) & (told[names[1]] == kept[names[1]]) & (told[names[2]] == kept[names[2]]), "left_semi")
    return kept.dropDuplicates(["doc_id", *names[1:]]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of a benchmark item, however long the document."""
    found = decontamination.report(docs, table(spark, sf_dir, "benchmark")).where(F.col("n_hit") > 0).select("doc_id", "row_hash").distinct()
    keyed = docs.withColumn("_row_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    bad = keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["_row_hash"] == found["row_hash"])
    return keyed.join(found, bad, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language identification and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = Scratch.mark()
        kept = scratch.put(stage(spark, docs, sf_dir), name)
        # What the stage wrote for itself, and what it read, nobody reads any more.
        Scratch.drop_since(spark, mark)
        scratch.drop(before)
        docs = before = kept
    return docs
