"""Benchmark decontamination with a positional inverted index.

``build_index`` stores two tables: the documents with their words, numbered, and
the postings (term, document number, position) of the training tokens, each segment
sorted by term. ``search`` looks a benchmark window up from its rarest term: the
postings of that term give aligned starts (position minus the term's offset in the window). They are
intersected with the postings of the next rarest term, shifted by its offset, and what is left with those
of all the others. Windows with a term that no
document has are dropped before. With ``slop`` 0 a match is the exact phrase. With
more, it is proximity: every other term occurs at most ``slop`` places from where the phrase has it.

An index serves any benchmark; ``report`` builds one of the terms that its own benchmark has, as
no other posting can match. Terms and windows are told by 64-bit hashes, so every table
beside the documents has rows of a few numbers. One of at most ``BROADCAST_ROWS`` such rows, 40 bytes
each, is broadcast; beyond, the same join shuffles, and postings are salted, as a frequent term is one key.
All of it is DataFrame functions.

Defined results: a null text has no words; an item of no words has no window, an
item of fewer than ``width`` words is one window; items of equal text, or rows that
repeat an item_id, count by id; a null item_id is ignored. Repeated documents each
get their row, and so do those of a null id, as rows are told by number. Windows that tie on their rarest term are each
looked up. Very long texts and items are whole: each adds rows in proportion to its
words, and no row holds more than a document's words. An empty table of documents gives an empty
report, and an empty benchmark one without hits. Extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
#: Rows of numbers up to which a table is broadcast.
BROADCAST_ROWS = 500_000
SALTS = 64


def word_list(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), APART, -1), "")


def look_up(posted: DataFrame, table: DataFrame) -> DataFrame:
    """posted (term, n, ...) joined with a table of numbers on ``term``; salted where that is too large to broadcast."""
    if table.count() <= BROADCAST_ROWS:
        return posted.join(F.broadcast(table), "term")
    posted = posted.withColumn("salt", F.pmod("n", F.lit(SALTS)).cast("int"))
    return posted.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"]).drop("salt")


@dataclass(frozen=True)
class Index:
    """``documents`` (n, words and the columns kept) and ``postings`` (term, n, pos)."""

    documents: DataFrame
    postings: DataFrame


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings"))


def build_index(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = (), terms: DataFrame | None = None) -> Index:
    """Store the index of docs, with the columns ``keep``; of all terms, or of those of ``terms`` (term) alone."""
    spark = docs.sparkSession
    docs.select(F.monotonically_increasing_id().alias("n"), *keep, word_list(F.col(text)).alias("words")).write.parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    posted = documents.select("n", F.posexplode("words").alias("pos", "word")).select(F.xxhash64("word").alias("term"), "n", "pos")
    if terms is not None:
        posted = look_up(posted, terms)
    posted.sortWithinPartitions("term", "n", "pos").write.parquet(f"{path}/postings")
    return open_index(spark, path)


@dataclass(frozen=True)
class Windows:
    """``terms`` (window, size, i, term) of each distinct window, and ``items`` (window, item_id)."""

    terms: DataFrame
    items: DataFrame


def windows(items: DataFrame, scratch: Scratch, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> Windows:
    words = F.transform(word_list(F.col(text)), lambda w: F.xxhash64(w))
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(width), F.size("w"))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda s: F.slice("w", s, size))
    found = scratch.put(rows.select("item_id", F.explode(cut).alias("w")).select("item_id", "w", F.xxhash64("w").alias("window")).distinct(), "windows")
    terms = found.select("window", "w").distinct().select("window", F.size("w").alias("size"), F.posexplode("w").alias("i", "term"))
    return Windows(scratch.put(terms, "terms"), found.select("window", "item_id"))


def search(index: Index, wanted: Windows, scratch: Scratch, slop: int = 0) -> DataFrame:
    """(n, window, start, size): where windows occur in the documents."""
    distinct = scratch.put(wanted.terms.select("term").distinct(), "distinct")
    often = scratch.put(look_up(index.postings.select("term", "n"), distinct).groupBy("term").agg(F.count(F.lit(1)).alias("often")), "often")
    # Each window under its rarest term, with the next rarest; one that lacks a term altogether is nowhere.
    order = F.array_sort(F.collect_list(F.struct("often", "term", "i")))  # of a window's terms, at most its width
    ranked = wanted.terms.join(often, "term", "left").groupBy("window", "size").agg(order.alias("r"), F.count("often").alias("known"))
    ranked = ranked.where(F.col("known") == F.col("size")).select("window", "size", F.col("r")[0].alias("a"), F.get("r", F.lit(1)).alias("b"))
    anchors = scratch.put(ranked.select(F.col("a.term").alias("term"), "window", "size", F.col("a.i").alias("at"), F.col("b.term").alias("then"), F.col("b.i").alias("then_at")), "anchors")
    start = (F.col("pos") - F.col("at")).alias("start")
    near = look_up(index.postings, anchors).select("n", "window", "size", start, "then", (start + F.col("then_at")).alias("then_pos")).where(F.col("start") >= 0)
    near = scratch.put(near, "near")
    # The list of the next rarest term leaves few of these starts.
    second = look_up(index.postings, anchors.where("then is not null").select(F.col("then").alias("term")).distinct()).select("n", F.col("term").alias("then"), "pos")
    if slop:
        both = near.join(second, ["n", "then"]).where(F.abs(F.col("pos") - F.col("then_pos")) <= slop).select("n", "window", "size", "start").distinct()
    else:
        both = near.join(second.withColumnRenamed("pos", "then_pos"), ["n", "then", "then_pos"]).select("n", "window", "size", "start")
    near = scratch.put(both.unionByName(near.where("then is null").select("n", "window", "size", "start")), "starts")
    # The lists of the documents that still have one, and what each start asks of them.
    found = near.select("n").distinct()
    found = F.broadcast(found) if near.count() <= BROADCAST_ROWS else found
    lists = index.postings.join(found, "n", "left_semi")
    asked = near.join(wanted.terms.select("window", "i", "term"), "window").withColumn("want", F.col("start") + F.col("i"))
    if slop:
        met = asked.join(lists, ["n", "term"]).where(F.abs(F.col("pos") - F.col("want")) <= slop)
    else:
        met = asked.join(lists.withColumnRenamed("pos", "want"), ["n", "term", "want"])
    whole = met.groupBy("n", "window", "start", "size").agg(F.count_distinct("i").alias("met") if slop else F.count(F.lit(1)).alias("met"))
    return whole.where(F.col("met") == F.col("size")).select("n", "window", "start", "size")


def covered(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(n, n_hit, items): words under any hit, and the sorted ids of the items."""
    ends = hits.groupBy("n", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    past = F.max("end").over(Window.partitionBy("n").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    words = ends.withColumn("past", F.coalesce(past, F.lit(0))).groupBy("n").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "past"))).alias("n_hit"))
    named = hits.select("n", "window").distinct().join(items, "window").groupBy("n").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return words.join(named, "n")


def report(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and row_hash of its text."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    wanted = windows(items, scratch, width=width)
    terms = scratch.put(wanted.terms.select("term").distinct(), "vocabulary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row_hash"), F.col(text).alias("text"))
    index = build_index(rows, scratch.path("index"), keep=("doc_id", "row_hash"), terms=terms)
    hits = covered(scratch.put(search(index, wanted, scratch), "hits"), wanted.items)
    n_words = F.size("words").cast("long")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return index.documents.select("n", "doc_id", "row_hash", n_words.alias("n_words")).join(hits, "n", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "row_hash",
    )
