"""N-gram Jaccard join by MinHash banding, with exact verification.

1. Each text becomes the set of its word 5-grams, hashed to 64 bits, and a
   MinHash signature of bands; band and row counts are chosen for a target recall.
2. Equal texts fall together by two 64-bit hashes. One row of each, a node, stands for its copies.
3. Nodes shuffle on their band hashes. In a band bucket everyone gets one edge, to
   the bucket's least node: linear in the bucket, however large. The components of
   these edges hold every pair that shares a band.
4. Pairs inside a component are verified on the full n-gram sets. A small component is one
   task's group. A larger one is cut in blocks, and every pair of blocks is
   a group: as many pairs as a shuffle has tasks, with at most ``BLOCK`` texts or some
   ``BLOCK_BYTES`` bytes in a block. Pairs of blocks are dealt to the tasks in turn, so
   a huge group of near copies is spread evenly. Pairs of texts are counted where they
   are found and never written out; what leaves is one row per text with its number of links and one edge
   to the least text it is linked with there.
5. The classes are the components of those verified edges.

The number of links is exact, so a group of n different texts that are all near takes n^2 / 2
comparisons, and each text goes to n / BLOCK groups; copies of a text cost nothing.

Words are runs of characters other than U+0020 and U+0009-U+000D, A-Z taken as
a-z. A text of one to four words is one n-gram.

Defined results: a null or empty text, or one of white space, has no n-grams
and stands alone, its class its own id; null is an id like any other, and the class of documents
that all have it is null; rows that share an id and a text count as one document, and
those that share an id only are linked each by its text; exact copies are links of each
other; a pair whose similarity ties with the threshold is linked; a very long text is one set,
held whole by the tasks of its pairs; an empty table gives an empty one. Extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, text_chunks, words
from .components import components

WORDS = 5
#: Texts of a block: at least, as long as the component has so many, and at most.
LEAST_BLOCK = 64
BLOCK = 1024
#: Bytes of text in a block, on average at most.
BLOCK_BYTES = 8 << 20
#: MinHash values that a signature may take.
HASHES = 256


def choose_bands(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, within the hashes, find a pair at the threshold with the recall."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def shingle_chunks(column: pa.Array, n: int = WORDS, most: int = 1 << 19):
    """Yield (first row, hashes of word n-grams, first n-gram of each text) of runs of whole texts."""
    factor = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for lo, _, data, starts in text_chunks(column, most):
        _, _, h, first = words(data, starts)
        size = np.diff(first)
        if not len(h):
            yield lo, h, first
            continue
        # A short text's n-gram starts at its first word; words beyond it count 0.
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(h)) - first[owner]
        begin = place <= np.maximum(size[owner] - n, 0)
        total = np.zeros(len(h), np.uint64)
        padded = np.r_[h, np.zeros(n, np.uint64)]
        own = np.r_[owner, np.full(n, -1)]
        for k in range(n):
            total += np.where(own[k : k + len(h)] == owner, padded[k : k + len(h)], np.uint64(0)) * factor[k]
        many = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
        yield lo, mix(total[begin]), np.r_[0, np.cumsum(many)]


def signatures(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, texts x bands, of texts that each have an n-gram."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    c = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    starts, out, step = first[:-1], np.zeros((len(first) - 1, bands), np.uint64), np.empty_like(x)
    for j in range(bands):
        band = np.full(len(first) - 1, j + 1, np.uint64)
        for i in range(j * rows, (j + 1) * rows):
            np.bitwise_xor(x, c[i], out=step)
            np.multiply(step, a[i], out=step)
            np.add(step, b[i], out=step)
            band = mix(band ^ np.minimum.reduceat(step, starts).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, j] = mix(band)
    return out


def signed(docs: DataFrame, bands: int, rows: int, n: int = WORDS) -> DataFrame:
    """docs (doc_id, d1, d2, size, text) with bands for text; bands is null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            sig = np.zeros((batch.num_rows, bands), np.uint64)
            some = np.zeros(batch.num_rows, bool)
            for lo, grams, first in shingle_chunks(text, n):
                has = np.flatnonzero(np.diff(first))
                if len(has):
                    sig[lo + has] = signatures(grams, np.r_[first[has], len(grams)], bands, rows)
                    some[lo + has] = True
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * bands, bands, dtype=np.int32)), pa.array(sig.view(np.int64).ravel()), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "d1", "d2", "size")), lists], ["doc_id", "d1", "d2", "size", "bands"])

    return docs.mapInArrow(run, "doc_id long, d1 long, d2 long, size int, bands array<long>")


def verify(left: pd.DataFrame, threshold: tuple[int, int], n: int = WORDS) -> pd.DataFrame:
    """Links inside one pair of blocks: rows (node, links, root) of its texts.

    ``left`` has node, text, copies, side (0, 1, or 2 for both: one block with itself).
    Similarity is at least threshold[0] / threshold[1].
    """
    left = left.drop_duplicates("node").sort_values("node").reset_index(drop=True)
    sets = [np.zeros(0, np.uint64)] * len(left)
    for lo, grams, first in shingle_chunks(pa.array(left["text"], pa.large_string()), n):
        for i in range(len(first) - 1):
            sets[lo + i] = np.unique(grams[first[i] : first[i + 1]])
    size = np.array([len(s) for s in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (None, np.zeros(0, np.int64))
    first = np.r_[0, np.cumsum(size)]
    side, node, copies = left["side"].to_numpy(), left["node"].to_numpy(), left["copies"].to_numpy()
    right = np.flatnonzero(side != 0)
    links, root = np.zeros(len(left), np.int64), node.copy()
    parent = np.arange(len(left))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    flat = np.concatenate([at[first[i] : first[i + 1]] for i in right]) if len(right) else np.zeros(0, np.int64)
    cut = np.r_[0, np.cumsum(size[right])][:-1]
    mark = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int64)
    for i in np.flatnonzero(side != 1):
        mark[at[first[i] : first[i + 1]]] = 1
        common = np.add.reduceat(mark[flat], cut) if len(flat) else np.zeros(0, np.int64)
        mark[at[first[i] : first[i + 1]]] = 0
        like = right[(common * threshold[1] >= (size[i] + size[right] - common) * threshold[0]) & (right != i)]
        if side[i] == 2:
            like = like[like > i]
        links[i] += copies[like].sum()
        links[like] += copies[i]
        for j in like:
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
    for i in range(len(left)):
        root[i] = node[top(i)]
    return pd.DataFrame({"node": node, "links": links, "root": root})


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: tuple[int, int] = (4, 5), recall: float = 0.999, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, d1, d2 (hashes of its text), class_id, n_links and ``chosen``.

    class_id is the least id of its class, and n_links the number of documents at least so
    similar. Of each class the rows of one document are chosen: the least id with the least node.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = keyed(docs, text, doc_id)
    bands, rows = choose_bands(threshold[0] / threshold[1], recall)
    marked = scratch.put(signed(docs.withColumn("size", F.octet_length("text")), bands, rows, n), "signatures")
    known = marked.where(F.col("bands").isNotNull())
    # Null is an id, too: a text's rows without an id are one document.
    same = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id"), (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))).alias("copies"), F.max("size").alias("size"))
    texts = scratch.put(same.withColumn("node", F.monotonically_increasing_id()), "texts")
    # Band buckets of nodes; each bucket is a star around its least member.
    banded = known.join(texts.drop("size"), ["d1", "d2"]).where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", F.posexplode("bands").alias("band", "h")).select("node", F.xxhash64("band", "h").alias("h"))
    hubs = banded.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where(F.col("hub") != F.col("far")).select("h", "hub")
    edges = banded.join(hubs, "h").where(F.col("node") != F.col("hub")).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    near = scratch.put(components(edges, scratch), "near")
    near = near.join(texts, "node")
    # Blocks of components, and every pair of blocks; enough pairs of a large component for all tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = F.least(F.lit(block), F.greatest(F.lit(min(block, LEAST_BLOCK)), F.ceil(F.col("many") / math.sqrt(2 * tasks))))
    blocks = F.greatest(F.ceil(F.col("many") / most), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("bytes"))
    placed = near.join(sizes, "root").select("root", blocks.alias("k"), F.pmod(F.xxhash64("node"), F.greatest(blocks, F.lit(1)).cast("long")).cast("int").alias("b"), "node", "first_id", "d1", "d2", "copies")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("b", o).alias("p"), F.greatest("b", o).alias("q")))
    mine = docs["doc_id"].eqNullSafe(placed["first_id"]) & (docs["d1"] == placed["d1"]) & (docs["d2"] == placed["d2"])
    held = docs.join(placed, mine).select("root", "k", "b", "node", "copies", "text", F.explode(pairs).alias("pq"))
    side = F.when(F.col("pq.p") == F.col("pq.q"), 2).when(F.col("b") == F.col("pq.p"), 0).otherwise(1)
    # Pairs of blocks go round the tasks from where their component starts.
    turn = F.col("pq.q").cast("long") * (F.col("pq.q") + 1) / 2 + F.col("pq.p")
    slot = F.pmod(F.xxhash64("root") + turn.cast("long"), F.lit(tasks)).cast("int")
    held = held.select(slot.alias("slot"), "root", "k", "pq.p", "pq.q", side.alias("side"), "node", "copies", "text")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = verify(pdf, threshold, n)
        out["many"] = key[2] > 1
        return out

    groups = held.repartitionById(tasks, "slot").groupBy("slot", "root", "k", "p", "q")
    checked = scratch.put(groups.applyInPandas(run, "node long, links long, root long, many boolean"), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("many").alias("many"))
    single = links.where(~F.col("many")).select("node", "root")
    crossing = components(checked.where("many").select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
    found = links.select("node", "links").join(single.union(crossing), "node").join(texts.select("node", "first_id"), "node")
    found = scratch.put(found, "found")
    tops = found.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("top"))
    linked = found.join(tops, "root").select("node", "links", "class_id", (F.col("top.node") == F.col("node")).alias("chosen"))
    classes = texts.join(linked, "node", "left").select(
        "d1", "d2", "first_id", F.when(F.col("links").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("chosen", F.lit(True)).alias("chosen")
    )
    out = marked.select("doc_id", "d1", "d2", F.col("bands").isNotNull().alias("some")).join(classes, ["d1", "d2"], "left")
    return out.select(
        "doc_id",
        "d1",
        "d2",
        F.when(F.col("some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("some"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        (~F.col("some") | (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("first_id")))).alias("chosen"),
    )


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, d1, d2, text) of docs: what tells a document from another."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("d1"), F.xxhash64(F.lit(1), whole).alias("d2"), whole.alias("text"))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its class) and n_links (documents at least so similar)."""
    return classify(docs, text, doc_id, **options).select("doc_id", "class_id", "n_links")
