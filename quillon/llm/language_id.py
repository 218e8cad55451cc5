"""Language identification: a document as a mixture of languages.

Training gives each language a smoothed distribution over hashed character
n-grams. For a document, expectation-maximisation over those likelihoods
estimates the proportion of each language, and languages leave the set while a
penalised likelihood (a BIC-like penalty for each language) gets no worse: half of the set
at once while that holds, then a quarter and so on down to one, so the number of EM runs grows
with the logarithm of the languages. The prediction is the largest proportion of the set
that stays.

Training reads a bounded, documented sample: about ``per_language`` texts of
each language, of every language that occurs. Which rows are in it depends on a hash of
the id alone. Counting happens on the executors; the model has ``MODEL`` float32 values at most:
beyond so many languages times ``BUCKETS``, n-grams are hashed to fewer buckets.

Defined results: a null text, and one without a letter, is ``und`` with score 0
and no proportions; so is every text if nothing was learnt. Every non-null label is a language,
also a blank one. Of languages that tie the first by name is taken. Texts are processed whole,
however long. Repeated rows get equal results, an empty table gives an empty one, other columns
pass through, and a column of the input whose name clashes with an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, remainder

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Values of a model at most, languages times buckets.
MODEL = 1 << 26
_LETTER = regex.compile(r"\p{L}")
_APART = regex.compile(r"[^\p{L}\p{M}]+")
#: Above so many n-grams for each bucket, a text is counted by bucket, so memory stays bounded.
_DENSE = 4


def buckets_for(languages: int) -> int:
    """Buckets of a model of so many languages."""
    n = BUCKETS
    while n > 1 and n * languages > MODEL:
        n >>= 1
    return n


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all character n-grams of the words of a text, with word boundaries."""
    code = np.frombuffer((" " + _APART.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(0, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            break
        h = code * np.uint32(2654435761) if n == 1 else (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + code[n - 1 :] * np.uint32(3266489917)
        if n in ORDERS:
            x = h + np.uint32(n * 0x9E3779B9 % 2**32)
            x = (x ^ (x >> np.uint32(16))) * np.uint32(2246822507)
            out.append((x ^ (x >> np.uint32(13))) & np.uint32(buckets - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counted(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray | None]:
    """Buckets and how often each occurs (None: once each, a bucket may come again)."""
    g = grams(text, buckets)
    if len(g) < _DENSE * buckets:
        return g, None
    n = np.bincount(g, minlength=buckets)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float32)


def mixture(like: np.ndarray, weight: np.ndarray | None, penalty: float, steps: int = 12) -> np.ndarray:
    """Proportions of the languages (rows of ``like``), 0 for those outside the chosen set."""
    k, m = like.shape
    w = np.ones(m, np.float32) if weight is None else weight
    n = float(w.sum())

    def em(rows: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
        p = like[rows]
        for _ in range(steps):
            mixed = pi @ p
            new = pi * (p @ (w / mixed)) / n
            near = np.abs(new - pi).max() < 1e-3
            pi = new
            if near:
                break
        return pi, float(w @ np.log(pi @ p))

    rows = np.arange(k)
    pi, best = em(rows, np.full(k, 1 / k, np.float32))
    cost = penalty * np.log(max(n, 2.0))
    many = len(rows) // 2
    while many:
        order = np.argsort(pi, kind="stable")
        keep = np.sort(order[many:])
        start = np.maximum(pi[keep], 1e-4)
        fewer, fit = em(rows[keep], (start / start.sum()).astype(np.float32))
        if fit + many * cost < best:
            many //= 2
            continue
        rows, pi, best = rows[keep], fewer, fit
        many = min(many, len(rows) // 2)
    out = np.zeros(k, np.float64)
    out[rows] = pi / pi.sum()
    return out


class Model:
    """Smoothed n-gram likelihoods of each learnt language."""

    def __init__(self, languages: list[str], counts: np.ndarray, alpha: float = 0.1, penalty: float = 2.0):
        self.languages, self.penalty = languages, penalty
        total = counts.sum(1, keepdims=True)
        self.like = ((counts + alpha) / (total + alpha * counts.shape[1])).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, np.ndarray]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, np.zeros(len(self.languages))
        at, weight = counted(text, self.like.shape[1])
        pi = mixture(self.like[:, at], weight, self.penalty)
        top = int(pi.argmax())
        return self.languages[top], float(min(1.0, pi[top])), pi


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 800) -> Model:
    """Learn from rows where ``train`` holds and neither text nor lang is null."""
    rows = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = rows.groupBy(F.col(lang).alias("l")).count().collect()  # a row for each label
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    buckets = buckets_for(len(sizes))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < F.try_element_at(share, F.col(lang))).select(F.col(lang).alias("l"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for l, t in zip(b.column("l").to_pylist(), b.column("t").to_pylist(), strict=True):
                seen.setdefault(l, np.zeros(buckets, np.int64))
                seen[l] += np.bincount(grams(t, buckets), minlength=buckets)
        for l, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["l", "g", "n"])

    learnt = sample.mapInArrow(count, "l string, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()  # MODEL rows at most
    names = sorted(learnt["l"].unique())
    counts = np.zeros((len(names), buckets))
    np.add.at(counts, (learnt["l"].map({x: i for i, x in enumerate(names)}).to_numpy(int), learnt["g"].to_numpy(int)), learnt["n"].to_numpy(float))
    return Model(names, counts)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ``proportions`` (map of the chosen languages)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # MODEL floats at most
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "proportions")])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType()))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [model.predict(t) for t in b.column(text).to_pylist()]
            extra = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([[(model.languages[i], float(f[2][i])) for i in np.flatnonzero(f[2])] for f in found], pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "lang_pred", "score", "proportions"])

    return docs.mapInArrow(label, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 3, held: int = 1, **options) -> DataFrame:
    """docs with held_out, lang_pred, score and proportions; learns from the folds that are not held out."""
    fold = free_name(docs.columns, "fold")
    model = fit(docs, remainder(F.col(doc_id), folds) != held, text, lang, doc_id, **options)
    out = predict(docs.withColumn(fold, remainder(F.col(doc_id), folds) == held), model, text)
    return out.withColumn("held_out", F.col(fold)).drop(fold)
