"""Class-based n-gram language model in the manner of Brown et al.

Words are put into classes by exchange clustering; a text's probability is the
product of class transitions and of word emissions within the class, both
smoothed. Counts come from all training texts:

1. Word counts, hashed to 64 bits, over all training tokens (one shuffle).
2. A start for the clustering. Each of the ``HEAD`` most frequent words is a unit of its own; the
   others share one with the words of like spelling (their last letters). Bigrams of units over all training tokens: at most units squared.
   Exchange clustering moves units between classes while the likelihood of the
   bigrams rises. That is a bounded problem, whatever the size of the corpus.
3. One distributed round of exchange for all other words, from that start: each word's bigrams with the
   classes before and after it, in all training text, meet in one place (one shuffle), and
   the word by itself goes to the class where the likelihood is highest. All words of
   the round move at once, so each sees the others where they started.
4. Bigrams of the classes so found, over all training tokens.
5. Scoring. Words with the highest counts, at most ``LEXICON``, are sent to the
   executors; the counts and classes of the rarer ones are joined by hash, in 4 too. So no table
   that grows with the corpus is ever collected or broadcast.

Tokens are the words and one end per text. An unknown word has the emission of
an unseen word in its spelling's class. The emission is
(c(w) + ALPHA) / (N(class) + ALPHA * (V(class) + 1)), the transition
(C(a, b) + PRIOR * P(b)) / (C(a) + PRIOR), which both sum to one with one unseen word a class.

Defined results: a null or empty text has one token, its end; a very long text
is scored whole, in parts of whole words held by its task alone; with no training
text all counts are 0; an empty table gives an empty one; words that tie in count or
gain are taken in order of their hashes, or stay; repeated rows are scored alike and,
in training, count each; a null doc_id is kept; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, remainder, text_chunks, words

#: Words with a unit of their own in the start, at most; the distributed round gives every other word a class of its own.
HEAD = 800
SPELLINGS = 1024
CLASSES = 64
#: Words whose counts are broadcast, at most; some 16 bytes each.
LEXICON = 1 << 20
ALPHA = 0.1
PRIOR = 5.0
#: Distinct words, or places of words, that a counting task holds before it passes them on.
FLUSH = 2_000_000
#: Places of words that are assigned at once.
BLOCK_PLACES = 60_000
END = np.uint64(0x5EED0FE2D0FE2D01)


def spelling(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unit of words by spelling: the last three bytes before a final mark of punctuation."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    last = low[end - 1]
    stop = end - ((last < 128) & ~((last >= 97) & (last <= 122)))
    h = np.zeros(len(end), np.uint64)
    for k in range(1, 4):
        at = stop - k
        h = h * np.uint64(257) + np.where(at >= begin, low[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(h) % np.uint64(SPELLINGS)).astype(np.int64)


def token_chunks(column: pa.Array):
    """Yield (first row, token hashes, spelling units, first token of each text); each text closes with END."""
    for lo, _, data, starts in text_chunks(column):
        begin, end, h, first = words(data, starts)
        h[h == END] = END ^ np.uint64(1)
        unit = spelling(data, begin, end) if len(h) else np.zeros(0, np.int64)
        yield lo, np.insert(h, first[1:], END), np.insert(unit, first[1:], SPELLINGS), first + np.arange(len(first))


def merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, sums of n, and where each value first stood."""
    u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)).astype(np.int64), at


def count_words(docs: DataFrame) -> DataFrame:
    """(word, unit, n) over docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h, n, unit):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(unit.astype(np.int32)), pa.array(n)], ["word", "unit", "n"])

        held, size = [], 0
        for batch in batches:
            for _, h, unit, _ in token_chunks(batch.column("text")):
                u, n, at = merged(h, np.ones(len(h)))
                held.append((u, n, unit[at]))
                size += len(u)
                if size > FLUSH:
                    h, n, unit = (np.concatenate(x) for x in zip(*held, strict=True))
                    u, n, at = merged(h, n)
                    held, size = [(u, n, unit[at])], len(u)
                    if size > FLUSH // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            h, n, unit = (np.concatenate(x) for x in zip(*held, strict=True))
            u, n, at = merged(h, n)
            for lo in range(0, len(u), 100_000):
                yield out(u[lo : lo + 100_000], n[lo : lo + 100_000], unit[at][lo : lo + 100_000])

    return docs.select("text").mapInArrow(run, "word long, unit int, n long").groupBy("word").agg(F.min("unit").alias("unit"), F.sum("n").alias("n"))


class Units:
    """Unit of a token: a head word's own, else its spelling's, else the end's."""

    def __init__(self, head: np.ndarray):
        self.head = np.sort(head)
        self.end = SPELLINGS
        self.n = SPELLINGS + 1 + len(head)

    def of(self, h: np.ndarray, unit: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return unit
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, SPELLINGS + 1 + at, unit)


def count_bigrams(docs: DataFrame, units: Units) -> DataFrame:
    """(a, b, n) of neighbouring units; the first token of a text follows an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units.n * units.n, np.int64)
        for batch in batches:
            for _, h, unit, first in token_chunks(batch.column("text")):
                u = units.of(h, unit)
                before = np.r_[units.end, u[:-1]]
                before[first[:-1]] = units.end
                k, n = np.unique(before * units.n + u, return_counts=True)
                total[k] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // units.n).astype(np.int32)), pa.array((at % units.n).astype(np.int32)), pa.array(total[at])], ["a", "b", "n"])

    return docs.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, end: int, classes: int = CLASSES, passes: int = 12) -> np.ndarray:
    """Class of each unit. pairs: units x units bigram counts. The end has class 0 for itself.

    Starts from frequency order dealt over the classes; then each unit, the most frequent
    first, goes to the class where the bigrams' likelihood is highest, until nothing moves.
    """
    n = len(pairs)
    after, before = pairs.sum(1), pairs.sum(0)
    order = [i for i in np.argsort(-(after + before), kind="stable") if i != end and after[i] + before[i] > 0]
    cls = np.full(n, min(1, classes - 1))
    for k, i in enumerate(order):
        cls[i] = 1 + k % (classes - 1)
    cls[end] = 0
    out = np.zeros((n, classes))  # from a unit to a class
    into = np.zeros((n, classes))
    for c in range(classes):
        out[:, c] = pairs[:, cls == c].sum(1)
        into[:, c] = pairs[cls == c].sum(0)
    grid = np.zeros((classes, classes))
    for c in range(classes):
        grid[c] = out[cls == c].sum(0)

    for _ in range(passes):
        moved = 0
        for i in order:
            c, s = cls[i], pairs[i, i]
            o, b = out[i].copy(), into[i].copy()
            grid[c] -= o
            grid[:, c] -= b
            grid[c, c] += s
            o[c] -= s
            b[c] -= s
            row, col = grid.sum(1), grid.sum(0)
            base, diag = xlogx(grid), np.diag(grid)
            # Adding the unit to class k changes row k by o, column k by b and the corner by both and s.
            gain = (xlogx(grid + o[None, :]) - base).sum(1) + (xlogx(grid + b[:, None]) - base).sum(0)
            gain += xlogx(diag + o + b + s) - xlogx(diag + o) - xlogx(diag + b) + xlogx(diag)
            gain -= xlogx(row + after[i]) - xlogx(row) + xlogx(col + before[i]) - xlogx(col)
            gain[0] = -np.inf
            k = int(gain.argmax())
            if gain[k] <= gain[c] + 1e-9:
                k = c
            o[c] += s
            b[c] += s
            if k != c:
                moved += 1
                out[:, c] -= pairs[:, i]
                out[:, k] += pairs[:, i]
                into[:, c] -= pairs[i]
                into[:, k] += pairs[i]
                o, b = out[i].copy(), into[i].copy()
                cls[i] = k
            grid[k] += o
            grid[:, k] += b
            grid[k, k] -= s
        if moved <= len(order) // 500:
            break
    return cls


def count_contexts(docs: DataFrame, units: Units, cls: np.ndarray) -> DataFrame:
    """(word, unit, beside) of the words that are not heads, in parts.

    ``beside`` has two bytes for each place of the word: the class that follows, or CLASSES where
    the word follows itself, and the class before, or CLASSES where that is counted there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            h, unit, pair = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h)
            h, unit, pair = h[order], unit[order], pair[order]
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            for lo in range(0, len(begin), 100_000):
                at = begin[lo : lo + 100_000]
                to = begin[lo + 100_000] if lo + 100_000 < len(begin) else len(h)
                cut = pa.py_buffer((2 * (np.r_[at, to] - at[0])).astype(np.int32))
                beside = pa.Array.from_buffers(pa.binary(), len(at), [None, cut, pa.py_buffer(pair[at[0] : to])])
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(unit[at]), beside], ["word", "unit", "beside"])

        held, size = [], 0
        for batch in batches:
            for _, h, unit, first in token_chunks(batch.column("text")):
                u = units.of(h, unit)
                c = cls[u].astype(np.uint8)
                i = np.flatnonzero(u < SPELLINGS)  # no head, no end: so a next token there is
                starts = np.zeros(len(h), bool)
                starts[first[:-1]] = True
                pair = np.empty((len(i), 2), np.uint8)
                pair[:, 0] = np.where(h[i + 1] == h[i], CLASSES, c[i + 1])
                pair[:, 1] = np.where(starts[i], 0, np.where(h[i - 1] == h[i], CLASSES, c[i - 1]))
                held.append((h[i], u[i].astype(np.int32), pair))
                size += len(i)
                if size > FLUSH:
                    yield from out(held)
                    held, size = [], 0
        if size:
            yield from out(held)

    return docs.select("text").mapInArrow(run, "word long, unit int, beside binary")


class Gains:
    """By how much a word raises the likelihood of the class bigrams in each class."""

    #: Counts up to which the terms are tabled.
    TABLED = 8

    def __init__(self, grid: np.ndarray):
        self.grid = grid
        self.sides = [self._table(grid.T), self._table(grid)]
        self.sums = [grid.sum(1), grid.sum(0)]

    def _table(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.arange(1, self.TABLED + 1)[:, None, None]
        return g, (xlogx(g + n) - xlogx(g)).reshape(-1, g.shape[1])

    def best(self, after: np.ndarray, before: np.ndarray, itself: np.ndarray, cur: np.ndarray) -> np.ndarray:
        """Class of each word: where the likelihood is highest when that word alone moves; it stays in a tie.

        after, before: words x classes counts of what follows and precedes, without ``itself``, how often
        the word follows itself. ``cur`` is its class now, and the word is among the grid's counts there.
        """
        m, classes = after.shape
        every = np.arange(m)
        gain = np.zeros((m, classes))
        # A side at a time: adding the word to class k changes grid[k, j] by after[j], and grid[i, k] by before[i].
        for mine, other, (g, table) in ((after, before, self.sides[0]), (before, after, self.sides[1])):
            w, j = np.nonzero(mine)
            if not len(w):
                continue
            n, c, at = mine[w, j].astype(np.int64), cur[w], np.arange(len(w))
            easy = (j != c) & (n <= self.TABLED)
            rise = table[(np.where(easy, n, 1) - 1) * classes + j]
            left = g[j, c]  # without the word: it leaves the row and column of its class
            rise[at, c] = xlogx(left) - xlogx(left - n)
            hard = np.flatnonzero(~easy)
            if len(hard):
                w_, j_, n_, c_ = w[hard], j[hard], n[hard], c[hard]
                was = g[j_]
                corner = j_ == c_
                was[corner] -= other[w_[corner]]
                was[np.arange(len(hard)), c_] -= n_ + np.where(corner, itself[w_], 0)
                rise[hard] = xlogx(was + n_[:, None]) - xlogx(was)
            begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            many = np.diff(np.r_[begin, len(w)])
            for r in range(int(many.max())):  # the r-th entry of each word that has so many, at most one for each class
                begin, many = begin[many > r], many[many > r]
                gain[w[begin + r]] += rise[begin + r]
        # The corner, where a class meets itself: more than the two sides only where the word has both there, or itself.
        w, k = np.nonzero(((after > 0) & (before > 0)) | (itself > 0)[:, None])
        a, b, s = after[w, k], before[w, k], itself[w]
        diag = np.diag(self.grid)[k] - np.where(k == cur[w], a + b + s, 0)
        gain[w, k] += xlogx(diag + a + b + s) - xlogx(diag + a) - xlogx(diag + b) + xlogx(diag)
        for mine, sums in zip((after, before), self.sums, strict=True):
            total = mine.sum(1) + itself
            size, inverse = np.unique(total, return_inverse=True)
            less = (xlogx(sums + size[:, None]) - xlogx(sums))[inverse]
            own = sums[cur]
            less[every, cur] = xlogx(own) - xlogx(own - total)
            gain -= less
        gain[:, 0] = -np.inf
        best = gain.argmax(1)
        return np.where(gain[every, best] > gain[every, cur] + 1e-9, best, cur)


def best_classes(after: np.ndarray, before: np.ndarray, itself: np.ndarray, cur: np.ndarray, grid: np.ndarray) -> np.ndarray:
    return Gains(grid).best(after, before, itself, cur)


def assign(contexts: DataFrame, cls: np.ndarray, grid: np.ndarray) -> DataFrame:
    """(word, unit, n, cls) of each word of contexts (word, unit, beside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(grid)
        width = CLASSES + 1

        def block(word, unit, places, pairs) -> pa.RecordBatch:
            """Of whole words: a row of word and unit with its number of places, and the places' pairs."""
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            m = len(begin)
            owner = np.repeat(np.cumsum(np.r_[False, word[1:] != word[:-1]]), places)
            counts = [np.bincount(owner * width + pairs[:, k], minlength=m * width).reshape(m, width) for k in (0, 1)]
            after, before, itself = counts[0][:, :CLASSES].astype(float), counts[1][:, :CLASSES].astype(float), counts[0][:, CLASSES].astype(float)
            unit = unit[begin]
            own = gains.best(after, before, itself, cls[unit])
            return pa.RecordBatch.from_arrays([pa.array(word[begin]), pa.array(unit), pa.array(counts[0].sum(1)), pa.array(own.astype(np.int32))], ["word", "unit", "n", "cls"])

        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                part = batch.slice(lo, 10_000)
                beside = part.column("beside").cast(pa.large_binary())
                cut = np.frombuffer(beside.buffers()[1], np.int64)[beside.offset : beside.offset + len(beside) + 1]
                pairs = np.frombuffer(beside.buffers()[2], np.uint8)[cut[0] : cut[-1]].reshape(-1, 2) if cut[-1] > cut[0] else np.zeros((0, 2), np.uint8)
                held.append((part.column("word").to_numpy(), part.column("unit").to_numpy(), np.diff(cut) // 2, pairs))
                size += len(pairs)
                if size < BLOCK_PLACES and sum(len(x[0]) for x in held) < BLOCK_PLACES:
                    continue
                word, unit, places, pairs = (np.concatenate(x) for x in zip(*held, strict=True))
                at = int(np.searchsorted(word, word[-1]))  # the last word may go on
                if not at:  # nothing but one frequent word, of which there is more
                    held, size = [(word, unit, places, pairs)], len(pairs)
                    continue
                whole = int(places[:at].sum())
                yield block(word[:at], unit[:at], places[:at], pairs[:whole])
                held, size = [(word[at:], unit[at:], places[at:], pairs[whole:])], len(pairs) - whole
        if held:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, unit int, n long, cls int")


def count_classes(docs: DataFrame, classed: DataFrame, lexicon: np.ndarray, cls: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Class x class bigrams over all tokens; the classes of words outside the lexicon (sorted) are joined."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, cls = shared.value
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for _, h, _, first in token_chunks(batch.column("text")):
                c = look_up(lexicon, cls, h, -1)
                c[h == END] = 0
                a, x = np.r_[0, c[:-1]], np.r_[END, h[:-1]]
                a[first[:-1]] = 0
                known = (a >= 0) & (c >= 0)
                total += np.bincount(a[known] * CLASSES + c[known], minlength=len(total))
                i = np.flatnonzero(~known)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[i].astype(np.int32), c[i].astype(np.int32), x[i].view(np.int64), h[i].view(np.int64), np.ones(len(i), np.int64))], ["a", "b", "x", "y", "n"])
        at = np.flatnonzero(total)
        none = np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((at // CLASSES).astype(np.int32)), pa.array((at % CLASSES).astype(np.int32)), pa.array(none), pa.array(none), pa.array(total[at])], ["a", "b", "x", "y", "n"])

    pairs = scratch.put(docs.select("text").mapInArrow(run, "a int, b int, x long, y long, n long"), "pairs")
    whole = pairs.where((F.col("a") >= 0) & (F.col("b") >= 0)).select("a", "b", "n")
    rest = pairs.where((F.col("a") < 0) | (F.col("b") < 0))
    # Each join is keyed by rare words alone: an end that is known has no part in it.
    first = rest.where(F.col("a") < 0).join(classed.select(F.col("word").alias("x"), "cls"), "x").select(F.col("cls").alias("a"), "b", "y", "n")
    rest = first.unionByName(rest.where(F.col("a") >= 0).select("a", "b", "y", "n"))
    second = rest.where(F.col("b") < 0).join(classed.select(F.col("word").alias("y"), "cls"), "y").select("a", F.col("cls").alias("b"), "n")
    found = whole.unionByName(rest.where(F.col("b") >= 0).select("a", "b", "n")).unionByName(second).groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros((CLASSES, CLASSES))
    grid[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return grid


def look_up(keys: np.ndarray, values: np.ndarray, h: np.ndarray, default: int) -> np.ndarray:
    """Value of each h by sorted keys, default where there is none."""
    if not len(keys):
        return np.full(len(h), default, np.int64)
    u, inverse = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
    return np.where(keys[at] == u, values[at], default)[inverse]


@dataclass
class Model:
    units: Units  # of all words of the lexicon, each its own
    cls: np.ndarray
    lexicon: np.ndarray
    counts: np.ndarray
    transition: np.ndarray  # log10, class x class
    emission: np.ndarray  # log10 of each class's denominator
    tokens: int
    distinct: int


def train(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame, int]:
    """(model, (word, unit, n, cls) of all words, the least count that the model's lexicon has) of docs (text)."""
    counted = scratch.put(count_words(docs), "words")
    # How many words have each count: few rows, as large counts are rare. Beyond the head's need they are summed.
    tiers = counted.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("n")).collect()
    distinct, total = sum(t["words"] for t in tiers), sum(t["tokens"] for t in tiers)
    top = counted.where(F.col("unit") != SPELLINGS).orderBy(F.desc("n"), "word").limit(HEAD).collect()
    head = np.array([r["word"] for r in top], np.int64)
    units = Units(head.view(np.uint64))
    bigrams = count_bigrams(docs, units).toArrow()
    pairs = np.zeros((units.n, units.n))
    pairs[bigrams["a"].to_numpy(), bigrams["b"].to_numpy()] = bigrams["n"].to_numpy()
    start = exchange(pairs, units.end)
    grid = np.zeros((CLASSES, CLASSES))
    np.add.at(grid, (np.repeat(start, units.n), np.tile(start, units.n)), pairs.ravel())
    own = start[units.of(head.view(np.uint64), np.zeros(len(head), np.int64))]
    fixed = [(r["word"], r["unit"], r["n"], int(c)) for r, c in zip(top, own, strict=True)]
    ends = counted.where(F.col("unit") == SPELLINGS).select("word", "unit", "n", F.lit(0).alias("cls"))
    heads = docs.sparkSession.createDataFrame(fixed, "word long, unit int, n long, cls int")
    classed = scratch.put(assign(count_contexts(docs, units, start), start, grid).unionByName(heads).unionByName(ends), "classes")
    least, have = 4097, 0
    for t in tiers:
        if have + t["words"] > LEXICON:
            break
        least, have = t["n"], have + t["words"]
    if least <= 4096:
        lex = classed.where(F.col("n") >= least)
    else:  # more than LEXICON words beyond 4096: the most frequent of them
        lex = classed.orderBy(F.desc("n"), "word").limit(LEXICON)
    lex = lex.select("word", "n", "cls").toArrow()
    h, n, c = lex["word"].to_numpy().view(np.uint64), lex["n"].to_numpy(), lex["cls"].to_numpy().astype(np.int64)
    if least > 4096 and len(n):
        least = int(n.min()) + 1
        h, n, c = h[n >= least], n[n >= least], c[n >= least]
    order = np.argsort(h)
    h, n, c = h[order], n[order].astype(np.int64), c[order]
    grid = count_classes(docs, classed.where(F.col("n") < least), h, c, scratch)
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classed.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n_class[r["cls"]], v_class[r["cls"]] = r["n"], r["v"]
    prior = (n_class + 1) / (n_class + 1).sum()
    transition = np.log10((grid + PRIOR * prior) / (grid.sum(1, keepdims=True) + PRIOR))
    real = h != END
    return Model(Units(h[real]), np.r_[start[: SPELLINGS + 1], c[real]], h, n, transition, np.log10(n_class + ALPHA * (v_class + 1)), int(total), int(distinct)), classed, least


def score(docs: DataFrame, train_on: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    docs = docs.select(F.col(doc_id).alias("doc_id"), (~train_on).alias("held_out"), F.col(text).alias("text"))
    model, classed, least = train(docs.where(~F.col("held_out")).select("text"), scratch)
    shared = spark.sparkContext.broadcast(model)  # LEXICON words and CLASSES squared at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, h, unit, first in token_chunks(batch.column("text")):
                u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(m.lexicon, u), max(len(m.lexicon) - 1, 0))
                found = m.lexicon[place] == u if len(m.lexicon) else np.zeros(len(u), bool)
                n = np.where(found, m.counts[place], 0) if len(m.lexicon) else np.zeros(len(u), np.int64)
                word = np.where(found, np.log10(n + ALPHA), 0.0)[inverse]
                cls = m.cls[m.units.of(u, unit[at])][inverse]
                before = np.r_[0, cls[:-1]]
                before[first[:-1]] = 0
                known = found[inverse]
                # A word outside the lexicon has its class by the join, but the end always has its own.
                sure = known | (h == END)
                after_sure = np.r_[True, sure[:-1]]
                after_sure[first[:-1]] = True
                size = np.diff(first)
                classes = np.add.reduceat(np.where(sure & after_sure, m.transition[before, cls], 0.0) - np.where(sure, m.emission[cls], 0.0), first[:-1])
                heads = np.add.reduceat(word, first[:-1])
                seen = np.add.reduceat(known.astype(np.int64), first[:-1])
                rare = (~known).nonzero()[0]
                # The classes beside it, -1 where they come by the join too; -2 for an end, which is done.
                prev = np.where(sure[rare], -2, np.where(after_sure[rare], before[rare], -1))
                after = np.minimum(rare + 1, len(h) - 1)
                then = np.where(sure[after], cls[after], -1)
                kind = pa.StructArray.from_arrays([pa.array(h[rare].view(np.int64)), pa.array(prev.astype(np.int32)), pa.array(cls[rare].astype(np.int32)), pa.array(then.astype(np.int32))], ["word", "prev", "own", "then"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first).astype(np.int32)), kind)
                rows = batch.slice(lo, len(size))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(size.astype(np.int64)), pa.array(seen), pa.array(heads), pa.array(classes), lists], ["doc_id", "held_out", "n_tokens", "seen", "heads", "classes", "rare"])

    parts = docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, seen long, heads double, classes double, rare array<struct<word:long,prev:int,own:int,then:int>>")
    parts = scratch.put(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    tail = parts.select("row", F.posexplode("rare").alias("i", "r")).select("row", "i", "r.*")
    rest = classed.where(F.col("n") < least).select("word", "n", "cls")
    met = tail.join(rest, "word", "left").select("row", F.struct("i", "prev", F.coalesce("cls", "own").alias("cls"), "then", F.coalesce("n", F.lit(0)).alias("n")).alias("r"))
    found = met.groupBy("row").agg(F.sort_array(F.collect_list("r")).alias("r"))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lists = batch.column("r")
            first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            prev, cls, then, n = (lists.flatten().field(k).to_numpy() for k in ("prev", "cls", "then", "n"))
            # A rare word whose neighbour before is rare too follows the one before in the list.
            end = prev == -2
            prev = np.where(prev == -1, np.r_[0, cls[:-1]], prev)
            sums = m.transition[prev, cls] - m.emission[cls] + np.where(then >= 0, m.transition[cls, np.maximum(then, 0)], 0.0)
            sums[end] = 0.0
            add = lambda x: pa.array(np.add.reduceat(x, first[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), add(np.log10(n + ALPHA)), add((n > 0).astype(np.int64)), add(sums)], ["row", "rare_sum", "rare_known", "rare_classes"])

    found = found.mapInArrow(tails, "row long, rare_sum double, rare_known long, rare_classes double")
    words = F.col("heads") + F.coalesce("rare_sum", F.lit(0.0))
    base = math.log10(model.tokens + ALPHA * (model.distinct + 1))
    total = words + F.col("classes") + F.coalesce("rare_classes", F.lit(0.0))
    return parts.drop("rare").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def held_out_score(docs: DataFrame, folds: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id, modulo ``folds``, is not 0."""
    return score(docs, remainder(F.col(doc_id), folds) != 0, text, doc_id)
