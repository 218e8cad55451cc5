"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie behind one another in one numpy array of
symbols. In each round every sequence applies its own lowest-rank pair, at all
its places at once; sequences without a known pair are done. What is left of
each is its number of tokens. A merge makes a symbol that only later ranks use,
so merging all places of one pair at once gives what one by one gives.

Counts equal the library's: special strings inside a text count as one token
each, as by its default, and no begin, end or padding is added.

Defined results: a null or empty text has 0 bytes and 0 tokens. Texts are
processed whole, however long; repeated rows get equal results; a count that
equals the limit is not over it; an empty table gives an empty one; other columns pass
through, and one that clashes with an output is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The pre-token pattern of this public vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BLANK_RUNS = [c + " " for c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Distinct pieces that a worker remembers; when full it starts anew.
REMEMBER = 400_000


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table as sorted pair keys with rank and result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocab = _byte_names(), spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.byte_id = np.zeros(256, np.int64)
        for c, b in names.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        out = size.copy()
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        never = np.int64(len(self.key))
        while len(symbol) > 1:
            pair = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.where((self.key[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], never)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.r_[rank, never], first)
            group = np.cumsum(np.r_[0, owner[1:] != owner[:-1]])
            hit = (rank == low[group[:-1]]) & (rank < never)
            # Of places that overlap (a a a), each second one counts, from the left of its run.
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
            hit &= (place - run) % 2 == 0
            where = np.flatnonzero(hit)
            symbol[where] = self.result[at[where]]
            stay = np.ones(len(symbol), bool)
            stay[where + 1] = False
            live = (low < never)[group]
            gone = ~live & np.r_[True, owner[1:] != owner[:-1]]
            out[owner[gone]] = np.bincount(group, minlength=len(first))[group[gone]]
            stay &= live
            symbol, owner = symbol[stay], owner[stay]
        if len(symbol):
            out[owner[0]] = 1
        return out


@lru_cache(1)
def load(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts texts; remembers the counts of pieces it has seen."""

    def __init__(self, merges: Merges):
        self.merges, self.seen = merges, {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that are tokenized on their own: runs up to a space before a word.

        A pre-token never spans a space with a non-space on its left, so a text
        may be cut there. A text with a space after other white space is cut by the pattern.
        """
        if any(x in text for x in _BLANK_RUNS):
            return PATTERN.findall(text)
        head, *rest = text.split(" ")
        return ([head] if head else []) + [" " + x for x in rest]

    def __call__(self, texts: list[str]) -> list[int]:
        out, parts = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.special and (n := len(self.special.findall(text))):
                out[i] += n
                parts += [(i, self.pieces(x)) for x in self.special.split(text) if x]
            else:
                parts.append((i, self.pieces(text)))
        new = list({p for _, ps in parts for p in ps}.difference(self.seen))
        if len(self.seen) + len(new) > REMEMBER:
            self.seen = {}
            new = list({p for _, ps in parts for p in ps})
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            cut = [PATTERN.findall(p) for p in some]
            each = list({x for c in cut for x in c})
            n = dict(zip(each, self.merges.counts(each).tolist(), strict=True))
            self.seen.update((p, sum(n[x] for x in c)) for p, c in zip(some, cut, strict=True))
        get = self.seen.__getitem__
        for i, ps in parts:
            out[i] += sum(map(get, ps))
        return out


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. vocabulary: a path that every executor can read."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_bytes", "n_tokens", "over_limit")])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load(vocabulary))
        for b in batches:
            done = []
            column = b.column(text)
            for lo in range(0, len(column), 256):
                done += counter([t or "" for t in column.slice(lo, 256).to_pylist()])
            n = pa.array(done, pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, size, n, pa.compute.greater(n, limit)], [*b.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, schema)
