"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of the sequence length while they last and
then into the binary digits of what is left, longest first. Every piece is a
sequence of its own whose length is a power of two, so nothing is padded, no
sequence crosses documents, and pieces of equal length form a bucket that can
be batched together. Pieces need no partner, so packing is one narrow pass:
no shuffle, no state between rows, and no hot bucket.

Defined results: a null or empty text has only the closing id, hence one piece
of length 1; a very long text gives full pieces and then the digits of its rest, and
is held by its task alone; a null doc_id is kept and its pieces carry null; rows
that repeat or tie on an id are packed each for itself; an empty table gives no
pieces; extra columns do not matter.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Distinct parts that a worker remembers; when full it starts anew.
REMEMBER = 400_000


def cuts(n: int, length: int) -> list[int]:
    """Piece lengths of n ids: powers of two up to ``length``, itself a power of two, longest first."""
    assert length > 0 and length & (length - 1) == 0, "the sequence length is a power of two"
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


@lru_cache(1)
def load(path: str) -> Ids:
    """The ids of a worker process; what it remembers serves all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Ids(Tokenizer.from_file(path))


#: The printable stand-in that byte-level vocabularies have for each byte.
_STAND_IN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Ids:
    """The library's ids of texts as little-endian unsigned 32-bit bytes.

    This vocabulary lower-cases, drops white space and never merges across it,
    so what stands between blanks is tokenized on its own; each distinct such
    part goes to the library once and is remembered. Special strings hold no
    blank and so stay whole. A part that is a Latin word in lower case, or one and a
    comma or full stop, is one pre-token (and one more) in normal form, which the
    library's model takes as it is.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, {}
        self.model = tokenizer.model
        self.bytes_of = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token in normal form, straight from the library's merge model."""
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(_STAND_IN)
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(word)])

    def _learn(self, parts: list[str]) -> None:
        seen, plain = self.seen, []
        marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ",."}
        for p in parts:
            stem = p[:-1] if p[-1:] in marks else p
            if stem.isalpha() and stem.islower() and _latin(stem):
                ids = seen.get(stem)
                if ids is None:
                    ids = seen[stem] = self._word(stem)
                if stem is not p:
                    seen[p] = ids + marks[p[-1]]
            else:
                plain.append(p)
        for lo in range(0, len(plain), 20_000):
            some = plain[lo : lo + 20_000]
            seen.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        # Lower case beforehand makes fewer parts; where the library might see it otherwise, it is left to it.
        texts = [t.lower() if "<|" not in t and _latin(t) else t for t in texts]
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        every = {p for ps in parts for p in ps}
        if len(self.seen) + len(every) > REMEMBER:
            self.seen = {}
        self._learn(list(every.difference(self.seen)))
        get = self.seen.__getitem__
        return [b"".join(map(get, ps)) for ps in parts]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids array<int>"


def pack(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", length: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per piece. vocabulary: a path that every executor can read.

    ``bucket`` is the length's exponent: batches draw on one bucket. A
    ``sequence_id`` holds the partition and the piece's number there, so a
    task that runs again gives the same one.
    """
    cuts(0, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, count = load(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                names = part.column("k").to_pylist()
                rows = []
                pieces = []
                for name, raw in zip(names, ids([t or "" for t in part.column("t").to_pylist()]), strict=True):
                    raw += end_id.to_bytes(4, "little")
                    n, at = len(raw) // 4, 0
                    for size in cuts(n, length):
                        piece = raw[4 * at : 4 * (at + size)]
                        rows.append((name, at, size, zlib.crc32(piece), n, count, size.bit_length() - 1))
                        pieces.append(piece if with_ids else None)
                        at += size
                        count += 1
                if not rows:
                    continue
                c = list(zip(*rows, strict=True))
                sizes = np.array(c[2] if with_ids else [0] * len(rows), np.int32)
                flat = np.frombuffer(b"".join(p for p in pieces if p), "<i4") if with_ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat), mask=None if with_ids else pa.array([True] * len(rows)))
                long = [pa.array(x, pa.int64()) for x in c[:6]]
                yield pa.RecordBatch.from_arrays([*long, pa.array(np.zeros(len(rows), np.int64)), pa.array(c[6], pa.int32()), lists], [f.split()[0] for f in PIECES.split(", ")])

    return docs.selectExpr(f"cast(`{doc_id}` as long) as k", f"`{text}` as t").mapInArrow(run, PIECES)
