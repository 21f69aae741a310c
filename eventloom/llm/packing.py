"""Packing documents into fixed-length training sequences by best-fit decreasing.

Documents are tokenised and an end id is added. Overlong ones are first cut into
full windows, which fill a sequence each; the remainders are packed best-fit
decreasing, where a segment tree indexed by remaining capacity finds the tightest
open window. Every task packs its own documents in pools of about ``POOL_TOKENS``
tokens, so memory is bounded, nothing is shuffled and a lost task repeats alone.
A pool leaves at most a few windows underfull, which is the only price of packing
pools apart.

Ids are those of the tokenizer file read by ``tokenizers``. Its vocabulary is also
there as byte-pair ranks, which the faster encoder uses; the tests hold both
encoders' ids against each other.

Defined cases: a null text is empty and yields just the end id; an empty table
gives an empty result; ties in length go by arrival; repeated rows are documents of
their own; extra columns are ignored (only the id and the text are read).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import table

WINDOW = 1024
END_ID = 0
#: Tokens that are packed together.
POOL_TOKENS = 4_000_000
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class CapacityTree:
    """Segment tree over remaining capacities 0 .. size: how many windows are open at each."""

    def __init__(self, size: int) -> None:
        self.base = 1
        while self.base < size + 1:
            self.base *= 2
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.base
        while node:
            self.count[node] += by
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of an open window with the least capacity of at least ``need``."""
        node, count = need + self.base, self.count
        if not count[node]:
            while True:
                if node == 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.base:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.base
        window = self.open[capacity].pop()
        self._change(capacity, -1)
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, and the number of windows. Lengths are 1 .. size."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take_tightest(need)
        if found is None:
            found = (size, opened)
            opened += 1
        capacity, at = found
        window[i], offset[i] = at, size - capacity
        if capacity > need:
            tree.add(capacity - need, at)
    return window, offset, opened


def encoder(vocabulary: str = VOCABULARY):
    """Text -> ids. Special strings in a text are their ids, as ``tokenizers`` has them by default."""
    import base64

    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    special = tuple(SPECIAL)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.asarray(made.encode(text, allowed_special="all"), np.uint32)
        return made.encode_to_numpy(text, disallowed_special=())

    return encode


def pack_batches(batches: Iterator[pa.RecordBatch], size: int, pool_tokens: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Columns (id, text) in, pieces out. One pool is held at a time."""
    from pyspark import TaskContext

    encode = encoder(vocabulary)
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 40
    rows: list[list] = []
    held = 0

    def pack() -> pa.RecordBatch:
        nonlocal rows, held, first
        ids, starts, lengths, crcs, totals = map(np.asarray, zip(*rows))
        full = lengths == size
        window, offset, opened = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), int(full.sum())
        window[full] = np.arange(opened)
        if not full.all():
            rest, at, more = best_fit_decreasing(lengths[~full], size)
            window[~full], offset[~full] = rest + opened, at
            opened += more
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(ids), pa.int64())]
            + [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals, window + first, offset)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        first += opened
        rows, held = [], 0
        tb.release()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
            for start in range(0, len(ids), size):
                piece = ids[start : start + size]
                rows.append([doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)])
            held += len(ids)
            if held >= pool_tokens:
                yield pack()
    if rows:
        yield pack()


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, pool_tokens: int = POOL_TOKENS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per piece: document, start, length, checksum of its ids, document's tokens, sequence, offset."""

    def run(batches):
        return pack_batches(batches, size, pool_tokens, vocabulary)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
