"""Removal of byte strings that occur earlier, by bucket-pointer refinement.

A suffix array sorted to depth ``LENGTH`` would put equal strings of LENGTH bytes
side by side. Bucket-pointer refinement gets there without comparing bytes: initial
buckets are the q-grams (q = ``GRAM``), and a bucket is refined by the identifiers of
the buckets at later offsets, each new identifier being reused for the next step:
id64(i) from id32(i), id32(i + 32), then id100(i) from id64(i), id64(i + 36). An
identifier is a 64-bit hash of the bytes it stands for, so identifiers agree between
tasks without global numbering.

Two steps keep this affordable. First, of every string of LENGTH bytes only one
q-gram, the one with the least hash, is put in an initial bucket (equal strings choose
equal q-grams); q-grams that occur once end there. Second, only strings whose chosen
q-gram occurs again are refined to full depth. In each task the earliest of equal
strings goes on, later ones are marked there; the earliest of all tasks' candidates
is found by one shuffle of packed blocks. So a string in a third of all documents
costs an entry per task. Marks come back as packed runs, and texts are read again to
cut them.

Order is (id, start); whole copies of an earlier document are removed without
refinement. Defined cases: null texts are empty; texts shorter than LENGTH lose
nothing; null ids come first, in no defined order among themselves; rows that repeat
id and text count as the same document, each gives a row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow_rows, shuffle_width, staged, table

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Input bytes for each bucket.
BUCKET_BYTES = 4_000_000
#: Strings after which a task packs what it has.
FLUSH = 1_000_000
#: A text with more than one in so many of all rows is hot.
HOT_SHARE = 512
#: Packed marks up to which they are broadcast; beyond they are shuffled.
BROADCAST_BYTES = 32_000_000

FIRST = "bucket int, id long, row long, n long, digest binary, block binary"
SECOND = "bucket int, chunk long, block binary"
#: Rows of a chunk are numbered alike but for this many bits; what is found of them meets in one task.
CHUNK_BITS = 10


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length as compressed byte planes."""
    import zstandard

    n = len(arrays[0])
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T.tobytes() for a in arrays)
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueezed(block: bytes, kinds: list[str]) -> list[np.ndarray]:
    import zstandard

    n = int.from_bytes(block[:8], "little")
    widths = [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:], max_output_size=max(1, n * sum(widths))), np.uint8)
    out, at = [], 0
    for kind, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(data[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the q-grams at each position."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    prefix = tb.prefix_hash(data)
    return tb.mix((prefix[GRAM:] - prefix[:-GRAM]) * tb.powers(len(prefix), tb.INVERSE, "down")[: len(prefix) - GRAM])


def least_places(ids: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes the place of its least q-gram, the first one of equals.

    Q-grams are compared by the upper half of their identifiers, so value and place
    fit in one number.
    """
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, span = (ids & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(ids), dtype=np.uint64), 1
    while span * 2 <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[WINDOW - span : WINDOW - span + n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def strings_of(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether a string of LENGTH bytes from each place ends in the document that it starts in."""
    inside = np.ones(max(n, 0), bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    return inside


def refined(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Identifiers of the strings of LENGTH bytes at ``starts``, from the q-gram identifiers at later offsets."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tb.mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + tb.mix(b))

    def double(at: np.ndarray) -> np.ndarray:
        return pair(ids[at], ids[at + GRAM])

    return pair(double(starts), double(starts + LENGTH - 2 * GRAM))


def by_bucket(ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and the bounds of each bucket in it."""
    bucket = ((ids >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((ids, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns (id, text) in; a row per document (bucket -1) and blocks of initial buckets out."""
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 36
    names = [c.split()[0] for c in FIRST.split(", ")]
    for batch in batches:
        size, digest, keep = np.zeros(batch.num_rows, np.int64), [], []
        for low, high, data, offsets in tb.chunks(batch.column(1)):
            size[low:high] = np.diff(offsets)
            digest += [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            ids = gram_ids(data)
            at = least_places(ids)
            at = at[strings_of(offsets, len(at))]
            at = np.unique(at[np.concatenate([[True], at[1:] != at[:-1]])]) if len(at) else at
            doc = np.searchsorted(offsets, at, "right") - 1
            keep.append((ids[at], (doc + low).astype(np.uint32), (at - offsets[doc]).astype(np.uint32)))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, -1, np.int32)), batch.column(0), pa.array(base + np.arange(n)), pa.array(size), pa.array(digest, pa.binary()), pa.nulls(n, pa.binary())],
            names=names,
        )
        if keep:
            ids, row, at = (np.concatenate(x) for x in zip(*keep))
            order, cut = by_bucket(ids, buckets)
            made = []
            for b, (x, y) in enumerate(zip(cut, cut[1:])):
                if y > x:
                    some = order[x:y]
                    step = np.diff(ids[some] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype(np.uint32)
                    made.append((b, base.to_bytes(8, "little") + squeezed([step, row[some], at[some]])))
            if made:
                k = len(made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in made], pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([x for _, x in made], pa.binary())],
                    names=names,
                )
        base += n
        keep.clear()
        tb.release()


def by_chunk(row: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """(chunk, block): rows and places, packed for each chunk of rows."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    chunk = row >> CHUNK_BITS
    edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(row) else np.zeros(0, np.int64)
    low = (row & ((1 << CHUNK_BITS) - 1)).astype("<u2")
    blocks = [squeezed([low[a:b], place[a:b].astype("<u4")]) for a, b in zip(edge, [*edge[1:], len(row)])]
    return pd.DataFrame({"chunk": chunk[edge].astype(np.int64), "block": blocks})


def of_rows(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct places) of the rows of one chunk."""
    if not len(frame):
        return
    parts = [unsqueezed(b, ["<u2", "<u4"]) for b in frame.block]
    both = np.unique((np.concatenate([p[0] for p in parts]).astype(np.int64) << 32) | np.concatenate([p[1] for p in parts]))
    row, place = both >> 32, both & 0xFFFFFFFF
    base = int(frame.chunk.iloc[0]) << CHUNK_BITS
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for a, b in zip(edge, [*edge[1:], len(row)]):
        yield base + int(row[a]), place[a:b]


def places_of(frame: pd.DataFrame) -> pd.DataFrame:
    """(row, blocks) with one block of packed places."""
    return pd.DataFrame([(row, [runs_block(places)]) for row, places in of_rows(frame)], columns=["row", "blocks"])


def spans_of(frame: pd.DataFrame) -> pd.DataFrame:
    """(row, blocks) with one block: the removed runs as pairs of 64-bit start and end."""
    return pd.DataFrame([(row, [covered(places)]) for row, places in of_rows(frame)], columns=["row", "blocks"])


def runs_block(values: np.ndarray) -> bytes:
    """Sorted distinct whole numbers, packed: steps between single numbers, or between runs with their lengths, in 2 or 4 bytes."""
    values = np.unique(values)
    edge = np.flatnonzero(np.concatenate([[True], np.diff(values) != 1]))
    length = np.diff(np.concatenate([edge, [len(values)]]))
    starts = values[edge]
    singles = len(edge) * 2 > len(values)
    pairs = [np.diff(values, prepend=0)] if singles else [np.diff(starts, prepend=0), length]
    wide = max(int(x.max(initial=0)) for x in pairs) >= 1 << 16
    return bytes([2 * wide + singles]) + np.column_stack(pairs).astype("<u4" if wide else "<u2").tobytes()


def runs_of(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs."""
    kind, data = block[0], block[1:]
    numbers = np.frombuffer(data, "<u4" if kind & 2 else "<u2").astype(np.int64)
    if kind & 1:
        return np.cumsum(numbers), np.ones(len(numbers), np.int64)
    pairs = numbers.reshape(-1, 2)
    return np.cumsum(pairs[:, 0]), pairs[:, 1]


def repeated(frame: pd.DataFrame) -> pd.DataFrame:
    """(chunk, block) of one bucket's q-grams that occur more than once."""
    ids, rows, places = [], [], []
    for block in frame.block:
        step, row, at = unsqueezed(block[8:], ["<u4", "<u4", "<u4"])
        ids.append(np.cumsum(step, dtype=np.uint32))
        rows.append(row.astype(np.int64) + int.from_bytes(block[:8], "little"))
        places.append(at)
    ids, rows, places = np.concatenate(ids), np.concatenate(rows), np.concatenate(places)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    same = sorted_ids[1:] == sorted_ids[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    made = by_chunk(rows[order[many]], places[order[many]])
    del ids, rows, places, order, sorted_ids
    tb.release()
    return made


def refine(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns (id, text, row, digest, blocks of places) in; blocks of strings and marks found here out."""
    held: list[tuple] = []
    for batch in batches:
        key = np.array([-(2**63) if d is None else d for d in batch.column(0).to_pylist()], np.int64)
        rows, digests, marks = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for low, high, data, offsets in tb.chunks(batch.column(1)):
            ids = gram_ids(data)
            at = least_places(ids)
            wanted = np.zeros(len(ids), bool)
            for i in range(low, high):
                a, b = offsets[i - low], offsets[i - low + 1]
                if hashlib.sha256(data[a:b]).digest() == digests[i]:  # else another text under the same id
                    for block in marks[i]:
                        first, length = runs_of(block)
                        wanted[a + np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())] = True
            starts = np.flatnonzero(strings_of(offsets, len(at)) & wanted[at]) if len(at) else at
            doc = np.searchsorted(offsets, starts, "right") - 1
            held.append((refined(ids, starts), key[low:high][doc], rows[low:high][doc], (starts - offsets[doc]).astype(np.uint32)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from settle(held, buckets)
                held = []
                tb.release()
    if held:
        yield from settle(held, buckets)
        tb.release()


def settle(held: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """Marks of strings that are not the first of their kind here, and blocks of those that are."""
    names = [c.split()[0] for c in SECOND.split(", ")]
    ids, key, row, start = (np.concatenate(x) for x in zip(*held))
    if not len(ids):
        return
    order = np.lexsort((start, key, ids))
    ids, key, row, start = ids[order], key[order], row[order], start[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    # an entry of the first one's document and place (a repeated row) is no later one
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = ~first & ((key != key[lead]) | (start != start[lead]))
    here = by_chunk(row[later], start[later])
    if len(here):
        yield pa.RecordBatch.from_arrays([pa.array((-1 - here.chunk.to_numpy() % buckets).astype(np.int32)), pa.array(here.chunk.to_numpy()), pa.array(here.block.to_list(), pa.binary())], names=names)
    ids, key, row, start = ids[~later], key[~later], row[~later], start[~later]
    # sorted by identifier, so also by bucket
    bucket = ((ids >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    made = []
    for b, (x, y) in enumerate(zip(cut, cut[1:])):
        if y > x:
            used, where = np.unique(row[x:y], return_inverse=True)
            key_of = np.zeros(len(used), np.int64)
            key_of[where] = key[x:y]
            head = squeezed([key_of, used])
            body = squeezed([np.diff(ids[x:y], prepend=np.uint64(0)), where.astype("<u4"), start[x:y]])
            made.append((b, len(head).to_bytes(8, "little") + head + body))
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.nulls(len(made), pa.int64()), pa.array([x for _, x in made], pa.binary())], names=names)


def later_ones(frame: pd.DataFrame) -> pd.DataFrame:
    """(chunk, block) of one bucket's strings that are not the first of their kind; marks made before pass."""
    if frame.bucket.iloc[0] < 0:
        return frame[["chunk", "block"]]
    ids, keys, rows, starts = [], [], [], []
    for block in frame.block:
        size = int.from_bytes(block[:8], "little")
        key, row = unsqueezed(block[8 : 8 + size], ["<i8", "<i8"])
        step, where, start = unsqueezed(block[8 + size :], ["<u8", "<u4", "<u4"])
        ids.append(np.cumsum(step, dtype=np.uint64))
        keys.append(key[where])
        rows.append(row[where])
        starts.append(start)
    ids, keys, rows, starts = map(np.concatenate, (ids, keys, rows, starts))
    order = np.lexsort((starts, keys, ids))
    ids, keys, rows, starts = ids[order], keys[order], rows[order], starts[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = ~first & ((keys != keys[lead]) | (starts != starts[lead]))
    made = by_chunk(rows[later], starts[later])
    del ids, keys, rows, starts, order, lead
    tb.release()
    return made


def covered(starts: np.ndarray) -> bytes:
    """The maximal runs of bytes under strings that start at the sorted places, as pairs of 64-bit start and end."""
    new = np.concatenate([[True], starts[1:] > starts[:-1] + LENGTH])
    first = np.flatnonzero(new)
    return np.column_stack([starts[first], starts[np.concatenate([first[1:] - 1, [len(starts) - 1]])] + LENGTH]).astype("<i8").tobytes()


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns (text, row, digest, blocks) in; (row, n_removed, n_spans, kept_sha256, spans) out."""
    for batch in batches:
        out = []
        rows, digests, marks = (batch.column(k).to_pylist() for k in (1, 2, 3))
        for i, text in enumerate(batch.column(0)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if hashlib.sha256(raw).digest() != digests[i]:
                continue
            starts, ends = np.frombuffer(marks[i][0], "<i8").reshape(-1, 2).T
            kept, at = hashlib.sha256(), 0
            for a, b in zip(starts.tolist(), ends.tolist()):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((rows[i], int((ends - starts).sum()), len(starts), kept.hexdigest(), marks[i][0]))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
            names=["row", "n_removed", "n_spans", "kept_sha256", "spans"],
        )
        tb.release()


def with_originals(docs: DataFrame, order) -> DataFrame:
    """``docs`` with the least id of its text's rows as ``original``, null where the text has one row.

    Texts with more than one in ``HOT_SHARE`` of all rows are fewer than that, so they
    are broadcast and their rows do not meet in a task; all others meet by digest.
    """
    groups = staged(docs.groupBy("digest").agg(F.min(order).alias("original"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "repeat-groups")
    bound = -(-docs.count() // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col("k") > bound).select("digest", "original"))
    rest = groups.filter(F.col("k") <= bound).select("digest", "original")
    return docs.join(hot, "digest").unionByName(docs.join(hot, "digest", "left_anti").join(rest, "digest", "left"))


def with_texts(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """Marks (id, row, digest, blocks) with their texts, broadcast only if their bytes, just summed, are within the bound."""
    total = marks.agg(F.sum(F.expr("aggregate(blocks, 64L, (a, b) -> a + octet_length(b))"))).first()[0] or 0
    side = marks.withColumnRenamed("id", "mark_id")
    return texts.join(F.broadcast(side) if total <= BROADCAST_BYTES else side, F.col("id").eqNullSafe(F.col("mark_id")))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    with arrow_rows(df.sparkSession):
        return _repeats(df, id_col, text_col)


def _repeats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans, kept_sha256, and spans (pairs of
    64-bit start and end of the removed runs, null where none)."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = int(min(max(shuffle_width(spark), -(-size // BUCKET_BYTES)), 100_000))

    first = staged(texts.mapInArrow(lambda b: anchors(b, buckets), FIRST), "repeat-anchors")
    docs = first.filter("bucket = -1").select("id", "row", "n", "digest")
    order = F.coalesce("id", F.lit(-(2**63)))
    docs = staged(with_originals(docs, order).withColumn("copy", F.coalesce(order > F.col("original"), F.lit(False)) & (F.col("n") >= LENGTH)), "repeat-docs")

    found = first.filter("bucket >= 0").groupBy("bucket").applyInPandas(repeated, "chunk long, block binary")
    places = found.groupBy("chunk").applyInPandas(places_of, "row long, blocks array<binary>")
    marks = staged(docs.filter("NOT copy").select("id", "row", "digest").join(places, "row"), "repeat-places")

    joined = with_texts(marks, texts).select("id", "text", "row", "digest", "blocks")
    second = joined.mapInArrow(lambda b: refine(b, buckets), SECOND)
    later = second.groupBy("bucket").applyInPandas(later_ones, "chunk long, block binary")
    starts = later.groupBy("chunk").applyInPandas(spans_of, "row long, blocks array<binary>")
    cuts = staged(docs.select("id", "row", "digest").join(starts, "row"), "repeat-starts")
    done = staged(with_texts(cuts, texts).select("text", "row", "digest", "blocks").mapInArrow(
        cut_texts, "row long, n_removed long, n_spans long, kept_sha256 string, spans binary"
    ), "repeat-cuts").dropDuplicates(["row"])
    out = docs.join(done, "row", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        "spans",
    )


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
