"""Exact n-gram Jaccard join by pivots, regions and triangle-inequality windows.

Jaccard distance is a metric, but unrelated documents are all at distance exactly 1
from each other, so Voronoi regions of whole-set distances would need windows that
hold every document. Regions are therefore made in projections, where pivots do
separate: the shingle universe is split by hash into P parts. A pair whose sets
differ in at most D shingles agrees wholly (distance 0) in at least P - D parts, and
a similarity of 0.8 bounds D by a ninth of both sizes. The pivots of a part are the
projected sets that occur, a document's region is that of the pivot at distance 0.
Sizes are cut into classes, each with its own P; a document near the upper end of its
class is replicated into the next class, the window that keeps pairs across the
boundary. So every linked pair meets in a region, and regions hold hardly anything
but similar documents, however common single shingles or passages are.

Inside the regions the join goes on recursively and exactly. The most central member
of a region is its pivot and is compared with all others; members within the threshold
join its component. All regions with one pivot make its cell. Cells whose members lie in
several components are joined further, each in a task with the whole sets: pivots are
chosen farthest first, a member belongs to its nearest pivot and is replicated to each
pivot that is farther by at most twice the threshold (the triangle inequality: a linked
pair meets at the nearest pivot of either), and these parts are joined alike until they
are small or no longer shrink; what is left is compared with the pivots' distances and
parity sketches as filters, which never rule out a link. Only links between different
components leave a task, a spanning forest: fewer rows than members. Cells that hang
together by common members go to one task as long as they are small, so that a set
travels once; a cell over the bounds is cut into blocks that meet two by two. A document
may leave a few of its most common regions, as many as leave every linked pair a region
to meet in. Links are decided on the whole shingle sets.

Documents with equal shingle sets are one vertex. Signatures travel as packed blocks
of (signature, row), a few bytes each; sets are built once, for documents that share
a region with another, and hardly any other text is shuffled: a bitmap of fixed size says
which rows may be asked for. A pivot with many members is split into chunks.

Defined cases: null, empty and blank texts have no shingles, are their own component
and link with nothing; texts of fewer than five words are one shingle; null ids are
never a component's id unless alone; repeated rows give a row each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import arrow_rows, likely, scratch, shuffle_width, staged, table, with_likely
from .components import components

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sizes of a class differ by this factor at most.
CLASS_RATIO = 1.5
#: Input bytes for each bucket of signatures.
BUCKET_BYTES = 4_000_000
#: Signatures after which a task packs what it has.
FLUSH = 500_000
#: Pairs that a task works on at a time, besides one large pivot.
TASK_ROWS = 2048
#: Members, and shingles of members, of a cell or of a block of one in a task (a larger document is alone in a block).
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1_500_000
#: Pivots of a part inside a task, members up to which it is not parted further, share of its members that a part may keep.
PIVOTS, LEAF, SHRINK = 8, 48, 0.7
#: Tasks over which rows of one body or cell are spread.
SALTS = 64
#: Parts beyond those that the greatest difference calls for, as a share of it.
SPARE = 0.6
#: Members from which a region counts as common; a document may leave some of those, see ``spare``.
COMMON_MEMBERS = 1
#: Places of the greatest parity sketch.
SKETCH_BITS = 1 << 16
#: Documents that one task compares with a pivot.
CHUNK_MEMBERS = 256
PACKED = "bucket int, id long, row long, n long, sid long, spare long, small binary, block binary"


def classes(limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per class: least size, greatest size, greatest difference of a linked pair, parts."""
    low, high = [1], []
    while True:
        high.append(max(low[-1], int(low[-1] * CLASS_RATIO)))
        if high[-1] >= limit:
            break
        low.append(high[-1] + 1)
    high.append(max(high[-1] + 1, int((high[-1] + 1) * CLASS_RATIO)))
    low.append(high[-2] + 1)
    low, high = np.array(low), np.array(high)
    differ = 2 * high * (100 - PERCENT) // (100 + PERCENT)
    parts = differ + 1 + np.where(differ > 0, np.ceil(differ * SPARE).astype(np.int64) + 1, 0)
    return low, high, differ, parts


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, row offsets into them)."""
    data = tb.ascii_lower(data)
    starts, ends = tb.words(data, offsets)
    word = tb.hashes(tb.prefix_hash(data), starts, ends)
    cut = np.searchsorted(starts, offsets)
    n = len(word) - WORDS + 1
    roll = np.zeros(max(n, 0), np.uint64)
    for j in range(WORDS if n > 0 else 0):
        roll = roll * np.uint64(0x100000001B3) + word[j : j + n]
    roll = tb.mix(roll)
    sets = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= WORDS:
            sets.append(np.unique(roll[a : b - WORDS + 1]))
        elif b > a:
            few = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                few = few * np.uint64(0x100000001B3) + w
            sets.append(tb.mix(few))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def set_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; sets are the same if ids are."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(tb.mix(values ^ np.uint64(0x5BF03635)), out=total[1:])
    return tb.mix(total[at[1:]] - total[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64)).astype(np.int64)


def signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit signatures, row of each, regions that each row may leave) of all rows' sets.

    A linked pair agrees in at least s = parts - difference - empty parts places, s
    taken from either document. If each leaves at most (s - 1) / 2 of its regions,
    the pair still meets in one.
    """
    n = np.diff(at)
    spare = np.full(len(n), np.iinfo(np.int64).max)
    if not n.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    low, high, differ, parts = classes(int(n.max()))
    own = np.searchsorted(high, n)
    out_sig, out_row = [], []
    for shift in (0, 1):
        kind = own + shift
        chosen = np.flatnonzero((n > 0) & ((n * 100 // PERCENT >= low[np.minimum(kind, len(low) - 1)]) if shift else True))
        if not len(chosen):
            continue
        kind, size = kind[chosen], n[chosen]
        p = parts[kind]
        base = np.concatenate([[0], np.cumsum(p)])
        local = np.repeat(np.arange(len(chosen)), size)
        where = np.repeat(at[chosen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        v = values[where]
        part = base[local] + (tb.mix(v) % p[local].astype(np.uint64)).astype(np.int64)
        v = tb.mix(v ^ np.uint64(0x27D4EB2F165667C5))
        cells = int(base[-1])
        count = np.bincount(part, minlength=cells)
        lower = np.bincount(part, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
        upper = np.bincount(part, (v >> np.uint64(32)).astype(np.float64), cells).astype(np.uint64)
        owner = np.repeat(np.arange(len(chosen)), p)
        number = np.arange(cells) - base[owner]
        tag = (kind[owner] * 1_000_003 + number).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sig = tb.mix(lower * np.uint64(0xC2B2AE3D27D4EB4F) + upper * np.uint64(0x165667B19E3779F9) + tag)
        blank = p - np.bincount(owner[count > 0], minlength=len(chosen))
        spare[chosen] = np.minimum(spare[chosen], np.maximum(0, (p - differ[kind] - blank - 1) // 2))
        # so many empty parts that agreeing parts might all be empty ones: those count too
        keep = (count > 0) | (blank >= p - differ[kind])[owner]
        out_sig.append(sig[keep])
        out_row.append(chosen[owner[keep]])
    return np.concatenate(out_sig), np.concatenate(out_row), np.where(n > 0, spare, 0)


def sketches(values: np.ndarray, at: np.ndarray, places: int = 4) -> list[bytes]:
    """Per set, the parity of the number of its members at each of about ``places`` * n hashed places.

    The places where two sketches differ are at most as many as the members in
    which the sets differ, so a sketch can rule a link out but never miss one.
    A sketch folded in half is the sketch of half as many places.
    """
    n = np.diff(at)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(places * n, 1))).astype(np.int64), 64, SKETCH_BITS)
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    place = base[owner] + (tb.mix(values ^ np.uint64(0x94D049BB)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    edge = (base // 8).tolist()
    return [odd[a:b] for a, b in zip(edge, edge[1:])]


def fold_sketch(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def even_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches with as many places each, as rows of 64-bit words."""
    bits = int(np.clip(1 << int(np.ceil(np.log2(4 * max(map(len, sets))))), 64, SKETCH_BITS))
    places = ((tb.mix(x ^ np.uint64(0x94D049BB)) & np.uint64(bits - 1)).astype(np.int64) for x in sets)
    return np.stack([np.packbits((np.bincount(x, minlength=bits) & 1).astype(np.uint8)) for x in places]).view(np.uint64)


def pack(sig: np.ndarray, row: np.ndarray, base: int, squeeze) -> bytes:
    """Sorted signatures as differences, rows as offsets from ``base``."""
    order = np.argsort(sig, kind="stable")
    sig, row = sig[order], row[order]
    step = np.diff(sig, prepend=np.uint32(0)).astype("<u4")
    planes = step.view(np.uint8).reshape(-1, 4).T.tobytes() + row.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return struct.pack("<qq", len(sig), base) + squeeze(planes)


def unpack(block: bytes, unsqueeze) -> tuple[np.ndarray, np.ndarray]:
    n, base = struct.unpack_from("<qq", block)
    planes = np.frombuffer(unsqueeze(block[16:], n * 8), np.uint8)
    step = np.ascontiguousarray(planes[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    row = np.ascontiguousarray(planes[4 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(step, dtype=np.uint32), row.astype(np.int64) + base


def describe(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns (id, text) in; a row for each document (bucket -1) and packed signature blocks out."""
    import zstandard
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 36
    squeeze = zstandard.ZstdCompressor(level=1).compress
    names = [c.split()[0] for c in PACKED.split(", ")]

    def flush(sigs: list[np.ndarray], rows: list[np.ndarray], base: int) -> Iterator[pa.RecordBatch]:
        if not sigs:
            return
        sig, row = np.concatenate(sigs), np.concatenate(rows)
        sigs.clear()
        rows.clear()
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        sig, row = (sig[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), row[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        made = [(b, pack(sig[x:y], row[x:y], base, squeeze)) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
        if made:
            n = len(made)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in made], pa.int32()), *(pa.nulls(n, pa.int64()) for _ in range(5)), pa.nulls(n, pa.binary()), pa.array([x for _, x in made], pa.binary())],
                names=names,
            )

    for batch in batches:
        done, sigs, rows, parity, small = 0, [], [], [], []
        sizes, sids, spare = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for low, high, data, offsets in tb.chunks(batch.column(1)):
            values, at = shingle_sets(data, offsets)
            sizes[low:high], sids[low:high] = np.diff(at), set_ids(values, at)
            parity += sketches(values, at)
            small += sketches(values, at, 1)
            # of equal sets in a chunk one sends signatures
            _, first = np.unique(sids[low:high], return_index=True)
            sig, row, spare[low:high] = signatures(values, at)
            sole = np.zeros(high - low, bool)
            sole[first] = True
            sigs.append(sig[sole[row]])
            rows.append(row[sole[row]] + low)
            done = high
            if sum(map(len, sigs)) >= FLUSH:
                yield from flush(sigs, rows, base)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(done, -1, np.int32)),
                batch.column(0),
                pa.array(base + np.arange(done)),
                pa.array(sizes),
                pa.array(sids),
                pa.array(spare),
                pa.array(small, pa.binary()),
                pa.array(parity, pa.binary()),
            ],
            names=names,
        )
        yield from flush(sigs, rows, base)
        base += batch.num_rows
        del sigs, rows, parity, small
        tb.release()


def regions_of(frame: pd.DataFrame) -> pd.DataFrame:
    """(region, row, times) of the regions of one bucket with two rows or more; equal member lists once, with their number."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    parts = [unpack(b, lambda x, size: plain.decompress(x, max_output_size=size)) for b in frame.block]
    sig, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(sig, kind="stable")
    sig, row = sig[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([edge, [len(sig)]]))
    many = size > 1
    owner = np.repeat(np.arange(len(edge)), size)
    keep = many[owner]
    row, owner, size = row[keep], owner[keep], size[many]
    if not len(row):
        return pd.DataFrame({"region": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)})
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    name = tb.mix(np.add.reduceat(tb.mix(row.astype(np.uint64)), first) + size.astype(np.uint64)).astype(np.int64)
    _, once, times = np.unique(name, return_index=True, return_counts=True)
    count = np.zeros(len(size), np.int64)
    count[once] = times
    count = np.repeat(count, size)
    pick = count > 0
    made = pd.DataFrame({"region": np.repeat(name, size)[pick], "row": row[pick], "times": count[pick]})
    del parts, sig, row, order, owner, keep, count, pick
    tb.release()
    return made


def build_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tb.chunks(batch.column(1)):
            values, at = shingle_sets(data, offsets)
            blocks = [values[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, at)), pa.array(np.diff(at)), pa.array(blocks, pa.binary())], names=["sid", "n", "members"])
        tb.release()


def compare(a, n, members, b, pivot_n, pivot_members):
    """(a, b, both, na, nb): sizes of the intersections of all sets with the pivot's."""
    pivot = np.frombuffer(pivot_members, np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in members]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    both = np.add.reduceat((pivot[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return a, np.full(len(a), b), both, sizes, np.full(len(a), len(pivot))


class Part:
    """Sets of one task's group, numbered from 0, with the component of each."""

    def __init__(self, sid: np.ndarray, comp: np.ndarray, block: np.ndarray, members: list[bytes], across: bool):
        self.sid, self.block, self.across = sid, block, across
        self.label = np.unique(comp, return_inverse=True)[1]
        sets = [np.frombuffer(x, np.uint64) for x in members]
        self.size = np.array([len(x) for x in sets], np.int64)
        values = np.concatenate(sets)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.parity = even_sketches(sets)
        known, self.ids = np.unique(values, return_inverse=True)
        self.mark = np.zeros(len(known), bool)
        self.links: list[tuple[int, int]] = []

    def shared(self, pivot: int, some: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pivot's set with those of ``some``; unites the linked ones."""
        own = self.ids[self.at[pivot] : self.at[pivot + 1]]
        size = self.size[some]
        first = np.cumsum(size) - size
        where = np.repeat(self.at[some] - first, size) + np.arange(int(size.sum()))
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.ids[where]].astype(np.int64), first)
        self.mark[own] = False
        for other in some[both * 100 >= (size + len(own) - both) * PERCENT].tolist():
            if self.label[other] != self.label[pivot]:
                self.links.append((int(self.sid[pivot]), int(self.sid[other])))
                self.label[self.label == self.label[other]] = self.label[pivot]
        return both

    def join(self, some: np.ndarray) -> None:
        """All links among ``some`` that join components."""
        if len(some) < 2 or (self.label[some] == self.label[some[0]]).all():
            return
        if len(some) <= LEAF:
            return self.compare(some, np.zeros((0, len(some))))
        away = []
        pivot = 0
        for _ in range(PIVOTS):
            both = self.shared(int(some[pivot]), some)
            away.append(1 - both / (self.size[some] + self.size[some[pivot]] - both))
            near = np.min(away, axis=0)
            pivot = int(np.argmax(near))
        far = np.stack(away)
        inside = far <= near + 2 * (100 - PERCENT) / 100 + 1e-9
        if inside.sum(axis=1).max() > SHRINK * len(some):
            return self.compare(some, far)
        for k in np.unique(np.argmin(far, axis=0)):
            self.join(some[inside[k]])

    def compare(self, some: np.ndarray, far: np.ndarray) -> None:
        """Every pair of ``some`` in different components that sizes, distances to pivots and sketches allow."""
        size = self.size[some]
        for i, one in enumerate(some[:-1].tolist()):
            rest = np.arange(i + 1, len(some))
            rest = rest[self.label[some[rest]] != self.label[one]]
            if self.across:
                rest = rest[self.block[some[rest]] != self.block[one]]
            rest = rest[np.minimum(size[rest], size[i]) * 100 >= np.maximum(size[rest], size[i]) * PERCENT]
            if len(far):
                rest = rest[(np.abs(far[:, rest] - far[:, i : i + 1]) <= (100 - PERCENT) / 100 + 1e-9).all(axis=0)]
            apart = np.bitwise_count(self.parity[some[rest]] ^ self.parity[one]).sum(axis=1, dtype=np.int64)
            rest = rest[apart * (100 + PERCENT) <= (size[rest] + size[i]) * (100 - PERCENT)]
            if len(rest):
                self.shared(one, some[rest])


def forest(frame: pd.DataFrame) -> pd.DataFrame:
    """(u, v): links that join components, of the cells or pairs of blocks of one task."""
    frame = frame.drop_duplicates(["key", "low", "high", "sid"]).sort_values(["key", "low", "high", "sid"])
    key, low, high = (frame[k].to_numpy() for k in ("key", "low", "high"))
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    sid, comp, block, members = (frame[k].to_numpy() for k in ("sid", "comp", "block", "members"))
    links = []
    for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(frame)]):
        if y - x > 1 and (comp[x:y] != comp[x]).any():
            part = Part(sid[x:y], comp[x:y], block[x:y], members[x:y], low[x] != high[x])
            part.join(np.arange(y - x))
            links += part.links
    tb.release()
    return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["u", "v"])


def spread_left(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with what ``few`` keys have; rows of one key are spread over SALTS tasks by sid."""
    each = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS))).join(each, [key, "salt"], "left").drop("salt")


def cell_links(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of staged cells (pivot, sid, n, comp): links that join components."""
    least = cells.groupBy("pivot").agg(F.min("comp").alias("v"))
    body = components(cells.join(least, "pivot").select(F.col("comp").alias("u"), "v"))
    named = cells.join(body.select(F.col("u").alias("comp"), "v"), "comp", "left").withColumn("body", F.coalesce("v", "comp"))
    weight = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")]
    over = (F.col("m") > BLOCK_MEMBERS) | (F.col("w") > BLOCK_SHINGLES)
    large = named.select("body", "sid", "n").distinct().groupBy("body").agg(*weight).filter(over).select("body", F.lit(True).alias("large"))
    keyed = spread_left(named, large, "body").withColumn("key", F.when(F.col("large"), F.xxhash64(F.lit("pivot"), "pivot")).otherwise(F.xxhash64(F.lit("body"), "body")))
    keyed = keyed.select("key", "sid", "n", "comp").distinct()
    blocks = keyed.groupBy("key").agg(*weight).filter(over).select("key", F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("w") / BLOCK_SHINGLES)).alias("blocks"))
    cut = spread_left(keyed, blocks, "key").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = staged(cut.select("key", "sid", "n", "comp", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")), "near-cells")
    tasks = max(1, -(-int(cut.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES))
    full = cut.drop("n").join(likely(sets.select("sid", "members"), "sid", cut, "sid"), "sid").withColumn("task", F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks)))
    return full.groupBy("task").applyInPandas(forest, "u long, v long")


def meet(pairs: DataFrame, sets: DataFrame, judge, schema: str) -> DataFrame:
    """``judge`` over staged (a, b, m) with what ``sets`` (sid, n, members) has of both.

    A pivot b is split into chunks by m, at least the number of its a that come from
    one region; many small pivots share a task.
    """
    tasks = max(1, -(-pairs.count() // TASK_ROWS))
    chunk = F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / CHUNK_MEMBERS))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b", chunk), F.lit(tasks)).alias("task"))
    left = dealt.join(sets.select(F.col("sid").alias("a"), "n", "members"), "a")
    asked = likely(sets.select("sid", "n", "members"), "sid", dealt, "b")
    pivots = asked.select(F.col("sid").alias("p"), F.col("n").alias("pivot_n"), F.col("members").alias("pivot_members"))
    right = dealt.select(F.col("b").alias("p"), F.col("task").alias("at")).distinct().join(pivots, "p")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = {p: (n, members) for p, n, members in zip(right.p, right.pivot_n, right.pivot_members)}
        left = left.sort_values(["b", "a"])
        b = left.b.to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
        a, n, members = left.a.to_numpy(), left.n.to_numpy(), left.members.to_numpy()
        rows = [judge(a[x:y], n[x:y], members[x:y], int(b[x]), *own[b[x]]) for x, y in zip(edge, [*edge[1:], len(b)]) if b[x] in own]
        columns = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(columns, zip(*rows))}) if rows else pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})

    return left.groupBy("task").cogroup(right.groupBy("at")).applyInPandas(run, schema)


def allowed(a, n, members, b, pivot_n, pivot_members):
    """(a, b, m) of the m pairs of one chunk of a pivot whose sketches allow a link."""
    pivot = np.frombuffer(pivot_members, np.uint8)
    keep = np.zeros(len(a), bool)
    for i, sketch in enumerate(members):
        own = np.frombuffer(sketch, np.uint8)
        both = min(len(own), len(pivot))
        apart = int(np.bitwise_count(fold_sketch(own, both) ^ fold_sketch(pivot, both)).sum())
        keep[i] = apart * (100 + PERCENT) <= (n[i] + pivot_n) * (100 - PERCENT)
    return a[keep], np.full(keep.sum(), b), np.full(keep.sum(), keep.sum())


def may_link(na, nb):
    """Whether two sizes allow a link at all."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT


def leave_common(members: DataFrame) -> DataFrame:
    """``members`` (region, sid, n, spare, times, m) without the largest regions that a document may leave."""
    common = members.filter(f"m > {COMMON_MEMBERS}")
    by_size = Window.partitionBy("sid").orderBy(F.desc("m"), "region").rowsBetween(Window.unboundedPreceding, 0)
    stay = common.withColumn("left", F.sum("times").over(by_size)).filter("left > spare")
    return members.filter(f"m <= {COMMON_MEMBERS}").unionByName(stay.drop("left")).select("region", "sid", "n")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row per row of ``df``, named id_col, n_shingles, component_id."""
    with arrow_rows(df.sparkSession):
        return _near_groups(df, id_col, text_col)


def _near_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = int(min(max(shuffle_width(spark), -(-size // BUCKET_BYTES)), 100_000))

    packed = staged(texts.mapInArrow(lambda b: describe(b, buckets), PACKED), "near-packed")
    docs = packed.filter("bucket = -1").select("id", "row", "n", "sid")
    blocks = packed.filter("bucket >= 0").select("bucket", "block")

    found = blocks.groupBy("bucket").applyInPandas(regions_of, "region long, row long, times long")
    found = found.groupBy("region", "row").agg(F.sum("times").alias("times"))
    spared = packed.filter("bucket = -1").select("row", "sid", "n", "spare")
    members = found.join(spared, "row").groupBy("region", "sid", "n", "spare").agg(F.max("times").alias("times"))
    members = staged(members, "near-found")
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = staged(leave_common(members.join(size, "region")), "near-stay")
    # the pivot is the member that shares the most regions with the most others, so it is central
    share = members.join(members.groupBy("region").agg(F.count(F.lit(1)).alias("m")), "region").groupBy("sid").agg(F.sum("m").alias("share"))
    several = (
        members.join(share, "sid").groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.max_by("sid", F.struct("share", "sid")).alias("pivot")).filter("m > 1")
    )
    members = staged(members.join(several, "region"), "near-members")

    # the documents that share a region, each set once: their sketches and sets
    known = members.select("sid").distinct()
    first = staged(docs.join(known, "sid", "left_semi").groupBy("sid").agg(F.min("row").alias("row")).select("row"), "near-first")
    sole = packed.filter("bucket = -1").select("sid", "id", "row", "n", F.col("block").alias("members"))
    sketched = staged(likely(sole, "row", first, "row").join(first, "row", "left_semi").drop("row"), "near-sketched")
    # a set that nobody asks for, of a text that was only likely, meets nothing in the joins by sid
    asked = likely(texts, "id", sketched, "id")
    sets = staged(asked.mapInArrow(build_sets, "sid long, n long, members binary"), "near-sets")

    sizes = members.select("sid", "n").distinct()
    star = members.filter("sid <> pivot").groupBy(F.col("sid").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("na")).agg(F.max("m").alias("m"))
    star = star.join(sizes.select(F.col("sid").alias("b"), F.col("n").alias("nb")), "b").filter(may_link(F.col("na"), F.col("nb"))).select("a", "b", "m")
    star = staged(meet(staged(star, "near-edges"), sketched, allowed, "a long, b long, m long"), "near-star")
    judged = meet(star, sets, compare, "a long, b long, both long, na long, nb long")
    linked = judged.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * PERCENT)
    links = staged(linked.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "near-links")
    label = components(links)

    # what is left: cells with members of two components or more, without their pivot
    open_ = members.filter("m > 2 AND sid <> pivot").select("pivot", "sid", "n").distinct()
    named = open_.join(label.select(F.col("u").alias("sid"), F.col("v").alias("comp")), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    mixed = named.groupBy("pivot").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("pivot")
    more = staged(cell_links(staged(named.join(mixed, "pivot"), "near-open"), sets), "near-more")
    label = components(label.unionByName(more))

    per_set = docs.filter("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    named = per_set.join(label.select(F.col("u").alias("sid"), F.col("v").alias("comp")), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    named = staged(named, "near-sets-named")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "comp").select("sid", "component_id")
    out = docs.join(by_set, "sid", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay when each group of linked documents keeps its row of least id."""
    names = df.columns
    rows = staged(df.select(F.monotonically_increasing_id().alias("__el_row"), F.struct(*names).alias("__el_all")), "near-rows")
    keyed = rows.select("__el_row", F.col(f"__el_all.`{id_col}`").alias("__el_id"), F.col(f"__el_all.`{text_col}`").alias("__el_text"))
    with scratch(df.sparkSession) as made:
        groups = near_groups(keyed, "__el_row", "__el_text").join(keyed.select("__el_row", "__el_id"), "__el_row")
        order = F.struct(F.col("__el_id").isNull().alias("none"), "__el_id", "__el_row")
        leads = groups.groupBy("component_id").agg(F.min(order).alias("lead"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        gone = staged(groups.join(leads, "component_id").filter(F.col("__el_row") != F.col("lead.__el_row")).select("__el_row"), "near-gone")
        made.pop()
    marked = with_likely(rows, "__el_row", gone, "__el_row")
    stay = marked.filter("NOT __el_likely").unionByName(marked.filter("__el_likely").join(gone, "__el_row", "left_anti"))
    return stay.select("__el_all.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
