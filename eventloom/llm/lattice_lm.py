"""Language-model scores by subword lattice likelihood.

A word's lattice has an arc for every piece of an existing vocabulary that matches
at a place; single bytes are pieces too, so there is always a way through. Arcs are
weighted by unigram scores, and a forward recursion in log space sums over all
segmentations: the result is the marginal probability of the word. Pieces do not
cross white space, so a document's log probability is the sum over its words plus
that of the end.

The vocabulary and its order are fixed. Its scores are ranks, so they first become
Zipf weights; ``ROUNDS`` rounds of expectation maximisation over the words of all
training documents (counted by one shuffle, each distinct word weighted by its count)
then make them probabilities: first pieces of a word among themselves, later pieces and
the word's end among themselves. A document goes on or ends with the share of ends among
the training tokens, so ``score`` is a proper distribution over texts and nothing but the
lattice. Beside it, ``word_score`` gives a word that training documents hold one more arc
over the whole word, with its share of all tokens; Witten-Bell's estimate of new words
says how much weight spelling gets beside it. Only the piece weights, of the vocabulary's
fixed size, ever reach the driver.

Each distinct word is scored once. The ``FREQUENT`` most frequent words (a fixed
bound) are sent to the tasks; all others meet their documents in one shuffle of packed
blocks (word hash, row, times), and partial sums return by blocks of documents, so a
word that every document has costs nothing and no document is expanded.

Defined cases: null and empty texts have the end only; without training documents
all counts are 0, the weights are those of the ranks and a text ends with probability
a half; null ids learn and are never held out; rows that repeat an id are
scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import LOWER, UPPER, fold, shuffle_width, staged, table
from .repeats import squeezed, unsqueezed

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
#: Words sent to every task.
FREQUENT = 50_000
#: Words up to this many bytes are scored together with others of their length.
TOGETHER = 48
#: Input bytes for each bucket of words.
BUCKET_BYTES = 8_000_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CASE = str.maketrans(UPPER, LOWER)
ALPHA = 0.01


def pieces(vocabulary: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as bytes in the order of their scores, a word's start being a space; all single bytes last."""
    import public_tokenizers
    import sentencepiece

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            text = model.id_to_piece(i).replace("▁", " ").encode()
            if text and b" " not in text[1:]:
                found.setdefault(text, model.get_score(i))
    ordered = sorted(found, key=lambda t: -found[t])
    return ordered + [bytes([b]) for b in range(256) if bytes([b]) not in found]


class Lattice:
    """Pieces, their log weights, and vectorised forward and backward recursions."""

    BITS = 19

    def __init__(self, texts: list[bytes]) -> None:
        self.size = len(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        keys = tb.hashes(tb.prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends)
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        left = np.arange(self.size)
        for shift in (0, 13, 27, 41, 5, 33):
            slot = ((keys[left] >> np.uint64(shift)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
            ids, tags = np.full(1 << self.BITS, -1, np.int32), np.zeros(1 << self.BITS, np.uint64)
            ids[slot], tags[slot] = left, keys[left]
            self.tables.append((shift, ids, tags))
            left = left[ids[slot] != left]
            if not len(left):
                break
        self.longest = max(map(len, texts))
        self.opens = np.array([t[:1] == b" " for t in texts])
        self.stop = 0.0
        self.set(1 / (np.arange(self.size) + 10.0), 0.05)
        #: Natural logs of the weight of spelling, and of a whole-word arc's weight by times seen.
        self.spell, self.whole = 0.0, -np.inf

    def set(self, uses: np.ndarray, words: float) -> None:
        """Weights from uses of the pieces and the number of words they spell."""
        later = uses[~self.opens].sum() + words
        self.weights = np.log(uses / np.where(self.opens, uses[self.opens].sum(), later))
        self.stop = float(np.log(words / later))

    def probability(self, block: np.ndarray) -> np.ndarray:
        """Log probabilities of words of one length, over all segmentations."""
        return self.forward(block)[0][-1] + self.stop

    def with_words(self, spelled: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Log probabilities with an arc over the whole word, by the times that it was seen."""
        with np.errstate(divide="ignore"):
            return np.logaddexp(spelled + self.spell, np.log(seen) + self.whole)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for shift, ids, tags in self.tables:
            slot = ((keys >> np.uint64(shift)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
            hit = tags[slot] == keys
            out[hit] = ids[slot[hit]]
        return out

    def arcs(self, block: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of a block of words of one length, in order of the end."""
        n, length = block.shape
        powers, down = tb.powers(length + 1, tb.MULTIPLIER, "up"), tb.powers(length + 1, tb.INVERSE, "down")
        prefix = np.zeros((n, length + 1), np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * powers[:length], axis=1, out=prefix[:, 1:])
        for end in range(1, length + 1):
            for start in range(max(0, end - self.longest), end):
                found = self.find(tb.mix((prefix[:, end] - prefix[:, start]) * down[start] + np.uint64(end - start)))
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    yield start, end, rows, found[rows]

    def forward(self, block: np.ndarray) -> tuple[np.ndarray, list]:
        n, length = block.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        kept = []
        for start, end, rows, piece in self.arcs(block):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.weights[piece])
            kept.append((start, end, rows, piece))
        return alpha, kept

    def expect(self, block: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece."""
        alpha, kept = self.forward(block)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        out = np.zeros(self.size)
        for start, end, rows, piece in reversed(kept):
            through = self.weights[piece] + beta[end, rows]
            beta[start, rows] = np.logaddexp(beta[start, rows], through)
            share = np.exp(alpha[start, rows] + through - alpha[-1, rows]) * times[rows]
            out += np.bincount(piece, share, self.size)
        return out


def blocks_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words of one length, their bytes with a leading space), at most 20000 words at a time."""
    data = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(d) for d in data], np.int64)
    order = np.argsort(sizes, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(sizes[order]) > 0])) if len(order) else []
    for a, b in zip(edge, [*edge[1:], len(order)]):
        length = int(sizes[order[a]])
        step = max(1, min(20_000, 20_000 * TOGETHER // length))
        for i in range(a, b, step):
            some = order[i : min(b, i + step)]
            yield some, np.frombuffer(b"".join(data[k] for k in some), np.uint8).reshape(len(some), length)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, seen) with the count in training documents, 0 for words of others only. Columns: learn, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned, other = Counter(), set()
            for learn, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = WORDS.findall((text.as_py() or "").translate(CASE))
                if learn:
                    learned.update(found)
                else:
                    other.update(found)
            for w in other:
                learned.setdefault(w, 0)
            words = list(learned)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([learned[w] for w in part], pa.int64())], names=["word", "seen"])

    return docs.select("learn", "text").mapInArrow(count, "word string, seen long").groupBy("word").agg(F.sum("seen").alias("seen"))


def learn(counts: DataFrame, lattice: Lattice, tokens: int, kinds: int) -> None:
    """Sets the weights of the pieces from the words seen, and how whole words count beside them."""
    context = counts.sparkSession.sparkContext
    if not kinds:
        return
    for _ in range(ROUNDS):
        sent = context.broadcast(lattice)

        def expect(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own = sent.value
            sums = np.zeros(own.size + 1)
            for frame in frames:
                seen = frame.seen.to_numpy(np.float64)
                for some, block in blocks_of(frame.word.tolist()):
                    sums[:-1] += own.expect(block, seen[some])
                    sums[-1] += seen[some].sum()
            used = np.flatnonzero(sums)
            yield pd.DataFrame({"piece": used, "uses": sums[used]})

        rows = counts.filter("seen > 0").mapInPandas(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full(lattice.size + 1, ALPHA)
        uses[rows.piece.to_numpy(np.int64)] += rows.uses.to_numpy()
        lattice.set(uses[:-1], uses[-1])
    fresh = kinds / (tokens + kinds)
    lattice.spell, lattice.whole = float(np.log(fresh)), float(np.log((1 - fresh) / tokens))


def word_hash(words: list[str]) -> np.ndarray:
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b"".join(data), np.uint8)
    return tb.hashes(tb.prefix_hash(joined), np.concatenate([[0], ends[:-1]]), ends)


def score_words(counts: DataFrame, lattice: Lattice, buckets: int) -> DataFrame:
    """(bucket, key, seen, logp, wordp) of every word: key is its hash, logp and wordp its log10 probabilities by the lattice and with whole words."""
    sent = counts.sparkSession.sparkContext.broadcast(lattice)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            words, seen = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            out = np.zeros(len(words))
            for some, block in blocks_of(words):
                out[some] = own.probability(block)
            key = word_hash(words)
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(key.astype(np.int64)), batch.column(1), pa.array(out / np.log(10)), pa.array(own.with_words(out, seen) / np.log(10))],
                names=["bucket", "key", "seen", "logp", "wordp"],
            )

    return counts.select("word", "seen").mapInArrow(score, "bucket int, key long, seen long, logp double, wordp double")


DOCS = "bucket int, chunk long, id long, place int, held_out boolean, tokens long, known long, base double, model double, whole double, block binary"


def split_documents(batches: Iterator[pa.RecordBatch], keys: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns (id, held_out, text) in; per document what the frequent words give (bucket -1), and blocks of the other words."""
    from pyspark import TaskContext

    context = TaskContext.get()
    chunk = (context.partitionId() if context else 0) << 32
    names = [c.split()[0] for c in DOCS.split(", ")]
    empty = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    for batch in batches:
        n = batch.num_rows
        tokens, sums, rest = np.zeros(n, np.int64), np.zeros((n, 4)), []
        for low, high, data, offsets in tb.chunks(batch.column(2)):
            data = tb.ascii_lower(data)
            starts, ends = tb.words(data, offsets)
            key = tb.hashes(tb.prefix_hash(data), starts, ends)
            doc = np.searchsorted(offsets, starts, "right") - 1 + low
            tokens += np.bincount(doc, minlength=n)
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            for k in range(4):
                sums[:, k] += np.bincount(doc[hit], values[at[hit], k], n)
            rest.append((key[~hit], doc[~hit].astype(np.uint32)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, chunk)), batch.column(0), pa.array(np.arange(n, dtype=np.int32)), batch.column(1), pa.array(tokens)]
            + [pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2]), pa.array(sums[:, 3]), pa.nulls(n, pa.binary())],
            names=names,
        )
        key, doc = (np.concatenate(x) for x in zip(*rest)) if rest else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([new, [len(key)]])).astype(np.uint32)
        key, doc = key[new], doc[new]
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        made = [(b, squeezed([np.diff(key[x:y], prepend=np.uint64(0)), doc[x:y], times[x:y]])) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
        if made:
            k = len(made)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in made], pa.int32()), pa.array(np.full(k, chunk)), *(pa.nulls(k, kind) for kind in empty), pa.array([x for _, x in made], pa.binary())],
                names=names,
            )
        chunk += 1


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score); learns from rows whose fold is not 1."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(fold(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = int(min(max(shuffle_width(spark), -(-size // BUCKET_BYTES)), 100_000))

    counts = staged(word_counts(docs.select((~F.col("held_out")).alias("learn"), "text")), "lm-counts")
    ends = docs.filter("NOT held_out").count()
    all_words, kinds = counts.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.count_if(F.col("seen") > 0)).first()
    tokens, kinds = all_words + ends, kinds + (ends > 0)
    lattice = Lattice(pieces(vocabulary))
    learn(counts, lattice, tokens, kinds)
    share = ends / tokens if ends else 0.5
    end_model, go_on = float(np.log10(share)), float(np.log10(1 - share)) if share < 1 else 0.0
    end_whole = float((np.log(ends) + lattice.whole) / np.log(10)) if ends else float(np.log10(0.5))
    log_all = float(np.log10(tokens + 0.5 * (kinds + 1)))
    words = staged(score_words(counts, lattice, buckets), "lm-words")

    top = words.filter("seen > 0").orderBy(F.desc("seen"), "key").limit(FREQUENT).toPandas()
    key = top.key.to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(key)
    values = np.column_stack([np.ones(len(top)), np.log10(top.seen.to_numpy() + 0.5) - log_all, top.logp.to_numpy(np.float64), top.wordp.to_numpy(np.float64)])[order]
    sent = spark.sparkContext.broadcast((key[order], values))
    parts = staged(docs.mapInArrow(lambda b: split_documents(b, *sent.value, buckets), DOCS), "lm-parts")

    def look_up(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = right.key.to_numpy(np.int64).astype(np.uint64)
        by = np.argsort(known)
        known, seen, logp, wordp = known[by], *(right[c].to_numpy()[by] for c in ("seen", "logp", "wordp"))
        base = np.log10(seen + 0.5) - log_all
        for chunk, block in zip(left.chunk, left.block):
            step, doc, times = unsqueezed(block, ["<u8", "<u4", "<u4"])
            at = np.searchsorted(known, np.cumsum(step, dtype=np.uint64))
            used, where = np.unique(doc, return_inverse=True)
            sums = [np.bincount(where, v * times, len(used)) for v in ((seen[at] > 0).astype(np.float64), base[at], logp[at], wordp[at])]
            out.append((chunk, squeezed([used, *sums])))
        return pd.DataFrame(out, columns=["chunk", "block"])

    rest = parts.filter("bucket >= 0").select("bucket", "chunk", "block").groupBy("bucket").cogroup(words.groupBy("bucket")).applyInPandas(look_up, "chunk long, block binary")

    def add_up(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("place")
        sums = np.zeros((len(left), 4))
        for block in sorted(right.block):
            used, *values = unsqueezed(block, ["<u4", "<f8", "<f8", "<f8", "<f8"])
            for k in range(4):
                sums[used, k] += values[k]
        return pd.DataFrame(
            {
                "id": left.id,
                "held_out": left.held_out,
                "n_tokens": left.tokens + 1,
                "n_known": left.known + sums[:, 0].astype(np.int64) + int(ends > 0),
                "base_score": left.base + sums[:, 1] + np.log10(ends + 0.5) - log_all,
                "score": left.model + sums[:, 2] + left.tokens * go_on + end_model,
                "word_score": left.whole + sums[:, 3] + end_whole,
            }
        )

    mine = parts.filter("bucket = -1").drop("bucket", "block")
    done = mine.groupBy("chunk").cogroup(rest.groupBy("chunk")).applyInPandas(
        add_up, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word_score double"
    )
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "word_score")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
