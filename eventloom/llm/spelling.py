"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by Aho-Corasick halves.

Words are counted in one pass over the texts; a task hands on its counts whenever it
holds ``HELD`` words, so its memory is bounded and frequent words are summed before
they are shuffled.

A word is cut in two segments. One edit leaves one of them as it was, so a near word
begins with the first or ends with the second. Automaton shards hold every word's two
segments; each word is scanned by the shards that could hold a segment of a word of its
length or one more or less (a shard is a hash of the segment, so a word visits at most
six). A hit counts if the segment lies at the word's beginning or end, the lengths
differ by one at most, and the rest differs by exactly one edit.

A segment that more than ``HOT`` entries share would make all their pairs meet. Its
words are cut again: the part between what they are known to share is halved, and the
near word must also hold one of those halves at its place. This goes on until no
segment is hot or nothing is left to cut (words that share all but one letter are no
more than there are letters), so no group grows with the vocabulary.

A word's form is its most frequent near word if that is at least twice as frequent.
Counts double along a chain of forms, so chains have fewer than 64 steps and roots are
found by a few pointer jumps.

Defined cases: null and empty texts have no words; a null id counts as the empty text
in front of the colon; repeated rows count each time; ties in frequency go to the
smaller word in code-point order; empty tables give empty results; other columns are
not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, shuffle_width, staged, table
from .importance import CRC_SQL, crc_sql

#: One run in so many loses a letter (by a hash of id and run).
DROP_EVERY = 97
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
#: Entries (words of near lengths) that may share a segment before they are cut again.
HOT = 1000
#: Pairs that are compared one by one, and letters that are compared at once.
FEW, CELLS = 24, 4_000_000
#: Entries of a shard, about.
SHARD_ENTRIES = 50_000

#: In Latin-1, where a byte is a code point: letters stay (A-Z in lower case), others become spaces.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0xC0 or 97 <= c <= 122 else 32 for c in range(256))


def lettered(text: str | None) -> list[bytes]:
    """The runs of letters in lower case, a byte a letter; characters beyond Latin-1 become '?', which is none."""
    return (text or "").encode("latin-1", "replace").translate(_BYTES).split()


def altered(run: bytes, prefix_crc: int) -> bytes:
    """The run without one letter if the hash of id and run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix_crc)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): words of at least ``letters`` letters that occur at least ``least`` times."""

    def handed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in Counter(lettered(text.as_py())).items():
                    word = altered(found, crc)
                    if len(word) >= letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield handed(held)
                    held = Counter()
        yield handed(held)

    counted = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    at = next((i for i, c in enumerate(short) if c != long[i]), len(short))
    return short[at + (len(short) == len(long)) :] == long[at + 1 :]


# A role of a word of ``size`` letters: it is known to share its first ``head`` and last ``tail`` letters with the near word.
ROLE = "size int, head int, tail int"


def _role(word: Column, size: Column, head: Column, tail: Column) -> Column:
    """The key under which a word is filed: size, and what it has at both ends; null where it is too short for them."""
    fits = (head >= 0) & (tail >= 0) & (F.length(word) >= head + tail) & (F.abs(F.length(word) - size) <= 1)
    key = F.concat_ws(" ", size, F.substring(word, F.lit(1), head), F.when(tail > 0, F.substring(word, F.length(word) - tail + 1, tail)).otherwise(F.lit("")), head)
    return F.when(fits, key)


def halves(size: Column, head: Column, tail: Column) -> Column:
    """The two ways in which what lies between head and tail of a word of ``size`` letters can be halved."""
    middle = size - head - tail
    half = F.floor(middle / 2).cast("int")
    return F.array(
        F.struct((head + half).alias("head"), tail.alias("tail"), F.lit(True).alias("front")),
        F.struct(head.alias("head"), (tail + middle - half).cast("int").alias("tail"), F.lit(False).alias("front")),
    )


def filed(words: DataFrame) -> DataFrame:
    """(word, own, size, head, tail, front, key): every word under its two segments (own), and under those that words of near lengths would share with it."""
    sized = words.select("word", F.explode(F.array(*[F.length("word") + d for d in (-1, 0, 1)])).alias("size"))
    cut = sized.select("word", (F.length("word") == F.col("size")).alias("own"), "size", F.explode(halves(F.col("size"), F.lit(0), F.lit(0))).alias("h"))
    return _keyed(cut)


def _keyed(cut: DataFrame) -> DataFrame:
    out = cut.select("word", "own", "size", F.col("h.head").alias("head"), F.col("h.tail").alias("tail"), F.col("h.front").alias("front"))
    return out.withColumn("key", _role(F.col("word"), F.col("size"), F.col("head"), F.col("tail"))).filter("key IS NOT NULL")


def refined(entries: DataFrame, hot: int = HOT) -> DataFrame:
    """Entries whose keys are cut again as long as more than ``hot`` entries have them and a middle of two letters or more is left."""
    done = None
    while True:
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("own").alias("owned"), F.first(F.col("size") - F.col("head") - F.col("tail")).alias("middle"))
        heavy = staged(sizes.filter((F.col("n") > hot) & (F.col("middle") >= 2)).select("key", "owned"), "hot-segments")
        if heavy.isEmpty():
            return entries if done is None else done.unionByName(entries)
        cold = entries.join(heavy, "key", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        # where nobody owns the segment, nothing is to be found
        again = entries.join(heavy.filter("owned"), "key", "left_semi").select("word", "own", "size", F.explode(halves(F.col("size"), F.col("head"), F.col("tail"))).alias("h"))
        entries = staged(_keyed(again), "segments")


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def one_edit_pairs(owners: list[str], scanned: list[str]) -> Iterator[tuple[str, str]]:
    """(scanned, owner) pairs that are one edit apart; the owners have one length."""
    if len(owners) * len(scanned) <= FEW:
        yield from ((x, y) for x in scanned for y in owners if one_edit(x, y))
        return
    own, size = _letters(owners), len(owners[0])
    by_length = defaultdict(list)
    for w in scanned:
        by_length[len(w)].append(w)
    for length, words in by_length.items():
        step = max(1, CELLS // (len(owners) * max(size, length)))
        for at in range(0, len(words), step):
            part = words[at : at + step]
            other = _letters(part)
            if length == size:
                fits = (other[:, None, :] != own[None, :, :]).sum(axis=2) == 1
            else:
                short, long = (other[:, None, :], own[None, :, :]) if length < size else (own[None, :, :], other[:, None, :])
                # what is equal from the front and from the back together covers the shorter word
                front = np.minimum.accumulate(short == long[..., :-1], axis=2).sum(axis=2)
                back = np.minimum.accumulate((short == long[..., 1:])[..., ::-1], axis=2).sum(axis=2)
                fits = front + back >= min(length, size)
            yield from ((part[i], owners[k]) for i, k in zip(*np.nonzero(fits)))


def scan_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, near) of one shard: an automaton of the owners' segments runs over all words of the shard."""
    import ahocorasick

    # segment -> places of its owners: (front, size, head, tail) -> what stands at the other end -> number of the group
    places: dict[str, dict[tuple[bool, int, int, int], dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
    owners: list[list[str]] = []
    mine = rows[rows.own]
    for word, size, head, tail, front in zip(mine.word, mine["size"].tolist(), mine["head"].tolist(), mine["tail"].tolist(), mine.front.tolist()):
        segment, rest = (word[:head], word[size - tail :]) if front else (word[size - tail :], word[:head])
        groups = places[segment][front, size, head, tail]
        if rest not in groups:
            groups[rest] = len(owners)
            owners.append([])
        owners[groups[rest]].append(word)
    if not owners:
        return pd.DataFrame({"word": [], "near": []}, dtype=object)
    automaton = ahocorasick.Automaton()
    for segment, at in places.items():
        automaton.add_word(segment, (len(segment), [(*role, groups) for role, groups in at.items()]))
    automaton.make_automaton()
    hits: list[list[str]] = [[] for _ in owners]
    for word in rows.word.unique():
        length = len(word)
        for end, (n, roles) in automaton.iter(word):
            first, last = end == n - 1, end == length - 1
            if first or last:
                for front, size, head, tail, groups in roles:
                    if (first if front else last) and -2 < size - length < 2 and head + tail <= length:
                        group = groups.get(word[length - tail :] if front else word[:head])
                        if group is not None:
                            hits[group].append(word)
    found = {pair for own, scanned in zip(owners, hits) if len(scanned) > 1 or scanned != own for pair in one_edit_pairs(own, scanned)}
    return pd.DataFrame(sorted(found), columns=["word", "near"])


def near_words(words: DataFrame, hot: int = HOT, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(word, near): all ordered pairs of ``words`` (distinct) that are one edit apart."""
    spark = words.sparkSession
    entries = refined(filed(words), hot)
    shards = max(shuffle_width(spark), 8 * words.count() // shard_entries + 1)
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    # pairs of both directions, as either word's segment may be the one that is shared
    seen = dealt.groupBy("shard").applyInPandas(lambda rows: scan_shard(rows), "word string, near string")
    return seen.unionByName(seen.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last word of the chain of forms, by pointer jumps."""
    at = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        hop = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(at.join(hop, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        at = after.drop("moved")
        if after.filter("moved").isEmpty():
            return forms.join(at, "word")


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, letters: int = LEAST_LETTERS, times: int = TIMES, hot: int = HOT
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the documents."""
    words = staged(word_counts(docs, id_col, text_col, least, letters), "words")
    near = near_words(words.select("word"), hot).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("near_n").alias("top_n"), F.min_by("near", F.struct(-F.col("near_n"), "near")).alias("top"))
    follows = F.col("top_n") >= times * F.col("n")
    forms = staged(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("top")).alias("form"), F.when(follows, F.col("top_n")).alias("form_n")
        ),
        "forms",
    )
    return roots(forms)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc_id, w, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, c, {crc_sql("concat(doc_id, ':', w)")} AS h FROM runs, crc_table),
made AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
voc AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM voc)),
pairs AS (
  SELECT cut.word AS a, voc.word AS b FROM cut JOIN voc ON cut.v = voc.word
  UNION SELECT voc.word, cut.word FROM cut JOIN voc ON cut.v = voc.word
  UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.v = y.v AND x.i = y.i AND x.word <> y.word),
best AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS top_n, first(b ORDER BY n DESC, b) AS top
  FROM pairs JOIN voc ON voc.word = b GROUP BY a),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= {TIMES} * n THEN top END AS form, CASE WHEN top_n >= {TIMES} * n THEN top_n END AS form_n
  FROM voc LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT word, n, n_near, form, form_n, last AS root FROM forms JOIN (SELECT word, last FROM chain WHERE next IS NULL) USING (word)
"""
