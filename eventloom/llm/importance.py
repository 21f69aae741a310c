"""Importance resampling towards a target: array-scored weights, then an exact histogram of integer scores.

Features are runs of 1 to ``NGRAM`` consecutive words (here single words), hashed to
``BUCKETS`` buckets by crc32. One pass counts the buckets of the documents and of the
target; only sums per bucket leave the tasks. The gains (scaled log ratios, floored to
integers) are one array of ``BUCKETS`` numbers, which is sent to the tasks; a second
pass adds them up along each whole text. A Gumbel term from a hash of the id makes the
greatest scores a draw without replacement.

Which scores are drawn is found from the histogram of the integer scores alone. A
score is read as digits of 16 or 8 bits; within each prefix of digits the counts are
summed from the greatest downwards, so that no window holds more than 65,536 rows (256
at the last digits, where most scores share the first ones), and these sums together
are the score's rank offset. Scores whose offset is below the
number to draw survive; only their rows are numbered, by id within each score. Rows
that repeat id and score are numbered as one with its count and laid out afterwards.

Defined cases: null and empty texts have no words, weight 0 and are never eligible
where ``least_words`` is positive; a null id is hashed as the empty text and comes after known ids;
repeated rows are rows of their own, with ranks of their own; an empty target has
counts of 0; empty tables give empty results; other columns are not looked at
(``drawn_documents`` passes them through).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, staged, table

BUCKETS = 10_000
NGRAM = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Digits of a score, greatest first: how far each is shifted, and how many bits it has.
SHIFTS, BITS = (48, 32, 16, 8, 0), (16, 16, 16, 8, 8)
#: Copies of one (score, id) that one row of the first layout stands for.
COPIES = 4096
#: A task forgets hashed features when it holds so many.
REMEMBERED = 200_000

#: Bytes of a word stay (A-Z in lower case), others become spaces; bytes beyond ASCII always belong to words.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Hashed(dict):
    """Bucket of each feature."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(found: list[bytes], ngram: int) -> list[bytes]:
    out = found
    for n in range(2, ngram + 1):
        out = out + [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
    return out


def slots(text: str | None, hashed: Hashed, ngram: int) -> np.ndarray:
    found = features(words(text), ngram)
    return np.fromiter(map(hashed.__getitem__, found), np.int64, len(found))


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """(bucket, n): features of all rows by bucket, buckets without any left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Hashed(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(slots(text.as_py(), hashed, ngram), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) by bucket."""
    s_all, t_all, size = float(have.sum()), float(want.sum()), float(len(have))
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(have.tolist(), want.tolist())],
        np.int64,
    )


def fit(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of each bucket: ``buckets`` numbers, whatever the tables' sizes."""
    out = []
    for df, col in ((docs, text_col), (target, target_col)):
        counts = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(df, col, buckets, ngram).collect():
            counts[bucket] = n
        out.append(counts)
    return gains(*out)


def with_weights(df: DataFrame, gain: np.ndarray, text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """``df`` with __el_features, __el_words and __el_weight in place of the text."""
    sent = df.sparkSession.sparkContext.broadcast(gain)
    others = [F.col(c) for c in df.columns if c != text_col]
    packed = df.select(F.struct(*others).alias("all"), F.col(text_col).cast("string").alias("t"))
    schema = f"all {packed.schema['all'].dataType.simpleString()}, __el_features long, __el_words long, __el_weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        hashed = Hashed(len(own))
        for batch in batches:
            made = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                found = words(text.as_py())
                taken = features(found, ngram)
                at = np.fromiter(map(hashed.__getitem__, taken), np.int64, len(taken))
                made[:, i] = len(at), len(found), own[at].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made)], names=["all", "__el_features", "__el_words", "__el_weight"])

    return packed.mapInArrow(run, schema).select("all.*", "__el_features", "__el_words", "__el_weight")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of a hash of seed and id."""
    key = F.concat_ws("", F.lit(f"{seed}:"), doc_id.cast("string"))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def rank_offsets(histogram: DataFrame) -> DataFrame:
    """(score, offset) of a histogram (score, n) of distinct scores: how many rows have a greater score.

    Level by level: a prefix of digits has its parent's offset and the counts of greater
    prefixes below that parent, of which there are at most 65,536.
    """
    digits = [F.shiftright("score", s) if s == SHIFTS[0] else F.shiftright("score", s).bitwiseAND((1 << b) - 1) for s, b in zip(SHIFTS, BITS)]
    names = [f"d{k}" for k in range(len(SHIFTS))]
    rows = histogram.select("score", "n", *[d.alias(name) for d, name in zip(digits, names)])
    out = None
    for k, name in enumerate(names):
        prefix, parent = names[: k + 1], names[:k]
        level = rows if k == len(names) - 1 else rows.groupBy(*prefix).agg(F.sum("n").alias("n"))
        below = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        greater = F.coalesce(F.sum("n").over(below.orderBy(F.desc(name)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        level = level.withColumn("greater", greater).drop("n")
        out = level.withColumnRenamed("greater", "offset") if out is None else level.join(out, parent).withColumn("offset", F.col("offset") + F.col("greater")).drop("greater")
    return out.select("score", "offset")


def numbered(rows: DataFrame, keys: list[str], draw: int, offsets: DataFrame) -> DataFrame:
    """Rows (keys, score, id, n) with a score of ``offsets``, each copy with its rank up to ``draw``."""
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = rows.join(offsets, "score").withColumn("first", F.col("offset") + before)
    # a group of copies is laid out in two steps, so no array is longer than COPIES
    parts = first.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    laid = parts.withColumn("at", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)))
    rank = F.col("first") + F.col("at") + 1
    return laid.select(*keys, F.when(rank <= draw, rank).alias("rank"))


def importance_draw(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, ngram: int = NGRAM,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn."""
    gain = fit(docs, target, buckets, ngram, text_col, target_col)
    weighed = with_weights(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__el_text")), gain, "__el_text", ngram)
    scored = staged(
        weighed.select(
            "doc_id", F.col("__el_features").alias("n_features"), F.col("__el_weight").alias("weight"),
            (F.col("__el_weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("__el_words") >= least_words).alias("fit"),
        ),
        "scored",
    )
    keys = ["doc_id", "n_features", "weight", "score"]
    histogram = staged(scored.filter("fit").groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    # N is a sum over partial sums, one number
    draw = percent * (histogram.agg(F.sum("n")).first()[0] or 0) // 100
    offsets = staged(rank_offsets(histogram).filter(F.col("offset") < draw), "offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    over = F.col("fit") & (F.col("score") >= F.lit(cutoff)) if cutoff is not None else F.lit(False)
    rest = scored.filter(~over).select(*keys, F.lit(None).cast("long").alias("rank"))
    grouped = scored.filter(over).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return numbered(grouped, keys, draw, offsets).unionByName(rest)


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose id is drawn; rows that repeat a drawn id come along, null ids do not."""
    drawn = ranks.filter("rank IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__el_drawn")).distinct()
    return docs.join(drawn, docs[id_col] == F.col("__el_drawn"), "left_semi")


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_draw(docs, table(spark, sf_dir, "benchmark").select("text"))


#: DuckDB has no crc32: bytes of each distinct word are folded through a table that is made by the polynomial's rule.
CRC_SQL = """steps AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes; crc_table must be in scope as ``t``."""
    codes = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, t[xor(a, b) & 255 + 1])))".replace("xor(a, b) & 255 + 1", "(xor(a, b) & 255) + 1")


def _words_sql(source: str, key: str) -> str:
    return f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {source}"


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
dw AS ({_words_sql("documents", "doc_id")}), tw AS ({_words_sql("benchmark", "1 AS one")}),
voc AS (SELECT w, {crc_sql("w")} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw), crc_table),
dn AS (SELECT b, count(*) AS s FROM dw JOIN voc USING (w) GROUP BY b),
tn AS (SELECT b, count(*) AS s FROM tw JOIN voc USING (w) GROUP BY b),
gain AS (
  SELECT i AS b, floor(1000 * ln((coalesce(tn.s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE
    / ((coalesce(dn.s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tw) + {BUCKETS})::DOUBLE)))::BIGINT AS g
  FROM range({BUCKETS}) r(i) LEFT JOIN dn ON dn.b = i LEFT JOIN tn ON tn.b = i),
per AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM dw JOIN voc USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('{SEED}:', doc_id)), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN per USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
