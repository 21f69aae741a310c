"""Mixing sources to target weights.

Every source's words, in a fixed document order, are packed into blocks of
``BLOCK`` words. A source's target says how many draws it gets; each draw is
dealt to an output shard by a hash, so the counts of a source over the shards are
multinomial while its total is exact. Draw number k of a source maps through that
source's pseudorandom index permutation of the epoch to a block index, and all
draws, those of whole epochs too, join blocks by (source, index). ``mix_shards`` gives
the taken parts of documents with their shard. A source is repeated only after each of its blocks
was used once, so no document exceeds ``MAX_REPEATS`` times its size. The last
draw of a source is cut to the words still missing, so the words taken equal the
rounded target.

Word positions come from a three-level prefix sum (documents within a hash slice,
slices within a band, bands within a source); every window is bounded by a
constant number of rows or by a hash slice, so a hot source is spread out.

Defined cases: null texts have size 0 and are never taken; null sources form one
source of their own, last in order; null ids are one ordinary id; repeated rows
are rows of their own; an all-empty table takes nothing (targets 0); an empty
table gives an empty result; extra columns pass through ``mix_documents`` and
``mix_shards`` (a column named like the shard is replaced), where
input names beginning with ``__el_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, shuffle_width, staged, table

SPACE = r"[\x20\x09-\x0D]"
#: Words in a block.
BLOCK = 512
#: Draws that an output shard holds on average.
SHARD_DRAWS = 256
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the whole mix, as a share of all words.
SHARE = 1.5
MAX_REPEATS = 2
#: Draws that one task numbers.
DRAW_CHUNK = 8192
#: Fixed constants of the order and of the permutations (primes).
ID_PRIME, ORDER_STEP, ORDER_PRIME = 1000003, 48271, 65521
STEP_PRIMES = (2147483647, 2147483629, 2147483587)
SHIFT = 7919


def slice_of(doc_id: Column) -> Column:
    """0 .. ORDER_PRIME - 1, evenly spread over ids."""
    return F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(ID_PRIME)) * ORDER_STEP % ORDER_PRIME


def source_plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: rank, size, target, words to take, blocks, draws."""
    per = sizes.groupBy("__el_source").agg(F.sum("__el_size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = per.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("__el_source").asc_nulls_last())) - 1
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    capped = ranked.withColumns(
        {
            "cap": F.col("source_size") * MAX_REPEATS,
            "level": (
                F.sum("source_size").over(everything) * share
                - F.coalesce(F.sum(F.col("source_size") * MAX_REPEATS).over(before), F.lit(0))
            )
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    full = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    target = F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    size, want = F.col("source_size"), F.col("want")
    return (
        capped.withColumn("target", target)
        .withColumn("want", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(size > 0, F.floor(want / size)).otherwise(0).cast("long"))
        .withColumn("left_over", want - F.col("epochs") * size)
        .withColumn("blocks", F.ceil(size / BLOCK).cast("long"))
        .withColumn("whole_blocks", F.floor(size / BLOCK).cast("long"))
        .withColumn("draws", F.col("epochs") * F.col("blocks") + F.ceil(F.col("left_over") / BLOCK).cast("long"))
        .select("__el_source", "rank", "source_size", "target", "epochs", "left_over", "blocks", "whole_blocks", "draws")
    )


def positions(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``sizes`` with rank, source_size, target and start: the words of its source before the document."""
    keyed = (
        sizes.join(plan.select("__el_source", "rank", "source_size", "target"), sizes["__el_source"].eqNullSafe(plan["__el_source"]))
        .drop(plan["__el_source"])
        .withColumn("__el_slice", slice_of(F.col("__el_id")))
        .withColumn("__el_band", F.floor(F.col("__el_slice") / 256).cast("long"))
    )
    slices = keyed.groupBy("rank", "__el_band", "__el_slice").agg(F.sum("__el_size").alias("__el_sum"))
    earlier = (Window.unboundedPreceding, -1)
    in_band = Window.partitionBy("rank", "__el_band").orderBy("__el_slice").rowsBetween(*earlier)
    slices = slices.withColumn("__el_before", F.coalesce(F.sum("__el_sum").over(in_band), F.lit(0)))
    bands = keyed.groupBy("rank", "__el_band").agg(F.sum("__el_size").alias("__el_sum"))
    in_source = Window.partitionBy("rank").orderBy("__el_band").rowsBetween(*earlier)
    bands = bands.withColumn("__el_bands_before", F.coalesce(F.sum("__el_sum").over(in_source), F.lit(0))).drop("__el_sum")
    base = slices.join(bands, ["rank", "__el_band"]).select(
        "rank", "__el_slice", (F.col("__el_before") + F.col("__el_bands_before")).alias("__el_base")
    )
    in_slice = Window.partitionBy("rank", "__el_slice").orderBy("__el_id", "__el_row").rowsBetween(*earlier)
    placed = keyed.withColumn("__el_in_slice", F.coalesce(F.sum("__el_size").over(in_slice), F.lit(0)))
    return placed.join(base, ["rank", "__el_slice"]).withColumn("start", F.col("__el_base") + F.col("__el_in_slice"))


def permuted(k: Column, n: Column, rank: Column, epoch: Column) -> Column:
    """A bijection of 0 .. n-1: k -> (step * k + shift) mod n with a step coprime to n."""
    step = F.element_at(F.filter(F.array(*(F.lit(p) for p in STEP_PRIMES)), lambda p: n % p != 0), 1) % n
    wide = "decimal(19,0)"
    moved = step.cast(wide) * k.cast(wide) + ((rank + 1) * SHIFT + epoch * ID_PRIME).cast(wide)
    return (moved % n.cast(wide)).cast("long")


def draw_blocks(plan: DataFrame, seed: int = 17) -> DataFrame:
    """One row per draw: rank, draw number, shard, epoch, block index, words taken from the block's start."""
    shards = plan.agg(F.greatest(F.lit(1), F.ceil(F.sum("draws") / SHARD_DRAWS)).cast("long").alias("shards"))
    chunks = (
        plan.filter("draws > 0")
        .withColumn("chunk", F.explode(F.expr(f"sequence(0L, (draws - 1) div {DRAW_CHUNK})")))
        .repartition(shuffle_width(plan.sparkSession), "rank", "chunk")
    )
    first = F.col("chunk") * DRAW_CHUNK
    draws = chunks.withColumn(
        "draw", F.explode(F.sequence(first, F.least(first + DRAW_CHUNK, F.col("draws")) - 1))
    ).crossJoin(F.broadcast(shards))
    epoch = F.expr("draw div blocks")
    k = F.col("draw") - F.col("epoch") * F.col("blocks")
    short = F.col("source_size") - F.col("whole_blocks") * BLOCK
    return (
        draws.withColumn("epoch", epoch)
        .withColumn("k", k)
        .withColumn(
            "block",
            F.when(F.col("k") >= F.col("whole_blocks"), F.col("whole_blocks")).otherwise(
                permuted(F.col("k"), F.greatest(F.col("whole_blocks"), F.lit(1)), F.col("rank"), F.col("epoch"))
            ),
        )
        .withColumn("block_words", F.when(F.col("block") < F.col("whole_blocks"), F.lit(BLOCK)).otherwise(short).cast("long"))
        .withColumn(
            "words",
            F.when(F.col("epoch") < F.col("epochs"), F.col("block_words")).otherwise(
                F.least(F.col("block_words"), F.col("left_over") - F.col("k") * BLOCK)
            ),
        )
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "rank", "draw"), F.col("shards")))
        .select("rank", "draw", "shard", "epoch", "block", "block_words", "words")
    )


def pieces(placed: DataFrame) -> DataFrame:
    """One row per document and block that it lies in: block, offset there, length, offset in the document."""
    start, end = F.col("start"), F.col("start") + F.col("__el_size")
    low = F.greatest(start, F.col("block") * BLOCK)
    return (
        placed.filter("__el_size > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + __el_size - 1) div {BLOCK})")))
        .select(
            "__el_row",
            "__el_size",
            "rank",
            "block",
            (low - F.col("block") * BLOCK).alias("at"),
            (F.least(end, (F.col("block") + 1) * BLOCK) - low).alias("length"),
            (low - start).alias("from_word"),
        )
    )


def sizes_of(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Narrow rows: one per document, with a row number that stays because it is staged."""
    return df.select(
        F.col(id_col).cast("long").alias("__el_id"),
        F.col(source_col).cast("string").alias("__el_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("__el_size"),
        F.col("__el_row") if "__el_row" in df.columns else F.monotonically_increasing_id().alias("__el_row"),
    )


def mixture(sizes: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(placed documents, words of documents met by a draw: one row per document piece and draw)."""
    plan = staged(source_plan(sizes), "mix-plan")
    placed = positions(sizes, plan)
    draws = draw_blocks(plan, seed).select("rank", "block", "epoch", "shard", "words")
    met = (
        pieces(placed)
        .join(draws, ["rank", "block"])
        .withColumn("length", F.least(F.col("at") + F.col("length"), F.col("words")) - F.col("at"))
        .filter("length > 0")
        .select("__el_row", "__el_size", "epoch", "shard", "from_word", "length")
    )
    return placed, met


def documents_in_mix(df: DataFrame, id_col="doc_id", source_col="source", text_col="text", seed: int = 17) -> DataFrame:
    """Per document: id, size, source_size, target, taken."""
    sizes = staged(sizes_of(df, id_col, source_col, text_col), "mix-sizes")
    placed, met = mixture(sizes, seed)
    taken = met.groupBy("__el_row").agg(F.sum("length").alias("__el_taken"))
    return placed.join(taken, "__el_row", "left").select(
        F.col("__el_id").alias(id_col),
        F.col("__el_size").alias("size"),
        "source_size",
        "target",
        F.coalesce("__el_taken", F.lit(0)).cast("long").alias("taken"),
    )


def ranges(spans: Column) -> Column:
    """Spans of one document in order, those that adjoin within an epoch and shard made one."""

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        adjoins = (last["epoch"] == span["epoch"]) & (last["shard"] == span["shard"]) & (last["from_word"] + last["length"] == span["from_word"])
        longer = last.withField("length", last["length"] + span["length"])
        return F.when(adjoins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.filter(spans, lambda s: F.lit(False)), add)


def mix_shards(
    df: DataFrame, id_col="doc_id", source_col="source", text_col="text", seed: int = 17, into: str = "shard"
) -> DataFrame:
    """The mix as rows with the columns of ``df`` and ``into``, the output shard: one row for each
    contiguous part of a document that an epoch puts in a shard, cut from the text as it stands
    (white space goes with the word before). ``n_chars``, if there, is counted anew for cut texts."""
    names = [c for c in df.columns if c != into]
    kept = staged(df.select(F.monotonically_increasing_id().alias("__el_row"), F.struct(*names).alias("__el_all")), "mix-documents")
    parts = {"__el_i": id_col, "__el_s": source_col, "__el_t": text_col}
    narrow = kept.select("__el_row", *[F.col(f"__el_all.`{c}`").alias(k) for k, c in parts.items()])
    sizes = staged(sizes_of(narrow, "__el_i", "__el_s", "__el_t"), "mix-sizes")
    _, met = mixture(sizes, seed)
    spans = met.groupBy("__el_row").agg(
        F.collect_list(F.struct("epoch", "shard", "from_word", "length")).alias("__el_spans"),
        F.first("__el_size").alias("__el_size"),
    )
    text = F.col(f"__el_all.`{text_col}`")

    def whole(span: Column) -> Column:
        return span["length"] == F.col("__el_size")

    cut = F.exists("__el_spans", lambda s: ~whole(s))
    words = F.when(cut, F.regexp_extract_all(text, F.lit(f"((?:^{SPACE}*)?{WORD}{SPACE}*)"), F.lit(1)))

    def part(words: Column, span: Column) -> Column:
        some = F.array_join(F.slice(words, (span["from_word"] + 1).cast("int"), span["length"].cast("int")), "")
        return F.struct(F.when(whole(span), text).otherwise(some).alias("text"), whole(span).alias("whole"), span["shard"].alias("shard"))

    # Through an array of one, so that the words are split once and not for each span.
    texts = F.element_at(F.transform(F.array(words), lambda w: F.transform(ranges(F.col("__el_spans")), lambda s: part(w, s))), 1)
    other = {name: f"__el_c{k}" for k, name in enumerate(names) if name != text_col}
    rows = kept.join(spans, "__el_row").select(
        *[F.col(f"__el_all.`{name}`").alias(short) for name, short in other.items()], F.explode(texts).alias("__el_part")
    )

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("__el_part.text").alias(name)
        old = F.col(other[name])
        if name == "n_chars":
            return F.when(F.col("__el_part.whole"), old).otherwise(F.char_length("__el_part.text")).cast(df.schema[name].dataType).alias(name)
        return old.alias(name)

    return rows.select(*map(column, names), F.col("__el_part.shard").alias(into))


def mix_documents(df: DataFrame, id_col="doc_id", source_col="source", text_col="text", seed: int = 17) -> DataFrame:
    """``mix_shards`` without the shard."""
    return mix_shards(df, id_col, source_col, text_col, seed, "__el_shard").drop("__el_shard")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_in_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM s
), l AS (
  SELECT *, source_size * {MAX_REPEATS} AS cap,
    (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(source_size * {MAX_REPEATS}) OVER b, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN cap <= level * weight THEN cap::DOUBLE
    ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
    source_size // {BLOCK} AS whole_blocks FROM t
), q AS (
  SELECT *, floor(target + 0.5)::BIGINT - epochs * source_size AS left_over FROM p
), o AS (
  SELECT d.doc_id, d.size, q.rank, q.source_size, q.target, q.epochs,
    coalesce(sum(d.size) OVER (PARTITION BY q.rank ORDER BY (d.doc_id % {ID_PRIME}) * {ORDER_STEP} % {ORDER_PRIME}, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), k AS (
  SELECT q.*, unnest(generate_series(0, (left_over - 1) // {BLOCK})) AS k FROM q WHERE left_over > 0
), b AS (
  SELECT rank, CASE WHEN k >= whole_blocks THEN whole_blocks
      ELSE ((({STEP_PRIMES[0]} % whole_blocks)::HUGEINT * k + (rank + 1) * {SHIFT} + epochs * {ID_PRIME}) % whole_blocks)::BIGINT END AS block,
    least(CASE WHEN k >= whole_blocks THEN source_size - whole_blocks * {BLOCK} ELSE {BLOCK} END, left_over - k * {BLOCK}) AS words
  FROM k
), x AS (
  SELECT doc_id, rank, start, size, unnest(generate_series(start // {BLOCK}, (start + size - 1) // {BLOCK})) AS block FROM o WHERE size > 0
), e AS (
  SELECT x.doc_id, sum(greatest(0, least(start + size, x.block * {BLOCK} + words) - greatest(start, x.block * {BLOCK}))) AS extra
  FROM x JOIN b ON x.rank = b.rank AND x.block = b.block GROUP BY x.doc_id
)
SELECT o.doc_id, o.size, o.source_size, o.target, (o.size * o.epochs + coalesce(e.extra, 0))::BIGINT AS taken
FROM o LEFT JOIN e USING (doc_id)
"""
