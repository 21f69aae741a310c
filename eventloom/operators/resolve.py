"""Entity resolution: blocking, pair scores, components and cluster merge.

Records have ``idx`` (input order), ``title``, ``venue``, ``start``, ``end`` and, for
the merge, the event columns of ``plans.schemas``. Blocking is an equi-join on
exploded day keys; the cheap gates sit in the join, title scores are computed once per
distinct pair of normalised titles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.similarity import apart_table, cached_title_score, cached_venue_score, half_up, pairs_within, score_table, title_similarity, venue_similarity

LONG_SPAN = 3
TOLERANCE = 1
THRESHOLD, FLOOR, CEILING = 0.82, 0.55, 0.97
TITLE_WEIGHT, VENUE_WEIGHT = 0.72, 0.28
VENUE_CONFLICT, CONFLICT_FACTOR, NO_VENUE_FACTOR = 0.4, 0.75, 0.97
#: Titles of one day that a task compares with as many others.
TITLES = 2000
#: Records of one span of days that a task pairs with as many others at a time, pairs of a task, and tasks.
CELL, TASK_PAIRS, MOST_TASKS = 700, 2_000_000, 20_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or "/tmp/checkpoints").rstrip("/")


def checkpointed(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/eventloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_keys(start: Column, end: Column) -> Column:
    """Every day of a record whose end is at most ``LONG_SPAN`` days after its start; first day, last day and month of a longer one."""
    days = F.transform(F.sequence(start, end), lambda d: d.cast("string"))
    long = F.array(start.cast("string"), end.cast("string"), F.concat(F.lit("long "), F.date_format(start, "yyyy-MM")))
    return F.when(F.date_diff(end, start) <= LONG_SPAN, days).otherwise(F.array_distinct(long))


def met_spans(records: DataFrame) -> DataFrame:
    """(met, l_start, l_end, l_n, l_chunks, r_start, r_end, r_n, r_chunks): spans of days whose records are candidates of each other, each two spans once.

    A span has its number of records and of chunks of about CELL. Two spans are met if they share a block and lie within the
    tolerance; a span meets itself, too.
    """
    spans = records.filter("idx IS NOT NULL").groupBy("start", "end").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / CELL).cast("int"))
    keyed = spans.withColumn("keys", block_keys(F.col("start"), F.col("end"))).withColumn("block_key", F.explode("keys"))
    each = F.struct("l_start", "l_end") <= F.struct("r_start", "r_end")
    met = _met(keyed, keyed, ["block_key"]).filter(each).select(*[f"{side}_{c}" for side in "lr" for c in ("start", "end", "n", "chunks")])
    return checkpointed(met.withColumn("met", F.monotonically_increasing_id()), "er-spans")


def counted_pairs(met: DataFrame) -> int:
    """How many pairs the records of the met spans make."""
    same = (F.col("l_start") == F.col("r_start")) & (F.col("l_end") == F.col("r_end"))
    made = F.when(same, F.expr("l_n * (l_n - 1) div 2")).otherwise(F.col("l_n") * F.col("r_n"))
    return met.agg(F.coalesce(F.sum(made), F.lit(0))).first()[0]


def by_cells(records: DataFrame, kept: list[str], run, schema: T.StructType) -> DataFrame:
    """``run(table, lower, upper)`` on every cell: the Arrow table of a cell's records with the columns ``kept``, and the places of the pairs in it, the smaller idx first.

    A cell is two chunks of records of two met spans, so a task holds some thousands of records and at most CELL * CELL pairs,
    and pairs themselves are never shuffled nor tested one by one.
    """
    met = met_spans(records)
    tasks = min(MOST_TASKS, max(records.sparkSession.sparkContext.defaultParallelism, counted_pairs(met) // TASK_PAIRS))
    same = (F.col("l_start") == F.col("r_start")) & (F.col("l_end") == F.col("r_end"))
    forth = met.select("met", F.col("l_start").alias("start"), F.col("l_end").alias("end"), F.col("l_chunks").alias("mine"), F.col("r_chunks").alias("others"), F.when(same, "both").otherwise("left").alias("side"))
    back = met.filter(~same).select("met", F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("r_chunks").alias("mine"), F.col("l_chunks").alias("others"), F.lit("right").alias("side"))
    rows = records.filter("idx IS NOT NULL").join(forth.unionByName(back), ["start", "end"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("idx"), F.col("mine")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    both, left = F.col("side") == "both", F.col("side") == "left"
    i = F.when(both, F.least("chunk", "other")).when(left, F.col("chunk")).otherwise(F.col("other"))
    j = F.when(both, F.greatest("chunk", "other")).when(left, F.col("other")).otherwise(F.col("chunk"))
    rows = rows.withColumns({"i": i, "j": j}).select("met", "i", "j", (both & (F.col("i") == F.col("j"))).alias("alone"), (left | both & (F.col("chunk") == F.col("i"))).alias("first"), *kept)

    def cell(table: pa.Table) -> pa.Table:
        idx, first = table["idx"].to_numpy(), table["first"].to_numpy()
        alone = bool(table["alone"][0].as_py())
        a = np.arange(len(idx)) if alone else np.flatnonzero(first)
        b = a if alone else np.flatnonzero(~first)
        x, y = np.repeat(a, len(b)), np.tile(b, len(a))
        wanted = idx[x] < idx[y] if alone else idx[x] != idx[y]
        if not wanted.all():
            x, y = x[wanted], y[wanted]
        turned = idx[x] > idx[y]
        return run(table, np.where(turned, y, x), np.where(turned, x, y))

    return rows.repartition(int(tasks), "met", "i", "j").groupBy("met", "i", "j").applyInArrow(cell, schema)


def candidate_pairs(records: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """(l_*, r_*) of records that share a block key and whose dates lie within the tolerance, each pair once; * are the columns ``kept``, all if not told."""
    kept = kept or records.columns
    fields = [records.schema[c] for c in kept]
    schema = T.StructType([T.StructField(f"{side}_{f.name}", f.dataType) for side in "lr" for f in fields])

    def paired(table: pa.Table, lower: np.ndarray, upper: np.ndarray) -> pa.Table:
        taken = [table[c].take(pa.array(at)) for at in (lower, upper) for c in kept]
        return pa.Table.from_arrays(taken, names=[f"{side}_{c}" for side in "lr" for c in kept])

    return by_cells(records, list(dict.fromkeys(["idx", *kept])), paired, schema)


def distinct_scores(pairs: DataFrame, left: str, right: str, score, name: str) -> DataFrame:
    """``pairs`` with ``score`` of two text columns, computed once per distinct pair."""
    both = pairs.select(F.col(left).alias("__a"), F.col(right).alias("__b")).distinct()
    scored = both.withColumn(name, score(F.col("__a"), F.col("__b")))
    return pairs.join(scored, (pairs[left] == F.col("__a")) & (pairs[right] == F.col("__b"))).drop("__a", "__b")


def combined_score(title: Column, venue: Column, left_tokens: Column, right_tokens: Column, same_url: Column) -> Column:
    """The match score of a pair whose dates fit."""
    single = (F.least(F.size(left_tokens), F.size(right_tokens)) <= 1) & (F.array_sort(left_tokens) != F.array_sort(right_tokens))
    mixed = TITLE_WEIGHT * title + VENUE_WEIGHT * venue
    return (
        F.when(same_url, 1.0)
        .when(single, 0.0)
        .when(title < FLOOR, 0.0)
        .when(venue < VENUE_CONFLICT, CONFLICT_FACTOR * mixed)
        .when(title >= CEILING, 1.0)
        .when(venue.isNull(), NO_VENUE_FACTOR * title)
        .otherwise(mixed)
    )


def canonical_url(url: Column) -> Column:
    """Host without 'www.' and path, lower case, no trailing '/'; null without both."""
    bare = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?#]*)", 1)), "^www\\.", "")
    path = F.rtrim(F.lower(F.regexp_extract(bare, "^[^/?#]*(/[^?#]*)?", 1)), F.lit("/"))
    return F.when((host != "") & (path != ""), F.concat(host, path))


def prepared(records: DataFrame) -> DataFrame:
    """The columns that scoring needs."""
    url = canonical_url(F.col("url")) if "url" in records.columns else F.lit(None).cast("string")
    return records.select("idx", tx.normalize_title(F.col("title")).alias("key"), tx.normalize_venue(F.col("venue")).alias("place"), url.alias("link"), "start", "end")


def match_scores(records: DataFrame, digits: int | None = None) -> DataFrame:
    """(l_idx, r_idx, title_score, venue_score, score) of all candidate pairs, rounded half up to ``digits`` if told.

    A cell scores its distinct pairs of titles and of venues, and hands them on to its pairs of records.
    """
    ready = checkpointed(prepared(records).filter("key IS NOT NULL AND place IS NOT NULL"), "er-prepared")
    kind = ready.schema["idx"].dataType
    schema = T.StructType([T.StructField("l_idx", kind), T.StructField("r_idx", kind), *[T.StructField(c, T.DoubleType()) for c in ("title_score", "venue_score", "score")]])

    def scored(table: pa.Table, lower: np.ndarray, upper: np.ndarray) -> pa.Table:
        titles, places, links = (table[c].combine_chunks().dictionary_encode() for c in ("key", "place", "link"))
        k, p, u = (x.indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in (titles, places, links))
        names = titles.dictionary.to_pylist()
        apart = apart_table(names)[k[lower], k[upper]]
        by_title, t = score_table(names, k[lower], k[upper], cached_title_score)
        by_venue, v = score_table(places.dictionary.to_pylist(), p[lower], p[upper], cached_venue_score)
        title, venue = by_title[t], by_venue[v]
        same = (u[lower] == u[upper]) & (u[lower] >= 0)
        mixed = TITLE_WEIGHT * title + VENUE_WEIGHT * venue
        score = np.select(
            [same, apart, title < FLOOR, venue < VENUE_CONFLICT, title >= CEILING, np.isnan(venue)], [1.0, 0.0, 0.0, CONFLICT_FACTOR * mixed, 1.0, NO_VENUE_FACTOR * title], mixed
        )
        told = [title, venue, score] if digits is None else [half_up(by_title, digits)[t], half_up(by_venue, digits)[v], half_up(score, digits)]
        idx = table["idx"].combine_chunks()
        return pa.Table.from_arrays([idx.take(pa.array(lower)), idx.take(pa.array(upper)), *[pa.array(x, from_pandas=True) for x in told]], names=schema.names)

    return by_cells(ready, ["idx", "key", "place", "link"], scored, schema)


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(idx, root): the least idx of each vertex's component, by rounds of least neighbours and pointer jumps."""
    both = edges.select(F.col("l_idx").alias("a"), F.col("r_idx").alias("b"))
    both = checkpointed(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "er-edges")
    label = checkpointed(vertices.select("idx", F.col("idx").alias("root")), "er-roots")
    while True:
        near = both.join(label.select(F.col("idx").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        moved = label.join(near, label["idx"] == near["a"], "left").select("idx", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        hop = moved.select(F.col("idx").alias("root"), F.col("root").alias("next"))
        after = checkpointed(moved.join(hop, "root").select("idx", F.col("next").alias("root"), "was"), "er-roots")
        label = after.drop("was")
        if after.filter("root <> was").isEmpty():
            return label


def least_title_score(threshold: float) -> float:
    """The title score below which no pair reaches the threshold: with the best venue, or with none."""
    return min((threshold - VENUE_WEIGHT) / TITLE_WEIGHT, threshold / NO_VENUE_FACTOR)


def similar_titles(titles: DataFrame, least: float) -> DataFrame:
    """(a, b, title_score) of different titles of (block_key, key) that share a block and score ``least``, each pair once, a < b.

    Titles of a block are dealt to chunks of about TITLES, and two chunks meet in a task,
    which hands on only pairs that its bounds do not exclude; those are scored once.
    """
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        at, other = group["i"].iloc[0], group["j"].iloc[0]
        left, right = (group.loc[group["chunk"] == c, "key"].tolist() for c in (at, other))
        return pd.DataFrame(sorted(set(pairs_within(left, right, least))), columns=["a", "b"])

    known = titles.filter("key <> ''").distinct()
    sizes = known.groupBy("block_key").agg(F.ceil(F.count(F.lit(1)) / TITLES).cast("int").alias("chunks"))
    dealt = known.join(sizes, "block_key").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("block_key", "key", "chunk", F.least("chunk", "other").cast("int").alias("i"), F.greatest("chunk", "other").cast("int").alias("j"))
    found = met.groupBy("block_key", "i", "j").applyInPandas(compare, "a string, b string").distinct()
    # the pairs are dealt anew, so that scoring is spread
    return found.withColumn("title_score", title_similarity(F.col("a"), F.col("b"))).filter(F.col("title_score") >= least)


def same_link(records: DataFrame) -> DataFrame:
    """(l_idx, r_idx): records with one link to the first with the same link and days, and these firsts with each other where they share a block."""
    linked = records.filter("link IS NOT NULL")
    firsts = linked.groupBy("link", "start", "end").agg(F.min("idx").alias("idx"))
    stars = linked.join(firsts.withColumnRenamed("idx", "first"), ["link", "start", "end"]).filter("idx <> first").select(F.col("first").alias("l_idx"), F.col("idx").alias("r_idx"))
    keyed = firsts.withColumn("keys", block_keys(F.col("start"), F.col("end"))).withColumn("block_key", F.explode("keys"))
    return stars.unionByName(_met(keyed, keyed, ["block_key", "link"]).filter("l_idx < r_idx").select("l_idx", "r_idx"))


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """l_* and r_* of rows (idx, start, end, keys, ...) that agree in ``on`` and whose days lie within the tolerance, at the least block that both have."""
    l, r = (df.select(*on, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in on or c == "block_key"]) for df, side in ((left, "l"), (right, "r")))
    near = (F.date_sub("l_start", TOLERANCE) <= F.col("r_end")) & (F.date_sub("r_start", TOLERANCE) <= F.col("l_end"))
    once = F.col("block_key") == F.array_min(F.array_intersect("l_keys", "r_keys"))
    return l.join(r, on).filter(near & once)


def profiles_of(ready: DataFrame) -> DataFrame:
    """(key, place, start, end, idx, n): records with one title, venue and days, their first and their number; staged."""
    named = ready.filter("key <> ''").groupBy("key", "place", "start", "end")
    return checkpointed(named.agg(F.min("idx").alias("idx"), F.count("idx").alias("n")), "er-profiles")


def strong_profiles(profiles: DataFrame, threshold: float) -> DataFrame:
    """(l_idx, r_idx, l_n, r_n): two profiles with the threshold's score, links aside, each two once. Profiles meet where their titles are equal or similar."""
    keyed = profiles.withColumn("keys", block_keys(F.col("start"), F.col("end"))).withColumn("block_key", F.explode("keys"))
    titles = checkpointed(similar_titles(keyed.select("block_key", "key"), least_title_score(threshold)), "er-titles")
    equal = _met(keyed, keyed, ["block_key", "key"]).filter("l_idx < r_idx").withColumns({"l_key": F.col("key"), "r_key": F.col("key"), "title_score": F.lit(1.0)}).drop("key")
    turned = keyed.join(titles, keyed["key"] == titles["a"]).drop("a")
    alike = _met(turned.withColumnRenamed("b", "wanted").withColumnRenamed("key", "l_title"), keyed.withColumnRenamed("key", "wanted"), ["block_key", "wanted"])
    alike = alike.withColumns({"l_key": F.col("l_l_title"), "r_key": F.col("wanted"), "title_score": F.col("l_title_score")})
    kept = ["l_idx", "r_idx", "l_n", "r_n", "l_key", "r_key", "l_place", "r_place", "title_score"]
    return _scored_pairs(equal.select(*kept).unionByName(alike.select(*kept))).filter(F.col("score") >= threshold).select("l_idx", "r_idx", "l_n", "r_n")


def _scored_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (keys, places, title_score) with their score, links aside."""
    pairs = distinct_scores(pairs, "l_place", "r_place", venue_similarity, "venue_score")
    score = combined_score(F.col("title_score"), F.col("venue_score"), F.array_distinct(F.split("l_key", " ")), F.array_distinct(F.split("r_key", " ")), F.lit(False))
    return pairs.withColumn("score", score)


def _edges(ready: DataFrame, profiles: DataFrame, strong: DataFrame) -> DataFrame:
    """Records tied to their profile's first, profiles to each other, and what has one link."""
    same = ["key", "place", "start", "end"]
    firsts = profiles.select(*same, F.col("idx").alias("first"))
    stars = ready.filter("key <> ''").join(firsts, same).filter("idx <> first").select(F.col("first").alias("l_idx"), F.col("idx").alias("r_idx"))
    return stars.unionByName(strong.select("l_idx", "r_idx")).unionByName(same_link(ready))


def _supported(threshold: float) -> None:
    if threshold <= CONFLICT_FACTOR:
        raise ValueError(f"thresholds of {CONFLICT_FACTOR} and less are not supported: pairs with a venue conflict could reach them")


def links(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(l_idx, r_idx): enough pairs of records with the threshold's score to connect all that such pairs connect.

    Records with one title, venue and days are one profile: they are all alike, so each is tied to
    its profile's first. Profiles meet where their titles are equal or similar.
    """
    _supported(threshold)
    ready = checkpointed(prepared(records).fillna("", ["key", "place"]), "er-prepared")
    profiles = profiles_of(ready)
    return _edges(ready, profiles, checkpointed(strong_profiles(profiles, threshold), "er-strong"))


def linked_matches(ready: DataFrame, threshold: float) -> DataFrame:
    """One row, n: candidate pairs of records that have one link and would miss the threshold without it."""
    same = ["link", "key", "place", "start", "end"]
    alike = ready.filter("link IS NOT NULL AND idx IS NOT NULL").groupBy(*same).agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n"))
    keyed = alike.withColumn("keys", block_keys(F.col("start"), F.col("end"))).withColumn("block_key", F.explode("keys"))
    met = _met(keyed, keyed, ["block_key", "link"]).filter("l_idx <= r_idx")
    scored = _scored_pairs(distinct_scores(met, "l_key", "r_key", title_similarity, "title_score"))
    pairs = F.when(F.col("l_idx") < F.col("r_idx"), F.col("l_n") * F.col("r_n")).otherwise(F.expr("l_n * (l_n - 1) div 2"))
    return scored.filter(F.col("score") < threshold).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("n"))


def stats(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: records before, clusters after, how many are merged, and how many candidate pairs there are (comparisons) and reach the threshold (matches).

    Pairs are counted, not made: all of them by spans of days, those that reach the threshold by profiles, as in ``links``.
    """
    _supported(threshold)
    ready = checkpointed(prepared(records).fillna("", ["key", "place"]), "er-prepared")
    profiles = profiles_of(ready)
    strong = checkpointed(strong_profiles(profiles, threshold), "er-strong")
    roots = components(_edges(ready, profiles, strong), ready.select("idx"))
    own = profiles.filter(F.date_sub("start", TOLERANCE) <= F.col("end")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n"))
    across = strong.agg(F.coalesce(F.sum(F.col("l_n") * F.col("r_n")), F.lit(0)).alias("n"))
    matches = own.unionByName(across).unionByName(linked_matches(ready, threshold)).agg(F.sum("n").alias("matches"))
    sizes = roots.agg(F.count(F.lit(1)).alias("before"), F.countDistinct("root").alias("after")).withColumn("comparisons", F.lit(counted_pairs(met_spans(ready))).cast("long"))
    return sizes.join(matches, F.lit(True)).withColumn("merged", F.col("before") - F.col("after"))


def clusters(records: DataFrame, threshold: float = THRESHOLD, scores: DataFrame | None = None) -> DataFrame:
    """(idx, root) of all records; ``scores`` if they are known, else only pairs that can matter are made."""
    edges = links(records, threshold) if scores is None else scores.filter(F.col("score") >= threshold).select("l_idx", "r_idx")
    return components(edges, records.select("idx"))


def merge_clusters(records: DataFrame, roots: DataFrame) -> DataFrame:
    """One record per cluster.

    Columns used: idx, title, venue, start, end, minute, category, description, image,
    source, url, priority, first_seen and price struct<is_free,min,max,raw,needs_registration>.
    """
    title = F.col("title")
    length = F.length(title)
    tidy = ~tx.is_shouting(title) & ~title.contains("|")
    size = F.when(length.between(12, 60), 2).when(length <= 90, 1).otherwise(0)
    rank = F.struct(F.col("priority"), tidy.cast("int"), (F.coalesce("venue", F.lit("")) != "").cast("int"), size, (F.coalesce("image", F.lit("")) != "").cast("int"), -F.col("idx"))
    all_ = records.join(roots, "idx").withColumn("rank", rank)
    head = Window.partitionBy("root")
    all_ = all_.withColumn("canonical", F.col("rank") == F.max("rank").over(head))
    # canonical first, then by priority, then by input order
    order = F.struct((~F.col("canonical")).cast("int"), -F.col("priority"), F.col("idx"))
    fold_at = F.struct((~F.col("canonical")).cast("int"), F.col("idx"))

    def first_filled(c: str) -> Column:
        filled = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.min_by(F.when(filled, F.col(c)), F.when(filled, F.col("order"))).alias(c)

    price = F.col("price")
    unknown = ~price["is_free"] & price["min"].isNull()
    paid = ~price["is_free"] & price["min"].isNotNull()
    all_ = all_.withColumns({"order": order, "fold": fold_at, "unknown": unknown, "paid": paid})
    amount_max = F.coalesce(price["max"], price["min"])
    out = all_.groupBy("root").agg(
        tx.clean_display_title(F.min_by("title", "order")).alias("title"),
        F.min_by("start", "order").alias("start"),
        F.greatest(F.max("end"), F.min_by("start", "order")).alias("end"),
        *[first_filled(c) for c in ("minute", "venue", "description", "image")],
        F.coalesce(F.min_by(F.when(F.col("category") != "diger", F.col("category")), F.when(F.col("category") != "diger", F.col("fold"))), F.lit("diger")).alias("category"),
        F.array_sort(F.collect_list(F.struct("order", "source", F.coalesce("url", F.lit("")).alias("url"), "title"))).alias("members"),
        F.min("first_seen").alias("first_seen"),
        F.count(F.lit(1)).alias("records"),
        F.count_if("paid").alias("n_paid"),
        F.count_if(~F.col("unknown")).alias("n_known"),
        F.min_by("price", "fold").alias("price_first"),
        F.max_by("price", "fold").alias("price_last"),
        F.min_by(F.when(F.col("paid"), price), F.when(F.col("paid"), F.col("fold"))).alias("price_paid"),
        F.min(F.when(F.col("paid"), price["min"])).alias("low"),
        F.max(F.when(F.col("paid"), amount_max)).alias("high"),
        F.min_by(F.when(price["is_free"] & (price["raw"] != ""), price["raw"]), F.when(price["is_free"] & (price["raw"] != ""), F.col("fold"))).alias("free_raw"),
        F.coalesce(F.bool_or(price["is_free"] & price["needs_registration"]), F.lit(False)).alias("registration"),
    )
    many = F.col("n_paid") > 1
    is_free = F.when(F.col("n_known") == 0, F.lit(False)).otherwise(F.col("n_paid") == 0)
    out = out.withColumns(
        {
            "is_free": is_free,
            "price_min": F.when(F.col("n_paid") > 0, F.col("low")),
            "price_max": F.when(many & (F.col("high") != F.col("low")), F.col("high")).when(F.col("n_paid") == 1, F.col("price_paid.max")),
            "price_raw": F.when(F.col("n_paid") > 0, F.col("price_paid.raw")).when(F.col("n_known") > 0, F.coalesce("free_raw", F.lit(""))).otherwise(F.col("price_last.raw")),
            "needs_registration": F.when(F.col("n_paid") > 0, F.lit(False)).when(F.col("n_known") > 0, F.col("registration")).otherwise(F.lit(False)),
        }
    )
    keys = F.array_distinct(F.transform("members", lambda m: m["source"]))
    sources = F.transform(
        keys,
        lambda k: F.struct(
            k.alias("source"),
            F.coalesce(F.try_element_at(F.filter(F.transform(F.filter("members", lambda m: m["source"] == k), lambda m: m["url"]), lambda u: u != ""), F.lit(1)), F.lit("")).alias("url"),
        ),
    )
    titles = F.transform(keys, lambda k: F.struct(k.alias("source"), F.element_at(F.filter("members", lambda m: m["source"] == k), -1)["title"].alias("title")))
    return out.withColumns({"sources": sources, "source_titles": titles, "source_count": F.size(keys)}).drop(
        "members", "n_paid", "n_known", "price_first", "price_last", "price_paid", "low", "high", "free_raw", "registration"
    )


def event_uid(title_key: Column, start: Column, venue_key: Column) -> Column:
    """The first 16 hex digits of sha1 over title key, first day and venue key."""
    return F.substring(F.sha1(F.concat_ws("|", title_key, start.cast("string"), venue_key).cast("binary")), 1, 16)


def final_order(events: DataFrame) -> DataFrame:
    """Merged events by first day, most sources first, then title."""
    return events.orderBy("start", F.desc("source_count"), "title")
