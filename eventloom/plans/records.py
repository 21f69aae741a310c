"""Event records built from the benchmark tables, and their SQL twins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF = date(1998, 6, 17)
ER_REF = date(2026, 8, 27)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per line item: title, venue, dates, price, source, category and flags."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), "o_orderstatus")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.lower("p_type").alias("category"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("venue"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "title", "venue", "start", F.expr("date_add(start, l_linenumber - 1)").alias("end"),
        "category", F.concat("l_returnflag", "l_linestatus").alias("source"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") == 0).alias("is_free"),
        F.col("l_linenumber").alias("source_count"), (F.col("o_orderstatus") == "F").alias("announced"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
    )


EVENTS_SQL = """e AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS title, s_name AS venue, o_orderdate::DATE AS start,
    (o_orderdate::DATE + (l_linenumber - 1)) AS "end", lower(p_type) AS category, l_returnflag || l_linestatus AS source, l_extendedprice AS price,
    l_discount = 0 AS is_free, l_linenumber AS source_count, o_orderstatus = 'F' AS announced,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records for entity resolution: one per part, titles noisy by source, dates spread by size."""
    p = table(spark, sf_dir, "part")
    kind = F.pmod("p_partkey", F.lit(4))
    noisy = F.when(kind == 0, F.concat("p_name", F.lit(" Konseri"))).when(kind == 1, F.concat(F.lit("İzmir | "), "p_name")).when(
        kind == 2, F.concat("p_name", F.lit(" (Bilet) 2026"))
    ).otherwise(F.upper("p_name"))
    start = F.expr(f"date_add(DATE '{ER_REF}', p_size)")
    return p.select(
        F.col("p_partkey").alias("idx"), noisy.alias("title"), F.col("p_brand").alias("venue"), start.alias("start"),
        F.date_add(start, F.pmod("p_partkey", F.lit(5)).cast("int")).alias("end"),
        F.when(kind == 0, F.lit(None).cast("int")).otherwise(F.pmod("p_partkey", F.lit(24)).cast("int") * 60).alias("minute"),
        F.when(kind == 3, "diger").otherwise(F.lower("p_type")).alias("category"),
        F.when(kind == 1, F.concat(F.lit("about "), "p_name")).alias("description"),
        F.lit(None).cast("string").alias("image"),
        F.concat(F.lit("src"), kind.cast("string")).alias("source"),
        F.concat(F.lit("https://www.example.com/e/"), F.col("p_partkey").cast("string"), F.lit("/")).alias("url"),
        (kind * 10).cast("int").alias("priority"),
        F.lit(None).cast("timestamp").alias("first_seen"),
        F.struct(
            (F.pmod("p_partkey", F.lit(7)) == 0).alias("is_free"),
            F.when(F.pmod("p_partkey", F.lit(7)) > 1, F.col("p_retailprice")).alias("min"),
            F.lit(None).cast("double").alias("max"),
            F.concat(F.col("p_retailprice").cast("string"), F.lit(" TL")).alias("raw"),
            F.lit(False).alias("needs_registration"),
        ).alias("price"),
    )


LISTINGS_SQL = f"""l AS (
  SELECT p_partkey AS idx, p_name AS name, p_brand AS venue, p_type, p_retailprice, (DATE '{ER_REF}' + p_size) AS start,
    (DATE '{ER_REF}' + p_size + (p_partkey % 5)::INTEGER) AS "end", p_partkey % 4 AS kind FROM part)"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as a listing page gives them, one per part, in eight kinds: dated in text, in the title, with the venue in
    the title, with an end, a menu entry, without a date, past, in another city."""
    p = table(spark, sf_dir, "part")
    kind = F.pmod("p_partkey", F.lit(8))
    day = F.expr(f"date_add(DATE '{ER_REF}', p_size)")
    iso = F.date_format(day, "yyyy-MM-dd")
    return p.select(
        F.col("p_partkey").alias("idx"), F.concat(F.lit("src"), F.expr("p_partkey div 8 % 4").cast("string")).alias("source"),
        F.when(kind == 1, F.concat("p_name", F.lit(" 18 Eylül 2026"))).when(kind == 2, F.concat("p_name", F.lit(" / Bostanlı Suat Taşer Tiyatrosu")))
        .when(kind == 4, "Tüm Etkinlikler").otherwise(F.col("p_name")).alias("title"),
        F.when(kind == 0, F.concat(iso, F.lit("T20:30"))).when(kind == 2, F.date_format(day, "dd.MM.yyyy")).when(kind.isin(3, 7), iso).when(kind == 6, "01.01.2020").alias("date_text"),
        F.when(kind == 3, F.date_format(F.date_add(day, 3), "yyyy-MM-dd")).alias("end_text"),
        F.when(kind == 7, "Zorlu PSM İstanbul").when(~kind.isin(2), F.col("p_brand")).alias("venue"),
        F.when(kind == 0, "150 TL").when(kind == 3, "Ücretsiz").alias("price_text"),
        F.concat(F.lit("https://example.com/"), "p_partkey").alias("url"),
    )


def source_list(spark: SparkSession) -> DataFrame:
    rows = [("src0", False, None, False, 90), ("src1", False, None, True, 10), ("src2", False, "konser", False, None), ("src3", True, None, False, 70), ("src9", False, None, False, 5)]
    return spark.createDataFrame(rows, "key string, city_filter boolean, default_category string, free_by_default boolean, priority int")


RAW_SQL = f"""r AS (
  SELECT p_partkey AS idx, (p_partkey // 8) % 4 AS s, p_partkey % 8 AS kind, p_name AS name, p_brand AS brand, DATE '{ER_REF}' + p_size AS day FROM part),
  b AS (SELECT idx, 'src' || s AS source, s, kind, name, CASE kind WHEN 2 THEN 'Bostanlı Suat Taşer Tiyatrosu' WHEN 7 THEN 'Zorlu PSM İstanbul' ELSE brand END AS venue,
    CASE kind WHEN 1 THEN DATE '2026-09-18' WHEN 6 THEN DATE '2020-01-01' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE day END AS start,
    CASE WHEN kind = 4 THEN 'junk' WHEN s = 3 THEN 'no_city' WHEN kind = 7 THEN 'other_city' WHEN kind = 5 THEN 'no_date' WHEN kind = 6 THEN 'past' END AS reason,
    kind = 3 OR (s = 1 AND kind <> 0) AS is_free FROM r)"""
