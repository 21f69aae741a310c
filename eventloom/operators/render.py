"""Texts of lists, digests, details and statistics, in messages of bounded size."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories as ct
from ..functions import dates as dt
from ..functions import text as tx
from . import notify
from .long_lists import packed

AGAIN = " <i>(devam)</i>"


def pack_blocks(header: Column, lines: Column, limit: int = notify.SAFE_LIMIT) -> Column:
    """Messages of at most ``limit`` characters from ordered lines, structs of (heading, line).

    A new heading goes before its first line with a blank line between; a message that
    goes on repeats header and heading with a mark; an overlong line is cut.
    """

    def cut(x: Column) -> Column:
        return F.when(F.length(x) <= limit - 200, x).otherwise(F.concat(F.substring(x, 1, limit - 200), F.lit("…")))

    state = F.struct(F.array().cast("array<string>").alias("done"), header.alias("open"), F.lit("").alias("under"))

    def step(s: Column, x: Column) -> Column:
        line, heading = cut(x["line"]), F.coalesce(x["heading"], F.lit(""))
        fresh = (heading != "") & (heading != s["under"])
        head = F.when(fresh, F.concat(F.lit("\n\n"), heading)).otherwise("")
        full = F.length(s["open"]) + F.length(head) + F.length(line) + 1 > limit
        again = F.concat(header, F.lit(AGAIN), F.when(fresh, head).when(heading != "", F.concat(F.lit("\n\n"), heading, F.lit(AGAIN))).otherwise(""))
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.concat(F.when(full, again).otherwise(F.concat(s["open"], head)), F.lit("\n"), line).alias("open"),
            heading.alias("under"),
        )

    return F.aggregate(lines, state, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def line_of(ref: date, with_date: Column) -> Column:
    """The lines of an event; its date only where asked for, else its time."""
    when = F.when(with_date, dt.format_dates(F.col("start"), F.col("end"), F.col("minute"), ref)).otherwise(F.when(F.col("minute").isNotNull(), dt.clock_label(F.col("minute"))))
    price = F.when(F.col("is_free"), F.lit("🆓 <b>Ücretsiz</b>")).otherwise(F.concat(F.lit("🎟 "), tx.esc(F.col("price_label"))))
    return notify.event_line(F.col("title"), F.col("url"), F.col("category"), when, F.col("venue"), price, F.col("source_count"))


def by_day(events: DataFrame, key: str, header: Column, ref: date) -> DataFrame:
    """(key, n, message): the events of each key by day, then time and title, under day headings."""
    line = line_of(ref, F.col("end") > F.col("start"))
    rows = events.select(
        key, "start", F.coalesce("minute", F.lit(0)).alias("at"), "title", "uid", notify.day_heading(F.col("start"), ref).alias("heading"),
        F.when(F.length(line) <= notify.SAFE_LIMIT - 200, line).otherwise(F.concat(F.substring(line, 1, notify.SAFE_LIMIT - 200), F.lit("…"))).alias("line"), header.alias("header"),
    )
    return packed(rows, key, ["start", "at", "title", "uid"], F.col("line"), F.col("heading"), F.col("header"), notify.SAFE_LIMIT)


def detail(ref: date) -> Column:
    """The card of one event (title, start, end, minute, venue, category, is_free, price_label, description, sources, source_titles)."""
    links = F.transform(
        F.array_sort("sources"),
        lambda s: F.when(s["url"] != "", F.concat(F.lit('• <a href="'), tx.esc(s["url"]), F.lit('">'), tx.esc(s["source"]), F.lit("</a>"))).otherwise(F.concat(F.lit("• "), tx.esc(s["source"]))),
    )
    others = F.array_except(F.transform("source_titles", lambda t: t["title"]), F.array("title"))
    named = F.transform(F.slice(F.array_sort(others), 1, 4), lambda t: F.concat(F.lit("<i>· "), tx.esc(tx.truncate(t, 70)), F.lit("</i>")))
    return F.concat_ws(
        "\n",
        F.concat(ct.category_mark(F.col("category")), F.lit(" <b>"), tx.esc(F.col("title")), F.lit("</b>")),
        F.lit(""),
        F.concat(F.lit("🗓 "), tx.esc(dt.format_dates(F.col("start"), F.col("end"), F.col("minute"), ref))),
        F.when(F.coalesce("venue", F.lit("")) != "", F.concat(F.lit("📍 "), tx.esc(F.col("venue")))),
        F.concat(F.lit("🏷 "), tx.esc(ct.category_label(F.col("category")))),
        F.when(F.col("is_free"), F.lit("🆓 <b>Ücretsiz</b>")).otherwise(F.concat(F.lit("🎟 "), tx.esc(F.col("price_label")))),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n"), tx.esc(tx.truncate(F.col("description"), 400)))),
        F.when(F.size("sources") > 0, F.concat(F.lit("\n<b>Kaynaklar:</b>\n"), F.array_join(links, "\n"))),
        F.when((F.size("source_titles") > 1) & (F.size(others) > 0), F.concat(F.lit("\n<i>Diğer kaynaklardaki adlandırmalar:</i>\n"), F.array_join(named, "\n"))),
    )


def stats_text(counts: DataFrame, categories: DataFrame) -> DataFrame:
    """One row ``message`` from counts (total, upcoming, free, multi_source) and categories (category, n): the ten most frequent."""
    top = categories.orderBy(F.desc("n"), "category").limit(10)
    known = F.coalesce(F.concat(ct.category_mark(F.col("category")), F.lit(" "), ct.category_label(F.col("category"))), F.concat(F.lit("• "), tx.esc(F.col("category"))))
    lines = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "category", F.concat(known, F.lit(": "), F.col("n").cast("string")).alias("line")))).alias("__l"))
    text = F.concat_ws(
        "\n", F.lit("<b>📊 Bot Durumu</b>\n"),
        *[F.concat(F.lit(f"{label}: <b>"), F.col(c).cast("string"), F.lit("</b>")) for label, c in (("Gelecek etkinlik", "upcoming"), ("Bunlardan ücretsiz", "free"), ("Birden fazla kaynakta doğrulanan", "multi_source"))],
        F.concat(F.lit("Veritabanındaki toplam kayıt: "), F.col("total").cast("string")),
        F.when(F.size("__l") > 0, F.concat(F.lit("\n<b>Kategoriler</b>\n"), F.array_join(F.transform("__l", lambda x: x["line"]), "\n"))),
    )
    # one row each, put side by side
    return counts.withColumn("__one", F.lit(1)).join(lines.withColumn("__one", F.lit(1)), "__one").select(text.alias("message"))
