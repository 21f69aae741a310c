"""What chats are sent: replies to a date bucket, the morning's digest, news. Texts are made once per distinct setting.

Events have uid, title, start, end, minute, url, category, venue, is_free, price_label and source_count; subscribers chat_id,
free_only, categories and keywords. Null flags are false, null lists empty.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as dt
from ..functions import text as tx
from . import notify, read, subscribers as subs
from .long_lists import packed
from .render import line_of
from .resolve import checkpointed

# The buckets' names and what is said where nothing is found.
BUCKET_NAMES = {
    "bugun": "Bugün", "yarin": "Yarın", "bu_hafta": "Bu Hafta", "hafta_sonu": "Bu Hafta Sonu", "gelecek_hafta": "Gelecek Hafta", "bu_ay": "Bu Ay", "ileride": "İleriki Tarihler", "gecmis": "Geçmiş",
}
NOTHING = "Bu aralıkta etkinlik bulunamadı."
NOTHING_FREE = "Bu aralıkta ücretsiz etkinlik bulunamadı."
NOTHING_IN = {
    "bugun": "Bugün için kayıtlı etkinlik yok. /hafta ile bu haftaya bakabilirsiniz.", "yarin": "Yarın için kayıtlı etkinlik yok.", "hafta_sonu": "Bu hafta sonu için kayıtlı etkinlik yok.",
}
#: Events of a digest and of a round of news.
DIGEST, NEWS = 40, 30


def texts(asked: DataFrame, found: DataFrame, key: str, order: list[str], ref: date, days: bool = False) -> DataFrame:
    """(key, n, message) for each row of asked(key, title, empty, footer, tail): found(key, events) in ``order``, or by day under headings.

    A key without events gets one message with ``empty`` (none if that is null). A footer follows the last message after a
    blank line, or as a message of its own where it does not fit; a tail is joined to the last message. Keys are not null
    and stand once in ``asked``.
    """
    heads = asked.select(F.col(key).alias("__key"), F.concat(F.lit("<b>"), tx.esc(F.col("title")), F.lit("</b>")).alias("header"), tx.esc(F.col("empty")).alias("__none"), F.col("empty").isNull().alias("__skip"), "footer", "tail")
    show = (F.col("end") > F.col("start")) if days else F.lit(True)
    line = line_of(ref, show)
    cut = F.when(F.length(line) <= notify.SAFE_LIMIT - 200, line).otherwise(F.concat(F.substring(line, 1, notify.SAFE_LIMIT - 200), F.lit("…")))
    sort = ["start", "__at", "title", "uid"] if days else [f"__o{i}" for i in range(len(order))]
    keyed = found.withColumns({"__at": F.coalesce("minute", F.lit(0)), **{f"__o{i}": F.col(c) for i, c in enumerate(order)}}).withColumnRenamed(key, "__key")
    lines = keyed.select("__key", *sort, cut.alias("__line"), (notify.day_heading(F.col("start"), ref) if days else F.lit("")).alias("__heading"))
    made = packed(lines.join(heads.select("__key", "header"), "__key"), "__key", sort, F.col("__line"), F.col("__heading"), F.col("header"), notify.SAFE_LIMIT)
    made = checkpointed(made, "messages")
    ends = made.groupBy("__key").agg(F.max("n").alias("__last")).join(heads.drop("header"), "__key")
    foot = F.when(F.coalesce("footer", F.lit("")) != "", tx.esc(F.col("footer")))
    fits = F.length("message") + F.length(foot) + 2 <= notify.SAFE_LIMIT
    tail = F.coalesce("tail", F.lit(""))
    closing = F.when(F.col("n") < F.col("__last"), F.array("message")).when(foot.isNull(), F.array(F.concat("message", tail))).when(
        fits, F.array(F.concat("message", F.lit("\n\n"), foot, tail))).otherwise(F.array(F.col("message"), F.concat(foot, tail)))
    told = made.join(ends, "__key").select("__key", "n", F.posexplode(closing).alias("__more", "message")).select("__key", (F.col("n") + F.col("__more")).alias("n"), "message")
    silent = heads.filter(~F.col("__skip")).join(made.select("__key"), "__key", "left_anti")
    silent = silent.select("__key", F.lit(1).cast("long").alias("n"), F.concat("header", F.lit("\n\n"), "__none").alias("message"))
    return told.unionByName(silent).withColumnRenamed("__key", key)


def _to_chats(of: DataFrame, made: DataFrame) -> DataFrame:
    return of.join(made.withColumnRenamed("chat_id", "wish"), "wish").select("chat_id", "n", "message")


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def bucket_texts(events: DataFrame, subscribers: DataFrame, bucket: str, ref: date, order: list[str]) -> DataFrame:
    """(chat_id, n, message): each chat's reply to a bucket by day, its first events in ``order`` under the saved filters."""
    of, wishes = notify.settings(subscribers.withColumn("keywords", F.array().cast("array<string>")))
    found = subs.bucket_replies(events, wishes, bucket, ref, order).drop("n")
    free, name = F.col("free_only"), BUCKET_NAMES[bucket]
    asked = wishes.select(
        "chat_id", F.when(free, f"{name} — Ücretsiz Etkinlikler").otherwise(f"{name} İzmir'de").alias("title"),
        F.when(free, NOTHING_FREE).otherwise(NOTHING_IN.get(bucket, NOTHING)).alias("empty"), _text(None).alias("footer"), _text(None).alias("tail"),
    )
    return _to_chats(of, texts(asked, found, "chat_id", order, ref, days=True))


def digest_texts(events: DataFrame, subscribers: DataFrame, ref: date, order: list[str], limit: int = DIGEST) -> DataFrame:
    """(chat_id, n, message): the first ``limit`` events of the day that each chat's filters pass, and how many of the day's are free."""
    of, wishes = notify.settings(subscribers)
    today = checkpointed(read.in_bucket(events, "bugun", ref).orderBy(*order).limit(limit), "today")
    free = today.agg(F.count_if("is_free").alias("free"))
    day, only = F.lit(ref), F.col("free_only")
    greeting = F.concat(F.lit("🌅 Günaydın! "), F.day(day).cast("string"), F.lit(" "), dt.month_label(day), F.lit(" "), dt.weekday_label(day), F.lit(" — İzmir'de bugün"))
    # one row of counts beside every wish
    asked = wishes.join(F.broadcast(free), F.lit(True)).select(
        "chat_id", F.when(only, "🆓 Bugün İzmir'de ücretsiz").otherwise(greeting).alias("title"),
        F.when(only, "Bugün için kayıtlı ücretsiz etkinlik yok.").otherwise("Bugün için kayıtlı etkinlik yok. Yarına bakmak için /yarin.").alias("empty"),
        F.when(~only & (F.col("free") > 0), F.concat(F.lit("Bugünkü "), F.col("free").cast("string"), F.lit(" etkinlik ücretsiz. Tümü için: /ucretsiz"))).alias("footer"), _text(None).alias("tail"),
    )
    return _to_chats(of, texts(asked, notify.matches(today, wishes), "chat_id", order, ref))


def news_texts(events: DataFrame, subscribers: DataFrame, ref: date, order: list[str], limit: int = NEWS) -> DataFrame:
    """(chat_id, n, message): of the first ``limit`` unannounced events those that a chat's filters pass, twelve shown and the rest counted; nothing where none passes."""
    of, wishes = notify.settings(subscribers)
    fresh = checkpointed(read.unannounced(events, ref, limit), "news")
    matched = checkpointed(notify.matches(fresh, wishes), "matched")
    by = Window.partitionBy("chat_id").orderBy(*order)
    shown = matched.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= notify.FIRST).drop("__n")
    n = F.least("all", F.lit(notify.FIRST))
    asked = matched.groupBy("chat_id").agg(F.count(F.lit(1)).alias("all")).select(
        "chat_id", F.concat(F.lit("✨ "), n.cast("string"), F.lit(" yeni etkinlik eklendi")).alias("title"), _text(None).alias("empty"), _text(None).alias("footer"),
        F.when(F.col("all") > n, F.concat(F.lit("\n\n<i>…ve "), (F.col("all") - n).cast("string"), F.lit(" etkinlik daha. /hafta</i>"))).alias("tail"),
    )
    return _to_chats(of, texts(asked, shown, "chat_id", order, ref))
