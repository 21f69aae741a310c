from datetime import date

from pyspark.sql import functions as F

REF = date(2026, 8, 27)
EVENT = "uid string, title string, start date, end date, minute int, url string, category string, venue string, is_free boolean, price_label string, source_count int, announced boolean"
CHAT = "chat_id long, free_only boolean, categories array<string>, keywords array<string>"


def _rows(n, free=False):
    return [(f"u{i:02d}", f"Title {i:02d}", REF, REF, 1200, "", "konser", "Arena", free, "1 ₺", 1, False) for i in range(n)]


def test_digest_news_and_bucket_texts(spark):
    from eventloom.operators import replies

    e = spark.createDataFrame(_rows(15) + [("f", "Free one", REF, REF, None, "https://x/", "sergi", None, True, None, 2, False)], EVENT)
    chats = spark.createDataFrame([(1, None, None, None), (2, True, [], []), (3, False, ["sinema"], []), (4, False, [], ["arena"])], CHAT)
    order = ["start", "title", "uid"]
    got = {(r.chat_id, r.n): r.message for r in replies.digest_texts(e, chats, REF, order).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert got[1, 1].startswith("<b>🌅 Günaydın! 27 Ağustos Perşembe — İzmir'de bugün</b>\n🖼 ") and got[1, 1].endswith("\n\nBugünkü 1 etkinlik ücretsiz. Tümü için: /ucretsiz")
    assert got[2, 1] == "<b>🆓 Bugün İzmir'de ücretsiz</b>\n🖼 <a href=\"https://x/\">Free one</a>\n   Bugün (27 Ağustos Perşembe)\n   🆓 <b>Ücretsiz</b> · 🔗 2 kaynak"
    assert got[3, 1].endswith("\n\nBugün için kayıtlı etkinlik yok. Yarına bakmak için /yarin.")
    assert got[4, 1].count("🎵") == 15 and "🖼" not in got[4, 1]
    news = {(r.chat_id, r.n): r.message for r in replies.news_texts(e, chats, REF, order).collect()}
    assert set(news) == {(1, 1), (2, 1), (4, 1)} and news[1, 1].startswith("<b>✨ 12 yeni etkinlik eklendi</b>\n") and news[1, 1].endswith("\n\n<i>…ve 4 etkinlik daha. /hafta</i>")
    bucket = {(r.chat_id, r.n): r.message for r in replies.bucket_texts(e, chats, "bugun", REF, order).collect()}
    assert bucket[2, 1].startswith("<b>Bugün — Ücretsiz Etkinlikler</b>\n\n<b>📅 Bugün — 27 Ağustos Perşembe</b>\n🖼 ") and bucket[1, 1] == bucket[4, 1]
    assert bucket[3, 1] == "<b>Bugün İzmir'de</b>\n\nBugün için kayıtlı etkinlik yok. /hafta ile bu haftaya bakabilirsiniz."


def test_footers_that_do_not_fit_and_nothing_to_tell(spark):
    from eventloom.operators import replies

    asked = spark.createDataFrame([("k", "T", None, "f" * 500, "!")], "key string, title string, empty string, footer string, tail string")
    e = spark.createDataFrame(_rows(70), EVENT).withColumn("key", F.lit("k"))
    got = {r.n: r.message for r in replies.texts(asked, e, "key", ["uid"], REF).collect()}
    last = max(got)
    assert all(len(m) <= 3800 for m in got.values()) and sorted(got) == list(range(1, last + 1)) and got[last].endswith("f" * 500 + "!")
    assert sum(m.count("🎵") for m in got.values()) == 70
    none = spark.createDataFrame([], EVENT)
    chats = spark.createDataFrame([(1, False, [], [])], CHAT)
    assert replies.news_texts(none, chats, REF, ["uid"]).count() == 0 and replies.digest_texts(none, chats.limit(0), REF, ["uid"]).count() == 0
    assert [r.message for r in replies.bucket_texts(none, chats, "bu_ay", REF, ["uid"]).collect()] == ["<b>Bu Ay İzmir'de</b>\n\nBu aralıkta etkinlik bulunamadı."]
