"""Keywords by automaton, and settings that look alike."""

from datetime import date

from pyspark.sql import functions as F

from eventloom.functions import keywords
from eventloom.operators import notify, subscribers


def test_parts_of_keywords_find_the_same(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(["rock gecesi", "caz ve rock", "", None, "ROCK", "ğüş öç"])]
    words = ["rock", "Rock", "caz", "ve r", "x", "", None, "ğü", "gecesi", "rock"]
    want = sorted((i, w) for i, t in texts for w in {w for w in words if w is not None} if t is not None and w.lower() in t)
    df, asked = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame([(w,) for w in words], "w string")
    for most in (100, 2):
        monkeypatch.setattr(keywords, "KEYWORDS", most)
        assert sorted(map(tuple, keywords.found_in(df, "t", asked, "w").collect())) == want
    assert keywords.found_in(df, "t", asked.limit(0), "w").isEmpty()


def test_many_keywords_without_a_nested_loop(spark):
    names = spark.createDataFrame([(f"word{k} gecesi", "") for k in range(300)], "title string, venue string")
    events = names.select("title", "venue", F.col("title").alias("uid"), F.lit("konser").alias("category"), F.lit(True).alias("is_free"))
    chats = spark.range(100_000).select(F.col("id").alias("chat_id"), F.lit(None).cast("boolean").alias("free_only"), F.array().cast("array<string>").alias("categories"), F.array(F.concat(F.lit("word"), F.col("id"))).alias("keywords"))
    got = notify.matches(events, chats)
    assert "NestedLoop" not in got.filter("size(keywords) > 0")._jdf.queryExecution().toString().split("Union")[-1]
    assert got.count() == sum(str(k).startswith(str(i)) for i in range(300) for k in range(300))


def test_settings_that_look_alike_stay_apart(spark):
    day = date(2026, 8, 27)
    events = spark.createDataFrame([("u", "t", "v", day, day, "a", True), ("w", "t", "v", day, day, "a|b", False)], "uid string, title string, venue string, start date, end date, category string, is_free boolean")
    kind = "chat_id long, free_only boolean, categories array<string>"
    chats = spark.createDataFrame([(1, False, ["a|b"]), (2, None, ["a", "b"]), (3, None, None), (4, True, [])], kind)
    got = {(r.chat_id, r.uid) for r in subscribers.bucket_replies(events, chats, "bugun", day, ["uid"]).collect()}
    assert got == {(1, "w"), (2, "u"), (3, "u"), (3, "w"), (4, "u")}
