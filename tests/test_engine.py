from datetime import date, datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from eventloom.operators import filters, notify, read, resolve, store
from eventloom.sources import extract as ex
from eventloom.sources import pages as pg
from eventloom.streaming import ingest


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def similarity(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0

    def ratio(x, y):
        return 2 * lcs(x, y) / (len(x) + len(y))

    sort = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    ta, tb = set(a.split()), set(b.split())
    both, x, y = ta & tb, ta - tb, tb - ta
    if both and (not x or not y):
        token_set = 1.0
    else:
        s, jx, jy = " ".join(sorted(both)), " ".join(sorted(x)), " ".join(sorted(y))
        g = 1 if s else 0
        la, lb = len(s) + g + len(jx), len(s) + g + len(jy)
        token_set = 1 - (len(jx) + len(jy) - 2 * lcs(jx, jy)) / (la + lb)
        if s:
            token_set = max(token_set, 1 - (g + len(jx)) / (len(s) + la), 1 - (g + len(jy)) / (len(s) + lb))
    return (token_set + sort) / 2


def listings(spark, rows):
    full = [
        Row(
            idx=i, title=t, venue=v, start=date.fromisoformat(s), end=date.fromisoformat(e or s), minute=None, category=c, description=None, image=None, source=src,
            url=u, priority=p, first_seen=None, price=Row(is_free=False, min=m, max=None, raw=f"{m} TL" if m else "", needs_registration=False),
        )
        for i, (t, v, s, e, c, src, u, p, m) in enumerate(rows)
    ]
    schema = (
        "idx long, title string, venue string, start date, end date, minute int, category string, description string, image string, source string, url string, "
        "priority int, first_seen timestamp, price struct<is_free:boolean,min:double,max:double,raw:string,needs_registration:boolean>"
    )
    return spark.createDataFrame(full, schema)


CONCERT = [
    ("Sezen Aksu Konseri", "Kültürpark Açıkhava", "2026-09-12", None, "konser", "a", "https://a.com/1", 10, 500.0),
    ("SEZEN AKSU | İZMİR", "", "2026-09-12", None, "diger", "b", "https://b.com/1", 20, None),
    ("Sezen Aksu - Kültürpark Açıkhava Tiyatrosu", "Kültürpark Açıkhava Tiyatrosu", "2026-09-12", None, "konser", "c", "", 5, 750.0),
    ("Sezen Aksu (İzmir) Bileti", None, "2026-09-12", None, "konser", "a", "https://a.com/2", 10, None),
    ("Hamlet", "AKM", "2026-09-12", None, "tiyatro", "a", "https://a.com/3", 10, 100.0),
    ("Hamlet Makinesi", "AKM", "2026-09-12", None, "tiyatro", "b", "https://b.com/3", 20, 100.0),
    ("Uzun Sergi", "Galeri", "2026-09-01", "2026-09-30", "sergi", "a", "https://a.com/4", 10, None),
    ("Uzun Sergi", "Galeri", "2026-09-12", None, "sergi", "b", "https://b.com/4", 20, None),
]


def test_title_similarity(spark):
    words = ["hamlet", "hamlet makinesi", "sezen aksu", "aksu sezen", "sezen aksu akustik", "tarkan", "", "manga"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", resolve.title_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert abs(r.s - similarity(r.a, r.b)) < 1e-9, r


def test_clusters_and_merge(spark):
    x = listings(spark, CONCERT)
    roots = resolve.clusters(x)
    assert {r.idx: r.root for r in roots.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 7}
    m = {r.root: r for r in resolve.merge_clusters(x, roots).collect()}
    got = m[0]
    assert (got.title, got.venue, got.category, got.records, got.source_count) == ("Sezen Aksu", "Kültürpark Açıkhava", "konser", 4, 3)
    assert (got.is_free, got.price_min, got.price_max) == (False, 500.0, 750.0)
    assert [tuple(s) for s in got.sources] == [("b", "https://b.com/1"), ("a", "https://a.com/1"), ("c", "")]
    assert dict(map(tuple, got.source_titles))["a"] == "Sezen Aksu (İzmir) Bileti"


def test_blocking_is_not_a_range_join(spark):
    x = listings(spark, [("A Bir", "", "2026-09-01", None, "", "a", "", 1, None), ("A Bir", "", "2026-09-02", None, "", "b", "", 1, None)])
    assert resolve.candidate_pairs(x.select("idx", "start", "end")).count() == 0


def test_a_record_of_four_days_meets_its_inner_days(spark):
    days = [("2026-09-01", "2026-09-04"), ("2026-09-02", None), ("2026-09-03", None), ("2026-09-01", "2026-09-05"), ("2026-09-10", "2026-09-13"), ("2026-09-20", "2026-09-24")]
    x = listings(spark, [("A Bir", "", s, e, "", "a", "", 1, None) for s, e in days])
    got = {(r.l_idx, r.r_idx) for r in resolve.candidate_pairs(x.select("idx", "start", "end")).collect()}
    assert got == {(0, 1), (0, 2), (0, 3)}
    keys = {r.idx: r.k for r in x.select("idx", resolve.block_keys(F.col("start"), F.col("end")).alias("k")).collect()}
    assert keys[0] == ["2026-09-01", "2026-09-02", "2026-09-03", "2026-09-04"] and keys[3] == ["2026-09-01", "2026-09-05", "long 2026-09"]
    assert {r.idx: r.root for r in resolve.clusters(x).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "l_idx long, r_idx long")
    roots = resolve.components(edges, spark.range(42).withColumnRenamed("id", "idx"))
    assert {r.idx: r.root for r in roots.collect()} == {i: 0 for i in range(41)} | {41: 41}


def test_city_filter(spark):
    rows = [("İstanbul Devlet Tiyatrosu", False, True), ("İstanbul Tiyatrosu İzmir Turnesi", True, False), ("Selamiçeşme Parkı", False, True), ("Aydınlık Gece", False, False), ("izmirde", True, False)]
    df = spark.createDataFrame(rows, "t string, local boolean, other boolean")
    text = filters.blob(F.col("t"))
    assert df.filter((filters.mentions_local(text) != F.col("local")) | (filters.is_other_city(text) != F.col("other"))).count() == 0
    junk = spark.createDataFrame([("Anasayfa", True), ("29 Ağustos 2026", True), ("ab", True), ("Hamlet", False)], "t string, j boolean")
    assert junk.filter(filters.is_junk_title(F.col("t")) != F.col("j")).count() == 0


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", datetime(2026, 1, 1), datetime(2026, 1, 1), True), (2, "b", datetime(2026, 1, 1), datetime(2026, 1, 1), False)], "k long, t string, first_seen timestamp, last_seen timestamp, announced boolean")
    new = spark.createDataFrame([(2, "B", False), (3, "c", False)], "k long, t string, announced boolean")
    t = store.Table(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.replace(old)
    got = {r.k: r for r in t.replace(store.upsert(t.read(), new, "k", datetime(2026, 2, 1))).collect()}
    assert (got[1].t, got[1].announced, got[2].t, got[2].first_seen.month, got[2].last_seen.month, got[3].first_seen.month) == ("a", True, "B", 1, 2, 2)
    assert store.prune_stale(t.read(), datetime(2026, 2, 1), 14).count() == 2 and store.prune_stale(t.read(), datetime(2026, 2, 1), 0).count() == 3
    health = spark.createDataFrame([("a", 2, None, "x"), ("b", 1, None, None)], "source string, failures int, last_success timestamp, last_error string")
    ran = spark.createDataFrame([("a", True, []), ("c", False, ["e1", "e2", "e3", "e4"])], "source string, ok boolean, errors array<string>")
    after = {r.source: r for r in store.update_health(health, ran, datetime(2026, 2, 1)).collect()}
    assert (after["a"].failures, after["b"].failures, after["c"].failures, after["c"].last_error) == (0, 1, 1, "e1; e2; e3")


def test_messages_fit(spark):
    df = spark.createDataFrame([("x", i, f"line {i} " + "y" * 100) for i in range(120)] + [("z", 0, "w" * 5000)], "k string, i int, line string").withColumn("h", F.lit("<b>head</b>"))
    rows = notify.messages(df, "k", "line", ["i"], "h").orderBy("k", "n").collect()
    assert all(len(r.message) <= notify.SAFE_LIMIT for r in rows)
    joined = "\n".join(r.message for r in rows if r.k == "x")
    assert all(f"line {i} " in joined for i in range(120)) and rows[1].message.startswith("<b>head</b> <i>(devam)</i>")


def test_matches_of_subscribers(spark):
    e = spark.createDataFrame([("u1", "Rock Gecesi", "Arena", "konser", False), ("u2", "Hamlet", "AKM", "tiyatro", True)], "uid string, title string, venue string, category string, is_free boolean")
    s = spark.createDataFrame([(1, True, [], []), (2, False, ["konser"], []), (3, False, [], ["hamlet"]), (4, False, [], [])], "chat_id int, free_only boolean, categories array<string>, keywords array<string>")
    got = {(r.chat_id, r.uid) for r in notify.matches(e, s).collect()}
    assert got == {(1, "u2"), (2, "u1"), (3, "u2"), (4, "u1"), (4, "u2")}


JSONLD = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@type":"MusicEvent","name":"Konser","startDate":"2026-09-12T20:00","location":{"name":"Arena"},"offers":[{"price":"450","priceCurrency":"TRY"},{"price":600}]}},{"item":{"@type":"TheaterEvent","name":"Oyun","startDate":"2026-09-13","location":"AKM","offers":{"price":"0"}}}]}</script>'
NEXT = '<script id="__NEXT_DATA__">{"props":{"list":[{"eventName":"Caz Gecesi","startDate":"2026-09-14","mekan":"Sahne","fiyat":300},{"comment":"hi"}]}}</script>'
CARDS = "".join(f'<div class="ListCard_root__x{i}"><a href="/e/{i}"><h3>Etkinlik {w}</h3></a><p>1{i} Eylül 2026 - Kent Tiyatrosu<b>{i}50 TL</div>' for i, w in enumerate(("Bir", "İki", "Üç")))


def test_extraction(spark):
    html = f"<html><nav><ul><li><a href=/>Ana</a></li></ul></nav>{JSONLD}{NEXT}{CARDS}<footer>2026</footer></html>"
    sources = spark.createDataFrame([("s", list(ex.STRATEGIES), {"item": "div", "title": "h3"})], "key string, strategies array<string>, selectors map<string,string>")
    rows = ex.extract(spark.createDataFrame([(1, "s", html), (2, "s", None), (3, None, "<p><b>x")], "page_id long, source string, html string"), sources, date(2026, 8, 27))
    by = {}
    for r in rows.orderBy("strategy", "card_ord").collect():
        by.setdefault(r.strategy, []).append(r)
    assert [(r.title, r.venue, r.price_text) for r in by["jsonld"]] == [("Konser", "Arena", "450.0 TL - 600.0 TL"), ("Oyun", "AKM", "Ücretsiz")]
    assert [(r.title, r.venue, r.price_text) for r in by["nextdata"]] == [("Caz Gecesi", "Sahne", "300 TL")]
    assert {r.title for r in by["heuristic"]} == {"Etkinlik Bir", "Etkinlik İki", "Etkinlik Üç"}
    assert len(by["selectors"]) == 3
    best = read.best_strategy(rows, ["jsonld", "nextdata"])
    assert best.filter("page = 1").first().n == 3


def test_pages(spark, tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("sources:\n- {key: a, url: 'https://x.com/l', pagination: {param: p, max_pages: 3}}\n- {key: b, url: 'https://y.com', enabled: false}\n")
    src = pg.load_sources(spark, str(f))
    urls = pg.paged_urls(pg.enabled(src)).orderBy("ord").collect()
    assert [r.url for r in urls] == ["https://x.com/l", "https://x.com/l?p=2", "https://x.com/l?p=3"]
    df = spark.createDataFrame([("/a", "https://x.com/a"), ("b", "https://x.com/d/b"), ("//y.com/c", "https://y.com/c"), ("mailto:x", None), ("", None), ("https://z.com", "https://z.com")], "h string, w string")
    assert df.filter(~pg.absolutize(F.lit("https://x.com/d/e?x=1"), F.col("h")).eqNullSafe(F.col("w"))).count() == 0


def test_stream_in_two_batches(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, event_type string, value double"
    rows = [(1, datetime(2026, 1, 1), 1, "a", 1.0), (1, datetime(2026, 1, 3), 2, "b", 2.0), (2, datetime(2026, 1, 2), 3, "c", 1.0)]
    for i, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = store.Table(spark, str(tmp_path / "t"))
    ingest.upsert_stream(ingest.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), t, str(tmp_path / "c"), "user_id", ["ts", "event_id"])
    assert {(r.user_id, r.n, r.last.event_type) for r in t.read().collect()} == {(1, 2, "b"), (2, 1, "c")}


def test_build_cleans_titles_and_finds_dates(spark):
    from eventloom.operators import build

    ref = date(2026, 8, 27)
    sources = spark.createDataFrame([("a", False, None, False, 90), ("b", True, "konser", True, None)], "key string, city_filter boolean, default_category string, free_by_default boolean, priority int")
    rows = [
        (1, "a", "Kuş Sesleri 18 Eylül 2026 / Bostanlı Suat Taşer Tiyatrosu GÜNCEL", None, None, None, "100 TL"),
        (2, "a", "Deniz Arena", "12.09.2026", "2026-09-10", "Deniz Arena", None),
        (3, "a", "Uzun Sergi", "12.09.2026", "2026-10-01", None, None),
        (4, "b", "İzmir buluşması", "yarın 20:00", None, None, None),
        (5, "b", "Yersiz buluşma", "yarın 20:00", None, None, None),
        (6, "a", "12 Ekim 2026", None, None, None, None),
        (7, "a", None, "yarın", None, None, None),
    ]
    raw = spark.createDataFrame(rows, "idx long, source string, title string, date_text string, end_text string, venue string, price_text string")
    got = {r.idx: r for r in build.judged(raw, sources, ref).collect()}
    assert (got[1].title, got[1].venue, got[1].start, got[1].reason) == ("Kuş Sesleri", "Bostanlı Suat Taşer Tiyatrosu", date(2026, 9, 18), None)
    assert got[1].price["min"] == 100 and not got[1].price["is_free"]
    assert (got[2].title, got[2].end) == ("Deniz Arena", date(2026, 9, 12))  # an earlier end is none
    assert (got[3].start, got[3].end, got[3].category) == (date(2026, 9, 12), date(2026, 10, 1), "sergi")
    assert (got[4].start, got[4].minute, got[4].category, got[4].price["is_free"]) == (date(2026, 8, 28), 1200, "konser", True)
    assert got[5].reason == "no_city" and got[6].reason == "junk"
    assert {r.idx: r.priority for r in build.with_priority(raw, sources).collect()} == {1: 90, 2: 90, 3: 90, 4: 50, 5: 50, 6: 90, 7: 90}


def test_scrape_flow_reaches_the_store(spark, tmp_path):
    from eventloom.operators import build, store

    ref = date(2026, 8, 27)
    sources = spark.createDataFrame([("a", False, None, False, 90), ("b", False, None, False, 10), ("c", False, None, False, 5)], "key string, city_filter boolean, default_category string, free_by_default boolean, priority int")
    rows = [
        (1, "a", "p1", "jsonld", 0, "Kuş Sesleri", "2026-09-01", "Deniz Arena"), (2, "b", "p2", "selectors", 2, "Kuş Sesleri Konseri", "2026-09-01", "Deniz Arena"),
        (3, "b", "p2", "heuristic", 3, "Başka bir şey", "2026-09-02", None), (4, "b", "p2", "selectors", 2, "Geçmiş oyun", "2020-01-01", None),
    ]
    raw = spark.createDataFrame(rows, "idx long, source string, page string, strategy string, strategy_ord int, title string, date_text string, venue string")
    judged, merged = build.scrape(raw, sources, ref)
    assert [(r.records, r.source_count, r.start) for r in merged.collect()] == [(2, 2, date(2026, 9, 1))]
    report = {r.source: (r.found, r.kept, r.past) for r in build.source_report(judged, sources).collect()}
    assert report == {"a": (1, 1, 0), "b": (2, 1, 1), "c": (0, 0, 0)}
    table = store.Table(spark, str(tmp_path / "events"))
    from eventloom.functions import text as tx
    from eventloom.operators import resolve

    out = merged.withColumn("uid", resolve.event_uid(tx.normalize_title(F.col("title")), F.col("start"), tx.normalize_venue(F.col("venue")))).select("uid", "title", "start", "end")
    first = build.store_events(table, out, datetime(2026, 8, 27)).collect()
    again = build.store_events(table, out, datetime(2026, 8, 28)).collect()
    assert len(first) == len(again) == 1 and again[0].first_seen == datetime(2026, 8, 27) and again[0].last_seen == datetime(2026, 8, 28)


def test_day_messages_repeat_header_and_heading(spark):
    from eventloom.operators import render

    rows = [("k", i, f"Event {i:03d} " + "x" * 60, date(2026, 8, 27 + i % 2)) for i in range(150)] + [("j", 0, "y" * 5000, date(2026, 8, 27))]
    df = spark.createDataFrame(rows, "k string, uid long, title string, start date").withColumns({
        "end": F.col("start"), "minute": F.lit(None).cast("int"), "url": F.lit(""), "category": F.lit("konser"), "venue": F.lit("Arena"), "price_label": F.lit("1 ₺"), "is_free": F.lit(False), "source_count": F.lit(1),
    })
    got = {}
    for r in render.by_day(df, "k", F.lit("<b>H</b>"), date(2026, 8, 27)).collect():
        got.setdefault(r.k, []).append((r.n, r.message))
    texts = [m for _, m in sorted(got["k"])]
    assert all(len(m) <= 4096 for m in texts) and len(got["j"]) == 1
    assert texts[0].startswith("<b>H</b>\n\n<b>📅 Bugün — 27 Ağustos Perşembe</b>\n🎵 ")
    assert all(m.startswith("<b>H</b> <i>(devam)</i>\n\n<b>📅 ") for m in texts[1:])
    whole = "\n".join(texts)
    assert whole.count("📍 Arena") == 150 and whole.count("<b>📅 Yarın — 28 Ağustos Cuma</b>\n") == 1


def test_embedded_json_dates_and_synonyms(spark):
    from eventloom.sources import extract as ex

    body = '[{"title":"Good one","startDate":"2026-09-01","x":1},{"title":"Bad day","startDate":"2026-99-99","x":1},{"name":{},"title":"Second name","date":"yarın 20:00"}]'
    page = spark.createDataFrame([(1, f'<script type="application/json">{body}</script>'), (2, None), (3, "")], "page_id long, html string")
    rows = ex.extract(page, ref=date(2026, 8, 27))
    assert sorted((r.page, r.title, r.start_text) for r in rows.collect()) == [(1, "Good one", "2026-09-01"), (1, "Second name", "yarın 20:00")]
    counts = ex.strategy_counts(rows, date(2026, 8, 27))
    assert [(r.page, r.strategy, r.dated) for r in ex.best_by_dates(counts).collect()] == [(1, "nextdata", 2)]


def test_subscribers(spark):
    from eventloom.operators import subscribers as sb

    kind = "chat_id long, title string, active boolean, digest_enabled boolean, notify_new boolean, free_only boolean, categories array<string>, keywords array<string>"
    stored = spark.createDataFrame([(1, "a", True, True, False, True, ["konser"], []), (2, None, True, False, True, False, None, None)], kind)
    changes = spark.createDataFrame([(1, "", True), (3, "c", None)], "chat_id long, title string, notify_new boolean")
    after = sb.upsert(stored, changes)
    assert after.columns == stored.columns
    got = {r.chat_id: r for r in after.collect()}
    assert (got[1].title, got[1].notify_new, got[1].free_only, got[1].categories) == ("a", True, True, ["konser"])
    assert tuple(got[3]) == (3, "c", True, True, True, False, [], []) and got[2].categories == []
    off = sb.deactivate(after, spark.createDataFrame([(3,), (3,), (9,)], "chat_id long"))
    assert [r.chat_id for r in sb.listed(off).orderBy("chat_id").collect()] == [1, 2]
    assert [r.chat_id for r in sb.listed(off, digest_only=True, notify_only=True).collect()] == [1]
    day = date(2026, 8, 27)
    rows = [("x", "t1", "", day, day, "konser", True), ("y", "t2", None, day, day, "konser", False), ("z", None, "v", day, day, "spor", True)]
    events = spark.createDataFrame(rows, "uid string, title string, venue string, start date, end date, category string, is_free boolean")
    shown = sb.bucket_replies(events, stored, "bugun", day, ["uid"], 2).select("chat_id", "n", "uid").collect()
    assert sorted(map(tuple, shown)) == [(1, 1, "x"), (2, 1, "x"), (2, 2, "y")]
    assert sb.bucket_replies(events.limit(0), stored, "bugun", day, ["uid"]).isEmpty()


def test_store_keeps_two_versions_and_their_tags(spark, tmp_path):
    from eventloom.operators import store

    t = store.Table(spark, str(tmp_path / "t"))
    for k in range(4):
        assert t.replace(spark.range(k + 1), f"tag{k}").count() == k + 1
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name != "_versions"]
    assert len(folders) == 2 and all(t.has(f"tag{k}") for k in range(4)) and t.read().count() == 4
    assert store.pruned(spark.range(5), spark.range(2), "id").first().deleted == 3 and store.prune_all(spark.range(3)).count() == 0
