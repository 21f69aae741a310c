"""Queries of the engine by name, and their SQL equivalents.

Each query takes (spark, sf_dir) and reads its whole tables. Queries without SQL
(extraction by look-alike cards) are held against fixtures in tests.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ..functions import categories as ct
from ..functions import dates as dt
from ..functions import money as mn
from ..functions import text as tx
from ..operators import build, dated_store as ds, filters, notify, read, render, replies, resolve, store, subscribers
from ..sources import extract as ex
from ..sources import pages as pg
from ..sources import saved_pages as sp
from ..streaming import announce, ingest
from .matching_sql import CLUSTERS, MERGE, SCORES
from .records import ER_REF, EVENTS_SQL, LISTINGS_SQL, RAW_SQL, REF, events, listings, raw_rows, source_list, table

ORDER = ["start", "title", "uid"]
SHOWN = ["uid", "title", "venue", "start", "end", "category"]
WEEK = dt.bucket_bounds("bu_hafta", REF)
NOW = datetime(2000, 1, 1)


def bucket_list(spark, sf_dir):
    return read.in_bucket(events(spark, sf_dir), "bu_hafta", REF).select(*SHOWN).orderBy(*ORDER)


def filtered_list(spark, sf_dir):
    first, last = dt.bucket_bounds("bu_ay", REF)
    return read.list_events(events(spark, sf_dir), first, last, free=True, categories=["economy", "promo"], min_sources=2).select(*SHOWN)


def search_folded(spark, sf_dir):
    return read.search(events(spark, sf_dir).filter(F.col("end") >= F.lit(REF)), "RING", 40, ORDER).select(*SHOWN)


def offset_page(spark, sf_dir):
    return read.page(events(spark, sf_dir).select(*SHOWN), ORDER, 100, 50)


def counts_summary(spark, sf_dir):
    return read.counts(events(spark, sf_dir), REF)


def category_counts(spark, sf_dir):
    return read.category_counts(events(spark, sf_dir), REF)


def new_items(spark, sf_dir):
    return read.unannounced(events(spark, sf_dir), REF, 20).select(*SHOWN)


def classify_buckets(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy(dt.classify(F.col("start"), F.col("end"), REF).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("decimal(20,2)").cast("double").alias("total"))


def bucket_ranges(spark, sf_dir):
    """How many records overlap each of the eight buckets, in one pass."""
    e = events(spark, sf_dir)
    counted = e.agg(*[F.count_if(dt.in_bucket(F.col("start"), F.col("end"), b, REF)).alias(b) for b in dt.BUCKETS])
    return counted.unpivot([], list(dt.BUCKETS), "bucket", "n")


def title_keys(spark, sf_dir):
    """Normalised titles of noisy listings: the noise goes, the name stays."""
    x = listings(spark, sf_dir)
    return x.select("idx", tx.normalize_title(F.col("title")).alias("key"), tx.normalize_venue(F.col("venue")).alias("place"))


def display_titles(spark, sf_dir):
    x = listings(spark, sf_dir)
    return x.select("idx", tx.clean_display_title(F.col("title")).alias("shown"), tx.slugify(F.concat_ws(" ", "venue", tx.tr_lower(F.col("title")))).alias("slug"))


def event_uids(spark, sf_dir):
    x = resolve.prepared(listings(spark, sf_dir))
    return x.select("idx", resolve.event_uid(F.col("key"), F.col("start"), F.col("place")).alias("uid"), "link")


def price_roundtrip(spark, sf_dir):
    """Prices written in Turkish style among other words, and read back."""
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    raw = F.concat(F.lit("Bilet fiyatı: "), F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"), F.lit(" TL"))
    price = F.col("price")
    return e.withColumn("price", mn.parse_price(raw)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price["min"].alias("low"), price["is_free"].alias("is_free"), mn.price_label(price).alias("label"))


def date_roundtrip(spark, sf_dir):
    """Order dates written in five ways, and read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    long = F.concat(F.day("d").cast("string"), F.lit(" "), dt.month_label(F.col("d")), F.lit(" "), F.year("d").cast("string"))
    way = F.pmod("o_orderkey", F.lit(5))
    raw = (
        F.when(way == 0, long)
        .when(way == 1, F.date_format("d", "dd.MM.yyyy"))
        .when(way == 2, F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T20:30")))
        .when(way == 3, F.concat(F.lit("Tarih: "), tx.tr_upper(long), F.lit(" Saat 21.15")))
        .otherwise(F.concat(F.day("d").cast("string"), F.lit(" "), dt.month_label(F.col("d")), F.lit(" "), F.year("d").cast("string"), F.lit(" - "), F.date_format(F.date_add("d", 40), "d"), F.lit(" "), dt.month_label(F.date_add("d", 40)), F.lit(" "), F.year(F.date_add("d", 40)).cast("string")))
    )
    got = F.col("got")
    o = o.withColumn("raw", raw)
    return o.withColumn("got", dt.parse_dates(F.col("raw"), REF)).select("o_orderkey", got["start"].alias("start"), got["end"].alias("end"), got["minute"].alias("minute"), dt.is_date_only(F.col("raw")).alias("date_only"))


def date_labels(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy(dt.format_dates(F.col("start"), F.col("end"), F.lit(None).cast("int"), REF).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def category_guess(spark, sf_dir):
    """Categories of documents by the words of their whole texts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ct.guess_category(F.lit(None).cast("string"), F.col("text"), F.col("source")).alias("category"))


def city_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = filters.blob(F.col("text"), F.col("source"))
    return d.select("doc_id", filters.mentions_local(text).alias("local"), filters.is_other_city(text).alias("elsewhere"))


def drop_reasons(spark, sf_dir):
    e = events(spark, sf_dir)
    reason = filters.drop_reason(F.col("title"), filters.blob(F.col("title"), F.col("venue")), F.col("start"), F.col("end"), REF, F.lit(False))
    return e.groupBy("source", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_per_source(spark, sf_dir):
    e = events(spark, sf_dir).select("source", "title", "start", "uid")
    return filters.first_per(e, ["source", "title"], ["start", "uid"])


def block_keys(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(F.explode(resolve.block_keys(F.col("start"), F.col("end"))).alias("block_key")).groupBy("block_key").agg(F.count(F.lit(1)).alias("n"))


def candidate_pairs(spark, sf_dir):
    return resolve.candidate_pairs(listings(spark, sf_dir).select("idx", "start", "end"), ["idx"])


def match_scores(spark, sf_dir):
    return resolve.match_scores(listings(spark, sf_dir), 9)


def clusters(spark, sf_dir):
    return resolve.clusters(listings(spark, sf_dir))


def merged_events(spark, sf_dir):
    """Merged listings in their final order; sources and their titles are told as text."""
    x = listings(spark, sf_dir)
    m = resolve.final_order(resolve.merge_clusters(x, resolve.clusters(x)))
    told = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("=", s["source"], s[name])), ";") for c, name in (("sources", "url"), ("source_titles", "title"))}
    return m.withColumns(told)


def dedup_stats(spark, sf_dir):
    return resolve.stats(listings(spark, sf_dir))


def _stored(spark, sf_dir):
    """The store before the batch: orders up to 1998, and the batch: orders from 1997 with other values."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("at"))
    old = o.filter(F.col("at") < F.lit(datetime(1999, 1, 1))).select(
        "o_orderkey", "o_totalprice", F.col("at").alias("first_seen"), F.col("at").alias("last_seen"), (F.pmod("o_orderkey", F.lit(2)) == 0).alias("announced")
    )
    new = o.filter(F.col("at") >= F.lit(datetime(1997, 1, 1))).select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(False).alias("announced"))
    return old, new


def upsert_merge(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return store.upsert(old, new, "o_orderkey", NOW)


def upsert_split(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return store.split_batch(old, new, "o_orderkey").groupBy("is_new").agg(F.count(F.lit(1)).alias("n"))


def prune(spark, sf_dir):
    old, _ = _stored(spark, sf_dir)
    kept = store.prune_stale(old.withColumn("end", F.col("last_seen").cast("date")), datetime(1999, 1, 1), 400)
    return store.prune_old(kept, date(1999, 1, 1), 200).agg(F.count(F.lit(1)).alias("n"), F.min("last_seen").alias("oldest"))


def health_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    return store.consecutive_failures(e, "user_id", "event_id", "failed")


def run_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("kept"), F.array_sort(F.collect_set(F.when(F.col("event_type") == "error", "error"))).alias("errors"))
    return store.run_log(e).drop("errors")


def mode_per_user(spark, sf_dir):
    return read.mode_per(table(spark, sf_dir, "events"), "user_id", "event_type")


def html_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id", pg.absolutize(F.col("url"), F.col("href")).alias("link")).agg(F.count(F.lit(1)).alias("n"))


def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))


def page_urls(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("key"), F.concat(F.lit("https://example.com/"), F.col("n_nationkey").cast("string")).alias("url"), F.lit("page").alias("param"),
        F.lit(None).cast("string").alias("template"), F.lit(1).alias("first_page"), (F.col("n_regionkey") + 1).cast("int").alias("max_pages"),
    )
    return pg.paged_urls(n)


_NAV = {"item": "nav li > a", "title": "a", "date": "a@href"}


def _nav_rows(spark, sf_dir):
    """The navigation links of all pages as rows: pages hold no events, but cards that selectors with child steps find."""
    sources = spark.createDataFrame([("nav", ["selectors"], _NAV)], "key string, strategies array<string>, selectors map<string,string>")
    return ex.extract(table(spark, sf_dir, "pages").withColumn("source", F.lit("nav")), sources, ER_REF)


def extracted_rows(spark, sf_dir):
    return _nav_rows(spark, sf_dir).select("page", "source", "strategy", "strategy_ord", "card_ord", "title", "date_text", "url")


def strategy_counts(spark, sf_dir):
    return ex.strategy_counts(_nav_rows(spark, sf_dir), ER_REF)


def build_event(spark, sf_dir):
    """Raw rows judged and built: reasons, cleaned titles, venues, dates, prices, categories."""
    x = build.judged(raw_rows(spark, sf_dir), source_list(spark), ER_REF)
    price = F.col("price")
    return x.select("idx", "source", "reason", "title", "venue", "start", "end", "minute", "category", price["min"].alias("low"), price["is_free"].alias("is_free"))


def kept_events(spark, sf_dir):
    """Rows that stay, the first of each source and uid, with their source's priority."""
    k = build.kept(build.judged(raw_rows(spark, sf_dir), source_list(spark), ER_REF), ["idx"])
    return build.with_priority(k, source_list(spark)).select("idx", "source", "uid", "priority")


def source_report(spark, sf_dir):
    return build.source_report(build.judged(raw_rows(spark, sf_dir), source_list(spark), ER_REF), source_list(spark))


def scraped_events(spark, sf_dir):
    """From raw rows to merged events in one flow."""
    raw = raw_rows(spark, sf_dir).withColumns({"page": F.col("source"), "strategy": F.lit("jsonld"), "strategy_ord": F.lit(0)})
    _, merged = build.scrape(raw, source_list(spark), ER_REF)
    return merged.select("root", "title", "venue", "start", "end", "category", "source_count", "records")


def _inline_pages(spark, sf_dir):
    """One page per part in three kinds: JSON-LD, embedded JSON, and four cards that selectors fit."""
    p = table(spark, sf_dir, "part")
    kind = F.pmod("p_partkey", F.lit(3))
    iso = F.date_format(F.expr(f"date_add(DATE '{ER_REF}', p_size)"), "yyyy-MM-dd")
    ld = F.concat(
        F.lit('<html><script type="application/ld+json">{"@graph":[{"@type":["MusicEvent"],"name":"'), "p_name", F.lit('","startDate":"'), iso, F.lit('T21:00","location":{"name":"'), "p_brand",
        F.lit('"},"offers":[{"price":"'), F.col("p_size").cast("string"), F.lit('","priceCurrency":"TRY"},{"price":900}]},{"@type":"Person","name":"nobody"}]}</script><p>x</html>'),
    )
    nd = F.concat(
        F.lit('<script id="__NEXT_DATA__">{"props":{"items":[{"title":"'), "p_name", F.lit('","startDate":"'), iso, F.lit('","venue":{"name":"'), "p_brand", F.lit('"},"price":'), F.col("p_size").cast("string"),
        F.lit('},{"title":"wrong day","startDate":"2026-99-99"},{"name":{},"title":"second name","date":"yarın 20:00"}]}}</script>'),
    )
    card = [F.concat(F.lit('<div class="ev"><h3>'), "p_name", F.lit(f' no{i}</h3><span class="d">'), iso, F.lit('</span><b class="v">'), "p_brand", F.lit(f'</b><a href="/e/{i}">go</a></div>')) for i in range(4)]
    return p.select(F.col("p_partkey").alias("page_id"), F.lit("https://site.example/list?page=2").alias("url"), F.lit("inline").alias("source"), F.when(kind == 0, ld).when(kind == 1, nd).otherwise(F.concat(*card)).alias("html"))


def _inline_rows(spark, sf_dir):
    selectors = {"item": ".ev", "title": "h3", "date": ".d", "venue": ".v", "url": "a@href"}
    sources = spark.createDataFrame([("inline", ["jsonld", "nextdata", "selectors"], selectors)], "key string, strategies array<string>, selectors map<string,string>")
    return ex.extract(_inline_pages(spark, sf_dir), sources, ER_REF)


def extracted_events(spark, sf_dir):
    """All rows of the strategies for JSON-LD, embedded JSON and selectors."""
    x = _inline_rows(spark, sf_dir)
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("venue", "price_text", "url")]
    return x.select("page", "strategy", "card_ord", "title", F.coalesce("start_text", "date_text").alias("date_text"), *blank)


def extracted_counts(spark, sf_dir):
    return ex.strategy_counts(_inline_rows(spark, sf_dir), ER_REF).groupBy("strategy").agg(F.sum("found").alias("found"), F.sum("dated").alias("dated"))


def _mixed_pages(spark, sf_dir):
    """One page per part, every one with rows of two strategies: a featured JSON-LD event beside two cards; five JSON-LD events beside six
    cards; embedded JSON beside three cards that only look alike. Of what counts on a page one row is not past."""
    p = table(spark, sf_dir, "part")
    kind = F.pmod("p_partkey", F.lit(3))
    iso, page = F.date_format(F.expr(f"date_add(DATE '{ER_REF}', p_size)"), "yyyy-MM-dd"), F.col("p_partkey").cast("string")

    def ld(name, day, link):
        return [F.lit('{"@type":"Event","name":"'), name, F.lit('","startDate":"'), day, F.lit('","location":{"name":"'), F.col("p_brand"), F.lit('"},"url":"'), link, F.lit('"}')]

    def card(name, day, link, shape="ev"):
        return [F.lit(f'<div class="{shape}"><h3>'), name, F.lit('</h3><p class="d">'), day, F.lit('</p><b class="v">'), F.col("p_brand"), F.lit('</b><a href="'), link, F.lit('">more of it</a></div>')]

    link = F.concat(F.lit("/e/"), page)
    script, end = F.lit('<script type="application/ld+json">['), F.lit("]</script>")
    past = [(F.lit(f"old event {k}"), F.lit(f"2020-01-0{k}"), F.lit(f"/old/{k}")) for k in range(1, 5)]
    featured = [script, *ld(F.lit("Featured alone"), iso, F.lit("/featured")), end, F.lit("<div class='list'>"), *card(F.col("p_name"), iso, link), *card(*past[0]), F.lit("</div>")]
    enough = [script, *ld(F.col("p_name"), iso, link), *[x for e in past for x in (F.lit(","), *ld(*e))], end, F.lit("<div class='list'>")]
    enough += [x for k in range(6) for x in card(F.lit(f"Card number {k}"), iso, F.lit(f"/c/{k}"))] + [F.lit("</div>")]
    state = [F.lit('<script id="__NEXT_DATA__">{"props":{"items":[{"title":"In the state alone","startDate":"'), iso, F.lit('","x":[]}]}}</script>')]
    alike = [*state, *card(F.col("p_name"), iso, link, "item__a1b2c"), *card(*past[1], "item__d3e4f"), *card(*past[2], "item__g5h6i")]
    html = F.when(kind == 0, F.concat(*featured)).when(kind == 1, F.concat(*enough)).otherwise(F.concat(*alike))
    return p.select(F.col("p_partkey").alias("page_id"), F.lit("https://site.example/list/").alias("url"), F.concat(F.lit("src"), F.expr("p_partkey div 3 % 3").cast("string")).alias("source"), html.alias("html"))


def pages_to_events(spark, sf_dir):
    """From pages to merged events in one flow: every strategy, the best of each page, building, resolution, merge."""
    rules = {"item": ".list > .ev", "title": "h3", "date": ".d", "venue": ".v"}
    rows = [(f"src{k}", False, None, False, priority, ["jsonld", "nextdata", "selectors", "heuristic"], rules) for k, priority in enumerate((90, 10, 50))]
    sources = spark.createDataFrame(rows, "key string, city_filter boolean, default_category string, free_by_default boolean, priority int, strategies array<string>, selectors map<string,string>")
    _, merged = build.scrape(ex.extract(_mixed_pages(spark, sf_dir), sources, ER_REF), sources, ER_REF)
    return merged.select("title", "venue", "start", "end", "category", "source_count", "records")


def marked_announced(spark, sf_dir):
    """Events after every second line item was announced."""
    e = events(spark, sf_dir)
    return store.mark_announced(e.select("uid", "announced"), e.filter("source_count % 2 = 0").select("uid")).select("uid", "announced")


def updated_health(spark, sf_dir):
    """Health of the users as sources after a run in which some took part, some of them without success."""
    e = table(spark, sf_dir, "events").withColumn("source", F.col("user_id").cast("string"))
    old = e.filter("user_id % 3 <> 0").groupBy("source").agg(F.count_if(F.col("event_type") == "error").cast("int").alias("failures"), F.max("ts").alias("last_success"), F.lit("before").alias("last_error"))
    ran = e.filter("user_id % 4 <> 1").groupBy("source", (F.col("user_id") % 2 == 0).alias("ok")).agg(F.array(*[F.concat(F.lit(f"e{k} of "), F.count(F.lit(1))) for k in range(4)]).alias("errors"))
    return store.update_health(old.withColumn("last_success", F.col("last_success").cast("timestamp")), ran, NOW).withColumn("last_success", F.col("last_success").cast("timestamp_ntz"))


def last_run(spark, sf_dir):
    return build.last_run(table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")).select("id", "user_id", "event_type")


def day_messages(spark, sf_dir):
    """The week's events of each category by day, as messages: whether all fit, the events and the days shown."""
    e = read.in_bucket(events(spark, sf_dir), "bu_hafta", REF).withColumns({"minute": F.lit(None).cast("int"), "url": F.lit(""), "price_label": F.lit("1 ₺")})
    m = render.by_day(e, "category", F.concat(F.lit("<b>"), "category", F.lit("</b>")), REF)
    headings = F.regexp_extract_all("message", F.lit("<b>📅 ([^<]*)</b>(?! <i>)"), F.lit(1))
    return m.groupBy("category").agg((F.max(F.length("message")) <= 4096).alias("fits"), F.sum(F.size(F.regexp_extract_all("message", F.lit("📍"), F.lit(0)))).alias("shown"), F.sum(F.size(headings)).alias("days"))


def stats_message(spark, sf_dir):
    e = events(spark, sf_dir)
    return render.stats_text(read.counts(e, REF), read.category_counts(e, REF))


def broken_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") != "purchase")
    return build.broken_sources(store.consecutive_failures(e, "user_id", "event_id", "failed"))


def _subscribers(spark, sf_dir):
    """One subscriber per supplier: wishes by key."""
    s = table(spark, sf_dir, "supplier")
    k = F.pmod("s_suppkey", F.lit(4))
    return s.select(
        F.col("s_suppkey").alias("chat_id"), (k == 0).alias("free_only"),
        F.when(k == 1, F.array(F.lit("economy"), F.lit("promo"))).otherwise(F.array().cast("array<string>")).alias("categories"),
        F.when(k == 2, F.array(F.lit("ring"))).otherwise(F.array().cast("array<string>")).alias("keywords"),
    )


def _news(spark, sf_dir):
    return read.in_bucket(events(spark, sf_dir), "yarin", REF)


def _staged_news(spark, sf_dir):
    """Tomorrow's events, staged: filters read them several times, and their joins read whole tables."""
    return resolve.checkpointed(_news(spark, sf_dir).select("uid", "title", "venue", "start", "category", "is_free"), "news")


def subscriber_match(spark, sf_dir):
    news = _staged_news(spark, sf_dir)
    told = [F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid")]
    return notify.by_setting(_subscribers(spark, sf_dir), lambda wishes: notify.matches(news, wishes).groupBy("chat_id").agg(*told))


def digest_topk(spark, sf_dir):
    news = _staged_news(spark, sf_dir)
    d = notify.by_setting(_subscribers(spark, sf_dir), lambda wishes: notify.digest(notify.matches(news, wishes), ["start", "title", "uid"]))
    return d.select("chat_id", F.array_join("uids", ",").alias("uids"), "more", "free")


def _chats(spark, sf_dir):
    """Suppliers as stored subscribers; changes for every third of them and for chats from 1,000,000 on, one per customer."""
    s = _subscribers(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chat_id"), F.col("s_name").alias("title")), "chat_id")
    stored = s.withColumns({"active": F.lit(True), "digest_enabled": F.pmod("chat_id", F.lit(5)) > 0, "notify_new": F.pmod("chat_id", F.lit(2)) == 0})
    again = stored.filter("chat_id % 3 = 0").select("chat_id", F.when(F.pmod("chat_id", F.lit(2)) == 0, "").otherwise("renamed").alias("title"), F.lit(True).alias("notify_new"), F.lit(None).cast("boolean").alias("free_only"))
    new = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).alias("chat_id"), F.col("c_name").alias("title"), F.lit(None).cast("boolean").alias("notify_new"), (F.pmod("c_custkey", F.lit(2)) == 0).alias("free_only"))
    return subscribers.upsert(stored, again.unionByName(new))


def subscriber_upsert(spark, sf_dir):
    return _chats(spark, sf_dir).select("chat_id", "title", "active", "digest_enabled", "notify_new", "free_only", F.array_join("categories", ",").alias("categories"), F.array_join("keywords", ",").alias("keywords"))


def subscriber_list(spark, sf_dir):
    """Active subscribers who want digests and news, after those of the nations' keys were deactivated."""
    gone = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chat_id"))
    return subscribers.listed(subscribers.deactivate(_chats(spark, sf_dir), gone), digest_only=True, notify_only=True).select("chat_id", "title")


def bucket_replies(spark, sf_dir):
    """What each subscriber sees of tomorrow: the first uid, the last, and how many."""
    r = subscribers.bucket_replies(events(spark, sf_dir), _chats(spark, sf_dir), "yarin", REF, ORDER)
    return r.groupBy("chat_id").agg(F.count(F.lit(1)).alias("shown"), F.min_by("uid", "n").alias("first_uid"), F.max_by("uid", "n").alias("last_uid"))


def pruned_rows(spark, sf_dir):
    """How many stored rows the two prunings remove."""
    old, _ = _stored(spark, sf_dir)
    old = old.withColumn("end", F.col("last_seen").cast("date"))
    return store.pruned(old, store.prune_old(store.prune_stale(old, datetime(1999, 1, 1), 400), date(1999, 1, 1), 200), "o_orderkey")


def packed_messages(spark, sf_dir):
    """Customers of each nation as lines of messages."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = notify.event_line(F.col("c_name"), F.lit(""), F.lit("konser"), F.lit("bugün"), F.col("c_mktsegment"), F.lit("100 ₺"), F.lit(2))
    rows = c.select("n_name", "c_custkey", line.alias("line"), F.concat(F.lit("<b>"), "n_name", F.lit("</b>")).alias("header"))
    return notify.messages(rows, "n_name", "line", ["c_custkey"], "header")


def _told(spark, sf_dir):
    return events(spark, sf_dir).withColumns({"minute": F.lit(None).cast("int"), "url": F.lit(""), "price_label": F.lit("1 ₺")})


def bucket_texts(spark, sf_dir):
    """What each supplier as a chat is told of the week."""
    return replies.bucket_texts(_told(spark, sf_dir), _subscribers(spark, sf_dir), "bu_hafta", REF, ORDER)


def digest_texts(spark, sf_dir):
    """The morning's messages to each supplier as a chat."""
    return replies.digest_texts(_told(spark, sf_dir), _subscribers(spark, sf_dir), REF, ORDER)


def news_texts(spark, sf_dir):
    """The news to each supplier as a chat."""
    return replies.news_texts(_told(spark, sf_dir), _subscribers(spark, sf_dir), REF, ORDER)


def saved_pages(spark, sf_dir):
    """Pages saved as they were fetched, every third once more; those of the last half hour, the last of each address."""
    sp.register(spark)
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{resolve.shared_root(spark)}/eventloom-bronze-{uuid.uuid4().hex}"
    fetched = F.lit(NOW).cast("timestamp") - F.make_dt_interval(mins=F.pmod("page_id", F.lit(50)).cast("int"))
    sp.save(p.select("url", fetched.alias("fetched_at"), "html"), path)
    sp.save(p.filter("page_id % 3 = 0").select("url", F.lit(NOW).cast("timestamp").alias("fetched_at"), F.concat("html", F.lit("again")).alias("html")), path)
    kept = sp.latest(spark, path, NOW + timedelta(minutes=1), 30)
    return kept.select("host", "url", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), F.sha2("html", 256).alias("html_sha256"))


def dated_store(spark, sf_dir):
    """Orders in a store by month and slice of keys: the orders before 1999, a batch that changes every fifth and moves
    some of them to other months, a prune, then what overlaps six months."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 3).alias("end"))
    shape = "o_orderkey long, o_totalprice double, start date, end date, first_seen timestamp, last_seen timestamp, announced boolean"
    t = ds.DatedTable(spark, f"{resolve.shared_root(spark)}/eventloom-dated-{uuid.uuid4().hex}", "o_orderkey", shape, "month", 2)
    t.upsert(o.filter(F.col("start") < F.lit(date(1999, 1, 1))), datetime(1999, 1, 1))
    k = F.pmod("o_orderkey", F.lit(3)).cast("int") * 20
    changed = o.filter("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.date_add("start", k).alias("start"), F.date_add("end", k).alias("end"))
    t.upsert(changed, NOW)
    t.drop(F.col("end") < F.lit(date(1998, 9, 1)))
    seen = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")]
    return t.between(date(1998, 8, 1), date(1999, 1, 31)).select("o_orderkey", "o_totalprice", "start", "end", *seen)


def stream_upsert(spark, sf_dir):
    """The events table as a file stream, upserted by user."""
    base = f"{resolve.shared_root(spark)}/eventloom-stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events*.parquet"
    target = store.Table(spark, f"{base}/table")
    stream = ingest.event_stream(spark, path, table(spark, sf_dir, "events").schema)
    ingest.upsert_stream(stream, target, f"{base}/checkpoint", "user_id", ["ts", "event_id"])
    out = target.read()
    return out.select("user_id", "n", "first_seen", "last_seen", F.col("last.event_type").alias("last_type"))


def daily_windows(spark, sf_dir):
    w = ingest.windowed_counts(table(spark, sf_dir, "events"))
    return w.select("start", "event_type", "n", F.round("total", 2).alias("total"))


def _streamed(spark, sf_dir, make):
    """What ``make`` tells of the events table as a stream, in folders of its own."""
    base = f"{resolve.shared_root(spark)}/eventloom-stream-{uuid.uuid4().hex}"
    stream = ingest.event_stream(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    return announce.run_available(make(stream), f"{base}/out", f"{base}/checkpoint")


def announced_once(spark, sf_dir):
    """Users announced when they are first seen, and again after an absence of two days: keyed state with time to live."""
    return _streamed(spark, sf_dir, lambda s: announce.announced(s, "user_id", keep=timedelta(days=2)))


def settled_windows(spark, sf_dir):
    """Daily counts on a stream, each event once, of the days that the watermark has passed."""
    return _streamed(spark, sf_dir, announce.settled_windows).withColumn("total", F.round("total", 2))


QUERIES = {
    f.__name__: f
    for f in (
        bucket_list, filtered_list, search_folded, offset_page, counts_summary, category_counts, new_items, classify_buckets, bucket_ranges, title_keys,
        display_titles, event_uids, price_roundtrip, date_roundtrip, date_labels, category_guess, city_filter, drop_reasons, first_per_source, block_keys,
        candidate_pairs, match_scores, clusters, merged_events, dedup_stats, upsert_merge, upsert_split, prune, health_counter, run_counters, mode_per_user,
        html_titles, page_links, json_props, page_urls, extracted_rows, strategy_counts, subscriber_match, digest_topk, packed_messages, build_event,
        kept_events, source_report, scraped_events, extracted_events, extracted_counts, day_messages, stats_message, broken_sources, subscriber_upsert,
        subscriber_list, bucket_replies, pruned_rows, stream_upsert, daily_windows, announced_once, settled_windows,
        pages_to_events, marked_announced, updated_health, last_run, dated_store, bucket_texts, digest_texts, news_texts, saved_pages,
    )
}

_COLS = 'uid, title, venue, start, "end", category'
_FOLD = "translate(lower({0}), 'ışğüöçâîûäéàáãåèêëìíïñòóôõùúýÿ', 'isguocaiuaeaaaaeeeiiinoooouuyy')"


def _within(bucket):
    a, b = dt.bucket_bounds(bucket, REF)
    return f"\"end\" >= DATE '{a}' AND start <= DATE '{b}'"


def _guess_sql():
    text, place = "lower(coalesce(text, ''))", "lower(coalesce(source, ''))"
    whens = [f"WHEN {' OR '.join(f'contains({text}, {w!r})' for w in words.split('|'))} THEN '{k}'" for k, (_, words) in ct.CATEGORIES.items() if words]
    whens += [f"WHEN {' OR '.join(f'contains({place}, {w!r})' for w in words.split('|'))} THEN '{k}'" for k, words in ct.VENUE_WORDS]
    return f"SELECT doc_id, CASE {' '.join(whens)} ELSE 'diger' END AS category FROM documents"


_MONTHS = "[" + ", ".join(f"'{m}'" for m in dt.MONTH_LABELS) + "]"
_DAYS = "[" + ", ".join(f"'{d}'" for d in dt.WEEKDAY_LABELS) + "]"
_YEAR = f"CASE WHEN year(start) <> {REF.year} OR year({{0}}) <> {REF.year} THEN ' ' || year({{0}}) ELSE '' END"
_ONE = "day({0}) || ' ' || " + _MONTHS + "[month({0})] || " + _YEAR

_BUILT = f"""WITH {RAW_SQL}, e AS (SELECT idx, source, reason, CASE kind WHEN 4 THEN 'Tüm Etkinlikler' ELSE name END AS title, venue, start,
    CASE WHEN kind = 3 THEN start + 3 ELSE start END AS "end", CASE WHEN kind = 0 THEN 1230 END AS minute,
    CASE WHEN s = 2 THEN 'konser' WHEN kind = 2 THEN 'tiyatro' WHEN kind = 7 THEN 'diger' ELSE 'diger' END AS category,
    CASE WHEN kind = 0 THEN 150.0::DOUBLE END AS low, is_free, kind, name FROM b)"""

_PLACE = "CASE WHEN length({0}) = 7 THEN 'brand' ELSE lower(replace({0}, '#', ' ')) END"

_NAMED = f"""WITH RECURSIVE {LISTINGS_SQL}, n AS (SELECT idx, name AS key, {_PLACE.format('venue')} AS place, start, "end" FROM l), """

_TOLD = """string_agg(source || '=' || {0}, ';' ORDER BY first)"""

_MERGED = f"""{_NAMED} r AS (SELECT idx, kind, name, venue, start, "end", CASE WHEN kind > 0 THEN (idx % 24)::INTEGER * 60 END AS minute, CASE WHEN kind = 3 THEN 'diger' ELSE lower(p_type) END AS category,
      CASE WHEN kind = 1 THEN 'about ' || name END AS description, 'src' || kind AS source, 'https://www.example.com/e/' || idx || '/' AS url, kind * 10 AS priority, kind IN (0, 2) AS tidy,
      CASE kind WHEN 0 THEN name || ' Konseri' WHEN 1 THEN 'İzmir | ' || name WHEN 2 THEN name || ' (Bilet) 2026' ELSE upper(name) END AS listed,
      idx % 7 = 0 AS free, CASE WHEN idx % 7 > 1 THEN p_retailprice END AS low, p_retailprice || ' TL' AS raw FROM l),
  {MERGE}, tops AS (SELECT root, min(start) FILTER (ord = 1) AS start, greatest(max("end"), min(start) FILTER (ord = 1)) AS "end", min(venue) FILTER (ord = 1) AS venue,
      arg_min(minute, ord) FILTER (minute IS NOT NULL) AS minute, arg_min(description, ord) FILTER (description IS NOT NULL) AS description,
      coalesce(arg_min(category, fold) FILTER (category <> 'diger'), 'diger') AS category, count(*) AS records,
      min(CASE kind WHEN 3 THEN array_to_string(list_transform(string_split(translate(upper(name), 'I', 'ı'), ' '), lambda w: translate(substr(w, 1, 1), 'ıi', 'Iİ') || lower(substr(w, 2))), ' ') ELSE listed END) FILTER (ord = 1) AS title,
      count(low) AS paid, count(*) FILTER (free OR low IS NOT NULL) AS known, min(low) AS price_min, max(low) AS high,
      arg_min(raw, fold) FILTER (low IS NOT NULL) AS paid_raw, arg_min(raw, fold) FILTER (free) AS free_raw, arg_max(raw, fold) AS last_raw FROM o GROUP BY 1),
  told AS (SELECT root, count(*)::INTEGER AS source_count, {_TOLD.format('url')} AS sources, {_TOLD.format('listed')} AS source_titles FROM by_source GROUP BY 1)
  SELECT root, title, start, "end", minute, venue, description, NULL::VARCHAR AS image, category, NULL::TIMESTAMP AS first_seen, records, known > 0 AND paid = 0 AS is_free, price_min,
    CASE WHEN paid > 1 AND high <> price_min THEN high END AS price_max, CASE WHEN paid > 0 THEN paid_raw WHEN known > 0 THEN free_raw ELSE last_raw END AS price_raw, false AS needs_registration,
    sources, source_titles, source_count FROM tops JOIN told USING (root)"""

# kinds that stay hold the name as their title: the date and the venue go
_SCRAPED = _BUILT.replace("WITH r", "WITH RECURSIVE raw_r", 1).replace("FROM r)", "FROM raw_r)", 1) + f""", r AS (
    SELECT e.*, name AS listed, CASE source WHEN 'src0' THEN 90 WHEN 'src1' THEN 10 ELSE 50 END AS priority, true AS tidy, 'https://example.com/' || idx AS url,
      CASE WHEN kind = 2 THEN 'bostanli suat taser' ELSE {_PLACE.format('venue')} END AS place FROM e WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY source, name, start, place ORDER BY idx) = 1),
  n AS (SELECT idx, name AS key, place, start, "end" FROM r), {MERGE}
  SELECT root, min(name) FILTER (ord = 1) AS title, min(venue) FILTER (ord = 1) AS venue, min(start) FILTER (ord = 1) AS start, max("end") AS "end",
    coalesce(arg_min(category, fold) FILTER (category <> 'diger'), 'diger') AS category, count(DISTINCT source)::INTEGER AS source_count, count(*) AS records FROM o GROUP BY 1"""

# what stays of a page is the row with the part's name, found without a venue where cards only look alike
_FROM_PAGES = f"""WITH RECURSIVE b AS (SELECT p_partkey AS idx, p_name AS name, 'src' || (p_partkey // 3) % 3 AS source, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS venue, DATE '{ER_REF}' + p_size AS start FROM part),
  r AS (SELECT *, start AS "end", name AS listed, 'diger' AS category, true AS tidy, 'https://site.example/e/' || idx AS url, CASE source WHEN 'src0' THEN 90 WHEN 'src1' THEN 10 ELSE 50 END AS priority,
      CASE WHEN venue IS NULL THEN '' ELSE {_PLACE.format('venue')} END AS place FROM b QUALIFY row_number() OVER (PARTITION BY source, name, start, CASE WHEN venue IS NULL THEN '' ELSE {_PLACE.format('venue')} END ORDER BY idx) = 1),
  n AS (SELECT idx, name AS key, place, start, "end" FROM r), {MERGE}
  SELECT min(name) FILTER (ord = 1) AS title, coalesce(min(venue) FILTER (ord = 1), arg_min(venue, ord)) AS venue, min(start) FILTER (ord = 1) AS start, max("end") AS "end", 'diger' AS category,
    count(DISTINCT source)::INTEGER AS source_count, count(*) AS records FROM o GROUP BY root"""

_PACKED = """WITH RECURSIVE l AS (SELECT n_name, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS i, '<b>' || n_name || '</b>' AS header,
      '🎵 <b>' || c_name || '</b>' || chr(10) || '   bugün · 📍 ' || c_mktsegment || chr(10) || '   100 ₺ · 🔗 2 kaynak' AS line FROM customer JOIN nation ON c_nationkey = n_nationkey),
  pack AS (SELECT n_name, i, 1::BIGINT AS n, length(header) + 1 + length(line) AS size FROM l WHERE i = 1
    UNION ALL SELECT l.n_name, l.i, CASE WHEN p.size + length(line) + 1 > 3800 THEN p.n + 1 ELSE p.n END,
      CASE WHEN p.size + length(line) + 1 > 3800 THEN length(header || ' <i>(devam)</i>') + 1 + length(line) ELSE p.size + length(line) + 1 END FROM pack p JOIN l ON l.n_name = p.n_name AND l.i = p.i + 1)
  SELECT n_name, n, min(header) || CASE WHEN n > 1 THEN ' <i>(devam)</i>' ELSE '' END || chr(10) || string_agg(line, chr(10) ORDER BY i) AS message FROM pack JOIN l USING (n_name, i) GROUP BY 1, 2"""

# Texts to suppliers as chats of four kinds: t has the records with the label of their dates, u those shown to a kind in order (k, i).
_ASKED = "(k <> 0 OR is_free) AND (k <> 1 OR category IN ('economy', 'promo'))"
_WORD = " AND (k <> 2 OR contains(title, 'ring'))"
_LABELLED = f"""WITH RECURSIVE {EVENTS_SQL}, t AS (SELECT *, CASE WHEN "end" > start THEN
      (CASE WHEN date_trunc('month', start) = date_trunc('month', "end") THEN day(start) || '-' || day("end") || ' ' || {_MONTHS}[month("end")] ||
        CASE WHEN year(start) <> {REF.year} THEN ' ' || year("end") ELSE '' END
       ELSE {_ONE.format('start')} || ' – ' || {_ONE.format('"end"')} END) || CASE WHEN DATE '{REF}' BETWEEN start AND "end" THEN ' (devam ediyor)' ELSE '' END
      WHEN start = DATE '{REF}' THEN 'Bugün (' || {_ONE.format('start')} || ' ' || {_DAYS}[isodow(start)] || ')'
      WHEN start = DATE '{REF}' + 1 THEN 'Yarın (' || {_ONE.format('start')} || ' ' || {_DAYS}[isodow(start)] || ')'
      ELSE {_ONE.format('start')} || ' ' || {_DAYS}[isodow(start)] END AS label FROM e), kinds AS (SELECT unnest(range(4)) AS k)"""
_DAY_NAME = "day({0}) || ' ' || " + _MONTHS + "[month({0})] || ' ' || " + _DAYS + "[isodow({0})]"


def _message_sql(header, heading="''", label="label"):
    """m(k, n, message, last): the events u of each kind in greedy messages."""
    return f"""l AS (SELECT k, i, '<b>' || {header} || '</b>' AS header, {heading} AS heading, '📌 <b>' || title || '</b>' || chr(10) || '   ' || concat_ws(' · ', {label}, '📍 ' || venue) || chr(10) || '   ' ||
        concat_ws(' · ', CASE WHEN is_free THEN '🆓 <b>Ücretsiz</b>' ELSE '🎟 1 ₺' END, CASE WHEN source_count > 1 THEN '🔗 ' || source_count || ' kaynak' END) AS line FROM u),
      f AS (SELECT *, heading <> coalesce(lag(heading) OVER (PARTITION BY k ORDER BY i), '') AS fresh FROM l),
      g AS (SELECT k, i, header, CASE WHEN fresh THEN chr(10) || chr(10) || heading ELSE '' END || chr(10) || line AS goes_on, header || ' <i>(devam)</i>' ||
        CASE WHEN heading = '' THEN '' WHEN fresh THEN chr(10) || chr(10) || heading ELSE chr(10) || chr(10) || heading || ' <i>(devam)</i>' END || chr(10) || line AS begins FROM f),
      pack AS (SELECT k, i, 1::BIGINT AS n, header || goes_on AS open FROM g WHERE i = 1
        UNION ALL SELECT g.k, g.i, CASE WHEN length(open) + length(goes_on) > 3800 THEN n + 1 ELSE n END, CASE WHEN length(open) + length(goes_on) > 3800 THEN begins ELSE open || goes_on END
        FROM pack p JOIN g ON g.k = p.k AND g.i = p.i + 1),
      m AS (SELECT k, n, arg_max(open, i) AS message, max(n) OVER (PARTITION BY k) AS last FROM pack GROUP BY 1, 2)"""


_DIGEST_FOOT = "'Bugünkü ' || (SELECT count(*) FILTER (is_free) FROM d) || ' etkinlik ücretsiz. Tümü için: /ucretsiz'"
_NOTHING_SQL = "SELECT k, 1 AS n, '<b>' || {0} || '</b>' || chr(10) || chr(10) || {1} AS message FROM kinds WHERE k NOT IN (SELECT k FROM u)"
_DIGEST_HEAD = f"CASE k WHEN 0 THEN '🆓 Bugün İzmir''de ücretsiz' ELSE '🌅 Günaydın! ' || {_DAY_NAME.format(f"DATE '{REF}'")} || ' — İzmir''de bugün' END"
_BUCKET_HEAD = "CASE k WHEN 0 THEN 'Bu Hafta — Ücretsiz Etkinlikler' ELSE 'Bu Hafta İzmir''de' END"
_BUCKET_NONE = "CASE k WHEN 0 THEN 'Bu aralıkta ücretsiz etkinlik bulunamadı.' ELSE 'Bu aralıkta etkinlik bulunamadı.' END"
_DIGEST_NONE = "CASE k WHEN 0 THEN 'Bugün için kayıtlı ücretsiz etkinlik yok.' ELSE 'Bugün için kayıtlı etkinlik yok. Yarına bakmak için /yarin.' END"
_HEADING = f"""'<b>📅 ' || CASE WHEN start = DATE '{REF}' THEN 'Bugün — ' WHEN start = DATE '{REF}' + 1 THEN 'Yarın — ' WHEN start < DATE '{REF}' THEN 'Devam eden — ' ELSE '' END
        || {_DAY_NAME.format('start')} || CASE WHEN start < DATE '{REF}' THEN ' başlangıçlı' ELSE '' END || '</b>'"""

_PAGES_SQL = f"""WITH p AS (SELECT p_partkey AS page, p_partkey % 3 AS kind, p_name AS name, p_brand AS brand, p_size AS size, strftime(DATE '{ER_REF}' + p_size, '%Y-%m-%d') AS iso FROM part),
    x AS (SELECT page, 'jsonld' AS strategy, 0 AS card_ord, name AS title, iso || 'T21:00' AS date_text, brand AS venue, size || '.0 TL - 900.0 TL' AS price_text, '' AS url FROM p WHERE kind = 0
      UNION ALL SELECT page, 'nextdata', 0, name, iso, brand, size || ' TL', '' FROM p WHERE kind = 1
      UNION ALL SELECT page, 'nextdata', 1, 'second name', 'yarın 20:00', '', '', '' FROM p WHERE kind = 1
      UNION ALL SELECT page, 'selectors', i, name || ' no' || i, iso, brand, '', 'https://site.example/e/' || i FROM p, range(4) t(i) WHERE kind = 2)"""

_CHATS = """chats AS (
    SELECT s_suppkey AS chat_id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0 THEN 'renamed' ELSE s_name END AS title, true AS active, s_suppkey % 5 > 0 AS digest_enabled,
      s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS notify_new, s_suppkey % 4 = 0 AS free_only, CASE WHEN s_suppkey % 4 = 1 THEN 'economy,promo' ELSE '' END AS categories,
      CASE WHEN s_suppkey % 4 = 2 THEN 'ring' ELSE '' END AS keywords FROM supplier
    UNION ALL SELECT c_custkey + 1000000, c_name, true, true, true, c_custkey % 2 = 0, '', '' FROM customer)"""

_NAV_SQL = """WITH nav AS (SELECT page_id AS page, url AS base, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages),
    a AS (SELECT page, base, unnest(list_transform(list_zip(regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a>', 1), regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a>', 2), range(0, 1000)), lambda z: {'href': z[1], 'title': z[2], 'k': z[3]})) AS z FROM nav),
    t AS (SELECT page, base, z.href, trim(z.title) AS title, z.k FROM a WHERE z.href IS NOT NULL),
    x AS (SELECT page, 'nav' AS source, 'selectors' AS strategy, 0 AS strategy_ord, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS card_ord, title, href AS date_text,
      regexp_extract(base, '^([a-z]+://[^/?#]+)', 1) || href AS url FROM (SELECT * FROM t WHERE length(regexp_replace(title, '\\P{L}', '', 'g')) >= 3 QUALIFY row_number() OVER (PARTITION BY page, title, href ORDER BY k) = 1))"""

ORACLES = {
    "extracted_rows": _NAV_SQL + " SELECT * FROM x",
    "strategy_counts": _NAV_SQL + " SELECT page, strategy, count(*) AS found, 0::BIGINT AS dated FROM x GROUP BY 1, 2",
    "subscriber_upsert": f"WITH {_CHATS} SELECT * FROM chats",
    "subscriber_list": f"WITH {_CHATS} SELECT chat_id, title FROM chats WHERE digest_enabled AND notify_new AND chat_id NOT IN (SELECT n_nationkey FROM nation)",
    "bucket_replies": f"""WITH {EVENTS_SQL}, {_CHATS}, g AS (SELECT DISTINCT free_only, categories FROM chats), m AS (
        SELECT g.*, e.uid, row_number() OVER (PARTITION BY free_only, categories ORDER BY start, title, uid) AS n FROM e JOIN g ON (NOT free_only OR is_free)
          AND (categories = '' OR list_contains(string_split(categories, ','), category)) WHERE {_within('yarin')} QUALIFY n <= 40)
        SELECT chat_id, count(*) AS shown, arg_min(uid, n) AS first_uid, arg_max(uid, n) AS last_uid FROM chats JOIN m USING (free_only, categories) GROUP BY 1""",
    "pruned_rows": """SELECT count(*) AS deleted FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
        AND (o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 400 DAY OR o_orderdate::DATE < DATE '1999-01-01' - 200)""",
    "match_scores": f"{_NAMED}{SCORES} SELECT l_idx, r_idx, round(title_score, 9) AS title_score, round(venue_score, 9) AS venue_score, round(score, 9) AS score FROM m",
    "clusters": f"{_NAMED}{CLUSTERS} SELECT idx, root FROM c",
    "dedup_stats": f"""{_NAMED}{CLUSTERS} SELECT (SELECT count(*) FROM n) AS before, (SELECT count(DISTINCT root) FROM c) AS after, (SELECT count(*) FROM m) AS comparisons,
        (SELECT count(*) FILTER (score >= 0.82) FROM m) AS matches, (SELECT count(*) - count(DISTINCT root) FROM c) AS merged""",
    "merged_events": _MERGED,
    "scraped_events": _SCRAPED,
    "packed_messages": _PACKED,
    "build_event": _BUILT + ' SELECT idx, source, reason, title, venue, start, "end", minute, category, low, is_free FROM e',
    "kept_events": _BUILT + """ SELECT idx, source, substr(sha1(name || '|' || start || '|' || CASE WHEN kind = 2 THEN 'bostanli suat taser' WHEN length(venue) = 7 THEN 'brand' ELSE lower(replace(venue, '#', ' ')) END), 1, 16) AS uid,
        CASE source WHEN 'src0' THEN 90 WHEN 'src1' THEN 10 WHEN 'src2' THEN 50 END AS priority FROM e WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY source, uid ORDER BY idx) = 1""",
    "source_report": _BUILT + """ SELECT k.source, count(e.idx) AS found, count(e.idx) FILTER (reason IS NULL) AS kept, count(e.idx) FILTER (reason IN ('junk', 'no_city')) AS filtered,
        count(e.idx) FILTER (reason = 'other_city') AS other_city, count(e.idx) FILTER (reason = 'no_date') AS no_date, count(e.idx) FILTER (reason = 'past') AS past
        FROM (SELECT unnest(['src0', 'src1', 'src2', 'src3', 'src9']) AS source) k LEFT JOIN e ON e.source = k.source GROUP BY 1""",
    "extracted_events": _PAGES_SQL + " SELECT * FROM x",
    "extracted_counts": _PAGES_SQL + " SELECT strategy, count(*) AS found, count(*) AS dated FROM x GROUP BY 1",
    "stats_message": f"""WITH {EVENTS_SQL}, a AS (SELECT * FROM e WHERE "end" >= DATE '{REF}'), c AS (SELECT category, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, category LIMIT 10)
        SELECT '<b>📊 Bot Durumu</b>' || chr(10) || chr(10) || 'Gelecek etkinlik: <b>' || (SELECT count(*) FROM a) || '</b>' || chr(10) || 'Bunlardan ücretsiz: <b>' || (SELECT count(*) FILTER (is_free) FROM a)
        || '</b>' || chr(10) || 'Birden fazla kaynakta doğrulanan: <b>' || (SELECT count(*) FILTER (source_count > 1) FROM a) || '</b>' || chr(10) || 'Veritabanındaki toplam kayıt: ' || (SELECT count(*) FROM e)
        || chr(10) || chr(10) || '<b>Kategoriler</b>' || chr(10) || (SELECT string_agg('• ' || category || ': ' || n, chr(10) ORDER BY n DESC, category) FROM c) AS message""",
    "day_messages": f"""WITH {EVENTS_SQL} SELECT category, true AS fits, count(*) AS shown, count(DISTINCT start) AS days FROM e WHERE {_within('bu_hafta')} GROUP BY 1""",
    "broken_sources": """WITH s AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS ok FROM events GROUP BY 1)
        SELECT s.user_id, count(e.event_id) AS failures FROM s JOIN events e ON e.user_id = s.user_id AND e.event_type <> 'purchase' AND (s.ok IS NULL OR e.event_id > s.ok) GROUP BY 1 HAVING count(e.event_id) >= 3""",
    "bucket_list": f"WITH {EVENTS_SQL} SELECT {_COLS} FROM e WHERE {_within('bu_hafta')}",
    "filtered_list": f"WITH {EVENTS_SQL} SELECT {_COLS} FROM e WHERE {_within('bu_ay')} AND is_free AND category IN ('economy', 'promo') AND source_count >= 2",
    "search_folded": f"""WITH {EVENTS_SQL}, f AS (SELECT * FROM e WHERE "end" >= DATE '{REF}' ORDER BY start, title, uid LIMIT 800)
        SELECT {_COLS} FROM f WHERE contains(lower(title || ' ' || venue), 'ring') ORDER BY start, title, uid LIMIT 40""",
    "offset_page": f"WITH {EVENTS_SQL} SELECT {_COLS} FROM e ORDER BY start, title, uid LIMIT 50 OFFSET 100",
    "counts_summary": f"""WITH {EVENTS_SQL} SELECT count(*) AS total, count(*) FILTER ("end" >= DATE '{REF}') AS upcoming,
        count(*) FILTER ("end" >= DATE '{REF}' AND is_free) AS free, count(*) FILTER ("end" >= DATE '{REF}' AND source_count > 1) AS multi_source FROM e""",
    "category_counts": f"WITH {EVENTS_SQL} SELECT category, count(*) AS n FROM e WHERE \"end\" >= DATE '{REF}' GROUP BY category",
    "new_items": f"WITH {EVENTS_SQL} SELECT {_COLS} FROM e WHERE NOT announced AND \"end\" >= DATE '{REF}' ORDER BY start, title, uid LIMIT 20",
    "classify_buckets": f"""WITH {EVENTS_SQL} SELECT CASE WHEN "end" < DATE '{REF}' THEN 'gecmis' WHEN start <= DATE '{REF}' THEN 'bugun'
        WHEN start = DATE '{REF}' + 1 THEN 'yarin' WHEN start <= DATE '{WEEK[1]}' THEN 'bu_hafta' WHEN start <= DATE '{WEEK[1]}' + 7 THEN 'gelecek_hafta'
        WHEN start <= DATE '{dt.bucket_bounds("bu_ay", REF)[1]}' THEN 'bu_ay' ELSE 'sonra' END AS bucket, count(*) AS n, sum(price)::DECIMAL(20,2)::DOUBLE AS total FROM e GROUP BY 1""",
    "bucket_ranges": f"WITH {EVENTS_SQL} " + " UNION ALL ".join(f"SELECT '{b}' AS bucket, count(*) AS n FROM e WHERE {_within(b)}" for b in dt.BUCKETS),
    "title_keys": f"WITH {LISTINGS_SQL} SELECT idx, name AS key, CASE WHEN length(venue) = 7 THEN 'brand' ELSE lower(replace(venue, '#', ' ')) END AS place FROM l",
    "display_titles": f"""WITH {LISTINGS_SQL}, t AS (SELECT *, CASE kind WHEN 0 THEN name || ' Konseri' WHEN 1 THEN 'İzmir | ' || name WHEN 2 THEN name || ' (Bilet) 2026'
          ELSE array_to_string(list_transform(string_split(translate(upper(name), 'I', 'ı'), ' '),
            lambda w: translate(substr(w, 1, 1), 'ıi', 'Iİ') || lower(substr(w, 2))), ' ') END AS shown,
          CASE kind WHEN 0 THEN name || ' konseri' WHEN 1 THEN 'izmir | ' || name WHEN 2 THEN name || ' (bilet) 2026' ELSE name END AS low FROM l)
        SELECT idx, shown, trim(regexp_replace(lower(venue) || ' ' || low, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t""",
    "page_links": """WITH p AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
        SELECT page_id, CASE WHEN trim(href) = '' OR regexp_matches(lower(href), '^(javascript:|mailto:|tel:|#)') THEN NULL
          WHEN regexp_matches(lower(href), '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)//', 1) || href
          WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href
          ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:])/[^/]*$', '\\1') || '/' || href END AS link, count(*) AS n FROM p GROUP BY ALL""",
    "event_uids": f"WITH {LISTINGS_SQL} SELECT idx, substr(sha1(name || '|' || start || '|' || CASE WHEN length(venue) = 7 THEN 'brand' ELSE lower(replace(venue, '#', ' ')) END), 1, 16) AS uid, 'example.com/e/' || idx AS link FROM l",
    "price_roundtrip": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice BETWEEN 1900 AND 2100 THEN NULL ELSE l_extendedprice END AS low,
        false AS is_free, CASE WHEN l_extendedprice BETWEEN 1900 AND 2100 THEN 'Fiyat belirtilmemiş'
        WHEN l_extendedprice = floor(l_extendedprice) THEN replace(format('{:,}', l_extendedprice::BIGINT), ',', '.') || ' ₺'
        ELSE translate(format('{:,.2f}', l_extendedprice), ',.', '.,') || ' ₺' END AS label FROM lineitem""",
    "date_roundtrip": """SELECT o_orderkey, o_orderdate::DATE AS start, CASE WHEN o_orderkey % 5 = 4 THEN o_orderdate::DATE + 40 ELSE o_orderdate::DATE END AS "end",
        CASE o_orderkey % 5 WHEN 2 THEN 1230 WHEN 3 THEN 1275 END AS minute, true AS date_only FROM orders""",
    "date_labels": f"""WITH {EVENTS_SQL}, t AS (SELECT *, CASE WHEN "end" > start THEN
        (CASE WHEN date_trunc('month', start) = date_trunc('month', "end") THEN day(start) || '-' || day("end") || ' ' || {_MONTHS}[month("end")] ||
          CASE WHEN year(start) <> {REF.year} THEN ' ' || year("end") ELSE '' END
         ELSE {_ONE.format('start')} || ' – ' || {_ONE.format('"end"')} END) || CASE WHEN DATE '{REF}' BETWEEN start AND "end" THEN ' (devam ediyor)' ELSE '' END
        ELSE {_ONE.format('start')} || ' ' || {_DAYS}[isodow(start)] END AS base FROM e)
        SELECT CASE WHEN "end" > start THEN base WHEN start = DATE '{REF}' THEN 'Bugün (' || base || ')' WHEN start = DATE '{REF}' + 1 THEN 'Yarın (' || base || ')' ELSE base END AS label,
        count(*) AS n FROM t GROUP BY 1""",
    "category_guess": _guess_sql(),
    "city_filter": f"""WITH t AS (SELECT doc_id, {_FOLD.format("concat_ws(' ', nullif(text, ''), nullif(source, ''))")} AS b FROM documents)
        SELECT doc_id, regexp_matches(b, '\\b(?:{filters.LOCAL})') AS local,
        regexp_matches(b, '\\b(?:{filters.ELSEWHERE})\\b') AND NOT regexp_matches(b, '\\b(?:{filters.LOCAL})') AS elsewhere FROM t""",
    "drop_reasons": f"""WITH {EVENTS_SQL} SELECT source, CASE WHEN "end" < DATE '{REF}' THEN 'past' ELSE 'kept' END AS reason, count(*) AS n FROM e GROUP BY ALL""",
    "first_per_source": f"""WITH {EVENTS_SQL} SELECT source, title, start, uid FROM e QUALIFY row_number() OVER (PARTITION BY source, title ORDER BY start, uid) = 1""",
    "block_keys": f"""WITH {EVENTS_SQL}, k AS (
        SELECT unnest(CASE WHEN "end" - start <= 3 THEN list_transform(range(0, ("end" - start) + 1), lambda i: (start + i::INTEGER)::VARCHAR)
          ELSE list_distinct([start::VARCHAR, "end"::VARCHAR, 'long ' || strftime(start, '%Y-%m')]) END) AS block_key FROM e)
        SELECT block_key, count(*) AS n FROM k GROUP BY 1""",
    "candidate_pairs": f"""WITH {LISTINGS_SQL}, k AS (
        SELECT idx, start, "end", unnest(CASE WHEN "end" - start <= 3 THEN list_transform(range(0, ("end" - start) + 1), lambda i: (start + i::INTEGER)::VARCHAR)
          ELSE list_distinct([start::VARCHAR, "end"::VARCHAR, 'long ' || strftime(start, '%Y-%m')]) END) AS b FROM l)
        SELECT DISTINCT x.idx AS l_idx, y.idx AS r_idx FROM k x JOIN k y ON x.b = y.b AND x.idx < y.idx AND x.start - 1 <= y."end" AND y.start - 1 <= x."end\"""",
    "upsert_merge": """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderdate AS day FROM orders), a AS (SELECT * FROM o WHERE day < TIMESTAMP '1999-01-01'),
        b AS (SELECT * FROM o WHERE day >= TIMESTAMP '1997-01-01')
        SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_totalprice * 2 ELSE a.o_totalprice END AS o_totalprice,
        coalesce(a.day, TIMESTAMP '2000-01-01') AS first_seen, CASE WHEN b.o_orderkey IS NOT NULL THEN TIMESTAMP '2000-01-01' ELSE a.day END AS last_seen,
        coalesce(a.o_orderkey % 2 = 0, false) AS announced FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
    "upsert_split": """SELECT o_orderdate >= TIMESTAMP '1999-01-01' AS is_new, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1""",
    "prune": """SELECT count(*) AS n, min(o_orderdate) AS oldest FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
        AND o_orderdate >= TIMESTAMP '1999-01-01' - INTERVAL 400 DAY AND o_orderdate::DATE >= DATE '1999-01-01' - 200""",
    "health_counter": """WITH s AS (SELECT user_id, max(event_id) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1)
        SELECT s.user_id, count(e.event_id) AS failures FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = 'error' AND (s.ok IS NULL OR e.event_id > s.ok) GROUP BY 1""",
    "run_counters": """WITH u AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS kept, bool_or(event_type = 'error') AS bad FROM events GROUP BY 1)
        SELECT sum(kept)::BIGINT AS kept, count(*) AS sources, count(*) FILTER (bad) AS failed FROM u""",
    "mode_per_user": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
        SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""",
    "html_titles": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS links FROM pages""",
    "json_props": "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "page_urls": """WITH p AS (SELECT n_name AS key, 'https://example.com/' || n_nationkey AS base, unnest(range(0, n_regionkey + 1)) AS ord FROM nation)
        SELECT key, CASE WHEN ord = 0 THEN base ELSE base || '?page=' || (ord + 1) END AS url, ord::INTEGER AS ord FROM p""",
    "subscriber_match": f"""WITH {EVENTS_SQL}, s AS (SELECT s_suppkey AS chat_id, s_suppkey % 4 AS k FROM supplier)
        SELECT chat_id, count(*) AS n, min(uid) AS first_uid FROM e JOIN s ON (k <> 0 OR is_free) AND (k <> 1 OR category IN ('economy', 'promo')) AND (k <> 2 OR contains(title, 'ring'))
        WHERE {_within('yarin')} GROUP BY 1""",
    "digest_topk": f"""WITH {EVENTS_SQL}, s AS (SELECT s_suppkey AS chat_id, s_suppkey % 4 AS k FROM supplier), m AS (
        SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY start, title, uid) AS r FROM e
        JOIN s ON (k <> 0 OR is_free) AND (k <> 1 OR category IN ('economy', 'promo')) AND (k <> 2 OR contains(title, 'ring')) WHERE {_within('yarin')})
        SELECT chat_id, string_agg(uid, ',' ORDER BY r) FILTER (r <= 12) AS uids, greatest(count(*) - 12, 0) AS more, count(*) FILTER (is_free) AS free FROM m GROUP BY 1""",
    "bucket_texts": f"""{_LABELLED}, u AS (SELECT k, t.*, row_number() OVER (PARTITION BY k ORDER BY start, title, uid) AS i FROM t JOIN kinds ON {_ASKED} WHERE {_within('bu_hafta')} QUALIFY i <= 40),
        {_message_sql(_BUCKET_HEAD, _HEADING, 'CASE WHEN "end" > start THEN label END')}, x AS (SELECT k, n, message FROM m UNION ALL {_NOTHING_SQL.format(_BUCKET_HEAD, _BUCKET_NONE)})
        SELECT s_suppkey AS chat_id, n, message FROM supplier JOIN x ON k = s_suppkey % 4""",
    "digest_texts": f"""{_LABELLED}, d AS (SELECT * FROM t WHERE {_within('bugun')} ORDER BY start, title, uid LIMIT 40),
        u AS (SELECT k, d.*, row_number() OVER (PARTITION BY k ORDER BY start, title, uid) AS i FROM d JOIN kinds ON {_ASKED}{_WORD}), {_message_sql(_DIGEST_HEAD)},
        w AS (SELECT *, n = last AND k <> 0 AND (SELECT count(*) FILTER (is_free) FROM d) > 0 AS footed, {_DIGEST_FOOT} AS foot FROM m),
        x AS (SELECT k, n, CASE WHEN footed AND length(message) + length(foot) + 2 <= 3800 THEN message || chr(10) || chr(10) || foot ELSE message END AS message FROM w
          UNION ALL SELECT k, n + 1, foot FROM w WHERE footed AND length(message) + length(foot) + 2 > 3800 UNION ALL {_NOTHING_SQL.format(_DIGEST_HEAD, _DIGEST_NONE)})
        SELECT s_suppkey AS chat_id, n, message FROM supplier JOIN x ON k = s_suppkey % 4""",
    "news_texts": f"""{_LABELLED}, d AS (SELECT * FROM t WHERE NOT announced AND "end" >= DATE '{REF}' ORDER BY start, title, uid LIMIT 30),
        a AS (SELECT k, d.*, row_number() OVER (PARTITION BY k ORDER BY start, title, uid) AS i, count(*) OVER (PARTITION BY k) AS passed FROM d JOIN kinds ON {_ASKED}{_WORD}), u AS (SELECT * FROM a WHERE i <= 12),
        {_message_sql("'✨ ' || least(passed, 12) || ' yeni etkinlik eklendi'")}
        SELECT s_suppkey AS chat_id, n, message || CASE WHEN n = last AND passed > 12 THEN chr(10) || chr(10) || '<i>…ve ' || (passed - 12) || ' etkinlik daha. /hafta</i>' ELSE '' END AS message
        FROM supplier JOIN m ON m.k = s_suppkey % 4 JOIN (SELECT DISTINCT k, passed FROM a) z ON z.k = m.k""",
    "saved_pages": """WITH s AS (SELECT url, TIMESTAMP '2000-01-01' - to_minutes(page_id % 50) AS fetched_at, html FROM pages UNION ALL SELECT url, TIMESTAMP '2000-01-01', html || 'again' FROM pages WHERE page_id % 3 = 0)
        SELECT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, url, fetched_at, sha256(html) AS html_sha256 FROM s WHERE fetched_at > TIMESTAMP '1999-12-31 23:31:00'
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, html DESC) = 1""",
    "dated_store": """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS start, o_orderdate::DATE + 3 AS "end", o_orderdate < TIMESTAMP '1999-01-01' AS known, o_orderkey % 5 = 0 AS changed,
          ((o_orderkey % 3) * 20)::INTEGER AS k FROM orders),
        s AS (SELECT o_orderkey, CASE WHEN changed THEN 2 * o_totalprice ELSE o_totalprice END AS o_totalprice, CASE WHEN changed THEN start + k ELSE start END AS start, CASE WHEN changed THEN "end" + k ELSE "end" END AS "end",
          CASE WHEN known THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '2000-01-01' END AS first_seen, CASE WHEN changed THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '1999-01-01' END AS last_seen FROM o WHERE known OR changed)
        SELECT * FROM s WHERE "end" >= DATE '1998-09-01' AND start <= DATE '1999-01-31'""",
    "stream_upsert": """SELECT user_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1""",
    "announced_once": """SELECT user_id, ts AS announced_at FROM events WHERE user_id IS NOT NULL
        QUALIFY coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY, true) AND row_number() OVER (PARTITION BY user_id, ts) = 1""",
    "settled_windows": """SELECT date_trunc('day', ts) AS start, event_type, count(DISTINCT event_id) AS n, round(sum(value), 2) AS total FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    "pages_to_events": _FROM_PAGES,
    "marked_announced": f"WITH {EVENTS_SQL} SELECT uid, announced OR source_count % 2 = 0 AS announced FROM e",
    "updated_health": """WITH o AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, max(ts) AS last_success FROM events WHERE user_id % 3 <> 0 GROUP BY 1),
        r AS (SELECT user_id, user_id % 2 = 0 AS ok, count(*) AS n FROM events WHERE user_id % 4 <> 1 GROUP BY ALL)
        SELECT coalesce(o.user_id, r.user_id)::VARCHAR AS source, (CASE WHEN ok IS NULL THEN failures WHEN ok THEN 0 ELSE coalesce(failures, 0) + 1 END)::INTEGER AS failures,
        CASE WHEN ok THEN TIMESTAMP '2000-01-01' ELSE last_success END AS last_success,
        CASE WHEN ok IS NULL THEN 'before' WHEN NOT ok THEN 'e0 of ' || n || '; e1 of ' || n || '; e2 of ' || n END AS last_error FROM o FULL JOIN r USING (user_id)""",
    "last_run": "SELECT event_id AS id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1",
    "daily_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
