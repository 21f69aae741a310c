"""Streams over several batches and restarts; similarity and links against plain definitions."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import similarity as sm
from eventloom.operators import resolve
from eventloom.streaming import announce, ingest

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def stream_of(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def add(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def at(day, hour=0):
    return datetime(2026, 1, 1) + timedelta(days=day, hours=hour)


def test_announced_once_over_restarts(spark, tmp_path):
    def run():
        out = announce.announced(stream_of(spark, tmp_path), "user_id")
        return sorted((r.user_id, r.announced_at) for r in announce.run_available(out, f"{tmp_path}/out", f"{tmp_path}/c").collect())

    add(spark, tmp_path, [(1, at(0, 5), 7, "a", 1.0), (2, at(0, 3), 7, "a", 1.0), (3, at(1), 8, "a", 1.0), (4, at(1), None, "a", 1.0)])
    first = [(7, at(0, 3)), (8, at(1))]
    assert run() == first
    add(spark, tmp_path, [(5, at(10), 7, "a", 1.0), (6, at(10), 9, "a", 1.0)])
    assert run() == sorted([*first, (9, at(10))])
    assert run() == sorted([*first, (9, at(10))])  # nothing new
    add(spark, tmp_path, [(7, at(24), 7, "a", 1.0), (8, at(24), 8, "a", 1.0)])  # 8 was away for longer than 14 days
    add(spark, tmp_path, [(9, at(60), 1, "a", 1.0)])
    got = run()
    assert got == sorted([*first, (9, at(10)), (8, at(24)), (1, at(60))])
    add(spark, tmp_path, [(10, at(61), 7, "a", 1.0)])
    assert run() == sorted([*got, (7, at(61))])
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{tmp_path}/c")
    assert {r.key.key for r in state.select("key").collect()} == {1, 7}  # the rest was forgotten


def test_late_and_repeated_rows(spark, tmp_path):
    def run():
        out = announce.settled_windows(stream_of(spark, tmp_path))
        return sorted((r.start, r.event_type, r.n, r.total) for r in announce.run_available(out, f"{tmp_path}/out", f"{tmp_path}/c").collect())

    add(spark, tmp_path, [(1, at(0, 1), 1, "a", 1.0), (2, at(0, 2), 1, "a", 2.0), (2, at(0, 2), 1, "a", 2.0)])
    assert run() == []  # the day may still change
    add(spark, tmp_path, [(2, at(0, 2), 1, "a", 2.0), (3, at(0, 20), 1, "b", 4.0), (4, at(2, 5), 1, "a", 8.0)])
    assert run() == [(at(0), "a", 2, 3.0), (at(0), "b", 1, 4.0)]
    add(spark, tmp_path, [(5, at(1, 1), 1, "a", 16.0), (6, at(2, 6), 1, "a", 32.0), (7, at(4), 1, "a", 64.0)])  # 5 is a day late
    assert run() == [(at(0), "a", 2, 3.0), (at(0), "b", 1, 4.0), (at(2), "a", 2, 40.0)]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    add(spark, tmp_path, [(1, at(0, 1), 1, "a", 1.0), (2, at(3), 1, "a", 2.0)])
    out = announce.run_available(ingest.windowed_counts(stream_of(spark, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/c")
    assert [tuple(r) for r in out.collect()] == [(at(0), "a", 1, 1.0)]


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before, row = row, [0]
        for j, d in enumerate(b):
            row.append(before[j] + 1 if c == d else max(row[-1], before[j + 1]))
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abğ ", k=rng.randint(0, 90))) for _ in range(2))
        assert sm.common_length(a, b) == table_lcs(a, b)


def titles(n, seed):
    rng = random.Random(seed)
    words = ["konser", "konseri", "gece", "gecesi", "tiyatro", "rock", "caz", "ali", "alı", "veli", "a", "kafka", "kafkas"]
    return sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n)})


def test_no_similar_pair_is_excluded():
    known = titles(160, 2)
    for least in (0.75, 0.85):
        tokens = {t: set(t.split()) for t in known}
        apart = lambda a, b: min(len(tokens[a]), len(tokens[b])) < 2 and tokens[a] != tokens[b]
        want = {(a, b) for a in known for b in known if a < b and not apart(a, b) and sm.title_score(a, b) >= least}
        half = len(known) // 3
        made = set(sm.pairs_within(known, known, least))
        assert want <= made and len(made) < len(known) ** 2 / 4
        across = set(sm.pairs_within(known[:half], known[half:], least))
        assert {(a, b) for a, b in want if (a in known[:half]) != (b in known[:half])} <= across


@pytest.mark.parametrize("chunk", [2000, 7])
def test_links_connect_what_scores_connect(spark, monkeypatch, chunk):
    monkeypatch.setattr(resolve, "TITLES", chunk)
    rng = random.Random(5)
    names = titles(60, 3)
    rows = []
    for i in range(220):
        start = date(2026, 8, 27) + timedelta(days=rng.randint(0, 5))
        name = rng.choice(names) if i % 9 else ""
        link = rng.choice([None, None, f"https://x.y/{rng.randint(0, 12)}", "https://x.y/"])
        rows.append((i, name, rng.choice(["Arena", "Arena İzmir", "Kültür Merkezi", None, ""]), start, start + timedelta(days=rng.choice([0, 0, 1, 3, 9])), link))
    rows += [(220 + k, *rows[5][1:]) for k in range(5)]
    df = spark.createDataFrame(rows, "idx long, title string, venue string, start date, end date, url string")
    by_links = {r.idx: r.root for r in resolve.clusters(df).collect()}
    by_scores = {r.idx: r.root for r in resolve.clusters(df, scores=resolve.match_scores(df)).collect()}
    assert by_links == by_scores and 1 < len(set(by_links.values())) < len(rows)
    with pytest.raises(ValueError):
        resolve.links(df, 0.7)


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "idx long, title string, venue string, start date, end date, url string")
    assert resolve.clusters(none).isEmpty()
