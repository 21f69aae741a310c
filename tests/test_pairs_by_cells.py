"""Candidate pairs and their scores by cells, held against all pairs in plain Python; counts of pairs that are not made."""

import random
from datetime import date, timedelta

import numpy as np
import pytest

from eventloom.functions import similarity as sm
from eventloom.operators import resolve

FIELDS = "idx long, title string, venue string, start date, end date, url string"


def records(spark, n=150, seed=3):
    rng = random.Random(seed)
    names = ["caz gecesi", "caz geceleri", "rock gecesi", "ali veli", "ali", "", "kafka konusmalari", "kafka konusmasi"]
    links = [None, None, "https://x.y/1", "https://x.y/2", "https://x.y/"]
    rows = []
    for i in rng.sample(range(1000), n):
        start = date(2026, 8, 27) + timedelta(days=rng.randint(0, 4))
        rows.append((i, rng.choice(names), rng.choice(["arena", "arena salonu", "kultur merkezi", ""]), start, start + timedelta(days=rng.choice([0, 0, 1, 3, 6])), rng.choice(links)))
    rows.append((2000, "ali veli", "arena", None, None, None))
    return spark.createDataFrame(rows, FIELDS)


def keys(start, end):
    if (end - start).days <= 3:
        return {str(start + timedelta(days=k)) for k in range((end - start).days + 1)}
    return {str(start), str(end), f"long {start:%Y-%m}"}


def candidates(rows):
    day = timedelta(days=1)
    rows = sorted((r for r in rows if r.start), key=lambda r: r.idx)
    return [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if keys(a.start, a.end) & keys(b.start, b.end) and a.start - day <= b.end and b.start - day <= a.end]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cell", [700, 5])
def test_candidate_pairs_are_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(resolve, "CELL", cell)
    df = records(spark)
    want = candidates(df.collect())
    made = resolve.candidate_pairs(df.select("idx", "start", "end"), ["idx"])
    assert sorted(map(tuple, made.collect())) == [(a.idx, b.idx) for a, b in want]
    # pairs come out of cells as they are: no join makes them, none tests them
    assert plan(made).lstrip().startswith("FlatMapGroupsInArrow")
    whole = resolve.candidate_pairs(df).select("l_idx", "r_idx", "l_title", "r_title", "l_end", "r_end")
    assert sorted(map(tuple, whole.collect())) == [(a.idx, b.idx, a.title, b.title, a.end, b.end) for a, b in want]


def test_no_pairs_of_nothing(spark):
    none = spark.createDataFrame([], FIELDS)
    assert resolve.candidate_pairs(none).isEmpty() and resolve.match_scores(none).isEmpty()
    assert resolve.stats(none).select("before", "after", "comparisons", "matches", "merged").first() == (0, 0, 0, 0, 0)


def expected_scores(spark, df):
    ready = {r.idx: r for r in resolve.prepared(df).collect()}
    out = {}
    for a, b in candidates(df.collect()):
        x, y = ready[a.idx], ready[b.idx]
        title, venue = sm.title_score(x.key, y.key), sm.venue_score(x.place, y.place)
        one, two = set(x.key.split(" ")), set(y.key.split(" "))
        mixed = None if venue is None else 0.72 * title + 0.28 * venue
        if x.link is not None and x.link == y.link:
            score = 1.0
        elif min(len(one), len(two)) <= 1 and one != two or title < 0.55:
            score = 0.0
        elif venue is not None and venue < 0.4:
            score = 0.75 * mixed
        elif title >= 0.97:
            score = 1.0
        else:
            score = 0.97 * title if venue is None else mixed
        out[a.idx, b.idx] = (title, venue, score)
    return out


@pytest.mark.parametrize("cell", [700, 5])
def test_scores_of_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(resolve, "CELL", cell)
    df = records(spark)
    made = resolve.match_scores(df)
    assert {(r[0], r[1]): tuple(r)[2:] for r in made.collect()} == expected_scores(spark, df)
    # the scores are made where the pairs are: pairs are not joined to them
    assert plan(made).lstrip().startswith("FlatMapGroupsInArrow")


def test_scores_round_half_up_as_spark_does(spark):
    values = [0.1234567895, 0.0009765625, 3 / 1024, 0.28 * 7 / 1024, 2 / 3, 0.9999999995, 1.0, 0.0, 0.8200000000000001]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 9)").collect()]
    assert sm.half_up(np.array([*values, np.nan]), 9)[:-1].tolist() == want


def test_counts_of_pairs_that_are_not_made(spark, monkeypatch):
    df = records(spark, 220, 8).filter("start IS NOT NULL")
    scores = expected_scores(spark, df)
    roots = {r.idx: r.root for r in resolve.clusters(df, scores=resolve.match_scores(df)).collect()}
    monkeypatch.setattr(resolve, "by_cells", None)
    got = resolve.stats(df).first()
    matches = sum(s >= resolve.THRESHOLD for *_, s in scores.values())
    assert (got.comparisons, got.matches) == (len(scores), matches) and 0 < matches < len(scores)
    assert (got.before, got.after, got.merged) == (220, len(set(roots.values())), 220 - len(set(roots.values())))
