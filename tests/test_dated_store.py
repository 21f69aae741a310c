from datetime import date, datetime

from pyspark.sql import functions as F

SHAPE = "uid string, title string, start date, end date, first_seen timestamp, last_seen timestamp, announced boolean"
NEW = "uid string, title string, start date, end date"
ONE, TWO, THREE = datetime(2026, 8, 1), datetime(2026, 8, 2), datetime(2026, 8, 3)


def _files(table):
    from pathlib import Path

    return {str(p) for p in Path(table.path).rglob("*.parquet")}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_an_upsert_rewrites_the_parts_it_touches(spark, tmp_path):
    from eventloom.operators.dated_store import DatedTable

    t = DatedTable(spark, str(tmp_path / "t"), "uid", SHAPE, "day", 2)
    assert t.read().count() == 0 and t.between(date(2026, 8, 1), date(2026, 8, 2)).count() == 0
    rows = [(f"u{i}", f"t{i}", date(2026, 8, 1 + i % 10), date(2026, 8, 1 + i % 10)) for i in range(200)]
    t.upsert(spark.createDataFrame(rows, NEW), ONE)
    before, live = _files(t), set(t.parts())
    assert len(live) == 20
    batch = spark.createDataFrame([("u3", "again", date(2026, 8, 4), date(2026, 8, 4)), ("u3", "again", date(2026, 8, 4), date(2026, 8, 4))], NEW)
    t.upsert(batch, TWO, "b1")
    written = _files(t) - before
    assert len({p.rsplit("/version=", 1)[0] for p in written}) == 1 and len(live & set(t.parts())) == 19
    t.upsert(batch, THREE, "b1")  # the same batch again, after a restart
    got = {r.uid: r for r in t.read().collect()}
    assert len(got) == 200 and (got["u3"].title, got["u3"].first_seen, got["u3"].last_seen) == ("again", ONE, TWO) and got["u4"].last_seen == ONE
    # a moved start takes the row out of its old part
    t.upsert(spark.createDataFrame([("u3", "moved", date(2026, 9, 9), date(2026, 9, 12))], NEW), THREE)
    assert t.read().count() == 200
    read = t.between(date(2026, 9, 10), date(2026, 9, 10))
    assert [(r.uid, r.start, r.first_seen) for r in read.collect()] == [("u3", date(2026, 9, 9), ONE)]
    assert "PartitionFilters: [isnotnull(span" in _plan(read) and "GreaterThanOrEqual(end" in _plan(read)
    assert "PartitionFilters: [slice" in _plan(t.get("u7")) or "PartitionFilters: [isnotnull(slice" in _plan(t.get("u7"))
    assert sorted(r.uid for r in t.get("u7", "u8", "nobody").collect()) == ["u7", "u8"]


def test_drops_empty_parts_nulls_and_half_writes(spark, tmp_path):
    from eventloom.operators.dated_store import DatedTable

    t = DatedTable(spark, str(tmp_path / "t"), "uid", SHAPE, "month", 1)
    rows = [("a", "x", date(2026, 8, 1), date(2026, 8, 1)), ("b", "y", date(2026, 9, 1), date(2026, 9, 1)), ("c", None, None, None), (None, "no key", date(2026, 8, 1), None)]
    t.upsert(spark.createDataFrame(rows, NEW), ONE)
    t.upsert(spark.createDataFrame([], NEW), TWO)
    assert len(t.versions()) == 1 and sorted(r.uid for r in t.read().collect()) == ["a", "b", "c"]
    kept = [p for p in t.parts() if "2026-09" in p]
    t.drop(F.col("end") < F.lit(date(2026, 8, 20)))
    assert sorted(r.uid for r in t.read().collect()) == ["b", "c"] and [p for p in t.parts() if "2026-09" in p] == kept
    assert t.between(date(2026, 1, 1), date(2026, 12, 31)).count() == 1
    # files without a mark are not read, and the next write clears them
    half = f"{t.path}/data/span=2026-09-01/slice=0/version=00000099-half-"
    t.read().write.parquet(half)
    assert t.read().count() == 2
    t.upsert(spark.createDataFrame([("c", "dated", date(2026, 9, 3), date(2026, 9, 3))], NEW), THREE)
    assert sorted((r.uid, r.title) for r in t.read().collect()) == [("b", "y"), ("c", "dated")] and not any("half" in p for p in _files(t))
