import gzip
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import functions as F

SHAPE = "url string, fetched_at timestamp, html string"
OLD, NOW = datetime(2026, 8, 1, 10, 0, tzinfo=timezone.utc), datetime(2026, 8, 1, 12, 0, tzinfo=timezone.utc)


def test_pages_round_trip_with_ttl_and_bad_rows(spark, tmp_path):
    from eventloom.sources import saved_pages as sp

    sp.register(spark)
    path = str(tmp_path / "bronze")
    assert sp.latest(spark, path).count() == 0
    rows = [(f"https://h{i % 3}.example/{i}", OLD, f"<p>ğ {i}\n</p>") for i in range(30)] + [(None, OLD, "x"), ("no address", NOW, "y"), ("https://h0.example/null", NOW, None)]
    sp.save(spark.createDataFrame(rows, SHAPE).repartition(4), path)
    sp.save(spark.createDataFrame([("https://h1.example/1", NOW, "<p>new</p>")], SHAPE), path)
    got = {r.url: r for r in sp.latest(spark, path).collect()}
    assert len(got) == 31 and got["https://h1.example/1"].html == "<p>new</p>" and got["https://h2.example/2"].html == "<p>ğ 2\n</p>" and got["https://h0.example/null"].html is None
    assert {r.host for r in got.values()} == {f"h{k}.example" for k in range(3)}
    young = sp.latest(spark, path, now=datetime(2026, 8, 1, 12, 10), minutes=30)
    assert sorted(r.url for r in young.collect()) == ["https://h0.example/null", "https://h1.example/1"]
    marks = sorted(p.read_text() for p in Path(path, "_written").iterdir())
    assert marks == ['{"pages": 1, "failed": 0}', '{"pages": 31, "failed": 2}']
    # a broken line is a row with its error, files without a mark are not read
    mark = next(Path(path, "_written").iterdir()).name
    Path(path, "pages/host=h0.example", f"{mark}.broken.0").write_bytes(gzip.compress(b"{oops\n"))
    Path(path, "pages/host=h0.example", "unfinished.task.0").write_bytes(gzip.compress(b'{"url": "https://h0.example/u", "fetched_at": null, "html": ""}\n'))
    told = spark.read.format("saved_pages").option("path", path).load()
    assert told.filter("error IS NOT NULL").count() == 1 and sp.latest(spark, path).count() == 31
    assert told.rdd.getNumPartitions() == 3


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    import pytest

    from eventloom.sources import saved_pages as sp

    sp.register(spark)
    path = str(tmp_path / "bronze")
    rows = spark.range(20).repartition(2).select(F.concat(F.lit("https://h/"), F.col("id").cast("string")).alias("url"), F.lit(OLD).alias("fetched_at"), F.when(F.col("id") == 19, F.raise_error(F.lit("stop"))).otherwise("x").alias("html"))
    with pytest.raises(Exception, match="stop"):
        sp.save(rows, path)
    assert sp.latest(spark, path).count() == 0 and not [p for p in Path(path).rglob("*") if p.is_file()]
