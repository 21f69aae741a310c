from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm.common import likely

from .test_operators import DOCS, corpus


def test_stages_and_run(spark, tmp_path):
    rows = corpus(90, 3)
    labels = [(i, 1, 0) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mix_sources", "pack_sequences"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 3:
            assert 0 < docs.count() <= seen
            seen = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and clashing columns: every stage gives the columns it got and keeps a row of each clean text."""
    rows = corpus(60, 5)
    width = len(rows[0])
    names = [c.split()[0] for c in DOCS.split(", ")]
    at = names.index("text")
    odd = [tuple(None for _ in range(width)), rows[0], rows[0], tuple("" if i == at else v for i, v in enumerate(rows[1])), tuple(None if i not in (0, at) else v for i, v in enumerate(rows[2]))]
    docs = spark.createDataFrame(rows + odd, DOCS)
    for name in ("score", "predicted", "digest", "component_id", "shard", "row", "bucket", "size", "sequence_id"):
        docs = docs.withColumn(name, F.lit("mine"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert docs.filter("score <> 'mine' OR shard <> 'mine'").isEmpty() and not docs.isEmpty(), name
    assert not corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).isEmpty()


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.isEmpty(), name


def staged_folders(spark):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("eventloom-*")}


def test_near_copies_leave_two_folders_and_run_one(spark, tmp_path):
    """What the near join staged goes once the rows to drop are known; a whole run leaves the rows before packing."""

    def labels(before):
        return sorted(name.rsplit("-", 1)[0] for name in staged_folders(spark) - before)

    docs = spark.createDataFrame(corpus(90, 3), DOCS)
    before = staged_folders(spark)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert labels(before) == ["eventloom-near-gone", "eventloom-near-rows"]
    assert 0 < kept.count() < 90
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = staged_folders(spark)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert labels(before) == ["eventloom-pipeline-mix_sources"]
    assert not packed.isEmpty()


def test_near_copies_by_likely_rows(spark):
    """Only rows whose key may be asked for go on to a join; the near join drops the same rows without broadcasts by size."""
    far = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(400)]
    near = [(1000 + i, " ".join(f"n{j}" for j in range(60)) + f" t{i}") for i in range(6)]
    docs = spark.createDataFrame(far + near, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus_pipeline.drop_near_copies(spark, docs, "")
        keys = spark.createDataFrame([(1001,), (None,)], "key long")
        odd = docs.unionByName(spark.createDataFrame([(None, "none")], docs.schema))
        some = likely(odd, "doc_id", keys, "key").collect()
        assert {1001, None} <= {r.doc_id for r in some} and len(some) < 10
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "__el_likely" in plan or "bitmap_construct_agg" in plan
        assert sorted(r.doc_id for r in rows.collect()) == [*range(400), 1000]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
