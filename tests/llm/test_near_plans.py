from eventloom.llm import near_join


def watched(monkeypatch, module, seen):
    """``seen`` gets (label, plan) of all that ``module`` stages."""
    real = module.staged

    def staged(df, label, *rest):
        seen.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label, *rest)

    monkeypatch.setattr(module, "staged", staged)


def test_texts_are_not_shuffled_to_be_sets(spark, monkeypatch):
    """Without broadcasts by size, too, sets are built where the texts lie; repeated and null ids change nothing."""
    far = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(20)]
    near = [(100 + i, " ".join(f"n{j}" for j in range(60)) + f" t{i}") for i in range(4)]
    odd = [(None, near[0][1]), near[1], (100, far[3][1])]
    docs = spark.createDataFrame(far + near + odd, "doc_id long, text string")
    seen = []
    watched(monkeypatch, near_join, seen)
    monkeypatch.setattr(near_join, "CHUNK_MEMBERS", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_join.near_groups(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = next(p for label, p in seen if label == "near-sets")
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    want = [(i, 3 if i == 3 else i) for i in range(20)] + [(100 + i, 100) for i in range(4)] + [(None, 100), (101, 100), (100, 3)]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)
