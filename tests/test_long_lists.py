from pyspark.sql import functions as F


def test_packing_by_pointers_equals_the_fold(spark):
    import random

    from eventloom.operators import render
    from eventloom.operators.long_lists import packed

    rng = random.Random(3)
    rows = [("short", i, "", f"s{i}", "H") for i in range(3)] + [(None, i, "day", "n" * 30, "<b>N</b>") for i in range(5)] + [("wide", i, "", "w" * 60, "H" * 50) for i in range(4)]
    rows += [("long", i, ["", f"day {i // 40}"][rng.random() < 0.9], "x" * rng.choice([1, 5, 20, 40, 75]), "<b>L</b>") for i in range(4000)]
    rows += [("gap", i, "h" * (900 if i % 7 == 3 else 4) + str(i // 5), "g" * (i % 60), "G") for i in range(60)] + [("tie", 1, "", "same", "T")] * 70
    df = spark.createDataFrame(rows, "key string, at int, heading string, line string, header string").repartition(7)
    # lines are cut by the fold itself: limit - 200 is above the longest line here
    limit = 300
    per = df.groupBy("key").agg(F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("at", "line", "heading"))).alias("rows"))
    want = per.select("key", F.posexplode(render.pack_blocks(F.col("header"), F.col("rows"), limit))).collect()
    for block in (2, 64):
        got = packed(df, "key", ["at"], F.col("line"), F.col("heading"), F.col("header"), limit, block).collect()
        assert {(r.key, r.n): r.message for r in got} == {(r.key, r.pos + 1): r.col for r in want} and len(got) == len(want)
    assert max(r.n for r in got if r.key == "long") > 300


def test_packing_edges(spark):
    from eventloom.operators import notify
    from eventloom.operators.long_lists import packed

    shape = "key string, at int, line string, header string, k string, pos int, n int"
    none = spark.createDataFrame([], shape)
    assert packed(none, "key", ["at"], F.col("line"), F.lit(""), F.col("header"), 100).collect() == []
    one = spark.createDataFrame([("a", 1, None, "H", "clash", 5, 5), ("a", None, "first", "H", "clash", 5, 5)], shape)
    assert [tuple(r) for r in notify.messages(one, "key", "line", ["at"], "header").collect()] == [("a", 1, "H\nfirst\n")]
    full = spark.createDataFrame([("a", 1, "line", "H" * 99, "", 1, 1)], shape)
    got = sorted(tuple(r) for r in packed(full, "key", ["at"], F.col("line"), F.lit(""), F.col("header"), 100).collect())
    assert got == [("a", 1, "H" * 99), ("a", 2, "H" * 99 + " <i>(devam)</i>\nline")]
