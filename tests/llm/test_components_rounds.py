from eventloom.llm import components

from .test_near_plans import watched


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars are told as such at once; any others end as stars of their least vertices."""
    seen = []
    watched(monkeypatch, components, seen)
    edges = spark.createDataFrame([(1, 5), (5, 1), (7, 1), (9, 8), (3, 3), (None, 4)], "u long, v long")
    assert sorted(map(tuple, components.components(edges).collect())) == [(5, 1), (7, 1), (9, 8)]
    assert [label for label, _ in seen] == ["edges"]
    path = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 22), (21, 22)], "u long, v long")
    assert sorted(map(tuple, components.components(path).collect())) == [*((i, 0) for i in range(1, 10)), (21, 20), (22, 20)]
