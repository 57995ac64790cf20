"""Audits of a stored run, and figures by subgroup."""

from fathomline.operators import audit as A

SCHEMA = "id string, ord long, error string, correct boolean"


def test_verdicts_missing_repeated_and_null(spark):
    stored = spark.createDataFrame([("a", 1, None, True), ("b", 2, "x", False), (None, 3, None, True), ("c", 4, "x", False), ("c", 4, "x", False), ("e", 6, None, True)], SCHEMA)
    again = spark.createDataFrame([("a", 1, None, True), ("b", 2, "y", False), (None, 3, "z", None), ("c", 4, "x", False), ("d", 5, None, True)], SCHEMA)
    found = A.verdicts(stored.repartition(3), again, ["id", "ord"])
    assert sorted(map(tuple, found.collect())) == [
        ("verdict", "b/2", "error", "x", "y"), ("verdict", "c/4", "times", "2", "1"), ("verdict", "d/5", "times", "0", "1"), ("verdict", "e/6", "times", "1", "0"),
        ("verdict", "null/3", "correct", "true", "null"), ("verdict", "null/3", "error", "null", "z"),
    ]
    assert A.verdicts(again, again, ["id", "ord"]).count() == 0 and A.verdicts(again.limit(0), again.limit(0), ["id"]).count() == 0


def test_figures_by_subgroup(spark):
    rows = [("g", e, e is None, t) for e, t in (("x", 1), ("y", 2), ("x", 3), ("y", None), (None, 100))] + [(None, None, True, 7), ("h", None, True, None)]
    found = {r["g"]: tuple(r)[1:] for r in A.by_subgroup(spark.createDataFrame(rows, "g string, error string, correct boolean, said long").repartition(4), "g", "said").collect()}
    assert found.keys() == {"g", "none", "h"}
    assert found["g"][:4] == (5, 1, "x", 26.5) and abs(found["g"][4] - (3 + 97 * 0.85)) < 1e-9
    assert found["none"] == (1, 1, None, 7.0, 7.0) and found["h"] == (1, 1, None, None, None)
