"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from fathomline.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.collect(), df.columns) == normal(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_bootstrap_intervals(spark):
    from pyspark.sql import functions as F

    from fathomline.operators import statistics as S

    df = spark.range(500).select("id", (F.col("id") % 4 == 0).alias("x"), (F.col("id") % 2 == 0).alias("y"), (F.col("id") % 5).alias("g"))
    r = S.bootstrap(df, "x").first()
    assert r["low"] < 0.25 < r["high"] and abs(r["high"] - r["low"] - 2 * 1.96 * (0.25 * 0.75 / 500) ** 0.5) < 0.02
    r = S.paired_bootstrap(df, "x", "y").first()  # x implies y, so the difference is 1 on a quarter of the rows: narrower than of unpaired rates
    assert (r["n"], r["diff"]) == (500, 0.25) and abs(r["high"] - r["low"] - 2 * 1.96 * (0.25 * 0.75 / 500) ** 0.5) < 0.02
    r = S.macro_bootstrap(df, "x", "g").first()
    assert r["groups"] == 5 and r["low"] < 0.25 < r["high"] and abs(r["high"] - r["low"] - 2 * 1.96 * (0.25 * 0.75 / 500) ** 0.5) < 0.02
    assert S.bootstrap(df, "x", by=["g"]).orderBy("g").collect() == S.bootstrap(df.repartition(7), "x", by=["g"]).orderBy("g").collect()


def test_running_sums_in_parts(spark):
    """Many values, few, ties, nulls in the group and in the value, negative numbers, one group and none."""
    import random

    from pyspark.sql import functions as F

    from fathomline.operators import statistics as S

    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([r.randint(-50, 50) / 4, 0.25]), r.random() < 0.4) for _ in range(3000)] + [("c", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, x double, y boolean").repartition(5)
    for by in (["g"], []):
        counts = df.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("times"))
        got = {(*[row[b] for b in by], row["x"]): (row["times_before"], row["times_all"]) for row in S.running(counts, by, "x", ["times"], parts=7).collect()}
        of = lambda key: [x for g, x, _ in rows if not by or g == key[0]]
        assert got == {(*([g] if by else []), x): (sum(v < x for v in of((g,))), len(of((g,)))) for g, x, _ in rows}
    want = {}
    for g in ("a", "b", None, "c"):
        pos, neg = [x for h, x, y in rows if h == g and y], [x for h, x, y in rows if h == g and not y]
        want[g] = round(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)), 6) if pos and neg else None
    assert {row["g"]: row["auroc"] for row in S.auroc(df, "x", "y", ["g"]).collect()} == want
    assert S.at_index(df.limit(0), "x", {"m": F.floor(F.col("n") / 2)}).collect()[0]["m"] is None


def test_pairs_of_all_part_groups(spark, tmp_path):
    spark.createDataFrame([(1, 60), (1, 107), (1, 49), (2, 10), (2, 7), (3, 3), (3, 103)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue.QUERIES["pair_containment"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(7, 10, 2), (7, 49, 1), (10, 49, 1)]


def test_every_part_is_converted_and_whole_texts_masked(spark, tmp_path):
    spark.createDataFrame([(k, k) for k in range(1, 22)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "x" * 50 + "  12.5 mg\n of 7")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["p_partkey"] for r in catalogue.QUERIES["unit_convert"](spark, str(tmp_path)).collect()}
    assert found == set(range(1, 22))
    assert catalogue.QUERIES["text_features"](spark, str(tmp_path)).first()["masked"] == "x" * 50 + " # mg of #"


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
