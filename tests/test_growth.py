"""What decides how queries grow: rows dealt over tasks, and work that is left out where nothing asks for it."""

import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from fathomline.functions import discourse as D
from fathomline.functions import notes as N
from fathomline.operators import comparison as M
from fathomline.operators import keys as K
from fathomline.operators import relational as R
from fathomline.operators import scoring as V
from fathomline.operators import statistics as S
from fathomline.plans import cases
from fathomline.sources.tables import read, spread

SMALL = "/root/testdata/sf0.001"


def by_task(df):
    return [n for _, n in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_rows_of_one_row_group_are_dealt_over_tasks(spark):
    part = read(spark, SMALL, "part").select("p_partkey", "p_size")
    assert len(by_task(part)) == 1
    for rows in (spread(part), cases.records(spark, SMALL), cases.rollouts(spark, SMALL)):
        counts = by_task(rows)
        assert len(counts) == 4 and max(counts) - min(counts) <= 4 and sum(counts) == part.count()
    assert spread(part).exceptAll(part).isEmpty()


def test_conditions_on_texts_stay_after_rows_are_dealt(spark):
    text = F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    rows = spread(read(spark, SMALL, "part").select("p_partkey", "p_size")).withColumn("text", text).where(F.regexp_like("text", F.lit("n.*7$")))
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("Repartition")
    assert "Filter" in above and "Filter" not in below and rows.count() == 20


def test_notes_of_negatives_are_edited_once(spark):
    plan = queries()["generated_negatives"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Allergies" not in plan and "Repartition" not in plan, plan


def test_runs_are_judged_once_for_their_comparison(spark):
    plan = queries()["run_comparison"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan, plan


def test_rates_by_name_are_those_of_all(spark):
    row = lambda kind, i: (kind, i % 2 == 0, i % 3 == 0, i % 5 == 0)
    rows = spark.createDataFrame([row(k, i) for i, k in enumerate(["tool_call", "uncertain", "extractive"] * 7)], "answer_type string, correct boolean, called boolean, unsupported_args boolean")
    rows = rows.withColumns({c: F.col("called") for c in ("tool_selected", "tool_args_correct", "tool_executed", "result_in_answer", "over_call", "over_refusal")})
    names = ["tool_e2e", "unsupported_argument_rate"]
    assert sorted(M.bundle(rows, names=names).collect()) == sorted(M.bundle(rows).where(F.col("metric").isin(names)).collect())
    plan = queries()["rates_of_calls"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "batch(answer_type" not in plan, plan


def test_only_calls_are_judged_for_their_rate(spark):
    plan = queries()["rates_of_subsets"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    judged = plan.split("batch(answer_type")[1].split("Repartition")[0]
    assert any("Filter" in line and "% 4" in line for line in judged.splitlines()), plan  # the kind of a record is that of a remainder by 4


def test_far_numbers_are_not_rounded(monkeypatch):
    rounded = []
    monkeypatch.setattr(N, "round", lambda *of: rounded.append(of) or round(*of), raising=False)
    assert N.same_number(5.2, 1, [100.0, -5.2, 7.0, 5.24]) and not N.same_number(5.2, 1, [5.26, float("nan"), float("inf")]) and len(rounded) == 2
    assert N.same_number(6.0, 0, [5.5]) and not N.same_number(5.0, 0, [5.5]) and N.same_number(1e300, 0, [1e300])


def test_input_is_read_once_for_a_typed_verdict(monkeypatch):
    read_facts, times = K.input_facts, []
    monkeypatch.setattr(K, "input_facts", lambda *of: times.append(1) or read_facts(*of))
    found = K.verdict("extractive", "Tired.", [["Sodium", "150", "mmol/L", "136-145"]], "What is the sodium?", "It is 150.", "It is 150.", None, None, "answer", None)
    assert found["error"] is None and found["coverage"] == "structured" and len(times) == 1


def test_rates_by_check_need_no_former_verdict(spark):
    plan = queries()["typed_rates_by_check"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("batch(") <= 2, plan


def test_kernels_pass_over_what_is_not_asked(spark):
    rows = spark.createDataFrame([("tool_call", "unit_convert"), ("uncertain", "calculate_bmi")], "kind string, tool string")
    none = F.lit(None).cast("string")
    of = [none, F.lit(None).cast("array<array<string>>"), none]
    error, sources = V.ANSWER_ERROR(F.col("kind"), none, *of, F.lit("It is not documented.")), V.SOURCES(F.col("tool"), F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>"), *of)
    found = {r["kind"]: r for r in rows.select("kind", error.alias("e"), sources.alias("s")).collect()}
    assert found["tool_call"]["e"] is None and found["tool_call"]["s"] is None
    assert found["uncertain"]["e"] is not None and len(found["uncertain"]["s"]) == 2


def test_parts_are_found_by_halves(spark):
    cuts = [1.0, 2.0, 2.0, 3.5, 9.0]
    values = [0.0, 1.0, 1.5, 2.0, 2.5, 3.5, 9.0, 10.0]
    rows = spark.createDataFrame([(cuts, v) for v in values] + [([], 1.0)], "c array<double>, v double")
    found = [(r["c"], r["v"], r["p"]) for r in rows.withColumn("p", S.part_of(F.col("c"), F.col("v"), 199)).collect()]
    assert all(p == sum(c < v for c in c_) for c_, v, p in found)


def test_only_parts_with_a_place_are_sorted(spark, monkeypatch):
    sorted_rows, inside = [], S.inside_parts
    monkeypatch.setattr(S, "inside_parts", lambda rows, offsets, *of: sorted_rows.append(offsets.agg(F.sum("__sum_times")).first()[0]) or inside(rows, offsets, *of))
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, "a").alias("g"), F.col("id").cast("double").alias("v"))
    found = {r["g"]: (r["p10"], r["p90"]) for r in S.interpolated(df, "v", {"p10": 0.1, "p90": 0.9}, ["g"]).collect()}
    assert all(abs(x - y) < 1e-6 for g, first in (("a", 0), (None, 1)) for x, y in zip(found[g], (first + 1999.8, first + 17998.2), strict=True)) and sorted_rows[0] < 2000


def test_quantiles_have_names_with_points(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(101)], "g string, v double")
    assert S.quantiles(df, "v", {"p0.5": 0.5, "p0.9": 0.9}, ["g"]).first() == ("a", 50.0, 90.0)
    assert S.interpolated(df, "v", {"p0.5": 0.5}, ["g"]).first() == ("a", 50.0)


def test_names_are_tried_where_their_first_letters_stand():
    import random

    names = (*D.ALIASES, "[odd] name", "^x")
    pattern, _ = D.names_pattern(names)
    first = re.search(r"\(\?=\(\?i:\[.*?\]\)\)(?=\(\?:)", pattern.pattern)
    plain = re.compile(pattern.pattern.replace(first[0], "", 1))
    words = ["Sodium", "SODIUM", "\u017fodium", "\u212a", "K", "k", "ALT", "alt", "Na", "[Odd] name", "^x", "-ALT", "xALT", "free T4", "pH", " ", ", ", "\n", "5.1", "total  protein", "Total Protein"]
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(words) + draw.choice(["", " ", "-"]) for _ in range(12))
        assert [m.span() for m in pattern.finditer(text)] == [m.span() for m in plain.finditer(text)], text
    assert not D.names_pattern(("",))[0].pattern.count("(?=")


def test_kernels_hold_few_rows_at_once(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    pieces = list(N.slices(batch, 128))
    assert max(map(len, pieces)) == 128 and [x for p in pieces for x in p.column("x").to_pylist()] == list(range(1000))
    size = N.arrow("array<long>", lambda xs: xs and [len(xs), *xs[:1]])
    rows = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") % 7 != 0, F.array_repeat("id", 3)).alias("xs"))
    found = {r["id"]: r["s"] for r in rows.withColumn("s", size(F.col("xs"))).collect()}
    assert found == {k: None if k % 7 == 0 else [3, k] for k in range(1000)}
    assert rows.where("id < 0").withColumn("s", size(F.col("xs"))).collect() == []


def test_texts_of_queries_are_cut_once(spark):
    plan = queries()["check_duplicates"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan, plan


def test_pairs_are_compared_by_their_sets(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g".split()), (2, "a b c d e f h".split()), (3, "x a b c d e f".split()), (4, ["a"])], "id long, t array<string>")
    grams = R.Grams(docs, docs, "id", "t", 5)
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3)], "q long, x long")
    assert sorted(grams.intersected(pairs).collect()) == sorted(grams.compared(pairs).collect()) == [(1, 1, 1.0), (1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.5)]
