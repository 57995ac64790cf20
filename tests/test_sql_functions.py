"""Checks and calls from SQL."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import tables as T
from fathomline.operators import quality as Q

RECORD = """named_struct('id', concat('train_', id), 'split', 'train', 'ord', id, 'note', 'Weight 80 kg, height 180 cm.', 'table', named_struct('type', 'labs', 'headers', array('Test', 'Value', 'Unit', 'Reference Range'),
  'rows', array(array('Creatinine', '1.0', 'mg/dL', '0.7-1.3'))), 'question', 'What is the BMI?', 'answer', 'It is 24.7.', 'answer_type', 'tool_call',
  'tool_calls', array(named_struct('tool', 'calculate_bmi', 'arguments', map('weight_kg', if(id = 2, '81', '80'), 'height_cm', '180'), 'result', if(id = 1, 9D, if(id = 2, 25D, 24.7D)))))"""


def records(spark):
    return spark.range(4).selectExpr(f"explode(array({RECORD})) as r").select("r.*")


def test_flags_and_figures_in_sql(spark):
    with T.checks_in_sql(records(spark), ["Q1", "Q4", "Q5", "sources"]) as session:
        four, five = session.sql("SELECT * FROM flags('Q4')"), session.sql("SELECT id, detail FROM flags('Q5') WHERE split = 'train'")
        sources, other = session.sql("SELECT key, value FROM figures('sources')"), session.sql("SELECT * FROM flags('Q6')")
        plan = four._jdf.queryExecution().optimizedPlan().toString()
    assert four.columns == ["check", "severity", "split", "id", "detail"]
    assert four.collect() == Q.q4_results(records(spark)).collect() and [r["id"] for r in four.collect()] == ["train_1"]
    assert [tuple(r) for r in five.collect()] == [("train_2", "not in the input: weight")]
    assert {r["key"]: r["value"] for r in sources.collect()} == {"train weight:note/kg height:note/cm": 3, "train weight:missing height:note/cm": 1}
    # A name leaves one branch of the union, without Python.
    assert plan.count("Range (0, 4") == 1 and "Union" not in plan and "Python" not in plan
    with pytest.raises(Exception, match="not registered: Q6"):
        other.collect()
    with pytest.raises(Exception, match="(?i)flags"):
        spark.sql("SELECT * FROM flags('Q4')")
    with pytest.raises(ValueError, match="Q77"):
        T.register_checks(records(spark), ["Q77"])


def test_calls_of_a_table(spark):
    T.register_calls(spark)
    call = lambda unit: f'<tool_call>{{"name": "unit_convert", "arguments": {{"value": 1, "from_unit": "kg", "to_unit": "{unit}"}}}}</tool_call>'
    rows = [(1, call("lb") + call("g")), (2, "none"), (3, None), (4, "<tool_call>{"), (4, "<tool_call>{"), (5, '<tool_call>{"name": "x", "arguments": {}}</tool_call>')]
    spark.createDataFrame(rows, "k long, said string").repartition(3).createOrReplaceTempView("turns_of_test")
    found = spark.sql("SELECT k, place, name, arguments['to_unit'] AS unit, status, error IS NOT NULL AS bad FROM tool_calls(TABLE(turns_of_test), 'said')")
    assert sorted(map(tuple, found.collect()), key=repr) == [
        (1, 1, "unit_convert", "lb", "valid", False), (1, 2, "unit_convert", "g", "valid", False), (2, None, None, None, "no_call", False), (3, None, None, None, "no_call", False),
        (4, None, None, None, "unterminated", True), (4, None, None, None, "unterminated", True), (5, 1, "x", None, "schema_error", True),
    ]
    empty = spark.sql("SELECT * FROM tool_calls(TABLE(SELECT * FROM turns_of_test WHERE k > 9), 'said', 'xml')")
    assert empty.columns == ["k", "said", "place", "name", "arguments", "status", "error"] and empty.count() == 0
    for bad in ("'k'", "'other'", "'said', 'yaml'"):
        with pytest.raises(Exception, match="tool_calls"):
            spark.sql(f"SELECT * FROM tool_calls(TABLE(turns_of_test), {bad})")
    with pytest.raises(Exception, match="columns of its own named name"):
        spark.sql("SELECT * FROM tool_calls(TABLE(SELECT k AS name, said FROM turns_of_test), 'said')")
    assert spark.sql("SELECT k FROM tool_calls(TABLE(turns_of_test), 'said')").groupBy().agg(F.count("k")).first()[0] == 7
