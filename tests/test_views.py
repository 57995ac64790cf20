"""Views of records and their audit."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import views as V

RECORD = "id string, ord long, answer string, answer_type string, tool_calls array<string>"


@pytest.fixture(scope="module")
def tables(spark):
    records = spark.createDataFrame([(f"train_{k}", k, f"a{k}", "tool_call" if k % 2 else "extractive", ["c"] if k % 2 else None) for k in range(6)], RECORD)
    flagged = spark.createDataFrame([("train_1",), ("train_1",), ("train_3",)], "id string")
    review = spark.createDataFrame([("train_1", "relabel", "unknown", "uncertain"), ("train_3", "drop", None, None), ("train_5", "relabel", "x", "x")], "id string, decision string, answer string, answer_type string")
    additions = spark.createDataFrame([("extra_0", 0, "e", "extractive", None)], RECORD)
    return records, flagged, review, additions


def built(tables, variant):
    return {r["id"]: r for r in V.build(*tables, variant).collect()}


def test_variants(tables):
    assert set(built(tables, "filtered")) == {f"train_{k}" for k in (0, 2, 4, 5)}
    again = built(tables, "relabelled_with_additions")
    assert set(again) == {"extra_0", *(f"train_{k}" for k in (0, 1, 2, 4, 5))} and again["extra_0"]["ord"] == 6
    assert (again["train_1"]["answer"], again["train_1"]["answer_type"], again["train_1"]["tool_calls"]) == ("unknown", "uncertain", None)
    assert again["train_5"]["answer"] == "a5" and again["train_5"]["tool_calls"] == ["c"]
    with pytest.raises(ValueError):
        V.build(*tables, "x")


def test_flagged_without_decision_fails(spark, tables):
    with pytest.raises(Exception, match="no decision for train_0"):
        V.build(tables[0], spark.createDataFrame([("train_0",)], "id string"), tables[2], tables[3], "relabelled").collect()


def test_audit_and_manifest(tables):
    records = tables[0]
    changed = records.where("id <> 'train_0'").withColumn("answer", F.when(F.col("id") == "train_2", "z").otherwise(F.col("answer"))).withColumn("ord", F.when(F.col("id") == "train_4", 40).otherwise(F.col("ord")))
    assert sorted(map(tuple, V.audit(changed, records).collect())) == [("train_0", "missing"), ("train_2", "changed"), ("train_4", "moved")]
    assert V.audit(records, records.repartition(3)).count() == 0
    assert V.manifest(records).first() == V.manifest(records.repartition(5)).first() != V.manifest(changed).first()


def test_small_parts(spark, tables):
    assert {r["id"] for r in V.first_of_types(tables[0], 1).collect()} == {"train_0", "train_1"}
    items = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "id string, sha256 string")
    approvals = spark.createDataFrame([("a", "1", "approved"), ("b", "9", "approved"), ("c", "3", "draft")], "id string, sha256 string, status string")
    assert sorted(map(tuple, V.approval_state(items, approvals).collect())) == [("a", "approved"), ("b", "CHANGED"), ("c", "draft"), ("d", "missing")]
    log = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 1.00000001), (4, 2.0)], "step int, epoch double")
    assert sorted(r["step"] for r in V.epoch_ends(log).collect()) == [3, 4]


def test_checkpoints_at_whole_epochs(spark):
    log = spark.createDataFrame([(5, 0.5), (10, 1.0), (20, 2.0)], "step long, epoch double")
    found = spark.createDataFrame([(10, "a"), (20, "b")], "step long, sha256 string")
    assert sorted((r["step"], r["epoch"]) for r in V.epoch_checkpoints(log, found, found).collect()) == [(10, 1), (20, 2)]
    with pytest.raises(ValueError, match="not as listed"):
        V.epoch_checkpoints(log, found, found.withColumn("sha256", F.lit("a")))
    with pytest.raises(ValueError, match="1 checkpoints"):
        V.epoch_checkpoints(log.where("step < 20"), found, found)


def test_tools_of_a_run():
    from fathomline.operators import chat

    call = '<tool_call>{"name": "calculate_bmi", "arguments": {"weight_kg": 80, "height_cm": 170}}</tool_call>'
    assert chat.parsed(call)["status"] == "valid" and chat.parsed(call, tools=("unit_convert",))["status"] == "schema_error"


def test_few_shot_examples(spark):
    from fathomline.operators import chat

    rows = spark.createDataFrame([("a", f"t{k}", "n" * n, "q", "x") for k, n in enumerate((1, 5, 9))], "answer_type string, id string, note string, question string, answer string")
    (row,) = chat.few_shot(rows).collect()
    assert row["id"] == "t1" and [m["role"] for m in row["messages"]] == ["user", "assistant"]
