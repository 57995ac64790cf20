"""Record checks, sources and streams."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import quality as Q
from fathomline.operators import relational as R
from fathomline.sources import config, jsonl, manifest
from fathomline.streaming import events

LABS = ("labs", ["Test", "Value", "Unit", "Reference Range"], [["Glucose (fasting)", "150.4", "mg/dL", "70-100"], ["Creatinine", "0.7", "mg/dL", "0.6-1.2"]])
NOTE = "CC: fatigue. HPI: 58-year-old woman. Weight 106.4 kg, height 189.2 cm. BMI 29.7."


def record(id="train_0", split="train", ord=0, note=NOTE, table=LABS, question="What is the glucose?", answer="Glucose is 150.4 mg/dL.", answer_type="extractive", calls=None):
    return (id, split, ord, note, table, question, answer, answer_type, calls)


def frame(spark, *rows):
    return spark.createDataFrame(rows, Q.RECORD)


def found(df):
    return sorted(((r["id"], r["detail"]) for r in df.collect()), key=repr)


def test_clean_record_has_no_flags(spark):
    iron = ("labs", LABS[1], [["Serum Iron", "60", "mcg/dL", "60-170"], ["TIBC", "300", "mcg/dL", "250-450"], ["Ferritin", "50", "ng/mL", ">30"], ["Transferrin Saturation", "20", "%", "20-50"]])
    assert found(Q.run_checks(frame(spark, record(table=iron, answer="Ferritin is 50.")))) == []
    Q.validate(frame(spark, record()))


def test_structure(spark):
    bad = frame(spark, record(answer=" ", answer_type="x"), record(id="val_1", table=("labs", ["Test"], [])), record(id="train_2", answer_type="tool_call"))
    details = [d for _, d in found(Q.q1_schema(bad))]
    assert {"no answer", "unknown answer_type", "id of another split", "headers of another kind of table", "empty table", "calls and answer_type disagree"} <= set(details)
    with pytest.raises(ValueError):
        Q.validate(bad)


def test_ids(spark):
    got = found(Q.q2_ids(frame(spark, record(), record(), record(id="train_2"), record(id="X"))))
    assert ("train_0", "id occurs again") in got and ("*", "numbers are not 0, 1, 2, ...") in got and ("X", "id is not split_number") in got


def test_duplicates_and_contamination(spark):
    long = "word " + " ".join(f"w{k}" for k in range(60))
    rows = frame(spark, record(), record(id="train_1", ord=1), record(id="train_2", ord=2, note=long), record(id="val_0", split="val", note=long + " end"), record(id="val_1", split="val"))
    assert ("train_1", "same note and question as train_0") in found(Q.q3_duplicates(rows))
    assert any(i == "val_0" and d.startswith("note much like that of train_2") for i, d in found(Q.q3_duplicates(rows)))
    assert found(Q.q18_contamination(rows)) == [("val_1", "note and question of train_1")]


def copied_notes(spark):
    """More training notes that share each gram than were once looked at, and of those that share most more than ten: the last is the most similar."""
    words = [f"w{k}" for k in range(60)]
    near = [record(id=f"train_{n}", ord=n, note=" ".join([*words, *[f"x{n}y{k}" for k in range(20)]])) for n in range(119)]
    return frame(spark, *near, record(id="train_119", ord=119, note=" ".join(words)), record(id="val_0", split="val", note=" ".join([*words, "end"])), record(id="val_1", split="val", note="alone"))


def test_notes_like_many_others_are_found(spark):
    assert found(Q.q3_duplicates(copied_notes(spark))) == [("val_0", "note much like that of train_119 (0.982)")]


def test_similarities_to_many_notes_are_whole(spark):
    got = {r["key"]: r["value"] for r in Q.q3_metrics(copied_notes(spark)).where("metric = 'similarity to train'").collect()}
    assert got == {"val p50": 0.0, "val p90": 0.982, "val p99": 0.982, "val p100": 0.982}


def test_calls(spark):
    good = [("unit_convert", {"value": "150.4", "from_unit": "mg/dL", "to_unit": "mmol/L", "substance": "glucose"}, 8.35)]
    wrong = [("unit_convert", {"value": "99", "from_unit": "mg/dL", "to_unit": "mmol/L", "substance": "glucose"}, 8.35)]
    rows = frame(spark, record(answer="8.35 mmol/L", answer_type="tool_call", calls=good), record(id="train_1", answer="no", answer_type="tool_call", calls=wrong))
    assert [i for i, _ in found(Q.q4_results(rows))] == ["train_1"] and [i for i, _ in found(Q.q5_grounding(rows))] == ["train_1"] and [i for i, _ in found(Q.q9_answers(rows))] == ["train_1"]


def test_text_checks(spark):
    rows = frame(spark, record(answer="It is 777 µg. One. Two. Three. Four.", note=NOTE.replace("29.7", "39.7").replace("58", "12"), table=("labs", LABS[1], [["X", "high", "", "?"]])))
    for check, n in ((Q.q7_bmi, 1), (Q.q11_numbers, 1), (Q.q14_cells, 3), (Q.q16_plausible, 1), (Q.q17_length, 1)):
        assert check(rows).count() == n, check


def test_details_of_checks(spark):
    bmi = lambda w, h, r=29.7: [("calculate_bmi", {"weight_kg": w, "height_cm": h}, r)]
    micro = [("unit_convert", {"value": "0.7", "from_unit": "mg/dL", "to_unit": "μmol/L", "substance": "creatinine"}, 61.89)]
    rows = frame(
        spark, record(id="train_0", answer="BMI is 29.7.", answer_type="tool_call", calls=bmi("106.4", "189.2")), record(id="train_1", answer="29.7", answer_type="tool_call", calls=bmi("106.4", "190")),
        record(id="train_2", note="wt 234.6 lb, ht 74.5 in", answer="29.7", answer_type="tool_call", calls=bmi("106.4", "189.3")),
        record(id="train_3", question="What is the BMI?", answer="Height is not documented.", answer_type="uncertain"),
        record(id="train_4", answer="150.4 - 100 = 51.4. It is above by 50.4, and by 7.", answer_type="numeric_reasoning"),
        record(id="train_5", answer="Glucose is 150.4; 1.2 is the bound and 3.5 another."), record(id="train_6", note="Creatinine 0.9 and glucose 150. A man with pregnancy."),
        record(id="train_7", question="To µmol/L?", answer="61.89", answer_type="tool_call", calls=micro), record(id="train_8", question="What is the glucose?", answer="150.4", answer_type="numeric_reasoning"),
        record(id="train_9", table=("labs", LABS[1], [["A", "1", "", "3.5-5"]])),
    )
    of = lambda check: found(check(rows))
    assert of(Q.q5_grounding) == [("train_1", "not in the input: height")] and [i for i, _ in of(Q.q6_rounding)] == ["train_2"]
    assert of(Q.q8_labels) == [("train_3", "said to be missing, but given: height")] and ("train_3", "uncertain, but the note states a BMI") in of(Q.q7_bmi)
    assert of(Q.q10_arithmetic) == [("train_4", "doesn't hold: 150.4 - 100 = 51.4"), ("train_4", "no such difference: 7")]
    assert ("train_5", "bound of a range elsewhere: 3.5") in of(Q.q11_numbers) and ("train_9", "not supported: 150.4") in of(Q.q11_numbers)
    assert of(Q.q12_conflicts) == [("train_6", "Creatinine: note 0.9, table 0.7")] and of(Q.q13_characters) == [("train_7", "U+00B5 in the text, U+03BC in arguments")]
    assert {i for i, _ in of(Q.q15_templates)} >= {"train_5", "train_8"} and ("train_6", "female condition, male patient") in of(Q.q16_plausible)
    assert {r["metric"] for f in Q.METRICS.values() for r in f(rows).collect()} >= {"sources", "BMI questions", "characters", "sentences", "stated BMI and computed"}
    assert {r["check"]: r["status"] for r in Q.summary(Q.run_checks(rows)).collect()}["Q12"] == "warn"


def test_arithmetic():
    from fathomline.functions import arithmetic as A

    assert [(e["kind"], e["ok"]) for e in A.equations("(120 - 100) / 100 × 100 = 20%; 10 / 4 = 2.5; 198.9 / 40 = 4.97x; 7 − 2 = 4; 5 / 0 = 1; 30/60 x 100 = 50 %")] == [("pct_change", True), ("pct", True), ("diff", False), ("ratio", True), ("ratio", True), ("ratio", False)]
    assert [a["ok"] for a in A.amounts("above by 3.2, divided by 4; by about 9", "from 10 to 6.8", ["1"])] == [True, True]
    assert A.evaluate("2 + 3 × 4 ÷ 6") == 4.0 and A.evaluate("1 / 0") is None and A.evaluate("__import__('os')") is None and A.evaluate("2 ** 9") is None
    assert A.false_chains("2 + 3 = 5; 1 / 4 = 25%; 3 * 3 = 10; 9 / 4 = 2.3") == ["3 * 3 = 10"]


def test_reference(spark):
    rows = spark.createDataFrame([("drug_interaction:a:b", "drug_interaction", "y"), ("drug_interaction:b:a", "drug_interaction", "y"), ("Odd", "x", "y"), ("drug_interaction:c", "drug_interaction", "y"), ("guideline:x", "x", "y")], "key string, category string, value string")
    got = found(Q.q19_reference(rows))
    assert ("Odd", "odd key") in got and ("drug_interaction:a:b", "pair under several keys") in got and ("drug_interaction:c", "not two drugs") in got and ("guideline:x", "category of another prefix") in got
    notes = frame(spark, record(note="Medications: B 5 mg, a, zeta"), record(id="val_0", split="val", note="Medications: a"))
    got = {(r["metric"], r["key"]): r["value"] for r in Q.q19_coverage(notes, rows).collect()}
    assert got == {("notes with a pair", "train"): 1.0, ("pairs", "a:b"): 1.0, ("drugs without a key", "zeta"): 1.0}


def test_strict_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null}\n')
    assert sorted(tuple(r) for r in jsonl.read_strict(spark, str(p), "a long, b string").collect()) == [(1, "x", 1), (2, None, 3)]
    for bad in ('{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 1}}', '{"a": NaN}', '{"a": -Infinity}', '{"a": 1e999}', "[1]", "{x}"):
        p.write_text('{"a": 1}\n' + bad + "\n")
        assert [r["line"] for r in jsonl.problems(spark, str(p)).collect()] == [2]
        with pytest.raises(Exception, match=":2: "):
            jsonl.read_strict(spark, str(p), "a long").collect()


def test_jsonl_sink_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    jsonl.write(df, str(tmp_path / "o"))
    assert [tuple(r) for r in jsonl.read_lenient(spark, str(tmp_path / "o"), "a long, b string").collect()] == [(1, None)]
    with pytest.raises(Exception):
        jsonl.write(df, str(tmp_path / "o"))


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    listed = spark.createDataFrame([tuple(r) for r in manifest.digests(spark, str(tmp_path)).collect()], "file string, bytes long, sha256 string")
    manifest.verify(manifest.digests(spark, str(tmp_path)), listed)
    (tmp_path / "b.txt").write_text("z")
    (tmp_path / "a.txt").unlink()
    assert sorted(tuple(r) for r in manifest.differences(manifest.digests(spark, str(tmp_path)), listed).collect()) == [("a.txt", "missing"), ("b.txt", "changed")]
    with pytest.raises(ValueError):
        manifest.verify(manifest.digests(spark, str(tmp_path)), listed)


def test_prepare_writes_nothing_if_an_input_is_bad(spark):
    done = []
    with pytest.raises(ValueError):
        manifest.prepare({"a": spark.range(1), "b": spark.range(0)}, lambda n, df: df.where(F.lit(n == "b")).union(spark.range(1 if n == "b" else 0)), lambda n, df: done.append(n))
    assert done == []


def test_config(tmp_path):
    import json

    (tmp_path / "base").write_text(json.dumps({"a": {"x": 1, "y": 2}, "b": [1]}))
    (tmp_path / "child").write_text(json.dumps({"extends": "base", "a": {"y": 3}, "b": [2]}))
    assert config.load(tmp_path / "child", json.loads) == {"a": {"x": 1, "y": 3}, "b": [2]}


def test_union_checked(spark):
    a, b = spark.range(3).withColumn("v", F.lit(1)), spark.range(5, 7).withColumn("v", F.lit(2))
    assert R.union_checked(a, b, "id").count() == 5
    with pytest.raises(Exception, match="collide"):
        R.union_checked(a, a, "id").collect()
    with pytest.raises(ValueError):
        R.require_full_coverage(a, b, "id")


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k % 24:02d}:00:00", k % 3, "view", 1.0, "{}") for k in range(48)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.unionByName(df).write.parquet(str(tmp_path / "in"))
    for name, make in (("w", events.windowed), ("s", events.sessions), ("d", events.first_seen)):
        events.run_available(make(events.source(spark, str(tmp_path / "in"))), str(tmp_path / f"c{name}"), str(tmp_path / name))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 48
    assert spark.read.parquet(str(tmp_path / "w")).agg(F.sum("n")).first()[0] > 80
