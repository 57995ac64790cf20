"""Readings of made-up answers, and typed keys."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import discourse as D
from fathomline.operators import keys as K
from fathomline.operators import quality as Q
from fathomline.operators import scoring as V

NAMES = ("Ferritin", "TIBC", "Serum Iron", "Sodium", "Potassium", "ALT", "AST", "Heart Rate", "Glucose (fasting)", "Free T4")
ROWS = [["Sodium", "151", "mmol/L", "136-145"], ["Potassium", "5.2", "mmol/L", "3.5-5.0"], ["ALT", "30", "U/L", "7-56"], ["HDL", "40", "mg/dL", ">40"]]
NOTE = "Weight 80 kg, height 200 cm. Ferritin 9. BP 120/80."


@pytest.mark.parametrize("text,expected", [
    ("Fasting glucose and K, not k.", ["Glucose (fasting)", "Potassium"]), ("Iron studies: serum iron 40, TIBC 300", ["Serum Iron", "TIBC"]), ("potassium chloride; sodium-free", []),
    ("FREE T4 and T4", ["Free T4", "Free T4"]), ("", []),
])
def test_mentions(text, expected):
    assert [m.name for m in D.mentions(text, NAMES)] == expected


@pytest.mark.parametrize("text,states", [
    ("Sodium is high.", {"Sodium": D.HIGH}), ("Sodium is not high.", {"Sodium": D.LOW | D.NORMAL}), ("Sodium of 151 is above the upper limit of 145.", {"Sodium": D.HIGH}),
    ("ALT and AST are within normal limits.", {"ALT": D.NORMAL, "AST": D.NORMAL}), ("There is reduced ferritin.", {"Ferritin": D.LOW}), ("She has hyperkalemia.", {"Potassium": D.HIGH}),
    ("Sodium is 151. It is outside the range.", {"Sodium": D.LOW | D.HIGH}), ("Sodium isn't abnormal.", {"Sodium": D.NORMAL}), ("If the sodium would be high, stop.", {}),
    ("Potassium is high, while ALT is normal.", {"Potassium": D.HIGH, "ALT": D.NORMAL}),
])
def test_states(text, states):
    assert D.read(text, NAMES).states == states


def test_reading():
    r = D.read("**Sodium** is 151 mmol/L, 6 above 145.\nPotassium stands out most at 5.2. All other values are normal. Sodium is low.", NAMES)
    assert r.numbers == {"Sodium": [151.0, 6.0, 145.0], "Potassium": [5.2]} and r.most == ["Potassium"] and r.order == ["Sodium", "Potassium"] and r.blanket and r.conflicts == ["Sodium"]
    assert D.yes_no("Yes, it is") is True and D.yes_no("no.") is False and D.yes_no("None") is None


def test_facts():
    table, facts = K.input_facts(NOTE + " ALT 99. TSH 1 and TSH 2.", ROWS, "With heart rate of 111 bpm?")
    assert set(table) == {"Sodium", "Potassium", "ALT", "HDL"} and facts["ALT"].value == 30 and facts["Ferritin"].state == D.LOW and facts["Heart Rate"].state == D.HIGH and "TSH" not in facts
    assert facts["HDL"].state == D.LOW and facts["Blood Pressure"].value == 120 and round(facts["Sodium"].deviation, 3) == 1.041


@pytest.mark.parametrize("question,kinds", [
    ("What is the BMI, and does it exceed 25?", ["bmi", "yesno"]), ("By how much does the sodium exceed the upper limit?", ["diff"]), ("How many times the upper limit is the potassium?", ["ratio"]),
    ("By what percent is potassium above the limit?", ["pct"]), ("Which value is the most abnormal, and which other values are abnormal?", ["entity", "set"]), ("Is the ALT within the normal range?", ["status"]),
    ("What is the sodium?", ["value"]), ("What was the sodium, and is it normal?", ["value", "status"]), ("Is the sodium above 150?", ["yesno"]), ("Where does she live?", ["text"]),
])
def test_keys(question, kinds):
    assert [c.kind for c in K.build_key(NOTE, ROWS, question, "At home.").checks] == kinds


def test_values_that_a_question_can_mean():
    vitals = [["Heart Rate", "111", "bpm"], ["SpO2", "97", "%"]]
    of = lambda rows, question: K.build_key("ALT 99. AST 20.", rows, question, "").checks[0].want
    assert of(vitals, "Which labs are abnormal?") == ["ALT"] and of(vitals, "Which values are abnormal?") == ["Heart Rate"] and of(vitals, "Which lab test is the most elevated?") == "ALT"
    assert K.build_key("", ROWS, "Which vital signs are abnormal?", "x").coverage == "text"


CASES = [
    ("What is the sodium?", "151 mmol/L.", None), ("What is the sodium?", "It is 115.", "value:missing"), ("Is the ALT within the normal range?", "Yes.", None), ("Is the ALT within the normal range?", "ALT is low.", "status:wrong"),
    ("Is the ALT within the normal range?", "It can be.", "status:not_stated"), ("By how much does the sodium exceed the upper limit?", "Sodium exceeds it by 6 mmol/L.", None),
    ("By how much does the sodium exceed the upper limit?", "By 5.", "diff:out_of_band"), ("By how much does the sodium exceed the upper limit?", "ALT is 6.", "diff:out_of_band"), ("By what percent is potassium above the limit?", "104 % of the limit", None),
    ("Which value is the most abnormal?", "Sodium is the most abnormal.", None), ("Which value is the most abnormal?", "ALT is the most abnormal.", "entity:wrong(ALT)"),
    ("Which values are abnormal?", "Sodium and potassium are high, and HDL is low.", None), ("Which values are abnormal?", "Sodium is high.", "set:missing(HDL,Potassium)"),
    ("Which values are abnormal?", "Sodium, potassium and ALT are abnormal.", "set:false_member(ALT)"), ("Is the sodium above 150?", "Yes, it is.", None), ("Is the sodium above 150?", "No.", "yesno:wrong"),
    ("What is the BMI?", "20.1", None), ("What is the BMI?", "It's not documented.", "over_refusal"), ("What does the note say of blood pressure?", "BP was 120/80.", None), ("Why?", "", "no_answer_answer"),
]


@pytest.mark.parametrize("question,said,error", CASES)
def test_verdicts(question, said, error):
    assert K.verdict("extractive", NOTE, ROWS, question, "BP was 120/80.", said, None, [], "answer", None)["error"] == error


def test_calls_and_abstentions():
    call = lambda w, h, r=20.0, name="calculate_bmi", status="valid": {"name": name, "tool": name, "arguments": {"weight_kg": w, "height_cm": h}, "result": r, "status": status}
    run = lambda calls, said, gold=None, stop="answer", bad=None: K.verdict("tool_call", NOTE, ROWS, "BMI?", "20.0", said, gold or call("80", "200"), calls, stop, bad)
    assert run([call("80.3", "200.5", 20.1)], "It is 20.1.") == {"coverage": "structured", "checks": [], "expected": "call", "error": None, "name_ok": True, "outcome_ok": True}
    errors = [run([], "20")["error"], run([], "", bad="unterminated")["error"], run([call("90", "200", 20.0)], "20.0")["error"], run([call("80", "200", 22.0)], "22.0")["error"], run([call("80", "200")], "ok")["error"], run([call("80", "200")] * 2, "20.0")["error"]]
    assert errors == ["no_call", "parse_error", "ungrounded_args", "outcome_out_of_band", "result_not_reported", "extra_call_or_budget"]
    absent = call("99", "150")
    assert run([], "Weight is not documented.", absent)["error"] is None and run([absent], "44", absent)["error"] == "called_without_inputs" and run([], "44", absent)["error"] == "no_abstention"
    unsure = lambda said: K.verdict("uncertain", NOTE, ROWS, "Dose?", "The dose is not documented.", said, None, [], "answer", None)["error"]
    assert unsure("The dose is not documented.") is None and unsure("The dose is not documented; it is safe to give.") == "definite_conclusion_despite_missing"


def test_columns_and_versions(spark):
    rows = [(f"train_{k}", "train", k, NOTE, ("labs", [], ROWS), q, said, "numeric_reasoning" if k else "extractive", None) for k, (q, said, _) in enumerate(CASES[:6])]
    df = V.gold_rollout(spark.createDataFrame(rows, Q.RECORD)).withColumn("gold", F.lit("BP was 120/80."))
    got = {r["id"]: r for r in K.SCORERS["2.2"](df).collect()}
    assert [got[f"train_{k}"]["typed"]["error"] for k in range(6)] == [c[2] for c in CASES[:6]]
    more = df.limit(1).withColumns({"answer_type": F.lit("numeric_reasoning"), "final": F.explode(F.array(F.lit("Sodium is 151 and normal."), F.lit("Sodium 151; 2 + 2 = 5."), F.lit("Sodium is 151, high.")))})
    assert sorted((r["final"], r["typed_correct"], r["guarded_correct"]) for r in K.SCORERS["2.2"](more).collect()) == [("Sodium 151; 2 + 2 = 5.", True, False), ("Sodium is 151 and normal.", True, False), ("Sodium is 151, high.", True, True)]
    r = df.select(D.read_of(F.lit("Sodium is high at 151."), F.array(F.lit("Sodium"))).alias("r")).first()["r"]
    assert r["states"] == {"Sodium": 4} and r["numbers"] == {"Sodium": [151.0]}
