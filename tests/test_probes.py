"""Records made from records, and label masks."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathomline.functions import editing as E
from fathomline.operators import masks as M
from fathomline.operators import probes as P
from fathomline.operators import quality as Q

HEADERS = ["Test", "Value", "Unit", "Reference Range"]
RENAL = [["Creatinine", "1.0", "mg/dL", "0.7-1.3"], ["BUN", "12", "mg/dL", "7-20"]]


@pytest.mark.parametrize("note,expected", [
    ("HPI: 58-year-old female with pain.", "HPI: Female patient with pain."), ("Seen: a 40 year old man.", "Seen: a man."), ("An 80-year-old male, aged 80.", "A male patient."), ("Pt 62 yo, tired", "Pt, tired"), (None, ""),
])
def test_without_age(note, expected):
    assert E.without_age(note) == expected and E.cues(E.without_age(note), "age") == []


@pytest.mark.parametrize("note,expected", [
    ("She says her knee hurts; it troubles her.", "The patient says the patient's knee hurts; it troubles the patient."), ("Mr. Ode, an old man, hurt himself.", "Patient Ode, an old patient, hurt themselves."), ("A woman. His car.", "A patient. The patient's car."),
])
def test_without_sex(note, expected):
    assert E.without_sex(note) == expected and E.cues(E.without_sex(note), "sex") == []


def test_body_probe():
    note = "CC: tired.\nWeight: 80 kg, Height: 170 cm\nHe is well, weighs 80 kg, and sleeps.\nLost 45 lbs since May.\nBMI 27.7."
    probe = E.body_probe(note, [["Weight", "80", "kg"], ["BUN", "12", "mg/dL"]], "What is the BMI?")
    assert probe == {"note": "CC: tired.\nHe is well, and sleeps.\nLost 45 lbs since May.", "rows": [["BUN", "12", "mg/dL"]], "partly": 1, "excluded": None}
    assert E.body_probe("x", [["Height", "1", "m"]], "BMI?")["excluded"] == "no row is left" and E.body_probe("x", RENAL, "At 80 kg?")["excluded"] == "the question measures"
    assert "feet-inches" in E.body_probe("He is 5'11\" tall", RENAL, "BMI?")["excluded"]
    assert E.changes("a\nb", "a\nc").endswith("-b\n+c") and E.changes(None, "") == ""


@pytest.fixture(scope="module")
def records(spark):
    of = lambda k, note, rows=RENAL: (f"train_{k}", "train", k, note, ("labs", HEADERS, rows), "?", "", "extractive", None)
    rows = [of(0, "A 50-year-old man."), of(1, "A 50-year-old woman; she is well."), of(2, "A man."), of(3, "A 17-year-old man."), of(4, "A 50-year-old man.", [*RENAL, ["eGFR", "90", "", ">60"]]), of(5, "A 50-year-old man in his fifties."), of(6, "A 50-year-old man.", [["Creatinine", "88", "umol/L", ""]])]
    return spark.createDataFrame(rows, Q.RECORD)


def test_eligible_and_generated(spark, records):
    assert sorted((r["id"], r["age"], r["sex"]) for r in P.eligible(records).collect()) == [("train_0", 50, "male"), ("train_1", 50, "female"), ("train_5", 50, "male")]
    made = P.positives(records).collect()
    assert {r["source_id"]: r["tool_calls"][0]["result"] for r in made} == {"train_0": 92.0, "train_1": 69.0, "train_5": 92.0} and sorted(r["id"] for r in made) == ["pos_0000", "pos_0001", "pos_0002"]
    assert [r["issues"] for r in P.reviewed(P.positives(records)).collect()] == [[]] * 3
    wrong = P.positives(records).withColumn("note", F.lit("A 51-year-old man.")).where("source_id <> 'train_5'")
    assert sorted(tuple(r["issues"]) for r in P.reviewed(wrong).collect()) == [("age", "result"), ("age", "sex", "result")]
    no_age, no_sex = P.negatives(records, "age").collect(), P.negatives(records, "sex").collect()
    assert {r["source_id"]: r["note"] for r in no_age} == {"train_0": "A man.", "train_1": "A woman; she is well."}
    assert {r["source_id"]: r["note"] for r in no_sex} == {"train_0": "A 50-year-old patient.", "train_1": "A 50-year-old patient; the patient is well.", "train_5": "A 50-year-old patient in the patient's fifties."}


def test_judged_positives(spark):
    gold = ("calculate_egfr", {"creatinine_mg_dl": "1.0", "age": "50", "sex": "male"}, 92.0)
    call = lambda result=92.0, sex="Male": ("calculate_egfr", {"creatinine_mg_dl": "1.0", "age": "50", "sex": sex}, result, "valid")
    rows = [("The eGFR is 92, stage G1.", [call()], gold), ("It is 92 (G2).", [call()], gold), ("It is 92.", [call()], gold), ("It is 92, G1.", [call(sex="female")], gold), ("90, stage 1", [call(90.0)], gold), ("None", [], gold)]
    df = spark.createDataFrame([(k, *r, "answer") for k, r in enumerate(rows)], "k int, final string, calls array<struct<name:string,arguments:map<string,string>,result:double,status:string>>, gold_call struct<tool:string,arguments:map<string,string>,result:double>, stop_reason string")
    got = {r["k"]: r for r in P.judged_positives(df).collect()}
    assert [got[k]["e2e"] for k in range(6)] == [True, False, False, False, False, False] and not got[4]["outcome"] and not got[3]["grounded"] and got[1]["reported"] and not got[1]["context"]
    assert P.stages("KDIGO category G3a, stage 4") == ["G3a", "G4"]
    assert spark.range(1).select(P.accepted_stages(F.lit(59.6)).alias("a")).first()["a"] == ["G3a", "G2"]


def test_judged_probes(spark):
    body = ("unit_convert", {"value": "80", "from_unit": "lbs", "to_unit": "kg"}, 36.3, "valid")
    rows = [("Weight and height are not documented.", [], None), ("At 80 kg and 170 cm the BMI is 27.7.", [], None), ("If the weight were 80 kg it would be high; height is not documented.", [], None), ("x", [("calculate_bmi", {}, 1.0, "valid")], None), ("x", [body], None), ("x", [], "invalid_json"), ("It is not documented.", [], None)]
    df = spark.createDataFrame([(k, "n", RENAL, "BMI?", *r) for k, r in enumerate(rows)], "k int, note string, rows array<array<string>>, question string, final string, calls array<struct<name:string,arguments:map<string,string>,result:double,status:string>>, bad_status string")
    got = {r["k"]: r for r in P.judged_probes(df).collect()}
    assert [(got[k]["fabrication"], got[k]["intended"]) for k in range(7)] == [(False, True), (True, False), (False, True), (True, False), (True, False), (True, False), (False, False)]
    assert got[1]["claims"]["asserted"] == ["170 cm", "80 kg", "BMI 27.7"] and got[2]["claims"]["review"] == ["80 kg"]


def test_clinical_context():
    of = lambda tool, arguments, result, said: P.in_context("", [["Creatinine", "2.0", "mg/dL", "0.7-1.3"]], "", tool, arguments, result, said)
    assert of("calculate_bmi", {}, 27.7, "The BMI is 27.7. This is overweight.")["ok"] and not of("calculate_bmi", {}, 27.7, "The BMI is 27.7, obese.")["ok"] and of("calculate_bmi", {}, 27.7, "27.7.")["why"] == "no category"
    assert of("calculate_bmi", {}, 24.9, "BMI 24.9 is in the overweight category.")["ok"] and of("calculate_bmi", {}, None, "x") == {"ok": None, "why": "no result"} and not of("calculate_bmi", {}, 31.0, "BMI 31.0, not obese.")["ok"]
    assert of("unit_convert", {"substance": "creatinine"}, 176.84, "It is 176.84 umol/L, which is elevated.")["ok"] and not of("unit_convert", {"substance": "creatinine"}, 176.84, "176.84 is normal.")["ok"]


def test_proposals_gate_packet_and_merge(spark):
    call = [("calculate_bmi", {"weight_kg": "1", "height_cm": "2"}, 1.0)]
    of = lambda k, note: (f"train_{k}", "train", k, note, ("labs", HEADERS, RENAL), "?", "", "tool_call", call)
    rows = spark.createDataFrame([of(0, "wt 80 kg"), of(1, "BMI 27.7"), of(2, "80 kg, 170 cm"), of(3, "80 kg now, 90 kg then"), of(4, "")], Q.RECORD)
    got = {r["id"]: r for r in P.proposals(rows, rows).collect()}
    assert [got[f"train_{k}"]["category"] for k in range(5)] == ["missing_input", "documented_bmi", "not_missing", "several_measurements", "missing_input"]
    assert got["train_0"]["answer"] == "The input gives weight 80.0 kg. Height is not documented, so the BMI cannot be calculated." and got["train_4"]["answer"].startswith("Weight And Height are")
    screens = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "name string, passes boolean")
    assert tuple(P.gate(screens).first()) == (1, ["b", "c"], "review")
    answers = spark.createDataFrame([(label, i, f"{label}{i}") for label in ("x", "y") for i in range(5)], "label string, id int, answer string")
    blind, key = P.packet(answers, "1")
    assert "label" not in blind.columns and {(r["answer"], r["label"], r["id"]) for r in blind.join(key, "item").collect()} == {(f"{a}{i}", a, i) for a in "xy" for i in range(5)}
    with pytest.raises(ValueError):
        P.packet(answers.withColumn("label", F.lit("core_test")), "1")
    rater = lambda *labels: spark.createDataFrame([(f"n_{k}", v) for k, v in enumerate(labels)], "item string, label string")
    got = P.merged(rater("a", "b", "c"), rater("a", "c", "d"), spark.createDataFrame([("n_1", "b")], "item string, label string")).orderBy("item").collect()
    assert [tuple(r) for r in got] == [("n_0", "a", "agreed"), ("n_1", "b", "adjudicated"), ("n_2", None, "pending")]


PATH = public_tokenizers.path("byte_bpe_50k.json")
TALK = [{"role": "user", "content": "Hi <|end|>?"}, {"role": "assistant", "content": "<think>hm</think>Yes é."}, {"role": "user", "content": "So?"}, {"role": "assistant", "content": "<think>oh</think>No."}]


def test_masks():
    tokenizer = M.load(PATH)
    (whole,) = M.sequences(tokenizer, M.plain_template, TALK)
    assert [whole.text[a:b] for a, b in whole.spans] == ["<think>hm</think>Yes é.<|end|>", "<think>oh</think>No.<|end|>"] and M.audit(tokenizer, M.plain_template, TALK, [whole]) == []
    first, whole = M.sequences(tokenizer, M.last_thought_template, TALK)
    assert first.text.endswith("<think>hm</think>Yes é.<|end|>\n") and "hm" not in whole.text and M.audit(tokenizer, M.last_thought_template, TALK, [first, whole]) == []
    assert M.audit(tokenizer, M.last_thought_template, TALK, [whole]) == ["labels do not spell each assistant turn once"]
    with pytest.raises(M.MaskError, match="later turns"):
        M.sequences(tokenizer, M.last_thought_template, TALK, split=False)
    with pytest.raises(M.MaskError, match="at most 5"):
        M.sequences(tokenizer, M.plain_template, TALK, longest=5)
    with pytest.raises(M.MaskError, match="empty"):
        M.sequences(tokenizer, M.plain_template, [{"role": "assistant", "content": ""}])


def test_masks_of_a_table(spark):
    df = spark.createDataFrame([(1, TALK), (2, TALK[:1]), (3, [{"role": "assistant", "content": ""}])], "id int, messages array<struct<role:string,content:string>>")
    encoded = M.encode(df, PATH, M.last_thought_template)
    got = sorted((r["id"], r["sequence"], r["error"]) for r in encoded.collect() if r["error"] is None)
    assert got == [(1, 0, None), (1, 1, None)] and [r["id"] for r in encoded.where("error is not null").collect()] == [3]
    assert M.lengths(encoded).first()["max"] == max(len(r["ids"]) for r in encoded.where("error is null").collect())
    assert [(r["sequences"], r["conversations"]) for r in M.supervision(encoded).collect()] == [(2, 1)]
