"""Scalar functions on literal values."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import clinical as C
from fathomline.functions import text as X
from fathomline.operators import chat
from fathomline.operators import statistics as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


lit = F.lit


@pytest.mark.parametrize("args,expected", [
    ((100.0, "mg/dL", "mmol/L", "glucose"), 5.55), ((1.0, "mg/dL", "umol/L", "creatinine"), 88.42), ((200.0, "mg/dL", "mmol/L", "cholesterol"), 5.18),
    ((100.0, "lb", "kg", None), 45.36), ((100.0, "kg", "lb", None), 220.46), ((10.0, "in", "cm", None), 25.4), ((100.0, "cm", "in", None), 39.37),
    ((212.0, "°F", "°C", None), 100.0), ((37.0, "°C", "°F", None), 98.6), ((150.4, "mg/dL", "mmol/L", "Fasting  Glucose"), 8.35), ((1.2, "mg/dL", " µmol/l ", "creatinine"), 106.1),
    ((234.6, "lb", "kg", "anything"), 106.41), ((1.0, "mg/dL", "mmol/L", None), None), ((1.0, "mg/dL", "mmol/L", "iron"), None), ((1.0, "kg", "cm", None), None), ((1.0, "furlong", "cm", None), None), ((None, "kg", "lb", None), None),
])
def test_unit_convert(spark, args, expected):
    r = value(spark, C.unit_convert(lit(args[0]).cast("double"), *[lit(a).cast("string") for a in args[1:]]))
    assert r["result"] == expected and (r["error"] is None) == (expected is not None)


@pytest.mark.parametrize("spelling", ["μmol/L", "µmol/L", "umol/L", "UMOL/L", " µmol/l "])
def test_unit_spellings(spark, spelling):
    assert value(spark, C.normalize_unit(lit(spelling))) == "umol/L"


@pytest.mark.parametrize("cr,age,female,raw", [(1.0, 50, False, 91.69), (1.0, 50, True, 68.63), (0.9, 40, False, 110.73), (0.7, 40, True, 112.05), (2.5, 58, True, 21.75)])
def test_egfr(spark, cr, age, female, raw):
    assert round(value(spark, C.egfr_raw(lit(cr), lit(float(age)), lit(female))), 2) == raw
    assert value(spark, C.egfr(lit(cr), lit(float(age)), lit("F" if female else "man")))["result"] == round(raw)


@pytest.mark.parametrize("cr,age,sex", [(0.0, 50.0, "male"), (1.0, 17.0, "male"), (1.0, 50.5, "male"), (1.0, 50.0, "x")])
def test_egfr_errors(spark, cr, age, sex):
    assert value(spark, C.egfr(lit(cr), lit(age), lit(sex)))["error"].startswith("Error:")


def test_stages_and_categories(spark):
    assert [value(spark, C.kdigo_stage(lit(float(x)))) for x in (90, 89, 60, 59, 44, 29, 14)] == ["G1", "G2", "G2", "G3a", "G3b", "G4", "G5"]
    assert [value(spark, C.who_categories(lit(x))) for x in (17.0, 22.0, 27.7, 31.0, 24.9)] == [["underweight"], ["normal"], ["overweight"], ["obese"], ["normal", "overweight"]]
    assert value(spark, C.bmi(lit(104.2), lit(163.4)))["result"] == 39.0


def test_numbers_and_ranges(spark):
    assert value(spark, C.parse_float(lit(" −1,234.5 "))) == -1234.5
    assert all(value(spark, C.parse_float(lit(s))) is None for s in ("5d", "1_0", "x", "", "nan"))
    assert value(spark, C.numbers(lit("BP 150/92, 1,200 mg v2.1 −3"))) == [150.0, 92.0, 1200.0, -3.0]
    assert value(spark, C.fact_numbers(lit("Glucose 150 (70-100), under 5, <3"))) == [150.0]
    assert tuple(value(spark, C.reference_range(lit("70-100")))) == (70.0, 100.0, False, False)
    assert tuple(value(spark, C.reference_range(lit("<200")))) == (None, 200.0, False, True)
    assert tuple(value(spark, C.reference_range(lit("≥ 40")))) == (40.0, None, False, False)
    assert value(spark, C.reference_range(lit("x"))) is None
    assert tuple(value(spark, C.parse_bp(lit("150/92")))) == (150.0, 92.0)
    assert value(spark, C.number_matches(lit(4.2), lit(1), F.array(lit(4.19), lit(9.0)))) is True


def test_tools(spark):
    call = lambda name, **a: value(spark, C.execute_tool(lit(name), F.create_map(*[lit(x) for kv in a.items() for x in kv]) if a else F.create_map().cast("map<string,string>")))
    assert call("calculate_bmi", weight_kg="104.2", height_cm="163.4")["result"] == 39.0
    assert "unknown tool" in call("x", a="1")["error"] and "missing" in call("calculate_bmi", weight_kg="1")["error"]
    assert "unexpected" in call("calculate_bmi", weight_kg="1", height_cm="2", z="3")["error"]


NOTE = "CC: fatigue. HPI: 58-year-old woman. Vitals: HR 117 bpm, BP 150/92. Weight 234.6 lb, height 74.5 in. BMI 29.7. Allergies: NKDA"


def test_notes(spark):
    assert tuple(value(spark, X.age_sex(lit(NOTE)))) == (58, "F")
    assert tuple(value(spark, X.age_sex(lit("Mr. Smith")))) == (None, "M")
    assert value(spark, X.allergy_status(lit(NOTE))) == "nkda" and value(spark, X.allergy_status(lit("x"))) == "absent"
    assert value(spark, X.allergy_status(lit("Allergies: penicillin"))) == "documented" and value(spark, X.allergy_status(lit("Allergy: not documented"))) == "not_documented"
    assert value(spark, X.inline_bmi(lit(NOTE))) == [29.7]
    assert {k for k, v in value(spark, X.section_presence(lit(NOTE))).items() if v} == {"cc", "hpi", "vitals", "allergies"}
    assert value(spark, X.table_panel(lit("labs"), F.array(*[F.array(lit(t)) for t in ("TSH", "Free T4", "Free T3")]))) == "thyroid"
    assert value(spark, X.sentence_count(lit("One. Two! Three 1.5 mg."))) == 3
    assert value(spark, X.truncate(lit("a  b c"), 4)) == "a b…"


def test_wilson(spark):
    assert value(spark, S.wilson(lit(50), lit(100)))["low"] == 0.4038
    assert tuple(value(spark, S.wilson(lit(0), lit(0)))) == (None, None)
    assert value(spark, S.wilson(lit(0), lit(3), clamp=True))["low"] == 0.0


def scores(spark, rows):
    return spark.createDataFrame(rows, "s double, y boolean")


def test_auroc_and_ece(spark):
    area = lambda rows: S.auroc(scores(spark, rows), "s", "y").first()["auroc"]
    assert area([(0.1, False), (0.2, False), (0.8, True), (0.9, True)]) == 1.0 and area([(0.5, False), (0.5, True)]) == 0.5 and area([(0.5, True)]) is None
    error = lambda rows: S.ece(scores(spark, rows), "s", "y").first()["ece"]
    assert error([(1.0, True), (0.0, False)]) == 0.0 and error([(0.9, False), (0.9, False)]) == 0.9 and error([]) is None


def test_tri_state(spark):
    state = lambda *xs: value(spark, S.tri_state(F.array(*map(lit, xs)).cast("array<string>")))
    assert [state(), state("pass"), state("pass", "review"), state("review", "fail")] == ["review", "pass", "review", "fail"]


def test_parsed_turns():
    ok = '<tool_call>{"name": "calculate_bmi", "arguments": {"weight_kg": 70, "height_cm": 170}}</tool_call>'
    xml = "x <tool_call><function=unit_convert>\n<parameter=value>\n5\n</parameter>\n<parameter=from_unit>\nkg\n</parameter>\n<parameter=to_unit>\nlb\n</parameter>\n</function></tool_call>"
    assert chat.parsed(ok)["status"] == "valid" and chat.parsed(xml, "xml")["status"] == "valid" and chat.parsed(xml, "xml")["content"] == "x"
    assert chat.parsed("plain")["status"] == "no_call" and chat.parsed(ok + "<tool_call>")["status"] == "unterminated"
    assert chat.parsed(ok.replace(": 70", ": true"))["status"] == "schema_error" and chat.parsed(ok.replace(": 70", ": NaN"))["status"] == "invalid_json"
    assert chat.parsed('<tool_call>{"name": "a", "name": "b", "arguments": {}}</tool_call>')["status"] == "invalid_json"
    assert chat.parsed("<tool_call><function=x></tool_call>", "xml")["status"] == "invalid_json"


def test_rollout(spark):
    def generate(prompts):
        return ["done" if "RESULT" in p else "<tool_call>oops</tool_call>" if p.startswith("bad") else '<tool_call>{"name": "calculate_bmi", "arguments": {"weight_kg": 1, "height_cm": 2}}</tool_call>' for p in prompts]

    prompts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "deaf")], "id long, prompt string")
    got = {r["id"]: (r["stop_reason"], r["answer"], len(r["turns"])) for r in chat.rollout(prompts, generate, lambda name, a: " RESULT" if name else "", budget=2).collect()}
    assert got[1] == ("answer", "done", 2) and got[2] == ("parse_error", None, 1)
