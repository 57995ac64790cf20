"""Numbers, units and clinical formulas as Column expressions.

A function that can fail returns a struct of result and error, one of them null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions import wording as W

# Forms of numbers, pressures and reference ranges.
NUMBER = r"(?<![\w.])[-−]?\d+(?:,\d{3})*(?:\.\d+)?"
PRESSURE = r"^\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*$"
BETWEEN = r"^\s*(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)\s*$"
BOUND = r"^\s*(<=|>=|<|>|≤|≥)\s*(\d+(?:\.\d+)?)\s*$"

# Spellings of units, spellings of substances, and the formulas between units.
UNITS = {
    "mg/dL": ["mg/dl"], "mmol/L": ["mmol/l"], "umol/L": ["umol/l", "micromol/l"], "kg": ["kg", "kgs", "kilogram", "kilograms"],
    "lb": ["lb", "lbs", "pound", "pounds"], "in": ["in", "inch", "inches", '"'], "cm": ["cm", "centimeter", "centimeters"],
    "F": ["°f", "ºf", "degf", "f", "fahrenheit"], "C": ["°c", "ºc", "degc", "c", "celsius"],
}
SUBSTANCES = {
    "glucose": ["glucose", "fasting glucose", "glucose (fasting)", "blood glucose"],
    "creatinine": ["creatinine", "serum creatinine"], "cholesterol": ["cholesterol", "total cholesterol"],
}
SEXES = {"male": ["male", "m", "man"], "female": ["female", "f", "woman"]}
FACTORS = {
    ("mg/dL", "mmol/L", "glucose"): 0.0555, ("mg/dL", "umol/L", "creatinine"): 88.42, ("mg/dL", "mmol/L", "cholesterol"): 0.0259,
    ("lb", "kg", None): 0.4536, ("kg", "lb", None): 2.2046, ("in", "cm", None): 2.54, ("cm", "in", None): 0.3937,
}


def lookup(key: Column, names: dict[str, list[str]]) -> Column:
    """The name that lists a spelling, else null."""
    pairs = [F.lit(x) for name, spellings in names.items() for s in spellings for x in (s, name)]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_float(s: Column) -> Column:
    """A decimal number with a Unicode minus and thousands separators; null for anything else."""
    plain = F.replace(F.replace(F.trim(s), F.lit("−"), F.lit("-")), F.lit(","), F.lit(""))
    return F.when(F.regexp_like(plain, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), plain.try_cast("double"))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), parse_float)


def fact_numbers(text: Column) -> Column:
    return numbers(F.regexp_replace(F.coalesce(text, F.lit("")), W.CONTEXT, " "))


def decimals(number: Column) -> Column:
    """Digits after the point in the text of a number."""
    return F.length(F.regexp_extract(number, r"\.(\d+)", 1))


def number_matches(gold: Column, places: Column, candidates: Column) -> Column:
    """Whether a candidate equals gold at gold's precision."""
    scale = F.pow(F.lit(10.0), places)
    return F.exists(candidates, lambda c: F.abs(F.rint(c * scale) / scale - gold) <= 1e-9)


def parse_bp(s: Column) -> Column:
    part = lambda k: F.regexp_extract(s, PRESSURE, k).try_cast("double")
    return F.when(F.regexp_like(s, F.lit(PRESSURE)), F.struct(part(1).alias("systolic"), part(2).alias("diastolic")))


def reference_range(s: Column) -> Column:
    """low, high and whether each bound is excluded; a null bound is open; null if unreadable."""
    null = F.lit(None).cast("double")
    op, value = F.regexp_extract(s, BOUND, 1), F.regexp_extract(s, BOUND, 2).try_cast("double")
    both = F.struct(F.regexp_extract(s, BETWEEN, 1).try_cast("double").alias("low"), F.regexp_extract(s, BETWEEN, 2).try_cast("double").alias("high"), F.lit(False).alias("low_strict"), F.lit(False).alias("high_strict"))
    upper = F.struct(null.alias("low"), value.alias("high"), F.lit(False).alias("low_strict"), (op == "<").alias("high_strict"))
    lower = F.struct(value.alias("low"), null.alias("high"), (op == ">").alias("low_strict"), F.lit(False).alias("high_strict"))
    return F.when(F.regexp_like(s, F.lit(BETWEEN)), both).when(op.isin("<", "<=", "≤"), upper).when(op.isin(">", ">=", "≥"), lower)


def range_state(value: Column, low: Column, high: Column, low_strict: Column, high_strict: Column) -> Column:
    """high is tested first; a bound that is excluded counts as outside."""
    above = high.isNotNull() & ((value > high) | high_strict & (value == high))
    below = low.isNotNull() & ((value < low) | low_strict & (value == low))
    return F.when(value.isNotNull(), F.when(above, "high").when(below, "low").otherwise("normal"))


def deviation(value: Column, low: Column, high: Column) -> Column:
    """Relative distance outside the range, 0 inside."""
    return F.when(value > high, F.try_divide(value - high, F.abs(high))).when(value < low, F.try_divide(low - value, F.abs(low))).otherwise(F.lit(0.0))


def to_metric(value: Column, unit: Column) -> Column:
    return F.when(unit == "lb", value * 0.4536).when(unit == "in", value * 2.54).otherwise(value)


def normalize_unit(unit: Column) -> Column:
    key = F.lower(F.replace(F.translate(F.trim(unit), "µμ", "uu"), F.lit(" "), F.lit("")))
    return lookup(key, UNITS)


def normalize_substance(substance: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(substance)), r"\s+", " ")
    return F.when(~key.isin("", "null", "none"), F.coalesce(lookup(key, SUBSTANCES), key))


def outcome(result: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), result).alias("result"), error.alias("error"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def unit_convert(value: Column, from_unit: Column, to_unit: Column, substance: Column) -> Column:
    """Conversion to two places; one that doesn't depend on the substance ignores it."""
    source, target, what = normalize_unit(from_unit), normalize_unit(to_unit), normalize_substance(substance)
    result = F.lit(None).cast("double")
    for (a, b, s), factor in FACTORS.items():
        fits = (source == a) & (target == b) & (F.lit(True) if s is None else F.coalesce(what == s, F.lit(False)))
        result = F.when(fits, value * factor).otherwise(result)
    result = F.when((source == "F") & (target == "C"), (value - 32) * 5 / 9).when((source == "C") & (target == "F"), value * 9 / 5 + 32).otherwise(result)
    error = F.when(~finite(value), "Error: value must be a finite number").when(result.isNull(), F.concat(F.lit("Error: unsupported conversion from "), F.coalesce(from_unit, F.lit("?")), F.lit(" to "), F.coalesce(to_unit, F.lit("?"))))
    return outcome(F.round(result, 2), error)


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    good = finite(weight_kg) & finite(height_cm) & (weight_kg > 0) & (height_cm > 0)
    return outcome(F.round(weight_kg / F.pow(height_cm / 100, F.lit(2)), 1), F.when(~good, "Error: weight_kg and height_cm must be positive numbers"))


def egfr_raw(creatinine: Column, age: Column, female: Column) -> Column:
    """CKD-EPI 2021, without race."""
    ratio = creatinine / F.when(female, 0.7).otherwise(0.9)
    power = F.pow(F.least(ratio, F.lit(1.0)), F.when(female, -0.241).otherwise(-0.302)) * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2))
    return F.lit(142.0) * power * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0)


def normal_sex(sex: Column) -> Column:
    return lookup(F.lower(F.trim(sex)), SEXES)


def egfr(creatinine: Column, age: Column, sex: Column) -> Column:
    kind = normal_sex(sex)
    error = (
        F.when(~(finite(creatinine) & (creatinine > 0)), "Error: creatinine_mg_dl must be a positive number")
        .when(~(finite(age) & (age == F.floor(age)) & age.between(18, 120)), "Error: age must be an integer between 18 and 120")
        .when(kind.isNull(), "Error: sex must be 'male' or 'female'")
    )
    return outcome(F.round(egfr_raw(creatinine, age, kind == "female"), 0), error)


def kdigo_stage(x: Column) -> Column:
    return F.when(x >= 90, "G1").when(x >= 60, "G2").when(x >= 45, "G3a").when(x >= 30, "G3b").when(x >= 15, "G4").when(x.isNotNull(), "G5")


def accepted_stages(x: Column) -> Column:
    """The stage, and its neighbour within 1.0 of a cut."""
    return F.array_distinct(F.array(kdigo_stage(x), kdigo_stage(x - 1.0), kdigo_stage(x + 1.0)))


def who_categories(x: Column, band: float = 0.15) -> Column:
    category = lambda v: F.when(v < 18.5, "underweight").when(v < 25, "normal").when(v < 30, "overweight").otherwise("obese")
    return F.array_sort(F.array_distinct(F.array(category(x - band), category(x), category(x + band))))


def half_up(x: Column, places: int) -> Column:
    """Rounding of the written decimal number, halves away from zero."""
    return F.round(x.cast("string").cast("decimal(38,18)"), places).cast("double")


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance + 1e-9


TOOLS = {
    "unit_convert": (("value", "from_unit", "to_unit"), ("substance",)),
    "calculate_bmi": (("weight_kg", "height_cm"), ()),
    "calculate_egfr": (("creatinine_mg_dl", "age", "sex"), ()),
}


def execute_tool(name: Column, arguments: Column) -> Column:
    """arguments: map of text to text. Unknown tools, missing and unexpected arguments give errors, in this order; then the tool runs."""
    arg = lambda k: F.try_element_at(arguments, F.lit(k))
    number = lambda k: parse_float(arg(k))
    run = {
        "unit_convert": unit_convert(number("value"), arg("from_unit"), arg("to_unit"), arg("substance")),
        "calculate_bmi": bmi(number("weight_kg"), number("height_cm")),
        "calculate_egfr": egfr(number("creatinine_mg_dl"), number("age"), arg("sex")),
    }
    fail = lambda text: outcome(F.lit(None).cast("double"), text)
    result = fail(F.concat(F.lit("Error: unknown tool "), F.coalesce(name, F.lit("?"))))
    for tool, (required, optional) in TOOLS.items():
        keys = F.map_keys(arguments)
        missing = F.array_except(F.array(*map(F.lit, required)), keys)
        unexpected = F.array_sort(F.array_except(keys, F.array(*map(F.lit, required + optional))))
        checked = F.when(F.size(missing) > 0, fail(F.concat(F.lit("Error: missing required argument(s) "), F.array_join(missing, ", ")))).when(F.size(unexpected) > 0, fail(F.concat(F.lit("Error: unexpected argument(s) "), F.array_join(unexpected, ", ")))).otherwise(run[tool])
        result = F.when(name == tool, checked).otherwise(result)
    return result
