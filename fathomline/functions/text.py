"""Text measures and extraction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of notes.
STOP_WORDS = ["a", "an", "the", "is", "are", "was", "were", "of", "to", "in", "and", "or", "with", "for", "on", "at", "by", "as"]
SECTIONS = {
    "cc": r"CC|Chief Complaint", "hpi": r"HPI|History of Present(?:ing)? Illness", "pmh": r"PMH|Past Medical History",
    "medications": r"(?:Current |Home )?Medications?", "allergies": r"Allerg(?:y|ies)", "vitals": r"Vitals?|Vital Signs",
    "exam": r"(?:Physical )?Exam(?:ination)?", "labs": r"Labs?|Laboratory(?: Results| Data| Studies| Findings)?",
    "assessment_plan": r"Assessment(?:\s*(?:/|and|&)\s*Plan)?|A/P|Plan|Impression",
}
PANELS = {
    "metabolic": ["Glucose (fasting)", "HbA1c", "Creatinine", "BUN", "Sodium", "Potassium"],
    "lipid": ["Total Cholesterol", "LDL", "HDL", "Triglycerides"],
    "cbc": ["WBC", "Hemoglobin", "Hematocrit", "Platelets"],
    "liver": ["ALT", "AST", "Alkaline Phosphatase", "Total Bilirubin", "Albumin", "Total Protein"],
    "thyroid": ["TSH", "Free T4", "Free T3"],
    "coagulation": ["PT", "INR", "aPTT", "D-dimer"],
    "iron": ["Serum Iron", "TIBC", "Ferritin", "Transferrin Saturation"],
    "renal": ["Creatinine", "BUN", "eGFR", "Uric Acid", "Calcium", "Phosphorus"],
}
VITALS = ["Blood Pressure", "Heart Rate", "Temperature", "Respiratory Rate", "SpO2"]

# Headers of sections, statements on allergies, age, sex and title, a stated BMI.
HEADER = r"(?i)(?<![A-Za-z])\**\s*(?:{})\s*\**\s*:"
ALLERGIES = r"(?i)\ballerg(?:y|ies)(?:\s+history)?\s*\**\s*:\s*\**\s*([^\n]*)"
NO_ALLERGIES = r"(?i)\bNKDA\b|no known (?:drug )?allergies|\bnone known\b|\bno allergies\b"
ALLERGIES_UNKNOWN = (
    r"(?i)not (?:documented|recorded|obtained|available|listed|reviewed|assessed|specified|provided)"
    r"|\bunknown\b|\bunable\b|\bpending\b|\bunclear\b|to be (?:obtained|confirmed|clarified)"
)
AGE = r"(?i)\b(\d{1,3})[- ](?:year|yr)s?[- ]old\b"
SEX = r"(?i)\b(male|female|man|woman|gentleman|lady)\b"
MALE, FEMALE = ["male", "man", "gentleman"], ["female", "woman", "lady"]
MALE_TITLE, FEMALE_TITLE = r"\bMr\.", r"\bM(?:s|rs)\."
STATED_BMI = r"(?i)\bBMI\b[^0-9\n]{0,12}?(\d{2}(?:\.\d+)?)(?!\s*[-–]\s*\d)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\s]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\s]+"))


def sentence_count(text: Column) -> Column:
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.size(F.filter(parts, lambda p: F.trim(p) != ""))


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+(?:\.\d+)?", "#")


def truncate(text: Column, n: int) -> Column:
    """White space collapsed; what is longer than n ends in an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, n - 1)), F.lit("…")))


def approx_tokens(text: Column) -> Column:
    return F.bround(F.length(text) / F.lit(4.0)).cast("long")


def token_f1(a: Column, b: Column, stop: list[str] = STOP_WORDS) -> Column:
    """F1 of bags of lower-case words without stop words; 1 if both are empty, 0 if one is."""
    bag = lambda t: F.filter(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda w: ~w.isin(stop))

    def score(bags: Column) -> Column:
        x, y = bags["x"], bags["y"]
        count = lambda w, xs: F.size(F.filter(xs, lambda v: v == w))
        shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, w: s + F.least(count(w, x), count(w, y)))
        both = 2.0 * shared / (F.size(x) + F.size(y))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both)

    return F.transform(F.array(F.struct(bag(a).alias("x"), bag(b).alias("y"))), score)[0]  # the bags are computed once


def occurrences(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def markdown_table(headers: Column, rows: Column, unit: str = "Unit") -> Column:
    """A Markdown table; pipes are escaped, and an empty cell of the unit column says so."""
    cell = lambda c: F.trim(F.replace(c, F.lit("|"), F.lit("\\|")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    at = F.array_position(headers, unit)
    body = F.transform(rows, lambda r: line(F.transform(r, lambda c, i: F.when((i + 1 == at) & (cell(c) == ""), "(no unit)").otherwise(cell(c)))))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit("---")), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(line(F.transform(headers, cell)), rule), body), "\n")


def user_content(note: Column, kind: Column, headers: Column, rows: Column, question: Column) -> Column:
    return F.concat(F.lit("## Encounter note\n"), F.trim(note), F.lit("\n\n## Table ("), kind, F.lit(")\n"), markdown_table(headers, rows), F.lit("\n\n## Question\n"), F.trim(question))


def section_presence(note: Column) -> Column:
    pairs = [x for name, p in SECTIONS.items() for x in (F.lit(name), F.regexp_like(note, F.lit(HEADER.format(p))))]
    return F.create_map(*pairs)


def note_style(note: Column) -> Column:
    return F.when(F.instr(note, "**") > 0, "markdown").otherwise("plain")


def allergy_status(note: Column) -> Column:
    """documented, nkda, not_documented, or absent."""
    said = F.regexp_extract(note, ALLERGIES, 1)
    like = lambda t, p: F.regexp_like(t, F.lit(p))
    of_said = F.when(like(said, ALLERGIES_UNKNOWN), "not_documented").when(like(said, NO_ALLERGIES), "nkda").when(F.btrim(said, F.lit(" .*")) != "", "documented").otherwise("not_documented")
    return F.when(like(note, ALLERGIES), of_said).when(like(note, NO_ALLERGIES), "nkda").otherwise("absent")


def age_sex(note: Column) -> Column:
    """Age; sex within 40 characters after it, else anywhere, else from a title."""
    after = F.regexp_extract(note, AGE.replace("(?i)", "(?is)").replace("(\\d{1,3})", "\\d{1,3}") + "(.{0,40})", 1)
    word = F.lower(F.coalesce(F.nullif(F.regexp_extract(after, SEX, 1), F.lit("")), F.nullif(F.regexp_extract(note, SEX, 1), F.lit(""))))
    titled = F.when(F.regexp_like(note, F.lit(MALE_TITLE)), "M").when(F.regexp_like(note, F.lit(FEMALE_TITLE)), "F")
    return F.struct(F.regexp_extract(note, AGE, 1).try_cast("int").alias("age"), F.when(word.isin(MALE), "M").when(word.isin(FEMALE), "F").otherwise(titled).alias("sex"))


def inline_bmi(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(STATED_BMI), F.lit(1)), lambda x: x.try_cast("double"))


def table_panel(kind: Column, rows: Column) -> Column:
    names = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r[0])))
    is_set = lambda wanted: names == F.array(*map(F.lit, sorted(wanted)))
    panel = F.lit("mixed")
    for name, wanted in reversed(PANELS.items()):
        panel = F.when(is_set(wanted), name).otherwise(panel)
    return F.when(kind == "vitals", F.when(is_set(VITALS), "vitals").otherwise("vitals+body")).otherwise(panel)


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def input_text(note: Column, rows: Column, question: Column) -> Column:
    return F.concat_ws(" ", note, F.array_join(F.flatten(rows), " "), question)


def stem_recall(wanted: Column, said: Column, length: int = 6) -> Column:
    """Share of the stems (first letters of longer words) of one text that occur in another."""
    stems = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[a-z]{4,}"), F.lit(0)), lambda w: F.substring(w, 1, length)))
    return F.try_divide(F.size(F.array_intersect(stems(wanted), stems(said))).cast("double"), F.size(stems(wanted)).cast("double"))
