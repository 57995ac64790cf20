"""Checks of question-answering records. Each gives flags: check, severity, split, id, detail; METRICS give figures: check, metric, key, value.

Records: id, split, ord, note, table (type, headers, rows), question, answer, answer_type, tool_calls (tool, arguments as a map of texts, result).

Facts that checks share are columns of `with_features`; a check adds those that it needs and that aren't there yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import arithmetic as A
from fathomline.functions import clinical as C
from fathomline.functions import notes as N
from fathomline.functions import text as X
from fathomline.operators import relational as R
from fathomline.operators import statistics as S

# Fixed values of the record format.
ANSWER_TYPES = ["extractive", "numeric_reasoning", "tool_call", "uncertain"]
HEADERS = {"labs": ["Test", "Value", "Unit", "Reference Range"], "vitals": ["Vital", "Value", "Unit"]}
RECORD = """id string, split string, ord long, note string, table struct<type: string, headers: array<string>, rows: array<array<string>>>,
  question string, answer string, answer_type string, tool_calls array<struct<tool: string, arguments: map<string, string>, result: double>>"""

# Characters that look alike, wordings, conditions of one sex, drugs of one class, prefixes of reference keys, rows of substances.
LOOKALIKES = "µμ–—−×÷≈≤≥°²³"
RANGE_WORDING = r"(?i)within (?:the |its |their )?(?:normal )?(?:reference )?range|normal (?:reference )?range|reference range|above|below|elevated|abnormal"
SELF_ANNOTATED = r"(?i)coding error|possibly erroneous|likely erroneous|dual diagnosis|noted in (?:chart|records)|per (?:chart|records)|discrepan"
FEMALE_ONLY = (
    r"(?i)\bpregnan\w*|\bmenstrua\w*|\bovar(?:y|ies|ian)\b|\buter(?:us|ine)\b|\bendometri\w*|\bvagin\w*|\bcervix\b"
    r"|\bcervical (?:cancer|dysplasia|screening|cytology)"
)
MALE_ONLY = r"(?i)\bprostat\w*|\bBPH\b|\btesticular\b|\bscrot\w*"
DRUG_CLASSES = {
    "beta-blocker": ["metoprolol", "carvedilol", "bisoprolol"], "anticoagulant": ["warfarin", "apixaban", "enoxaparin"],
    "DPP-4 inhibitor": ["sitagliptin", "linagliptin"], "ACE inhibitor / ARB": ["lisinopril", "ramipril", "losartan"], "SSRI": ["sertraline", "citalopram"],
    "gabapentinoid": ["gabapentin", "pregabalin"], "statin": ["atorvastatin", "rosuvastatin"], "PPI": ["omeprazole", "pantoprazole"],
    "SGLT2 inhibitor": ["dapagliflozin", "empagliflozin"],
}
CATEGORY_OF_PREFIX = {
    "drug_interaction": "drug_interaction", "contraindication": "contraindication", "guideline": "clinical_guideline",
    "dosing": "dosing_guideline", "reference": "clinical_reference",
}
SUBSTANCE_ROWS = {"glucose": ["Glucose (fasting)", "Fasting Glucose"], "creatinine": ["Creatinine"], "cholesterol": ["Total Cholesterol"]}
ANSWER_NUMBER = r"(?<![\w.])\d+(?:,\d{3})*(?:\.\d+)?"
MICRO_UNITS = r"\b(?:ug|µg|μg|uL|µL|μL|umol|µmol|μmol)\b"

SOURCES, MATCHES = ["note", "table", "question"], ["exact", "converted", "approx"]


def flags(df: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    """A flag for each row where detail isn't null."""
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "split", "id", detail.alias("detail")).where("detail is not null")


def each(df: DataFrame, check: str, severity: str, details: Column) -> DataFrame:
    """A flag for each text of an array."""
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "split", "id", F.explode(F.array_compact(details)).alias("detail"))


def figures(df: DataFrame, check: str, metric: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))


FEATURES: dict[str, Callable[[], Column]] = {
    "measures": lambda: N.record_measurements_of(F.col("note"), F.col("table.rows"), F.col("question")),
    "drugs": lambda: N.medications_of(F.col("note")),
    "stated_bmi": lambda: X.inline_bmi(F.coalesce("note", F.lit(""))),
    "age_sex": lambda: X.age_sex(F.coalesce("note", F.lit(""))),
    "panel": lambda: X.table_panel(F.col("table.type"), F.col("table.rows")),
    "allergy": lambda: X.allergy_status(F.coalesce("note", F.lit(""))),
    "asks_bmi": lambda: F.coalesce(F.regexp_like("question", F.lit(N.ASKS_BMI)), F.lit(False)),
    "uncertain_class": lambda: F.when(F.col("answer_type") == "uncertain", N.uncertain_class_of(F.col("question"), F.col("answer"))),
    "numeric_classes": lambda: F.when(F.col("answer_type") == "numeric_reasoning", N.numeric_classes(F.coalesce("question", F.lit("")))),
    "sections": lambda: X.section_presence(F.coalesce("note", F.lit(""))),
    "note_style": lambda: X.note_style(F.coalesce("note", F.lit(""))),
    "note_words": lambda: X.word_count(F.col("note")),
    "question_words": lambda: X.word_count(F.col("question")),
    "answer_words": lambda: X.word_count(F.col("answer")),
    "answer_sentences": lambda: X.sentence_count(F.col("answer")),
    "question_template": lambda: X.mask_numbers(F.col("question")),
    "approx_prompt_tokens": lambda: F.bround((F.length("note") + F.length(X.table_text(F.concat(F.array("table.headers"), F.col("table.rows")))) + F.length("question")) / F.lit(4.0)).cast("long"),
    "approx_answer_tokens": lambda: X.approx_tokens(F.col("answer")),
}


def with_features(records: DataFrame, *names: str) -> DataFrame:
    """records with the named features (all, if none is named) that they don't have yet."""
    return records.withColumns({n: FEATURES[n]() for n in names or FEATURES if n not in records.columns})


def called(tool: str) -> Column:
    return F.coalesce(F.exists("tool_calls", lambda c: c["tool"] == tool), F.lit(False))


def structure_errors() -> Column:
    """All structural problems of a record, as an array of texts and nulls."""
    blank = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"no {c}") for c in ("id", "note", "question", "answer", "answer_type")]
    headers = F.when(F.col("table.type") == "labs", F.array(*map(F.lit, HEADERS["labs"]))).when(F.col("table.type") == "vitals", F.array(*map(F.lit, HEADERS["vitals"])))
    rows = F.coalesce("table.rows", F.array().cast("array<array<string>>"))
    has_calls = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    return F.array(
        *blank, F.when(~F.col("id").startswith(F.concat("split", F.lit("_"))), "id of another split"),
        F.when(~F.col("answer_type").isin(ANSWER_TYPES), "unknown answer_type"), F.when(headers.isNull(), "unknown kind of table"),
        F.when(headers.isNotNull() & ~F.col("table.headers").eqNullSafe(headers), "headers of another kind of table"), F.when(F.size(rows) == 0, "empty table"),
        F.when(F.exists(rows, lambda r: r.isNull() | (F.size(r) != F.size("table.headers"))), "row and headers differ in length"),
        F.when(F.exists(rows, lambda r: F.exists(r, lambda c: c.isNull())), "cell without text"),
        F.when(has_calls != (F.col("answer_type") == "tool_call"), "calls and answer_type disagree"),
        F.when(F.exists("tool_calls", lambda c: c["tool"].isNull() | c["arguments"].isNull() | c["result"].isNull()), "incomplete call"),
    )


def q1_schema(records: DataFrame) -> DataFrame:
    return each(records, "Q1", "error", structure_errors())


def q1_empty_cells(records: DataFrame) -> DataFrame:
    """Blank cells by row and header."""
    rows = records.select(F.col("table.headers").alias("h"), F.explode("table.rows").alias("r")).select("r", F.posexplode("r").alias("at", "cell"), "h")
    blank = rows.where(F.trim("cell") == "").groupBy(F.concat(F.try_element_at("r", F.lit(1)), F.lit(" / "), F.try_element_at("h", F.col("at") + 1)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return figures(blank, "Q1", "empty cells", F.col("key"), F.col("n"))


def q2_ids(records: DataFrame) -> DataFrame:
    """Ids once over all splits, of the form split_number, numbers contiguous from 0 within a split."""
    repeated = records.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split")).where("n > 1")
    number = F.when(F.col("id").rlike(r"^[A-Za-z0-9]+_\d+$") & F.col("id").startswith(F.concat("split", F.lit("_"))), F.regexp_extract("id", r"_(\d+)$", 1).try_cast("long"))
    odd = flags(records, "Q2", "error", F.when(number.isNull(), "id is not split_number"))
    gaps = records.groupBy("split").agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(number).alias("n"), F.countDistinct(number).alias("different"))
    bad = (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("different") != F.col("n"))
    gap = flags(gaps.withColumn("id", F.lit("*")), "Q2", "error", F.when(bad, "numbers are not 0, 1, 2, ..."))
    return flags(repeated, "Q2", "error", F.lit("id occurs again")).unionByName(odd).unionByName(gap)


def near_notes(records: DataFrame, index_split: str, k: int, levels: tuple[float, ...] = R.LEVELS) -> DataFrame:
    """For records of other splits the most similar note of the index split, by an exact search down to the last level: id, match, jaccard. A row for each id (ties: most grams in common, then least match)."""
    notes = records.select("id", "split", F.regexp_extract_all(F.lower("note"), F.lit(r"(?U)\w+"), F.lit(0)).alias("t"))
    found = R.most_similar(notes.where(F.col("split") != index_split), notes.where(F.col("split") == index_split), "id", "t", k, levels)
    return R.first_of(found, ["id"], [F.desc("jaccard"), F.desc("shared"), F.asc("match")]).drop("shared")


def q3_duplicates(records: DataFrame, index_split: str = "train", k: int = 5, threshold: float = 0.9) -> DataFrame:
    """Repeated (note, question) within a split, and notes much like one of the index split."""
    keyed = records.select("split", "id", "ord", R.row_digest(records, "note", "question").alias("h"))
    firsts = keyed.groupBy("split", "h").agg(F.min(F.struct("ord", "id")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = keyed.join(firsts, ["split", "h"]).where("ord <> f.ord or id <> f.id")
    # Spark sizes records by what they are made of, which may be much less: they are not left to be broadcast.
    alike = near_notes(records, index_split, k, (threshold,)).where(F.col("jaccard") >= threshold).join(records.select("id", "split").hint("merge"), "id")
    return flags(repeats, "Q3", "warn", F.concat(F.lit("same note and question as "), F.col("f.id"))).unionByName(flags(alike, "Q3", "warn", F.format_string("note much like that of %s (%.3f)", "match", "jaccard")))


def q3_metrics(records: DataFrame, index_split: str = "train", k: int = 5) -> DataFrame:
    """By split: notes used more than once, templates of notes and those shared with the index split; and the similarities to it."""
    hashed = records.select("split", F.sha2("note", 256).alias("h"), F.sha2(X.mask_numbers(F.col("note")), 256).alias("t"))
    reused = hashed.groupBy("split", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.count_if(F.col("n") > 1).alias("n"))
    templates = hashed.groupBy("split").agg(F.countDistinct("t").alias("n"))
    shared = hashed.where(F.col("split") != index_split).join(hashed.where(F.col("split") == index_split).select("t").distinct(), "t", "left_semi").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    out = figures(reused, "Q3", "notes used again", F.col("split"), F.col("n")).unionByName(figures(templates, "Q3", "templates of notes", F.col("split"), F.col("n")))
    out = out.unionByName(figures(shared, "Q3", f"notes with a template of {index_split}", F.col("split"), F.col("n")))
    # An id may repeat, over splits too: each record of another split counts once.
    alike = near_notes(records, index_split, k).join(records.where(F.col("split") != index_split).select("id", "split").hint("merge"), "id")
    near = S.quantiles(alike, "jaccard", {f"p{q}": q for q in (0.5, 0.9, 0.99, 1.0)}, ["split"])
    spread = near.select("split", F.explode(F.array(*[F.struct(F.lit(f"p{round(100 * q)}").alias("name"), F.round(f"`p{q}`", 3).alias("v")) for q in (0.5, 0.9, 0.99, 1.0)])).alias("s"))
    return out.unionByName(figures(spread, "Q3", f"similarity to {index_split}", F.concat("split", F.lit(" "), F.col("s.name")), F.col("s.v")))


def calls(records: DataFrame) -> DataFrame:
    return records.select("*", F.posexplode("tool_calls").alias("at", "call"))


def q4_results(records: DataFrame) -> DataFrame:
    """Tool results computed again."""
    run = calls(records).withColumn("r", C.execute_tool(F.col("call.tool"), F.col("call.arguments")))
    wrong = F.coalesce(F.abs(F.col("r.result") - F.col("call.result")) > 1e-9, F.lit(True))
    return flags(run, "Q4", "error", F.coalesce(F.col("r.error"), F.when(wrong, F.concat_ws(" ", F.lit("gives"), F.col("r.result").cast("string"), F.lit("and not"), F.col("call.result").cast("string")))))


def grounding(target: Column, kind: str, exact: float = 1e-6, approx: float = 0.15) -> Column:
    """Where a body measure of a call comes from: the match that is best by source (note, table, question), then exact, converted to one place, or
    nearly; then one with a label, then the first. Null without a match."""
    def place(m: Column, i: Column) -> Column:
        metric = F.when(m["unit"] == "lb", m["value"] * 0.4536).when(m["unit"] == "in", m["value"] * 2.54).otherwise(m["value"])
        imperial = m["unit"].isin("lb", "in")
        match = F.when(~imperial & C.close(m["value"], target, exact), 0).when(imperial & C.close(F.round(metric, 1), target, exact), 1).when(imperial & C.close(metric, target, approx), 2)
        source = F.array_position(F.array(*map(F.lit, SOURCES)), m["source"])
        return F.when((m["kind"] == kind) & match.isNotNull(), F.struct(source.alias("s"), match.alias("m"), (~m["labeled"]).alias("u"), i.alias("i"), m["source"].alias("source"), m["unit"].alias("unit"), m["value"].alias("value"), F.round(metric - target, 3).alias("diff")))

    best = F.array_min(F.array_compact(F.transform("measures", place)))
    return F.when(best.isNotNull(), F.struct(best["source"].alias("source"), best["unit"].alias("unit"), F.element_at(F.array(*map(F.lit, MATCHES)), best["m"] + 1).alias("match"), best["value"].alias("value"), best["diff"].alias("diff")))


def grounded_calls(records: DataFrame) -> DataFrame:
    """Calls of calculate_bmi with weight and height: where their arguments come from."""
    rows = calls(with_features(records, "measures")).where("call.tool = 'calculate_bmi'")
    number = lambda key: C.parse_float(F.try_element_at("call.arguments", F.lit(key)))
    return rows.withColumns({"weight": grounding(number("weight_kg"), "weight"), "height": grounding(number("height_cm"), "height")})


def converted_values(records: DataFrame) -> DataFrame:
    """Calls of unit_convert with `found`: table (a row of the substance), note (its value there), question, or null."""
    rows = calls(records).where("call.tool = 'unit_convert'")
    substance = C.normalize_substance(F.try_element_at("call.arguments", F.lit("substance")))
    value = C.parse_float(F.try_element_at("call.arguments", F.lit("value")))
    same = lambda x: F.coalesce(C.close(x, value, 1e-6), F.lit(False))
    stated = lambda tests: F.exists("table.rows", lambda r: r[0].isin(tests) & same(C.parse_float(r[1])))
    in_table = F.lit(False)
    for name, tests in SUBSTANCE_ROWS.items():
        in_table = F.when(substance == name, stated(tests)).otherwise(in_table)
    analyte = F.create_map(*[F.lit(x) for name, tests in SUBSTANCE_ROWS.items() for x in (name, tests[0])])
    in_note = F.exists(N.analyte_values_of(F.col("note"), F.try_element_at(analyte, substance)), lambda v: same(C.parse_float(v)))
    found = F.when(F.coalesce(in_table, F.lit(False)), "table").when(in_note, "note").when(F.exists(C.numbers(F.col("question")), same), "question")
    return rows.withColumn("found", found)


def q5_grounding(records: DataFrame) -> DataFrame:
    """Arguments of calls that the input doesn't give: body measures as stated or converted, values to convert as stated."""
    missing = lambda k: F.when(F.col(k).isNull(), k)
    lacks = F.array_compact(F.array(missing("weight"), missing("height")))
    body = flags(grounded_calls(records), "Q5", "error", F.when(F.size(lacks) > 0, F.concat(F.lit("not in the input: "), F.array_join(lacks, ", "))))
    value = F.try_element_at("call.arguments", F.lit("value"))
    return body.unionByName(flags(converted_values(records), "Q5", "error", F.when(F.col("found").isNull(), F.concat(F.lit("not in the input: value "), value))))


def q5_patterns(records: DataFrame) -> DataFrame:
    """How often arguments come from where."""
    label = lambda k: F.concat(F.lit(f"{k}:"), F.coalesce(F.concat(F.col(f"{k}.source"), F.lit("/"), F.col(f"{k}.unit")), F.lit("missing")))
    body = grounded_calls(records).select("split", F.concat_ws(" ", label("weight"), label("height")).alias("p"))
    value = converted_values(records).select("split", F.concat(F.lit("value:"), F.coalesce("found", F.lit("missing"))).alias("p"))
    counts = body.unionByName(value).groupBy("split", "p").agg(F.count(F.lit(1)).alias("n"))
    return figures(counts, "Q5", "sources", F.concat_ws(" ", "split", "p"), F.col("n"))


def q6_rounding(records: DataFrame) -> DataFrame:
    """Converted arguments that are only nearly the conversion."""
    near = lambda k: F.when((F.col(f"{k}.match") == "approx"), F.format_string(f"{k} %s %s is %+.3f off after conversion", F.col(f"{k}.value").cast("string"), F.col(f"{k}.unit"), F.col(f"{k}.diff")))
    return each(grounded_calls(records), "Q6", "info", F.array(near("weight"), near("height")))


def q6_deltas(records: DataFrame) -> DataFrame:
    """By how much the BMI of exactly converted arguments (to two places) differs from the stated result, where one is imperial."""
    rows = grounded_calls(records).where("weight is not null and height is not null and (weight.unit = 'lb' or height.unit = 'in')")
    metric = lambda k, unit, factor: F.when(F.col(f"{k}.unit") == unit, F.round(F.col(f"{k}.value") * factor, 2)).otherwise(F.col(f"{k}.value"))
    again = C.bmi(metric("weight", "lb", 0.4536), metric("height", "in", 2.54))["result"]
    delta = F.format_string("%+.1f", F.round(again - F.col("call.result"), 1) + 0.0)
    counts = rows.groupBy(delta.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return figures(counts, "Q6", "BMI after exact conversion", F.col("d"), F.col("n"))


def primary_metric(kind: str) -> Column:
    """The note's measurement of a kind that counts, in kg or cm: the first with a label, else the first; no restatements."""
    own = F.filter("measures", lambda m: (m["kind"] == kind) & (m["source"] == "note") & ~m["equivalent"])
    chosen = F.coalesce(F.try_element_at(F.filter(own, lambda m: m["labeled"]), F.lit(1)), F.try_element_at(own, F.lit(1)))
    return C.to_metric(chosen["value"], chosen["unit"])


def stated_gaps(records: DataFrame) -> DataFrame:
    """Records whose note states a BMI: computed (from the note's weight and height) and gap to the nearest stated one."""
    rows = with_features(records, "measures", "stated_bmi", "asks_bmi").where(F.size("stated_bmi") > 0)
    rows = rows.withColumn("computed", C.bmi(primary_metric("weight"), primary_metric("height"))["result"])
    return rows.withColumn("gap", F.array_min(F.transform("stated_bmi", lambda b: F.abs(b - F.col("computed")))))


def q7_bmi(records: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Stated BMIs that are not the computed one, and uncertain BMI questions about notes that state one."""
    rows = stated_gaps(records)
    off = flags(rows, "Q7", "warn", F.when(F.col("gap") > tolerance, F.format_string("stated BMI is %.1f away from %.1f", "gap", "computed")))
    return off.unionByName(flags(rows, "Q7", "warn", F.when((F.col("answer_type") == "uncertain") & F.col("asks_bmi"), "uncertain, but the note states a BMI")))


def q7_gaps(records: DataFrame, tolerance: float = 0.5) -> DataFrame:
    bucket = F.when(F.col("gap") <= tolerance, "agrees").when(F.col("gap") < 1, "0.5-1").when(F.col("gap") < 2, "1-2").when(F.col("gap") < 5, "2-5").otherwise(">=5")
    return figures(stated_gaps(records).where("gap is not null").groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")), "Q7", "stated BMI and computed", F.col("b"), F.col("n"))


def uncertain_conflicts(records: DataFrame) -> DataFrame:
    """Uncertain records with `conflict`: what the input gives although the answer says it is missing; null if it is missing indeed."""
    rows = with_features(records.where("answer_type = 'uncertain'"), "measures", "allergy", "uncertain_class")
    rows = rows.withColumn("asked_drugs", N.question_drugs_of(F.col("question"), F.col("note")))
    given = lambda kind: F.exists("measures", lambda m: (m["kind"] == kind) & m["source"].isin("note", "table"))
    says = lambda kind: F.contains("uncertain_class", F.lit(kind)) & given(kind)
    body = F.col("uncertain_class").isin("height", "weight", "height_and_weight")
    conflict = (
        F.when(body & (says("height") | says("weight")), F.concat_ws(" and ", F.when(says("height"), "height"), F.when(says("weight"), "weight")))
        .when((F.col("uncertain_class") == "allergy") & F.col("allergy").isin("nkda", "documented"), F.concat(F.lit("allergies: "), "allergy"))
        .when((F.col("uncertain_class") == "dose") & F.exists("asked_drugs", lambda d: d["has_dose"]), "dose")
    )
    return rows.withColumn("conflict", conflict)


def q8_labels(records: DataFrame) -> DataFrame:
    return flags(uncertain_conflicts(records), "Q8", "warn", F.when(F.col("conflict").isNotNull(), F.concat(F.lit("said to be missing, but given: "), "conflict")))


def q8_decisions(records: DataFrame) -> DataFrame:
    """BMI questions: whether the tool was called or the answer is uncertain, by whether weight and height are both given."""
    rows = with_features(records, "measures", "asks_bmi").where(F.col("asks_bmi") & (called("calculate_bmi") | (F.col("answer_type") == "uncertain")))
    has = lambda kind: F.exists("measures", lambda m: m["kind"] == kind)
    counts = rows.groupBy("answer_type", (has("weight") & has("height")).alias("both")).agg(F.count(F.lit(1)).alias("n"))
    return figures(counts, "Q8", "BMI questions", F.concat("answer_type", F.when(F.col("both"), " with both").otherwise(" without")), F.col("n"))


def q9_answers(records: DataFrame, tolerance: float = 0.051) -> DataFrame:
    """Answers of calls that do not state the result."""
    said = F.transform(F.regexp_extract_all("answer", F.lit(ANSWER_NUMBER), F.lit(0)), C.parse_float)
    rows = calls(records).withColumn("said", F.coalesce(said, F.array().cast("array<double>")))
    return flags(rows, "Q9", "warn", F.when(~F.exists("said", lambda s: C.close(s, F.col("call.result"), tolerance)), F.concat(F.lit("answer lacks the result "), F.col("call.result").cast("string"))))


def q10_arithmetic(records: DataFrame) -> DataFrame:
    """Equations of numeric answers that don't hold, and amounts that are no difference of stated numbers."""
    cells = F.flatten(F.transform("table.rows", lambda r: F.slice(r, 2, F.greatest(F.size(r), F.lit(1)))))
    rows = records.where("answer_type = 'numeric_reasoning'").withColumns({"equations": A.equations_of(F.col("answer")), "amounts": A.amounts_of(F.col("answer"), F.col("question"), cells)})
    wrong = F.transform(F.filter("equations", lambda e: ~e["ok"]), lambda e: F.concat(F.lit("doesn't hold: "), e["text"]))
    loose = F.transform(F.filter("amounts", lambda a: ~a["ok"]), lambda a: F.concat(F.lit("no such difference: "), a["text"]))
    return each(rows, "Q10", "warn", F.concat(wrong, loose))


def q11_numbers(records: DataFrame) -> DataFrame:
    """Numbers of extractive answers that the input lacks; whether all of them are bounds of reference ranges in other tables."""
    of_rows = lambda keep: F.flatten(F.transform(F.flatten(F.transform("table.rows", keep)), C.numbers))
    bounds = records.where("table.type = 'labs'").select(F.explode(of_rows(lambda r: F.slice(r, 4, 1))).alias("x")).distinct()
    said = F.array_distinct(F.concat(C.numbers(F.col("note")), C.numbers(F.col("question")), F.coalesce(of_rows(lambda r: r), F.array().cast("array<double>"))))
    spoken = F.coalesce(F.transform(F.regexp_extract_all("answer", F.lit(ANSWER_NUMBER), F.lit(0)), C.parse_float), F.array().cast("array<double>"))
    rows = records.where("answer_type = 'extractive'").withColumn("said", said)
    rows = rows.withColumn("odd", F.filter(F.array_distinct(spoken), lambda x: ~F.exists("said", lambda y: C.close(x, y, 1e-9)))).where(F.size("odd") > 0)
    # The few odd numbers meet the bounds as rows, whatever the number of either.
    known = rows.select("split", "id", "ord", F.explode("odd").alias("x")).join(bounds.withColumn("known", F.lit(True)), "x", "left")
    kinds = known.groupBy("split", "id", "ord").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("bound"), F.sort_array(F.collect_set(F.col("x").cast("string"))).alias("x"))
    return flags(kinds, "Q11", "warn", F.concat(F.when(F.col("bound"), "bound of a range elsewhere: ").otherwise("not supported: "), F.array_join("x", ", ")))


def q12_conflicts(records: DataFrame) -> DataFrame:
    """Values that the note gives for a row of the table and that differ from it; the table's value at fewer places is no conflict."""
    rows = records.select("split", "id", "note", F.explode("table.rows").alias("r")).where(F.col("r")[0].isin(list(N.ANALYTES)))
    rows = rows.select("split", "id", F.col("r")[0].alias("name"), F.col("r")[1].alias("value"), N.analyte_values_of(F.col("note"), F.col("r")[0]).alias("said"))
    x = C.parse_float(F.col("value"))
    # Python's rounding of a binary number: to the nearest, which is not a tie but for exact halves.
    restated = lambda v: C.close(C.parse_float(v), F.rint(x * F.pow(F.lit(10.0), C.decimals(v))) / F.pow(F.lit(10.0), C.decimals(v)), 1e-9)
    same = lambda v: F.when(F.col("name") == "Blood Pressure", C.parse_bp(v).eqNullSafe(C.parse_bp(F.col("value")))).otherwise(F.coalesce(C.close(C.parse_float(v), x, 1e-9) | restated(v), F.lit(False)))
    bad = F.filter("said", lambda v: ~same(v))
    return flags(rows, "Q12", "warn", F.when(F.size(bad) > 0, F.concat("name", F.lit(": note "), F.array_join(bad, ", "), F.lit(", table "), "value")))


def q13_characters(records: DataFrame) -> DataFrame:
    """Micro signs in question or answer where the call's arguments have the Greek letter."""
    arguments = F.array_join(F.flatten(F.transform("tool_calls", lambda c: F.map_values(c["arguments"]))), " ")
    mixed = F.contains(arguments, F.lit("μ")) & (F.contains(F.coalesce("question", F.lit("")), F.lit("µ")) | F.contains(F.coalesce("answer", F.lit("")), F.lit("µ")))
    return flags(records, "Q13", "info", F.when(mixed, "U+00B5 in the text, U+03BC in arguments"))


def q13_inventory(records: DataFrame) -> DataFrame:
    """How often each look-alike character occurs in each field."""
    fields = {
        "note": F.col("note"), "question": F.col("question"), "answer": F.col("answer"), "table": F.array_join(F.flatten("table.rows"), " "),
        "tool_args": F.array_join(F.flatten(F.transform("tool_calls", lambda c: F.map_values(c["arguments"]))), " "),
    }
    sums = records.agg(*[F.sum(X.occurrences(F.coalesce(t, F.lit("")), c)).alias(f"{f}{k}") for f, t in fields.items() for k, c in enumerate(LOOKALIKES)])
    each_one = sums.select(F.explode(F.array(*[F.struct(F.lit(f"U+{ord(c):04X} {f}").alias("key"), F.col(f"{f}{k}").alias("n")) for f in fields for k, c in enumerate(LOOKALIKES)])).alias("s"))
    return figures(each_one.where("s.n > 0"), "Q13", "characters", F.col("s.key"), F.col("s.n"))


def q14_cells(records: DataFrame) -> DataFrame:
    """Values and reference ranges of tables that can't be read, and tables that are no usual panel."""
    cell = lambda r, k: F.coalesce(F.try_element_at(r, F.lit(k)), F.lit(""))
    pressure = lambda r: cell(r, 1) == "Blood Pressure"
    value = lambda r: F.when(F.when(pressure(r), C.parse_bp(cell(r, 2)).isNull()).otherwise(C.parse_float(cell(r, 2)).isNull()), F.concat(F.lit("unreadable value: "), cell(r, 1), F.lit(" "), cell(r, 2)))
    limits = lambda r: F.when((F.col("table.type") == "labs") & (F.size(r) > 3) & C.reference_range(cell(r, 4)).isNull(), F.concat(F.lit("unreadable range: "), cell(r, 1), F.lit(" "), cell(r, 4)))
    panel = F.array(F.when(F.col("panel").isin("mixed", "vitals+body"), F.concat(F.lit("no usual panel: "), "panel")))
    return each(with_features(records, "panel"), "Q14", "warn", F.concat(panel, F.transform("table.rows", value), F.transform("table.rows", limits)))


BOUNDARY = ["extractive", "numeric_reasoning"]


def q15_templates(records: DataFrame) -> DataFrame:
    """Records whose question template occurs as extractive and as numeric."""
    rows = records.where(F.col("answer_type").isin(BOUNDARY)).withColumn("t", X.mask_numbers(F.col("question")))
    shared = rows.groupBy("t").agg(F.countDistinct("answer_type").alias("kinds")).where("kinds > 1").select("t")
    return flags(rows.join(shared, "t", "left_semi"), "Q15", "info", F.concat(F.lit("template of both types, here "), "answer_type"))


def q15_wording(records: DataFrame) -> DataFrame:
    """Percent of questions of either type that ask for a range."""
    asks = F.regexp_like("question", F.lit(RANGE_WORDING))
    shares = records.where(F.col("answer_type").isin(BOUNDARY)).groupBy("answer_type").agg(F.round(100.0 * F.count_if(asks) / F.count(F.lit(1)), 1).alias("pct"))
    return figures(shares, "Q15", "percent that ask for a range", F.col("answer_type"), F.col("pct"))


def q16_plausible(records: DataFrame) -> DataFrame:
    """Hematocrit against hemoglobin, conditions of the other sex, and ages out of range."""
    value = lambda name: F.try_element_at(F.filter(F.transform("table.rows", lambda r: F.when(r[0] == name, C.parse_float(r[1]))), lambda x: x.isNotNull()), F.lit(-1))
    ratio = F.when((value("Hemoglobin") != 0) & (value("Hematocrit") != 0), value("Hematocrit") / value("Hemoglobin"))
    age, sex, like = F.col("age_sex.age"), F.col("age_sex.sex"), lambda p: F.coalesce(F.regexp_like("note", F.lit(p)), F.lit(False))
    return each(with_features(records, "age_sex"), "Q16", "info", F.array(
        F.when(~ratio.between(2.4, 3.6), F.format_string("hematocrit is %.2f of hemoglobin", ratio)), F.when((sex == "F") & like(MALE_ONLY), "male condition, female patient"),
        F.when((sex == "M") & like(FEMALE_ONLY), "female condition, male patient"), F.when((age < 18) | (age > 100), F.format_string("age %d", age)),
    ))


def q16_classes(records: DataFrame) -> DataFrame:
    """Notes with two drugs of one class, and notes that name a discrepancy themselves."""
    names = F.array_distinct(F.transform("drugs", lambda d: F.split(d["name"], r"\s+")[0]))
    found = F.array_compact(F.array(*[F.when(F.size(F.array_intersect(names, F.array(*map(F.lit, drugs)))) >= 2, name) for name, drugs in DRUG_CLASSES.items()]))
    rows = with_features(records, "drugs").select(F.explode(F.concat(found, F.array_compact(F.array(F.when(F.regexp_like("note", F.lit(SELF_ANNOTATED)), "(discrepancy named)"))))).alias("c"))
    return figures(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "Q16", "two drugs of a class", F.col("c"), F.col("n"))


def q17_length(records: DataFrame, most: int = 3) -> DataFrame:
    rows = with_features(records, "answer_sentences", "answer_words")
    return flags(rows, "Q17", "info", F.when(F.col("answer_sentences") > most, F.format_string("%d sentences, %d words", "answer_sentences", "answer_words")))


def q17_sentences(records: DataFrame) -> DataFrame:
    counts = with_features(records, "answer_sentences").groupBy("answer_type", F.least("answer_sentences", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return figures(counts, "Q17", "sentences", F.concat("answer_type", F.lit(" "), F.col("k").cast("string"), F.when(F.col("k") == 5, "+").otherwise("")), F.col("n"))


def overlaps(records: DataFrame, train: str = "train") -> DataFrame:
    """Records of other splits with kind (pair, note or null), hit and qa, as contamination gives them."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    hashed = records.select("split", "id", digest("note").alias("note"), digest("question").alias("question"), digest("answer").alias("answer"))
    found = R.contamination(hashed.where(F.col("split") == train), hashed.where(F.col("split") != train), ["note", "question"], "note", ["question", "answer"], "id")
    return found.join(hashed.where(F.col("split") != train).select("id", "split").distinct(), "id")


def q18_contamination(records: DataFrame, train: str = "train") -> DataFrame:
    detail = F.when(F.col("kind") == "pair", F.concat(F.lit("note and question of "), "hit")).when(F.col("kind") == "note", F.concat(F.lit("note of "), "hit"))
    return flags(overlaps(records, train), "Q18", "warn", detail)


def q18_counts(records: DataFrame, train: str = "train") -> DataFrame:
    """By split: records whose note and question, note, or question and answer are in the training split."""
    kinds = F.array_compact(F.array(F.when(F.col("kind") == "pair", "note+question"), F.when(F.col("kind") == "note", "note"), F.when(F.col("qa").isNotNull(), "question+answer")))
    counts = overlaps(records, train).select("split", F.explode(kinds).alias("k")).groupBy("split", "k").agg(F.count(F.lit(1)).alias("n"))
    return figures(counts, "Q18", "in the training split", F.concat_ws(" ", "split", "k"), F.col("n"))


def interaction_pairs(reference: DataFrame) -> DataFrame:
    """kind, pair (sorted), id of keys of two drugs."""
    parts = F.split("key", ":")
    return reference.where((parts[0] == "drug_interaction") & (F.size(parts) == 3)).select(F.array_sort(F.slice(parts, 2, 2)).alias("pair"), F.col("key").alias("id"))


def q19_reference(reference: DataFrame) -> DataFrame:
    """Keys of the reference table (key, category, value): repeated or odd ones, other categories, empty values, wrong numbers of drugs, pairs under several keys."""
    keyed = reference.select(F.lit("reference").alias("split"), F.col("key").alias("id"), "category", "value")
    prefix, parts = F.split("id", ":")[0], F.size(F.split("id", ":"))
    category = F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_OF_PREFIX.items() for x in pair]), prefix)
    problems = each(keyed, "Q19", "warn", F.array(
        F.when(~F.col("id").rlike(r"^[a-z0-9_]+(:[a-z0-9_]+)+$"), "odd key"), F.when(~category.eqNullSafe(F.col("category")), "category of another prefix"),
        F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "no value"), F.when((prefix == "drug_interaction") & (parts != 3), "not two drugs"),
    ))
    repeated = keyed.groupBy("split", "id").agg(F.count(F.lit(1)).alias("n"))
    pairs = interaction_pairs(reference).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).withColumn("split", F.lit("reference"))
    return problems.unionByName(flags(repeated, "Q19", "warn", F.when(F.col("n") > 1, "key occurs again"))).unionByName(flags(pairs, "Q19", "warn", F.when(F.col("n") > 1, "pair under several keys")))


def note_drugs(records: DataFrame) -> DataFrame:
    """split, id and drug (as in keys) of each different drug of a note."""
    key = lambda name: F.replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+inhaler$", ""), F.lit(" "), F.lit("_"))
    return with_features(records, "drugs").select("split", "id", F.explode(F.array_distinct(F.transform("drugs", lambda d: key(d["name"])))).alias("drug"))


def q19_coverage(records: DataFrame, reference: DataFrame, top: int = 20) -> DataFrame:
    """Notes by split that hold a pair of the reference, hits of each pair, and the drugs that it lacks most often."""
    drugs = note_drugs(records)
    known = interaction_pairs(reference).select("pair").distinct()
    hits = R.pairs_of(drugs.select(F.struct("split", "id").alias("of"), "drug"), "of", "drug").select("of", F.array("a", "b").alias("pair")).join(known, "pair")
    notes = hits.select("of").distinct().groupBy("of.split").agg(F.count(F.lit(1)).alias("n"))
    pairs = hits.groupBy(F.array_join("pair", ":").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    vocabulary = known.select(F.explode("pair").alias("drug")).distinct()
    lacks = drugs.join(vocabulary, "drug", "left_anti").groupBy("drug").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "drug").limit(top)
    out = figures(notes, "Q19", "notes with a pair", F.col("split"), F.col("n")).unionByName(figures(pairs, "Q19", "pairs", F.col("k"), F.col("n")))
    return out.unionByName(figures(lacks, "Q19", "drugs without a key", F.col("drug"), F.col("n")))


CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Q1": q1_schema, "Q2": q2_ids, "Q3": q3_duplicates, "Q4": q4_results, "Q5": q5_grounding, "Q6": q6_rounding, "Q7": q7_bmi, "Q8": q8_labels, "Q9": q9_answers,
    "Q10": q10_arithmetic, "Q11": q11_numbers, "Q12": q12_conflicts, "Q13": q13_characters, "Q14": q14_cells, "Q15": q15_templates, "Q16": q16_plausible,
    "Q17": q17_length, "Q18": q18_contamination,
}
#: Checks of the reference table, which has columns of its own.
REFERENCE_CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {"Q19": q19_reference}
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "empty cells": q1_empty_cells, "duplicates": q3_metrics, "sources": q5_patterns, "deltas": q6_deltas, "gaps": q7_gaps, "decisions": q8_decisions,
    "characters": q13_inventory, "wording": q15_wording, "classes": q16_classes, "sentences": q17_sentences, "overlaps": q18_counts,
}


def run_checks(records: DataFrame, names: list[str] | None = None, reference: DataFrame | None = None) -> DataFrame:
    """Flags of the named checks (all, if none is named) of records, and with a reference table of its checks."""
    found = [CHECKS[n](records) for n in names or CHECKS if n in CHECKS]
    found += [f(reference) for n, f in REFERENCE_CHECKS.items() if reference is not None and n in (names or REFERENCE_CHECKS)]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def summary(found: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per check: number of flags and status (the severity if there are any, else pass)."""
    spark = found.sparkSession
    listed = spark.createDataFrame([(n,) for n in names or [*CHECKS, *REFERENCE_CHECKS]], "check string")
    counts = found.groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"))
    return listed.join(counts, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("flags"), F.coalesce("severity", F.lit("pass")).alias("status"))


def validate(records: DataFrame) -> None:
    """Raises at the first structural problem or repeated id."""
    bad = q1_schema(records).unionByName(q2_ids(records).where("detail = 'id occurs again'")).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['split']} {bad[0]['id']}: {bad[0]['detail']}")
