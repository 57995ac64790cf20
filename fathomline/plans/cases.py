"""Made-up question-answering records, one for each part, and queries of what is done with records.

Every field is an expression that Spark and DuckDB read alike, so the SQL beside a query works on the same values. `fault` plants one
kind of error in each 23rd record: what a check must find is known from the numbers, not from the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import notes as N
from fathomline.functions import tables
from fathomline.operators import quality as Q
from fathomline.operators import relational as R
from fathomline.operators import scoring as V
from fathomline.operators import statistics as S
from fathomline.operators import views
from fathomline.plans.registry import query
from fathomline.sources.tables import read, spread

FIELDS = {
    "n": "p_partkey",
    "ten": "CAST(floor(n / 10) AS BIGINT)",
    "fault": "n % 23",
    "split": "CASE WHEN n % 10 < 8 THEN 'train' WHEN n % 10 = 8 THEN 'val' ELSE 'test' END",
    "num": "CASE WHEN n % 10 < 8 THEN ten * 8 + n % 10 ELSE ten END",
    "id": "CASE WHEN fault = 2 THEN 'odd' || num ELSE split || '_' || num END",
    "kind": "CASE (ten + n) % 4 WHEN 0 THEN 'extractive' WHEN 1 THEN 'numeric_reasoning' WHEN 2 THEN 'tool_call' ELSE 'uncertain' END",
    "answer_type": "CASE WHEN fault = 3 THEN 'other' ELSE kind END",
    "labs": "n % 7 <> 0",
    "imperial": "n % 3 = 0",
    "female": "n % 2 = 0",
    "age": "CASE WHEN fault = 15 THEN 105 ELSE 20 + n % 70 END",
    "lb": "CAST(1204 + 20 * p_size AS DOUBLE) / 10",
    "kg": "round(lb * CAST(0.4536 AS DOUBLE), 1)",
    "inch": "CAST(605 + 10 * (n % 15) AS DOUBLE) / 10",
    "cm": "round(inch * CAST(2.54 AS DOUBLE), 1)",
    "bmi": "round(kg / pow(cm / 100, 2), 1)",
    "stated": "CASE WHEN n % 5 = 0 THEN bmi WHEN n % 5 = 1 THEN round(bmi + CAST(1.7 AS DOUBLE), 1) END",
    "gl": "CAST(7045 + 100 * (n % 120) AS DOUBLE) / 100",
    "diff": "round(gl - 100, 2)",
    "cr": "CAST(6 + p_size % 20 AS DOUBLE) / 10",
    "cr_note": "CASE WHEN fault = 10 THEN CAST(16 + p_size % 20 AS DOUBLE) / 10 ELSE cr END",
    "hb": "CAST(100 + 10 * (n % 8) AS DOUBLE) / 10",
    "hct": "CASE WHEN fault = 13 THEN hb * 5 ELSE hb * 3 END",
    "topic": "ten % 3",
    "no_body": "kind = 'uncertain' AND ten % 2 = 0",
    "shared": "fault = 17",
    "body_text": "CASE WHEN imperial THEN CAST(lb AS STRING) || ' lb, height ' || CAST(inch AS STRING) || ' in.' ELSE CAST(kg AS STRING) || ' kg, height ' || CAST(cm AS STRING) || ' cm.' END",
    "note": """CASE WHEN shared THEN 'Shared note.' ELSE 'HPI: ' || age || '-year-old ' || CASE WHEN female THEN 'woman' ELSE 'man' END || ', tired.'
      || CASE WHEN no_body THEN '' ELSE ' Weight ' || body_text END || CASE WHEN stated IS NOT NULL THEN ' BMI ' || CAST(stated AS STRING) || '.' ELSE '' END
      || CASE WHEN n % 11 = 0 THEN ' Weight loss of 50 lb.' ELSE '' END || CASE WHEN fault <> 14 THEN '' WHEN female THEN ' Enlarged prostate.' ELSE ' Recent pregnancy.' END
      || ' Creatinine ' || CAST(cr_note AS STRING) || ' mg/dL.' || chr(10) || 'Medications: metformin 500 mg daily, lisinopril' || CASE WHEN n % 4 = 0 THEN ' 10 mg' ELSE '' END
      || CASE WHEN n % 6 = 0 THEN ', losartan 50 mg' ELSE '' END || chr(10) || 'Allergies: ' || CASE n % 3 WHEN 0 THEN 'NKDA' WHEN 1 THEN 'penicillin' ELSE 'not documented' END END""",
    "converts": "kind = 'tool_call' AND n % 5 = 4",
    "question": """CASE WHEN fault = 1 THEN ' ' WHEN shared THEN 'Shared?' WHEN n % 13 = 0 AND kind IN ('extractive', 'numeric_reasoning') THEN 'Is the glucose normal?'
      WHEN kind = 'extractive' THEN 'What is the fasting glucose?' WHEN kind = 'numeric_reasoning' THEN 'By how much does the glucose exceed 100?'
      WHEN converts THEN 'Convert the creatinine to ' || CASE WHEN fault = 11 THEN 'µmol/L' ELSE 'umol/L' END || '.'
      WHEN kind = 'tool_call' OR topic = 0 THEN 'What is the BMI?' WHEN topic = 1 THEN 'What is the dose of lisinopril?' ELSE 'Any allergies?' END""",
    "arg_kg": "CASE WHEN fault = 6 THEN kg + 5 WHEN imperial AND n % 9 = 0 THEN round(kg + CAST(0.1 AS DOUBLE), 1) ELSE kg END",
    "again": "CASE WHEN converts THEN round(cr * CAST(88.42 AS DOUBLE), 2) ELSE round(arg_kg / pow(cm / 100, 2), 1) END",
    "result": "CASE WHEN fault = 5 THEN again + 1 ELSE again END",
    "answer": """CASE WHEN kind = 'extractive' THEN 'The fasting glucose is ' || CAST(gl AS STRING) || ' mg/dL.' || CASE WHEN fault = 9 THEN ' The bound is 777.' WHEN fault = 16 THEN ' It is. It is. It is. It is.' ELSE '' END
      WHEN kind = 'numeric_reasoning' THEN CAST(gl AS STRING) || ' - 100 = ' || CAST(CASE WHEN fault = 8 THEN diff + 1 ELSE diff END AS STRING) || '. It is off the limit by ' || CAST(abs(diff) AS STRING) || '.'
      WHEN kind = 'tool_call' THEN CASE WHEN fault = 7 THEN 'Done.' WHEN converts THEN 'It is ' || CAST(result AS STRING) || ' umol/L.' ELSE 'The BMI is ' || CAST(result AS STRING) || '.' END
      WHEN topic = 0 THEN 'Height and weight are not documented.' WHEN topic = 1 THEN 'The dose of lisinopril is not documented.' ELSE 'Allergies are not documented.' END""",
    "has_calls": "kind = 'tool_call' AND fault <> 4",
}


def fields_sql() -> str:
    """The fields in DuckDB: a select around a select for each, as later ones use earlier ones."""
    inner = "SELECT p_partkey, p_size FROM part"
    for name, expression in FIELDS.items():
        inner = f"SELECT *, {expression} AS {name} FROM ({inner})"
    return f"WITH r AS MATERIALIZED ({inner})"


RECORDS = fields_sql()


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"))
    for name, expression in FIELDS.items():
        out = out.withColumn(name, F.expr(expression))
    return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records; table and tool_calls are put together from the fields."""
    text = lambda c: F.col(c).cast("string")
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    bad = F.col("fault") == 12
    lab_rows = F.array(
        row("Glucose (fasting)", F.when(bad, "high").otherwise(text("gl")), "mg/dL", F.when(bad, "?").otherwise("70-100")), row("Creatinine", text("cr"), "mg/dL", "0.6-1.2"),
        row("Hemoglobin", text("hb"), "g/dL", "12-16"), row("Hematocrit", text("hct"), "%", "36-48"),
    )
    vital_rows = F.array(*[row(*cells) for cells in (("Blood Pressure", "120/80", "mmHg"), ("Heart Rate", "80", "bpm"), ("Temperature", "98.6", "°F"), ("Respiratory Rate", "16", "breaths/min"), ("SpO2", "98", "%"))])
    headers = F.when(F.col("labs") & (F.col("fault") == 18), row("Test", "Value")).when(F.col("labs"), row(*Q.HEADERS["labs"])).otherwise(row(*Q.HEADERS["vitals"]))
    table = F.struct(F.when(F.col("labs"), "labs").otherwise("vitals").alias("type"), headers.alias("headers"), F.when(F.col("labs"), lab_rows).otherwise(vital_rows).alias("rows"))
    body = F.create_map(F.lit("weight_kg"), text("arg_kg"), F.lit("height_cm"), text("cm"))
    unit = F.when(F.col("fault") == 11, "μmol/L").otherwise("umol/L")
    convert = F.create_map(F.lit("value"), text("cr"), F.lit("from_unit"), F.lit("mg/dL"), F.lit("to_unit"), unit, F.lit("substance"), F.lit("creatinine"))
    call = F.struct(F.when(F.col("converts"), "unit_convert").otherwise("calculate_bmi").alias("tool"), F.when(F.col("converts"), convert).otherwise(body).alias("arguments"), F.col("result").alias("result"))
    return fields(spark, sf_dir).select(
        "id", "split", F.col("n").cast("long").alias("ord"), "note", table.alias("table"), "question", "answer", "answer_type", F.when(F.col("has_calls"), F.array(call)).alias("tool_calls"),
    )


def flags_sql(check: str, severity: str, *cases: str) -> str:
    """Flags from SELECTs of split, id and detail."""
    return f"{RECORDS} SELECT '{check}' AS \"check\", '{severity}' AS severity, split, id, detail FROM ({' UNION ALL '.join(cases)}) WHERE detail IS NOT NULL"


def when(condition: str, detail: str) -> str:
    return f"SELECT split, id, {detail} AS detail FROM r WHERE {condition}"


@query(flags_sql("Q1", "error", when("fault = 1", "'no question'"), when("fault = 2", "'id of another split'"), when("fault = 3", "'unknown answer_type'"), when("fault = 18 AND labs", "'headers of another kind of table'"), when("fault = 18 AND labs", "'row and headers differ in length'"), when("has_calls <> (answer_type = 'tool_call')", "'calls and answer_type disagree'")))
def check_structure(spark, sf_dir):
    return Q.q1_schema(records(spark, sf_dir))


@query(flags_sql("Q2", "error", when("fault = 2", "'id is not split_number'"), "SELECT min(split), id, 'id occurs again' FROM r GROUP BY id HAVING count(*) > 1", "SELECT split, '*', 'numbers are not 0, 1, 2, ...' FROM r WHERE fault <> 2 GROUP BY split HAVING min(num) <> 0 OR max(num) <> count(*) - 1"))
def check_ids(spark, sf_dir):
    return Q.q2_ids(records(spark, sf_dir))


NEAR = """, w AS (SELECT id, split, regexp_extract_all(lower(note), '\\w+') AS t FROM r), sh AS (SELECT id, split, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS g FROM w),
p AS (SELECT id AS x, unnest(g) AS s FROM sh WHERE split = 'train'), u AS (SELECT id AS q, unnest(g) AS s FROM sh WHERE split <> 'train'),
h AS (SELECT q, x, count(*) AS hits FROM u JOIN p USING (s) GROUP BY q, x),
j AS (SELECT q, x, hits, len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS j FROM h JOIN sh a ON a.id = q AND a.split <> 'train' JOIN sh b ON b.id = x AND b.split = 'train'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY j DESC, hits DESC, x) AS place FROM j) WHERE place = 1)"""


@query(f"""{RECORDS}{NEAR} SELECT 'Q3' AS "check", 'warn' AS severity, split, id, detail FROM (
  SELECT split, id, CASE WHEN n <> first_n THEN 'same note and question as ' || first_id END AS detail FROM (SELECT *, min(n) OVER w AS first_n, first_value(id) OVER (w ORDER BY n) AS first_id FROM r WINDOW w AS (PARTITION BY split, note, question))
  UNION ALL SELECT r.split, r.id, printf('note much like that of %s (%.3f)', x, j) FROM best JOIN r ON r.id = q WHERE j >= 0.9) WHERE detail IS NOT NULL""")
def check_duplicates(spark, sf_dir):
    return Q.q3_duplicates(records(spark, sf_dir))


@query(f"""{RECORDS}{NEAR}, m AS (SELECT split, note, regexp_replace(note, '\\d+(?:\\.\\d+)?', '#', 'g') AS t FROM r), k AS (SELECT r.split, coalesce(j, 0)::DOUBLE AS j FROM r LEFT JOIN best ON q = id WHERE split <> 'train')
SELECT 'Q3' AS "check", metric, key, value::DOUBLE AS value FROM (
  SELECT 'notes used again' AS metric, split AS key, count_if(n > 1) AS value FROM (SELECT split, note, count(*) AS n FROM m GROUP BY ALL) GROUP BY split
  UNION ALL SELECT 'templates of notes', split, count(DISTINCT t) FROM m GROUP BY split
  UNION ALL SELECT 'notes with a template of train', split, count(*) FROM m WHERE split <> 'train' AND t IN (SELECT t FROM m WHERE split = 'train') GROUP BY split
  UNION ALL SELECT 'similarity to train', split || ' p' || unnest([50, 90, 99, 100]), round(unnest([quantile_disc(j, 0.5), quantile_disc(j, 0.9), quantile_disc(j, 0.99), max(j)]), 3) FROM k GROUP BY split)""")
def duplicate_figures(spark, sf_dir):
    """Notes used again, templates of notes and those shared with the training split, and the distribution of similarities to it."""
    return Q.q3_metrics(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT n, kind, value, unit, equivalent FROM (
  SELECT n, 'weight' AS kind, lb AS value, 'lb' AS unit, false AS equivalent FROM r UNION ALL SELECT n, 'weight', kg, 'kg', n % 3 <> 1 FROM r UNION ALL SELECT n, 'height', cm, 'cm', false FROM r)""")
def restated_measurements(spark, sf_dir):
    """Weights of the records written in two units, the second in parentheses, approximate or by itself: which restate the one before."""
    rows = fields(spark, sf_dir)
    lb, kg, cm = (F.col(c).cast("string") for c in ("lb", "kg", "cm"))
    second = F.when(F.col("n") % 3 == 0, F.concat(F.lit(" ("), kg, F.lit(" kg)"))).when(F.col("n") % 3 == 1, F.concat(F.lit("; "), kg, F.lit(" kg"))).otherwise(F.concat(F.lit(" (approx. "), kg, F.lit(" kg)")))
    text = F.concat(F.lit("Weight "), lb, F.lit(" lb"), second, F.lit(". Height "), cm, F.lit(" cm."))
    found = rows.select("n", F.explode(N.body_measurements_of(text)).alias("m"))
    return found.select("n", "m.kind", "m.value", "m.unit", "m.equivalent")


@query(flags_sql("Q4", "error", when("has_calls AND abs(again - result) > 1e-9", "'gives ' || again || ' and not ' || result")))
def check_results(spark, sf_dir):
    return Q.q4_results(records(spark, sf_dir))


@query(flags_sql("Q5", "error", when("has_calls AND NOT converts AND shared", "'not in the input: weight, height'"), when("has_calls AND NOT converts AND fault = 6", "'not in the input: weight'"), when("has_calls AND converts AND NOT labs AND fault IN (10, 17)", "'not in the input: value ' || cr")))
def check_grounding(spark, sf_dir):
    return Q.q5_grounding(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q5' AS "check", 'sources' AS metric, split || ' ' || CASE WHEN converts THEN 'value:' || CASE WHEN labs THEN 'table' WHEN fault IN (10, 17) THEN 'missing' ELSE 'note' END
  ELSE 'weight:' || CASE WHEN shared OR fault = 6 THEN 'missing' WHEN imperial THEN 'note/lb' ELSE 'note/kg' END || ' height:' || CASE WHEN shared THEN 'missing' WHEN imperial THEN 'note/in' ELSE 'note/cm' END END AS key,
  count(*)::DOUBLE AS value FROM r WHERE has_calls GROUP BY ALL""")
def grounding_patterns(spark, sf_dir):
    return Q.q5_patterns(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT "check", split, id, detail FROM (
  SELECT 'Q4' AS "check", split, id, 'gives ' || again || ' and not ' || result AS detail FROM r WHERE has_calls AND abs(again - result) > 1e-9
  UNION ALL SELECT 'Q5', split, id, CASE WHEN NOT converts AND shared THEN 'not in the input: weight, height' WHEN NOT converts AND fault = 6 THEN 'not in the input: weight' WHEN converts AND NOT labs AND fault IN (10, 17) THEN 'not in the input: value ' || cr END FROM r WHERE has_calls) WHERE detail IS NOT NULL""")
def checks_in_sql(spark, sf_dir):
    """Two checks called from SQL, over all records."""
    with tables.checks_in_sql(records(spark, sf_dir), ["Q4", "Q5"]) as session:
        return session.sql("SELECT `check`, split, id, detail FROM flags('Q4') UNION ALL SELECT `check`, split, id, detail FROM flags('Q5')")


@query(flags_sql("Q6", "info", when("has_calls AND NOT converts AND imperial AND n % 9 = 0 AND fault NOT IN (6, 17)", "'weight ' || lb || ' lb is ' || printf('%+.3f', round(lb * 0.4536::DOUBLE - arg_kg, 3)) || ' off after conversion'")))
def check_rounding(spark, sf_dir):
    return Q.q6_rounding(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q6' AS "check", 'BMI after exact conversion' AS metric, printf('%+.1f', round(round(round(lb * 0.4536::DOUBLE, 2) / pow(round(inch * 2.54::DOUBLE, 2) / 100, 2), 1) - result, 1) + 0.0::DOUBLE) AS key, count(*)::DOUBLE AS value
  FROM r WHERE has_calls AND NOT converts AND imperial AND fault NOT IN (6, 17) GROUP BY ALL""")
def rounding_deltas(spark, sf_dir):
    return Q.q6_deltas(records(spark, sf_dir))


GAP = "round(CASE WHEN imperial THEN lb * 0.4536::DOUBLE / pow(inch * 2.54::DOUBLE / 100, 2) ELSE kg / pow(cm / 100, 2) END, 1)"


@query(flags_sql("Q7", "warn", when(f"NOT shared AND NOT no_body AND abs(stated - {GAP}) > 0.5", f"printf('stated BMI is %.1f away from %.1f', abs(stated - {GAP}), {GAP})"), when("NOT shared AND stated IS NOT NULL AND answer_type = 'uncertain' AND topic = 0 AND fault <> 1", "'uncertain, but the note states a BMI'")))
def check_stated_bmi(spark, sf_dir):
    return Q.q7_bmi(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q7' AS "check", 'stated BMI and computed' AS metric, CASE WHEN g <= 0.5 THEN 'agrees' WHEN g < 1 THEN '0.5-1' WHEN g < 2 THEN '1-2' WHEN g < 5 THEN '2-5' ELSE '>=5' END AS key, count(*)::DOUBLE AS value
  FROM (SELECT abs(stated - {GAP}) AS g FROM r WHERE NOT shared AND NOT no_body AND stated IS NOT NULL) GROUP BY ALL""")
def stated_bmi_gaps(spark, sf_dir):
    return Q.q7_gaps(records(spark, sf_dir))


@query(flags_sql("Q8", "warn", when("answer_type = 'uncertain' AND NOT shared AND topic = 0 AND NOT no_body", "'said to be missing, but given: height and weight'"), when("answer_type = 'uncertain' AND NOT shared AND topic = 1 AND fault <> 1 AND n % 4 = 0", "'said to be missing, but given: dose'"), when("answer_type = 'uncertain' AND NOT shared AND topic = 2 AND n % 3 < 2", "'said to be missing, but given: allergies: ' || CASE n % 3 WHEN 0 THEN 'nkda' ELSE 'documented' END")))
def check_labels(spark, sf_dir):
    return Q.q8_labels(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q8' AS "check", 'BMI questions' AS metric, answer_type || CASE WHEN no_body THEN ' without' ELSE ' with both' END AS key, count(*)::DOUBLE AS value
  FROM r WHERE NOT shared AND fault <> 1 AND (has_calls AND NOT converts OR answer_type = 'uncertain' AND topic = 0) GROUP BY ALL""")
def bmi_decisions(spark, sf_dir):
    return Q.q8_decisions(records(spark, sf_dir))


@query(flags_sql("Q9", "warn", when("has_calls AND fault = 7", "'answer lacks the result ' || result")))
def check_answers(spark, sf_dir):
    return Q.q9_answers(records(spark, sf_dir))


@query(flags_sql("Q10", "warn", when("answer_type = 'numeric_reasoning' AND fault = 8", "'doesn''t hold: ' || gl || ' - 100 = ' || (diff + 1)")))
def check_arithmetic(spark, sf_dir):
    return Q.q10_arithmetic(records(spark, sf_dir))


@query(flags_sql("Q11", "warn", when("answer_type = 'extractive' AND (fault = 9 OR NOT labs OR fault = 12)", "'not supported: ' || array_to_string(list_sort(list_filter([CASE WHEN fault = 9 THEN '777.0' END, CASE WHEN NOT labs OR fault = 12 THEN gl::VARCHAR END], lambda x: x IS NOT NULL)), ', ')")))
def check_numbers(spark, sf_dir):
    return Q.q11_numbers(records(spark, sf_dir))


@query(flags_sql("Q12", "warn", when("labs AND fault = 10", "'Creatinine: note ' || cr_note || ', table ' || cr")))
def check_conflicts(spark, sf_dir):
    return Q.q12_conflicts(records(spark, sf_dir))


@query(flags_sql("Q13", "info", when("has_calls AND converts AND fault = 11", "'U+00B5 in the text, U+03BC in arguments'")))
def check_characters(spark, sf_dir):
    return Q.q13_characters(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q13' AS "check", 'characters' AS metric, key, value::DOUBLE AS value FROM (
  SELECT 'U+00B5 question' AS key, count_if(converts AND fault = 11) AS value FROM r UNION ALL SELECT 'U+03BC tool_args', count_if(has_calls AND converts AND fault = 11) FROM r
  UNION ALL SELECT 'U+00B0 table', count_if(NOT labs) FROM r) WHERE value > 0""")
def character_inventory(spark, sf_dir):
    return Q.q13_inventory(records(spark, sf_dir))


@query(flags_sql("Q14", "warn", when("labs", "'no usual panel: mixed'"), when("labs AND fault = 12", "'unreadable value: Glucose (fasting) high'"), when("labs AND fault = 12", "'unreadable range: Glucose (fasting) ?'")))
def check_cells(spark, sf_dir):
    return Q.q14_cells(records(spark, sf_dir))


SHARED_TEMPLATES = "(SELECT t FROM (SELECT regexp_replace(question, '[0-9]+([.][0-9]+)?', '#', 'g') AS t, answer_type FROM r WHERE answer_type IN ('extractive', 'numeric_reasoning')) GROUP BY t HAVING count(DISTINCT answer_type) > 1)"


@query(flags_sql("Q15", "info", when(f"answer_type IN ('extractive', 'numeric_reasoning') AND regexp_replace(question, '[0-9]+([.][0-9]+)?', '#', 'g') IN {SHARED_TEMPLATES}", "'template of both types, here ' || answer_type")))
def check_templates(spark, sf_dir):
    return Q.q15_templates(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q15' AS "check", 'percent that ask for a range' AS metric, answer_type AS key, round(100.0 * count_if(regexp_matches(question, '(?i)normal (reference )?range|reference range|above|below|elevated|abnormal')) / count(*), 1)::DOUBLE AS value
  FROM r WHERE answer_type IN ('extractive', 'numeric_reasoning') GROUP BY answer_type""")
def range_wording(spark, sf_dir):
    return Q.q15_wording(records(spark, sf_dir))


@query(flags_sql("Q16", "info", when("labs AND fault = 13", "'hematocrit is 5.00 of hemoglobin'"), when("fault = 14", "CASE WHEN female THEN 'male condition, female patient' ELSE 'female condition, male patient' END"), when("fault = 15", "'age 105'")))
def check_plausible(spark, sf_dir):
    return Q.q16_plausible(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q16' AS "check", 'two drugs of a class' AS metric, 'ACE inhibitor / ARB' AS key, count(*)::DOUBLE AS value FROM r WHERE NOT shared AND n % 6 = 0 HAVING count(*) > 0""")
def drug_classes(spark, sf_dir):
    return Q.q16_classes(records(spark, sf_dir))


@query(flags_sql("Q17", "info", when("kind = 'extractive' AND fault = 16", "'5 sentences, 14 words'")))
def check_length(spark, sf_dir):
    return Q.q17_length(records(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q17' AS "check", 'sentences' AS metric, answer_type || ' ' || CASE WHEN kind = 'extractive' AND fault = 16 THEN '5+' WHEN kind = 'extractive' AND fault = 9 OR kind = 'numeric_reasoning' THEN '2' ELSE '1' END AS key, count(*)::DOUBLE AS value FROM r GROUP BY ALL""")
def sentence_counts(spark, sf_dir):
    return Q.q17_sentences(records(spark, sf_dir))


@query(flags_sql("Q18", "warn", """SELECT a.split, a.id, CASE WHEN p.id IS NOT NULL THEN 'note and question of ' || p.id WHEN q.id IS NOT NULL THEN 'note of ' || q.id END AS detail FROM r a
  LEFT JOIN (SELECT note, question, max(id) AS id FROM r WHERE split = 'train' GROUP BY ALL) p ON a.note = p.note AND a.question = p.question LEFT JOIN (SELECT note, max(id) AS id FROM r WHERE split = 'train' GROUP BY ALL) q ON a.note = q.note WHERE a.split <> 'train'"""))  # fmt: skip
def check_contamination(spark, sf_dir):
    return Q.q18_contamination(records(spark, sf_dir))


# Reference entries made of nations, some with a wrong category, an odd key, or the pair turned round.
REFERENCE = """WITH e AS (SELECT n_nationkey AS k, lower(replace(n_name, ' ', '_')) AS a, 'lisinopril' AS b FROM nation),
f AS (SELECT CASE k % 5 WHEN 0 THEN 'drug_interaction:' || a || ':' || b WHEN 1 THEN 'drug_interaction:' || b || ':metformin' WHEN 2 THEN 'Guideline:' || a WHEN 3 THEN 'drug_interaction:' || a ELSE 'drug_interaction:metformin:' || b END AS key,
  CASE WHEN k % 5 = 2 THEN 'clinical_guideline' ELSE 'drug_interaction' END AS category, CASE WHEN k % 7 = 0 THEN ' ' ELSE 'x' END AS value FROM e)"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation_of_reference")
    return spark.sql(REFERENCE.replace("FROM nation", "FROM nation_of_reference") + " SELECT key, category, value FROM f")


@query(REFERENCE + """, p AS (SELECT list_sort([split_part(key, ':', 2), split_part(key, ':', 3)]) AS pair, key FROM f WHERE key LIKE 'drug_interaction:%:%')
SELECT 'Q19' AS "check", 'warn' AS severity, 'reference' AS split, id, detail FROM (SELECT key AS id, 'odd key' AS detail FROM f WHERE NOT regexp_full_match(key, '[a-z0-9_]+(:[a-z0-9_]+)+')
  UNION ALL SELECT key, 'category of another prefix' FROM f WHERE split_part(key, ':', 1) <> category UNION ALL SELECT key, 'no value' FROM f WHERE trim(value) = ''
  UNION ALL SELECT key, 'not two drugs' FROM f WHERE key LIKE 'drug_interaction:%' AND key NOT LIKE 'drug_interaction:%:%' UNION ALL SELECT key, 'key occurs again' FROM f GROUP BY key HAVING count(*) > 1
  UNION ALL SELECT min(key), 'pair under several keys' FROM p GROUP BY pair HAVING count(*) > 1)""")
def check_reference(spark, sf_dir):
    return Q.q19_reference(reference(spark, sf_dir))


@query(f"""{RECORDS} SELECT 'Q19' AS "check", metric, key, value FROM (SELECT 'notes with a pair' AS metric, split AS key, count(*)::DOUBLE AS value FROM r WHERE NOT shared GROUP BY split
  UNION ALL SELECT 'pairs', 'lisinopril:metformin', count(*)::DOUBLE FROM r WHERE NOT shared UNION ALL SELECT 'drugs without a key', 'losartan', count(*)::DOUBLE FROM r WHERE NOT shared AND n % 6 = 0)""")
def reference_coverage(spark, sf_dir):
    return Q.q19_coverage(records(spark, sf_dir), reference(spark, sf_dir))


@query(f"""{RECORDS} SELECT id, n AS ord, CASE WHEN labs THEN 'mixed' ELSE 'vitals' END AS panel, CASE WHEN shared THEN 'absent' WHEN n % 3 = 0 THEN 'nkda' WHEN n % 3 = 1 THEN 'documented' ELSE 'not_documented' END AS allergy,
  CASE WHEN NOT shared THEN age END::INTEGER AS age, CASE WHEN NOT shared THEN CASE WHEN female THEN 'F' ELSE 'M' END END AS sex, CASE WHEN shared OR no_body THEN 0 ELSE 2 END::INTEGER AS measures,
  CASE WHEN shared THEN 0 WHEN n % 6 = 0 THEN 3 ELSE 2 END::INTEGER AS drugs, CASE WHEN answer_type = 'uncertain' THEN CASE topic WHEN 0 THEN 'height_and_weight' WHEN 1 THEN 'dose' ELSE 'allergy' END END AS uncertain_class,
  CASE WHEN answer_type = 'numeric_reasoning' THEN CASE WHEN fault = 1 OR shared THEN 'other' WHEN n % 13 = 0 THEN 'threshold' ELSE 'difference' END END AS numeric_class, NOT shared AS has_medications, len(regexp_extract_all(note, '[^\\s]+'))::INTEGER AS note_words FROM r""")
def record_features(spark, sf_dir):
    rows = Q.with_features(records(spark, sf_dir))
    return rows.select(
        "id", "ord", "panel", "allergy", "age_sex.age", "age_sex.sex", F.size("measures").alias("measures"), F.size("drugs").alias("drugs"), "uncertain_class",
        F.array_join("numeric_classes", "+").alias("numeric_class"), F.element_at("sections", "medications").alias("has_medications"), "note_words",
    )


@query(f"""{RECORDS} SELECT id, n AS ord, unnest(CASE WHEN imperial THEN [lb, inch] ELSE [kg, cm] END) AS value, unnest(CASE WHEN imperial THEN ['lb', 'in'] ELSE ['kg', 'cm'] END) AS unit,
  unnest(CASE WHEN imperial THEN [lb * 0.4536::DOUBLE, inch * 2.54::DOUBLE] ELSE [kg, cm] END) AS metric, true AS labeled, false AS is_delta FROM r WHERE NOT shared AND NOT no_body
  UNION ALL SELECT id, n, 50.0, 'lb', 50 * 0.4536::DOUBLE, true, true FROM r WHERE NOT shared AND n % 11 = 0""")
def body_measurements(spark, sf_dir):
    from fathomline.functions import clinical as C

    found = records(spark, sf_dir).select("id", "ord", F.explode(N.body_measurements_of(F.col("note"))).alias("m"))
    return found.select("id", "ord", "m.value", "m.unit", C.to_metric(F.col("m.value"), F.col("m.unit")).alias("metric"), "m.labeled", "m.is_delta")


@query(f"""{RECORDS} SELECT id, n AS ord, unnest(['metformin', 'lisinopril', 'losartan'][:CASE WHEN n % 6 = 0 THEN 3 ELSE 2 END]) AS name, unnest([true, n % 4 = 0, true][:CASE WHEN n % 6 = 0 THEN 3 ELSE 2 END]) AS has_dose FROM r WHERE NOT shared""")
def medications(spark, sf_dir):
    return records(spark, sf_dir).select("id", "ord", F.explode(N.medications_of(F.col("note"))).alias("d")).select("id", "ord", "d.name", "d.has_dose")


@query(f"{RECORDS} SELECT id, n AS ord, cr_note AS value FROM r WHERE NOT shared")
def analyte_values(spark, sf_dir):
    found = records(spark, sf_dir).select("id", "ord", F.explode(N.analyte_values_of(F.col("note"), F.lit("Creatinine"))).alias("v"))
    return found.select("id", "ord", F.col("v").cast("double").alias("value"))


# Rollouts: the gold answer, an empty one, a refusal, a wrong number, too many numbers, or a call that goes wrong.
ROLLOUT = "n % 6"


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records joined with made-up rollouts."""
    gold = V.gold_rollout(records(spark, sf_dir)).withColumn("way", F.col("ord") % 6)
    said = F.when(F.col("way") == 1, "").when(F.col("way") == 2, "It is not documented.").when(F.col("way") == 3, "It is 9999.").when(F.col("way") == 4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15").otherwise(F.col("final"))
    return gold.withColumns({"final": said, "calls": F.when(F.col("way") == 5, F.concat("calls", "calls")).otherwise(F.col("calls"))})


ERROR = f"""CASE WHEN answer_type = 'tool_call' THEN CASE WHEN NOT has_calls THEN CASE WHEN {ROLLOUT} = 2 THEN 'no_call_abstained' ELSE 'no_call' END WHEN {ROLLOUT} = 5 THEN 'extra_call'
    WHEN {ROLLOUT} IN (1, 2, 3) OR fault = 7 THEN 'result_not_in_answer' WHEN {ROLLOUT} = 4 THEN CASE WHEN result BETWEEN 1 AND 15 AND result = floor(result) THEN NULL ELSE 'result_not_in_answer' END END
  WHEN {ROLLOUT} = 1 THEN 'no_answer_answer'
  WHEN answer_type = 'uncertain' THEN CASE {ROLLOUT} WHEN 2 THEN 'missing_field_not_named' WHEN 3 THEN 'no_abstention' WHEN 4 THEN 'no_abstention' END
  WHEN {ROLLOUT} = 4 THEN 'number_dump' WHEN answer_type IN ('extractive', 'numeric_reasoning') AND {ROLLOUT} = 2 THEN 'over_refusal' WHEN answer_type = 'numeric_reasoning' AND {ROLLOUT} = 3 THEN 'number_mismatch'
  WHEN answer_type = 'extractive' AND {ROLLOUT} = 3 THEN CASE WHEN labs AND fault <> 12 THEN 'number_mismatch' ELSE 'low_overlap' END END"""


@query(f"{RECORDS} SELECT id, n AS ord, answer_type, {ERROR} AS error, {ERROR} IS NULL AS correct, {ROLLOUT} = 2 OR {ROLLOUT} IN (0, 5) AND kind = 'uncertain' AS abstained FROM r WHERE answer_type <> 'other'")
def verdicts(spark, sf_dir):
    return V.score(rollouts(spark, sf_dir).where("answer_type <> 'other'")).select("id", "ord", "answer_type", "error", "correct", "abstained")


@query(f"{RECORDS} SELECT id, n AS ord, CASE WHEN has_calls AND fault <> 7 AND answer_type = 'tool_call' OR answer_type IN ('extractive', 'numeric_reasoning', 'uncertain') THEN NULL ELSE CASE WHEN has_calls THEN 'result_not_in_answer' ELSE 'no_call' END END AS error FROM r WHERE answer_type <> 'other'")
def gold_verdicts(spark, sf_dir):
    """The gold answers as if a model had given them: only records without a call, or whose answer lacks the result, are wrong."""
    return V.score(V.gold_rollout(records(spark, sf_dir).where("answer_type <> 'other'"))).select("id", "ord", "error")


@query(f"""{RECORDS}, v AS (SELECT answer_type, {ERROR} IS NULL AS ok FROM r WHERE answer_type <> 'other'), t AS (SELECT answer_type, count_if(ok) AS k, count(*) AS n, count_if(ok)::DOUBLE / count(*) AS p FROM v GROUP BY answer_type),
w AS (SELECT *, 1 + 1.96 * 1.96 / n::DOUBLE AS d, p + 1.96 * 1.96 / (2 * n::DOUBLE) AS c, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n::DOUBLE * n)) AS h FROM t)
SELECT answer_type, k::BIGINT AS k, n::BIGINT AS n, round(p, 4)::DOUBLE AS rate, round(greatest(0, (c - h) / d), 4)::DOUBLE AS low, round(least(1, (c + h) / d), 4)::DOUBLE AS high FROM w""")
def verdict_rates(spark, sf_dir):
    """Rates by answer type with clamped bounds."""
    scored = V.score(rollouts(spark, sf_dir).where("answer_type <> 'other'"))
    r = S.rate(F.col("correct"))
    rows = scored.groupBy("answer_type").agg(r["k"].alias("k"), r["n"].alias("n"), r["rate"].alias("rate"))
    return rows.withColumn("w", S.wilson(F.col("k"), F.col("n"), clamp=True)).select("answer_type", "k", "n", "rate", "w.low", "w.high")


FLAGGED = "has_calls AND NOT converts AND (shared OR fault = 6) OR has_calls AND converts AND NOT labs AND fault IN (10, 17)"


def reviewed(spark, sf_dir):
    """Training records, ids that the grounding check flags there, and a decision for each: relabelled or dropped."""
    train = records(spark, sf_dir).where("split = 'train' and answer_type = 'tool_call'")
    flagged = Q.q5_grounding(train).select("id").distinct()
    odd = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 2 == 1
    review = flagged.select("id", F.when(odd, "drop").otherwise("relabel").alias("decision"), F.lit("It is not documented.").alias("answer"), F.lit("uncertain").alias("answer_type"))
    additions = records(spark, sf_dir).where("split = 'val' and answer_type = 'tool_call'")
    return train, flagged, review, additions


@query(f"""{RECORDS}, t AS (SELECT *, {FLAGGED} AS bad FROM r WHERE split = 'train' AND answer_type = 'tool_call')
SELECT id, n AS ord, answer, answer_type FROM t WHERE NOT bad""")
def view_filtered(spark, sf_dir):
    return views.build(*reviewed(spark, sf_dir), "filtered").select("id", "ord", "answer", "answer_type")


@query(f"""{RECORDS}, t AS (SELECT *, {FLAGGED} AS bad FROM r WHERE split = 'train' AND answer_type = 'tool_call')
SELECT id, n AS ord, CASE WHEN bad THEN 'It is not documented.' ELSE answer END AS answer, CASE WHEN bad THEN 'uncertain' ELSE answer_type END AS answer_type, NOT bad AS has_calls FROM t WHERE NOT bad OR num % 2 = 0
UNION ALL SELECT id, n + (SELECT max(n) FROM t) + 1, answer, answer_type, true FROM r WHERE split = 'val' AND answer_type = 'tool_call' AND has_calls
UNION ALL SELECT id, n + (SELECT max(n) FROM t) + 1, answer, answer_type, false FROM r WHERE split = 'val' AND answer_type = 'tool_call' AND NOT has_calls""".replace("NOT bad AS has_calls", "NOT bad AND fault <> 4 AS has_calls"))
def view_relabelled(spark, sf_dir):
    return views.build(*reviewed(spark, sf_dir), "relabelled_with_additions").select("id", "ord", "answer", "answer_type", F.col("tool_calls").isNotNull().alias("has_calls"))


@query(f"""{RECORDS}, t AS (SELECT *, {FLAGGED} AS bad FROM r WHERE split = 'train' AND answer_type = 'tool_call'), x AS (SELECT * FROM r WHERE split = 'val' AND answer_type = 'tool_call')
SELECT 'raw' AS variant, id, n AS ord, answer, answer_type FROM t UNION ALL SELECT 'with_additions', id, n, answer, answer_type FROM t UNION ALL SELECT 'with_additions', id, n + (SELECT max(n) FROM t) + 1, answer, answer_type FROM x
UNION ALL SELECT 'relabelled', id, n, CASE WHEN bad THEN 'It is not documented.' ELSE answer END, CASE WHEN bad THEN 'uncertain' ELSE answer_type END FROM t WHERE NOT bad OR num % 2 = 0""")
def other_views(spark, sf_dir):
    """The three variants beside filtered and relabelled with additions."""
    tables, out = reviewed(spark, sf_dir), None
    for variant in ("raw", "with_additions", "relabelled"):
        one = views.build(*tables, variant).select(F.lit(variant).alias("variant"), "id", "ord", "answer", "answer_type")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{RECORDS}, t AS (SELECT *, {FLAGGED} AS bad FROM r WHERE split = 'train' AND answer_type = 'tool_call')
SELECT id, CASE WHEN num % 2 = 0 THEN 'changed' ELSE 'missing' END AS state FROM t WHERE bad""")
def view_audit(spark, sf_dir):
    """The relabelled view against the raw one: what was changed and what is missing."""
    tables = reviewed(spark, sf_dir)
    return views.audit(views.build(*tables, "relabelled"), views.build(*tables, "raw"))


@query(f"{RECORDS} SELECT id, note, question, 1 + CASE WHEN labs THEN 3 ELSE 4 END::INTEGER AS rows FROM r WHERE split = 'test'")
def inference_view(spark, sf_dir):
    """What a model gets to see of a record: no answer, type or calls."""
    return views.without_gold(records(spark, sf_dir).where("split = 'test'")).select("id", "note", "question", F.size("table.rows").alias("rows"))


@query(f"{RECORDS} SELECT id, answer, answer_type, CASE WHEN has_calls THEN CASE WHEN converts THEN 'unit_convert' ELSE 'calculate_bmi' END END AS tool FROM r WHERE split = 'test'")
def gold_sidecar(spark, sf_dir):
    """The gold side of records, by id."""
    return views.sidecar(records(spark, sf_dir).where("split = 'test'")).select("id", "answer", "answer_type", F.col("tool_calls")[0]["tool"].alias("tool"))


@query(f"{RECORDS} SELECT split, count(*)::BIGINT AS n, count(DISTINCT note)::BIGINT AS notes FROM r WHERE id IN (SELECT id FROM r WHERE split <> 'train') AND split <> 'train' GROUP BY split")
def known_ids(spark, sf_dir):
    """Records of other splits by a list of their ids."""
    rows = records(spark, sf_dir).where("split <> 'train'")
    return rows.join(rows.select("id").distinct(), "id", "left_semi").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(R.row_digest(rows, "note")).alias("notes"))
