"""Queries of readings, typed verdicts, edited and generated records, masks; on texts made of the tables, so that SQL knows what is in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import arithmetic as A
from fathomline.functions import clinical as C
from fathomline.functions import discourse as D
from fathomline.functions import editing as E
from fathomline.functions import notes as N
from fathomline.functions import text as X
from fathomline.functions import wording as W
from fathomline.operators import keys as K
from fathomline.operators import probes as P
from fathomline.operators import quality as Q
from fathomline.operators import relational as R
from fathomline.operators import scoring as V
from fathomline.operators import statistics as S
from fathomline.plans import cases
from fathomline.plans.cases import FLAGGED, RECORDS
from fathomline.plans.registry import query
from fathomline.sources import reports
from fathomline.sources.tables import read

TYPED = f"""CASE WHEN answer_type = 'tool_call' THEN CASE WHEN {FLAGGED} THEN 'called_without_inputs' WHEN fault = 7 THEN 'result_not_reported' END
  WHEN answer_type IN ('extractive', 'numeric_reasoning') AND n % 13 = 0 AND labs AND fault NOT IN (1, 12, 17) THEN 'status:not_stated' END"""
SCORED_ROWS = "answer_type <> 'other' AND NOT (answer_type = 'tool_call' AND NOT has_calls) AND NOT (kind = 'tool_call' AND answer_type <> 'tool_call')"


def typed(spark, sf_dir):
    rows = V.gold_rollout(cases.records(spark, sf_dir).where("answer_type <> 'other' and not (answer_type = 'tool_call' and tool_calls is null)"))
    return K.typed_score(rows)


@query(f"""{RECORDS} SELECT id, n AS ord, CASE WHEN answer_type = 'uncertain' OR answer_type = 'tool_call' AND ({FLAGGED}) THEN 'abstain' WHEN answer_type = 'tool_call' THEN 'call' ELSE 'answer' END AS expected, {TYPED} AS error,
  CASE WHEN answer_type IN ('extractive', 'numeric_reasoning') AND (fault IN (1, 17) OR NOT labs OR fault = 12) THEN 'text' ELSE 'structured' END AS coverage FROM r WHERE {SCORED_ROWS}""")
def typed_verdicts(spark, sf_dir):
    """Gold answers by typed keys: a gold answer fails where the record is at fault, or where it doesn't say what is asked."""
    return typed(spark, sf_dir).select("id", "ord", "typed.expected", "typed.error", "typed.coverage")


@query(f"""{RECORDS}, v AS (SELECT *, {TYPED} IS NULL AS ok, answer_type IN ('extractive', 'numeric_reasoning') AND NOT (fault IN (1, 17) OR NOT labs OR fault = 12) AS keyed FROM r WHERE {SCORED_ROWS})
SELECT CASE WHEN NOT keyed AND answer_type IN ('extractive', 'numeric_reasoning') THEN 'text' WHEN n % 13 = 0 THEN 'status' WHEN kind = 'extractive' THEN 'value' ELSE 'diff' END AS kind, count_if(ok)::BIGINT AS k, count(*)::BIGINT AS n
FROM v WHERE answer_type IN ('extractive', 'numeric_reasoning') GROUP BY 1""")
def typed_check_kinds(spark, sf_dir):
    checks = typed(spark, sf_dir).select(F.explode("typed.checks").alias("c"))
    return checks.groupBy("c.kind").agg(F.count_if("c.ok").alias("k"), F.count(F.lit(1)).alias("n"))


@query(f"""{RECORDS}, v AS (SELECT *, {TYPED} IS NULL AS ok, NOT (answer_type = 'tool_call' AND fault = 7) AS before, answer_type = 'tool_call' AND ({FLAGGED}) AS abstains FROM r WHERE {SCORED_ROWS}),
m AS (SELECT answer_type || ' now' AS metric, ok AS f FROM v UNION ALL SELECT answer_type || ' before', before FROM v UNION ALL SELECT 'expected ' || CASE WHEN abstains THEN 'abstain' ELSE 'call' END, ok FROM v WHERE answer_type = 'tool_call'
  UNION ALL SELECT 'name if called', true FROM v WHERE answer_type = 'tool_call' AND NOT abstains UNION ALL SELECT 'outcome if called', true FROM v WHERE answer_type = 'tool_call' AND NOT abstains)
SELECT metric, count_if(f)::BIGINT AS k, count(*)::BIGINT AS n, round(count_if(f)::DOUBLE / count(*), 4)::DOUBLE AS rate FROM m GROUP BY 1""")
def typed_rates(spark, sf_dir):
    """By type the typed verdict and the former one; calls by what was expected, and the steps of a call."""
    rows = V.score(typed(spark, sf_dir))
    scores = rows.select("answer_type", F.col("typed_correct").alias("correct"), F.col("correct").alias("before"), "typed.expected", "typed.checks", "typed.name_ok", "typed.outcome_ok")
    return S.typed_aggregate(scores, ("types",))


@query(f"""{RECORDS}, v AS (SELECT *, {TYPED} IS NULL AS ok, answer_type IN ('extractive', 'numeric_reasoning') AND NOT (fault IN (1, 17) OR NOT labs OR fault = 12) AS keyed FROM r WHERE {SCORED_ROWS})
SELECT 'check ' || CASE WHEN NOT keyed AND answer_type IN ('extractive', 'numeric_reasoning') THEN 'text' WHEN n % 13 = 0 THEN 'status' WHEN kind = 'extractive' THEN 'value' ELSE 'diff' END AS metric,
  count_if(ok)::BIGINT AS k, count(*)::BIGINT AS n, round(count_if(ok)::DOUBLE / count(*), 4)::DOUBLE AS rate FROM v WHERE answer_type IN ('extractive', 'numeric_reasoning') GROUP BY 1""")
def typed_rates_by_check(spark, sf_dir):
    """The rows of the typed aggregate by kind of check."""
    rows = V.score(typed(spark, sf_dir))
    scores = rows.select("answer_type", F.col("typed_correct").alias("correct"), F.col("correct").alias("before"), "typed.expected", "typed.checks", "typed.name_ok", "typed.outcome_ok")
    return S.typed_aggregate(scores, ("checks",))


# Answers about two analytes, made of orders: which is named, in which state it is said to be, and its number.
SAID = """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 4 AS form, round(o_totalprice / 1000, 1) AS x FROM orders)"""


def said(spark, sf_dir):
    form, x = F.col("o_orderkey") % 4, F.round(F.col("o_totalprice") / 1000, 1).cast("string")
    text = (
        F.when(form == 0, F.concat(F.lit("Sodium is "), x, F.lit(" mmol/L, which is above the upper limit. It is not low.")))
        .when(form == 1, F.concat(F.lit("The potassium of "), x, F.lit(" is within the normal range, but ALT is reduced.")))
        .when(form == 2, F.concat(F.lit("**Potassium** is not elevated at "), x, F.lit(". She has hyponatremia."))).otherwise(F.concat(F.lit("Sodium and ALT are normal. Potassium stands out most at "), x, F.lit(".")))
    )
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))


@query(SAID + """ SELECT k, CASE form WHEN 0 THEN 'Sodium=4' WHEN 1 THEN 'ALT=1,Potassium=2' WHEN 2 THEN 'Potassium=3,Sodium=1' ELSE 'ALT=2,Sodium=2' END AS states, CASE WHEN form = 0 THEN 'Sodium' ELSE 'Potassium' END AS owner, x::DOUBLE AS number,
  CASE WHEN form = 3 THEN 'Potassium' END AS most FROM a""")
def reading(spark, sf_dir):
    """States (1 low, 2 normal, 4 high), owner of the number, and what stands out."""
    rows = said(spark, sf_dir).select("k", D.read_of(F.col("text"), F.array(F.lit("Sodium"), F.lit("Potassium"), F.lit("ALT"))).alias("r"))
    states = F.array_sort(F.transform(F.map_entries("r.states"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    owned = F.map_entries("r.numbers")[0]
    return rows.select("k", F.array_join(states, ",").alias("states"), owned["key"].alias("owner"), owned["value"][0].alias("number"), F.try_element_at("r.most", F.lit(1)).alias("most"))


@query(SAID + """ SELECT k, CASE form WHEN 0 THEN 'Sodium@0' WHEN 1 THEN 'Potassium@4,ALT@' || (length(x::VARCHAR) + 50) WHEN 2 THEN 'Potassium@2' ELSE 'Sodium@0,ALT@11,Potassium@27' END AS mentions FROM a""")
def mentions(spark, sf_dir):
    found = D.mentions_of(F.col("text"), F.array(F.lit("Sodium"), F.lit("Potassium"), F.lit("ALT")))
    return said(spark, sf_dir).select("k", F.array_join(F.transform(found, lambda m: F.concat(m["name"], F.lit("@"), m["start"].cast("string"))), ",").alias("mentions"))


PHRASES = [
    ("The dose is not documented.", True, ""), ("It has been recorded at 12.", False, ""), ("The chart is silent on this; it is elevated.", True, "high"), ("N/A", True, ""), ("It isn't elevated, and is within normal limits.", False, "normal"),
    ("It is above the upper limit.", False, "high"), ("No information; low.", True, "low"), ("Both high and low values.", False, "high+low"), ("It can't be determined.", True, ""), ("hyperkalemia, WNL otherwise", False, "high+normal"),
]
PHRASE_ROWS = ", ".join("({}, '{}', {}, '{}')".format(k, t.replace("'", "''"), str(a).lower(), d) for k, (t, a, d) in enumerate(PHRASES))


@query(f"SELECT e.event_id, p.abstains, p.directions FROM events e JOIN (VALUES {PHRASE_ROWS}) p(k, t, abstains, directions) ON e.event_id % {len(PHRASES)} = p.k")
def wording(spark, sf_dir):
    """Whether a text abstains, and the directions that it asserts."""
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in PHRASES]), (F.col("event_id") % len(PHRASES) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", text.alias("text"))
    directions = N.arrow("string", lambda t: "+".join(sorted(W.directions(t))))
    return rows.select("event_id", F.regexp_like("text", F.lit(W.ABSTAINS)).alias("abstains"), directions(F.col("text")).alias("directions"))


@query(f"""{RECORDS} SELECT id, n AS ord, CASE n % 4 WHEN 0 THEN '9999 kg' WHEN 1 THEN CASE WHEN shared OR no_body THEN CASE WHEN imperial THEN lb::VARCHAR || ' lb' ELSE kg::VARCHAR || ' kg' END ELSE '' END ELSE '' END AS values FROM r WHERE fault <> 6""")
def fabricated(spark, sf_dir):
    """Weights that an answer states and the input lacks: a made-up one, the record's own (made up where the note lacks it), a hedged one, none."""
    rows = cases.fields(spark, sf_dir).where("fault <> 6")
    own = F.when(F.col("imperial"), F.concat(F.col("lb").cast("string"), F.lit(" lb"))).otherwise(F.concat(F.col("kg").cast("string"), F.lit(" kg")))
    form = F.col("n") % 4
    said = F.when(form == 0, "It is 9999 kg.").when(form == 1, F.concat(F.lit("It is "), own, F.lit("."))).when(form == 2, "Something such as 9999 kg.").otherwise("Unknown.")
    found = N.fabricated_of(F.col("note"), F.array().cast("array<array<string>>"), F.col("question"), F.lit("weight"), said)
    return rows.select("id", F.col("n").cast("long").alias("ord"), F.array_join(found, ",").alias("values"))


@query("SELECT p_partkey, (p_size + 2) * 3 - p_partkey::DOUBLE AS value, p_size % 3 = 1 AS false FROM part")
def evaluated(spark, sf_dir):
    """Expressions evaluated, and equations that don't hold."""
    part = read(spark, sf_dir, "part")
    expression = F.format_string("(%d + 2) × 3 - %d", "p_size", "p_partkey")
    claim = F.concat(F.lit("so "), F.col("p_size").cast("string"), F.lit(" + 2 = "), (F.col("p_size") + 2 + (F.col("p_size") % 3 == 1).cast("int")).cast("string"), F.lit("."))
    return part.select("p_partkey", A.evaluate_of(expression).alias("value"), (F.size(A.false_chains_of(claim)) > 0).alias("false"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '/80' END AS pressure, CASE p_partkey % 3 WHEN 1 THEN p_size + 0.5 END::DOUBLE AS fact, p_size::DOUBLE AS stated, 'mg/dl' AS unit FROM part")
def numbers_in_context(spark, sf_dir):
    """Pressures, numbers that are facts (not those of ranges and bounds), and units after numbers."""
    form, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.when(form == 0, F.concat(size, F.lit(" / 80"))).when(form == 1, F.concat(F.lit("It is "), size, F.lit(".5 (range 70-100), over 3"))).otherwise(F.concat(F.lit("<"), size))
    pressure = C.parse_bp(text)
    units = N.arrow("string", lambda t: V.with_units(t)[0][1])
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.concat(pressure["systolic"].cast("int").cast("string"), F.lit("/"), pressure["diastolic"].cast("int").cast("string")).alias("pressure"),
        F.when(form == 1, F.try_element_at(C.fact_numbers(text), F.lit(1))).alias("fact"), C.numbers(F.concat(size, F.lit(" mg/dL")))[0].alias("stated"), units(F.concat(size, F.lit(" mg/dL."))).alias("unit"),
    )


@query("SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'))) <= 60 THEN trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) ELSE rtrim(left(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')), 59)) || '…' END AS short FROM documents WHERE text IS NOT NULL")
def truncated(spark, sf_dir):
    """Whole texts in one line of a table: cutting them is what this does."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.truncate(F.col("text"), 60).alias("short"))


@query(f"{RECORDS} SELECT id, n AS ord, CASE WHEN NOT shared THEN stated END AS bmi, NOT shared AS medications, NOT shared AS hpi, NOT shared AS allergies, false AS labs, 'plain' AS style FROM r")
def note_parts(spark, sf_dir):
    rows = cases.records(spark, sf_dir).select("id", "ord", X.inline_bmi(F.col("note")).alias("b"), X.section_presence(F.col("note")).alias("s"), X.note_style(F.col("note")).alias("style"))
    return rows.select("id", "ord", F.try_element_at("b", F.lit(1)).alias("bmi"), F.col("s")["medications"].alias("medications"), F.col("s")["hpi"].alias("hpi"), F.col("s")["allergies"].alias("allergies"), F.col("s")["labs"].alias("labs"), "style")


@query(f"""{RECORDS} SELECT id, n AS ord, CASE WHEN shared THEN 'Shared note.' ELSE replace(note, age || '-year-old ', '') END AS no_age, CASE WHEN shared THEN 0 ELSE 1 END::INTEGER AS sex_cues,
  CASE WHEN shared THEN 'Shared note.' ELSE replace(note, CASE WHEN female THEN 'woman' ELSE 'man' END, 'patient') END AS no_sex FROM r""")
def edited_notes(spark, sf_dir):
    return cases.records(spark, sf_dir).select("id", "ord", E.without_age_of(F.col("note")).alias("no_age"), F.size(E.cues_of(F.col("note"), "sex")).alias("sex_cues"), E.without_sex_of(F.col("note")).alias("no_sex"))


EGFR = """round(142 * pow(least(cr / k, 1), a) * pow(greatest(cr / k, 1), -1.2::DOUBLE) * pow(0.9938::DOUBLE, age) * CASE WHEN female THEN 1.012 ELSE 1 END::DOUBLE)"""
ELIGIBLE = f", e AS (SELECT *, CASE WHEN female THEN 0.7 ELSE 0.9 END::DOUBLE AS k, CASE WHEN female THEN -0.241 ELSE -0.302 END::DOUBLE AS a FROM r WHERE labs AND NOT shared), g AS (SELECT *, {EGFR} AS egfr FROM e)"


@query(f"{RECORDS}{ELIGIBLE} SELECT id, n AS ord, cr AS creatinine, age::INTEGER AS age, CASE WHEN female THEN 'female' ELSE 'male' END AS sex FROM e")
def eligible_records(spark, sf_dir):
    return P.eligible(cases.records(spark, sf_dir)).select("id", "ord", "creatinine", "age", "sex")


@query(f"""{RECORDS}{ELIGIBLE}, p AS (SELECT *, row_number() OVER (ORDER BY sha256(id || '7'), id) - 1 AS place FROM g WHERE fault <> 2)
SELECT printf('pos_%04d', place) AS id, id AS source_id, egfr::DOUBLE AS result, 'With creatinine ' || cr || ' mg/dL, age ' || age || ' and sex ' || CASE WHEN female THEN 'female' ELSE 'male' END || ' the eGFR (CKD-EPI 2021) is ' || egfr::BIGINT
  || ' mL/min/1.73m², KDIGO category ' || CASE WHEN egfr >= 90 THEN 'G1' WHEN egfr >= 60 THEN 'G2' WHEN egfr >= 45 THEN 'G3a' WHEN egfr >= 30 THEN 'G3b' WHEN egfr >= 15 THEN 'G4' ELSE 'G5' END || '.' AS answer FROM p""")
def generated_positives(spark, sf_dir):
    rows = cases.records(spark, sf_dir).where("not startswith(id, 'odd')")
    return P.positives(rows, "7").select("id", "source_id", F.col("tool_calls")[0]["result"].alias("result"), "answer")


@query(f"{RECORDS}{ELIGIBLE} SELECT count(*)::BIGINT AS n, 0::BIGINT AS issues FROM e WHERE fault <> 2")
def generated_review(spark, sf_dir):
    """Positives, computed again from their own input."""
    rows = cases.records(spark, sf_dir).where("not startswith(id, 'odd')")
    return P.reviewed(P.positives(rows, "7")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("issues")).cast("long").alias("issues"))


@query(f"{RECORDS}{ELIGIBLE} SELECT id AS source_id, replace(note, CASE WHEN female THEN 'woman' ELSE 'man' END, 'patient') AS note, 'The patient''s sex is not recorded, so the eGFR cannot be calculated from the creatinine of ' || cr || ' mg/dL.' AS answer FROM e WHERE fault <> 2")
def generated_negatives(spark, sf_dir):
    return P.negatives(cases.records(spark, sf_dir).where("not startswith(id, 'odd')"), "sex").select("source_id", "note", "answer")


@query(f"""{RECORDS} SELECT id AS source_id, 'HPI' AS starts, true AS clean FROM r WHERE has_calls AND NOT converts AND NOT shared""")
def measurement_probes(spark, sf_dir):
    """Inputs without measurements: nothing of them is found any more."""
    rows = P.body_probes(cases.records(spark, sf_dir).where("note <> 'Shared note.'"))
    clean = F.col("excluded").isNull() & (F.size(N.body_measurements_of(F.col("note"))) <= 1) & ~F.contains("note", F.lit("BMI"))
    return rows.select("source_id", F.substring("note", 1, 3).alias("starts"), clean.alias("clean"))


@query(f"""{RECORDS} SELECT id, n AS ord, CASE WHEN result < 18.5 - 0.15 THEN 'underweight' WHEN result < 25 THEN 'normal' ELSE 'heavier' END AS band, n % 2 = 0 AND result BETWEEN 18.65 AND 24.85 AS ok FROM r
  WHERE has_calls AND NOT converts AND fault <> 7 AND (result < 18.35 OR result BETWEEN 18.65 AND 24.85 OR result > 25.15)""")
def clinical_context(spark, sf_dir):
    """Answers that call every BMI normal, or none anything."""
    rows = V.gold_rollout(cases.records(spark, sf_dir).where("tool_calls is not null and answer <> 'Done.'")).where("gold_call.tool = 'calculate_bmi'")
    rows = rows.withColumn("result", F.col("gold_call.result")).where("result < 18.35 or result between 18.65 and 24.85 or result > 25.15")
    said = F.when(F.col("ord") % 2 == 0, F.concat("final", F.lit(" This is in the normal range."))).otherwise(F.col("final"))
    judged = P.IN_CONTEXT(F.col("note"), F.col("rows"), F.col("question"), F.col("gold_call.tool"), F.col("gold_call.arguments"), F.col("result"), said)
    band = F.when(F.col("result") < 18.35, "underweight").when(F.col("result") < 25, "normal").otherwise("heavier")
    return rows.select("id", "ord", band.alias("band"), judged["ok"].alias("ok"))


@query(f"""{RECORDS}, f AS (SELECT * FROM r WHERE answer_type = 'tool_call' AND ({FLAGGED}) AND fault <> 2 AND NOT converts) SELECT id, CASE WHEN NOT shared AND stated IS NOT NULL THEN 'documented_bmi' WHEN NOT shared THEN 'not_missing' ELSE 'missing_input' END AS category,
  CASE WHEN shared THEN 'Weight And Height are not documented, so the BMI cannot be calculated.' END AS answer FROM f""")
def relabel_proposals(spark, sf_dir):
    rows = cases.records(spark, sf_dir).where("answer_type = 'tool_call' and tool_calls[0].tool = 'calculate_bmi' and not startswith(id, 'odd')")
    return P.proposals(rows, Q.q5_grounding(rows)).select("id", "category", "answer")


@query("""WITH s AS (SELECT event_type AS name, avg(value) < 50 AS passes FROM events WHERE event_type IS NOT NULL GROUP BY 1) SELECT count_if(passes)::BIGINT AS passed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT coalesce(passes, false)), '') AS failed,
  CASE WHEN count_if(NOT coalesce(passes, false)) = 0 THEN 'pass' ELSE 'review' END AS decision FROM s""")
def gate_decision(spark, sf_dir):
    screens = read(spark, sf_dir, "events").where("event_type is not null").groupBy(F.col("event_type").alias("name")).agg((F.avg("value") < 50).alias("passes"))
    return P.gate(screens).select("passed", F.array_join("failed", ",").alias("failed"), "decision")


@query("""WITH a AS (SELECT doc_id::VARCHAR AS item, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS a, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT item, CASE WHEN a = b THEN a WHEN item::BIGINT % 2 = 0 THEN 'good' END AS label, CASE WHEN a = b THEN 'agreed' WHEN item::BIGINT % 2 = 0 THEN 'adjudicated' ELSE 'pending' END AS source FROM a""")
def merged_raters(spark, sf_dir):
    """Two raters of the same items, and rulings on the even ones."""
    rows = read(spark, sf_dir, "labels").where("quality is not null and toxic is not null").withColumn("item", F.col("doc_id").cast("string"))
    first, second = rows.select("item", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label")), rows.select("item", F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("label"))
    return P.merged(first, second, rows.where("doc_id % 2 = 0").select("item", F.lit("good").alias("label")))


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY sha256(label || '/' || id || '5'), label, id) - 1 AS place FROM (SELECT source AS label, doc_id::VARCHAR AS id, n_chars FROM documents WHERE source IS NOT NULL))
SELECT printf('n_%05d', place) AS item, label, id::BIGINT AS id FROM p""")
def blinded_packet(spark, sf_dir):
    """The key of a blinded packet: which item is whose answer."""
    rows = read(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("label"), F.col("doc_id").alias("id"), "n_chars")
    return P.packet(rows, "5")[1].select("item", "label", "id")


@query("""WITH s AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: left(w, 6))) AS a, list_distinct(list_transform(regexp_extract_all(lower(lang || ' ' || source || ' document about'), '[a-z]{4,}'), lambda w: left(w, 6))) AS b FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, round(len(list_intersect(b, a))::DOUBLE / nullif(len(b), 0), 6)::DOUBLE AS recall FROM s""")
def stem_recall(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    return rows.select("doc_id", F.round(X.stem_recall(F.concat_ws(" ", "lang", "source", F.lit("document about")), F.col("text")), 6).alias("recall"))


@query("SELECT conv_id, turn, length(text) > 160 AS cut, replace(replace(left(text, 160), chr(10), ' '), '|', '\\|') || CASE WHEN length(text) > 160 THEN '…' ELSE '' END AS line FROM conversations WHERE text IS NOT NULL")
def snippets(spark, sf_dir):
    """One line a text, for reports: cutting is what this does."""
    return read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", (F.length("text") > 160).alias("cut"), reports.snippet("text").alias("line"))


@query("""SELECT c_custkey, c_mktsegment <> d AS changed FROM (SELECT *, lead(c_mktsegment) OVER (ORDER BY c_custkey) AS d FROM customer) WHERE d IS NOT NULL AND c_mktsegment <> d""")
def ordered_differences(spark, sf_dir):
    """Two views of the same order compared row by row, by digests: here a table and itself, moved by one."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    a = rows.select("c_custkey", R.row_digest(rows, "c_mktsegment").alias("d"))
    b = rows.select((F.col("c_custkey") - 1).alias("c_custkey"), R.row_digest(rows, "c_mktsegment").alias("e"))
    return a.join(b, "c_custkey").where("d <> e").select("c_custkey", F.lit(True).alias("changed"))


@query("""WITH m AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn) AS t, count_if(role = 'assistant') AS turns, sum(CASE WHEN role = 'assistant' THEN length(text) + 7 END) AS chars
  FROM conversations GROUP BY conv_id HAVING count_if(role IS NULL OR text IS NULL OR text = '' OR contains(text, '<|')) = 0 AND count_if(role = 'assistant') > 0) SELECT conv_id AS id, 1::INTEGER AS sequences, length(t)::INTEGER AS chars, chars::INTEGER AS labelled FROM m""")
def label_masks(spark, sf_dir):
    """Conversations as tokens with labels: characters of all tokens and of the labelled ones, by decoding them."""
    import public_tokenizers

    from fathomline.operators import masks

    turns = read(spark, sf_dir, "conversations")
    good = F.count_if(F.col("role").isNull() | F.col("text").isNull() | (F.col("text") == "") | F.contains("text", F.lit("<|"))) == 0
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"), good.alias("good"), F.count_if(F.col("role") == "assistant").alias("n"))
    talks = rows.where("good and n > 0").select(F.col("conv_id").alias("id"), F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = masks.encode(talks, path).where("error is null")
    decoded = N.arrow("int", lambda ids: len(_decoder(path).decode(ids, skip_special_tokens=False)))
    labels = F.filter("labels", lambda x: x != masks.IGNORED)
    return encoded.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("sequences"), F.first(decoded(F.col("ids"))).alias("chars"), F.first(decoded(labels)).alias("labelled"))


_DECODERS: dict = {}


def _decoder(path: str):
    if path not in _DECODERS:
        from fathomline.operators import masks

        _DECODERS[path] = masks.load(path)
    return _DECODERS[path]
