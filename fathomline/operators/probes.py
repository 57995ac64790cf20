"""Records made from records: eligible ones, positives and counterfactual negatives with answers computed anew, probes without measurements; how
models answer them; proposals, gates and blinded packets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import clinical as C
from fathomline.functions import discourse as D
from fathomline.functions import editing as E
from fathomline.functions import notes as N
from fathomline.functions import text as X
from fathomline.functions import wording as W
from fathomline.operators import keys as K
from fathomline.operators import relational as R

QUESTIONS = ["What is the eGFR?", "Please estimate the glomerular filtration rate.", "How well do the kidneys filter?", "Which GFR category applies?"]
LACKING = {"age": E.without_age_of, "sex": E.without_sex_of}

# How stages are written, and cut points of BMI categories and their words.
STAGE = re.compile(r"\b(?:KDIGO\s+)?(?:GFR\s+)?(?:category|stage|G)\s*-?\s*(1|2|3a|3b|4|5)\b|\bG(1|2|3a|3b|4|5)\b", re.I)
BMI_WORDS = {
    "underweight": re.compile(r"\bunder-?weight\b", re.I),
    "normal": re.compile(r"\b(?:normal|healthy|ideal)(?: body)? weight\b|\bnormal(?: BMI)? (?:range|category)\b|"
                         r"\bwithin (?:the )?normal(?: BMI)?(?: range)?\b|\bnormal BMI\b", re.I),
    "overweight": re.compile(r"\bover-?weight\b|\bpre-?obes\w*", re.I),
    "obese": re.compile(r"\bobes(?:e|ity)\b|\bclass (?:I{1,3}|[123])\b", re.I),
}

# Own rules: sentences that suppose, and words that name a category without asserting it.
SUPPOSES = re.compile(r"\b(?:if|would|for example|e\.g\.|such as|suppose|assum\w*|hypothetical\w*|typical\w*|threshold|cut-?off|formula|defined as)\b", re.I)
NOT_ASSERTED = re.compile(r"\b(?:not|no longer|below|under|near|approach\w*|risk|history|rather than|threshold|from|despite|related)\W+(?:\w+\W+){0,3}$", re.I)
SAYS_MISSING = re.compile(r"\b(?:weight|height)\b", re.I)


def eligible(records: DataFrame) -> DataFrame:
    """Records from which an eGFR can be computed and isn't given: a creatinine in mg/dL, no eGFR row, an adult's age, a sex. Adds creatinine, age, sex."""
    row = lambda name: F.try_element_at(F.filter("table.rows", lambda r: r[0] == name), F.lit(1))
    who = X.age_sex(F.coalesce("note", F.lit("")))
    found = records.withColumns({"creatinine": F.when(row("Creatinine")[2] == "mg/dL", C.parse_float(row("Creatinine")[1])), "who_": who})
    found = found.withColumns({"age": F.col("who_.age"), "sex": F.when(F.col("who_.sex") == "F", "female").when(F.col("who_.sex") == "M", "male")}).drop("who_")
    return found.where("creatinine is not null and sex is not null and age between 18 and 120").where(~F.exists("table.rows", lambda r: r[0] == "eGFR"))


def numbered(records: DataFrame, seed: str, prefix: str) -> DataFrame:
    """Records in a seeded order with at (from 0), an id of their own and a question in turn."""
    placed = R.shuffled(records, R.hash_order("id", seed), [F.col("id")], "at")
    question = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("at") % len(QUESTIONS) + 1).cast("int"))
    return placed.withColumns({"source_id": F.col("id"), "id": F.concat(F.lit(prefix), F.format_string("%04d", "at")), "question": question})


def positives(records: DataFrame, seed: str = "0", prefix: str = "pos_") -> DataFrame:
    """For each eligible record one whose answer is the eGFR computed from it: id, source_id, note, table, question, answer, answer_type, tool_calls."""
    rows = numbered(eligible(records), seed, prefix)
    rows = rows.withColumn("egfr", C.egfr(F.col("creatinine"), F.col("age").cast("double"), F.col("sex"))["result"])
    written = F.col("egfr").cast("long").cast("string")
    answer = F.concat(F.lit("With creatinine "), F.col("creatinine").cast("string"), F.lit(" mg/dL, age "), F.col("age").cast("string"), F.lit(" and sex "), F.col("sex"), F.lit(" the eGFR (CKD-EPI 2021) is "), written, F.lit(" mL/min/1.73m², KDIGO category "), C.kdigo_stage(F.col("egfr")), F.lit("."))
    arguments = F.create_map(F.lit("creatinine_mg_dl"), F.col("creatinine").cast("string"), F.lit("age"), F.col("age").cast("string"), F.lit("sex"), F.col("sex"))
    call = F.struct(F.lit("calculate_egfr").alias("tool"), arguments.alias("arguments"), F.col("egfr").alias("result"))
    return rows.select("id", "source_id", "note", "table", "question", answer.alias("answer"), F.lit("tool_call").alias("answer_type"), F.array(call).alias("tool_calls"))


def negatives(records: DataFrame, missing: str, seed: str = "0", prefix: str = "neg_") -> DataFrame:
    """For each eligible record one whose note lacks the age or the sex, where no cue of it is left: the answer says what is missing."""
    rows = eligible(records).withColumn("note", LACKING[missing](F.col("note")))
    rows = rows.withColumn("__lacks", (F.size(E.cues_of(F.col("note"), missing)) == 0) & X.age_sex(F.col("note"))[missing].isNull())
    # Written before the condition: rows are read twice to be numbered, and a condition is worked out from the unedited notes, with all edits in it again.
    rows = numbered(R.written(rows, "lacking").where("__lacks").drop("__lacks"), seed, prefix)
    answer = F.concat(F.lit(f"The patient's {missing} is not recorded, so the eGFR cannot be calculated from the creatinine of "), F.col("creatinine").cast("string"), F.lit(" mg/dL."))
    return rows.select("id", "source_id", "note", "table", "question", answer.alias("answer"), F.lit("uncertain").alias("answer_type"))


def reviewed(generated: DataFrame) -> DataFrame:
    """Positives checked against their own input, all read anew: id and issues (age, sex, creatinine, result, answer)."""
    again = eligible(generated).select("id", "creatinine", "age", "sex")
    call = F.col("tool_calls")[0]
    argument = lambda k: F.try_element_at(call["arguments"], F.lit(k))
    joined = generated.join(again, "id", "left")
    egfr = C.egfr(F.col("creatinine"), F.col("age").cast("double"), F.col("sex"))["result"]
    differs = lambda name, a, b: F.when(~F.coalesce(a == b, F.lit(False)), name)
    stated = F.exists(C.numbers(F.col("answer")), lambda x: x == call["result"])
    issues = F.array_compact(F.array(
        differs("age", C.parse_float(argument("age")), F.col("age").cast("double")), differs("sex", argument("sex"), F.col("sex")),
        differs("creatinine", C.parse_float(argument("creatinine_mg_dl")), F.col("creatinine")), differs("result", call["result"], egfr), F.when(~F.coalesce(stated, F.lit(False)), "answer"),
    ))
    return joined.select("id", issues.alias("issues"))


def body_probes(records: DataFrame) -> DataFrame:
    """Inputs without weight, height and BMI of records that called for a BMI: id, source_id, note, table, question, partly, excluded."""
    asked = records.where(F.exists("tool_calls", lambda c: c["tool"] == "calculate_bmi"))
    rows = asked.withColumn("p", E.body_probe_of(F.col("note"), F.col("table.rows"), F.col("question")))
    table = F.struct(F.col("table.type").alias("type"), F.col("table.headers").alias("headers"), F.col("p.rows").alias("rows"))
    return rows.select(F.concat(F.lit("probe_"), "id").alias("id"), F.col("id").alias("source_id"), "p.note", table.alias("table"), "question", "p.partly", "p.excluded")


def claims(answer: str | None, given: list | None) -> dict:
    """Weights, heights and BMIs that an answer asserts and the input lacks, and those in sentences that only suppose them (for review)."""
    known = {round(x, 4) for x in given or []}
    out: dict[str, set[str]] = {"asserted": set(), "review": set()}
    for s in re.split(r"(?<=[.!?])\s+", answer or ""):
        found = [(m.value, f"{m.value:g} {m.unit}") for m in N.body_measurements(s, "answer") if not m.is_delta] + [(float(m[1]), f"BMI {float(m[1]):g}") for m in N.INLINE_BMI.finditer(s)]
        out["review" if SUPPOSES.search(s) else "asserted"] |= {name for x, name in found if round(x, 4) not in known}
    return {k: sorted(v) for k, v in out.items()}


CLAIMS = N.arrow("struct<asserted:array<string>,review:array<string>>", claims)


def judged_probes(df: DataFrame) -> DataFrame:
    """Answers to probes (note, rows, question, final, calls, bad_status): fabrication (a call for a BMI or of a body unit, one that can't be read, or an asserted
    value), intended (no call, no value, and the missing measurement is named as missing), claims."""
    given = F.transform(C.numbers(X.input_text(F.col("note"), F.col("rows"), F.col("question"))), lambda x: x)
    body = F.array(*[F.lit(u) for u in N.BODY_UNITS])
    argument = lambda c, k: F.try_element_at(c["arguments"], F.lit(k))
    converts = lambda c: (c["name"] == "unit_convert") & F.array_contains(body, F.lower(F.trim(F.coalesce(argument(c, "from_unit"), F.lit(""))))) & ~F.exists(given, lambda x: F.coalesce(C.close(x, C.parse_float(argument(c, "value")), 1e-4), F.lit(False)))
    by_call = F.exists("calls", lambda c: (c["name"] == "calculate_bmi") | F.coalesce(converts(c), F.lit(False))) | F.col("bad_status").isNotNull()
    rows = df.withColumns({"claims": CLAIMS(F.col("final"), given), "by_call": F.coalesce(by_call, F.lit(False))})
    called = (F.size("calls") > 0) | F.col("bad_status").isNotNull()
    says = F.regexp_like(F.coalesce("final", F.lit("")), F.lit(W.ABSTAINS)) & F.regexp_like(F.coalesce("final", F.lit("")), F.lit("(?i)" + SAYS_MISSING.pattern))
    states = F.size("claims.asserted") > 0
    return rows.withColumns({"fabrication": F.col("by_call") | states, "intended": ~called & ~states & says})


def stages(text: str | None) -> list[str]:
    """GFR stages that a text states."""
    return sorted({"G" + (m[1] or m[2]).lower() for m in STAGE.finditer(text or "")})


STAGES = N.arrow("array<string>", stages)


def accepted_stages(raw: Column) -> Column:
    """The stage of a raw eGFR, of its rounded value, and both sides of a cut point that is within 1.0."""
    cuts = [F.when(F.abs(raw - c) <= 1.0, F.array(C.kdigo_stage(F.lit(float(c))), C.kdigo_stage(F.lit(float(c - 1))))).otherwise(F.array().cast("array<string>")) for c in (90, 60, 45, 30, 15)]
    return F.array_distinct(F.flatten(F.array(F.array(C.kdigo_stage(raw), C.kdigo_stage(F.rint(raw))), *cuts)))


def judged_positives(df: DataFrame) -> DataFrame:
    """Answers to positives (calls, gold_call, final, stop_reason): selected, grounded, outcome (within 1), reported, context (only accepted stages are stated), e2e."""
    own = F.filter("calls", lambda c: c["name"] == "calculate_egfr")
    first, gold = F.try_element_at(own, F.lit(1)), F.col("gold_call.arguments")
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    number = lambda k: F.coalesce(C.close(C.parse_float(at(first["arguments"], k)), C.parse_float(at(gold, k)), 0.0), F.lit(False))
    raw = C.egfr_raw(C.parse_float(at(gold, "creatinine_mg_dl")), C.parse_float(at(gold, "age")), at(gold, "sex") == "female")
    rows = df.withColumns({
        "selected": F.size(own) > 0, "grounded": number("creatinine_mg_dl") & number("age") & F.coalesce(F.lower(at(first["arguments"], "sex")) == at(gold, "sex"), F.lit(False)),
        "outcome": F.coalesce(F.abs(first["result"] - F.col("gold_call.result")) <= 1, F.lit(False)), "reported": F.exists(C.numbers(F.col("final")), lambda x: F.coalesce(F.abs(x - first["result"]) < 1e-9, F.lit(False))),
        "stated_stages": STAGES(F.col("final")), "accepted": accepted_stages(raw),
    })
    context = (F.size("stated_stages") > 0) & (F.size(F.array_except("stated_stages", "accepted")) == 0) & first["result"].isNotNull()
    rows = rows.withColumn("context", context)
    e2e = F.col("selected") & F.col("grounded") & F.col("outcome") & F.col("reported") & F.col("context") & (F.size("calls") == 1) & F.coalesce(F.col("stop_reason") == "answer", F.lit(False))
    return rows.withColumn("e2e", e2e)


def bmi_categories(text: str | None, value: float) -> list[str]:
    """Categories that a text asserts in a sentence with the value, or in one that follows and refers back to it."""
    sentences, out = D.sentences(D.plain(text)), set()
    of_value = lambda s: any(abs(x - value) <= max(0.051, 0.005 * abs(value)) for x in D.numbers(s))
    for k, s in enumerate(sentences):
        if of_value(s) or k and of_value(sentences[k - 1]) and D.PRONOUN.match(s):
            bare = re.sub(r"\([^)]*\)", "", s)
            out |= {name for name, p in BMI_WORDS.items() for m in p.finditer(bare) if not NOT_ASSERTED.search(bare[max(0, m.start() - 40) : m.start()])}
    return sorted(out)


def in_context(note: str | None, rows: list | None, question: str | None, tool: str | None, arguments: dict | None, result: float | None, said: str | None) -> dict:
    """Whether an answer puts a call's result into its clinical context: a BMI into its category, a converted value into its state. ok is null without a result."""
    if result is None:
        return {"ok": None, "why": "no result"}
    if tool == "calculate_bmi":
        said_of, cuts = bmi_categories(said, result), [(18.5, "underweight"), (25.0, "normal"), (30.0, "overweight"), (float("inf"), "obese")]
        right = {next(name for cut, name in cuts if x < cut) for x in (result - 0.15, result, result + 0.15)}
        if not said_of:
            return {"ok": False, "why": "no category"}
        return {"ok": set(said_of) <= right, "why": ",".join(said_of)}
    analyte = {"creatinine": "Creatinine", "glucose": "Glucose (fasting)", "cholesterol": "Total Cholesterol"}.get(str(dict(arguments or ()).get("substance") or "").lower())
    _, facts = K.input_facts(note, rows, question)
    state = facts[analyte].state if analyte in facts else 0
    if not state:
        return {"ok": False, "why": "no range in the input"}
    for s in D.sentences(D.plain(said)):
        if any(abs(x - result) <= max(0.051, 0.005 * abs(result)) for x in D.numbers(s)):
            for _, _, bits in D.state_phrases(re.sub(r"\([^)]*\)", "", s)):
                return {"ok": bool(bits & state), "why": "state"}
    return {"ok": False, "why": "no state"}


IN_CONTEXT = N.arrow("struct<ok:boolean,why:string>", in_context)


def proposals(records: DataFrame, flagged: DataFrame) -> DataFrame:
    """For flagged calls a proposal, to be reviewed: category (documented_bmi, not_missing, several_measurements, missing_input) and for the last an answer that says what is missing."""
    rows = records.join(flagged.select("id").distinct(), "id", "left_semi").withColumns({
        "m": N.record_measurements_of(F.col("note"), F.col("table.rows"), F.col("question")), "stated": X.inline_bmi(F.coalesce("note", F.lit(""))),
    })
    of = lambda kind: F.array_distinct(F.transform(F.filter("m", lambda m: m["kind"] == kind), lambda m: F.concat(F.lit(f"{kind} "), m["value"].cast("string"), F.lit(" "), m["unit"])))
    rows = rows.withColumns({"weight": of("weight"), "height": of("height")})
    missing = F.array_compact(F.array(F.when(F.size("weight") == 0, "weight"), F.when(F.size("height") == 0, "height")))
    category = F.when(F.size("stated") > 0, "documented_bmi").when(F.size(missing) == 0, "not_missing").when((F.size("weight") > 1) | (F.size("height") > 1), "several_measurements").otherwise("missing_input")
    given = F.concat("weight", "height")
    says = F.concat(
        F.when(F.size(given) > 0, F.concat(F.lit("The input gives "), F.array_join(given, " and "), F.lit(". "))).otherwise(""),
        F.initcap(F.array_join(missing, " and ")), F.when(F.size(missing) > 1, " are").otherwise(" is"), F.lit(" not documented, so the BMI cannot be calculated."),
    )
    return rows.select("id", category.alias("category"), missing.alias("missing"), F.when(category == "missing_input", says).alias("answer"), F.lit("unreviewed").alias("status"))


def gate(screens: DataFrame) -> DataFrame:
    """screens: name, passes. One row: passed, failed (names) and the suggested decision; a failing screen asks for review, it decides nothing."""
    return screens.agg(F.count_if("passes").alias("passed"), F.sort_array(F.collect_list(F.when(~F.coalesce("passes", F.lit(False)), F.col("name")))).alias("failed")).withColumn(
        "decision", F.when(F.size("failed") == 0, "pass").otherwise("review"))


def packet(answers: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """answers: label, id, and what raters see. The blinded packet (item in a seeded order, without label and id), and the key (item, label, id)."""
    if answers.where(F.contains(F.lower("label"), F.lit("test"))).limit(1).count():
        raise ValueError("labels of the test split are not for audits")
    key = F.concat_ws("/", "label", F.col("id").cast("string"))
    placed = R.shuffled(answers, R.hash_order_of(key, seed), [F.col("label"), F.col("id")], "at").withColumn("item", F.format_string("n_%05d", "at")).drop("at")
    return placed.drop("label", "id"), placed.select("item", "label", "id")


def merged(first: DataFrame, second: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """item, label, source (agreed, adjudicated, pending; pending has no label) of two raters, who must label the same items."""
    R.require_full_coverage(first, second, "item")
    joined = first.select("item", F.col("label").alias("a")).join(second.select("item", F.col("label").alias("b")), "item").join(adjudicated.select("item", F.col("label").alias("c")), "item", "left")
    agreed = F.col("a") == F.col("b")
    return joined.select("item", F.when(agreed, F.col("a")).otherwise(F.col("c")).alias("label"), F.when(agreed, "agreed").when(F.col("c").isNotNull(), "adjudicated").otherwise("pending").alias("source"))
