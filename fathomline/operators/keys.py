"""Typed answer keys: what an answer must state, worked out from question and input, and whether it does.

A question is cut into clauses; the first rule that fits a clause gives its check: value, diff, ratio, pct, bmi, status, entity (which stands
out), set (which are in a state), yesno, and text where nothing else fits. Checks compare an answer's reading with the input, not with
the gold answer's words. The rules are this engine's own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import discourse as D
from fathomline.functions import notes as N
from fathomline.functions import wording as W
from fathomline.functions.arithmetic import false_chains
from fathomline.operators import scoring as V

# Ranges of vital signs, usual ranges of laboratory values, and bands within which an answer's number counts.
VITAL_RANGES = {"Heart Rate": (60.0, 100.0), "Respiratory Rate": (12.0, 20.0), "SpO2": (95.0, None), "Temperature": (97.0, 100.3)}
USUAL_RANGES = {
    "Creatinine": "0.7-1.3", "BUN": "7-20", "eGFR": ">60", "Uric Acid": "3.5-7.2", "Calcium": "8.5-10.5", "Phosphorus": "2.5-4.5", "TSH": "0.27-4.20", "Free T4": "0.93-1.70",
    "Free T3": "2.0-4.4", "Serum Iron": "60-170", "TIBC": "250-370", "Ferritin": "12-300", "Transferrin Saturation": "20-50", "PT": "11.0-13.5", "INR": "0.8-1.1", "aPTT": "25-35",
    "D-dimer": "<500", "ALT": "7-56", "AST": "10-40", "Alkaline Phosphatase": "44-147", "Total Bilirubin": "0.1-1.2", "Albumin": "3.5-5.5", "Total Protein": "6.0-8.3", "WBC": "4.5-11.0",
    "Hemoglobin": "12.0-17.5", "Hematocrit": "36-51", "Platelets": "150-400", "Total Cholesterol": "<200", "LDL": "<100", "HDL": ">40", "Triglycerides": "<150", "HbA1c": "<5.7",
    "Glucose (fasting)": "70-100", "Sodium": "136-145", "Potassium": "3.5-5.0",
}
BANDS = {"diff": (0.051, 0.005), "ratio": (0.051, 0.05), "pct": (0.51, 0.05), "bmi": (0.15, 0.0)}

KINDS = {"abnormal": D.LOW | D.HIGH, "high": D.HIGH, "low": D.LOW, "normal": D.NORMAL}
CLAUSE = re.compile(r"\?\s*|;\s*|,?\s+and\s+(?=(?:which|what|is|are|does|do|by|how|if|whether|can|was|were)\b)", re.I)


@dataclass
class Fact:
    """A value of the input with its range."""

    name: str
    raw: str
    value: float | None = None
    low: float | None = None
    high: float | None = None
    low_strict: bool = False
    high_strict: bool = False

    def __post_init__(self):
        self.value = N.plain_float(self.raw.partition("/")[0])

    def within(self, text: str | None) -> Fact:
        """This fact with the range that a text gives; the usual one of a vital sign if it gives none."""
        text = (text or "").strip()
        if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)", text):
            self.low, self.high = float(m[1]), float(m[2])
        elif m := re.fullmatch(r"(<=|>=|<|>|≤|≥)\s*(\d+(?:\.\d+)?)", text):
            upper = m[1] in ("<", "<=", "≤")
            self.low, self.high = (None, float(m[2])) if upper else (float(m[2]), None)
            self.low_strict, self.high_strict = m[1] == ">", m[1] == "<"
        elif self.name in VITAL_RANGES:
            self.low, self.high = VITAL_RANGES[self.name]
        return self

    @property
    def state(self) -> int:
        """Its state as bits; 0 if it can't be told."""
        if self.value is None or self.low is None and self.high is None:
            return 0
        if self.high is not None and (self.value > self.high or self.high_strict and self.value == self.high):
            return D.HIGH
        if self.low is not None and (self.value < self.low or self.low_strict and self.value == self.low):
            return D.LOW
        return D.NORMAL

    @property
    def deviation(self) -> float:
        """How many times its bound (or its bound how many times it) it is; 0 inside the range."""
        if self.state == D.HIGH and self.high:
            return self.value / self.high
        return self.low / self.value if self.state == D.LOW and self.value else 0.0


def input_facts(note: str | None, rows: list | None, question: str | None) -> tuple[dict[str, Fact], dict[str, Fact]]:
    """Facts of the table; and all, with values stated in the question, and those of the note that aren't ambiguous."""
    table = {r[0]: Fact(r[0], r[1] or "").within(r[3] if len(r) > 3 else None) for r in rows or [] if r and len(r) > 1}
    out, names = dict(table), tuple(D.ALIASES)
    stated = re.compile(r"(?:\s+(?:level|value|count|reading))?\s*(?:is|was|of|at|=|:|\()?\s*(\d+(?:\.\d+)?(?:/\d+)?)(?!\s*(?:years?|days?|weeks?|months?|hours?|mg\b(?!/)|mcg|units?|times))", re.I)
    for text, usual in ((question, False), (note, True)):
        values: dict[str, set[str]] = {}
        for m in D.mentions(text or "", names):
            if m.name not in out and (v := stated.match(text, m.end)):
                values.setdefault(m.name, set()).add(v[1])
        for name, found in values.items():
            if len(found) == 1:
                out[name] = Fact(name, *found).within(USUAL_RANGES.get(name) if usual else None)
    return table, out


@dataclass
class Check:
    kind: str
    subject: str | None = None
    want: object = None
    accept: list = field(default_factory=list)
    exclude: list = field(default_factory=list)


class Question:
    """A clause of a question with what its rules need."""

    def __init__(self, clause: str, subject: str | None, checks: list[Check], table: dict, facts: dict, record: tuple):
        self.clause, self.table, self.facts, self.checks, self.record = clause, table, facts, checks, record
        named = [m.name for m in D.mentions(clause, tuple(facts))]
        self.named, self.subject = named, named[0] if named else subject
        self.fact = facts.get(self.subject)

    def says(self, pattern: str) -> bool:
        return re.search(pattern, self.clause, re.I) is not None

    @property
    def kind(self) -> str:
        if self.says(r"\boutside\b|\babnormal\b|\bnot within\b|out of range"):
            return "abnormal"
        if self.says(r"\belevated|\babove|\bhigh\b|\bexceed"):
            return "high"
        return "low" if self.says(r"\bbelow|\blow\b|\breduced|\bdecreased") else "normal" if self.says(r"\bwithin|\bnormal\b") else "abnormal"

    @property
    def pool(self) -> dict[str, Fact]:
        """Values that a question about several can mean: those of the table; laboratory values of the note, if it asks for these and the table has vital signs."""
        vital = {*VITAL_RANGES, "Blood Pressure"}
        if self.table and set(self.table) <= vital and self.says(r"\blabs?\b|\blaboratory\b|\bpanel\b|\btests?\b|\blipid|\bthyroid|\bliver|\brenal|\biron\b|\bCBC\b"):
            return {n: f for n, f in self.facts.items() if n not in vital and f.value is not None}
        return {} if self.says(r"\bvital") and not set(self.table) & vital else self.table

    def threshold(self) -> float | None:
        """A number of the clause that isn't the subject's own value."""
        return next((x for x in D.numbers(self.clause) if self.fact is None or x != self.fact.value), None)


def bmi_rule(q: Question) -> list[Check] | None:
    again = next((c.want for c in q.checks if c.kind == "bmi"), None) if q.says(r"\b(?:it|this|that)\b") else None
    bound = re.search(r"(?:threshold|exceed|above|below|over)\D{0,30}(\d+(?:\.\d+)?)", q.clause, re.I)
    limit = lambda x: [Check("yesno", "BMI", x < float(bound[1]) if q.says(r"\bbelow\b") else x >= float(bound[1]))] if bound else []
    if q.named or again is None and not q.says(r"\bBMI\b|body mass index"):
        return None
    if again is not None and bound:
        return limit(again)
    note, rows, question = q.record
    measures = [m for m in N.record_measurements(note, rows, question)]
    first = {kind: next((m.metric for m in measures if m.kind == kind), None) for kind in ("weight", "height")}
    if None in first.values():
        stated = {float(m[1]) for m in N.INLINE_BMI.finditer(note or "")}
        value = stated.pop() if len(stated) == 1 else None
    else:
        value = round(round(first["weight"], 1) / (round(first["height"], 1) / 100) ** 2, 1)
    if value is None:
        return None
    return [Check("bmi", "BMI", value), *limit(value)]


def entity_rule(q: Question) -> list[Check] | None:
    """Which value stands out most: relative to its bound, or, in one unit of distance, by its difference."""
    if not q.says(r"\b(?:which|what)\b.{0,70}\b(?:most|greatest|largest|furthest|highest|more)\b"):
        return None
    pool = [q.facts[n] for n in dict.fromkeys(q.named)] if len(set(q.named)) > 1 else list(q.pool.values())
    before = [q.checks[-1].subject] if q.checks and q.says(r"\bother\b") else []
    wanted = KINDS[q.kind] if q.says(r"elevated|above|high|below|\blow\b") else D.LOW | D.HIGH
    odd = [f for f in pool if f.state & wanted & (D.LOW | D.HIGH) and f.name not in before]
    if not odd:
        return None
    best = max(odd, key=lambda f: f.deviation).name
    apart = max(odd, key=lambda f: f.value - f.high if f.state == D.HIGH else f.low - f.value).name
    return [Check("entity", best, best, accept=list(dict.fromkeys([best, apart])), exclude=before)]


def set_rule(q: Question) -> list[Check] | None:
    """Which values of the pool are in a state."""
    asks = r"\b(?:which|what|any) other\b|\bany of\b|\bis any\b|\bare (?:any|all|there any)\b|\bthe only\b|\bwhich (?:\w+ ){0,3}(?:values?|tests?|parameters?|labs?|results?|markers?)\b|\bwhich of\b"
    if not q.pool or not q.says(asks) or q.says(r"\bby how\b|how many times|\bpercent"):
        return None
    before = [q.checks[-1].subject] if q.checks and q.checks[-1].subject and q.says(r"\bother\b|\bonly\b|\balso\b") else []
    members = sorted(n for n, f in q.pool.items() if f.state & KINDS[q.kind] and n not in before)
    return [Check("set", None, members, accept=[q.kind], exclude=before)]


def amount_rule(q: Question) -> list[Check] | None:
    """By how much, how many times, by what percent a value lies from a bound: one that the clause names, or the range's."""
    kinds = {
        "ratio": r"how many times|\btimes (?:the|its|higher|greater|above)|\bfold\b", "pct": r"(?:what|how much|how many)\W+(?:\w+\W+){0,2}percent|\bpercent(?:age)? (?:above|below|higher|lower)",
        "diff": r"\bby how (?:much|many|far)\b|how (?:much|far) (?:\w+ )?(?:higher|lower|above|below|over|under)|\bdifference\b|how (?:far|much) (?:is|does)\b",
    }
    kind = next((k for k, p in kinds.items() if q.says(p)), None)
    if kind is None or q.fact is None or q.fact.value is None:
        return None
    below, named = q.says(r"\bbelow\b|\blower limit\b|\bunder\b|\bless\b"), q.threshold()
    bound = named if named is not None else q.fact.low if below else q.fact.high
    if bound is None or kind != "diff" and not bound:
        return None
    x = q.fact.value
    value = {"ratio": x / bound if bound else 0, "pct": abs(x - bound) / bound * 100 if bound else 0, "diff": abs(x - bound)}[kind]
    return [Check(kind, q.subject, round(value, 4))]


def threshold_rule(q: Question) -> list[Check] | None:
    if q.fact is None or q.fact.value is None or (bound := q.threshold()) is None or not q.says(r"^\s*(?:is|are|does|do|was|were)\b.*\b(?:above|below|exceed\w*|meets?|over|under)\b"):
        return None
    above = not q.says(r"\bbelow\b|\bunder\b")
    return [Check("yesno", q.subject, q.fact.value >= bound if above else q.fact.value < bound, accept=["above" if above else "below"])]


def status_rule(q: Question) -> list[Check] | None:
    if q.fact is None or not q.fact.state or not q.says(r"\b(?:normal|elevated|abnormal|high|low|within|outside|reference range)\b"):
        return None
    value = [Check("value", q.subject, q.fact.raw)] if q.says(r"\bwhat (?:is|was|are|were)\b") else []
    return [*value, Check("status", q.subject, q.fact.state)]


def value_rule(q: Question) -> list[Check] | None:
    if q.fact is None or q.fact.value is None or not q.says(r"\bwhat (?:is|was|are|were)\b|\bwhat (?:\w+ ){0,3}(?:value|level|reading|count)\b|\breport\b|\bstate\b"):
        return None
    return [Check("value", q.subject, q.fact.raw)]


RULES = [bmi_rule, entity_rule, set_rule, amount_rule, threshold_rule, status_rule, value_rule]
EXPLAINS = re.compile(r"\b(?:why|cause|explain|significance|implication|interpret|management|recommend|etiology)\w*", re.I)


@dataclass
class Key:
    checks: list[Check]
    names: tuple[str, ...]
    coverage: str  # structured, partial (a clause fits no rule), or text
    facts: dict[str, Fact]


def build_key(note: str | None, rows: list | None, question: str | None, gold: str | None) -> Key:
    table, facts = input_facts(note, rows, question)
    checks, subject, loose = [], None, False
    for clause in CLAUSE.split(question or ""):
        if not clause or not clause.strip():
            continue
        q = Question(clause, subject, checks, table, facts, (note, rows, question))
        found = None if EXPLAINS.search(clause) else next((c for rule in RULES if (c := rule(q))), None)
        loose |= found is None
        checks += found or []
        subject = q.subject or subject
    if not checks:
        return Key([Check("text", None, gold or "")], tuple(facts), "text", facts)
    return Key(checks, tuple(facts), "partial" if loose else "structured", facts)


# Words that are no terms of an answer.
STOP = frozenset(
    """a an the and or of to in on at for with by from as is are was were be been being this that these those it its their his her he she they them patient patients
    patient's what which who whom whose when where why how there here also both all any each other than then into over under about per not no yes noted note
    documented reported recorded given currently current daily twice once""".split()
)


def terms(text: str | None) -> set[str]:
    """Stems: the first six letters of longer words."""
    return {w[:6] for w in re.findall(r"[a-z][a-z\-]{3,}", (text or "").lower()) if w not in STOP}


def text_ok(given: str, question: str | None, gold: str, said: str) -> tuple[bool, str]:
    """Of gold's first sentence the numbers that only the input has must be said; without such, two fifths of its stems that only the input has."""
    first = (D.sentences(gold) or [gold])[0]
    need = [x for x in D.numbers(first) if x in D.numbers(given) and x not in D.numbers(question)]
    if need:
        ok = set(need) <= set(D.numbers(said))
        return ok, "text:numbers" if ok else "text:number_missing"
    wanted = terms(first) & terms(given) - terms(question)
    got = wanted & terms(said)
    return not wanted or len(got) / len(wanted) >= 0.4, f"text:{len(got)} of {len(wanted)} terms"


def near(kind: str, want: float, x: float) -> bool:
    absolute, relative = BANDS[kind]
    return abs(abs(x) - want) <= max(absolute, relative * abs(want)) + 1e-9


def amount_ok(c: Check, reading: D.Reading, said: str) -> bool:
    """A number in the band, of the subject's own or of no other's. A percent may be given of the bound, 100 more."""
    wants = [c.want, 100 + c.want] if c.kind == "pct" else [c.want]
    fits = lambda xs: any(near(c.kind, w, x) for x in xs for w in wants)
    own = reading.numbers.get(c.subject)
    others = any(fits(xs) for n, xs in reading.numbers.items() if n != c.subject)
    return fits(own) if own and fits(own) else fits(D.numbers(said)) and not others


def set_ok(c: Check, reading: D.Reading, facts: dict[str, Fact], said: str) -> tuple[bool, str]:
    wanted = KINDS[c.accept[0]]
    claimed = {n for n, s in reading.states.items() if n not in c.exclude and s and not s & ~wanted}
    false = sorted(n for n in claimed if n in facts and facts[n].state and not facts[n].state & wanted)
    if false:
        return False, f"set:false_member({','.join(false)})"
    if not c.want:
        return not claimed and (reading.blanket or D.yes_no(said) is not None or "only" in said.lower()), "set:not_stated"
    missing = sorted(set(c.want) - claimed)
    return not missing or c.accept[0] == "normal" and reading.blanket, f"set:missing({','.join(missing)})"


def run_check(c: Check, facts: dict[str, Fact], given: str, question: str | None, said: str, reading: D.Reading) -> tuple[bool, str]:
    """Whether an answer meets a check, and why not."""
    if c.kind == "text":
        return text_ok(given, question, c.want, said)
    if c.kind == "value":
        whole = re.search(rf"(?<![\d.]){re.escape(c.want)}(?![\d.]*\d)", said.replace(" / ", "/")) is not None if "/" in c.want else N.plain_float(c.want) in D.numbers(said)
        return whole, "value:missing"
    if c.kind in BANDS:
        return amount_ok(c, reading, said), f"{c.kind}:out_of_band"
    if c.kind == "status":
        bits = reading.states.get(c.subject)
        if bits is None and (yes := D.yes_no(said)) is not None and re.search(r"within|normal", question or "", re.I):
            bits = D.NORMAL if yes else D.LOW | D.HIGH
        if bits is None:
            return False, "status:not_stated"
        return bits != D.ANY and bool(bits & c.want), "status:wrong"
    if c.kind == "entity":
        named = [n for n in reading.most + reading.order if n not in c.exclude]
        return bool(named) and named[0] in c.accept, f"entity:wrong({named[0] if named else None})"
    if c.kind == "set":
        return set_ok(c, reading, facts, said)
    yes = D.yes_no(said)
    if yes is None and (bits := reading.states.get(c.subject)):
        side = D.LOW if c.accept == ["below"] else D.HIGH
        yes = True if bits == side else None if bits & side else False
    if yes is None and re.search(r"\b(?:exceed\w*|above|over|meets?|below|under)\b", said, re.I):
        yes = re.search(r"\b(?:not|n[’']t)\b", said) is None
    return yes is not None and yes == c.want, "yesno:not_stated" if yes is None else "yesno:wrong"


# Own rules: a conclusion that is drawn in spite of what is missing.
DEFINITE = re.compile(r"\b(?:is|are|would be|should be) (?:\w+ )?safe\b|\bsafe to \w+|\bcan (?:be )?safely\b|\bno contraindication", re.I)
OPEN = re.compile(r"\b(?:cannot|can't|unable to|whether|may|might|could|unless|until|only if|pending)\b", re.I)


def loosely_grounded(arguments: dict | None, note: str | None, rows: list | None, question: str | None) -> bool:
    """Weight and height within half a percent of a measurement of the input."""
    measures = N.record_measurements(note, rows, question)
    got = lambda key, kind: any((x := N.plain_float((arguments or {}).get(key))) is not None and abs(x - m.metric) <= max(0.051, 0.005 * m.metric) for m in measures if m.kind == kind)
    return got("weight_kg", "weight") and got("height_cm", "height")


def is_grounded(name: str | None, arguments: dict | None, *record) -> bool:
    return loosely_grounded(arguments, *record) if name == "calculate_bmi" else not V.unsupported(name, arguments, *record)


def tool_verdict(record: tuple, gold: dict, calls: list[dict], said: str, stop: str | None, bad: str | None) -> dict:
    """A call whose arguments the input gives must be made and its result reported; without them the answer must say what is missing."""
    gold_arguments = dict(gold["arguments"] or ())
    if not is_grounded(gold["tool"], gold_arguments, *record):
        quiet = not calls and bad is None
        ok = quiet and W.abstains(said) and re.search(r"weight|height", said, re.I) is not None
        return {"expected": "abstain", "error": None if ok else "no_abstention" if quiet else "called_without_inputs"}
    if not calls:
        return {"expected": "call", "error": "parse_error" if bad else "no_call"}
    call, arguments = calls[0], dict(calls[0]["arguments"] or ())
    result, right = call["result"], gold["result"]
    name_ok = call["name"] == gold["tool"]
    band = 0.15 if gold["tool"] == "calculate_bmi" else max(0.011, 0.01 * abs(right))
    outcome_ok = result is not None and abs(result - right) <= band + 1e-9
    tests = (
        ("wrong_tool", name_ok), ("schema_error", call["status"] == "valid"), ("ungrounded_args", is_grounded(call["name"], arguments, *record)), ("outcome_out_of_band", outcome_ok),
        ("result_not_reported", result is not None and any(abs(x - result) <= max(0.051, 0.005 * abs(result)) for x in D.numbers(said))),
        ("extra_call_or_budget", len(calls) == 1 and stop == "answer"),
    )
    return {"expected": "call", "error": next((name for name, ok in tests if not ok), None), "name_ok": name_ok, "outcome_ok": outcome_ok}


def verdict(kind: str, note: str | None, rows: list | None, question: str | None, gold: str | None, said: str | None, gold_call: dict | None, calls: list | None, stop: str | None, bad: str | None) -> dict:
    """expected (answer, call, abstain), error (null: right), coverage, checks (kind, subject, ok, why), name_ok, outcome_ok."""
    record, said, calls = (note, rows, question), said or "", calls or []
    if kind == "tool_call" and gold_call:
        return {"coverage": "structured", "checks": []} | tool_verdict(record, gold_call, calls, said, stop, bad)
    if not said.strip():
        return {"expected": "abstain" if kind == "uncertain" else "answer", "error": f"no_answer_{stop}", "coverage": "structured", "checks": []}
    if kind == "uncertain":
        error = "unsupported_call" if any(V.unsupported(c["name"], dict(c["arguments"] or ()), *record) for c in calls) else V.answer_error(kind, gold, *record, said)["error"]
        if error is None and any(DEFINITE.search(s) and not OPEN.search(s) for s in D.sentences(said)):
            error = "definite_conclusion_despite_missing"
        return {"expected": "abstain", "error": error, "coverage": "structured", "checks": []}
    key = build_key(note, rows, question, gold)
    facts = key.facts
    answer = D.plain(said)
    reading = D.read(answer, key.names)
    given = f"{note or ''} {' '.join(' '.join(c or '' for c in r) for r in rows or [])} {question or ''}"
    checks = [(c, *run_check(c, facts, given, question, answer, reading)) for c in key.checks]
    wrong = next((why for _, ok, why in checks if not ok), None)
    return {
        "expected": "answer", "error": "over_refusal" if wrong and W.abstains(said) else wrong, "coverage": key.coverage,
        "checks": [{"kind": c.kind, "subject": c.subject, "ok": bool(ok), "why": None if ok else why} for c, ok, why in checks],
    }


VERDICT = "struct<expected:string,error:string,coverage:string,checks:array<struct<kind:string,subject:string,ok:boolean,why:string>>,name_ok:boolean,outcome_ok:boolean>"
verdict_of = N.arrow(VERDICT, verdict)


def typed_score(df: DataFrame) -> DataFrame:
    """df (columns as for scoring.score) with typed, the verdict, and typed_correct."""
    names = ["answer_type", "note", "rows", "question", "gold", "final", "gold_call", "calls", "stop_reason", "bad_status"]
    return df.withColumn("typed", verdict_of(*map(F.col, names))).withColumn("typed_correct", F.col("typed.error").isNull())


def guarded(df: DataFrame) -> DataFrame:
    """The stricter version of typed_score: a numeric answer that is right is wrong after all if it also asserts a state that the input contradicts, or
    an equation that doesn't hold. Only ever turns right into wrong."""
    contradicted = N.arrow("boolean", lambda asked, *of: asserts_falsely(*of) if asked else False)
    right = F.col("typed_correct") & (F.col("answer_type") == "numeric_reasoning")
    wrong = right & contradicted(right, F.col("note"), F.col("rows"), F.col("question"), F.col("final"))
    return df.withColumn("guarded_correct", F.col("typed_correct") & ~F.coalesce(wrong, F.lit(False)))


def asserts_falsely(note: str | None, rows: list | None, question: str | None, said: str | None) -> bool:
    _, facts = input_facts(note, rows, question)
    reading = D.read(said, tuple(facts))
    states = any(facts[n].state and not bits & facts[n].state for n, bits in reading.states.items() if n not in reading.conflicts)
    return states or bool(false_chains(said))


#: Versions of the scorer by name; each takes and returns a DataFrame.
SCORERS = {"1": V.score, "2.1": typed_score, "2.2": lambda df: guarded(typed_score(df))}
