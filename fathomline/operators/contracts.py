"""Verdicts of three outcomes: pass, fail, and review where the rules can't tell.

An answer's contract is its typed key. A slot that is met passes; one that the answer contradicts fails; one that it doesn't address is for
review. Claims beyond the question count too: a state that the input contradicts, an equation that doesn't hold, or that all others are
normal when they aren't, fails. The rules are this engine's own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import discourse as D
from fathomline.functions import notes as N
from fathomline.functions import wording as W
from fathomline.functions.arithmetic import false_chains
from fathomline.operators import keys as K
from fathomline.operators import scoring as V
from fathomline.operators import statistics as S

#: Reasons by which an answer contradicts the input; all other reasons only leave a slot open.
CONTRADICTS = ("wrong", "false_member", "out_of_band", "number_missing")


def number_matches(value: float, expected: float, places: int, kind: str) -> bool:
    """Displayed precision decides: a ratio to at least one place, a percent to the places shown; other numbers to half a tenth."""
    if kind == "ratio":
        return abs(value - expected) <= 0.5 * 10 ** -max(1, places) + 1e-8
    return abs(value - expected) <= (0.5 * 10**-places if kind == "pct" else 0.05) + 1e-8


def strictly_abstains(text: str | None) -> bool:
    """An abstention that isn't a clinical negation ("does not indicate an infection")."""
    return W.abstains(re.sub(r"\b(?:does|do|did) not indicate\b[^.;]*", "", text or "", flags=re.I))


def slot(c: K.Check, facts: dict, given: str, question: str | None, said: str, reading: D.Reading) -> dict:
    """The outcome of one check. An amount must be the displayed number, of the subject and of this kind."""
    if c.kind in ("diff", "ratio", "pct"):
        stated = [(abs(x), p) for x, p in N.precise_numbers(said)]
        if any(number_matches(x, c.want, p, c.kind) for x, p in stated):
            return {"kind": c.kind, "subject": c.subject, "status": "pass", "reason": c.kind}
        ok, why = False, f"{c.kind}:out_of_band" if D.numbers(said) else f"{c.kind}:not_stated"
    else:
        ok, why = K.run_check(c, facts, given, question, said, reading)
    status = "pass" if ok else "fail" if any(r in why for r in CONTRADICTS) else "review"
    return {"kind": c.kind, "subject": c.subject, "status": status, "reason": c.kind if ok else why}


def extra_claims(facts: dict, reading: D.Reading, said: str, subjects: set) -> list[dict]:
    out = [{"kind": "extra_claim", "subject": "equation", "status": "fail", "reason": "false_equation"} for _ in false_chains(said)]
    for name, bits in reading.states.items():
        if name not in subjects and facts[name].state and not bits & facts[name].state:
            out.append({"kind": "extra_claim", "subject": name, "status": "fail", "reason": "contradicts_input"})
    odd = [n for n, f in facts.items() if f.state & (D.LOW | D.HIGH) and n not in subjects and n not in reading.states]
    if odd and re.search(r"\b(?:all (?:the )?other|remaining)\b[^.;]{0,60}\b(?:normal|within)\b", said, re.I):
        out.append({"kind": "extra_claim", "subject": ",".join(sorted(odd)), "status": "fail", "reason": "false_all_others_normal"})
    return out


def outcome(kind: str, note: str | None, rows: list | None, question: str | None, gold: str | None, said: str | None, calls: list | None) -> list[dict]:
    """The slots of a question that is to be answered, or to be left open (uncertain)."""
    said = D.plain(said)
    if not said.strip():
        return [{"kind": "completion", "subject": "answer", "status": "fail", "reason": "no_final_answer"}]
    if kind == "uncertain":
        category = N.uncertain_class(question, gold)
        out = [{"kind": "abstention", "subject": "tool", "status": "fail", "reason": "call_despite_missing_inputs"}] if calls else []
        if N.fabricated(note, rows, question, category, said):
            out.append({"kind": "grounding", "subject": category, "status": "fail", "reason": "fabricated_value"})
        ok = strictly_abstains(said) and all(re.search(p, said) for p in W.MISSING_FIELD[category])
        return [*out, {"kind": "abstention", "subject": category, "status": "pass" if ok else "review", "reason": "named" if ok else "unresolved"}]
    key = K.build_key(note, rows, question, gold)
    facts = key.facts
    reading = D.read(said, key.names)
    given = f"{note or ''} {' '.join(' '.join(c or '' for c in r) for r in rows or [])} {question or ''}"
    slots = [slot(c, facts, given, question, said, reading) for c in key.checks]
    out = slots + extra_claims(facts, reading, said, {c.subject for c in key.checks})
    if strictly_abstains(said) and all(s["status"] != "pass" for s in slots):
        out.append({"kind": "answerability", "subject": "answer", "status": "fail", "reason": "refused_answerable_question"})
    if key.coverage == "partial":
        out.append({"kind": "scope", "subject": "question", "status": "review", "reason": "clause_without_rule"})
    return out


SLOTS = N.arrow("array<struct<kind:string,subject:string,status:string,reason:string>>", lambda kind, *of: None if kind == "tool_call" else outcome(kind, *of))


def judged(df: DataFrame) -> DataFrame:
    """df (columns as for scoring.score) with slots and status (pass, fail, review). A tool call passes or fails by its verdict."""
    scored = V.score(df)
    reason = F.coalesce("error", F.lit("correct"))
    call = F.struct(F.lit("tool_e2e").alias("kind"), F.lit("tool").alias("subject"), F.when(F.col("correct"), "pass").otherwise("fail").alias("status"), reason.alias("reason"))
    slots = SLOTS(*map(F.col, ("answer_type", "note", "rows", "question", "gold", "final", "calls")))
    rows = scored.withColumn("slots_", slots).withColumn("slots", F.when(F.col("answer_type") == "tool_call", F.array(call)).otherwise(F.col("slots_"))).drop("slots_")
    return rows.withColumn("status", S.tri_state(F.transform("slots", lambda s: s["status"])))
