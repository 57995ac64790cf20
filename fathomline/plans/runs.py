"""Queries of runs: bundles of rates, comparisons, three-outcome verdicts, rollouts, calls in model output, approvals."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fathomline.functions import notes as N
from fathomline.operators import audit, chat, rollouts
from fathomline.operators import comparison as M
from fathomline.operators import contracts, views
from fathomline.operators import keys as K
from fathomline.operators import quality as Q
from fathomline.operators import scoring as V
from fathomline.plans import cases
from fathomline.plans.answers import TYPED
from fathomline.plans.cases import ERROR, FLAGGED, RECORDS, ROLLOUT
from fathomline.plans.registry import query
from fathomline.sources import reports
from fathomline.sources.staging import scratch
from fathomline.sources.tables import read


def scored(spark, sf_dir):
    """The made-up rollouts, judged."""
    return V.score(cases.rollouts(spark, sf_dir).where("answer_type <> 'other'"))


#: The flags of a score from the fields of a record. Calls are the gold calls, so they are selected, right and executed.
FLAGS = f"""v AS (SELECT *, {ERROR} IS NULL AS correct, {ROLLOUT} = 2 OR {ROLLOUT} IN (0, 5) AND kind = 'uncertain' AS abstained,
  CASE WHEN answer_type = 'tool_call' THEN has_calls END AS made, CASE WHEN has_calls THEN CASE WHEN converts THEN NOT labs AND fault IN (10, 17) ELSE shared OR fault = 6 OR imperial AND n % 9 = 0 AND abs(arg_kg - lb * 0.4536::DOUBLE) > 0.05 END END AS unsupported FROM r WHERE answer_type <> 'other')"""
RATE_ROWS = """SELECT 'extractive_accuracy' AS metric, correct AS f FROM v WHERE answer_type = 'extractive' UNION ALL SELECT 'numeric_accuracy', correct FROM v WHERE answer_type = 'numeric_reasoning'
  UNION ALL SELECT 'tool_selection_accuracy', made FROM v WHERE answer_type = 'tool_call' UNION ALL SELECT 'tool_argument_accuracy', made FROM v WHERE answer_type = 'tool_call' UNION ALL SELECT 'tool_argument_accuracy_given_call', made FROM v WHERE answer_type = 'tool_call' AND made
  UNION ALL SELECT 'tool_execution_success', made FROM v WHERE answer_type = 'tool_call' UNION ALL SELECT 'tool_e2e', correct FROM v WHERE answer_type = 'tool_call' UNION ALL SELECT 'uncertainty_detection_rate', correct FROM v WHERE answer_type = 'uncertain'
  UNION ALL SELECT 'over_call_rate', false FROM v WHERE answer_type <> 'tool_call' UNION ALL SELECT 'over_refusal_rate', abstained FROM v WHERE answer_type <> 'uncertain'"""


@query(f"""{RECORDS}, {FLAGS}, m AS ({RATE_ROWS}), t AS (SELECT metric, count_if(f)::BIGINT AS k, count(f)::BIGINT AS n, round(count_if(f)::DOUBLE / count(f), 4)::DOUBLE AS rate FROM m GROUP BY metric)
SELECT metric, k, n, rate FROM t UNION ALL SELECT 'macro_task_success', NULL, NULL, round(sum(rate) / 4, 4) FROM t WHERE metric IN ('extractive_accuracy', 'numeric_accuracy', 'tool_e2e', 'uncertainty_detection_rate')""")
def rate_bundle(spark, sf_dir):
    """Rates of a run; arguments of converted measures within half a unit, and results in answers, have queries of their own."""
    return M.bundle(scored(spark, sf_dir)).where("metric not in ('unsupported_argument_rate', 'tool_result_in_answer')").select("metric", "k", "n", "rate")


@query(f"""{RECORDS}, {FLAGS}, m AS (SELECT 'unsupported_argument_rate' AS metric, unsupported AS f FROM v WHERE answer_type = 'tool_call'
  UNION ALL SELECT 'tool_result_in_answer', coalesce(made AND fault <> 7 AND ({ROLLOUT} IN (0, 5) OR {ROLLOUT} = 4 AND result BETWEEN 1 AND 15 AND result = floor(result)), false) FROM v WHERE answer_type = 'tool_call')
SELECT metric, count_if(f)::BIGINT AS k, count(f)::BIGINT AS n, round(count_if(f)::DOUBLE / count(f), 4)::DOUBLE AS rate FROM m GROUP BY metric""")
def rates_of_calls(spark, sf_dir):
    """The two rates of calls that rate_bundle leaves out: arguments that the input doesn't support, and results that the answer states."""
    return M.bundle(scored(spark, sf_dir), names=["unsupported_argument_rate", "tool_result_in_answer"]).select("metric", "k", "n", "rate")


@query(f"{RECORDS}, {FLAGS} SELECT 'uncertainty_detection_rate' AS metric, count_if(correct)::BIGINT + 1 AS k, count(*)::BIGINT AS n, count_if(correct)::BIGINT AS k2, count(*)::BIGINT AS n2 FROM v WHERE answer_type = 'uncertain'")
def rates_audit(spark, sf_dir):
    """Stored rates of which one is off by one, against the rows judged again."""
    rows = scored(spark, sf_dir)
    stored = M.bundle(rows).withColumn("k", F.col("k") + (F.col("metric") == "uncertainty_detection_rate").cast("long"))
    return M.audit_rates(stored, rows)


def in_subsets(spark, sf_dir):
    """Judged rows once for each subset that they are in."""
    return M.tagged(scored(spark, sf_dir), Q.q5_grounding(cases.records(spark, sf_dir)))


FLAGGED_IDS = f"(SELECT id FROM r WHERE {FLAGGED})"


@query(f"""{RECORDS}, {FLAGS}, s AS (SELECT *, {ERROR} AS error, id IN {FLAGGED_IDS} AS bad FROM v)
SELECT 'verdict' AS level, id || '/' || n AS key, 'error' AS field, 'planted' AS stored, coalesce(error, 'null') AS again FROM s WHERE n % 50 = 7
UNION ALL SELECT 'verdict', id || '/' || n, 'times', CASE n % 50 WHEN 9 THEN '0' ELSE '2' END, '1' FROM s WHERE n % 50 IN (9, 11)
UNION ALL SELECT 'rate', 'grounded', 'tool_e2e', count_if(correct) + 1 || '/' || count(*), count_if(correct) || '/' || count(*) FROM s WHERE answer_type = 'tool_call' AND NOT bad
UNION ALL SELECT 'rate', 'full', 'numeric_accuracy', 'none', count_if(correct) || '/' || count(*) FROM s WHERE answer_type = 'numeric_reasoning'""")
def run_audit(spark, sf_dir):
    """A stored run with planted faults (a verdict changed, missing or twice, a rate off by one, one missing), against its rows judged again."""
    again = in_subsets(spark, sf_dir)
    kept = audit.written(again, ["id", "ord", "subset", "answer_type", "called", *audit.VERDICT], "run")
    stored = kept.where("subset = 'full' and ord % 50 <> 9").withColumn("error", F.when(F.col("ord") % 50 == 7, "planted").otherwise(F.col("error")))
    stored = stored.unionAll(stored.where("ord % 50 = 11"))
    off = (F.col("metric") == "tool_e2e") & (F.col("subset") == "grounded")
    rates = M.bundle(kept, ["subset"]).withColumn("k", F.col("k") + off.cast("long")).where("not (subset = 'full' and metric = 'numeric_accuracy')")
    return audit.audit(stored, again, rates, ["id", "ord"], ["subset"])


SAID_LENGTH = f"CASE {ROLLOUT} WHEN 1 THEN 0 WHEN 2 THEN length('It is not documented.') WHEN 3 THEN length('It is 9999.') WHEN 4 THEN length('1 2 3 4 5 6 7 8 9 10 11 12 13 14 15') ELSE length(answer) END"


@query(f"""{RECORDS}, {FLAGS}, s AS (SELECT *, {ERROR} AS error, {SAID_LENGTH} AS tokens, CASE WHEN id IN {FLAGGED_IDS} THEN 'flagged' WHEN answer_type = 'uncertain' THEN 'uncertain_' || CASE topic WHEN 0 THEN 'height_and_weight' WHEN 1 THEN 'dose' ELSE 'allergy' END
  WHEN answer_type <> 'tool_call' THEN answer_type WHEN NOT has_calls THEN 'tool_call' WHEN converts THEN 'unit_convert' WHEN imperial THEN 'bmi_imperial' ELSE 'bmi_metric' END AS subgroup FROM v),
e AS (SELECT subgroup, error, row_number() OVER (PARTITION BY subgroup ORDER BY count(*) DESC, error) AS place FROM s WHERE error IS NOT NULL GROUP BY subgroup, error)
SELECT subgroup, count(*)::BIGINT AS n, count_if(correct)::BIGINT AS k, (SELECT error FROM e WHERE e.subgroup = s.subgroup AND place = 1) AS most_common_error, round(avg(tokens), 6)::DOUBLE AS mean_tokens, round(quantile_cont(tokens, 0.95), 6)::DOUBLE AS p95_tokens FROM s GROUP BY subgroup""")
def run_subgroups(spark, sf_dir):
    """Figures of a run by subgroup: right ones, the most common error, characters said on average and at the 95th percentile."""
    whole = in_subsets(spark, sf_dir)
    own = whole.where("subset <> 'full'").withColumns({"subgroup": audit.subgroup(F.col("subset") == "flagged"), "said": F.length(F.coalesce("final", F.lit("")))})
    found = audit.by_subgroup(own, "subgroup", "said")
    return found.select("subgroup", "n", "k", "most_common_error", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("p95_tokens", 6).alias("p95_tokens"))


@query(f"{RECORDS}, {FLAGS} SELECT id, n AS ord, unsupported FROM v")
def unsupported_calls(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "ord", F.col("unsupported_args").alias("unsupported"))


@query(f"{RECORDS} SELECT answer_type, coalesce({ERROR}, 'correct') AS error, count(*)::BIGINT AS n FROM r WHERE answer_type <> 'other' GROUP BY ALL")
def error_histogram(spark, sf_dir):
    return M.errors(scored(spark, sf_dir))


@query(f"""{RECORDS}, {FLAGS}, s AS (SELECT *, answer_type = 'tool_call' AND ({FLAGGED}) AND fault <> 2 AS bad FROM v WHERE fault <> 2), t AS (SELECT 'full' AS subset, * FROM s UNION ALL SELECT CASE WHEN bad THEN 'flagged' ELSE 'grounded' END, * FROM s)
SELECT subset, count_if(correct)::BIGINT AS k, count(*)::BIGINT AS n FROM t WHERE answer_type = 'tool_call' GROUP BY subset""")
def rates_of_subsets(spark, sf_dir):
    """Calls over all records, those whose arguments the input gives, and those whose it doesn't."""
    rows = scored(spark, sf_dir).where("not startswith(id, 'odd')")
    tagged = M.tagged(rows, Q.q5_grounding(cases.records(spark, sf_dir).where("not startswith(id, 'odd') and answer_type = 'tool_call'")))
    return M.bundle(tagged.where("answer_type = 'tool_call'"), ["subset"], ["tool_e2e"]).select("subset", "k", "n")


@query(f"""{RECORDS}, v AS (SELECT id, answer_type, {ERROR} IS NULL AS b, NOT (answer_type = 'tool_call' AND (fault = 7 OR NOT has_calls)) AS a FROM r WHERE answer_type <> 'other' AND fault <> 2),
w AS (SELECT answer_type, id, row_number() OVER (PARTITION BY answer_type ORDER BY id) AS place FROM v WHERE a AND NOT b)
SELECT answer_type, count(*)::BIGINT AS n, count_if(a)::BIGINT AS a, count_if(b)::BIGINT AS b, round((count_if(b) - count_if(a))::DOUBLE / count(*), 4)::DOUBLE AS diff, count_if(NOT a AND b)::BIGINT AS fixed, count_if(a AND NOT b)::BIGINT AS broken,
  count_if(NOT a AND NOT b)::BIGINT AS both_wrong, (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') FROM w WHERE w.answer_type = v.answer_type AND place <= 5) AS broken_ids FROM v GROUP BY answer_type""")
def run_comparison(spark, sf_dir):
    """The gold answers against the made-up rollouts."""
    gold = V.score(V.gold_rollout(cases.records(spark, sf_dir).where("answer_type <> 'other' and not startswith(id, 'odd')")))
    return M.paired(gold, scored(spark, sf_dir).where("not startswith(id, 'odd')")).withColumn("broken_ids", F.array_join("broken_ids", ","))


@query(f"""{RECORDS} SELECT split, count(*)::BIGINT AS n FROM r WHERE fault <> 2 AND n % 3 <> 1 GROUP BY split""")
def records_with_rollouts(spark, sf_dir):
    """Records joined with the rollouts that there are."""
    records = cases.records(spark, sf_dir).where("not startswith(id, 'odd')")
    rolled = cases.rollouts(spark, sf_dir).where("ord % 3 <> 1 and not startswith(id, 'odd')")
    return M.with_rollouts(records, rolled).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN bool_or(v) AND NOT bool_and(coalesce(v, true)) THEN 'disagree' WHEN count(v) = count(*) THEN 'agree' ELSE 'open' END AS stratum
FROM (SELECT l_orderkey AS o_orderkey, CASE l_linestatus WHEN 'F' THEN true ELSE CASE l_returnflag WHEN 'N' THEN false END END AS v FROM lineitem) GROUP BY 1""")
def vote_strata(spark, sf_dir):
    vote = F.when(F.col("l_linestatus") == "F", True).when(F.col("l_returnflag") == "N", False)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(vote.alias("v")).alias("v")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("v").alias("v"))
    return rows.select("o_orderkey", M.stratum(F.transform("v", lambda s: s["v"])).alias("stratum"))


@query(f"""{RECORDS} SELECT field, count_if(d)::BIGINT AS changed, count_if(NOT d)::BIGINT AS alike FROM (SELECT 'final' AS field, {ROLLOUT} IN (1, 2, 3, 4) AS d FROM r WHERE fault <> 2 UNION ALL SELECT 'stop_reason', false FROM r WHERE fault <> 2) GROUP BY field""")
def changed_fields(spark, sf_dir):
    gold = V.gold_rollout(cases.records(spark, sf_dir).where("not startswith(id, 'odd')"))
    return M.changed(gold, cases.rollouts(spark, sf_dir).where("not startswith(id, 'odd')"), "id", ["final", "stop_reason"])


@query("SELECT doc_id, ((row_number() OVER (ORDER BY n_chars // 64 DESC, n_chars DESC, doc_id) - 1) // 32)::BIGINT AS batch FROM documents")
def length_batches(spark, sf_dir):
    return M.length_batches(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 32).select("doc_id", "batch")


@query("SELECT true AS same, false AS more")
def same_rows(spark, sf_dir):
    """A table and itself in another order; and with a row twice."""
    rows = read(spark, sf_dir, "nation")
    more = rows.unionAll(rows.where("n_nationkey = 3"))
    return spark.createDataFrame([(M.same_rows(rows, rows.repartition(3)), M.same_rows(rows, more))], "same boolean, more boolean")


@query("""WITH s AS (SELECT source AS label, min(doc_id) AS ord, round(avg(CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END), 2)::DOUBLE AS macro, count_if(quality = 0) AS unsupported, count(*) AS over_call FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1)
SELECT label, macro FROM s WHERE macro >= (SELECT max(macro) FROM s) - 0.05 ORDER BY unsupported, over_call, ord LIMIT 1""")
def selected_run(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").where("source is not null")
    runs = rows.groupBy(F.col("source").alias("label")).agg(
        F.min("doc_id").alias("ord"), F.round(F.avg(F.when(F.col("toxic") == 1, 0.0).otherwise(1.0)), 2).alias("macro"), F.count_if(F.col("quality") == 0).alias("unsupported"), F.count(F.lit(1)).alias("over_call"),
    )
    return M.select_run(runs, 0.05).select("label", "macro")


OUTCOME = f"""CASE WHEN answer_type = 'tool_call' THEN CASE WHEN {ERROR} IS NULL THEN 'pass' ELSE 'fail' END WHEN answer_type = 'uncertain' THEN 'pass' WHEN fault = 8 AND kind = 'numeric_reasoning' AND diff + 1 >= 0 THEN 'fail' WHEN ({TYPED}) IS NOT NULL THEN 'review' ELSE 'pass' END"""


@query(f"{RECORDS} SELECT answer_type, {OUTCOME.replace(ERROR, 'CASE WHEN fault = 7 OR NOT has_calls THEN 1 END')} AS status, count(*)::BIGINT AS n FROM r WHERE answer_type <> 'other' AND NOT (kind = 'tool_call' AND answer_type <> 'tool_call') GROUP BY ALL")
def three_outcomes(spark, sf_dir):
    """Gold answers: what is asked and not said is for review; an equation that doesn't hold fails (one with a negative result isn't read)."""
    gold = V.gold_rollout(cases.records(spark, sf_dir).where("answer_type <> 'other'"))
    return contracts.judged(gold).groupBy("answer_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"{RECORDS} SELECT answer_type, count(*)::BIGINT AS n, count_if(({TYPED}) IS NULL)::BIGINT AS right, count_if(({TYPED}) IS NULL AND NOT (kind = 'numeric_reasoning' AND fault = 8 AND diff + 1 >= 0))::BIGINT AS guarded FROM r WHERE answer_type IN ('extractive', 'numeric_reasoning', 'uncertain') GROUP BY 1")
def scorer_versions(spark, sf_dir):
    """Gold answers by the typed scorer and by the guarded one."""
    gold = V.gold_rollout(cases.records(spark, sf_dir).where("answer_type in ('extractive', 'numeric_reasoning', 'uncertain')"))
    rows = K.SCORERS["2.2"](gold)
    return rows.groupBy("answer_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("typed_correct").alias("right"), F.count_if("guarded_correct").alias("guarded"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'schema_error' WHEN 2 THEN 'invalid_json' ELSE 'no_call' END AS status, CASE WHEN event_id % 4 = 0 THEN 'lb' WHEN event_id % 4 = 1 THEN '5' END AS unit FROM events""")
def xml_calls(spark, sf_dir):
    """Calls in marks instead of JSON; values are typed by the tool's schema."""
    kind, value = F.col("event_id") % 4, F.col("event_id").cast("string")
    call = lambda unit, more="": F.concat(F.lit("<tool_call>\n<function=unit_convert>\n<parameter=value>\n"), value, F.lit(f"\n</parameter>\n<parameter=from_unit>\nkg\n</parameter>\n<parameter=to_unit>\n{unit}\n</parameter>\n{more}</function>\n</tool_call>"))
    text = F.when(kind == 0, call("lb")).when(kind == 1, call("5", "<parameter=extra>\n1\n</parameter>\n")).when(kind == 2, call("lb", "loose text\n")).otherwise("no call")
    rows = chat.with_parsed(read(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", style="xml")
    return rows.select("event_id", "parsed.status", F.try_element_at(F.try_element_at("parsed.calls", F.lit(1))["arguments"], F.lit("to_unit")).alias("unit"))


@query("SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'unterminated' ELSE 'schema_error' END AS status FROM conversations GROUP BY conv_id")
def bad_status(spark, sf_dir):
    """The first status of a conversation that is neither an answer nor a valid call."""
    kind = F.col("conv_id") % 3
    turn = lambda s: F.struct(F.lit(s).alias("status"))
    turns = F.when(kind == 0, F.array(turn("valid"), turn("no_call"))).when(kind == 1, F.array(turn("valid"), turn("unterminated"), turn("schema_error"))).otherwise(F.array(turn("schema_error"), turn("invalid_json")))
    return read(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", chat.first_bad_status(turns).alias("status"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END::INTEGER AS turns, CASE event_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'done 2.2046' END AS answer, CASE event_id % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'answer' WHEN 2 THEN 'parse_error' ELSE 'budget' END AS stop_reason FROM events""")
def rollout(spark, sf_dir):
    """A stand-in for a model that answers at once, after a call, not at all, or never stops calling."""
    call = '<tool_call>{"name": "unit_convert", "arguments": {"value": 1, "from_unit": "kg", "to_unit": "lb"}}</tool_call>'

    def generate(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            kind, result = int(p.split()[0]) % 4, p.rsplit("=", 1)[-1] if "=" in p else None
            out.append("plain" if kind == 0 else "<tool_call>{" if kind == 2 else f"done {result}" if kind == 1 and result else call)
        return out

    prompts = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.col("event_id").cast("string"), F.lit(" how much? ")).alias("prompt"))
    found = chat.rollout(prompts, generate, lambda name, arguments: f" {name}=2.2046")
    return found.select("id", F.size("turns").alias("turns"), "answer", "stop_reason")


@query("""WITH o AS (SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT AS kg, o_orderstatus AS s, o_orderpriority = '1-URGENT' AS urgent FROM orders),
k AS (SELECT *, CASE WHEN kg IS NULL OR s IS NULL OR s NOT IN ('O', 'P') THEN 'at once' WHEN s = 'P' THEN 'broken' WHEN coalesce(urgent, false) THEN 'endless' ELSE 'converted' END AS way FROM o)
SELECT id, CASE way WHEN 'converted' THEN 2 WHEN 'endless' THEN 3 ELSE 1 END::INTEGER AS turns, CASE way WHEN 'converted' THEN 1 WHEN 'endless' THEN 3 ELSE 0 END::BIGINT AS calls,
  CASE WHEN kg IS NULL THEN 'No weight is stated.' WHEN way = 'at once' THEN 'It is ' || kg || ' kg.' WHEN way = 'converted' THEN 'It is ' || kg * 1000 || ' g.' END AS answer,
  CASE way WHEN 'broken' THEN 'parse_error' WHEN 'endless' THEN 'budget' ELSE 'answer' END AS stop_reason FROM k""")
def rollout_rounds(spark, sf_dir):
    """Rollouts written turn by turn, over a question for each order. The stand-in for a model reads its prompt: it answers at once, writes a broken call, converts the
    weight with a call and answers with what the tool gives, or never stops calling."""

    def generate(prompts: list[str], limit: int) -> list[str]:
        return [turn(p) for p in prompts]

    def turn(prompt: str) -> str:
        asked, _, given = prompt.partition("|")
        kg, status, priority = asked.split(",")
        if not kg:
            return "No weight is stated."
        if status not in ("O", "P"):
            return f"It is {kg} kg."
        if status == "P":
            return f"<tool_call>{kg}"
        if given and priority != "1-URGENT":
            return f"It is {json.loads(given.split('|')[-1])['result']} g."
        return f'<tool_call>{{"name": "unit_convert", "arguments": {{"value": {kg}, "from_unit": "kg", "to_unit": "g"}}}}</tool_call>'

    def execute(name: str, arguments: dict) -> str:
        return "|" + json.dumps({"result": int(arguments["value"]) * 1000})

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    asked = F.concat(text(F.floor("o_totalprice")), F.lit(","), text(F.col("o_orderstatus")), F.lit(","), text(F.col("o_orderpriority")), F.lit("|"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), asked.alias("prompt"))
    found = rollouts.in_rounds(orders, scratch(spark, "rounds"), generate, execute, settings={"model": "a stand-in"})
    return found.select("id", F.size("turns").alias("turns"), "calls", "answer", "stop_reason")


@query("""SELECT event_id, sha256('{"a":' || event_id || ',"b":"x"}') AS digest FROM events""")
def canonical_digest(spark, sf_dir):
    """A digest of JSON that doesn't depend on the order of keys or on spaces."""
    digest = N.arrow("string", lambda text: reports.digest(json.loads(text)))
    written = F.when(F.col("event_id") % 2 == 0, F.format_string('{"b": "x",  "a": %d}', "event_id")).otherwise(F.format_string('{"a":%d,"b":"x"}', "event_id"))
    return read(spark, sf_dir, "events").select("event_id", digest(written).alias("digest"))


@query(f"""{RECORDS}, l AS (SELECT answer_type, id, length(note) + length(question) AS len FROM r), m AS (SELECT answer_type, quantile_disc(len, 0.5) AS middle FROM l GROUP BY 1)
SELECT answer_type, id FROM (SELECT l.*, row_number() OVER (PARTITION BY answer_type ORDER BY abs(len - middle), id) AS place FROM l JOIN m USING (answer_type)) WHERE place <= 2""")
def few_shot(spark, sf_dir):
    return chat.few_shot(cases.records(spark, sf_dir), 2).select("answer_type", "id")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'draft' WHEN doc_id % 5 = 2 THEN 'CHANGED' ELSE 'approved' END AS state FROM documents""")
def approvals(spark, sf_dir):
    """Approvals by digest: missing, draft, changed since, approved."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    given = docs.where("id % 5 <> 0").select("id", F.when(F.col("id") % 5 == 2, "0").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("id") % 5 == 1, "draft").otherwise("approved").alias("status"))
    return views.approval_state(docs, given).select(F.col("id").alias("doc_id"), "state")


@query("SELECT max(event_id)::BIGINT AS step, event_id // 500 AS epoch FROM events WHERE event_id % 500 = 0 GROUP BY 2")
def epoch_ends(spark, sf_dir):
    """Rows of a log at whole epochs."""
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("event_id") / 500).alias("epoch"))
    return views.epoch_ends(log).select("step", F.rint("epoch").cast("long").alias("epoch"))
