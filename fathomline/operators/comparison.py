"""Runs and their comparison: records joined with rollouts, bundles of rates, subsets, paired outcomes, strata, changed fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators import relational as R
from fathomline.operators import statistics as S


def with_rollouts(records: DataFrame, rollouts: DataFrame, complete: bool = False) -> DataFrame:
    """Records that have a rollout (id, final, stop_reason, bad_status, calls), as scoring takes them; with complete, ids must be the same on both sides."""
    if complete:
        R.require_full_coverage(records, rollouts, "id")
    of_record = records.select("id", "split", "ord", "answer_type", F.col("answer").alias("gold"), "note", F.col("table.rows").alias("rows"), "question", F.try_element_at("tool_calls", F.lit(1)).alias("gold_call"))
    return of_record.join(rollouts.select("id", "final", "stop_reason", "bad_status", "calls"), "id")


#: Rates of a run: name, the rows that count, and the flag (null: doesn't apply).
RATES: dict[str, tuple[str, str]] = {
    "extractive_accuracy": ("answer_type = 'extractive'", "correct"), "numeric_accuracy": ("answer_type = 'numeric_reasoning'", "correct"),
    "tool_selection_accuracy": ("answer_type = 'tool_call'", "tool_selected"), "tool_argument_accuracy": ("answer_type = 'tool_call'", "tool_args_correct"),
    "tool_argument_accuracy_given_call": ("answer_type = 'tool_call' and called", "tool_args_correct"), "tool_execution_success": ("answer_type = 'tool_call'", "tool_executed"),
    "tool_result_in_answer": ("answer_type = 'tool_call'", "result_in_answer"), "tool_e2e": ("answer_type = 'tool_call'", "correct"),
    "uncertainty_detection_rate": ("answer_type = 'uncertain'", "correct"), "over_call_rate": ("answer_type <> 'tool_call'", "over_call"),
    "over_refusal_rate": ("answer_type <> 'uncertain'", "over_refusal"), "unsupported_argument_rate": ("true", "unsupported_args"),
}
MACRO = ["extractive_accuracy", "numeric_accuracy", "tool_e2e", "uncertainty_detection_rate"]


def bundle(scored: DataFrame, by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """All rates of scored rows in one aggregation, as rows of by, metric, k, n, rate, low, high; macro_task_success has no k and is null where one of its four rates is. With names, these
    rates only, so that what only others read isn't judged."""
    by = by or []
    flags = {name: F.when(F.expr(rows), F.col(flag)) for name, (rows, flag) in RATES.items() if names is None or name in names}
    sums = scored.groupBy(*by).agg(*[x for name, f in flags.items() for x in (F.count_if(f).alias(f"{name}_k"), F.count(f).alias(f"{name}_n"))])
    rate = lambda name: F.round(F.try_divide(F.col(f"{name}_k").cast("double"), F.col(f"{name}_n").cast("double")), 4)
    bounds = lambda name: S.wilson(F.col(f"{name}_k"), F.col(f"{name}_n"))
    one = lambda name: F.struct(F.lit(name).alias("metric"), F.col(f"{name}_k").alias("k"), F.col(f"{name}_n").alias("n"), rate(name).alias("rate"), bounds(name)["low"].alias("low"), bounds(name)["high"].alias("high"))
    if names is not None:
        return sums.select(*by, F.explode(F.array(*map(one, flags))).alias("m")).select(*by, "m.*")
    null = F.lit(None)
    macro = F.struct(F.lit("macro_task_success").alias("metric"), null.cast("long").alias("k"), null.cast("long").alias("n"), F.round(reduce(lambda a, b: a + b, map(rate, MACRO)) / 4, 4).alias("rate"), null.cast("double").alias("low"), null.cast("double").alias("high"))
    return sums.select(*by, F.explode(F.array(*map(one, RATES), macro)).alias("m")).select(*by, "m.*")


def tagged(scored: DataFrame, flagged: DataFrame) -> DataFrame:
    """Rows once for each subset that they are in: full, and grounded or flagged."""
    marked = scored.join(flagged.select("id").distinct().withColumn("is_flagged", F.lit(True)), "id", "left")
    own = F.when(F.col("is_flagged"), "flagged").otherwise("grounded")
    return marked.withColumn("subset", F.explode(F.array(F.lit("full"), own))).drop("is_flagged")


def errors(scored: DataFrame) -> DataFrame:
    """How often each error occurs by answer type; correct answers as correct."""
    return scored.groupBy("answer_type", F.coalesce("error", F.lit("correct")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def paired(a: DataFrame, b: DataFrame, names: int = 5) -> DataFrame:
    """Two scored runs over the items that both have: by answer type n, right answers of each, the difference, items fixed, broken and wrong in both, and the
    first broken ids."""
    # Written, as verdicts are dear and pairs are read twice.
    pairs = R.written(a.select("id", "answer_type", F.col("correct").alias("a")).join(b.select("id", F.col("correct").alias("b")), "id"), "pairs")
    # Broken ids come first in an order, instead of by a filter: a filter on verdicts would be pushed down as all of the expressions behind them.
    marked = pairs.withColumn("broken_id", F.when(F.col("a") & ~F.col("b"), F.col("id")))
    few = R.first_of(marked, ["answer_type"], [F.col("broken_id").asc_nulls_last()], names).groupBy("answer_type").agg(F.sort_array(F.collect_list("broken_id")).alias("broken_ids"))
    sums = pairs.groupBy("answer_type").agg(F.count("id").alias("n"), F.count_if("a").alias("a"), F.count_if("b").alias("b"), *S.paired_outcomes(F.col("a"), F.col("b")))
    rows = sums.join(few, "answer_type", "left").withColumn("diff", F.round((F.col("b") - F.col("a")) / F.col("n"), 4))
    return rows.select("answer_type", "n", "a", "b", "diff", "fixed", "broken", "both_wrong", F.coalesce("broken_ids", F.array().cast("array<string>")).alias("broken_ids"))


def stratum(votes: Column) -> Column:
    """Of an array of verdicts (true, false, null for open): disagree if there are both, agree if all are alike, else open."""
    has = lambda v: F.exists(votes, lambda x: x.eqNullSafe(F.lit(v)))
    return F.when(has(True) & has(False), "disagree").when((F.size(votes) > 0) & F.forall(votes, lambda x: x.isNotNull()), "agree").otherwise("open")


def changed(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field: rows of both runs that differ in it (null-safely), and rows that are alike."""
    joined = a.select(key, *[F.col(f).alias(f"{f}_a") for f in fields]).join(b.select(key, *[F.col(f).alias(f"{f}_b") for f in fields]), key)
    differs = F.array(*[F.struct(F.lit(f).alias("field"), (~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))).alias("d")) for f in fields])
    return joined.select(F.explode(differs).alias("x")).groupBy("x.field").agg(F.count_if("x.d").alias("changed"), F.count_if(~F.col("x.d")).alias("alike"))


def length_batches(df: DataFrame, length: str, key: str, size: int, width: int = 64) -> DataFrame:
    """df with batch: rows of like length, the longest first, `size` in each; lengths are ranked in ranges of `width`."""
    rows = R.placed(df, [], -F.floor(F.col(length) / width), [F.desc(length), F.asc(key)], "at_")
    return rows.withColumn("batch", F.floor(F.col("at_") / size).cast("long")).drop("at_")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often."""
    return R.symmetric_difference(a, b).isEmpty()


def select_run(runs: DataFrame, band: float = 0.005) -> DataFrame:
    """runs: label, ord, macro, unsupported, over_call. The run that is chosen: of those within the band of the best macro the one with the fewest unsupported
    arguments, then over-calls, then the first."""
    return R.near_best(runs, "macro", band, [F.asc("unsupported"), F.asc("over_call"), F.asc("ord")])


def audit_rates(stored: DataFrame, scored: DataFrame) -> DataFrame:
    """Rates of a run as they were stored (metric, k, n) against those of its rows judged again: metrics that differ, with both."""
    again = bundle(scored).where("k is not null").select("metric", F.col("k").alias("k2"), F.col("n").alias("n2"))
    both = stored.where("k is not null").select("metric", "k", "n").join(again, "metric", "full")
    return both.where(~(F.col("k").eqNullSafe(F.col("k2")) & F.col("n").eqNullSafe(F.col("n2"))))
