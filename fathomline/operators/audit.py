"""Audit of a former run: what was stored of it, against what its records and rollouts give when they are judged again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import notes as N
from fathomline.operators import comparison as M
from fathomline.operators import statistics as S
from fathomline.sources.staging import scratch

#: Fields of a verdict that are compared, each null-safely.
VERDICT = ["error", "correct", "abstained", "over_refusal", "over_call", "tool_selected", "tool_args_correct", "tool_executed", "result_in_answer", "unsupported_args"]
FINDING = ["level", "key", "field", "stored", "again"]


def findings(df: DataFrame, level: str, key: Column, field: Column, stored: Column, again: Column) -> DataFrame:
    return df.select(F.lit(level).alias("level"), key.cast("string").alias("key"), field.cast("string").alias("field"), stored.cast("string").alias("stored"), again.cast("string").alias("again"))


def verdicts(stored: DataFrame, again: DataFrame, key: list[str], fields: list[str] | None = None) -> DataFrame:
    """Findings of single verdicts: items that one side lacks or holds more than once, and fields that differ. Null keys are keys like others; keys are joined by slashes."""
    fields = [f for f in fields or VERDICT if f in stored.columns]
    packed = lambda df, side: df.groupBy(*[F.col(k).alias(f"{side}_{k}") for k in key]).agg(F.count(F.lit(1)).alias(f"{side}_times"), F.min(F.struct(*fields)).alias(side))
    same = None
    for k in key:
        one = F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        same = one if same is None else same & one
    both = packed(stored, "a").join(packed(again, "b"), same, "full")
    name = F.concat_ws("/", *[F.coalesce(F.coalesce(f"a_{k}", f"b_{k}").cast("string"), F.lit("null")) for k in key])
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    times = F.when(~F.col("a_times").eqNullSafe(F.col("b_times")) | (F.col("a_times") > 1), F.struct(F.lit("times").alias("field"), F.coalesce("a_times", F.lit(0)).cast("string").alias("stored"), F.coalesce("b_times", F.lit(0)).cast("string").alias("again")))
    there = F.col("a_times").isNotNull() & F.col("b_times").isNotNull()
    differs = [F.when(there & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), text(F.col(f"a.{f}")).alias("stored"), text(F.col(f"b.{f}")).alias("again"))) for f in fields]
    rows = both.select(name.alias("key"), F.explode(F.array_compact(F.array(times, *differs))).alias("d"))
    return findings(rows, "verdict", F.col("key"), F.col("d.field"), F.col("d.stored"), F.col("d.again"))


def rates(stored: DataFrame, again: DataFrame, by: list[str]) -> DataFrame:
    """Findings of stored rates (by, metric, k, n) against all rates of the rows judged again, by subset: differing counts, and rates that one side lacks."""
    made = M.bundle(again, by).where("k is not null").select(*[F.col(b).alias(f"b_{b}") for b in [*by, "metric"]], F.concat_ws("/", "k", "n").alias("again"))
    kept = stored.where("k is not null").select(*by, "metric", F.concat_ws("/", "k", "n").alias("stored"))
    same = None
    for b in [*by, "metric"]:
        one = F.col(b).eqNullSafe(F.col(f"b_{b}"))
        same = one if same is None else same & one
    both = kept.join(made, same, "full").where(~F.col("stored").eqNullSafe(F.col("again")))
    key = F.concat_ws("/", *[F.coalesce(F.coalesce(b, f"b_{b}").cast("string"), F.lit("null")) for b in by])
    return findings(both, "rate", key, F.coalesce("metric", "b_metric"), F.coalesce("stored", F.lit("none")), F.coalesce("again", F.lit("none")))


def written(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Columns of judged rows, written and read again: judging is dear, and more than one thing is asked of it."""
    narrow = df.select(*dict.fromkeys(c for c in columns if c in df.columns))
    path = scratch(df.sparkSession, name)
    narrow.write.parquet(path)
    return df.sparkSession.read.schema(narrow.schema).parquet(path)


def audit(stored: DataFrame, again: DataFrame, stored_rates: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """All findings of a run; without any it is what it says. Rows of `again` may carry a column subset, as tagged gives it: a row for each; verdicts are then those of full."""
    judged = written(again, [*key, *by, "subset", "answer_type", "called", *VERDICT], "audit")
    first = judged.where(F.col("subset") == "full") if "subset" in judged.columns else judged
    return verdicts(stored, first, key).unionByName(rates(stored_rates, judged, by))


def subgroup(flagged: Column) -> Column:
    """What a judged row is grouped under: flagged (the input lacks what its call takes), unit_convert, bmi_imperial and bmi_metric (where the gold arguments come from), uncertain_ and
    what is missing, else its type."""
    imperial = F.contains("arg_detail", F.lit("imperial"))
    tool = F.when(F.col("gold_call.tool") == "calculate_bmi", F.when(imperial, "bmi_imperial").otherwise("bmi_metric")).otherwise(F.col("gold_call.tool"))
    uncertain = F.concat(F.lit("uncertain_"), F.coalesce(N.uncertain_class_of(F.col("question"), F.col("gold")), F.lit("other")))
    return F.when(flagged, "flagged").when(F.col("answer_type") == "uncertain", uncertain).when(F.col("answer_type") == "tool_call", F.coalesce(tool, F.lit("tool_call"))).otherwise(F.col("answer_type"))


def by_subgroup(judged: DataFrame, group: str, tokens: str) -> DataFrame:
    """Per group: n, right ones, the most common error (ties: the first by name; null if there is none), mean tokens and their interpolated 95th percentile, by ranks and not by a buffer of a group."""
    rows = written(judged, [group, "error", "correct", tokens], "subgroups").withColumn(group, F.coalesce(group, F.lit("none")))
    # Errors are of few kinds, so what is grouped the second time is small.
    errors = rows.groupBy(group, "error").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"), F.sum(tokens).alias("sum"), F.count(tokens).alias("of"))
    most = F.min(F.when(F.col("error").isNotNull(), F.struct((-F.col("n")).alias("n"), "error")))["error"]
    sums = errors.groupBy(group).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.try_divide(F.sum("sum"), F.sum("of")).alias("mean_tokens"), most.alias("most_common_error"))
    return sums.join(S.interpolated(rows.where(F.col(tokens).isNotNull()), tokens, {"p95_tokens": 0.95}, [group]), group, "left").select(group, "n", "k", "most_common_error", "mean_tokens", "p95_tokens")
