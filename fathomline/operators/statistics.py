"""Evaluation statistics as aggregations and windows.

Aggregations are partial before they shuffle. Windows run over counted values, in parts of a group (`running`); only windows over parts or
groups are in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.relational import written

Z = 1.96


def wilson(k: Column, n: Column, clamp: bool = False, z: float = Z) -> Column:
    """Bounds of the score interval of k of n as a struct low, high, to four places; null where n is 0. Not clamped to [0, 1] unless asked."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, d = k / n, 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (centre - half) / d, (centre + half) / d
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return F.struct(F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def rate(flag: Column) -> dict[str, Column]:
    """k, n and rate of a three-valued flag: null means that it doesn't apply."""
    k, n = F.count_if(flag), F.count(flag)
    return {"k": k, "n": n, "rate": F.round(F.try_divide(k.cast("double"), n.cast("double")), 4)}


def counts_with_percent(df: DataFrame, key: str, domain: DataFrame) -> DataFrame:
    """Counts over a fixed domain of keys, zeros included, with percent of all to one place."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = domain.join(counts, key, "left").withColumn("total", df.agg(F.count(F.lit(1))).scalar())
    n = F.coalesce(F.col("n"), F.lit(0))
    return joined.select(key, n.alias("n"), F.round(F.try_divide(100.0 * n, F.col("total").cast("double")), 1).alias("pct"))


def nearest_rank(q: float) -> Column:
    """The place (from 0) of the value at rank ceil(q * n), without interpolation, as at_index takes it."""
    return F.greatest(F.ceil(F.lit(q) * F.col("n")) - 1, F.lit(0))


def quantiles(df: DataFrame, value: str, names: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Values at nearest ranks by name, found by counts of values: no task holds a group."""
    return at_index(df, value, {name: nearest_rank(q) for name, q in names.items()}, by)


def interpolated(df: DataFrame, value: str, names: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Quantiles by name, interpolated between the two values next to q * (n - 1): exact for any number of different values, as only these two are selected."""
    by = by or []
    at = {name: F.lit(q) * (F.col("n") - 1) for name, q in names.items()}
    sides = {f"{name}__{side}": f(place) for name, place in at.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = at_index(df, value, sides | {"n__all": None}, by)
    share = {name: F.lit(q) * (F.col("n__all") - 1) - F.floor(F.lit(q) * (F.col("n__all") - 1)) for name, q in names.items()}
    low, high = (lambda name: F.col(f"`{name}__low`").cast("double")), (lambda name: F.col(f"`{name}__high`").cast("double"))
    return found.select(*by, *[(low(name) + (high(name) - low(name)) * share[name]).alias(name) for name in names])


def describe(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, mean, min, max and quantiles of a column by group. Values are counted first, and everything is read from the counts."""
    return at_index(df, column, {"median": nearest_rank(0.5), "p5": nearest_rank(0.05), "p95": nearest_rank(0.95)}, by, [
        F.sum("times").alias("n"), F.round(F.sum(F.col(column).cast("double") * F.col("times")) / F.sum("times"), 1).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")])


def part_of(cuts: Column, value: Column, parts: int) -> Column:
    """How many of at most `parts` sorted cuts are below a value, by halves instead of looking at each."""
    steps = [1 << k for k in reversed(range(parts.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def in_parts(counts: DataFrame, by: list[str], value: str, columns: list[str], parts: int = 200) -> tuple[DataFrame, DataFrame]:
    """counts (written; a row for each different number `value` of a group) with __part, as a group's values are cut at approximate percentiles; and for each part (by as __by, __of) what
    its columns sum to, what they sum to in the parts before (__of_), and in all (_all). Both small tables are written, so Spark knows that they needn't be shuffled to."""
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10_000).alias("__cuts"))
    cuts = written(cuts.select(*[F.col(b).alias(f"__cut_{b}") for b in by], "__cuts"), "cuts")
    joined = counts.join(cuts, [F.col(b).eqNullSafe(F.col(f"__cut_{b}")) for b in by]) if by else counts.crossJoin(cuts)  # one row
    rows = joined.select(*counts.columns, part_of(F.col("__cuts"), F.col(value), parts - 1).alias("__part"))
    sums = rows.groupBy(*by, "__part").agg(*[F.sum(c).alias(c) for c in columns])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__of_{c}") for c in columns]
    offsets = sums.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__part").alias("__of"), *[F.col(c).alias(f"__sum_{c}") for c in columns], *before, *[F.sum(c).over(group).alias(f"{c}_all") for c in columns])
    return rows, written(offsets, "offsets")


def inside_parts(rows: DataFrame, offsets: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    """Rows of the parts that `offsets` holds, with sums over smaller values of the group (_before) and over all (_all)."""
    joined = rows.join(offsets, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by] + [F.col("__part") == F.col("__of")])
    smaller = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.coalesce(F.sum(c).over(smaller), F.lit(0)) + F.col(f"__of_{c}")).alias(f"{c}_before") for c in columns]
    return joined.select(*[c for c in rows.columns if c != "__part"], *sums, *[f"{c}_all" for c in columns])


def running(counts: DataFrame, by: list[str], value: str, columns: list[str], parts: int = 200) -> DataFrame:
    """counts (a row for each different number `value` of a group) with, for each column, its sum over smaller values (_before) and over all (_all).

    Sums run within a part of a group, and parts add what lies in those before. So no task holds more than a part of a group, also where each row has a value of its own. Counts are read
    three times, so they are written first."""
    rows, offsets = in_parts(written(counts, "counts"), by, value, columns, parts)
    return inside_parts(rows, offsets, by, value, columns)


def at_index(df: DataFrame, value: str, places: dict[str, Column | None], by: list[str] | None = None, more: list[Column] | None = None) -> DataFrame:
    """Values at sorted positions; a place is an expression of n, the number of values, counted from 0 (None: n itself). Values are counted first, and only parts of a group in which a
    place lies are sorted. more: aggregates of the counts (value, times)."""
    by = by or []
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times")), "counts")
    rows, offsets = in_parts(counts, by, value, ["times"])
    ats = {name: at for name, at in places.items() if at is not None}
    within = lambda at, before, times: (at >= F.col(before)) & (at < F.col(before) + F.col(times))
    held = F.exists(F.array(F.lit(False), *[within(at, "__of_times", "__sum_times") for at in ats.values()]), lambda x: x)
    few = written(offsets.withColumn("n", F.col("times_all")).where(held).drop("n"), "few")
    ranked = inside_parts(rows, few, by, value, ["times"]).withColumn("n", F.col("times_all"))
    found = ranked.groupBy(*[F.col(b).alias(f"__in_{b}") for b in by]).agg(F.lit(True).alias("__found"), *[F.min(F.when(within(at, "times_before", "times"), F.col(value))).alias(name) for name, at in ats.items()])
    whole = counts.groupBy(*by).agg(F.sum("times").alias("__n"), *more or [])
    both = whole.join(found, [F.col(b).eqNullSafe(F.col(f"__in_{b}")) for b in by], "left") if by else whole.crossJoin(found)  # one row each
    names = [F.col("__n").alias(name) if at is None else F.col(f"`{name}`") for name, at in places.items()]  # a name may hold a point, as p0.5
    return both.select(*by, *names, *[F.col(c) for c in whole.columns if c not in by and c != "__n"])


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """The different values with their rank; equal values share the average of their ranks."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("times"))
    return running(counts, [], value, ["times"]).select(value, (F.col("times_before") + 1 + (F.col("times") - 1) / F.lit(2.0)).alias("rank"))


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney area with average ranks for ties; null with one class. Scores are counted before they are ranked."""
    by = by or []
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    ranked = running(counts, by, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    return ranked.groupBy(*by).agg(F.round(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")), 6).alias("auroc"))


def bins(score: Column, n: int) -> Column:
    """Equal-width bin of a probability, the last one closed."""
    return F.least(F.floor(score * n), F.lit(n - 1)).cast("int")


def reliability(df: DataFrame, score: str, label: str, n: int = 10, second: str | None = None) -> DataFrame:
    """Bins with mean score and rate of the label, and of a second label (rate2)."""
    more = [F.avg(F.col(second).cast("double")).alias("y2")] if second else []
    rows = df.groupBy(bins(F.col(score), n).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("p"), F.avg(F.col(label).cast("double")).alias("y"), *more)
    rates = [F.round("y2", 6).alias("rate2")] if second else []
    return rows.select("bin", "n", F.round("p", 6).alias("mean_p"), F.round("y", 6).alias("rate"), *rates, (F.abs(F.col("p") - F.col("y")) * F.col("n")).alias("gap"))


def ece(df: DataFrame, score: str, label: str, n: int = 10) -> DataFrame:
    """Expected calibration error; null for no rows."""
    return reliability(df, score, label, n).agg(F.round(F.try_divide(F.sum("gap"), F.sum("n").cast("double")), 6).alias("ece"))


def risk_coverage(df: DataFrame, score: str, correct: str, tie: str, cuts: int = 10) -> DataFrame:
    """Accuracy of the most confident rows at each coverage: of max(1, round half even (coverage * n)) rows, highest score first, then tie.

    Rows are counted by score first; a cut falls among the rows of one score, which alone are ranked by tie, in ranges of it if there are many."""
    rows = df.select(score, tie, F.col(correct).cast("long").alias("ok"))
    counts = rows.groupBy(score).agg(F.count(F.lit(1)).alias("rows"), F.sum("ok").alias("oks"))
    sums = running(counts.withColumn("down", -F.col(score)), [], "down", ["rows", "oks"]).withColumn("n", F.col("rows_all"))
    at = [F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(c) / cuts).cast("int")) for c in range(1, cuts + 1)]
    holds = (F.col("k") > F.col("rows_before")) & (F.col("k") <= F.col("rows_before") + F.col("rows"))
    asked = sums.select(score, "rows", "rows_before", "oks_before", "n", F.explode(F.array_distinct(F.array(*at))).alias("k")).where(holds)  # at most `cuts` rows
    spread = rows.join(F.broadcast(asked.select(score).distinct()), score).groupBy(score, tie).agg(F.count(F.lit(1)).alias("rows"), F.sum("ok").alias("oks"))
    inside = running(spread, [score], tie, ["rows", "oks"]).select(F.col(score).alias("s"), "rows", "oks", F.col("rows_before").alias("of_rows"), F.col("oks_before").alias("of_oks"))
    left = F.col("k") - F.col("rows_before")
    # Of rows with the same score and tie as many count as are needed, the right ones last.
    last = inside.join(F.broadcast(asked.withColumnRenamed("rows", "all_rows")), F.col("s") == F.col(score)).where((left > F.col("of_rows")) & (left <= F.col("of_rows") + F.col("rows")))
    taken = left - F.col("of_rows")
    right = F.col("oks_before") + F.col("of_oks") + F.greatest(F.lit(0), taken - (F.col("rows") - F.col("oks")))
    return last.select(F.col("k").cast("long").alias("k"), F.round(F.col("k") / F.col("n"), 4).alias("coverage"), F.round(right / F.col("k"), 6).alias("accuracy"))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")]


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two raters, for any number of categories; kappa is null if chance alone agrees always."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = cells.select(F.col("a").alias("c"), F.col("n").alias("na"), F.lit(0).alias("nb"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same")).unionByName(
        cells.select(F.col("b").alias("c"), F.lit(0).alias("na"), F.col("n").alias("nb"), F.lit(0).alias("same"))
    )
    sums = every.groupBy("c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same")).agg(
        F.sum("na").alias("n"), F.sum("same").alias("same"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance")
    )
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return sums.select("n", F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test: 2 * P(X <= min) for a fair coin, at most 1; 1 without trials. In logarithms, so that no count is too large."""
    n, k = wins + losses, F.least(wins, losses)
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), i), F.lit(0.0), lambda s, j: s + F.log((n - j + 1).cast("double")) - F.log(j.cast("double")))
    terms = F.transform(F.sequence(F.lit(0), k.cast("int")), lambda i: F.exp(F.when(i == 0, F.lit(0.0)).otherwise(log_choose(i)) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def paired_outcomes(a: Column, b: Column) -> list[Column]:
    return [F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broken"), F.count_if(~a & ~b).alias("both_wrong"), F.count_if(a & b).alias("both_right")]


def resampled(df: DataFrame, value: str, by: list[str], resamples: int, seed: int) -> DataFrame:
    """Poisson bootstrap of sums: by, resample, w (rows drawn), s (their sum).

    A resample draws each row Poisson(1) times, so rows of equal value together Poisson(count) times: values are counted first, and each different
    value of a group is drawn once a resample, whatever the number of rows. Draws depend on group, value and seed alone."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select(*by, "x", "n", F.xxhash64(*by, "x", F.lit(seed)).alias("key"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in by)

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            drawn = [np.random.default_rng(key % (1 << 64)).poisson(n, resamples) for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(b) for b in by], batch.column("x"), pa.array(drawn, pa.list_(pa.int64()))], names=[*by, "x", "w"])

    weights = cells.mapInArrow(kernel, f"{keys + ', ' if by else ''}x double, w array<bigint>").select(*by, "x", F.posexplode("w").alias("resample", "w"))
    return weights.groupBy(*by, "resample").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("s"))


def interval(means: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Bounds of a column of resamples: as many rows a group as there are resamples, whatever the data, so a group's are sorted at once."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")
    return means.groupBy(*by).agg(at(0.025).alias("low"), at(0.975).alias("high"), F.count(column).alias("resamples"))


def bootstrap(df: DataFrame, value: str, resamples: int = 1000, seed: int = 17, by: list[str] | None = None) -> DataFrame:
    """Percentile interval of the mean."""
    by = by or []
    return interval(resampled(df, value, by, resamples, seed).withColumn("m", F.try_divide("s", F.col("w").cast("double"))), "m", by)


def paired_bootstrap(pairs: DataFrame, a: str, b: str, resamples: int = 1000, seed: int = 17, by: list[str] | None = None) -> DataFrame:
    """Of rows with the outcomes of two runs on the same item: n, both rates, their difference b - a, and its percentile interval (items are drawn, not outcomes)."""
    by = by or []
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("xa"), F.col(b).cast("double").alias("xb"))
    sums = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("xa"), 4).alias("a"), F.round(F.avg("xb"), 4).alias("b"), F.round(F.avg(F.col("xb") - F.col("xa")), 4).alias("diff"))
    bounds = bootstrap(both.withColumn("d", F.col("xb") - F.col("xa")), "d", resamples, seed, by)
    return sums.join(bounds, by) if by else sums.crossJoin(bounds)  # one row each


def macro_bootstrap(df: DataFrame, value: str, group: str, resamples: int = 1000, seed: int = 17) -> DataFrame:
    """Percentile interval of the unweighted mean of group means: groups are resampled by themselves, the mean is taken in each resample."""
    means = resampled(df, value, [group], resamples, seed).withColumn("m", F.try_divide("s", F.col("w").cast("double")))
    macro = means.groupBy("resample").agg(F.avg("m").alias("macro"), F.count("m").alias("groups"))
    bounds = interval(macro, "macro", [])
    return bounds.select("low", "high").crossJoin(macro.agg(F.max("groups").alias("groups")))  # one row each


def tri_state(outcomes: Column) -> Column:
    """fail if any fails; review if there is none or any needs review; else pass."""
    return F.when(F.exists(outcomes, lambda o: o == "fail"), "fail").when((F.size(outcomes) == 0) | F.exists(outcomes, lambda o: o == "review"), "review").otherwise("pass")


def typed_aggregate(scores: DataFrame, parts: tuple[str, ...] = ("types", "checks")) -> DataFrame:
    """Rates of typed verdicts (answer_type, correct, before, expected, checks of kind and ok, name_ok, outcome_ok) as rows of metric, k, n, rate:
    by type the new and the former verdict and for calls a funnel whose later steps count only where they apply (types), and by kind of check (checks). A part that isn't asked for isn't worked out."""
    tool, call = F.col("answer_type") == "tool_call", (F.col("answer_type") == "tool_call") & (F.col("expected") == "call")
    one = lambda metric, flag, holds=F.lit(True): F.when(holds, F.struct(metric.alias("metric"), flag.alias("flag")))
    own = F.array_compact(F.array(
        one(F.concat("answer_type", F.lit(" now")), F.col("correct")), one(F.concat("answer_type", F.lit(" before")), F.col("before")), one(F.concat(F.lit("expected "), "expected"), F.col("correct"), tool),
        one(F.lit("name if called"), F.col("name_ok"), call), one(F.lit("outcome if called"), F.col("outcome_ok"), call),
    ))
    checks = F.transform(F.coalesce("checks", F.array().cast(dict(scores.dtypes)["checks"])), lambda c: F.struct(F.concat(F.lit("check "), c["kind"]).alias("metric"), c["ok"].alias("flag")))
    r, rows = rate(F.col("m.flag")), {"types": own, "checks": checks}
    return scores.select(F.explode(F.concat(*[rows[p] for p in parts])).alias("m")).groupBy("m.metric").agg(r["k"].alias("k"), r["n"].alias("n"), r["rate"].alias("rate"))


def resolved(rows: DataFrame, status: str, by: list[str]) -> DataFrame:
    """Of pass, fail and review: how many are resolved (not for review), and how many of these pass."""
    is_ = lambda v: F.col(status) == v
    done = F.count_if(~is_("review"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), done.alias("resolved"), F.count_if(is_("pass")).alias("passed"), F.round(F.try_divide(done.cast("double"), F.count(F.lit(1)).cast("double")), 4).alias("coverage"),
        F.round(F.try_divide(F.count_if(is_("pass")).cast("double"), done.cast("double")), 4).alias("rate"),
    )
