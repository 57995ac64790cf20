"""Queries of evaluation statistics. A document's score is a fixed function of its id, so that both engines see the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import statistics as S
from fathomline.plans.registry import query
from fathomline.sources.tables import read

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\s]+'))"
SCORED_SQL = "scored AS (SELECT doc_id, source, lang, toxic = 1 AS toxic, quality = 1 AS good, ((doc_id * 7919) % 101) / 100.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"


def words(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\s]+"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.select("doc_id", "source", "lang", (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 1).alias("good"), ((F.col("doc_id") * 7919) % 101 / F.lit(100.0)).alias("p"))


WILSON_SQL = """round(({k}::DOUBLE / {n} + 1.96 * 1.96 / (2 * {n}) {s} 1.96 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 1.96 * 1.96 / (4 * {n}::DOUBLE * {n}))) / (1 + 1.96 * 1.96 / {n}), 4)::DOUBLE"""


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    return tuple(WILSON_SQL.format(k=k, n=f"nullif({n}, 0)::DOUBLE", s=s) for s in "-+")


LOW, HIGH = wilson_sql("k", "n")


@query(f"""
WITH a AS (SELECT source, count_if(quality = 1) AS k, count(quality) AS n, sum({WORDS_SQL})::BIGINT AS words FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, k::BIGINT AS k, n::BIGINT AS n, words, {LOW} AS low, {HIGH} AS high FROM a""")
def label_rate_wilson(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("words"))
    joined = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    sums = joined.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("quality").alias("n"), F.sum("words").alias("words"))
    return sums.withColumn("w", S.wilson(F.col("k"), F.col("n"))).select("source", "k", "n", "words", "w.low", "w.high")


@query("""
WITH d AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS lang), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, coalesce(n, 0)::BIGINT AS n, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM documents), 1)::DOUBLE AS pct FROM d LEFT JOIN c USING (lang)""")
def count_by_key_pct(spark, sf_dir):
    domain = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "lang string")
    return S.counts_with_percent(read(spark, sf_dir, "documents").select("lang"), "lang", domain)


@query(f"""
SELECT lang, count(w)::BIGINT AS n, round(avg(w), 1)::DOUBLE AS mean, quantile_disc(w, 0.5)::DOUBLE AS median, min(w)::INTEGER AS min, quantile_disc(w, 0.05)::DOUBLE AS p5, quantile_disc(w, 0.95)::DOUBLE AS p95, max(w)::INTEGER AS max
FROM (SELECT lang, {WORDS_SQL} AS w FROM documents) GROUP BY lang""")
def describe_lengths(spark, sf_dir):
    found = S.describe(read(spark, sf_dir, "documents").select("lang", words(F.col("text")).alias("w")), "w", ["lang"])
    return found.select("lang", F.col("n").cast("long").alias("n"), "mean", *[F.col(c).cast("double").alias(c) for c in ("median", "p5", "p95")], "min", "max")


@query("SELECT l_returnflag, round(quantile_cont(v, 0.1), 6)::DOUBLE AS p10, round(quantile_cont(v, 0.5), 6)::DOUBLE AS median, round(quantile_cont(v, 0.975), 6)::DOUBLE AS p975 FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS v FROM lineitem) GROUP BY 1")
def interpolated_quantiles(spark, sf_dir):
    """Quantiles between values, of a column in which nearly every row has its own."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    found = S.interpolated(rows, "v", {"p10": 0.1, "median": 0.5, "p975": 0.975}, ["l_returnflag"])
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p975")])


@query("""
WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT lang, min(CASE WHEN spot = round_even(0.9 * (n - 1), 0) THEN n_chars END) AS p90, min(CASE WHEN spot = n // 2 THEN n_chars END) AS upper_median FROM s GROUP BY lang""")
def index_percentiles(spark, sf_dir):
    places = {"p90": F.bround(F.lit(0.9) * (F.col("n") - 1)), "upper_median": F.floor(F.col("n") / 2)}
    return S.at_index(read(spark, sf_dir, "documents"), "n_chars", places, ["lang"])


BUNDLE_SQL = """count(*)::BIGINT AS n, count_if(toxic)::BIGINT AS toxic_k, count(toxic)::BIGINT AS toxic_n, round(count_if(toxic)::DOUBLE / nullif(count(toxic), 0), 4)::DOUBLE AS toxic_rate,
  round(count_if(good AND NOT toxic)::DOUBLE / nullif(count_if(NOT toxic), 0), 4)::DOUBLE AS good_of_clean, round(count_if(p >= 0.5)::DOUBLE / nullif(count(p), 0), 4)::DOUBLE AS confident"""


def bundle():
    toxic = S.rate(F.col("toxic"))
    return [
        F.count(F.lit(1)).alias("n"), toxic["k"].alias("toxic_k"), toxic["n"].alias("toxic_n"), toxic["rate"].alias("toxic_rate"),
        S.rate(F.when(~F.col("toxic"), F.col("good")))["rate"].alias("good_of_clean"), S.rate(F.col("p") >= 0.5)["rate"].alias("confident"),
    ]


@query(f"WITH {SCORED_SQL} SELECT lang, {BUNDLE_SQL} FROM scored GROUP BY lang")
def metric_bundle(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("lang").agg(*bundle())


@query(f"""WITH {SCORED_SQL}, t AS (SELECT *, unnest(CASE WHEN p > 0.2 AND good THEN ['all', 'grounded', 'good'] WHEN p > 0.2 THEN ['all', 'grounded'] WHEN good THEN ['all', 'good'] ELSE ['all'] END) AS subset FROM scored)
SELECT subset, {BUNDLE_SQL} FROM t GROUP BY subset""")
def metric_subsets(spark, sf_dir):
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("p") > 0.2, "grounded"), F.when(F.col("good"), "good")))
    return scored(spark, sf_dir).withColumn("subset", F.explode(tags)).groupBy("subset").agg(*bundle())


@query(f"""WITH {SCORED_SQL}, r AS (SELECT lang, count_if(toxic)::DOUBLE / count(*) AS rate FROM scored GROUP BY lang)
SELECT CASE WHEN count(*) = 4 THEN round(avg(rate), 6) END::DOUBLE AS macro, count(*)::BIGINT AS groups FROM r""")
def macro_average(spark, sf_dir):
    rates = scored(spark, sf_dir).groupBy("lang").agg(F.avg(F.col("toxic").cast("double")).alias("rate"))
    return rates.agg(F.when(F.count("rate") == 4, F.round(F.avg("rate"), 6)).alias("macro"), F.count(F.lit(1)).alias("groups"))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS rank FROM scored)
SELECT lang, round((sum(CASE WHEN toxic THEN rank END) - count_if(toxic)::DOUBLE * (count_if(toxic) + 1) / 2) / nullif(count_if(toxic) * count_if(NOT toxic), 0), 6)::DOUBLE AS auroc FROM r GROUP BY lang""")
def auroc_ties(spark, sf_dir):
    return S.auroc(scored(spark, sf_dir), "p", "toxic", ["lang"])


@query(f"""WITH {SCORED_SQL} SELECT doc_id, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE)::DOUBLE AS rank FROM scored""")
def average_rank(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", "p")
    return rows.join(S.average_ranks(rows, "p"), "p").select("doc_id", "rank")


BINS_SQL = "b AS (SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, avg(p) AS mp, avg(CASE WHEN toxic THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS y, avg(good::INT::DOUBLE) AS y2 FROM scored GROUP BY 1)"


@query(f"WITH {SCORED_SQL}, {BINS_SQL} SELECT round(sum(abs(mp - y) * n) / sum(n), 6)::DOUBLE AS ece FROM b")
def ece_10(spark, sf_dir):
    return S.ece(scored(spark, sf_dir), "p", "toxic")


@query(f"WITH {SCORED_SQL}, {BINS_SQL} SELECT bin, n::BIGINT AS n, round(mp, 6)::DOUBLE AS mean_p, round(y, 6)::DOUBLE AS rate, round(y2, 6)::DOUBLE AS rate2 FROM b")
def reliability_bins(spark, sf_dir):
    return S.reliability(scored(spark, sf_dir), "p", "toxic", second="good").drop("gap")


@query(f"WITH {SCORED_SQL} SELECT round(avg((p - CASE WHEN toxic THEN 1 ELSE 0 END) * (p - CASE WHEN toxic THEN 1 ELSE 0 END)), 6)::DOUBLE AS brier FROM scored")
def brier(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(F.avg(F.pow(F.col("p") - F.col("toxic").cast("int"), F.lit(2))), 6).alias("brier"))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT row_number() OVER w AS k, sum(CASE WHEN toxic THEN 1 ELSE 0 END) OVER w AS oks, count(*) OVER () AS n FROM scored WINDOW w AS (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT DISTINCT greatest(1, round_even(n * c / 10.0, 0))::BIGINT AS cut FROM (SELECT count(*) AS n FROM scored), (SELECT unnest(range(1, 11)) AS c))
SELECT k::BIGINT AS k, round(k::DOUBLE / n, 4)::DOUBLE AS coverage, round(oks::DOUBLE / k, 6)::DOUBLE AS accuracy FROM r JOIN c ON k = cut""")
def risk_coverage(spark, sf_dir):
    return S.risk_coverage(scored(spark, sf_dir), "p", "toxic", "doc_id")


@query(f"""WITH {SCORED_SQL} SELECT source, count_if(p >= 0.5 AND toxic)::BIGINT AS tp, count_if(p >= 0.5 AND NOT toxic)::BIGINT AS fp, count_if(NOT p >= 0.5 AND toxic)::BIGINT AS fn, count_if(NOT p >= 0.5 AND NOT toxic)::BIGINT AS tn FROM scored GROUP BY source""")
def confusion(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("source").agg(*S.confusion(F.col("p") >= 0.5, F.col("toxic")))


@query("""WITH c AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, count_if(a = b)::DOUBLE AS same FROM c),
m AS (SELECT sum(na * nb) AS chance FROM (SELECT a AS v, count(*)::DOUBLE AS na FROM c GROUP BY a) JOIN (SELECT b AS v, count(*)::DOUBLE AS nb FROM c GROUP BY b) USING (v))
SELECT n::BIGINT AS n, round(same / n, 6)::DOUBLE AS agreement, round((same / n - chance / (n * n)) / nullif(1 - chance / (n * n), 0), 6)::DOUBLE AS kappa FROM n, m""")
def kappa(spark, sf_dir):
    return S.kappa(read(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""WITH {SCORED_SQL}, a AS (SELECT source, (p >= 0.5) = toxic AS a, (p >= 0.3) = toxic AS b FROM scored)
SELECT source, count_if(NOT a AND b)::BIGINT AS fixed, count_if(a AND NOT b)::BIGINT AS broken, count_if(NOT a AND NOT b)::BIGINT AS both_wrong, count_if(a AND b)::BIGINT AS both_right FROM a GROUP BY source""")
def paired_partition(spark, sf_dir):
    a, b = (F.col("p") >= 0.5) == F.col("toxic"), (F.col("p") >= 0.3) == F.col("toxic")
    return scored(spark, sf_dir).groupBy("source").agg(*S.paired_outcomes(a, b))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT lang, source, count_if(p >= 0.9 AND toxic) AS w, count_if(p < 0.1 AND toxic) AS l FROM scored GROUP BY lang, source),
t AS (SELECT *, (w + l)::DOUBLE AS n, least(w, l) AS k FROM c)
SELECT lang, source, w::BIGINT AS wins, l::BIGINT AS losses, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, (k + 1)::BIGINT), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))))) END, 6)::DOUBLE AS p_value FROM t""")
def sign_test(spark, sf_dir):
    counts = scored(spark, sf_dir).groupBy("lang", "source").agg(F.count_if((F.col("p") >= 0.9) & F.col("toxic")).alias("wins"), F.count_if((F.col("p") < 0.1) & F.col("toxic")).alias("losses"))
    return counts.withColumn("p_value", F.round(S.sign_test(F.col("wins"), F.col("losses")), 6))


@query()
def bootstrap_ci(spark, sf_dir):
    """Paired: of the difference between two cuts of one score, by language."""
    a, b = (F.col("p") >= 0.5) == F.col("toxic"), (F.col("p") >= 0.3) == F.col("toxic")
    return S.paired_bootstrap(scored(spark, sf_dir).select("lang", a.alias("a"), b.alias("b")), "a", "b", by=["lang"])


@query()
def bootstrap_macro_ci(spark, sf_dir):
    """Of the unweighted mean over languages."""
    return S.macro_bootstrap(scored(spark, sf_dir), "toxic", "lang")


@query(f"""WITH {SCORED_SQL}, a AS (SELECT lang, ((p >= 0.5) = toxic)::INT AS a, ((p >= 0.3) = toxic)::INT AS b FROM scored)
SELECT lang, count(*)::BIGINT AS n, round(avg(a), 4)::DOUBLE AS a, round(avg(b), 4)::DOUBLE AS b, round(avg(b - a), 4)::DOUBLE AS diff FROM a GROUP BY lang""")
def paired_difference(spark, sf_dir):
    """The part of the paired comparison that draws nothing."""
    return bootstrap_ci(spark, sf_dir).select("lang", "n", "a", "b", "diff")


@query("""SELECT o_orderpriority, count(*)::BIGINT AS n, count_if(o_orderstatus <> 'P')::BIGINT AS resolved, count_if(o_orderstatus = 'F')::BIGINT AS passed, round(count_if(o_orderstatus <> 'P')::DOUBLE / count(*), 4)::DOUBLE AS coverage,
  round(count_if(o_orderstatus = 'F')::DOUBLE / nullif(count_if(o_orderstatus <> 'P'), 0), 4)::DOUBLE AS rate FROM orders GROUP BY 1""")
def resolved_coverage(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "review").when(F.col("o_orderstatus") == "F", "pass").otherwise("fail")
    return S.resolved(read(spark, sf_dir, "orders").withColumn("status", status), "status", ["o_orderpriority"])


@query("""WITH c AS (SELECT o_orderkey, list(CASE WHEN l_returnflag = 'R' AND l_discount > 0.09 THEN 'fail' WHEN l_linestatus = 'F' THEN 'review' ELSE 'pass' END) FILTER (WHERE l_orderkey IS NOT NULL) AS o FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT CASE WHEN list_contains(o, 'fail') THEN 'fail' WHEN o IS NULL OR list_contains(o, 'review') THEN 'review' ELSE 'pass' END AS verdict, count(*)::BIGINT AS n FROM c GROUP BY 1""")
def tri_state(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), "fail").when(F.col("l_linestatus") == "F", "review").otherwise("pass").alias("o"))
    checks = line.groupBy("l_orderkey").agg(F.collect_set("o").alias("o"))  # three values at most
    joined = read(spark, sf_dir, "orders").select("o_orderkey").join(checks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy(S.tri_state(F.coalesce("o", F.array().cast("array<string>"))).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN abs(v) < 10 THEN '<10' WHEN abs(v) < 50 THEN '10-50' WHEN abs(v) < 100 THEN '50-100' ELSE '>=100' END AS bucket, event_type, count(*)::BIGINT AS n FROM (SELECT value AS v, event_type FROM events WHERE value IS NOT NULL) GROUP BY 1, 2""")
def bucket_histogram(spark, sf_dir):
    v = F.abs("value")
    bucket = F.when(v < 10, "<10").when(v < 50, "10-50").when(v < 100, "50-100").otherwise(">=100")
    return read(spark, sf_dir, "events").where("value is not null").groupBy(bucket.alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(l_linenumber, 5)::INTEGER AS capped, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def capped_histogram(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.least("l_linenumber", F.lit(5)).alias("capped")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT printf('%+.1f', round(s_acctbal - floor(s_acctbal), 1)::DOUBLE) AS delta, count(*)::BIGINT AS n FROM supplier GROUP BY 1")
def delta_histogram(spark, sf_dir):
    return read(spark, sf_dir, "supplier").groupBy(F.format_string("%+.1f", F.round(F.col("s_acctbal") - F.floor("s_acctbal"), 1)).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count_if(o_orderpriority = '1-URGENT')::BIGINT AS urgent, count_if(o_orderpriority = '2-HIGH')::BIGINT AS high, count_if(o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))::BIGINT AS other FROM orders GROUP BY 1")
def contingency(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("other")
    return read(spark, sf_dir, "orders").withColumn("kind", kind).groupBy("o_orderstatus").pivot("kind", ["urgent", "high", "other"]).count().na.fill(0)


@query("SELECT least(8, greatest(1, ceil(event_id / 1000.0)))::INTEGER AS epoch, round(avg(value), 6)::DOUBLE AS mean, count(*)::BIGINT AS n FROM events GROUP BY 1")
def log_epoch_mean(spark, sf_dir):
    epoch = F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.col("event_id") / 1000))).cast("int")
    return read(spark, sf_dir, "events").groupBy(epoch.alias("epoch")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, coalesce(bool_and(value IS NOT NULL AND isfinite(value)), true) AS stable, count(*)::BIGINT AS n FROM events GROUP BY 1")
def finite_check(spark, sf_dir):
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.bool_and(finite).alias("stable"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT lang, round(avg({WORDS_SQL}), 2)::DOUBLE AS mean_tokens, max({WORDS_SQL})::INTEGER AS max_tokens, round(sum({WORDS_SQL})::DOUBLE / sum(n_chars), 6)::DOUBLE AS tokens_per_char FROM documents GROUP BY lang")
def cost_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("lang", words(F.col("text")).alias("w"), "n_chars")
    return rows.groupBy("lang").agg(F.round(F.avg("w"), 2).alias("mean_tokens"), F.max("w").alias("max_tokens"), F.round(F.sum("w") / F.sum("n_chars"), 6).alias("tokens_per_char"))


@query("SELECT coalesce(event_type, 'all') AS type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6)::DOUBLE AS loss FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY ROLLUP (event_type)")
def token_weighted_loss(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("value is not null and event_type is not null").withColumn("w", F.col("event_id") % 7 + 1)
    sums = rows.rollup("event_type").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 6).alias("loss"))
    return sums.select(F.coalesce("event_type", F.lit("all")).alias("type"), "loss")


@query("""SELECT lang, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE spot <= 3), '') AS first_ids, min(n_chars) AS min, max(n_chars) AS max, count(*)::BIGINT AS n
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS spot FROM documents) GROUP BY lang""")
def first_examples(spark, sf_dir):
    from pyspark.sql import Window

    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    firsts = docs.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("at <= 3")
    names = firsts.groupBy("lang").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    sums = docs.groupBy("lang").agg(F.min("n_chars").alias("min"), F.max("n_chars").alias("max"), F.count(F.lit(1)).alias("n"))
    return sums.join(names, "lang").select("lang", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("first_ids"), "min", "max", "n")
