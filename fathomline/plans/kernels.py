"""Queries of the scalar functions, on values derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import clinical as C
from fathomline.functions import text as X
from fathomline.operators.statistics import rate
from fathomline.plans.registry import query
from fathomline.sources.tables import read


# The nine formulas, a substance that has none, and a pair of units that has none, with spellings that differ.
CONVERSIONS = [
    (" LBS ", "kg", None, "x * 0.4536"), ("kilograms", "lb", None, "x * 2.2046"), ("inches", "cm", None, "x * 2.54"), ("cm", '"', "glucose", "x * 0.3937"), ("mg/dL", "mmol/L", "Fasting  glucose", "x * 0.0555"),
    ("mg/dl", "µmol/L", "creatinine", "x * 88.42"), ("MG/DL", "mmol/l", "total cholesterol", "x * 0.0259"), ("°F", "C", None, "(x - 32) * 5 / 9"), ("celsius", "f", None, "x * 9 / 5 + 32"),
    ("mg/dL", "mmol/L", "urea", None), ("kg", "cm", None, None),
]
CONVERTED = " ".join(f"WHEN {k} THEN {formula.replace('x', '(p_size * 3 + 40)::DOUBLE')}" for k, (*_, formula) in enumerate(CONVERSIONS) if formula)


@query(f"SELECT p_partkey, round(CASE p_partkey % {len(CONVERSIONS)} {CONVERTED} END, 2)::DOUBLE AS result, p_partkey % {len(CONVERSIONS)} >= 9 AS failed FROM part")
def unit_convert(spark, sf_dir):
    kind = F.col("p_partkey") % len(CONVERSIONS)
    pick = lambda at: F.element_at(F.array(*[F.lit(c[at]).cast("string") for c in CONVERSIONS]), (kind + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select("p_partkey", C.unit_convert((F.col("p_size") * 3 + 40).cast("double"), pick(0), pick(1), pick(2)).alias("r"))
    return rows.select("p_partkey", "r.result", F.col("r.error").isNotNull().alias("failed"))


@query("SELECT p_partkey, round((p_size + 45) / pow((150 + p_partkey % 50) / 100.0::DOUBLE, 2), 1)::DOUBLE AS result FROM part")
def bmi(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", C.bmi((F.col("p_size") + 45).cast("double"), (150 + F.col("p_partkey") % 50).cast("double"))["result"].alias("result"))


EGFR_SQL = """r AS (SELECT p_partkey, p_partkey % 2 = 0 AS female, (18 + p_partkey % 100) AS age, (p_size / 10.0::DOUBLE + 0.3) AS cr FROM part),
q AS (SELECT *, cr / CASE WHEN female THEN 0.7 ELSE 0.9 END::DOUBLE AS ratio FROM r),
e AS (SELECT p_partkey, 142 * pow(least(ratio, 1), CASE WHEN female THEN -0.241 ELSE -0.302 END::DOUBLE) * pow(greatest(ratio, 1), -1.2::DOUBLE) * pow(0.9938::DOUBLE, age) * CASE WHEN female THEN 1.012 ELSE 1 END::DOUBLE AS x FROM q)"""


def filtration(spark, sf_dir):
    sex = F.when(F.col("p_partkey") % 2 == 0, "F").otherwise("man")
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", C.egfr(F.col("p_size") / 10 + 0.3, (18 + F.col("p_partkey") % 100).cast("double"), sex).alias("e"))


@query(f"WITH {EGFR_SQL} SELECT p_partkey, round(x)::DOUBLE AS egfr FROM e")
def egfr(spark, sf_dir):
    return filtration(spark, sf_dir).select("p_partkey", F.col("e.result").alias("egfr"))


@query(f"WITH {EGFR_SQL} SELECT CASE WHEN round(x) >= 90 THEN 'G1' WHEN round(x) >= 60 THEN 'G2' WHEN round(x) >= 45 THEN 'G3a' WHEN round(x) >= 30 THEN 'G3b' WHEN round(x) >= 15 THEN 'G4' ELSE 'G5' END AS stage, count(*)::BIGINT AS n FROM e GROUP BY 1")
def kdigo_stage(spark, sf_dir):
    return filtration(spark, sf_dir).groupBy(C.kdigo_stage(F.col("e.result")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT p_partkey, p_size::DOUBLE / 2 + 10.1 AS x FROM part), c AS (SELECT p_partkey, unnest([x - 0.15, x, x + 0.15]) AS v FROM b) SELECT p_partkey, array_to_string(list_sort(list_distinct(list(CASE WHEN v < 18.5 THEN 'underweight' WHEN v < 25 THEN 'normal' WHEN v < 30 THEN 'overweight' ELSE 'obese' END))), '/') AS categories FROM c GROUP BY 1")
def who_category(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(C.who_categories(F.col("p_size") / F.lit(2.0) + 10.1), "/").alias("categories"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 35 OR l_linenumber = 2 AND l_quantity = 35 THEN 'high' WHEN l_linenumber <> 2 AND l_quantity < 12 THEN 'low' ELSE 'normal' END AS state FROM lineitem")
def ref_range_state(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", C.reference_range(F.when(F.col("l_linenumber") == 2, " <35").otherwise("12 – 35")).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", C.range_state(F.col("l_quantity"), F.col("r.low"), F.col("r.high"), F.col("r.low_strict"), F.col("r.high_strict")).alias("state"))


@query("SELECT o_orderkey, o_totalprice AS value, round(o_totalprice * 0.4536, 4)::DOUBLE AS metric FROM orders")
def parse_float(spark, sf_dir):
    """Numbers written with separators, read again."""
    written = F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" "))
    return read(spark, sf_dir, "orders").select("o_orderkey", C.parse_float(written).alias("value"), F.round(C.to_metric(C.parse_float(written), F.lit("lb")), 4).alias("metric"))


@query("SELECT o_orderkey, round(o_totalprice::VARCHAR::DECIMAL(38, 18), 1)::DOUBLE AS rounded FROM orders")
def half_up(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", C.half_up(F.col("o_totalprice"), 1).alias("rounded"))


@query("SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS first, len(regexp_extract_all(props, '[0-9]+'))::INTEGER AS n FROM events")
def extract_numbers(spark, sf_dir):
    found = C.numbers(F.regexp_replace("props", r"[\"{}:]", " "))
    return read(spark, sf_dir, "events").select("event_id", F.try_element_at(found, F.lit(1)).alias("first"), F.size(found).alias("n"))


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * 1000) <= 5000 + 1e-9 AS near, CASE WHEN l_quantity > 40 THEN (l_quantity - 40) / 40 WHEN l_quantity < 10 THEN (10 - l_quantity) / 10 ELSE 0 END::DOUBLE AS deviation FROM lineitem")
def tolerance(spark, sf_dir):
    near = C.close(F.col("l_extendedprice"), F.col("l_quantity") * 1000, 5000)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", near.alias("near"), C.deviation(F.col("l_quantity"), F.lit(10.0), F.lit(40.0)).alias("deviation"))


@query("""WITH b AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: w NOT IN ('a', 'an', 'the', 'is', 'are', 'was', 'were', 'of', 'to', 'in', 'and', 'or', 'with', 'for', 'on', 'at', 'by', 'as')) AS x,
  list_filter(regexp_extract_all(lower(lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn)), '[a-z0-9_]+'), lambda w: w NOT IN ('a', 'an', 'the', 'is', 'are', 'was', 'were', 'of', 'to', 'in', 'and', 'or', 'with', 'for', 'on', 'at', 'by', 'as')) AS y FROM conversations)
SELECT conv_id, turn, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0) / (len(x) + len(y)), 9) END::DOUBLE AS f1 FROM b""")
def token_f1(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("before"))
    return rows.select("conv_id", "turn", F.round(X.token_f1(F.col("text"), F.col("before")), 9).alias("f1"))


CHARACTERS = "éèüñßó–µ"


@query(f"SELECT c, sum(length(text) - length(replace(text, c, '')))::BIGINT AS n FROM documents, (SELECT unnest({list(CHARACTERS)}) AS c) GROUP BY c")
def char_inventory(spark, sf_dir):
    """One pass: a sum for each character, then turned into rows."""
    sums = read(spark, sf_dir, "documents").agg(*[F.sum(X.occurrences(F.col("text"), c)).alias(f"c{k}") for k, c in enumerate(CHARACTERS)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(f"c{k}", F.lit(0)).cast("long").alias("n")) for k, c in enumerate(CHARACTERS)])).alias("r")).select("r.*")


@query("""SELECT l_orderkey, '| Line | Value | Unit |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_quantity::BIGINT || ' | ' || CASE WHEN l_returnflag = 'N' THEN '(no unit)' ELSE l_returnflag || '\\|x' END || ' |', chr(10) ORDER BY l_linenumber, l_quantity, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END) AS t FROM lineitem GROUP BY 1""")
def table_markdown(spark, sf_dir):
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", F.lit("|x"))))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", cells.alias("c")))), lambda r: r["c"]).alias("rows"))
    return rows.select("l_orderkey", X.markdown_table(F.array(F.lit("Line"), F.lit("Value"), F.lit("Unit")), F.col("rows")).alias("t"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, length(coalesce(text, ''))::INTEGER AS chars, round_even(length(coalesce(text, '')) / 4.0, 0)::BIGINT AS tokens FROM documents")
def sha_manifest(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"), F.length(text).alias("chars"), X.approx_tokens(text).alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+'))::INTEGER AS words, CASE WHEN instr(text, '**') > 0 THEN 'markdown' ELSE 'plain' END AS style, regexp_replace(regexp_replace(text, '[0-9]+([.][0-9]+)?', '#', 'g'), '[ \\t-\\r]+', ' ', 'g') AS masked FROM documents")
def text_features(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.word_count(text).alias("words"), X.note_style(text).alias("style"), F.regexp_replace(X.mask_numbers(text), r"\s+", " ").alias("masked"))


@query("SELECT role, count(*)::BIGINT AS n, count_if(length(text) > 200)::BIGINT AS k, round(count_if(length(text) > 200)::DOUBLE / count(text), 4)::DOUBLE AS rate FROM conversations GROUP BY role")
def null_skipping_rate(spark, sf_dir):
    r = rate(F.length("text") > 200)
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), r["k"].alias("k"), r["rate"].alias("rate"))
