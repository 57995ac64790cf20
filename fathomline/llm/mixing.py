"""Mixing sources to target weights.

Tokens are summed per source, targets come from the weights, and each document is emitted floor(rate) times plus one
copy more with the probability that is left, decided by a seeded hash of its id: the same on every run and every
layout of the data.

Targets: the mix holds `total` times all tokens. The share of a source is its weight's, but at most `most` times its
own tokens; what exceeds that goes to the others by weight until none is above. That fixed point needs no iteration:
with sources ordered by cap/weight, exactly the first ones are at their caps and the rest share what is left by weight.

Defined results: a null or empty text has size 0 and takes 0. A source of null is a source of its own, last in order.
A source without tokens has target 0. Rows that repeat a doc_id share its draw. A null id has a draw like any other.
An empty table gives an empty result. Only one row per source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_of, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """sized: source, size. Returns per source: source, source_size, target."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    listed = sums.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    )
    listed = listed.withColumns({
        "cap": F.lit(most) * F.col("source_size"), "budget": F.lit(total) * F.sum("source_size").over(everything),
    })
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    upto, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    listed = listed.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    listed = listed.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("cap_rank", "level"))).over(everything)["level"]
    listed = listed.withColumn("cap_rank", F.row_number().over(by_ratio))
    return listed.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def draw(id_col: Column, seed: int) -> Column:
    """A number from 0 to 1, fixed by the id and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f"/{seed}"))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42, keep: bool = False, **shares) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken; with keep, the input's columns in a struct `row`."""
    size = word_count(text_of(text_col)) if size is None else size
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []))
    # Written first, so that its size is known: if it is small it is broadcast and no document moves, else both sides are joined by source.
    targets = materialize(source_targets(sized.select("source", "size"), **shares).withColumnRenamed("source", "of"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(["row"] if keep else [])
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as many times as the mix takes it."""
    mixed = mix(docs, keep=True, **options).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS cap_rank,
  (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN cap / weight <= level THEN cap ELSE weight * min(CASE WHEN cap / weight > level THEN {'r': cap_rank, 'l': level} END) OVER () .l END AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '/42'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM j)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
