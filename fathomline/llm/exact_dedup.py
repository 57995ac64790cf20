"""Exact deduplication in DataFrame operations only.

Equal texts are combined three times, each time comparing the full content:

1. locally: the partial aggregation of each map task leaves one row per text of that task;
2. by salt: those rows are merged by (digest, text, salt), the salt being the map task, so that one text
   that makes up much of the corpus is spread over `salts` reducers;
3. globally: the at most `salts` winners of a text are merged by (digest, text).

The text is part of every grouping key; the digest in front only makes unequal keys cheap to tell apart.

Defined results: a null text is an empty text. A null doc_id never wins against another; a group of null ids has a
null keep_id. Rows that repeat both doc_id and text are copies of one another: exactly one of them is kept. An empty
table gives an empty result. Columns of the input beyond those named are ignored by `exact_groups` and carried by
`drop_copies`; internal columns live in a struct, so that no input name clashes with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RE, has_order, materialize, orderable, table, text_of


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACE_RE, " ")


def combine(rows: DataFrame, value: Column, salts: int, least=F.min) -> DataFrame:
    """rows: digest, content and what `value` reads. Returns digest, content, best (of the values by the aggregate `least`), size."""
    local = rows.select("digest", "content", value.alias("value"), (F.spark_partition_id() % salts).alias("salt"))
    salted = local.groupBy("digest", "content", "salt").agg(least("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(least("value").alias("best"), F.sum("n").alias("size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    content = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    best = combine(rows, F.col("doc_id"), salts)
    # Back to single rows without the texts. Written first, so that the texts are shuffled no more than those two times.
    groups = materialize(best.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("best").alias("keep_id"), F.max("size").alias("group_size")), "groups")
    ids = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    joined = ids.join(groups.where("texts = 1"), "digest").select("doc_id", "keep_id", "group_size", "digest", "times")
    clash = groups.where("texts > 1").select("digest")
    if not clash.isEmpty():  # two texts under one digest are told apart by their content
        told = (
            rows.join(clash, "digest", "left_semi")
            .groupBy("doc_id", "digest", "content").agg(F.count(F.lit(1)).alias("times"))
            .join(best, ["digest", "content"])
            .select("doc_id", F.col("best").alias("keep_id"), F.col("size").alias("group_size"), "digest", "times")
        )
        joined = joined.unionByName(told)
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """docs without all but the first (by id, then by the other columns, maps by their JSON) of equal texts; all columns stay as they are."""
    content = normalised(text_col)
    others = [f for f in docs.schema.fields if f.name not in (id_col, text_col)]

    def row(column):
        # The text travels once: the row holds it only where white space or null make it differ from the content.
        return F.struct(
            F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
            F.col(text_col).isNull().alias("no_text"), F.when(F.col(text_col) != content, F.col(text_col)).alias("text"),
            *[column(f).alias(f"c{k}") for k, f in enumerate(others)],
        )

    whole = row(lambda f: F.col(f"`{f.name}`"))
    if all(has_order(f.dataType) for f in others):
        value, least, at = whole, F.min, "best"
    else:
        value, least, at = F.struct(row(orderable).alias("order"), whole.alias("row")), lambda c: F.min_by(c, f"{c}.order"), "best.row"
    rows = docs.select(content.alias("content"), value.alias("row")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    best = combine(rows, F.col("row"), salts, least)
    columns = {f.name: F.col(f"{at}.c{k}") for k, f in enumerate(others)}
    columns[id_col] = F.col(f"{at}.id")
    columns[text_col] = F.when(~F.col(f"{at}.no_text"), F.coalesce(F.col(f"{at}.text"), F.col("content")))
    return best.select(*[columns[c].alias(c) for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY doc_id) AS copy FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(t) AS text_sha256
FROM r JOIN g USING (t)
"""
