"""Queries of digests of tables, and of files that are written from tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import digests as D
from fathomline.operators.relational import placed
from fathomline.plans.registry import query
from fathomline.sources import jsonl, manifest, results, snapshots, strict
from fathomline.sources.staging import scratch
from fathomline.sources.tables import read
from fathomline.streaming import logs


def digest_sql(columns: list[str], table: str, by: str) -> str:
    """The four sums in DuckDB."""
    text = " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '~')" for c in columns)
    lane = lambda k: f"sum(('0x' || substr(h, {1 + k * D.DIGITS}, {D.DIGITS}))::HUGEINT)"
    digits = " || ".join(f"lpad(printf('%x', ({lane(k)} % {D.MODULUS})::BIGINT), {D.DIGITS}, '0')" for k in range(D.LANES))
    return f"SELECT {by}, count(*)::BIGINT AS n, {digits} AS digest FROM (SELECT {by}, sha256({text}) AS h FROM {table}) GROUP BY {by}"


@query(digest_sql(["doc_id", "text", "lang", "source", "n_chars"], "documents", "lang"))
def rows_digest(spark, sf_dir):
    """The digest of the documents of each language, spread anew so that order plays no part."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars").repartition(7)
    return D.multiset_digest(docs, by=["lang"])


@query("""SELECT c_nationkey AS nation, (count(*) FILTER (WHERE c_acctbal < 0) = 0) AS same FROM customer GROUP BY 1""")
def same_rows_by_digest(spark, sf_dir):
    """Nations whose customers are the same with and without those in debt, told by digests alone."""
    rows = read(spark, sf_dir, "customer")
    a, b = D.multiset_digest(rows, by=["c_nationkey"]), D.multiset_digest(rows.where("not c_acctbal < 0"), by=["c_nationkey"])
    b = b.select(F.col("c_nationkey").alias("k"), F.col("n").alias("m"), F.col("digest").alias("other"))
    joined = a.join(b, F.col("c_nationkey").eqNullSafe(F.col("k")), "left")
    return joined.select(F.col("c_nationkey").alias("nation"), F.coalesce((F.col("n") == F.col("m")) & (F.col("digest") == F.col("other")), F.lit(False)).alias("same"))


@query("SELECT doc_id, lang, length(text)::BIGINT AS chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def strict_documents(spark, sf_dir):
    """Documents written as JSON lines and read again by the strict source, in ranges of 1 MB."""
    path = scratch(spark, "jsonl")
    read(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.option("ignoreNullFields", "false").json(path)
    strict.register(spark)
    rows = spark.read.format("strict_jsonl").schema("doc_id long, lang string, text string").option("splitBytes", str(1 << 20)).load(path)
    return rows.select("doc_id", "lang", F.length("text").cast("long").alias("chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("""SELECT version, kind, count(*)::BIGINT AS n, sum(item_id)::BIGINT AS ids FROM (SELECT 1 AS version, item_id, kind FROM items UNION ALL SELECT 2, item_id, kind FROM items WHERE price IS NOT NULL) GROUP BY 1, 2""")
def pinned_versions(spark, sf_dir):
    """Two versions of a table published one after the other: a reader that is pinned to the first still sees it."""
    folder, rows = scratch(spark, "versions"), read(spark, sf_dir, "items").select("item_id", "kind", "price")
    first = snapshots.publish(spark, {"items": rows}, folder)
    second = snapshots.publish(spark, {"items": rows.where("price is not null")}, folder, expected=first)
    read_at = lambda v: snapshots.load(spark, folder, v, check=True)["items"].withColumn("version", F.lit(v))
    return read_at(first).unionAll(read_at(second)).groupBy("version", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("ids"))


@query("""WITH l AS (SELECT event_id AS step, value, least(8, greatest(1, ceil(event_id / 1000.0)))::INTEGER AS epoch FROM events WHERE event_type <> 'error'), s AS (SELECT DISTINCT step FROM l),
g AS (SELECT step, lag(step) OVER (ORDER BY step) AS before FROM s)
SELECT epoch, round(avg(value), 6)::DOUBLE AS mean, count(*)::BIGINT AS n, (SELECT count(*) FROM g WHERE step > before + 1)::BIGINT AS gaps, (SELECT coalesce(sum(step - before - 1), 0) FROM g)::BIGINT AS missing FROM l GROUP BY epoch""")
def followed_log(spark, sf_dir):
    """Events but for one type as a log that is followed as a stream, in batches of one file: figures by epoch, and gaps of steps."""
    source, folder = scratch(spark, "log"), scratch(spark, "figures")
    rows = read(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_id").cast("long").alias("step"), "value")
    rows.repartition(3).write.json(source)
    stream = spark.readStream.schema("step long, value double").option("maxFilesPerTrigger", 1).json(source)
    epoch = F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.col("step") / 1000))).cast("int")
    logs.keep_figures(stream, folder, epoch).awaitTermination()
    missing = logs.gaps(spark, folder).agg(F.count(F.lit(1)).alias("gaps"), F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).alias("missing"))
    return logs.figures(spark, folder).withColumn("mean", F.round("mean", 6)).crossJoin(missing)  # one row


@query("SELECT nation_id, count(*)::BIGINT AS n, round(sum(balance), 2)::DOUBLE AS balance, true AS reused FROM vendors WHERE balance > 0 GROUP BY nation_id")
def reused_result(spark, sf_dir):
    """A result that is computed once for a published table and then taken from the store."""
    folder, store = scratch(spark, "inputs"), scratch(spark, "results")
    snapshots.publish(spark, {"vendors": read(spark, sf_dir, "vendors")}, folder)
    make = lambda t: t["vendors"].where("balance > 0").groupBy("nation_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))
    results.reused(spark, store, "positive balances", {"above": 0}, folder, make)
    again, was_there = results.reused(spark, store, "positive balances", {"above": 0}, folder, make)
    return again.withColumn("reused", F.lit(was_there))


@query("SELECT 'de' AS split, row_number() OVER (ORDER BY doc_id) AS line, doc_id, length(text)::BIGINT AS chars FROM documents WHERE lang = 'de' UNION ALL SELECT 'fr', row_number() OVER (ORDER BY doc_id), doc_id, length(text)::BIGINT FROM documents WHERE lang = 'fr'")
def split_lines(spark, sf_dir):
    """Documents of two languages written as a file of JSON lines each, and read as two splits with each record's line in its file."""
    docs, paths = read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), {}
    for lang in ("de", "fr"):
        paths[lang] = scratch(spark, f"lines-{lang}")
        # One file, as its lines are to be in order: the sort is one of ranges, and its files are put together by coalesce.
        jsonl.write(docs.where(F.col("lang") == lang).select("doc_id", "text").orderBy("doc_id").coalesce(1), paths[lang])
    rows = jsonl.read_splits(spark, paths, "doc_id long, text string", lambda all_: require_ids(all_))
    return rows.select("split", F.col("ord").alias("line"), "doc_id", F.length("text").cast("long").alias("chars"))


def require_ids(rows):
    bad = rows.where("doc_id is null").limit(1).count()
    if bad:
        raise ValueError("a record without an id")


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bad' ELSE 'good' END AS line, count(*)::BIGINT AS n FROM documents GROUP BY ALL""")
def lenient_lines(spark, sf_dir):
    """JSON lines of which each third is cut off: the lenient reader keeps a row of nulls for it, the strict one's complaints name as many lines."""
    path = scratch(spark, "cut")
    docs = read(spark, sf_dir, "documents")
    whole = F.to_json(F.struct("doc_id", "text"))
    docs.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"doc_id": '), F.lit("x"), F.col("doc_id").cast("string"))).otherwise(whole).alias("value")).write.text(path)
    rows = jsonl.read_lenient(spark, path, "doc_id long, text string")
    good = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is not null").select("doc_id", F.lit("good").alias("line"), "n")
    bad = jsonl.problems(spark, path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("long").alias("doc_id"), F.lit("bad").alias("line"), "n")
    return good.unionAll(bad.where("n > 0"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def frozen_subset(spark, sf_dir):
    """Orders by a frozen list of ids, in the list's order."""
    orders = read(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    # The order of the list is counted in ranges of the price.
    ids = placed(urgent, [], -F.floor(F.col("o_totalprice") / 1000), [F.desc("o_totalprice"), F.asc("o_orderkey")], "pos").select("o_orderkey", "pos")
    return manifest.subset(orders.select("o_orderkey", "o_orderstatus"), ids, "o_orderkey").select("pos", "o_orderkey", "o_orderstatus")
