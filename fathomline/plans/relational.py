"""Queries of joins, ordered computations, top-k, samples and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import relational as R
from fathomline.plans.registry import query
from fathomline.sources.tables import read

TOKENS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"


def tokens(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


@query("SELECT count_if(a IS NOT NULL AND b IS NOT NULL)::BIGINT AS both, count_if(b IS NULL)::BIGINT AS only_left, count_if(a IS NULL)::BIGINT AS only_right, count_if(coalesce(na, 0) > 1 OR coalesce(nb, 0) > 1)::BIGINT AS repeated FROM (SELECT o_orderkey AS a, count(*) AS na FROM orders GROUP BY 1) FULL JOIN (SELECT l_orderkey AS b, count(*) AS nb FROM lineitem GROUP BY 1) ON a = b")
def full_coverage_check(spark, sf_dir):
    return R.coverage(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT l_returnflag, o_orderpriority, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 30 GROUP BY 1, 2")
def inner_join_subset(spark, sf_dir):
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    joined = line.where("l_quantity > 30").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_returnflag", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def anti_exclude(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_anti")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_keep(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'relabelled' ELSE d.lang END AS lang, CASE WHEN l.quality = 0 THEN NULL ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1")
def relabel_view(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    replaced = {"lang": F.when(low, "relabelled").otherwise(F.col("lang")), "source": F.when(~low, F.col("source"))}
    return R.relabel(docs, read(spark, sf_dir, "labels"), "doc_id", replaced, F.col("toxic") == 1)


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT -1 - item_id, 'benchmark' FROM benchmark")
def union_view(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"))
    items = read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.lit("benchmark").alias("kind"))
    return R.union_checked(docs, items, "id")


@query("SELECT a.conv_id, a.turn, a.text AS call, b.text AS result FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def zip_calls(spark, sf_dir):
    """Each user turn with the turn after it; none: null."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumns({"next_turn": F.lead("turn").over(by), "next_text": F.lead("text").over(by)})
    return turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("call"), F.when(F.col("next_turn") == F.col("turn") + 1, F.col("next_text")).alias("result"))


@query("SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS first_id FROM documents) WHERE doc_id <> first_id")
def exact_dups(spark, sf_dir):
    """Rows whose (text, lang) occurred before, with the first id. Texts are compared by digest and length."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("t"), "lang")
    firsts = docs.groupBy("t", "lang").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(firsts, docs["t"].eqNullSafe(firsts["t"]) & docs["lang"].eqNullSafe(firsts["lang"])).where("doc_id <> first_id").select("doc_id", "first_id")


@query("SELECT source, count(DISTINCT regexp_replace(text, '[0-9]+([.][0-9]+)?', '#', 'g'))::BIGINT AS templates, count(*)::BIGINT AS n FROM documents GROUP BY source")
def masked_templates(spark, sf_dir):
    masked = F.sha2(F.regexp_replace("text", r"[0-9]+([.][0-9]+)?", "#"), 256)
    return read(spark, sf_dir, "documents").select("source", masked.alias("t")).groupBy("source").agg(F.countDistinct("t").alias("templates"), F.count(F.lit(1)).alias("n"))


@query("SELECT props, count(DISTINCT event_type)::BIGINT AS kinds FROM (SELECT regexp_replace(props, '[0-9]+', '#', 'g') AS props, event_type FROM events) GROUP BY props HAVING count(DISTINCT event_type) > 1")
def template_conflict(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.regexp_replace("props", "[0-9]+", "#").alias("props"), "event_type")
    return rows.groupBy("props").agg(F.countDistinct("event_type").alias("kinds")).where("kinds > 1")


CONTAMINATION_SQL = """
WITH x AS (SELECT text, lang, max(doc_id) AS by_pair FROM documents WHERE source = 'src0' GROUP BY ALL), y AS (SELECT text, max(doc_id) AS by_note FROM documents WHERE source = 'src0' GROUP BY ALL),
z AS (SELECT lang, n_chars, max(doc_id) AS by_qa FROM documents WHERE source = 'src0' GROUP BY ALL)
SELECT doc_id, CASE WHEN by_pair IS NOT NULL THEN 'pair' WHEN by_note IS NOT NULL THEN 'note' END AS kind, coalesce(by_pair, by_note) AS hit, by_qa AS qa
FROM documents d LEFT JOIN x USING (text, lang) LEFT JOIN y USING (text) LEFT JOIN z USING (lang, n_chars) WHERE source <> 'src0'"""


@query(CONTAMINATION_SQL)
def contamination(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("t"), "lang", "n_chars")
    return R.contamination(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), ["t", "lang"], "t", ["lang", "n_chars"], "doc_id")


JACCARD_SQL = f"""
WITH sh AS (SELECT 'x' AS side, doc_id AS id, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS g FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)
  UNION ALL SELECT 'q', item_id, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) FROM (SELECT item_id, {TOKENS_SQL} AS t FROM benchmark)),
p AS (SELECT id AS x, unnest(g) AS s FROM sh WHERE side = 'x'), rare AS (SELECT s FROM p GROUP BY s HAVING count(*) <= 100), u AS (SELECT id AS q, unnest(g) AS s FROM sh WHERE side = 'q'),
h AS (SELECT q, x, count(*) AS n FROM u JOIN p USING (s) WHERE s IN (SELECT s FROM rare) GROUP BY q, x),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, x) AS place FROM h) WHERE place <= 10),
j AS (SELECT t.q, t.x, t.n, len(list_intersect(a.g, b.g))::DOUBLE AS common, len(a.g) AS la, len(b.g) AS lb FROM t JOIN sh a ON a.side = 'q' AND a.id = t.q JOIN sh b ON b.side = 'x' AND b.id = t.x),
b AS (SELECT q, x, common / (la + lb - common) AS j, row_number() OVER (PARTITION BY q ORDER BY common / (la + lb - common) DESC, n DESC, x) AS place FROM j)
SELECT id AS id, x AS match, coalesce(round(j, 9), 0)::DOUBLE AS jaccard FROM (SELECT id FROM sh WHERE side = 'q') LEFT JOIN b ON q = id AND place = 1"""


@query(JACCARD_SQL)
def near_dup_jaccard(spark, sf_dir):
    """Benchmark items against all documents."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("t"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), tokens(F.col("text")).alias("t"))
    return R.max_jaccard(items, docs, "id", "t").withColumn("jaccard", F.round("jaccard", 9))


@query(f"""
WITH sh AS MATERIALIZED (SELECT doc_id AS id, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS g FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)),
c AS (SELECT a.id AS id, b.id AS match, len(list_intersect(a.g, b.g))::DOUBLE AS common, len(a.g) AS na, len(b.g) AS nb FROM sh a JOIN sh b ON a.id % 20 = 0 AND a.id <> b.id AND len(a.g) > 0 AND len(b.g) >= 0.8 * len(a.g) - 1e-9 AND len(b.g) * 0.8 <= len(a.g) + 1e-9)
SELECT id, match, round(common / (na + nb - common), 9)::DOUBLE AS jaccard FROM c WHERE common / (na + nb - common) >= 0.8 - 1e-12""")
def similar_documents(spark, sf_dir):
    """Every twentieth document against all: those whose 5-grams are 0.8 alike or more, by an exact search."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("t"))
    found = R.similar(docs.where("id % 20 = 0"), docs, "id", "t", 0.8).where("id <> match")
    return found.withColumn("jaccard", F.round("jaccard", 9))


@query("WITH s AS (SELECT DISTINCT l_orderkey, l_partkey % 50 AS i FROM lineitem) SELECT a.i AS a, b.i AS b, count(*)::BIGINT AS orders FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.i < b.i GROUP BY 1, 2")
def pair_containment(spark, sf_dir):
    """In how many orders both of a pair of part groups occur: pairs of at most the lines of one order."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("i"))
    return R.pairs_of(items, "l_orderkey", "i").groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders"))


@query("WITH o AS (SELECT l_orderkey, list(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_filter(q, lambda x: len(list_filter(q, lambda y: abs(abs(x - y) - 7) <= 1e-9)) > 0)) > 0 AS found FROM o")
def theta_pairs(spark, sf_dir):
    """Whether two quantities of an order differ by 7: arrays of one order, never a join of rows."""
    pools = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return pools.select("l_orderkey", F.exists("q", lambda x: F.exists("q", lambda y: F.abs(F.abs(x - y) - 7) <= 1e-9)).alias("found"))


@query("SELECT o_orderkey, count_if(round(l_extendedprice / 1000, 0) = round(o_totalprice / 1000, 0))::BIGINT AS exact, count_if(l_extendedprice BETWEEN o_totalprice * 0.95 AND o_totalprice * 1.05)::BIGINT AS band FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def band_match(spark, sf_dir):
    joined = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey"))
    exact = F.round(F.col("l_extendedprice") / 1000, 0) == F.round(F.col("o_totalprice") / 1000, 0)
    return joined.groupBy("o_orderkey").agg(F.count_if(exact).alias("exact"), F.count_if(F.col("l_extendedprice").between(F.col("o_totalprice") * 0.95, F.col("o_totalprice") * 1.05)).alias("band"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, abs(l_quantity - 25), l_linenumber, l_quantity) AS place FROM lineitem) WHERE place = 1")
def best_priority_match(spark, sf_dir):
    """The best row of each group by a composite priority: an aggregation, without a sort."""
    priority = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    best = F.min(F.struct(priority.alias("p"), F.abs(F.col("l_quantity") - 25).alias("d"), "l_linenumber", "l_quantity")).alias("b")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best).select("l_orderkey", "b.l_linenumber", "b.l_quantity")


@query("SELECT o_orderkey, arg_min(l_linenumber, abs(l_extendedprice - o_totalprice / 4) * 1000 + l_linenumber / 1000.0) AS l_linenumber, round(min(abs(l_extendedprice - o_totalprice / 4)), 4)::DOUBLE AS distance FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def nearest_match(spark, sf_dir):
    joined = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey"))
    near = F.min(F.struct(F.abs(F.col("l_extendedprice") - F.col("o_totalprice") / 4).alias("d"), "l_linenumber")).alias("b")
    return joined.groupBy("o_orderkey").agg(near).select("o_orderkey", "b.l_linenumber", F.round("b.d", 4).alias("distance"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_value FROM events")
def asof_last_mention(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return R.as_of(events, "user_id", ["ts", "event_id"], F.col("value"), F.col("event_type") == "purchase").select("event_id", "last_value")


@query("SELECT p.doc_id AS positive, q.doc_id AS probe, p.source FROM (SELECT min(doc_id) AS doc_id, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source) p JOIN (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0) q USING (source)")
def pair_by_source(spark, sf_dir):
    labelled = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    positives = labelled.where("toxic = 1").groupBy("source").agg(F.min("doc_id").alias("positive"))
    return labelled.where("quality = 0").select(F.col("doc_id").alias("probe"), "source").join(positives, "source").select("positive", "probe", "source")


@query("SELECT user_id, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'purchase')::BIGINT AS purchase, count_if(event_type = 'view')::BIGINT AS view FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id")
def pivot_labels(spark, sf_dir):
    kinds = ["click", "purchase", "view"]
    return read(spark, sf_dir, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)


@query("SELECT r_name, n_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2)::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def lookup_dimension(spark, sf_dir):
    """Dimensions of fixed size; Spark broadcasts them by their measured size."""
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 15")
def topk_global(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(15)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 8")
def topk_group(spark, sf_dir):
    return R.first_of(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8)


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events) WHERE place <= 10")
def first_n_per_type(spark, sf_dir):
    return R.first_of(read(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], [F.asc("event_id")], 10)


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3")
def most_common(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(3).select("event_type", "n")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 25")
def limit_head(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id").limit(25)


@query("WITH m AS (SELECT n_name, round(avg(s_acctbal), 2) AS m, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT n_name, m::DOUBLE AS mean FROM m WHERE m >= (SELECT max(m) FROM m) - 500 ORDER BY n DESC, n_name LIMIT 1")
def tie_band_select(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    means = rows.groupBy("n_name").agg(F.round(F.avg("s_acctbal"), 2).alias("mean"), F.count(F.lit(1)).alias("n"))
    return R.near_best(means, "mean", 500, [F.desc("n"), F.asc("n_name")]).select("n_name", "mean")


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE place = n // 2 + 1")
def median_representative(spark, sf_dir):
    """The document of median length: lengths are counted, and only documents of that one length are ordered by id."""
    rows = read(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    counts = rows.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("n_chars"))
    middle = F.floor(F.sum("n").over(Window.partitionBy("lang")) / 2) + 1
    lengths = counts.select("lang", "n_chars", middle.alias("place"), upto.alias("upto"), "n").where("place > upto - n and place <= upto")
    alike = rows.join(lengths.select(F.col("lang").alias("l"), F.col("n_chars").alias("c"), (F.col("place") - F.col("upto") + F.col("n")).alias("k")), F.col("lang").eqNullSafe(F.col("l")) & F.col("n_chars").eqNullSafe(F.col("c")))
    return alike.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("i = k").select("lang", "doc_id", "n_chars")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || 'seed'), doc_id) AS place FROM documents) WHERE place <= 50")
def stratified_sample_md5(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("lang", "doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("seed"))).alias("h"))
    return R.first_of(rows, ["lang"], [F.asc("h"), F.asc("doc_id")], 50).select("lang", "doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY sha256(o_orderkey::VARCHAR || 'shuffle'))::BIGINT AS place FROM orders")
def seeded_shuffle(spark, sf_dir):
    """Places in a shuffled order."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey")
    return R.shuffled(rows, R.hash_order("o_orderkey", "shuffle"), [], "at").select("o_orderkey", (F.col("at") + 1).alias("place"))


@query("SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4)::INTEGER AS template FROM documents")
def round_robin(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id")
    ranges = F.floor(F.col("doc_id") / 65_536)  # a range holds at most as many rows, for ids that do not repeat
    return R.placed(docs, ["source"], ranges, [F.col("doc_id")], "at").select("source", "doc_id", (F.col("at") % 4).cast("int").alias("template"))


@query("""WITH q AS (SELECT c_mktsegment AS segment, count(*)::DOUBLE * 1000 / (SELECT count(*) FROM customer) AS quota FROM customer GROUP BY 1), f AS (SELECT segment, quota, floor(quota) AS s FROM q)
SELECT segment, (s + CASE WHEN row_number() OVER (ORDER BY round(quota - s, 9) DESC, segment) <= 1000 - sum(s) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM f""")
def largest_remainder(spark, sf_dir):
    weights = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return R.largest_remainder(weights, "segment", "n", 1000)


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def set_except(spark, sf_dir):
    """New failures: customers without an urgent order that is done."""
    urgent = read(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(urgent.select(F.col("o_custkey").alias("k")))


@query("SELECT count(*)::BIGINT AS n FROM ((SELECT p_partkey AS k FROM part EXCEPT ALL SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 20) UNION ALL (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 20 EXCEPT ALL SELECT p_partkey FROM part))")
def set_symdiff(spark, sf_dir):
    a = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    b = read(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_partkey").alias("k")).distinct()
    return R.symmetric_difference(a, b).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, a & b AS both, xor(7, a) AS other, (a & ~b) = 0 AS subset FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 15 THEN 1 WHEN l_quantity < 35 THEN 2 ELSE 4 END AS a, CASE WHEN l_discount < 0.03 THEN 1 WHEN l_discount < 0.06 THEN 3 ELSE 7 END AS b FROM lineitem)")
def state_set_algebra(spark, sf_dir):
    """Sets of low, normal, high as three bits."""
    a = F.when(F.col("l_quantity") < 15, 1).when(F.col("l_quantity") < 35, 2).otherwise(4)
    b = F.when(F.col("l_discount") < 0.03, 1).when(F.col("l_discount") < 0.06, 3).otherwise(7)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.col("a").bitwiseAND(F.col("b")).alias("both"), F.lit(7).bitwiseXOR(F.col("a")).alias("other"), (F.col("a").bitwiseAND(F.bitwise_not("b")) == 0).alias("subset"))


@query("SELECT n_nationkey, sha256('=' || n_nationkey::VARCHAR || chr(31) || '=' || n_name || chr(31) || '=' || n_regionkey::VARCHAR) AS digest FROM nation")
def view_digest(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    return nation.select("n_nationkey", R.row_digest(nation, "n_nationkey", "n_name", "n_regionkey").alias("digest"))


@query(f"SELECT item_id, len(list_intersect(a, b))::INTEGER AS shared, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9)::DOUBLE AS jaccard FROM (SELECT item_id, list_distinct({TOKENS_SQL}) AS a, (SELECT list_distinct({TOKENS_SQL}) FROM benchmark ORDER BY item_id LIMIT 1) AS b FROM benchmark)")
def array_jaccard(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("a"))
    first = items.orderBy("item_id").limit(1).select("a").scalar()
    both = F.size(F.array_intersect("a", "b"))
    return items.withColumn("b", first).select("item_id", both.alias("shared"), F.round(both / F.size(F.array_union("a", "b")), 9).alias("jaccard"))


@query("SELECT event_id, round(value - lag(value) OVER w, 6)::DOUBLE AS delta, ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0)::DOUBLE AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def step_delta(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events")
    micros = F.unix_micros("ts")
    return events.select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"), ((micros - F.lag(micros).over(w)) / F.lit(1e6)).alias("seconds"))


@query("SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS first_id FROM events")
def first_occurrence(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    firsts = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first_id"))
    return events.join(firsts, ["user_id", "event_type"]).select("event_id", "first_id")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::INTEGER AS subject FROM conversations")
def carry_forward(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.length("text")), ignorenulls=True).over(w).alias("subject"))


@query("SELECT conv_id, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1")
def contiguity(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(((F.min("turn") == 0) & (F.max("turn") == F.count(F.lit(1)) - 1) & (F.countDistinct("turn") == F.count(F.lit(1)))).alias("contiguous"))


@query("SELECT a.user_id, a.n IS DISTINCT FROM b.n AS n_changed, a.v IS DISTINCT FROM b.v AS v_changed FROM (SELECT user_id, count(*) AS n, max(value) AS v FROM events GROUP BY 1) a JOIN (SELECT user_id, count(*) AS n, max(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1) b USING (user_id)")
def rollout_diff(spark, sf_dir):
    """Which fields differ between two runs, null-safely."""
    events = read(spark, sf_dir, "events")
    sums = lambda df, x: df.groupBy("user_id").agg(F.count(F.lit(1)).alias(f"n{x}"), F.max("value").alias(f"v{x}"))
    joined = sums(events, "a").join(sums(events.where("event_type <> 'error'"), "b"), "user_id")
    return joined.select("user_id", (~F.col("na").eqNullSafe(F.col("nb"))).alias("n_changed"), (~F.col("va").eqNullSafe(F.col("vb"))).alias("v_changed"))


@query("SELECT o_orderkey, CASE WHEN bool_or(d) THEN 'disagree' WHEN bool_and(f) THEN 'agree' ELSE 'open' END AS stratum FROM (SELECT l_orderkey AS o_orderkey, l_returnflag = 'R' AND l_linestatus = 'O' AS d, l_linestatus = 'F' AS f FROM lineitem) GROUP BY 1")
def stratum_case(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("d"), (F.col("l_linestatus") == "F").alias("f"))
    return rows.groupBy("o_orderkey").agg(F.when(F.bool_or("d"), "disagree").when(F.bool_and("f"), "agree").otherwise("open").alias("stratum"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND NOT bool_or(l_discount > 0.08))")
def eligible_orders(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("some"), F.bool_or(F.col("l_discount") > 0.08).alias("bad"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(lines.where("some and not bad"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("SELECT doc_id, coalesce(a.quality, b.label) AS label, CASE WHEN a.quality IS NULL THEN 'pending' WHEN a.quality = a.toxic THEN 'agree' ELSE 'adjudicated' END AS state FROM labels a LEFT JOIN (SELECT vec_id AS doc_id, label FROM embeddings) b USING (doc_id)")
def rater_merge(spark, sf_dir):
    other = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    joined = read(spark, sf_dir, "labels").join(other, "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == F.col("toxic"), "agree").otherwise("adjudicated")
    return joined.select("doc_id", F.coalesce("quality", "label").alias("label"), state.alias("state"))


@query("SELECT label, n, n >= 50 AND mean > 0 AND spread AS ok FROM (SELECT label, count(*)::BIGINT AS n, avg(len(embedding)) AS mean, max(vec_id) - min(vec_id) > 10 AS spread FROM embeddings GROUP BY 1)")
def gate_screens(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("embedding")).alias("mean"), (F.max("vec_id") - F.min("vec_id") > 10).alias("spread"))
    return rows.select("label", "n", ((F.col("n") >= 50) & (F.col("mean") > 0) & F.col("spread")).alias("ok"))
