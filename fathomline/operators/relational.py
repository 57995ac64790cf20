"""Joins, ordered computations, top-k, sampling and set operations.

Records have no order of their own in a DataFrame: every operator that depends on order takes the columns that define it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.sources.staging import scratch


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How far two sets of keys cover each other: keys in both, only left, only right, and keys that repeat on a side."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("na"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("both"), F.count_if(F.col("nb").isNull()).alias("only_left"),
        F.count_if(F.col("na").isNull()).alias("only_right"), F.count_if((F.coalesce("na", F.lit(0)) > 1) | (F.coalesce("nb", F.lit(0)) > 1)).alias("repeated"),
    )


def require_full_coverage(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises unless both sides have the same keys, each once."""
    r = coverage(left, right, key).first()
    if r["only_left"] or r["only_right"] or r["repeated"]:
        raise ValueError(f"keys differ: {r.asDict()}")


def relabel(records: DataFrame, decisions: DataFrame, key: str, replace: dict[str, Column], drop: Column) -> DataFrame:
    """Left join of review decisions: replaced columns where there is one, rows gone where `drop` holds."""
    joined = records.join(decisions, key, "left").where(~F.coalesce(drop, F.lit(False)))
    return joined.withColumns(replace).select(records.columns)


def union_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union of all rows; the query fails if a key is on both sides."""
    sides = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(2)))
    clash = sides.groupBy(key).agg(F.countDistinct("__side").alias("sides")).where("sides > 1").agg(F.count(F.lit(1)).alias("clashes"))
    return sides.drop("__side").where(F.assert_true(clash.scalar() == 0, "keys collide").isNull())


def first_of(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group and task before it shuffles."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__at") <= n).drop("__at")


def contamination(train: DataFrame, other: DataFrame, pair: list[str], note: str, qa: list[str], id_col: str) -> DataFrame:
    """Rows of other whose pair, note, or question and answer occur in train; a pair counts before a note, the last. `hit` and `qa` hold the train id."""
    def keyed(keys: list[str], name: str) -> DataFrame:
        return train.groupBy(*[F.col(k).alias(f"__{name}{i}") for i, k in enumerate(keys)]).agg(F.max(id_col).alias(name))

    out = other
    for name, keys in (("by_pair", pair), ("by_note", [note]), ("by_qa", qa)):
        seen = keyed(keys, name)
        out = out.join(seen, [F.col(k) == seen[f"__{name}{i}"] for i, k in enumerate(keys)], "left")
    return out.select(id_col, F.when(F.col("by_pair").isNotNull(), "pair").when(F.col("by_note").isNotNull(), "note").alias("kind"), F.coalesce("by_pair", "by_note").alias("hit"), F.col("by_qa").alias("qa"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for what is used more than once: Spark then knows its size, and a lost executor loses nothing of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingles(tokens: Column, k: int) -> Column:
    """Hashes (64 bits) of the different k-grams of an array of tokens; none for fewer tokens. Tokens are hashed once, and a gram from its tokens' hashes.

    The arrays of one bind the tokens and their hashes to variables: else the optimiser would put their expressions into the inner function, to be evaluated for each gram."""
    def grams(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, F.array_distinct(each)).otherwise(F.array().cast("array<long>"))

    hashes = F.transform(F.array(tokens), lambda t: F.transform(t, lambda word: F.xxhash64(word)))
    return F.transform(hashes, grams)[0]


class Grams:
    """Gram sets of queries, and of an index what its sets have in common with them: asked (q, g), sizes of both, and hits (x, g, size of x's set). Each side is read once; sets
    and hits are written, as they are counted, joined and compared afterwards."""

    def __init__(self, queries: DataFrame, index: DataFrame, id_col: str, tokens: str, k: int):
        self.queries = written(queries.select(F.col(id_col).alias("q"), shingles(F.col(tokens), k).alias("gq")).withColumn("nq", F.size("gq")), "queries")
        self.asked = self.queries.select("q", "nq", F.explode("gq").alias("g"))
        sets = index.select(F.col(id_col).alias("x"), shingles(F.col(tokens), k).alias("gx"))
        # Only grams that are asked for matter: the others go before anything is shuffled or counted.
        hits = sets.select("x", F.size("gx").alias("nx"), F.explode("gx").alias("g")).join(self.asked.select("g").distinct(), "g", "left_semi")
        self.hits = written(hits, "hits")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """pairs (q, x, and others) with j, their Jaccard similarity, by counting what they share."""
        shared = pairs.join(self.hits, "x").join(self.asked.select("q", "nq", "g"), ["q", "g"])
        both = F.count(F.lit(1))
        return shared.groupBy(*pairs.columns).agg((both / (F.first("nq") + F.first("nx") - both)).alias("j"))

    def intersected(self, pairs: DataFrame) -> DataFrame:
        """As compared, with a row for each pair instead of one for each gram of it: for pairs that are as many as the data makes them."""
        sets = self.hits.join(pairs.select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.first("nx").alias("nx"), F.collect_list("g").alias("gx"))
        shared = pairs.join(sets, "x").join(self.queries, "q").withColumn("both", F.size(F.array_intersect("gq", "gx")))
        return shared.select(*pairs.columns, (F.col("both") / (F.col("nq") + F.col("nx") - F.col("both"))).alias("j"))


def max_jaccard(queries: DataFrame, index: DataFrame, id_col: str, tokens: str, k: int = 5, max_df: int = 100, candidates: int = 10) -> DataFrame:
    """For each query row the most similar index row: id, match, jaccard (0 and null match without candidates).

    Grams in more than max_df index rows propose nothing; the `candidates` rows that share most of the others (ties: least id) are
    compared by their full gram sets; of equal similarities the first candidate wins. `similar` has no such bounds."""
    grams = Grams(queries, index, id_col, tokens, k)
    rare = grams.hits.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= max_df).select("g")
    shared = grams.asked.join(grams.hits, "g").join(rare, "g", "left_semi").groupBy("q", "x").agg(F.count(F.lit(1)).alias("n"))
    scored = grams.compared(first_of(shared, ["q"], [F.desc("n"), F.asc("x")], candidates).select("q", "x", "n"))
    best = first_of(scored, ["q"], [F.desc("j"), F.desc("n"), F.asc("x")])
    return grams.queries.select("q").join(best, "q", "left").select(F.col("q").alias(id_col), F.col("x").alias("match"), F.coalesce("j", F.lit(0.0)).alias("jaccard"))


def similar(queries: DataFrame, index: DataFrame, id_col: str, tokens: str, threshold: float, k: int = 5, salts: int = 16) -> DataFrame:
    """All pairs of a query row and an index row whose gram sets have a Jaccard similarity of at least the threshold: id, match, jaccard. Exact, without bounds.

    A set of n grams and one that is as similar share at least t * n of them, so any n - ceil(t * n) + 1 of its grams hold one that both have: each query proposes by that many
    of its rarest grams, and only sets of t * n to n / t grams are proposed. Rows with the same grams are one class on either side until the end, so copies are compared once. A gram
    of many rows is dealt out by salts."""
    as_class = lambda df, name: df.select(F.col(id_col).alias("id"), F.col(tokens).alias("t"), F.unhex(F.substring(F.sha2(F.to_json(F.struct(F.array_sort(shingles(F.col(tokens), k)).alias("s"))), 256), 1, 32)).alias(name))
    members_q, members_x = as_class(queries, "class"), as_class(index, "class")
    one = lambda rows: rows.groupBy("class").agg(F.min_by("t", "id").alias("t"))
    grams = Grams(one(members_q), one(members_x), "class", "t", k)
    counted = grams.hits.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.asked.join(counted, "g", "left").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.coalesce("df", F.lit(0)), "g")))
    t = F.lit(float(threshold))
    probes = ranked.where((F.col("place") <= F.col("nq") - F.ceil(t * F.col("nq") - 1e-9) + 1) & F.col("df").isNotNull()).select("q", "nq", "g").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = grams.hits.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int"))
    fits = (F.col("nx") >= t * F.col("nq") - 1e-9) & (F.col("nx") * t <= F.col("nq") + 1e-9)
    pairs = written(probes.join(salted, ["g", "salt"]).where(fits).select("q", "x").distinct(), "pairs")
    found = grams.intersected(pairs).where(F.col("j") >= t - 1e-12)
    asked = members_q.select(F.col("id").alias(id_col), F.col("class").alias("q"))
    return asked.join(found, "q").join(members_x.select(F.col("id").alias("match"), F.col("class").alias("x")), "x").select(id_col, "match", F.col("j").alias("jaccard"))


#: Similarities by which `most_similar` asks, one after the other; at 0 every shared gram proposes.
LEVELS = (0.9, 0.75, 0.65, 0.55, 0.45, 0.3, 0.15, 0.0)


def most_similar(queries: DataFrame, index: DataFrame, id_col: str, tokens: str, k: int = 5, levels: tuple[float, ...] = LEVELS, hot: int = 1000) -> DataFrame:
    """For each query row the index row whose gram set has the highest Jaccard similarity: id, match, jaccard, shared (grams in common; ties: most shared, then least id). Exact, without bounds, down to the
    last level; below it, and where no gram is shared, match is null and the others are 0.

    Rows with the same grams are one class on either side, so copies are compared once. Grams of a set are ordered from the rarest on; two sets have no more in common than follow the first gram that both have,
    so one that leaves either too few for the level proposes nothing. Who finds a match at a level has all that are as similar; only the others are asked at the next. A gram of more than `hot` classes is dealt out by salts."""
    sets = lambda df: df.select(F.col(id_col).alias("id"), F.array_sort(shingles(F.col(tokens), k)).alias("s"))
    members = written(sets(queries), "members")
    asked = written(members.where(F.size("s") > 0).select("s").distinct().select(F.monotonically_increasing_id().alias("q"), F.size("s").alias("nq"), F.col("s").alias("gq")), "asked")
    classes = sets(index).where(F.size("s") > 0).groupBy("s").agg(F.min("id").alias("match"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("x"), "match", F.size("s").alias("nx"), F.col("s").alias("gx")), "classes")
    by_q, by_x = asked.select("q", "nq", F.explode("gq").alias("g")), classes.select("x", "nx", F.explode("gx").alias("g"))
    common = written(by_x.join(by_q.select("g").distinct().hint("merge"), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("df")), "common")

    def ranked(rows: DataFrame, of: str, rest: str) -> DataFrame:
        """Rows of grams that both sides have; rest: how many of its set are not before it, the others counting as rarest."""
        rows = rows.join(common, "g").withColumns({rest: F.row_number().over(Window.partitionBy(of).orderBy(F.desc("df"), F.desc("g"))), "salts": F.floor(F.col("df") / hot).cast("int")})
        return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), "salts")) if of == "q" else F.pmod(F.xxhash64("x"), F.col("salts") + 1).cast("int")).drop("df", "salts")

    probes, hits, found = written(ranked(by_q, "q", "rq"), "probes"), written(ranked(by_x, "x", "rx"), "hits"), None
    left = asked.select("q")
    for level in levels:
        t = F.lit(float(level))
        open_probes = probes.where(F.col("rq") >= t * F.col("nq") - 1e-9).join(left, "q", "left_semi")
        enough = F.least("rq", "rx") >= t / (1 + t) * (F.col("nq") + F.col("nx")) - 1e-9
        # Spark doesn't know how many rows a salted side has, so neither is left to be broadcast.
        pairs = open_probes.join(hits.where(F.col("rx") >= t * F.col("nx") - 1e-9).hint("merge"), ["g", "salt"]).where(enough).select("q", "x").distinct()
        both = pairs.join(asked, "q").join(classes, "x").select("q", "match", "nq", "nx", F.size(F.array_intersect("gq", "gx")).alias("shared"))
        scored = both.select("q", "match", "shared", (F.col("shared") / (F.col("nq") + F.col("nx") - F.col("shared"))).alias("j")).where(F.col("j") >= t - 1e-12)
        best = written(first_of(scored, ["q"], [F.desc("j"), F.desc("shared"), F.asc("match")]), "best")
        found = best if found is None else found.unionByName(best)
        left = written(left.join(best, "q", "left_anti"), "left")
        if left.isEmpty():
            break
    of = asked.join(found, "q").select("gq", "match", "j", "shared")
    rows = members.where(F.size("s") > 0).join(of, F.col("s") == F.col("gq"), "left").unionByName(members.where(F.size("s") == 0), allowMissingColumns=True)
    return rows.select(F.col("id").alias(id_col), "match", F.coalesce("j", F.lit(0.0)).alias("jaccard"), F.coalesce("shared", F.lit(0)).alias("shared"))


def pairs_of(items: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs of different items of a group, smaller item first: group, a, b."""
    sets = items.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("s"))
    left = sets.select(group, "s", F.posexplode("s").alias("i", "a"))
    return left.select(group, "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))


def as_of(events: DataFrame, by: str, order: list[str], value: Column, is_event: Column) -> DataFrame:
    """Each row with the last non-null `value` of an event row before it in its group."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("last_value", F.last(F.when(is_event, value), ignorenulls=True).over(before))


def near_best(df: DataFrame, metric: str, band: float, then: list[Column]) -> DataFrame:
    """Of the rows within `band` of the best metric, the first by `then`."""
    best = df.agg(F.max(metric)).scalar()
    return df.where(F.col(metric) >= best - band).orderBy(*then).limit(1)


def hash_order(id_col: str, seed: str) -> Column:
    """A fixed shuffle: rows in the order of this digest."""
    return hash_order_of(F.col(id_col).cast("string"), seed)


def hash_order_of(key: Column, seed: str) -> Column:
    return F.sha2(F.concat(key, F.lit(seed)), 256)


def placed(df: DataFrame, group: list[str], part: Column, order: list[Column], name: str) -> DataFrame:
    """df with each row's place (from 0) in its group, in an order of which `part` is the coarse first key. Rows are ranked within their part, and
    parts by the rows before them, so that no task holds more than a part of a group."""
    rows = df.withColumn("__part", part)
    sums = rows.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__of"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col("__part").eqNullSafe(F.col("__of"))]
    return rows.withColumn("__i", inside).join(offsets, same).withColumn(name, (F.col("__i") + F.col("__before") - 1).cast("long")).select(*df.columns, name)


def shuffled(df: DataFrame, digest: Column, then: list[Column], name: str) -> DataFrame:
    """df with places (from 0) in the order of a digest of hexadecimal digits, that is in a fixed random order."""
    rows = df.withColumn("__digest", digest)
    return placed(rows, [], F.substring("__digest", 1, 3), [F.col("__digest"), *then], name).drop("__digest")


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Whole shares of `total` in proportion: floors, and one more for the largest remainders (ties: least key). One row a key."""
    quota = F.col(weight).cast("double") * total / F.sum(weight).over(Window.partitionBy())
    rows = weights.withColumn("quota", quota).withColumn("share", F.floor("quota"))
    left = F.lit(total) - F.sum("share").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy((F.round(F.col("quota") - F.col("share"), 9)).desc(), F.col(key).asc()))
    return rows.withColumns({"left": left, "place": place}).select(key, (F.col("share") + (F.col("place") <= F.col("left")).cast("long")).alias("share"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def row_digest(df: DataFrame, *columns: str) -> Column:
    """Digest of a row's values, in the order of the columns; nulls differ from any text."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns or df.columns]), "\x1f"), 256)
