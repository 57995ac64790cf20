r"""Trie of the prefixes that conversations share, built as a Patricia tree.

A node is a different sequence of the first d turns (role, text). Turns become digests, of 128 bits, of all turns up to them (exclusive ors of hashes of place and
turn, so that they can be summed over ranges of a conversation). Then:

1. Sort: conversations that are equal as a whole become one sequence with their number; sequences are ordered by their digests, in ranges.
2. Points: neighbours in the order agree up to some depth. Points are these depths (branches) and the ends of sequences (ends, leaves), found with a
   stack that holds one path. What lies between two points of a path is an edge and is never made while aggregates are computed.
3. Borders: a range knows the neighbours of its first and last sequence. The paths that it shares with them are left open and summed over ranges: at most two paths a
   range. All other points are closed where they are.
4. Aggregates: members, leaves, children, tokens saved go up from point to point; a second pass in preorder hands each point its parent's smallest member.
5. Expansion: each depth of an edge becomes a node. It has its lower point's members, and what it saves is what its point saves and the sum of the edge's bytes from its depth on.

Skew: copies of a conversation are aggregated before they are sorted. A prefix that a third of all conversations share is many ranges. A conversation that
holds a third of all rows is ordered in ranges, and joined by buckets of 65,536 places. A sequence is sorted by its first digests only, up to the next multiple of 64 beyond what
it shares with another one; the rest of it is one edge. So arrays hold what two different sequences share, not whole conversations. The members that
end at a node are joined into texts of ids 4,096 at a time, and hashed in order as a stream, since the digest over them is one of all.

Defined results: a null role or text is empty. Turns are ordered by turn (null first), then role, then text; rows that repeat are turns of their
own. Rows with a null conv_id take no part. Conversations without turns end at the root. An empty table gives no nodes. Columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_of

#: Digests of a sequence that are sorted at least, and by whose multiples more are taken.
BLOCK = 64
BUCKET_BITS, CHUNK_BITS, SALTS = 16, 12, 16
NOTHING = hashlib.sha256(b"").hexdigest()


def ordinals(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """Turns (conv_id, turn, role, text) in order: conv_id, at (grows in the order of all rows), part (range of rows), role, text. Written, as ranges are drawn anew each time."""
    t = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    n = parts or int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = t.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"), "role", "text")


def carried(rows: DataFrame, **sums) -> DataFrame:
    """What a conversation has in ranges before the one it goes on in, by aggregate: at most one row a range, so it may be broadcast."""
    pairs = rows.groupBy("conv_id", "part").agg(*[total.alias(name) for name, total in sums.items()])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    again = {"n": F.sum, "size": F.sum, "a": F.bit_xor, "b": F.bit_xor}
    pairs = pairs.select("conv_id", "part", *[again[name](name).over(before).alias(f"{name}_before") for name in sums])
    return F.broadcast(pairs.where(F.col(f"{next(iter(sums))}_before").isNotNull()))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of ordinals() with pos, their place in the conversation from 1."""
    within = Window.partitionBy("part", "conv_id").orderBy("at")
    joined = rows.join(carried(rows, n=F.count(F.lit(1))), ["conv_id", "part"], "left")
    return joined.withColumn("pos", F.row_number().over(within) + F.coalesce("n_before", F.lit(0))).drop("n_before")


def digests(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """Each turn as conv_id, pos, a and b (digest of all turns up to it), size (bytes of its text), upto (bytes of all texts up to it)."""
    rows = ordinals(turns, parts).select("conv_id", "at", "part", F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "role", "text").alias("y"), F.octet_length("text").cast("long").alias("size"))
    rows = placed(materialize(rows, "turns")).withColumns({"a": F.xxhash64("pos", "x", "y"), "b": F.xxhash64("y", "pos", "x")})
    within = Window.partitionBy("part", "conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = carried(rows, size=F.sum("size"), a=F.bit_xor("a"), b=F.bit_xor("b"))
    joined = rows.join(before, ["conv_id", "part"], "left")
    running = lambda name, how: how(name).over(within)
    return joined.select(
        "conv_id", "pos", running("a", F.bit_xor).bitwiseXOR(F.coalesce("a_before", F.lit(0))).alias("a"), running("b", F.bit_xor).bitwiseXOR(F.coalesce("b_before", F.lit(0))).alias("b"),
        "size", (running("size", F.sum) + F.coalesce("size_before", F.lit(0))).alias("upto"))


SEQUENCE = "len long, a long, b long, total long, n long, rep long, ends string"


def sequences(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Different sequences of turns: len, a, b (digest of the whole), total (bytes), n (conversations), rep (the smallest), ends (digest of their ids)."""
    import pyarrow as pa

    none = conversations.where("conv_id IS NOT NULL").select("conv_id", F.lit(0).alias("pos"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "size", "upto")])
    members = rows.unionAll(none).groupBy("conv_id").agg(F.max(F.struct(F.col("pos").cast("long").alias("len"), "a", "b", "upto")).alias("whole")).select("conv_id", "whole.*")
    chunks = members.groupBy("len", "a", "b", "upto", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    keys = ["len", "a", "b", "upto"]

    def kernel(batches):
        key = total = rep = digest = None
        for batch in batches:
            out = []
            for *new, n, first, ids in zip(*(batch.column(c).to_pylist() for c in [*keys, "n", "rep", "ids"]), strict=True):
                if new != key:
                    if key is not None:
                        out.append((*key, total, rep, digest.hexdigest()))
                    key, total, rep, digest = new, 0, first, hashlib.sha256()
                else:
                    digest.update(b",")
                total += n
                digest.update(ids.encode())
            yield record(pa, out)
        if key is not None:
            yield record(pa, [(*key, total, rep, digest.hexdigest())])

    return chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "n", "rep", "ids").mapInArrow(kernel, SEQUENCE)


def record(pa, rows):
    columns = list(zip(*rows, strict=True)) or [()] * 7
    names = [part.split()[0] for part in SEQUENCE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "ends" else pa.int64()) for name, c in zip(names, columns, strict=True)], names=names)


def of_sequences(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """The rows of the conversations that stand for their sequence."""
    wanted = seqs.select(F.col("rep").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.shiftright("len", BUCKET_BITS).cast("int"))).alias("bucket"))
    return rows.withColumn("bucket", F.shiftright("pos", BUCKET_BITS)).join(wanted, ["conv_id", "bucket"], "left_semi")


def sort_keys(rows: DataFrame, seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """seqs with the digests that they are sorted by: ka, kb, and the bytes up to each, uptos."""
    bounds = rows.where(F.col("pos") % block == 0).select("conv_id", "pos", "a", "b").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    shared = bounds.groupBy("pos", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    reach = bounds.join(shared, ["pos", "a", "b", "salt"]).groupBy("conv_id").agg((F.max("pos") + block).alias("reach"))
    names = ["conv_id", "pos", "a", "b", "upto"]
    taken = rows.where(F.col("pos") <= block).select(*names).unionAll(rows.where(F.col("pos") > block).join(reach, "conv_id").where("pos <= reach").select(*names))
    keys = taken.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "upto"))).alias("k"))
    empty = F.array().cast("array<bigint>")
    return seqs.join(keys, F.col("rep") == F.col("conv_id"), "left").select(
        "rep", "len", "total", "n", "ends", *[F.coalesce(F.col(f"k.{c}"), empty).alias(name) for c, name in (("a", "ka"), ("b", "kb"), ("upto", "uptos"))])


class Node:
    """A point of the tree while its range is read: `kept` is what closed nodes below it save."""

    __slots__ = ("children", "depth", "ends", "first", "key", "kept", "leaves", "n", "open", "rep", "smallest", "upto")

    def __init__(self, depth, key, upto, first, rep, n=0, smallest=None, ends=None, open_=False):
        self.depth, self.key, self.upto, self.first, self.rep, self.n, self.ends = depth, key, upto, first, rep, n, ends
        self.smallest, self.open, self.children, self.leaves, self.kept = smallest, open_, 0, 0, 0

    def take(self, child: Node) -> None:
        self.n += child.n
        self.leaves += child.leaves
        self.smallest = child.smallest if self.smallest is None else min(self.smallest, child.smallest)
        if not child.open:
            self.children += 1
            self.kept += child.kept + (child.n - 1) * (child.upto - self.upto)


def agree(x: list, y: list) -> int:
    """The number of leading digests in common; null has none."""
    if x is None or y is None:
        return 0
    k = 0
    for p, q in zip(x, y, strict=False):
        if p != q:
            break
        k += 1
    return k


def points(part: int, before: list | None, after: list | None, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The points of a range, rows being (at, rep, len, total, n, ends, key, uptos) in order: open ones in partial sums, closed ones whole.

    Each as (part, first row, depth, parent's depth, a, b, upto, size of the last turn if open, rep, n, smallest, children, leaves, kept, ends, open)."""
    stack: list[Node] = []
    key: list = []
    uptos: list = []

    def inner(depth, of: Node, open_=False):
        return Node(depth, key[depth - 1] if depth else (0, 0), uptos[depth - 1] if depth else 0, of.first, of.rep, open_=open_)

    def written(v: Node, above: int, size: int = 0):
        return (part, v.first, v.depth, above, *v.key, v.upto, size, v.rep, v.n, v.smallest, v.children, v.leaves, v.kept, v.ends, v.open)

    def close(down_to: int):
        """Takes points deeper than down_to off the stack; the last of their parents is made there if there is none."""
        while stack[-1].depth > down_to:
            v = stack.pop()
            if not (v.open or v.children):
                v.leaves = 1
            if stack[-1].depth < down_to:
                stack.append(inner(down_to, v))
            yield written(v, stack[-1].depth, v.upto - stack[-1].upto)
            stack[-1].take(v)

    for at, rep, length, total, n, ends, new, new_uptos in rows:
        if not stack:
            common = agree(before, new)
            key, uptos = new, new_uptos
            whole = Node(length, None, total, at, rep)
            stack = [inner(depth, whole, True) for depth in range(common + 1)]
        else:
            common = agree(key, new)
            yield from close(common)
            key, uptos = new, new_uptos
        if length > stack[-1].depth:
            stack.append(Node(length, key[length - 1] if length <= len(key) else (0, 0), total, at, rep, n, rep, ends))
        else:
            stack[-1].ends, stack[-1].n, stack[-1].smallest = ends, n, rep
    if not stack:
        return
    yield from close(agree(key, after))
    while stack:
        v = stack.pop()
        v.open = True
        while v.depth > (stack[-1].depth + 1 if stack else 0):
            up = inner(v.depth - 1, v, True)
            yield written(v, v.depth - 1, v.upto - up.upto)
            up.take(v)
            v = up
        yield written(v, v.depth - 1, v.upto - stack[-1].upto if stack else 0)
        if stack:
            stack[-1].take(v)


POINT = "part int, first long, depth long, above long, a long, b long, upto long, size long, rep long, n long, smallest long, children long, leaves long, kept long, ends string, open boolean"
EDGE = "above long, depth long, rep long, n long, smallest long, parent long, children long, leaves long, kept long, upto long, ends string"


def batch_of(rows: list, schema: str):
    """Rows as an Arrow batch of a schema of these few types."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for (_, kind), c in zip(fields, columns, strict=True)], names=[name for name, _ in fields])


def find_points(keyed: DataFrame, parts: int | None = None) -> DataFrame:
    """The points of all ranges of the sequences with their keys."""
    n = parts or int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, "ka", "kb").sortWithinPartitions("ka", "kb")
    rows = materialize(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sequences")
    # A row a range, so that these windows are over the ranges only.
    ends = rows.groupBy("part").agg(F.min(F.struct("ka", "kb")).alias("low"), F.max(F.struct("ka", "kb")).alias("high"))
    in_order = Window.orderBy("part")
    ends = ends.select("part", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("after"))
    names = ["part", "at", "rep", "len", "total", "n", "ends", "ka", "kb", "uptos"]
    blank = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names}
    heads = [ends.select("part", F.lit(at).cast("long").alias("at"), *[blank[c] for c in ("rep", "len", "total", "n", "ends")], F.col(f"{side}.ka"), F.col(f"{side}.kb"), blank["uptos"]) for at, side in ((-2, "before"), (-1, "after"))]
    stream = rows.select(*names).unionAll(heads[0]).unionAll(heads[1]).repartition(n, "part").sortWithinPartitions("part", "at")

    def kernel(batches):
        from itertools import groupby

        def read():
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    yield from zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns), strict=True)

        out = []
        for part, group in groupby(read(), key=lambda r: r[0]):
            sides = [None if r[7] is None else list(zip(r[7], r[8], strict=True)) for r in (next(group), next(group))]
            body = ((*r[1:7], list(zip(r[7], r[8], strict=True)), r[9]) for r in group)
            for point in points(part, *sides, body):
                out.append(point)
                if len(out) >= 2000:
                    yield batch_of(out, POINT)
                    out = []
        yield batch_of(out, POINT)

    return stream.mapInArrow(kernel, POINT)


def merged(open_points: DataFrame) -> DataFrame:
    """Open points summed over ranges, with what is saved below them and their number of children: two paths a range at most, so one task does it."""
    sums = open_points.groupBy("depth", "a", "b").agg(
        F.min("first").alias("owner"), F.first("size").alias("size"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "kept")], F.min("smallest").alias("smallest"), F.max("ends").alias("ends"))
    fields = ["owner", "depth", "a", "b", "size", "n", "smallest", "children", "leaves", "kept", "ends"]
    schema = "owner long, depth long, a long, b long, size long, n long, smallest long, children long, leaves long, kept long, ends string"

    def kernel(batches):
        rows = [list(r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        path, above = [], []
        for k, row in enumerate(rows):
            del path[row[1] :]
            above.append(path[-1] if path else None)
            path.append(k)
        for k in range(len(rows) - 1, 0, -1):
            up, row = rows[above[k]], rows[k]
            up[7] += 1
            up[9] += row[9] + (row[5] - 1) * row[4]
        for row in rows:
            row[8] = row[8] if row[7] else 1
        yield batch_of(rows, schema)

    return sums.select(*fields).coalesce(1).sortWithinPartitions("owner", "depth").mapInArrow(kernel, schema)


def edges(found: DataFrame) -> DataFrame:
    """Points as edges down to them, with their parent's smallest member: by a pass in preorder over each range."""
    whole = merged(found.where("open")).select("owner", *[F.col(c).alias(f"m_{c}") for c in ("depth", "a", "b", "n", "smallest", "children", "leaves", "kept", "ends")])
    closed = found.where("NOT open").select("*", F.lit(True).alias("emit"))
    opened = found.where("open").join(whole, (F.col("depth") == F.col("m_depth")) & (F.col("a") == F.col("m_a")) & (F.col("b") == F.col("m_b")))
    opened = opened.select(*[F.col(f"m_{c}").alias(c) if c in ("n", "smallest", "children", "leaves", "kept", "ends") else F.col(c) for c in found.columns], (F.col("first") == F.col("owner")).alias("emit"))
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["part", "first", "depth", "above", "rep", "n", "smallest", "children", "leaves", "kept", "upto", "ends", "emit"]
    stream = closed.unionAll(opened).select(*names).repartition(n, "part").sortWithinPartitions("part", "first", "depth")

    def kernel(batches):
        path, of = [], None
        for batch in batches:
            out = []
            for part, _, depth, above, rep, n, smallest, children, leaves, kept, upto, ends, emit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != of:
                    path, of = [], part
                while path and path[-1][0] > above:
                    path.pop()
                if emit:
                    out.append((above, depth, rep, n, smallest, path[-1][1] if path else None, children, leaves, kept, upto, ends))
                path.append((depth, smallest))
            yield batch_of(out, EDGE)

    return stream.mapInArrow(kernel, EDGE)


def expand(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges as nodes: each depth of an edge, with the sum of bytes from there to the edge's end."""
    spread = found.where("depth > 0").withColumn("bucket", F.explode(F.sequence(F.shiftright(F.col("above") + 1, BUCKET_BITS), F.shiftright("depth", BUCKET_BITS))))
    e, r = spread.alias("e"), rows.withColumn("bucket", F.shiftright("pos", BUCKET_BITS)).alias("r")
    on = (F.col("e.rep") == F.col("r.conv_id")) & (F.col("e.bucket") == F.col("r.bucket")) & (F.col("r.pos") > F.col("e.above")) & (F.col("r.pos") <= F.col("e.depth"))
    last = F.col("r.pos") == F.col("e.depth")
    nodes = e.join(r, on).select(
        F.col("e.smallest").alias("conv_id"), F.col("r.pos").cast("long").alias("depth"), F.when(F.col("r.pos") == F.col("e.above") + 1, F.col("e.parent")).otherwise(F.col("e.smallest")).alias("parent_conv_id"),
        F.col("e.n").alias("n_convs"), F.when(last, F.col("e.children")).otherwise(1).alias("n_children"), F.col("e.leaves").alias("n_leaves"),
        (F.col("e.kept") + (F.col("e.n") - 1) * (F.col("e.upto") - F.col("r.upto") + F.col("r.size"))).alias("saved_tokens"), F.when(last, F.col("e.ends")).alias("ends"))
    root = found.where("depth = 0").select(
        F.col("smallest").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("kept").alias("saved_tokens"), "ends")
    return nodes.unionAll(root).withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).drop("ends")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """turns (conv_id, turn, role, text), and the ids of all conversations where some have no turns. Returns the nodes: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (bytes of texts that need not be repeated in its subtree), ends_sha256."""
    rows = materialize(digests(turns, parts), "digests")
    seqs = materialize(sequences(rows, conversations if conversations is not None else turns.select("conv_id").distinct()), "whole")
    alone = materialize(of_sequences(rows, seqs), "alone").drop("bucket")
    found = materialize(find_points(sort_keys(alone, seqs, block), parts), "points")
    return expand(edges(found), alone)


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin as another of their family: conversation c is the first h turns of c - c % family, then its own turns after its first h; h is crc32(c) % most."""
    rows = placed(materialize(ordinals(turns), "rebuilt"))
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    c = F.col("conv_id")
    ids = rows.select("conv_id").distinct()
    heads = rows.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    asked = ids.select("conv_id", (c - c % family).alias("base"), h(c).alias("h"))
    first = asked.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.lit(0).alias("own"), "pos", "role", "text")
    then = rows.where(F.col("pos") > h(c)).select("conv_id", F.lit(1).alias("own"), "pos", "role", "text")
    return first.unionAll(then).select("conv_id", F.struct("own", "pos").alias("turn"), "role", "text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(turns), turns.select("conv_id").distinct())


#: The checksum bit by bit over the digits of an id, as DuckDB has no function for it.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::BIGINT) ELSE d // 2 END)), 4294967295::BIGINT)"""
SQL = f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM a),
i AS (SELECT conv_id, {CRC_SQL} % 9 AS h FROM (SELECT DISTINCT conv_id FROM a)),
r AS (SELECT i.conv_id, 0 AS own, pos, role, text FROM i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 5 AND pos <= h
  UNION ALL SELECT o.conv_id, 1, pos, role, text FROM o JOIN i ON i.conv_id = o.conv_id AND pos > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, octet_length(encode(text)) AS size, sha256(length(role)::VARCHAR || ':' || role || text) AS x FROM r),
p AS (SELECT conv_id, depth, size, sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS key FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM i),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM p GROUP BY key, depth),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(key, depth) AS key FROM p GROUP BY conv_id) GROUP BY key),
u AS (SELECT n.*, p.key AS up FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
k AS (SELECT up AS key, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY up),
t AS (SELECT p.key, sum((u.n_convs - 1) * u.size) AS saved, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves FROM u JOIN p ON p.conv_id = u.conv_id AND p.depth <= u.depth LEFT JOIN k ON k.key = u.key GROUP BY p.key)
SELECT u.conv_id, u.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  coalesce(ends, '{NOTHING}') AS ends_sha256
FROM u JOIN t ON t.key = u.key LEFT JOIN k ON k.key = u.key LEFT JOIN e ON e.key = u.key LEFT JOIN n AS above ON above.key = u.up
"""
