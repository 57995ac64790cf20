r"""Exact top-k search on a bit-sliced index.

Components become integers floor(scale * x). A block of up to `block` rows holds, for every dimension, the bits of its
values as slices: bitmaps with a bit per row. A query's inner products with all rows of a block are computed by
bitmap arithmetic: the slices of a dimension are added once for each bit set in the query's component, by full
adders over bitmaps of equal weight (carries go one weight up), until one bitmap per weight is left. The top rows are
then selected from the most significant slice downward; rows that are equal at the k-th place are settled exactly, the
smaller id first. The scores of the few chosen rows are read from the same slices.

Values are made non-negative before slicing: x - least for positive components of the query, most - x for negative ones;
what that adds to the score is the same for all rows of a block and is taken off again.

Every query meets every row, in blocks: the index blocks and the query blocks are rows with a binary column each; the
query blocks are repeated for every index block and joined to them by its number. A block's result is k rows a query,
which are ranked once more per query. No task holds more than one block of rows and one of queries.

Rows that repeat both id and vector are one row of the index for up to k + 1 of them (more can't be among the k best), and one
query that is answered as often as it is there; so a block is bounded by its number of different rows.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part. Vectors only meet those
of the same length. A null id is a candidate (last among ties), never a query. Rows that repeat an id are candidates
each; a query doesn't meet its own row, but others that carry its id; repeated query rows give repeated results (told
apart by nothing). Fewer candidates than k give all. Scores must fit a long. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

BLOCK, QUERIES = 16_384, 256


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def slices(values: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of non-negative integers, least weight first."""
    bits = max(1, int(values.max()).bit_length())
    return [np.packbits((values >> k) & 1 == 1, bitorder="little") for k in range(bits)]


class Index:
    """Slices of a block: values has a row for each row, a column for each dimension."""

    def __init__(self, values: np.ndarray):
        self.rows, dims = values.shape
        words = -(-self.rows // 64)
        padded = np.zeros((words * 64, dims), np.int64)
        padded[: self.rows] = values
        self.least, self.most = values.min(axis=0), values.max(axis=0)
        self.up = [[s.view(np.uint64) for s in slices(np.where(np.arange(words * 64) < self.rows, padded[:, d] - self.least[d], 0))] for d in range(dims)]
        self.down = [[s.view(np.uint64) for s in slices(np.where(np.arange(words * 64) < self.rows, self.most[d] - padded[:, d], 0))] for d in range(dims)]
        self.valid = np.packbits(np.arange(words * 64) < self.rows, bitorder="little").view(np.uint64)

    def sums(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Bitmaps of every row's score less a constant, least weight first; the constant."""
        heaps: list[list[np.ndarray]] = []
        constant = 0
        for d, q in enumerate(query):
            constant += q * int(self.least[d] if q >= 0 else self.most[d])
            part, weight = (self.up if q >= 0 else self.down)[d], abs(q)
            shift = 0
            while weight:
                if weight & 1:
                    while len(heaps) < shift + len(part):
                        heaps.append([])
                    for k, s in enumerate(part):
                        heaps[shift + k].append(s)
                weight >>= 1
                shift += 1
        out, k = [], 0
        while k < len(heaps):
            heap = heaps[k]
            while len(heap) > 1:
                if k + 1 == len(heaps):
                    heaps.append([])
                a, b = heap.pop(), heap.pop()
                half = a ^ b
                if heap:  # full adder
                    c = heap.pop()
                    heap.insert(0, half ^ c)
                    heaps[k + 1].append((a & b) | (half & c))
                else:
                    heap.append(half)
                    heaps[k + 1].append(a & b)
            out.append(heap[0] if heap else np.zeros_like(self.valid))
            k += 1
        return out, constant

    def top(self, query: list[int], k: int, allowed: np.ndarray) -> list[tuple[int, int]]:
        """The k best of the allowed rows as (row, score), best first; equal scores by row."""
        sums, constant = self.sums(query)
        sure, equal = np.zeros_like(allowed), allowed
        for s in reversed(sums):
            with_bit = equal & s
            n = int(np.bitwise_count(sure | with_bit).sum())
            if n > k:
                equal = with_bit
            else:
                sure, equal = sure | with_bit, equal & ~s
                if n == k:
                    equal = np.zeros_like(allowed)
                    break
        rows = positions(sure)
        rows = np.concatenate([rows, positions(equal)[: k - len(rows)]])  # the boundary: equal scores, in row order
        scored = [(int(r), constant + sum(int(s[r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << w for w, s in enumerate(sums))) for r in rows]
        return sorted(scored, key=lambda x: (-x[1], x[0]))


def positions(bitmap: np.ndarray) -> np.ndarray:
    """Numbers of the set bits; only words that have any are unpacked."""
    words = np.flatnonzero(bitmap)
    if not len(words):
        return words
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return words[at] * 64 + bit


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """vectors: id, v, times; rows differ in id or v. Returns dims, block, n (blocks of that length), payload: ids (null: no id), times and values as Arrow bytes."""
    counts = vectors.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select(F.col("dims").alias("of"), F.ceil(F.col("rows") / rows).cast("int").alias("n"))
    spread = F.pmod(F.xxhash64("id", "v"), F.col("n").cast("long")).cast("int")
    placed = vectors.join(F.broadcast(counts), F.size("v") == F.col("of")).select(F.size("v").alias("dims"), spread.alias("block"), "n", "id", "times", "v")

    def kernel(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = pa.concat_arrays([c.flatten() for c in group.column("v").chunks])
        least, most = pc.min_max(flat).as_py().values()
        small = next(t for t, b in ((pa.int16(), 15), (pa.int32(), 31), (pa.int64(), 63)) if -(1 << b) <= least and most < 1 << b)
        part = pa.table({"id": group.column("id"), "times": group.column("times"), "v": pa.FixedSizeListArray.from_arrays(flat.cast(small), len(flat) // group.num_rows)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        return pa.table({"dims": group.column("dims").slice(0, 1), "block": group.column("block").slice(0, 1), "n": group.column("n").slice(0, 1), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return materialize(placed.groupBy("dims", "block").applyInArrow(kernel, "dims int, block int, n int, payload binary"), name)


def unpack(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    import pyarrow as pa

    data = pa.ipc.open_stream(payload).read_all()
    flat = pa.concat_arrays([c.flatten() for c in data.column("v").chunks])
    return data.column("id").to_pylist(), data.column("times").to_numpy(), flat.to_numpy().reshape(data.num_rows, -1).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """For each row where is_query holds: query_id, rank (from 1), vec_id, score."""
    good = vectors.where(usable(F.col(vector_col)))
    marked = good.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), (is_query & F.col(id_col).isNotNull()).alias("asks"))
    # A row's id and quantised vector say all that matters here, so of equal rows any one is a query's own.
    distinct = materialize(marked.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked")), "different")
    rows = distinct.select("id", "v", F.least("n", F.lit(k + 1)).alias("times"))
    asked = distinct.where("asked > 0").select("id", "v", F.col("asked").alias("times"))
    index, asks = blocks(rows, block, "index"), blocks(asked, queries, "queries")
    targets = index.select("dims", F.col("n").alias("targets")).distinct()
    sent = asks.join(targets, "dims").select("dims", F.explode(F.sequence(F.lit(0), F.col("targets") - 1)).alias("block"), F.col("block").alias("ask"), F.col("payload").alias("asked"))
    met = index.select("dims", "block", "payload").join(sent, ["dims", "block"]).select("dims", "block", "ask", "payload", "asked")

    def kernel(batches):
        import pyarrow as pa

        last, known = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in ("dims", "block", "ask", "payload", "asked")}
                if last != (row["dims"], row["block"]):
                    ids, times, values = unpack(row["payload"])
                    order = np.repeat(order := sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0)), times[order])
                    ids, values, last = [ids[r] for r in order], values[order], (row["dims"], row["block"])
                    known = Index(values)
                    own: dict = {}
                    for r, i in enumerate(ids):
                        own.setdefault(i, []).append(r)
                out = []
                for number, (q, n, v) in enumerate(zip(*unpack(row["asked"]), strict=True)):
                    allowed = known.valid.copy()
                    for r in own.get(q, ()):
                        if np.array_equal(values[r], v):
                            allowed[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
                            break
                    out += [(q, row["ask"] * 1_000_000 + number, n, ids[r], s) for r, s in known.top(v.tolist(), k, allowed)]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(5)], names=["query_id", "ask", "times", "vec_id", "score"])

    found = met.mapInArrow(kernel, "query_id long, ask long, times long, vec_id long, score long")
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = ranked.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.own <> c.own AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 5
"""
