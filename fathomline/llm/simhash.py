r"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into `segments` segments (4 of 16 bits; 5 for very many fingerprints). Two that
differ in at most 3 bits leave, by pigeonhole, segments - 3 segments untouched, and of any two others at least one
with at most one error. So a key is the untouched segments as they are, and one more segment fuzzily: as the index of
a codeword of the binary Golay code (23, 12), the segment being padded to 23 bits. Every word has exactly one codeword
within distance 3; x and y at distance 1 share the nearest codeword of x if y brings all its codewords within
distance 4, of which there are one or six. The join therefore has two sides: one gives the nearest codeword, the other
all that are near. Candidates are compared bit by bit, so the links are exactly the pairs at 3 bits or fewer.

Equal fingerprints are one node. A node has at most 43,744 others within 3 bits, whatever the number of documents. Links join into components by alternating large and small stars, each round written
to the shared folder; nothing is gathered on the driver but the number of links and a checksum.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like any other. Rows
that repeat a doc_id have a row each. A null doc_id gets a component but never names one, unless the component has no
other id: then component_id is null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, orderable, rows_of, table

SEED, SHINGLE, RADIUS = 42, 3, 3


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z, and the six kinds of white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return int.from_bytes(xxh64_digest(joined, seed), "big")
    after = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts, ends = [0, *after[: n - width].tolist()], (after[width - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):
        hashes = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as doc_id, fp (the fingerprint as a signed long)."""

    def kernel(batches):
        import pyarrow as pa

        for part, (_, texts) in rows_of(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([signed(fingerprint(t)) for t in texts], pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@lru_cache
def codewords() -> np.ndarray:
    """The codeword of each of the 4,096 indices."""
    words = np.zeros(4096, np.uint32)
    index = np.arange(4096, dtype=np.uint32)
    for bit in range(12):
        words ^= np.where(index >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0))
    return words


@lru_cache
def near_codewords(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of `width` bits, padded with zeros: index of the nearest codeword; where the near ones (within distance 4) of each word begin; the near ones."""
    code, nearest, starts, near = codewords(), [], [0], []
    for at in range(0, 1 << width, 4096):
        distance = np.bitwise_count(np.arange(at, min(at + 4096, 1 << width), dtype=np.uint32)[:, None] ^ code[None, :])
        nearest.append(distance.argmin(axis=1))
        close = distance <= 4
        near.append(np.nonzero(close)[1].astype(np.uint16))
        starts.append(close.sum(axis=1))
    return np.concatenate(nearest).astype(np.uint16), np.concatenate([np.atleast_1d(s) for s in starts]).cumsum(), np.concatenate(near)


def segment_plan(segments: int) -> tuple[list[tuple[int, int]], list[tuple[tuple[int, ...], int]]]:
    """(shift, width) of the segments, and the keys as (untouched segments, fuzzy segment)."""
    edges = [64 * k // segments for k in range(segments + 1)]
    keys = []
    for exact in combinations(range(segments), segments - RADIUS):
        rest = [k for k in range(segments) if k not in exact]
        keys += [(exact, k) for k in rest[:2]]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], keys


def keys_of(fps: np.ndarray, segments: int, fuzzy: bool, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """fps unsigned. Returns keys and the place in fps that each belongs to."""
    parts, keys = segment_plan(segments)
    cut = [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in parts]
    out, of = [], []
    for number, (exact, k) in enumerate(keys):
        base = np.full(len(fps), number, np.uint64)
        for e in exact:
            base = base << np.uint64(parts[e][1]) | cut[e]
        nearest, starts, near = tables[parts[k][1]]
        word = cut[k].astype(np.int64)
        if fuzzy:
            times = starts[word + 1] - starts[word]
            place = np.repeat(np.arange(len(fps)), times)
            within = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
            code = near[starts[word][place] + within]
        else:
            place, code = np.arange(len(fps)), nearest[word]
        out.append(base[place] << np.uint64(12) | code.astype(np.uint64))
        of.append(place)
    return np.concatenate(out), np.concatenate(of)


def links(nodes: DataFrame, segments: int = 4) -> DataFrame:
    """nodes: distinct fp. Returns each pair at most 3 bits apart once or more: a, b with a < b."""
    tables = {w: near_codewords(w) for _, w in segment_plan(segments)[0]}
    shared = nodes.sparkSession.sparkContext.broadcast(tables)  # its size depends on the code alone: under 1 MB

    def keyed(fuzzy: bool):
        def kernel(batches):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    fps = batch.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).astype(np.int64)
                    key, of = keys_of(fps.view(np.uint64), segments, fuzzy, shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[of])], names=["key", "fp"])

        return nodes.select("fp").mapInArrow(kernel, "key long, fp long")

    x, y = keyed(False).withColumnRenamed("fp", "x"), keyed(True).withColumnRenamed("fp", "y")
    # Spark takes a kernel to make as many rows as it reads, but these make 8 and some forty a node: it would broadcast them by the size of the nodes.
    found = x.join(y.hint("merge"), (x["key"] == y["key"]) & (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges a, b. Returns node, root for every node of an edge: root is the least node reachable."""
    edges = materialize(edges.select("a", "b").where("a <> b"), "links")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("c")).alias("m"))
        large = both.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        small = down.join(least, F.col("a") == F.col("c")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = materialize(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        state = now


def spread(nodes: DataFrame) -> DataFrame:
    """Nodes over as many tasks as a shuffle has: each of them makes some forty rows."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(spread(nodes.select("fp")), segments))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    rooted = materialize(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(named, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(found, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key. Spark takes the first of each task before it deals rows out, so that a key with many rows is no burden."""
    place = "place" + "_" * max(map(len, rows.columns))
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) == 1).drop(place)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = 4) -> DataFrame:
    """One row of docs for each component, whole and as it was: the one with the least doc_id (null after all others), then the least other columns (maps by their JSON), then the least text."""
    others = [f for f in docs.schema.fields if f.name not in (id_col, text_col)]
    order = [F.col(f"`{id_col}`").asc_nulls_last(), *map(orderable, others), F.col(f"`{text_col}`")]
    fp, node, root = (name + "_" * max(map(len, docs.columns)) for name in ("fp", "node", "root"))
    names, at = [*docs.columns, fp], docs.columns.index(text_col)

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                prints = [signed(fingerprint(t)) for t in part.column(at).cast(pa.string()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.int64())], names=names)

    rows = materialize(docs.mapInArrow(kernel, StructType([*docs.schema.fields, StructField(fp, LongType())])), "printed")
    nodes = materialize(rows.select(F.col(fp).alias("fp")).distinct(), "nodes")
    roots = components(links(spread(nodes), segments)).toDF(node, root)
    heads = first_of(rows, fp, order).join(roots, F.col(fp) == F.col(node), "left").withColumn(root, F.coalesce(root, fp))
    return first_of(heads, root, order).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
