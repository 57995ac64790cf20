"""Digests of files of any size: read in pieces by executors, whole or in ranges.

A file's SHA-256 is one task's work, as it can't be put together from parts; no more than a piece of 1 MB is held. Digests of ranges are many tasks, and a tree digest (of the ranges'
digests, in order) stands for the file: two versions of a file are compared by their ranges, and what changed is named by its place.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.strict import PIECE_BYTES, listed, opened

RANGE_BYTES = 64 << 20


def ranges(spark: SparkSession, paths: str, size: int | None) -> DataFrame:
    """file, range (from 0), start, bytes: of all files, or each file as one range."""
    files = spark.createDataFrame(listed(paths), "file string, size long")
    step = F.lit(size).cast("long") if size else F.greatest(F.col("size"), F.lit(1))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), step))
    rows = files.select("file", "size", starts.alias("start"), step.alias("step"))
    return rows.select("file", (F.col("start") / F.col("step")).cast("long").alias("range"), "start", F.least("step", F.col("size") - F.col("start")).alias("bytes"))


def hashed(rows: DataFrame) -> DataFrame:
    """Rows of ranges() with sha256."""

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for file, start, left in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "bytes")), strict=True):
                store, at = opened(file)
                digest = hashlib.sha256()
                with store.open_input_file(at) as f:
                    f.seek(start)
                    while left > 0 and (piece := f.read(min(PIECE_BYTES, left))):
                        digest.update(piece)
                        left -= len(piece)
                if left > 0:
                    raise ValueError(f"{file} has become shorter")
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "sha256"])

    # A row is a range's work, so rows are dealt out one by one.
    return rows.repartition(200, "file", "range").mapInArrow(kernel, "file string, range long, start long, bytes long, sha256 string")


def file_digests(spark: SparkSession, paths: str) -> DataFrame:
    """file (whole path), bytes, sha256 of each file."""
    return hashed(ranges(spark, paths, None)).select("file", "bytes", "sha256")


def range_digests(spark: SparkSession, paths: str, size: int = RANGE_BYTES) -> DataFrame:
    """file, range, start, bytes, sha256 of each range of a file."""
    return hashed(ranges(spark, paths, size))


def tree_digests(parts: DataFrame) -> DataFrame:
    """file, bytes, ranges, tree: the digest of the digests of a file's ranges, in order (64 characters for each range)."""
    return parts.groupBy("file").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("ranges"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "sha256"))), lambda r: r["sha256"]), ""), 256).alias("tree"))


def changed_ranges(now: DataFrame, before: DataFrame) -> DataFrame:
    """Ranges that differ between two readings of range_digests: file, range, start, state (changed, added, gone)."""
    a, b = now.select("file", "range", "start", F.col("sha256").alias("a")), before.select("file", "range", F.col("start").alias("was"), F.col("sha256").alias("b"))
    state = F.when(F.col("a").isNull(), "gone").when(F.col("b").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, ["file", "range"], "full").select("file", "range", F.coalesce("start", "was").alias("start"), state.alias("state")).where("state is not null")
