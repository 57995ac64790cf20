"""JSONL: a strict reader, a lenient one, and a writer.

The strict reader refuses what JSON allows but data must not hold: duplicate keys (at any depth), NaN and infinities (written or by
overflow), lines that are no object. Blank lines are skipped. An error names file and line.
"""

from __future__ import annotations

import json
import math
import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unique(pairs: list[tuple]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise ValueError(f"duplicate key {key!r}")
        out[key] = value
    return out


def finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"non-finite number {text}")
    return value


def refuse(text: str):
    raise ValueError(f"constant {text}")


def strict_object(line: str) -> dict:
    value = json.loads(line, object_pairs_hook=unique, parse_float=finite, parse_constant=refuse)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def why_not(line: str | None) -> str | None:
    """What a line fails by; null for a good or a blank one."""
    if line is None or not line.strip():
        return None
    try:
        strict_object(line)
    except RecursionError:
        return "nested too deeply"
    except ValueError as e:
        return re.sub(r"\s+", " ", str(e)) or "invalid JSON"
    return None


def with_status(df: DataFrame, column: str, name: str = "error") -> DataFrame:
    """df with the strict reader's complaint about a column of JSON texts, null where there is none."""
    at, schema = df.columns.index(column), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{name}` string"

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([why_not(x) for x in batch.column(at).to_pylist()], pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(kernel, schema)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text. Large files are read in splits: lines are numbered within their split, and splits by the lines before them."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each split, of 128 MB by default
    number = (F.col("at") - F.col("first") + F.col("before") + 1).cast("long")
    return lines.join(F.broadcast(blocks), ["file", "block"]).select("file", number.alias("line"), F.regexp_replace("value", "\r$", "").alias("text"))


def problems(spark: SparkSession, path: str) -> DataFrame:
    return with_status(numbered_lines(spark, path), "text").where("error is not null").select("file", "line", "error")


def read_strict(spark: SparkSession, path: str, schema: str, order: str | None = "ord") -> DataFrame:
    """Records of a schema; the job fails at the first bad line, naming file and line. `order` is the line's number within its file."""
    checked = with_status(numbered_lines(spark, path).where("trim(text) <> ''"), "text")
    good = F.when(F.col("error").isNull(), F.from_json("text", schema)).otherwise(F.raise_error(F.concat_ws(":", F.col("file"), F.col("line").cast("string"), F.concat(F.lit(" "), F.col("error")))))
    rows = checked.select(good.alias("r"), F.col("line").cast("long").alias("line"))
    return rows.select("r.*", *([F.col("line").alias(order)] if order else []))


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Records of several splits, each with its split and its place (ord) in it. `check` gets all of them and raises if they are not as they should be."""
    out = None
    for split, path in paths.items():
        one = read_strict(spark, path, schema).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    if check:
        check(out)
    return out


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a reference table: key, category, value."""
    return read_strict(spark, path, "key string, category string, value string", order=None)


def write(df: DataFrame, path: str, force: bool = False) -> None:
    """One JSON object a line, nulls kept, text as it is. Refuses to overwrite unless told to."""
    df.write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", "false").json(path)
