"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, NullType, StructField, StructType

#: White space as the contracts count it: space, and tab to carriage return.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; Spark's reader opens it, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all run on one machine, as in tests, a folder of our own; on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows that go to Python at a time after small_batches: with texts of some thousand bytes, Spark's 10,000 are held twice.
BATCH_ROWS, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on at most BATCH_ROWS rows go to Python at a time in this session."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fathomline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text column, null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def rows_of(batches, size: int = 256):
    """Arrow batches cut into slices of few rows, so that long texts are in Python one slice at a time: (slice, columns as lists)."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, [column.to_pylist() for column in part.columns]


def has_order(kind: DataType) -> bool:
    """Whether Spark can compare values of this type; maps, for one, it can't."""
    if isinstance(kind, ArrayType):
        return has_order(kind.elementType)
    if isinstance(kind, StructType):
        return all(has_order(f.dataType) for f in kind.fields)
    return isinstance(kind, AtomicType | NullType)


def orderable(field: StructField) -> Column:
    """A column, or where Spark can't compare its values their JSON, by which rows can be ordered."""
    column = F.col(f"`{field.name}`")
    return column if has_order(field.dataType) else F.to_json(F.struct(column))
