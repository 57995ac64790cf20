"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; timestamps without a zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoned = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly to tasks: a table in few row groups is read by as few tasks, which would then do all that is worked out of its rows. For narrow rows, before texts are made of them.
    The number is given, as else small rows are put together again. Rows then go through a generator: a condition on texts made of them would else be moved before the exchange, and be worked
    out by the few tasks that read."""
    spark = df.sparkSession
    dealt = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return dealt.select(F.inline(F.array(F.struct(*df.columns))))
