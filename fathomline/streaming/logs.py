"""A training log followed as a stream: figures that are kept up to date, and gaps of steps.

Each batch of the stream leaves its own sums and runs of steps in a folder that carries the batch's number and is overwritten if the batch comes again: a batch that is written twice, after a
failure say, counts once. Figures are sums over batches, so they equal those of one query over the whole log. A step that is in the log twice counts twice in sums and once in runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Steps of a run of successive ones at most, so that runs are found in parts.
STRETCH = 4096


def runs_of(rows: DataFrame, step: str = "step") -> DataFrame:
    """Runs of successive steps: first, last."""
    steps = rows.where(F.col(step).isNotNull()).select(F.col(step).cast("long").alias("step")).distinct().withColumn("part", F.floor(F.col("step") / STRETCH))
    island = F.col("step") - F.row_number().over(Window.partitionBy("part").orderBy("step"))
    return steps.withColumn("island", island).groupBy("part", "island").agg(F.min("step").alias("first"), F.max("step").alias("last")).select("first", "last")


def sums_of(rows: DataFrame, epoch: Column, value: str = "value") -> DataFrame:
    return rows.groupBy(epoch.alias("epoch")).agg(F.sum(value).alias("total"), F.count(value).alias("values"), F.count(F.lit(1)).alias("n"))


def keep_figures(stream: DataFrame, folder: str, epoch: Column, step: str = "step", value: str = "value", **trigger) -> StreamingQuery:
    """Starts the query that leaves each batch's sums and runs under the folder. trigger: as of DataStreamWriter.trigger, by default all that is there and then an end."""

    def write(batch: DataFrame, number: int) -> None:
        sums_of(batch, epoch, value).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")
        runs_of(batch, step).write.mode("overwrite").parquet(f"{folder}/runs/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger or {"availableNow": True}).start()


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """epoch, mean, n over all batches so far."""
    sums = spark.read.parquet(f"{folder}/sums")
    return sums.groupBy("epoch").agg(F.try_divide(F.sum("total"), F.sum("values").cast("double")).alias("mean"), F.sum("n").alias("n"))


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Steps that are missing between those seen so far: first and last of each gap. Runs are sorted by stretches, with the last step before each carried over."""
    runs = spark.read.parquet(f"{folder}/runs").select("first", "last", F.floor(F.col("first") / (STRETCH * 64)).alias("part"))
    parts = runs.groupBy("part").agg(F.max("last").alias("high"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for a quarter of a million steps
    carried = parts.select("part", F.max("high").over(before).alias("carried"))
    within = Window.partitionBy("part").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    seen = runs.join(carried, "part").withColumn("seen", F.greatest(F.max("last").over(within), F.col("carried")))
    return seen.where(F.col("first") > F.col("seen") + 1).select((F.col("seen") + 1).alias("first"), (F.col("first") - 1).alias("last"))
