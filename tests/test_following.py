"""Logs followed as streams, and results used again."""

import json

import pytest
from pyspark.sql import functions as F

from fathomline.operators.statistics import interpolated, quantiles
from fathomline.sources import results, snapshots
from fathomline.streaming import logs


def test_a_failing_batch_counts_once(spark, tmp_path, monkeypatch):
    source, folder = tmp_path / "log", str(tmp_path / "figures")
    source.mkdir()
    steps = [[1, 2, 3, 7], [4, 5, 8], [9000, 9001, 20]]
    for k, some in enumerate(steps):
        (source / f"{k}.json").write_text("".join(json.dumps({"step": s, "value": s / 2}) + "\n" for s in some))
    stream = lambda: spark.readStream.schema("step long, value double").option("maxFilesPerTrigger", 1).json(str(source))
    epoch = F.when(F.col("step") < 5, 1).otherwise(2)
    plain, fail = logs.runs_of, {"at": 2}

    def stops_once(rows, step="step"):
        fail["at"] -= 1
        if fail["at"] == 0:
            raise RuntimeError("stopped between two writes")
        return plain(rows, step)

    monkeypatch.setattr(logs, "runs_of", stops_once)
    with pytest.raises(Exception, match="stopped"):
        logs.keep_figures(stream(), folder, epoch).awaitTermination()
    logs.keep_figures(stream(), folder, epoch).awaitTermination()
    (source / "3.json").write_text('{"step": 6, "value": null}\n')
    logs.keep_figures(stream(), folder, epoch).awaitTermination()
    got = {r["epoch"]: (r["mean"], r["n"]) for r in logs.figures(spark, folder).collect()}
    late = [s for some in steps for s in some if s >= 5]
    assert got == {1: (1.25, 4), 2: (pytest.approx(sum(late) / 2 / len(late)), len(late) + 1)}
    assert sorted((r["first"], r["last"]) for r in logs.gaps(spark, folder).collect()) == [(9, 19), (21, 8999)]


def test_results_are_used_again(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows, calls = spark.range(20).withColumn("x", F.col("id") % 3), []

    def compute(tables):
        calls.append(1)
        return tables["t"].groupBy("x").count()

    run = lambda settings=None, version=None: results.reused(spark, store, "counts", settings or {}, folder, compute, version)
    snapshots.publish(spark, {"t": rows}, folder)
    first, was_there = run()
    # The inputs may even be gone: nothing of them is read again.
    for part in (tmp_path / "in" / "data").rglob("*.parquet"):
        if part.is_file():
            part.rename(part.with_suffix(".gone"))
    again, there = run()
    assert (was_there, there, len(calls)) == (False, True, 1) and sorted(again.collect()) == sorted(first.collect())
    snapshots.publish(spark, {"t": rows.withColumn("x", F.when(F.col("id") == 7, 9).otherwise(F.col("x")))}, folder)
    changed, there = run()
    assert not there and len(calls) == 2 and changed.count() == 4 and run()[1] and run(version=1)[1]
    run({"k": 1})
    assert len(calls) == 3
    broken = next(p for p in (tmp_path / "store").rglob("part-*.parquet"))
    key = broken.parent.name.split("-")[0]
    broken.unlink()
    assert results.stored(spark, store, key) is None


def test_quantiles_of_a_million_values(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    import numpy as np

    values = np.array([i * 7919 % 1_000_003 for i in range(1_000_000)], float)
    (row,) = interpolated(df, "v", {"a": 0.1, "b": 0.5, "c": 0.999}).collect()
    assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.999])), abs=1e-6)
    by = {r["g"]: (r["lo"], r["hi"]) for r in quantiles(df, "v", {"lo": 0.0, "hi": 1.0}, ["g"]).collect()}
    assert by == {g: (values[g::2].min(), values[g::2].max()) for g in (0, 1)}
    assert interpolated(df.where("false"), "v", {"a": 0.5}).collect()[0]["a"] is None
