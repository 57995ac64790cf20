"""Sources, sinks, reports and provenance."""

import json

import pytest
from pyspark.sql import functions as F

from fathomline.sources import jsonl, manifest, reports


def test_lines_are_numbered_over_splits(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    p.write_text("".join(json.dumps({"a": k, "t": "x" * (k % 50)}) + ("\r\n" if k % 3 else "\n") for k in range(3000)))
    (tmp_path / "small.jsonl").write_text('{"a": 7, "t": ""}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = jsonl.read_strict(spark, str(tmp_path), "a long, t string")
        assert got.rdd.getNumPartitions() > 4
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["a"], r["ord"]) for r in rows) == sorted([(k, k + 1) for k in range(3000)] + [(7, 1)])


def test_splits_and_reference(spark, tmp_path):
    for name, n in (("train", 3), ("val", 2)):
        (tmp_path / name).write_text("".join(json.dumps({"id": f"{name}_{k}"}) + "\n" for k in range(n)))
    got = jsonl.read_splits(spark, {n: str(tmp_path / n) for n in ("train", "val")}, "id string")
    assert sorted((r["split"], r["id"], r["ord"]) for r in got.collect()) == [("train", f"train_{k}", k + 1) for k in range(3)] + [("val", f"val_{k}", k + 1) for k in range(2)]
    with pytest.raises(ValueError, match="bad"):
        jsonl.read_splits(spark, {"train": str(tmp_path / "train")}, "id string", check=lambda df: (_ for _ in ()).throw(ValueError("bad")))
    (tmp_path / "ref").write_text('{"key": "a:b", "category": "c", "value": "d"}\n')
    assert [tuple(r) for r in jsonl.read_reference(spark, str(tmp_path / "ref")).collect()] == [("a:b", "c", "d")]


def test_publish_leaves_all_or_nothing(spark, tmp_path):
    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        manifest.publish(spark, {"a": good, "b": bad}, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    manifest.publish(spark, {"a": good, "b": good}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "b")).count() == 3
    with pytest.raises(FileExistsError):
        manifest.publish(spark, {"a": good}, str(tmp_path / "out"))


def test_copy_subset_additions_and_checkpoints(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("x")
    assert manifest.copy_file(spark, str(a), str(b)) and not manifest.copy_file(spark, str(a), str(b))
    a.write_text("y")
    with pytest.raises(FileExistsError):
        manifest.copy_file(spark, str(a), str(b))
    assert manifest.copy_file(spark, str(a), str(b), force=True) and b.read_text() == "y"
    records = spark.createDataFrame([("p", None), ("q", 2), ("r", 3)], "id string, v long")
    ids = spark.createDataFrame([("q", 0), ("p", 1)], "id string, pos int")
    assert [tuple(r) for r in manifest.subset(records, ids, "id").orderBy("pos").collect()] == [(0, "q", 2), (1, "p", None)]
    with pytest.raises(Exception, match="unknown id z"):
        manifest.subset(records, spark.createDataFrame([("z", 0)], "id string, pos int"), "id").collect()
    with pytest.raises(ValueError, match="draft"):
        manifest.subset(records, ids, "id", "draft")
    more = tmp_path / "more.jsonl"
    more.write_text('{"id": "extra_1"}\n')
    sha = manifest.digests(spark, str(more)).first()["sha256"]
    assert manifest.additions(spark, str(more), "id string", sha, "extra_").count() == 1
    with pytest.raises(Exception, match="without the prefix"):
        manifest.additions(spark, str(more), "id string", sha, "other_").collect()
    with pytest.raises(ValueError, match="not the listed file"):
        manifest.additions(spark, str(more), "id string", "0", "extra_")
    for name in ("checkpoint-20", "checkpoint-5", "checkpoint-x", "other"):
        (tmp_path / "runs" / name).mkdir(parents=True)
    assert [r["step"] for r in manifest.checkpoints(spark, str(tmp_path / "runs")).collect()] == [5, 20]


def test_zip_round_trip(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "f").write_text("x")
    listed = manifest.export_zip(str(tmp_path / "in"), str(tmp_path / "o.zip"))
    assert manifest.import_zip(str(tmp_path / "o.zip"), str(tmp_path / "back")) == listed and (tmp_path / "back" / "sub" / "f").read_text() == "x"
    import zipfile

    with zipfile.ZipFile(tmp_path / "o.zip", "a") as z:
        z.writestr("more", "y")
    with pytest.raises(ValueError, match="not as listed"):
        manifest.import_zip(str(tmp_path / "o.zip"), str(tmp_path / "again"))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, {"k": 2}), (None, None, None)], "s string, x double, m map<string,int>").coalesce(1)
    reports.write_json({"t": df}, str(tmp_path / "r" / "a.json"))
    assert json.loads((tmp_path / "r" / "a.json").read_text())["t"][0] == {"s": "a|b", "x": 1.5, "m": {"k": 2}}
    reports.write_markdown("T", {"t": df}, str(tmp_path / "a.md"))
    assert "| a\\|b | 1.5 | k: 2 |" in (tmp_path / "a.md").read_text()
    with pytest.raises(FileExistsError):
        reports.write_json({"t": df}, str(tmp_path / "a.md"))
    with pytest.raises(ValueError):
        reports.small(spark.range(20), most=10)
    flags = spark.createDataFrame([("Q1", "warn", "train", f"t{k}", "x") for k in range(5)], "check string, severity string, split string, id string, detail string")
    assert [tuple(r) for r in reports.findings(flags, 2).collect()] == [("Q1", "warn", 5, ["t0 x", "t1 x"])]
    assert spark.createDataFrame([("a\n|" + "b" * 9,)], "s string").select(reports.snippet("s", 6)).first()[0] == "a \\|bbb…"


def test_log_and_provenance(spark, tmp_path):
    log = reports.Log(str(tmp_path / "l" / "log.jsonl"))
    log.write(step=1, loss=0.5)
    log.write(step=2, loss=0.25)
    assert [tuple(r) for r in log.read(spark, "step long, loss double").collect()] == [(1, 0.5), (2, 0.25)]
    with pytest.raises(ValueError):
        log.write(loss=float("nan"))
    stream = reports.follow(spark, str(tmp_path / "l"), "step long, loss double").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "s"))
    stream.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert reports.digest({"b": 1, "a": [2]}) == reports.digest({"a": [2], "b": 1}) and reports.versions("pyspark", "no-such")["no-such"] is None
    a, b = reports.protocol({"x": {"y": 1}}, "p", {"f": "1"}), reports.protocol({"x": {"y": 1}}, "p", {"f": "2"})
    assert [d[0] for d in reports.protocol_differences(a, b)] == ["file:f", "protocol"]
    assert reports.protocol_differences({"x": {"y": 1, "z": None}}, {"x": {"y": 2}}) == [("x.y", 1, 2), ("x.z", None, None)]
    with pytest.raises(ValueError):
        reports.refuse_test("core_Test")
    reports.freeze({"r": "1"}, str(tmp_path / "f.json"))
    reports.verify_frozen({"r": "1"}, str(tmp_path / "f.json"))
    with pytest.raises(ValueError):
        reports.verify_frozen({"r": "2"}, str(tmp_path / "f.json"))
    import hashlib

    d = tmp_path / "d.json"
    d.write_text(json.dumps({"status": "approved", "messages": [1]}))
    assert reports.demonstrations(str(d), hashlib.sha256(d.read_bytes()).hexdigest()) == [1]
    with pytest.raises(ValueError):
        reports.demonstrations(str(d), "0")
