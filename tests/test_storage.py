"""The strict data source, digests of files and of tables, and versions."""

import hashlib
import json
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from fathomline.operators import digests as D
from fathomline.sources import files, snapshots, strict


@pytest.fixture(scope="module")
def source(spark):
    strict.register(spark)
    return lambda schema, path, split=1 << 20: spark.read.format("strict_jsonl").schema(schema).option("splitBytes", str(split)).load(str(path))


def test_ranges_hold_each_line_once(source, tmp_path):
    r = random.Random(1)
    rows = [{"k": k, "t": "é\n" * r.randint(0, 30), "more": {"x": [1.5, None]}} for k in range(300)]
    text = "".join(json.dumps(row, ensure_ascii=False) + r.choice(["\n", "\r\n", "\n\n", "\n  \n"]) for row in rows)
    (tmp_path / "a.jsonl").write_text(text.rstrip(), newline="")
    (tmp_path / "b.jsonl").write_text('{"k": 999, "t": null}\n')
    (tmp_path / "_hidden").write_text("not json")
    for split in (7, 64, 1000, 1 << 20):
        got = source("k long, t string, more struct<x: array<double>>, _offset long, _file string", tmp_path, split).collect()
        assert len(got) == 301
        mine = sorted((g for g in got if g["k"] != 999), key=lambda g: g["_offset"])
        assert [(g["k"], g["t"]) for g in mine] == [(row["k"], row["t"]) for row in rows] and mine[0]["more"]["x"] == [1.5, None] and mine[0]["_file"].endswith("a.jsonl")
    assert source("k long", tmp_path / "a.jsonl", 50).agg(F.sum("k")).first()[0] == sum(range(300))


@pytest.mark.parametrize("bad", ['{"k": 1, "k": 2}', '{"k": NaN}', '{"k": 1e999}', "[1]", '{"k": "x"}', "{", '{"k": 9223372036854775808}'])
@pytest.mark.parametrize("split", [9, 1 << 20])
def test_bad_lines_are_named_by_file_and_line(source, tmp_path, bad, split):
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n' * 40 + "\n" + bad + '\n{"k": 2}\n')
    with pytest.raises(PythonException, match=r"x\.jsonl:42: "):
        source("k long", tmp_path / "x.jsonl", split).collect()


def test_nothing_and_no_file(source, tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    assert source("k long", tmp_path / "empty.jsonl").collect() == []
    with pytest.raises(Exception, match="absent"):
        source("k long", tmp_path / "absent").collect()


def test_file_digests(spark, tmp_path):
    for name, data in (("a", b"x" * 1000), ("b", b""), ("c", bytes(range(256)) * 20)):
        (tmp_path / name).write_bytes(data)
    got = {r["file"].rpartition("/")[2]: (r["bytes"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n: (len(d := (tmp_path / n).read_bytes()), hashlib.sha256(d).hexdigest()) for n in "abc"}
    before = spark.createDataFrame(files.range_digests(spark, str(tmp_path), 512).collect())
    tree = {r["file"].rpartition("/")[2]: r for r in files.tree_digests(before).collect()}
    parts = [hashlib.sha256(b"x" * n).hexdigest() for n in (512, 488)]
    assert tree["a"]["ranges"] == 2 and tree["a"]["tree"] == hashlib.sha256("".join(parts).encode()).hexdigest() and tree["c"]["bytes"] == 5120
    (tmp_path / "c").write_bytes((tmp_path / "c").read_bytes()[:1024] + b"!" + (tmp_path / "c").read_bytes()[1025:] + b"tail")
    changed = files.changed_ranges(files.range_digests(spark, str(tmp_path), 512), before).collect()
    assert sorted((r["file"].rpartition("/")[2], r["range"], r["start"], r["state"]) for r in changed) == [("c", 2, 1024, "changed"), ("c", 10, 5120, "added")]


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """More than one value can hold; read in pieces, so the reader's memory does not grow with it."""
    path = tmp_path / "large"
    with path.open("wb") as f:
        f.truncate(3 << 30)
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 << 10):
        digest.update(zeros)
    (row,) = files.file_digests(spark, str(path)).collect()
    assert (row["bytes"], row["sha256"]) == (3 << 30, digest.hexdigest())


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "tables")
    rows = lambda n: spark.range(n).select("id", F.array(F.col("id").cast("string")).alias("a"))
    assert snapshots.entries(spark, folder) == {}
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, folder)
    assert snapshots.publish(spark, {"x": rows(3), "y": rows(0)}, folder) == 1
    broken = {"x": rows(5), "y": rows(2).select(F.raise_error(F.lit("stopped")).alias("id"))}
    with pytest.raises(Exception, match="stopped"):
        snapshots.publish(spark, broken, folder)
    # As a killed writer leaves it: data without an entry, and an entry that is not whole.
    rows(7).write.parquet(f"{folder}/data/1-dead/x")
    (tmp_path / "tables/_log/00000000000000000002.json").write_text('{"tables": {"x": ')
    now = snapshots.load(spark, folder, check=True)
    assert (now["x"].count(), now["y"].count()) == (3, 0) and snapshots.recover(spark, folder, older_than_s=3600) == ["1-dead"]
    (tmp_path / "tables/_log/00000000000000000002.json").unlink()
    assert snapshots.publish(spark, {"x": rows(4)}, folder, expected=1) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, {"x": rows(9)}, folder, expected=1)
    assert snapshots.load(spark, folder)["x"].count() == 4 and snapshots.load(spark, folder, 1)["x"].count() == 3
    assert len(snapshots.recover(spark, folder, older_than_s=-1)) == 1 and snapshots.load(spark, folder, 1, check=True)["x"].count() == 3
    part = next((tmp_path / "tables" / "data").glob("*/x/part-*.parquet"))
    part.unlink()
    with pytest.raises(ValueError, match="not as published"):
        snapshots.load(spark, folder, 1, check=True)
        snapshots.load(spark, folder, 2, check=True)


def test_multiset_digests(spark):
    data = [(k % 5, None if k % 3 else "x|", [k], k / 7) for k in range(100)]
    df = spark.createDataFrame(data, "a long, b string, c array<long>, d double")
    one = D.multiset_digest(df).first()
    assert D.multiset_digest(df.repartition(9, "d")).first() == one and D.same_rows(df, df.orderBy(F.desc("d")))
    assert not D.same_rows(df, df.unionAll(df.limit(1))) and not D.same_rows(df, df.where("d > 0")) and D.multiset_digest(df, key="k").first() != one
    more = spark.createDataFrame([(1, "1:x", [2], 0.5), (1, "1:x", [2], 0.5)], df.schema)
    union = D.multiset_digest(df.unionAll(more)).first()["digest"]
    assert D.combined(one["digest"], D.multiset_digest(more).first()["digest"]) == union and D.combined(union, D.multiset_digest(more).first()["digest"], -1) == one["digest"]
    ab = lambda rows: D.multiset_digest(spark.createDataFrame(rows, "a string, b string")).first()["digest"]
    assert len({ab([("x", "")]), ab([("", "x")]), ab([("x", None)]), ab([("x", "~")]), ab([("1:x|", "")])}) == 5
    assert D.multiset_digest(df.where("false")).first()["digest"] == "0" * 60
