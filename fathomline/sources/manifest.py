"""Manifests by digest, checked subsets, and writes that leave all or nothing."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file (name), bytes, sha256 of the files in a folder or behind a pattern. A file is read as one value, so it may have 2 GB at most."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differences(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Files whose digest isn't the listed one: file and state (changed, missing, not listed)."""
    joined = found.select("file", F.col("sha256").alias("a")).join(listed.select("file", F.col("sha256").alias("b")), "file", "full")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "not listed").when(F.col("a") != F.col("b"), "changed")
    return joined.select("file", state.alias("state")).where("state is not null")


def verify(found: DataFrame, listed: DataFrame) -> None:
    bad = differences(found, listed).orderBy("file").limit(5).collect()
    if bad:
        raise ValueError(f"files differ from the manifest: {[tuple(r) for r in bad]}")


def prepare(inputs: dict[str, DataFrame], problems: Callable[[str, DataFrame], DataFrame], write: Callable[[str, DataFrame], None]) -> None:
    """Writes all inputs, but only if none of them has a problem."""
    for name, df in inputs.items():
        bad = problems(name, df).limit(1).collect()
        if bad:
            raise ValueError(f"{name}: {bad[0].asDict()}")
    for name, df in inputs.items():
        write(name, df)


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it: any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """Writes tables as Parquet to folder/name: into a folder beside it first, which is renamed once all are there. A failing write leaves nothing;
    an existing folder is refused."""
    fs, target = hadoop(spark, folder)
    if fs.exists(target):
        raise FileExistsError(folder)
    staged = f"{folder.rstrip('/')}.staged-{uuid.uuid4().hex}"
    _, staging = hadoop(spark, staged)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staged}/{name}")
        if not fs.rename(staging, target):
            raise FileExistsError(folder)
    finally:
        fs.delete(staging, True)


def copy_file(spark: SparkSession, source: str, target: str, force: bool = False) -> bool:
    """Copies a file byte by byte. Nothing is done (False) if the same bytes are there; other bytes are refused unless forced."""
    fs, at = hadoop(spark, target)
    if fs.exists(at):
        a, b = (digests(spark, p).select("sha256").first()[0] for p in (source, target))
        if a == b:
            return False
        if not force:
            raise FileExistsError(f"{target} holds other bytes")
    from_fs, from_at = hadoop(spark, source)
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, from_at, fs, at, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def subset(records: DataFrame, ids: DataFrame, key: str, status: str | None = "frozen") -> DataFrame:
    """Records by a list of ids (key, pos), in its order as pos; an unknown id fails. The list must be frozen."""
    if status != "frozen":
        raise ValueError(f"subset is {status}, not frozen")
    marked = records.withColumn("known_", F.lit(True))
    joined = ids.join(marked, key, "left")
    known = F.when(F.col("known_").isNull(), F.raise_error(F.concat(F.lit("unknown id "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.where(known.isNull()).select("pos", *records.columns)


def additions(spark: SparkSession, path: str, schema: str, listed_sha256: str, prefix: str, id_col: str = "id") -> DataFrame:
    """Records to be added to a view: the file must have the listed digest, and every id the prefix."""
    found = digests(spark, path).agg(F.count(F.lit(1)).alias("files"), F.first("sha256").alias("sha256")).first()
    if (found["files"], found["sha256"]) != (1, listed_sha256):
        raise ValueError(f"{path} is not the listed file")
    rows = spark.read.schema(schema).json(path)
    return rows.where(F.assert_true(F.startswith(F.col(id_col), F.lit(prefix)), F.concat(F.lit("id without the prefix: "), F.col(id_col))).isNull())


def checkpoints(spark: SparkSession, folder: str, pattern: str = r"checkpoint-(\d+)$") -> DataFrame:
    """Sub-folders named by a step: step, path, in order of steps."""
    fs, at = hadoop(spark, folder)
    names = [str(s.getPath()) for s in fs.listStatus(at) if s.isDirectory()]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    return rows.withColumn("step", F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("long")).where("step is not null").select("step", "path").orderBy("step")


def export_zip(folder: str, target: str) -> dict[str, str]:
    """All files of a folder of this machine in a ZIP, with their digests in manifest.json inside. Returns the digests by name."""
    import hashlib

    root = Path(folder)
    files = {str(p.relative_to(root)): p for p in sorted(root.rglob("*")) if p.is_file()}
    listed = {name: hashlib.sha256(p.read_bytes()).hexdigest() for name, p in files.items()}
    with zipfile.ZipFile(target, "x", zipfile.ZIP_DEFLATED) as z:
        for name, p in files.items():
            z.write(p, name)
        z.writestr("manifest.json", json.dumps(listed, indent=1))
    return listed


def import_zip(source: str, folder: str) -> dict[str, str]:
    """Unpacks such a ZIP into a new folder, once all its files have the listed digests."""
    import hashlib

    with zipfile.ZipFile(source) as z:
        listed = json.loads(z.read("manifest.json"))
        names = set(z.namelist()) - {"manifest.json"}
        bad = [n for n in names ^ listed.keys()] + [n for n in names & listed.keys() if hashlib.sha256(z.read(n)).hexdigest() != listed[n]]
        if bad or any(Path(n).is_absolute() or ".." in Path(n).parts for n in names):
            raise ValueError(f"not as listed: {sorted(bad)[:5]}")
        Path(folder).mkdir(parents=True)
        for n in names:
            z.extract(n, folder)
    return listed
