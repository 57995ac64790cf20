"""Versions of a set of tables that are published as a whole, on stores that can't rename a folder at once.

A version is a log entry, `_log/<number>.json`, which names the folders of its tables with their numbers of rows and digests of their rows. Data are written first, into a folder of
their own; the entry comes last and is created only if that number is not taken, so of two writers one fails and may try again. Readers take the entry with the
largest number, or the one that they are pinned to, and see nothing of a writer that was stopped. What such a writer left is removed by `recover`.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from fathomline.operators.digests import multiset_digest
from fathomline.sources.manifest import hadoop

LOG = "_log"


class Conflict(RuntimeError):
    """Another writer has published the version."""


def read_text(fs, at) -> str:
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def entries(spark: SparkSession, folder: str) -> dict[int, dict]:
    """Versions that are published; an entry that is not complete is none yet."""
    fs, at = hadoop(spark, f"{folder.rstrip('/')}/{LOG}")
    out = {}
    for status in fs.listStatus(at) if fs.exists(at) else ():
        name = status.getPath().getName()
        if name.endswith(".json") and name[:-5].isdigit():
            try:
                out[int(name[:-5])] = json.loads(read_text(fs, status.getPath()))
            except ValueError:
                continue
    return out


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, expected: int | None = None) -> int:
    """Writes tables as the next version and returns its number. `expected` is the version that they were made from: publishing fails with Conflict if there is a newer one."""
    latest = max(entries(spark, folder), default=0)
    if expected is not None and latest != expected:
        raise Conflict(f"{folder} is at version {latest}, not {expected}")
    stage = f"data/{int(time.time() * 1000)}-{uuid.uuid4().hex}"
    listed = {}
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{stage}/{name}"
        df.write.parquet(path)
        written = spark.read.schema(df.schema).parquet(path)
        found = multiset_digest(written).first()
        listed[name] = {"path": f"{stage}/{name}", "schema": df.schema.json(), "rows": found["n"], "digest": found["digest"]}
    fs, at = hadoop(spark, f"{folder.rstrip('/')}/{LOG}/{latest + 1:020d}.json")
    try:
        stream = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            raise Conflict(f"version {latest + 1} of {folder} is taken") from e
        raise
    stream.write(bytearray(json.dumps({"tables": listed}).encode()))
    stream.close()
    return latest + 1


def load(spark: SparkSession, folder: str, version: int | None = None, check: bool = False) -> dict[str, DataFrame]:
    """The tables of a version, the latest unless one is named. With check, rows are held against their digests first."""
    from pyspark.sql.types import StructType

    found = entries(spark, folder)
    number = max(found, default=0) if version is None else version
    if number not in found:
        raise FileNotFoundError(f"{folder} has no version {number}")
    out = {}
    for name, listed in found[number]["tables"].items():
        out[name] = spark.read.schema(StructType.fromJson(json.loads(listed["schema"]))).parquet(f"{folder.rstrip('/')}/{listed['path']}")
        if check and (got := multiset_digest(out[name]).first()) and (got["n"], got["digest"]) != (listed["rows"], listed["digest"]):
            raise ValueError(f"{name} of version {number} is not as published")
    return out


def recover(spark: SparkSession, folder: str, older_than_s: float = 24 * 3600) -> list[str]:
    """Removes what stopped writers left: folders that no version names and that are older than a write may take. Returns their names."""
    base = folder.rstrip("/")
    fs, at = hadoop(spark, f"{base}/data")
    used = {listed["path"].split("/")[1] for entry in entries(spark, folder).values() for listed in entry["tables"].values()}
    gone = []
    for status in fs.listStatus(at) if fs.exists(at) else ():
        name = status.getPath().getName()
        if name not in used and int(name.split("-")[0]) < (time.time() - older_than_s) * 1000:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
