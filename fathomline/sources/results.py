"""Results that are kept and used again: a store addressed by what they depend on.

The address of a result is a digest of the plan's name and text, its settings, and the manifest of its inputs (rows and digests of each table of a published version), so nothing of the
inputs is read to know whether the result is there. A stored result is held against its own digest before it is used; one that differs is computed again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fathomline.operators.digests import multiset_digest
from fathomline.sources import snapshots
from fathomline.sources.manifest import hadoop
from fathomline.sources.reports import digest


def address(plan: str, settings: dict, manifest: dict) -> str:
    inputs = {name: {"rows": t["rows"], "digest": t["digest"], "schema": t["schema"]} for name, t in manifest["tables"].items()}
    return digest({"plan": plan, "settings": settings, "inputs": inputs})


def stored(spark: SparkSession, store: str, key: str) -> DataFrame | None:
    """The result under a key, or null if there is none or it isn't as it was written."""
    fs, at = hadoop(spark, f"{store.rstrip('/')}/{key}.json")
    if not fs.exists(at):
        return None
    try:
        listed = json.loads(snapshots.read_text(fs, at))
        found = spark.read.schema(StructType.fromJson(json.loads(listed["schema"]))).parquet(listed["path"])
        row = multiset_digest(found).first()
    except Exception:  # a result that can't be read is none
        return None
    return found if (row["n"], row["digest"]) == (listed["rows"], listed["digest"]) else None


def reused(spark: SparkSession, store: str, plan: str, settings: dict, folder: str, compute: Callable[[dict[str, DataFrame]], DataFrame], version: int | None = None) -> tuple[DataFrame, bool]:
    """The result of compute(tables of a version), and whether it was there already."""
    entries = snapshots.entries(spark, folder)
    number = max(entries, default=0) if version is None else version
    if number not in entries:
        raise FileNotFoundError(f"{folder} has no version {number}")
    key = address(plan, settings, entries[number])
    found = stored(spark, store, key)
    if found is not None:
        return found, True
    path = f"{store.rstrip('/')}/{key}-{snapshots.uuid.uuid4().hex}"
    made = compute(snapshots.load(spark, folder, number))
    made.write.parquet(path)
    written = spark.read.schema(made.schema).parquet(path)
    row = multiset_digest(written).first()
    fs, at = hadoop(spark, f"{store.rstrip('/')}/{key}.json")
    stream = fs.create(at, True)
    stream.write(bytearray(json.dumps({"path": path, "schema": made.schema.json(), "rows": row["n"], "digest": row["digest"]}).encode()))
    stream.close()
    return written, False
