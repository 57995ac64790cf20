"""Reports and provenance: small tables that the driver writes, logs that grow, and what a run depends on."""

from __future__ import annotations

import hashlib
import json
import os
import platform
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A report is read by people: a table of more rows is refused, not cut.
MOST_ROWS = 10_000


def small(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """All rows of a small table, in its order; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return [r.asDict(recursive=True) for r in rows]


def new_file(path: str) -> Path:
    """A path to write to; what is there is never overwritten."""
    at = Path(path)
    if at.exists():
        raise FileExistsError(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    return at


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    new_file(path).write_text(json.dumps({name: small(df) for name, df in tables.items()}, indent=1, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def cell(value) -> str:
    """One cell of a Markdown table: nested values as key: value, pipes and line breaks escaped."""
    if isinstance(value, dict):
        value = ", ".join(f"{k}: {cell(v)}" for k, v in value.items())
    elif isinstance(value, list):
        value = ", ".join(cell(v) for v in value)
    elif isinstance(value, float):
        value = f"{value:g}"
    return ("" if value is None else str(value)).replace("|", "\\|").replace("\n", " ")


def markdown(rows: list[dict]) -> str:
    """Rows as a Markdown table; nested maps are written out."""
    if not rows:
        return "(none)\n"
    line = lambda cells: f"| {' | '.join(cells)} |\n"
    return line(map(str, rows[0])) + line("---" for _ in rows[0]) + "".join(line(cell(v) for v in r.values()) for r in rows)


def write_markdown(title: str, tables: dict[str, DataFrame], path: str) -> None:
    parts = [f"# {title}\n", *(f"\n## {name}\n\n{markdown(small(df))}" for name, df in tables.items())]
    new_file(path).write_text("".join(parts), encoding="utf-8")


def findings(flags: DataFrame, examples: int = 3) -> DataFrame:
    """Per check: number of flags and the first examples, for a report."""
    row = F.struct("split", "id", "detail")
    firsts = F.slice(F.sort_array(F.collect_list(row)), 1, examples)
    few = flags.withColumn("at", F.row_number().over(_by_check())).where(F.col("at") <= examples)
    counts = flags.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("flags"))
    texts = F.transform(firsts, lambda e: F.concat_ws(" ", e["id"], e["detail"]))
    return counts.join(few.groupBy("check").agg(texts.alias("examples")), "check").orderBy("check")


def _by_check():
    from pyspark.sql import Window

    return Window.partitionBy("check").orderBy("split", "id", "detail")


def snippet(column: str, length: int = 160):
    """One line of a text for a table: cut, line breaks and pipes escaped."""
    one = F.replace(F.replace(F.substring(F.coalesce(F.col(column), F.lit("")), 1, length), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(column) > length, F.concat(one, F.lit("…"))).otherwise(one)


class Log:
    """A log of JSON lines that is only ever appended to; a line is on disk before the next begins. Streams can follow it as a folder of files."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def write(self, **values) -> None:
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(values, ensure_ascii=False, allow_nan=False) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.read.schema(schema).json(str(self.path))


def follow(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the lines of all logs in a folder, each file once it is there; a log that is still written should be moved there when it is done."""
    return spark.readStream.schema(schema).json(folder)


def versions(*packages: str) -> dict[str, str | None]:
    """Installed versions, null for what isn't there, and those of Python and the system."""
    out: dict[str, str | None] = {"python": platform.python_version(), "system": platform.platform()}
    for p in packages:
        try:
            out[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            out[p] = None
    return out


def canonical(value) -> str:
    """JSON with sorted keys and no spaces: equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def protocol(config: dict, prompt: str, files: dict[str, str]) -> dict[str, str]:
    """What a run depends on, as digests: its configuration, its prompt, and every file by name; and one digest of all."""
    parts = {"config": digest(config), "prompt": hashlib.sha256(prompt.encode()).hexdigest(), **{f"file:{n}": d for n, d in sorted(files.items())}}
    return parts | {"protocol": digest(parts)}


def protocol_differences(a: dict, b: dict, path: str = "") -> list[tuple[str, object, object]]:
    """Where two nested dicts differ: path, value in a, value in b (null where it is missing)."""
    out = []
    for key in sorted(a.keys() | b.keys(), key=str):
        at, x, y = f"{path}{key}", a.get(key), b.get(key)
        if isinstance(x, dict) and isinstance(y, dict):
            out += protocol_differences(x, y, f"{at}.")
        elif x != y or (key in a) != (key in b):
            out.append((at, x, y))
    return out


def refuse_test(label: str) -> str:
    """A label, unless it names the test split: tuning must not see it."""
    if "test" in label.lower():
        raise ValueError(f"{label} names the test split")
    return label


def freeze(runs: dict[str, str], path: str) -> None:
    """Writes the digests of runs to a new file: frozen once, verified ever after."""
    new_file(path).write_text(canonical({"status": "frozen", "runs": runs}) + "\n", encoding="utf-8")


def verify_frozen(runs: dict[str, str], path: str) -> None:
    frozen = json.loads(Path(path).read_text(encoding="utf-8"))
    bad = protocol_differences(frozen["runs"], runs)
    if frozen["status"] != "frozen" or bad:
        raise ValueError(f"runs differ from the frozen ones: {bad[:5]}")


def demonstrations(path: str, sha256: str) -> list[dict]:
    """Few-shot messages of a JSON file {status, messages}: it must have the digest and be approved."""
    data = Path(path).read_bytes()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the demonstrations are not those that were listed")
    value = json.loads(data)
    if value.get("status") != "approved":
        raise ValueError(f"the demonstrations are {value.get('status')}, not approved")
    return value["messages"]
