"""Checks, figures and calls from `spark.sql`: functions that a session registers.

`flags('Q4')` and `figures('sources')` are SQL table functions over a table of records: their body is the union of all checks, and a constant name leaves one branch of it in the
plan, without Python. `tool_calls` is a Python table function whose columns follow from the table that it is given.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from fathomline.operators import chat
from fathomline.operators import quality as Q

FLAG = "`check` STRING, severity STRING, split STRING, id STRING, detail STRING"
FIGURE = "metric STRING, key STRING, value DOUBLE"


def of_names(parts: dict[str, Callable[[DataFrame], DataFrame]], records: DataFrame, name: str) -> DataFrame:
    """The rows of all parts under their names. A filter by a constant name is pushed into each branch, where it is true or false before anything is read."""
    out = None
    for key, part in parts.items():
        one = part(records).withColumn(name, F.lit(key))
        out = one if out is None else out.unionByName(one)
    return out


#: Parts that compute while they are planned, as they write grams of notes: registered only when they are named.
EAGER = ("Q3", "duplicates")


def register_checks(records: DataFrame, names: list[str] | None = None) -> None:
    """Registers flags(name) and figures(name) over records in their session, in place of former ones, for the named checks and figures (none named: all but EAGER).

    A name that isn't registered is an error once there is a row to ask about. A function none of whose parts is named isn't registered."""
    spark = records.sparkSession
    unknown = set(names or ()) - Q.CHECKS.keys() - Q.METRICS.keys()
    if unknown:
        raise ValueError(f"no checks or figures: {', '.join(sorted(unknown))}")
    unregister_checks(spark)
    for function, parts, columns in (("flags", Q.CHECKS, FLAG), ("figures", Q.METRICS, FIGURE)):
        chosen = {k: f for k, f in parts.items() if (k in names if names else k not in EAGER)}
        if not chosen:
            continue
        view, wanted = f"fathomline_{function}", f"{function}.wanted"
        of_names(chosen, records, "part").createOrReplaceTempView(view)
        listed = ", ".join(f"'{k}'" for k in chosen)
        known = f"IF({wanted} IN ({listed}), {wanted}, raise_error(concat('{function}: not registered: ', coalesce({wanted}, 'null'))))"
        output = ", ".join(c.strip().split()[0] for c in columns.split(","))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(wanted STRING) RETURNS TABLE ({columns}) RETURN SELECT {output} FROM {view} WHERE part = {known}")


def unregister_checks(spark: SparkSession) -> None:
    for function in ("flags", "figures"):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {function}")
        spark.catalog.dropTempView(f"fathomline_{function}")


@contextlib.contextmanager
def checks_in_sql(records: DataFrame, names: list[str] | None = None) -> Iterator[SparkSession]:
    """A session in which flags and figures are registered for a while; what `sql` gave in it can be read afterwards."""
    register_checks(records, names)
    try:
        yield records.sparkSession
    finally:
        unregister_checks(records.sparkSession)


@dataclass
class CallsResult(AnalyzeResult):
    """What the analysis of tool_calls finds: the columns, and which text is read how."""

    column: str = ""
    style: str = "json"


class ToolCalls:
    """tool_calls(TABLE(turns), 'text' [, 'json' or 'xml']): a row for each call of a turn, with the columns of the table, then place (from 1), name, arguments, status, error.
    A turn without calls has one row with nulls in place, name and arguments; a turn whose calls can't be read likewise, with its status. Rows stay where they are: no shuffle."""

    MORE = [StructField("place", IntegerType()), StructField("name", StringType()), StructField("arguments", MapType(StringType(), StringType())), StructField("status", StringType()), StructField("error", StringType())]

    def __init__(self, analyzed: CallsResult):
        self.column, self.style, self.width = analyzed.column, analyzed.style, len(analyzed.schema.fields) - len(ToolCalls.MORE)

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, style: AnalyzeArgument | None = None) -> CallsResult:
        if not table.isTable:
            raise ValueError("tool_calls takes a table first: tool_calls(TABLE(turns), 'text')")
        if column.value is None or not column.isConstantExpression:
            raise ValueError("tool_calls takes the name of a text column second")
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        if kinds.get(column.value) != StringType():
            raise ValueError(f"tool_calls: {column.value} is no text column of the table")
        written = style.value if style else "json"
        if written not in ("json", "xml"):
            raise ValueError(f"tool_calls: calls are written as json or xml, not {written}")
        clash = sorted(kinds.keys() & {f.name for f in ToolCalls.MORE})
        if clash:
            raise ValueError(f"tool_calls: the table has columns of its own named {', '.join(clash)}")
        return CallsResult(schema=StructType([*table.dataType.fields, *ToolCalls.MORE]), column=column.value, style=written)

    def eval(self, row, column, style="json"):
        turn = chat.parsed(row[self.column], self.style)
        own = tuple(row)[: self.width]
        error = "; ".join(turn["errors"]) or None
        for place, call in enumerate(turn["calls"], 1):
            yield *own, place, call["name"], dict(call["arguments"]), turn["status"], error
        if not turn["calls"]:
            yield *own, None, None, None, turn["status"], error


def register_calls(spark: SparkSession) -> None:
    """Registers tool_calls."""
    spark.udtf.register("tool_calls", F.udtf(ToolCalls))
