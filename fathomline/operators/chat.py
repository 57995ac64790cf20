"""Conversations, tool calls in model output, and bounded rollouts with a pluggable generator."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.statistics import quantiles
from fathomline.sources.jsonl import refuse, unique

# The tools that a model may call, their parameters' types, and which are required.
NUMBER, INTEGER, STRING, NULLABLE = ("number",), ("integer",), ("string",), ("string", "null")
SCHEMAS = {
    "unit_convert": ({"value": NUMBER, "from_unit": STRING, "to_unit": STRING, "substance": NULLABLE}, ("value", "from_unit", "to_unit")),
    "calculate_bmi": ({"weight_kg": NUMBER, "height_cm": NUMBER}, ("weight_kg", "height_cm")),
    "calculate_egfr": ({"creatinine_mg_dl": NUMBER, "age": INTEGER, "sex": STRING}, ("creatinine_mg_dl", "age", "sex")),
}
ENUMS = {("calculate_egfr", "sex"): ("male", "female")}
# Marks of calls in model output.
BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
FUNCTION = re.compile(r"\s*<function=([^>\n]+)>\n(.*?)</function>\s*", re.S)
PARAMETER = re.compile(r"<parameter=([^>\n]+)>\n(.*?)\n</parameter>\n?", re.S)


def fits(value, kinds: tuple[str, ...]) -> bool:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    tests = {"number": number, "integer": number and isinstance(value, int), "string": isinstance(value, str), "null": value is None}
    return any(tests[k] for k in kinds)


def call_errors(name, arguments, tools: tuple[str, ...] | None = None) -> list[str]:
    """What is wrong with a call; empty for a valid one. tools: those that a run offers (default: all)."""
    if not isinstance(name, str) or name not in SCHEMAS or tools is not None and name not in tools:
        return [f"unknown tool {name!r}"]
    if not isinstance(arguments, dict):
        return ["arguments must be an object"]
    properties, required = SCHEMAS[name]
    out = [f"missing required argument {k!r}" for k in required if k not in arguments]
    out += [f"unexpected argument {k!r}" for k in sorted(arguments.keys() - properties.keys())]
    for key in properties.keys() & arguments.keys():
        value = arguments[key]
        if not fits(value, properties[key]):
            out.append(f"{key}: expected {' or '.join(properties[key])}")
        elif (name, key) in ENUMS and value not in ENUMS[name, key]:
            out.append(f"{key}: expected one of {', '.join(ENUMS[name, key])}")
        elif isinstance(value, float) and not math.isfinite(value):
            out.append(f"{key}: must be finite")
    return sorted(out)


def xml_call(body: str) -> tuple[str, dict] | None:
    """<function=NAME> with <parameter=KEY> blocks and nothing else; values are typed by the tool's schema."""
    whole = FUNCTION.fullmatch(body)
    if not whole or PARAMETER.sub("", whole[2]).strip():
        return None
    name, parts = whole[1].strip(), [(m[1].strip(), m[2]) for m in PARAMETER.finditer(whole[2])]
    kinds = SCHEMAS.get(name, ({}, ()))[0]
    if len({key for key, _ in parts}) < len(parts):
        return None
    return name, {key: typed(value, kinds.get(key, STRING)) for key, value in parts}


def typed(raw: str, kinds: tuple[str, ...]):
    text = raw.strip()
    if "null" in kinds and text in ("None", "null"):
        return None
    if {"number", "integer"} & set(kinds) and re.fullmatch(r"-?\d+", text):
        return int(text)
    if "number" in kinds:
        try:
            return float(text)
        except ValueError:
            return raw
    return raw


def parsed(text: str | None, style: str = "json", tools: tuple[str, ...] | None = None) -> dict:
    """One assistant turn: status (no_call, valid, invalid_json, unterminated, schema_error), content, calls, errors."""
    text = text or ""
    bodies, content = BLOCK.findall(text), BLOCK.sub("", text).strip()
    result = lambda status, calls=(), errors=(): {"status": status, "content": content, "calls": list(calls), "errors": list(errors)}
    if "<tool_call>" in content:
        content = content if bodies else content.split("<tool_call>")[0].strip()
        return result("unterminated", errors=["<tool_call> without closing tag"])
    if not bodies:
        return result("no_call")
    calls, errors = [], []
    for body in bodies:
        if style == "xml":
            call = xml_call(body)
            if call is None:
                return result("invalid_json", errors=["malformed <function=...> call"])
            name, arguments = call
        else:
            try:
                value = json.loads(body.strip(), object_pairs_hook=unique, parse_constant=refuse)
            except (ValueError, RecursionError) as e:
                return result("invalid_json", errors=[str(e)])
            if not isinstance(value, dict) or value.keys() != {"name", "arguments"}:
                return result("invalid_json", errors=["a call must be an object of name and arguments"])
            name, arguments = value["name"], value["arguments"]
        errors += call_errors(name, arguments, tools)
        arguments = arguments if isinstance(arguments, dict) else {}
        calls.append({"name": name if isinstance(name, str) else json.dumps(name), "arguments": [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in arguments.items() if v is not None]})
    return result("schema_error" if errors else "valid", calls, errors)


PARSED = "struct<status:string,content:string,calls:array<struct<name:string,arguments:map<string,string>>>,errors:array<string>>"


def with_parsed(df: DataFrame, column: str, style: str = "json", name: str = "parsed", tools: tuple[str, ...] | None = None) -> DataFrame:
    """df with the parsed turn of a text column. Arguments are texts by name: model output may hold any."""
    at = df.columns.index(column)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{name}` {PARSED}"

    def kernel(batches):
        import pyarrow as pa

        call = pa.struct([("name", pa.string()), ("arguments", pa.map_(pa.string(), pa.string()))])
        kind = pa.struct([("status", pa.string()), ("content", pa.string()), ("calls", pa.list_(call)), ("errors", pa.list_(pa.string()))])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([parsed(t, style, tools) for t in batch.column(at).to_pylist()], kind)], names=[*batch.schema.names, name])

    return df.mapInArrow(kernel, schema)


def first_bad_status(turns: Column) -> Column:
    """Status of the first turn that is neither an answer nor a valid call."""
    return F.try_element_at(F.filter(F.transform(turns, lambda t: t["status"]), lambda s: ~s.isin("no_call", "valid")), F.lit(1))


def tool_response(result: Column, error: Column) -> Column:
    """Content of a tool's turn: an object of result or of error."""
    return F.when(error.isNull(), F.to_json(F.struct(result.alias("result")))).otherwise(F.to_json(F.struct(error.alias("error"))))


def conversation(turns: DataFrame, by: str, order: str, system: str) -> DataFrame:
    """One row per conversation: messages in order, the system prompt first; roles other than user and assistant fail."""
    role = F.when(F.col("role").isin("system", "user", "assistant", "tool"), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce("role", F.lit("null")))))
    said = turns.where("role <> 'system'").groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), role.alias("role"), F.trim("text").alias("content")))).alias("m"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return said.select(by, F.concat(first, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("messages"))


def few_shot(examples: DataFrame, per_type: int = 1) -> DataFrame:
    """Examples for a prompt: of each answer type those of median length of note and question (ties: least id), as user and assistant messages."""
    length = F.length("note") + F.length("question")
    rows = examples.select("answer_type", "id", "note", "question", "answer", length.alias("length"))
    middle = quantiles(rows, "length", {"middle": 0.5}, ["answer_type"])
    # A filter on the place lets each task keep its first rows of a type only.
    near = Window.partitionBy("answer_type").orderBy(F.abs(F.col("length") - F.col("middle")), "id")
    chosen = rows.join(middle, "answer_type").withColumn("at", F.row_number().over(near)).where(F.col("at") <= per_type)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return chosen.select("answer_type", "id", F.array(message("user", F.concat("note", F.lit("\n\n"), "question")), message("assistant", F.col("answer"))).alias("messages"))


def rollout(prompts: DataFrame, generate: Callable[[list[str]], list[str]], execute: Callable[[str, dict], str], budget: int = 2) -> DataFrame:
    """prompts: id, prompt. The model answers, calls run and are appended, until it answers without a call, a turn can't be read, or the
    budget of calls is used. `generate` gets the prompts of a batch. Returns id, turns, answer, stop_reason (answer, parse_error, budget)."""
    schema = f"id {dict(prompts.dtypes)['id']}, turns array<string>, answer string, stop_reason string"

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column("id"), batch.column("prompt").to_pylist()
            turns: list[list[str]] = [[] for _ in texts]
            ends: list[tuple] = [(None, "budget")] * len(texts)
            live = list(range(len(texts)))
            for _ in range(budget + 1):
                later = []
                for k, out in zip(live, generate([texts[k] for k in live]), strict=True):
                    turns[k].append(out)
                    p = parsed(out)
                    if p["status"] == "no_call":
                        ends[k] = (p["content"], "answer")
                    elif p["status"] != "valid":
                        ends[k] = (None, "parse_error")
                    else:
                        texts[k] += out + "".join(execute(c["name"], dict(c["arguments"])) for c in p["calls"])
                        later.append(k)
                live = later
                if not live:
                    break
            yield pa.RecordBatch.from_arrays([ids, pa.array(turns, pa.list_(pa.string())), pa.array([a for a, _ in ends], pa.string()), pa.array([s for _, s in ends])], names=["id", "turns", "answer", "stop_reason"])

    return prompts.select("id", "prompt").mapInArrow(kernel, schema)


def confidence(logprobs: Column, finished: Column) -> Column:
    """Mean log-probability without the end token, or why there is none."""
    n = F.size(logprobs)
    value = F.when(finished & (n > 1), F.aggregate(F.slice(logprobs, 1, n - 1), F.lit(0.0), lambda s, x: s + x) / (n - 1))
    reason = F.when(logprobs.isNull(), "not recorded").when(~finished, "not finished").when(n <= 1, "empty")
    return F.struct(value.alias("value"), reason.alias("reason"))
