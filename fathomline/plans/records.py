"""Queries of conversations, tool calls and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import tables
from fathomline.operators import chat
from fathomline.plans.registry import query
from fathomline.sources.jsonl import with_status
from fathomline.sources.tables import read


@query("SELECT conv_id, 1 + count(*)::INTEGER AS messages, '[system] be exact' || chr(10) || string_agg('[' || role || '] ' || trim(text, ' '), chr(10) ORDER BY turn) AS text FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def chat_build(spark, sf_dir):
    built = chat.conversation(read(spark, sf_dir, "conversations"), "conv_id", "turn", "be exact")
    lines = F.transform("messages", lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"]))
    return built.select("conv_id", F.size("messages").alias("messages"), F.array_join(lines, "\n").alias("text"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' ELSE 'bad' END AS status FROM events")
def strict_json_status(spark, sf_dir):
    """Objects that are good, repeat a key, hold NaN, or overflow."""
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.col("props")).when(kind == 1, '{"a": {"k": 1, "k": 2}}').when(kind == 2, '{"a": NaN}').otherwise('{"a": 1e999}')
    checked = with_status(read(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return checked.select("event_id", F.when(F.col("error").isNull(), "ok").otherwise("bad").alias("status"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'schema_error' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'unterminated' ELSE 'no_call' END AS status, CASE WHEN event_id % 5 < 2 THEN 1 ELSE 0 END::INTEGER AS calls, CASE event_id % 5 WHEN 4 THEN 'answer' ELSE 'so' END AS content FROM events""")
def tool_call_parse(spark, sf_dir):
    kind = F.col("event_id") % 5
    value = F.col("value").cast("string")
    call = lambda arguments: F.concat(F.lit('so <tool_call>{"name": "unit_convert", "arguments": {"value": '), value, F.lit(arguments), F.lit("}}</tool_call>"))
    text = (
        F.when(kind == 0, call(', "from_unit": "kg", "to_unit": "lb"')).when(kind == 1, call(', "unit": "kg"'))
        .when(kind == 2, "so <tool_call>{'name': 1}</tool_call>").when(kind == 3, 'so <tool_call>{"name"').otherwise(" answer ")
    )
    rows = chat.with_parsed(read(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return rows.select("event_id", "parsed.status", F.size("parsed.calls").alias("calls"), "parsed.content")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{\"result\":' || turn || '.5}' ELSE '{\"error\":\"Error: none\"}' END AS content FROM conversations")
def tool_response(spark, sf_dir):
    even = F.col("turn") % 2 == 0
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", chat.tool_response(F.col("turn") + 0.5, F.when(~even, "Error: none")).alias("content"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:len(embedding) - 1], lambda x: x::DOUBLE)) / (len(embedding) - 1), 9)::DOUBLE AS confidence FROM embeddings")
def mean_logprob(spark, sf_dir):
    values = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(chat.confidence(values, F.lit(True))["value"], 9).alias("confidence"))


@query("""WITH o AS (SELECT o_orderkey, coalesce(floor(o_totalprice)::BIGINT::VARCHAR, 'null') AS v, coalesce(o_orderstatus, '') AS s, coalesce(o_orderpriority, '') AS p FROM orders)
SELECT o_orderkey, place::INTEGER AS place, 'unit_convert' AS name, CASE WHEN v <> 'null' THEN v END AS value, CASE place WHEN 1 THEN 'g' ELSE p END AS to_unit, CASE WHEN v = 'null' THEN 'schema_error' ELSE 'valid' END AS status
FROM (SELECT *, unnest(CASE WHEN p = '1-URGENT' THEN [1, 2] ELSE [1] END) AS place FROM o WHERE s = 'O')
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, CASE s WHEN 'P' THEN 'unterminated' ELSE 'no_call' END FROM o WHERE s <> 'O'""")
def calls_in_sql(spark, sf_dir):
    """Calls in what is said of each order (a call, two, one that is cut off, none), by a table function that is called from SQL."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    value, status, priority = F.coalesce(F.floor("o_totalprice").cast("string"), F.lit("null")), text(F.col("o_orderstatus")), text(F.col("o_orderpriority"))
    call = lambda unit: F.concat(F.lit('<tool_call>{"name": "unit_convert", "arguments": {"value": '), value, F.lit(', "from_unit": "kg", "to_unit": "'), unit, F.lit('"}}</tool_call>'))
    said = F.when(status == "P", F.concat(F.lit("so <tool_call>"), value)).when(status != "O", value).when(priority == "1-URGENT", F.concat(call(F.lit("g")), call(priority))).otherwise(call(F.lit("g")))
    tables.register_calls(spark)
    spoken = read(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return spark.sql("SELECT o_orderkey, place, name, arguments['value'] AS value, arguments['to_unit'] AS to_unit, status FROM tool_calls(TABLE({spoken}), 'said')", spoken=spoken)
