r"""Chat formatting in budgeted windows, in DataFrame operations only.

A conversation becomes one or more windows of at most `budget` tokens. Prefix sums of turn tokens choose the spans:
each span is a run of whole turns whose prefix sums fall in one bin of half the room, so that a span and its last
turn always fit; a turn larger than half the room has a window of its own. A system turn that opens the conversation is
retained in every window. A window after the first repeats the turns at the end of the one before that fit in `history`
tokens and in what its system turn and new turns leave of the budget. So a window exceeds the budget only where its one new
turn does together with the system turn: turns are never cut. The room is the budget less the system turn and `history`
(or a quarter of what the system turn leaves, if that is less). Repeats are context: only assistant turns that are new to
a window are under the loss mask, so that each is trained on exactly once.

A turn is written as `<turn>role\ntext</turn>\n`. Inside role and text a backslash becomes `\b` and `<` becomes `\l`
(and a line break in a role `\n`), so no text can write a marker, and reading back is exact.

Tokens of a turn: its runs of other than white space, plus `overhead` for the markers.

Defined results: a null text or role is empty. Turns are ordered by turn (null first), then role, then text; rows
repeated in full are turns of their own. Rows with a null conv_id form one conversation. An empty table gives no
windows. Columns other than the four are ignored. A long conversation is sorted with spilling, and no more than one
window of it is held in memory; only `read_back` gathers a conversation, since a digest over all of it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, word_count

BUDGET, HISTORY, OVERHEAD = 512, 64, 4
OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column) -> Column:
    r"""Each backslash is followed by b, l or n; taking \b last leaves the others as they were."""
    out = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, overhead: int = OVERHEAD) -> DataFrame:
    """turns: conv_id, turn, role, text. Returns per window: conv_id, window, text, repeated (its leading turns that are repeats), spans (of new assistant texts: start, length in code points)."""
    t = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    t = t.withColumn("tokens", word_count(F.col("text")) + overhead)
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("pos", F.row_number().over(in_order)).withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    t = t.withColumn("cost", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    t = t.withColumns({
        "upto": F.sum("cost").over(so_far),
        "system_cost": F.first(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(so_far),
        "system_text": F.first(F.when(F.col("system"), F.col("text"))).over(so_far),
    })
    beside = F.lit(budget) - F.col("system_cost")
    t = t.withColumn("half", F.greatest(F.lit(1), F.floor((beside - F.least(F.lit(history), F.floor(beside / 4))) / 2)))
    t = t.withColumn("large", (F.col("cost") > F.col("half")).cast("int"))
    t = t.withColumn("run", 2 * F.sum("large").over(so_far) - F.col("large"))
    t = t.withColumn("bin", F.when(F.col("large") == 1, F.lit(-1)).otherwise(F.floor((F.col("upto") - F.col("cost")) / F.col("half"))))
    place = F.struct("run", "bin")
    t = t.withColumn("new_window", F.coalesce((F.lag(place).over(in_order) != place) & ~F.lag("system").over(in_order), F.lit(False)).cast("int"))
    t = t.withColumn("window", F.sum("new_window").over(so_far))
    by_window = Window.partitionBy("conv_id").orderBy("window")
    t = t.withColumn("end", F.max("upto").over(by_window.rangeBetween(0, 0))).withColumn("next_cost", F.max("upto").over(by_window.rangeBetween(0, 1)) - F.col("end"))
    t = t.withColumn("after", F.col("end") - F.col("upto") + F.col("cost"))
    tail = ~F.col("system") & (F.col("after") <= F.least(F.lit(history), beside - F.col("next_cost")))
    at = F.when(tail, F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("repeat")), F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("repeat")))).otherwise(F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("repeat"))))
    placed = t.select("conv_id", "pos", "role", "text", "system", "system_text", F.explode(at).alias("at"))
    entry = F.struct("pos", F.col("at.repeat").alias("repeat"), escape(F.col("role"), True).alias("role"), escape(F.col("text")).alias("text"))
    grouped = placed.groupBy("conv_id", F.col("at.window").alias("window")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), F.max("system_text").alias("system_text"), F.max(~F.col("at.repeat")).alias("any_new")
    ).where("any_new")
    again = (F.col("window") > 0) & F.col("system_text").isNotNull()
    head = F.when(again, F.array(F.struct(F.lit(0).alias("pos"), F.lit(True).alias("repeat"), F.lit("system").alias("role"), escape(F.col("system_text")).alias("text"))))
    grouped = grouped.withColumn("entries", F.concat(F.coalesce(head, F.slice("entries", 1, 0)), F.col("entries")))
    grouped = grouped.withColumn("pieces", F.transform("entries", lambda e: F.concat(F.lit(OPEN), e["role"], F.lit("\n"), e["text"], F.lit(CLOSE))))
    spans = F.expr(f"""
        filter(transform(entries, (e, i) -> named_struct(
            'start', aggregate(slice(pieces, 1, i), 0, (n, p) -> n + length(p)) + {len(OPEN) + 1} + length(e.role),
            'length', length(e.text), 'loss', e.role = 'assistant' and not e.repeat)), s -> s.loss)""")
    return grouped.select(
        "conv_id", "window", F.array_join("pieces", "").alias("text"),
        F.size(F.filter("entries", lambda e: e["repeat"])).alias("repeated"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """windows() read again: per conversation its turns and its trained text, as digests and sizes."""
    turns = F.slice(F.split("text", CLOSE), F.col("repeated") + 1, F.greatest(F.lit(0), F.size(F.split("text", CLOSE)) - 1 - F.col("repeated")))
    turns = F.transform(turns, lambda t: F.substring(t, len(OPEN) + 1, F.length(t)))
    plain = F.transform(turns, lambda t: F.concat(unescape(F.substring_index(t, "\n", 1)), F.lit("\n"), unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t))), F.lit("\n")))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    per_window = formatted.select("conv_id", "window", F.size(plain).alias("n"), F.array_join(plain, "").alias("turns"), loss.alias("loss"), F.length("text").alias("chars"))
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
    )
    trained = F.array_join("parts.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("parts.turns", ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


#: A conversation that tries to write markers itself.
HOSTILE = r"\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return read_back(windows(rows.unionByName(own)))


SQL = rf"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}'),
b AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {OVERHEAD} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM a),
c AS (SELECT *, pos = 1 AND role = 'system' AS system, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE tokens END AS cost FROM b),
d AS (SELECT *, sum(cost) OVER w AS upto, first_value(CASE WHEN system THEN tokens ELSE 0 END) OVER w AS system_cost, first_value(CASE WHEN system THEN text END) OVER w AS system_text
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, greatest(1, floor(({BUDGET} - system_cost - least({HISTORY}, floor(({BUDGET} - system_cost) / 4.0))) / 2.0)) AS half FROM d),
f AS (SELECT *, CASE WHEN cost > half THEN 1 ELSE 0 END AS large FROM e),
g AS (SELECT *, 2 * sum(large) OVER (PARTITION BY conv_id ORDER BY pos) - large AS run FROM f),
h AS (SELECT *, run::VARCHAR || '/' || (CASE WHEN large = 1 THEN -1 ELSE floor((upto - cost) / half) END)::BIGINT::VARCHAR AS place FROM g),
i AS (SELECT *, coalesce(lag(place) OVER w <> place AND NOT lag(system) OVER w, false) AS fresh FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
j AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS win FROM i),
j2 AS (SELECT *, max(upto) OVER (PARTITION BY conv_id, win) AS ends, max(upto) OVER (PARTITION BY conv_id ORDER BY win RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS next_ends FROM j),
k AS (SELECT *, ends - upto + cost AS after, least({HISTORY}, {BUDGET} - system_cost - (next_ends - ends)) AS room, max(win) OVER (PARTITION BY conv_id) AS last_win,
  14 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars FROM j2)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  sum(chars * (1 + CASE WHEN system THEN last_win WHEN after <= room AND win < last_win THEN 1 ELSE 0 END))::BIGINT AS formatted_chars,
  (max(last_win) + 1)::BIGINT AS n_windows
FROM k GROUP BY conv_id
"""
