"""Spans in texts against plain scans."""

import random
import re

from pyspark.sql import functions as F

from fathomline.operators import spans as P

NAMES = {"Iron": ["serum iron", "iron"], "T4": ["free t4", "T4"], "LDL": ["ldl"]}


def some_texts():
    r = random.Random(6)
    words = ["iron", "Serum iron", "free T4", "T4,", "ldl", "LDL-C", "12.5", "3", "x9", "7x", "not", "elevated", "low.", "within normal limits", "é", "range of", "\n", "is\n\n", "!", "a. B", "above the lower limit", "isn't", "5 % above", "3 times", "by 4"]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(120)] + ["", None, "iron", "...\n\n", "iron 4. 5"]


def plain(text):
    """Numbers and words of state of one text, by scanning it."""
    cuts = [m.span() for m in re.finditer(P.SENTENCE_END, text, re.A)]
    ends = list(zip([0] + [b for _, b in cuts], [a for a, _ in cuts] + [len(text)], strict=True))
    sentences = [s for s in ends if s[1] > s[0]]
    aliases = {a.lower(): n for n, group in NAMES.items() for a in group}
    named = [(m.start(), m.end(), aliases[m[0].lower()]) for m in re.finditer(r"(?<![0-9A-Za-z_])(?:serum iron|free t4|iron|ldl|t4)(?![0-9A-Za-z_])", text, re.I)]
    out = []
    for kind, pattern in (("number", P.NUMBER), ("state", P.STATE)):
        for m in re.finditer(pattern, text, re.A):
            at = m.start()
            if any(a < at < b or a == at for a, b, _ in named):
                continue
            inside = [k for k, (a, b) in enumerate(sentences) if a <= at < b]
            last = max((n for n in named if n[0] < at), default=None)
            owned = bool(inside and last and last[0] >= sentences[inside[0]][0])
            out.append((kind, at, inside[0] if inside else None, last and last[2], owned, m[0]))
    return out


def test_sweep_joins_by_containment(spark):
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    got = P.read_texts(df, "k", "text", NAMES).select("id", "kind", "start", "sentence", "subject", "owned", "hit").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(k, *row) for k, t in enumerate(texts) for row in plain(t or "")], key=repr)


def test_contexts(spark):
    df = spark.createDataFrame([(1, "Well. Iron is low; LDL high, iron rose."), (2, "Nothing"), (3, None), (4, "")], "k long, text string")
    got = {(r["id"], r["subject"]): r["context"] for r in P.contexts(df, "k", "text", NAMES, default="T4").collect()}
    assert got == {(1, "T4"): "Well. ", (1, "Iron"): "Iron is low;  iron rose.", (1, "LDL"): "LDL high, ", (2, "T4"): "Nothing"}
    assert P.contexts(df, "k", "text", NAMES).count() == 2


def test_roles_and_states(spark):
    roles = [("off by ", ".", "difference"), ("is ", " points above it", "difference"), ("is ", " times", "ratio"), ("up ", "% above", "percent"), ("up ", "% points", "value"), ("range of ", "", "bound"), (">= ", "", "value"), ("> ", "", "bound"), (None, None, "value")]
    df = spark.createDataFrame(roles, "before string, after string, want string")
    assert df.where(P.number_role(F.col("before"), F.col("after")) != F.col("want")).count() == 0
    states = [("high", "is ", 4), ("high", "is not very ", 3), ("High", "isn't ", 3), ("low", "never, ", 1), ("within normal limits", "", 2), ("abnormal", "no ", 2), ("above the lower limit", "", 6)]
    df = spark.createDataFrame(states, "hit string, before string, want int")
    assert df.where(P.state_bits(F.col("hit"), F.col("before")) != F.col("want")).count() == 0


def test_a_long_text(spark):
    """20 MB of one text are rows that are sorted: 400,000 sentences, as many mentions and numbers."""
    piece = "The iron of this one was 12.5 and not elevated. "
    df = spark.range(1).select(F.col("id").alias("k"), F.repeat(F.lit(piece), 420_000).alias("text"))
    got = P.read_texts(df, "k", "text", NAMES).groupBy("kind", "subject", "owned", "states").agg(F.count(F.lit(1)).alias("n"), F.max("sentence").alias("last")).collect()
    assert {(r["kind"], r["subject"], r["owned"], r["states"], r["n"], r["last"]) for r in got} == {("number", "Iron", True, None, 420_000, 419_999), ("state", "Iron", True, 3, 420_000, 419_999)}
