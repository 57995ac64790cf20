r"""Spans in texts, and an interval sweep over them: which sentence and which subject each span belongs to.

Spans of each kind (sentences, mentions of named things, numbers, words of state) are found by one regular expression a kind, in built-in functions: what lies between
the matches and the matches themselves become rows, and running sums of their lengths are their places. The sweep lays starts and ends of all spans of a
text in one order and keeps, in windows, the sentence that is open, the number of mentions that are open, and the mention that began last. So spans are joined by
containment without comparing pairs of spans, and a text of any length is rows that are sorted, with spilling.

Ids must be unique. A null text has no spans. Places are characters from 0, ends exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, NORMAL, HIGH = 1, 2, 4
ANY = LOW | NORMAL | HIGH
#: What ends a sentence; the mark is no part of it.
SENTENCE_END = r"[.!?]\s+|\n+"
NUMBER = r"(?<![0-9A-Za-z_])[0-9]+(?:\.[0-9]+)?(?![0-9A-Za-z_])"
#: Characters around a span that its role is read from.
AROUND = 65

#: Own rules: words of state with the states they leave open, tried in this order.
STATES = [
    (r"(?:outside|out of|beyond)(?: \w+){0,3} (?:range|limits?)|abnormal", LOW | HIGH),
    (r"(?:above|over|exceeds) (?:the |its )?lower (?:limit|bound)", NORMAL | HIGH), (r"(?:below|under) (?:the |its )?upper (?:limit|bound)", LOW | NORMAL),
    (r"(?:within|in)(?: \w+){0,3} (?:range|limits?)|normal|unremarkable", NORMAL),
    (r"elevated|raised|increased|high|higher|above|exceeds", HIGH), (r"low|lower|below|decreased|reduced|depressed", LOW),
]
STATE = rf"(?i)(?<![\w-])(?:{'|'.join(p for p, _ in STATES)})(?![\w-])"
NEGATION = r"(?i)(?:(?<!\w)(?:not|no|never|without|nor|neither)|n[’'´]t)(?:\s+\w+){0,2}\s+$"
#: Own rules: roles of a number by the text before (ends with) or behind it (begins with); bounds are nothing's value.
ROLES = [
    ("bound", r"(?:range|limit|threshold|bound|boundary)(?: of| is)?\s*$|[<>≤≥]\s*$", None),
    ("percent", None, r"^\s*(?:%|percent)(?!\s*(?:percentage )?points)"),
    ("ratio", r"ratio(?: of| is)?\s*$", r"^\s*(?:times|-?\s?fold|×|x(?!\w))"),
    ("difference", r"(?:by|difference(?: of| is)?|shortfall(?: of| is)?)\s+(?:about |only )?$", r"^\s*(?:[^\s\d]+\s+){0,2}(?:above|below|higher|lower|over|under)(?!\w)"),
]


def matches(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Matches of a pattern (never empty ones) and what lies between them: id, i, start (of the match), gap (text before it), hit, behind (text up to the next match). The last row of a text has
    no hit, and its gap is what is left."""
    text = F.col(text_col)
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))).alias("i", "p"))
    rows = parts.select("id", "i", F.col("p.gap").alias("gap"), F.col("p.hit").alias("hit"))
    in_order = Window.partitionBy("id").orderBy("i")
    upto = F.coalesce(F.sum(F.length("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("id", "i", (upto + F.length("gap")).cast("long").alias("start"), "gap", "hit", F.lead("gap").over(in_order).alias("behind"))


def spans(docs: DataFrame, id_col: str, text_col: str, kind: str, pattern: str) -> DataFrame:
    """Matches as spans: id, kind, start, end, hit, before and after (text up to the neighbouring matches, AROUND at most)."""
    rows = matches(docs, id_col, text_col, pattern).where("hit is not null")
    return rows.select("id", F.lit(kind).alias("kind"), "start", (F.col("start") + F.length("hit")).alias("end"), "hit", F.right("gap", F.lit(AROUND)).alias("before"), F.left("behind", F.lit(AROUND)).alias("after"))


def between(docs: DataFrame, id_col: str, text_col: str, kind: str, pattern: str) -> DataFrame:
    """What lies between matches of a pattern, as spans: sentences between their ends, say. Blank ones are none."""
    cuts = spans(docs, id_col, text_col, kind, pattern).select("id", "start", "end")
    ends = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.length(text_col).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    from_ = F.coalesce(F.lag("end").over(Window.partitionBy("id").orderBy("start", F.col("end").asc_nulls_last())), F.lit(0).cast("long"))
    blank = F.lit(None).cast("string")
    return cuts.unionAll(ends).select("id", F.lit(kind).alias("kind"), from_.alias("start"), F.col("start").alias("end"), blank.alias("hit"), blank.alias("before"), blank.alias("after")).where(F.col("end") > F.col("start"))


def aliases_of(names: dict[str, list[str]]) -> tuple[str, Column]:
    """A pattern for all aliases as whole words, longer ones first, and a map from an alias in small letters to its name."""
    aliases = {a.lower(): name for name, group in names.items() for a in group}
    pattern = rf"(?i)(?<![0-9A-Za-z_])(?:{'|'.join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))})(?![0-9A-Za-z_])"
    return pattern, F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])


def mentions(docs: DataFrame, id_col: str, text_col: str, names: dict[str, list[str]]) -> DataFrame:
    """Where one of the names' aliases stands, in any case; hit is the name."""
    pattern, of = aliases_of(names)
    return spans(docs, id_col, text_col, "mention", pattern).withColumn("hit", of[F.lower("hit")])


def sweep(*kinds: DataFrame) -> DataFrame:
    """Spans of several kinds, "sentence" and "mention" among them, as rows of the others and of mentions: with sentence (its number in the text, from 0, and null between sentences),
    subject (name of the mention that began last before, or null), owned (whether that was in the same sentence), inside (whether the span begins in a mention)."""
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    # At one place ends come before starts, and sentences before mentions before others.
    is_ = lambda kind: F.col("kind") == kind
    rank = F.when(is_("sentence"), 1).when(is_("mention"), 2).otherwise(3)
    step = lambda at, order, delta: F.struct(F.col(at).alias("at"), order.alias("order"), F.lit(delta).alias("delta"))
    steps = F.when(is_("sentence") | is_("mention"), F.array(step("start", rank, 1), step("end", F.lit(0), -1))).otherwise(F.array(step("start", rank, 1)))
    events = rows.withColumn("e", F.explode(steps)).select("*", "e.*").drop("e")
    upto = Window.partitionBy("id").orderBy("at", "order", "end").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    begins = lambda kind: is_(kind) & (F.col("delta") == 1)
    open_ = lambda kind, window: F.coalesce(F.sum(F.when(is_(kind), F.col("delta"))).over(window), F.lit(0))
    state = events.withColumns({
        "sentence": F.when(open_("sentence", upto) > 0, F.count_if(begins("sentence")).over(upto) - 1),
        "from": F.max(F.when(begins("sentence"), F.col("start"))).over(upto),
        "last": F.last(F.when(begins("mention"), F.struct("start", "hit")), ignorenulls=True).over(before),
        "inside": open_("mention", before) > 0,
    })
    owned = F.coalesce(F.col("sentence").isNotNull() & (F.col("last.start") >= F.col("from")), F.lit(False))
    return state.where((F.col("delta") == 1) & ~is_("sentence")).select("id", "kind", "start", "end", "hit", "before", "after", "sentence", F.col("last.hit").alias("subject"), owned.alias("owned"), "inside")


def contexts(docs: DataFrame, id_col: str, text_col: str, names: dict[str, list[str]], default: str | None = None) -> DataFrame:
    """What a text says of each name: id, subject, context. A stretch begins where a name is mentioned and goes on to the next mention of any; stretches of one name are joined by a space.
    What comes before the first mention is the default's, if there is one; a text without mentions is all of it."""
    pattern, of = aliases_of(names)
    rows = matches(docs, id_col, text_col, pattern)
    said = rows.where("hit is not null").select("id", F.col("i") + 1, of[F.lower("hit")].alias("subject"), F.concat("hit", "behind").alias("piece"))
    if default:
        said = said.unionAll(rows.where("i = 0").select("id", F.lit(0), F.lit(default), "gap"))
    pieces = said.toDF("id", "place", "subject", "piece").where(F.length("piece") > 0)
    return pieces.groupBy("id", "subject").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), " ").alias("context"))


def number_role(before: Column, after: Column) -> Column:
    """bound, percent, ratio, difference, or value where no rule says more."""
    low, high = F.lower(F.coalesce(before, F.lit(""))), F.lower(F.coalesce(after, F.lit("")))
    out = F.lit("value")
    for role, left, right in reversed(ROLES):
        holds = [F.regexp_like(side, F.lit(p)) for side, p in ((low, left), (high, right)) if p]
        out = F.when(holds[0] if len(holds) == 1 else holds[0] | holds[1], role).otherwise(out)
    return out


def state_bits(hit: Column, before: Column) -> Column:
    """The states that a word of state leaves open, as bits; a negation shortly before it leaves the others."""
    bits = F.lit(0)
    for pattern, states in reversed(STATES):
        bits = F.when(F.regexp_like(F.lower(hit), F.lit(rf"^(?:{pattern})$")), states).otherwise(bits)
    return F.when(F.regexp_like(F.coalesce(before, F.lit("")), F.lit(NEGATION)), F.lit(ANY) - bits).otherwise(bits)


def read_texts(docs: DataFrame, id_col: str, text_col: str, names: dict[str, list[str]]) -> DataFrame:
    """All that texts say, a row for each number or word of state: id, kind, start, sentence, subject, owned, hit, role (of a number), states (bits). Numbers in a name are none."""
    found = sweep(between(docs, id_col, text_col, "sentence", SENTENCE_END), mentions(docs, id_col, text_col, names), spans(docs, id_col, text_col, "number", NUMBER), spans(docs, id_col, text_col, "state", STATE))
    rows = found.where("kind <> 'mention' and not inside")
    number = F.col("kind") == "number"
    return rows.select("id", "kind", "start", "sentence", "subject", "owned", "hit", F.when(number, number_role(F.col("before"), F.col("after"))).alias("role"), F.when(~number, state_bits(F.col("hit"), F.col("before"))).alias("states"))
