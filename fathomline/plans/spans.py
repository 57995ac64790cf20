"""Queries of spans in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import spans as P
from fathomline.plans.answers import SAID, said
from fathomline.plans.registry import query
from fathomline.sources.tables import read

#: Things that the texts of documents mention, with their aliases.
TOPICS = {"where": ["in the", "in", "at"], "whose": ["of the", "of"], "which": ["that", "this"], "license": ["license", "public license"]}
ANALYTES = {"Sodium": ["sodium"], "Potassium": ["potassium"], "ALT": ["ALT"]}

ALIAS_SQL = "|".join(sorted((a for group in TOPICS.values() for a in group), key=lambda a: (-len(a), a)))
NAME_SQL = "CASE lower(hit) " + " ".join(f"WHEN '{a}' THEN '{name}'" for name, group in TOPICS.items() for a in group) + " END"


def places_sql(pattern: str) -> str:
    """Matches with their places: a match begins behind all gaps and matches before it."""
    gaps, hits = f"string_split_regex(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}')"
    return f"""SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit, length(gaps[i]) + sum(length(gaps[i]) + coalesce(length(hits[i]), 0)) OVER (PARTITION BY doc_id ORDER BY i) - length(gaps[i]) - coalesce(length(hits[i]), 0) AS start
      FROM (SELECT doc_id, {gaps} AS gaps, {hits} AS hits, unnest(range(1, len({gaps}) + 1)) AS i FROM documents WHERE text IS NOT NULL)"""


NUMBERS_SQL = rf"""
WITH s AS (SELECT doc_id, start - length(gap) AS a, start AS b FROM ({places_sql(r"[.!?]\s+|\n+")}) WHERE length(gap) > 0),
m AS (SELECT doc_id, start, start + length(hit) AS stop, {NAME_SQL} AS name FROM ({places_sql(rf"(?i)\b(?:{ALIAS_SQL})\b")}) WHERE hit IS NOT NULL),
n AS (SELECT doc_id, start, hit FROM ({places_sql(r"\b[0-9]+(?:\.[0-9]+)?\b")}) WHERE hit IS NOT NULL),
t AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS sentence FROM s),
j AS (SELECT n.doc_id, n.start, n.hit AS number, sentence, a, m.start AS said, m.stop, m.name AS subject FROM n LEFT JOIN t ON t.doc_id = n.doc_id AND n.start >= t.a AND n.start < t.b
  ASOF LEFT JOIN m ON m.doc_id = n.doc_id AND m.start < n.start)
SELECT doc_id, start::BIGINT AS start, number, sentence::BIGINT AS sentence, subject, coalesce(said >= a, false) AS owned FROM j WHERE coalesce(stop <= start, true)"""


@query(NUMBERS_SQL)
def numbers_in_sentences(spark, sf_dir):
    """Numbers of documents with the sentence that holds them and the thing named last before."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = P.sweep(P.between(docs, "doc_id", "text", "sentence", P.SENTENCE_END), P.mentions(docs, "doc_id", "text", TOPICS), P.spans(docs, "doc_id", "text", "number", P.NUMBER))
    return found.where("kind = 'number' and not inside").select(F.col("id").alias("doc_id"), "start", F.col("hit").alias("number"), "sentence", "subject", "owned")


@query(SAID + """ SELECT k, unnest(CASE form WHEN 0 THEN ['Sodium'] WHEN 2 THEN ['Potassium'] WHEN 1 THEN ['Potassium', 'ALT'] ELSE ['Sodium', 'ALT', 'Potassium'] END) AS subject,
  unnest(CASE form WHEN 0 THEN ['Sodium is ' || x || ' mmol/L, which is above the upper limit. It is not low.'] WHEN 1 THEN ['potassium of ' || x || ' is within the normal range, but ', 'ALT is reduced.']
    WHEN 2 THEN ['Potassium** is not elevated at ' || x || '. She has hyponatremia.'] ELSE ['Sodium and ', 'ALT are normal. ', 'Potassium stands out most at ' || x || '.'] END) AS context FROM a""")
def subject_contexts(spark, sf_dir):
    """What answers say of each analyte."""
    return P.contexts(said(spark, sf_dir), "k", "text", ANALYTES).select(F.col("id").alias("k"), "subject", "context")


@query(SAID + """, b AS (SELECT k, form, x::VARCHAR AS x FROM a)
SELECT k, kind, hit, subject, owned, role, states FROM (
  SELECT k, 'number' AS kind, x AS hit, CASE form WHEN 0 THEN 'Sodium' ELSE 'Potassium' END AS subject, true AS owned, 'value' AS role, NULL::INT AS states FROM b
  UNION ALL SELECT k, 'state', 'above', 'Sodium', true, NULL, 4 FROM b WHERE form = 0 UNION ALL SELECT k, 'state', 'low', 'Sodium', false, NULL, 6 FROM b WHERE form = 0
  UNION ALL SELECT k, 'state', 'within the normal range', 'Potassium', true, NULL, 2 FROM b WHERE form = 1 UNION ALL SELECT k, 'state', 'reduced', 'ALT', true, NULL, 1 FROM b WHERE form = 1
  UNION ALL SELECT k, 'state', 'elevated', 'Potassium', true, NULL, 3 FROM b WHERE form = 2 UNION ALL SELECT k, 'state', 'normal', 'ALT', true, NULL, 2 FROM b WHERE form = 3)""")
def said_of_subjects(spark, sf_dir):
    """Numbers with their role and words of state with the states they leave open (1 low, 2 normal, 4 high), by subject."""
    return P.read_texts(said(spark, sf_dir), "k", "text", ANALYTES).select(F.col("id").alias("k"), "kind", "hit", "subject", "owned", "role", "states")
