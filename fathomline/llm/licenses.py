r"""License notices in texts, short ones found in spite of small edits.

A text is taken as its words (`[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased), joined by single spaces. A notice of a few words may
occur with up to k edits of characters (insertions, deletions, substitutions), k by its length. By the pigeonhole principle one of k + 1 pieces of the notice
occurs as it is, within k characters of its place. So:

1. The pieces of all notices are exact seeds; one automaton finds where they stand.
2. Around each seed's place the regex library matches the notice with at most k errors, from the start of a word to the end of a word. The match with fewest
   errors is a span; the same span found by several seeds counts once.

Spans without errors whose notice is one of the base phrases are the base places. A span with errors has the label of its notice, too. The score of a text is
the best of its spans: 1 less the share of the notice's characters that are errors, times the notice's weight, as a mention of a license says
less than its grant.

Each text is scanned by itself, in a time that grows with its length and with the number of seeds in it; windows that are alike, as in a text that
repeats itself, are matched once.

Defined results: a null text is empty. A text without words has 0 words, no labels (empty strings), score 0 and null first and last word. Rows that repeat have
a row each. An empty table gives an empty result. Columns other than id and text are ignored. Words count from 0; offsets are code points of the text, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table

#: Base phrases and labels, as the contract has them.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Other notices: label, weight, words.
NOTICES = [
    ("agpl", 0.9, "gnu affero general public license"),
    ("apache", 1.0, "licensed under the apache license version 2 0"),
    ("bsd", 0.9, "bsd license"),
    ("bsd", 1.0, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", 0.9, "creative commons attribution"),
    ("cc0", 0.9, "cc0 1 0 universal"),
    ("copyright", 0.5, "all rights reserved"),
    ("gpl", 1.0, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", 1.0, "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", 0.9, "gnu lesser general public license"),
    ("mit", 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl", 0.9, "mozilla public license"),
    ("public-domain", 0.9, "released into the public domain"),
    ("unlicense", 1.0, "this is free and unencumbered software released into the public domain"),
]
BASE_WEIGHT = 0.8
#: One edit is allowed for each full run of this many characters of a notice.
CHARS_AN_EDIT = 12
#: Windows whose matches are remembered, each of some hundred bytes.
REMEMBERED = 20_000

#: Bytes of UTF-8 text: letters lower-cased, other ASCII that no word holds turned to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def edits(notice: str) -> int:
    return len(notice) // CHARS_AN_EDIT


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice cut into k + 1 runs of about equal length: (start, run). Those at its ends take the spaces around the notice in, which every match has."""
    cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
    runs = [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    runs[0] = (-1, " " + runs[0][1])
    return [*runs[:-1], (runs[-1][0], runs[-1][1] + " ")]


class Search:
    """Notices with their automaton of seeds. Texts are bytes of UTF-8 read as Latin-1, so an error is one of a byte."""

    def __init__(self, notices: list[tuple[str, float, str]]):
        import ahocorasick
        import regex

        self.notices = [(label, weight, words, edits(words)) for label, weight, words in notices]
        # The space behind a notice is in the group, as errors at the end of a group that a literal follows would be missed.
        self.patterns = [regex.compile(rf"(?b) (?:{regex.escape(words, literal_spaces=True)} ){{e<={k}}}(?<= )") for _, _, words, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (_, _, words, k) in enumerate(self.notices):
            for start, run in pieces(words, k):
                held.setdefault(run, []).append((n, start))
        for run, uses in held.items():
            self.seeds.add_word(run, (len(run), uses))
        self.seeds.make_automaton()
        self.match = lru_cache(REMEMBERED)(self._match)

    def _match(self, n: int, window: str) -> tuple[int, int, int] | None:
        found = self.patterns[n].search(window)
        return found and (found.start() + 1, found.end() - 1, sum(found.fuzzy_counts))

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Spans as (notice, start, end, errors), offsets in the words joined by spaces with one before and behind."""
        text = f" {b' '.join(words).decode('latin-1')} "
        found, seen = set(), set()
        for last, (length, uses) in self.seeds.iter(text):
            for n, start in uses:
                begins = last - length + 1 - start
                if (n, begins) not in seen:
                    seen.add((n, begins))
                    _, _, notice, k = self.notices[n]
                    low = max(0, begins - k - 1)
                    if hit := self.match(n, text[low : begins + len(notice) + k + 1]):
                        found.add((n, low + hit[0], low + hit[1], hit[2]))
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))


@cache
def searcher() -> Search:
    return Search([(label, BASE_WEIGHT, words) for words, label in BASE.items()] + NOTICES)


def scan(text: str | None) -> tuple[int, list[tuple[str, str, int, int, int, float]]]:
    """Number of words, and spans: (label, notice, first word, word after the last, errors, score)."""
    words, search = words_of(text), searcher()
    spans = search.spans(words)
    out = []
    if spans:
        starts, at = {}, 1
        for k, word in enumerate(words):
            starts[at] = k
            at += len(word) + 1
        for n, a, b, errors in spans:
            label, weight, notice, _ = search.notices[n]
            out.append((label, notice, starts[a], starts.get(b + 1, len(words)), errors, round(weight * (1 - errors / len(notice)), 4)))
    return len(words), out


def places(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each word in code points of the text, in the order of words_of."""
    import re

    return (m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))


SPAN = "array<struct<label:string,notice:string,first_word:long,next_word:long,errors:int,score:double,start:long,end:long>>"


def find_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as doc_id, n_words, spans (label, notice, first_word, next_word, errors, score, and start and end in the text)."""
    import pyarrow as pa

    names = ("label", "notice", "first_word", "next_word", "errors", "score", "start", "end")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True))))

    def kernel(batches):
        for part, (_, texts) in rows_of(batches):
            counts, found = [], []
            for text in texts:
                n, spans = scan(text)
                at = list(places(text)) if spans else []
                counts.append(n)
                found.append([dict(zip(names, (*s, at[s[2]][0], at[s[3] - 1][1]), strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, spans {SPAN}")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_notices(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["notice"].isin(*BASE) & (s["errors"] == 0))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first_word").alias("first_word"), F.array_max("base.first_word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.col("spans.label")).alias("labels"),
        F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"), F.size("spans").cast("long").alias("n_spans"))
