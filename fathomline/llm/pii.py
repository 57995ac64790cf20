r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds, each leftmost and non-overlapping within its kind, matches that fail their test dropped without another try:

email  `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`
ip     `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`, parts at most 255
card   `[0-9]([\x20-]?[0-9])+`, 13 to 19 digits that pass Luhn
phone  `\+[0-9][\x20().0-9-]+[0-9]`, 9 to 15 digits

Base spans stay, whatever their score. The method adds kinds of its own, where validator and context leave a score of
at least `THRESHOLD`: iban (mod 97), ssn (ranges that are issued, and a word nearby), local_phone (ten digits in
groups, and a word nearby). A span starts with the score of its kind; a validator that passes raises it; words before
and after it raise or lower it.

The patterns are scanned so that no text, however long its runs, takes more than linear time: an email is found from
its @, and digit patterns only start where a run of digits does (from within a run the same run would fail again).

Defined results: a null text is empty; texts without matches have empty `spans` and the digest of the empty string.
Offsets are code points, end exclusive. Rows that repeat have a row each. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
THRESHOLD = 0.5
WINDOW = 48

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Looking behind comes after the first character, so that the search skips to characters that can start a match.
IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", re.S)
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.S)
SSN = re.compile(r"([0-9](?<![0-9-].)[0-9]{2})-([0-9]{2})-([0-9]{4})(?![0-9-])", re.S)
LOCAL_PHONE = re.compile(r"[(0-9](?<![0-9+.(-].)(?:(?<=\()[0-9]{3}\) ?|(?<=[0-9])[0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", re.S)

#: Score of a kind by itself, and once its validator has passed.
SCORES = {"email": (0.6, 0.9), "ip": (0.3, 0.6), "card": (0.2, 0.8), "phone": (0.4, 0.6), "iban": (0.2, 0.8), "ssn": (0.1, 0.3), "local_phone": (0.1, 0.3)}
#: Words near a span that speak for its kind, and words that speak against any.
FOR = {
    "email": {"email", "mail", "contact", "write"}, "ip": {"ip", "address", "host", "server", "client"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment"}, "phone": {"phone", "call", "tel", "telephone", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer"}, "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "call", "tel", "telephone", "mobile", "fax"},
}
AGAINST = {"version", "isbn", "order", "invoice", "serial", "example", "test", "sample"}
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the checksum of an IBAN holds: letters count from 10, the first four characters go last, and 1 remains."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL_PART.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def overlaps(found: list[tuple[int, int, bool]], start: int, end: int) -> bool:
    """Whether one of the spans, which are in order and disjoint, overlaps another span."""
    k = bisect_left(found, end, key=lambda s: s[0])
    return k > 0 and found[k - 1][1] > start


def proposals(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """Spans by kind as (start, end, whether the validator passes); base kinds only hold those that pass."""
    out: dict[str, list[tuple[int, int, bool]]] = {kind: [] for kind in BASE + ADDED}
    out["email"] = [(a, b, True) for a, b in emails(text)]
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append((*m.span(), True))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out["card"].append((*m.span(), True))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(digits_of(m[0])) <= 15:
            out["phone"].append((*m.span(), True))
    for m in IBAN.finditer(text):
        out["iban"].append((*m.span(), 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code)))
    for m in SSN.finditer(text) if "-" in text else ():
        out["ssn"].append((*m.span(), m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"))
    for m in LOCAL_PHONE.finditer(text):
        if not any(overlaps(out[kind], *m.span()) for kind in ("phone", "card")):
            out["local_phone"].append((*m.span(), True))
    return out


def score(kind: str, valid: bool, before: str, after: str) -> float:
    words = set(WORD.findall(before.lower())) | set(WORD.findall(after.lower()))
    value = SCORES[kind][valid] + 0.3 * bool(words & FOR[kind]) - 0.2 * bool(words & AGAINST)
    return round(min(1.0, max(0.0, value)), 3)


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans by kind as listed, then start: (kind, start, end, score)."""
    text = text or ""
    out = []
    for kind, found in proposals(text).items():
        for a, b, valid in found:
            value = score(kind, valid, text[max(0, a - WINDOW) : a], text[b : b + WINDOW])
            if kind in BASE or value >= THRESHOLD:
                out.append((kind, a, b, value))
    return out


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as doc_id, spans (kind, start, end, score)."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def kernel(batches):
        for part, (_, texts) in rows_of(batches):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPAN}")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"), F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("max_score"),
    )


def base_digest(text: str | None) -> str:
    """The digest of the base spans of one text, for tests."""
    found = [s for s in spans(text) if s[0] in BASE]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found).encode()).hexdigest()
