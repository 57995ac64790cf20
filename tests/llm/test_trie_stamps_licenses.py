"""Prefix tries, timestamps and license notices against plain versions, with nulls, empty tables, ties, repeated rows, long texts and clashing names."""

import hashlib
import random
import re
import zlib
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from fathomline.llm import licenses, stamps, trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURN = "conv_id long, turn long, role string, text string"


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def plain_trie(convs):
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out, saved, leaves = [], {}, {}
    for key in sorted(members, key=len, reverse=True):
        below, own = children.get(key, []), members[key]
        leaves[key] = sum(leaves[k] for k in below) or 1
        saved[key] = sum(saved[k] for k in below) + ((len(own) - 1) * len(key[-1][1].encode()) if key else 0)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(key))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(below), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_conversations(seed):
    r, convs = random.Random(seed), {}
    for c in range(-15, 90):
        known, x = list(convs.values()), r.random()
        if known and x < 0.3:
            convs[c] = list(r.choice(known))
        else:
            start = r.choice(known)[: r.randint(0, 6)] if known and x < 0.7 else []
            convs[c] = start + [(r.choice(["user", "", "a:b"]), r.choice(["x", "", "ü<\\", "x" * 50])) for _ in range(r.randint(0, 6))]
    return convs


@pytest.mark.parametrize("parts,block", [(1, 64), (7, 3), (13, 1)])
def test_trie(spark, parts, block):
    convs = some_conversations(parts)
    turns = [(c, k, role or None, text or None) for c, seq in convs.items() for k, (role, text) in enumerate(seq)]
    df = spark.createDataFrame(turns, TURN).withColumns({c: F.lit(1) for c in ("a", "pos", "part", "n", "rep")})
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert rows(trie.prefix_trie(df, ids, parts, block), *NODE) == plain_trie(convs)


def test_trie_of_chains_ties_and_nothing(spark):
    chain = {c: [("u", "x")] * (c % 9) for c in range(40)}
    turns = [(c, None if k == 0 else 1, *t) for c, seq in chain.items() for k, t in enumerate(seq)] + [(None, 0, "u", "lost")]
    ids = spark.createDataFrame([(c,) for c in chain], "conv_id long")
    assert rows(trie.prefix_trie(spark.createDataFrame(turns, TURN), ids, 5, 2), *NODE) == plain_trie(chain)
    assert trie.prefix_trie(spark.createDataFrame([], TURN)).collect() == []
    alone = trie.prefix_trie(spark.createDataFrame([], TURN), spark.createDataFrame([(4,)], "conv_id long"))
    assert rows(alone, *NODE) == plain_trie({4: []})


def test_trie_of_one_long_conversation(spark):
    """Most rows are one conversation's: it lies in many ranges, and all but its first digests are one edge."""
    convs = {1: [("u", str(k)) for k in range(3000)], 2: [("u", str(k)) for k in range(130)] + [("u", "other")], 3: [("u", "0")]}
    df = spark.createDataFrame([(c, k, *t) for c, seq in convs.items() for k, t in enumerate(seq)], TURN)
    assert rows(trie.prefix_trie(df, parts=6), *NODE) == plain_trie(convs)


def test_trie_rebuilds_from_the_family(spark):
    own = {c: [("u", f"{c}.{k}") for k in range(c % 13)] for c in range(60) if c % 5 != 0 or c % 2 == 0}
    own = {c: seq for c, seq in own.items() if seq}
    df = spark.createDataFrame([(c, k, *t) for c, seq in own.items() for k, t in enumerate(seq)], TURN)
    got = {}
    for r in trie.rebuilt(df).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        assert [t for _, t in sorted(got.get(c, []))] == [t for _, t in own.get(c - c % 5, [])[:h] + seq[h:]]


# timestamps


def plain_stamps(table):
    """A reading of the forms from their description: (utc_us, rule, ambiguous) for each row."""
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

    def dates(text):
        for form, names in ((r"(20\d\d)-(\d\d)-(\d\d)", "ymd"), (r"(20\d\d)(\d\d)(\d\d)", "ymd"), (r"(\d\d)\.(\d\d)\.(20\d\d)", "dmy"), (r"(\d\d) ([A-Z][a-z]{2}) (20\d\d)", "dby"), (r"(\d\d)/(\d\d)/(20\d\d)", "dmy/mdy")):
            if m := re.fullmatch(form, text, re.A):
                for order in names.split("/"):
                    part = dict(zip(order, m.groups(), strict=True))
                    if "b" in part:
                        part["m"] = months.index(part["b"]) + 1 if part["b"] in months else 0
                    try:
                        yield date(int(part["y"]), int(part["m"]), int(part["d"]))
                    except ValueError:
                        yield None
                return

    read = []
    for _, _, _, raw in table:
        raw = (raw or "").strip(" \t\n\v\f\r")
        if re.fullmatch(r"\d{10}|\d{13}", raw, re.A):
            read.append(("epoch", int(raw) * (10**6 if len(raw) == 10 else 1000)))
            continue
        m = re.fullmatch(r"(.*?)(?:[T ](\d\d):(\d\d)(?::(\d\d))?( ?[AP]M)?(?: ?(Z|[+-]\d\d:?\d\d))?)?", raw, re.A)
        found = list(dates(m[1])) if m else []
        h, mi, s, half, zoned = int(m[2] or 0), int(m[3] or 0), int(m[4] or 0), (m[5] or "").strip(), m[6] if m else None
        if half:
            ok, h = 1 <= h <= 12, h % 12 + 12 * (half == "PM")
        else:
            ok = h <= 23
        shift = None
        if zoned:
            hours, minutes = (0, 0) if zoned == "Z" else (int(zoned[1:3]), int(zoned[-2:]))
            ok, shift = ok and hours <= 14 and minutes <= 59, (-1 if zoned[0] == "-" else 1) * (hours * 60 + minutes)
        if not ok or mi > 59 or s > 59 or not any(found):
            read.append(("bad", None))
        else:
            read.append(("dates", found, timedelta(hours=h, minutes=mi, seconds=s), shift))
    votes = {}
    for (_, source, _, _), r in zip(table, read, strict=True):
        if r[0] == "dates" and len(r[1]) == 2 and None in r[1]:
            votes.setdefault(source, [0, 0])[r[1].index(None)] += 1
    out = []
    for (_, source, zone, _), r in zip(table, read, strict=True):
        if r[0] == "epoch":
            out.append((r[1], "epoch", False))
            continue
        if r[0] == "bad":
            out.append((None, "bad", False))
            continue
        _, found, time, shift = r
        rule, day = "plain", next(d for d in found if d)
        if len(found) == 2 and None not in found and found[0] != found[1]:
            no_month, no_day = votes.get(source, [0, 0])
            rule = "default" if no_month == no_day else "votes"
            day = found[1] if no_month > no_day else found[0]
        wall = datetime(day.year, day.month, day.day) + time
        if shift is None:
            try:
                where = ZoneInfo(zone)
            except (TypeError, ValueError, OSError, KeyError):
                out.append((None, "bad", False))
                continue
            folds = [wall.replace(tzinfo=where, fold=f).utcoffset() for f in (0, 1)]
            # In a gap fold 0 has the offset before the change, in an overlap also.
            moved, unsettled = folds[1], folds[0] != folds[1]
        else:
            moved, unsettled = timedelta(minutes=shift), False
        utc = (wall - moved).replace(tzinfo=UTC)
        out.append((int(utc.timestamp()) * 10**6, rule, rule != "plain" or unsettled))
    return out


STAMP = "stamp_id long, source string, zone string, raw string"
ZONES = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "UTC", "Asia/Kolkata", "Africa/Casablanca"]
FORMS = ["2024-03-10 02:30:00", "2024-11-03T01:30", "31.03.2024 02:15", "27 Oct 2024 02:15:59", "20240310", "2024-02-30", "2023-02-29 10:00", "24.12.2024 24:00", "2024-01-01 10:60", "01/02/2024", "13/02/2024 01:00 PM", "02/13/2024", "05/05/2024 12:00 AM", "13/13/2024",
    "1704067200", "1704067200123", "170406720", "2024-01-01T00:00:00+1500", "2024-01-01T00:00 -09:30", "2024-01-01 00:30 PM", "2024-01-01 12:30AM Z", "2024-01-01 13:00 AM", "1 Jan 2024", "01 JAN 2024", "2024-01-01T", "2024-01-01t10:00", "1999-01-01", "2099-12-31 23:59:59", "2000-02-29", "\n 2024-07-01 \t", "x|y", "2024-04-07 01:45", "01/02/2024 05:00Z", "2024-01-01 10:00:00 ", "２０２４-01-01", "2024-01-01\x85"]


def some_stamps():
    r = random.Random(8)
    table = [(k, f"s{k % 4}" if k % 9 else None, ZONES[k % len(ZONES)], raw) for k, raw in enumerate(FORMS * 6)]
    table += [(1000 + k, f"s{k % 4}", r.choice(ZONES), f"{r.randint(1, 31):02d}/{r.randint(1, 28):02d}/2024 {r.randint(0, 23):02d}:30") for k in range(200)]
    table += [(2000 + k, "hot", "Europe/Berlin", f"2024-{r.choice([3, 10])}-{r.randint(24, 31)} 0{r.randint(1, 3)}:15") for k in range(50)]
    table += [(3000 + k, "hot", "America/New_York", f"20{r.randint(0, 99):02d}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:15") for k in range(300)]
    return [*table, (1, None, None, None), (None, None, None, "01/02/2024"), (2, "s1", "No/Where", "2024-01-01"), (2, "s1", "No/Where", "2024-01-01"), (3, "s1", "../etc", "20240101"), (4, "s1", None, "20240101T10:00Z")]


@pytest.mark.parametrize("parts", [1, 9])
def test_stamps(spark, parts):
    table = some_stamps()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(table, STAMP).withColumns({c: F.lit(7) for c in ("wall", "part", "kind", "salt", "offset", "epoch")})
        got = rows(stamps.normalise(df), "stamp_id", "utc_us", "rule", "ambiguous")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted([(row[0], *result) for row, result in zip(table, plain_stamps(table), strict=True)], key=repr)
    assert got == want
    assert {r[2] for r in got} == {"bad", "epoch", "votes", "default", "plain"}


def test_stamps_of_an_empty_table_and_states(spark):
    assert stamps.normalise(spark.createDataFrame([], STAMP)).collect() == []
    walls = spark.createDataFrame([("Europe/Berlin", int(datetime(2024, m, d, 2, 30, tzinfo=UTC).timestamp())) for m, d in ((3, 31), (10, 27), (7, 1))], "zone string, wall long").withColumn("id", F.lit(1))
    assert rows(stamps.sweep(walls, 3), "offset", "state") == [(3600, "overlap"), (7200, "gap"), (7200, "plain")]


# license notices


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


NOTICES = [(words, label, licenses.edits(words)) for words, label in licenses.BASE.items()] + [(words, label, licenses.edits(words)) for label, _, words in licenses.NOTICES]


def fewest_errors(words):
    """Fewest edits of each notice over all runs of words, where they are few enough."""
    out = {}
    for notice, _, k in NOTICES:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if len(run) > len(notice) + k:
                    break
                if len(run) >= len(notice) - k and (d := distance(run, notice)) <= k:
                    out[notice] = min(d, out.get(notice, d))
    return out


def edited(r, notice, n):
    s = list(notice)
    for _ in range(n):
        at = r.randrange(len(s))
        s[at : at + 1] = r.choice([[], [r.choice("abcx ")], [s[at], r.choice("el ")]])
    return "".join(s)


def test_notices_with_edits():
    r = random.Random(2)
    for _ in range(150):
        notice, _, k = r.choice(NOTICES)
        words = plain_words(f"see {edited(r, notice, r.randint(0, k + 1))} for license")
        found = {}
        for n, _, _, errors in licenses.searcher().spans([w.encode() for w in words]):
            name = licenses.searcher().notices[n][2]
            found[name] = min(errors, found.get(name, errors))
        assert found == fewest_errors(words), words


TEXTS = ["", None, "  ,. ", "The MIT License (MIT)", "mit-license, MIT license; mit  licenses", "CC BY 4.0 / cc-by / ccby / cc by", "GNU General Public License v2", "gnu general publik license", "Apache\nLicense Apache Licence", "ÀPACHE LICENSE apache license", "cc by cc by cc by", "by cc by",
    "word " * 30_000 + "mit license " * 500, "x" * 100_000, "License " * 3000, "Permission is hereby granted, free of charge, to any person obtaing a copy"]


def test_license_query(spark, tmp_path):
    table = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[4])]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("spans", "n_words", "base", "labels")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in licenses.op13_licenses(spark, str(tmp_path)).collect()}
    for key, text in table:
        words = plain_words(text)
        places = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        r = got[key]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({label for _, label in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        if len(words) < 100:
            found = fewest_errors(words)
            assert r["labels"] == ",".join(sorted({label for notice, label, _ in NOTICES if notice in found}))
    assert got[7]["labels"] == "gpl" and got[7]["n_base"] == 0 and got[15]["labels"] == "mit"
    assert licenses.find_notices(df.where("false")).collect() == []


def test_license_spans_point_into_the_text(spark):
    text = "Ü. Released under the GNU General  Publik-License, 1999"
    (span,) = licenses.find_notices(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]["spans"]
    assert text[span["start"] : span["end"]] == "GNU General  Publik-License" and span["errors"] == 1
