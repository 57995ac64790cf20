r"""Removal of passages that repeat: windows grouped by minimizer and hashes, in place of a radix sort of suffixes.

Two suffixes fall into one group of a radix sort that stops after `length` bytes exactly if their first `length` bytes
are equal, so groups of two or more are the repeated windows. No suffix is ordered here: the same groups, but for collisions
of hashes, are found in three passes, called digits below. After each only suffixes in groups of two or more go on:

1. Anchor. The first digit of a window is its anchor: the `anchor`-byte string within it whose hash is least (of equal
   ones the first). Equal windows have equal anchors at equal places. Neighbouring windows mostly share one anchor
   occurrence, so this pass sorts ranges of windows, one row for about a hundred bytes.
2. Range. The second digit is the content of all bytes that a range covers. Ranges that are equal in it hold equal windows
   throughout, and are settled; if all ranges of an anchor are equal, so is the anchor.
3. Window. Where ranges of one anchor differ, the third digit is the rest of each window, byte position by byte position. Of
   equal ranges one takes part for all. The bytes of an anchor's ranges are put together in one task and their windows compared
   there; of an anchor with more than `most_kinds` different ranges each window is a row that goes by its own hash.

Digits are compared as hashes of 64 bits; windows that are taken for equal agree in two of them, that of their anchor and that
of their content. What a task can settle among its own rows it settles first, and passes on one row for all: a
passage that is in a third of the documents gives each later pass a row for each task, not for each document.

The text is read twice from the input. Anchors that repeat go into a Bloom filter of at most `BLOOM_BYTES` that the second
reading uses to leave out, ahead of any shuffle, ranges and whole texts that have no repeated anchor; it never leaves
out one that has. Texts that may hold repeats are written to the shared folder with an id of their own.

Passages of fewer bytes than a window are reported, not removed: n_shared counts strings of `phrase` words that the text has in
common with other texts. Of every `passage - phrase + 1` neighbouring strings of that many words one is chosen, the one of least
hash, so that a passage of `passage` words or more that two texts share always counts, and nothing shorter than `phrase` words does.
These strings go the way of the anchors, in the same two readings. A word of more than CHUNK bytes counts as several.

Defined results: a null or empty text has 0 bytes, and nothing is removed. Texts shorter than `length` are never changed.
Rows that repeat a text, or a doc_id, count as texts each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of, table

LENGTH, ANCHOR = 400, 200
#: Bytes hashed at a time; windows of longer texts are taken in stretches.
CHUNK = 1 << 20
BLOOM_BYTES, BLOOM_HASHES = 64 << 20, 4
PASSAGE, PHRASE = 50, 40
#: Up to so many kinds of ranges of one anchor are compared in one task.
MOST_KINDS = 2000


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of substrings: sums of random values of the bytes, times powers of an odd number, modulo 2^64."""

    def __init__(self, seed: int, most: int = CHUNK + 4096):
        r = np.random.default_rng(seed)
        self.values = r.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(r.integers(0, 1 << 62)) * 4 + 3
        self.up, self.down = self.powers(base, most), self.powers(pow(base, -1, 1 << 64), most)

    @staticmethod
    def powers(base: int, most: int) -> np.ndarray:
        out = np.full(most, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Of every substring of that length."""
        n = len(sums) - length
        return mixed((sums[length:] - sums[:n]) * self.down[:n])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours: of the suffix of one stretch of that width and the prefix of the next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(padded, axis=1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def stretches(texts: list[bytes], length: int):
    """Lists of (text's number, first byte, bytes) that hold at most CHUNK bytes and each window of each text once."""
    out, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), CHUNK - length + 1):
            part = text[at : at + CHUNK]
            if size + len(part) > CHUNK:
                yield out
                out, size = [], 0
            out.append((k, at, part))
            size += len(part)
    if out:
        yield out


def ranges(texts: list[bytes], roll: Rolling, length: int, anchor: int):
    """Ranges of window starts with one anchor: yields arrays text's number, first start, last start, hash of the anchor, hash of the content."""
    for some in stretches(texts, length):
        data = np.frombuffer(b"".join(s for _, _, s in some), np.uint8)
        sizes = np.array([len(s) for _, _, s in some])
        ends = np.cumsum(sizes)
        sums = roll.sums(data)
        grams = roll.windows(sums, anchor)
        place = np.uint64((1 << 21) - 1)
        order = grams & ~place | np.arange(len(grams), dtype=np.uint64)
        at_least = (least_in_windows(order, length - anchor + 1) & place).astype(np.int64)
        start = np.concatenate([np.arange(e - n, e - length + 1) for e, n in zip(ends, sizes, strict=True)])
        at = at_least[start]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
        last = np.append(first[1:], len(start)) - 1
        lo, hi, at = start[first], start[last], at[first]
        content = mixed((sums[hi + length] - sums[lo]) * roll.down[lo])
        content = mixed(content ^ (at - lo).astype(np.uint64) << np.uint64(40) ^ (hi - lo).astype(np.uint64))
        of = np.searchsorted(ends, lo, side="right")
        shift = np.array([a for _, a, _ in some])[of] - (ends - sizes)[of]
        yield np.array([k for k, _, _ in some])[of], lo + shift, hi + shift, grams[at] & ~np.uint64(1), content


def word_stretches(texts: list[bytes], passage: int):
    """Lists of (text's number, bytes) that hold at most about CHUNK bytes, whole words, and any `passage` neighbouring words of a text together."""
    out, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            part = text[at : at + CHUNK]
            if at + len(part) < len(text):
                last = max(part.rfind(c) for c in b" \t\n\v\f\r")
                part = part[:last] if last > 0 else part
                tail = part.rsplit(None, passage - 1)
                step = len(tail[0]) if len(tail) == passage and tail[0] else len(part)
            else:
                step = len(part)
            if size + len(part) > CHUNK and out:
                yield out
                out, size = [], 0
            out.append((k, part))
            size += len(part) + 1
            if at + len(part) >= len(text):
                break
            at += step
    if out:
        yield out


IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def phrases(texts: list[bytes], roll: Rolling, passage: int = PASSAGE, phrase: int = PHRASE):
    """The chosen strings of `phrase` words of each text: yields arrays text's number, hash, each pair once in an array."""
    for some in word_stretches(texts, passage):
        data = np.frombuffer(b"\n" + b"\n".join(t for _, t in some) + b"\n", np.uint8)
        edges = np.flatnonzero(np.diff(IS_SPACE[data].view(np.int8)))
        begin, end = edges[::2] + 1, edges[1::2] + 1
        if len(begin) < passage:
            continue
        sums = roll.sums(data)
        words = mixed((sums[end] - sums[begin]) * roll.down[begin]) + mixed((end - begin).astype(np.uint64))
        upto = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * roll.up[: len(words)], out=upto[1:])
        strings = roll.windows(upto, phrase)
        place = np.uint64((1 << 21) - 1)
        order = strings & ~place | np.arange(len(strings), dtype=np.uint64)
        least = (least_in_windows(order, passage - phrase + 1) & place).astype(np.int64)
        of = np.searchsorted(np.cumsum([len(t) + 1 for _, t in some]), begin, side="left")
        at = np.unique(least[of[: len(least)] == of[passage - 1 :]])
        pairs = np.unique(np.stack([np.array([k for k, _ in some], np.uint64)[of[at]], strings[at] | np.uint64(1)]), axis=1)
        yield pairs[0].astype(np.int64), pairs[1]


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def repeated_anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """docs: text. Returns the hashes of anchors (even) that occur twice or more, and of chosen strings of words (odd) that two texts or more have."""

    def kernel(batches):
        import pyarrow as pa

        roll = Rolling(1)
        for _, (texts,) in rows_of(batches):
            bodies = encoded(texts)
            for g in chain((g for _, _, _, g, _ in ranges(bodies, roll, length, anchor)), (g for _, g in phrases(bodies, roll))):
                found, times = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], names=["g", "n"])

    rows = docs.select("text").mapInArrow(kernel, "g long, n int")
    return materialize(rows.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "anchors")


def bloom_bits(g: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places in a filter of a power of two of bits."""
    shift = np.uint64(64 - bits.bit_length() + 1)
    return [(mixed(g + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)) >> shift for k in range(BLOOM_HASHES)]


def bloom(anchors: DataFrame) -> np.ndarray:
    """A filter of eight bits or more for each anchor, but of at most BLOOM_BYTES, whatever their number."""
    n = anchors.count()
    bits = min(BLOOM_BYTES * 8, max(1 << 16, 1 << (8 * n).bit_length()))

    def kernel(batches):
        import pyarrow as pa

        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in bloom_bits(g, bits):
                np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own[used].view(np.int64))], names=["word", "bits"])

    found = anchors.mapInArrow(kernel, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def maybe_in(filtered: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.ones(len(g), bool)
    for at in bloom_bits(g, len(filtered) * 64):
        out &= filtered[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1
    return out


STORED = "n_bytes long, kept_sha256 string, uid long, body binary, g array<long>, c array<long>, lo array<long>, hi array<long>, said array<long>"


def stored(docs: DataFrame, filtered: np.ndarray, length: int, anchor: int) -> DataFrame:
    """docs: doc_id, text. A row for each: done (with kept_sha256), or with body and the ranges whose anchors may repeat; said: chosen strings that may be in other texts."""
    shared = docs.sparkSession.sparkContext.broadcast(filtered)  # at most BLOOM_BYTES

    def kernel(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        roll, uid = Rolling(1), TaskContext.get().partitionId() << 36
        for part, (_, texts) in rows_of(batches):
            bodies = encoded(texts)
            hits: list[list[tuple]] = [[] for _ in bodies]
            for k, lo, hi, g, c in ranges(bodies, roll, length, anchor):
                keep = np.flatnonzero(maybe_in(shared.value, g))
                for row in zip(k[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), g[keep].view(np.int64).tolist(), c[keep].view(np.int64).tolist(), strict=True):
                    hits[row[0]].append(row[1:])
            said: list[list[int]] = [[] for _ in bodies]
            for k, g in phrases(bodies, roll):
                keep = np.flatnonzero(maybe_in(shared.value, g))
                for n, x in zip(k[keep].tolist(), g[keep].view(np.int64).tolist(), strict=True):
                    said[n].append(x)
            rows = []
            for body, found, strings in zip(bodies, hits, said, strict=True):
                strings = list(set(strings)) or None  # stretches of a long text overlap
                if found:
                    lo, hi, g, c = map(list, zip(*found, strict=True))
                    rows.append((len(body), None, uid, body, g, c, lo, hi, strings))
                else:
                    rows.append((len(body), hashlib.sha256(body).hexdigest(), uid, None, None, None, None, None, strings))
                uid += 1
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), longs, longs, longs, longs, longs]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *[f.split()[0] for f in STORED.split(", ")]])

    return materialize(docs.mapInArrow(kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, {STORED}"), "texts")


def settled_ranges(texts: DataFrame, most_kinds: int = MOST_KINDS) -> DataFrame:
    """Ranges whose anchor repeats: uid, g, lo, hi, whole (all its windows repeat), ask (its windows are to be compared), hot (its anchor has more than most_kinds kinds)."""
    hits = texts.where("body is not null").select("uid", F.explode(F.arrays_zip("g", "c", "lo", "hi")).alias("r")).select("uid", "r.*")
    alike = hits.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "lo")).alias("one"))
    alike = materialize(alike, "kinds")
    anchors = alike.groupBy("g").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    # Anchors meet kinds of ranges, not ranges, and what comes of that is written: the join of single ranges, of which a text that
    # repeats itself has many of a kind, then has a plain exchange on both sides, and Spark can split a hot kind.
    known = materialize(alike.join(anchors, "g").select("g", "c", "n", "one", "kinds"), "known-kinds")
    joined = hits.join(known, ["g", "c"])
    return materialize(joined.select(
        "uid", "g", "lo", "hi", (F.col("n") > 1).alias("whole"),
        ((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("one") == F.struct("uid", "lo")))).alias("ask"), (F.col("kinds") > most_kinds).alias("hot"),
    ), "ranges")


def window_hashes(roll: Rolling, body: np.ndarray, lo: int, hi: int, length: int):
    """Hashes of the windows that start from lo to hi, a stretch at a time."""
    for at in range(lo, hi + 1, CHUNK):
        last = min(hi, at + CHUNK - 1)
        yield roll.windows(roll.sums(body[at : last + length]), length)


def equal_windows(g: np.ndarray, w: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window has an equal among these, or one that is sure; and which windows are the first of equals (a sure one, if any)."""
    order = np.lexsort((~sure, g, w))
    new = np.append(True, (w[order][1:] != w[order][:-1]) | (g[order][1:] != g[order][:-1]))[: len(w)]
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    many = np.diff(np.append(first, len(new)))[group] > 1
    repeats, firsts = np.empty_like(sure), np.empty_like(sure)
    repeats[order], firsts[order] = many | sure[order][first[group]], new
    return repeats, firsts


def compared_ranges(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """uid, lo, hi of repeated windows in the ranges that were to be compared and aren't settled; for anchors of few kinds of ranges.

    The bytes that a range covers go to its anchor's task, where its windows are compared with those of the others.
    """
    rows = texts.where("body is not null").select("uid", "body").join(asked_ranges(found.where("ask and not hot")), "uid")

    def cut(batches):
        import pyarrow as pa

        for _, (uids, bodies, asks) in rows_of(batches):
            rows = [(r["g"], u, r["lo"], r["whole"], body[r["lo"] : r["hi"] + length]) for u, body, some in zip(uids, bodies, asks, strict=True) for r in some]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["g", "uid", "lo", "whole", "covered"])

    cuts = rows.mapInArrow(cut, "g long, uid long, lo long, whole boolean, covered binary").repartition("g").sortWithinPartitions("g", "uid", "lo")

    def compare(batches):
        import pyarrow as pa

        roll = Rolling(2)

        def runs_of(rows):
            g, w, uid, pos, sure = [], [], [], [], []
            for anchor, u, lo, whole, covered in rows:
                n = len(covered) - length + 1
                w += window_hashes(roll, np.frombuffer(covered, np.uint8), 0, n - 1, length)
                for out, value in ((g, anchor), (uid, u)):
                    out.append(np.full(n, value, np.int64))
                pos.append(np.arange(lo, lo + n))
                sure.append(np.full(n, whole, bool))
            g, w, uid, pos, sure = np.concatenate(g), np.concatenate(w).view(np.int64), np.concatenate(uid), np.concatenate(pos), np.concatenate(sure)
            known = equal_windows(g, w, sure)[0] & ~sure
            return pa.RecordBatch.from_arrays([pa.array(c) for c in joined_runs(uid[known], pos[known])], names=["uid", "lo", "hi"])

        held: list[tuple] = []
        for _, columns in rows_of(batches, 1024):
            held += zip(*columns, strict=True)
            last = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)
            if last:  # all but the last anchor are whole
                yield runs_of(held[:last])
                held = held[last:]
        if held:
            yield runs_of(held)

    return cuts.mapInArrow(compare, "uid long, lo long, hi long")


def asked_ranges(found: DataFrame) -> DataFrame:
    return found.groupBy("uid").agg(F.collect_list(F.struct("g", "lo", "hi", "whole")).alias("asked"))


def compared_windows(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """As compared_ranges, for anchors of any number of kinds: each window goes its own way."""
    rows = texts.where("body is not null").select("uid", "body").join(asked_ranges(found.where("ask and hot")), "uid")

    def kernel(batches):
        import pyarrow as pa

        roll = Rolling(2)
        for _, (uids, bodies, asks) in rows_of(batches):
            g, w, uid, pos, sure = [], [], [], [], []
            for u, body, some in zip(uids, bodies, asks, strict=True):
                data = np.frombuffer(body, np.uint8)
                for r in some:
                    n = r["hi"] - r["lo"] + 1
                    w += window_hashes(roll, data, r["lo"], r["hi"], length)
                    g.append(np.full(n, r["g"], np.int64))
                    uid.append(np.full(n, u, np.int64))
                    pos.append(np.arange(r["lo"], r["hi"] + 1))
                    sure.append(np.full(n, r["whole"], bool))
            g, w, uid, pos, sure = np.concatenate(g), np.concatenate(w).view(np.int64), np.concatenate(uid), np.concatenate(pos), np.concatenate(sure)
            # One of equal windows goes on for all of this slice; those that needed to know have it. In the order of the texts, as neighbours compress well.
            repeats, go = equal_windows(g, w, sure)
            known = repeats & ~sure
            runs = joined_runs(uid[known], pos[known])
            info = pos * 4 + (repeats | sure) * 2 + ~(repeats | sure)
            columns = [
                np.concatenate([g[go], mixed(runs[0].view(np.uint64) + runs[1].view(np.uint64)).view(np.int64)]), np.concatenate([w[go], runs[1]]),
                np.concatenate([uid[go], runs[0]]), np.concatenate([pos[go], runs[1]]), np.concatenate([info[go], runs[2] * 4 + 3]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "w", "uid", "lo", "info"])

    # info: the last start, whether the window is known to repeat, and whether its text needs to be told.
    windows = rows.mapInArrow(kernel, "g long, w long, uid long, lo long, info long")
    equal, sure, need = Window.partitionBy("g", "w"), F.col("info").bitwiseAND(2) > 0, F.col("info").bitwiseAND(1) > 0
    counted = windows.withColumns({"times": F.count(F.lit(1)).over(equal), "any_sure": F.max(sure).over(equal)})
    return counted.where(need & ((F.col("times") > 1) | F.col("any_sure"))).select("uid", "lo", F.shiftright("info", 2).alias("hi"))


def joined_runs(uid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring positions as runs: uid, first, last."""
    order = np.lexsort((pos, uid))
    uid, pos = uid[order], pos[order]
    first = np.flatnonzero(np.append(True, (uid[1:] != uid[:-1]) | (pos[1:] != pos[:-1] + 1))) if len(uid) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(uid)) - 1 if len(uid) else first
    return uid[first], pos[first], pos[last]


def spans_of(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in the given ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = True, most_kinds: int = MOST_KINDS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, and with_text kept (the bytes that remain; null where nothing was removed)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    anchors = repeated_anchors(rows, length, anchor)
    texts = stored(rows, bloom(anchors), length, anchor)
    said = texts.where("said is not null").select("uid", F.explode("said").alias("g"))
    counts = said.join(anchors.where("g & 1 = 1"), "g").groupBy("uid").agg(F.count(F.lit(1)).alias("n_shared"))
    found = settled_ranges(texts, most_kinds)
    starts = found.where("whole").select("uid", "lo", "hi").unionByName(compared_ranges(texts, found, length))
    if not found.where("ask and hot").isEmpty():
        starts = starts.unionByName(compared_windows(texts, found, length))
    counts = materialize(counts, "shared")
    starts = starts.unionByName(counts.select("uid", F.lit(-1).cast("long").alias("lo"), F.col("n_shared").alias("hi")))
    removed = starts.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    open_texts = texts.where("body is not null").select("doc_id", "uid", "body").join(removed, "uid", "left").select("doc_id", "body", "starts")

    def kernel(batches):
        import pyarrow as pa

        for part, (_, bodies, all_starts) in rows_of(batches):
            out = []
            for body, some in zip(bodies, all_starts, strict=True):
                spans = spans_of([(s["lo"], s["hi"]) for s in some or () if s["lo"] >= 0], length)
                shared = sum(s["hi"] for s in some or () if s["lo"] < 0)
                kept = without(body, spans)
                out.append((len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), shared, kept if spans else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: 5 + with_text]
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"][: 6 + with_text])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + ", kept binary" * with_text
    zero = F.lit(0).cast("long")
    done = texts.where("body is null").join(counts.withColumnRenamed("uid", "of"), F.col("uid") == F.col("of"), "left")
    done = done.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.coalesce("n_shared", zero).alias("n_shared"), *([F.lit(None).cast("binary").alias("kept")] if with_text else []))
    return done.unionByName(open_texts.mapInArrow(kernel, schema))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
