"""Sum-of-squares online packing of tokenised documents into windows.

Each document (its ids, then an end id) longer than a window gives full windows of its own first; what is left is
placed online: of all fill levels at which it fits, and a new window, the one that makes the sum of squared counts of
partially filled windows smallest. The counts are held in an array by level. A window that becomes full is written.

Every task packs what it reads. The pieces of windows that are open at its end are not done: tasks' remainders are put
together, in the order of tasks, to pools of about `pool` tokens, and each pool goes on placing them by sum of squares. What is
open at the end of a pool is put together to pools once more (`ROUNDS`). Only what is open at the end of the last round is closed: its
pieces are laid end to end and cut every `window` ids, and the last stretch is cut into powers of two, largest first, which need no
padding. A pool is of whole remainders, and has as many windows open as these need: its size in tokens is what bounds it. A task, which reads on
without a bound, hands over the windows that are open when there are `MOST_OPEN`, and begins anew. Every id lies in exactly one piece.

Sequence ids are numbered within the task or pool and carry its number, so that one that runs again gives the same. What
the tasks packed is written to the shared folder before pools are formed.

Tokens come from a public tokenizer whose path is a parameter. Where the tokenizer is of the kind known here (lower-cased
words, digits and other runs, white space never joined), the ids of a text are those of its pieces one after the other, and
each task keeps the ids of pieces it has seen, up to a bound; every other tokenizer gets whole texts.

Defined results: a null or empty text is the end id alone. Rows that repeat are packed as documents of their own. An
empty table gives no pieces. A null doc_id is packed like any other. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of, table

WINDOW, END_ID = 4096, 2
#: Pieces whose ids a task keeps, windows that a task may have open, tokens that make a pool, and rounds of pools.
KNOWN_PIECES, MOST_OPEN, POOL, ROUNDS = 300_000, 4096, 16 << 20, 2
#: Texts of these characters are cut into the tokenizer's own pieces here, as it would: lower-cased, then letters, single
#: digits, and runs of others, white space between. Each of these letters is a letter to the tokenizer, normalised as it
#: stands, and so is its lower case: capitals whose lower case lies beyond ɏ (Ə, Ɛ, Ɔ) go through the whole tokenizer.
LETTER = "[a-zß-öø-ɏ]"
PIECE = re.compile(rf"{LETTER}++|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ɏ0-9\t-\r ]++")
PLAIN = re.compile(rf"[\t-\r -~{''.join(c for c in map(chr, range(0xC0, 0x250)) if re.fullmatch(LETTER, c.lower()))}]*")


#: Byte-level tokenizers write a byte as a letter: itself where it is a visible character of Latin-1, else the next one from 256 on.
SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) for b in SEEN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(SEEN)))}


#: The kind of tokenizer whose pieces are cut here.
KIND = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def is_known_kind(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = {"normalizer": "normalizers", "pre_tokenizer": "pretokenizers"}
    plain = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
    return plain and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"] and all((spec[k] or {}).get(v) == KIND[k] for k, v in steps.items())


class Numbers(dict):
    """Pieces and their numbers. One that isn't known gets the next number and is noted as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class WordIds:
    """Ids of texts: known pieces are looked up, new ones encoded once. Of a text with other characters, words (between white space) that have such are encoded whole."""

    def __init__(self, path: str, most: int = KNOWN_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.cuts = Tokenizer.from_file(path), most, is_known_kind(path)
        self.forget()

    def forget(self) -> None:
        """Pieces are numbered; the ids of all lie in one array, so that a piece takes little more than its text."""
        self.known, self.whole = Numbers(), set()
        self.flat, self.starts, self.sizes = np.zeros(1024, np.uint32), np.zeros(256, np.int32), np.zeros(256, np.int32)
        self.used = 0

    def ids_of(self, parts: list[str]) -> list[list[int]]:
        """Pieces go to the tokenizer's model as they are, written in its letters for bytes; whole words through the whole tokenizer."""
        tokenize, whole, out = self.tokenizer.model.tokenize, self.whole, []
        for p in parts:
            if p in whole:
                out.append(self.tokenizer.encode(p, add_special_tokens=False).ids)
            else:
                out.append([t.id for t in tokenize(p if p.isascii() else "".join([LETTERS[b] for b in p.encode()]))])
        return out

    def cut(self, text: str) -> list[str]:
        """Pieces of plain text, and words that are not plain: a piece has no such characters, so the two never meet in one string."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return PIECE.findall(text.lower())
        parts = []
        for word in re.split(r"[\t-\r ]+", text):
            if PLAIN.fullmatch(word) and "<|" not in word:
                parts += PIECE.findall(word.lower())
            else:
                self.whole.add(word)
                parts.append(word)
        return parts

    def learn(self) -> None:
        new, self.known.new = self.known.new, []
        n = len(self.known) - len(new)
        for at in range(0, len(new), 4096):
            some = self.ids_of(new[at : at + 4096])
            sizes = np.fromiter(map(len, some), np.int32, len(some))
            total = int(sizes.sum())
            self.flat, self.starts, self.sizes = room(self.flat, self.used + total), room(self.starts, n + len(some)), room(self.sizes, n + len(some))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(some), np.uint32, total)
            self.starts[n : n + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(some)] = sizes
            self.used += total
            n += len(some)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.cuts:
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts]
        if len(self.known) > self.most:
            self.forget()
        number_of, numbers = self.known.__getitem__, []
        for t in texts:
            parts = self.cut(t) if t else []
            numbers.append(np.fromiter(map(number_of, parts), np.int32, len(parts)))
        self.learn()
        out = []
        for number in numbers:
            sizes = self.sizes[number]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[number] - ends + sizes, sizes)])
        return out


def room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, twice as long as often as needed to hold size."""
    while size > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class Packer:
    """Windows by sum of squares. write(pieces) gets the pieces of a finished window: (key, start, ids, whole length). At the end, and beyond most_open open windows if that is given,
    hand_over(pieces) gets those of all that are open (default: they are laid)."""

    def __init__(self, write, window: int = WINDOW, most_open: int | None = None, hand_over=None):
        self.write, self.window, self.most_open, self.hand_over = write, window, most_open, hand_over or self.lay
        self.counts = np.zeros(window + 1, np.int64)  # open windows by fill level
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def add(self, key, ids: np.ndarray) -> None:
        whole = len(ids)
        full = whole // self.window * self.window
        for at in range(0, full, self.window):
            self.write([(key, at, ids[at : at + self.window], whole)])
        if full < whole:
            self.place((key, full, ids[full:].copy(), whole))

    def place(self, piece) -> None:
        size = len(piece[2])
        level = self.best_level(size)
        pieces = []
        if level:
            self.counts[level] -= 1
            self.n_open -= 1
            pieces = self.open[level].pop()
        pieces.append(piece)
        fill = level + size
        if fill == self.window:
            self.write(pieces)
            return
        self.counts[fill] += 1
        self.n_open += 1
        self.open.setdefault(fill, []).append(pieces)
        if self.most_open and self.n_open > self.most_open:
            self.close()

    def best_level(self, size: int) -> int:
        """The level, 0 for a new window, that leaves the least sum of squares; of equal ones the fullest."""
        counts, last = self.counts, self.window - size
        levels = np.flatnonzero(counts[1 : last + 1]) + 1
        if not len(levels):
            return 0
        # Half the change in the sum is counts[after] - counts[before] + 1; a full window leaves the sum, a new one enters it.
        change = 2 * (counts[levels + size] - counts[levels]) + 2
        if levels[-1] == last:
            change[-1] = 1 - 2 * counts[last]
        k = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[k]) if change[k] <= 2 * counts[size] + 1 else 0

    def close(self) -> None:
        """End all open windows, the fullest first: their pieces are handed over."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        if pieces:
            self.hand_over(pieces)

    def lay(self, pieces: list) -> None:
        """Write pieces end to end, cut at every full window, the rest at powers of two."""
        left = sum(len(p[2]) for p in pieces)
        room, now = 0, []
        for key, start, ids, whole in pieces:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                take = min(room, len(ids) - at)
                now.append((key, start + at, ids[at : at + take], whole))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self.write(now)
                    now = []


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def as_bytes(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where that is enough, else in four."""
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def as_ids(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * length else "<u4")


class Rows:
    """Pieces as rows of FIELDS, and left: the ids of pieces that are handed over, as bytes. first is the first sequence id."""

    def __init__(self, first: int, with_ids: bool):
        self.next, self.with_ids, self.rows, self.handed = first, with_ids, [], 0

    def write(self, pieces: list) -> None:
        offset = 0
        for key, start, ids, whole in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((key, start, len(ids), crc, whole, self.next, offset, ids.astype(np.int32) if self.with_ids else None, None))
            offset += len(ids)
        self.next += 1

    def hand_over(self, pieces: list) -> None:
        """Open pieces: no sequence id, and their place in the order of handing over as offset."""
        self.rows += [(key, start, len(ids), 0, whole, None, self.handed + k, None, as_bytes(ids)) for k, (key, start, ids, whole) in enumerate(pieces)]
        self.handed += len(pieces)

    def taken(self, key_type, size: int | None = None, **more):
        """The first `size` rows (default: all) as an Arrow batch; more: constant columns."""
        import pyarrow as pa

        rows, self.rows = self.rows[:size], self.rows[size:] if size else []
        kinds = [key_type, *[pa.int64()] * 6, pa.list_(pa.int32()), pa.binary()]
        arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        arrays += [pa.array(np.full(len(rows), v, np.int64)) for v in more.values()]
        return pa.RecordBatch.from_arrays(arrays, names=[*FIELDS, "left", *more])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, pool: int = POOL, most_open: int = MOST_OPEN, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, left binary"

    def in_tasks(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        words, out, key_type = WordIds(tokenizer), Rows(task << 36, with_ids), None
        packer = Packer(out.write, window, most_open, out.hand_over)
        for part, (ids, texts) in rows_of(batches, 128):
            key_type = part.column(0).type
            for key, tokens in zip(ids, words.encode(texts), strict=True):
                packer.add(key, np.append(tokens, np.uint32(end_id)))
            if len(out.rows) >= 256:
                yield out.taken(key_type, task=task)
        packer.close()
        while out.rows:
            yield out.taken(key_type, 256, task=task)

    def in_pools(turn: int):
        """Rows sorted by pool, task and offset; a pool's windows are closed where the next one begins, in the last round for good."""
        names = ["pool", "doc_id", "start", "doc_tokens", "length", "left"]

        def kernel(batches):
            number, out, packer, key_type = None, None, None, None

            def finished():
                packer.close()
                while out.rows:
                    yield out.taken(key_type, 256, task=number)

            for batch in batches:
                key_type = batch.column("doc_id").type
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for of, key, start, whole, length, left in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                        if of != number:
                            if packer:
                                yield from finished()
                            number, out = of, Rows((1 << 62) + (turn << 59) + (of << 36), with_ids)
                            packer = Packer(out.write, window, hand_over=None if turn == rounds - 1 else out.hand_over)
                        packer.place((key, start, as_ids(left, length), whole))
                    if len(out.rows) >= 256:
                        yield out.taken(key_type, task=number)
            if packer:
                yield from finished()

        return kernel

    packed = materialize(rows.mapInArrow(in_tasks, f"{schema}, task long"), "packed")
    done = packed.where("sequence_id is not null").select(*FIELDS)
    for turn in range(rounds):
        open_pieces = packed.where("sequence_id is null")
        sizes = open_pieces.groupBy("task").agg(F.sum("length").alias("size"))  # a row for each task or pool
        before = F.sum("size").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
        # Written, so that its size is known: if it is small it is broadcast, and remainders are shuffled once.
        pools = materialize(sizes.select(F.col("task").alias("of"), F.floor(F.coalesce(before, F.lit(0)) / pool).cast("long").alias("pool")), "pools")
        placed = open_pieces.join(pools, F.col("task") == F.col("of")).select("pool", "task", "offset", "doc_id", "start", "doc_tokens", "length", "left")
        pooled = placed.repartition("pool").sortWithinPartitions("pool", "task", "offset").mapInArrow(in_pools(turn), f"{schema}, task long")
        packed = pooled if turn == rounds - 1 else materialize(pooled, "pooled")
        done = done.unionByName(packed.where("sequence_id is not null").select(*FIELDS))
    return done.select(*FIELDS[: 7 + with_ids])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
