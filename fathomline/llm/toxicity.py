"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a word: an embedding of the word, and the mean of embeddings of its character n-grams (2 to 4, with marks at
both ends; both embeddings are looked up by hash). Two gated recurrent layers read a window of `WINDOW` words in either
direction, attention pools their states, and a logistic unit gives the window's logit. Windows start every `STRIDE`
words and cover the whole text; the score of a text comes from its largest logits by a logistic fit.

Training: of the labelled documents at most `most` (MOST_DOCS) of each label are used (least hash of the id first; of rows that
repeat an id the one with the least text), and of each at most `most_windows` (MOST_WINDOWS, by label) windows, spread over the
whole text by a seeded draw; these parameters bound what the driver gets, at every size of the input. Windows of a
toxic document count as toxic in the first epoch; then only those of them go on that look most toxic. A quarter of the
chosen documents is kept from the network: the logistic fit is made on all of their windows (if that quarter lacks a label,
the largest logit is taken as it is, shifted by the odds of the labels). Documents whose
crc32(doc_id as text) mod 4 is 2 are held out. Only the text enters a score.

Scoring needs no shuffle. A task computes the input of each different word once and keeps up to `KNOWN_WORDS`.

Defined results: a null or empty text is one window without words. Without labelled documents of both labels all scores
are 0. Rows that repeat have a row each; repeated labels of a document count once, as their maximum. A null doc_id is
scored, and counts as the text "null" for being held out. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import batched

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, rows_of, table

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN, ATTENTION = 1 << 14, 1 << 15, 8, 8, 8
MOST_DOCS, MOST_WINDOWS, EPOCHS, BATCH, SEED = 2000, {1: 16, 0: 10}, 4, 256, 7
#: Words and n-grams in fewer training documents than this share one row: what is rare would be learnt by heart.
LEAST_DOCS = 4
#: After the first epoch, this share of a toxic document's windows goes on as toxic: those with the largest logits.
LIKELY = 0.3
#: With few windows there are more epochs.
LEAST_STEPS = 400
KNOWN_WORDS, THRESHOLD = 100_000, 0.3
EDGES = ".,;:!?\"'()[]{}«»„“”‘’…–—-*_"


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the word embedding; rows of the n-gram embedding, flat; where each word's n-grams begin."""
    bare = [w.lower().strip(EDGES) or w for w in words]
    flat = np.frombuffer(("".join(f"\x02{w}\x03" for w in bare)).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in bare), np.int64, len(bare))
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(bare)), sizes)
    grams, owners = [], []
    code = flat.copy()
    for n in range(1, 5):
        if n > 1:
            code = mixed(code[:-1] * np.uint64(31) + flat[n - 1 :])
            inside = of[: len(code)] == of[n - 1 :]
            grams.append(code[inside] % np.uint64(CHAR_ROWS))
            owners.append(of[: len(code)][inside])
    grams, owners = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    weights = mixed(flat + mixed(np.arange(len(flat), dtype=np.uint64) - starts[of].astype(np.uint64)))
    word = np.add.reduceat(weights, starts) % np.uint64(WORD_ROWS)
    counts = np.bincount(owners, minlength=len(bare))
    return word.astype(np.int64), grams[order], np.cumsum(counts) - counts


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, by=0.3: (r.standard_normal(s) * by).astype(np.float32)
    p = {"words": f(WORD_ROWS, WIDTH, by=0.1), "grams": f(CHAR_ROWS, WIDTH, by=0.1), "A": f(2 * HIDDEN, ATTENTION), "v": f(ATTENTION), "w": f(2 * HIDDEN), "b": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"W{d}": f(2 * WIDTH, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": f(HIDDEN, 3 * HIDDEN)}
    return p


def recurrent(x: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: bool):
    """x: time, window, 3 * HIDDEN. Returns the states, and with keep what the gradient needs."""
    times, n, h = x.shape[0], x.shape[1], HIDDEN
    states, state, kept = np.empty((times, n, h), np.float32), np.zeros((n, h), np.float32), {}
    for t in range(times - 1, -1, -1) if backward else range(times):
        inner = state @ u
        gates = 1 / (1 + np.exp(-(x[t, :, : 2 * h] + inner[:, : 2 * h])))
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * inner[:, 2 * h :])
        if keep:
            kept[t] = (state, z, r, new, inner[:, 2 * h :])
        state = (new + z * (state - new)) * mask[t][:, None]
        states[t] = state
    return states, kept


def pooled(p: dict, states: np.ndarray, mask: np.ndarray):
    """states: time, window, 2 * HIDDEN. Returns logits, attention, pooled states and the attention's inner layer."""
    m = np.tanh(states @ p["A"])
    s = np.where(mask > 0, m @ p["v"], np.float32(-1e9))
    a = np.exp(s - s.max(axis=0))
    a = a * mask
    a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
    c = np.einsum("tn,tnh->nh", a, states)
    return c @ p["w"] + p["b"][0], a, c, m


def gradient(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean cross entropy; x: time, window, 2 * WIDTH."""
    times, n, _ = x.shape
    out, kept = {}, {}
    for d in "fb":
        out[d], kept[d] = recurrent(x @ p[f"W{d}"] + p[f"c{d}"], mask, p[f"U{d}"], d == "b", True)
    states = np.concatenate([out["f"], out["b"]], axis=2)
    logits, a, c, m = pooled(p, states, mask)
    dl = ((sigmoid(logits) - y) / n).astype(np.float32)
    g = {"w": c.T @ dl, "b": dl.sum(keepdims=True)}
    dc = dl[:, None] * p["w"]
    da = np.einsum("nh,tnh->tn", dc, states)
    ds = a * (da - (a * da).sum(axis=0))
    g["v"] = ds.ravel() @ m.reshape(-1, m.shape[2])
    dm = ds[:, :, None] * p["v"] * (1 - m * m)
    g["A"] = states.reshape(-1, 2 * HIDDEN).T @ dm.reshape(-1, dm.shape[2])
    dstates = a[:, :, None] * dc + dm @ p["A"].T
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        u, h = p[f"U{d}"], HIDDEN
        du, dgates, dh = np.zeros_like(u), np.empty((times, n, 3 * h), np.float32), np.zeros((n, h), np.float32)
        for t in range(times) if d == "b" else range(times - 1, -1, -1):
            before, z, r, new, inner = kept[d][t]
            dnew_state = (dstates[t, :, k * h : (k + 1) * h] + dh) * mask[t][:, None]
            dz = dnew_state * (before - new) * z * (1 - z)
            dn = dnew_state * (1 - z) * (1 - new * new)
            dr = dn * inner * r * (1 - r)
            dgates[t, :, :h], dgates[t, :, h : 2 * h], dgates[t, :, 2 * h :] = dz, dr, dn
            di = np.concatenate([dz, dr, dn * r], axis=1)
            du += before.T @ di
            dh = dnew_state * z + di @ u.T
        g[f"U{d}"], g[f"c{d}"] = du, dgates.sum(axis=(0, 1))
        g[f"W{d}"] = x.reshape(-1, x.shape[2]).T @ dgates.reshape(-1, 3 * h)
        dx += dgates @ p[f"W{d}"].T
    return g, dx


def kept_rows(rows: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Rows of an embedding; those that are not kept are row 0."""
    return np.where(kept[rows], rows, 0)


def often(words: np.ndarray, docs: np.ndarray, word: np.ndarray, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of either embedding occur in at least that many documents; words and docs: what occurs where. A few documents at a time, to keep memory small."""
    found = np.unique(docs * len(word) + words)
    docs, words = found // len(word), found % len(word)
    times = np.zeros(WORD_ROWS, np.int64), np.zeros(CHAR_ROWS, np.int64)
    edges = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))[::64] if len(docs) else []
    for at, to in zip(edges, [*edges[1:], len(docs)], strict=True):
        some, of = words[at:to], docs[at:to]
        sizes = ends[some] - starts[some]
        each = grams[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts[some], sizes)]
        for total, rows, of_rows in ((times[0], word[some], of), (times[1], each, np.repeat(of, sizes))):
            total += np.bincount(np.unique(of_rows * len(total) + rows) % len(total), minlength=len(total))
    return times[0] >= least, times[1] >= least


def train(windows: list[str], labels: list[int], docs: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Windows of at most WINDOW words each, joined by spaces, with their documents' labels and numbers from 0."""
    p, r = initial(seed), np.random.default_rng(seed)
    names: dict[str, int] = {}
    ids = np.zeros((len(windows), WINDOW), np.int64)
    mask = np.zeros((len(windows), WINDOW), np.float32)
    for k, words in enumerate(w.split() for w in windows):
        ids[k, : len(words)] = [names.setdefault(w, len(names)) for w in words]
        mask[k, : len(words)] = 1
    parts = [word_features(list(some)) for some in batched(names or [""], 16_384)]
    word, grams = np.concatenate([w for w, _, _ in parts]), np.concatenate([g.astype(np.int32) for _, g, _ in parts])
    ends = np.cumsum(np.concatenate([np.diff(np.append(s, len(g))) for _, g, s in parts]))
    starts = np.append(0, ends[:-1])
    del names, parts
    y, of = np.array(labels, np.float32), np.array(docs, np.int64)
    used = mask > 0
    p["word_kept"], p["gram_kept"] = often(ids[used], np.repeat(of, used.sum(axis=1)), word, grams, starts, ends, LEAST_DOCS)
    word, grams = kept_rows(word, p["word_kept"]), kept_rows(grams, p["gram_kept"])

    def batch(rows):
        """What the gradient of these windows needs."""
        some, place = np.unique(ids[rows], return_inverse=True)
        sizes = ends[some] - starts[some]
        begin = np.cumsum(sizes) - sizes
        flat = grams[np.arange(sizes.sum()) - np.repeat(begin - starts[some], sizes)]
        chars = np.add.reduceat(p["grams"][flat], begin, axis=0) / sizes[:, None]
        inputs = np.concatenate([p["words"][word[some]], chars], axis=1).astype(np.float32)
        place = place.reshape(len(rows), WINDOW).T
        return some, sizes, flat, inputs, place

    dense = [k for k in p if k not in ("words", "grams", "word_kept", "gram_kept")]
    adam = {k: (np.zeros_like(p[k]), np.zeros_like(p[k])) for k in dense}
    ada = {k: np.full(len(p[k]), 1e-6, np.float32) for k in ("words", "grams")}
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(windows)))
    step, steps = 0, epochs * -(-len(windows) // BATCH)
    active = np.arange(len(windows))
    for epoch in range(epochs):
        if epoch == 1:
            active = likely(window_logits(p, batch, mask), y, of)
        order = r.permutation(active)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            step += 1
            rate = 0.01 * (1 - 0.8 * step / steps)
            some, sizes, flat, inputs, place = batch(rows)
            g, dx = gradient(p, inputs[place], np.ascontiguousarray(mask[rows].T), y[rows])
            dinput = summed(place.ravel(), dx.reshape(-1, dx.shape[2]), len(some))
            for name, index, d in (("words", word[some], dinput[:, :WIDTH]), ("grams", flat, np.repeat(dinput[:, WIDTH:] / sizes[:, None], sizes, axis=0))):
                touched, back = np.unique(index, return_inverse=True)
                total = summed(back, d, len(touched))
                ada[name][touched] += (total * total).mean(axis=1)
                p[name][touched] -= 8 * rate * total / np.sqrt(ada[name][touched])[:, None]
            for k, (first, second) in adam.items():
                first += 0.1 * (g[k] - first)
                second += 0.001 * (g[k] * g[k] - second)
                p[k] = p[k] - (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return p


def summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values added up by index."""
    return np.stack([np.bincount(index, weights=values[:, c], minlength=size) for c in range(values.shape[1])], axis=1).astype(np.float32)


def window_logits(p: dict, batch, mask: np.ndarray) -> np.ndarray:
    out = []
    for at in range(0, len(mask), 2048):
        _, _, _, inputs, place = batch(np.arange(at, min(at + 2048, len(mask))))
        x, m = inputs[place], np.ascontiguousarray(mask[at : at + 2048].T)
        states = [recurrent(x @ p[f"W{d}"] + p[f"c{d}"], m, p[f"U{d}"], d == "b", False)[0] for d in "fb"]
        out.append(pooled(p, np.concatenate(states, axis=2), m)[0])
    return np.concatenate(out)


def likely(logits: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The windows to go on with: all of clean documents, and of each toxic one those with the largest logits."""
    order = np.lexsort((-logits, of))
    first = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
    sizes = np.diff(np.append(first, len(order)))
    rank = np.arange(len(order)) - np.repeat(first, sizes)
    keep = (rank < np.maximum(1, LIKELY * np.repeat(sizes, sizes))) | (y[order] == 0)
    return np.sort(order[keep])


class Scorer:
    """Logits of texts; keeps each direction's input of the words seen."""

    def __init__(self, p: dict, most: int = KNOWN_WORDS):
        self.p, self.most = p, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.inputs = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.inputs[0] = self.projected(np.zeros((1, 2 * WIDTH), np.float32))

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            word, grams, starts = word_features(some)
            sizes = np.diff(np.append(starts, len(grams)))
            word, grams = kept_rows(word, self.p["word_kept"]), kept_rows(grams, self.p["gram_kept"])
            chars = np.add.reduceat(self.p["grams"][grams], starts, axis=0) / sizes[:, None]
            n = len(self.known) + 1
            while n + len(some) > len(self.inputs):
                self.inputs = np.concatenate([self.inputs, np.zeros_like(self.inputs)])
            self.inputs[n : n + len(some)] = self.projected(np.concatenate([self.p["words"][word], chars], axis=1).astype(np.float32))
            self.known.update(zip(some, range(n, n + len(some)), strict=True))

    def top_logits(self, texts: list[str | None], top: int = 3) -> np.ndarray:
        """Per text its largest window logits, largest first; with fewer windows the last one stands for the rest."""
        split = [(t or "").split() for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > self.most:
            self.forget()
            new = list({w for words in split for w in words})
        self.learn(new)
        lengths = np.array([len(w) for w in split])
        counts = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
        flat = np.zeros(lengths.sum() + WINDOW, np.int64)
        flat[: lengths.sum()] = np.fromiter((i for words in split for i in map(self.known.__getitem__, words)), np.int64, lengths.sum())
        begin = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = begin[of] + number * STRIDE
        left = np.clip(begin[of] + lengths[of] - start, 0, WINDOW)
        logits = np.empty(len(of), np.float32)
        span = np.arange(WINDOW)[:, None]
        for at in range(0, len(of), 2048):
            rows = slice(at, at + 2048)
            mask = (span < left[rows]).astype(np.float32)
            ids = np.where(mask > 0, flat[np.minimum(start[rows] + span, len(flat) - 1)], 0)
            x = self.inputs[ids]
            forward, _ = recurrent(x[:, :, : 3 * HIDDEN], mask, self.p["Uf"], False, False)
            backward, _ = recurrent(x[:, :, 3 * HIDDEN :], mask, self.p["Ub"], True, False)
            logits[rows] = pooled(self.p, np.concatenate([forward, backward], axis=2), mask)[0]
        order = np.lexsort((-logits, of))
        first = np.cumsum(counts) - counts
        return np.stack([logits[order[first + np.minimum(k, counts - 1)]] for k in range(top)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients and intercept of weighted rows, by Newton's method."""
    weight = weight / weight.sum()
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(tops: np.ndarray) -> np.ndarray:
    return np.column_stack([tops[:, 0], tops.mean(axis=1)])


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Ids and labels that may be learnt from."""
    return labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))


def training_docs(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, most: int = MOST_DOCS) -> DataFrame:
    """Text and label of at most `most` documents of each label; a quarter of them is for the logistic fit."""
    picked = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    picked = picked.withColumn("for_fit", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0)
    texts = docs.select(F.col(id_col).alias("of"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), F.col("of") == F.col("id"))  # at most 2 * most rows without texts
    return found.groupBy("id", "label", "for_fit").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_DOCS, most_windows: dict[int, int] = MOST_WINDOWS) -> dict | None:
    """The network and the logistic fit, or None without documents of both labels."""
    known = labelled(labels, id_col, label_col)
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return None
    chosen = materialize(training_docs(docs, known, id_col, text_col, most), "labelled")

    def cut(batches):
        import pyarrow as pa

        for _, (ids, texts, marks) in rows_of(batches):
            out = []
            for i, t, y in zip(ids, texts, marks, strict=True):
                words = (t or "").split()
                starts = np.arange(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)
                if len(starts) > most_windows[y]:
                    starts = np.sort(np.random.default_rng(zlib.crc32(str(i).encode())).choice(starts, most_windows[y], replace=False))
                out += [(str(i), " ".join(words[s : s + WINDOW]), y) for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32())], names=["id", "words", "label"])

    got = sorted(map(tuple, chosen.where("not for_fit").select("id", "text", "label").mapInArrow(cut, "id string, words string, label int").collect()))
    numbers = {i: k for k, i in enumerate(dict.fromkeys(i for i, _, _ in got))}
    if len({y for _, _, y in got}) < 2:
        return None
    model = train([w for _, w, _ in got], [y for _, _, y in got], [numbers[i] for i, _, _ in got])
    del got
    scored = top_logits(chosen.where("for_fit"), "id", "text", model).collect()
    label = {r["id"]: r["label"] for r in chosen.where("for_fit").select("id", "label").collect()}
    y = np.array([label[r["doc_id"]] for r in scored], np.float64)
    if not len(y) or y.min() == y.max():
        return model | {"fit": np.array([1.0, 0.0, np.log(share[1] / share[0])])}
    # Rows weigh as their label does among all labelled documents, so that scores are probabilities there.
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum())
    return model | {"fit": fit_logistic(features(np.array([r["tops"] for r in scored])), y, weight)}


def top_logits(docs: DataFrame, id_col: str, text_col: str, model: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the constants above alone: about 2 MB

    def kernel(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for part, (_, texts) in rows_of(batches):
            tops = scorer.top_logits(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tops.astype(np.float64).tolist(), pa.list_(pa.float64()))], names=["doc_id", "tops"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {dict(rows.dtypes)['doc_id']}, tops array<double>")


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as doc_id, score."""
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score"))
    a, b, c = map(float, model["fit"])
    largest, mean = F.col("tops")[0], F.aggregate("tops", F.lit(0.0), lambda s, x: s + x) / F.size("tops")
    logit = F.lit(a) * largest + F.lit(b) * mean + F.lit(c)
    return top_logits(docs, id_col, text_col, model).select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that score `threshold` or more; all columns stay as they are. options are those of fit."""
    model = fit(docs, labels, id_col, text_col, **options)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kernel(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        w = shared.value["fit"]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tops = scorer.top_logits(part.column(at).cast(pa.string()).to_pylist())
                yield part.filter(pa.array(sigmoid(features(tops) @ w[:2] + w[2]) < threshold))

    return docs.mapInArrow(kernel, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
