"""Similarity joins against all pairs."""

import random

import pytest

from fathomline.operators import relational as R


def sets(seed, n):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 40))] for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            if words:
                words[r.randrange(len(words))] = f"new{r.randint(0, 9)}"
        out.append(words)
    return [*out, *[["the", "same", "words", "of", "all", "copies"]] * 40, None, []]


def grams(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words or []) - k + 1)}


@pytest.mark.parametrize("threshold,k", [(0.9, 5), (0.8, 2), (0.5, 1), (1.0, 3)])
def test_similar_equals_all_pairs(spark, threshold, k):
    a, b = sets(1, 90), sets(1, 120)[30:] + sets(2, 60)
    rows = lambda x: spark.createDataFrame(list(enumerate(x)), "id long, t array<string>")
    got = {(r["id"], r["match"]): round(r["jaccard"], 9) for r in R.similar(rows(a), rows(b), "id", "t", threshold, k, salts=3).collect()}
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            g, h = grams(x, k), grams(y, k)
            if g and h and len(g & h) / len(g | h) >= threshold - 1e-12:
                want[i, j] = round(len(g & h) / len(g | h), 9)
    assert got == want and len(want) > 1600


def test_most_similar_of_the_candidates(spark):
    rows = lambda x: spark.createDataFrame(x, "id long, t array<string>")
    index = [(k, "a b c d e f".split()) for k in range(5)] + [(9, "a b c d e x".split()), (10, "p q r s t u v".split())]
    got = R.max_jaccard(rows([(1, "a b c d e f".split()), (2, "p q r s t".split()), (3, ["a"]), (4, None)]), rows(index), "id", "t", k=3, max_df=5, candidates=2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1.0), (2, 10, 0.6), (3, None, 0.0), (4, None, 0.0)]


@pytest.mark.parametrize("k,hot,levels", [(5, 1000, R.LEVELS), (1, 3, (0.6, 0.0)), (2, 10, (0.8,))])
def test_most_similar_equals_all_pairs(spark, k, hot, levels):
    a, b = sets(1, 90), sets(1, 120)[30:] + sets(2, 60)
    rows = lambda x: spark.createDataFrame(list(enumerate(x)), "id long, t array<string>")
    got = {r["id"]: (r["match"], r["jaccard"], r["shared"]) for r in R.most_similar(rows(a), rows(b), "id", "t", k, levels, hot).collect()}
    want = {}
    for i, x in enumerate(a):
        g, best = grams(x, k), (0.0, 0, 0)
        for j, y in enumerate(b):
            h = grams(y, k)
            if g & h and len(g & h) / len(g | h) >= levels[-1] - 1e-12:
                best = max(best, (len(g & h) / len(g | h), len(g & h), -j))
        want[i] = (-best[2] if best[1] else None, best[0], best[1])
    assert got == want and None in {m for m, _, _ in want.values()} and len({m for m, _, _ in want.values()}) > 10
