"""Rollouts written turn by turn: equal to unbroken ones, gone on with after a failure, in batches by tokens."""

import os
import sys

import pytest
from pyspark import cloudpickle

from fathomline.operators import chat
from fathomline.operators import rollouts as T

# Workers don't have this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CALL = '<tool_call>{"name": "unit_convert", "arguments": {"value": 1, "from_unit": "kg", "to_unit": "lb"}}</tool_call>'


def answer(prompt: str) -> str:
    kind, seen = int(prompt.split()[0] or 0) % 4 if prompt.strip() else 0, prompt.count("=2.2")
    return "plain" if kind == 0 else "<tool_call>{" if kind == 2 else f"done {seen}" if kind == 1 and seen else CALL


def generate(prompts, limit):
    return [answer(p) for p in prompts]


def execute(name, arguments):
    return f" {name}=2.2"


def prompts(spark, n=40):
    return spark.range(n).selectExpr("id", "concat(id, ' how much? ') as prompt").repartition(3)


def rows(df):
    return sorted(map(tuple, df.select("id", "turns", "answer", "stop_reason").collect()))


def test_rounds_equal_an_unbroken_run(spark, tmp_path):
    whole = chat.rollout(prompts(spark), lambda texts: generate(texts, 0), execute, 2)
    found = T.in_rounds(prompts(spark), str(tmp_path / "a"), generate, execute)
    assert rows(found) == rows(whole) and {r["stop_reason"] for r in found.collect()} == {"answer", "parse_error", "budget"}
    assert sorted(os.listdir(tmp_path / "a")) == [".run.json.crc", "run.json", "turn-0", "turn-1", "turn-2"]


def test_a_failing_generator_costs_its_round_only(spark, tmp_path):
    folder, log, broken = str(tmp_path / "run"), str(tmp_path / "log"), str(tmp_path / "broken")
    os.mkdir(log)
    open(broken, "w").close()

    def flaky(texts, limit):
        turn = max(t.count("=2.2") for t in texts)
        if turn and os.path.exists(broken):
            raise RuntimeError("the generator is gone")
        for t in texts:
            with open(f"{log}/{t.split()[0]}", "a") as f:
                f.write(f"{t.count('=2.2')}\n")
        return generate(texts, limit)

    with pytest.raises(Exception, match="the generator is gone"):
        T.in_rounds(prompts(spark), folder, flaky, execute)
    assert os.path.exists(f"{folder}/turn-0/_SUCCESS") and not os.path.exists(f"{folder}/turn-1/_SUCCESS")
    os.remove(broken)
    found = T.in_rounds(prompts(spark), folder, flaky, execute)
    assert rows(found) == rows(T.in_rounds(prompts(spark), str(tmp_path / "b"), generate, execute))
    # Each turn of each conversation was asked for once: the first round was not generated again.
    assert all(sorted(open(f"{log}/{name}").read().split()) == [str(k) for k in range(len(open(f"{log}/{name}").read().split()))] for name in os.listdir(log))
    # A run that is there is read, not made.
    assert rows(T.in_rounds(prompts(spark), folder, None, execute)) == rows(found)
    with pytest.raises(ValueError, match="other prompts or settings"):
        T.in_rounds(prompts(spark, 41), folder, generate, execute)
    with pytest.raises(ValueError, match="other prompts or settings"):
        T.in_rounds(prompts(spark), folder, generate, execute, settings={"model": "b"})


def test_batches_of_one_limit_within_the_tokens():
    sizes = [(5, 10), (90, 10), (7, 10), (6, 3), (400, 10), (7, 3), (8, 10)]
    found = list(T.batches_of(sizes, 60))
    assert found == [([3, 5], 3), ([0, 2, 6], 10), ([1], 10), ([4], 10)]
    assert sorted(k for batch, _ in found for k in batch) == list(range(len(sizes)))
    assert all(len(b) == 1 or len(b) * (max(sizes[k][0] for k in b) + limit) <= 60 for b, limit in found)
    assert list(T.batches_of([], 60)) == []


def test_limits_of_tokens(spark, tmp_path):
    """What is left of a conversation's tokens limits its turn, whatever batch it is in; those without any left end."""

    def words(texts, limit):
        return [" ".join((CALL if t.startswith("call") else "w " * 50).split()[:limit]) for t in texts]

    df = spark.createDataFrame([(1, "call a"), (2, "b"), (3, None), (3, "b")], "id long, prompt string")
    for tokens, first in ((18, (1, 2, 2, 18, "budget")), (15, (1, 2, 1, 15, "parse_error"))):  # a call has 9 words: the second one has room, or is cut
        found = T.in_rounds(df, str(tmp_path / f"w{tokens}"), words, execute, lambda t: len(t.split()), T.Budget(turns=9, tokens=tokens, turn_tokens=10))
        got = sorted((r["id"], len(r["turns"]), r["calls"], r["new_tokens"], r["stop_reason"]) for r in found.collect())
        assert got == [first, (2, 1, 0, 10, "answer"), (3, 1, 0, 10, "answer"), (3, 1, 0, 10, "answer")]


def test_empty_table(spark, tmp_path):
    assert T.in_rounds(prompts(spark).limit(0), str(tmp_path / "e"), generate, execute).collect() == []
