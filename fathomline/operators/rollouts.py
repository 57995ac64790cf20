"""Rollouts that are written turn by turn, so that what is generated is generated once.

A round is one turn of all conversations that go on. Its rows are written before the next one begins: a lost executor costs its tasks of one turn, a run that ends early goes on
after the last whole round. Rounds need no shuffle: a conversation's row carries its transcript, and those that have ended stay in the round that ended them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.chat import parsed
from fathomline.operators.digests import multiset_digest
from fathomline.sources import snapshots
from fathomline.sources.manifest import hadoop
from fathomline.sources.reports import digest


@dataclass(frozen=True)
class Budget:
    """Turns and new tokens of a conversation, new tokens of a turn, and tokens of a batch: its rows times its longest prompt with the turn to come."""

    turns: int = 3
    tokens: int = 2048
    turn_tokens: int = 512
    batch_tokens: int = 32768


def batches_of(rows: list[tuple[int, int]], batch_tokens: int) -> Iterator[tuple[list[int], int]]:
    """rows: prompt tokens and new tokens left of each. Batches of row numbers, with the limit of new tokens that holds for each of their rows.

    The limit of a batch must be the least of its rows', as generators take one for all; rows of one limit only are put together, so that what a row gets doesn't
    depend on its neighbours, and a repeated task gives the same rows. Within a limit the shortest come first, so that batches pad little."""
    batch: list[int] = []
    limit = longest = 0
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][1], rows[k][0], k)):
        length, own = rows[k]
        if batch and (own != limit or (len(batch) + 1) * (max(longest, length) + own) > batch_tokens):
            yield batch, limit
            batch, longest = [], 0
        batch.append(k)
        limit, longest = own, max(longest, length)
    if batch:
        yield batch, limit


def one_round(states: DataFrame, generate: Callable, execute: Callable, count: Callable[[str], int], budget: Budget) -> DataFrame:
    """One turn of each state (id, transcript, turns, calls, new_tokens, answer, stop_reason)."""
    columns = ["id", "transcript", "turns", "calls", "new_tokens", "answer", "stop_reason"]
    schema = states.select(*columns).schema

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            sizes = [(count(r["transcript"]), min(budget.turn_tokens, budget.tokens - r["new_tokens"])) for r in rows]
            for chosen, limit in batches_of(sizes, budget.batch_tokens):
                for k, out in zip(chosen, generate([rows[k]["transcript"] for k in chosen], limit), strict=True):
                    r, turn = rows[k], parsed(out)
                    r["turns"], r["new_tokens"] = [*(r["turns"] or []), out], r["new_tokens"] + count(out)
                    if turn["status"] == "no_call":
                        r["answer"], r["stop_reason"] = turn["content"], "answer"
                        continue
                    if turn["status"] != "valid":
                        r["stop_reason"] = "parse_error"
                        continue
                    r["calls"] += len(turn["calls"])
                    r["transcript"] += out + "".join(execute(c["name"], dict(c["arguments"])) for c in turn["calls"])
                    if len(r["turns"]) >= budget.turns or r["new_tokens"] >= budget.tokens:
                        r["stop_reason"] = "budget"
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return states.select(*columns).mapInArrow(kernel, schema)


def in_rounds(
    prompts: DataFrame, folder: str, generate: Callable[[list[str], int], list[str]], execute: Callable[[str, dict], str], count: Callable[[str], int] = len,
    budget: Budget = Budget(), settings: dict | None = None,
) -> DataFrame:
    """prompts: id, prompt (null: empty). The model answers, its calls run and are appended, until it answers without a call, a turn can't be read, or the budget is used.

    generate takes the prompts of a batch and the limit of new tokens of each; count gives a text's tokens. Rounds are written to folder/turn-k. A folder that holds whole rounds of the
    same prompts, budget and settings is gone on with; one of others is refused. Ids may repeat: rows are never joined. Without prompts there are no rows.
    Returns id, turns, calls, new_tokens, answer, stop_reason (answer, parse_error, budget)."""
    spark, folder = prompts.sparkSession, folder.rstrip("/")
    prompts = prompts.select("id", F.coalesce("prompt", F.lit("")).alias("prompt"))
    row = multiset_digest(prompts).first()
    key = digest({"rows": row["n"], "digest": str(row["digest"]), "budget": asdict(budget), "settings": settings or {}})
    fs, at = hadoop(spark, f"{folder}/run.json")
    if fs.exists(at):
        if json.loads(snapshots.read_text(fs, at))["run"] != key:
            raise ValueError(f"{folder} holds a run of other prompts or settings")
    else:
        stream = fs.create(at, False)
        stream.write(bytearray(json.dumps({"run": key}).encode()))
        stream.close()

    states = prompts.select(
        "id", F.col("prompt").alias("transcript"), F.array().cast("array<string>").alias("turns"), F.lit(0).cast("long").alias("calls"), F.lit(0).cast("long").alias("new_tokens"),
        F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("stop_reason"),
    )
    schema, paths = states.schema, []
    for k in range(budget.turns):
        path = f"{folder}/turn-{k}"
        # The mark of a whole round is written after all of its files.
        if not fs.exists(hadoop(spark, f"{path}/_SUCCESS")[1]):
            one_round(states, generate, execute, count, budget).write.mode("overwrite").parquet(path)
        paths.append(path)
        states = spark.read.schema(schema).parquet(path).where("stop_reason is null")
        if states.isEmpty():
            break
    ended = spark.read.schema(schema).parquet(*paths).where("stop_reason is not null")
    return ended.select("id", "turns", "calls", "new_tokens", "answer", "stop_reason")
