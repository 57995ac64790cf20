"""Label masks for training: conversations as token ids, of which only the assistant's turns are labels.

A template writes messages as text; it is a parameter, as is the tokenizer's file. A turn that is written alike in the whole conversation
and when it was generated is labelled in the whole; one that later turns change has a sequence of its own, as it was seen when it was
generated. Each assistant turn is labelled exactly once. Nothing is ever cut: too long a conversation is reported.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import notes as N
from fathomline.operators import statistics as S

IGNORED = -100
BEGIN, END = "<|{}|>\n", "<|end|>"

Template = Callable[[list[dict], bool], str]


class MaskError(ValueError):
    pass


class Sequence(NamedTuple):
    text: str
    spans: list[tuple[int, int]]
    ids: list[int]
    labels: list[int]


def plain_template(messages: list[dict], generate: bool) -> str:
    """Every message between marks; with generate, the mark that begins the assistant's answer."""
    return "".join(f"{BEGIN.format(m['role'])}{m['content']}{END}\n" for m in messages) + (BEGIN.format("assistant") if generate else "")


def last_thought_template(messages: list[dict], generate: bool) -> str:
    """As plain_template, but text in <think> marks is written in the last assistant turn only: earlier turns change as the conversation goes on."""
    last = max((k for k, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
    cut = lambda text: text.split("</think>")[-1] if text.startswith("<think>") else text
    kept = [m if k == last and not generate else m | {"content": cut(m["content"])} for k, m in enumerate(messages)]
    return plain_template(kept, generate)


def turn_span(template: Template, messages: list[dict], k: int) -> tuple[str, tuple[int, int]]:
    """The conversation as it is up to assistant turn k, and where that turn and its end mark stand in it."""
    before, upto = template(messages[:k], True), template(messages[: k + 1], False)
    if not upto.startswith(before):
        raise MaskError(f"turn {k}: what it was generated from is not what stands before it")
    end = upto.rfind(END)
    if end <= len(before):
        raise MaskError(f"turn {k}: empty, or without an end mark")
    return upto, (len(before), end + len(END))


def labelled(tokenizer, text: str, spans: list[tuple[int, int]], longest: int | None) -> Sequence:
    """Ids of a text, and the same where a token lies in a span; spans must begin and end with tokens."""
    encoded = tokenizer.encode(text, add_special_tokens=False)
    offsets = encoded.offsets
    starts, ends = {a for a, _ in offsets}, {b for _, b in offsets}
    for a, b in spans:
        if a not in starts or b not in ends:
            raise MaskError(f"characters {a} to {b} are no whole tokens")
    if longest is not None and len(encoded.ids) > longest:
        raise MaskError(f"{len(encoded.ids)} tokens, at most {longest}")
    inside = lambda a, b: b > a and any(s <= a and b <= e for s, e in spans)
    return Sequence(text, spans, encoded.ids, [i if inside(*o) else IGNORED for i, o in zip(encoded.ids, offsets, strict=True)])


def sequences(tokenizer, template: Template, messages: list[dict], longest: int | None = None, split: bool = True) -> list[Sequence]:
    """The sequences of a conversation: turns that later ones change by themselves, then the whole with all others. Without split such a turn fails."""
    whole, alike, changed = template(messages, False), [], []
    for k, m in enumerate(messages):
        if m["role"] == "assistant":
            upto, span = turn_span(template, messages, k)
            if whole.startswith(upto):
                alike.append(span)
            elif split:
                changed.append((upto, span))
            else:
                raise MaskError(f"turn {k}: later turns change it")
    out = [labelled(tokenizer, text, [span], longest) for text, span in changed]
    return out + ([labelled(tokenizer, whole, alike, longest)] if alike else [])


def audit(tokenizer, template: Template, messages: list[dict], found: list[Sequence]) -> list[str]:
    """What is wrong with the sequences of a conversation: labels must spell each assistant turn once, and nothing else."""
    problems = []
    wanted = sorted(template(messages[: k + 1], False)[slice(*turn_span(template, messages, k)[1])] for k, m in enumerate(messages) if m["role"] == "assistant")
    spelled = []
    for s in found:
        runs, last = [], IGNORED
        for label in s.labels:
            if label != IGNORED:
                if last == IGNORED:
                    runs.append([])
                runs[-1].append(label)
            last = label
        spelled += [tokenizer.decode(r, skip_special_tokens=False) for r in runs]
        problems += ["a label is not its token"] * any(x not in (IGNORED, i) for i, x in zip(s.ids, s.labels, strict=True))
    if sorted(spelled) != wanted:
        problems.append("labels do not spell each assistant turn once")
    return problems


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


ENCODED = "sequence int, ids array<int>, labels array<int>, error string"


def encode(conversations: DataFrame, tokenizer: str, template: Template = plain_template, longest: int | None = None, split: bool = True) -> DataFrame:
    """conversations: id, messages (role, content). One row per sequence: id, sequence, ids, labels; or one with error for a conversation that can't be."""
    schema = f"id {dict(conversations.dtypes)['id']}, {ENCODED}"

    def kernel(batches):
        import pyarrow as pa

        tokens = load(tokenizer)
        # Ids and labels of few conversations are Python objects at once, not those of a whole batch.
        for batch in (piece for whole in batches for piece in N.slices(whole, 128)):
            rows = []
            for i, messages in zip(batch.column("id").to_pylist(), batch.column("messages").to_pylist(), strict=True):
                try:
                    found = sequences(tokens, template, messages, longest, split)
                    wrong = audit(tokens, template, messages, found)
                    if wrong:
                        raise MaskError("; ".join(wrong))
                    rows += [(i, k, s.ids, s.labels, None) for k, s in enumerate(found)]
                except MaskError as e:
                    rows.append((i, None, None, None, str(e)))
            kinds = [batch.column("id").type, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["id", "sequence", "ids", "labels", "error"])

    return conversations.select("id", "messages").mapInArrow(kernel, schema)


def lengths(encoded: DataFrame) -> DataFrame:
    """n and percentiles of the lengths of sequences, by position: p50, p95, p99, max."""
    rows = encoded.where("error is null").select(F.size("ids").alias("length"))
    n = F.col("n")
    at = lambda q: F.bround(F.lit(q) * (n - 1)).cast("long")
    return S.at_index(rows, "length", {"p50": at(0.5), "p95": at(0.95), "p99": at(0.99), "max": n - 1})


def supervision(encoded: DataFrame) -> DataFrame:
    """Conversations by number of sequences, with tokens and labelled tokens."""
    rows = encoded.where("error is null").groupBy("id").agg(F.count(F.lit(1)).alias("sequences"), F.sum(F.size("ids")).alias("tokens"), F.sum(F.size(F.filter("labels", lambda x: x != IGNORED))).alias("labels"))
    return rows.groupBy("sequences").agg(F.count(F.lit(1)).alias("conversations"), F.sum("tokens").alias("tokens"), F.sum("labels").alias("labels"))
