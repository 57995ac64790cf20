"""Views of training records: filtered, relabelled, with additions; and the audit that derives them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators import relational as R

VARIANTS = ("raw", "filtered", "relabelled", "with_additions", "relabelled_with_additions")


def build(records: DataFrame, flagged: DataFrame, review: DataFrame, additions: DataFrame, variant: str) -> DataFrame:
    """records: id, ord and more. flagged: ids that a check found. review: id, decision (keep, relabel, drop), answer, answer_type. additions: records.

    raw keeps all; filtered leaves flagged ids out; relabelled replaces the answer of flagged ids as reviewed (a flagged id without a decision
    fails); additions follow in their own order. Order is in `ord`."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    out = records
    ids = flagged.select("id").distinct()
    if variant == "filtered":
        out = out.join(ids, "id", "left_anti")
    if variant.startswith("relabelled"):
        decided = ids.join(review.select("id", F.col("decision").alias("_d"), F.col("answer").alias("_a"), F.col("answer_type").alias("_t")), "id", "left")
        decided = decided.withColumn("_d", F.coalesce("_d", F.raise_error(F.concat(F.lit("no decision for "), "id"))))
        again = F.col("_d") == "relabel"
        replaced = {"answer": F.when(again, F.col("_a")).otherwise(F.col("answer")), "answer_type": F.when(again, F.col("_t")).otherwise(F.col("answer_type"))}
        if "tool_calls" in records.columns:
            replaced["tool_calls"] = F.when(~F.coalesce(again, F.lit(False)), F.col("tool_calls"))
        out = R.relabel(out, decided, "id", replaced, F.col("_d") == "drop")
    if variant.endswith("additions"):
        last = records.agg(F.coalesce(F.max("ord"), F.lit(-1))).scalar()
        out = R.union_checked(out, additions.withColumn("ord", F.col("ord") + last + 1), "id")
    return out


def without_gold(records: DataFrame) -> DataFrame:
    """What a model gets to see: id, note, table, question."""
    return records.select("id", "note", "table", "question")


def sidecar(records: DataFrame) -> DataFrame:
    """What a model must not see, by id."""
    return records.select("id", "answer", "answer_type", "tool_calls")


def digest(view: DataFrame) -> Column:
    """A digest of each row, for manifests and comparison."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(view.columns) if c != "ord"]), {"ignoreNullFields": "false"}), 256)


def manifest(view: DataFrame) -> DataFrame:
    """One row: rows, and a checksum of rows and their order that no partitioning changes."""
    placed = view.select("ord", digest(view).alias("d"))
    return placed.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("ord", "d").cast("decimal(38,0)")).cast("string").alias("checksum"))


def audit(view: DataFrame, derived: DataFrame) -> DataFrame:
    """Differences of a stored view from the one derived again: id and state (missing, unexpected, changed, moved)."""
    a = view.select("id", F.col("ord").alias("o1"), digest(view).alias("d1"))
    b = derived.select("id", F.col("ord").alias("o2"), digest(derived).alias("d2"))
    state = F.when(F.col("d1").isNull(), "missing").when(F.col("d2").isNull(), "unexpected").when(F.col("d1") != F.col("d2"), "changed").when(F.col("o1") != F.col("o2"), "moved")
    return a.join(b, "id", "full").select("id", state.alias("state")).where("state is not null")


def first_of_types(records: DataFrame, per_type: int) -> DataFrame:
    """The first records of each answer type, in their order."""
    return R.first_of(records, ["answer_type"], [F.asc("ord"), F.asc("id")], per_type)


def approval_state(items: DataFrame, approvals: DataFrame) -> DataFrame:
    """items: id, sha256. approvals: id, sha256, status. State: missing, draft, approved, or CHANGED after approval."""
    joined = items.join(approvals.select("id", F.col("sha256").alias("approved_sha"), "status"), "id", "left")
    state = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "approved", "draft").when(F.col("sha256") == F.col("approved_sha"), "approved").otherwise("CHANGED")
    return joined.select("id", state.alias("state"))


def epoch_ends(log: DataFrame, every: str = "epoch") -> DataFrame:
    """Rows of a training log at whole epochs, the last of each."""
    whole = log.where(F.abs(F.col(every) - F.rint(F.col(every))) < 1e-6).withColumn("n", F.rint(F.col(every)).cast("int"))
    order = Window.partitionBy("n").orderBy(F.desc("step"))
    return whole.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def epoch_checkpoints(log: DataFrame, found: DataFrame, listed: DataFrame, expected: int = 2) -> DataFrame:
    """Checkpoints (step, sha256) at whole epochs of a log. There must be `expected` of them, each found with the listed digest."""
    ends = epoch_ends(log).select("step", F.rint("epoch").cast("int").alias("epoch"))
    rows = ends.join(found.select("step", F.col("sha256").alias("sha256")), "step", "left").join(listed.select("step", F.col("sha256").alias("listed")), "step", "left").collect()
    wrong = sorted(r["step"] for r in rows if r["sha256"] is None or r["sha256"] != r["listed"])
    if len(rows) != expected or wrong:
        raise ValueError(f"{len(rows)} checkpoints at whole epochs, {expected} expected; not as listed: {wrong}")
    return ends


def additions_of(view: str, added: dict[str, DataFrame], empty: DataFrame) -> DataFrame:
    """The additions registered for a view; none for a view without."""
    return added.get(view, empty.limit(0))
