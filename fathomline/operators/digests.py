"""A digest of the rows of a table, whatever their order: two tables of any size are compared without a join, and a frozen one without its rows.

Each row has a SHA-256 over a key and its values. Its digits are taken as four numbers of 60 bits, and each of the four is summed over all rows modulo 2^60. Sums don't depend on the order or on partitions,
count repeated rows as often as they occur, and add up: the digest of a union is the sum of digests, that of rows taken away their difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES, BITS = 4, 60
MODULUS = 1 << BITS
DIGITS = BITS // 4


def row_text(columns: list[Column]) -> Column:
    """A row's values as one text: each with its length, so that no two rows share one; null has none."""
    each = [F.when(c.isNull(), F.lit("~")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.array_join(F.array(*each), "|")


def lanes(df: DataFrame, columns: list[str] | None = None, key: str = "") -> list[Column]:
    from pyspark.sql.types import ArrayType, MapType, StructType

    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType)}
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) if c in nested else F.base64(F.col(f"`{c}`")) if t == "binary" else F.col(f"`{c}`") for c, t in df.dtypes if columns is None or c in columns]
    digest = F.sha2(F.concat(F.lit(key), row_text(values)), 256)
    return [F.conv(F.substring(digest, 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(20,0)") for k in range(LANES)]


def written(sums: list[Column]) -> Column:
    """Four sums as 60 digits."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.pmod(s, F.lit(MODULUS).cast("decimal(38,0)")).cast("long")), DIGITS, "0")) for s in sums])


def multiset_digest(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, key: str = "") -> DataFrame:
    """n and digest of all rows, or of each group. Columns count in the order of the table."""
    rows = df.select(*[F.col(f"`{b}`") for b in by or []], *[c.alias(f"lane{k}") for k, c in enumerate(lanes(df, columns, key))])
    sums = rows.groupBy(*by or []).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"lane{k}"), F.lit(0).cast("decimal(30,0)")).cast("decimal(38,0)").alias(f"lane{k}") for k in range(LANES)])
    return sums.select(*by or [], "n", written([F.col(f"lane{k}") for k in range(LANES)]).alias("digest"))


def combined(a: str, b: str, sign: int = 1) -> str:
    """The digest of the rows of both tables, or with sign -1 of the first without those of the second."""
    pairs = ((int(a[k : k + DIGITS], 16), int(b[k : k + DIGITS], 16)) for k in range(0, LANES * DIGITS, DIGITS))
    return "".join(f"{(x + sign * y) % MODULUS:0{DIGITS}x}" for x, y in pairs)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of the same columns hold the same rows equally often: a row of each comes to the driver."""
    return a.columns == b.columns and multiset_digest(a).first() == multiset_digest(b).first()
