"""Ranks and running sums over whole tables without a window that puts all rows into one task.

Rows are dealt by a bucket of their sort key; small per-bucket totals give each bucket its offset, and only rows of one
bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitforge.functions.columns import hash_order

#: Hexadecimal digits of the hash that name a bucket: 16**3 buckets.
DIGITS = 3


def hash_ranked(df: DataFrame, seed: int | str, id_cols: Sequence[str], by: Sequence[str] = (), rank: str = "rank", total: str = "total") -> DataFrame:
    """df with the 1-based rank of each row in seeded hash order among the rows with its `by` values, and their number.

    The order is by hash of seed, `by` and `id_cols`, then by id; nulls in `by` are a group of their own.
    """
    key = hash_order(seed, *(F.col(c) for c in by), *(F.col(c) for c in id_cols))
    rows = df.withColumn("__hash", key).withColumn("__bucket", F.substring("__hash", 1, DIGITS))
    groups = [F.col(c) for c in by]
    counts = rows.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16**DIGITS rows a group.
    offsets = counts.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__bucket").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias(total))
    on = F.col("__bucket") == F.col("__of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    local = Window.partitionBy(*by, "__bucket").orderBy("__hash", *id_cols)
    ranked = rows.withColumn("__local", F.row_number().over(local)).join(offsets, on)
    return ranked.withColumn(rank, F.col("__before") + F.col("__local")).select(*df.columns, rank, total)


def running_sums(df: DataFrame, by: Sequence[str], order: str, bucket: Column, sums: Sequence[str]) -> DataFrame:
    """df with `before_<c>`, the sum of each column c over the rows of its `by` group that come earlier in `order`.

    `bucket` must not decrease with `order`; the values of `order` are distinct within a group.
    """
    rows = df.withColumn("__bucket", bucket)
    totals = rows.groupBy(*by, "__bucket").agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__bucket", *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums))
    local = Window.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *(F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"__l_{c}") for c in sums))
    joined = inside.join(offsets, [*by, "__bucket"])
    return joined.select(*df.columns, *((F.col(f"__o_{c}") + F.col(f"__l_{c}")).alias(f"before_{c}") for c in sums))
