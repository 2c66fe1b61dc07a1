"""Exact de-duplication, near-duplicate groups by key, and set operations between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from splitforge.functions.columns import col, normalise_real


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in the given order. Sums are combined before the shuffle, so a key that a large
    share of the rows have is no hot task. Null keys are kept all."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return best.select("row.*").unionByName(df.where(F.col(key).isNull()))


def marked_duplicates(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """df with `reason`: duplicate for rows that first_wins drops, else null."""
    firsts = df.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*order)).alias("__first"))
    joined = df.join(firsts, F.col(key) == F.col("__key"), "left")
    late = F.col("__first").isNotNull() & (F.struct(*order) != F.col("__first"))
    return joined.withColumn("reason", F.when(late, "duplicate")).select(*df.columns, "reason")


def label_conflicts(df: DataFrame, key: str = "content_hash", label: str = "label") -> DataFrame:
    """Keys that stand under more than one label, with the number of rows."""
    return df.groupBy(key).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).where("labels > 1").drop("labels")


def near_groups(df: DataFrame, key: str | Column, fallback: str | Column, name: str = "group") -> DataFrame:
    """df with `group`: the perceptual key, or where there is none the fallback."""
    return df.withColumn(name, F.coalesce(col(key), col(fallback)))


def rejects(df: DataFrame, source: str = "source", reason: str = "reason") -> DataFrame:
    """Rows by source and reason; rows without a reason count as added."""
    return df.groupBy(source, F.coalesce(F.col(reason), F.lit("added")).alias("reason")).agg(F.count("*").alias("n"))


#: What becomes of a row, in the order in which it is judged.
REASONS = ("bad", "too small", "duplicate", "added")


def judged(df: DataFrame, key: str, order: Sequence[str], bad: Column, too_small: Column) -> DataFrame:
    """df with `reason`: bad, too small, duplicate or added. Only rows that are neither bad nor too small can be first of their
    key; null counts as false in both, and rows without a key are no duplicates."""
    early = F.when(F.coalesce(bad, F.lit(False)), "bad").when(F.coalesce(too_small, F.lit(False)), "too small")
    rows = df.withColumn("reason", early)
    firsts = rows.where("reason IS NULL").groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*order)).alias("__first"))
    joined = rows.join(firsts, (F.col(key) == F.col("__key")) & F.col("reason").isNull(), "left")
    late = F.col("__first").isNotNull() & (F.struct(*order) != F.col("__first"))
    return joined.withColumn("reason", F.coalesce("reason", F.when(late, "duplicate"), F.lit("added"))).select(*df.columns, "reason")


def write_added(rows: DataFrame, path: str, sources: Sequence[str], source: str = "source", reason: str = "reason") -> dict[tuple[str | None, str], int]:
    """Write the rows whose reason is added, and return how many rows of each source had each reason, all from one job.

    Counts are observed while rows pass, so nothing is read twice; those of sources that aren't named stand under None.
    """
    seen = Observation()
    named = {s: F.col(source) == s for s in sources}
    of = {**named, None: F.coalesce(~F.col(source).isin(*sources), F.lit(True)) if sources else F.lit(True)}
    keys = [(s, r) for s in of for r in REASONS]
    counts = [F.count_if(of[s] & (F.col(reason) == r)).alias(f"n{i}") for i, (s, r) in enumerate(keys)]
    rows.observe(seen, *counts).where(F.col(reason) == "added").drop(reason).write.parquet(path)
    return {k: seen.get[f"n{i}"] for i, k in enumerate(keys) if seen.get[f"n{i}"]}


def examples(df: DataFrame, by: str, value: str, n: int = 3) -> DataFrame:
    """(by, examples): the first n distinct values of each group. The bound of the rank is a constant, so each task keeps n of a
    group before the shuffle."""
    first = df.select(by, value).where(F.col(value).isNotNull()).distinct().withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(value))).where(F.col("__rank") <= n)
    return first.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("examples"))


def pairwise_overlap(df: DataFrame, key: str, split: str = "split", examples: int = 3) -> DataFrame:
    """(left_split, right_split, n, examples): keys that stand in two splits, from one pass over all splits."""
    shared = df.select(key, split).where(F.col(key).isNotNull()).distinct().groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("in")).where(F.size("in") > 1)
    pairs = shared.select(key, F.explode("in").alias("left_split"), "in").select(key, "left_split", F.explode("in").alias("right_split")).where("left_split < right_split")
    counts = pairs.groupBy("left_split", "right_split").agg(F.count("*").alias("n"))
    # A constant bound of the rank: each task keeps the first few of a pair before the shuffle.
    first = pairs.withColumn("__rank", F.row_number().over(Window.partitionBy("left_split", "right_split").orderBy(key))).where(F.col("__rank") <= examples)
    shown = first.groupBy("left_split", "right_split").agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("examples"))
    return counts.join(shown, ["left_split", "right_split"]).select("left_split", "right_split", "n", "examples")


def merged_overlap(df: DataFrame, key: str, merged: Sequence[str], other: str, split: str = "split") -> DataFrame:
    """Distinct keys of the `merged` splits that the other split holds, too."""
    return df.where(F.col(split).isin(*merged)).select(key).intersect(df.where(F.col(split) == other).select(key))


def duplicates_in_splits(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(split, n): rows beyond the distinct keys of each split, and of all under the name of null."""
    return df.groupBy(split, key).agg(F.count("*").alias("k")).rollup(split).agg((F.sum("k") - F.count_distinct(key)).alias("n"), F.grouping(split).alias("whole"))


def union_and_sum(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys against rows."""
    return df.agg(F.count_distinct(key).alias("distinct_keys"), F.count("*").alias("n_rows"))


def not_available(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Requested keys that aren't available."""
    return requested.select(key).distinct().join(available.select(key).distinct(), key, "left_anti")


def availability(df: DataFrame, key: str, names: Sequence[str] = ("real", "nature", "authentic", "human")) -> DataFrame:
    """(raw, normalised, n): rows by key and by the key with all names of real ones as REAL."""
    return df.groupBy(F.col(key).alias("raw")).agg(F.count("*").alias("n")).select("raw", normalise_real("raw", names).alias("normalised"), "n")
