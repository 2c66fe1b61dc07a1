"""Splits, caps, quotas and seeded samples; membership depends on seeds and values only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitforge.functions.columns import hash_order
from splitforge.operators.ranking import hash_ranked


def stratified_split(df: DataFrame, seed: int, id_col: str = "sample_id", label_col: str = "label", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """df with `split`: of each class, bround(n * train) rows train, bround(n * val) val, the rest test."""
    ranked = hash_ranked(df, seed, [id_col], [label_col], "__rank", "__n")
    n_train, n_val = F.bround(F.col("__n") * train), F.bround(F.col("__n") * val)
    split = F.when(F.col("__rank") <= n_train, "train").when(F.col("__rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("__rank", "__n")


def random_split(df: DataFrame, seed: int, val: float, id_col: str = "sample_id") -> DataFrame:
    """df with `split`: floor(n * val) rows val, the rest train."""
    ranked = hash_ranked(df, seed, [id_col], (), "__rank", "__n")
    return ranked.withColumn("split", F.when(F.col("__rank") <= F.floor(F.col("__n") * val), "val").otherwise("train")).drop("__rank", "__n")


def class_balanced_cap(df: DataFrame, seed: int, most: int | None, id_col: str = "sample_id", label_col: str = "label") -> DataFrame:
    """All rows if there are at most `most` of them (or no limit), else most // 2 of each class; a short class isn't topped up."""
    if most is None:
        return df
    ranked = hash_ranked(df, seed, [id_col], [label_col], "__rank", "__n")
    whole = df.agg(F.count("*").alias("__all"))
    return ranked.crossJoin(F.broadcast(whole)).where((F.col("__all") <= most) | (F.col("__rank") <= most // 2)).drop("__rank", "__n", "__all")


def per_key_quota(df: DataFrame, caps: dict[str, int], key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first caps[key] rows of each key in the given order; other keys go.

    The largest cap bounds the rank by a constant, so Spark keeps only that many rows a key in each task before the
    shuffle.
    """
    cap = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v))))[F.col(key)]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = df.where(F.col(key).isin(*caps)).withColumn("__rank", rank).where(F.col("__rank") <= max(caps.values()))
    return ranked.where(F.col("__rank") <= cap).drop("__rank")


def balanced(df: DataFrame, seed: int, n_real: DataFrame, key: str = "generator", id_cols: Sequence[str] = ("content_hash",), ceiling: int | None = None) -> DataFrame:
    """Every key cut down to min(smallest key, ceiling, n_real // keys) rows, in hash order of the content.

    n_real: a table of one row and column `n_real`.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("__k"))
    target = sizes.agg(F.min("__k").alias("__least"), F.count("*").alias("__keys")).crossJoin(n_real)
    parts = [F.col("__least"), F.floor(F.col("n_real") / F.col("__keys"))]
    target = target.select(F.least(*parts, *([F.lit(ceiling)] if ceiling is not None else [])).alias("__target"))
    ranked = hash_ranked(df, seed, list(id_cols), [key], "__rank", "__n")
    return ranked.crossJoin(F.broadcast(target)).where("__rank <= __target").drop("__rank", "__n", "__target")


def group_ranks(df: DataFrame, seed: int, group_col: str = "group") -> DataFrame:
    """(group, rank, total) of the distinct groups in hash order."""
    return hash_ranked(df.select(group_col).distinct(), seed, [group_col], (), "rank", "total")


def group_split(df: DataFrame, seed: int, val: float, group_col: str = "group") -> DataFrame:
    """df with `split`: floor(groups * val) whole groups val, all others train."""
    chosen = group_ranks(df, seed, group_col).where(F.col("rank") <= F.floor(F.col("total") * val)).select(group_col, F.lit("val").alias("split"))
    return df.join(chosen, group_col, "left").withColumn("split", F.coalesce("split", F.lit("train"))).select(*df.columns, "split")


def held_back_groups(df: DataFrame, seed: int, share: float, group_col: str = "group", label_col: str = "label") -> DataFrame:
    """The distinct groups of floor(groups * share) among rows of label 0."""
    ranks = group_ranks(df.where(F.col(label_col) == 0), seed, group_col)
    return ranks.where(F.col("rank") <= F.floor(F.col("total") * share)).select(group_col)


def best_epoch(df: DataFrame, score: str = "f1", epoch: str = "epoch", by: Sequence[str] = ()) -> DataFrame:
    """The row of the greatest score, the earliest of equals; scores that are null or NaN never win."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(epoch))).alias("__row")
    return rows.groupBy(*by).agg(best).select("__row.*")


def seeded_sample(df: DataFrame, seed: int, n: int, id_col: str = "sample_id", by: Sequence[str] = ()) -> DataFrame:
    """n rows (of each `by` group) in hash order. n is a constant, so every task keeps its first n and only these meet."""
    key = hash_order(seed, *(F.col(c) for c in by), F.col(id_col))
    if not by:
        return df.orderBy(key, id_col).limit(n)
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(key, id_col)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def first_rows(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def seeded_order(df: DataFrame, seed: int, id_col: str = "sample_id") -> DataFrame:
    """df sorted by its seeded hash, for a sink."""
    return df.orderBy(hash_order(seed, F.col(id_col)), id_col)
