"""Checks of stored splits; each gives findings (check, severity, n, examples), n = 0 where nothing is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitforge.operators.dedup import label_conflicts, pairwise_overlap
from splitforge.operators.joins import held_out_present
from splitforge.operators.metrics import class_counts


def finding(rows: DataFrame, check: str, example: str, severity: str = "error", keep: int = 3) -> DataFrame:
    """One row: how many rows, and the first examples in order."""
    ranked = rows.select(F.col(example).cast("string").alias("e"))
    least = ranked.where("e IS NOT NULL").distinct().orderBy("e").limit(keep).agg(F.array_sort(F.collect_list("e")).alias("examples"))
    return rows.agg(F.count("*").alias("n")).crossJoin(least).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n", "examples")


def _pairs(df: DataFrame, key: str, check: str) -> DataFrame:
    rows = pairwise_overlap(df, key).select(F.concat(F.lit(check + ":"), "left_split", F.lit("-"), "right_split").alias("check"), F.lit("error").alias("severity"), "n", "examples")
    return rows



def duplicate_rows(df: DataFrame, key: str, check: str) -> DataFrame:
    return finding(df.groupBy("split", key).agg(F.count("*").alias("k")).where("k > 1").select(key), check, key)


def balance(df: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Splits whose classes differ by more than the tolerance of their rows."""
    off = class_counts(df).where(F.abs(F.col("n_real") - F.col("n_generated")) / F.col("n") > tolerance)
    return finding(off, "class balance", "split", "warning")


def sizes(df: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Splits whose rows differ from their share of all by more than max(4, 1 % of all)."""
    shares = F.create_map(*(x for k, v in sorted(targets.items()) for x in (F.lit(k), F.lit(float(v)))))
    counts = class_counts(df).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    off = counts.where(F.abs(F.col("n") - F.col("total") * shares[F.col("split")]) > F.greatest(F.lit(4.0), F.col("total") * 0.01))
    return finding(off, "split size", "split", "warning")


def split_report(df: DataFrame, key: str = "sample_id", targets: dict[str, float] | None = None, tolerance: float = 0.02, listing: DataFrame | None = None) -> DataFrame:
    """Duplicates in splits, overlaps of splits, balance, sizes against targets and, given a listing, missing files."""
    out = duplicate_rows(df, key, "duplicate in split").unionByName(_pairs(df, key, "overlap")).unionByName(balance(df, tolerance)).unionByName(sizes(df, targets or {"train": 0.8, "val": 0.1, "test": 0.1}))
    if listing is not None:
        from splitforge.operators.joins import missing_files

        out = out.unionByName(finding(missing_files(df, listing, key), "missing file", key))
    return out


def blank_generators(df: DataFrame) -> DataFrame:
    return finding(df.where("label = 1").where(F.coalesce(F.trim("generator"), F.lit("")) == ""), "blank generator", "sample_id")


def independent_report(df: DataFrame, held_generators: DataFrame, held_sources: DataFrame, final: str = "test", key: str = "sample_id") -> DataFrame:
    """Overlaps by key and by content, duplicates, blank generators, held-out keys outside the final split, and whether
    the final split has them at all."""
    seen = held_out_present(df.where(F.col("split") != final), held_generators, held_sources)
    absent = held_generators.join(df.where(F.col("split") == final).select("generator").distinct(), "generator", "left_anti")
    parts = [
        _pairs(df, key, "overlap"), _pairs(df, "content_hash", "content overlap"), duplicate_rows(df, key, "duplicate in split"),
        blank_generators(df), finding(seen, "held out in training", key), finding(absent, "held out missing in final", "generator"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def thin_generators(df: DataFrame, least: int, mixin: str = "is_mixin") -> DataFrame:
    """(generator, n): generators with too few rows in train and val; mixed-in rows are left out."""
    rows = df.where("label = 1").where(F.col("split").isin("train", "val"))
    rows = rows.where(~F.coalesce(F.col(mixin), F.lit(False))) if mixin in df.columns else rows
    return rows.groupBy("generator").agg(F.count("*").alias("n")).where(F.col("n") < least)


def leakage_report(df: DataFrame, held_generators: DataFrame, held_sources: DataFrame, least: int, final: str = "test", key: str = "sample_id") -> DataFrame:
    """(train and val) against the final split by key and content, held-out keys in training, duplicates, a final split
    of one class, thin generators; and beside them groups that straddle splits and contents under two labels."""
    merged = df.withColumn("split", F.when(F.col("split") == final, final).otherwise("pool"))
    seen = held_out_present(df.where(F.col("split") != final), held_generators, held_sources)
    one_class = df.where(F.col("split") == final).groupBy("split").agg(F.count_distinct("label").alias("k")).where("k < 2")
    parts = [_pairs(merged, key, "overlap"), _pairs(merged, "content_hash", "content overlap"), finding(seen, "held out in training", key), duplicate_rows(df, key, "duplicate in split"), finding(one_class, "final split of one class", "split"), finding(thin_generators(df, least), "thin generator", "generator", "warning")]
    if "group" in df.columns:
        parts.append(finding(pairwise_overlap(df, "group").withColumn("pair", F.concat_ws("-", "left_split", "right_split")), "group_overlap", "pair", "warning"))
    parts.append(finding(label_conflicts(df), "label_conflict", "content_hash", "warning"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def passed(findings: DataFrame) -> DataFrame:
    """One row: ok, and the number of errors."""
    errors = F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("n"))), F.lit(0))
    return findings.agg((errors == 0).alias("ok"), errors.alias("errors"))


def quota_plan(available: DataFrame, n_real: int, ceiling: int, least: int, key: str = "generator", strict: bool = True) -> DataFrame:
    """(key, available, quota): min(available, ceiling, n_real // keys); with `strict` a quota below `least` is an error."""
    sizes_ = available.groupBy(key).agg(F.count("*").alias("available"))
    many = sizes_.agg(F.count("*").alias("__keys"))
    quota = F.least(F.col("available"), F.lit(ceiling), F.floor(F.lit(n_real) / F.col("__keys")))
    plan = sizes_.crossJoin(F.broadcast(many)).select(key, "available", quota.cast("long").alias("quota"))
    if not strict:
        return plan.withColumn("short", F.col("quota") < least)
    wrong = F.raise_error(F.concat(F.lit("too few rows of "), F.col(key))).cast("long")
    return plan.withColumn("quota", F.when(F.col("quota") < least, wrong).otherwise(F.col("quota")))


def frozen_changes(before: DataFrame, after: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """(path, change) of files that were added, removed or altered between two snapshots of digests."""
    both = before.select(path, F.col(digest).alias("__b")).join(after.select(path, F.col(digest).alias("__a")), path, "full_outer")
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("__a") != F.col("__b"), "altered")
    return both.select(path, change.alias("change")).where("change IS NOT NULL")


def condition_digests(rows: DataFrame, vector: str = "features", keys: Sequence[str] = ("name", "param"), places: int = 6) -> DataFrame:
    """(keys, n, digest): a digest of each condition's transformed rows, at `places` places, that their order doesn't
    change. It is a sum of 40-bit hashes of sample and vector."""
    one = F.shiftrightunsigned(F.xxhash64("sample_id", F.transform(vector, lambda x: F.round(x * 10**places).cast("long"))), 24)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(one).alias("digest"))


def not_reproduced(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("name", "param")) -> DataFrame:
    """Conditions whose digests differ between two runs."""
    return first.select(*keys, F.col("digest").alias("__d")).join(second, list(keys), "full_outer").where(~F.col("__d").eqNullSafe(F.col("digest"))).select(*keys)


def gate(findings: DataFrame, required: Sequence[str]) -> DataFrame:
    """(allowed, blocked_by): false if any of the named checks has findings."""
    rows = findings.where(F.col("check").isin(*required)).where("n > 0")
    return rows.agg((F.count("*") == 0).alias("allowed"), F.array_sort(F.collect_set("check")).alias("blocked_by"))


def readability(images: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """The finding of images that don't decode, of all or of n chosen by hash of their origin."""
    from splitforge.operators.images import unreadable
    from splitforge.operators.sampling import seeded_sample

    rows = images if n is None else seeded_sample(images, seed, n, "origin")
    return finding(unreadable(rows), "unreadable image", "origin")
