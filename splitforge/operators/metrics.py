"""Metrics of binary classification, overall and by any keys, as aggregations over rows of (label, p, pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitforge.functions.columns import known_key, reconstructed_counts, size_bucket
from splitforge.operators.ranking import running_sums

COUNTS = ("tn", "fp", "fn", "tp")
#: Buckets of a group's distinct scores.
BUCKETS = 256


def _count(label: int, pred: int) -> Column:
    return F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("pred") == pred), 1).otherwise(0)), F.lit(0)).cast("long")


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp; zeros for an empty table without keys."""
    return df.groupBy(*by).agg(_count(0, 0).alias("tn"), _count(0, 1).alias("fp"), _count(1, 0).alias("fn"), _count(1, 1).alias("tp"))


def scores(counts: DataFrame) -> DataFrame:
    """counts with n, accuracy, precision, recall, f1: 0 where a denominator is 0, null without rows."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    n = tn + fp + fn + tp

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(n > 0, F.when(bottom == 0, 0.0).otherwise(top / bottom))

    return counts.select("*", n.alias("n"), F.when(n > 0, (tp + tn) / n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores(confusion(df, by))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, roc_auc): the exact area with ties counted half; null where one class is absent.

    Rows are summed to distinct scores, whose running sums are taken in two levels, so no task sees all of a group. The
    buckets lie between quantiles of the distinct scores, so scores that crowd somewhere share no bucket.
    """
    keys = list(by) or ["__all"]
    rows = df.where(F.col("p").isNotNull() & ~F.isnan("p"))
    rows = rows if by else rows.withColumn("__all", F.lit(1))
    points = rows.groupBy(*keys, "p").agg(F.sum(F.col("label")).alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    bounds = points.groupBy(*keys).agg(F.percentile_approx("p", [k / BUCKETS for k in range(1, BUCKETS)], 50 * BUCKETS).alias("__bounds"))
    placed = points.join(bounds, keys).withColumn("__at", F.size(F.filter("__bounds", lambda b: b < F.col("p")))).drop("__bounds")
    run = running_sums(placed, keys, "p", F.col("__at"), ["neg"])
    area = run.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)).alias("won"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return area.select(*by, F.when((F.col("all_pos") > 0) & (F.col("all_neg") > 0), F.col("won") / (F.col("all_pos") * F.col("all_neg"))).alias("roc_auc"))


def rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mean_p, fpr (predicted 1 among label 0), tpr (predicted 1 among label 1); null without rows of the label."""
    hit = F.col("pred").cast("double")
    return df.groupBy(*by).agg(F.avg("p").alias("mean_p"), F.avg(F.when(F.col("label") == 0, hit)).alias("fpr"), F.avg(F.when(F.col("label") == 1, hit)).alias("tpr"))


def by_key(df: DataFrame, label: int, key: str, rate: str) -> DataFrame:
    """(key, n, mean_p, rate) of the rows of one label; blank keys are unknown."""
    rows = df.where(F.col("label") == label).withColumn("__key", known_key(key))
    return rows.groupBy("__key").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("pred").cast("double")).alias(rate)).withColumnRenamed("__key", key)


def by_generator(df: DataFrame) -> DataFrame:
    return by_key(df, 1, "generator", "detected_rate")


def by_source(df: DataFrame) -> DataFrame:
    return by_key(df, 0, "source", "fp_rate")


def by_bucket(df: DataFrame, size: str = "size") -> DataFrame:
    """All metrics by size bucket; sizes of 0 belong to none and absent buckets have no row."""
    rows = df.withColumn("bucket", size_bucket(size, include_zero=False)).where("bucket IS NOT NULL")
    return classification(rows, ["bucket"]).join(rates(rows, ["bucket"]), "bucket").join(roc_auc(rows, ["bucket"]), "bucket", "left")


def composition(df: DataFrame, size: str = "size") -> DataFrame:
    """(split, kind, key, n): rows in all, by label, by (generator or source, label) and by size bucket, from one scan."""
    rows = df.select("split", "label", F.coalesce("generator", "source").alias("origin"), size_bucket(size).alias("bucket"))
    sets = rows.groupingSets([["split"], ["split", "label"], ["split", "origin", "label"], ["split", "bucket"]], "split", "label", "origin", "bucket").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "label").when(F.col("g") == 1, "origin").otherwise("bucket")
    key = F.when(F.col("g") == 3, F.col("label").cast("string")).when(F.col("g") == 1, F.concat_ws("/", "origin", "label")).when(F.col("g") == 6, F.col("bucket")).otherwise("")
    return sets.select("split", kind.alias("kind"), F.coalesce(key, F.lit("unknown")).alias("key"), "n")


def members(df: DataFrame) -> DataFrame:
    """(split, generators, sources): the sorted distinct names in each split."""
    return df.groupBy("split").agg(F.array_sort(F.collect_set("generator")).alias("generators"), F.array_sort(F.collect_set("source")).alias("sources"))


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_generated"))


def macro_mean(metrics: DataFrame, values: Sequence[str], with_clean: bool, by: Sequence[str] = ("model",), name: str = "name") -> DataFrame:
    """Means over conditions, with or without the clean one; null values are left out; n_conditions."""
    rows = metrics if with_clean else metrics.where(F.col(name) != "clean")
    return rows.groupBy(*by).agg(F.count("*").alias("n_conditions"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def summed_errors(metrics: DataFrame, by: Sequence[str] = ("model",), name: str = "name") -> DataFrame:
    """False positives and negatives over all conditions but the clean one."""
    return metrics.where(F.col(name) != "clean").groupBy(*by).agg(F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def reconstructed_errors(metrics: DataFrame, positives: int, negatives: int, by: Sequence[str] = ("model",), name: str = "name", accuracy: str = "accuracy", f1: str = "f1") -> DataFrame:
    """False positives and negatives that follow from published accuracy and F1, summed over all conditions but the clean one; and
    how far the rounding of F1 can move the sum of true positives."""
    counts = reconstructed_counts(accuracy, f1, positives, negatives)
    rows = metrics.where(F.col(name) != "clean").select(*by, *(c.alias(k) for k, c in counts.items()))
    return rows.groupBy(*by).agg(F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("tp_bound").alias("tp_bound"))


def sweep_curve(df: DataFrame, by: Sequence[str] = ("model", "cohort", "sweep"), step: str = "step") -> DataFrame:
    return df.groupBy(*by, step).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))


def sweep_ends(curve: DataFrame, by: Sequence[str] = ("model", "cohort", "sweep"), step: str = "step") -> DataFrame:
    """drop = first - last of the mean, rise = last - first."""
    ends = curve.groupBy(*by).agg(F.min_by("mean_p", step).alias("first"), F.max_by("mean_p", step).alias("last"))
    return ends.withColumn("drop", F.col("first") - F.col("last")).withColumn("rise", F.col("last") - F.col("first"))


def log_loss(df: DataFrame, by: Sequence[str] = (), smoothing: float = 0.0, floor: float = 1e-12) -> DataFrame:
    """Mean cross entropy, the target mixed with (1/2, 1/2) by `smoothing`."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - floor)), F.lit(floor))
    target = F.col("label") * (1 - smoothing) + smoothing / 2
    return df.groupBy(*by).agg(F.avg(-(target * F.ln(p) + (1 - target) * F.ln(1 - p))).alias("log_loss"))


def wide(metrics: DataFrame, models: Sequence[str], values: Sequence[str], keys: Sequence[str] = ("name", "param")) -> DataFrame:
    """One row a condition, the values of each model side by side as <model>_<value>."""
    return metrics.groupBy(*keys).pivot("model", list(models)).agg(*(F.first(v).alias(v) for v in values))
