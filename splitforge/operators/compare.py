"""Comparison and report tables of two or more models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.functions.columns import condition_tag, drop, gap, reconstructed_counts, retention
from splitforge.operators.joins import with_availability, with_clean
from splitforge.operators.metrics import classification, macro_mean, rates, roc_auc


def derived_benchmark(wide: DataFrame, positives: int = 5000, negatives: int = 5000, models: Sequence[str] = ("baseline", "robust")) -> DataFrame:
    """The wide benchmark (name, param, <model>_acc, <model>_f1, <model>_auc) with tags, gaps, retentions and
    reconstructed errors."""
    base, robust = models
    clean = wide.where(F.col("name") == "clean").select(*(F.col(f"{m}_{v}").alias(f"clean_{m}_{v}") for m in models for v in ("acc", "f1")))
    rows = wide.crossJoin(F.broadcast(clean.limit(1))).withColumn("label", condition_tag("name", "param"))
    for v in ("acc", "f1", "auc"):
        rows = rows.withColumn(f"{v}_gap", gap(f"{robust}_{v}", f"{base}_{v}"))
    for v in ("acc", "f1"):
        for m in models:
            rows = rows.withColumn(f"{m}_{v}_retention", retention(f"{m}_{v}", f"clean_{m}_{v}"))
    for m in models:
        counts = reconstructed_counts(f"{m}_acc", f"{m}_f1", positives, negatives)
        rows = rows.withColumn(f"{m}_fp", counts["fp"]).withColumn(f"{m}_fn", counts["fn"]).withColumn(f"{m}_bound", counts["tp_bound"])
    return rows.drop(*(f"clean_{m}_{v}" for m in models for v in ("acc", "f1")))


def clean_and_transformed(metrics: DataFrame, values: Sequence[str] = ("accuracy", "f1", "roc_auc")) -> DataFrame:
    """(model, metric, clean, transformed): the clean value and the mean over the other conditions."""
    means = macro_mean(metrics, values, with_clean=False)
    clean = metrics.where(F.col("name") == "clean").select("model", *values)
    names = ", ".join(f"'{v}', {v}, mean_{v}" for v in values)
    return clean.join(means, "model").selectExpr("model", f"stack({len(values)}, {names}) AS (metric, clean, transformed)")


def retention_matrix(metrics: DataFrame, models: Sequence[str], value: str = "accuracy") -> DataFrame:
    """Conditions by models: the share of the clean value that is left."""
    rows = with_clean(metrics, [value]).withColumn("r", retention(value, f"clean_{value}"))
    return rows.groupBy("name", "param").pivot("model", list(models)).agg(F.first("r"))


def robustness_summary(scored: DataFrame, base: str = "baseline", robust: str = "robust") -> DataFrame:
    """Metrics of each (model, name, param) with retention and drop against the model's clean ones and the gap between
    the two models' accuracies."""
    keys = ["model", "name", "param"]
    rows = classification(scored, keys).join(roc_auc(scored, keys), keys, "left")
    rows = with_clean(rows, ["accuracy", "f1"])
    for v in ("accuracy", "f1"):
        rows = rows.withColumn(f"{v}_retention", retention(v, f"clean_{v}")).withColumn(f"{v}_drop", drop(v, f"clean_{v}"))
    pair = rows.groupBy("name", "param").agg((F.max(F.when(F.col("model") == robust, F.col("accuracy"))) - F.max(F.when(F.col("model") == base, F.col("accuracy")))).alias("accuracy_gap"))
    return rows.drop("clean_accuracy", "clean_f1").join(pair, ["name", "param"])


def generalisation(expected: DataFrame, scored: DataFrame, base: str) -> DataFrame:
    """A row for every expected model on one held-out set: metrics, rates and the difference of accuracy from `base`."""
    rows = classification(scored, ["model"]).join(rates(scored, ["model"]), "model").join(roc_auc(scored, ["model"]), "model", "left")
    out = with_availability(expected, rows)
    reference = rows.where(F.col("model") == base).select(F.col("accuracy").alias("__base")).limit(1)
    return out.crossJoin(F.broadcast(reference)).withColumn("accuracy_delta", F.col("accuracy") - F.col("__base")).drop("__base")


def sensitivity(curves: DataFrame, models: Sequence[str]) -> DataFrame:
    """The mean curves of all models side by side: one row for each cohort, sweep and step."""
    return curves.groupBy("cohort", "sweep", "step").pivot("model", list(models)).agg(F.first("mean_p"))


def gap_ranking(rows: DataFrame, by: str = "acc_gap", n: int | None = None, gains: bool = False) -> DataFrame:
    """Rows by ascending gap, or the n strongest gains."""
    ordered = rows.orderBy(F.desc(by) if gains else F.asc(by), "name", "param")
    return ordered if n is None else ordered.limit(n)


