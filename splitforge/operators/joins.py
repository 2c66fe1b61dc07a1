"""Joins of samples, conditions, models and splits. Hints stand only on tables whose size is fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def samples_by_conditions(samples: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every sample with every condition; `conditions` is a catalogue of a few rows."""
    return samples.crossJoin(F.broadcast(conditions))


def by_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Every (already transformed) row with every model, so all models score identical inputs; a few models."""
    return rows.crossJoin(F.broadcast(models))


def with_clean(metrics: DataFrame, values: Sequence[str], model: str = "model", name: str = "name") -> DataFrame:
    """metrics with `clean_<value>`, the model's values under the clean condition."""
    clean = metrics.where(F.col(name) == "clean").select(model, *(F.col(v).alias(f"clean_{v}") for v in values))
    return metrics.join(clean, model, "left")


def compared_runs(frozen: DataFrame, new: DataFrame, values: Sequence[str], keys: Sequence[str] = ("name", "param")) -> DataFrame:
    """The frozen rows (with `ord`) and beside them the new values as text, or - where there is none; in display order."""
    fresh = new.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values))
    joined = frozen.join(fresh, list(keys), "left")
    return joined.select("ord", *keys, *values, *(F.coalesce(F.col(f"new_{v}").cast("string"), F.lit("-")).alias(f"new_{v}") for v in values)).orderBy("ord")


def with_availability(expected: DataFrame, results: DataFrame, model: str = "model") -> DataFrame:
    """A row for every expected model; `status` is missing where it has no results, whose values stay null."""
    there = results.withColumn("status", F.lit("ok"))
    return expected.join(there, model, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def held_out_present(df: DataFrame, held_generators: DataFrame, held_sources: DataFrame) -> DataFrame:
    """Rows whose generator (label 1) or source (label 0) is held out."""
    made = df.where("label = 1").join(held_generators, "generator", "left_semi").select(*df.columns)
    real = df.where("label = 0").join(held_sources, "source", "left_semi").select(*df.columns)
    return made.unionByName(real)


def without_groups(df: DataFrame, groups: DataFrame, applies: Column | None = None, group: str = "group") -> DataFrame:
    """df without the rows of the groups to which the predicate applies."""
    if applies is None:
        return df.join(groups, group, "left_anti").select(*df.columns)
    marked = df.join(groups.distinct().withColumn("__held", F.lit(True)), group, "left")
    return marked.where(~(F.col("__held").isNotNull() & F.coalesce(applies, F.lit(False)))).select(*df.columns)


def not_in_manifest(scored: DataFrame, manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """Scored samples that the manifest doesn't list; none are expected."""
    return scored.join(manifest, key, "left_anti")


def missing_files(manifest: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """Manifest rows whose file a listing of the storage doesn't hold."""
    return manifest.join(listing.select(key).distinct(), key, "left_anti")
