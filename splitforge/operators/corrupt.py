"""Corruption and augmentation of vector samples: catalogues of conditions and kernels as data.

A kernel is a row: two sparse matrices, the spread of a drawn factor, the size of noise and the steps of rounding. Blur,
resampling, crop, brightness and contrast are linear maps of a vector, so one expression applies them all to whatever
row a sample was joined with; the plan doesn't grow with the number of conditions. Draws depend on seed, condition,
parameter and sample, never on partitions or row order. Kernels that aren't of this form can be added as functions of Columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitforge.functions.columns import bound, hash_order, normal, uniform
from splitforge.operators.joins import samples_by_conditions

#: The conditions of the robustness sweep as (name, parameter as shown, value).
SWEEP = (
    ("clean", "-", None), ("jpeg", "q90", 90.0), ("jpeg", "q70", 70.0), ("jpeg", "q50", 50.0), ("jpeg", "q30", 30.0),
    ("blur", "sigma0.5", 0.5), ("blur", "sigma1.0", 1.0), ("blur", "sigma2.0", 2.0), ("resize", "scale0.5", 0.5), ("resize", "scale0.25", 0.25),
    ("noise", "sigma0.02", 0.02), ("noise", "sigma0.05", 0.05), ("noise", "sigma0.10", 0.10),
    ("color_jitter", "brightness_pm20", 0.2), ("color_jitter", "contrast_pm20", 0.2), ("color_jitter", "saturation_pm20", 0.2), ("center_crop", "keep0.80", 0.8),
)
#: The probe sweeps (sweep, steps) and the older corruption set.
PROBES = (("grain", (0.0, 4.0, 8.0, 12.0, 16.0, 24.0)), ("blur", (0.0, 0.5, 1.0, 2.0)), ("downscale", (1024.0, 512.0, 256.0, 128.0, 64.0)))
LEGACY = (("jpeg", "q35", 35.0), ("blur", "radius2", 2.0), ("resize", "scale0.5", 0.5), ("noise", "sigma15", 15.0 / 255), ("color_jitter", "brightness_pm30", 0.3), ("center_crop", "keep0.80", 0.8))


#: Lengths of vectors that a call may meet, at most.
MAX_LENGTHS = 64


def catalogue(spark: SparkSession, conditions: Sequence[tuple] = SWEEP) -> DataFrame:
    """(ord, name, param, value) of the conditions, for a broadcast join."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(conditions)], "ord int, name string, param string, value double")


Sparse = list[list[tuple[int, float]]]


@dataclass(frozen=True)
class Kernel:
    """What becomes of a vector v: f * (mix v) + (1 - f) * (rest v), then noise, then rounding.

    mix has for each position the (position, weight) pairs that are summed for it, none is the identity; rest has the pairs of
    one sum that is the same for all positions, none is zero.
    f is drawn evenly from 1 - spread to 1 + spread. sigma is the size of normal noise in halves of the range, after which values are
    clipped to [-1, 1]; steps is how many levels a unit is rounded to. What is 0 is left out.
    """

    mix: Sparse | None = None
    rest: list[tuple[int, float]] | None = None
    spread: float = 0.0
    sigma: float = 0.0
    steps: float = 0.0


def identity(value: float, n: int) -> Kernel:
    return Kernel()


def quantise(quality: float, n: int) -> Kernel:
    """Rounding to levels of quality / 100 * 64 steps a unit; stands for recompression."""
    return Kernel(steps=quality * 0.64)


def blur(sigma: float, n: int) -> Kernel:
    """A normalised Gaussian window over positions, the ends repeated."""
    if sigma <= 0:
        return Kernel()
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    return Kernel(mix=[[(min(max(i + k, 0), n - 1), w / total) for k, w in zip(range(-reach, reach + 1), weights)] for i in range(n)])


def down_up(scale: float, n: int) -> Kernel:
    """Means of blocks of round(1 / scale) positions, repeated to the old length."""
    block = max(1, round(1 / scale))
    blocks = [range(i // block * block, min(i // block * block + block, n)) for i in range(n)]
    return Kernel(mix=[[(j, 1 / len(b)) for j in b] for b in blocks])


def noise(sigma: float, n: int) -> Kernel:
    """Normal noise of sigma times the full range 2, clipped to [-1, 1]."""
    return Kernel(sigma=sigma)


def brightness(spread: float, n: int) -> Kernel:
    return Kernel(spread=spread)


def contrast(spread: float, n: int) -> Kernel:
    return Kernel(rest=[(j, 1 / n) for j in range(n)], spread=spread)


def centre_crop(keep: float, n: int) -> Kernel:
    """The middle share of the positions, stretched to the old length by the nearest index."""
    inner = math.floor(n * keep)
    first = (n - inner) // 2
    return Kernel(mix=[[(first + math.floor((i + 0.5) * inner / n), 1.0)] for i in range(n)])


Build = Callable[[float, int], Kernel]
Custom = Callable[..., Column]


@dataclass(frozen=True)
class Transform:
    """A named transform: how its kernel is built from parameter and length, or its own Column; and what its parameter is."""

    parameter: str
    values: tuple[float, ...]
    build: Build | None = None
    column: Custom | None = None


#: The transforms of vectors by name, with the parameters that random augmentation draws from; add() takes more.
TRANSFORMS: dict[str, Transform] = {
    "clean": Transform("", (), identity), "jpeg": Transform("quality in percent", (90.0, 70.0, 50.0, 30.0), quantise), "blur": Transform("sigma in positions", (0.5, 1.0, 2.0), blur),
    "resize": Transform("scale", (0.5, 0.25), down_up), "noise": Transform("sigma as a share of the range", (0.02, 0.05, 0.1), noise), "brightness": Transform("spread of the factor", (0.2,), brightness),
    "contrast": Transform("spread of the factor", (0.2,), contrast), "center_crop": Transform("share kept", (0.8,), centre_crop),
}
#: Names and parameters of random augmentation.
BANKS = {name: t.values for name, t in TRANSFORMS.items() if t.values}


def add(name: str, column: Custom | None = None, build: Build | None = None, parameter: str = "", values: Sequence[float] = ()) -> None:
    """Take a transform: `build` gives its kernel for a parameter and a length, or `column` a Column of the vector, the
    parameter and the parts that seed its draws."""
    if (column is None) == (build is None):
        raise ValueError("a transform is either a kernel or a Column")
    TRANSFORMS[name] = Transform(parameter, tuple(values), build, column)


def remove(name: str) -> None:
    TRANSFORMS.pop(name, None)


def named(name: str) -> Transform:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; there are {', '.join(sorted(TRANSFORMS))}")
    return TRANSFORMS[name]


def described(spark: SparkSession) -> DataFrame:
    """(name, parameter, values, form) of the transforms of vectors: what the parameter means, which are drawn, and whether
    the transform is a kernel or a Column."""
    rows = [(name, t.parameter, list(t.values), "kernel" if t.build else "column") for name, t in sorted(TRANSFORMS.items())]
    return spark.createDataFrame(rows, "name string, parameter string, values array<double>, form string")


_CELLS = pa.list_(pa.struct([("pos", pa.int32()), ("w", pa.float64())]))
_KERNEL = pa.struct([("mix", pa.list_(_CELLS)), ("rest", _CELLS), ("spread", pa.float64()), ("sigma", pa.float64()), ("steps", pa.float64())])


def _lengths(samples: DataFrame, vector: str, lengths: Sequence[int] | None) -> list[int]:
    """The lengths given, or those that there are, which takes a pass over the samples."""
    if lengths is not None:
        return sorted(set(lengths))
    found = [r[0] for r in samples.where(F.size(vector) > 0).select(F.size(vector)).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(found) > MAX_LENGTHS:
        raise ValueError(f"vectors have more than {MAX_LENGTHS} lengths")
    return sorted(found)


def kernels(spark: SparkSession, entries: Sequence[tuple[tuple, str, float | None]], key: str, lengths: Sequence[int]) -> DataFrame:
    """A table of (key columns, n, kernel) for (key values, transform, parameter) entries and lengths of vectors; of
    transforms that are Columns there are no rows. Its size is that of the catalogue times the lengths."""
    names = [c.split()[0] for c in key.split(",")]
    rows = [(k, n, t.build(0.0 if value is None else value, n)) for k, name, value in entries for n in lengths if (t := named(name)).build]
    columns = {c: [k[i] for k, _, _ in rows] for i, c in enumerate(names)}
    cells = lambda row: row and [{"pos": p, "w": w} for p, w in row]
    made = [{"mix": k.mix and [cells(row) for row in k.mix], "rest": cells(k.rest), "spread": k.spread, "sigma": k.sigma, "steps": k.steps} for _, _, k in rows]
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in key.split(",")]
    table = pa.table({**columns, "n": [n for _, n, _ in rows], "kernel": made}, schema=pa.schema([*fields, ("n", pa.int32()), ("kernel", _KERNEL)]))
    return spark.createDataFrame(table)


def applied(v: Column, kernel: Column, *seed) -> Column:
    """What the kernel makes of the vector; a null kernel leaves it."""

    def total(row: Column, of: Column) -> Column:
        return F.aggregate(row, F.lit(0.0), lambda a, s: a + F.get(of, s["pos"]) * s["w"])

    def mixed(of: Column) -> Column:
        own = F.when(kernel["mix"].isNull(), of).otherwise(F.transform(kernel["mix"], lambda row: total(row, of)))
        factor = 1 - kernel["spread"] + 2 * kernel["spread"] * uniform(*seed, "factor")
        drawn = F.struct(factor.alias("f"), ((1 - factor) * F.when(kernel["rest"].isNull(), 0.0).otherwise(total(kernel["rest"], of))).alias("rest"))
        return F.when(kernel["spread"] > 0, bound(drawn, lambda d: F.transform(own, lambda x: d["f"] * x + d["rest"]))).otherwise(own)

    def noisy(of: Column) -> Column:
        one = F.lit(1.0)
        return F.when(kernel["sigma"] > 0, F.transform(of, lambda x, i: F.greatest(-one, F.least(one, x + 2 * kernel["sigma"] * normal(*seed, i))))).otherwise(of)

    def stepped(of: Column) -> Column:
        return F.when(kernel["steps"] > 0, F.transform(of, lambda x: F.round(x * kernel["steps"]) / kernel["steps"])).otherwise(of)

    # Each part binds what it starts from, or Spark would compute it again for every use.
    return F.when(kernel.isNull(), v).otherwise(bound(bound(bound(v, mixed), noisy), stepped))


def _transform_of(name: str, param: str) -> str:
    """Jitter names its transform in the parameter; saturation is the identity for vectors, which have no colours."""
    if name != "color_jitter":
        return name
    kind = param.split("_")[0]
    return "clean" if kind == "saturation" else kind


def _known(v: Column, n: Column, lengths: Sequence[int]) -> Column:
    """The vector, or an error for a length that the kernels weren't built for."""
    wrong = F.raise_error(F.format_string("a vector has %s components, kernels are for others", n)).cast("array<double>")
    return F.when(v.isNull() | (n == 0) | n.isin(*lengths), v).otherwise(wrong)


def _with_custom(out: Column, v: Column, cases: Sequence[tuple[Column, Transform, float | None, tuple]]) -> Column:
    """`out`, or the own Column of the transforms that have one."""
    for here, transform, value, seed in cases:
        if transform.column:
            out = F.when(here, transform.column(v, 0.0 if value is None else value, *seed)).otherwise(out)
    return out


def sweep(samples: DataFrame, seed: int, conditions: Sequence[tuple] = SWEEP, vector: str = "features", id_col: str = "sample_id", lengths: Sequence[int] | None = None) -> DataFrame:
    """Every sample under every condition: samples with (ord, name, param, value) and the transformed vector.

    Broadcast joins and one projection; samples are dealt out before they multiply. `lengths`: the lengths that vectors have, where they are known.
    """
    spark = samples.sparkSession
    sizes = _lengths(samples, vector, lengths)
    table = kernels(spark, [((name, param), _transform_of(name, param), value) for name, param, value in conditions], "name string, param string", sizes)
    rows = samples_by_conditions(samples.withColumn(vector, F.col(vector).cast("array<double>")), catalogue(spark, conditions))
    rows = rows.withColumn("n", F.size(vector)).join(F.broadcast(table), ["name", "param", "n"], "left")
    v, parts = _known(F.col(vector), F.col("n"), sizes), (seed, F.col("name"), F.col("param"), F.col(id_col))
    cases = [((F.col("name") == name) & (F.col("param") == param), named(_transform_of(name, param)), value, parts) for name, param, value in conditions]
    return rows.withColumn(vector, _with_custom(applied(v, F.col("kernel"), *parts), v, cases)).select(*samples.columns, "ord", "name", "param", "value")


def _probe_kernel(name: str, step: int, value: float) -> tuple[str, float]:
    """The transform of a probe's step: step 0 is the identity, and downscaling never upsamples."""
    if step == 0:
        return "clean", 0.0
    return {"grain": ("noise", value / 255), "blur": ("blur", value), "downscale": ("resize", min(1.0, value / 1024))}[name]


def probe_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(sweep, step, value) for sweep, steps in PROBES for step, value in enumerate(steps)]
    return spark.createDataFrame(rows, "sweep string, step int, value double")


def probe(samples: DataFrame, seed: int, vector: str = "features", id_col: str = "sample_id", lengths: Sequence[int] | None = None) -> DataFrame:
    """Every sample at every step of the probe sweeps."""
    spark = samples.sparkSession
    sizes = _lengths(samples, vector, lengths)
    table = kernels(spark, [((name, step), *_probe_kernel(name, step, value)) for name, steps in PROBES for step, value in enumerate(steps)], "sweep string, step int", sizes)
    rows = samples_by_conditions(samples.withColumn(vector, F.col(vector).cast("array<double>")), probe_catalogue(spark))
    rows = rows.withColumn("n", F.size(vector)).join(F.broadcast(table), ["sweep", "step", "n"], "left")
    out = applied(_known(F.col(vector), F.col("n"), sizes), F.col("kernel"), seed, F.col("sweep"), F.col("step"), F.col(id_col))
    return rows.withColumn(vector, out).select(*samples.columns, "sweep", "step", "value")


def augmented(samples: DataFrame, seed: int, p: float = 0.5, num: int = 2, names: Sequence[str] = tuple(BANKS), vector: str = "features", id_col: str = "sample_id", lengths: Sequence[int] | None = None) -> DataFrame:
    """With probability p, `num` distinct transforms in drawn order with drawn parameters; labels stay.

    Adds `applied`, the transforms of each row in order. An unknown name is an error.
    """
    banks = {n: named(n).values or (0.0,) for n in names}
    sizes = _lengths(samples, vector, lengths)
    sample = F.col(id_col)
    order = F.array_sort(F.array(*(F.struct(hash_order(seed, "order", F.lit(n), sample).alias("h"), F.lit(n).alias("n"), F.lit(len(b)).alias("many")) for n, b in banks.items())))
    picks = F.when(uniform(seed, "gate", sample) < p, F.slice(order, 1, num)).otherwise(F.slice(order, 1, 0))
    rows = samples.withColumn("__picks", picks).withColumn(vector, F.col(vector).cast("array<double>")).withColumn("__n", F.size(vector))
    rows = rows.withColumn("applied", F.transform("__picks", lambda s: s["n"])).withColumn(vector, _known(F.col(vector), F.col("__n"), sizes))
    entries = [((n, i), n, value) for n, bank in banks.items() for i, value in enumerate(bank)]
    table = kernels(samples.sparkSession, entries, "name string, index int", sizes).withColumnsRenamed({"name": "__name", "index": "__index", "n": "__of", "kernel": "__kernel"})
    for k in range(num):
        pick = F.get("__picks", F.lit(k))
        index = F.floor(uniform(seed, "parameter", pick["n"], sample) * pick["many"]).cast("int")
        placed = rows.withColumn("__pick", pick["n"]).withColumn("__at", index)
        joined = placed.join(F.broadcast(table), (F.col("__pick") == F.col("__name")) & (F.col("__at") == F.col("__index")) & (F.col("__n") == F.col("__of")), "left")
        parts = (seed, F.col("__pick"), k, sample)
        cases = [((F.col("__pick") == n) & (F.col("__at") == i), named(n), value, parts) for (n, i), _, value in entries]
        rows = joined.withColumn(vector, _with_custom(applied(F.col(vector), F.col("__kernel"), *parts), F.col(vector), cases)).select(*rows.columns)
    return rows.select(*samples.columns, "applied")


def legacy(samples: DataFrame, seed: int, p: float = 0.5, vector: str = "features", id_col: str = "sample_id", lengths: Sequence[int] | None = None) -> DataFrame:
    """With probability p one of the older corruptions, drawn evenly; `applied` names it, or is null."""
    sample, sizes = F.col(id_col), _lengths(samples, vector, lengths)
    pick = F.when(uniform(seed, "gate", sample) < p, F.floor(uniform(seed, "pick", sample) * len(LEGACY)).cast("int"))
    table = kernels(samples.sparkSession, [((i, name, f"{name}:{param}"), _transform_of(name, param), value) for i, (name, param, value) in enumerate(LEGACY)], "__pick int, __name string, applied string", sizes)
    rows = samples.withColumn("__pick", pick).withColumn(vector, F.col(vector).cast("array<double>")).withColumn("n", F.size(vector))
    rows = rows.join(F.broadcast(table), ["__pick", "n"], "left")
    out = applied(_known(F.col(vector), F.col("n"), sizes), F.col("kernel"), seed, F.col("__name"), sample)
    return rows.withColumn(vector, out).select(*samples.columns, "applied")


def capped_dimensions(df: DataFrame, most: int, width: str = "orig_w", height: str = "orig_h") -> DataFrame:
    """df with `w` and `h`: the sizes scaled so that the longer side is at most `most`, never below 1; the old ones stay."""
    longest = F.greatest(width, height)
    scale = F.when(longest > most, most / longest).otherwise(1.0)
    return df.withColumn("w", F.greatest(F.lit(1), F.bround(F.col(width) * scale).cast("int"))).withColumn("h", F.greatest(F.lit(1), F.bround(F.col(height) * scale).cast("int")))
