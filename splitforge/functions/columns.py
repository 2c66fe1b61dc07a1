"""Projections, predicates and scalar expressions over manifests, scores and metric tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest value of a 15-digit hexadecimal prefix, plus one.
_SPAN = 16**15


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row.

    An expression that a lambda refers to is computed again for every element; a lambda's own variable isn't.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Projections and predicates


def normalise_real(key: str | Column, names: Sequence[str] = ("real", "nature", "authentic", "human")) -> Column:
    """REAL for any of the names, whatever their case and outer blanks; else the key as it is. Null stays null."""
    return F.when(F.lower(F.trim(col(key))).isin([n.lower() for n in names]), F.lit("REAL")).otherwise(col(key))


def min_side_at_least(width: str | Column, height: str | Column, least: int) -> Column:
    """Whether the shorter side reaches the limit; false when either is null."""
    return F.coalesce((col(width) >= least) & (col(height) >= least), F.lit(False))


#: Inclusive upper bounds of the size buckets, and their names.
BUCKETS = ((96, "<=96"), (224, "96-224"), (512, "224-512"), (1024, "512-1024"))
LAST_BUCKET = ">1024"


def size_bucket(longest: str | Column, include_zero: bool = True) -> Column:
    """The size bucket of the longer side. A size of 0 (or less) belongs to the first, or with include_zero=False to none."""
    size = col(longest)
    out = F.when(size.isNull(), None) if include_zero else F.when(size.isNull() | (size <= 0), None)
    for bound, name in BUCKETS:
        out = out.when(size <= bound, F.lit(name))
    return out.otherwise(F.lit(LAST_BUCKET))


def predict(p: str | Column, threshold: float = 0.5, tie: int = 1) -> Column:
    """1 where p reaches the threshold; a tie gives `tie`. Null stays null."""
    return ((col(p) >= threshold) if tie else (col(p) > threshold)).cast("int")


def condition_tag(name: str | Column, param: str | Column) -> Column:
    """name, or name:param where there is a parameter."""
    return F.when(col(param) == "-", col(name)).otherwise(F.concat_ws(":", col(name), col(param)))


def rounded(value: str | Column, places: int = 6) -> Column:
    return F.round(col(value), places)


def gap_verdict(gap: str | Column, gain: float = 0.03, loss: float = -0.005) -> Column:
    return F.when(col(gap) > gain, "gain").when(col(gap) < loss, "loss").when(col(gap).isNotNull(), "neutral")


def known_key(key: str | Column, unknown: str = "unknown") -> Column:
    """The key, or `unknown` where it is null or blank."""
    return F.when(F.coalesce(F.trim(col(key)), F.lit("")) == "", unknown).otherwise(col(key))


def unreadable(p: str | Column, policy: str = "exclude") -> Column:
    """What becomes of a row without a prediction: the prediction to use (zero, fail), or null for rows to leave out."""
    p = col(p)
    missing = p.isNull() | F.isnan(p)
    if policy == "zero":
        return F.when(missing, 0.0).otherwise(p)
    if policy == "fail":
        return F.when(missing, F.raise_error(F.lit("a row has no prediction")).cast("double")).otherwise(p)
    if policy in ("exclude", "skip"):
        return F.when(~missing, p)
    raise ValueError(f"unknown policy {policy!r}")


# Hashes and seeded draws: functions of values only, never of partitioning or row order


def content_hash(content: str | Column) -> Column:
    return F.sha2(col(content).cast("binary"), 256)


def _joined(parts: Sequence) -> Column:
    return F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def derived_seed(*parts) -> Column:
    """The first 8 bytes of the sha256 of the parts joined by bars, as an unsigned number; columns or plain values."""
    return F.conv(F.substring(F.sha2(_joined(parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seed_prefix(*parts) -> Column:
    """The first 15 hexadecimal digits of that sha256, as a long."""
    return F.conv(F.substring(F.sha2(_joined(parts), 256), 1, 15), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A draw in (0, 1) that the parts decide."""
    return (seed_prefix(*parts).cast("double") + 1.0) / float(_SPAN + 1)


def normal(*parts) -> Column:
    """A standard normal draw that the parts decide, to 9 places (Box-Muller on two uniforms)."""
    first, second = uniform(*parts, "a"), uniform(*parts, "b")
    return F.round(F.sqrt(-2.0 * F.ln(first)) * F.cos(F.lit(2 * math.pi) * second), 9)


def hash_order(seed: int | str, *parts) -> Column:
    """A sort key that stands for a seeded shuffle."""
    return F.sha2(_joined([seed, *parts]), 256)


# Numbers


def gap(robust: str | Column, base: str | Column) -> Column:
    return col(robust) - col(base)


def retention(value: str | Column, clean: str | Column) -> Column:
    """value / clean, null where clean is 0 or null."""
    return F.when(col(clean) != 0, col(value) / col(clean))


def drop(value: str | Column, clean: str | Column) -> Column:
    return col(clean) - col(value)


def softmax_of_two(first: str | Column, second: str | Column) -> Column:
    """Probability of the second of two logits."""
    return 1.0 / (1.0 + F.exp(col(first) - col(second)))


def standardised(values: str | Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(x - mean) / std of an array, whose channel is the position modulo the number of channels."""
    means, stds = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(col(values), lambda x, i: (x - F.get(means, i % len(mean))) / F.get(stds, i % len(std)))


def reconstructed_counts(accuracy: str | Column, f1: str | Column, positives: int, negatives: int, slack: float = 0.0005) -> dict[str, Column]:
    """tp, fp, fn, tn from accuracy and F1 at known class totals, and tp_bound: how far rounding of F1 by `slack` can
    move tp. From 2tp / (2tp + errors) = f1 and errors = (1 - accuracy) * total."""
    total = positives + negatives
    a, f = col(accuracy), col(f1)
    perfect = f >= 1
    rest = F.when(~perfect, 1.0 - f)
    tp = F.bround(F.when(perfect, F.lit(float(positives))).otherwise(total / 2 * f * (1.0 - a) / rest))
    fp = F.greatest(F.lit(0.0), F.least(F.lit(float(negatives)), F.bround(tp - (total * a - negatives))))
    bound = total / 2 * (1.0 - a) * slack / (rest * rest)
    return {"tp": tp.cast("long"), "fp": fp.cast("long"), "fn": (positives - tp).cast("long"), "tn": (negatives - fp).cast("long"), "tp_bound": bound}


def perceptual_key(vector: str | Column) -> Column:
    """A hexadecimal key with a bit for each position above the array's median; vectors of 4 * k values."""

    def median(ordered: Column) -> Column:
        n = F.size(ordered)
        return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2

    def key(values: Column, middle: Column) -> Column:
        def digit(i: Column) -> Column:
            four = sum((F.when(F.get(values, i * 4 + k) > middle, 8 >> k).otherwise(0) for k in range(4)), F.lit(0))
            return F.substring(F.lit("0123456789abcdef"), four + 1, 1)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 4).cast("int") - 1), digit), "")

    doubles = F.transform(col(vector), lambda x: x.cast("double"))
    return bound(doubles, lambda values: bound(bound(F.array_sort(values), median), lambda middle: key(values, middle)))


def report_json(**parts: Column) -> Column:
    """A JSON object of the parts; nulls are kept out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(parts.items()))))
