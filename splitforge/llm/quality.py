"""A sparse rule ensemble over text statistics.

Shallow trees fitted on labelled rows give paths; each path is a conjunction of comparisons of statistics. A lasso
logistic regression over these rules and the clipped statistics keeps the few that matter, and the kept ones are
compiled into one Spark column expression that scores any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitforge.llm import flat
from splitforge.llm.shared import stored

#: Rows of the fitting sample at most, about; the sample is by hash of the id.
MAX_ROWS = 30_000
TREES, DEPTH, LASSO = 12, 3, 0.0005

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "mark": b".,;:?'\"()-",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
}
STATISTICS = ["chars", "words", "lines", "word_size", "line_words", *(f"{k}_share" for k in _KINDS), "wide_share", "odd_ends", "odd_starts", "repeats", "variety", "short_words", "plain_words", "line_variety"]


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct values in each row."""
    owner = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
    keys = np.unique(flat.mix(owner + np.uint64(1)) ^ hashes, return_index=True)[1]
    return np.bincount(owner[keys].astype(np.int64), minlength=len(rows) - 1).astype(np.float64)


def statistics_of(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; null counts as empty, and an empty text has zeros."""
    words = flat.Words(texts, lower=False)
    raw, at, rows = words.raw, words.offsets, words.rows
    n_bytes = np.maximum(np.diff(at), 1).astype(np.float64)
    n_words = np.diff(rows).astype(np.float64)
    some = np.maximum(n_words, 1)
    out = [_row_sums((raw & 0xC0) != 0x80, at), n_words]
    newline = np.append(raw == 10, False)
    lines = _row_sums(newline[:-1], at) + (np.diff(at) > 0)
    sizes = words.ends - words.starts
    out += [lines, _row_sums(sizes, rows) / some, n_words / np.maximum(lines, 1)]
    for letters in _KINDS.values():
        table = np.zeros(256, bool)
        table[list(letters)] = True
        out.append(_row_sums(table[raw], at) / n_bytes)
    out.append(_row_sums(raw >= 128, at) / n_bytes)
    odd = np.zeros(256, bool)
    odd[list(_KINDS["symbol"] + b"!|")] = True
    if len(words.starts):
        first, last = raw[words.starts], raw[words.ends - 1]
    else:
        first = last = np.empty(0, np.uint8)
    letter = np.zeros(256, bool)
    letter[list(range(97, 123))] = True
    letter[128:] = True
    again = np.zeros(len(words.hashes), bool)
    if len(again):
        again[1:] = words.hashes[1:] == words.hashes[:-1]
        again[rows[:-1][rows[:-1] < len(again)]] = False
    out += [_row_sums(odd[last], rows) / some, _row_sums(odd[first], rows) / some, _row_sums(again, rows) / some]
    out += [_distinct(words.hashes, rows) / some, _row_sums(sizes <= 3, rows) / some, _row_sums(letter[last], rows) / some]
    ends = np.zeros(len(raw) + 1, bool)
    ends[:-1] = newline[:-1]
    line_ends = np.union1d(np.flatnonzero(newline), at[1:][np.diff(at) > 0])
    line_starts = np.concatenate([[0], line_ends[:-1]]).astype(np.int64) if len(line_ends) else np.empty(0, np.int64)
    line_hash = flat.span_hashes(flat.BYTE_VALUE[raw], np.minimum(line_starts + newline[np.minimum(line_starts, len(newline) - 1)], line_ends), line_ends) if len(line_ends) else np.empty(0, np.uint64)
    line_rows = np.searchsorted(line_ends, at[1:], "right")
    line_rows = np.concatenate([[0], line_rows]).astype(np.int64)
    out.append(_distinct(line_hash, line_rows) / np.maximum(np.diff(line_rows), 1))
    return np.stack(out, axis=1)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the columns of STATISTICS) of every row, computed from its whole text where the row is read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for first, rows in flat.slices(texts):
                table = statistics_of(texts.slice(first, rows))
                yield pa.record_batch([batch.column(0).slice(first, rows), *(pa.array(c) for c in table.T)], names=[id_col, *STATISTICS])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(work, f"`{id_col}` {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, '<=' or '>', threshold)."""

    parts: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, sign, bound in self.parts:
            held = held & (F.col(name) <= bound if sign == "<=" else F.col(name) > bound)
        return F.coalesce(held, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Weighted rules, weighted statistics clipped to a range and scaled to 0..1, and an intercept."""

    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[str, float, float, float], ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 from the columns of STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        for name, low, high, weight in self.linear:
            total = total + _clipped(name, low, high) * weight
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _clipped(name: str, low: float, high: float) -> Column:
    value = F.coalesce(F.col(name), F.lit(0.0))
    return (F.greatest(F.least(value, F.lit(high)), F.lit(low)) - low) / (high - low)


def _paths(node, names: list[str], parts: tuple = ()) -> Iterator[Rule]:
    """Rules of all nodes below the root of a fitted tree."""
    if node.numDescendants() == 0:
        return
    split = node.split()
    name, bound = names[split.featureIndex()], float(split.threshold())
    for child, sign in ((node.leftChild(), "<="), (node.rightChild(), ">")):
        own = (*parts, (name, sign, bound))
        yield Rule(own)
        yield from _paths(child, names, own)


def tree_rules(rows: DataFrame, names: list[str] = STATISTICS, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """The distinct paths of a small forest fitted on rows with `label` and the named columns."""
    data = rows.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=48, minInstancesPerNode=5).fit(data)
    found: dict[Rule, None] = {}
    for tree in forest.trees:
        found.update(dict.fromkeys(_paths(tree._call_java("rootNode"), names)))
    return list(found)


def fit(rows: DataFrame, names: list[str] = STATISTICS, lasso: float = LASSO) -> Model:
    """Fit on rows with `label` (0 or 1) and the named columns.

    No rows give a score of 0.5 for any text; rows of one class give its smoothed share.
    """
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, n = seen.get(1, 0), sum(seen.values())
    if good == 0 or good == n:
        return Model((), (), math.log((good + 1) / (n - good + 1)))
    rules = tree_rules(rows, names)
    bounds = rows.select(*(F.percentile_approx(c, [0.02, 0.98], 1000).alias(c) for c in names)).first()
    linear = [(c, float(bounds[c][0]), float(bounds[c][1])) for c in names if bounds[c][1] > bounds[c][0]]
    columns = [r.column().cast("double") for r in rules] + [_clipped(*x) for x in linear]
    data = rows.select("label", array_to_vector(F.array(*columns)).alias("features"))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(data)
    weights = fitted.coefficients.toArray()
    kept = tuple((r, float(w)) for r, w in zip(rules, weights) if w)
    lines = tuple((*x, float(w)) for x, w in zip(linear, weights[len(rules) :]) if w)
    return Model(kept, lines, float(fitted.intercept))


def training_rows(ids: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int = MAX_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(id_col, label) of at most about `most` labelled rows of `ids` whose crc32(id) mod `parts` isn't `held_out`.

    A bounded sample by hash of the id; conflicting labels of one id count by their mean, null ones not at all.
    """
    named = labels.select(F.col(id_col), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col(id_col).isNotNull())
    named = named.where(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) != held_out)
    named = named.groupBy(id_col).agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    named = named.join(ids.select(id_col).distinct(), id_col, "left_semi")
    n = named.count()
    return named if n <= most else named.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every document, from its text alone.

    Labels are learnt from rows whose crc32(id) mod 3 isn't 1. The statistics are computed once, in one pass over the
    texts, and kept in the shared folder. Null and empty texts are scored by their zero statistics; repeated rows are
    scored as they are; an empty table gives no rows; further columns of either table are ignored.
    """
    rows = stored(statistics(docs.select(id_col, text_col), id_col, text_col), "statistics")
    return with_score(rows, fitted(rows, labels, id_col), id_col)


def fitted(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """The model of rows of statistics whose crc32(id) mod 3 isn't 1; of several rows of one id the least counts."""
    # The labelled ids are few: statistics of others don't get as far as the sums.
    learnt = stored(training_rows(rows, labels, "quality", 3, 1, id_col=id_col), "training")
    known = rows.join(learnt.select(id_col), id_col, "left_semi")
    once = stored(known.select(id_col, F.struct(*STATISTICS).alias("s")), "known").groupBy(id_col).agg(F.min("s").alias("s")).select(id_col, "s.*")
    return fit(stored(once.join(learnt, id_col), "labelled").coalesce(4))


def with_score(rows: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
    scored = rows.select(id_col, held.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
