"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.llm.shared import passing, stored


def _down(links: DataFrame) -> DataFrame:
    """Links from the greater to the lesser end, without loops and repeats."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b): the least id that can be reached, for all ids but that one.

    Each round links every node to the least of its neighbours, so paths shrink by a constant factor; rounds end when
    nothing changes. All steps are joins and sums on a node's id, so a node with many links is split like any skewed
    join; each round's links are written to the shared folder, and only a count and a check sum reach the driver. Of the
    rounds' tables only the last stays there.
    """
    with passing(links.sparkSession) as put:
        return stored(_rounds(links, put).select(F.col("a").alias("id"), F.col("b").alias("component")), "components")


def _rounds(links: DataFrame, put) -> DataFrame:
    now = put(_down(links), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = put(_down(moved.unionByName(small.select("a", F.col("m").alias("b")))), "links")
        before, mark = mark, _mark(then)
        now = then
        if mark == before:
            break
    return now


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
