"""Ranked lexical search: the k best documents of every item, by branch and bound over a tree of documents.

A document is restricted to the terms that any item has, and these stand in the order of how many documents hold them,
the commonest first. Documents in the order of these vectors share leading terms like the paths of a trie (an FP-tree):
a node is a run of documents that share a path, found from the lengths of the common paths of neighbours, and chains
without a branch are one node. Each node knows, of every term in its subtree, the greatest count, and the least m of its
documents; as the score of a term rises with its count and falls with m, this bounds what any document below can score.
For each item the tree is gone through depth first, the best child first, and what can't reach the item's k-th best
score is cut off. A task has a tree for every batch of its documents and keeps the scores to beat from one to the next;
it hands on k documents an item and tree at most, of which the best are taken.

Counts and weights are those of all documents. The arithmetic is in 64-bit integers, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitforge.llm import flat
from splitforge.llm.shared import stored

#: Bytes of items that are searched for in one pass over the documents, about; more items take several passes.
MAX_BYTES = 16 << 20
#: Documents below which a node isn't divided further.
LEAF = 32
#: Documents that a task searches, about: vectors are so small that a block of a file holds far more.
TASK = 8_000
#: Terms are runs of letters and digits of ASCII and of all other characters.
PART = np.zeros(256, bool)
PART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
PART[128:] = True
#: Parts into which the candidates of an item are dealt before its best are taken.
SALT = 64


def term_value(weight, tf, m):
    """What a term adds to a document's score: weight * (10**9 * tf div (1000 * tf + 8 * m))."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def term_weight(total: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * held + 1)))


def length_values(n: np.ndarray, total: int, length: int) -> np.ndarray:
    """m of documents of n terms: 10 + (90 * n * total) div length."""
    if len(n) and 90 * int(n.max()) * total >= 1 << 63:
        return np.array([10 + 90 * int(x) * total // length for x in n], np.int64)
    return 10 + (90 * n * total) // length


def _restricted(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(id, n, terms, tf) of the documents with terms: their number, and which of the given ones each holds how often."""
    kind = dict(docs.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = flat.Lookup(terms)
        for batch in batches:
            for first, size in flat.slices(batch.column("text")):
                part = batch.slice(first, size)
                words = flat.Words(part.column("text"), True, PART)
                at, term = known(words.hashes)
                owner = np.searchsorted(words.rows, at, "right") - 1
                key, tf = np.unique(owner * max(len(terms), 1) + term, return_counts=True)
                owner, term = np.divmod(key, max(len(terms), 1))
                n = np.diff(words.rows)
                some = np.flatnonzero(n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n))[some])]).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (term, tf)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(some)), pa.array(n[some].astype(np.int64)), *arrays], ["id", "n", "terms", "tf"])

    return docs.select("id", "text").mapInArrow(work, f"id {kind}, n long, terms array<int>, tf array<int>")


class Tree:
    """The trie of documents given as flat vectors: terms ascending in each, the commonest being term 0.

    Documents are numbered anew in the order of their paths (`order` has their old numbers). Node v holds documents
    first[v] to last[v]; its children are child[kids[v]:kids[v + 1]], none for a leaf. least_m[v], and the rows
    (node * terms + term -> greatest count) in keys and most, belong to the whole subtree of a node.
    """

    def __init__(self, terms: np.ndarray, tf: np.ndarray, offsets: np.ndarray, m: np.ndarray, n_terms: int, leaf: int = LEAF):
        raw, sizes = terms.astype(">u4").tobytes(), np.diff(offsets)
        paths = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        self.terms, self.offsets = flat.spread(terms, offsets, self.order)
        self.tf = flat.spread(tf, offsets, self.order)[0]
        self.m, self.width = m[self.order], max(n_terms, 1)
        self._branch(self._shared(sizes[self.order]), leaf)
        self._sum_up()

    def _shared(self, sizes: np.ndarray) -> np.ndarray:
        """How many leading terms each document shares with the next."""
        if len(sizes) < 2:
            return np.zeros(0, np.int64)
        both = np.minimum(sizes[:-1], sizes[1:])
        starts = np.concatenate([[0], np.cumsum(both)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], both)
        equal = self.terms[at + np.repeat(self.offsets[:-2], both)] == self.terms[at + np.repeat(self.offsets[1:-1], both)]
        differ = np.append(np.where(equal, starts[-1] + 1, np.arange(starts[-1])), starts[-1] + 1)
        # reduceat gives a segment without elements the value at its start, so those are set apart.
        first = np.minimum.reduceat(differ, np.minimum(starts[:-1], len(differ) - 1))
        return np.where(both > 0, np.minimum(first - starts[:-1], both), 0)

    def _branch(self, shared: np.ndarray, leaf: int) -> None:
        """Nodes from the root down: a run of documents is cut where neighbours share least."""
        first, last, children = [0], [len(self.order)], []
        for v in _growing(first):
            a, b = first[v], last[v]
            if b - a <= leaf:
                children.append([])
                continue
            inner = shared[a : b - 1]
            least = inner.min()
            if least == inner.max() and b - a > 1 and (np.diff(self.offsets)[a:b] == least).all():
                children.append([])  # equal paths
                continue
            cuts = [a, *(np.flatnonzero(inner == least) + a + 1).tolist(), b]
            children.append(list(range(len(first), len(first) + len(cuts) - 1)))
            first += cuts[:-1]
            last += cuts[1:]
        self.first, self.last = np.array(first), np.array(last)
        self.kids = np.concatenate([[0], np.cumsum([len(c) for c in children])])
        self.child = np.array([c for some in children for c in some], np.int64)

    def _sum_up(self) -> None:
        """Subtree maxima and minima, from the leaves up; a child's number is greater than its parent's."""
        n = len(self.first)
        parent = np.zeros(n, np.int64)
        parent[self.child] = np.repeat(np.arange(n), np.diff(self.kids))
        depth = np.zeros(n, np.int64)
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        self.least_m = np.full(n, np.iinfo(np.int64).max)
        leaves = np.flatnonzero(np.diff(self.kids) == 0)
        leaves = leaves[np.argsort(self.first[leaves])]
        leaf_of = np.repeat(leaves, (self.last - self.first)[leaves])
        np.minimum.at(self.least_m, leaf_of, self.m)
        keys, most = _greatest(np.repeat(leaf_of, np.diff(self.offsets)) * self.width + self.terms, self.tf)
        node, rest = keys // self.width, (keys, most)
        found = [[], []]
        for d in range(int(depth.max()), -1, -1):
            here = depth[node] == d
            for part, values in zip(found, rest):
                part.append(values[here])
            up = np.flatnonzero(depth == d)
            np.minimum.at(self.least_m, parent[up[up > 0]], self.least_m[up[up > 0]])
            if d:
                lifted = parent[node[here]] * self.width + rest[0][here] % self.width
                rest = _greatest(np.concatenate([rest[0][~here], lifted]), np.concatenate([rest[1][~here], rest[1][here]]))
                node = rest[0] // self.width
        keys, most = np.concatenate(found[0]), np.concatenate(found[1])
        order = np.argsort(keys)
        self.keys, self.most = keys[order], most[order]

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The greatest score that a document below each node could have."""
        key = nodes[:, None] * self.width + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        tf = np.where(self.keys[at] == key, self.most[at], 0)
        return term_value(weights[None, :], tf, self.least_m[nodes][:, None]).sum(axis=1)

    def scores(self, a: int, b: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of documents a to b."""
        part = slice(self.offsets[a], self.offsets[b])
        at = np.minimum(np.searchsorted(terms, self.terms[part]), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == self.terms[part])
        owner = np.searchsorted(self.offsets[a : b + 1] - self.offsets[a], hit, "right") - 1
        out = np.zeros(b - a, np.int64)
        np.add.at(out, owner, term_value(weights[at[hit]], self.tf[part][hit], self.m[a:b][owner]))
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, beat: int, place: np.ndarray) -> tuple[list[tuple[int, int]], int]:
        """((score, document), ...) of the k best with a score of `beat` at least, and how many nodes were opened.

        place: the rank of each document's id, which decides between equal scores. terms are ascending, and only documents that score above 0 count.
        """
        kept: list[tuple[int, int, int]] = []
        beat, opened = max(beat, 1), 0
        if not len(self.keys):
            return [], 0
        stack = [(int(self.bounds(np.zeros(1, np.int64), terms, weights)[0]), 0)]
        while stack:
            bound, v = stack.pop()
            if bound < beat:
                continue
            opened += 1
            if self.kids[v] < self.kids[v + 1]:
                children = self.child[self.kids[v] : self.kids[v + 1]]
                limit = self.bounds(children, terms, weights)
                some = np.flatnonzero(limit >= beat)
                some = some[np.argsort(limit[some], kind="stable")]
                stack += zip(limit[some].tolist(), children[some].tolist())
                continue
            a = int(self.first[v])
            got = self.scores(a, int(self.last[v]), terms, weights)
            some = np.flatnonzero(got >= beat)
            kept += zip((-got[some]).tolist(), place[self.order[a + some]].tolist(), (a + some).tolist())
            if len(kept) >= k:
                kept = sorted(kept)[:k]
                if len(kept) == k:
                    beat = max(beat, -kept[-1][0])
        return [(-s, int(self.order[d])) for s, _, d in sorted(kept)], opened


def _growing(items: list) -> Iterator[int]:
    """The positions of a list to which the loop adds."""
    i = 0
    while i < len(items):
        yield i
        i += 1


def _greatest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the greatest value of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[starts], np.maximum.reduceat(values, starts)


def _candidates(vectors: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, id, score): of every tree the documents that may be among an item's k best.

    asked: the terms of each item, as ranks ascending, and their weights; rank: the rank of each known term.
    """
    kind = dict(vectors.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [[] for _ in asked]
        for batch in batches:
            ids, column = batch.column("id"), batch.column("terms")
            offsets = np.asarray(column.offsets, np.int64)
            term, tf = rank[np.asarray(column.flatten(), np.int64)], np.asarray(batch.column("tf").flatten(), np.int64)
            owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
            order = np.lexsort((term, owner))
            tree = Tree(term[order], tf[order], offsets - offsets[0], length_values(np.asarray(batch.column("n"), np.int64), total, length), len(rank))
            place = np.empty(len(ids), np.int64)
            place[np.asarray(pc.sort_indices(ids, null_placement="at_end"), np.int64)] = np.arange(len(ids))
            out = [[], [], []]
            for i, (terms, weights) in enumerate(asked):
                beat = known[i][-1] if len(known[i]) == k else 1
                found, _ = tree.best(terms, weights, k, beat, place)
                known[i] = sorted([*known[i], *(s for s, _ in found)], reverse=True)[:k]
                for part, values in zip(out, ([i] * len(found), [d for _, d in found], [s for s, _ in found])):
                    part += values
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), ids.take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.int64())], ["item", "id", "score"])

    return vectors.mapInArrow(work, f"item int, id {kind}, score long")


def _distinct_terms(texts: list[str]) -> list[np.ndarray]:
    words = flat.Words(pa.array(texts, pa.large_string()), True, PART)
    return [np.unique(words.hashes[a:b]) for a, b in zip(words.rows[:-1], words.rows[1:])]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_col, rank, id_col, score): of every item the k documents of highest score above 0, equal scores by ascending id.

    Terms are runs of ASCII letters, digits and other characters of the whole text, A-Z in lower case; a null text has
    none. A document scores the sum over the item's terms of w * ((10**9 * tf) div (1000 * tf + 8 * m)), where w is
    floor(1000 * ln((2 N + 2) / (2 df + 1))) and m is 10 + (90 n N) div L over all documents. Ids may be of any type
    with an order; a null id comes after the others. Rows repeated with one id are documents of their own; items repeated
    with one id and text count once, other texts under one id are items of their own, also with a null id. Items without
    terms give no rows, nor does an empty table. Further columns are ignored. Terms are compared by 64 bits of hash.
    """
    spark = docs.sparkSession
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    groups = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MAX_BYTES)
    out = spark.createDataFrame([], _schema(docs, items, id_col, item_col))
    for g in range(groups):
        # About MAX_BYTES of text, and no more than one item above it.
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).collect()
        found = _of_group(bare, rows, k)
        if found is not None:
            numbers = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {dict(asked.dtypes)['item_id']}")
            named = found.join(F.broadcast(numbers), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
            out = named if groups == 1 else out.unionByName(named)
    return out


def _schema(docs: DataFrame, items: DataFrame, id_col: str, item_col: str) -> str:
    return f"{item_col} {dict(items.dtypes)[item_col]}, rank int, {id_col} {dict(docs.dtypes)[id_col]}, score long"


def _of_group(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """(item, rank, id, score) of the items with these rows, numbered as they stand."""
    terms = _distinct_terms([r["text"] for r in rows])
    known = np.unique(np.concatenate([*terms, np.empty(0, np.uint64)]))
    if not len(known):
        return None
    vectors = stored(_restricted(docs, known), "vectors")
    total, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return None
    held = np.zeros(len(known), np.int64)
    for term, count in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        held[term] = count
    order = np.lexsort((np.arange(len(known)), -held))
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    weight = np.array([term_weight(total, h) for h in held[order].tolist()], np.int64)
    asked = []
    for own in terms:
        ranks = np.sort(rank[np.searchsorted(known, own)])
        asked.append((ranks, weight[ranks]))
    dealt = vectors.where("size(terms) > 0").repartition(max(1, -(-total // TASK)))
    found = stored(_candidates(dealt, asked, rank, total, length, k), "candidates")
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    # Two steps: an item with candidates from very many trees has no task with all of them.
    parts = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k).select("item", "rank", "id", "score")
