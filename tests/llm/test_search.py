"""Ranked search, centroid clusters and license scans against plain Python on small tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitforge.llm import centroids, licenses, queries, search
from tests.compare import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_centroid_clusters", "op13_license_scan"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    same(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name])


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))


def plain_ranks(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score) of lists of (id, text)."""
    texts = [(i, Counter(_terms(t))) for i, t in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    total, length = len(texts), sum(n for _, _, n in texts)
    held = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scored = []
        for doc, counts, n in texts:
            m = 10 + 90 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in set(_terms(text)) if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _ranked(spark, docs, items, parts=3, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, item int").repartition(parts)
    asked = spark.createDataFrame(items, "item_id string, text string, rank int")
    return sorted((tuple(r) for r in search.ranked(df, asked, **options).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_search_equals_plain_scores(spark, parts):
    draw = random.Random(5)
    words = [f"w{int(draw.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(7, docs[7][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, "?! -")]
    items = [(str(i), " ".join(draw.choices(words, k=draw.randint(1, 12)))) for i in range(30)] + [("0", "W1 w2"), (None, docs[3][1]), ("x", None), ("y", ""), ("z", "unheard"), ("z", "unheard")]
    want = plain_ranks(docs, items)
    assert _ranked(spark, [(*d, "s", 1) for d in docs], [(*i, 0) for i in items], parts) == want


def test_search_with_leaves_of_one_document_and_several_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAF", 1)
    monkeypatch.setattr(search, "MAX_BYTES", 20)
    docs = [(1, "a b c"), (2, "a b"), (3, "a"), (4, "b c c c"), (5, "a b c"), (6, "")]
    items = [("p", "a b"), ("q", "c d"), ("r", "C"), ("s", "a a a a a a a a a a a a a a a a")]
    assert _ranked(spark, [(*d, "", 0) for d in docs], [(*i, 0) for i in items], k=3) == plain_ranks(docs, items, 3)


def test_search_of_empty_tables_and_awkward_rows(spark, awkward):
    items = spark.createDataFrame([(1, "lazy dog"), (2, "日本語 naïve"), (3, "word5x5 without")], "item_id long, text string")
    got = sorted((tuple(r) for r in search.ranked(awkward, items).collect()), key=str)
    assert got == plain_ranks([(r.doc_id, r.text) for r in awkward.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert search.ranked(awkward.limit(0), items).collect() == [] and search.ranked(awkward, items.limit(0)).collect() == []
    assert search.ranked(awkward, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_subtree_bounds_hold_for_every_document_below():
    draw = np.random.default_rng(3)
    docs = [np.unique(draw.zipf(1.4, draw.integers(1, 12)) % 40) for _ in range(300)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    tf, m = draw.integers(1, 9, offsets[-1]), draw.integers(10, 200, len(docs))
    tree = search.Tree(np.concatenate(docs), tf, offsets, m, 40, leaf=2)
    terms, weights = np.arange(0, 40, 3), draw.integers(0, 5000, 14)
    bounds = tree.bounds(np.arange(len(tree.first)), terms, weights)
    for v, (a, b) in enumerate(zip(tree.first, tree.last)):
        assert tree.scores(a, b, terms, weights).max() <= bounds[v]
    found, opened = tree.best(terms, weights, 5, 1, np.arange(len(docs)))
    every = sorted(((-s, int(tree.order[i])) for i, s in enumerate(tree.scores(0, len(docs), terms, weights))))[:5]
    assert [(-s, d) for s, d in found] == every and opened < len(tree.first)


def plain_clusters(rows, k=40, rounds=5):
    """(vec_id, cluster, distance) of lists of (id, components), in exact numbers."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in starts]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds if centres else 0):
        got = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, got) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=str) if centres else []


def _clusters(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "id": F.lit(0), "planes": F.lit(1)}).repartition(parts)
    return centroids.clusters(df, **options)


@pytest.mark.parametrize("parts", [1, 5])
def test_clusters_equal_exact_arithmetic(spark, parts):
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(64)]) for i in range(90)] + [(200 + i, [0.25] * 64) for i in range(30)]
    rows += [(300, None), (301, [1.0] * 63), (302, [None] + [0.0] * 63), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (3, [0.1] * 64), (305, [-524287.5] * 64), (306, [524288.0] + [0.0] * 63), (307, [0.0] * 64)]
    got = _clusters(spark, rows, parts).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == plain_clusters(rows)
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for r in got:
        assert r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster)


def test_clusters_with_ties_few_vectors_and_none(spark):
    tied = [(i, [float(i % 2)] + [0.0] * 63) for i in range(7)] + [(9, [0.5] + [0.0] * 63)]
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in _clusters(spark, tied, k=4, rounds=2).collect()), key=str) == plain_clusters(tied, 4, 2)
    assert _clusters(spark, [(None, [0.0] * 64)]).collect() == [] and _clusters(spark, [(1, None)]).collect() == []
    assert _clusters(spark, []).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bit_planes_keep_values_and_products():
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 1 << 28, (50, 64)), draw.integers(0, 1 << 11, (7, 64))
    assert (centroids.unpack(centroids.pack(x, 28)) == x).all()
    assert (centroids.dot_products(centroids.pack(x, 28), centroids.pack(y, 11)) == x @ y.T).all()


def plain_licenses(text):
    """The columns that digests() gives of a text, but its id."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    spots = [(label, p) for said, label in licenses.PHRASES for q in [said.split()] for p in range(len(words)) if words[p : p + len(q)] == q]
    found = []
    for notice, label, name in licenses.NOTICES:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", notice.lower())
        h = 1 << (len(own) - 1).bit_length()
        for first in range(0, max(len(words), 1), h):
            common = set(words[first : first + 2 * h]) & set(own)
            if len(common) >= math.ceil(licenses.CONTAINED * len(set(own)) - 1e-9) and common >= set(name.split()):
                found.append((h, first, set(own), label, len(common) / len(set(own))))
    found = [a for a in found if not any(a[:2] == b[:2] and a[2] < b[2] for b in found)]
    labels = {label for label, _ in spots} | {f[3] for f in found}
    held = max((f[4] for f in found), default=0.0)
    places = [p for _, p in spots]
    return (len(words), len(spots), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, _ in spots})), ",".join(sorted(labels)), 1.0 if spots else held)


@pytest.mark.parametrize("parts", [1, 5])
def test_licenses_equal_plain_windows(spark, awkward, parts):
    draw = random.Random(2)
    filler = [f"x{i}" for i in range(50)] + "the of license public under to is in licensed work mit version".split()
    texts = []
    for i in range(150):
        words = draw.choices(filler, k=draw.randint(0, 80))
        for _ in range(draw.randint(0, 2)):
            said = draw.choice(licenses.NOTICES)[0].split()
            said = [w for w in said if draw.random() > 0.1]
            at = draw.randint(0, len(words))
            words[at:at] = said
        texts.append((i, draw.choice([" ", "\n", "\n * ", ". "]).join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(awkward.select("doc_id", "text")).withColumns({"place": F.lit(1), "word": F.lit("w"), "id": F.lit(2), "phrases": F.lit(0)})
    got = licenses.digests(licenses.matches(docs.repartition(parts))).collect()
    want = [(r.doc_id, *plain_licenses(r.text)) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert licenses.matches(docs.limit(0)).collect() == []


def test_matches_say_where_a_notice_stands(spark):
    text = "word " * 40 + "Licensed under\n# CC BY-NC 4.0. See the MIT\tLicense."
    row = licenses.matches(spark.createDataFrame([("d", text)], "doc_id string, text string")).first()
    assert [tuple(p) for p in row.phrases] == [("mit", 49)]
    assert {n.label for n in row.notices} == {"cc-by-nc", "mit"} and all(n.first <= 40 < n.first + n.words for n in row.notices if n.label == "cc-by-nc")


def test_a_notice_without_words_is_refused():
    with pytest.raises(ValueError):
        licenses.known([("?!", "x", "")], licenses.PHRASES)
    with pytest.raises(ValueError):
        licenses.known([("a b", "x", "c")], licenses.PHRASES)
