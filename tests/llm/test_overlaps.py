"""Decontamination, near duplicates, repeated passages, embeddings and components against brute force."""

import random
import re
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitforge.llm import components, decontam, embed_dedup, line_dedup, near_dedup


def words(draw, n, size=400):
    return [f"w{draw.randrange(size)}" for _ in range(n)]


# Components


def test_components(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.component for r in components.components(df).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}
    assert components.components(df.limit(0)).collect() == []


# Near duplicates


def sets_of(texts):
    out = {}
    for i, text in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    return out


def brute_groups(texts, percent):
    sets = sets_of(texts)
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups_equal_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    draw = random.Random(percent)
    texts = []
    for base in range(6):
        ws = words(draw, 120)
        for _ in range(25):
            changed = [w if draw.random() > 0.012 else f"x{draw.randrange(9999)}" for w in ws]
            texts.append((len(texts), " ".join(changed)))
    texts += [(len(texts) + i, t) for i, t in enumerate(["", None, "one two", "One TWO", "a b c d e", "a  b\nc d e", " ", "a a a a a a", "a a a a a a a a"])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(df, percent).collect()}
    assert found == brute_groups(texts, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_dedup.groups(df.limit(20), percent).collect())


def test_near_groups_of_awkward_rows(spark, awkward):
    rows = near_dedup.groups(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.doc_id == 7} == {7} and {r.n_shingles for r in rows if r.doc_id == 2} == {0}
    assert near_dedup.groups(awkward.limit(0)).collect() == []


def test_estimates_are_near_the_similarity(spark):
    draw = random.Random(9)
    base = words(draw, 600, 10**6)
    other = [w if draw.random() > 0.02 else "z" + w for w in base]
    sets = sets_of([(0, " ".join(base)), (1, " ".join(other))])
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    df = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(other))], "doc_id long, text string").coalesce(1)
    rows = near_dedup.signatures(df, "doc_id", "text")
    x, y = rows.where("id = 0").alias("x"), rows.where("id = 1").alias("y")
    assert abs(x.crossJoin(y).select(near_dedup.estimate(F.col("x.bits"), F.col("y.bits"))).first()[0] - true) < 0.1


def test_links_of_every_twentieth_document_are_kept(spark):
    """All pairs of the documents whose id is divisible by 20 with all others, on full sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = sets_of([(r.doc_id, r.text) for r in docs.collect()])
    holders = {}
    for i, grams in sets.items():
        for g in grams:
            holders.setdefault(g, []).append(i)
    place = {r.doc_id: r.component_id for r in near_dedup.groups(docs, 85).collect()}
    links = 0
    for a in sets:
        if a % 20 == 0:
            shared = {}
            for g in sets[a]:
                for b in holders[g]:
                    shared[b] = shared.get(b, 0) + 1
            for b, k in shared.items():
                if a != b and 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                    links += 1
                    assert place[a] == place[b]
    assert links > 3


# Repeated passages


def sentences(draw, n):
    return " ".join(" ".join(words(draw, draw.randrange(5, 12), 3000)).capitalize() + "." for _ in range(n))


def test_passages_are_removed_and_clean_text_stays(spark):
    draw = random.Random(4)
    passage = sentences(draw, 12)
    texts = {i: sentences(draw, 6) for i in range(30)}
    planted = dict(texts)
    for i in (3, 8, 12, 20):
        planted[i] = texts[i] + " and then " + passage + " so it went on. " + sentences(draw, 3)
    planted[25] = planted[3]
    df = spark.createDataFrame(sorted(planted.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in line_dedup.without_repeats(df).collect()}
    assert {i for i, r in found.items() if r.removed_runs} == {8, 12, 20, 25}
    assert found[3].text == planted[3] and found[25].text.strip() == ""
    inner = passage.split(". ")[2]
    for i in (8, 12, 20):
        assert inner in planted[i] and inner not in found[i].text
        assert found[i].removed_words >= 0.7 * len(passage.split())
        assert all(w in found[i].text for w in texts[i].split()[:20])
    assert {r.doc_id for r in line_dedup.report(df).collect()} == {8, 12, 20, 25}


@pytest.mark.parametrize("size", [25, 26, 51, 60, 80])
@pytest.mark.parametrize("lower", [True, False])
def test_passages_within_lines_are_removed_to_their_edges(spark, size, lower):
    draw = random.Random(size)
    rows, expected = [], {}
    for i in range(40):
        passage = " ".join(words(draw, size, 3000)) if lower else " ".join(sentences(draw, 20).split()[3 : size + 3])
        a, b, c, d = (" ".join(words(draw, draw.randrange(0, 90), 3000) + [f"own{i}{x}"]) for x in "abcd")
        rows += [(2 * i, f"{a} {passage} {b[::-1]}"), (2 * i + 1, f"{c} {passage} {d[::-1]}")]
        expected |= {2 * i: (0, rows[-2][1]), 2 * i + 1: (size, f"{c} {d[::-1]}")}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.removed_words, r.text) for r in line_dedup.without_repeats(df).collect()} == expected


def test_runs_of_fewer_words_stay(spark):
    draw = random.Random(24)
    passage = " ".join(words(draw, 24, 3000))
    df = spark.createDataFrame([(1, f"own1 {passage} own2"), (2, f"own3 {passage} own4 x{passage}y")], "doc_id long, text string")
    assert [r.removed_words for r in line_dedup.without_repeats(df).collect()] == [0, 0]


def test_repeats_within_a_text_and_short_lines(spark):
    draw = random.Random(6)
    line = sentences(draw, 5)
    df = spark.createDataFrame([(1, f"{line}\n{line}\n{line}"), (2, "Licensed under some licence.\nOne."), (3, "Licensed under some licence.\nTwo.")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()}
    assert found[1].count(line.split(". ")[1]) == 1
    assert found[2].startswith("Licensed") and found[3].startswith("Licensed")


def test_only_equal_bytes_count(spark):
    line = sentences(random.Random(7), 8)
    wider = line.replace(". ", ".  ").replace(" w", "  w")
    df = spark.createDataFrame([(1, line), (2, wider), (3, line), (4, f"{wider}\n{line}")], "doc_id long, text string")
    found = {r.doc_id: r.removed_words for r in line_dedup.without_repeats(df).collect()}
    assert found[1] == found[2] == 0 and found[3] == len(line.split()) and found[4] == 2 * found[3]


def test_boundaries_resist_shifts():
    draw = random.Random(8)
    body = sentences(draw, 40)
    a, b = (set(line_dedup.chunks(pa.array([text]))[1].tolist()) for text in (body, "Something quite else came first, " + body))
    assert len(a) > 30 and len(a - b) <= 3


def repeated_words(texts, least):
    """For each text the words in runs of `least` and more that stand, byte by byte, in an earlier text or earlier in it."""
    out, seen = [], {}
    for text in texts:
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]
        gone = set()
        for i in range(len(spans) - least + 1):
            run = text[spans[i][0] : spans[i + least - 1][1]]
            if run in seen:
                gone.update(range(i, i + least))
            seen.setdefault(run, True)
        out.append(gone)
    return out


@pytest.mark.parametrize("dealt", [1, 4, 37])
def test_removed_runs_equal_brute_force(spark, dealt):
    draw = random.Random(15)
    pool = [" ".join(words(draw, draw.randrange(10, 90), 3000)) for _ in range(12)]
    texts = []
    for i in range(150):
        parts = [" ".join(words(draw, draw.randrange(0, 60), 3000)) if draw.random() < 0.6 else draw.choice(pool) for _ in range(draw.randrange(0, 9))]
        texts.append(draw.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[3], texts[4] + " " + texts[4], "x" + texts[7], " ".join(["again and again"] * 60), "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(dealt)
    expected = repeated_words(texts, line_dedup.MIN_WORDS)
    found = {r.doc_id: r for r in line_dedup.without_repeats(df).collect()}
    for i, text in enumerate(texts):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]
        assert found[i].removed_words == len(expected[i])
        assert found[i].text.split() == [text[a:b] for k, (a, b) in enumerate(spans) if k not in expected[i]]


@pytest.mark.parametrize("dealt", [[[1, 2, 3, 4]], [[1, 2], [3, 4]], [[1], [2, 3, 4]], [[1, 3], [2, 4]], [[1], [2], [3], [4]]])
def test_passages_whose_parts_stand_in_still_earlier_texts(spark, dealt):
    """Of 20 passages of 28 words two documents have all; earlier ones have words 1-24 and words 5-28."""
    draw = random.Random(17)
    groups = {k: [] for k in (1, 2, 3, 4)}
    for p in range(20):
        passage = words(draw, 28, 3000)
        for k, part in ((1, passage[:24]), (2, passage[4:]), (3, passage), (4, passage)):
            groups[k].append((k * 100 + p, " ".join(words(draw, 40, 3000) + [f"own{k}x{p}"] + part + [f"end{k}x{p}"] + words(draw, 40, 3000))))
    parts = [spark.createDataFrame([r for k in part for r in groups[k]], "doc_id long, text string").coalesce(1) for part in dealt]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    lost = {r.doc_id: r.removed_words for r in line_dedup.without_repeats(df).collect()}
    assert lost == {i: 28 * (i >= 400) for k in groups for i, _ in groups[k]}


def test_shared_fragments_equal_brute_force(spark):
    """Texts of overlapping cuts of few sources: every chunk has many holders, most without the passage around it."""
    draw = random.Random(18)
    sources = [words(draw, 120, 400) for _ in range(4)]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            source, a = draw.choice(sources), draw.randrange(100)
            parts += source[a : a + draw.randrange(5, 40)]
            if draw.random() < 0.5:
                parts.append(f"n{draw.randrange(9)}")
        texts.append(" ".join(parts))
    expected = repeated_words(texts, line_dedup.MIN_WORDS)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    found = {r.doc_id: r.removed_words for r in line_dedup.without_repeats(df).collect()}
    assert found == {i: len(e) for i, e in enumerate(expected)} and sum(map(len, expected)) > 3000


def test_whole_documents_table_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    expected = dict(zip(sorted(texts), repeated_words([texts[d] or "" for d in sorted(texts)], line_dedup.MIN_WORDS)))
    found = {r.doc_id: r.removed_words for r in line_dedup.without_repeats(rows).collect()}
    assert found == {d: len(e) for d, e in expected.items()}


def test_parts_from_several_documents_stay(spark):
    draw = random.Random(16)
    sources = [words(draw, 60, 3000) for _ in range(3)]
    patched = " ".join(" ".join(s[20:34]) for s in sources)
    df = spark.createDataFrame([*((i, " ".join(s)) for i, s in enumerate(sources)), (9, patched)], "doc_id long, text string")
    assert {r.doc_id: r.removed_words for r in line_dedup.without_repeats(df).collect()} == {0: 0, 1: 0, 2: 0, 9: 0}


@pytest.mark.parametrize("shortest", [4, 7, 8, 22])
def test_equal_runs_equal_a_plain_search(shortest):
    rng = np.random.default_rng(shortest)
    for _ in range(200):
        bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 60, rng.integers(1, 6)))])
        own = rng.integers(0, 3, bounds[-1]).astype(np.uint8)
        differ = rng.random(len(own)) < rng.choice([0.02, 0.1, 0.3, 0.9])
        expected = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            begin = low
            for at in range(low, high + 1):
                if at == high or differ[at]:
                    if at - begin >= shortest:
                        expected.append((begin, at))
                    begin = at + 1
        edge = np.zeros(4 + -len(own) % 4, np.uint8)
        begins, stops = line_dedup.equal_runs(np.concatenate([own, edge]), np.concatenate([own + differ, edge + 1]).astype(np.uint8), bounds, shortest)
        assert list(zip(begins.tolist(), stops.tolist())) == expected


def test_line_dedup_of_awkward_rows(spark, awkward):
    rows = line_dedup.without_repeats(awkward)
    assert rows.columns[:9] == awkward.columns
    assert sorted((str(r.doc_id), r.text is None) for r in rows.collect()) == sorted((str(r.doc_id), r.text is None) for r in awkward.collect())
    assert line_dedup.without_repeats(awkward.limit(0)).collect() == []


# Decontamination


def brute_leaks(docs, items):
    def grams(text, n=None):
        ws = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", text.lower())
        n = n or min(5, len(ws))
        return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set(), n

    out = set()
    for d, text in docs:
        for i, item in items:
            wanted, n = grams(item)
            if wanted and len(wanted & grams(text or "", n)[0]) >= 0.8 * len(wanted):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    draw = random.Random(11)
    items = [(i, sentences(draw, draw.randrange(2, 6))) for i in range(40)] + [(40, "Why is that?"), (41, ""), (42, None), (43, sentences(draw, 60))]
    docs = []
    for d in range(120):
        text = sentences(draw, draw.randrange(0, 30))
        if d % 5 == 0:
            i = draw.randrange(44)
            at = len(text) // 2
            text = text[:at] + " " + (items[i][1] or "") + " " + text[at:]
        docs.append((d, text if d % 17 else None))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(docs, [x for x in items if x[1]])
    assert len(expected) > 10
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()} == expected
    monkeypatch.setattr(decontam, "MAX_ITEMS", 7)
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench.unionByName(bench)).collect()} == expected
    assert {r.doc_id for r in decontam.without_leaks(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_items_with_ids_of_any_type_or_none(spark, monkeypatch):
    draw = random.Random(12)
    texts = [sentences(draw, 4) for _ in range(9)]
    docs = spark.createDataFrame([(f"d{k}", f"{sentences(draw, 3)} {t}") for k, t in enumerate(texts)] + [(None, texts[0])], "doc_id string, text string")
    items = spark.createDataFrame([(None if k % 4 == 0 else f"item {k}", t) for k, t in enumerate(texts)] + [("item 1", texts[1]), (None, texts[0]), ("item 1", texts[2])], "item_id string, text string")
    expected = sorted([(f"d{k}", None if k % 4 == 0 else f"item {k}") for k in range(9)] + [(None, None), ("d2", "item 1")], key=str)
    for most in (decontam.MAX_BYTES, 300):
        monkeypatch.setattr(decontam, "MAX_BYTES", most)
        assert sorted(((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()), key=str) == expected
        assert decontam.without_leaks(docs, items.where("item_id IS NULL")).count() == 6


def index_of(items, threshold=None):
    words = decontam._words([x for _, x in items])
    owner = np.repeat(np.arange(len(items)), np.diff(words.rows))
    terms = np.unique(np.stack([words.hashes, owner.astype(np.uint64)]), axis=1)[0]
    terms, many = np.unique(terms, return_counts=True)
    sizes = np.diff(words.rows)
    return decontam.Index(items, terms, many, len(items), sizes.mean(), sizes.max(), threshold)


@pytest.mark.parametrize("threshold", [0.3, 0.7, None])
def test_pivots_and_blocks_lose_nothing(monkeypatch, threshold):
    draw = random.Random(12)
    items = [(i, sentences(draw, 4) + f" w1 w2 {'w3 ' * (i % 4)}") for i in range(60)]
    index = index_of(items, threshold)
    for rows in (50, 10**6):
        monkeypatch.setattr(decontam, "_ROWS", rows)
        mixed = [items[i][1] + " " + items[(i * 7 + 3) % 60][1][: 60 * (i % 5)] for i in range(60)]
        own = decontam._words(mixed)
        at, term = index.terms(own.hashes)
        passage = np.searchsorted(own.rows, at, "right") - 1
        pair = np.unique(passage * len(index.terms.keys) + term)
        found = {p: {} for p in range(60)}
        for p, i, s in index.retrieve(pair % len(index.terms.keys), pair // len(index.terms.keys), 60):
            found[p] |= dict(zip(i.tolist(), s.tolist()))
        for p in range(60):
            mine = pair[pair // len(index.terms.keys) == p] % len(index.terms.keys)
            rows_of = np.isin(index.block_key // index.blocks, mine).nonzero()[0]
            full = np.zeros(60)
            for r in rows_of:
                for k in range(index.items_at[r], index.items_at[r + 1]):
                    full[index.item[k]] += index.share[k]
            assert {i for i in range(60) if full[i] >= index.least[i] + 1e-5} <= set(found[p]) <= {i for i in range(60) if full[i] >= index.least[i] - 1e-5}
            assert all(abs(full[i] - s) < 1e-9 for i, s in found[p].items()) and abs(found[p][p] - 1) < 1e-9


def test_retrieval_keeps_all_that_verification_finds(spark):
    """Items whose rare words stand at one end, in documents that lack as many of these as the rule allows."""
    draw = random.Random(13)
    items, docs, expected = [], [], set()
    for i in range(120):
        n = draw.randrange(8, 60)
        common = words(draw, n, 12)
        rare = max(1, (n - 4) // 5)
        item = common[: n - rare] + [f"rare{i}x{k}" for k in range(rare)]
        item = item if i % 2 else item[::-1]
        left = item[: n - rare] if i % 2 else item[rare:]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(words(draw, 30, 12) + left + words(draw, 30, 12))))
        grams = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
        wanted, held = grams(item), grams(docs[-1][1].split())
        asked = grams(item)
        if len(wanted & held) >= decontam.OVERLAP * len(wanted) and len(asked & held) >= decontam.QUESTION * len(asked) and len(set(item) & set(docs[-1][1].split())) >= decontam.ANSWER * len(set(item)):
            expected.add((i, i))
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(expected) > 60 and expected <= found


def test_groups_of_items_change_nothing(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [sorted(decontam.find_leaks(docs, bench).collect())]
    for most in (7, 1000):
        monkeypatch.setattr(decontam, "MAX_ITEMS", most)
        rows.append(sorted(decontam.find_leaks(docs, bench).collect()))
    assert rows[0] and rows[0] == rows[1] == rows[2]


def test_decontamination_of_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog.")], "item_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(awkward, bench).collect()] == [1]
    assert decontam.without_leaks(awkward, bench).count() == awkward.count() - 1
    assert decontam.find_leaks(awkward, bench.limit(0)).collect() == [] == decontam.find_leaks(awkward.limit(0), bench).collect()
    assert decontam.without_leaks(awkward, bench.limit(0)).count() == awkward.count()


# Embeddings


def test_error_bounds_hold():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(200, 64)), draw.normal(size=(150, 64))
    y[:50] = x[:50] + draw.normal(size=(50, 64)) * 0.3
    ux, uy = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    for threshold in (0.2, 0.93):
        a, b, again = embed_dedup.similar_pairs(x, y, threshold)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(ux @ uy.T >= threshold))))
        assert again < 200 * 150 * 0.2


def test_groups_of_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    draw = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        base = draw.normal(size=(10, 16))
        rows += [[base[i % 10] + draw.normal(size=16) * draw.choice([0, 0.05, 0.15]), label] for i in range(60)]
    rows = [(i, [float(np.float32(v)) for v in vec], label) for i, (vec, label) in enumerate(rows)]
    odd = [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, [None] + [1.0] * 15, 0), (204, rows[0][1], None), (205, [], 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (208, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("vec", F.lit(1))
    found = {r.vec_id: r for r in embed_dedup.groups(df).collect()}
    good = {i: (np.array(v), label) for i, v, label in rows} | {206: (np.array([1.0, 2.0]), 1), 207: (np.array([2.0, 4.0]), 1)}
    parent, links = {i: i for i in found}, {i: 0 for i in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (u, la) in good.items():
        for b, (v, lb) in good.items():
            if a < b and la == lb and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (links[i], find(i), find(i) == i) for i in found}
    assert embed_dedup.groups(df.limit(0)).collect() == []
    named = df.withColumn("vec_id", F.format_string("v%04d", "vec_id"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.groups(named).collect()} == {f"v{i:04d}": (r.n_links, f"v{r.component_id:04d}") for i, r in found.items()}


def test_repeated_rows_of_one_vector_id(spark):
    """Rows of one id are vectors of their own that are linked; their component is the least id reached."""
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (5, [0.0, 1.0], 1), (9, [0.0, -0.0], 1), (8, [0.0, 3.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.groups(df).collect())
    assert found == [(3, 2, 3), (5, 0, 3), (5, 2, 3), (5, 2, 3), (8, 0, 8), (9, 0, 9)]


def test_diagonals_with_one_other_text_meet_it_as_one_row():
    n = 600
    first = [7 if i % 3 else 100 + i for i in range(n)]
    number = lambda values: pa.array(values, pa.int32())
    batch = pa.record_batch([pa.array(range(n)), pa.array(first), number(range(n)), number(range(n)), number(range(n)), number([None] * n), number([None] * n)], names=["id", "first", "shift", "low", "high", "open_low", "open_high"])
    (made,) = line_dedup._bundled(iter([batch]))
    assert made.num_rows == 200 + 2
    rows = made.to_pylist()
    assert sorted((d["id"], r["first"], d["shift"]) for r in rows for d in r["listed"]) == [(i, first[i], i) for i in range(n)]


def test_all_joins_of_line_dedup_use_one_shuffle_of_the_texts(spark):
    """Were a join to need fewer columns of them, the texts would be read, compressed and shuffled once more."""
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(i, "a passage of words that is the same in all of them " * 8 + str(i)) for i in range(9)], "doc_id int, text string").write.mode("overwrite").parquet(folder)
    df = line_dedup.report(spark.read.parquet(folder))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 2 and "ReusedExchange" in plan
