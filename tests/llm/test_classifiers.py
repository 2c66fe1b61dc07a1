"""Quality and toxicity: held-out accuracy, awkward rows, and the parts by themselves."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from splitforge.llm import flat, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def recall_and_precision(rows, labels, label, of):
    """Of the held-out rows of label `of`: the share predicted so, and the share of those predicted so that are."""
    held = [(r[label], r.predicted) for r in rows.where("held_out").join(labels, "doc_id").collect()]
    hits = sum(a == b == of for a, b in held)
    return hits / sum(a == of for a, _ in held), hits / sum(b == of for _, b in held)


def plain_statistics(text):
    """The statistics of a text, one by one."""
    raw = text.encode()
    ws = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    lines = raw.split(b"\n")
    ended = lines[:-1] if lines[-1] == b"" else lines
    some, size = max(len(ws), 1), max(len(raw), 1)
    odd = set(b"#$%&*+/<=>@[\\]^_`{}~!|")
    share = lambda letters: sum(c in letters for c in raw) / size
    count = raw.count(b"\n") + bool(raw)
    return {
        "chars": len(text), "words": len(ws), "lines": count, "word_size": sum(map(len, ws)) / some, "line_words": len(ws) / max(count, 1),
        "upper_share": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit_share": share(b"0123456789"), "mark_share": share(b".,;:?'\"()-"), "shout_share": share(b"!"), "bar_share": share(b"|"),
        "symbol_share": share(odd - set(b"!|")), "wide_share": sum(c >= 128 for c in raw) / size, "odd_ends": sum(w[-1] in odd for w in ws) / some, "odd_starts": sum(w[0] in odd for w in ws) / some,
        "repeats": sum(a == b for a, b in zip(ws, ws[1:])) / some, "variety": len(set(ws)) / some, "short_words": sum(len(w) <= 3 for w in ws) / some,
        "plain_words": sum(97 <= w[-1] <= 122 or w[-1] >= 128 for w in ws) / some, "line_variety": len(set(ended)) / max(len(ended), 1),
    }


def test_quality_on_held_out_rows_and_in_plain_python(spark, tables):
    docs, labels = tables
    rows = quality.statistics(docs).persist()
    model = quality.fitted(rows, labels)
    scores = quality.with_score(rows, model).persist()
    assert scores.count() == docs.count()
    for of in (0, 1):
        assert min(recall_and_precision(scores, labels, "quality", of)) > 0.9
    found = {r.doc_id: (r.score, r.predicted, r.held_out) for r in scores.collect()}
    for r in docs.collect():
        s = plain_statistics(r.text or "")
        total = model.intercept + sum(w for rule, w in model.rules if all(s[n] <= b if sign == "<=" else s[n] > b for n, sign, b in rule.parts))
        total += sum((min(max(s[n], low), high) - low) / (high - low) * w for n, low, high, w in model.linear)
        score, predicted, held = found[r.doc_id]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-6, (r.doc_id, s)
        assert predicted == (score >= 0.5) and held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


LETTERS = dict(zip(range(12), "oIDKTYCFLNRS"))
CORES = [("insult", r"T(?:[^TYIDC]?C(?:[^TYIDC]{0,3}C)*[^TYIDC]{0,3})?(?=([ID]))|Y(?:[^TYIDC]{0,3}C)*[^TYIDC]{0,3}(?=([ID]))|[ID](?=([TY]))"), ("threat", r"[FL].{0,3}K.{0,2}(?=([TY]))|K(?=([TY]))")]


def plain_types(symbols):
    """The types of a clause from patterns over its symbols, one letter each."""
    said, threats = set(), set()
    for (kind, pattern), out in zip(CORES, (said, threats)):
        for begin in range(len(symbols)):
            # All ways in which a pattern can end, from each place.
            for end in range(begin, len(symbols)):
                ways = [p for p in pattern.split("|") if p]
                for way in ways:
                    body, _, last = way.partition("(?=(")
                    if re.fullmatch(body, symbols[begin:end]) and symbols[end] in last.strip("[])"):
                        out.add(end)
    cores = [("insult", i) for i in said] + [("threat", i) for i in threats]
    if not said:
        cores += [("mention" if c == "I" else "slur", i) for i, c in enumerate(symbols) if c in "IDS"]
    late = symbols[-1:] == "R"
    return {(k, "N" in symbols[max(0, i - 3) : i], late or "R" in symbols[:i]) for k, i in cores}


def test_toxicity_on_held_out_rows_and_in_plain_python(spark, tables):
    docs, labels = tables
    model = toxicity.fitted(docs, labels)
    scores = toxicity.with_score(docs, model).persist()
    assert scores.count() == docs.count()
    recall, precision = recall_and_precision(scores, labels, "toxic", 1)
    assert recall > 0.6 and precision > 0.9
    given = {w: s for s, text in toxicity.WORDS.items() for w in text.split()}
    stems = sorted(((symbol, size, set(keys)) for (size, symbol), keys in model[0].items()), reverse=True)

    def symbol(word):
        found = 0
        for s, size, keys in stems:
            if len(word.encode()) >= size and stem_hash(word.encode()[:size]) in keys:
                found = s
        return LETTERS[given.get(word, found)]

    lower = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}
    found = {r.doc_id: r for r in scores.collect()}
    checked = 0
    for r in docs.orderBy("doc_id").limit(400).collect():
        counts = {n: 0 for n in toxicity.TYPE_NAMES}
        for clause in re.split(r"[.!?;\n]", (r.text or "").translate(lower)):
            symbols = "".join(symbol(w) for w in re.findall(r"(?:[0-9a-zA-Z']|[^\x00-\x7f])+", clause))
            if re.search("[IDKS]", symbols):
                checked += 1
                for k, n, late in plain_types(symbols):
                    counts[f"n_{k}{'_negated' * n}{'_reported' * late}"] += 1
        assert counts == {n: found[r.doc_id][n] for n in counts}, r.doc_id
    assert checked > 100


def stem_hash(stem):
    data = np.frombuffer(stem, np.uint8)
    return int(flat.span_hashes(flat.BYTE_VALUE[data], np.array([0]), np.array([len(data)]))[0])


@pytest.mark.parametrize("score", [quality.score_documents, toxicity.score_documents])
def test_awkward_rows_without_labels_are_scored(spark, awkward, score):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert score(awkward.limit(0), labels).collect() == []
    few = spark.createDataFrame([(1, 1, 0), (1, None, None), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(score(awkward, few).collect()) == awkward.count()


def test_statistics():
    table = dict(zip(quality.STATISTICS, quality.statistics_of(pa.array(["go go go!\ngo é", None, ""]))[0]))
    assert (table["chars"], table["words"], table["lines"]) == (14, 5, 2)
    assert table["repeats"] == 1 / 5 and table["short_words"] == 1 and table["variety"] == 3 / 5
    assert not quality.statistics_of(pa.array([None, ""], pa.string())).any()


def test_rules_are_columns(spark):
    rule = quality.Rule((("words", ">", 2.0), ("bar_share", "<=", 0.1)))
    model = quality.Model(((rule, 2.0),), (("words", 0.0, 10.0, 1.0),), -1.0)
    rows = spark.createDataFrame([(1, 5.0, 0.0), (2, 1.0, 0.0), (3, 50.0, 0.5)], "doc_id int, words double, bar_share double")
    found = [r.s for r in rows.select(model.score().alias("s")).collect()]
    assert [round(x, 9) for x in found] == [round(1 / (1 + math.exp(-t)), 9) for t in (1.5, -0.9, 0.0)]


def types(text):
    counts = toxicity.count_types(pa.array([text]), toxicity.Lexicon({}))[0]
    return {n: int(c) for n, c in zip(toxicity.TYPE_NAMES, counts) if c}


@pytest.mark.parametrize(
    "text,found",
    [
        ("You are an idiot.", {"n_insult": 1}),
        ("You are not an idiot.", {"n_insult_negated": 1}),
        ("He said you are an IDIOT!", {"n_insult_reported": 1}),
        ("He is an idiot, they said nothing about it.", {"n_insult": 1}),
        ("He is an idiot, she said.", {"n_insult_reported": 1}),
        ("I will kill you. A moron; what trash", {"n_threat": 1, "n_mention": 1, "n_slur": 1}),
        ("You said they will never hurt him", {"n_threat_negated_reported": 1}),
        ("not far from there stands an idiot", {"n_mention": 1}),
        ("The clown made the children laugh at his party.", {"n_slur": 1}),
        ("The trash is taken out on Monday.", {"n_slur": 1}),
        ("Beat the eggs and burn the toast.", {}),
        ("These losers; you clown; stupid people", {"n_insult": 3}),
        ("A fine day.", {}),
        ("", {}),
    ],
)
def test_clauses(text, found):
    assert types(text) == found


def test_composition_is_the_product_of_its_parts():
    last = toxicity.Transducer(0, lambda s, x: (x, 0))
    seen = toxicity.Transducer(0, lambda s, x: (1, 0) if x == 1 else (s, 4 * s))
    moves, outs = toxicity.compose([last, seen], 2)
    state, out = 0, []
    for x in (0, 1, 0):
        out.append(int(outs[state, x]))
        state = int(moves[state, x])
    assert out == [0, 0, 4] and len(moves) == 3
