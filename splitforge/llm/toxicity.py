"""Toxicity by a weighted finite-state grammar of clauses.

Small transducers read the words of a clause as symbols, in order: one finds insults said of a target ("you are an
idiot", "these losers"), one threats against a target ("I will hurt you", "hang them"), and others negation shortly
before and reported speech before (or right at the end). Their composition is one table; what it gives at each word
makes the types of the clause: an insult, a threat, or the mere mention of an insult or of a word that only tends to be
one, each negated or not, reported or not. The score of a document is a logistic function of how many of its clauses
are of each type; the weights, and insulting words beyond the given ones, are learnt from labelled rows. Mentions have a
weight of their own, since many of the labelled texts are words in no order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitforge.llm import flat
from splitforge.llm.quality import training_rows
from splitforge.llm.shared import stored

#: Labelled rows that words and weights are learnt from, at most about.
MAX_ROWS = 24_000
#: Stems of these many bytes are learnt.
STEMS = (4, 5, 6, 7, 8)
#: How much commoner in toxic rows than in others a learnt insult is, at least, and one that only tends to be.
RATIO, TENDS = 25.0, 4.0
#: Words that a negation reaches over; between a target's verb and the insult; before and after a threatening verb.
NEGATION_REACH, VERB_REACH, BEFORE, AFTER = 3, 3, 3, 2

OTHER, INSULT, DOUBLE, THREAT, TARGET, TARGET_IS, IS, FIRST, WILL, NEGATION, REPORT, SLUR, END = range(13)
#: Words to start from, by what they do in a clause. DOUBLE ones are insults only when said of a target.
WORDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum pathetic worthless disgusting imbecile vermin filth subhuman retard dumbass bastard asshole bitch "
    "dumm dummkopf abschaum versager trottel arschloch connard imbécile salaud abruti estúpido imbécil escoria",
    DOUBLE: "trash clown clowns garbage pig pigs basura",
    THREAT: "kill murder hurt destroy shoot stab hang beat burn töten umbringen erschießen tuer frapper matar golpear",
    TARGET: "you your yours yourself he him his she her they them their this these those people everyone du dich dein ihr euch sie tu toi vous ton ils elles tú usted ustedes ellos",
    TARGET_IS: "you're he's she's they're",
    IS: "is are was were be being been bist ist sind seid est êtes sont eres son",
    FIRST: "i i'll i'm we we'll ich wir je nous yo nosotros",
    WILL: "will gonna going shall must should werde werden wird vais va voy vamos",
    NEGATION: "not never no nobody isn't aren't wasn't don't doesn't won't cannot can't nicht kein keine nie pas jamais aucun nunca ningún",
    REPORT: "said says wrote claimed claims called quoted quote alleged according reported sagte schrieb behauptete dit disait écrit dijo escribió",
}
_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True
_PART[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?;\n")] = True


class Transducer:
    """A deterministic finite-state transducer: step(state, symbol) -> (state, output bits)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def compose(machines: list[Transducer], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(next state, output bits) by [state, symbol] of the machines run side by side; state 0 is the start."""
    start = tuple(m.start for m in machines)
    states, queue, moves, outs = {start: 0}, [start], [], []
    while queue:
        now = queue.pop(0)
        row, bits = [], []
        for symbol in range(symbols):
            then = [m.step(s, symbol) for m, s in zip(machines, now)]
            to = tuple(t[0] for t in then)
            if to not in states:
                states[to] = len(states)
                queue.append(to)
            row.append(states[to])
            bits.append(sum(t[1] for t in then))
        moves.append(row)
        outs.append(bits)
    return np.array(moves), np.array(outs)


#: Output bits at a word: an insult said of a target, the mention of one, of a word that tends to be one, a threat; that
#: a negation is near, that a report came before; and at the end, that the last word was a report.
_INSULT, _MENTION, _SLUR, _THREAT, _NEGATED, _REPORTED, _LATE = (1 << i for i in range(7))


def _insults() -> Transducer:
    """Of a target: TARGET INSULT, INSULT TARGET, TARGET (a word) IS (up to VERB_REACH words) INSULT."""

    def step(state: tuple[str, int], symbol: int) -> tuple[tuple[str, int], int]:
        name, left = state
        if symbol in (INSULT, DOUBLE):
            said_of = name == "target" or name == "is"
            return ("insult", 0), _INSULT if said_of else _MENTION if symbol == INSULT else _SLUR
        if symbol in (TARGET, TARGET_IS):
            return (("target", 0) if symbol == TARGET else ("is", VERB_REACH)), _INSULT if name == "insult" else 0
        out = _SLUR if symbol == SLUR else 0
        if symbol == IS:
            return (("is", VERB_REACH) if name in ("target", "word", "is") else ("", 0)), out
        if name == "target":
            return ("word", 0), out
        return (("is", left - 1) if name == "is" and left else ("", 0)), out

    return Transducer(("", 0), step)


def _threats() -> Transducer:
    """FIRST or WILL, up to BEFORE words, THREAT, up to AFTER words, TARGET; or THREAT TARGET."""

    def step(state: tuple[int, int], symbol: int) -> tuple[tuple[int, int], int]:
        armed, left = state
        out = _THREAT if symbol in (TARGET, TARGET_IS) and left else 0
        left = max(left - 1, (AFTER + 1 if armed else 1) if symbol == THREAT else 0)
        return (BEFORE + 1 if symbol in (FIRST, WILL) else max(0, armed - 1), left), out

    return Transducer((0, 0), step)


def _negation() -> Transducer:
    return Transducer(0, lambda left, symbol: (NEGATION_REACH if symbol == NEGATION else max(0, left - 1), _NEGATED if left else 0))


def _reports() -> Transducer:
    """States: nothing said, said just now, said before."""
    return Transducer(0, lambda state, symbol: (1 if symbol == REPORT else min(state * 2, 2), (_LATE if state == 1 else 0) if symbol == END else _REPORTED if state else 0))


MOVES, OUTS = compose([_insults(), _threats(), _negation(), _reports()], 13)
_BITS = {"insult": _INSULT, "threat": _THREAT, "mention": _MENTION, "slur": _SLUR}
TYPES = list(product(_BITS, (False, True), (False, True)))
TYPE_NAMES = [f"n_{k}{'_negated' * n}{'_reported' * r}" for k, n, r in TYPES]
#: Weights of a clause before anything is learnt.
PRIOR = [{"insult": 1.2, "threat": 1.2, "mention": 0.8, "slur": 0.1}[k] * (0.4 if n else 1.0) * (0.5 if r else 1.0) for k, n, r in TYPES]
_STATES, _GIVES = MOVES.tolist(), OUTS.tolist()


def clause_types(symbols: list[int]) -> set[int]:
    """Positions in TYPES of what one clause is; a mention counts only in a clause without an insult."""
    state, given = 0, set()
    for symbol in symbols:
        bits = _GIVES[state][symbol]
        if bits & 15:
            given.add(bits)
        state = _STATES[state][symbol]
    late = bool(_GIVES[state][END] & _LATE)
    out = {(k, bool(bits & _NEGATED), late or bool(bits & _REPORTED)) for bits in given for k, bit in _BITS.items() if bits & bit}
    if any(k == "insult" for k, _, _ in out):
        out = {t for t in out if t[0] not in ("mention", "slur")}
    return {TYPES.index(t) for t in out}


def _lower(texts: pa.Array) -> flat.Words:
    """The words of the texts, in lower case (A-Z, and the capitals À to Þ)."""
    raw, offsets = flat.utf8(texts)
    data = raw.copy()
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.empty(0, np.int64)
    up = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
    data[up] += 32
    column = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))
    return flat.Words(column, True, _PART)


def _stems(words: flat.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the first `size` bytes of the words that have as many."""
    at = np.flatnonzero(words.ends - words.starts >= size)
    return at, flat.span_hashes(words.values, words.starts[at], words.starts[at] + size)


class Lexicon:
    """Hashes of words by symbol and of learnt stems, {(size, symbol): hashes}."""

    def __init__(self, insults: dict[tuple[int, int], list[int]]):
        given = {flat.text_hash(w): s for s, text in WORDS.items() for w in text.split()}
        self.words = flat.Lookup(np.array(list(given), np.uint64))
        self.symbol = np.array([given[int(h)] for h in self.words.keys], np.int8)
        self.stems = {k: flat.Lookup(np.array(v, np.uint64)) for k, v in sorted(insults.items(), key=lambda x: -x[0][1])}

    def symbols(self, words: flat.Words) -> np.ndarray:
        out = np.zeros(len(words.starts), np.int8)
        stems = {size: _stems(words, size) for size in {k[0] for k in self.stems}}
        for (size, symbol), table in self.stems.items():
            at, hashes = stems[size]
            out[at[table(hashes)[0]]] = symbol
        at, key = self.words(words.hashes)
        out[at] = self.symbol[key]
        return out


def count_types(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Clauses of each type, and words, by text."""
    words = _lower(texts)
    out = np.zeros((len(texts), len(TYPES) + 1), np.int64)
    out[:, -1] = np.diff(words.rows)
    symbols = lexicon.symbols(words)
    core = np.flatnonzero(np.isin(symbols, (INSULT, DOUBLE, THREAT, SLUR)))
    if not len(core):
        return out
    stops = np.zeros(len(words.raw) + 1, np.int64)
    np.cumsum(_STOP[words.raw], out=stops[1:])
    owner = np.repeat(np.arange(len(texts)), np.diff(words.rows))
    # A clause ends at a stop or with its text.
    clause = stops[words.starts] + owner
    hit = np.unique(clause[core])
    first, last = np.searchsorted(clause, hit), np.searchsorted(clause, hit, "right")
    for a, b in zip(first.tolist(), last.tolist()):
        for kind in clause_types(symbols[a:b].tolist()):
            out[owner[a], kind] += 1
    return out


def features(df: DataFrame, insults: dict[tuple[int, int], list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, TYPE_NAMES, n_words) of every row, from its whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(insults)
        for batch in batches:
            for first, rows in flat.slices(batch.column(1)):
                table = count_types(batch.column(1).slice(first, rows), lexicon)
                yield pa.record_batch([batch.column(0).slice(first, rows), *(pa.array(c) for c in table.T)], names=[id_col, *TYPE_NAMES, "n_words"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(work, f"`{id_col}` {kind}, " + ", ".join(f"{t} long" for t in (*TYPE_NAMES, "n_words")))


def learn_insults(rows: DataFrame) -> dict[tuple[int, int], list[int]]:
    """Hashes of stems by (size, INSULT or SLUR) that are commoner in toxic rows of (text, label).

    A stem counts once for each toxic text, and only once for texts in which its (least) pair of neighbours is the
    same, so copies of one text count once; chance finds are kept out by the number of such contexts asked for. Only the bounded fitting sample is read; what comes
    to the driver are the words frequent in its toxic rows.
    """
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}

    def terms(words: flat.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for size in STEMS:
            yield size, *_stems(words, size)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in flat.slices(batch.column(0)):
                words = _lower(batch.column(0).slice(first, n))
                around = np.concatenate([[np.uint64(0)], words.hashes, [np.uint64(0)]])
                near = flat.mix(around[:-2] * np.uint64(3) + around[2:])
                owner = np.repeat(np.arange(n), np.diff(words.rows))
                for kind, at, hashes in terms(words):
                    # Of each word of a text, the least of its contexts.
                    order = np.lexsort((near[at], hashes, owner[at]))
                    own, term = owner[at][order], hashes[order]
                    fresh = np.ones(len(order), bool)
                    fresh[1:] = (own[1:] != own[:-1]) | (term[1:] != term[:-1])
                    pairs = np.unique(np.stack([term[fresh], near[at][order][fresh]], axis=1), axis=0).view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(pairs), kind, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["kind", "term", "near"])

    found = rows.where("label = 1").select("text").mapInArrow(contexts, "kind int, term long, near long")
    # The probability that a neutral word has all its contexts in toxic rows, times the words, is below 0.001.
    least = max(3, math.ceil(math.log(1e3 * 50 * (toxic + 20)) / math.log((toxic + other) / toxic)))
    counted = found.groupBy("kind", "term").agg(F.count_distinct("near").alias("n")).where(F.col("n") >= least).collect()
    if not counted:
        return {}
    by_kind = {k: {r["term"]: r["n"] for r in counted if r["kind"] == k} for k in STEMS}
    keys = {k: np.array(sorted(v), np.int64).view(np.uint64) for k, v in by_kind.items()}

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: flat.Lookup(v) for k, v in keys.items()}
        sums = {k: np.zeros(len(t.keys), np.int64) for k, t in tables.items()}
        for batch in batches:
            for first, n in flat.slices(batch.column(0)):
                words = _lower(batch.column(0).slice(first, n))
                for kind, at, hashes in terms(words):
                    key = tables[kind](hashes)[1]
                    sums[kind] += np.bincount(key, minlength=len(sums[kind]))
        for k, s in sums.items():
            some = np.flatnonzero(s)
            yield pa.record_batch([pa.array(np.full(len(some), k, np.int32)), pa.array(tables[k].keys[some].view(np.int64)), pa.array(s[some])], names=["kind", "term", "n"])

    rest = rows.where("label = 0").select("text").mapInArrow(elsewhere, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()
    against = {(r["kind"], r["term"]): r["n"] for r in rest}
    out: dict[tuple[int, int], list[int]] = {}
    for kind, counts in by_kind.items():
        for term, n in counts.items():
            ratio = (n / toxic) / ((against.get((kind, term), 0) + 0.5) / other)
            if ratio >= TENDS:
                out.setdefault((kind, INSULT if ratio >= RATIO and n >= 3 * least else SLUR), []).append(term % (1 << 64))
    return out


def _inputs() -> list[Column]:
    """log(1 + clauses) of each type; the given weights' sum of them; clauses of a group of types in 50 words, 1 at most."""
    logs = [F.log1p(F.col(t)) for t in TYPE_NAMES]
    prior = sum((c * w for c, w in zip(logs, PRIOR)), F.lit(0.0))
    dense = [F.least(F.lit(1.0), 50.0 * sum((F.col(n) for n, t in zip(TYPE_NAMES, TYPES) if t[0] in kinds), F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1))) for kinds in (("insult", "threat", "mention"), ("slur",))]
    return [*logs, prior, *dense]


def fit_weights(rows: DataFrame) -> tuple[list[float], float]:
    """(weights of _inputs(), intercept) from rows of (label, TYPE_NAMES, n_words)."""
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, n = seen.get(1, 0), sum(seen.values())
    if toxic == 0 or toxic == n:
        return [*([0.0] * len(TYPES)), 4.0, 0.0, 0.0], -2.0
    data = rows.select("label", array_to_vector(F.array(*_inputs())).alias("features"))
    fitted = LogisticRegression(regParam=0.0005, maxIter=60, standardization=False).fit(data)
    return [float(w) for w in fitted.coefficients.toArray()], float(fitted.intercept)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[tuple[int, int], list[int]], list[float], float]:
    """(learnt insults, weights, intercept) from labelled rows whose crc32(id) mod 4 isn't 2; of several texts of one id
    the least counts."""
    train = training_rows(docs, labels, "toxic", 4, 2, MAX_ROWS, id_col)
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(train, id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))
    texts = stored(texts.select(id_col, "text", "label"), "labelled-texts")
    insults = learn_insults(texts)
    shown = features(texts.select(id_col, "text"), insults, id_col, "text")
    return insults, *fit_weights(stored(shown.join(train, id_col), "clauses"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted, TYPE_NAMES) of every document, from its text alone.

    Words and weights are learnt from labelled rows whose crc32(id) mod 4 isn't 2. Null and empty texts have no
    clauses and get the score of the intercept; repeated rows are scored as they are; an empty table gives no rows;
    without labels of both classes fixed weights hold. Further columns are ignored.
    """
    return with_score(docs, fitted(docs, labels, id_col, text_col), id_col, text_col)


def with_score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    insults, weights, intercept = model
    total = sum((c * w for c, w in zip(_inputs(), weights)), F.lit(intercept))
    rows = features(docs.select(id_col, text_col), insults, id_col, text_col)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
    scored = rows.select(id_col, held.alias("held_out"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias("score"), *TYPE_NAMES)
    return scored.select(id_col, "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *TYPE_NAMES)
