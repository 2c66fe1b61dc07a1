"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of every document.

The index is inverted (term -> blocks of items -> items) with weights scaled so that an item scores 1 against its own
text; document frequencies and the mean length are those of all items, also where these are dealt into several indexes.
A passage is queried as block-max WAND does it: its terms stand in ascending order of their largest weight, and the
pivot is the first at which the sum of these reaches the threshold. An item that holds neither the pivot nor a later
term can't reach it, so only the postings of those are opened, and the others are skipped to where a block is looked
at; a block is opened only if its own maxima reach the threshold. Every item that a passage reaches the threshold for
is retrieved, then its question and answer are compared with the passage by five-word shingles.

The threshold of an item is the least score of a passage that holds OVERLAP of its shingles, so retrieval loses nothing
that verification would find.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.llm import flat

K1, B = 1.2, 0.75
#: Items of a block, and items of an index at most; more items are split into several indexes.
BLOCK, MAX_ITEMS = 8, 20_000
#: Bytes of text of the items of an index, about; a single longer item is one by itself.
MAX_BYTES = 32 << 20
#: Rows that one step of a query opens at most, about.
_ROWS = 1_000_000
#: Shares of the shingles of an item, and of its question, that a passage must hold; and of its answer's words.
OVERLAP, QUESTION, ANSWER = 0.8, 0.7, 0.5
_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PART[128:] = True
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item: all sentences but the last, and the last; one sentence is both."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text.strip(), text.strip())


def _words(texts: list[str]) -> flat.Words:
    return flat.Words(pa.array(texts, pa.large_string()), True, _PART)


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the distinct runs of five words, or of the whole of fewer."""
    return flat.shingles(hashes, np.array([0, len(hashes)]))[0]


def least_score(weights: np.ndarray, grams: np.ndarray) -> float:
    """The least share of an item's score that a passage with OVERLAP of its shingles has.

    weights: what each word of the item adds to its score; grams: the shingle that begins at each word but the last
    four, by number. So many shingles may be missing; k of them at an end of the item leave k words uncovered, elsewhere
    k - 4, and no more weight than that of the heaviest such words is lost.
    """
    n = len(weights)
    if n < 5:
        return 1.0
    many = np.sort(np.bincount(grams))[::-1]
    may = int(np.floor((1 - OVERLAP) * len(many) + 1e-9))
    missing = min(int(many[:may].sum()), n)
    head, tail = (np.concatenate([[0.0], np.cumsum(w)]) for w in (weights, weights[::-1]))
    heaviest = np.concatenate([[0.0], np.cumsum(np.sort(weights)[::-1])])
    at_ends = np.array([(head[: k + 1] + tail[k::-1]).max() for k in range(missing + 1)])
    lost = (at_ends + heaviest[np.maximum(missing - np.arange(missing + 1) - 4, 0)]).max()
    return max(1e-3, 1.0 - float(lost))


def _numbered_grams(hashes: np.ndarray) -> np.ndarray:
    """The number of the five-word run that begins at each word but the last four."""
    if len(hashes) < 5:
        return np.zeros(1, np.int64)
    at = np.arange(len(hashes) - 4)
    return np.unique(flat.span_hashes(hashes, at, at + 5), return_inverse=True)[1]


class Index:
    """The BM25 index of (item_id, text) pairs, none without words.

    terms and frequencies: the distinct words of all the pairs as hashes, and how many of `total` items have each;
    mean, longest: words of an item on average and at most. threshold: a share of an item's own score; None: of each
    item the least that OVERLAP allows.
    """

    def __init__(self, items: list[tuple[int, str]], terms: np.ndarray, frequencies: np.ndarray, total: int, mean: float, longest: int, threshold: float | None = None):
        words = _words([t for _, t in items])
        texts = [(i, t, words.hashes[a:b]) for (i, t), a, b in zip(items, words.rows[:-1], words.rows[1:])]
        self.ids, self.longest = [i for i, _, _ in texts], longest
        self.grams = [_grams(w) for _, _, w in texts]
        parts = [split_item(t) for _, t, _ in texts]
        asked, told = _words([q for q, _ in parts]), _words([a for _, a in parts])
        self.question = [_grams(asked.hashes[a:b]) for a, b in zip(asked.rows[:-1], asked.rows[1:])]
        self.sizes, self.asked = [len(w) for _, _, w in texts], np.diff(asked.rows).tolist()
        self.answer = [np.unique(told.hashes[a:b]) for a, b in zip(told.rows[:-1], told.rows[1:])]
        n = max(len(texts), 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(words.rows))
        self.terms = flat.Lookup(words.hashes)
        place = np.searchsorted(self.terms.keys, words.hashes)
        pair, where, count = np.unique(place.astype(np.int64) * n + owner, return_inverse=True, return_counts=True)
        term, item = pair // n, pair % n
        held = np.zeros(len(self.terms.keys))
        held[np.searchsorted(self.terms.keys, terms)] = frequencies
        size = np.bincount(owner, minlength=len(texts)).astype(float)
        weight = np.log1p((total - held + 0.5) / (held + 0.5))[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[item] / max(mean, 1)))
        own = np.bincount(item, weight, minlength=len(texts))
        self.share = weight / own[item]
        if threshold is None:
            # Each place of a word counts with all of the word's weight, so no loss is put too low.
            of_word = self.share[where]
            self.least = np.array([least_score(of_word[a:b], _numbered_grams(words.hashes[a:b])) for a, b in zip(words.rows[:-1], words.rows[1:])])
        else:
            self.least = np.full(len(texts), threshold)
        # Weights are divided by the item's threshold, so a query asks for sums of 1.
        self.item, scaled = item, (self.share / self.least[item] if len(texts) else self.share).astype(np.float32)
        self.blocks = -(-n // BLOCK)
        key = term * self.blocks + item // BLOCK
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_key = key[starts]
        self.block_max = np.maximum.reduceat(scaled, starts) if len(starts) else scaled
        self.items_at = np.append(starts, len(key))
        self.blocks_at = np.searchsorted(self.block_key, np.arange(len(self.terms.keys) + 1) * self.blocks)
        self.term_max = np.maximum.reduceat(self.block_max, self.blocks_at[:-1]) if len(starts) else scaled

    def retrieve(self, terms: np.ndarray, passages: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(passage, items, scores) of all items that reach their threshold, from distinct (passage, term) pairs.

        terms and passages are sorted by passage, of which there are n, and by term.
        """
        enough = 1 - 1e-4
        keep = (np.bincount(passages, self.term_max[terms], minlength=n) >= enough)[passages]
        terms, passages = terms[keep], passages[keep]
        order = np.lexsort((self.term_max[terms], passages))
        largest = self.term_max[terms[order]].astype(np.float64)
        starts = np.flatnonzero(np.diff(passages, prepend=-1))
        ends = np.append(starts[1:], len(passages))
        before = np.cumsum(largest) - largest
        before -= np.repeat(before[starts], ends - starts)
        # From the pivot on; what comes before it can add no more than `skipped`.
        opened = before + largest >= enough
        pivots = np.add.reduceat(~opened, starts) if len(starts) else starts
        skipped = before[np.minimum(starts + pivots, ends - 1)]
        places = order[opened]
        sizes = (self.blocks_at[1:] - self.blocks_at[:-1])[terms[places]]
        many = np.concatenate([[0], np.cumsum(sizes)])
        first_of = np.searchsorted(passages[places], passages[starts])
        begin = 0
        while begin < len(starts):
            # So many passages at once that their postings from the pivots on are about _ROWS.
            stop = int(np.searchsorted(many[np.append(first_of[1:], len(places))], many[first_of[begin]] + _ROWS, "right"))
            stop = max(begin + 1, stop)
            low, high = first_of[begin], first_of[stop] if stop < len(starts) else len(places)
            own = places[low:high]
            rows, _ = flat.spread(np.arange(len(self.block_key)), self.blocks_at, terms[own])
            number = np.searchsorted(starts, np.repeat(own, sizes[low:high]), "right") - 1
            pair, which = np.unique(number * self.blocks + self.block_key[rows] % self.blocks, return_inverse=True)
            number = pair // self.blocks
            reach = np.bincount(which, self.block_max[rows], minlength=len(pair)) + skipped[number] >= enough
            yield from self._open(pair[reach], number[reach], terms, starts, ends, passages, enough)
            begin = stop

    def _open(self, pair: np.ndarray, number: np.ndarray, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray, passages: np.ndarray, enough: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Scores of the items of candidate blocks: all terms of the passage are looked up in the block, whose maxima
        decide whether its items are scored."""
        step = max(1, int(_ROWS // max(1, (ends - starts).max(initial=1))))
        for i in range(0, len(pair), step):
            own, block = number[i : i + step], pair[i : i + step] % self.blocks
            bounds = np.concatenate([[0], np.cumsum((ends - starts)[own])])
            at = np.repeat(starts[own] - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])
            which = np.repeat(np.arange(len(own)), np.diff(bounds))
            key = terms[at] * self.blocks + block[which]
            row = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            hit = self.block_key[row] == key
            row, which = row[hit], which[hit]
            reach = np.bincount(which, self.block_max[row], minlength=len(own)) >= enough
            row, which = row[reach[which]], which[reach[which]]
            posting, ends_of = flat.spread(np.arange(len(self.item)), self.items_at, row)
            slot = np.repeat(which, np.diff(ends_of)) * BLOCK + self.item[posting] % BLOCK
            score = np.bincount(slot, self.share[posting], minlength=len(own) * BLOCK)
            found = np.flatnonzero(score)
            item = block[found // BLOCK] * BLOCK + found % BLOCK
            good = score[found] >= self.least[item] - 1e-9
            found, item = found[good], item[good]
            passage = passages[starts[own[found // BLOCK]]]
            for a, b in zip(np.flatnonzero(np.diff(passage, prepend=-1)), np.append(np.flatnonzero(np.diff(passage, prepend=-1))[1:], len(passage))):
                yield int(passage[a]), item[a:b], score[found[a:b]]

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item_id, score, question share, answer share) of the items verified in each text, the best of a pair."""
        if not self.ids:
            return []
        words = flat.Words(texts, True, _PART)
        step = self.longest
        at, term = self.terms(words.hashes)
        row = np.searchsorted(words.rows, at, "right") - 1
        # Passages of 2 * step words begin every step words, so an item lies whole in one of them.
        passages_before = np.concatenate([[0], np.cumsum(np.maximum(-(-np.diff(words.rows) // step), 1))])
        own = passages_before[row] + (at - words.rows[row]) // step
        earlier = (at - words.rows[row]) >= step
        passage = np.concatenate([own, own[earlier] - 1])
        pair = np.sort(passage * len(self.terms.keys) + np.concatenate([term, term[earlier]]))
        pair = pair[np.diff(pair, prepend=-1) > 0]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for passage, items, scores in self.retrieve(pair % len(self.terms.keys), pair // len(self.terms.keys), int(passages_before[-1])):
            row = int(np.searchsorted(passages_before, passage, "right")) - 1
            begin = words.rows[row] + (passage - passages_before[row]) * step
            hashes = words.hashes[begin : min(begin + 2 * step, words.rows[row + 1])]
            grams = {}
            for item, score in zip(items.tolist(), scores.tolist()):
                found = self._verify(hashes, item, grams)
                if found and score > best.get((row, item), (0.0,))[0]:
                    best[row, item] = (score, *found)
        return [(row, self.ids[item], *found) for (row, item), found in sorted(best.items())]

    def _verify(self, hashes: np.ndarray, item: int, grams: dict) -> tuple[float, float] | None:
        def share(wanted: np.ndarray) -> float:
            if "grams" not in grams:
                grams["grams"] = _grams(hashes) if len(hashes) >= 5 else np.empty(0, np.uint64)
            return float(np.isin(wanted, grams["grams"]).mean())

        def short(wanted: np.ndarray, size: int) -> float:
            """Of an item of fewer than five words: its whole sequence somewhere in the passage."""
            if size not in grams:
                windows = [hashes[i : i + size] for i in range(len(hashes) - size + 1)]
                grams[size] = np.array([_grams(w)[0] for w in windows], np.uint64)
            return float(np.isin(wanted, grams[size]).mean())

        def held(wanted: np.ndarray, words: int) -> float:
            return share(wanted) if words >= 5 else short(wanted, words) if words else 1.0

        if held(self.grams[item], self.sizes[item]) < OVERLAP:
            return None
        question = held(self.question[item], self.asked[item])
        answer = float(np.isin(self.answer[item], hashes).mean()) if len(self.answer[item]) else 1.0
        return (question, answer) if question >= QUESTION and answer >= ANSWER else None


def with_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, text, words, terms array<long>) of the distinct items that have words; ids are of any type, or null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words(batch.column(1).to_pylist())
            terms = [np.unique(words.hashes[a:b]).view(np.int64) for a, b in zip(words.rows[:-1], words.rows[1:])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(words.rows)), pa.array(terms, pa.list_(pa.int64()))], names=["item", "text", "words", "terms"])

    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    return rows.mapInArrow(work, f"item {dict(items.dtypes)[item_col]}, text string, words long, terms array<long>").where("words > 0")


def _parts(items: DataFrame, item_col: str, text_col: str, threshold: float | None) -> Iterator[tuple[str, tuple, pa.Array]]:
    """(a name, what Index takes, the ids of its items) of groups of about MAX_ITEMS distinct items and MAX_BYTES of text, by hash.

    Frequencies are counted over all items by Spark. One group at a time comes to the driver, so what it holds and what
    is sent to the executors at once is bounded however many items there are.
    """
    rows = with_terms(items, item_col, text_col)
    total, mean, longest, size = rows.agg(F.count("*"), F.avg("words"), F.max("words"), F.sum(F.octet_length("text"))).first()
    frequencies = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    groups = max(-(-total // MAX_ITEMS), -(-(size or 0) // MAX_BYTES))
    for group in range(groups):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == group)
        own = part.select(F.explode("terms").alias("term")).distinct().join(frequencies, "term").toArrow()
        table = part.select("item", "text").orderBy("item", "text").toArrow().combine_chunks()
        # The index knows items by their places; what their ids are, and of which type, is none of its business.
        pairs = list(enumerate(table.column("text").to_pylist()))
        ids = table.column("item").combine_chunks()
        yield uuid.uuid4().hex, (pairs, np.asarray(own.column("term")).view(np.uint64), np.asarray(own.column("n")), total, mean, longest, threshold), ids


#: The indexes that this worker has built last, by name.
_built: dict[str, Index] = {}


def _index(name: str, shared) -> Index:
    """The index of a broadcast group, built once in a worker process; the last two are kept."""
    if name not in _built:
        while len(_built) > 1:
            _built.pop(next(iter(_built)))
        _built[name] = Index(*shared.value)
    return _built[name]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float | None = None, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap): one row for each item found in a document.

    No shuffle of documents: the index goes to the executors and documents are read once for each MAX_ITEMS items; the
    result doesn't depend on MAX_ITEMS. threshold: the share of its own score that retrieves an item; None: of each item
    the least that verification allows. Null and empty texts hold nothing, items without words are found nowhere,
    repeated documents are reported each, items repeated with one id and text once; ids of either may be of any type, and items
    without an id are looked for like others; empty tables give no rows; further columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, item_id {dict(items.dtypes)[item_col]}, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    found = [_found(rows, part, id_col, schema) for part in _parts(items, item_col, text_col, threshold)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _found(rows: DataFrame, part: tuple[str, tuple, pa.Array], id_col: str, schema: str) -> DataFrame:
    name, item_ids, shared = part[0], part[2], rows.sparkSession.sparkContext.broadcast(part[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch in batches:
            for first, n in flat.slices(batch.column(1)):
                leaks = index.leaks(batch.column(1).slice(first, n))
                if leaks:
                    row, item, score, question, answer = zip(*leaks)
                    columns = [batch.column(0).take(pa.array([first + r for r in row])), item_ids.take(pa.array(item)), pa.array(score), pa.array(question), pa.array(answer)]
                    yield pa.record_batch(columns, names=[id_col, "item_id", "score", "question_overlap", "answer_overlap"])

    return rows.mapInArrow(work, schema)


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns; a document without id stays if it holds none."""
    out = docs
    for name, part, _ in _parts(items, "item_id", "text", None):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def work(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                keep = np.ones(batch.num_rows, bool)
                for first, n in flat.slices(texts):
                    for leak in index.leaks(texts.slice(first, n)):
                        keep[first + leak[0]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(work, docs.schema)
    return out
