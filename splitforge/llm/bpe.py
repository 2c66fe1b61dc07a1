"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array; the rank of every neighbouring pair is found by binary search
over the sorted pair keys of the vocabulary file, and each round merges the lowest-rank pair of every word at once.
Words are cut without a regular-expression engine: character classes come from one table, word starts from
comparisons of neighbouring classes, and equal words of a batch are encoded once.

Results equal those of the `tokenizers` library for byte-level files without a normaliser or prefix blank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.llm import flat

_LETTER, _NUMBER, _OTHER, _SPACE, _EDGE = range(5)
#: The white space of the word pattern.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters of text cut in one step, and words remembered by a worker.
PIECE, REMEMBERED = 2_000_000, 400_000
#: Words of more bytes are merged one by one.
LONG = 4_000
_tables: dict = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    if "classes" not in _tables:
        kinds = np.full(0x110000, _OTHER, np.uint8)
        major = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
        kinds[major == ord("L")], kinds[major == ord("N")] = _LETTER, _NUMBER
        kinds[_WHITE] = _SPACE
        _tables["classes"] = kinds, flat.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return _tables["classes"]


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The tables of one vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE files without a normaliser are read here")
        vocab, letters = model["vocab"], _byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *added.values()]) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.of_byte = np.zeros(256, np.int32)
        texts = [b""] * self.size
        for token, i in vocab.items():
            texts[i] = bytes(letters[c] for c in token) if token not in added else token.encode()
            if len(texts[i]) == 1 and token not in added:
                self.of_byte[texts[i][0]] = i
        for token, i in added.items():
            texts[i] = token.encode()
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        decimals = [b"%d," % i for i in range(self.size)]
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self.decimal_at = np.concatenate([[0], np.cumsum([len(t) for t in decimals])]).astype(np.int64)
        self.special = added
        self.special_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.by_pair: dict[int, tuple[int, int]] = {}

    def merge(self, words: list[str]) -> list[bytes]:
        """The token ids (as little-endian 32-bit integers) of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        if long := [i for i, w in enumerate(raw) if len(w) > LONG]:
            out = self.merge([w for w, b in zip(words, raw) if len(b) <= LONG])
            for i in long:
                out.insert(i, self._merge_long(raw[i]))
            return out
        sizes = np.array([len(w) for w in raw], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        none = np.int32(2**31 - 1)

        def look(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = left * self.size + right
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            return np.where(hit, self.ranks[at], none), self.made[at]

        rank, made = np.full(len(symbol), none, np.int32), np.zeros(len(symbol), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = look(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(symbol)))
            best = np.repeat(best, counts)
            over = best == none
            if over.any():
                done.append((symbol[over], word[over]))
                keep = ~over
                symbol, word, rank, made, best = symbol[keep], word[keep], rank[keep], made[keep], best[keep]
                if not len(symbol):
                    break
            hit = rank == best
            # Of pairs that overlap, as in "aaa", every second one merges, from the left.
            places = np.flatnonzero(hit)
            fresh = np.concatenate([[True], places[1:] != places[:-1] + 1])
            run = places[fresh][np.cumsum(fresh) - 1]
            places = places[(places - run) % 2 == 0]
            symbol[places] = made[places]
            keep = np.ones(len(symbol), bool)
            keep[places + 1] = False
            touched = np.zeros(len(symbol), bool)
            touched[places] = True
            symbol, word, rank, made, touched = symbol[keep], word[keep], rank[keep], made[keep], touched[keep]
            touched[:-1] |= touched[1:]
            look_at = np.flatnonzero(touched)
            rank[look_at] = none
            look_at = look_at[look_at < len(symbol) - 1]
            look_at = look_at[word[look_at] == word[look_at + 1]]
            rank[look_at], made[look_at] = look(symbol[look_at], symbol[look_at + 1])
        if not done:
            return [b""] * len(words)
        symbol, word = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
        order = np.argsort(word, kind="stable")
        data = symbol[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, raw: bytes) -> bytes:
        """merge() of one very long word, in which each round would merge few of many pairs: a heap of pairs by rank and
        place, over a chain of symbols."""
        if not self.by_pair:
            self.by_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        symbol = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and (then := after[at]) >= 0 and (found := self.by_pair.get(symbol[at] * self.size + symbol[then])):
                heapq.heappush(heap, (found[0], at, symbol[at], symbol[then], found[1]))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, left, right, made = heapq.heappop(heap)
            then = after[at]
            if symbol[at] != left or then < 0 or symbol[then] != right:
                continue
            symbol[at], symbol[then] = made, -1
            after[at] = after[then]
            if after[at] >= 0:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def _cut(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces after one another, and the n + 1 offsets of the pieces."""
        text = "".join(pieces)
        if not text:
            return np.empty(0, np.uint32), np.zeros(len(pieces) + 1, np.int64)
        kinds, values = _classes()
        char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        kind = kinds[char]
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        filled = bounds[:-1][bounds[1:] > bounds[:-1]]
        before[filled] = _EDGE
        after[np.append(filled[1:], len(char)) - 1] = _EDGE
        space = kind == _SPACE
        start = kind != before
        follows = np.flatnonzero(~space & (before == _SPACE))
        start[follows] = char[follows - 1] != 32
        start |= space & (after < _SPACE)
        mark = np.flatnonzero((char == 39) & start)
        if len(mark):
            end = bounds[np.searchsorted(bounds, mark, "right")]
            one = np.where(mark + 1 < end, char[np.minimum(mark + 1, len(char) - 1)], 0)
            two = np.where(mark + 2 < end, char[np.minimum(mark + 2, len(char) - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            taken = np.flatnonzero(short | long)
            mark, end, size = mark[taken], end[taken], np.where(short[taken], 2, 3)
            start[mark + 1] = False
            inside = mark + size < end
            start[(mark + size)[inside]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(char))
        codes, distinct = pd.factorize(flat.span_hashes(values[char], starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        sizes = ends - starts
        same = sizes == sizes[first[codes]]
        like = np.arange(len(char)) + np.repeat(starts[first[codes]] - starts, sizes)
        if not same.all() or not np.array_equal(char[np.minimum(like, len(char) - 1)], char):
            # Two words with one hash: number the words by themselves.
            codes, distinct = pd.factorize(np.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())], object))
            first[: len(distinct)] = 0
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        missing = [w for w in words if w not in self.known]
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
                missing = words
            self.known.update(zip(missing, self.merge(missing)))
        found = [self.known[w] for w in words]
        tokens = np.frombuffer(b"".join(found), "<u4")
        token_at = np.concatenate([[0], np.cumsum([len(f) for f in found]) // 4]).astype(np.int64)
        out, word_at = flat.spread(tokens, token_at, codes)
        return out, word_at[np.searchsorted(starts, bounds)]

    def encode(self, texts: list[str | None], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts after one another, and the n + 1 offsets of the texts.

        special: control strings of the file in a text become their own ids; else they are ordinary text.
        """
        pieces: list[str] = []
        last: list[int] = []
        forced: list[tuple[int, int]] = []
        for text in texts:
            parts = self.special_pattern.split(text) if special and text and self.special_pattern else [text or ""]
            for i, part in enumerate(parts):
                if i % 2:
                    forced.append((len(pieces), self.special[part]))
                else:
                    pieces.extend(_portions(part))
            last.append(len(pieces))
        outs, offsets, total = [], [np.zeros(1, np.int64)], 0
        begin = size = 0
        for i, piece in enumerate(pieces):
            size += len(piece)
            if size >= PIECE or i == len(pieces) - 1:
                ids, at = self._cut(pieces[begin : i + 1])
                outs.append(ids)
                offsets.append(at[1:] + total)
                total += len(ids)
                begin, size = i + 1, 0
        ids, at = (np.concatenate(outs) if outs else np.empty(0, np.uint32)), np.concatenate(offsets)
        ends = at[np.array(last, np.int64)] if last else np.empty(0, np.int64)
        if forced:
            where = at[np.array([f[0] for f in forced])]
            ids = np.insert(ids, where, np.array([f[1] for f in forced], np.uint32))
            ends = ends + np.searchsorted(np.array([f[0] for f in forced]), np.array(last), "left")
        return ids, np.concatenate([[0], ends]).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        data, at = flat.spread(self.texts, self.text_at, ids.astype(np.int64))
        data = data.tobytes()
        where = at[offsets]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(where[:-1].tolist(), where[1:].tolist())]

    def joined(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The decimal ids of each row, joined by commas."""
        data, at = flat.spread(self.decimals, self.decimal_at, ids.astype(np.int64))
        data = data.tobytes()
        where = at[offsets]
        return [data[a : b - 1] if b > a else b"" for a, b in zip(where[:-1].tolist(), where[1:].tolist())]


_SAFE_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")


def _portions(text: str) -> Iterator[str]:
    """The text cut before blanks between two letters, where a token begins in any case, into about PIECE characters."""
    begin = 0
    while len(text) - begin > 2 * PIECE and (cut := _SAFE_CUT.search(text, begin + PIECE)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


def load(path: str) -> Bpe:
    """The tables of a vocabulary file, kept for as long as the worker process lives."""
    if path not in _tables:
        with open(path, encoding="utf-8") as file:
            _tables[path] = Bpe(file.read())
    return _tables[path]


def share(df: DataFrame, path: str) -> str:
    """Hand the vocabulary file to all executors; the name under which load_shared() finds it there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def load_shared(name: str) -> Bpe:
    return load(SparkFiles.get(name))


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of a bounded number of text bytes, with the Python strings."""
    texts = batch.column(batch.schema.get_field_index(column))
    for first, rows in flat.slices(texts):
        yield batch.slice(first, rows), texts.slice(first, rows).to_pylist()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """One row of (id_col, ids array<int>) for each row of df.

    Null and empty texts give an empty array; repeated rows stay; other columns are left out, so their names never
    clash. No shuffle: rows are encoded where they are read.
    """
    name = share(df, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_shared(name)
        for batch in batches:
            for part, texts in texts_of(batch, "__text"):
                ids, at = bpe.encode(texts, special)
                rows = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part.column(0), rows], names=[id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The reverse of encode(): one row of (id_col, text); a null array gives an empty text."""
    name = share(df, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_shared(name)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            at = np.asarray(lists.offsets, np.int64)
            ids = np.asarray(lists.values, np.int64)[at[0] : at[-1]]
            yield pa.record_batch([batch.column(0), pa.array(bpe.decode(ids, at - at[0]))], names=[id_col, "text"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(ids_col).alias("__ids")).mapInArrow(work, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest each text in one pass: (id_col, n_tokens, ids_sha256, decoded_sha256).

    The digests are of the decimal ids joined by commas and of the text decoded from those ids. Null texts count as
    empty. One pass keeps only a slice of a batch in memory and writes no token arrays.
    """
    name = share(df, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_shared(name)
        for batch in batches:
            for part, texts in texts_of(batch, "__text"):
                ids, at = bpe.encode(texts)
                joined = [hashlib.sha256(x).hexdigest() for x in bpe.joined(ids, at)]
                texts = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in bpe.decode(ids, at)]
                yield pa.record_batch([part.column(0), pa.array(np.diff(at)), pa.array(joined), pa.array(texts)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(work, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

