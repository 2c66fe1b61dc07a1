"""Removal of passages that repeat across documents, by content-defined chunks of lines.

A line ends at a line break and, since prose has few of them, after each word whose hash is the least among its
neighbours. A rolling hash over the hashes of several lines chooses chunk boundaries: the places where it is least among
the lines around. Both choices depend on nearby words alone, so a passage has the same lines and chunks wherever it
stands, and one of `least` words and more holds a whole chunk at least, however it lies in the text.

Chunks found in an earlier document (or earlier in the same) put the two texts on a diagonal: a pair of documents and the
distance between their places. Along each diagonal the bytes of both are compared, and runs of at least `least` equal
words are removed. The first occurrence of everything stays, and whatever goes stands in one piece in an earlier text.

A chunk is held against its first holder only, which may lack the passage around it. So a second step takes the windows of
`least` words that hold a chunk of such a diagonal and aren't equal along it, and puts texts on diagonals by the hash of
the whole window. Nothing is passed over: the first holder of such a window lacks it on its own diagonals too (or is the
first holder of the chunk, and then the others found it there), so all who hold it meet. The words removed are those in
runs of `least` and more that stand in an earlier text or earlier in the same, however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitforge.llm import flat

#: Words of a repeated run that is removed, at least.
MIN_WORDS = 25
#: Words of a line at most.
WRAP = 2
#: Buckets of keys for each partition of a shuffle, at least.
_BUCKETS_EACH = 4
#: What is known of a diagonal besides the other document; and how many of them a row has at most.
_DIAGONAL = ("id", "shift", "low", "high", "open_low", "open_high")
_BUNDLE = 256
_SPACE = b" \t\n\r\x0b\x0c"


def shape(least: int) -> tuple[int, int]:
    """(lines of a chunk, neighbouring places of which one begins a chunk), so that `least` equal words hold a chunk.

    Of n words all but 4 * WRAP - 3 at the edges lie in lines that the words around the passage don't change.
    """
    lines = (least - 4 * WRAP + 3 + WRAP - 1) // WRAP
    if lines < 3:
        raise ValueError(f"runs of {least} words are too short to be found")
    size = max(2, 2 * lines // 5)
    return size, lines - size + 1


def _slid(values: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of values[i : i + size] for every i of which so many follow."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def _least_around(values: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Which values are the least of some `window` neighbours of their row; ends: the end of the row of each value."""
    if len(values) < window:
        return np.zeros(len(values), bool)
    lows = _slid(values, window, np.minimum).copy()
    # A window that runs over the end of its row counts as 0, and no value is equal to it.
    lows[np.arange(len(lows)) + window > ends[: len(lows)]] = 0
    edge = np.zeros(window - 1, np.uint64)
    return (_slid(np.concatenate([edge, lows, edge]), window, np.maximum) == values) & (values > 0)


def chunks(texts: pa.Array, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, first byte, context) of the chunks of a batch; the context is a hash of all words that a window of `least`
    words with the chunk in it can have."""
    size, window = shape(least)
    words = flat.Words(texts, lower=False)
    n = len(words.starts)
    none = np.empty(0, np.int64)
    if not n:
        return none, none, none, none
    rows = words.rows
    owner_end = np.repeat(rows[1:], np.diff(rows))
    breaks = np.zeros(len(words.raw) + 1, np.int64)
    np.cumsum(words.raw == 10, out=breaks[1:])
    ends = _least_around(words.hashes, owner_end, WRAP)
    ends[:-1] |= breaks[words.starts[1:]] > breaks[words.ends[:-1]]
    ends[rows[1:][np.diff(rows) > 0] - 1] = True
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    lines = flat.span_hashes(words.hashes, first, last + 1)
    line_rows = np.searchsorted(first, rows)
    m = len(lines) - size + 1
    if m < 1:
        return none, none, none, none
    at = np.arange(m)
    rolling = flat.span_hashes(lines, at, at + size)
    # Where a chunk would run over the end of its text there is none.
    stop = np.repeat(line_rows[1:], np.diff(line_rows))[:m] - size + 1
    chosen = np.flatnonzero(_least_around(rolling, stop, window) & (at < stop))
    # What chose the place are hashes of words; the key is one of all bytes of the chunk, white space included.
    place = words.starts[first[chosen]]
    key = flat.span_hashes(words.values, place, words.ends[last[chosen + size - 1]], words.total).view(np.int64)
    row = np.searchsorted(line_rows, chosen, "right") - 1
    low, high = first[chosen], last[chosen + size - 1]
    reach = np.maximum(least - (high - low + 1), 0)
    low, high = np.maximum(low - reach, rows[row]), np.minimum(high + reach, rows[row + 1] - 1)
    around = flat.span_hashes(words.values, words.starts[low], words.ends[high], words.total)
    context = flat.mix(around ^ flat.mix((place - words.starts[low]).astype(np.uint64) + key.view(np.uint64)))
    return row, key, place - words.offsets[row], context


def _linked(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a slice of texts tells of its chunks, by the ranks of the texts' ids: (positions of the chunks that are the first
    with their context in the slice, rows of (row, other row, distance, first place, last place) of diagonals within it)."""
    row, _, at, context = found
    order = np.lexsort((at, row, rank[row], context))
    fresh = np.ones(len(order), bool)
    fresh[1:] = context[order][1:] != context[order][:-1]
    head = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(order) else order
    # Rows of one id aren't held against one another.
    later = ~fresh & ((rank[row[order]] > rank[row[head]]) | (row[order] == row[head]))
    a, b = order[later], head[later]
    pairs = np.stack([row[a], row[b], at[b] - at[a], at[a]])
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    if not pairs.shape[1]:
        return order[~later], np.empty((5, 0), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (pairs[:3, 1:] != pairs[:3, :-1]).any(axis=0)]))
    return order[~later], np.concatenate([pairs[:, starts], pairs[3:, np.append(starts[1:], pairs.shape[1]) - 1]])


def _places(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(bucket, key, id, low, diagonal struct<high, first, shift>): the chunks of all rows with an id, one for each context of a
    slice of rows (diagonal is null), and the diagonals within a slice, with any key.

    They are shuffled by a bucket of the key, all chunks of a slice and bucket as one row of arrays: a third less disk than a row
    a chunk. There are some times more buckets than partitions of a shuffle.
    """
    kind = dict(df.dtypes)[id_col]
    bits = int(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * _BUCKETS_EACH).bit_length()

    def listed(keys: np.ndarray, columns: list[pa.Array]) -> tuple[pa.Array, list[pa.Array]]:
        """The bucket of each row, and the columns as lists by bucket."""
        bucket = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0])) if len(order) else order
        offsets = pa.array(np.append(starts, len(order)), pa.int32())
        return pa.array(bucket[order][starts]), [pa.ListArray.from_arrays(offsets, c.take(pa.array(order))) for c in columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "keys", "ids", "lows", "diagonals"]
        for batch in batches:
            for first, n in flat.slices(batch.column(1)):
                ids = batch.column(0).slice(first, n)
                found = chunks(batch.column(1).slice(first, n), least)
                heads, (row, other, shift, low, high) = _linked(found, np.asarray(pc.rank(ids, tiebreaker="dense")))
                heads = np.sort(heads)
                bucket, lists = listed(found[1][heads], [pa.array(found[1][heads]), ids.take(pa.array(found[0][heads])), pa.array(found[2][heads].astype(np.int32))])
                any_key = flat.mix((low.astype(np.uint64) << np.uint64(32)) ^ (shift.astype(np.uint64) << np.uint64(8)) ^ row.astype(np.uint64)).view(np.int64)
                known = pa.StructArray.from_arrays([pa.array(high.astype(np.int32)), ids.take(pa.array(other)), pa.array(shift.astype(np.int32))], ["high", "first", "shift"])
                yield pa.record_batch([bucket, *lists, pa.nulls(len(bucket), pa.list_(known.type))], names=names)
                bucket, lists = listed(any_key, [pa.array(any_key), ids.take(pa.array(row)), pa.array(low.astype(np.int32)), known])
                yield pa.record_batch([bucket, *lists], names=names)

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("__text"))
    packed = rows.mapInArrow(work, f"bucket int, keys array<long>, ids array<{kind}>, lows array<int>, diagonals array<struct<high: int, first: {kind}, shift: int>>").repartition("bucket")
    each = packed.select("bucket", F.posexplode("keys").alias("at", "key"), "ids", "lows", "diagonals")
    return each.select("bucket", "key", *(F.col(c)[F.col("at")].alias(n) for c, n in (("ids", "id"), ("lows", "low"), ("diagonals", "diagonal"))))


def diagonals(places: DataFrame) -> DataFrame:
    """(id, first, shift, low, high, open_low, open_high): for each document and each earlier one that chunks of it stand in (or itself), the
    distances between the places, and from where to where in the document its chunks have that distance; and from where to
    where those that three texts and more have (null: none do).

    A chunk is held against the first with the same context in its slice of rows, and those against the first of all. So
    the middle of a passage that is common to all documents has a row a slice in the one shuffle by key, not one a document.
    """
    # Key before bucket, which follows from it: rows are sorted by the first column's bits, others are compared only where these are equal.
    by_key = Window.partitionBy("key", "bucket").orderBy(F.col("diagonal").isNotNull(), "id", "low")
    lead = F.first(F.struct("id", "low")).over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = F.col("diagonal").isNotNull()
    # Of two holders, one is the first. Only three and more may have in common what the first one lacks.
    rows = places.withColumn("lead", lead).withColumn("open", ~known & ((F.row_number().over(by_key) > 2) | F.lead("low").over(by_key).isNotNull()))
    linked = F.struct(F.col("low").alias("high"), F.col("lead.id").alias("first"), (F.col("lead.low") - F.col("low")).alias("shift"))
    rows = rows.where(known | (F.col("lead") < F.struct("id", "low"))).select("id", "low", "open", F.coalesce("diagonal", linked).alias("d"))
    return _drawn(rows.select("id", "d.first", "d.shift", "low", "d.high", F.when(F.col("open"), F.col("low")).alias("open")))


def _drawn(rows: DataFrame) -> DataFrame:
    """(id, first, shift, low, high, open_low, open_high) from places of diagonals; the last two are of the open ones."""
    return rows.groupBy("id", "first", "shift").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("open").alias("open_low"), F.max("open").alias("open_high"))


def window_diagonals(windows: DataFrame) -> DataFrame:
    """Like diagonals(), from (key, id, low) of windows of words, each held against the first of all with its key."""
    of_key = Window.partitionBy("key").orderBy("id", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = windows.withColumn("lead", F.first(F.struct("id", "low")).over(of_key)).where(F.col("lead") < F.struct("id", "low"))
    return _drawn(rows.select("id", F.col("lead.id").alias("first"), (F.col("lead.low") - F.col("low")).alias("shift"), "low", F.col("low").alias("high"), F.lit(None).cast("int").alias("open")))


class Texts:
    """The words of several texts, one blank after each: raw bytes, the byte each text begins at (offsets, one more at the end),
    first and last (exclusive) byte of every word (starts, ends), and the words before each text (rows, one more at the end)."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offsets[1:])
        solid = np.zeros(len(self.raw) + 2, np.int8)
        solid[1:-1] = ~flat.IS_SPACE[self.raw]
        step = np.diff(solid)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.rows = np.searchsorted(self.starts, self.offsets)

    def widened(self, row: np.ndarray, low: np.ndarray, high: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of raw from `by` words before the word at byte `low` of text `row` to as many after the one at `high`; none
        in a text without words."""
        base, first, last = self.offsets[row], self.rows[row], self.rows[row + 1] - 1
        i = np.maximum(first, np.searchsorted(self.starts, base + low) - by)
        j = np.minimum(last, np.searchsorted(self.starts, base + high) + by)
        if not len(self.starts):
            return base, base
        some = first <= last
        return np.where(some, self.starts[np.minimum(i, j)], base), np.where(some, self.ends[j], base)


def equal_runs(own: np.ndarray, other: np.ndarray, bounds: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the runs of `shortest` equal bytes and more between two arrays, none across a bound; the arrays are of whole
    groups of four bytes and differ after the last bound.

    A run of seven bytes and more holds an equal group, so bytes are looked at only in groups beside an equal one; and what
    begins before an equal group ends at the next byte that differs in such a group.
    """
    same = own.view(np.uint32) == other.view(np.uint32)
    beside = ~same
    if shortest >= 7:
        close = np.zeros(len(same), bool)
        close[1:] = same[:-1]
        close[:-1] |= same[1:]
        beside &= close
    at = (np.flatnonzero(beside)[:, None] * 4 + np.arange(4)).ravel()
    differ = at[own[at] != other[at]]
    begins = np.insert(differ + 1, np.searchsorted(differ + 1, bounds[:-1]), bounds[:-1])
    stops = np.insert(differ, np.searchsorted(differ, bounds[1:]), bounds[1:])
    # The arrays differ after the last bound, where a byte may have been looked at that no diagonal ends before.
    n = min(len(begins), len(stops))
    begins, stops = begins[:n], np.minimum(stops[:n], bounds[-1])
    long = stops - begins >= shortest
    if shortest >= 7:
        long &= same[np.minimum((begins + 3) // 4, len(same) - 1)]
    return begins[long], stops[long]


class Marks:
    """The diagonals of the texts of a batch, with the other text's bytes along them, from a column of lists."""

    def __init__(self, column: pa.Array):
        offsets, listed = np.asarray(column.offsets), column.values
        self.offsets, self.counts = offsets, np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        self.shift, self.low, self.high, self.begin = (np.asarray(listed.field(c).fill_null(0)).astype(np.int64) for c in ("shift", "low", "high", "begin"))
        self.open_low, self.open_high = (np.asarray(listed.field(c).fill_null(-1)).astype(np.int64) for c in ("open_low", "open_high"))
        pieces = listed.field("piece")
        self.given = np.asarray(pieces.is_valid())
        self.place = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :].astype(np.int64) if len(pieces) else np.zeros(1, np.int64)
        self.data = np.frombuffer(pieces.buffers()[2], np.uint8) if len(pieces) and pieces.buffers()[2] is not None else np.empty(0, np.uint8)

    def of(self, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the diagonals of the texts `picks` of the batch, for each the position in picks)."""
        counts = self.counts[picks]
        owner = np.repeat(np.arange(len(picks)), counts)
        return np.arange(counts.sum()) + np.repeat(self.offsets[:-1][picks] - np.cumsum(counts) + counts, counts), owner

    def any_open(self) -> np.ndarray:
        """Of which texts of the batch a diagonal is open."""
        total = np.concatenate([[0], np.cumsum(self.open_low >= 0)])
        return total[self.offsets[:-1] + self.counts] > total[self.offsets[:-1]]

    def runs(self, at: np.ndarray, row: np.ndarray, texts: Texts, fewest: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in `at`, first word, end word) of the runs of equal words along the diagonals `at`, which are those of texts
        `row`: of `fewest` words and more on open ones, of `least` on the others. Words are counted over all texts."""
        base, size = texts.offsets[row], texts.offsets[row + 1] - texts.offsets[row] - 1
        given, shift = self.given[at], self.shift[at]
        from_byte, to_byte = texts.widened(row, self.low[at] + np.where(given, 0, shift), self.high[at] + np.where(given, 0, shift), least)
        # Where the other text's bytes stand, in `data` or in the text itself, and the byte of the text that lies at the first.
        from_byte, to_byte = np.where(given, self.place[at], from_byte), np.where(given, self.place[at + 1], to_byte)
        begin = np.where(given, self.begin[at], from_byte - base - shift)
        low = np.maximum(begin, 0)
        lengths = np.maximum(np.minimum(begin + to_byte - from_byte, size) - low, 0)
        most = np.where(self.open_low[at] >= 0, fewest, least)
        own_at, other_at = base + low, from_byte + low - begin
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ends = np.cumsum(lengths)
        first = 0
        while first < len(at):
            # Some four million bytes at once; a longer diagonal by itself.
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (4 << 20), "right")))
            part = slice(first, stop)
            found.append(self._runs(texts, *(x[part] for x in (own_at, other_at, from_byte, to_byte, lengths, given, most)), first))
            first = stop
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def _runs(self, texts: Texts, own_at, other_at, from_byte, to_byte, lengths, given, most, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, data = texts.raw, self.data
        bounds = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        # Whole groups of four bytes.
        edge = np.zeros(4 + -int(bounds[-1]) % 4, np.uint8)
        own = np.concatenate([*(raw[a : a + n] for a, n in zip(own_at.tolist(), lengths.tolist())), edge])
        other = np.concatenate([*((data if g else raw)[a : a + n] for a, n, g in zip(other_at.tolist(), lengths.tolist(), given.tolist())), edge + 1])
        shortest = 2 * int(most.min())
        begins, stops = equal_runs(own, other, bounds, shortest)
        m = np.searchsorted(bounds, begins, "right") - 1
        a, b = own_at[m] + begins - bounds[m], own_at[m] + stops - bounds[m]
        i, j = np.searchsorted(texts.starts, a), np.searchsorted(texts.ends, b, "right")
        if not len(a) or not len(texts.starts):
            return (np.empty(0, np.int64),) * 3
        # Words must be whole in both texts; what is laid beside begins and ends where words of its text do.
        before, after = other_at[m] + begins - bounds[m] - 1, other_at[m] + stops - bounds[m]
        i = i + ((i < j) & (texts.starts[np.minimum(i, len(texts.starts) - 1)] == a) & (before >= from_byte[m]) & self._solid(raw, before, given[m]))
        j = j - ((i < j) & (texts.ends[j - 1] == b) & (after < to_byte[m]) & self._solid(raw, after, given[m]))
        kept = j - i >= most[m]
        return m[kept] + first, i[kept], j[kept]

    def _solid(self, raw: np.ndarray, at: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Whether the bytes at these places, in `data` or in `raw`, are of words."""
        out = np.zeros(len(at), bool)
        for bytes_, here in ((self.data, given), (raw, ~given)):
            if here.any() and len(bytes_):
                out[here] = ~flat.IS_SPACE[bytes_[np.clip(at[here], 0, len(bytes_) - 1)]]
        return out


def open_windows(texts: Texts, row: np.ndarray, low: np.ndarray, high: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> np.ndarray:
    """First words of the windows of `least` words that may hold an open chunk and are in no run of equal words; `row`, `low` and
    `high` are the text and the open places of diagonals, `runs` are Marks.runs of them.

    A chunk has a word a line at least, and begins between the places that its diagonal names (-1: none is open).
    """
    size = shape(least)[0]
    m, a, b = runs
    owner = row[m]
    from_word, to_word = (np.searchsorted(texts.starts, texts.offsets[owner] + place[m], "right") - 1 for place in (low, high))
    first = np.maximum(np.maximum(a, from_word) + size - least, texts.rows[owner])
    end = np.minimum(np.minimum(b - size, to_word), texts.rows[owner + 1] - least)
    shown = (low[m] >= 0) & (first <= end)
    n = len(texts.starts) + 1
    step = np.bincount(first[shown], minlength=n) - np.bincount(end[shown] + 1, minlength=n)
    whole = b - a >= least
    covered = np.bincount(a[whole], minlength=n) - np.bincount(b[whole] - least + 1, minlength=n)
    return np.flatnonzero((np.cumsum(step) > 0) & (np.cumsum(covered) == 0))


def _unpacked(column: pa.Array, picks: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The picked texts of a column of compressed ones with their positions, some `most` bytes at once."""
    coder = zstandard.ZstdDecompressor()
    rows, texts, size = [], [], 0
    for i in picks.tolist():
        texts.append(coder.decompress(column[i].as_buffer()))
        rows.append(i)
        size += len(texts[-1])
        if size >= most:
            yield np.array(rows), texts
            rows, texts, size = [], [], 0
    if rows:
        yield np.array(rows), texts


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs, those that overlap or adjoin as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, listed): the diagonals (id, first, shift, low, high, open_low, open_high) that a batch has with one other text, at most
    _BUNDLE a row."""
    for batch in batches:
        if batch.num_rows:
            code = np.asarray(batch.column(1).dictionary_encode().indices).astype(np.int64)
            order = np.argsort(code, kind="stable")
            begins = np.concatenate([[True], np.diff(code[order]) > 0])
            rank = np.arange(len(order)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            starts = np.flatnonzero(rank % _BUNDLE == 0)
            listed = pa.StructArray.from_arrays([batch.column(c).take(pa.array(order)) for c in _DIAGONAL], list(_DIAGONAL))
            yield pa.record_batch([batch.column(1).take(pa.array(order[starts])), pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), listed)], names=["first", "listed"])


def without_repeats(df: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", changed: bool = False) -> DataFrame:
    """df with the repeated passages cut out of text_col, and columns removed_runs and removed_words.

    White space around a removed run shrinks to what stood before it. Null texts stay null, texts without words and rows
    without id stay as they are; rows of one id count as one document and aren't held against one another; ids may be
    of any type with an order. All other columns stay, whatever their names; columns removed_runs and removed_words are
    replaced. An empty table gives no rows. With `changed`, only rows that lose something are returned.
    """
    shown = [c for c in df.columns if c not in ("removed_runs", "removed_words")]
    at, own = shown.index(text_col), shown.index(id_col)
    kinds = dict(df.dtypes)
    names = [f"c{i}" for i in range(len(shown))]
    packed_kinds = ", ".join(f"{n} {'binary' if i == at else kinds[shown[i]]}" for i, n in enumerate(names))
    id_kind = kinds[id_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first, n in flat.slices(batch.column(at)):
                part = batch.slice(first, n)
                texts = pa.array([None if t is None else coder.compress(t) for t in part.column(at).cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.record_batch([texts if i == at else part.column(i) for i in range(len(shown))], names=names)

    # Texts are compressed before the one shuffle, by id, that brings them to the places of both ends of a diagonal.
    packed = df.select(*(F.col(c).alias(n) for c, n in zip(shown, names))).mapInArrow(pack, packed_kinds).withColumn("__key", F.xxhash64(names[own]))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(listed.offsets)))
            kept = dict(zip(_DIAGONAL, listed.flatten().flatten()))
            shifts, lows, highs = (np.asarray(kept[c]).astype(np.int64) for c in ("shift", "low", "high"))

            def told(at: np.ndarray, begins: pa.Array, pieces: pa.Array) -> pa.RecordBatch:
                return pa.record_batch([*(kept[c].take(pa.array(at)) for c in _DIAGONAL), begins, pieces], names=[*_DIAGONAL, "begin", "piece"])

            # Equal texts are unpacked once. A repetition within the document needs none.
            coded = batch.column(2 + at).dictionary_encode()
            own_text = np.asarray(pc.equal(kept["id"], batch.column(0).take(pa.array(owner)))) | np.asarray(coded.is_null())[owner]
            code = np.asarray(coded.indices.fill_null(-1))[owner]
            if own_text.any():
                yield told(np.flatnonzero(own_text), pa.nulls(own_text.sum(), pa.int32()), pa.nulls(own_text.sum(), pa.binary()))
            for codes, texts in _unpacked(coded.dictionary, np.unique(code[~own_text])):
                here = np.flatnonzero(~own_text & np.isin(code, codes))
                found = Texts(texts)
                row = np.searchsorted(codes, code[here])
                a, b = found.widened(row, lows[here] + shifts[here], highs[here] + shifts[here], least)
                begins = (a - found.offsets[row] - shifts[here]).astype(np.int32)
                whole = found.raw.tobytes()
                # Some four million bytes at once.
                for part in np.split(np.arange(len(here)), np.flatnonzero(np.diff(np.cumsum(b - a) >> 22)) + 1):
                    yield told(here[part], pa.array(begins[part]), pa.array([whole[i:j] for i, j in zip(a[part].tolist(), b[part].tolist())], pa.binary()))

    def marked(lines: DataFrame, name: str) -> DataFrame:
        """(<name>_key, <name>): the hash of each id and the diagonals of its document, with the other text's bytes."""
        # Hashes of ids are never null, so no join needs a filter and all share the shuffle of `packed`; and the shuffle that
        # groups the marks is the one of their join. Were two ids to have one hash, bytes would still be compared.
        # The diagonals that a task has with one other text go there as one row, so the text is copied and unpacked once for them.
        # All columns of `packed` are kept, or its shuffle wouldn't be the one that the other joins use.
        diagonal = f"id: {id_kind}, shift: int, low: int, high: int, open_low: int, open_high: int"
        found = lines.select("id", "first", *_DIAGONAL[1:]).mapInArrow(_bundled, f"first {id_kind}, listed array<struct<{diagonal}>>")
        found = found.withColumn("__first", F.xxhash64("first")).hint("merge")
        found = found.join(packed, F.col("__first") == F.col("__key"), "left").select("first", "listed", *names)
        marks = found.mapInArrow(locate, f"{diagonal.replace(':', '')}, begin int, piece binary")
        marks = marks.withColumn(f"{name}_key", F.xxhash64("id")).groupBy(f"{name}_key")
        return marks.agg(F.collect_list(F.struct("shift", "low", "high", "open_low", "open_high", "begin", "piece")).alias(name))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, owner, keys, lows = Marks(batch.column(2)), [], [], []
            picks = np.flatnonzero(marks.any_open() & np.asarray(batch.column(1).is_valid()))
            for rows, packed_texts in _unpacked(batch.column(1), picks):
                texts = Texts(packed_texts)
                listed, row = marks.of(rows)
                runs = marks.runs(listed, row, texts, shape(least)[0], least)
                first = open_windows(texts, row, marks.open_low[listed], marks.open_high[listed], runs, least)
                if len(first):
                    begin, of = texts.starts[first], np.searchsorted(texts.rows, first, "right") - 1
                    keys.append(flat.span_hashes(flat.BYTE_VALUE[texts.raw], begin, texts.ends[first + least - 1]).view(np.int64))
                    lows.append((begin - texts.offsets[of]).astype(np.int32))
                    owner.append(rows[of])
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(lows))], names=["key", "id", "low"])

    rows = packed.hint("merge").join(marked(diagonals(_places(df, id_col, text_col, least)), "__marks"), F.col("__key") == F.col("__marks_key"), "left").select("__key", *names, "__marks")
    open_rows = rows.where("__marks IS NOT NULL").select(names[own], names[at], "__marks").mapInArrow(windows, f"key long, id {id_kind}, low int")
    rows = rows.hint("merge").join(marked(window_diagonals(open_rows), "__more"), F.col("__key") == F.col("__more_key"), "left").select(*names, "__marks", "__more")
    schema = df.select(*shown).schema.add("removed_runs", "long").add("removed_words", "long")

    if changed:
        rows = rows.where("__marks IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, packed_texts = (Marks(batch.column(len(shown))), Marks(batch.column(len(shown) + 1))), batch.column(at)
            texts: list[bytes | None] = [None] * batch.num_rows
            runs, gone = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, found in _unpacked(packed_texts, np.flatnonzero(np.asarray(packed_texts.is_valid()))):
                words = Texts(found)
                cuts: list[list[tuple[int, int]]] = [[] for _ in found]
                for marks in both:
                    listed, row = marks.of(rows)
                    m, first, end = marks.runs(listed, row, words, least, least)
                    for k, a, b in zip(row[m].tolist(), first.tolist(), end.tolist()):
                        cuts[k].append((a, b))
                for k, i in enumerate(rows.tolist()):
                    texts[i] = found[k]
                    if cuts[k]:
                        w0, w1, base = words.rows[k], words.rows[k + 1], words.offsets[k]
                        joined = [(a - int(w0), b - int(w0)) for a, b in _joined(cuts[k])]
                        runs[i], gone[i] = len(joined), sum(b - a for a, b in joined)
                        texts[i] = _without(found[k], (words.starts[w0:w1] - base, words.ends[w0:w1] - base), joined)
            column = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [column if i == at else batch.column(i) for i in range(len(shown))]
            out = pa.record_batch([*columns, pa.array(runs), pa.array(gone)], names=[*shown, "removed_runs", "removed_words"])
            yield out.filter(pa.array(runs > 0)) if changed else out

    return rows.mapInArrow(cut, schema)


def _without(text: bytes, bounds: tuple[np.ndarray, np.ndarray], cuts: list[tuple[int, int]]) -> bytes:
    """The text without the words of the cuts; where what stays ends and goes on with white space, the former's stays."""
    starts, ends = bounds
    out, at = b"", 0
    for a, b in [*cuts, (len(starts), len(starts))]:
        piece = text[at : int(starts[a]) if a < len(starts) else len(text)]
        out += piece.lstrip(_SPACE) if at and (not out or out[-1:] in _SPACE) else piece
        at = int(ends[b - 1]) if b else 0
    return out


def report(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, removed_runs, removed_words, text) of the documents from which a passage was removed."""
    return without_repeats(docs.select(id_col, text_col), least, id_col, text_col, changed=True).select(id_col, "removed_runs", "removed_words", text_col)
