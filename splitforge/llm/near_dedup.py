"""Near-duplicate documents by b-bit MinHash.

Every text is a set of word shingles. Minima of HASHES hash functions give bands for finding candidates; of each
minimum only the low BITS bits are kept, packed into 64-bit integers, and the similarity of a candidate pair is
estimated by counting equal groups of bits, corrected for those equal by chance. Pairs that could be similar enough
are compared on their full sets.

Texts with equal sets become one representative first. The members of a bucket of a band are dealt into parts by their
id; each is compared with the least of its part, and those with the least of all, which makes as many pairs as members.
Buckets whose members are one component then have nothing left to find, and only in the others are members of different
components compared with one another, tile by tile: on signatures first, and on texts those that this leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitforge.llm import flat
from splitforge.llm.components import components
from splitforge.llm.shared import passing, stored

#: Hash functions, those of a band, bits kept of each minimum. A pair of similarity 0.8 shares no band with a
#: probability of 3e-6, one of 0.85 with 2e-8.
HASHES, ROWS, BITS = 96, 4, 4
#: The estimate must come this many standard deviations short of the threshold for a pair to be passed over.
SIGMAS = 5.0
#: Parts that the members of a bucket are dealt into; only a bucket of very many has several in one.
PARTS = 4096
#: Members of a bucket in a tile, about.
TILE = 400
_LANES = HASHES * BITS // 64
_random = np.random.default_rng(20240501)
_MULTIPLY = _random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, HASHES, dtype=np.uint64)


def signatures_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, two set hashes, band keys, packed low bits) of each text."""
    words = flat.Words(texts)
    grams, at = flat.shingles(words.hashes, words.rows, n)
    sizes = np.diff(at)
    some = np.flatnonzero(sizes)
    minima = np.zeros((HASHES, len(sizes)), np.uint64)
    starts = at[:-1][some]
    sums = np.zeros((2, len(sizes)), np.uint64)
    if len(some):
        work = np.empty_like(grams)
        for k in range(HASHES):
            np.multiply(grams, _MULTIPLY[k], out=work)
            np.add(work, _ADD[k], out=work)
            minima[k, some] = np.minimum.reduceat(work, starts)
        sums[0, some] = np.add.reduceat(grams, starts)
        sums[1, some] = np.add.reduceat(flat.mix(grams), starts)
    minima = flat.mix(minima)
    keys = np.zeros((HASHES // ROWS, len(sizes)), np.uint64)
    for band in range(HASHES // ROWS):
        key = np.full(len(sizes), band + 1, np.uint64)
        for row in range(ROWS):
            key = flat.mix(key * np.uint64(31) + minima[band * ROWS + row])
        keys[band] = key
    low = minima & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    packed = np.zeros((_LANES, len(sizes)), np.uint64)
    for k in range(HASHES):
        packed[k // per] |= low[k] << np.uint64(BITS * (k % per))
    return sizes, sums, keys, packed


def signatures(df: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands array<long>, bits array<long>) of every row, from its whole text."""
    kind = dict(df.dtypes)[id_col]

    def lists(table: np.ndarray) -> pa.Array:
        flat_values = pa.array(np.ascontiguousarray(table.T).ravel().view(np.int64))
        return pa.ListArray.from_arrays(pa.array(np.arange(table.shape[1] + 1, dtype=np.int32) * table.shape[0]), flat_values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in flat.slices(batch.column(1), 1_000_000):
                sizes, sums, keys, packed = signatures_of(batch.column(1).slice(first, rows), n)
                columns = [batch.column(0).slice(first, rows), pa.array(sizes.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists(keys), lists(packed)]
                yield pa.record_batch(columns, names=["id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    schema = f"id {kind}, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")).mapInArrow(work, schema)


def estimate(x: Column, y: Column) -> Column:
    """Similarity of two packed signatures: the share of equal groups of bits, less what chance makes equal."""
    ones = F.lit(int("1" * (64 // BITS), 2**BITS))
    differ = F.lit(0)
    for lane in range(_LANES):
        bits = x[lane].bitwiseXOR(y[lane])
        for shift in range(BITS.bit_length() - 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1 << shift))
        differ = differ + F.bit_count(bits.bitwiseAND(ones))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / float(HASHES)) - chance) / (1 - chance)


def possible(percent: int, x: str, y: str) -> Column:
    """Whether two rows (with n_shingles and bits) could reach the similarity."""
    least = percent / 100
    chance = 2.0**-BITS
    equal = least + (1 - least) * chance
    slack = SIGMAS * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)
    small, large = F.least(F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")), F.greatest(F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles"))
    return (small * 100 >= large * percent) & (estimate(F.col(f"{x}.bits"), F.col(f"{y}.bits")) >= least - slack)


def verify(pairs: DataFrame, texts: DataFrame, percent: int, n: int = 5) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar: 100 * shared >= percent * all. texts: (id, text)."""
    kind = dict(pairs.dtypes)["a"]
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def keyed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = flat.Words(texts)
        grams, at = flat.shingles(words.hashes, words.rows, n)
        owner = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
        return np.stack([owner, grams]), np.diff(at)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in flat.slices(batch.column(2), 1_000_000):
                x, nx = keyed(batch.column(2).slice(first, rows))
                y, ny = keyed(batch.column(3).slice(first, rows))
                every = np.concatenate([x, y], axis=1)
                every = every[:, np.lexsort((every[1], every[0]))]
                twice = (every[:, 1:] == every[:, :-1]).all(axis=0)
                shared = np.bincount(every[0, 1:][twice].astype(np.int64), minlength=rows)
                keep = (100 * shared >= percent * (nx + ny - shared)) & (shared > 0)
                yield batch.select([0, 1]).slice(first, rows).filter(pa.array(keep))

    return both.mapInArrow(work, f"a {kind}, b {kind}")


def groups(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept): the groups of texts linked by 100 * shared >= percent * all shingles.

    component_id is the least id that links lead to, kept marks the row with that id. Words are runs of other bytes
    than ASCII white space in lower case (A-Z); a text of fewer than n words is one shingle; null texts and texts
    without words link with nothing. Rows of one id count as one document with several texts and are all returned; a
    null id takes the component of its equals. An empty table gives no rows; further columns are ignored.
    """
    base = docs.select(F.col(id_col), F.col(text_col))
    rows = stored(signatures(base, id_col, text_col, n), "signatures")
    key = ["set_a", "set_b", "n_shingles"]
    full = rows.where("n_shingles > 0 AND id IS NOT NULL")
    reps = stored(full.groupBy(*key).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "representatives")
    found = _links(reps, base.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), percent, n)
    named = reps.select(*key, "rep").join(found, F.col("rep") == F.col("id"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    # Ids that several representatives share, from rows repeated with other texts, are one component.
    out = rows.select("id", *key).join(named, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _links(reps: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """(id, component) of the representatives that are linked with others."""
    with passing(reps.sparkSession) as put:
        small = reps.select(F.col("rep").alias("id"), "n_shingles", "bits")
        buckets = reps.select("rep", F.explode("bands").alias("band")).withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PARTS)).cast("int"))
        # Every join below is by part of a band: a band has at most PARTS rows where its parts meet.
        parts = buckets.groupBy("band", "part").agg(F.min("rep").alias("near"), F.count("*").alias("n"))
        bands = parts.groupBy("band").agg(F.min("near").alias("hub"), F.sum("n").alias("members")).where("members > 1")
        parts = put(parts.join(bands, "band").select("band", "part", "near", "hub", "members"), "parts")
        members = put(buckets.join(parts, ["band", "part"]), "members")
        # All texts are shuffled once, at any size, to keep those of bucket members.
        ids = members.select(F.col("rep").alias("id")).distinct().hint("merge")
        own = put(texts.hint("merge").join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")), "texts")
        stars = members.select("rep", F.when(F.col("rep") != F.col("near"), F.col("near")).otherwise(F.col("hub")).alias("hub")).where("rep != hub").distinct()
        x, y = small.alias("x"), small.alias("y")
        stars = stars.join(x, F.col("rep") == F.col("x.id")).join(y, F.col("hub") == F.col("y.id")).where(possible(percent, "x", "y"))
        pairs = put(stars.select(F.col("rep").alias("a"), F.col("hub").alias("b")), "pairs")
        links = put(verify(pairs, own, percent, n), "links")
        first = components(links)
        # Buckets of three and more whose members aren't one component: pairs of members of different components.
        placed = members.where("members > 2").join(first, F.col("rep") == F.col("id"), "left").select("band", "part", "members", "rep", F.coalesce("component", "rep").alias("component"))
        mixed = placed.groupBy("band", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        mixed = mixed.groupBy("band").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("band")
        rest = placed.join(parts.join(mixed, "band").select("band", "part"), ["band", "part"]).drop("part")
        rest = rest.join(reps.select("rep", "n_shingles", "bits", "bands"), "rep")
        further = put(_across(rest, own, percent, n), "links")
        return components(links.unionByName(further).unionByName(first.select(F.col("id").alias("a"), F.col("component").alias("b"))))


class _Tile:
    """The rows of a pair of tiles: pairs of its left and right members that belong to different components."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        tile, first, last = (np.asarray(self.column(c)) for c in ("tile", "i", "j"))
        self.group, self.sizes = np.asarray(self.column("component")), np.asarray(self.column("n_shingles"))
        order = np.argsort(self.group, kind="stable")
        self.left, self.right, self.alike = order[(tile == first)[order]], order[(tile == last)[order]], first[0] == last[0]
        self.bits, self.bands = self._matrix("bits"), self._matrix("bands")
        self.band = np.asarray(self.column("band"), np.int64).view(np.uint64)[0]

    def column(self, name: str) -> pa.Array:
        out = self.table.column(name).combine_chunks()
        return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out

    def _matrix(self, name: str) -> np.ndarray:
        column = self.column(name)
        return np.asarray(column.flatten(), np.int64).reshape(len(column), -1).view(np.uint64)

    def candidates(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(x, ys): the members that could be similar enough to x by the packed bits; a pair is looked at in the first
        band that it shares."""
        least, chance = percent / 100, 2.0**-BITS
        equal = least + (1 - least) * chance
        cut = least - SIGMAS * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)
        low_bits = np.uint64(int("1" * (64 // BITS), 2**BITS))
        for x in self.left.tolist():
            ys = self.right[self.group[self.right] != self.group[x]]
            if self.alike:
                ys = ys[self.group[ys] > self.group[x]]
            small, large = np.minimum(self.sizes[ys], self.sizes[x]), np.maximum(self.sizes[ys], self.sizes[x])
            ys = ys[small * 100 >= large * percent]
            shared = self.bands[ys] == self.bands[x]
            ys = ys[self.bands[x][shared.argmax(axis=1)] == self.band]
            differ = self.bits[ys] ^ self.bits[x]
            for shift in range(BITS.bit_length() - 1):
                differ |= differ >> np.uint64(1 << shift)
            count = np.bitwise_count(differ & low_bits).sum(axis=1)
            ys = ys[((1 - count / HASHES) - chance) / (1 - chance) >= cut]
            if len(ys):
                yield x, ys


def _across(rest: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (a, b) that join what is linked between different components of a bucket. texts: (id, text).

    The members of a bucket are dealt into tiles of bounded size, and each pair of tiles meets in one task, twice: with
    signatures, to find the members that have a candidate there, and with the texts of those alone, to compare full
    sets. A task gives a spanning forest of its links, so a bucket of any size gives no more rows than it has members
    and tiles.
    """
    kind = dict(rest.dtypes)["rep"]
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    dealt = rest.withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("other", "members")

    def involved(table: pa.Table) -> pa.Table:
        tile, some = _Tile(table), np.zeros(table.num_rows, bool)
        for x, ys in tile.candidates(percent):
            some[x] = True
            some[ys] = True
        return tile.table.filter(pa.array(some))

    def linked(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        pairs = list(tile.candidates(percent))
        a = np.repeat([x for x, _ in pairs], [len(ys) for _, ys in pairs]).astype(np.int64)
        b = np.concatenate([ys for _, ys in pairs]).astype(np.int64) if pairs else a
        if len(a):
            keep = _similar(tile.column("text"), a, b, percent, n)
            a, b = a[keep], b[keep]
        ids = np.asarray(tile.column("rep"))
        root = roots(len(ids), a, b)
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(ids[root[some]])})

    left = dealt.groupBy("band", "i", "j").applyInArrow(involved, dealt.schema)
    left = left.join(texts.select(F.col("id").alias("rep"), "text"), "rep")
    return left.groupBy("band", "i", "j").applyInArrow(linked, f"a {kind}, b {kind}")


def _similar(texts: pa.Array, a: np.ndarray, b: np.ndarray, percent: int, n: int) -> np.ndarray:
    """Whether the full sets of the texts at a and b are similar, for each of the pairs."""
    used = np.unique(np.concatenate([a, b]))
    words = flat.Words(texts.take(pa.array(used)))
    grams, at = flat.shingles(words.hashes, words.rows, n)
    sizes = np.diff(at)
    a, b = np.searchsorted(used, a), np.searchsorted(used, b)
    shared = np.zeros(len(a), np.int64)
    distinct, column = np.unique(grams, return_inverse=True)
    if len(used) ** 2 * len(distinct) * 1e-10 < (sizes[a] + sizes[b]).sum() * 3e-8:
        # Many pairs of texts with common shingles: products of the 0/1 rows, some columns at a time.
        owner, products = np.repeat(np.arange(len(used)), sizes), np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for low in range(0, len(distinct), 8192):
            first, last = np.searchsorted(column, [low, low + 8192])
            rows = np.zeros((len(used), 8192), np.float32)
            rows[owner[first:last], column[first:last] - low] = 1
            products += rows @ rows.T
        shared = products[a, b].astype(np.int64)
    else:
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            shared[i] = len(np.intersect1d(grams[at[x] : at[x + 1]], grams[at[y] : at[y + 1]], assume_unique=True))
    return (100 * shared >= percent * (sizes[a] + sizes[b] - shared)) & (shared > 0)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that links (a, b) lead to, by position."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        then = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(then, end, low)
        then = then[then]
        if np.array_equal(then, root):
            return root
        root = then
