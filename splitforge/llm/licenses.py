"""License scans by an exact set-similarity join of text windows with license notices.

Text blocks are windows of words: a notice of up to h words, h a power of two, is held against windows of 2 h words that
begin every h words, so wherever it stands, and however it is broken into lines, one window has it whole. A window
matches if it holds the share CONTAINED of the notice's distinct words, those that name the license among them; a notice
that is part of another one in the same window is not counted beside it.

Only words that some notice has matter. One pass over the texts counts them and keeps their places; the counts over all
documents order the words, rarest first. A window that matches must share one of the first |T| - c + 1 words of the
notice's order, where c is the least number of common words (prefix filter); it must have c known words (length filter);
and the first common word must leave enough words behind it in both orders (positional filter). What is left is counted
in full. No window is passed over, and none is built unless it holds a rare word of a notice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.llm import flat
from splitforge.llm.shared import stored

#: Share of a notice's distinct words that a window must hold.
CONTAINED = 0.8
#: Phrases that name a license, with its label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices, with their labels and the words that tell each from the others.
NOTICES = (
    ("Released under the MIT License.", "mit", "mit"),
    ("This project is licensed under the terms of the MIT license.", "mit", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", "granted"),
    ("Licensed under the Apache License, Version 2.0.", "apache", "apache"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache", "compliance"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gnu general"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl", "gnu general"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl", "lesser"),
    ("licensed under the GNU Affero General Public License", "agpl", "affero"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", "redistribution"),
    ("licensed under the BSD 3-Clause License", "bsd", "bsd"),
    ("licensed under the ISC License", "isc", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc", "granted"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl", "mozilla"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "epl", "eclipse"),
    ("This is free and unencumbered software released into the public domain.", "unlicense", "unencumbered"),
    ("Licensed under CC BY 4.0.", "cc-by", "cc by"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa", "cc by sa"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "cc by nc"),
    ("Licensed under CC BY-ND 4.0.", "cc-by-nd", "cc by nd"),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa", "cc by nc sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by", "creative commons attribution"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa", "creative commons sharealike"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc", "creative commons noncommercial"),
)
#: Words are runs of digits, small letters and characters beyond ASCII, after A-Z are lower-cased.
PART = np.zeros(256, bool)
PART[[*range(48, 58), *range(97, 123)]] = True
PART[128:] = True


def _words(texts: Sequence[str]) -> list[np.ndarray]:
    words = flat.Words(pa.array(list(texts), pa.large_string()), True, PART)
    return [words.hashes[a:b] for a, b in zip(words.rows[:-1], words.rows[1:])]


@dataclass(frozen=True)
class Notices:
    """Notices, their names and phrases in numbers of their words; see known()."""

    words: np.ndarray
    notices: list[np.ndarray]
    names: list[np.ndarray]
    phrases: list[np.ndarray]
    steps: list[int]


def known(notices: Sequence[tuple[str, str, str]], phrases: Sequence[tuple[str, str]]) -> Notices:
    """The hashes of all words of notices and phrases, ascending; each notice's distinct words, its name's and each phrase's
    words by their places there; and the step h of each notice's windows."""
    texts, names, said = _words([t for t, _, _ in notices]), _words([n for _, _, n in notices]), _words([t for t, _ in phrases])
    if any(len(w) == 0 for w in [*texts, *said]):
        raise ValueError("a notice or phrase has no words")
    if any(len(np.setdiff1d(n, w)) for n, w in zip(names, texts)):
        raise ValueError("a notice lacks a word of its name")
    words = np.unique(np.concatenate([*texts, *said, np.empty(0, np.uint64)]))
    steps = [1 << (len(w) - 1).bit_length() for w in texts]
    return Notices(words, *([np.unique(np.searchsorted(words, w)) for w in some] for some in (texts, names)), [np.searchsorted(words, w) for w in said], steps)


def _places(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(row, id, n_words, place, word): where the known words stand in each text; row is a number of a document."""
    kind = dict(docs.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = flat.Lookup(words)
        for batch in batches:
            for first, size in flat.slices(batch.column("text")):
                part = batch.slice(first, size)
                found = flat.Words(part.column("text"), True, PART)
                at, word = lookup(found.hashes)
                owner = np.searchsorted(found.rows, at, "right") - 1
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=size))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (at - found.rows[owner], word)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(found.rows).astype(np.int64)), *lists], ["id", "n_words", "place", "word"])

    return docs.select("id", "text").mapInArrow(work, f"id {kind}, n_words long, place array<int>, word array<int>")


def phrase_places(phrases: list[np.ndarray], owner: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, phrase) of every place where a phrase's words stand one after another."""
    out = [[], [], []]
    for k, phrase in enumerate(phrases):
        n = len(place) - len(phrase) + 1
        hit = np.ones(max(n, 0), bool)
        for j, w in enumerate(phrase):
            end = slice(j, j + max(n, 0))
            hit &= (word[end] == w) & (owner[end] == owner[: max(n, 0)]) & (place[end] == place[: max(n, 0)] + j)
        at = np.flatnonzero(hit)
        for part, values in zip(out, (owner[at], place[at], np.full(len(at), k))):
            part.append(values)
    return tuple(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in out)


def contained(given: Notices, rank: np.ndarray, share: float, owner: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word of the window, notice, common words) of every window that holds the share of a notice.

    rank: of each known word its place in the order from the rarest on; owner ascends, and place within a text.
    """
    out = [[], [], [], []]
    for h in sorted(set(given.steps)):
        for parts, values in zip(out, _windows_that_hold(given, h, rank, share, owner, place, word)):
            parts.append(values)
    text, first, notice, common = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in out)
    alone = np.ones(len(text), bool)
    window = text * (int(place.max(initial=0)) + 1) + first
    for k, own in enumerate(given.notices):
        for other, longer in enumerate(given.notices):
            if given.steps[k] == given.steps[other] and len(own) < len(longer) and np.isin(own, longer).all():
                alone &= (notice != k) | ~np.isin(window, window[notice == other])
    return text[alone], first[alone], notice[alone], common[alone]


def least_common(size: int, share: float) -> int:
    """The least number of common words for a notice of so many: the share of them, rounded up."""
    return max(1, int(np.ceil(share * size - 1e-9)))


def _windows_that_hold(given, h, rank, share, owner, place, word):
    numbers = np.flatnonzero(np.array(given.steps) == h)
    notices = [given.notices[k] for k in numbers]
    ordered = [np.sort(rank[w]) for w in notices]
    need = np.array([least_common(len(w), share) for w in ordered])
    # Prefix filter: (word, notice) pairs by the word's rank.
    pairs = np.array(sorted((r, k) for k, w in enumerate(ordered) for r in w[: len(w) - need[k] + 1].tolist()))
    starts = np.searchsorted(pairs[:, 0], np.arange(len(rank) + 1))
    of_rank = rank[word]
    many = np.diff(starts)[of_rank]
    hit = np.flatnonzero(many)
    if not len(hit):
        return [np.empty(0, np.int64)] * 4
    # A word stands in the window that begins in its own step and in the one before. Windows of a text are numbered on.
    span = int(place.max()) // h + 2
    window = owner * span + place // h
    at, picks = np.repeat(hit, many[hit]), flat.spread(pairs[:, 1], starts, of_rank[hit])[0]
    both = np.concatenate([window[at] - 1, window[at]])
    inside = np.concatenate([place[at] >= h, np.ones(len(at), bool)])
    width = len(notices)
    candidate = np.unique((both * width + np.tile(picks, 2))[inside])
    windows, notice = np.divmod(candidate, width)
    # The distinct known words of each such window, in the order of their ranks.
    chosen = np.unique(windows)
    every = np.concatenate([window - 1, window])
    held = np.concatenate([place >= h, np.ones(len(place), bool)])
    near = np.minimum(np.searchsorted(chosen, every), len(chosen) - 1)
    held &= chosen[near] == every
    known_words = np.unique(near[held] * len(rank) + np.tile(of_rank, 2)[held])
    begins = np.searchsorted(known_words, np.arange(len(chosen) + 1) * len(rank))
    mine = np.searchsorted(chosen, windows)
    # Length filter.
    fits = begins[mine + 1] - begins[mine] >= need[notice]
    windows, notice, mine = windows[fits], notice[fits], mine[fits]
    common = np.zeros(len(windows), np.int64)
    for k, words in enumerate(ordered):
        at = np.flatnonzero(notice == k)
        if not len(at):
            continue
        # Positional filter: what stands behind the first common word of the prefix in either order bounds the rest.
        prefix = words[: len(words) - need[k] + 1]
        shared, where = _has(known_words, mine[at], prefix, len(rank))
        i = shared.argmax(axis=1)
        j = where[np.arange(len(at)), i] - begins[mine[at]]
        most = 1 + np.minimum(len(words) - i - 1, begins[mine[at] + 1] - begins[mine[at]] - j - 1)
        at = at[shared.any(axis=1) & (most >= need[k])]
        at = at[_has(known_words, mine[at], rank[given.names[numbers[k]]], len(rank))[0].all(axis=1)]
        common[at] = _has(known_words, mine[at], words, len(rank))[0].sum(axis=1)
    good = common >= need[notice]
    text, number = np.divmod(windows[good], span)
    return text, number * h, numbers[notice[good]], common[good]


def _has(keys: np.ndarray, windows: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window has each word, and where its key stands or would stand."""
    key = windows[:, None] * width + words[None, :]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return keys[at] == key, at


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[tuple[str, str, str]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES, share: float = CONTAINED) -> DataFrame:
    """(id_col, n_words, phrases, notices) of every document.

    phrases: an array of (label, first) of the places where a phrase stands, by place; notices: an array of (label,
    notice, first, words, contained) of the windows that hold the share of a notice's words and its name: which notice, the
    window's first word and length, and the share held; without notices that are part of another one there. Words are runs of digits, letters and characters beyond ASCII of the whole text, A-Z in lower
    case. Null and empty texts have no words and no matches; repeated rows and rows without id are rows of their own; an
    empty table gives no rows; further columns are ignored. Notices and phrases are a catalogue of fixed size, which
    every task gets. Words are compared by 64 bits of hash.
    """
    given = known(notices, phrases)
    kind = dict(docs.dtypes)[id_col]
    places = stored(_places(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), given.words), "places")
    counts = np.zeros(len(given.words), np.int64)
    for word, n in places.select(F.explode("word").alias("w")).groupBy("w").count().collect():
        counts[word] = n
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    sizes, labels, named = np.array([len(w) for w in given.notices]), [x for _, x, _ in notices], [x for _, x in phrases]
    spot = pa.struct([("label", pa.string()), ("first", pa.int64())])
    span = pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first", pa.int64()), ("words", pa.int64()), ("contained", pa.float64())])

    def listed(owner: np.ndarray, order: np.ndarray, columns: list[pa.Array], kind: pa.StructType, n: int) -> pa.ListArray:
        rows = pa.StructArray.from_arrays([c.take(pa.array(order)) for c in columns], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)), rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, column = batch.num_rows, batch.column("place")
            owner = np.repeat(np.arange(n), np.diff(np.asarray(column.offsets, np.int64)))
            place, word = np.asarray(column.flatten(), np.int64), np.asarray(batch.column("word").flatten(), np.int64)
            text, first, phrase = phrase_places(given.phrases, owner, place, word)
            said = listed(text, np.lexsort((phrase, first, text)), [pa.array([named[p] for p in phrase], pa.string()), pa.array(first)], spot, n)
            text, first, notice, common = contained(given, rank, share, owner, place, word)
            columns = [pa.array([labels[k] for k in notice], pa.string()), pa.array(notice, pa.int32()), pa.array(first), pa.array([2 * given.steps[k] for k in notice], pa.int64()), pa.array(common / sizes[notice], pa.float64())]
            held = listed(text, np.lexsort((notice, first, text)), columns, span, n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), said, held], ["id", "n_words", "phrases", "notices"])

    kinds = "phrases array<struct<label string, first long>>, notices array<struct<label string, notice int, first long, words long, contained double>>"
    return places.mapInArrow(work, f"id {kind}, n_words long, {kinds}").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) of what matches() found.

    labels are those of phrases and notices, distinct and sorted; score is 1 where a phrase stands, else the greatest
    share of a notice that a window holds, 0 where none does.
    """
    base = F.col("phrases.label")
    n = F.size("phrases").cast("long")
    some = F.size("phrases") > 0
    score = F.when(some, 1.0).otherwise(F.coalesce(F.array_max("notices.contained"), F.lit(0.0)))
    return found.select(
        id_col, "n_words", n.alias("n_base"), F.array_min("phrases.first").alias("first_word"), F.array_max("phrases.first").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.col("notices.label"))), ",").alias("labels"), score.alias("score"),
    )
