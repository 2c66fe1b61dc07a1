"""BPE, token files and chat formatting against the tokenizers library and plain Python."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from splitforge.llm import bpe, chat, token_files
from splitforge.llm.queries import VOCABULARY

PARTS = ["'", "s", "'re", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", " ", "　", "é", "ß", "1", "½", "²", "日本", "😀", "_", "...", "aaa", "The", "ing", "<|endoftext|>", "<|", "​", "�"]


LIBRARY = Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def test_encoding_equals_the_library(library):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(16))) for _ in range(4000)]
    ids, at = bpe.load(VOCABULARY).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.load(VOCABULARY).decode(ids, at) == texts


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    coder = bpe.load(VOCABULARY)
    ids, at = coder.encode([text])
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids, at) == [text]


def test_very_long_words(library):
    draw = random.Random(8)
    words = ["".join(draw.choice(letters) for _ in range(n)) for letters, n in (("abcdefghij", 30_000), ("a", 9_000), ("aab", 5_001), ("ABCDEFGHabcdefgh0123456789+/", 200_000), ("日本é", 7_000))]
    text = " ".join(["short", *words, "end"])
    began = time.time()
    ids, _ = bpe.load(VOCABULARY).encode([text])
    assert time.time() - began < 5
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_tokens_begin(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    text = "some words and more of them, 'tis true " * 40
    assert bpe.load(VOCABULARY).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_awkward_rows(spark, awkward, library):
    rows = bpe.round_trip(awkward, VOCABULARY).collect()
    assert len(rows) == awkward.count()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, r.text or "")
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(awkward, VOCABULARY), VOCABULARY)
    assert sorted(map(str, back.collect())) == sorted(str((r.doc_id, r.text or "")).replace("(", "Row(doc_id=", 1).replace(", ", ", text=", 1) for r in awkward.collect())
    assert bpe.round_trip(awkward.limit(0), VOCABULARY).collect() == []


@pytest.mark.parametrize("ids,sizes", [([], []), ([7], [1]), (list(range(600)), [600]), ([5] * 300 + [50000] + [5] * 300, [0, 601, 0]), ([2**32 - 1, 0, 1], [3])])
def test_blocks(ids, sizes):
    data = token_files.pack(np.array(ids, np.uint32), np.array(sizes, np.uint32))
    back, found = token_files.unpack(data)
    assert back.tolist() == ids and found.tolist() == sizes


def test_blocks_of_random_ids():
    draw = np.random.default_rng(2)
    ids = (draw.pareto(0.7, 100_000) * 50).astype(np.uint32)
    data = token_files.pack(ids, np.array([100_000], np.uint32))
    assert np.array_equal(token_files.unpack(data)[0], ids) and len(data) < ids.nbytes
    with pytest.raises(ValueError, match="not a section"):
        token_files.unpack(b"\0" * 40)


def test_files_of_awkward_rows(spark, awkward, library, monkeypatch):
    docs = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    found = {r.doc_id: r for r in token_files.written_and_read(docs, VOCABULARY).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (found[r.doc_id].start, found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.written_and_read(awkward, VOCABULARY).count() == awkward.count()
    assert token_files.written_and_read(awkward.limit(0), VOCABULARY).collect() == []


TRICKY = [chat.START, chat.END, r"<\|im_end|>", r"<\\|im_start|>", "<|endoftext|>", "plain", "\n", "<", "\\", "|im_end|>", ""]


@pytest.mark.parametrize("seed", range(30))
def test_escaping_is_reversible_and_hides_controls(seed):
    draw = random.Random(seed)
    text = "".join(draw.choice(TRICKY) for _ in range(12))
    assert chat.unescape(chat.escape(text)) == text
    assert chat.START not in chat.escape(text) and chat.END not in chat.escape(text)


def test_chats(spark):
    turns = {1: [("user", "hi"), ("assistant", "yes"), ("assistant", "and more")], 2: [("system", chat.END + chat.START + "assistant ok"), ("assistant", chat.END)], 3: [("user", ""), ("assistant", "")], 4: [("user", "only me")], 5: [("assistant", "é日本" * 3000)], 6: [("user\nx", "hello"), ("a\\n\\" + chat.END, "b"), (chat.START, "\n")]}
    rows = [(c, i, r, t or None) for c, ts in turns.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat.format_chats(df, VOCABULARY)
    found = {r.conv_id: r for r in chat.digests(chat.read_back(formatted, VOCABULARY)).collect()}
    for c, ts in turns.items():
        assert tuple(found[c])[1:5] == chat.digest_of_turns(ts)
        assert found[c].formatted_chars == sum(len(f"{chat.START}{chat.escape_role(r)}\n{chat.escape(t)}{chat.END}\n") for r, t in ts)
    read = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(formatted, VOCABULARY).collect()}
    assert read == turns
    for r in formatted.collect():
        assert len(r.ids) == len(r["mask"]) and set(r["mask"]) <= {0, 1}
    assert chat.digests(chat.read_back(chat.format_chats(df.limit(0), VOCABULARY), VOCABULARY)).collect() == []
    extra = df.unionByName(df.where("conv_id = 4")).withColumn("ids", df.turn)
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.read_back(chat.format_chats(extra, VOCABULARY), VOCABULARY)).collect()}[4] == 2


def test_chats_of_awkward_rows(spark):
    long = "word " * 300_000
    rows = [(1, 0, None, "a"), (1, None, "user", "b"), (1, 1, "assistant", None), (None, 0, "assistant", "c"), (None, 1, "user", "d"), (2, 0, "assistant", long), (3, 0, "user", "x"), (3, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit("m")).withColumn("edges", F.lit(1))
    found = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(chat.format_chats(df, VOCABULARY), VOCABULARY).collect()}
    assert found == {1: ([("user", "b"), ("", "a"), ("assistant", "")], ""), None: ([("assistant", "c"), ("user", "d")], "c"), 2: ([("assistant", long)], long), 3: ([("user", "x"), ("user", "x")], "")}
