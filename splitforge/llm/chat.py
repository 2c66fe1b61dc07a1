"""Chat formatting at the level of token ids.

Each turn's role and text are encoded by themselves, so no token spans a boundary; reserved ids above the
vocabulary are spliced in for the marks; the loss mask is the prefix sum of +1 and -1 at the borders of the texts of
the chosen role. The text form of the template is `<|im_start|>ROLE\\nTEXT<|im_end|>\\n` for each turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.llm import bpe

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)(\|im_(?:start|end)\|>)")
_ESCAPED = re.compile(r"<\\(\\*)(\|im_(?:start|end)\|>)")


def escape(text: str) -> str:
    """A control string, with any backslashes after its first character, gets one backslash more."""
    return _CONTROL.sub(r"<\\\1\2", text) if "|im_" in text else text


def unescape(text: str) -> str:
    """The reverse of escape()."""
    return _ESCAPED.sub(r"<\1\2", text) if "|im_" in text else text


def escape_role(role: str) -> str:
    """A role on one line: backslashes are doubled and line breaks become \\n, then control strings are escaped."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    """The reverse of escape_role()."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def encode_turns(df: DataFrame, vocabulary: str, loss_role: str = "assistant") -> DataFrame:
    """One row a turn: (conv_id, turn, ids, edges).

    ids: START role newline text END newline; edges: +1 where a text under the loss begins and -1 after its end, 0
    elsewhere. Texts and roles are escaped first and null counts as empty.
    """
    name = bpe.share(df, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load_shared(name)
        start, end = coder.size, coder.size + 1
        newline = coder.encode(["\n"])[0]
        for batch in batches:
            for part, texts in bpe.texts_of(batch, "text"):
                roles = part.column(2).to_pylist()
                head, head_at = coder.encode([escape_role(r or "") for r in roles], special=False)
                body, body_at = coder.encode([escape(t or "") for t in texts], special=False)
                ids, edges, sizes = [], [], []
                for i, role in enumerate(roles):
                    h, b = head[head_at[i] : head_at[i + 1]], body[body_at[i] : body_at[i + 1]]
                    row = np.concatenate([[start], h, newline, b, [end], newline])
                    edge = np.zeros(len(row), np.int8)
                    if role == loss_role:
                        first = 1 + len(h) + len(newline)
                        edge[first] += 1
                        edge[first + len(b)] -= 1
                    ids.append(row)
                    edges.append(edge)
                    sizes.append(len(row))
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat_ids, flat_edges = pa.array(np.concatenate(ids).astype(np.int32)), pa.array(np.concatenate(edges).astype(np.int8))
                yield pa.record_batch([part.column(0), part.column(1), pa.ListArray.from_arrays(at, flat_ids), pa.ListArray.from_arrays(at, flat_edges)], names=["conv_id", "turn", "ids", "edges"])

    kinds = dict(df.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, edges array<tinyint>"
    return df.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def assemble(turns: DataFrame) -> DataFrame:
    """One row a conversation: (conv_id, ids, edges), its turns in ascending order; equal turns are ordered by ids.

    A conversation is one sample, so its turns meet in one row; the shuffle is by conversation.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "ids", "edges")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    return rows.select("conv_id", F.flatten("turns.ids").alias("ids"), F.flatten("turns.edges").alias("edges"))


def format_chats(df: DataFrame, vocabulary: str, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, ids array<int>, mask array<tinyint>) of each conversation of (conv_id, turn, role, text) rows.

    Null texts and roles count as empty, null turns come first, repeated rows are turns of their own, further columns
    are ignored, an empty table gives no rows. mask is 1 on exactly the ids of texts of loss_role.
    """
    rows = assemble(encode_turns(df, vocabulary, loss_role))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = batch.column(2)
            # Every conversation's edges sum to 0, so one prefix sum serves the whole batch.
            mask = np.cumsum(np.asarray(edges.values, np.int64)[edges.offsets[0].as_py() : edges.offsets[-1].as_py()]).astype(np.int8)
            at = np.asarray(edges.offsets)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(mask))], names=["conv_id", "ids", "mask"])

    kind = dict(df.dtypes)["conv_id"]
    return rows.mapInArrow(work, f"conv_id {kind}, ids array<int>, mask array<tinyint>")


def read_back(df: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted) of formatted conversations.

    Turns come from the reserved ids, loss_text from the ids under the mask (each text by itself, unescaped),
    formatted is the text form with its marks.
    """
    name = bpe.share(df, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load_shared(name)
        start, end = coder.size, coder.size + 1

        def texts(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[str]:
            at = np.stack([begins, ends], axis=1).ravel()
            return coder.decode(ids[begins[0] : ends[-1]], at - begins[0])[::2] if len(at) else []

        for batch in batches:
            turns, loss, formatted = [], [], []
            for row in range(batch.num_rows):
                ids, mask = np.asarray(batch.column(1)[row].values, np.int64), np.asarray(batch.column(2)[row].values, np.int8)
                begins, ends = np.flatnonzero(ids == start), np.flatnonzero(ids == end)
                if len(begins) != len(ends):
                    raise ValueError("a turn has no end")
                plain = np.where(ids >= start, 0, ids)
                inner = texts(plain, begins + 1, ends)
                split = [t.partition("\n")[::2] for t in inner]
                turns.append([{"role": unescape_role(r), "text": unescape(t)} for r, t in split])
                formatted.append("".join(f"{START}{t}{END}\n" for t in inner))
                step = np.diff(np.concatenate([[0], mask, [0]]))
                loss.append("".join(unescape(t) for t in texts(plain, np.flatnonzero(step == 1), np.flatnonzero(step == -1))))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.record_batch([batch.column(0), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array(formatted, pa.string())], names=["conv_id", "turns", "loss_text", "formatted"])

    kind = dict(df.dtypes)["conv_id"]
    return df.mapInArrow(work, f"conv_id {kind}, turns array<struct<role string, text string>>, loss_text string, formatted string")


def digests(df: DataFrame) -> DataFrame:
    """The columns of the op1 query from read_back() rows."""
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digest_of_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[int, str, int, str]:
    """What digests() gives for a conversation, computed plainly; for tests."""
    loss = "".join(t for r, t in turns if r == loss_role)
    lines = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
