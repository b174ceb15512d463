"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role\\ntext<|im_end|>\\n`.  Inside roles and texts every `<|`, and every `<\\|` that
escaping may have made, gets one more backslash after the `<`; unescaping takes one away.  So no text can hold a
control string, and every text comes back as it was.  Line breaks in roles are written as `\\n`, backslashes doubled.

For each Arrow batch the headers, contents and ends lie in separate buffers; segment lengths give cumulative offsets,
these give scatter indices, and all bytes are copied into one preallocated buffer in numpy.  The loss mask is spans of
bytes: the texts of assistant turns.

A conversation is formatted in blocks of `block` turns, each by itself, so a conversation with a third of all rows is
spread over many tasks.  read_back() parses the formatted bytes again, a block at a time in order, in bounded memory.

Defined cases: null text is empty, null role is empty; turns are ordered by turn (null first), then role, then text,
so repeated turns are kept each; null conv_id is a conversation; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import as_bytes

START, END = b"<|im_start|>", b"<|im_end|>\n"
ASSISTANT = "assistant"
FORMATTED = "conv_id long, block long, part int, data binary, loss array<struct<start: int, end: int>>"
PIECE = 4 << 20


def escaped(col: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(col, r"<(\\*)\|", r"<\\\1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(col: pa.Array) -> pa.Array:
    return escaped(pc.replace_substring(pc.replace_substring(col, "\\", "\\\\"), "\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns in one buffer, each turn's end, and each text's start."""
    (role, role_at), (text, text_at) = as_bytes(escaped_role(roles)), as_bytes(escaped(texts))
    n, role_n, text_n = len(role_at) - 1, np.diff(role_at), np.diff(text_at)
    total = role_n + text_n + len(START) + 1 + len(END)
    end = np.cumsum(total)
    begin = end - total
    text_from = begin + len(START) + role_n + 1
    out = np.empty(int(end[-1]) if n else 0, np.uint8)

    def scatter(to: np.ndarray, source: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Copy the rows of one buffer to their places: row i, from at[i], to to[i]."""
        out[np.repeat(to - at, size) + np.arange(len(source))] = source

    for fixed, to in ((START, begin), (b"\n", text_from - 1), (END, end - len(END))):
        out[to[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    scatter(begin + len(START), role, role_at[:-1], role_n)
    scatter(text_from, text, text_at[:-1], text_n)
    return out, end, text_from


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to parts: turns of one block that lie in one piece of a batch."""
    last, part = None, 0
    for batch in batches:
        roles = batch.column("role").cast(pa.large_string()).fill_null("")
        texts = batch.column("text").cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 64)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PIECE, "right")))
            r, t = roles.slice(i, j - i), texts.slice(i, j - i)
            data, end, text_from = assemble(r, t)
            loss = np.asarray(pc.equal(r, ASSISTANT))
            keys = list(zip(batch.column("conv_id").slice(i, j - i).to_pylist(), batch.column("block").slice(i, j - i).to_pylist(), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            cols: list[list] = [[], [], [], [], []]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = part + 1 if keys[a] == last else 0
                last = keys[a]
                zero = int(end[a - 1]) if a else 0
                spans = [{"start": int(text_from[k]) - zero, "end": int(end[k]) - len(END) - zero} for k in range(a, b) if loss[k]]
                for c, x in zip(cols, (*keys[a], part, data[zero : int(end[b - 1])].tobytes(), spans), strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "block", "part", "data", "loss"])
            i = j


def format_chats(turns: DataFrame, block: int = 64) -> DataFrame:
    """(conv_id, block, part, data, loss): a conversation is its data in order of block and part."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    t = t.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return t.select("conv_id", "block", "role", "text").mapInArrow(_format, FORMATTED)


def parse(data: bytes) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn."""
    for turn in data.split(START)[1:]:
        role, _, text = turn.removesuffix(END).decode().partition("\n")
        yield unescaped_role(role), unescaped(text)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its parts in order; only digests and counts are kept."""
    none = object()
    conv, n, loss_n, chars, turns, loss = none, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([loss_n], pa.int64()), pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    done: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(batch.num_rows):
            x = batch.slice(i, 1).to_pylist()[0]
            if conv is none or x["conv_id"] != conv:
                if conv is not none:
                    done.append(row())
                conv, n, loss_n, chars, turns, loss = x["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            data = x["data"]
            chars += len(data.decode())
            for role, text in parse(data):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for span in x["loss"]:
                text = unescaped(data[span["start"] : span["end"]].decode())
                loss.update(text.encode())
                loss_n += len(text)
            if len(done) >= 1000:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
    if conv is not none:
        done.append(row())
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from the formatted bytes and the loss spans alone."""
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return parts.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
