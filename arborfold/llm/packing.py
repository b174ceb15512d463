"""Token ids in rows of fixed length: best-fit-decreasing packing with segment-tree capacity search.

Documents are encoded whole and end with `eos`.  Those longer than a row are split into full rows and a rest, without
loss.  Of each stretch of documents (at most `stretch` tokens, all within one task: no exchange), segments go in
order of falling length to the fullest row that still takes them; a segment tree over the remaining capacities
finds it in log(row length) steps.

A row holds ids (little-endian, 2 or 4 bytes each, padded with `pad`), cu_seqlens (0 and the end of each segment) and
resets (where positions start at 0 again: each segment's start); doc_ids and doc_offsets tell where each segment
comes from, so that unpack() gives every document back.

Defined cases: null or empty text is `eos` alone; repeated rows are packed each; null doc_id is kept; an empty table
gives no rows; a long text is one piece of its task's work, with some 10 bytes of memory for each of its own; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import chunks
from arborfold.llm.tokens import PIECE_BYTES, Encoder, default_path, pieces

#: Pieces of text whose ids are Python numbers at the same time.
AT_ONCE = 64
SCHEMA = "ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_offsets array<long>, doc_lengths array<long>"


class Capacities:
    """How many open rows have each remaining capacity: a segment tree with the number of rows below each node."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def least_from(self, need: int) -> int:
        """The least capacity >= need that some row has, or -1."""
        i = need + self.leaves
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:  # the sibling to the right has some
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Rows as lists of segment numbers."""
    free, open_rows, rows = Capacities(row), defaultdict(list), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        at = free.least_from(n)
        if at < 0:
            r, at = len(rows), row
            rows.append([])
        else:
            r = open_rows[at].pop()
            free.add(at, -1)
        rows[r].append(k)
        if at > n:
            open_rows[at - n].append(r)
            free.add(at - n, 1)
    return rows


def _pack(path: str, row: int, eos: int | None, pad: int, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, plain_specials=True)
        end = encoder.vocab - 1 if eos is None else eos
        kind = np.dtype("<u2" if max(encoder.vocab - 1, end, pad) < 1 << 16 else "<u4")
        width = kind.itemsize
        last = np.array([end], kind).tobytes()
        filler = np.full(row, pad, kind).tobytes()
        segments: list[tuple[bytes, int | None, int, int]] = []  # ids, document, offset, tokens of the document
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            rows = best_fit([len(s[0]) // width for s in segments], row)
            for i in range(0, len(rows), 1000):
                cols: list[list] = [[] for _ in range(7)]
                for members in rows[i : i + 1000]:
                    own = [segments[k] for k in members]
                    ids = b"".join(s[0] for s in own)
                    ends = np.cumsum([0, *(len(s[0]) // width for s in own)]).tolist()
                    for c, x in zip(cols, (ids + filler[len(ids) :], ends[-1], ends, ends[:-1], [s[1] for s in own], [s[2] for s in own], [s[3] for s in own]), strict=True):
                        c.append(x)
                kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["ids", "n_tokens", "cu_seqlens", "resets", "doc_ids", "doc_offsets", "doc_lengths"])

        for rows, data, off in chunks(batches, size=1 << 18):
            parts, owner = pieces(data, off, encoder.cuts, PIECE_BYTES)
            ids: list[list[bytes]] = [[] for _ in range(rows.num_rows)]
            for k in range(0, len(parts), AT_ONCE):
                for i, part in zip(owner[k : k + AT_ONCE].tolist(), encoder.ids(parts[k : k + AT_ONCE]), strict=True):
                    ids[i].append(np.array(part, kind).tobytes())
            for doc_id, own in zip(rows.column("doc_id").to_pylist(), ids, strict=True):
                whole = b"".join([*own, last])
                n = len(whole) // width
                segments += ((whole[i * width : (i + row) * width], doc_id, i, n) for i in range(0, n, row))
                size += n
                if size >= stretch:
                    yield from packed()
                    segments, size = [], 0
        if segments:
            yield from packed()

    return run


def pack_tokens(docs: DataFrame, tokenizer: str | None = None, row: int = 2048, eos: int | None = None, pad: int = 0, stretch: int = 2_000_000) -> DataFrame:
    """Packed rows of docs (doc_id, text).  eos: by default the vocabulary's last id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_pack(tokenizer or default_path("byte_bpe_50k.tiktoken"), row, eos, pad, stretch), SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """As Parquet: a row of ids is one binary value, so a reader maps a column chunk to an id matrix."""
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame, row: int = 2048) -> DataFrame:
    """(doc_id, doc_offset, doc_length, ids) of each segment."""
    width = F.length("ids") / row
    seg = F.arrays_zip("doc_ids", "doc_offsets", "doc_lengths", "resets", F.slice("cu_seqlens", F.lit(2), F.size("resets")).alias("ends"))
    out = packed.select("ids", width.cast("int").alias("w"), F.explode(seg).alias("s"))
    return out.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_offsets").alias("doc_offset"), F.col("s.doc_lengths").alias("doc_length"), F.substring("ids", F.col("s.resets") * F.col("w") + 1, (F.col("s.ends") - F.col("s.resets")) * F.col("w")).alias("ids"))
