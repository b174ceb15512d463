"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is factored against the indexed reference, which is the whole corpus.  The index holds anchors: in
every window of w words, the leftmost least hash of its grams of g words.  An anchor depends on the window's words
alone, so two equal windows have equal anchors at equal places.  The windows of one anchor follow each other; the
words they cover are a factor.

* A factor whose anchor occurs once in the corpus is literal: none of its windows is repeated.
* A factor that occurs again as a whole is a duplicate span.
* Other factors share an anchor and differ further on.  There, at the factor boundaries, each window is compared by
  itself, with one copy of every different factor of that anchor.

The three cases cover all windows, so a word goes exactly if some window over it also starts elsewhere.  Hashes of
128 bits stand for words of a window.  Counting is by groupBy (partial sums first), so a passage found in a third of
all documents is one row for each task; what returns to a document is in proportion to its own length.

Defined cases: null or empty text has no words; fewer than w words have no window; a repeated row is a second
occurrence, so all windows of both go; each input row gives one row; null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import chunks, forget, grams, mix, saved, words

GRAM = 8
_K = np.uint64(0xD6E8FEB86659FD93)


def _run_hash(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of the n words from each start."""
    out, live, k = n.astype(np.uint64) * _K, np.arange(len(start)), 0
    while len(live):
        x = (out[live] ^ h[start[live] + k]) * _K
        out[live] = x ^ (x >> np.uint64(31))
        k += 1
        live = live[n[live] > k]
    return mix(out)


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost least value among the n from each position."""
    at, span = np.arange(len(g)), 1
    val = g
    while span < n:
        step = min(span, n - span)
        a, b = val[: len(val) - step], val[step:]
        right = b < a
        at, val = np.where(right, at[step:], at[: len(val) - step]), np.where(right, b, a)
        span += step
    return at


def _factors(h: np.ndarray, first: np.ndarray, w: int) -> tuple[np.ndarray, ...]:
    """Of each factor: row, first word in its row, number of windows, anchor and hash."""
    g = grams(h, GRAM)
    at = _least(g, w - GRAM + 1)  # one for each window
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    whole = np.arange(len(at)) + w <= first[row + 1]
    q = np.flatnonzero(whole)
    if not len(q):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = at[q]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
    n = np.diff(np.append(new, len(q)))
    start = q[new]
    return row[start], start - first[row[start]], n, g[at[new]], _run_hash(h, start, n + w - 1)


def _parse(w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            h, _, _, first = words(data, off)
            row, start, n, anchor, whole = _factors(h, first, w)
            if len(row):
                # equal factors in a row, as in a word said over and over, are one row with a count
                again = (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1]) & (n[1:] == n[:-1])
                new = np.flatnonzero(np.concatenate([[True], ~again]))
                times = np.diff(np.append(new, len(row)))
                row, start, n, anchor, whole = (x[new] for x in (row, start, n, anchor, whole))
                take = pa.array(row)
                ints = [pa.array(x.astype(np.int32)) for x in (start, n * times, times)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), rows.column("doc_id").take(take), rows.column("th").take(take), *ints], names=["anchor", "whole", "doc_id", "th", "start", "n", "times"])

    return run


def _boundary(w: int):
    """The windows of the asked-for factors: anchor, hash, place; alone: whether the factor occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            h, _, _, first = words(data, off)
            g = grams(h, GRAM)
            doc, start, n, alone = [], [], [], []
            for i, asked in enumerate(rows.column("asked").to_pylist()):
                for x in asked or ():
                    doc.append(i)
                    start.append(x["start"])
                    n.append(x["n"])
                    alone.append(x["alone"])
            if not doc:
                continue
            n = np.array(n)
            which = np.repeat(np.arange(len(n)), n)
            doc = np.array(doc)[which]
            place = np.array(start)[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            q = first[doc] + place
            out = []
            for a in range(0, len(q), 100_000):
                x = q[a : a + 100_000]
                out.append(g[x + np.lib.stride_tricks.sliding_window_view(g, w - GRAM + 1)[x].argmin(1)])
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(_run_hash(h, q, np.full(len(q), w)).view(np.int64)), rows.column("doc_id").take(take), rows.column("th").take(take), pa.array(place.astype(np.int32)), pa.array(np.array(alone)[which])], names=["anchor", "whole", "doc_id", "th", "place", "alone"])

    return run


def _cut(w: int):
    """What is left of each text; spans: (first window, windows) that go, or none for texts that stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                n_words, n_removed, kept, spans = [], [], [], []
                for text, gone in zip(rows.column("text").to_pylist(), rows.column("gone").to_pylist(), strict=True):
                    all_words = (text or "").encode().split()  # ASCII white space, as in words()
                    mark = np.zeros(len(all_words) + 1, np.int64)
                    for x in gone or ():
                        mark[x["start"]] += 1
                        mark[min(len(all_words), x["start"] + x["n"] + w - 1)] -= 1
                    off = np.cumsum(mark)[:-1] > 0
                    left = [x for x, y in zip(all_words, off.tolist(), strict=True) if not y] if off.any() else all_words
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))
                    n_words.append(len(all_words))
                    n_removed.append(len(all_words) - len(left))
                    kept.append(b" ".join(left))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"],
                )

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _cut() without the texts, for texts that stay whole."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256)
            all_words = [(x or "").encode().split() for x in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), pa.array(list(map(len, all_words)), pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in all_words])], names=["doc_id", "th", "n_words", "kept_sha256"])


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _lists(docs: DataFrame, w: int) -> tuple[DataFrame, DataFrame]:
    """Documents with shared anchors: (doc_id, th, text, sure, asked); and the windows that repeat at boundaries: (doc_id, th, gone)."""
    found = docs.mapInArrow(_parse(w), "anchor long, whole long, doc_id long, th binary, start int, n int, times int")
    index = found.groupBy("anchor").agg(F.sum("times").alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("c > 1")
    shared = saved(found.join(index.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchor"))
    factor = shared.filter("mixed").groupBy("anchor", "whole").agg(F.sum("times").alias("c"), F.min(F.struct("doc_id", "th", "start", (F.col("n") / F.col("times")).cast("int").alias("n"))).alias("one"))
    factor = saved(factor)
    again = factor.filter("c > 1").select("anchor", "whole")
    sure = shared.filter("not mixed").select("doc_id", "th", "start", "n").union(shared.filter("mixed").join(again, ["anchor", "whole"], "left_semi").select("doc_id", "th", "start", "n"))
    asked = factor.select("one.*", (F.col("c") == 1).alias("alone"))
    per_doc = sure.select("*", F.lit(None).cast("boolean").alias("alone")).union(asked).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "alone")).alias("all"))
    per_doc = per_doc.select("doc_id", "th", F.filter("all", lambda x: x["alone"].isNull()).alias("sure"), F.filter("all", lambda x: x["alone"].isNotNull()).alias("asked"))
    texts = saved(docs.join(per_doc, _same(docs, per_doc)).select(docs["doc_id"], docs["th"], "text", "sure", "asked"))
    asked = texts.filter("size(asked) > 0").dropDuplicates(["doc_id", "th"])
    windows = saved(asked.mapInArrow(_boundary(w), "anchor long, whole long, doc_id long, th binary, place int, alone boolean"))
    twice = windows.groupBy("anchor", "whole").agg(F.count("*").alias("c")).filter("c > 1").select("anchor", "whole")
    edges = windows.filter("alone").join(twice, ["anchor", "whole"], "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct(F.col("place").alias("start"), F.lit(1).alias("n"))).alias("gone"))
    edges = saved(edges)
    forget(shared, factor, windows)
    return texts, edges


def _keyed(docs: DataFrame) -> DataFrame:
    """With 128 bits that tell rows of one doc_id, or of none, apart by their texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("th"))


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start: long, end: long>>"


def _changed(texts: DataFrame, edges: DataFrame, w: int) -> DataFrame:
    pair = lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"))
    gone = F.concat(F.transform("sure", pair), F.coalesce(edges["gone"], F.array().cast("array<struct<start: int, n: int>>")))
    return texts.join(edges, _same(texts, edges), "left").select(texts["doc_id"], "text", gone.alias("gone")).mapInArrow(_cut(w), _OUT)


def repeated_substrings(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs (doc_id, text); window: at least 9 words."""
    docs = _keyed(docs)
    texts, edges = _lists(docs, window)
    whole = docs.mapInArrow(_digest, "doc_id long, th binary, n_words long, kept_sha256 string")
    keys = texts.select("doc_id", "th").distinct()
    whole = whole.join(keys, _same(whole, keys), "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.union(_changed(texts, edges, window).select(*whole.columns))


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The same with what stays of each text (kept_text) and the word spans that went (spans)."""
    docs = _keyed(docs)
    texts, edges = _lists(docs, window)
    keys = texts.select("doc_id", "th").distinct()
    none = F.array().cast("array<struct<start: int, n: int>>").alias("gone")
    whole = docs.join(keys, _same(docs, keys), "left_anti").select("doc_id", "text", none).mapInArrow(_cut(window), _OUT)
    return whole.union(_changed(texts, edges, window))
