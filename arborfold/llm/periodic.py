"""Periodic runs of words, by the runs theorem.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends.  By the theorem
each run has a Lyndon root, under one of the two orders of the alphabet, that is the longest Lyndon word at its first
word.  The longest Lyndon word at i ends before the next smaller suffix, which is the next smaller value of the inverse
suffix array; so two suffix arrays, one for each order, name all candidates (i, period).  A candidate is extended to
the right by the longest common extension of i and i + period (the least LCP value between their places in the suffix
array, from a sparse table), and to the left by that of the reversed words.

Words are any alphabet with an order, so they are compared by a 64-bit hash.  Many texts are worked on at once, in
numpy: a text's words rank apart from all others', and each text ends with a sign below its words.  Suffixes are sorted
by prefix doubling; a round sorts again only what still ties, so plain texts end after a few rounds.

Runs of at least `least` words and `times` periods (4 or more) are kept.  A root whose run has that length has its first
occurrence within the run's first period, so its extension to the right covers at least (times - 2) periods + 1 more
words: candidates below that need no extension to the left, and only the texts with others are reversed.

`collapsed` drops from each run all words after its first period.

Defined cases: null and empty texts and texts without words have no runs; each repeated row is returned; null doc_id is
kept; of runs that overlap or nest each is found; empty tables give empty results; other columns are ignored.  Texts are
whole: a text is one row of its task, with some 50 + 8 log2(words) bytes of memory for each of its words; plain texts
go 1 MB at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import chunks, words

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.large_string())])


class Suffixes:
    """The suffixes of ranked words: sa, isa, and the ranks of the rounds.  Each text ends with a rank that no other place has."""

    def __init__(self, ranks: np.ndarray) -> None:
        n = len(ranks)
        sa = np.argsort(ranks, kind="stable")
        sorted_ranks = ranks[sa]
        head = np.ones(n, bool)
        head[1:] = sorted_ranks[1:] != sorted_ranks[:-1]
        isa = np.empty(n, np.int64)
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        isa[sa] = first  # a group's rank is the place of its first
        self.rounds, k = [isa.astype(np.int32)], 1
        size = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))  # places in sa
        while len(tied):
            # places are in order of their group, so this keeps groups together
            at = sa[tied]
            key = isa[at] * (n + 1) + isa[at + k]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            sa[tied] = at
            head = np.ones(len(at), bool)
            head[1:] = key[1:] != key[:-1]
            isa[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
            self.rounds.append(isa.astype(np.int32))
            k *= 2
            size = np.diff(np.append(np.flatnonzero(head), len(at)))
            tied = tied[np.repeat(size > 1, size)]
        self.sa, self.isa = sa, isa

    def lcp(self) -> np.ndarray:
        """Common words of each place of sa and the one before."""
        a, b = self.sa[1:], self.sa[:-1]
        out = np.zeros(len(self.sa), np.int32)
        live = np.flatnonzero(self.rounds[0][a] == self.rounds[0][b])
        a, b, same = a[live], b[live], np.zeros(len(live), np.int64)
        for k in range(len(self.rounds) - 1, -1, -1):
            r = self.rounds[k]
            same += (r[a + same] == r[b + same]).astype(np.int64) << k
        out[live + 1] = same
        return out


class Minima:
    """A sparse table of range minima."""

    def __init__(self, a: np.ndarray) -> None:
        self.levels = [a]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            a, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(a[:-half], a[half:]))
        return self.levels[k]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of [lo, hi), which is not empty."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for j in np.unique(k):
            x = np.flatnonzero(k == j)
            a = self.level(int(j))
            out[x] = np.minimum(a[lo[x]], a[hi[x] - (1 << int(j))])
        return out


def next_smaller(a: np.ndarray) -> np.ndarray:
    """For each place the first later one with a smaller value; its own last place's successor where there is none."""
    n = len(a)
    table, out = Minima(a), np.arange(1, n + 1)
    live, k = np.arange(n), 0
    ends = []
    while len(live):  # up: steps that double, while all in the step is larger
        level = table.level(k) if (1 << k) <= n else np.zeros(0, a.dtype)
        at = out[live]
        fits = at < len(level)
        larger = np.zeros(len(live), bool)
        larger[fits] = level[at[fits]] > a[live[fits]]
        ends.append(live[~larger])
        out[live[larger]] += 1 << k
        live, k = live[larger], k + 1
    live = np.zeros(0, np.int64)
    for k in range(len(ends) - 1, 0, -1):  # down again, for those that stopped at a larger step
        live = np.concatenate([live, ends[k]])
        level = table.level(k - 1) if (1 << (k - 1)) <= n else np.zeros(0, a.dtype)
        at = out[live]
        fits = at < len(level)
        larger = np.zeros(len(live), bool)
        larger[fits] = level[at[fits]] > a[live[fits]]
        out[live[larger]] += 1 << (k - 1)
    return out


class Extension:
    """Longest common extensions to the right."""

    def __init__(self, suffixes: Suffixes) -> None:
        self.isa, self.minima = suffixes.isa, Minima(suffixes.lcp())

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of different places i and j."""
        a, b = self.isa[i], self.isa[j]
        return self.minima.of(np.minimum(a, b) + 1, np.maximum(a, b) + 1).astype(np.int64)


def _ranked(h: np.ndarray, first: np.ndarray, down: bool = False) -> np.ndarray:
    """Ranks of texts' words, each text with an end of its own: text by text, the end below the words."""
    _, rank = np.unique(h, return_inverse=True)
    top = len(h) + 1
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.arange(len(n)).repeat(n + 1) * (top + 1)
    out[np.arange(len(h)) + doc] += np.where(down, top - rank, rank + 1)
    return out


def find_runs(h: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of texts with word hashes h, text i in h[first[i] : first[i + 1]]."""
    if times < 4 or not len(h):
        if times < 4:
            raise ValueError("runs of fewer than four periods are not looked for")
        return (np.zeros(0, np.int64),) * 4
    at, period = [], []
    for down in (False, True):
        s = Suffixes(_ranked(h, first, down))
        p = next_smaller(s.isa) - np.arange(len(s.isa))
        # a text's end has a place too; words are compared first, which leaves few candidates
        i = np.arange(len(p) - 1)
        i = i[s.rounds[0][i] == s.rounds[0][np.minimum(i + p[:-1], len(p) - 1)]]
        i = i[i + p[i] < len(p)]
        if len(i):
            right = Extension(s)(i, i + p[i])
            i = i[right >= np.maximum((times - 2) * p[i] + 1, least - 2 * p[i] + 1)]
        at.append(i)
        period.append(p[i])
    at, period = np.concatenate(at), np.concatenate(period)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    n = np.diff(first)
    begin = first[:-1] + np.arange(len(n))  # places with the ends
    text = np.searchsorted(begin, at, "right") - 1
    # only the texts with candidates, in both directions
    kept, slot = np.unique(text, return_inverse=True)
    size = n[kept]
    own_first = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(first[kept] - own_first[:-1], size) + np.arange(own_first[-1])
    base = own_first[:-1] + np.arange(len(kept))
    i = at - begin[text]
    forth = Extension(Suffixes(_ranked(h[own], own_first)))
    back = np.repeat(own_first[:-1] + own_first[1:] - 1, size) - np.arange(own_first[-1])
    backward = Extension(Suffixes(_ranked(h[own][back], own_first)))
    right = forth(base[slot] + i, base[slot] + i + period)
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    mirror = base[slot] + size[slot] - 1
    left[inner] = backward(mirror[inner] - i[inner] + 1, mirror[inner] - i[inner] - period[inner] + 1)
    start, length = i - left, period + left + right
    good = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([text[good], start[good], period[good], length[good]]), axis=1)
    return found[0], found[1], found[3], found[2]


def _collapsed(own: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(own)
    keep = np.ones(len(own), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(own[k] for k in np.flatnonzero(keep))


def _detect(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            h, _, _, first = words(data, off)
            text, *found = find_runs(h, first, least, times)
            bounds = np.searchsorted(text, np.arange(rows.num_rows + 1))
            found = list(zip(*(x.tolist() for x in found), strict=True))
            runs = [found[bounds[k] : bounds[k + 1]] for k in range(rows.num_rows)]
            texts = [_collapsed(data[off[k] : off[k + 1]].tobytes().split(), runs[k]) for k in range(rows.num_rows)]
            named = [[{"start": a, "length": b, "period": c} for a, b, c in x] for x in runs]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(named, _OUT.field("runs").type), pa.array(texts, pa.large_binary()).cast(pa.large_string())], schema=_OUT)

    return run


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed) of docs (doc_id, text); runs by start, then period, as (start, length, period) in words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(_detect(least, times), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
