"""Exact top-k by inner product: columnar branch-and-bound.

Candidates lie in blocks of `block` vectors, stored dimension by dimension (vertical layout), with the norm of what
remains after each step of `step` dimensions.  A query adds up products over one step at a time for all candidates
still alive.  By Cauchy-Schwarz the rest of a score is at most the product of the remaining norms, either way; a
candidate whose upper bound is under the k-th best lower bound goes, and the survivors are compacted.

Queries and candidates meet block by block (a stated query set against all rows); each pair of blocks gives at most
k rows for a query, and the best k of those are the result.  Scores are integers; ties go to the smaller vec_id.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, as queries or as
candidates; rows with null vec_id neither; rows with the same vec_id, equal or not, take part each, as queries and as
candidates of each other; shorter vectors are padded with zeros; components end at the bounds of 64 bits, and scores
beyond them wrap; queries without candidates give no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborfold.llm._shared import saved


def prune_top(query: np.ndarray, cols: np.ndarray, tails: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the best k columns: cols is dimensions x candidates, others the columns to search, tails the norm of the dimensions from each step on."""
    alive = others
    score = np.zeros(len(alive), cols.dtype)
    exact = cols.dtype == np.float64
    for s, d in enumerate(range(0, len(query), step)):
        score = score + query[d : d + step] @ cols[d : d + step, alive]
        left = query[d + step :].astype(np.float64)
        if not exact or len(alive) <= k or not len(left):
            continue
        bound = np.sqrt(left @ left) * tails[s + 1, alive] * (1 + 1e-9) + 1e-6
        floor = np.partition(score - bound, len(alive) - k)[len(alive) - k]
        keep = score + bound >= floor
        if not keep.all():
            alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[order]], score[order]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """One row for each vector, shorter ones padded with zeros."""
    off, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    n = np.diff(off)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.repeat(np.arange(len(n)), n), np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], n)] = flat[off[0] : off[-1]]
    return out


def _search(k: int, step: int):
    """Rows (block, side, ids, keys, vectors) sorted by block and side: candidates (0) come before the queries (1) sent to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            for x in range(batch.num_rows):
                one = {c: batch.column(c)[x] for c in ("block", "side", "ids", "keys", "vectors")}
                ids, keys = (one[c].values.to_numpy() for c in ("ids", "keys"))
                rows = _matrix(one["vectors"].values)
                dims = rows.shape[1]
                if one["side"].as_py() == 0:
                    cols = np.ascontiguousarray(rows.T)
                    squares = np.cumsum((cols * cols)[::-1], axis=0)[::-1]
                    tails = np.sqrt(np.vstack([squares[::step], np.zeros((1, len(ids)))]))
                    block, held = one["block"].as_py(), (ids, keys, cols, tails)
                    continue
                if block != one["block"].as_py():
                    continue
                c_ids, c_keys, cols, tails = held
                width = max(dims, len(cols))
                if dims < width:
                    rows = np.pad(rows, ((0, 0), (0, width - dims)))
                if len(cols) < width:
                    cols = np.pad(cols, ((0, width - len(cols)), (0, 0)))
                    tails = np.vstack([tails, np.zeros((-(-width // step) + 1 - len(tails), len(c_ids)))])
                if np.abs(rows).max(initial=0) * np.abs(cols).max(initial=0) * max(width, 1) >= 2.0**52:  # beyond what doubles add exactly
                    rows, cols = rows.astype(np.int64), cols.astype(np.int64)
                out: list[list] = [[], [], [], []]
                for q, own, v in zip(ids.tolist(), keys.tolist(), rows, strict=True):
                    best, score = prune_top(v, cols, tails, c_ids, np.flatnonzero((c_ids != q) | (c_keys != own)), k, step)
                    for c, y in zip(out, ([q] * len(best), [own] * len(best), best.tolist(), score.astype(np.int64).tolist()), strict=True):
                        c += y
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "own", "vec_id", "score"])

    return run


def top_inner_products(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, block: int = 4096, queries: int = 256, step: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row that is_query selects."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null and e is not null")
    v = v.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = v.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("e"))
    # equal rows are counted, so each has a key of its own that a lost task finds again
    v = v.groupBy("vec_id", "e").agg(F.count("*").alias("times")).select("vec_id", "e", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    v = saved(v.select("vec_id", F.xxhash64("e", "copy").alias("key"), "e"))
    n = max(1, v.count())
    blocks, groups = -(-n // block), max(1, -(-v.filter(is_query).count() // queries))

    def packed(rows: DataFrame, key, count: int) -> DataFrame:
        dealt = rows.withColumn("g", F.pmod(F.xxhash64("vec_id", "key"), F.lit(count).cast("long")))
        return dealt.groupBy("g").agg(F.collect_list(F.struct("vec_id", "key", "e")).alias("m")).select(key.alias("block"), "m")

    cand = packed(v, F.col("g"), blocks).select("block", F.lit(0).alias("side"), "m")
    query = packed(v.filter(is_query), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), groups).select("block", F.lit(1).alias("side"), "m")
    both = cand.union(query).select("block", "side", F.col("m.vec_id").alias("ids"), F.col("m.key").alias("keys"), F.col("m.e").alias("vectors"))
    found = both.repartition(blocks, "block").sortWithinPartitions("block", "side").mapInArrow(_search(k, step), "query_id long, own long, vec_id long, score long")
    w = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
