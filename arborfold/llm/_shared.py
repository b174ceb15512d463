"""What the operators of this subpackage share: scratch tables, batches of text, word hashes, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEFT: set[tuple[SparkSession, str]] = set()


# ---- scratch tables -------------------------------------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all tasks run here, as in tests."""
    sc = spark.sparkContext
    if here := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return here.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arborfold-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write df as a table to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LEFT.add((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that no pending plan reads."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            _delete(t.sparkSession, path)
            _LEFT.discard((t.sparkSession, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in list(_LEFT):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


# ---- rows by keys -----------------------------------------------------------------------------------------

#: Bits of a key filter: what is broadcast is at most this, 16 MB, whatever the number of keys.
FILTER_BITS = 1 << 27
_PAGE = 1 << 15


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame) -> DataFrame:
    """(page, words): one bit for the hash of each value of the only column of keys, in pages of 32,768 bits."""
    at = keys.select(_place(F.col(keys.columns[0])).alias("at"))
    pages = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(_PAGE - 1)).alias("bits"))
    word = lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return pages.select("page", F.transform(F.sequence(F.lit(0), F.lit(_PAGE // 64 - 1)), word).alias("words"))


def perhaps(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows (one struct column `name`) with _key and _in: false only if no key is equal."""
    rows = rows.withColumn("_key", key).withColumn("_at", _place(F.col("_key")))
    pages = F.broadcast(key_filter(keys))
    bit = F.col("_at").bitwiseAND(_PAGE - 1)
    # a page's byte i holds bits 8 i to 8 i + 7; words are big-endian
    bit_at = ((7 - F.shiftright(bit, 3).bitwiseAND(7)) * 8 + bit.bitwiseAND(7)).cast("int")
    found = F.getbit(F.element_at("words", F.shiftright(bit, 6).cast("int") + 1), bit_at) == 1
    out = rows.join(pages, F.shiftright("_at", 15) == F.col("page"), "left")
    return out.select(name, "_key", (F.coalesce(found, F.lit(False)) & F.col("_key").isNotNull()).alias("_in"))


def _marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    return perhaps(df.select(F.struct(F.col("*")).alias("_row"), key.alias("_k")), F.col("_k"), keys, "_row")


def joined(df: DataFrame, key: Column, table: DataFrame, once: bool = False) -> DataFrame:
    """(_row, the other columns of table) for the rows of df whose key is in table's first column; once: one row of df for each of table."""
    first, *others = table.columns
    other = table.select(F.col(first).alias("_other"), *others).hint("merge")
    out = _marked(df, key, table.select(first)).filter("_in").join(other, F.col("_key") == F.col("_other"))
    # rows of a key are together already: no exchange
    return (out.dropDuplicates(["_other", *others]) if once else out).select("_row", *others)


def having(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is among those of keys (a table of one column).

    A filter of fixed size leaves out nearly all the others before the rest is joined by an exchange: one way for any
    number of keys, exact, with nothing broadcast that grows.  Null keys match nothing.
    """
    other = keys.select(F.col(keys.columns[0]).alias("_other")).hint("merge")
    return _marked(df, key, keys).filter("_in").join(other, F.col("_key") == F.col("_other"), "left_semi").select("_row.*")


def without(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The other rows of df; see having().  Rows that the filter leaves out are not exchanged."""
    other = keys.select(F.col(keys.columns[0]).alias("_other")).hint("merge")
    marked = _marked(df, key, keys)
    rest = marked.filter("_in").join(other, F.col("_key") == F.col("_other"), "left_anti")
    return marked.filter(~F.col("_in")).select("_row.*").union(rest.select("_row.*"))


# ---- text in Arrow batches ------------------------------------------------------------------------------


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or buf[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `size` bytes of text, or one row: (rows, bytes, offsets)."""
    for batch in batches:
        data, off = as_bytes(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    _release()


def _release() -> None:
    """Give freed memory back: a worker is kept for other tasks, and what this one took would stay with it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs outside \\x20 and \\x09-\\x0D: starts, ends, and the first run of each row (one more at the end)."""
    space = SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[off[:-1][off[:-1] < len(data)]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the runs, and runs()."""
    if lower:
        data = _LOWER[data]
    starts, ends, first = runs(data, off)
    return _hashes(data, starts, ends), starts, ends, first


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes at a time over all words that still have some left."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 200_000):
        s, n = starts[a : a + 200_000], (ends - starts)[a : a + 200_000]
        part = np.concatenate([data[s[0] : s[-1] + n[-1]], np.zeros(8, np.uint8)])
        eight = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        at, h = s - s[0], n.astype(np.uint64) * _STEP
        live, k = np.arange(len(s)), 0
        while len(live):
            left = np.minimum(n[live] - 8 * k, 8)
            x = eight[at[live] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left.astype(np.uint64) * np.uint64(8)))
            h[live] = mix((h[live] ^ x) * _STEP + np.uint64(k + 1))
            k += 1
            live = live[n[live] > 8 * k]
        out[a : a + 200_000] = h
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, rows regarded or not: callers use only those within a row."""
    n = max(0, len(h) - k + 1)
    g = np.full(n, k, np.uint64)
    for i in range(k):
        g = (g + h[i : i + n]) * _STEP
        g ^= g >> np.uint64(29)
    return mix(g)


# ---- components -----------------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of one stretch of edges: as connected as before, and at most one edge for each node but the least."""
    up: dict = {}
    kind = None

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def out() -> Iterator[pa.RecordBatch]:
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [(x, r) for x, r in pairs if x != r]
        up.clear()
        for i in range(0, len(pairs), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*pairs[i : i + 10_000], strict=True)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(*(batch.column(c).to_pylist() for c in "ab"), strict=True):
            a, b = sorted((root(a), root(b)))
            up[b] = a
        if len(up) > 200_000:
            yield from out()
    yield from out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), root the smallest node reachable.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes.  Before each a
    task replaces its edges, 200,000 nodes at a time, by as many stars as they connect.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = lambda x: x.select("a", "b").mapInArrow(_forest, f"a {kind}, b {kind}")
    e = saved(stars(edges).distinct())
    while True:
        old = e
        # large star: all larger neighbours of a node point to the least of its neighbourhood
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b")
        # small star: a node and its smaller neighbours point to the least of them
        e1 = saved(stars(low).distinct())
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        joined = e1.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = saved(joined.filter("a <> b").distinct())
        same = e.count() == old.count() and e.join(old, ["a", "b"], "left_anti").isEmpty()
        forget(old, e1)
        if same:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
