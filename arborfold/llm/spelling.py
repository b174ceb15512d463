"""Spelling variants: words one edit apart, and the form that each most likely stands for.

Words are counted by an exchange.  The words that count are sorted by range and cut into shards, each a compact trie
of at most `nodes` nodes (or one word): nodes are numbered by depth, so one sorted array of (parent, letter) names all
children, and a node takes 16 bytes with its count.  Shards are broadcast in groups of at most `group_bytes`, one group
after the other; both bounds are fixed, whatever the vocabulary, and only the number of groups grows with it.  All
words, dealt over tasks, meet every shard: the word's distance-one Levenshtein automaton, states (read, edits), is
intersected with the trie depth-first.  In the states without an edit there is one path; from each of its nodes the
automaton may skip a letter of the word, take one of the trie that the word lacks, or take another one, and what follows
has to match letter by letter, to its end, before the path goes on; thousands of words take each step together, in
numpy.  Accepting nodes are the neighbours.  They are reduced where they are found to a row for each word and group of
shards (how many, and the best), and these to one row for each word.

A word's form is the near word of largest count (ties: smallest in code point order) if that is `ratio` times its own
or more.  Counts grow along forms, so no chain has more than log(largest count) / log(ratio) steps; roots are found by
pointer doubling.

Defined cases: null text has no words, null words are not counted; repeated rows are occurrences like any others; ties
as above; an empty table gives an empty result; other columns are ignored, whatever their names; texts are whole, and a
very long word is a shard of its own and is intersected like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import forget, saved

LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of_letters(docs: DataFrame) -> DataFrame:
    """(doc_id, word): each maximal run of letters of docs (doc_id, text), A-Z lower-cased."""
    found = F.explode(F.regexp_extract_all(F.col("text"), F.lit(LETTERS), F.lit(0)))
    return docs.select("doc_id", found.alias("word")).select("doc_id", F.translate("word", _UPPER, _LOWER).alias("word"))


def counted(occurrences: DataFrame, letters: int, least: int) -> DataFrame:
    """(word, n) of the words of at least `letters` code points that occur `least` times or more."""
    return occurrences.select("word").filter(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# ---- tries ----------------------------------------------------------------------------------------------


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins (one more at the end)."""
    text = pa.array(words, pa.large_string()) if isinstance(words, list) else words.cast(pa.large_string())
    lengths = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(text.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


class Trie:
    """Nodes by depth, 0 the root.  Child k + 1 has keys[k] = parent << 21 | letter, and keys ascend; values: a count, or 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Trie:
        """Of sorted, different words."""
        flat, off = _codes(words)
        size, counts = np.diff(off), np.array(counts, np.int64)
        keys, values = [], [np.where(size[:1] == 0, counts[:1], 0)]
        at, live, nodes, depth = np.zeros(len(size), np.int64), np.flatnonzero(size > 0), 1, 0
        while len(live):
            key = at[live] << 21 | flat[off[live] + depth]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            at[live] = nodes - 1 + np.cumsum(new)
            value, ends = np.zeros(int(new.sum()), np.int64), size[live] == depth + 1
            value[at[live[ends]] - nodes] = counts[live[ends]]
            keys.append(key[new])
            values.append(value)
            nodes, depth, live = nodes + len(value), depth + 1, live[~ends]
        return cls(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate(values))

    def to_bytes(self) -> bytes:
        return self.keys.tobytes() + self.values.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Trie:
        both = np.frombuffer(data, np.int64)
        return cls(both[: len(both) // 2], both[len(both) // 2 :])

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Children by letter, -1 where there is none."""
        key = nodes << 21 | letters
        k = np.searchsorted(self.keys, key)
        k[k == len(self.keys)] = 0
        return np.where(self.keys[k] == key, k + 1, -1) if len(self.keys) else np.full(len(nodes), -1)

    def word(self, node: int) -> str:
        out = []
        while node:
            key = int(self.keys[node - 1])
            out.append(chr(key & 0x1FFFFF))
            node = key >> 21
        return "".join(reversed(out))

    def near(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, node) of all pairs exactly one edit apart, each once, by number."""
        size, found = np.diff(off), []

        def follow(ids: np.ndarray, nodes: np.ndarray, k: int) -> None:
            """States (k, one edit): letter by letter to the end."""
            while len(ids):
                done = size[ids] == k
                ends = done & (self.values[nodes] > 0)
                found.append(ids[ends] * (len(self.values) + 1) + nodes[ends])
                ids, nodes = ids[~done], nodes[~done]
                nodes = self.step(nodes, flat[off[ids] + k])
                ids, nodes, k = ids[nodes >= 0], nodes[nodes >= 0], k + 1

        ids, nodes, k = np.arange(len(size)), np.zeros(len(size), np.int64), 0
        while len(ids):  # states (k, no edit); what an edit leads to is followed to its end before the next letter
            lo, hi = (np.searchsorted(self.keys, n << 21) for n in (nodes, nodes + 1))
            more = size[ids] > k
            follow(ids[more], nodes[more], k + 1)
            each = hi - lo
            which = np.repeat(np.arange(len(ids)), each)
            child = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - lo, each) + 1
            follow(ids[which], child, k)
            other = more[which]
            which, child = which[other], child[other]
            other = self.keys[child - 1] & 0x1FFFFF != flat[off[ids[which]] + k]
            follow(ids[which[other]], child[other], k + 1)
            ids, nodes = ids[more], nodes[more]
            nodes = self.step(nodes, flat[off[ids] + k])
            ids, nodes, k = ids[nodes >= 0], nodes[nodes >= 0], k + 1
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return pairs // (len(self.values) + 1), pairs % (len(self.values) + 1)


def _shards(nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([Trie.build(words, counts).to_bytes()], pa.binary())], names=["trie"])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if words and size + len(word) > nodes:
                    yield out()
                    words, counts, size = [], [], 0
                words.append(word)
                counts.append(n)
                size += len(word)
        if words:
            yield out()

    return run


_BEST = "word string, near long, form string, form_n long"
#: Words that meet a shard at a time.
_AT_ONCE = 4096


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.from_bytes(x) for x in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                words = batch.column("word").slice(at, _AT_ONCE)
                flat, off = _codes(words)
                near, best = np.zeros(len(words), np.int64), [None] * len(words)
                for trie in tries:
                    ids, nodes = trie.near(flat, off)
                    near += np.bincount(ids, minlength=len(words))
                    counts = trie.values[nodes]
                    most = np.zeros(len(words), np.int64)
                    np.maximum.at(most, ids, counts)
                    for k in np.flatnonzero(counts == most[ids]):  # the best of each word, ties included
                        this = (-int(counts[k]), trie.word(int(nodes[k])))
                        best[ids[k]] = min(best[ids[k]] or this, this)
                some = np.flatnonzero(near)
                rows = [words.take(pa.array(some)), pa.array(near[some]), pa.array([best[k][1] for k in some], pa.string()), pa.array([-best[k][0] for k in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=["word", "near", "form", "form_n"])

    return run


def _groups(sizes: list[tuple[int, int]], most: int) -> Iterator[list[int]]:
    """Numbers of shards, in groups of at most `most` bytes or one shard."""
    group, total = [], 0
    for k, size in sizes:
        if group and total + size > most:
            yield group
            group, total = [], 0
        group.append(k)
        total += size
    if group:
        yield group


def neighbours(words: DataFrame, nodes: int = 1_000_000, group_bytes: int = 32 << 20) -> DataFrame:
    """(word, near, form, form_n) of words (word, n): how many are near, and the best; a row for each group with any."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    letters = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    ranged = words.repartitionByRange(letters // nodes + 1, "word").sortWithinPartitions("word")
    shards = saved(ranged.mapInArrow(_shards(nodes), "trie binary").withColumn("shard", F.monotonically_increasing_id()))
    # a number and a size for each shard of some 100,000 words; the shards themselves come a group at a time
    sizes = [(r.shard, r.size) for r in shards.select("shard", F.length("trie").alias("size")).orderBy("shard").toLocalIterator()]
    out = None
    for group in _groups(sizes, group_bytes):
        held = shards.filter(F.col("shard").between(group[0], group[-1])).select("trie").collect()
        shared = spark.sparkContext.broadcast([bytes(r.trie) for r in held])
        found = saved(words.select("word").repartition(parts, "word").mapInArrow(_search(shared), _BEST))
        shared.destroy()  # what was found with it is written
        out = found if out is None else out.union(found)
    forget(shards)
    return spark.createDataFrame([], _BEST) if out is None else out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): each step doubles how far a word looks."""
    up = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = saved(up.join(over, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        forget(up)
        up = new.select("word", "root")
        up._scratch = new._scratch
        if new.filter("moved").isEmpty():
            return up


def spelling_variants(occurrences: DataFrame, letters: int = 6, least: int = 5, ratio: int = 5, nodes: int = 1_000_000, group_bytes: int = 32 << 20) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of occurrences (word)."""
    words = saved(counted(occurrences, letters, least))
    found = neighbours(words, nodes, group_bytes).select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("form_n")).alias("order"), "form").alias("best"))
    every = found.union(words.select("word", "n", F.lit(0).cast("long"), F.lit(None).cast(found.schema["best"].dataType)))
    every = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    takes = -F.col("best.order") >= F.col("n") * ratio
    every = saved(every.select("word", "n", "n_near", F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.order")).alias("form_n")))
    roots = _roots(every.filter("form is not null").select("word", "form"))
    return every.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
