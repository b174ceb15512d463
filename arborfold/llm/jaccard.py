"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct shingles of k words (A-Z lower-cased; words are runs outside ASCII white
space).  Two documents link when |A & B| / |A | B| >= threshold, which with sizes a and b means at least
T = ceil(t (a + b) / (1 + t)) common shingles.

DivideSkip, dealt over executors: a document's shingles are ordered from rare to frequent and divided.  The first
n - ceil(t n) + 1 make short inverted lists, which are merged (by an exchange on the shingle instead of a heap);
a pair must meet there at least T minus what its long lists can still give, or it is dropped.  For the survivors
the long lists are probed: both whole shingle sets are compared by binary search.  Lists are named by all
64 bits of a shingle, as sets are compared, so a set has as many entries as shingles.  Any order of them gives the
same links; frequent ones come from a list of at most `frequent` shingles, so what is broadcast has a fixed bound.

Lists are pruned before anything is paired: a shingle of one node alone goes, a list of two whose sizes do not fit
goes, and so does a node's entry in a list if the node stands in fewer lists than any partner there would require.
A shingle's documents are dealt over tasks by about `hot`, and pruned by what is known of all of them.

Equal sets collapse to one node before anything is paired.  While the lists hold far more pairs than rows, and a turn halves them, members of
lists of over `star` nodes are first paired with one pivot of each size class, in two lists each; nodes that end in
one component need no further pair.  All pairs that are left between different components follow, so no link that
could join two components is lost.

Defined cases: null text or text without words has no shingles and links with nothing (component_id is its own
doc_id); fewer than k words make one shingle, the whole sequence; repeated rows are equal sets, each row is returned;
a null doc_id takes part but never names a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.llm._shared import chunks, components, forget, grams, having, joined, mix, saved, without, words

_DIGEST, _SIZE = 12, 4  # bytes of a node: of its set's digest, and of its number of shingles
_PIECE = 4 << 20  # shingles among which frequent ones are told


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes."""
    h, _, _, first = words(data, off, lower=True)
    g = grams(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:  # the whole sequence; its length keeps it apart from shingles
            yield mix(grams(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _node(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=_DIGEST).digest() + len(s).to_bytes(_SIZE, "big") if len(s) else None


def _describe(k: int, often: int, piece: int):
    """Rows (doc_id, th, node), and rows (token, times) for shingles that several documents of one piece have."""
    names = ["doc_id", "th", "node", "token", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()

        def common() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            v, n = v[n >= often], n[n >= often]
            held.clear()
            seen.clear()
            none = pa.nulls(len(v), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(v), pa.binary()), pa.array(v.astype(np.int64)), pa.array(n)], names=names)

        size = 0
        for rows, data, off in chunks(batches):
            nodes = []
            for s in _sets(data, off, k):
                nodes.append(_node(s))
                if nodes[-1] and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    held.append(s)
                    size += len(s)
            none = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), pa.array(nodes, pa.binary()), none, none], names=names)
            if size >= piece:
                yield common()
                size = 0
        if held:
            yield common()

    return run


def _post(k: int, cut: tuple[int, int], frequent: np.ndarray, rank: np.ndarray, shares: np.ndarray):
    """Rows (token, share, node) of the short lists; a node once for each stretch of rows.

    share is 0, or for a frequent token with several shares one of 1 to their number, by the node.
    """
    a, b = cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, data, off in chunks(batches):
            tokens, nodes, counts = [], [], []
            for s in _sets(data, off, k):
                node = _node(s)
                if node is None or node in seen:
                    continue
                seen.add(node)
                if len(seen) > 200_000:
                    seen.clear()
                n = len(s)
                p = n - -(-a * n // b) + 1
                if p < n and len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    r = np.where(frequent[at] == s, rank[at], 0)
                    if r.any():
                        s = s[np.argsort(r, kind="stable")]
                tokens.append(s[:p])
                nodes.append(node)
                counts.append(p)
            if tokens:
                t = np.concatenate(tokens)
                which = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
                share = np.zeros(len(t), np.int32)
                if len(frequent) and shares.any():
                    at = np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)
                    of = np.where(frequent[at] == t, shares[at], 0)
                    own = np.array([int.from_bytes(x[:4], "big") for x in nodes], np.int64)[which]
                    share = np.where(of > 0, 1 + own % np.maximum(of, 1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(share), pa.array(nodes, pa.binary()).take(pa.array(which))], names=["token", "share", "node"])

    return run


def _probe(k: int, cut: tuple[int, int]):
    """Of rows (a, b, text_a, text_b) the pairs whose whole sets reach the threshold."""
    a, b = cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0

        def of(node: int, text: str) -> np.ndarray:
            nonlocal size
            if (s := known.get(node)) is None:
                data = np.frombuffer(text.encode(), np.uint8)
                s = known[node] = next(_sets(data, np.array([0, len(data)]), k))
                size += len(s)
            return s

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                x, y, tx, ty = (c.to_pylist() for c in batch.slice(i, 256).select(["a", "b", "text_a", "text_b"]).columns)
                out = []
                for one, two, one_text, two_text in zip(x, y, tx, ty, strict=True):
                    s, t = sorted((of(one, one_text), of(two, two_text)), key=len)
                    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                    both = int((t[at] == s).sum())
                    out.append(b * both >= a * (len(s) + len(t) - both))
                    if size > 2_000_000:
                        known.clear()
                        size = 0
                keep = pa.array(out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()).filter(keep), pa.array(y, pa.int64()).filter(keep)], names=["a", "b"])

    return run


def _size(c):
    return F.conv(F.hex(F.substring(c, _DIGEST + 1, _SIZE)), 16, 10).cast("long")


def _grouped(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5), frequent: int = 500_000, often: int = 3, star: int = 16, hot: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, node) for each row of docs, and (node, one, c) for each node: its first row and its component."""
    up, down = threshold
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    told = saved(docs.mapInArrow(_describe(k, often, _PIECE), "doc_id long, th long, node binary, token long, times long"))
    each = told.filter("token is null").select("doc_id", "th", "node")
    top = told.filter("token is not null").groupBy("token").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "token").limit(frequent).toPandas()
    rank = np.arange(len(top), 0, -1)  # the most frequent come last of all
    tokens = top["token"].to_numpy(np.int64).astype(np.uint64)
    by = np.argsort(tokens)

    times = top["n"].to_numpy(np.int64)
    shares = np.where(times > hot, 1 + times // hot, 0)

    need = F.ceil((F.col("na") + F.col("nb")) * up / (up + down))
    rest = lambda c: -F.floor(-F.col(c) * up / down) - 1  # noqa: E731  what lies beyond the short lists
    fits = F.least("na", "nb") * down >= F.greatest("na", "nb") * up

    # one exchange: a list, or a share of a hot one, lies in one partition
    posts = docs.mapInArrow(_post(k, threshold, tokens[by], rank[by], shares[by]), "token long, share int, node binary").repartition("token", "share").groupBy("token", "share", "node").agg(F.lit(1).alias("x")).drop("x")
    entry = Window.partitionBy("token", "share")
    lists = posts.withColumn("n", _size("node"))
    whole = lists.filter("share > 0").groupBy("token").agg(F.count("*").alias("all"), F.min("n").alias("least"), F.max("n").alias("most"))
    lists = lists.withColumn("l", F.count("*").over(entry)).withColumn("lo", F.min("n").over(entry)).withColumn("hi", F.max("n").over(entry))
    # only tokens of the list of frequent ones have shares, so `whole` has that bound
    lists = lists.join(F.broadcast(whole), "token", "left")
    lists = lists.withColumns({"l": F.coalesce("all", "l"), "lo": F.coalesce("least", "lo"), "hi": F.coalesce("most", "hi")})
    lists = lists.filter(F.col("l") > 1).filter((F.col("l") > 2) | (F.col("lo") * down >= F.col("hi") * up))
    # what a partner of size x must share at least; concave in x, so the least is at an end of the sizes that fit
    shared = lambda x: (F.col("n") + x) * up / (up + down) - F.greatest(F.col("n"), x) * up / down
    least_shared = F.least(shared(F.greatest("lo", F.col("n") * up / down)), shared(F.least("hi", F.col("n") * down / up)))
    lists = lists.select("node", F.struct("token", "l", (least_shared - 1e-6).alias("least")).alias("e"))
    # a node's entries in one row, as many as its text has short lists: labels are joined to nodes, not to entries
    lists = lists.groupBy("node").agg(F.collect_list("e").alias("e")).withColumn("m", F.size("e"))
    lists = lists.withColumn("e", F.transform(F.filter("e", lambda x: F.col("m") >= x["least"]), lambda x: F.struct(x["token"].alias("token"), x["l"].alias("l")))).filter(F.size("e") > 0)
    # numbered as they are written: from here on a node is its number, half as long and mostly zeros
    lists = saved(lists.select("node", _size("node").alias("n"), "m", "e").withColumn("id", F.monotonically_increasing_id()))
    ids = lists.select("node", "id")
    lists = lists.select(F.col("id").alias("node"), "n", "m", "e")

    cls = F.floor(F.log("n") / float(np.log(down / up)))

    def stars(posts: DataFrame, turn: int) -> DataFrame:
        """Pairs of each member with the pivots of its own and the next smaller size class, in two of its lists."""
        # a text that has little of its own stands in many of the lists that its group shares, and links with most of it
        chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1000)) / 1000 if turn else F.lit(0.5)
        posts = posts.withColumn("h", -F.col("m") * (chance + 0.5))
        first = F.desc("l") if turn == 0 else F.xxhash64("token", "node", F.lit(turn))
        few = posts.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy(first, F.xxhash64("token")))).filter("i <= 2").withColumn("cls", cls)
        pivots = posts.withColumn("cls", cls).groupBy("token", "cls").agg(F.min(F.struct("h", "node", "n")).alias("p"))
        pivots = pivots.select("token", F.explode(F.array("cls", F.col("cls") + 1)).alias("cls"), F.col("p.node").alias("a"), F.col("p.n").alias("na"))
        pairs = few.select("token", "cls", F.col("node").alias("b"), F.col("n").alias("nb")).join(pivots, ["token", "cls"]).filter("a <> b").filter(fits)
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # the whole text of one document of each node that is in some pair
    names = each.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("one"))
    listed = names.join(ids, "node").select(F.col("id").alias("node"), "one")

    def linked(pairs: DataFrame) -> DataFrame:
        inside = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = saved(listed.join(inside, "node").select(F.struct("one.doc_id", "one.th").alias("key"), "node"))
        texts = saved(joined(docs, F.struct("doc_id", "th"), wanted, once=True).select("node", F.col("_row.text").alias("text")))
        full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        out = saved(full.select("a", "b", "text_a", "text_b").mapInArrow(_probe(k, threshold), "a long, b long"))
        forget(texts, wanted)
        return out

    links = docs.sparkSession.createDataFrame([], "a long, b long")
    root = components(links)
    before = None
    for turn in itertools.count():
        owner = lists.join(root, "node", "left").withColumn("c", F.coalesce("root", "node")) if turn else lists.withColumn("c", F.col("node"))
        labelled = owner.select("node", "n", "m", "c", F.explode("e").alias("e")).select("e.token", "node", "n", "e.l", "m", "c")
        left = labelled.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(F.sum("m").alias("l"), F.sum(F.col("m") * F.col("m")).alias("s"), F.count("*").alias("c")).filter("c > 1")
        left = saved(left.select("token", "l", ((F.col("l") * F.col("l") - F.col("s")) / 2).alias("pairs")))
        todo, rows = left.agg(F.sum("pairs"), F.sum("l")).first()
        if not rows:
            break
        last = todo <= 4 * rows or (before is not None and 2 * todo > before)
        before = todo
        if last:
            # a list in blocks, and each two blocks in one task; most lists are one block
            blocked = labelled.join(left.select("token"), "token", "left_semi").withColumn("own", F.pmod(F.xxhash64("node"), 1 + F.floor(F.col("l") / hot))).withColumn("top", F.floor(F.col("l") / hot))
            x = blocked.select("token", F.col("own").alias("i"), F.explode(F.sequence("own", "top")).alias("j"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"))
            y = blocked.select("token", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"))
            both = x.join(y, ["token", "i", "j"]).filter("(i < j or x < y) and cx <> cy")
            swap = F.col("x") > F.col("y")
            two = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
            met = both.select(two("x", "y").alias("a"), two("y", "x").alias("b"), two("nx", "ny").alias("na"), two("ny", "nx").alias("nb"))
            met = met.filter(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"))
            pairs = met.filter(F.col("met") + F.greatest(rest("na"), rest("nb")) >= need).select("a", "b")
        else:
            long = labelled.filter(F.col("l") > star)
            pairs = stars(saved(long.join(left.select("token"), "token")) if turn else long, turn)
        pairs = saved(pairs.join(links, ["a", "b"], "left_anti") if turn else pairs)
        links = saved(links.union(linked(pairs)))
        root = saved(components(links))
        if last:
            break

    # a component is named by its least number, which root does not list; a node that stands in no list by itself
    found = ids.join(root.select(F.col("node").alias("id"), "root"), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    return each, names.join(found, "node", "left").select("node", "one", F.struct("root", F.when(F.col("root").isNull(), F.col("node")).alias("own")).alias("c"))


def _of_many(name: DataFrame, value: Column) -> DataFrame:
    """(c, of_all) for the components of several nodes.  Written, so that a join splits a component with many of them."""
    return saved(name.groupBy("c").agg(value.alias("of_all"), F.count("*").alias("nodes")).filter("nodes > 1").drop("nodes"))


def jaccard_components(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    how: threshold, the least similarity as a fraction (4, 5); k, words of a shingle (5); frequent, length of the
    broadcast list of frequent shingles (500,000); often, how many documents of one stretch must share a shingle for
    it to stand on that list (3); star (16), hot (1000): see above; they change the work, not the links.
    """
    each, name = _grouped(docs, **how)
    least = _of_many(name, F.min("one.doc_id"))
    ids = saved(name.join(least, "c", "left").select("node", F.coalesce("of_all", "one.doc_id").alias("component_id")))
    forget(least)
    out = each.join(ids, "node", "left")
    return out.select("doc_id", F.coalesce(_size("node"), F.lit(0)).alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, with one row for each component: the smallest doc_id's, and of its rows one.

    Components are told apart even if different texts in them share the smallest doc_id; a null doc_id is the largest.
    Rows without shingles link with nothing and all stay.  Only texts that go or repeat are exchanged.
    """
    each, name = _grouped(docs.select("doc_id", "text"), **how)
    first = _of_many(name, F.min("one"))
    stays = saved(name.join(first, "c", "left").select("node", F.coalesce("of_all", "one").alias("first")))
    forget(first)
    rows = each.filter("node is not null").groupBy("node", "doc_id", "th").agg(F.count("*").alias("n"))
    stay = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    # rows that go, and rows that stay but repeat
    listed = rows.join(stays, "node").select(F.struct("doc_id", "th").alias("key"), stay.alias("stay"), "n")
    listed = saved(listed.filter("not stay or n > 1"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    again = having(docs, key, listed.filter("stay").select("key")).dropDuplicates(["doc_id", "text"])
    return without(docs, key, listed.select("key")).union(again)
