"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, over sequences of `order` bytes.

Symbols are the bytes of a text as they are (digits are one symbol, so are white space and control characters), after
`order` - 1 pads and before an end symbol.  A sequence of up to seven symbols is its own 64-bit code, so no two
sequences share a count.

Counts lie in tables and grow with the trusted text.  The highest order counts occurrences, lower ones different left
neighbours; each order has the discounts D1, D2 and D3+ of Chen and Goodman from its own counts of counts, and hands
what it discounts to the order below; the lowest is mixed with the uniform distribution.  An order joins its counts to
the sums of their contexts and to the probabilities of their suffixes; at most 256 rows share a key in either join.

Sharded count join.  With p = (c - D) / total + gamma p' for a known sequence and gamma p' for an unknown one, the
logarithm of a probability is a sum over the sequences that end there: one weight for each known one, as the sequence
told and as a context of the next symbol.  So a document's bits are the sum over all its sequences of the weights they
have in the tables, and any part of the tables gives a part of the sum.  The weights are dealt by hash into shards of
about `shard` rows (a bound on what is broadcast); each shard is joined to the distinct sequences of every half megabyte
of text, and gives a partial sum for each document; the sums are added by an exchange of short rows.  Weights are fixed-point
numbers, so sums are exact in any order.

The documents are dealt in two halves by a hash of the doc_id, and each half is scored by the model of the trusted
texts of the other (by that of all if one half has none): no document is scored by a model that it was counted in.

A document has two scores: bits a symbol, and the share of symbols whose sequence of `order` no trusted text has, which
a few toxic words in a usual text raise.  Both are drawn towards their language's mean by `prior` symbols, so that a few
odd words in a short text decide nothing.  A language's limits are the `quantile` of the scores of its trusted
documents; a language with under `least` trusted documents has the limits of all together.  A document over either
limit is rejected.

Defined cases: null or empty text has one symbol, its end, and is kept; null lang is a language; without any trusted
document all are kept; a label row that repeats counts once, a document with contradicting labels is not trusted;
repeated documents count each and are returned each; a long text is one piece of its task's work and takes some 60
bytes of memory for each of its own; an empty table gives an empty result; other columns are ignored by quality() and
returned as they are, whatever their names, by good_documents().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.llm._shared import chunks, forget, having, saved, without

V = 256
PAD, CONTROL, END = 0, 1, 2
#: Weights are whole numbers of 1 / UNIT bits.
UNIT = 1 << 16
#: Steps of a score of one; quantiles are exact in them.
STEPS = {"bits": 10_000, "unseen": 200_000}
_COARSE = 256


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[:32] = CONTROL
    out[[9, 10, 11, 12, 13]] = 32
    out[48:58] = 48
    return out


CLASS = _classes()


def sequences(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the sequences that end at each symbol of each text, its end symbol included, and their first place."""
    lead = order - 1
    first = off + np.arange(len(off)) * order  # of each text with its pads and end
    s = np.full(first[-1], PAD, np.uint8)
    s[np.arange(len(data)) + np.repeat(np.arange(len(off) - 1) * order + lead, np.diff(off))] = CLASS[data]
    s[first[1:] - 1] = END
    code = np.zeros(len(s), np.uint64)
    for j in range(order):
        code[j:] |= s[: len(s) - j].astype(np.uint64) << np.uint64(8 * j)
    told = np.ones(len(s), bool)
    told[(first[:-1, None] + np.arange(lead)).ravel()] = False
    return code[told], off + np.arange(len(off))


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, np.concatenate([n for _, n in held]))
            return code, n

        def out(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(code), 50_000):
                part = code[i : i + 50_000]
                half, part = (part >> np.uint64(56)).astype(np.int32), (part & np.uint64((1 << 56) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(part), pa.array(n[i : i + 50_000])], names=["half", "g", "n"])

        for rows, data, off in chunks(batches, size=1 << 19):
            code, first = sequences(data, off, order)
            code |= np.repeat(rows.column("half").to_numpy().astype(np.uint64), np.diff(first)) << np.uint64(56)
            counts = pc.value_counts(pa.array(code))
            held.append((counts.field("values").to_numpy(), counts.field("counts").to_numpy()))
            if sum(len(x) for x, _ in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield from out(*held.pop())
        if held:
            yield from out(*merged())

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What a count of 1, 2, 3 and more loses; a twentieth at least, so that every order hands something down."""
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]  # too few counts to estimate from
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.05), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def half_of(doc_id) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


def _low(g: str, k: int) -> Column:
    """The last k symbols."""
    return F.col(g).bitwiseAND(F.lit((1 << 8 * k) - 1))


def train(trusted: DataFrame, order: int) -> tuple[DataFrame, list[int]]:
    """The weights of the models of trusted (half, text), in 1 / UNIT bits, and what each symbol costs besides.

    Rows (key, w0, w1, seen0, seen1): w0 and seen0 are of the model for half 0, which is of the texts of half 1; the key
    is the length << 56 | the sequence.
    """
    counted = saved(trusted.select("half", "text").mapInArrow(_count(order), "half int, g long, n long").groupBy("half", "g").agg(F.sum("n").alias("c")))
    both = counted.select("half").distinct().count() == 2
    model = F.array(1 - F.col("half")) if both else F.array(F.lit(0), F.lit(1))
    level = {order: counted.select(F.explode(model).alias("m"), "g", "c")}
    for k in range(order - 1, 0, -1):
        level[k] = saved(level[k + 1].groupBy("m", _low("g", k).alias("g")).agg(F.count("*").alias("c")))
    of = None
    for k, t in level.items():
        x = t.groupBy("m").agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).withColumn("k", F.lit(k))
        of = x if of is None else of.union(x)
    d = {(r.k, r.m): discounts(r.n1, r.n2, r.n3, r.n4) for r in of.collect()}  # two rows an order

    def of_both(k: int, one) -> Column:
        return F.when(F.col("m") == 0, one(d.get((k, 0), [0.5] * 3))).otherwise(one(d.get((k, 1), [0.5] * 3)))

    def loss(k: int) -> Column:
        return of_both(k, lambda x: F.when(F.col("c") == 1, x[0]).when(F.col("c") == 2, x[1]).otherwise(x[2]))

    def lost(k: int) -> Column:
        return of_both(k, lambda x: F.col("n0") * x[0] + F.col("n1") * x[1] + F.col("n2") * x[2])

    contexts, p = {}, None
    base = [0, 0]
    weights = []
    for k in range(1, order + 1):
        own = level[k].withColumn("loss", loss(k)).withColumn("context", F.shiftright("g", 8))
        contexts[k] = saved(own.groupBy("m", "context").agg(F.sum("c").alias("total"), *(F.count(F.when(x, 1)).alias(f"n{i}") for i, x in enumerate((F.col("c") == 1, F.col("c") == 2, F.col("c") > 2)))).select("m", "context", "total", lost(k).alias("lost")))
        own = own.join(contexts[k], ["m", "context"]).withColumn("gamma", F.col("lost") / F.col("total"))
        if k == 1:
            own = own.withColumn("low", F.lit(1 / V))
            for r in contexts[1].collect():  # the empty context of each model
                base[r.m] = round(UNIT * (np.log2(V) - np.log2(r.lost / r.total)))
        else:
            own = own.withColumn("suffix", _low("g", k - 1)).join(p, ["m", "suffix"])
        own = own.withColumn("p", (F.col("c") - F.col("loss")) / F.col("total") + F.col("gamma") * F.col("low"))
        own = saved(own.select("m", "g", "p", (F.log2("p") - F.log2("gamma") - F.log2("low")).alias("told")))
        p = own.select("m", F.col("g").alias("suffix"), F.col("p").alias("low"))
        weights.append(own.select("m", F.lit(k).alias("k"), "g", F.col("told").alias("w"), F.lit(k == order).alias("seen")))
        if k > 1:
            weights.append(contexts[k].select("m", F.lit(k - 1).alias("k"), F.col("context").alias("g"), F.log2(F.col("lost") / F.col("total")).alias("w"), F.lit(False).alias("seen")))
    out = weights[0]
    for x in weights[1:]:
        out = out.union(x)
    key = F.shiftleft(F.col("k").cast("long"), 56).bitwiseOR(F.col("g"))
    cost = F.round(-F.col("w") * UNIT).cast("long")
    of_model = lambda m, c: F.when(F.col("m") == m, F.col(c))
    summed = [F.coalesce(F.sum(of_model(m, "cost")), F.lit(0)).cast("int").alias(f"w{m}") for m in (0, 1)]
    known = [F.coalesce(F.max(of_model(m, "seen")), F.lit(False)).alias(f"seen{m}") for m in (0, 1)]
    out = out.select("m", key.alias("key"), cost.alias("cost"), "seen").groupBy("key").agg(*summed, *known)
    out = saved(out)
    forget(counted, *(t for k, t in level.items() if k < order), *contexts.values())
    return out, base


class Shard:
    """A part of the weights, in order of its keys."""

    def __init__(self, rows: pa.Table) -> None:
        key, w0, w1, s0, s1 = (rows.column(c).to_numpy() for c in ("key", "w0", "w1", "seen0", "seen1"))
        by = np.argsort(key)
        self.key, self.w, self.seen = key[by], np.stack([w0[by], w1[by]]), np.stack([s0[by], s1[by]])

    def sums(self, code: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """For both models the weights of the sequences of each code, as far as they are here, and whether the longest is known."""
        w, seen = np.zeros((2, len(code)), np.int64), np.zeros((2, len(code)), bool)
        if len(self.key):
            for k in range(1, order + 1):
                key = (code & np.uint64((1 << 8 * k) - 1)).astype(np.int64) | (k << 56)
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[at] == key
                w += np.where(hit, self.w[:, at], 0)
                if k == order:
                    seen = self.seen[:, at] & hit
        return w, seen


def _score(shard, base: list[int], order: int):
    """One shard's part of each document's bits and known sequences; base: what each symbol costs besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, size=1 << 19):
            code, first = sequences(data, off, order)
            half, n = rows.column("half").to_numpy(), np.diff(first)
            each = pa.array(code).dictionary_encode()
            u, at = each.dictionary.to_numpy(), each.indices.to_numpy()
            w, seen = shard.value.sums(u, order)
            # each sequence of under `order` symbols that starts a text is a context, too: all pads
            pads = shard.value.sums(np.zeros(1, np.uint64), order - 1)[0][:, 0]
            of = np.repeat(half, n)
            part = lambda x: np.add.reduceat(x[of, at].astype(np.int64), first[:-1])
            bits = part(w) + pads[half] + np.array(base, np.int64)[half] * n
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "th", "lang")), pa.array(n), pa.array(bits), pa.array(part(seen))], names=["doc_id", "th", "lang", "n", "bits", "known"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    return docs.withColumn("half", half_of("doc_id")).withColumn("th", F.xxhash64("text"))


def scores(docs: DataFrame, weights: DataFrame, base: list[int], order: int, shard: int) -> DataFrame:
    """(doc_id, th, lang, times, n, bits, unseen) for each different row of docs."""
    spark = docs.sparkSession
    parts = max(1, -(-weights.count() // shard))
    out = None
    for i in range(parts):
        rows = weights.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i).toArrow()  # about `shard` rows
        sent = spark.sparkContext.broadcast(Shard(rows))
        part = saved(_keyed(docs).mapInArrow(_score(sent, base if i == 0 else [0, 0], order), "doc_id long, th long, lang string, n long, bits long, known long"))
        sent.destroy()
        out = part if out is None else out.union(part)
    by = out.groupBy("doc_id", "th", "lang", "n").agg(F.count("*").alias("rows"), F.sum("bits").alias("bits"), F.sum("known").alias("known"))
    times = F.expr(f"rows div {parts}")
    return by.select("doc_id", "th", "lang", times.alias("times"), "n", F.expr(f"bits div (rows div {parts})").alias("bits"), (F.col("n") - F.expr(f"known div (rows div {parts})")).alias("unseen"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good and not toxic, by all their labels."""
    by = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return by.agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("doc_id")


def _steps_under(steps: DataFrame, quantile: float) -> DataFrame:
    """(what, lang, b): the step that holds the quantile; steps: (what, lang, b, n).

    Found among the sums of 256 steps each, then among those 256: no language's steps meet in one task.
    """
    keys = ["what", "lang"]
    total = steps.groupBy(*keys).agg(F.sum("n").alias("all"))
    coarse = steps.groupBy(*keys, F.floor(F.col("b") / _COARSE).alias("a")).agg(F.sum("n").alias("n"))

    def first_over(rows: DataFrame, by: str, before: Column) -> DataFrame:
        run = before + F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("upto", run).filter(F.col("upto") >= quantile * F.col("all"))
        return rows.groupBy(*keys).agg(F.min_by(F.struct(by, (F.col("upto") - F.col("n")).alias("before"), "all"), by).alias("x"))

    same = lambda x, y: (x["what"] == y["what"]) & x["lang"].eqNullSafe(y["lang"])
    a = first_over(coarse.join(total, same(coarse, total)).select(coarse["*"], total["all"]), "a", F.lit(0))
    a = saved(a.select(*keys, "x.*"))
    near = steps.join(F.broadcast(a), same(steps, a) & (F.floor(steps["b"] / _COARSE) == a["a"])).select(steps["*"], a["before"], a["all"])
    return first_over(near, "b", F.col("before")).select(*keys, "x.b")


def limits(scored: DataFrame, trusted: DataFrame, quantile: float, prior: int, least: int) -> DataFrame:
    """(lang, mean_bits, top_bits, mean_unseen, top_unseen) for each language; the other languages have those of lang null."""
    what = lambda k: F.struct(F.lit(k).alias("what"), F.lit(STEPS[k]).alias("step"), F.lit(UNIT if k == "bits" else 1).alias("unit"), F.col(k).alias("x"))
    own = scored.join(trusted, "doc_id").filter("n > 1").select("lang", "n", "times", F.explode(F.array(*map(what, STEPS))).alias("w")).select("lang", "n", "times", "w.*")
    own = own.union(own.withColumn("lang", F.lit(None).cast("string")))
    mean = own.groupBy("what", "lang").agg((F.sum(F.col("x") * F.col("times")) / F.sum(F.col("n") * F.col("times")) / F.max("unit")).alias("mean"), F.sum("times").alias("docs"))
    mean = saved(mean.filter((F.col("docs") >= least) | F.col("lang").isNull()).select(F.col("what").alias("what_"), F.col("lang").alias("lang_"), "mean"))
    if mean.isEmpty():
        return scored.sparkSession.createDataFrame([(None, 0.0, float("inf"), 0.0, float("inf"))], "lang string, mean_bits double, top_bits double, mean_unseen double, top_unseen double")
    own = own.join(mean, (F.col("what") == F.col("what_")) & F.col("lang").eqNullSafe(F.col("lang_")))
    score = (F.col("x") / F.col("unit") + prior * F.col("mean")) / (F.col("n") + prior)
    steps = saved(own.groupBy("what", "step", "lang", F.floor(score * F.col("step")).alias("b")).agg(F.sum("times").alias("n")))
    top = _steps_under(steps, quantile).join(mean, (F.col("what") == F.col("what_")) & F.col("lang").eqNullSafe(F.col("lang_")))
    step = F.create_map(*(F.lit(x) for k in STEPS for x in (k, STEPS[k])))
    top = top.select("what", "lang", "mean", ((F.col("b") + 1) / step[F.col("what")]).alias("top"))
    wide = [F.max(F.when(F.col("what") == k, F.col(c))).alias(f"{c}_{k}") for k in STEPS for c in ("mean", "top")]
    return saved(top.groupBy("lang").agg(*wide))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, prior: int = 200, least: int = 50, order: int = 5, shard: int = 4_000_000) -> DataFrame:
    """(doc_id, th, lang, times, n, score, keep) for each different row of docs (doc_id, lang, text)."""
    trusted = saved(trusted_ids(labels))
    texts = having(_keyed(docs), F.col("doc_id"), trusted.select("doc_id"))
    weights, base = train(texts, order)
    scored = saved(scores(docs, weights, base, order, shard))
    limit = limits(scored, trusted, quantile, prior, least)
    forget(weights)
    rest = limit.filter("lang is null").first()
    out = scored.join(limit.filter("lang is not null"), "lang", "left")
    value = {"bits": F.col("bits") / UNIT, "unseen": F.col("unseen")}
    score = {k: (value[k] + prior * F.coalesce(f"mean_{k}", F.lit(rest[f"mean_{k}"]))) / (F.col("n") + prior) for k in STEPS}
    under = [score[k] <= F.coalesce(f"top_{k}", F.lit(rest[f"top_{k}"])) for k in STEPS]
    return out.select("doc_id", "th", "lang", "times", "n", score["bits"].alias("score"), ((under[0] & under[1]) | (F.col("n") == 1)).alias("keep"))


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, keep) for each row of docs (doc_id, lang, text)."""
    out = judged(docs, labels, **how).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.pow(F.lit(2.0), "score").alias("perplexity"), "keep")


def good_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that are kept; only rows that go, and few others, are exchanged."""
    key = lambda d: F.struct(d["doc_id"].cast("long").alias("doc_id"), F.xxhash64(d["text"]).alias("th"), F.coalesce(d["lang"].cast("string"), F.lit("")).alias("lang"))
    bad = saved(judged(docs, labels, **how).filter("not keep").select(F.struct("doc_id", "th", "lang").alias("key")))
    return without(docs, key(docs), bad)
