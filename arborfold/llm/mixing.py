"""Mixing sources to target weights: hierarchical budgeting, in DataFrame functions only.

A tree of domains, languages and sources has a weight at each node (1 unless given).  The whole budget is shared out
from the root.  Children get shares in proportion to their weights; a child whose leaves cannot give its share, even
read `epochs` times over, gives all it has, and its shortage goes to its siblings in proportion to theirs.  Only what
a whole family lacks has already been taken from its share one level up: so siblings come before ancestors.

A leaf with a budget of A tokens and L tokens in all reads A div L whole epochs and of one more, in an order seeded by
(seed, epoch, doc_id), the longest prefix of documents with at most A mod L tokens.  The prefix is found by the sums
of 256 buckets of the order, then of 256 within the one that holds the edge, then by rows within one of those: no
leaf's rows ever meet in one task, whatever its size.  The unspent rest of a leaf is less than its edge document's
tokens; it stays unspent.

Defined cases: null domain, lang or source counts as the empty name; tokens are the runs outside ASCII white space,
null text has none; leaves without tokens give nothing, and nodes with weight 0 neither; in the edge bucket ties go by
text, and repeated rows of a leaf stay or go together; each chosen row has copies, the number of epochs that hold it; a
text longer than what is left ends its leaf's prefix; an empty table gives an empty result; other columns may have any
names and come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.llm._shared import joined, saved, without


def n_words(text: Column) -> Column:
    gaps = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), "[ \\t\\n\\x0B\\f\\r]+")
    return F.when(F.coalesce(F.btrim(text, F.lit(" \t\n\x0b\f\r")), F.lit("")) == "", 0).otherwise(F.size(gaps)).cast("long")


def _weight(names: list[Column], weights: dict[tuple[str, ...], int]) -> Column:
    out = F.lit(1)
    for path, w in weights.items():
        if len(path) == len(names):
            same = F.lit(True)
            for c, v in zip(names, path, strict=True):
                same = same & (c == v)
            out = F.when(same, w).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, path: list[str], weights: dict[tuple[str, ...], int], share: tuple[int, int], epochs: int) -> DataFrame:
    """leaves (path, tokens) with a column budget."""
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("c"))
    whole = total.select(F.least(F.expr(f"t * {share[0]} div {share[1]}"), F.col("c") * epochs)).first()[0]
    above = None
    for depth in range(1, len(path) + 1):
        here, up = path[:depth], path[: depth - 1]
        kids = nodes.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumn("w", _weight([F.col(c) for c in here], weights)).filter("w > 0 and cap > 0")
        kids = kids.join(above, up) if up else kids.withColumn("budget", F.lit(whole).cast("long"))
        order = Window.partitionBy(*up).orderBy(F.col("cap") / F.col("w"), here[-1])
        to_here, beyond = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
        left = F.col("budget") - (F.sum("cap").over(to_here) - F.col("cap"))
        kids = kids.withColumn("full", F.col("cap") * F.sum("w").over(beyond) <= F.col("w") * left)
        family = Window.partitionBy(*up)
        kids = kids.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
        kids = kids.withColumn("ws", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(family))
        kids = kids.withColumn("cw", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(to_here))
        given = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.expr("rest * cw div ws - rest * (cw - w) div ws")))
        above = kids.select(*here, given.alias("budget"))
    return leaves.join(above, path, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


#: A leaf's rows are dealt to so many tasks wherever they are joined to the plan.
SALT = 32


def _leaf(rows: DataFrame, path: dict[str, Column]) -> DataFrame:
    """The short rows (doc_id, leaf, tokens, tie); no name of the caller's comes near them."""
    names = {f"_{k}": F.coalesce(c.cast("string"), F.lit("")).alias(f"_{k}") for k, c in path.items()}
    return rows.select(F.col("doc_id"), *names.values(), n_words(F.col("text")).alias("_tokens"), F.xxhash64("text").alias("_tie"))


def _bucketed(rows: DataFrame, plan: DataFrame, keys: list[str], seed: int) -> DataFrame:
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(SALT)))
    spread = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    out = salted.join(spread, [*keys, "_salt"]).drop("_salt").withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "_epochs", F.coalesce("doc_id", F.lit(-1)))))
    return out.withColumn("_b1", F.substring("_h", 1, 2)).withColumn("_b2", F.substring("_h", 3, 2))


def plan_mix(docs: DataFrame, path: dict[str, Column], weights: dict[tuple[str, ...], int], share: tuple[int, int], epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The short rows and the plan: for each leaf its epochs and the edge of its prefix."""
    keys = [f"_{k}" for k in path]
    rows = saved(_leaf(docs, path))
    leaves = saved(rows.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")))
    plan = budgets(leaves, keys, weights, share, epochs).filter("budget > 0").select(*keys, F.expr("budget div tokens").alias("_epochs"), F.expr("budget % tokens").alias("_rest"))
    plan = saved(plan)
    two = saved(_bucketed(rows, plan, keys, seed).filter("_rest > 0").groupBy(*keys, "_b1", "_b2").agg(F.sum("_tokens").alias("t"), F.first("_rest").alias("_rest")))

    def edge(sums: DataFrame, by: list[str], bucket: str, before: Column) -> DataFrame:
        """The bucket in which the running sum first exceeds the rest, with the sum before it."""
        w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        run = before + F.sum("t").over(w)
        found = sums.select("*", run.alias("run")).filter("run > _rest").groupBy(*by)
        return found.agg(F.min_by(F.struct(F.col(bucket), (F.col("run") - F.col("t")).alias("before")), F.col(bucket)).alias("e"))

    one = two.groupBy(*keys, "_b1").agg(F.sum("t").alias("t"), F.first("_rest").alias("_rest"))
    first = edge(one, keys, "_b1", F.lit(0)).select(*keys, F.col("e._b1").alias("_b1"), F.col("e.before").alias("before1"))
    second = edge(two.join(first, [*keys, "_b1"]), keys, "_b2", F.col("before1"))
    edges = first.drop("before1").join(second.select(*keys, F.col("e._b2").alias("_e2"), F.col("e.before").alias("_before")), keys).withColumnRenamed("_b1", "_e1")
    return rows, saved(plan.join(edges, keys, "left"))


def choose(rows: DataFrame, plan: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """rows, with _copies, as far as the plan chooses them."""
    got = _bucketed(rows, plan, keys, seed)
    place, edge = F.concat("_b1", "_b2"), F.concat("_e1", "_e2")
    at_edge = F.coalesce(place == edge, F.lit(False))
    clear = got.filter(~at_edge).withColumn("_copies", F.col("_epochs") + F.coalesce(place < edge, F.lit(False)).cast("int"))
    w = Window.partitionBy(*keys).orderBy("_h", "doc_id", "_tie").rangeBetween(Window.unboundedPreceding, 0)
    near = got.filter(at_edge).withColumn("_copies", F.col("_epochs") + (F.col("_before") + F.sum("_tokens").over(w) <= F.col("_rest")).cast("int"))
    return clear.union(near).filter("_copies > 0")


def tree() -> dict[str, Column]:
    """Domain, language and source of a document; the domain, which is no column, follows from the source's last character."""
    return {"domain": F.expr("concat('d', cast(ascii(right(source, 1)) % 4 as string))"), "lang": F.col("lang"), "source": F.col("source")}


def mix_sources(docs: DataFrame, weights: dict[tuple[str, ...], int] | None = None, share: tuple[int, int] = (1, 2), epochs: int = 4, seed: int = 17, path: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, path names, n_tokens, copies) of the chosen documents."""
    path = path or tree()
    rows, plan = plan_mix(docs, path, weights or {}, share, epochs, seed)
    got = choose(rows, plan, [f"_{k}" for k in path], seed)
    return got.select("doc_id", *(F.col(f"_{k}").alias(k) for k in path), F.col("_tokens").alias("n_tokens"), F.col("_copies").cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, weights: dict[tuple[str, ...], int] | None = None, share: tuple[int, int] = (1, 2), epochs: int = 4, seed: int = 17, path: dict[str, Column] | None = None) -> DataFrame:
    """The chosen rows of docs, all their columns, each as often as epochs hold it.

    Who is chosen is decided on short rows; only texts that go or are read more than once are exchanged.
    """
    path = path or tree()
    names = [f"_{k}" for k in path]
    rows, plan = plan_mix(docs, path, weights or {}, share, epochs, seed)
    got = choose(rows, plan, names, seed).groupBy("doc_id", "_tie", *names).agg(F.max("_copies").cast("int").alias("copies"))
    rows = rows.select("doc_id", "_tie", *names).distinct()
    same = [rows[c].eqNullSafe(got[c]) for c in rows.columns]
    every = rows.join(got, same, "left").select(F.struct(*(rows[c] for c in rows.columns)).alias("key"), F.coalesce("copies", F.lit(0)).alias("copies"))
    other = saved(every.filter("copies <> 1"))
    own = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("_tie"), *(F.coalesce(c.cast("string"), F.lit("")).alias(f"_{k}") for k, c in path.items()))
    again = joined(docs, own, other.filter("copies > 1"))
    again = again.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
    return without(docs, own, other.select("key")).union(again)
