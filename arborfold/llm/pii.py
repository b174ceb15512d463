"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give them away.

Main path in DataFrame functions only.

Patterns (kinds email, ip, card, phone) are found leftmost and without overlap, each kind by itself.  Java's regex
engine gives the matches and, by splitting at them, the text between; running sums of both lengths are the offsets
in code points.  The patterns below have possessive loops and look-behinds that leave the matches as they are but
keep long runs from being scanned again from each character.

The method: a protected entity is a match (its text).  The terms of a document outside its entities co-occur with each
of them, once a document.  Over the corpus, with n documents and c counting documents,

    PMI(e; t) = log2( c(e, t) n / (c(e) c(t)) ),    IC(e) = log2( n / c(e) ),

and t discloses the share PMI / IC of the entity's information: 1 if t never occurs without it.  A term seen with
an entity in at least `evidence` documents whose share is `generalise` or more is replaced by its class wherever it
stands outside entities, in all documents; from `remove` on it is removed.  Both are spans of kind term (or gone).

Defined cases: null text counts as empty and gives zeros and the digest of the empty string; repeated rows are
occurrences like any others and each is returned; null doc_id is kept; ties in a span's start are ordered by kind;
empty tables give empty results; other columns are ignored, whatever their names; a very long text is one row of its
task, with about 100 bytes of memory for each of its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import forget, perhaps, saved

#: Kinds in their order, with patterns equal in matches to the plain ones of the contract.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
ORDER = [*KINDS, "term", "gone"]
_BLOCK = 32
SALT = 16


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The last digit counts once, the one before it twice, and so on."""
    d = F.reverse(F.transform(F.split(digits, ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0))))
    # from the right; doubled digits over 9 lose 9
    total = F.aggregate(F.transform(d, lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(match))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once; a lambda works out again for each element what it refers to."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(lengths: Column, levels: int = 3) -> Column:
    """Sums before each element: those of blocks, found in the same way, and those within the element's block."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    if not levels:
        return bound(lengths, lambda a: F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i))))

    def blocks(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))
        return F.when(F.size(a) > 0, F.transform(at, lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.array().cast("array<array<bigint>>"))

    def within(parts: Column, before: Column) -> Column:
        return F.flatten(F.transform(parts, lambda x, b: F.transform(x, lambda _, i: F.get(before, b) + total(F.slice(x, F.lit(1), i)))))

    return bound(bound(lengths, blocks), lambda parts: bound(running(F.transform(parts, total), levels - 1), lambda before: within(parts, before)))


def _found(text: Column, kind: str) -> Column:
    """Array of (match, start): all matches of the pattern, valid or not, with code point offsets."""
    return bound(F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0)), lambda got: bound(F.transform(F.split(text, KINDS[kind], -1), lambda g: F.length(g).cast("long")), lambda between: _starts(got, between)))


def _starts(got: Column, between: Column) -> Column:
    lead = F.slice(between, F.lit(1), F.size(got))
    before = running(F.zip_with(lead, got, lambda a, b: a + F.length(b)))
    starts = F.zip_with(before, lead, lambda a, b: a + b)
    return F.zip_with(got, starts, lambda m, s: F.struct(m.alias("match"), s.alias("start")))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with a column base: array of (kind, start, end, match), by start, then kind."""
    rank = {k: i for i, k in enumerate(KINDS)}
    out = docs
    for kind in KINDS:
        # rlike first: most texts have no match, and cost one scan for each kind
        out = out.withColumn(f"_{kind}", F.when(F.col("text").rlike(KINDS[kind]), _found(F.col("text"), kind)).otherwise(F.array().cast("array<struct<match: string, start: bigint>>")))
    one = lambda kind: F.transform(F.filter(f"_{kind}", lambda x: valid(kind, x["match"])), lambda x: F.struct(x["start"].alias("start"), F.lit(rank[kind]).alias("rank"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")))
    return out.withColumn("base", F.array_sort(F.concat(*map(one, KINDS)))).drop(*(f"_{k}" for k in KINDS))


_WORD = r"[\p{L}\p{N}_]+"


def _terms(text) -> Column:
    """The different words of two characters or more, lower-cased."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1), F.lower))


def _outside(text: Column, base: Column) -> Column:
    """The text between the entities."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["parts"], F.array(cut(s["at"], x["start"]))).alias("parts"))
    return F.aggregate(base, start, step, lambda s: F.array_join(F.concat(s["parts"], F.array(cut(s["at"], F.length(text).cast("long")))), " "))


def disclosing_terms(docs: DataFrame, found: DataFrame, evidence: int, generalise: float, remove: float) -> DataFrame:
    """(term, gone) of the terms that the method replaces or removes."""
    e = found.select(F.struct("text", "base").alias("row"), F.explode(F.array_distinct("base.match")).alias("entity"))
    # no pair is seen more often than its entity
    c_e = saved(e.groupBy("entity").agg(F.count("*").alias("c_e")).filter(F.col("c_e") >= evidence))
    often = perhaps(e.select(F.struct("row.*", "entity").alias("row"), "entity"), F.col("entity"), c_e.select("entity"), "row").filter("_in").select("row.*")
    pairs = often.select("entity", F.explode(_terms(_outside(F.col("text"), F.col("base")))).alias("term"))
    pairs = saved(pairs.groupBy("entity", "term").agg(F.count("*").alias("c_et")).filter(F.col("c_et") >= evidence))
    wanted = saved(pairs.select("term").distinct())
    # summed within tasks first, so that no word is in many rows of the exchange
    c_t = _words_among(docs, wanted).groupBy("term").agg(F.count("*").alias("c_t"))
    n = float(docs.count())
    pmi = F.log2(F.col("c_et") * n / (F.col("c_e") * F.col("c_t")))
    judged = pairs.join(c_t, "term").join(c_e, "entity").withColumn("share", pmi / F.greatest(F.log2(n / F.col("c_e")), F.lit(1e-9)))
    out = saved(judged.filter(F.col("share") >= generalise).groupBy("term").agg(F.max(F.col("share") >= remove).alias("gone")))
    forget(c_e, pairs, wanted)
    return out


def _words_among(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, th, term) for each document's different words, without most of those that are not in terms."""
    words = docs.select("doc_id", "th", F.explode(_terms(F.col("text"))).alias("term")).select(F.struct("doc_id", "th").alias("doc"), "term")
    return perhaps(words, F.col("term"), terms.select("term"), "doc").filter("_in").select("doc.*", F.col("_key").alias("term"))


def _occurrences(text: Column, base: Column, gone: Column) -> Column:
    """Spans of the words outside base that are keys of the map gone."""
    words, gaps = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.split(text, _WORD, -1)
    w = F.zip_with(words, gaps, lambda x, g: F.when(x.isNotNull(), F.struct(F.length(g).cast("long").alias("lead"), x.alias("word"))))
    return bound(F.filter(w, lambda x: x.isNotNull()), lambda w: _of_words(w, base, gone))


def _of_words(w: Column, base: Column, gone: Column) -> Column:
    at = running(F.transform(w, lambda x: x["lead"] + F.length(x["word"])))
    spans = F.zip_with(w, at, lambda x, a: F.struct((a + x["lead"]).alias("start"), (a + x["lead"] + F.length(x["word"])).alias("end"), F.lower(x["word"]).alias("term")))
    spans = F.filter(spans, lambda x: F.map_contains_key(gone, x["term"]) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    kind = lambda x: gone[x["term"]]
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.when(kind(x), 5).otherwise(4).alias("rank"), x["end"].alias("end"), F.when(kind(x), "gone").otherwise("term").alias("kind"), x["term"].alias("match")))


def sanitised_spans(docs: DataFrame, evidence: int = 3, generalise: float = 0.9, remove: float = 0.999) -> DataFrame:
    """docs (doc_id, text) with base and added: arrays of (start, rank, end, kind, match)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # the texts with entities are few and are used several times
    some = saved(base_spans(docs).filter(F.size("base") > 0))
    terms = disclosing_terms(docs, some, evidence, generalise, remove)
    # a term of many documents is dealt to several tasks
    hits = _words_among(docs, terms).withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALT)))
    hits = hits.join(terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>"))), ["term", "salt"])
    hits = saved(hits.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_set(F.struct("term", "gone"))).alias("gone")))
    kinds = saved(some.select("doc_id", "th", "base").dropDuplicates(["doc_id", "th"]))
    both = kinds.select("doc_id", "th", "base", F.lit(None).cast("map<string, boolean>").alias("gone")).union(hits.select("doc_id", "th", F.lit(None).cast(kinds.schema["base"].dataType), "gone"))
    both = saved(both.groupBy("doc_id", "th").agg(F.first("base", True).alias("base"), F.first("gone", True).alias("gone")).withColumnsRenamed({"doc_id": "i", "th": "h"}))
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string, match: string>>")
    # a text without spans is not exchanged
    marked = perhaps(docs.select(F.struct("doc_id", "text", "th").alias("row"), F.xxhash64("doc_id", "th").alias("key")), F.col("key"), both.select(F.xxhash64("i", "h").alias("key")), "row")
    near = marked.filter("_in").select("row.*").join(both.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
    far = marked.filter(~F.col("_in")).select("row.*").select("doc_id", "text", none.alias("base"), F.lit(None).cast(both.schema["gone"].dataType).alias("gone"))
    out = far.union(near.select("doc_id", "text", F.coalesce("base", none).alias("base"), "gone"))
    return out.withColumn("added", F.when(F.col("gone").isNotNull(), _occurrences(F.col("text"), F.col("base"), F.col("gone"))).otherwise(none)).drop("gone")


def label(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def all_spans(base: Column, added: Column) -> Column:
    return F.array_sort(F.concat(base, added))


def sanitise(spans: DataFrame) -> DataFrame:
    """(doc_id, text): entities become [KIND], disclosing terms their class or nothing.  Of overlapping spans the first counts."""
    shape = lambda m: F.when(m.rlike("^[0-9]+$"), "[number]").when(m.rlike("[0-9]"), "[code]").otherwise("[word]")
    new = lambda x: F.when(x["kind"] == "gone", "").when(x["kind"] == "term", shape(x["match"])).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = lambda text, a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(cut(F.col("text"), s["at"], x["start"]), new(x))).alias("parts"))).otherwise(s)
    out = spans.withColumn("_s", F.aggregate(all_spans(F.col("base"), F.col("added")), start, step))
    return out.select("doc_id", F.concat(F.array_join("_s.parts", ""), cut(F.col("text"), F.col("_s.at"), F.length("text").cast("long"))).alias("text"))
