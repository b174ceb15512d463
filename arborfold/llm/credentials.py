"""Secret scans: fixed patterns, and weak candidates that count only beside the other parts of a credential.

Main path in DataFrame functions only.

Patterns (kinds assign, access, hex) are found leftmost and without overlap, each kind by itself; a match that fails
its length is dropped and not tried again.  They are written with possessive loops and look-behinds that leave the
matches as they are.

The method, multipart linking: a credential has an identifier, a secret and often an endpoint.  Parts are

    strong   access (identifier), assign and hex (secret): always reported
    id       `user = ...`, `client_id: ...` and the like; an access match that is too short
    key      an assign match with a value of 4 to 7 characters, hex of 16 to 31, a token of 20 or more characters with
             both cases and a digit that stands by itself
    endpoint a URL, or `host = ...` and the like

The scope of a part is what lies within `reach` code points of it.  A weak part is reported if its scope holds a
strong secret (for id and endpoint) or a strong identifier (for key), or parts of both other roles, weak ones
included.  So a secret always takes part.

Scopes are joined with parts by interval: a part stands in each cell of `reach` code points that it touches, a cell
keeps for each role the greatest end and the least start, and a scope looks at its cells.  No scope lies with both of
its ends in one cell, so these two decide whether a part meets it, exactly, and no pairs are made: rows are in
proportion to the parts, also in a text full of them.

Defined cases: null text counts as empty and gives zeros and the digest of the empty string; each repeated row is
returned, with its own spans; null doc_id is kept; ties in a span's start are ordered by kind; empty tables give empty
results; other columns are ignored, whatever their names; a text is matched whole, as one row of its task, and its
parts are spread over tasks by cell; only the spans of one text come together again, in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import saved
from arborfold.llm.pii import _starts, bound

_GIVEN = r"""["']?+\x20*+[:=]\x20*+["']?+"""
#: Kinds in their order.
PATTERNS = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){_GIVEN}[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
    "id": rf"(?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?){_GIVEN}[A-Za-z0-9+/_.@=-]++",
    "key": r"(?<![A-Za-z0-9+/_.:@%&?#~=-])[A-Za-z0-9+/_=-]{20,}+(?![.:]*+[A-Za-z0-9+/_@%&?#~=-])",
    "endpoint": rf"""(?i:(?:https?|ftp|ssh|s3|gs|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ldaps?)://|(?:host(?:name)?|endpoint|server|url){_GIVEN})[^\x00-\x20"'<>,;]++""",
}
BASE = ("assign", "access", "hex")
ORDER = list(PATTERNS)
#: Roles: what completes what.
ROLES = {"id": ("access", "id"), "key": ("assign", "hex", "key"), "endpoint": ("endpoint",)}
_SPANS = "array<struct<start: bigint, rank: int, end: bigint, kind: string, match: string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _spans(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern with code point offsets; most texts have none and cost one scan."""
    pattern = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    found = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda got: bound(gaps, lambda between: _starts(got, between)))
    return F.when(text.rlike(pattern), F.transform(found, lambda x: _span(x["start"], x["match"], kind))).otherwise(_none())


def _span(start: Column, match: Column, kind: str) -> Column:
    return F.struct(start.alias("start"), F.lit(ORDER.index(kind)).alias("rank"), (start + F.length(match)).alias("end"), F.lit(kind).alias("kind"), match.alias("match"))


def _as(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: _span(x["start"], x["match"], kind))


def _value(match: Column) -> Column:
    """Length of what an assignment assigns."""
    return F.length(F.regexp_replace(match, f"^(?i:password|passwd|secret|token|api_?key){_GIVEN}", ""))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, base, weak): arrays of spans.  weak is empty unless the text has a secret and another part."""
    size = lambda *names: sum((F.size(n) for n in names), F.lit(0))
    text = F.col("text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumns({f"_{k}": _spans(text, k) for k in BASE})
    base = F.concat(F.filter("_assign", lambda x: _value(x["match"]) >= 8), F.filter("_access", lambda x: F.length(x["match"]) >= 16), F.filter("_hex", lambda x: F.length(x["match"]) >= 32))
    short = F.concat(F.filter("_assign", lambda x: _value(x["match"]).between(4, 7)), F.filter("_hex", lambda x: F.length(x["match"]) < 32))
    out = out.withColumns({"base": F.array_sort(base), "_short": _as(short, "key"), "_ids": _as(F.filter("_access", lambda x: F.length(x["match"]) < 16), "id")})
    has_key = (size("base", "_short") > 0) | text.rlike(PATTERNS["key"])
    out = out.withColumn("_others", F.when(has_key, F.concat(_spans(text, "id"), _spans(text, "endpoint"))).otherwise(_none()))
    mixed = lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[a-z]") & x["match"].rlike("[A-Z]")
    out = out.withColumn("_tokens", F.when(size("_others", "_access") > 0, F.filter(_spans(text, "key"), mixed)).otherwise(_none()))
    keys = (size("_short", "_tokens") > 0) | F.exists("base", lambda x: x["kind"] != "access")
    weak = F.when(keys & (size("_others", "_access") > 0), F.concat("_short", "_tokens", "_ids", "_others")).otherwise(_none())
    return out.select("doc_id", "base", weak.alias("weak"))


def _cells(lo: Column, hi: Column, reach: int) -> Column:
    """The cells of [lo, hi), which is not empty."""
    return F.explode(F.sequence(F.floor(lo / reach), F.floor((hi - 1) / reach)))


def linked(found: DataFrame, reach: int) -> DataFrame:
    """(row, added): the weak spans with complementary parts in their scope, of rows (row, base, weak)."""
    each = found.filter(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("x")).select("row", "x.*")
    role = lambda name: F.col("kind").isin(*ROLES[name])
    strong = F.col("kind").isin(*BASE)
    seen = {name: role(name) for name in ROLES} | {f"strong_{name}": role(name) & strong for name in ("id", "key")}
    cells = each.withColumn("cell", _cells(F.col("start"), F.col("end"), reach)).groupBy("row", "cell")
    cells = cells.agg(*(F.max(F.when(c, F.col("end"))).alias(f"{n}_end") for n, c in seen.items()), *(F.min(F.when(c, F.col("start"))).alias(f"{n}_start") for n, c in seen.items()))
    scopes = each.filter(~strong).withColumns({"lo": F.greatest(F.col("start") - reach, F.lit(0)), "hi": F.col("end") + reach})
    met = scopes.withColumn("cell", _cells(F.col("lo"), F.col("hi"), reach)).join(cells, ["row", "cell"])
    inside = lambda n: F.max((F.col(f"{n}_end") > F.col("lo")) & (F.col(f"{n}_start") < F.col("hi")))
    met = met.groupBy("row", "start", "rank", "end", "kind", "match").agg(*(F.coalesce(inside(n), F.lit(False)).alias(f"has_{n}") for n in seen))
    id_, key, endpoint = (F.col(f"has_{n}") for n in ROLES)
    told = F.when(F.col("kind") == "key", F.col("has_strong_id") | (id_ & endpoint)).when(F.col("kind") == "id", F.col("has_strong_key") | (key & endpoint)).otherwise(F.col("has_strong_key") | (key & id_))
    return met.filter(told).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "match"))).alias("added"))


def secret_spans(docs: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, base, added) for each row of docs (doc_id, text): arrays of (start, rank, end, kind, match)."""
    # texts are read once; what was found is small, and a row's number is fixed as it is written
    found = saved(parts(docs).withColumn("row", F.monotonically_increasing_id()))
    some = found.filter(F.size("weak") > 0).select("doc_id", "base", "row").join(linked(found, reach), "row", "left")
    rest = found.filter(F.size("weak") == 0).select("doc_id", "base", _none().alias("added"))
    return rest.union(some.select("doc_id", "base", F.coalesce("added", _none())))
