"""Column functions on texts.  Lengths are code points."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Budgets in code points.
OVERLAP, LEAST_CONTEXT = 800, 512
#: White space as Unicode has it.
BLANK = " \t\n\v\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FENCE = r"(?s)\A`{3,}(?:markdown|json)?[\t\n\f\r ]*(.*?)[\t\n\f\r ]*`{3,}\z"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def strip_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block, else the trimmed text."""
    t = trimmed(text)
    return F.when(t.rlike(FENCE), trimmed(F.regexp_extract(t, FENCE, 1))).otherwise(t)


def file_budget(num_ctx: int) -> int:
    return max(num_ctx, LEAST_CONTEXT) * 3  # three quarters of four code points a token


def overlap_of(limit: int) -> int:
    return min(OVERLAP, limit // 4)


def reduce_budget(num_ctx: int) -> int:
    return num_ctx * 3


def budgets(num_ctx: Column) -> tuple[Column, Column, Column]:
    """File budget, its overlap, and reduce budget, of a column of context sizes."""
    limit = F.greatest(num_ctx, F.lit(LEAST_CONTEXT)) * 3
    return limit, F.least(F.lit(OVERLAP), F.floor(limit / 4).cast("int")), num_ctx * 3


def n_chunks(text: Column, limit: int, overlap: int) -> Column:
    if limit <= 0 or overlap >= limit:
        raise ValueError("a chunk must be longer than its overlap")
    n = F.char_length(text)
    return F.when(n <= limit, 1).otherwise(F.ceil((n - limit) / (limit - overlap)) + 1).cast("int")


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once; a lambda works out again for each element what it refers to."""
    return F.element_at(F.transform(F.array(value), then), 1)


def chunks(text: Column, limit: int, overlap: int) -> Column:
    """Overlapping substrings, the last ending with the text; a short text is one chunk.

    A substring is found by counting code points from the beginning of what it is cut from, so a long text is cut into
    blocks of 4096 chunks, these into blocks of 64, and only those into chunks; 64 or fewer are cut at once.
    """
    step = limit - overlap

    def cut(piece: Column, count: Column, span: int) -> Column:
        """The first `count` chunks of piece, which has at most 64 x span of them."""
        if span == 1:
            return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(piece, i * step + 1, F.lit(limit)))
        block = lambda k: F.substring(piece, k * (span * step) + 1, F.lit(span * step + overlap))
        part = lambda k: _bound(block(k), lambda x: cut(x, F.least(F.lit(span), count - k * span), span // 64))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(count / span).cast("int") - 1), part))

    n = n_chunks(text, limit, overlap)
    return F.when(n == 1, F.array(text)).when(n <= 64, cut(text, n, 1)).otherwise(cut(text, n, 4096))


def steps_hash(steps: list[tuple[str, str]]) -> str:
    """Of the ordered steps; `<`, `>` and `&` are written as \\u escapes."""
    text = json.dumps([{"Name": n, "Prompt": p} for n, p in steps], ensure_ascii=False, separators=(",", ":"))
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return hashlib.sha256(text.encode()).hexdigest()


def steps_hash_column(steps: Column) -> Column:
    """The same of an array of (Name, Prompt)."""
    out = F.to_json(steps)
    for c in "<>&":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.sha2(out, 256)


def list_of(csv: Column) -> Column:
    """Comma-separated names; blank: null (keep what there is); clear or none: empty."""
    t = trimmed(csv)
    return F.when(t == "", F.lit(None)).when(F.lower(t).isin("clear", "none"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(t, ","), trimmed), lambda x: x != ""))


def or_default(value: Column, default: Column | str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def guidelines(content: Column, section: str, marker: str) -> Column:
    """content with the section appended unless it has the marker; two line breaks in between."""
    gap = F.when(content.endswith("\n\n"), "").when(content.endswith("\n"), "\n").otherwise("\n\n")
    return F.when(content.isNull(), section).when(content.contains(marker), content).otherwise(F.concat(content, gap, F.lit(section)))


def chat_request(model: str, system: Column, messages: Column, num_ctx: int = 0, as_json: bool = False) -> Column:
    """JSON of a chat request; messages: array of (role, content)."""
    first = F.struct(F.lit("system").alias("role"), system.alias("content"))
    parts = [F.lit(model).alias("model"), F.concat(F.array(first), messages).alias("messages"), F.lit(False).alias("stream")]
    if as_json:
        parts.append(F.lit("json").alias("format"))
    options = F.struct(F.lit(num_ctx).alias("num_ctx")) if num_ctx else F.from_json(F.lit("{}"), "num_ctx int")
    return F.to_json(F.struct(*parts, options.alias("options")))


def chat_reply(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.message.content"), F.lit(""))
