"""Benchmark decontamination by template canonicalisation.

In benchmark items and documents alike numbers, names and units become typed placeholders; other words are lower-cased
without outer punctuation.  Windows of `window` such tokens with at least `literals` words that stayed words are
hash-joined as tables: the windows of the items against every window of every document.  A filter of fixed size, one bit
for each item window's hash, leaves out nearly all windows of the documents before they leave their task; the others
are joined by an exchange, salted so that a window of very many documents is dealt out.

Windows with fewer such words are joined too, but by their lower-cased words and values as they stand, signs between
them included; so is an item's first window, whose first word is a name or not by what stands before it.  So verbatim
copies are found whatever an item is made of.  Each character of a script without spaces is a token of its own.

Joined windows of one item at one distance form an alignment.  Its slots must be consistent: a value of the item
stands for one value in the document and the other way round, but for a fifth of the slots at most.  So a question
asked again with other numbers is found, and a table of numbers that happens to fit is not.  A document is
contaminated by an item if consistent alignments cover `covered` of the item's tokens.

Defined cases: null or empty text matches nothing; items shorter than a window make one window of their own length, be it
one word, which each document with that word then holds; an item of signs only matches nothing; an item that repeats
counts once; repeated rows are each reported; null doc_id or item_id is kept; of equal windows all alignments are judged;
a long text is one piece of its task's work, with some 100 bytes of memory for each of its words; empty tables give no
rows; other columns are ignored by contaminated() and returned as they are, whatever their names, by decontaminated().
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import chunks, grams, mix, saved, without

# Unit words.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons ml l liter liters litre litres gallon gallons "
    "second seconds sec s minute minutes min hour hours hr hrs h day days week weeks month months year years percent % dollar dollars cent cents euro euros usd eur mph kmh km/h hz khz mhz ghz kb mb gb tb".split()
)
_ATTACHED = re.compile(r"(\d)(%|[a-zA-Z]{1,5}\b)")
#: Kana, Han, Thai, Lao, Myanmar and Khmer.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_OUTER = ".,;:!?\"'()[]{}<>*#$&%|~`_-–—…«»“”‘’/\\"
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3


def _apart(m: re.Match) -> str:
    return f"{m[1]} {m[2]}" if m[2].lower() in UNITS else m[0]


class Words(dict):
    """Raw word to a number; arrays by number hold its token at a sentence's start and within."""

    def __init__(self) -> None:
        super().__init__()
        self.start: list[int] = []
        self.mid: list[int] = []
        self.ends: list[bool] = []
        self.kind: list[int] = []  # at a sentence's start a name is a literal
        self.value: list[str] = []
        self.exact: list[int] = []  # of the word without outer signs, or of the sign

    def __missing__(self, raw: str) -> int:
        core = raw.strip(_OUTER) if raw != "%" else "%"
        lower = core.lower()
        kind = UNIT if lower in UNITS else NUMBER if any(c.isdigit() for c in core) else NAME if core[:1].isupper() and len(core) > 1 else LITERAL
        own = hash_word(lower)
        self.start.append(own if kind in (LITERAL, NAME) else kind)
        self.mid.append(own if kind == LITERAL else kind)
        self.ends.append(raw[-1:] in ".!?:")
        self.kind.append(kind if core else -1)
        self.value.append(lower)
        self.exact.append(own if core else hash_word(raw))
        n = self[raw] = len(self)
        return n


def hash_word(word: str) -> int:
    """64 bits, the same in every process; never a placeholder's number."""
    import xxhash

    return xxhash.xxh64_intdigest(word) | 8


def _split(text: str) -> list[str]:
    text = _ATTACHED.sub(_apart, text)
    return (text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)).split()


def canonical(texts: list[str], known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts together: token hashes, kinds, raw word numbers, each text's first token (one more at the end), and exact hashes without and with the signs before a token."""
    if len(known) > 300_000:
        known.clear()
        for x in (known.start, known.mid, known.ends, known.kind, known.value, known.exact):
            x.clear()
    ids, lengths = [], []
    for t in texts:
        w = list(map(known.__getitem__, _split(t or "")))
        ids += w
        lengths.append(len(w))
    ids = np.array(ids, np.int64)
    start, mid, ends, kind = np.array(known.start, np.uint64), np.array(known.mid, np.uint64), np.array(known.ends, bool), np.array(known.kind, np.int8)
    first = np.cumsum([0, *lengths])
    opens = np.ones(len(ids), bool)
    if len(ids):
        opens[1:] = ends[ids[:-1]]
        opens[first[:-1][first[:-1] < len(ids)]] = True
    k = kind[ids] if len(ids) else np.zeros(0, np.int8)
    h = np.where(opens, start[ids], mid[ids]) if len(ids) else np.zeros(0, np.uint64)
    k = np.where(opens & (k == NAME), LITERAL, k)
    keep = k >= 0
    exact = np.array(known.exact, np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
    signs = np.diff(np.cumsum(np.where(keep, np.uint64(0), mix(exact)))[keep], prepend=np.uint64(0))
    exact = exact[keep]
    return h[keep], k[keep], ids[keep], np.concatenate([[0], np.cumsum(keep)])[first], exact, exact + mix(signs)


def exact_grams(exact: np.ndarray, signed: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` tokens from each position as they stand; signs before the first are not of it."""
    n = max(0, len(exact) - size + 1)
    rest = grams(signed[1:], size - 1)[:n] if size > 1 else np.uint64(0)
    return mix(exact[:n] + mix(rest + np.full(n, size, np.uint64)))


_SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())]))
ITEM_WINDOWS = "hash long, size int, as_is boolean, j int, item long, item_id long, length int, slots array<struct<at: int, value: string>>"
CANDIDATES = "doc_id long, th long, p int, size int, as_is boolean, hash long, words array<string>"
#: Bits of the filter of the items' windows: what goes to executors is 4 MB, whatever the benchmark's size.
FILTER_BITS = 1 << 25
_PAGE = 1 << 15
SALT = 16


def _item_windows(window: int, literals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                h, k, ids, _, exact, signed = canonical([text or ""], known)
                size = min(window, len(h))
                if not size:
                    continue
                words = np.concatenate([[0], np.cumsum(k == LITERAL)])
                slots = [(i, {"at": i, "value": known.value[ids[i]]}) for i in np.flatnonzero(k > 0).tolist()]
                for j, (g, e) in enumerate(zip(grams(h, size).view(np.int64).tolist(), exact_grams(exact, signed, size).view(np.int64).tolist(), strict=True)):
                    rich = words[j + size] - words[j] >= literals
                    for as_is, hashed in ((False, g),) * bool(rich) + ((True, e),) * (not rich or j == 0):
                        for col, x in zip(cols, (hashed, size, as_is, j, item, item_id, len(h), [x for i, x in slots if j <= i < j + size]), strict=True):
                            col.append(x)
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), _SLOTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["hash", "size", "as_is", "j", "item", "item_id", "length", "slots"])

    return run


def _candidates(bits, sizes: list[tuple[int, bool]]):
    """The documents' windows that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Words(), bits.value
        mask = np.uint64(8 * len(table) - 1)
        for rows, data, off in chunks(batches):
            h, _, ids, first, exact, signed = canonical(_texts(data, off), known)
            for size, as_is in sizes:
                g = exact_grams(exact, signed, size) if as_is else grams(h, size)
                at = g & mask
                p = np.flatnonzero(table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                doc = np.searchsorted(first, p, "right") - 1
                inside = p + size <= first[doc + 1]
                p, doc = p[inside], doc[inside]
                for i in range(0, len(p), 10_000):
                    q, d = p[i : i + 10_000], doc[i : i + 10_000]
                    words = [known.value[x] for x in ids[(q[:, None] + np.arange(size)).ravel()].tolist()]
                    take = pa.array(d)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * size), pa.array(words, pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id").take(take), rows.column("th").take(take), pa.array((q - first[d]).astype(np.int32)), pa.array(np.full(len(q), size, np.int32)), pa.array([as_is] * len(q)), pa.array(g[q].view(np.int64)), lists],
                        names=["doc_id", "th", "p", "size", "as_is", "hash", "words"],
                    )

    return run


def _judge(covered: float):
    """Rows of a document and an item with all the windows they share: those whose alignments are consistent and cover enough."""
    names = ["doc_id", "th", "times", "item_id", "covered", "first_token", "last_token"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                by_shift = defaultdict(list)
                for w in x["windows"]:
                    by_shift[w["p"] - w["j"]].append(w)
                share: set[int] = set()
                a, b = 1 << 62, -1
                for shift, spans in by_shift.items():
                    # windows as they stand count by themselves if the rest contradicts them, and the other way round
                    for part in (spans, [w for w in spans if w["as_is"]], [w for w in spans if not w["as_is"]]):
                        said = {w["j"] + i: v for w in part for i, v in enumerate(w["words"])}
                        if said and consistent([(v, said[i]) for i, v in sorted({(y["at"], y["value"]) for w in part for y in w["slots"]})]):
                            share.update(said)
                            a, b = min(a, shift + min(said)), max(b, shift + max(said))
                            break
                if share and len(share) >= covered * x["length"]:
                    out.append((x["doc_id"], x["th"], x["times"], x["item_id"], len(share) / x["length"], a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

    return run


def consistent(slots: list[tuple[str, str]], spare: float = 0.2) -> bool:
    there, back, odd = {}, {}, 0
    for a, b in slots:
        odd += there.setdefault(a, b) != b or back.setdefault(b, a) != a
    return odd <= spare * len(slots)


def _texts(data: np.ndarray, off: np.ndarray) -> list[str]:
    whole, at = data.tobytes(), off.tolist()
    return [whole[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]


def _filter_of(windows: DataFrame) -> np.ndarray:
    """One bit for the low bits of each window's hash."""
    at = windows.select(F.col("hash").bitwiseAND(FILTER_BITS - 1).alias("at"))
    pages = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(_PAGE - 1)).alias("bits"))
    out = np.zeros(max(FILTER_BITS, _PAGE) // 8, np.uint8)
    for r in pages.collect():  # at most FILTER_BITS / 8 bytes
        out[r.page * _PAGE // 8 : (r.page + 1) * _PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    return out[: FILTER_BITS // 8]


def _found(docs: DataFrame, benchmark: DataFrame, window: int, literals: int, covered: float) -> DataFrame:
    """(doc_id, th, times, item_id, covered, first_token, last_token) for the different rows of docs."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item", "item_id"])
    windows = saved(items.mapInArrow(_item_windows(window, literals), ITEM_WINDOWS))
    sizes = [(r.size, r.as_is) for r in windows.select("size", "as_is").distinct().collect()]  # at most two for each size
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(windows))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    told = saved(docs.mapInArrow(_candidates(bits, sizes), CANDIDATES))
    bits.destroy()
    told = told.groupBy("doc_id", "th", "p", "size", "as_is", "hash").agg(F.count("*").alias("times"), F.min("words").alias("words"))
    # a window that a third of all documents hold is dealt to several tasks
    told = told.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALT).cast("long")))
    spread = windows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    met = told.join(spread, ["hash", "size", "as_is", "salt"])
    met = met.groupBy("doc_id", "th", "item", "item_id", "length").agg(F.max("times").alias("times"), F.collect_list(F.struct("j", "p", "as_is", "words", "slots")).alias("windows"))
    return met.mapInArrow(_judge(covered), "doc_id long, th long, times long, item_id long, covered double, first_token long, last_token long")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 4, covered: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered, first_token, last_token): the documents that hold an item, and where."""
    found = _found(docs, benchmark, window, literals, covered).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.select("doc_id", "item_id", "covered", "first_token", "last_token")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 4, covered: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that hold no item; only rows that go, and few others, are exchanged."""
    bad = saved(_found(docs, benchmark, window, literals, covered).select(F.struct("doc_id", "th").alias("key")).distinct())
    return without(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")), bad)
