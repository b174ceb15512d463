"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborfold.llm import _shared, chat, decontam, jaccard, mixing, packing, pii, quality, queries, substring, tokens, topk

SPACE = r"[^\x20\x09-\x0D]+"
#: Extra columns whose names operators use themselves.
CLASH = ["th", "node", "token", "n", "bits", "_h", "copies", "block", "base"]


def table(spark, rows, schema="doc_id long, text string, lang string, source string"):
    df = spark.createDataFrame(rows, schema)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(30)]
    out = []
    for k, t in enumerate(base):
        w = t.split()
        out.append(t)
        out.append(" ".join(w[:3] + ["changed"] + w[4:]).upper() if k % 3 == 0 else prose(rng, 10) + "\n" + " ".join(w[5:60]) + "\t" + prose(rng, 7))
        if k % 7 == 0:
            out += [t, t + " end", " ".join(w[:-1])]
    line = prose(rng, 40)
    out += [line + " " + prose(rng, 20) for _ in range(20)]
    out += [None, "", "  \n\t ", "one", "one", "a b c", "A b\tC", "x " * 300, "wörd  two\x0bthree\x0cfour five six", prose(rng, 6000), "<|endoftext|> don't <|startoftext|>", " a b c"]
    docs = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4]) for i, t in enumerate(out)]
    return docs + [docs[0], docs[0], (docs[1][0], "another text " * 5, "en", "s0"), (None, "no id here", "en", "s1")]


def empty(spark):
    return table(spark, [])


# ---- 1


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_model(x):
    out = []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for rank, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or (k == "ip" and all(int(q) <= 255 for q in m[0].split("."))) or (k == "card" and 12 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), rank, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii(spark):
    rng = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "999.1.1.1", "4785380592391139", "4785 3805 9239-1139", "+49 (30) 123456-78", "+1", " ", "é😀", "-", "7", "%", "\n", "secretterm"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(150)]
    texts += ["5000000007.1.1.1", "0.0.0.0", "000000000000255.1.02.3", "256.1.1.1", "1.1.1.0000000000000000000000256", "4294967297.1.1.1", "1000.1.1.1 255.255.255.255", "0000.00.0.1"]
    texts += [None, "", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "4785380592391139 " * 700, "x" * 5000, *["known secretterm joe@corp.org"] * 4, *[f"filler words number {i}" for i in range(60)]]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s"), (None, "1.2.3.4", "en", "s")])
    spans = pii.sanitised_spans(docs)
    got = spans.select("doc_id", pii.label(F.col("base")).alias("b"), pii.label(pii.all_spans(F.col("base"), F.col("added"))).alias("s")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert r.b == base_model(texts[r.doc_id] or ""), texts[r.doc_id]
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    i = texts.index("known secretterm joe@corp.org")
    assert {r.s for r in got if r.doc_id == i} != {base_model(texts[i])}  # the term that never comes without the address
    assert "joe@corp.org" not in pii.sanitise(spans).filter(f"doc_id = {i}").first().text
    assert pii.sanitised_spans(empty(spark)).count() == 0


def test_pii_offsets_of_a_long_text(spark):
    sizes = [0, 1, 31, 32, 33, 1023, 1024, 1025, 40_000]
    rows = spark.createDataFrame([([7 * i % 11 for i in range(n)],) for n in sizes], "a array<bigint>")
    for a, sums in rows.select("a", pii.running(F.col("a"))).collect():
        assert sums == [sum(a[:i]) for i in range(len(a))] if len(a) < 2000 else sums[-1] == sum(a[:-1])
    text = "\u00e9t\u00e9 " + "alpha, joe@corp.org  beta " * 30_000
    kind = pii.base_spans(spark.createDataFrame([(0, text)], "doc_id long, text string"))
    found = kind.withColumn("gone", F.create_map(F.lit("beta"), F.lit(True), F.lit("corp"), F.lit(False)))
    found = found.select("base", pii._occurrences(F.col("text"), F.array().cast(kind.schema["base"].dataType), F.col("gone")).alias("all")).first()
    assert [(x.start, x.end) for x in found.base] == [m.span() for m in re.finditer(r"joe@corp\.org", text)]
    assert [(x.start, x.end, x.kind) for x in found.all] == [(*m.span(), "gone" if m[0] == "beta" else "term") for m in re.finditer(r"\b(?:beta|corp)\b", text)]


def test_pii_terms_of_the_whole_document_and_in_all_documents(spark):
    far = "filler words that keep both a good distance apart " * 3
    texts = [f"secretterm {far} {k} joe@corp.org {far} Secretterm" for k in range(4)] + [f"{far} number {k}" for k in range(200)] + ["x joe@corp.org", "secretterm alone"]
    spans = pii.sanitised_spans(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), generalise=0.8)
    got = {r.doc_id: sorted((x.start, x.end) for x in r.added) for r in spans.collect()}
    for i, t in enumerate(texts):
        assert got[i] == [m.span() for m in re.finditer("secretterm", t, re.I)]


# ---- 2


def fill(kids, budget):
    """kids: name -> (capacity, weight)"""
    kids, out = {k: v for k, v in kids.items() if v[0] and v[1]}, {}
    while kids:
        w = sum(x[1] for x in kids.values())
        over = {k: c for k, (c, x) in kids.items() if c * w <= x * budget}
        if not over:
            break
        k = min(over, key=lambda k: over[k] / kids[k][1])
        out[k] = kids.pop(k)[0]
        budget -= out[k]
    return out, kids, budget


def test_mixing(spark, rows):
    docs = table(spark, rows)
    path = {"lang": F.col("lang"), "source": F.col("source")}
    for share, epochs, weights in (((1, 2), 1, {}), ((9, 10), 3, {("en",): 5, ("de", "s1"): 0})):
        got = mixing.mix_sources(docs, weights, share, epochs, 1, path).collect()
        avail, took = Counter(), Counter()
        for _, t, lang, source in rows:
            avail[lang or "", source or ""] += len(re.findall(SPACE, t or ""))
        for r in got:
            took[r.lang, r.source] += r.n_tokens * r.copies
            assert r.copies <= epochs
        budget = sum(avail.values()) * share[0] // share[1]
        usable = {k: v for k, v in avail.items() if weights.get(k, 1)}
        langs = {a: (sum(v for (x, _), v in avail.items() if x == a) * epochs, weights.get((a,), 1)) for a, _ in avail}
        full, rest, left = fill(langs, budget)
        longest = max(len((t or "").split()) for _, t, *_ in rows)
        for a in langs:
            want = full.get(a, 0) or left * rest[a][1] / sum(x[1] for x in rest.values())
            want = min(want, sum(v for (x, _), v in usable.items() if x == a) * epochs)
            have = sum(v for (x, _), v in took.items() if x == a)
            assert want - 4 * longest <= have <= want + 1
        assert sum(took.values()) <= budget
    again = mixing.mix_sources(docs, {}, (1, 2), 1, 1, path).count()
    assert mixing.mixed_documents(docs, {}, (1, 2), 1, 1, path).count() == again
    odd = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in ("_h", "_tokens", "_epochs", "_copies", "_row", "_key", "_tie", "key", "_lang", "_n")})
    for epochs in (1, 3):
        mixed = mixing.mixed_documents(odd, {("en",): 5}, (9, 10), epochs, 1, path)
        assert mixed.columns == odd.columns
        chosen = Counter()
        for r in mixing.mix_sources(docs, {("en",): 5}, (9, 10), epochs, 1, path).collect():
            chosen[r.doc_id] += r.copies
        mixed = mixed.collect()
        assert Counter(r.doc_id for r in mixed) == chosen
        assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in mixed for c in odd.columns[len(docs.columns) :])
    assert mixing.mix_sources(empty(spark)).count() == 0


# ---- 3


def test_substrings(spark, rows):
    seen, texts = Counter(), [re.findall(SPACE, t or "") for _, t, *_ in rows]
    for w in texts:
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        off = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                off[k : k + 35] = [True] * 35
        kept = " ".join(x for x, y in zip(w, off, strict=True) if not y)
        want.append((doc_id, len(w), sum(off), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.repeated_substrings(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    full = substring.without_repeats(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in full) == Counter(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in full)
    assert substring.repeated_substrings(empty(spark)).count() == 0


def test_substrings_of_rows_without_id(spark):
    """Texts of one id that meet in 32 bits are different rows, whatever they have removed."""
    rng = random.Random(12)
    passage = prose(rng, 60).split()
    said = " ".join(passage[:40])
    both = [F.concat(F.lit(f"{said} n"), "id"), F.concat(F.lit("n"), "id", F.lit(f" {said} {said}"))]
    many = spark.range(200_000).select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), t.alias("t"), F.hash(t).alias("h")) for i, t in enumerate(both)))).alias("x")).select("x.*")
    pair = many.groupBy("h").agg(F.min(F.when(F.col("i") == 0, F.col("t"))).alias("a"), F.min(F.when(F.col("i") == 1, F.col("t"))).alias("b")).filter("a is not null and b is not null").first()
    rows = [(None, pair.a), (None, pair.b), (None, None), (None, ""), (7, f"{said} x"), (None, " ".join(passage))]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.repeated_substrings(table(spark, [(i, t, "en", "s") for i, t in rows])).collect())
    assert got == Counter([(None, 41, 40), (None, 81, 80), (None, 0, 0), (None, 0, 0), (7, 41, 40), (None, 60, 40)])


# ---- 4, 7


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return lambda name: tokenizers.Tokenizer.from_file(tokens.default_path(name))


def test_counts(spark, rows, library):
    t = library("word_bpe_49k.json")
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False)), len(t.encode(x or "", add_special_tokens=False)) > 2048) for i, x, *_ in rows)
    assert Counter(map(tuple, tokens.token_counts(table(spark, rows)).collect())) == want
    assert tokens.token_counts(empty(spark)).count() == 0


def test_long_texts_in_pieces(library):
    rng = random.Random(14)
    texts = ["".join(rng.choice([" ", "  ", "\n", "a", "don't", "é", "“", "\u00a0", "\u3000", "12", ".", "word"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    data, off = _shared.as_bytes(pa.array(texts))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        e = tokens.Encoder(tokens.default_path(name))
        got = [[] for _ in texts]
        parts, owner = tokens.pieces(data, off, e.cuts, 5)
        for i, ids in zip(owner.tolist(), e.ids(parts), strict=True):
            got[i] += ids
        assert len(parts) > len(texts) and got == e.ids(texts)


def test_batches_by_bytes():
    pieces = {bytes([97 + i % 26]) * (i + 1) for i in range(500)}
    got = list(tokens.batches_by_bytes(pieces, 4000))
    assert set().union(*got) == pieces and all(sum(len(p) + 16 for p in b[:-1]) < 4000 for b in got)


def test_packing(spark, rows, library):
    t = library("byte_bpe_50k.json")
    t.encode_special_tokens = True
    packed = packing.pack_tokens(table(spark, rows), row=64).cache()
    parts = defaultdict(list)
    for r in packing.unpack(packed, 64).collect():
        parts[r.doc_id].append((r.doc_length, r.doc_offset, np.frombuffer(bytes(r.ids), "<u2").tolist()))
    for i, x, *_ in rows[:-4]:
        if i > 1:
            p = sorted(parts[i])
            assert sum((s[2] for s in p), []) == [*t.encode(x or "", add_special_tokens=False).ids, 50256]
            assert [s[1] for s in p] == list(range(0, p[0][0], 64))
    for r in packed.collect():
        assert len(r.ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.resets == r.cu_seqlens[:-1]
    assert sum(r.n_tokens for r in packed.collect()) / (64 * packed.count()) > 0.9
    assert packing.pack_tokens(empty(spark)).count() == 0


def test_best_fit():
    rng = random.Random(4)
    n = [rng.randrange(1, 51) for _ in range(400)]
    free, want = [], 0  # the model: the fullest row that still takes it
    for x in sorted(n, reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - x)
        else:
            free.append(50 - x)
            want += 1
    got = packing.best_fit(n, 50)
    assert len(got) == want and sorted(k for r in got for k in r) == list(range(400)) and all(sum(n[k] for k in r) <= 50 for r in got)


# ---- 5


def test_chat(spark):
    rng = random.Random(6)
    bits = ["<", "|", "\\", "<|im_end|>", "<|im_start|>assistant", "<\\|", "é😀", "\n", "a", "n"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    turns = [(c, t, rng.choice(["user", "assistant", "sys\ntem\\n<|"]), text()) for c in range(40) for t in range(rng.randrange(1, 9))]
    turns += [(99, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(300)] + [(100, None, None, None), (100, 1, "assistant", None), (None, 0, "user", "x"), (99, 5, "assistant", "turn 5"), (101, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("data", F.lit(1)).withColumn("part", F.lit(2))
    formatted = chat.format_chats(df).cache()
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, x in turns:
        by[c].append((-1 if t is None else t, role or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    data = sorted((r.block, r.part, bytes(r.data)) for r in formatted.filter("conv_id = 99").collect())
    assert len(data) > 3 and b"".join(x[2] for x in data).startswith(b"<|im_start|>user\nturn 0<|im_end|>\n")
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# ---- 6


def test_top(spark):
    rng = np.random.default_rng(7)
    v = [(i, [float(x) for x in np.round(rng.normal(size=20), 1 + i % 2)]) for i in range(400)]
    v[7] = (7, None)
    v[8] = (8, [float("nan")] * 20)
    v[9] = (9, [None, 1.0])
    v[10] = (10, [1.0, 2.0])
    v += [v[50], v[60], v[60], (100, v[3][1]), (3, v[4][1]), (None, [1.0]), (401, []), (402, [1e30] + [0.0] * 19)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("e", F.lit(1)).withColumn("block", F.lit(1))
    floor = lambda x: max(-(2**63), min(2**63 - 1, math.floor(x * 256)))  # noqa: E731  components saturate, sums wrap
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    ok = [(i, [int(float(floor(x))) for x in e]) for i, e in v if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = Counter()
    for k, (q, x) in enumerate(ok):
        if q % 50 == 0 and q != 400:
            s = sorted((-wrap(sum(a * b for a, b in zip(x, e, strict=False))), i) for j, (i, e) in enumerate(ok) if j != k and i != 402)[:5]
            want.update((q, r + 1, i, -y) for r, (y, i) in enumerate(s))
    small = df.filter("vec_id <> 402 or vec_id is null")
    assert Counter(map(tuple, topk.top_inner_products(small, block=64, queries=4, step=8).collect())) == want
    huge = topk.top_inner_products(df, block=64, queries=4, step=8).filter("query_id = 0").collect()
    assert len(huge) == 5
    assert topk.top_inner_products(df.limit(0)).count() == 0
    assert topk.top_inner_products(df.filter("vec_id = 150")).count() == 0
    assert [tuple(r) for r in topk.top_inner_products(df.filter("vec_id = 50")).collect()] == [(50, 1, 50, sum(floor(x) ** 2 for x in v[50][1]))] * 2


# ---- 8


@pytest.mark.parametrize("bits", [1 << 25, 1 << 15])
def test_decontamination(spark, monkeypatch, bits):
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    plain = " ".join(word() for _ in range(30))
    story = "A farmer named Alice has 12 apples and gives Bob 5 of them before walking 3 km to the old market where she buys 12 pears"
    again = story.replace("Alice", "Chloe").replace("Bob", "Dan").replace("12", "40").replace(" 5 ", " 7 ").replace("3 km", "9miles")
    torn = story.replace("12 apples", "40 apples").replace("12 pears", "41 pears").replace("gives Bob 5", "gives Bob 12").replace("3 km", "12 kg")
    bench = spark.createDataFrame([(1, plain), (2, story), (3, None), (4, ""), (5, "too short"), (None, " ".join(word() for _ in range(12)))], "item_id long, text string").withColumn("x", F.lit(1))
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, filler(50) + ". " + plain + " " + filler(9)), (2, filler(20) + ". " + again), (3, torn), (4, filler(100)), (5, None), (6, ""), (7, " ".join(plain.split()[:8])), (8, plain), (8, plain), (9, "1 2 3 4 5 6 7 8 9 " * 30), (None, plain), (10, filler(30_000) + " " + plain)]
    df = table(spark, [(i, t, "en", "s") for i, t in docs])
    got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(df, bench.union(bench)).collect())
    assert got == Counter({(1, 1): 1, (2, 2): 1, (8, 1): 2, (None, 1): 1, (10, 1): 1})
    kept = decontam.decontaminated(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 9] and kept.columns == df.columns
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(empty(spark), bench).count() == 0


def test_decontamination_finds_verbatim_copies_of_any_item(spark):
    items = ["12 + 7 = 19, 20 - 4 = 16, 3 * 5 = 15", "The Old Man And The Sea By Ernest Hemingway Of Oak Park", "WHAT IS THE CAPITAL CITY OF NEW ZEALAND TODAY", "Name it", "今天天气很好我们一起去公园散步吧", "日本の首都", "Paris is the capital of France", "7 + 5"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(i, f"some words before it {x} and others after", "en", "s") for i, x in enumerate(items)]
    docs[4] = (4, "他说" + items[4] + "然后走了", "zh", "s")
    docs[5] = (5, "問い" + items[5] + "は", "ja", "s")
    docs += [(10, "12 - 7 = 19, 20 + 4 = 16, 3 / 5 = 15", "en", "s"), (11, "7 - 5 and 5 + 7 and 7 5", "en", "s"), (12, "The New Boy And The Lake By Someone Else Of Elm Street", "en", "s"), (13, "今天他们没有去公园", "zh", "s")]
    df = table(spark, docs)
    got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect())
    assert got == Counter({(i, i): 1 for i in range(len(items))})
    assert sorted(r.doc_id for r in decontam.decontaminated(df, bench).collect()) == [10, 11, 12, 13]


def test_decontamination_by_brute_force(spark):
    """All documents of a table against all items, window by window, with tokens and their classes told apart here."""
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    outer = decontam._OUTER

    def tokens_of(text):
        out, opens = [], True
        for raw in re.sub(r"(\d)(%|[a-zA-Z]{1,5}\b)", lambda m: f"{m[1]} {m[2]}" if m[2].lower() in decontam.UNITS else m[0], text or "").split():
            core = raw.strip(outer) if raw != "%" else "%"
            low = core.lower()
            kind = "U" if low in decontam.UNITS else "#" if any(c.isdigit() for c in core) else "N" if core[:1].isupper() and len(core) > 1 and not opens else ""
            if core:
                out.append((kind or low, low, kind != ""))
            opens = raw[-1:] in ".!?:"
        return out

    items = [(r.item_id, tokens_of(r.text)) for r in bench]
    assert all(len(t) >= 8 for _, t in items)
    index = defaultdict(list)
    for n, (_, t) in enumerate(items):
        for j in range(len(t) - 7):
            if sum(not s for *_, s in t[j : j + 8]) >= 4:
                index[tuple(c for c, *_ in t[j : j + 8])].append((n, j))
    want = set()
    for r in docs:
        t = tokens_of(r.text)
        met = defaultdict(set)
        for p in range(len(t) - 7):
            for n, j in index.get(tuple(c for c, *_ in t[p : p + 8]), ()):
                met[n, p - j] |= set(range(j, j + 8))
        cover = defaultdict(set)
        for (n, shift), places in met.items():
            slots = [(items[n][1][i][1], t[shift + i][1]) for i in sorted(places) if items[n][1][i][2]]
            there, back, odd = {}, {}, 0
            for a, b in slots:
                odd += there.setdefault(a, b) != b or back.setdefault(b, a) != a
            if odd <= 0.2 * len(slots):
                cover[n] |= places
        want |= {(r.doc_id, items[n][0]) for n, places in cover.items() if len(places) >= 0.5 * len(items[n][1])}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, sf).collect()}
    assert want and got == want


# ---- 9


def symbols(text, order):
    out = []
    for b in (text or "").encode():
        out.append(32 if b in (9, 10, 11, 12, 13) else 1 if b < 32 else 48 if 48 <= b < 58 else b)
    return [0] * (order - 1) + out + [2]


def grams_of(text, order):
    s = symbols(text, order)
    return [tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s))]


def kn_model(texts, order, v=256):
    """Straight from the definition."""
    tables = [Counter(g for t in texts for g in grams_of(t, order))]
    for _ in range(order - 1):
        tables.append(Counter(k[1:] for k in tables[-1]))

    def discounts(c):
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return [0.5] * 3
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]

    ds, after = [discounts(c) for c in tables], []
    for c in tables:
        own = defaultdict(dict)
        for k, x in c.items():
            own[k[:-1]][k] = x
        after.append(own)

    def p(gram, i=0):
        if i == order:
            return 1 / v
        own, d, low = after[i].get(gram[:-1], {}), ds[i], p(gram[1:], i + 1)
        if not own:
            return low
        lose = lambda x: d[min(x, 3) - 1] if x else 0
        x, total = own.get(gram, 0), sum(own.values())
        return (x - lose(x)) / total + sum(map(lose, own.values())) / total * low

    return p, tables[0]


@pytest.mark.parametrize(("order", "shard", "least"), [(3, 4_000_000, 5), (4, 100, 30)])
def test_quality_by_definition(spark, order, shard, least):
    """Scores, limits and what is kept, with one shard of weights and with many."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("aab cé 1\n") for _ in range(rng.randrange(60))) for _ in range(90)] + ["zzzz qqq", None, "", "a1b2"]
    docs = [(i, t, ["en", "en", "de", None][i % 4], "s") for i, t in enumerate(texts)]
    trusted = {i for i in range(60) if i % 5}
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(3, 0, 0), (70, 0, 0), (71, 1, 1)], "doc_id long, quality int, toxic int")
    trusted -= {3}
    half = {r.i: r.h for r in spark.range(len(texts)).select(F.col("id").alias("i"), quality.half_of(F.col("id")).alias("h")).collect()}
    models = [kn_model([texts[i] for i in trusted if half[i] != h], order) for h in (0, 1)]
    score = {}
    for i, t, *_ in docs:
        p, known = models[half[i]]
        g = grams_of(t, order)
        score[i] = (len(g), -sum(math.log2(p(x)) for x in g), sum(x not in known for x in g))
    prior, limit = 20, {}
    for lang in ("en", "de", "", None):
        own = [score[i] for i in trusted if (lang is None or (docs[i][2] or "") == lang) and score[i][0] > 1]
        if len(own) >= least or lang is None:
            n, top = sum(x[0] for x in own), []
            for k, step in ((1, 10_000), (2, 200_000)):
                mean = sum(x[k] for x in own) / n
                steps = sorted(math.floor((x[k] + prior * mean) / (x[0] + prior) * step) for x in own)
                top.append((mean, (steps[math.ceil(0.9 * len(steps)) - 1] + 1) / step))
            limit[lang] = top
    got = {r.doc_id: r for r in quality.quality(table(spark, docs), labels, quantile=0.9, prior=prior, least=least, order=order, shard=shard).collect()}
    close = 0
    for i, (n, *x) in score.items():
        top = limit.get(docs[i][2] or "", limit[None])
        s = [(y + prior * mean) / (n + prior) for y, (mean, _) in zip(x, top, strict=True)]
        assert got[i].n_symbols == n and got[i].perplexity == pytest.approx(2 ** s[0], rel=1e-3)
        if all(abs(a - t) > 2e-4 for a, (_, t) in zip(s, top, strict=True)):
            close += 1
            assert got[i].keep == (n == 1 or all(a <= t for a, (_, t) in zip(s, top, strict=True)))
    assert close > 70 and not got[90].keep and got[91].keep and got[92].keep


def test_quality(spark):
    rng = random.Random(10)
    good = [" ".join(rng.choice(["the", "rain", "falls", "over", "green", "hills", "and", "rivers"]) for _ in range(60)) for _ in range(300)]
    bad = ["".join(rng.choice("#$%&QXZ!{}") for _ in range(300)) for _ in range(30)]
    texts = good + bad + [None, "", "rain"]
    docs = table(spark, [(i, t, ["en", "de", None][i % 3], "s") for i, t in enumerate(texts)] + [(0, good[0], "en", "s")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(5, 1, 0), (6, 0, 0), (None, 1, 0), (301, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = quality.quality(docs, labels).collect()
    keep = defaultdict(set)
    for r in got:
        keep[r.keep].add(r.doc_id)
    assert len(got) == len(texts) + 1 and keep[False] >= set(range(300, 330)) and len(keep[False]) <= 30 + 0.02 * 300 and keep[True] >= {330, 331, 332}
    filtered = quality.good_documents(docs, labels)
    assert {r.doc_id for r in filtered.collect()} == keep[True] and filtered.columns == docs.columns
    assert quality.quality(docs, labels.limit(0)).filter("keep").count() == len(texts) + 1
    assert quality.quality(empty(spark), labels).count() == 0


def test_quality_limit_is_the_held_out_quantile(spark):
    """A few words of another kind in a usual text are over the limit, and about one trusted document in a hundred is."""
    rng = random.Random(12)
    usual = ["the", "rain", "falls", "over", "green", "hills", "and", "rivers", "at", "noon", "in", "the", "east", "with", "light", "wind"]
    good = [" ".join(rng.choice(usual) for _ in range(rng.randrange(60, 200))) for _ in range(600)]
    mixed = [" ".join(rng.choice(usual) if rng.random() > 0.06 else rng.choice(["zzkwx", "qpjzk", "xxvqk"]) for _ in range(150)) for _ in range(60)]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(good + mixed)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.quality(docs, labels).collect()}
    assert not any(got[i] for i in range(600, 660))
    assert 1 <= sum(not got[i] for i in range(600)) <= 12


# ---- 10


def jaccard_model(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = re.findall(SPACE, (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return Counter((r[0], len(s), min(least[root(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard(spark, rows):
    want = jaccard_model(rows)
    assert Counter(map(tuple, jaccard.jaccard_components(table(spark, rows)).collect())) == want
    # every list long and dealt to several tasks, nothing frequent: other ways to the same links
    for how in ({"star": 1, "frequent": 0}, {"hot": 1, "often": 2}):
        assert Counter(map(tuple, jaccard.jaccard_components(table(spark, rows), **how).collect())) == want
    one = jaccard.one_of_each(table(spark, rows))
    n = sum(1 for (_, k, _) in want.elements() if k == 0)
    assert one.count() == len({c for (_, k, c) in want if k}) + 1 + n  # doc_id 1 is the least of two components
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_jaccard_one_shingle_in_a_third_of_all(spark):
    rng = random.Random(13)
    line = " ".join(f"common{i}" for i in range(9))
    docs = [(i, (line + " " if i % 3 == 0 else "") + " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 12, 30]))), "en", "s") for i in range(240)]
    docs += [(1000 + i, docs[i][1] + " x", "en", "s") for i in range(0, 240, 7)]
    for how in ({"hot": 10}, {"hot": 1}, {}):
        assert Counter(map(tuple, jaccard.jaccard_components(table(spark, docs), **how).collect())) == jaccard_model(docs)


def test_one_of_each(spark):
    """Which rows stay."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    given = [(5, a), (2, a.upper()), (2, a.upper()), (7, b), (7, b), (None, c), (None, c), (None, d), (9, None), (9, None), (8, " "), (None, ""), (3, a + " more"), (None, a)]
    left = jaccard.one_of_each(table(spark, [(i, t, "en", "s") for i, t in given]))
    assert left.columns == table(spark, []).columns
    want = [(2, a.upper()), (7, b), (None, c), (None, d), (9, None), (9, None), (8, " "), (None, "")]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want)
    assert jaccard.one_of_each(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    up = list(range(200))
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    want = {a: up[a] for e in edges for a in e if up[a] != a}
    assert {r.node: r.root for r in _shared.components(df).collect()} == want
    assert {r.node: r.root for r in _shared.components(df.repartition(13)).collect()} == want
    assert _shared.components(df.limit(0)).count() == 0


def test_rows_by_keys(spark, monkeypatch):
    """Also where the filter is so full that it lets nearly all pass."""
    df = spark.createDataFrame([(i % 50, "x", "y") for i in range(200)] + [(None, "x", "z")], "k long, _row string, `_key` string")
    keys = spark.createDataFrame([(k,) for k in (3, 5, 5, 7, 999, None)], "id long")
    for bits in (_shared.FILTER_BITS, 64):
        monkeypatch.setattr(_shared, "FILTER_BITS", bits)
        inside, outside = _shared.having(df, F.col("k"), keys), _shared.without(df, F.col("k"), keys)
        assert inside.columns == outside.columns == df.columns
        assert Counter(r.k for r in inside.collect()) == Counter({3: 4, 5: 4, 7: 4})
        assert Counter(r.k for r in outside.collect()) == Counter([i % 50 for i in range(200) if i % 50 not in (3, 5, 7)] + [None])
        both = _shared.joined(df, F.col("k"), spark.createDataFrame([(3, "a"), (3, "b")], "id long, v string"))
        assert sorted((r[0].k, r.v) for r in both.collect()) == [(3, "a")] * 4 + [(3, "b")] * 4
    assert _shared.without(df, F.col("k"), keys.limit(0)).count() == 201


def test_pipeline(spark):
    """Each stage on what the one before kept, against the operators' own brute force."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [docs]
    for i, (_, stage) in enumerate(p.STAGES):
        out = _shared.saved(stage(spark, held[-1], sf))
        if i < len(p.STAGES) - 1:
            assert out.columns == docs.columns
            assert 0 < out.count() <= held[-1].count()
        held.append(out)
    one, two, three = (x.toPandas() for x in held[1:4])
    parts = jaccard_model(list(zip(one.doc_id, one.text, strict=True)))
    assert set(two.doc_id) == {c if k else i for i, k, c in parts}
    bench = [re.findall(SPACE, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = lambda t: any(" ".join(b) in " ".join(re.findall(SPACE, t)) for b in bench)
    assert set(three.doc_id) <= {i for i, t in zip(two.doc_id, two.text, strict=True) if not holds(t)}
    assert len(three) >= 0.9 * sum(not holds(t) for t in two.text)
    inside = {i for r in held[5].collect() for i in r.doc_ids}
    assert inside == {r.doc_id for r in held[4].collect()}


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty, long and repeated texts, clashing columns and empty tables, in each stage by itself."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    rng = random.Random(9)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 60").first().text
    copy, long = prose(rng, 60), prose(rng, 15_000)
    given = [(1, None, "en", "src1"), (2, "", "en", "src1"), (None, None, None, None), (3, copy, "en", "src1"), (3, copy, "en", "src1"), (None, copy + " end", "en", None), (4, long, None, "src2"), (5, prose(rng, 30) + f" {item} " + prose(rng, 30), "fr", "src2"), (6, prose(rng, 80), "xx", "src3")]
    docs = table(spark, given)
    stages = dict(p.STAGES)
    assert [k for k, _ in p.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    kept = {}
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0
        rows = out.collect()
        assert all(r[c] == "x" for r in rows for c in CLASH)
        kept[name] = Counter((r.doc_id, r.text) for r in rows)
        assert kept[name] <= Counter((i, t) for i, t, *_ in given)
    nothing = {(1, None), (2, ""), (None, None)}
    assert all(nothing <= set(kept[k]) for k in ("quality classifier", "n-gram Jaccard join", "benchmark decontamination"))
    assert kept["quality classifier"][3, copy] in (0, 2)
    every = Counter((i, t) for i, t, *_ in given)
    assert kept["n-gram Jaccard join"] == every - Counter([(3, copy), (None, copy + " end")])
    assert kept["benchmark decontamination"] == every - Counter([(5, given[7][1])])
    assert kept["mixing sources"][3, copy] in (0, 2)
    packed = stages["token ids"](spark, docs, sf).collect()
    assert {i for r in packed for i in r.doc_ids} == {None, 1, 2, 3, 4, 5, 6} and stages["token ids"](spark, docs.limit(0), sf).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_pii_query(spark):
    got = queries.op1_pii(spark, "/root/testdata/sf0.001").toPandas()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got.itertuples():
        want = base_model(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(k, want)) for k in ("email:", "ip:", "card:", "phone:")]
