"""Secrets, periodic runs and spelling variants against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborfold.llm import credentials, periodic, pii, queries, spelling

SPACE = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "base", "weak", "kind", "start", "runs", "collapsed", "word", "n", "form", "root", "trie", "_assign"):
        df = df.withColumn(c, F.lit("x"))
    return df


# ---- 11

GIVEN = r"""["']?\x20*[:=]\x20*["']?"""


def found(text):
    """(start, rank, end, kind, role, strong) of all parts, by plain patterns."""
    out = []
    add = lambda m, end, kind, role, strong: out.append((m.start(), credentials.ORDER.index(kind), end, kind, role, strong))
    for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])" + GIVEN + "([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 4:
            add(m, m.end(), "assign" if len(m[1]) >= 8 else "key", "key", len(m[1]) >= 8)
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        add(m, m.end(), "access" if len(m[0]) >= 16 else "id", "id", len(m[0]) >= 16)
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 16:
            add(m, m.end(), "hex" if len(m[0]) >= 32 else "key", "key", len(m[0]) >= 32)
    for m in re.finditer("(?ai:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)" + GIVEN + "[A-Za-z0-9+/_.@=-]+", text):
        add(m, m.end(), "id", "id", False)
    for m in re.finditer("[A-Za-z0-9+/_.:@%&?#~=-]+", text):
        w = m[0].rstrip(".:")
        if re.fullmatch("[A-Za-z0-9+/_=-]{20,}", w) and all(re.search(c, w) for c in ("[0-9]", "[a-z]", "[A-Z]")):
            add(m, m.start() + len(w), "key", "key", False)
    url = "(?ai:https?|ftp|ssh|s3|gs|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ldaps?)://"
    for m in re.finditer(f"(?:{url}|(?ai:host(?:name)?|endpoint|server|url){GIVEN})" + r"""[^\x00-\x20"'<>,;]+""", text):
        add(m, m.end(), "endpoint", "endpoint", False)
    return out


def secrets_model(text, reach):
    parts, base, spans = found(text), [], []
    for x in parts:
        if x[5]:
            base.append(x[:4])
            spans.append(x[:4])
            continue
        near = [y for y in parts if y is not x and y[2] > x[0] - reach and y[0] < x[2] + reach]
        has = lambda r, strong=False: any(y[4] == r and (y[5] or not strong) for y in near)  # noqa: B023, E731
        told = {"key": has("id", True) or has("id") and has("endpoint"), "id": has("key", True) or has("key") and has("endpoint"), "endpoint": has("key", True) or has("key") and has("id")}
        if told[x[4]]:
            spans.append(x[:4])
    name = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(xs))
    return name(base), name(spans)


def labelled(spans):
    return spans.select("doc_id", pii.label(F.col("base")).alias("base"), pii.label(pii.all_spans(F.col("base"), F.col("added"))).alias("spans")).collect()


BITS = ["password", "PassWd = ", "token:", "api_key='", "apikey=", "hunter2", "correcthorse", "AKIA", "AKIAABCD", "ABCDEFGH1234", "0123456789abcdef", "deadbeef" * 4, "user: bob ", "client_id=", "https://h.io/x?y=1 ", "host = db1;", "aB3" * 8, "aB3" * 8 + ". ", "\n", " ", " ", ",", "=", "é😀", "plain words here " * 3, "ſecret=abcdefghi ", ":longvalue1"]


def test_secrets(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "token=api_key:longvalue1", "x" * 5000 + " user=a", "password=hunter2", "user=bob password=hunter2", "user=bob password=hunter2 url=h", "AKIA" + "Q" * 16 + " hunter2 token=abcd"]
    docs = table(spark, [*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, None)])
    for reach in (7, 60):
        got = labelled(credentials.secret_spans(docs, reach))
        want = [(i, *secrets_model(t or "", reach)) for i, t in [*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, None)]]
        assert Counter(map(tuple, got)) == Counter(want)
    assert credentials.secret_spans(table(spark, [])).count() == 0


def test_secrets_of_a_text_full_of_parts(spark):
    """Rows are in proportion to the parts: a cell keeps two numbers for each role."""
    text = "user=bob password=abcd http://a.b/ " * 4000 + "password=abcd " * 4000
    got = labelled(credentials.secret_spans(table(spark, [(1, text)]), 50))[0]
    small = "user=bob password=abcd http://a.b/ " * 40 + "password=abcd " * 40
    shift = len("user=bob password=abcd http://a.b/ ") * 3960
    last = [(x.split(":")[0], *(int(v) + shift for v in x.split(":")[1:])) for x in secrets_model(small, 50)[1].split(",")][-60:]
    assert got.base == "" and got.spans.count(",") == 12_000 + sum(int(x.split(":")[1]) >= 35 * 40 for x in secrets_model(small, 50)[1].split(",")) - 1
    assert got.spans.endswith(",".join(f"{k}:{a}:{b}" for k, a, b in last))


def test_secret_patterns_need_no_python(spark):
    plan = credentials.secret_spans(table(spark, [(1, "user=bob password=hunter2 url=h")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapInPandas", plan)


# ---- 12


def runs_model(w, least=6, times=4):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            if n >= max(least, times * p) and not any(all(w[k] == w[k + q] for k in range(s, s + n - q)) for q in range(1, p)):
                out.append((s, n, p))
            i = max(i, s + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a\tb\x0bc " * 4, "a b c " * 3 + "a b", ("a b a b a b a b c " * 5), "é ß " * 9 + "x " * 8]
    for _ in range(150):
        w = [rng.choice("aabcdé😀") for _ in range(rng.randrange(1, 60))]
        a, p = rng.randrange(len(w)), rng.randrange(1, 9)
        texts.append(rng.choice(" \n").join(w[i] if i < a else w[a + (i - a) % p if a + (i - a) % p < len(w) else i] for i in range(len(w))))
    rows = [*enumerate(texts), (3, texts[5]), (None, texts[6])]
    want = []
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        r = runs_model(w)
        want.append((i, tuple(r), collapse(w, r)))
    got = periodic.periodic_runs(table(spark, rows)).collect()
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == Counter(want)
    for least, times in ((20, 4), (1, 7)):
        got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(table(spark, rows[:-2]), least, times).collect()}
        assert got == {i: runs_model(re.findall(SPACE, t or ""), least, times) for i, t in rows[:-2]}
    assert periodic.periodic_runs(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.uint64), np.array([0, 9]), times=3)


def test_runs_of_long_texts(spark):
    """One word 200,000 times; a Fibonacci word, which holds no fourth powers; 60,000 words with one run; a text and its copies."""
    a, b = "a", "ab"
    while len(b) < 30_000:
        a, b = b, b + a
    rng = random.Random(1)
    plain = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    plain[500:540] = ["x", "y", "z", "t"] * 10
    texts = ["x " * 200_000, " ".join(b), " ".join(plain), " ".join(plain), "q " + " ".join(plain)]
    got = {r.doc_id: r for r in periodic.periodic_runs(table(spark, list(enumerate(texts)))).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 200_000, 1)] and got[0].collapsed == "x"
    assert got[1].runs == [] and got[1].collapsed == texts[1]
    assert [tuple(x) for x in got[2].runs] == [tuple(x) for x in got[3].runs] == [(500, 40, 4)]
    assert [tuple(x) for x in got[4].runs] == [(501, 40, 4)] and got[2].collapsed == " ".join(plain[:504] + plain[540:])


def test_next_smaller():
    for n in (1, 2, 3, 17, 500):
        a = np.random.default_rng(n).permutation(n)
        assert periodic.next_smaller(a).tolist() == [next((j for j in range(i + 1, n) if a[j] < a[i]), n) for i in range(n)]


# ---- 13


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_model(counts, ratio):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= ratio * n else None
        out[w] = [n, len(near), form, counts[form] if form else None]
    for w, x in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        x.append(root)
    return {(w, *x) for w, x in out.items()}


def test_spelling(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(3, 7))) for _ in range(150)] + ["chains"[:6] + "x" * k for k in range(4)] + ["é" * 400, "é" * 401]
    texts = [(i, f"{w} " * rng.choice([1, 2, 6, 30, 160])) for i, w in enumerate(words)] + [(200 + k, ("chains" + "x" * k + ".") * 6**k) for k in range(4)]
    texts += [(None, "ABé1ab-é\tÿÀÿ×÷"), (1, None), (2, ""), (3, "123 4"), texts[0], texts[0]]
    every = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    df = table(spark, texts)
    for letters, least, ratio, nodes, group in ((3, 1, 5, 1_000_000, 32 << 20), (4, 2, 2, 100, 32 << 20), (3, 1, 3, 500, 9000)):
        counts = {w: n for w, n in every.items() if len(w) >= letters and n >= least}
        got = spelling.spelling_variants(spelling.runs_of_letters(df), letters, least, ratio, nodes, group).select("word", "n", "n_near", "form", "form_n", "root").collect()
        assert len(got) == len(counts) and set(map(tuple, got)) == spelling_model(counts, ratio)
    assert spelling.spelling_variants(spelling.runs_of_letters(table(spark, []))).count() == 0


def test_tries():
    rng = random.Random(2)
    for t in range(60):
        words = sorted({"".join(rng.choice("abé😀"[: 1 + t % 4]) for _ in range(rng.randrange(t % 2, 7))) for _ in range(rng.randrange(1, 50))})
        trie = spelling.Trie.from_bytes(spelling.Trie.build(words, list(range(1, len(words) + 1))).to_bytes())
        ids, nodes = trie.near(*spelling._codes(words))
        got = [(words[i], trie.word(int(k)), int(trie.values[k])) for i, k in zip(ids, nodes, strict=True)]
        assert sorted(got) == sorted((a, b, j + 1) for a in words for j, b in enumerate(words) if a != b and one_edit(a, b))


def test_planted(spark):
    """The changes that the contract makes to texts before it looks for runs and words."""
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(300)] + [(None, "a b c"), (10, None)]
    got = Counter(map(tuple, queries.planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = Counter()
    for i, t in rows:
        h, w = zlib.crc32(str(i).encode()), (t or "").split()
        if i is not None and h % 10 == 0 and t is not None:
            g, n = h // 10, len(w)
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            t = " ".join(w)
        want[i, t] += 1
    assert got == want
    pairs = [(i, w) for i in range(600) for w in ("wörter", "another", "sixsix")] + [(None, "another")]
    got = Counter(r.word for r in queries.planted_typos(spark.createDataFrame(pairs, "doc_id long, word string")).collect())
    want = Counter()
    for i, w in pairs:
        h = zlib.crc32(f"{i}:{w}".encode())
        want[w[: h % len(w)] + w[h % len(w) + 1 :] if i is not None and h % 199 == 0 else w] += 1
    assert got == want and len(want) > 3
