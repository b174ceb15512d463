"""The reference's cases, models in plain Python on random texts, and a run with edits."""

import hashlib
import json
import os
import random
import subprocess
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from arborfold import cli, config
from arborfold.functions import paths, text
from arborfold.operators import facts, reduce, tree
from arborfold.plans import safety, state
from arborfold.plans.backends import ChatError, Digest, Echo, post_chat
from arborfold.plans.pipeline import Engine, reduce_tree
from arborfold.sources import repo_files as rf

CONFIG = config.Config(num_ctx=512, extraction_steps=(config.Step("ONE", "p1"),))


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", column(F.col("x"))).collect())]


# ---- chunks and budgets


def chunk_model(t, limit, lap):
    if len(t) <= limit:
        return [t]
    out, i = [], 0
    while i + limit < len(t):
        out.append(t[i : i + limit])
        i += limit - lap
    return [*out, t[i:]]


def test_chunks(spark):
    with pytest.raises(ValueError):
        text.n_chunks(F.lit("test"), 0, 0)
    with pytest.raises(ValueError):
        text.n_chunks(F.lit("test"), 10, 10)
    for t, limit, lap, want in (("hello", 10, 2, ["hello"]), ("hello", 5, 2, ["hello"]), ("abcdefg", 4, 2, ["abcd", "cdef", "efg"]), ("", 4, 2, [""])):
        assert values(spark, [t], lambda x, a=limit, b=lap: text.chunks(x, a, b)) == [want]
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé😀\n ") for _ in range(rng.randrange(60))) for _ in range(100)]
    for limit, lap in ((7, 3), (10, 0), (5, 4)):
        assert values(spark, texts, lambda x, a=limit, b=lap: text.chunks(x, a, b)) == [chunk_model(t, limit, lap) for t in texts]


def test_budgets():
    got = [(text.file_budget(n), text.overlap_of(text.file_budget(n)), text.reduce_budget(n)) for n in (256, 512, 1024, 8192, 20000)]
    assert got == [(1536, 384, 768), (1536, 384, 1536), (3072, 768, 3072), (24576, 800, 24576), (60000, 800, 60000)]


def test_chunks_of_long_texts(spark):
    """Across the edges of blocks of 64 and of 4096 chunks, in time that does not grow with the square."""
    text_of = lambda n: "".join(chr(97 + i % 26) for i in range(n)) + "é😀"
    for n in (64 * 3, 64 * 3 + 1, 64 * 3 - 1, 4096 * 3, 4096 * 3 + 2, 4096 * 3 * 2 + 5):
        assert values(spark, [text_of(n)], lambda x: text.chunks(x, 5, 2)) == [chunk_model(text_of(n), 5, 2)]
    long = spark.range(1).select(F.repeat(F.lit("0123456789"), 3_000_000).alias("t"))
    began = time.time()
    got = long.select(F.explode(text.chunks(F.col("t"), 1536, 384)).alias("c")).agg(F.count("*"), F.sum(F.length("c"))).first()
    assert got[0] == -(-(30_000_000 - 1536) // 1152) + 1 and time.time() - began < 60


def test_budget_columns(spark):
    sizes = [1, 256, 511, 512, 513, 1024, 1066, 1067, 8192, 20000]
    got = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", *text.budgets(F.col("n"))).collect()
    assert {tuple(r) for r in got} == {(n, text.file_budget(n), text.overlap_of(text.file_budget(n)), text.reduce_budget(n)) for n in sizes}


def reduce_model(items, budget, f):
    while True:
        parts = [p for x in items for p in (chunk_model(x, max(budget // 2, 1), budget // 10) if len(x) > budget else [x])]
        groups, size = [], 0
        for p in parts:
            if groups and size + len(p) <= budget:
                groups[-1].append(p)
            else:
                groups.append([p])
                size = 0
            size += len(p)
        out = [f("\n\n".join(g)) for g in groups]
        if len(out) == 1:
            return out[0]
        if sum(map(len, out)) >= sum(map(len, parts)) * 95 // 100:
            return "\n\n".join(out)
        items = out


def test_reduce_case(spark):
    items = spark.createDataFrame([("g", i, f"item{i}") for i in range(1, 6)], "grp string, ord int, text string")
    got = reduce.reduce_items(items, 15, lambda g, j: F.replace(j, F.lit("\n\n"), F.lit("-"))).collect()
    assert [r.text for r in got] == ["item1-item2-item3\n\nitem4-item5"]


def test_reduce_model(spark):
    rng = random.Random(2)
    groups = {f"g{k}": ["".join(rng.choice("abé😀") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(1, 12))] for k in range(30)}
    items = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "grp string, ord int, text string")
    for f, col in ((lambda x: x[:20], lambda g, j: F.substring(j, 1, 20)), (lambda x: x, lambda g, j: j)):
        got = {r.grp: r.text for r in reduce.reduce_items(items, 40, col).collect()}
        assert got == {g: reduce_model(ts, 40, f) for g, ts in groups.items()}


def test_consolidation_in_batches_and_rounds(spark, tmp_path):
    """fact_consolidation and facts_assembly on whole files, the longest of which take several rounds."""
    from arborfold.plans import queries

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = given.limit(3).select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.repeat(F.concat("text", F.lit("é ")), 200).alias("text"), *given.columns[2:])
    sf = str(tmp_path)
    given.union(long).write.parquet(f"{sf}/documents.parquet")
    digest = lambda system, user: hashlib.sha256(f"{system}\x1f{user}".encode()).hexdigest()
    limit, rounds, want, whole = queries.LIMIT, [], {}, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        content, name, where = r.text or "", f"doc_{r.doc_id}.txt", f"{r.source}/{r.lang}"
        path, own = f"{where}/{name}", []
        for k, (step, prompt) in enumerate(queries.STEPS):
            parts = chunk_model(content, limit, queries.OVERLAP)
            of = lambda i: f" (Chunk {i + 1} of {len(parts)})" if len(parts) > 1 else ""  # noqa: B023, E731
            facts = [digest(f"S\n{prompt}", f"File: {name}{of(i)} inside Module: {where}\n```\n{c}\n```") for i, c in enumerate(parts)]
            asked = []

            def merged(x, step=step, asked=asked):
                asked.append(x)
                return digest("C", f"Consolidate and deduplicate the extracted facts for {path} regarding step '{step}':\n{x}")  # noqa: B023

            fact = facts[0] if len(facts) == 1 else reduce_model(facts, queries.BUDGET, merged)
            rounds.append(len(asked))
            want[path, k] = fact
            own.append(f"#### [{step}]\n{fact}\n\n")
        whole[path] = "".join(own).strip()
    assert max(rounds) > 2
    assert {(r.path, r.step_ord): r.fact for r in queries.QUERIES["fact_consolidation"](spark, sf).collect()} == want
    assert {r.path: r.facts for r in queries.QUERIES["facts_assembly"](spark, sf).collect()} == whole


# ---- texts


def test_fences(spark):
    given = ["```json\n{}\n```", "```go\nx\n```", "```a```b```c```", "``````", "  plain \n", " x　"]
    assert values(spark, given, text.strip_fence) == ["{}", "go\nx", "a```b```c", "", "plain", "x"]


def test_guidelines(spark):
    assert values(spark, [None, "a\n\n", "a\n", "a", "AI Agent Guidelines"], lambda x: text.guidelines(x, "G", "AI Agent Guidelines")) == ["G", "a\n\nG", "a\n\nG", "a\n\nG", "AI Agent Guidelines"]


def test_lists(spark):
    assert values(spark, ["a, b,, c ", " ", "None", "clear"], text.list_of) == [["a", "b", "c"], None, [], []]


def test_steps_hash(spark):
    steps = [("A<", "x&é"), ("B", '"q"')]
    col = F.array(*(F.struct(F.lit(n).alias("Name"), F.lit(p).alias("Prompt")) for n, p in steps))
    assert spark.range(1).select(text.steps_hash_column(col)).first()[0] == text.steps_hash(steps) != text.steps_hash(steps[::-1])


def test_chat_json(spark):
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")))
    got = json.loads(spark.range(1).select(text.chat_request("m", F.lit("s"), m, 7)).first()[0])
    assert got == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}], "stream": False, "options": {"num_ctx": 7}}
    assert json.loads(spark.range(1).select(text.chat_request("m", F.lit("s"), m, as_json=True)).first()[0])["format"] == "json"
    assert values(spark, ['{"message":{"content":"a"}}', '{"message":{}}', "{}"], text.chat_reply) == ["a", "", ""]


# ---- paths


def test_ignore_rules(spark):
    rules = ["*.log", "build/"]
    given = ["src/main.go", "test.log", "build/output.bin", "src/.hidden.txt", ".git/config", "src/my_package.egg-info/PKG-INFO"]
    want = [False, True, True, True, True, True]
    assert values(spark, given, lambda x: paths.ignored(x, rules)) == want == [rf.ignored_by(rules)(p) for p in given]
    more = ["/top.txt", "a/**/z", "*.md", "!keep.md", "x?y", "[ab].c", "# no", ""]
    for p, w in (("top.txt", True), ("d/top.txt", False), ("a/z", True), ("a/b/c/z", True), ("d/r.md", True), ("d/keep.md", False), ("xzy", True), ("x/y", False), ("a.c", True), ("c.c", False), ("a.cc", False)):
        assert rf.ignored_by(more)(p) is w, p
        assert values(spark, [p], lambda x: paths.ignored(x, more)) == [w]


def test_unignored(spark):
    """Directories judged once give what judging every path gives."""
    rng = random.Random(4)
    given = ["/".join(rng.choice(["a", "b.c", "src", "fr", "x.egg-info", ".h"]) for _ in range(rng.randrange(1, 5))) + f"/{k}.log" for k in range(150)] + ["top.log", "fr", "keep.log"]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(given)], "path string, dir int")
    for rules in ([], ["fr/", "!src/fr/*"], ["*.log", "!keep.log", "b.c"], ["/a", "!/a/b.c", "src/**/fr", "1?.log"]):
        want = sorted(r.path for r in df.filter(~paths.pruned(F.col("path"), rules)).collect())
        got = tree.unignored(df, rules)
        assert got.columns == ["path", "dir"] and sorted(r.path for r in got.collect()) == want
    assert len(paths._merged(["a", "b/", "!c", "d", "# x"])) == 3


def test_prune(spark):
    assert values(spark, ["src1/de/a", "src2/a"], lambda x: paths.pruned(x, ["src1", "!src1/de/a"])) == [True, False]


def test_guard(spark, tmp_path):
    given = ["src/file.txt", "..config", "../out.txt", "src/../../out.txt", "/../x"]
    assert values(spark, given, paths.escapes) == [False, False, True, True, True]
    for p in given[:2]:
        safety.resolve_inside(tmp_path, p)
    for p in given[2:]:
        with pytest.raises(safety.PathTraversal):
            safety.resolve_inside(tmp_path, p)
    (tmp_path / "escape").symlink_to("/usr")
    with pytest.raises(safety.PathTraversal):
        safety.resolve_inside(tmp_path, "escape/file.txt")


def test_tree(spark):
    files = spark.createDataFrame([(p,) for p in ("root.go", "cmd/main.go", "internal/app/app.go", "internal/app/config.go", "internal/util/util.go")], "path string")
    dirs = tree.directories(files)
    assert sorted(r.path for r in dirs.collect()) == [".", "cmd", "internal", "internal/app", "internal/util"]
    assert {r.path: r.n_files for r in tree.file_counts(files).collect()} == {".": 1, "cmd": 1, "internal/app": 2, "internal/util": 1}
    changed = spark.createDataFrame([("internal/app/app.go", "Modified")], "path string, status string")
    direct = tree.directly_affected(dirs, changed, dirs.select("path"), dirs.select("path", F.lit("s").alias("summary")))
    assert [r.path for r in direct.collect()] == ["internal/app"]
    assert sorted(r.path for r in tree.affected(dirs, direct).collect()) == [".", "internal", "internal/app"]


def test_last_file_deleted(spark):
    dirs = tree.directories(spark.createDataFrame([("a/y",)], "path string"))
    gone = spark.createDataFrame([("a/b/x", "Deleted")], "path string, status string")
    direct = tree.directly_affected(dirs, gone, dirs.select("path"), dirs.select("path", F.lit("s").alias("summary")))
    assert [r.path for r in tree.affected(dirs, direct).collect()] == ["a/b"]
    assert sorted(r.path for r in tree.affected(dirs, direct, gone.select("path")).collect()) == [".", "a", "a/b"]


# ---- sources, state, safety


def test_scan(spark, tmp_path):
    for p in ("src/main.go", "src/utils.go", "src/.hidden/secret.txt", "build/output.bin", "test.log", "_under/_f.go"):
        safety.write_inside(tmp_path, p, "x")
    (tmp_path / "link").symlink_to(tmp_path / "src")
    (tmp_path / "bad.txt").write_bytes(b"\xe2\x82a\xff")
    got = {r.path: r for r in rf.repo_files(spark, str(tmp_path), ["*.log", "build/"]).collect()}
    assert sorted(got) == ["_under/_f.go", "bad.txt", "link", "src/main.go", "src/utils.go"]
    assert got["link"].error and got["link"].sha256 is None
    assert got["bad.txt"].content == "��a�"
    assert rf.read_ignore_file(str(tmp_path)) == []
    (tmp_path / ".gitignore").write_text("# Comment\n*.log\n\nbuild/\n")
    assert rf.read_ignore_file(str(tmp_path)) == ["*.log", "build/"]


def test_lock_and_ignore_file(tmp_path):
    with safety.lock(tmp_path), pytest.raises(safety.LockHeld), safety.lock(tmp_path):
        pass
    with safety.lock(tmp_path):
        pass
    (tmp_path / ".gitignore").write_text("a")
    safety.ensure_lock_is_ignored(tmp_path)
    once = (tmp_path / ".gitignore").read_text()
    safety.ensure_lock_is_ignored(tmp_path)
    assert once == (tmp_path / ".gitignore").read_text() and once.startswith("a\n#") and once.endswith(f"{safety.LOCK_NAME}\n")


def test_config(tmp_path):
    with pytest.raises(config.ConfigError):
        config.load(tmp_path)
    config.save(tmp_path, config.Config(model_id="yaml-model", num_ctx=2048, ignore=("a", "b")))
    assert config.load(tmp_path) == config.Config(model_id="yaml-model", num_ctx=2048, ignore=("a", "b"))
    assert os.stat(tmp_path / config.FILE_NAME).st_mode & 0o777 == 0o600
    env = {config.ENV_CONTEXT: "4096", config.ENV_MODEL: "env-model"}
    assert config.resolve(tmp_path, env).num_ctx == 4096
    c = config.resolve(tmp_path, env, "flag-model", "8192")
    assert (c.model_id, c.num_ctx) == ("flag-model", 8192)
    for e, flag in (({config.ENV_CONTEXT: "invalid"}, ""), ({config.ENV_CONTEXT: "0"}, "8"), ({}, "invalid")):
        with pytest.raises(config.ConfigError):
            config.resolve(tmp_path, e, num_ctx=flag)
    (tmp_path / config.FILE_NAME).write_text("num_ctx: '8192'\nmodel_id: 7\n")
    c = config.load(tmp_path)
    assert (c.num_ctx, c.model_id) == (8192, "7") and text.file_budget(c.num_ctx) > 0
    (tmp_path / config.FILE_NAME).write_text("base_url: [a, b]\n")
    with pytest.raises(config.ConfigError):
        config.load(tmp_path)
    (tmp_path / config.FILE_NAME).write_text("invalid: yaml: content:")
    with pytest.raises(config.ConfigError):
        config.load(tmp_path)


def test_prompts():
    assert cli.ask_text("q", "d", lambda: "test-input\n") == "test-input"
    assert cli.ask_text("q", "default", lambda: "\n") == "default"
    assert cli.ask_list("q", [], lambda: "a, b, c\n") == (["a", "b", "c"], True)
    assert cli.ask_list("q", ["default"], lambda: "\n") == (["default"], False)
    with pytest.raises(EOFError):
        cli.ask_text("q", "d", lambda: "")


def test_state(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "s"))
    assert not store.exists() and store.load().files.isEmpty()
    files = spark.createDataFrame([("p", "h", "f")], state.FILES)
    s = state.State(files, spark.createDataFrame([(".", "sum")], state.MODULES), "steps")
    store.save(s)
    store.save(store.load())  # a state is read while the next is written
    assert store.load().steps_hash == "steps" and store.load().files.collect() == files.collect()
    back = state.from_json(state.to_json(s))
    assert back.files.collect() == files.collect() and back.steps_hash == "steps"
    assert state.from_json(spark.createDataFrame([("{}",)], "json string")).files.isEmpty()
    store._create(store.numbers()[-1] + 1, {})
    assert store.exists() and store.load().files.isEmpty()


def test_http_backend():
    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = body["messages"][1]["content"] == "bad"
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"e" * 5000 if bad else json.dumps({"message": {"content": f"{self.path} {body['options']}"}}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    assert post_chat(base, "m", "s", "u", 5) == "/api/chat {'num_ctx': 5}"
    with pytest.raises(ChatError) as e:
        post_chat(base, "m", "s", "bad", 0)
    assert len(str(e.value)) < 1100
    server.shutdown()


# ---- whole runs


def files_of(spark, d):
    df = spark.createDataFrame(list(d.items()) or [("", "")], "path string, content string")
    return df.filter("path <> ''").select("path", F.sha2("content", 256).alias("sha256"), "content", F.lit(None).cast("string").alias("error"))


def test_update_redoes_only_what_a_change_touches(spark):
    d = {"a/x/1.txt": "one", "a/y/2.txt": "two", "b/3.txt": "", "4.txt": "é" * 4000}
    first = reduce_tree(files_of(spark, d), state.empty(spark), CONFIG, Digest(), full=True)
    assert sorted(r.path for r in first.rebuilt.collect()) == [".", "a", "a/x", "a/y", "b"]
    again = reduce_tree(files_of(spark, d), first.state, CONFIG, Digest())
    assert again.noop
    d |= {"a/x/1.txt": "other"}
    second = reduce_tree(files_of(spark, d), first.state, CONFIG, Digest())
    assert sorted(r.path for r in second.rebuilt.collect()) == [".", "a", "a/x"]
    assert [r.path for r in second.extracted.collect()] == ["a/x/1.txt"]
    fresh = reduce_tree(files_of(spark, d), state.empty(spark), CONFIG, Digest(), full=True)
    assert sorted(second.state.modules.collect()) == sorted(fresh.state.modules.collect())
    del d["a/y/2.txt"]
    third = reduce_tree(files_of(spark, d), second.state, CONFIG, Digest())
    assert sorted(r.path for r in third.state.modules.collect()) == [".", "a", "a/x", "b"]
    steps = config.Config(num_ctx=512, extraction_steps=(config.Step("TWO", "p2"),))
    assert reduce_tree(files_of(spark, d), third.state, steps, Digest()).extracted.count() == 3


def test_empty_answers(spark):
    class Nothing:
        def complete(self, system, user):
            return F.substring(user, 1, 0)

    r = reduce_tree(files_of(spark, {"a/1.txt": "x"}), state.empty(spark), CONFIG, Nothing(), full=True)
    assert {x.path: x.summary for x in r.rebuilt.collect()} == {".": "", "a": ""}
    assert not reduce_tree(files_of(spark, {"a/1.txt": "x"}), r.state, CONFIG, Nothing()).noop


def test_one_chunk_stays_verbatim(spark):
    f = files_of(spark, {"a/1.txt": "x", "a/2.txt": "y" * 2000})
    got = {r.path: r.facts for r in facts.extract(f, Echo(), [("ONE", "p")], "S", "C", 512).collect()}
    assert got["a/1.txt"] == "#### [ONE]\nFile: 1.txt inside Module: a\n```\nx\n```"
    assert got["a/2.txt"].startswith("#### [ONE]\nConsolidate and deduplicate the extracted facts for a/2.txt regarding step 'ONE':\nFile: 2.txt (Chunk 1 of 2)")


def test_engine_on_a_folder(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for p in ("src/a.py", "src/sub/b.py", "main.py"):
        safety.write_inside(tmp_path, p, p)
    told = []
    engine = Engine(spark, str(tmp_path), CONFIG, Digest(), lambda *x: told.append(x))
    with pytest.raises(RuntimeError):
        engine.update()
    engine.init()
    with pytest.raises(RuntimeError):
        engine.init()
    docs = tmp_path / "wiki"
    assert all((docs / x).exists() for x in ("architecture.md", "quickstart.md", "modules/README.md", "modules/src/README.md", "modules/src/sub/README.md"))
    assert "AI Agent Guidelines" in (tmp_path / "AGENTS.md").read_text()
    assert engine.update().noop
    (docs / "modules/src/README.md").unlink()
    assert sorted(r.path for r in engine.update().affected.collect()) == [".", "src"]
    assert [m for k, m in told if k == "page"].count("modules/src/README.md") == 2
    (tmp_path / "src/sub/b.py").unlink()
    (tmp_path / "main.py").unlink()
    engine.update()
    assert [m for k, m in told if k == "deleted"] == ["main.py", "src/sub/b.py"]
    assert not (docs / "modules/src/sub/README.md").exists() and (docs / "modules/src/README.md").exists()


def test_cancel(spark, tmp_path):
    class Slow:
        def complete(self, system, user):
            wait = F.pandas_udf(lambda x: (time.sleep(5), x)[1], "string")
            return wait(user)

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    safety.write_inside(tmp_path, "a.py", "a")
    engine = Engine(spark, str(tmp_path), CONFIG, Slow())
    stop = threading.Timer(5, engine.cancel)
    stop.start()
    with pytest.raises(Exception, match="(?i)cancel"):
        engine.init()
    with safety.lock(tmp_path):
        pass


def test_stream(spark, tmp_path):
    from arborfold.streaming.watch import follow

    src = str(tmp_path / "in")
    schema = "path string, version int, content string"
    store = state.Store(spark, str(tmp_path / "state"))

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        follow(spark.readStream.schema(schema).parquet(src), str(tmp_path / "files"), store, CONFIG, Digest(), str(tmp_path / "cp")).awaitTermination()

    send([("a/1", 1, "x"), ("b/2", 1, "y"), ("c/3", 1, "c"), (None, 1, "no path")])
    send([("a/1", 2, "z"), ("b/2", 3, None), ("a/1", 1, "late within the batch"), ("d/4", 5, None)])
    # older versions that come late, versions that come twice, a newer one that changes nothing, and one too old to bring a file back
    send([("a/1", 1, "old"), ("a/1", 2, "other"), ("b/2", 2, "gone already"), ("c/3", 4, "c"), ("c/3", 2, "c2"), ("d/4", 4, "d")])
    held = lambda d: reduce_tree(files_of(spark, d), state.empty(spark), CONFIG, Digest(), full=True).state
    want = held({"a/1": "z", "c/3": "c"})
    assert sorted(store.load().modules.collect()) == sorted(want.modules.select("path", "summary").collect())
    segments = len(store._entry(store.numbers()[-1])["tables"]["files"])
    send([("c/3", 5, "c"), ("a/1", 2, "z")])  # nothing changes, nothing is written
    assert len(store._entry(store.numbers()[-1])["tables"]["files"]) == segments
    send([("b/2", 4, "back"), ("c/3", 9, "c9")])
    want = held({"a/1": "z", "b/2": "back", "c/3": "c9"})
    assert sorted(store.load().modules.collect()) == sorted(want.modules.select("path", "summary").collect())
    # new steps need contents of files that no batch brings any more
    other = config.Config(num_ctx=512, extraction_steps=(config.Step("TWO", "p2"),))
    spark.createDataFrame([("e/5", 1, "e")], schema).coalesce(1).write.mode("append").parquet(src)
    follow(spark.readStream.schema(schema).parquet(src), str(tmp_path / "files"), store, other, Digest(), str(tmp_path / "cp")).awaitTermination()
    d = {"a/1": "z", "b/2": "back", "c/3": "c9", "e/5": "e"}
    want = reduce_tree(files_of(spark, d), state.empty(spark), other, Digest(), full=True).state
    assert sorted(store.load().modules.collect()) == sorted(want.modules.select("path", "summary").collect())


def test_contents_of_many_batches(spark, tmp_path):
    from arborfold.streaming.watch import Contents

    c, want = Contents(spark, str(tmp_path / "c"), most=3), {}
    for n in range(9):
        rows = [(f"p{n % 4}", n, f"text {n}" if n != 6 else None), (f"q{n}", n, "q")]
        c.add(n, spark.createDataFrame(rows, "path string, version long, content string"))
        want |= {p: t for p, _, t in rows}
    every = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.content for r in c.read(every).collect()} == {p: t for p, t in want.items() if t}
    assert len(c.batches()) <= 6
