"""Listing, two-phase reading, the sink, the delta state, and an engine's work in proportion to a change."""

import hashlib
import os
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from arborfold import config
from arborfold.operators import facts, tree
from arborfold.plans import safety, state
from arborfold.plans.backends import Digest, Head
from arborfold.plans.pipeline import Engine, reduce_tree
from arborfold.sources import listing as ls
from arborfold.sources import repo_files as rf
from arborfold.sources.files import FolderFiles, TableFiles
from arborfold.sources.text_tree import remove_files, write_tree

CONFIG = config.Config(num_ctx=512, extraction_steps=(config.Step("ONE", "p1"),))


def make(root, n, seed=0):
    rng, out = random.Random(seed), {}
    for k in range(n):
        path = "/".join([*(rng.choice(["a", "b", "b.c", "é", "_x", ".hid", "lib.egg-info"]) for _ in range(rng.randrange(4))), f"f{k}.{rng.choice(['py', 'log'])}"])
        out[path] = f"text {k} " * rng.randrange(5)
        safety.write_inside(root, path, out[path])
    return out


# ---- listing


def test_listing_in_rounds(spark, tmp_path):
    """However many entries a task lists before it hands on, and in the order of a walk."""
    files, rules = make(tmp_path, 150), ["*.log", "/b/", "!f7.log"]
    test = rf.ignored_by(rules)
    want = {p for p in files if not any(test(d) or test(f"{d}/x") for d in ("/".join(p.split("/")[:i]) for i in range(1, p.count("/") + 1))) and not test(p)}
    walk = []
    for here, dirs, names in os.walk(tmp_path):
        walk += [os.path.relpath(os.path.join(here, x), tmp_path) for x in names]
    for most in (1, 7, 10_000):
        found = ls.in_order(ls.listing(spark, str(tmp_path), rules, most)).collect()
        assert {r.path for r in found} == want
        assert [r.path for r in sorted(found, key=lambda r: r.ord)] == sorted(want, key=lambda p: [c.encode() for c in p.split("/")])
        assert all(r.size == os.path.getsize(tmp_path / r.path) for r in found)
    assert ls.listing(spark, str(tmp_path), ["*"]).count() == 0
    with pytest.raises(Exception, match="No such file"):
        ls.listing(spark, str(tmp_path / "none"), []).count()


def test_pushed_filters_leave_directories_out(spark, tmp_path):
    make(tmp_path, 60)
    safety.write_inside(tmp_path, "deep/er/one.txt", "é")
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    reader = rf._Reader(str(tmp_path), [])
    assert list(reader.pushFilters([IsNotNull(("path",)), EqualTo(("path",), "deep/er/one.txt")])) == [IsNotNull(("path",))]
    assert [p.names for p in reader.partitions()] == [["deep/er/one.txt"]] and not reader._leads("a") and reader._leads("deep")
    reader = rf._Reader(str(tmp_path), [])
    left = list(reader.pushFilters([StringStartsWith(("path",), "deep/"), In(("path",), ("deep/er/one.txt", "a/x")), EqualTo(("error",), "x")]))
    assert left == [EqualTo(("error",), "x")] and [p.names for p in reader.partitions()] == [["deep/er/one.txt"]]
    df = rf.repo_files(spark, str(tmp_path), [])
    assert [r.content for r in df.filter("path = 'deep/er/one.txt'").collect()] == ["é"]
    assert df.filter("startswith(path, 'deep/')").count() == 1
    assert df.filter("startswith(path, 'b') and error is null").count() == sum(r.path.startswith("b") for r in df.collect())


# ---- two phases


def test_only_what_may_have_changed_is_read(spark, tmp_path):
    root = tmp_path / "r"
    files = {p: t for p, t in make(root, 80).items() if not rf.ignored_by([])(p)}
    (root / "link.py").symlink_to(root / next(iter(files)))
    known = FolderFiles(spark, str(root), [], settle=0).index
    rows = {r.path: r for r in known.collect()}
    assert set(rows) == {*files, "link.py"} and all(r.hashed for r in rows.values())
    assert all(rows[p].sha256 == hashlib.sha256(t.encode()).hexdigest() for p, t in files.items())
    time.sleep(0.05)
    again = FolderFiles(spark, str(root), [], known, settle=0)
    assert [r.path for r in again.index.filter("hashed").collect()] == ["link.py"]  # its target may have changed
    a, b, c, *_ = sorted(files)
    safety.write_inside(root, a, files[a] + "!")
    os.utime(root / b)
    with open(root / c, "r+") as f:  # same size, and the time set back
        old = os.stat(root / c)
        f.write("?" * len(files[c]))
    os.utime(root / c, ns=(old.st_atime_ns, old.st_mtime_ns))
    (root / "link.py").unlink()
    now = FolderFiles(spark, str(root), [], known, settle=0)
    assert {r.path for r in now.index.filter("hashed").collect()} == {a, b, c}
    shas = {r.path: r.sha256 for r in now.index.collect()}
    assert {p for p in files if shas[p] != rows[p].sha256} == ({a, c} if files[c] else {a})
    # within the time that files need to settle, equal times prove nothing
    assert FolderFiles(spark, str(root), [], known, settle=3600).index.filter("not hashed").count() == 0
    got = now.read(spark.createDataFrame([(a,), (b,), ("not there",)], "path string")).collect()
    assert {r.path: r.content for r in got} == {a: files[a] + "!", b: files[b]}
    tasks = FolderFiles(spark, str(root), [], task_bytes=40_000)
    assert tasks.index.count() == len(files) and tasks._dealt(tasks.index).rdd.getNumPartitions() == 6


def test_table_files(spark):
    df = spark.createDataFrame([("a", "h", "x", None), ("b", None, None, "no")], "path string, sha256 string, content string, error string")
    t = TableFiles(df)
    assert t.index.count() == 2 and [tuple(r) for r in t.read(df.select("path")).collect()] == [("a", "x")]


# ---- the sink


def test_tree_sink_writes_all_or_nothing(spark, tmp_path):
    rows = [(f"d{i % 5}/é/{i}.md", f"text {i}\n") for i in range(200)] + [("top.md", ""), ("/abs.md", "x")]
    df = spark.createDataFrame(rows, "path string, content string").repartition(4)
    write_tree(df, str(tmp_path / "t"))
    assert {str(p.relative_to(tmp_path / "t")): p.read_text() for p in (tmp_path / "t").rglob("*") if p.is_file()} == {p.lstrip("/"): t for p, t in rows}
    write_tree(spark.createDataFrame([("top.md", "new")], "path string, content string"), str(tmp_path / "t"))
    assert (tmp_path / "t" / "top.md").read_text() == "new"
    bad = df.withColumn("content", F.when(F.col("path") == "d3/é/13.md", F.raise_error(F.lit("no"))).otherwise("other"))
    with pytest.raises(Exception):  # noqa: B017
        write_tree(bad, str(tmp_path / "t"))
    assert (tmp_path / "t" / "d1/é/1.md").read_text() == "text 1\n" and not list((tmp_path / "t").glob(".*"))
    (tmp_path / "t" / "out").symlink_to("/usr")
    for path in ("../x.md", "a/../../x.md", "out/x.md"):
        with pytest.raises(Exception, match="(?i)traversal|outside"):
            write_tree(spark.createDataFrame([("fine.md", "x"), (path, "x")], "path string, content string"), str(tmp_path / "t"))
    assert not (tmp_path / "t" / "fine.md").exists() and not (tmp_path / "x.md").exists()
    remove_files(spark.createDataFrame([("t/top.md",), ("t/none.md",)], "path string"), str(tmp_path))
    assert not (tmp_path / "t" / "top.md").exists() and (tmp_path / "t" / "d1/é/1.md").exists()


# ---- the state


def test_state_is_written_in_proportion_to_the_change(spark, tmp_path):
    """Random updates against a dictionary, through merges of segments; old versions go; late writers fail."""
    rng, folder = random.Random(5), str(tmp_path / "s")
    store = state.Store(spark, folder, most=3)
    want = {f"p{i}": ("h", f"facts {i} " * 20) for i in range(400)}
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], state.FILES)
    number = store.save(state.State(frame(want), spark.createDataFrame([(".", "s")], state.MODULES), "steps"))
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    first = size()
    for turn in range(7):
        new = {f"p{rng.randrange(420)}": (f"h{turn}", "x") for _ in range(8 if turn < 6 else 300)}
        gone = [p for p in rng.sample(sorted(want), 4) if p not in new]
        before = size()
        number = store.append(state.Delta({"files": frame(new)}, {"files": spark.createDataFrame([(p,) for p in gone], "path string")}), "steps", number)
        if turn == 0:
            assert size() - before < first / 2
        want = {**{k: v for k, v in want.items() if k not in gone}, **new}
        back = store.load()
        assert {r.path: (r.sha256, r.facts) for r in back.files.collect()} == want and back.number == number
        assert [tuple(r) for r in back.modules.collect()] == [(".", "s")]
        segments = store._entry(number)["tables"]["files"]
        assert len(segments) <= 4 and len(list((tmp_path / "s" / "files").iterdir())) <= 6
    assert len(segments) == 1  # the last change was large: all in one
    assert len(store.numbers()) == 2
    with pytest.raises(state.StateConflict):
        store.append(state.Delta(), "steps", number - 1)
    with pytest.raises(state.StateConflict):
        store._create(number, {})


def test_json_lines_and_document(spark):
    files = spark.createDataFrame([(f"p{i}", "h", 'f "x"\n') for i in range(50)], state.FILES)
    s = state.State(files, spark.createDataFrame([(".", "é")], state.MODULES), "steps")
    lines = state.to_json(s)
    assert lines.count() == 52
    back = state.from_json(lines)
    assert sorted(back.files.collect()) == sorted(files.collect()) and back.modules.first().summary == "é" and back.steps_hash == "steps"
    doc = spark.createDataFrame([('{"version":1,"steps_hash":"s","files":{"p":{"sha256":"h","facts":"f"}},"modules":{}}',)], "json string")
    assert [tuple(r) for r in state.from_document(doc).files.collect()] == [("p", "h", "f")]
    for other in ("{}", '{"version":2,"files":{"p":{}}}'):
        assert state.from_document(spark.createDataFrame([(other,)], "json string")).files.isEmpty()
    with pytest.raises(Exception):  # noqa: B017
        state.from_document(spark.createDataFrame([("{broken",)], "json string")).files.collect()


# ---- rounds and runs


def test_directories_are_done_as_they_become_ready(spark):
    """A deep chain beside a wide directory that takes several rounds: rounds are those of the longest chain of steps."""
    deep = {"/".join(f"d{j}" for j in range(i + 1)) + "/f.txt": "x" for i in range(5)}
    wide = {f"w/{i}.txt": f"w{i} " * 200 for i in range(60)}
    rows = spark.createDataFrame([*deep.items(), *wide.items()], "path string, facts string")
    dirs = tree.directories(rows).select("path", "depth")
    begun = []
    got = facts.synthesise(dirs, rows, spark.createDataFrame([], state.MODULES), Head(300), "S", "M", 512, lambda kind, m: begun.append({r[0].split(":")[0] for r in m.collect()}) if kind == "directory" else None)
    assert {r.path for r in got.collect()} == {r.path for r in dirs.collect()}
    # the deepest of the chain and the wide one begin together, and the chain does not wait for the wide one
    assert {"d0/d1/d2/d3/d4", "w"} <= begun[0]
    order = [d for b in begun for d in sorted(b)]
    assert order.index("d0/d1/d2/d3") < order.index(".") and all(len(b) == len(set(b)) for b in begun)
    chain = next(i for i, b in enumerate(begun) if "d0" in b)
    assert chain == 4 and sum(map(len, begun)) == dirs.count()
    # what each directory is given does not depend on the rounds
    assert got.filter("path = 'd0/d1/d2/d3/d4'").first().summary.startswith("Synthesize architecture for d0/d1/d2/d3/d4:\n### File: f.txt\nx")


def test_an_update_reads_and_writes_what_a_change_touches(spark, tmp_path):
    root = tmp_path / "r"
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    for i in range(120):
        safety.write_inside(root, f"m{i % 6}/s{i % 3}/f{i}.txt", f"text {i} " * 30)
    told = []
    engine = Engine(spark, str(root), CONFIG, Digest(), lambda *x: told.append(x), settle=0)
    engine.init()
    events = engine.events.table()
    assert events.filter("kind = 'extracted'").count() == 120 and events.filter("kind = 'page'").count() == 6 + 6 + 1
    assert events.filter("kind = 'directory'").count() == 13 and events.filter("kind = 'reduced'").count() >= 13
    assert sum(k == "extracted" for k, _ in told) == 120 and told[-1] == ("success", "done")
    time.sleep(0.05)
    safety.write_inside(root, "m1/s1/f1.txt", "changed")
    size = lambda: sum(p.stat().st_size for t in ("files", "modules", "prints") for p in (root / "wiki/.state" / t).rglob("*.parquet"))
    before = size()
    second = engine.update()
    assert [r.path for r in second.delta.rows["prints"].collect()] == ["m1/s1/f1.txt"]  # all that was read
    assert [r.path for r in second.extracted.collect()] == ["m1/s1/f1.txt"]
    events = engine.events.table()
    assert [r.message for r in events.filter("kind = 'extracted'").collect()] == ["m1/s1/f1.txt: step 1 of 1, ONE"]
    assert {r.message.split(":")[0] for r in events.filter("kind = 'directory'").collect()} == {".", "m1", "m1/s1"}
    assert size() - before < before
    assert engine.update().noop
    os.utime(root / "m1/s1/f1.txt")  # touched, but the same: read once more, nothing done
    touched = engine.update()
    assert touched.noop and touched.delta.rows["prints"].count() == 1
    assert engine.update().delta.rows["prints"].count() == 0
    # a whole scan finds the same
    index = FolderFiles(spark, str(root), engine.rules()).index
    fresh = reduce_tree(FolderFiles(spark, str(root), engine.rules()), state.empty(spark), CONFIG, Digest(), full=True)
    held = engine.store.load()
    assert sorted(held.modules.collect()) == sorted(fresh.state.modules.select("path", "summary").collect())
    assert held.files.count() == index.count() == 120
    steps = config.Config(num_ctx=512, extraction_steps=(config.Step("TWO", "p2"),))
    again = Engine(spark, str(root), steps, Digest(), lambda *x: told.append(x), settle=0)
    assert again.update().extracted.count() == 120
    assert again.events.table().filter("kind = 'warning'").count() == 1
    assert engine.store.load().steps_hash == again.store.load().steps_hash


def test_the_rest_of_the_configuration(spark, tmp_path):
    """Model and context invalidate nothing unless asked; a full run reuses facts only if asked; long roots are told of."""
    rows = [(f"a/{i}.txt", f"t{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "path string, content string").select("path", F.sha2("content", 256).alias("sha256"), "content", F.lit(None).cast("string").alias("error"))
    first = reduce_tree(df, state.empty(spark), CONFIG, Digest(), full=True)
    other = config.Config(num_ctx=600, model_id="x", extraction_steps=CONFIG.extraction_steps)
    assert reduce_tree(df, first.state, other, Digest()).noop
    whole = reduce_tree(df, first.state, CONFIG, Digest(), whole_config=True)
    assert whole.whole and whole.extracted.count() == 3
    assert reduce_tree(df, whole.state, CONFIG, Digest(), whole_config=True).noop
    assert reduce_tree(df, whole.state, other, Digest(), whole_config=True).extracted.count() == 3
    assert reduce_tree(df, first.state, CONFIG, Digest(), full=True).extracted.count() == 3
    assert reduce_tree(df, first.state, CONFIG, Digest(), full=True, reuse=True).extracted.count() == 0
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for i in range(5):
        safety.write_inside(tmp_path, f"{i}.txt", "x" * 1500)
    engine = Engine(spark, str(tmp_path), CONFIG, Head(1530))
    engine.init()
    assert engine.events.table().filter("kind = 'warning' and message like '%sent whole%'").count() == 1
