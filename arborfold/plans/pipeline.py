"""The whole: a first run over all files, and updates that redo only what a change touches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce as fold
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.config import Config
from arborfold.functions.paths import base_name, directory, page
from arborfold.functions.text import guidelines, reduce_budget, steps_hash, strip_fence
from arborfold.operators.facts import extract, synthesise
from arborfold.operators.tree import affected, changes, directly_affected, directories
from arborfold.plans.backends import Backend
from arborfold.plans.events import Event, Events, Log, quiet
from arborfold.plans.journal import digest
from arborfold.plans.safety import LockHeld, ensure_lock_is_ignored, in_git, lock, resolve_inside, write_inside
from arborfold.plans.scratch import saved
from arborfold.plans.state import Delta, State, Store, empty
from arborfold.sources.files import FolderFiles, Source, TableFiles
from arborfold.sources.listing import listing
from arborfold.sources.repo_files import read_ignore_file
from arborfold.sources.text_tree import remove_files, write_tree

AGENTS_FILE, MARKER = "AGENTS.md", "AI Agent Guidelines"


@dataclass
class Result:
    state: State
    affected: DataFrame
    rebuilt: DataFrame  # (path, summary) made in this run
    extracted: DataFrame  # (path) whose facts were asked for
    noop: bool = False
    deleted: DataFrame | None = None  # (path) of files that are gone, in order
    unreadable: DataFrame | None = None  # (path, error), in order
    delta: Delta = field(default_factory=Delta)  # what differs from the state that the run began with
    whole: bool = False  # nothing of that state counts any more


def facts_of(source: Source, index: DataFrame, known: DataFrame, config: Config, backend: Backend, log: Log = quiet) -> tuple[DataFrame, DataFrame]:
    """(path, sha256, facts) of all files of index, those unchanged from known, and of those extracted.

    Only the contents of files that are extracted are read.  New facts are written before anything is built on them: a
    failure later loses none.  What is unchanged is not written again.
    """
    old = known.select("path", F.col("sha256").alias("was"), F.col("facts").alias("had"))
    joined = index.filter("error is null").select("path", "sha256").join(old, "path", "left")
    hit = joined.filter("was = sha256").select("path", "sha256", F.col("had").alias("facts"))
    missed = saved(joined.filter("was is null or was <> sha256").select("path", "sha256"))
    new = extract(source.read(missed.select("path")), backend, config.steps, config.system_prompt, config.file_fact_consolidation_prompt, config.num_ctx, log)
    made = saved(missed.join(new, "path"))
    return hit.union(made), made


def fingerprint(config: Config) -> str:
    """Of all that shapes an answer: steps, model, context and prompts."""
    parts = [steps_hash(config.steps), config.model_id, str(config.num_ctx), config.system_prompt, config.module_synthesis_prompt, config.architecture_prompt, config.file_fact_consolidation_prompt]
    return digest(*parts)


def reduce_tree(files: DataFrame | Source, state: State, config: Config, backend: Backend, pages: DataFrame | None = None, full: bool = False, propagate_deleted: bool = True, log: Log = quiet, reuse: bool = False, whole_config: bool = False) -> Result:
    """One run over files, a table (path, sha256, content, error) or a source of two phases, given the state of the last.

    propagate_deleted: whether directories above one whose last file is gone are done again.  reuse: whether a full run
    takes facts of unchanged files from the state.  whole_config: whether model, context and prompts other than the
    steps count as the steps do, which all files are extracted anew for.
    """
    source = TableFiles(files) if isinstance(files, DataFrame) else files
    index = source.index
    spark = index.sparkSession
    now = fingerprint(config) if whole_config else steps_hash(config.steps)
    whole = full
    if not reuse and (full or state.steps_hash != now):
        if not full:
            log("warning", spark.range(1).select(F.lit("the steps have changed: all files are extracted again")))
        whole, state = True, State(*(x.limit(0) for x in (state.files, state.modules)), prints=state.prints, number=state.number)
    here = index if full else index.filter("error is null")
    dirs = saved(directories(here))
    unreadable = index.filter("error is not null").select("path", "error").orderBy("path")
    pages = dirs.select("path").join(state.modules.select("path"), "path", "left_semi") if pages is None else pages
    prints = index.filter("hashed and error is null").select("path", "sha256", "size", "mtime", "ctime", "seen")
    lost = lambda old, new: old.select("path").join(new.select("path"), "path", "left_anti")
    delta = Delta({"prints": prints}, {"prints": lost(state.prints, index)} if state.prints is not None else {})
    deleted = None
    if full:
        touched = dirs.select("path")
    else:
        current = here.select("path", F.coalesce("sha256", F.lit("")).alias("sha256"))
        diff = saved(changes(current, state.files))
        deleted = diff.filter("status = 'Deleted'").select("path").orderBy("path")
        direct = directly_affected(dirs, diff, pages, state.modules)
        touched = saved(affected(dirs, direct, diff.filter("status = 'Deleted'").select("path") if propagate_deleted else None))
        if touched.isEmpty():
            return Result(state, touched, dirs.select("path", F.lit("").alias("summary")).limit(0), index.select("path").limit(0), True, deleted, unreadable, delta)
    facts, made = facts_of(source, index, state.files, config, backend, log)
    todo = saved(dirs.join(touched, "path", "left_semi").select("path", "depth"))
    kept = state.modules.join(dirs.select("path"), "path", "left_semi").join(touched, "path", "left_anti").select("path", "summary")
    # of the facts only those in directories that are done again are read for it
    wanted = facts.join(todo.select(F.col("path").alias("dir")), directory(facts["path"]) == F.col("dir"), "left_semi")
    rebuilt = synthesise(todo, saved(wanted), kept, backend, config.system_prompt, config.module_synthesis_prompt, config.num_ctx, log)
    after = State(facts, kept.union(rebuilt), now, None, state.number)
    delta.rows |= {"files": made, "modules": rebuilt}
    delta.gone |= {"files": lost(state.files, index.filter("error is null")), "modules": lost(state.modules, dirs)}
    seen = index.filter("seen is not null and error is null").select("path", "sha256", "size", "mtime", "ctime", "seen")
    after.prints = seen
    return Result(after, touched, rebuilt, made.select("path"), False, deleted, unreadable, delta, whole)


def global_prompts(root_summary: DataFrame, config: Config) -> DataFrame:
    """(page, system, user) of the two pages on the whole, both from the root's summary."""
    system = F.lit(f"{config.system_prompt}\n{config.architecture_prompt}")
    pages = F.explode(F.array(F.struct(F.lit("architecture.md").alias("page"), F.lit("Create architecture.md. Base it on the root module summary:\n").alias("ask")), F.struct(F.lit("quickstart.md").alias("page"), F.lit("Create quickstart.md. Base it on the root module summary:\n").alias("ask"))))
    p = root_summary.select("summary", pages.alias("p"))
    return p.select("p.page", system.alias("system"), F.concat("p.ask", "summary").alias("user"))


GLOBAL_PAGES = ("architecture.md", "quickstart.md")


def call_plan(files: DataFrame | Source, config: Config, backend: Backend) -> DataFrame:
    """(path, calls): the calls of a first run for each file, directory and global page, by a run with a stand-in backend.

    Digest() stands for a model whose answers are short, Head(n) for one whose answers have n characters.
    """
    told: list[DataFrame] = []
    log = lambda kind, messages: told.append(messages.toDF("message")) if kind in ("extracted", "reduced") else None
    result = reduce_tree(files, empty(files.sparkSession if isinstance(files, DataFrame) else files.index.sparkSession), config, backend, full=True, log=log)
    pages = result.rebuilt.filter("path = '.'").select(F.explode(F.array(*map(F.lit, GLOBAL_PAGES))).alias("path"))
    calls = fold(DataFrame.union, told).select(F.regexp_extract("message", r"(?s)^(.*): (?:step|batch) \d+", 1).alias("path")).union(pages)
    return calls.groupBy("path").agg(F.count("*").alias("calls"))


def agent_section(docs_dir: str) -> str:
    return f"# {MARKER}\n\nGenerated documentation of this repository is in {docs_dir}: {docs_dir}/architecture.md for the system as a whole, {docs_dir}/quickstart.md to begin with, and {docs_dir}/modules/ with a page for each directory.\n\n"


class Engine:
    """init() and update() of a folder, with pages in its docs_dir.

    settle: see FolderFiles.  verify: whether an update reads every file to hash it, whatever its size and times say.
    reuse, whole_config, propagate_deleted: see reduce_tree().
    """

    def __init__(self, spark: SparkSession, root: str, config: Config, backend: Backend, on_event: Event | None = None, require_git: bool = True, ignore_agents_file: bool = True, propagate_deleted: bool = True, settle: float = 2.0, verify: bool = False, reuse: bool = False, whole_config: bool = False) -> None:
        self.spark, self.root, self.config, self.backend = spark, root, config, backend
        self.on_event, self.require_git = on_event, require_git
        self.ignore_agents_file, self.propagate_deleted = ignore_agents_file, propagate_deleted
        self.settle, self.verify, self.reuse, self.whole_config = settle, verify, reuse, whole_config
        self.group = ""
        self.store = Store(spark, str(Path(root, config.docs_dir, ".state")))
        self.events = Events(spark, f"file://{Path(root, config.docs_dir, '.events').absolute()}", "none", on_event)

    def rules(self) -> list[str]:
        """Configured rules, the docs folder, the root's ignore file; later ones win."""
        own = [f"/{AGENTS_FILE}"] if self.ignore_agents_file else []
        return [*self.config.ignore, self.config.docs_dir, *own, *read_ignore_file(self.root)]

    def run(self, mode: str) -> Result:
        if mode not in ("init", "update"):
            raise ValueError(f"unknown mode {mode}")
        if self.require_git and not in_git(self.root):
            raise RuntimeError(f"{self.root} is in no git repository")
        self.events.run = uuid.uuid4().hex
        told = self.events
        try:
            ensure_lock_is_ignored(self.root)
        except OSError as e:
            told.one("warning", str(e))
        with lock(self.root) as held, self._cancellable():
            if self.store.exists() != (mode == "update"):
                raise RuntimeError("there is a state already: update it" if mode == "init" else "there is no state yet: init first")
            if journal := getattr(self.backend, "journal", None):
                journal.begin()
            told.one("status", f"{mode}: scanning {self.root}")
            state = self.store.load()
            files = FolderFiles(self.spark, self.root, self.rules(), None if self.verify else state.prints, self.settle)
            result = reduce_tree(files, state, self.config, self.backend, None if mode == "init" else self._pages(), mode == "init", self.propagate_deleted, told.rows, self.reuse, self.whole_config)
            told.rows("warning", result.unreadable.select(F.concat("path", F.lit(" can't be read: "), "error")))
            if result.deleted is not None:
                told.rows("deleted", result.deleted)
            if held.lost():
                raise LockHeld("another run has taken the lock, as this one did not touch it")
            if result.noop:
                if not result.delta.rows["prints"].isEmpty():  # touched, but the same
                    self.store.append(result.delta, state.steps_hash, state.number)
                told.one("success", "nothing has changed")
                return result
            self._write(result, state, mode)
            if journal:
                journal.forget()
            return result

    @contextmanager
    def _cancellable(self) -> Iterator[None]:
        """The jobs of a run are a group of their own."""
        sc = self.spark.sparkContext
        self.group = f"arborfold-{uuid.uuid4().hex}"
        sc.setJobGroup(self.group, f"arborfold {self.root}", interruptOnCancel=True)
        try:
            yield
        finally:
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                sc.setLocalProperty(name, None)

    def cancel(self) -> None:
        """Stop a run in progress, its jobs now and to come, from another thread: it fails, and gives its lock back."""
        if self.group:
            self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.group)

    def _folder(self) -> Path:
        return resolve_inside(self.root, self.config.docs_dir)

    def _pages(self) -> DataFrame:
        """(path) of the directories that have a page."""
        top = self._folder() / "modules"
        if not top.exists():
            return self.spark.createDataFrame([], "path string")
        return saved(listing(self.spark, str(top), []).filter(base_name(F.col("path")) == "README.md").select(directory(F.col("path")).alias("path")))

    def _write(self, result: Result, state: State, mode: str) -> None:
        docs = self.config.docs_dir
        # the state first, so that pages never hold more than it knows
        if mode == "init" or result.whole:
            self.store.save(result.state)
        else:
            self.store.append(result.delta, result.state.steps_hash, state.number)
        held = self.store.load()
        written = result.rebuilt.select(page(F.col("path")).alias("path"), F.col("summary").alias("content"))
        write_tree(written, str(self._folder() / "modules"), self.root)
        self.events.rows("page", written.select(F.concat(F.lit("modules/"), "path")))
        stale = self._pages().join(held.modules.select("path"), "path", "left_anti")
        remove_files(stale.select(F.concat(F.lit(f"{docs}/modules/"), page(F.col("path"))).alias("path")), self.root)
        root = held.modules.filter("path = '.'").select("summary")
        missing = not all((self._folder() / x).exists() for x in GLOBAL_PAGES)
        if mode == "init" or missing or not result.affected.filter("path = '.'").isEmpty():
            most = reduce_budget(self.config.num_ctx)
            long = F.concat(F.lit("the root's summary has "), F.char_length("summary"), F.lit(f" characters, more than the {most} that fit; it is sent whole"))
            self.events.rows("warning", root.filter(F.char_length("summary") > most).select(long))
            answers = global_prompts(root, self.config).withColumn("text", strip_fence(self.backend.complete(F.col("system"), F.col("user")))).select("page", "text")
            for r in answers.collect():  # two rows
                write_inside(self.root, f"{docs}/{r.page}", r.text)
                self.events.one("page", r.page)
        if mode == "init":
            path = resolve_inside(self.root, AGENTS_FILE)
            old = path.read_text() if path.exists() else None
            new = self.spark.createDataFrame([(old,)], "c string").select(guidelines(F.col("c"), agent_section(docs), MARKER)).first()[0]
            write_inside(self.root, AGENTS_FILE, new)
        self.events.one("success", "done")

    def init(self) -> Result:
        return self.run("init")

    def update(self) -> Result:
        return self.run("update")
