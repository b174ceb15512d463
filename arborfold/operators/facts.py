"""From files to facts, and from facts to module summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfold.functions.paths import base_name, directory
from arborfold.functions.text import chunks, file_budget, overlap_of, reduce_budget, strip_fence, trimmed
from arborfold.operators.reduce import reduce_items, reduce_once
from arborfold.plans.backends import Backend
from arborfold.plans.events import Log, quiet
from arborfold.plans.scratch import saved


def prompts(files: DataFrame, steps: list[tuple[str, str]], system_prompt: str, num_ctx: int) -> DataFrame:
    """(path, step_ord, step, idx, n_chunks, system, user) of each step on each chunk of files (path, content)."""
    limit = file_budget(num_ctx)
    c = files.select("path", chunks(F.col("content"), limit, overlap_of(limit)).alias("c"))
    c = c.select("path", F.size("c").alias("n_chunks"), F.posexplode("c").alias("idx", "chunk"))
    # the steps are a few rows of the configuration: an array in each row, no join
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("step_ord"), F.lit(n).alias("step"), F.lit(f"{system_prompt}\n{p}").alias("system")) for i, (n, p) in enumerate(steps))))
    c = c.withColumn("s", each)
    part = F.when(F.col("n_chunks") > 1, F.concat(F.lit(" (Chunk "), F.col("idx") + 1, F.lit(" of "), F.col("n_chunks"), F.lit(")"))).otherwise("")
    user = F.concat(F.lit("File: "), base_name(F.col("path")), part, F.lit(" inside Module: "), directory(F.col("path")), F.lit("\n```\n"), F.col("chunk"), F.lit("\n```"))
    return c.select("path", F.col("s.step_ord").alias("step_ord"), F.col("s.step").alias("step"), "idx", "n_chunks", F.col("s.system").alias("system"), user.alias("user"))


def assemble(per_step: DataFrame) -> DataFrame:
    """(path, facts) of (path, step_ord, step, fact)."""
    parts = F.array_sort(F.collect_list(F.struct("step_ord", F.concat(F.lit("#### ["), F.col("step"), F.lit("]\n"), F.col("fact"), F.lit("\n\n")).alias("p"))))
    return per_step.groupBy("path").agg(trimmed(F.array_join(F.transform(parts, lambda x: x["p"]), "")).alias("facts"))


def consolidation(grp: Column, joined: Column) -> Column:
    return F.concat(F.lit("Consolidate and deduplicate the extracted facts for "), grp["path"], F.lit(" regarding step '"), grp["step"], F.lit("':\n"), joined)


def consolidate(answers: DataFrame, backend: Backend, prompt: str, num_ctx: int, log: Log = quiet) -> DataFrame:
    """(path, step_ord, step, fact) of (path, step_ord, step, idx, n_chunks, fact): one answer stays as it is, several are reduced."""
    one = answers.filter("n_chunks = 1").select("path", "step_ord", "step", "fact")
    many = answers.filter("n_chunks > 1")
    if many.isEmpty():
        return one
    items = many.select(F.struct("path", "step_ord", "step").alias("grp"), F.col("idx").alias("ord"), F.col("fact").alias("text"))
    got = reduce_items(items, reduce_budget(num_ctx), lambda g, joined: strip_fence(backend.complete(F.lit(prompt), consolidation(g, joined))), log, lambda g: g["path"])
    return one.union(got.select("grp.path", "grp.step_ord", "grp.step", F.col("text").alias("fact")))


def extract(files: DataFrame, backend: Backend, steps: list[tuple[str, str]], system_prompt: str, consolidation_prompt: str, num_ctx: int, log: Log = quiet) -> DataFrame:
    """(path, facts) of files (path, content); a model is asked once for each step and chunk."""
    asked = prompts(files, steps, system_prompt, num_ctx)
    answers = saved(asked.withColumn("fact", strip_fence(backend.complete(F.col("system"), F.col("user")))).drop("system", "user"))
    chunk = F.when(F.col("n_chunks") > 1, F.concat(F.lit(" (chunk "), F.col("idx") + 1, F.lit(" of "), F.col("n_chunks"), F.lit(")"))).otherwise("")
    log("extracted", answers.select(F.concat("path", F.lit(": step "), F.col("step_ord") + 1, F.lit(f" of {len(steps)}, "), "step", chunk)))
    return assemble(consolidate(answers, backend, consolidation_prompt, num_ctx, log))


def components(facts: DataFrame, children: DataFrame) -> DataFrame:
    """(dir, kind, name, text): own files first, then subsystems; what is empty gives none.  children: (path, summary)."""
    own = facts.filter("facts <> ''").select(directory(F.col("path")).alias("dir"), F.lit(0).alias("kind"), base_name(F.col("path")).alias("name"), F.concat(F.lit("### File: "), base_name(F.col("path")), F.lit("\n"), F.col("facts")).alias("text"))
    sub = children.filter("summary <> '' and path <> '.'").select(directory(F.col("path")).alias("dir"), F.lit(1).alias("kind"), base_name(F.col("path")).alias("name"), F.concat(F.lit("### Subsystem: "), base_name(F.col("path")), F.lit("\n"), F.col("summary")).alias("text"))
    return own.union(sub)


def synthesise(dirs: DataFrame, facts: DataFrame, known: DataFrame, backend: Backend, system_prompt: str, module_prompt: str, num_ctx: int, log: Log = quiet) -> DataFrame:
    """(path, summary) of dirs (path, depth), children before their parents.

    known: summaries (path, summary) of directories that are not in dirs and stand as they are.  A directory is begun
    as soon as its last child is done, whatever its depth.  A round is one step of reduction for all directories that
    are begun and not done, so a directory that takes many rounds holds back only those above it, and rounds are as
    many as the longest chain of steps.
    """
    budget = reduce_budget(num_ctx)
    ask = lambda g, joined: strip_fence(backend.complete(F.lit(f"{system_prompt}\n{module_prompt}"), F.concat(F.lit("Synthesize architecture for "), g, F.lit(":\n"), joined)))
    todo = saved(dirs.select("path"))
    parent = F.when(F.col("path") != ".", directory(F.col("path")))
    children = todo.select("path", parent.alias("parent")).join(todo.select(F.col("path").alias("parent")), "parent", "left_semi")
    waiting, done_with, made, items = todo, None, None, None
    while True:
        # begun: those waiting without a child that is not done
        open_children = children if made is None else children.join(made.select("path"), "path", "left_anti")
        begun = saved(waiting.join(open_children.select(F.col("parent").alias("path")), "path", "left_anti"))
        summaries = known if made is None else known.union(made)
        parts = components(facts, summaries).join(begun.select(F.col("path").alias("dir")), "dir", "left_semi")
        new = saved(parts.select(F.col("dir").alias("grp"), F.struct("kind", "name").alias("ord"), "text"))
        counts = new.groupBy(F.col("grp").alias("path")).agg(F.count("*").alias("parts"))
        log("directory", counts.select(F.concat(F.col("path"), F.lit(": "), F.col("parts"), F.lit(" components"))))
        bare = begun.join(counts.select("path"), "path", "left_anti").select("path", F.lit("").alias("summary"))
        active = new if items is None else new.union(items)
        ended, left = reduce_once(active, budget, ask, log)
        ended = saved(bare.union(ended.select(F.col("grp").alias("path"), F.col("text").alias("summary"))))
        made = ended if made is None else made.union(ended)
        done_with = begun if done_with is None else done_with.union(begun)
        waiting = todo.join(done_with, "path", "left_anti")
        items = left.select("grp", F.struct(F.col("ord").alias("kind"), F.lit("").alias("name")).alias("ord"), "text")
        if items.isEmpty() and waiting.isEmpty():
            return made
