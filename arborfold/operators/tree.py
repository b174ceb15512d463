"""The directory tree of a set of paths, changes between snapshots, and the directories they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.functions.paths import ancestors, base_name, depth, directory, ignored, never_entered, with_ancestors


def directories(files: DataFrame) -> DataFrame:
    """(path, parent, name, depth) of every directory above a file.  Distinct directories first, then their ancestors: rows shrink before they multiply."""
    own = files.select(directory(F.col("path")).alias("dir")).distinct()
    every = own.select(F.explode(with_ancestors(F.col("dir"))).alias("path")).distinct()
    root = F.col("path") == "."
    return every.select("path", F.when(root, F.lit(None)).otherwise(directory(F.col("path"))).alias("parent"), base_name(F.col("path")).alias("name"), depth(F.col("path")).cast("int").alias("depth"))


def unignored(files: DataFrame, rules: list[str]) -> DataFrame:
    """The rows of files (path, ...) that a scan would find: what lies below an ignored directory never comes back.

    Rules are matched against each directory once, however many files it has; a directory is shut if one at or above it
    is left out, and files look up their own.
    """
    own = files.select(directory(F.col("path")).alias("dir")).filter("dir <> '.'").distinct()
    above = own.select("dir", F.explode(with_ancestors(F.col("dir"))).alias("up")).filter("up <> '.'")
    shut = above.select("up").distinct().filter(never_entered(F.col("up"), rules))
    shut = above.join(shut, "up", "left_semi").select("dir").distinct()
    return files.join(shut, directory(files["path"]) == shut["dir"], "left_anti").filter(~ignored(F.col("path"), rules))


def file_counts(files: DataFrame) -> DataFrame:
    """(path, n_files) of directories with files of their own."""
    return files.groupBy(directory(F.col("path")).alias("path")).agg(F.count("*").alias("n_files"))


def child_counts(dirs: DataFrame) -> DataFrame:
    return dirs.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"), F.min("name").alias("first_child"), F.max("name").alias("last_child"))


def changes(current: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status): Added, Modified or Deleted, by (path, sha256) of both sides."""
    both = current.select("path", F.col("sha256").alias("new")).join(known.select("path", F.col("sha256").alias("old")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").when(F.col("new") != F.col("old"), "Modified")
    return both.select("path", status.alias("status")).filter("status is not null")


def directly_affected(dirs: DataFrame, changed: DataFrame, pages: DataFrame, summaries: DataFrame) -> DataFrame:
    """(path): directories with a changed file, a missing page, or no summary; and those that a deleted file leaves behind."""
    touched = changed.select(directory(F.col("path")).alias("path")).distinct()
    no_page = dirs.select("path").join(pages.select("path"), "path", "left_anti")
    no_summary = dirs.select("path").join(summaries.filter("summary <> ''").select("path"), "path", "left_anti")
    return touched.union(no_page).union(no_summary).distinct()


def affected(dirs: DataFrame, direct: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(path): direct and all directories of the tree above them.

    A directory whose last file is gone is in the tree no more.  With `deleted` (paths) its nearest ancestors that are
    still there count as affected too; without, they keep what they had.
    """
    inside = direct.join(dirs.select("path"), "path", "left_semi")
    up = inside.select(F.explode(with_ancestors(F.col("path"))).alias("path"))
    if deleted is not None:
        up = up.union(deleted.select(F.explode(ancestors(F.col("path"))).alias("path")))
    return up.distinct().join(dirs.select("path"), "path", "left_semi").union(direct.join(dirs.select("path"), "path", "left_anti")).distinct()
