"""What a file tree holds, listed by Spark jobs: names, sizes and times, nothing read.

Directories are listed in rounds.  A task takes its share of the directories that are still to be listed and goes down
from there; after `most` entries it hands the directories it has not come to to the next round, where they are dealt
over all tasks.  So a small tree is one task's work, and a large one is spread after its first entries.  What is below
an ignored directory is never listed.  A directory that can't be listed ends the scan, as a part would count as deleted.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.functions.paths import ignored_by
from arborfold.operators.prefix import running
from arborfold.plans.scratch import saved

LISTED = "path string, size long, mtime long, ctime long"
_ROWS = f"{LISTED}, below boolean"
_KINDS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("ctime", pa.int64()), ("below", pa.bool_())])


def walk_order(path: Column) -> Column:
    """Sorts as a walk does that takes each directory's entries by name and enters directories as it meets them."""
    return F.split(path, "/")


def entries(root: str, here: str, test) -> tuple[list[tuple], list[str]]:
    """(path, size, mtime, ctime) of the files in a directory of root (times in ns), and the directories to enter.

    A symbolic link counts as a file and is never entered; it has no times, as they would not tell what it leads to.
    """
    files, dirs = [], []
    under = "" if here == "." else here + "/"
    with os.scandir(os.path.join(root, here)) as found:
        for e in found:
            path = under + e.name
            if e.is_dir(follow_symlinks=False):
                # a rule for directories names what lies below, so a directory is tested as such
                if not test(path) and not test(f"{path}/x"):
                    dirs.append(path)
            elif not test(path):
                link = e.is_symlink()
                s = e.stat(follow_symlinks=False)
                files.append((path, s.st_size, None if link else s.st_mtime_ns, None if link else s.st_ctime_ns))
    return sorted(files), sorted(dirs)


def _round(root: str, rules: list[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, todo, seen = ignored_by(rules), deque(), 0
        for b in batches:
            todo.extend(b.column("path").to_pylist())
        while todo:
            if seen >= most:
                yield pa.RecordBatch.from_pylist([{"path": d, "below": True} for d in todo], _KINDS)
                return
            files, dirs = entries(root, todo.popleft(), test)
            seen += len(files) + len(dirs) + 1
            todo.extend(dirs)
            if files:
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "size", "mtime", "ctime", "below"), (*f, False), strict=True)) for f in files], _KINDS)

    return run


def listing(spark: SparkSession, root: str, rules: list[str], most: int = 10_000) -> DataFrame:
    """(path, size, mtime, ctime) of every file of root that is not ignored."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo, out = spark.createDataFrame([(".",)], "path string").coalesce(1), None
    while True:
        # written, so that a directory is listed once
        found = saved(todo.mapInArrow(_round(root, rules, most), _ROWS))
        files = found.filter("not below").drop("below")
        out = files if out is None else out.union(files)
        todo = found.filter("below").select("path")
        if todo.isEmpty():
            return out
        todo = todo.repartition(tasks)


def in_order(paths: DataFrame) -> DataFrame:
    """paths with ord: each path's place, from 0, in the walk over the whole tree."""
    placed = running(paths.withColumn("_walk", walk_order(F.col("path"))), [], ["_walk"], ord=F.lit(1))
    return placed.drop("_walk")
