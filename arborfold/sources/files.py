"""Files in two phases: an index of what is there, and the contents of those that are asked for.

A folder's index takes the hash of a file from the fingerprints of the last run (size, times and hash) if nothing
shows that it has changed; others are read to be hashed, and their contents stay where they are.  A change within
`settle` seconds before the last scan could have been missed by equal times, so such a file is read again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from functools import cached_property
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.operators.prefix import running
from arborfold.plans.safety import read_inside, resolve_inside
from arborfold.plans.scratch import saved
from arborfold.sources.listing import listing
from arborfold.sources.repo_files import decode

PRINTS = "path string, sha256 string, size long, mtime long, ctime long, seen long"
#: Bytes that one task reads.
TASK_BYTES = 32 << 20


class Source(Protocol):
    index: DataFrame  # (path, sha256, error), and (size, mtime, ctime, seen, hashed) or nulls

    def read(self, paths: DataFrame) -> DataFrame:
        """(path, content) of paths (path)."""
        ...


class TableFiles:
    """Files that are rows (path, sha256, content, error) of a table."""

    def __init__(self, files: DataFrame) -> None:
        self.files = files

    @cached_property
    def index(self) -> DataFrame:
        none = [F.lit(None).cast("long").alias(c) for c in ("size", "mtime", "ctime", "seen")]
        return saved(self.files.select("path", "sha256", "error", *none, F.lit(False).alias("hashed")))

    def read(self, paths: DataFrame) -> DataFrame:
        return self.files.filter("error is null").select("path", "content").join(paths.select("path"), "path", "left_semi")


def _hash(root: str):
    def one(path: str) -> tuple[str | None, str | None]:
        digest = hashlib.sha256()
        try:
            with open(resolve_inside(root, path), "rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            return digest.hexdigest(), None
        except (OSError, ValueError) as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], names=["path", "sha256", "error"])

    return run


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    text = decode(read_inside(root, path))
                except (OSError, ValueError):  # gone since it was hashed: the next run sees to it
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.large_string())], names=["path", "content"])

    return run


class FolderFiles:
    """Files below root.  known: fingerprints (path, sha256, size, mtime, ctime, seen) of the last run."""

    def __init__(self, spark: SparkSession, root: str, rules: list[str], known: DataFrame | None = None, settle: float = 2.0, task_bytes: int = TASK_BYTES) -> None:
        self.spark, self.root, self.rules, self.known, self.settle, self.task_bytes = spark, root, rules, known, settle, task_bytes

    def _dealt(self, files: DataFrame) -> DataFrame:
        """files (path, size) in tasks of about task_bytes, by running totals; a file is worth 4096 bytes at least."""
        worth = F.greatest("size", F.lit(4096))
        total = files.agg(F.sum(worth)).first()[0] or 0
        if total <= self.task_bytes:
            return files.select("path").coalesce(1)
        placed = running(files.select("path", "size"), [], ["path"], before=worth).withColumn("task", F.floor(F.col("before") / self.task_bytes))
        return placed.repartition(total // self.task_bytes + 1, "task").select("path")

    @cached_property
    def index(self) -> DataFrame:
        now = time.time_ns()  # before anything is listed
        found = listing(self.spark, self.root, self.rules)
        known = self.known if self.known is not None else self.spark.createDataFrame([], PRINTS)
        known = known.select("path", *(F.col(c).alias(f"old_{c}") for c in ("sha256", "size", "mtime", "ctime", "seen")))
        settled = F.greatest("mtime", "ctime") + int(self.settle * 1e9) < F.col("old_seen")
        same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) & (F.col("ctime") == F.col("old_ctime")) & settled
        both = saved(found.join(known, "path", "left").withColumn("same", F.coalesce(same, F.lit(False))))
        fresh = self._dealt(both.filter("not same")).mapInArrow(_hash(self.root), "path string, sha256 string, error string")
        times = ["size", "mtime", "ctime"]
        old = both.filter("same").select("path", F.col("old_sha256").alias("sha256"), F.lit(None).cast("string").alias("error"), *times, F.col("old_seen").alias("seen"), F.lit(False).alias("hashed"))
        new = fresh.join(both.select("path", *times), "path").select("path", "sha256", "error", *times, F.lit(now).alias("seen"), F.lit(True).alias("hashed"))
        return saved(old.union(new))

    def read(self, paths: DataFrame) -> DataFrame:
        asked = self.index.select("path", "size").join(paths.select("path"), "path", "left_semi")
        return self._dealt(asked).mapInArrow(_read(self.root), "path string, content string")
