"""Updates from a stream of file versions: each micro-batch of (path, version, content) is one update.

For each path the stream's own state holds the version that counts and its hash.  A version that is not newer is
dropped, whenever it comes; null content deletes; a newer version with the same content changes nothing but the version.
What is left of a batch are changes, and only they are written: contents to a folder for each batch, facts and
summaries to the store.  A batch that is run again after a failure finds the state it found the first time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce as fold

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from arborfold.config import Config
from arborfold.plans.backends import Backend
from arborfold.plans.pipeline import reduce_tree
from arborfold.plans.scratch import saved
from arborfold.plans.state import State, Store

CHANGES = "path string, version long, content string"


def _newer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest version of a path, if it is newer than the one held and has other content.  Ties in a batch: the greater content."""
    version, sha = state.get if state.exists else (None, None)
    best = None
    for f in frames:
        for v, c in zip(f["version"], f["content"], strict=True):
            if v is not None and not pd.isna(v) and (version is None or v > version):
                this = (int(v), isinstance(c, str), c if isinstance(c, str) else "")
                best = max(best or this, this)
    if best is None:
        return
    new = hashlib.sha256(best[2].encode()).hexdigest() if best[1] else None
    state.update((best[0], new))
    if version is None and new is None:
        return  # deleted before it was ever seen
    if version is None or new != sha:
        yield pd.DataFrame({"path": [key[0]], "version": [best[0]], "content": [best[2] if best[1] else None]})


def changes(versions: DataFrame) -> DataFrame:
    """(path, version, content) of a stream of them: what counts, once, in the order of versions for each path."""
    keyed = versions.filter("path is not null").select("path", F.col("version").cast("long").alias("version"), "content").groupBy("path")
    return keyed.applyInPandasWithState(_newer, CHANGES, "version long, sha256 string", "append", "NoTimeout")


class Contents:
    """The contents of files, as changes in a folder for each batch; folders are merged when they are more than `most`."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 16) -> None:
        self.spark, self.folder, self.most = spark, folder, most

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches that are complete."""
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self._path())] if fs.exists(self._path()) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch-") and fs.exists(self._path(f"{n}/_SUCCESS")))

    def add(self, number: int, changed: DataFrame) -> None:
        changed.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        # the batch before may still be read by this one's update: merge what is older
        if len(old := [n for n in self.batches() if n < number - 1]) > self.most:
            merged = self._newest(old).filter("content is not null")
            merged.write.mode("overwrite").parquet(f"{self.folder}/merged-{number}")
            fs = self._fs()
            fs.delete(self._path(f"batch-{old[-1]}"), True)
            fs.rename(self._path(f"merged-{number}"), self._path(f"batch-{old[-1]}"))
            for n in old[:-1]:
                fs.delete(self._path(f"batch-{n}"), True)

    def _newest(self, numbers: list[int]) -> DataFrame:
        every = fold(DataFrame.union, (self.spark.read.schema(CHANGES).parquet(f"{self.folder}/batch-{n}") for n in numbers))
        return every.groupBy("path").agg(F.max_by(F.struct("version", "content"), "version").alias("x")).select("path", "x.*")

    def read(self, paths: DataFrame) -> DataFrame:
        numbers = self.batches()
        if not numbers:
            return self.spark.createDataFrame([], "path string, content string")
        asked = paths.select("path")
        return self._newest(numbers).join(asked, "path", "left_semi").filter("content is not null").select("path", "content")


class _Changed:
    """The files that the store knows with the changes of a batch, as a source: contents come from the batch, others only if asked for."""

    def __init__(self, state: State, changed: DataFrame, contents: Contents) -> None:
        self.contents = contents
        none = [F.lit(None).cast("long").alias(c) for c in ("size", "mtime", "ctime", "seen")]
        new = changed.filter("content is not null").select("path", F.sha2("content", 256).alias("sha256"))
        files = state.files.select("path", "sha256").join(changed.select("path"), "path", "left_anti").union(new)
        self.index = saved(files.select("path", "sha256", F.lit(None).cast("string").alias("error"), *none, F.lit(False).alias("hashed")))

    def read(self, paths: DataFrame) -> DataFrame:
        return self.contents.read(paths)


def follow(versions: DataFrame, files_dir: str, store: Store, config: Config, backend: Backend, checkpoint: str):
    """The running query.  versions: a stream of (path, version, content); files_dir: where contents are kept."""
    contents = Contents(versions.sparkSession, files_dir)

    def update(batch: DataFrame, number: int) -> None:
        changed = saved(batch)
        if changed.isEmpty() and store.exists():
            return
        contents.add(number, changed)
        state = store.load()
        result = reduce_tree(_Changed(state, changed, contents), state, config, backend, full=not store.exists())
        if result.whole:
            store.save(result.state)
        elif not result.noop:
            store.append(result.delta, result.state.steps_hash, state.number)

    return changes(versions).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
