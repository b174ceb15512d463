"""A sink for text files: `df.write.format("text_tree").mode("append").option("root", r).save(folder)`, df (path, content).

Each task writes its files, complete and synced, to a staging folder of its own; when all tasks have ended the driver
moves them to their places, each in one step.  If a task fails, or the job is stopped, nothing has been moved and the
staging folder goes.  A path that leads outside `root`, by itself or by a link, is an error of its task.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from arborfold.plans.safety import resolve_inside


@dataclass
class _Staged(WriterCommitMessage):
    attempt: str


class _Writer(DataSourceWriter):
    def __init__(self, root: str, folder: str) -> None:
        self.root, self.folder = root, folder
        self.stage = os.path.join(folder, f".stage-{uuid.uuid4().hex}")
        os.makedirs(self.stage)  # on the driver; no task makes it again once it is gone

    def _target(self, path: str) -> Path:
        return resolve_inside(self.root, os.path.relpath(os.path.join(self.folder, path.lstrip("/")), self.root))

    def write(self, rows: Iterator[Row]) -> _Staged:
        # an attempt that is repeated has another name; only those that are reported count
        attempt = uuid.uuid4().hex
        with open(os.path.join(self.stage, attempt), "w") as names:
            for k, r in enumerate(rows):
                self._target(r.path)
                with open(os.path.join(self.stage, f"{attempt}.{k}"), "xb") as f:
                    f.write(r.content.encode())
                    f.flush()
                    os.fsync(f.fileno())
                names.write(json.dumps(r.path) + "\n")
        return _Staged(attempt)

    def commit(self, messages) -> None:
        for m in messages:
            with open(os.path.join(self.stage, m.attempt)) as names:
                for k, line in enumerate(names):
                    target = self._target(json.loads(line))
                    target.parent.mkdir(parents=True, exist_ok=True)
                    os.replace(os.path.join(self.stage, f"{m.attempt}.{k}"), target)
        self.abort(messages)

    def abort(self, messages) -> None:
        # renamed first: tasks that are still running find no folder to write to
        gone = os.path.join(self.folder, f".gone-{uuid.uuid4().hex}")
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.stage, gone)
        shutil.rmtree(gone, ignore_errors=True)


class TextTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_tree"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode append")
        folder = self.options["path"]
        return _Writer(self.options.get("root", folder), folder)


def write_tree(files: DataFrame, folder: str, root: str | None = None) -> None:
    """Write files (path, content) below folder, all of them or none.  root: where links may lead; folder if not given."""
    spark = files.sparkSession
    spark.dataSource.register(TextTree)
    os.makedirs(folder, exist_ok=True)
    files.select("path", "content").write.format("text_tree").mode("append").option("root", root or folder).save(folder)


def remove_files(paths: DataFrame, root: str) -> None:
    """Remove files (path) below root, in tasks; what is not there is passed over."""

    def gone(rows: Iterator[Row]) -> None:
        for r in rows:
            resolve_inside(root, r.path).unlink(missing_ok=True)

    paths.select("path").foreachPartition(gone)
