"""A data source for file trees: `spark.read.format("repo_files")`, partitions of at most 32 MB or one file.

Ignored directories are pruned while partitions are planned, so nothing below them is read.  Filters on the path
(equality, IN, a prefix) are pushed down: other directories are not even listed, and other files not read.  Names
beginning with `_` are read like any others.  A file that cannot be read is a row with an error.  The root must be a
folder that driver and executors see alike.  Planning lists on the driver; for trees that are too large for that, and
for updates, see listing.py and files.py.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from arborfold.functions.paths import ignored_by
from arborfold.plans.safety import read_inside

SCHEMA = "path string, sha256 string, content string, error string"


def _each_byte(e: UnicodeError):
    return "�" * (e.end - e.start), e.end


codecs.register_error("arborfold-bytes", _each_byte)


def decode(data: bytes) -> str:
    """One replacement character for each byte that is not UTF-8."""
    return data.decode("utf-8", "arborfold-bytes")


def read_ignore_file(root: str) -> list[str]:
    """The rules of the root's .gitignore, without blank lines and comments; none if there is no file."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return [x for line in f if (x := line.strip()) and not x.startswith("#")]
    except FileNotFoundError:
        return []


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, root: str, rules: list[str]) -> None:
        self.root, self.rules = root, rules
        self.asked: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.asked = values if self.asked is None else self.asked & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return path.startswith(self.prefix) and (self.asked is None or path in self.asked)

    def _leads(self, directory: str) -> bool:
        """Whether something that is asked for may lie below."""
        below = directory + "/"
        return (below.startswith(self.prefix) or self.prefix.startswith(below)) and (self.asked is None or any(a.startswith(below) for a in self.asked))

    def partitions(self) -> list[InputPartition]:
        from arborfold.sources.listing import entries

        out, test, todo = [_Files([])], ignored_by(self.rules), ["."]
        size = 0
        while todo:
            files, dirs = entries(self.root, todo.pop(), test)
            todo.extend(d for d in reversed(dirs) if self._leads(d))
            for path, n, *_ in files:
                if self._wanted(path):
                    if out[-1].names and size + n > 32 << 20:
                        out.append(_Files([]))
                        size = 0
                    out[-1].names.append(path)
                    size += n
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.names:
            try:
                data = read_inside(self.root, path)
                yield path, hashlib.sha256(data).hexdigest(), decode(data), None
            except (OSError, ValueError) as e:
                yield path, None, None, str(e)


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], json.loads(self.options.get("rules", "[]")))


def repo_files(spark: SparkSession, root: str, rules: list[str]) -> DataFrame:
    """(path, sha256, content, error) of all files of root that are not ignored."""
    spark.dataSource.register(RepoFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("repo_files").option("rules", json.dumps(rules)).load(root)
