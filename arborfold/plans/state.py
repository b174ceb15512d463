"""What is kept between runs: file facts, module summaries, fingerprints and the hash of the steps.

A state is a log of versions and Parquet segments.  A version names for each table its segments in order: rows of a
later one replace those of an earlier one by path, and rows marked `gone` delete.  A run appends segments with what it
has changed and then the next version, so it writes in proportion to the change.  Each segment is dealt by a hash of the
path.  When later segments are many they are merged into one, and when they hold half as many rows as the first, all
are; so each row is written again a bounded number of times on average.

A version is created exclusively under the next number: of two writers that began with the same version one fails, and a
holder of an expired lock, who comes late, can't replace what a later one wrote.  Segments that no kept version names
are deleted.  The folder may be on any file system that Hadoop knows.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
FILES, MODULES = "path string, sha256 string, facts string", "path string, summary string"
PRINTS = "path string, sha256 string, size long, mtime long, ctime long, seen long"
TABLES = {"files": FILES, "modules": MODULES, "prints": PRINTS}


class StateConflict(RuntimeError):
    pass


class State:
    def __init__(self, files: DataFrame, modules: DataFrame, steps_hash: str = "", prints: DataFrame | None = None, number: int = 0) -> None:
        self.files, self.modules, self.steps_hash, self.prints, self.number = files, modules, steps_hash, prints, number


@dataclass
class Delta:
    """What a run changes: for each table the rows that are new or other, and the paths that go."""

    rows: dict[str, DataFrame] = field(default_factory=dict)
    gone: dict[str, DataFrame] = field(default_factory=dict)


def empty(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], FILES), spark.createDataFrame([], MODULES), prints=spark.createDataFrame([], PRINTS))


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 4, most: int = 8, keep: int = 2) -> None:
        """buckets: files of a segment; most: later segments before they are merged; keep: versions whose segments stay."""
        self.spark, self.folder, self.buckets, self.most, self.keep = spark, folder if "://" in folder else os.path.abspath(folder), buckets, most, keep

    # ---- the log

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder if "://" in self.folder else f"file://{self.folder}", *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Of the versions there are."""
        fs, log = self._fs(), self._path("log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        return bool(self.numbers())

    def _entry(self, number: int) -> dict:
        stream = self._fs().open(self._path("log", f"{number:08d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _create(self, number: int, entry: dict) -> None:
        """The next version; StateConflict if another writer has made it."""
        text = json.dumps(entry).encode()
        if "://" not in self.folder:  # complete and exclusive in one step
            os.makedirs(os.path.join(self.folder, "log"), exist_ok=True)
            part, target = os.path.join(self.folder, "log", f".{uuid.uuid4().hex}"), os.path.join(self.folder, "log", f"{number:08d}.json")
            try:
                with open(part, "wb") as f:
                    f.write(text)
                    f.flush()
                    os.fsync(f.fileno())
                os.link(part, target)
            except FileExistsError as e:
                raise StateConflict(f"version {number} of {self.folder} was written by another run") from e
            finally:
                os.unlink(part)
            return
        try:
            out = self._fs().create(self._path("log", f"{number:08d}.json"), False)
        except Exception as e:
            raise StateConflict(f"version {number} of {self.folder} was written by another run") from e
        out.write(text)
        out.close()

    # ---- segments

    def _write(self, name: str, rows: DataFrame, gone: DataFrame | None) -> dict | None:
        """A segment of rows and of paths that go; None if it would be empty."""
        columns = [c.split(" ")[0] for c in TABLES[name].split(", ")]
        out = rows.select(*columns, F.lit(False).alias("gone"))
        if gone is not None:
            out = out.unionByName(gone.select("path", F.lit(True).alias("gone")), allowMissingColumns=True)
        where = f"{name}/{uuid.uuid4().hex}"
        out.repartition(self.buckets, "path").sortWithinPartitions("path").write.parquet(self._path(where).toString())
        n = self._read(name, where).count()
        return {"path": where, "rows": n} if n else None

    def _read(self, name: str, where: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name]}, gone boolean").parquet(self._path(where).toString())

    def _newest(self, name: str, segments: list[dict]) -> DataFrame:
        """(columns, gone) of several segments: the last one's rows count."""
        if len(segments) == 1:
            return self._read(name, segments[0]["path"])
        every = fold(DataFrame.union, (self._read(name, s["path"]).select(F.lit(i).alias("_at"), F.struct("*").alias("_row")) for i, s in enumerate(segments)))
        return every.groupBy("_row.path").agg(F.max_by("_row", "_at").alias("_row")).select("_row.*")

    def _table(self, name: str, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        first, later = segments[0], segments[1:]
        base = self._read(name, first["path"])
        if later:  # the first segment, by far the largest, is only filtered
            new = self._newest(name, later)
            base = base.join(new.select("path"), "path", "left_anti").select(base.columns).union(new.select(base.columns))
        return base.filter("not gone").drop("gone")

    def load(self) -> State:
        """Nothing, or another format: empty.  A broken version is an error."""
        if not (numbers := self.numbers()):
            return empty(self.spark)
        at = self._entry(numbers[-1])
        state = empty(self.spark)
        if at.get("version") == VERSION:
            tables = {t: self._table(t, at.get("tables", {}).get(t, [])) for t in TABLES}
            state = State(tables["files"], tables["modules"], at.get("steps_hash", ""), tables["prints"])
        state.number = numbers[-1]
        return state

    def save(self, state: State) -> int:
        """The whole of a state as the next version; its number."""
        prints = state.prints if state.prints is not None else self.spark.createDataFrame([], PRINTS)
        rows = {"files": state.files, "modules": state.modules, "prints": prints}
        tables = {t: [s] if (s := self._write(t, rows[t], None)) else [] for t in TABLES}
        number = max(self.numbers(), default=0) + 1
        self._create(number, {"version": VERSION, "steps_hash": state.steps_hash, "tables": tables})
        self._expire()
        return number

    def append(self, delta: Delta, steps_hash: str, number: int) -> int:
        """The next version after `number`, the one that the run began with."""
        at = self._entry(number)
        tables = {t: list(at.get("tables", {}).get(t, [])) for t in TABLES}
        for name in TABLES:
            if name in delta.rows or name in delta.gone:
                rows = delta.rows.get(name)
                rows = self.spark.createDataFrame([], TABLES[name]) if rows is None else rows
                if segment := self._write(name, rows, delta.gone.get(name)):
                    tables[name].append(segment)
                tables[name] = self._merged(name, tables[name])
        self._create(number + 1, {"version": VERSION, "steps_hash": steps_hash, "tables": tables})
        self._expire()
        return number + 1

    def _merged(self, name: str, segments: list[dict]) -> list[dict]:
        later = segments[1:]
        if later and 2 * sum(s["rows"] for s in later) >= segments[0]["rows"]:
            whole = self._write(name, self._table(name, segments), None)
            return [whole] if whole else []
        if len(later) > self.most:
            new = self._newest(name, later)
            merged = self._write(name, new.filter("not gone").drop("gone"), new.filter("gone").select("path"))
            return [segments[0], merged] if merged else segments[:1]
        return segments

    def _expire(self) -> None:
        """Old versions, and the segments that none of the kept ones names."""
        fs, numbers = self._fs(), self.numbers()
        for n in numbers[: -self.keep]:
            fs.delete(self._path("log", f"{n:08d}.json"), False)
        used = {s["path"] for n in numbers[-self.keep :] for t in self._entry(n).get("tables", {}).values() for s in t}
        for name in TABLES:
            top = self._path(name)
            for s in fs.listStatus(top) if fs.exists(top) else []:
                if f"{name}/{s.getPath().getName()}" not in used:
                    fs.delete(s.getPath(), True)


# ---- exchange as JSON

HEAD = "version int, steps_hash string"
LINE = f"{HEAD}, kind string, path string, sha256 string, facts string, summary string"
DOCUMENT = f"{HEAD}, files map<string, struct<sha256: string, facts: string>>, modules map<string, string>"


def to_json(state: State) -> DataFrame:
    """Rows (json): a head with version and steps_hash, then one for each file and module.  Nothing is brought together."""
    spark = state.files.sparkSession
    head = spark.range(1).select(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(state.steps_hash).alias("steps_hash"))).alias("json"))
    files = state.files.select(F.to_json(F.struct(F.lit("file").alias("kind"), "path", "sha256", "facts")).alias("json"))
    modules = state.modules.select(F.to_json(F.struct(F.lit("module").alias("kind"), "path", "summary")).alias("json"))
    return head.union(files).union(modules)


def from_json(lines: DataFrame) -> State:
    """Of rows (json) as to_json() makes them; another version gives an empty state, broken JSON is an error."""
    rows = lines.select(F.from_json("json", LINE, {"mode": "FAILFAST"}).alias("j")).select("j.*")
    head = rows.filter("kind is null").select("version", "steps_hash").first()
    if head is None or head.version != VERSION:
        return empty(lines.sparkSession)
    return State(rows.filter("kind = 'file'").select("path", "sha256", "facts"), rows.filter("kind = 'module'").select("path", "summary"), head.steps_hash or "")


def from_document(document: DataFrame) -> State:
    """Of one row (json) that holds all: {version, steps_hash, files: {path: {sha256, facts}}, modules: {path: summary}}."""
    parsed = document.select(F.from_json("json", DOCUMENT, {"mode": "FAILFAST"}).alias("j")).select("j.*")
    head = parsed.select("version", "steps_hash").first()
    if head is None or head.version != VERSION:
        return empty(document.sparkSession)
    files = parsed.select(F.explode("files").alias("path", "v")).select("path", "v.sha256", "v.facts")
    return State(files, parsed.select(F.explode("modules").alias("path", "summary")), head.steps_hash or "")
