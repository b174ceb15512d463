"""What a run tells: progress by file, step and directory, warnings, what was written.

Events that rows make (a line for each file and step, for each directory) are built and written by executors, to a
table (run, kind, message) beside the state; the driver's callback gets them one partition at a time, if there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Event = Callable[[str, str], None]
#: kind, one column of messages
Log = Callable[[str, DataFrame], None]
EVENTS = "run string, kind string, message string"


def quiet(kind: str, messages: DataFrame) -> None:
    return None


class Events:
    def __init__(self, spark: SparkSession, folder: str, run: str, tell: Event | None) -> None:
        self.spark, self.folder, self.run, self.tell = spark, folder, run, tell

    def one(self, kind: str, message: str) -> None:
        """From the driver: to the callback only."""
        if self.tell:
            self.tell(kind, message)

    def rows(self, kind: str, messages: DataFrame) -> None:
        """messages: one column; written in as many files as they have partitions."""
        out = messages.toDF("message").select(F.lit(self.run).alias("run"), F.lit(kind).alias("kind"), "message")
        path = f"{self.folder}/{self.run}"
        out.write.mode("append").parquet(path)
        if self.tell:
            for r in out.select("message").toLocalIterator():
                self.tell(kind, r.message)

    def table(self) -> DataFrame:
        """(run, kind, message) of this run."""
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/{self.run}")
