"""Tables that cut lineage, in the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LEFT: set[tuple[SparkSession, str]] = set()


@atexit.register
def _delete_all() -> None:
    for spark, path in _LEFT:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if here := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return here.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arborfold-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Written once and read back; what was computed, a model's answers included, is not computed again."""
    path = f"{folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LEFT.add((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
