"""Files from tables: any DataFrame of (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_files(df: DataFrame, path, content) -> DataFrame:
    """(path, sha256, content, error) as the scan of a tree gives them; null content counts as empty."""
    text = F.coalesce(content, F.lit(""))
    return df.select(path.alias("path"), F.sha2(text, 256).alias("sha256"), text.alias("content"), F.lit(None).cast("string").alias("error"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table_files(d, F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))), F.col("text"))
