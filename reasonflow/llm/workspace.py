"""Intermediate tables in the folder that the cluster shares.

A table written here cuts lineage and outlives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import new_path, shared_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, level: int = 3, tidy: bool = False) -> DataFrame:
    """Writes ``df`` once, its pages compressed at ``level``, and returns a reader of what was written.

    ``tidy``: what was shuffled for it is deleted as soon as it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, str(tidy or before == "true").lower())
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._rf_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialise`` returned and that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._rf_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession) -> None:
    """Deletes every intermediate table of this library in the shared folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/reasonflow")
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
