"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tenurekit.sources.scratch import fresh_folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(frame: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    The write's shuffle files go as soon as it has ended, not when the driver next collects garbage.
    """
    spark = frame.sparkSession
    path, before = fresh_folder(spark, f"llm/{name}"), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path, compression=codec)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)
