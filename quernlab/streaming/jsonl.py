"""Batch techniques over files as they arrive: a stream of JSON lines, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernlab.sources.reading import SAMPLE_SCHEMA


def read_stream(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def apply_stream(stream: DataFrame, technique: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run a technique on every micro-batch and append JSON lines; a batch that is repeated replaces its own files."""

    def each(batch: DataFrame, number: int) -> None:
        technique(batch).write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
