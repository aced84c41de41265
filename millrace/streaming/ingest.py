"""Streaming ingest of raw records. Stateless: no watermark, no windows; duplicates are left to the batch side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schemas import RAW_POSTING


def file_stream(spark: SparkSession, path: str, fmt: str = "text", schema: T.StructType | None = None, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A directory as a stream, the stand-in for a message topic; each trigger takes at most ``files_per_trigger`` files."""
    reader = spark.readStream.format(fmt)
    reader = reader.schema(schema) if schema is not None else reader
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.load(path)


def parsed(stream: DataFrame, column: str = "value", schema: T.StructType = RAW_POSTING) -> DataFrame:
    return stream.select(F.from_json(F.col(column).cast("string"), schema).alias("_r")).select("_r.*")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is there as Parquet, then stop. A rerun over the same checkpoint adds nothing."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def bronze(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    drain(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)
