"""An extension: files that arrive as a stream are counted into a table by kind, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import token_count
from tessera.sources.files import classify


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, text, content_hash, kind, tokens) from Parquet files of (path, text) that come into a folder."""
    rows = spark.readStream.schema("path string, text string").parquet(folder)
    return rows.select("path", "text", F.sha2("text", 256).alias("content_hash"), classify("path").alias("kind"), token_count("text").alias("tokens"))


def new_contents(stream: DataFrame) -> DataFrame:
    """Each content of each path once, whenever it comes again."""
    return stream.dropDuplicates(["path", "content_hash"])


def write_new(stream: DataFrame, out: str, checkpoint: str):
    """Append new contents to Parquet; a restart goes on where it ended."""
    return new_contents(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", out).format("parquet").trigger(availableNow=True).start()
