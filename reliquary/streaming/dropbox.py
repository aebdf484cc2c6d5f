"""Files dropped into a folder, unwrapped as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import probe
from ..sources.tables import read_files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    files = files.select(F.col("path").alias("source_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    return read_files(files.where(probe.identify(F.col("content"), F.col("name")).isNotNull()), "container")


def into(rows: DataFrame, table_path: str, checkpoint: str):
    """Append what arrives to a Parquet table, exactly once."""
    return rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_type(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Arrivals per window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "type_code").agg(F.count("*").alias("n"))
