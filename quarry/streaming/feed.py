"""A change feed: its pages, and a folder of JSON lines of (external_id, payload, version, updated_at) as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "external_id string, payload string, version long, updated_at string"


def read_changes(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """The stream of a folder's files, in any store that Spark reads. Files come once each, are read by executors, and must
    appear whole; changes that come again, or late, are told apart by their versions where they are applied."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(path)


def list_changes(changes: DataFrame, since: str | None, limit: int) -> DataFrame:
    """The first changes after `since`, oldest first: one page of the feed."""
    rows = changes if since is None else changes.where(F.col("updated_at") > since)
    return rows.orderBy("updated_at", "external_id").limit(limit)
