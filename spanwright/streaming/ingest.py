"""Extensions that run the batch plans on streams: incremental ingest and audit windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk
from ..sources.corpus import hashed


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, matter_id long, text string, ingested_at timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def distinct_documents(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's documents, once per (matter, hash) within the watermark."""
    return hashed(docs).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["matter_id", "sha256"])


def write_chunks(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Chunk new documents as they come; chunking is narrow, so it streams as it is."""
    rows = chunk(distinct_documents(docs).drop("ingested_at"))
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_windows(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, status, n) over a stream of audit rows (created_at, status)."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", width), "status").agg(F.count("*").alias("n"))
