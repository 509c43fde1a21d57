"""Commands over a folder of tables: ingest documents and chunks, embed what is stale, cache completions.

Every command can be run again: what is there already is left alone. A command writes its new rows once
before it appends them, so tables are never read and written by one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answering, chunking, embedding
from ..sources import corpus, store, tables


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; one that is not there yet is empty."""
    path = f"{folder}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], tables.SCHEMAS[name])
    return spark.read.schema(tables.SCHEMAS[name]).parquet(path)


def appended(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows, after they were added to a table of the folder in its own columns."""
    own = rows.sparkSession.createDataFrame([], tables.SCHEMAS[name]).schema
    fixed = store.written(rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in own]), name)
    fixed.write.mode("append").parquet(f"{folder}/{name}")
    return fixed


def ingest(spark: SparkSession, incoming: DataFrame, folder: str, max_words: int = chunking.MAX_WORDS, overlap: int = chunking.OVERLAP) -> DataFrame:
    """(doc_id, matter_id, chunks) of the documents taken: incoming (doc_id, matter_id, title, source, text)
    whose text its matter does not hold yet, appended to documents and, cut into windows, to chunks."""
    docs = store.written(corpus.to_ingest(corpus.hashed(incoming), stored(spark, folder, "documents")), "incoming")
    new = appended(docs, folder, "documents")
    cut = chunking.chunk(new.select("doc_id", "matter_id", "text"), max_words, overlap)
    chunks = appended(cut.withColumn("chunk_id", F.xxhash64("doc_id", "ordinal")), folder, "chunks")
    return new.join(chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").select("doc_id", "matter_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def embed(spark: SparkSession, folder: str, key: str) -> int:
    """Give every stale chunk of the folder a vector of this model; returns how many were stale."""
    chunks = stored(spark, folder, "chunks")
    n = corpus.stale(chunks, key).count()
    if n:
        whole = chunks.withColumn("embedding", F.col("embedding").cast("array<double>"))
        done = store.written(embedding.embedded(whole, embedding.embedder(key)).withColumn("embedding", F.col("embedding").cast("array<float>")), "chunks")
        done.write.mode("overwrite").parquet(f"{folder}/chunks")
    return n


def complete(spark: SparkSession, prompts: DataFrame, folder: str, client: answering.StubClient, offline: bool = False) -> DataFrame:
    """Completions of prompts (question_id, prompt): cached ones from the folder, each other prompt called once
    and added to it. offline: a prompt that is not cached fails the job."""
    done = store.written(answering.cached_call(prompts, client, stored(spark, folder, "completions"), offline), "completions")
    if offline and not done.filter("stop_reason = 'offline_miss'").isEmpty():
        raise ValueError("a prompt is not cached, and the run is offline")
    appended(done.filter("NOT cached").dropDuplicates(["key"]), folder, "completions")
    return done
