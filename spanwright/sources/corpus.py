"""Corpus readers and idempotent sinks: nested JSON, JSON lines, ingest, manifests, labelled results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digest
from .tables import CORPUS


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, context, id, category, question, is_impossible, spans) of a nested JSON corpus, a row per question.

    A contract with other than one paragraph fails the row it would give. The category is what
    follows the last double underscore of the id.
    """
    raw = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    c = raw.select(F.explode("data").alias("c")).select("c.title", "c.paragraphs")
    one = F.when(F.size("paragraphs") == 1, F.col("paragraphs")[0]).otherwise(F.raise_error(F.concat(F.lit("not one paragraph: "), "title")).cast(raw.schema["data"].dataType.elementType["paragraphs"].dataType.elementType))
    p = c.select("title", one.alias("p")).select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    spans = F.transform("q.answers", lambda a: F.struct(a["answer_start"].alias("start"), (a["answer_start"] + F.length(a["text"])).alias("end"), a["text"].alias("text")))
    return p.select("title", "context", F.col("q.id").alias("id"), F.substring_index("q.id", "__", -1).alias("category"), F.col("q.question").alias("question"), F.col("q.is_impossible").alias("is_impossible"), spans.alias("spans"))


def misaligned(corpus: DataFrame) -> DataFrame:
    """Gold spans that are not the text at their offsets."""
    s = corpus.select("id", "context", F.explode("spans").alias("s"))
    return s.filter(F.expr("substring(context, s.start + 1, s.end - s.start) IS DISTINCT FROM s.text")).select("id", "s")


def checked_file(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """(path, content) of a file; reading fails where its SHA-256 differs."""
    f = spark.read.format("binaryFile").load(path).select("path", "content")
    ok = F.sha2("content", 256) == sha256
    return f.withColumn("content", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("checksum mismatch: "), "path")).cast("binary")))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_label(df: DataFrame, path: str) -> None:
    """Write results partitioned by `label`; labels not in df stay as they were."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label").parquet(path)


def hashed(docs: DataFrame) -> DataFrame:
    """docs + sha256, char_count; a text with NUL fails."""
    text = F.when(F.col("text").contains("\u0000"), F.raise_error(F.lit("text holds NUL")).cast("string")).otherwise(F.col("text"))
    return docs.withColumn("text", text).withColumn("sha256", digest("text")).withColumn("char_count", F.length("text"))


def to_ingest(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The incoming documents (matter_id, sha256, doc_id ...) to append: one per new (matter, hash).

    A text that the matter already holds is left alone, whatever the chunk sizes are now.
    """
    keys = ["matter_id", "sha256"]
    new = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    first = new.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"))
    return new.join(first, [*keys, "doc_id"], "left_semi").dropDuplicates([*keys, "doc_id"])


def new_matters(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Names to append: those asked for that do not exist yet."""
    return names.select("name").distinct().join(existing.select("name"), "name", "left_anti")


def manifest(docs: DataFrame) -> DataFrame:
    return docs.select("title", digest("text").alias("sha256"), F.length("text").alias("chars"))


def manifest_check(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(title, state) of each manifest entry: ok, missing or changed."""
    have = manifest(docs).select("title", F.col("sha256").alias("_have"))
    rows = wanted.join(have, "title", "left")
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_have") != F.col("sha256"), "changed").otherwise("ok")
    return rows.select("title", state.alias("state"))


def stale(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks to embed: those without a vector of this model."""
    return chunks.filter(~F.col("embedding_model").eqNullSafe(F.lit(model)))
