"""Explicit schemas, Parquet readers, and integrity checks over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:int,text:string>"
#: Nested question-answering corpora: contracts, paragraphs, questions with gold answers.
CORPUS = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<answer_start:int,text:string>>>>>>>>"
SCHEMAS = {
    "matters": "matter_id long, name string",
    "users": "user_id string, email string",
    "members": "user_id string, matter_id long, role string",
    "documents": "doc_id long, matter_id long, title string, source string, text string, sha256 string, char_count int",
    "chunks": "chunk_id long, doc_id long, matter_id long, ordinal int, start_char int, end_char int, chunk_text string, embedding array<float>, embedding_model string",
    "audit": "question_id long, action string, matter_id long, detail string, created_at timestamp",
    "completions": "key string, text string, input_tokens long, output_tokens long, model string, stop_reason string",
    "questions": "question_id string, contract_title string, category string, question string, is_impossible boolean",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def violated(rows: DataFrame, name: str, key: Column | str, bad: Column) -> DataFrame:
    """(constraint, key) of the rows where `bad` holds or cannot be told."""
    k = F.col(key) if isinstance(key, str) else key
    return rows.filter(F.coalesce(bad, F.lit(True))).select(F.lit(name).alias("constraint"), k.cast("string").alias("key"))


def duplicated(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """(constraint, key) of key values that several rows carry; null keys never clash."""
    some = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return some.select(F.lit(name).alias("constraint"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"))


def orphans(child: DataFrame, parent: DataFrame, name: str, key: str, on: list[str]) -> DataFrame:
    """(constraint, key) of child rows whose `on` columns no parent row has."""
    return child.join(parent.select(*on).distinct(), on, "left_anti").select(F.lit(name).alias("constraint"), F.col(key).cast("string").alias("key"))


def violations(docs: DataFrame, chunks: DataFrame, members: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """(constraint, key) of every broken rule of the data model; empty when all hold."""
    found = [
        duplicated(docs, "document_hash_unique", "matter_id", "sha256"),
        duplicated(docs, "document_matter_unique", "doc_id", "matter_id"),
        orphans(chunks, docs, "chunk_document", "chunk_id", ["doc_id", "matter_id"]),
        duplicated(chunks, "chunk_ordinal_unique", "doc_id", "ordinal"),
        violated(chunks, "chunk_range", "chunk_id", ~((F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")))),
        violated(chunks, "chunk_length", "chunk_id", F.length("chunk_text") != F.col("end_char") - F.col("start_char")),
        violated(docs, "text_without_nul", "doc_id", F.col("text").contains("\u0000")),
    ]
    if "embedding" in chunks.columns:
        found.append(violated(chunks, "embedding_with_model", "chunk_id", F.col("embedding").isNull() != F.col("embedding_model").isNull()))
        found.append(violated(chunks.filter("embedding is not null"), "embedding_length", "chunk_id", F.size("embedding") != 384))
    if members is not None:
        found.append(violated(members, "member_role", "user_id", ~F.col("role").isin("owner", "member")))
    if users is not None:
        found.append(duplicated(users, "user_email_unique", "email"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def matters(docs: DataFrame, count: int = 4) -> DataFrame:
    """docs + matter_id: documents dealt to matters in turn by id."""
    return docs.withColumn("matter_id", F.pmod(F.col("doc_id"), F.lit(count)))
