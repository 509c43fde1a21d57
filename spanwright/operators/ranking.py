"""Lexical, BM25 and vector ranking of chunks for a batch of questions, and their fusion.

Postings are (chunk_id, dl, term, tf); questions carry question_id and the scope key that a chunk must
share. Every ranking is one plan over all questions: terms meet postings in an equi-join, scores are
sums, top-k is a ranked window that Spark prunes per partition before the shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col, or_terms, tokens

K1, B = 1.2, 0.75
RRF, DEPTH = 60, 50
#: Weight of an unweighted lexeme over pi squared by six, as full-text rank defines it (fixed values).
LEXEME, BASEL = 0.1, 1.64493406685
DIMENSIONS = 384


def postings(units: DataFrame, key: str = "chunk_id", text: str = "chunk_text", stem: bool = False, *keep: str) -> DataFrame:
    """(key, keep..., dl, term, tf); dl is the unit's number of tokens."""
    once = units.select(key, *keep, F.explode(F.array(tokens(text, stem))).alias("_w"))  # tokenized once
    each = once.select(key, *keep, F.size("_w").alias("dl"), F.explode("_w").alias("term"))
    return each.groupBy(key, *keep, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(units: DataFrame, text: str = "chunk_text", stem: bool = False) -> DataFrame:
    """One row: n (units), avgdl (mean tokens, token-less units included); a scan without a shuffle of its rows."""
    return units.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(tokens(text, stem))), F.lit(0.0)).alias("avgdl"))


def query_terms(questions: DataFrame, text: str = "question", stem: bool = False) -> DataFrame:
    """(question_id, scope, term): the distinct rankable terms of each question."""
    return questions.select("question_id", "scope", F.explode(F.array_distinct(tokens(text, stem))).alias("term"))


def top(scored: DataFrame, k: int, key: str = "chunk_id", score: Column | str = "score", by: str = "question_id") -> DataFrame:
    """The k best rows of each question, ranked from 1, ties by key."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(col(score).desc(), F.col(key)))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def bm25(terms: DataFrame, posts: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(question_id, chunk_id, score): frequencies of the whole corpus, candidates in scope only."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    known = terms.join(df, "term").crossJoin(F.broadcast(stats)).select(  # stats is one row
        "question_id", "scope", "term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hit = posts.join(known, ["scope", "term"])
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return hit.groupBy("question_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")


def harmonic_squares(tf: Column | str) -> Column:
    """1 + 1/4 + ... + 1/tf squared: repeated lexemes saturate."""
    return F.aggregate(F.sequence(F.lit(1), col(tf).cast("int")), F.lit(0.0), lambda a, j: a + 1.0 / (j * j))


def lexical(terms: DataFrame, posts: DataFrame) -> DataFrame:
    """(question_id, chunk_id, score): full-text rank of an OR query."""
    size = terms.groupBy("question_id").agg(F.count("*").alias("terms"))
    hit = posts.join(terms, ["scope", "term"]).groupBy("question_id", "chunk_id").agg(F.sum(harmonic_squares("tf")).alias("h"))
    return hit.join(size, "question_id").select("question_id", "chunk_id", F.round(F.col("h") / F.col("terms") * LEXEME / BASEL, 6).alias("score"))


def hash_vectors(units: DataFrame, text: str, name: str = "vec") -> DataFrame:
    """units + the hashing embedding of `text`: DIMENSIONS doubles of unit length, all 0 without words.

    A word's bucket is its MD5, read as one number, modulo DIMENSIONS. Words are split by Spark; counting them by bucket is one pass over Arrow batches, without a shuffle.
    """

    def run(words: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for own in words:
            x = np.zeros(DIMENSIONS)
            for w in own if own is not None else ():
                at = known.get(w)
                if at is None:
                    at = known[w] = int.from_bytes(hashlib.md5(w.encode()).digest(), "big") % DIMENSIONS
                x[at] += 1
            norm = np.sqrt((x * x).sum())
            out.append(x / norm if norm else x)
        return pd.Series(out)

    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0))
    return units.withColumn(name, F.pandas_udf(run, "array<double>")(words))


#: Questions scored at once against every vector, at most (their matrix is broadcast: 12 MB).
BLOCK = 4096


def vector_top(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, score): the k best cosines in scope from each task; only positive ones.

    questions: (question_id, scope, vec); vectors: (chunk_id, scope, vec), of unit length. Questions
    are broadcast in blocks of bounded size and each task keeps its own best, so what is shuffled is
    k rows a question and task; a few questions or many cost one scan of the vectors a block.
    """
    spark = questions.sparkSession
    asked = questions.select("question_id", "scope", "vec").orderBy("question_id").toLocalIterator()
    out = None
    while block := list(itertools.islice(asked, BLOCK)):
        by: dict = {}
        for r in block:
            by.setdefault(r["scope"], []).append(r)
        shared = spark.sparkContext.broadcast({s: ([r["question_id"] for r in rows], np.array([r["vec"] for r in rows])) for s, rows in by.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict = {}
            for batch in batches:
                scopes = np.array(batch.column("scope").to_pylist(), object)
                for scope in set(scopes) & set(shared.value):
                    at = np.flatnonzero(scopes == scope)
                    own = batch.take(pa.array(at))
                    x = own.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    ids = own.column("chunk_id").to_numpy(zero_copy_only=False)
                    s = shared.value[scope][1] @ x.T
                    for i, row in enumerate(s):
                        old_ids, old = best.get((scope, i), (ids[:0], row[:0]))
                        all_ids, all_s = np.concatenate([old_ids, ids]), np.concatenate([old, row])
                        if len(all_s) > k:
                            near = np.flatnonzero(all_s >= np.partition(all_s, -k)[-k] - 1e-6)  # what may tie when rounded
                            keep = near[np.lexsort((all_ids[near], -np.round(all_s[near], 6)))[:k]]
                            all_ids, all_s = all_ids[keep], all_s[keep]
                        best[scope, i] = all_ids, all_s
            for (scope, i), (ids, s) in best.items():
                n = s > 0
                yield pa.RecordBatch.from_arrays([pa.array([shared.value[scope][0][i]] * int(n.sum()), pa.int64()), pa.array(ids[n], pa.int64()), pa.array(s[n])], names=["question_id", "chunk_id", "score"])

        found = vectors.select("chunk_id", "scope", "vec").mapInArrow(run, "question_id long, chunk_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "question_id long, chunk_id long, score double")
    return out.withColumn("score", F.round("score", 6))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fuse(rankings: list[DataFrame], k: int, c: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of (question_id, chunk_id, rank) rankings: + score, rank."""
    parts = rankings[0].select("question_id", "chunk_id", "rank")
    for r in rankings[1:]:
        parts = parts.unionByName(r.select("question_id", "chunk_id", "rank"))
    fused = parts.groupBy("question_id", "chunk_id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    return top(fused, k)


def signals(questions: DataFrame, lexical_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """(question_id, top_ts_rank, top_cosine): best raw scores, 0 where a method found nothing."""
    a = lexical_hits.groupBy("question_id").agg(F.max("score").alias("top_ts_rank"))
    b = vector_hits.groupBy("question_id").agg(F.max("score").alias("top_cosine"))
    out = questions.select("question_id").join(a, "question_id", "left").join(b, "question_id", "left")
    return out.fillna(0.0, ["top_ts_rank", "top_cosine"])


def or_query(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", or_terms("question").alias("terms"))
