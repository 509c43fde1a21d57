"""Relations that the named queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..operators import chunking, ranking
from ..operators.sampling import CATEGORIES
from ..sources.store import kept
from ..sources.tables import matters, read

#: A chunk's id: its document's id and its ordinal.
CHUNKS_PER_DOC = 100_000


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their matter. A table of fewer splits than cores is spread over all cores first;
    a large one never is, as its scan has more."""
    docs = read(spark, d, "documents")
    cores = spark.sparkContext.defaultParallelism
    return matters(docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of all documents, written once a session: every ranking and span query reads them."""
    return kept(spark, "chunks", [read(spark, d, "documents")], lambda: chunked(spark, d))


def chunked(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk(documents(spark, d).select("doc_id", "matter_id", "text"))
    whole = F.when(F.col("ordinal") < CHUNKS_PER_DOC, F.col("doc_id") * CHUNKS_PER_DOC + F.col("ordinal"))
    # A document of more chunks would take the next one's ids: it fails instead.
    at = F.coalesce(whole, F.when(F.col("doc_id").isNotNull(), F.raise_error(F.concat(F.lit("too many chunks in document "), "doc_id"))).cast("long"))
    return rows.withColumn("chunk_id", at).withColumn("scope", F.col("matter_id"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages asked of the documents of one matter each."""
    b = read(spark, d, "benchmark")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod("item_id", F.lit(20)) + 1).cast("int"))
    return b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.pmod("item_id", F.lit(4)).alias("scope"), category.alias("category"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, scope, dl, term, tf) of all chunks, written once a session, terms of a scope together."""
    make = lambda: ranking.postings(chunks(spark, d), "chunk_id", "chunk_text", False, "scope").sortWithinPartitions("scope", "term")
    return kept(spark, "postings", [read(spark, d, "documents")], make)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, scope, vec): the chunks' hashing embeddings, written once a session."""
    make = lambda: ranking.hash_vectors(chunks(spark, d), "chunk_text").select("chunk_id", "scope", "vec")
    return kept(spark, "vectors", [read(spark, d, "documents")], make)


def _words(s: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in s)


DOCS = "docs AS (SELECT *, doc_id % 4 AS matter_id FROM documents)"
CHUNKS = DOCS + r""",
raw_ AS MATERIALIZED (SELECT doc_id, matter_id, text, regexp_extract_all(text, '\S+') AS ws, regexp_extract_all(text, '\s+') AS g0, length(regexp_extract(text, '^\s*')) AS lead FROM docs),
gap_ AS (SELECT doc_id, matter_id, ws, CASE WHEN lead > 0 THEN g0[2:] ELSE g0 END AS gs, lead, len(ws) AS n FROM raw_),
word_ AS MATERIALIZED (SELECT doc_id, matter_id, lead, n, unnest(range(1, n + 1)) AS i, unnest(ws) AS w, unnest(CASE WHEN len(gs) < n THEN list_append(gs, '') ELSE gs[:n] END) AS g FROM gap_ WHERE n > 0),
pos_ AS MATERIALIZED (SELECT doc_id, matter_id, n, i, lead + coalesce(sum(length(w) + length(g)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(w) AS l FROM word_),
win_ AS (SELECT s.doc_id, s.matter_id, ((s.i - 1) // 160)::INT AS ordinal, s.a::INT AS start_char, (e.a + e.l)::INT AS end_char
         FROM pos_ s JOIN pos_ e ON s.doc_id = e.doc_id AND e.i = least(s.i + 199, s.n)
         WHERE (s.i - 1) % 160 = 0 AND (s.i = 1 OR s.i + 39 < s.n)),
chunks AS MATERIALIZED (SELECT w.doc_id, w.matter_id, w.matter_id AS scope, w.ordinal, w.start_char, w.end_char, w.doc_id * 100000 + w.ordinal AS chunk_id,
           substring(d.text, w.start_char + 1, w.end_char - w.start_char) AS chunk_text
           FROM win_ w JOIN documents d USING (doc_id))"""
STOP = _words(STOPWORDS)
QUESTIONS = f"questions AS (SELECT item_id AS question_id, text AS question, item_id % 4 AS scope, [{_words(CATEGORIES)}][(item_id % 20 + 1)::INT] AS category FROM benchmark)"
POSTINGS = CHUNKS + f""",
tok_ AS (SELECT chunk_id, scope, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) AS term FROM chunks),
posts AS (SELECT chunk_id, scope, term, count(*) AS tf FROM tok_ WHERE term NOT IN ({STOP}) GROUP BY ALL),
{QUESTIONS},
terms AS (SELECT DISTINCT question_id, scope, term FROM (SELECT question_id, scope, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM questions) WHERE term NOT IN ({STOP}))"""
LEXICAL = POSTINGS + """,
size_ AS (SELECT question_id, count(*) AS terms FROM terms GROUP BY question_id),
lex AS (SELECT t.question_id, p.chunk_id, round(sum(list_sum(list_transform(range(1, p.tf + 1), lambda j: 1.0e0 / (j * j)))) / any_value(s.terms) * 0.1e0 / 1.64493406685e0, 6) AS score
        FROM posts p JOIN terms t ON p.scope = t.scope AND p.term = t.term JOIN size_ s ON s.question_id = t.question_id GROUP BY ALL),
lexr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM lex)"""


def _fold() -> str:
    at = "0"
    for i in range(4):
        at = f"(({at}) * {2**32 % 384} + ('0x' || substr(md5(word), {1 + 8 * i}, 8))::BIGINT) % 384"
    return at


def buckets_sql(name: str, source: str, key: str, text: str, keep: str) -> str:
    return f"""{name}_w AS (SELECT {key}, {keep}, unnest(regexp_extract_all(lower({text}), '[a-z]+')) AS word FROM {source}),
{name}_c AS (SELECT {key}, {keep}, ({_fold()})::INT AS bucket, count(*) AS c FROM {name}_w GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(c * c)) AS norm FROM {name}_c GROUP BY {key}),
{name} AS (SELECT {key}, {keep}, bucket, c / norm AS weight FROM {name}_c JOIN {name}_n USING ({key}))"""


VECTOR = buckets_sql("cb", "chunks", "chunk_id", "chunk_text", "scope") + ",\n" + buckets_sql("qb", "questions", "question_id", "question", "scope") + """,
vec AS (SELECT question_id, chunk_id, round(sum(cb.weight * qb.weight), 6) AS score FROM cb JOIN qb ON cb.scope = qb.scope AND cb.bucket = qb.bucket GROUP BY ALL),
vecr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM vec)"""
HYBRID = LEXICAL + ",\n" + VECTOR + """,
rrf AS (SELECT question_id, chunk_id, round(sum(1.0e0 / (60 + rank)), 9) AS score FROM (SELECT question_id, chunk_id, rank FROM lexr WHERE rank <= 50 UNION ALL SELECT question_id, chunk_id, rank FROM vecr WHERE rank <= 50) GROUP BY ALL),
rrfr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM rrf)"""
BM25 = POSTINGS + """,
df_ AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
dl_ AS (SELECT chunk_id, sum(tf) AS dl FROM posts GROUP BY chunk_id),
st_ AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(tf) FROM posts) / (SELECT count(*) FROM chunks) AS avgdl),
bm AS (SELECT t.question_id, p.chunk_id, round(sum(ln(1.0e0 + (st_.n - df_.df + 0.5e0) / (df_.df + 0.5e0)) * p.tf * 2.2e0 / (p.tf + 1.2e0 * (0.25e0 + 0.75e0 * dl_.dl / st_.avgdl))), 6) AS score
       FROM posts p JOIN terms t ON p.scope = t.scope AND p.term = t.term JOIN df_ ON df_.term = p.term JOIN dl_ ON dl_.chunk_id = p.chunk_id CROSS JOIN st_ GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0)"""

#: Gold: where a benchmark passage first occurs in a document of its matter.
GOLD = """gold AS MATERIALIZED (SELECT b.item_id AS question_id, d.doc_id, (instr(d.text, b.text) - 1)::INT AS start, (instr(d.text, b.text) - 1 + length(b.text))::INT AS "end", b.text AS quote
         FROM benchmark b JOIN docs d ON d.matter_id = b.item_id % 4 WHERE contains(d.text, b.text))"""
#: How many words anchor a passage in a document before the exact comparison.
ANCHOR = 5


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, doc_id, start, end, quote): where passages first occur; written once a session."""
    return kept(spark, "gold", [read(spark, d, "documents"), read(spark, d, "benchmark")], lambda: located(spark, d))


def located(spark: SparkSession, d: str) -> DataFrame:
    """Passages meet documents by a hash of their inner words, then exactly: the first and last word may
    stand inside others. A passage of fewer than three words meets every document of its scope."""
    docs = documents(spark, d).select("doc_id", F.col("matter_id").alias("scope"), "text")
    q = questions(spark, d).select("question_id", "scope", F.col("question").alias("quote"))
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    split = F.regexp_extract_all("quote", F.lit(r"\S+"), F.lit(0))
    whole = q.withColumn("_w", split).withColumn("_n", F.least(F.size("_w") - 2, F.lit(ANCHOR)))
    anchored = whole.filter("_n > 0").withColumn("anchor", F.expr("xxhash64(slice(_w, 2, _n))"))
    lengths = [r["_n"] for r in anchored.select("_n").distinct().collect()]  # at most ANCHOR values
    pinned = docs.select("doc_id", "scope", F.explode(F.array(words)).alias("w"))  # the pattern runs once a text
    places = pinned.select("doc_id", "scope", F.explode(_anchors(F.col("w"), lengths)).alias("anchor"))
    pairs = places.join(anchored.select("question_id", "scope", "anchor"), ["scope", "anchor"]).select("question_id", "doc_id").distinct()
    pairs = pairs.unionByName(whole.filter("_n <= 0").select("question_id", "scope").join(docs.select("doc_id", "scope"), "scope").select("question_id", "doc_id"))
    rows = pairs.join(q, "question_id").join(docs.select("doc_id", "text"), "doc_id")
    return rows.withColumn("_at", F.expr("locate(quote, text)")).filter("_at > 0").select("question_id", "doc_id", (F.col("_at") - 1).alias("start"), (F.col("_at") - 1 + F.length("quote")).alias("end"), "quote")


def _anchors(words, lengths):
    def of(n):
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in lengths]))) if lengths else F.array().cast("array<bigint>")
