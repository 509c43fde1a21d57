"""Named queries: documents, chunks, ranking, spans and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedding as E
from ..operators import nearest as N
from ..operators import ranking as R
from ..operators import spans as S
from ..sources import corpus, tables
from ..sources.store import written
from . import base as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


_SPAN = "chunk_id, doc_id, ordinal, start_char, end_char"


@query(f"WITH {B.CHUNKS} SELECT {_SPAN}, md5(chunk_text) AS text_md5 FROM chunks")
def chunk_windows(spark, d):
    return B.chunked(spark, d).select(*_SPAN.split(", "), F.md5("chunk_text").alias("text_md5"))


@query(f"WITH {B.CHUNKS} SELECT c.chunk_id, substring(d.text, start_char + 1, end_char - start_char) = chunk_text AS same FROM chunks c JOIN documents d USING (doc_id)")
def offset_roundtrip(spark, d):
    docs = B.documents(spark, d).select("doc_id", "text")
    same = F.expr("substring(text, start_char + 1, end_char - start_char) = chunk_text")
    return B.chunks(spark, d).join(docs, "doc_id").select("chunk_id", same.alias("same"))


@query(f"""WITH {B.CHUNKS},
n_ AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
l_ AS (SELECT length(chunk_text) AS len, ceil(length(chunk_text) / 3.5e0)::BIGINT AS tokens FROM chunks),
o_ AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS i, count(*) OVER () AS n FROM l_)
SELECT (SELECT count(*) FROM l_) AS chunks, (SELECT count(*) FROM n_) AS documents, (SELECT median(n)::DOUBLE FROM n_) AS median_per_doc, (SELECT max(n) FROM n_) AS max_per_doc,
 (SELECT median(len)::DOUBLE FROM l_) AS median_chars, (SELECT len FROM o_ WHERE i = floor(0.95e0 * (n - 1))) AS p95_chars, (SELECT max(len) FROM l_) AS max_chars,
 (SELECT round(avg((tokens > 256)::INT), 6) FROM l_) AS truncated_256, (SELECT round(avg((tokens > 512)::INT), 6) FROM l_) AS truncated_512""")
def chunk_stats(spark, d):
    from ..operators.metrics import at_index, p95_index, rate

    c = B.chunks(spark, d).select("doc_id", F.length("chunk_text").alias("len"), T.token_estimate("chunk_text").alias("tokens"))
    per = c.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("documents"), F.median("n").alias("median_per_doc"), F.max("n").alias("max_per_doc"))
    whole = c.agg(F.count("*").alias("chunks"), F.median("len").alias("median_chars"), F.max("len").alias("max_chars"), F.round(rate(F.col("tokens") > 256), 6).alias("truncated_256"), F.round(rate(F.col("tokens") > 512), 6).alias("truncated_512"))
    p95 = at_index(c, "len", p95_index()).select(F.col("len").alias("p95_chars"))
    return whole.crossJoin(per).crossJoin(p95)  # one row each


@query(f"""WITH {B.CHUNKS}, h_ AS (SELECT matter_id, sha256(text) AS h, doc_id FROM docs), u_ AS (SELECT DISTINCT user_id FROM events)
SELECT 'document_hash_unique' AS "constraint", matter_id || '|' || h AS key FROM h_ GROUP BY matter_id, h HAVING count(*) > 1
UNION ALL SELECT 'chunk_document', chunk_id::VARCHAR FROM chunks WHERE chunk_id % 103 = 0
UNION ALL SELECT 'chunk_ordinal_unique', '-1|' || ordinal FROM chunks WHERE chunk_id % 103 = 0 GROUP BY ordinal HAVING count(*) > 1
UNION ALL SELECT 'chunk_range', chunk_id::VARCHAR FROM chunks WHERE chunk_id % 101 = 0
UNION ALL SELECT 'chunk_length', chunk_id::VARCHAR FROM chunks WHERE chunk_id % 101 = 0
UNION ALL SELECT 'embedding_with_model', chunk_id::VARCHAR FROM chunks WHERE chunk_id % 107 = 0
UNION ALL SELECT 'embedding_length', chunk_id::VARCHAR FROM chunks WHERE chunk_id % 107 <> 0 AND chunk_id % 109 = 0
UNION ALL SELECT 'member_role', user_id::VARCHAR FROM u_ WHERE user_id % 3 = 2
UNION ALL SELECT 'user_email_unique', 'u' || (user_id % 140) || '@x.example' FROM u_ GROUP BY user_id % 140 HAVING count(*) > 1""")
def constraint_violations(spark, d):
    # Chunks damaged in four ways, roles that do not exist and shared addresses, beside what documents really repeat.
    docs = B.documents(spark, d).withColumn("sha256", T.digest("text"))
    broken = lambda n: F.pmod("chunk_id", F.lit(n)) == 0
    three = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    chunks = B.chunks(spark, d).withColumn("doc_id", F.when(broken(103), F.lit(-1)).otherwise(F.col("doc_id"))).withColumn("end_char", F.when(broken(101), F.col("start_char")).otherwise(F.col("end_char")))
    chunks = chunks.withColumn("embedding_model", F.when(broken(107) | broken(109), "m")).withColumn("embedding", F.when(~broken(107) & broken(109), three))
    users = tables.read(spark, d, "events").select("user_id").distinct()
    members = users.select("user_id", F.element_at(F.array(F.lit("owner"), F.lit("member"), F.lit("guest")), (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("role"))
    shared = users.select("user_id", F.concat(F.lit("u"), F.pmod("user_id", F.lit(140)), F.lit("@x.example")).alias("email"))
    return tables.violations(docs, chunks, members, shared)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS matter_id, 'matter ' || ((row_number() OVER (ORDER BY doc_id) - 1) % 4) AS matter FROM documents")
def matter_assign(spark, d):
    # A global number by ranges: each range counts its rows, earlier counts are added, no single task sorts all.
    # The ranges are written, so that counts and places come from the same ones.
    docs = tables.read(spark, d, "documents").select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    part = written(docs.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    from pyspark.sql import Window as W

    before = part.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    position = F.col("_m") + F.col("_b")
    rows = part.join(before.select("_p", "_b"), "_p").select("doc_id", position.alias("position"))
    return rows.withColumn("matter_id", F.pmod("position", F.lit(4))).withColumn("matter", F.concat(F.lit("matter "), "matter_id"))


@query(f"""WITH {B.DOCS}, have AS (SELECT DISTINCT matter_id, sha256(text) AS h FROM docs WHERE doc_id % 5 = 0)
SELECT min(doc_id) AS doc_id, matter_id, sha256(text) AS sha256, length(any_value(text)) AS char_count FROM docs WHERE (matter_id, sha256(text)) NOT IN (SELECT (matter_id, h) FROM have) GROUP BY matter_id, sha256(text)""")
def ingest_dedup(spark, d):
    # One document in five is there already; what a matter holds is not taken again.
    docs = corpus.hashed(B.documents(spark, d).select("doc_id", "matter_id", "text"))
    return corpus.to_ingest(docs, docs.filter("doc_id % 5 = 0")).select("doc_id", "matter_id", "sha256", "char_count")


@query("""SELECT 'doc-' || doc_id AS title, CASE WHEN lang = 'es' THEN 'missing' WHEN lang = 'de' THEN 'changed' ELSE 'ok' END AS state FROM documents""")
def manifest_check(spark, d):
    docs = tables.read(spark, d, "documents").withColumn("title", F.concat(F.lit("doc-"), "doc_id"))
    wanted = corpus.manifest(docs)
    # The corpus as found: one language is gone, another was edited.
    found = docs.filter("lang != 'es'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return corpus.manifest_check(wanted, found)


@query("""SELECT item_id AS question_id, list_transform(list_sort(list_transform(map_entries(m), lambda e: {'p': e.value, 't': e.key})), lambda x: x.t) AS terms FROM (
SELECT item_id, map_from_entries(list({'k': t, 'v': p})) AS m FROM (SELECT item_id, t, min(p) AS p FROM (SELECT item_id, lower(unnest(x)) AS t, unnest(range(len(x))) AS p FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS x FROM benchmark)) GROUP BY ALL) GROUP BY item_id)""")
def or_terms(spark, d):
    return R.or_query(B.questions(spark, d))


@query(f"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({B.STOP})) AS tokens FROM documents")
def tokenize(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", T.tokens("text").alias("tokens"))


@query()
def tokenize_stemmed(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", T.tokens("text", stem=True).alias("tokens"))


@query(f"WITH {B.POSTINGS} SELECT chunk_id, term, tf FROM posts")
def term_freq(spark, d):
    return B.postings(spark, d).select("chunk_id", "term", "tf")


@query(f"""WITH {B.POSTINGS} SELECT term, count(*) AS df, round(ln(1.0e0 + ((SELECT count(*) FROM chunks) - count(*) + 0.5e0) / (count(*) + 0.5e0)), 6) AS idf,
round((SELECT sum(tf) FROM posts) / (SELECT count(*) FROM chunks), 6) AS avgdl FROM posts GROUP BY term""")
def bm25_stats(spark, d):
    posts = B.postings(spark, d)
    stats = R.corpus_stats(B.chunks(spark, d))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6)
    return df.crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"), F.round("avgdl", 6).alias("avgdl"))  # one row of stats


@query(f"WITH {B.POSTINGS} SELECT DISTINCT t.question_id, p.chunk_id FROM posts p JOIN terms t ON p.scope = t.scope AND p.term = t.term")
def lexical_match(spark, d):
    return B.postings(spark, d).join(R.query_terms(B.questions(spark, d)), ["scope", "term"]).select("question_id", "chunk_id").distinct()


def _lexical(spark, d):
    return R.lexical(R.query_terms(B.questions(spark, d)), B.postings(spark, d))


def _bm25(spark, d):
    posts = B.postings(spark, d)
    return R.bm25(R.query_terms(B.questions(spark, d)), posts, R.corpus_stats(B.chunks(spark, d)))


def _vector(spark, d):
    return R.vector_top(R.hash_vectors(B.questions(spark, d), "question"), B.vectors(spark, d), R.DEPTH)


def _hybrid(spark, d, k=10):
    return R.fuse([R.top(_lexical(spark, d), R.DEPTH), R.top(_vector(spark, d), R.DEPTH)], k)


RANKINGS = {"lexical": (_lexical, "lexr"), "bm25": (_bm25, "bmr"), "vector": (_vector, "vecr"), "hybrid": (_hybrid, "rrfr")}
_TOP = ["question_id", "chunk_id", "rank", "score"]


@query(f"WITH {B.LEXICAL} SELECT question_id, chunk_id, rank, score FROM lexr WHERE rank <= 10")
def lexical_topk(spark, d):
    return R.top(_lexical(spark, d), 10).select(*_TOP)


@query(f"WITH {B.BM25} SELECT question_id, chunk_id, rank, score FROM bmr WHERE rank <= 10")
def bm25_topk(spark, d):
    return R.top(_bm25(spark, d), 10).select(*_TOP)


@query(f"WITH {B.CHUNKS}, {B.buckets_sql('cb', 'chunks', 'chunk_id', 'chunk_text', 'scope')} SELECT chunk_id, bucket, round(weight, 6) AS weight FROM cb")
def hash_embed(spark, d):
    each = R.hash_vectors(B.chunks(spark, d), "chunk_text").select("chunk_id", F.posexplode("vec").alias("bucket", "weight"))
    return each.filter("weight > 0").select("chunk_id", "bucket", F.round("weight", 6).alias("weight"))


@query(f"WITH {B.CHUNKS} SELECT chunk_id FROM chunks WHERE doc_id % 3 = 0 OR doc_id % 3 = 1")
def embed_stale(spark, d):
    # As found: a third has no vector, a third one of an older model, a third is current.
    turn = F.pmod("doc_id", F.lit(3))
    have = B.chunks(spark, d).withColumn("embedding_model", F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, "older").otherwise("current"))
    return corpus.stale(have, "current").select("chunk_id")


@query(f"""WITH {B.CHUNKS}, {B.buckets_sql('cb', 'chunks', 'chunk_id', 'chunk_text', 'scope')}, n_ AS (SELECT chunk_id, count(*) AS n, round(max(weight), 6) AS heaviest FROM cb GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN doc_id % 3 = 2 THEN 'kept' ELSE 'hashing-384' END AS made_by, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE coalesce(n, 0) END AS buckets, CASE WHEN doc_id % 3 = 2 THEN 7.0e0 ELSE coalesce(heaviest, 0.0e0) END AS heaviest FROM chunks LEFT JOIN n_ USING (chunk_id)""")
def embed_merge(spark, d):
    # A third has no vector, a third an older model's, a third a current one, which stays as it is.
    turn = F.pmod("doc_id", F.lit(3))
    model = E.embedder("hashing-384")
    seven = F.array(F.lit(7.0))
    have = B.chunks(spark, d).withColumn("embedding_model", F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, "older").otherwise(model.key)).withColumn("embedding", F.when(turn == 0, F.lit(None)).otherwise(seven))
    done = E.searchable(E.embedded(have, model), model.key)
    used = F.size(F.filter("embedding", lambda x: x > 0))
    return done.select("chunk_id", F.when(turn == 2, "kept").otherwise(F.col("embedding_model")).alias("made_by"), used.alias("buckets"), F.round(F.array_max("embedding"), 6).alias("heaviest"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS first_day, date_diff('day', cast(min(ts) AS DATE), cast(max(ts) AS DATE))::INT AS days, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_at FROM events GROUP BY user_id""")
def activity_dates(spark, d):
    e = tables.read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return e.select("user_id", F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_diff(F.to_date("z"), F.to_date("a")).alias("days"), F.date_format("z", "yyyy-MM-dd'T'HH:mm:ss").alias("last_at"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 10""")
def vector_topk(spark, d):
    # Exact scan: every vector asks the vectors of its own label (its scope).
    e = tables.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("scope"), F.col("embedding").alias("vec"))
    return R.top(N.cosine_nearest(e, 10), 10, key="vec_id", by="query_id").select("query_id", "vec_id", "rank", "score")


@query(f"WITH {B.HYBRID} SELECT question_id, chunk_id, rank, score FROM rrfr WHERE rank <= 10")
def rrf_hybrid(spark, d):
    return _hybrid(spark, d).select(*_TOP)


@query(f"""WITH {B.HYBRID} SELECT q.question_id, coalesce(max(l.score), 0.0e0) AS top_ts_rank, coalesce(max(v.score), 0.0e0) AS top_cosine
FROM questions q LEFT JOIN lexr l ON l.question_id = q.question_id AND l.rank = 1 LEFT JOIN vecr v ON v.question_id = q.question_id AND v.rank = 1 GROUP BY q.question_id""")
def signals(spark, d):
    return R.signals(B.questions(spark, d), _lexical(spark, d), _vector(spark, d))


@query(f"WITH {B.CHUNKS} SELECT chunk_id, doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def scope_filter(spark, d):
    allowed = tables.read(spark, d, "labels").filter("toxic = 0").select("doc_id")
    return B.chunks(spark, d).join(allowed, "doc_id", "left_semi").select("chunk_id", "doc_id")


@query(f"WITH {B.CHUNKS} SELECT chunk_id, doc_id, end_char FROM chunks WHERE ordinal = 0 AND start_char >= 0")
def first_chunks(spark, d):
    return B.chunks(spark, d).filter((F.col("ordinal") == 0) & (F.col("start_char") >= 0)).select("chunk_id", "doc_id", "end_char")


@query(f"""WITH {B.CHUNKS}, {B.GOLD} SELECT g.question_id, c.chunk_id FROM gold g JOIN chunks c USING (doc_id) WHERE c.start_char < g."end" AND g.start < c.end_char""")
def span_overlap(spark, d):
    g = B.gold(spark, d).select("question_id", "doc_id", "start", "end")
    return B.chunks(spark, d).join(g, "doc_id").filter(S.overlaps("start_char", "end_char", "start", "end")).select("question_id", "chunk_id")


@query(f"""WITH {B.CHUNKS}, {B.GOLD} SELECT g.question_id, g.doc_id FROM gold g WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = g.doc_id AND c.start_char <= g.start AND g."end" <= c.end_char)""")
def span_containment(spark, d):
    g = B.gold(spark, d).select("question_id", F.col("doc_id").alias("gd"), "start", "end")
    return g.join(B.chunks(spark, d), (F.col("gd") == F.col("doc_id")) & S.contains("start_char", "end_char", "start", "end"), "left_semi").select("question_id", F.col("gd").alias("doc_id"))


@query(f"""WITH {B.CHUNKS}, s AS (SELECT doc_id, start_char AS start, end_char AS "end" FROM chunks WHERE ordinal % 3 <> 2),
g AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM s),
i AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc_id, k""")
def merge_regions(spark, d):
    # What a reader saw who skipped every third window of each document.
    s = B.chunks(spark, d).filter("ordinal % 3 != 2").select("doc_id", F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    return S.merge_regions(s, "doc_id")


def _top_docs(spark, d, k=5):
    hits = R.top(_bm25(spark, d), k).select("question_id", "chunk_id", "rank")
    return hits.join(B.chunks(spark, d).select("chunk_id", "doc_id", "start_char", "end_char"), "chunk_id")


_HITS = B.BM25 + """,
ctx AS (SELECT b.question_id, b.chunk_id, b.rank, c.doc_id, c.start_char, c.end_char FROM bmr b JOIN chunks c USING (chunk_id) WHERE b.rank <= 5),
g_ AS (SELECT *, CASE WHEN start_char > max(end_char) OVER w THEN 1 ELSE 0 END AS gap FROM ctx WINDOW w AS (PARTITION BY question_id, doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i_ AS (SELECT *, sum(gap) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g_),
reg AS (SELECT question_id, doc_id, min(start_char) AS a, max(end_char) AS z FROM i_ GROUP BY question_id, doc_id, k)"""


def _resolved(spark, d):
    top = _top_docs(spark, d)
    shown = S.merge_regions(top.select("question_id", "doc_id", F.col("start_char").alias("start"), F.col("end_char").alias("end")), "question_id", "doc_id")
    regions = shown.groupBy("question_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("regions"))
    # Every other question is quoted with its spaces doubled, as a model might.
    quote = F.when(F.pmod("question_id", F.lit(2)) == 1, F.replace("question", F.lit(" "), F.lit("  "))).otherwise(F.col("question"))
    q = B.questions(spark, d).select("question_id", quote.alias("quote"))
    rows = regions.join(q, "question_id").join(B.documents(spark, d).select("doc_id", "text"), "doc_id")
    return S.resolve_quotes(rows), shown


@query(f"""WITH {_HITS}, f AS (SELECT r.question_id, r.doc_id, r.a + instr(substring(d.text, r.a + 1, r.z - r.a), q.question) - 1 AS start, length(q.question) AS n, contains(q.question, ' ') AS spaced, instr(substring(d.text, r.a + 1, r.z - r.a), q.question) > 0 AS hit
FROM reg r JOIN documents d USING (doc_id) JOIN questions q ON q.question_id = r.question_id)
SELECT question_id, doc_id, min(CASE WHEN hit THEN start END)::INT AS start, (min(CASE WHEN hit THEN start END) + any_value(n))::INT AS "end", CASE WHEN bool_or(hit) THEN CASE WHEN question_id % 2 = 1 AND any_value(spaced) THEN 'whitespace' ELSE 'exact' END END AS mode FROM f GROUP BY question_id, doc_id""")
def resolve_quote(spark, d):
    return _resolved(spark, d)[0].select("question_id", "doc_id", "start", "end", "mode")


@query(f"""WITH {_HITS}, cites AS (
 SELECT question_id, doc_id, start_char AS start, end_char AS "end", question_id % 5 AS turn FROM ctx WHERE rank = 1),
c AS (SELECT question_id, CASE WHEN turn = 1 THEN -1 ELSE doc_id END AS doc_id, CASE WHEN turn = 2 THEN start + 5000000 WHEN turn = 3 THEN start + 1 ELSE start END AS start,
      CASE WHEN turn = 2 THEN "end" + 5000000 ELSE "end" END AS "end", CASE WHEN turn = 4 THEN ' ' ELSE substring(d.text, start + 1, "end" - start) END AS quoted_text FROM cites JOIN documents d USING (doc_id))
SELECT c.question_id, c.doc_id, c.start::INT AS start, c."end"::INT AS "end", CASE WHEN trim(quoted_text) = '' THEN 'empty_quote' WHEN d.text IS NULL THEN 'document_out_of_scope'
 WHEN NOT (c.start >= 0 AND c.start < c."end" AND c."end" <= length(d.text)) THEN 'bad_offsets' WHEN substring(d.text, c.start + 1, c."end" - c.start) <> quoted_text THEN 'text_mismatch'
 WHEN NOT EXISTS (SELECT 1 FROM reg r WHERE r.question_id = c.question_id AND r.doc_id = c.doc_id AND r.a <= c.start AND c."end" <= r.z) THEN 'not_in_context' END AS reason
FROM c LEFT JOIN documents d USING (doc_id)""")
def verify_citations(spark, d):
    # Each question cites its best chunk; four in five are damaged, each in another way.
    top = _top_docs(spark, d)
    docs = B.documents(spark, d).select("doc_id", "text")
    turn = F.pmod("question_id", F.lit(5))
    best = top.filter("rank = 1").join(docs, "doc_id").withColumn("t", turn).withColumn("quoted_text", F.when(F.col("t") == 4, " ").otherwise(F.expr("substring(text, start_char + 1, end_char - start_char)")))
    cites = best.select(
        "question_id", F.when(F.col("t") == 1, F.lit(-1)).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("t") == 2, F.col("start_char") + 5_000_000).when(F.col("t") == 3, F.col("start_char") + 1).otherwise(F.col("start_char")).alias("start"),
        F.when(F.col("t") == 2, F.col("end_char") + 5_000_000).otherwise(F.col("end_char")).alias("end"), "quoted_text")
    shown = top.select("question_id", "doc_id", F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    return S.verify_citations(cites, docs, shown).select("question_id", "doc_id", "start", "end", "reason")


@query(f"WITH {B.CHUNKS} SELECT doc_id, list(chunk_id ORDER BY chunk_id) AS chunk_ids FROM chunks GROUP BY doc_id")
def doc_chunk_lists(spark, d):
    return B.chunks(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


@query(f"WITH {B.DOCS}, {B.QUESTIONS} SELECT q.question_id, d.doc_id FROM questions q JOIN docs d ON d.matter_id = q.scope")
def question_scope(spark, d):
    return B.documents(spark, d).select("doc_id", F.col("matter_id").alias("scope")).join(B.questions(spark, d).select("question_id", "scope"), "scope").select("question_id", "doc_id")


@query(f"WITH {B.LEXICAL}, {B.VECTOR} SELECT question_id, chunk_id FROM lexr WHERE rank <= 10 INTERSECT SELECT question_id, chunk_id FROM vecr WHERE rank <= 10")
def method_intersect(spark, d):
    return R.top(_lexical(spark, d), 10).select("question_id", "chunk_id").intersect(R.top(_vector(spark, d), 10).select("question_id", "chunk_id"))
