"""Named queries: metrics, sampling, contexts, prompts, redaction and the answer pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering as A
from ..operators import context as C
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import reports as P
from ..operators import redaction as X
from ..operators import sampling as Q
from ..operators import scoring as O
from ..operators import spans as S
from ..sources.session import run_metadata as run_row
from ..sources.store import written
from ..sources.tables import read
from . import base as B
from .retrieval import RANKINGS, _bm25, _hybrid, _lexical, _vector

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Answers of a run, as the labels and lengths of documents give them; the same text on both engines.
_ANSWERS = """SELECT d.doc_id AS question_id, d.source AS category, l.quality = 0 AS is_impossible,
 CASE WHEN n_chars % 10 IN (0, 5) THEN 'not_found' WHEN n_chars % 5 = 1 THEN 'rejected' ELSE 'answered' END AS status,
 CASE WHEN n_chars % 10 = 0 THEN NULL WHEN n_chars % 10 = 5 THEN 'not_found' ELSE 'answered' END AS model_status,
 n_chars % 10 = 0 AS gated, CASE WHEN l.toxic = 0 THEN 'correct' ELSE 'incorrect' END AS verdict, n_chars / 7.0e0 AS latency_ms,
 CAST(ceil(n_chars / 3.5e0) AS BIGINT) AS input_tokens, n_chars % 97 AS output_tokens, CASE WHEN n_chars % 10 = 0 THEN NULL ELSE 'ollama:stub' END AS model,
 n_chars % 6 = 0 AS cached, n_chars % 4 AS citations, n_chars % 3 AS whitespace_matches, d.lang AS run,
 CASE WHEN n_chars % 5 <> 1 THEN NULL WHEN n_chars % 3 = 0 THEN 'no_citations' WHEN n_chars % 3 = 1 THEN 'quote_not_found:C1' ELSE 'unknown_chunk:C9' END AS reason
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
ANSWERS = f"ans AS ({_ANSWERS.format(documents='documents', labels='labels')})"


def answers(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    rows = spark.sql(_ANSWERS, documents=docs, labels=labels)
    return rows.withColumn("rejection_reasons", F.when(F.col("reason").isNull(), F.array().cast("array<string>")).otherwise(F.array("reason"))).drop("reason")


_SCORED = ANSWERS + """,
scored AS (SELECT *, CASE WHEN is_impossible THEN status = 'not_found' WHEN status = 'answered' THEN verdict = 'correct' ELSE false END AS correct, status = 'not_found' AS abstained,
 CASE WHEN is_impossible THEN status = 'answered' WHEN status = 'answered' THEN verdict <> 'correct' ELSE false END AS shown_wrong,
 CASE WHEN NOT is_impossible AND status = 'answered' THEN verdict <> 'correct' ELSE coalesce(model_status = 'answered', false) END AS model_wrong FROM ans)"""


@query(f"WITH {_SCORED} SELECT question_id, correct, abstained, shown_wrong, model_wrong FROM scored")
def outcome_scores(spark, d):
    return O.outcomes(answers(spark, d)).select("question_id", "correct", "abstained", "shown_wrong", "model_wrong")


def _latency(where, divide=""):
    at = lambda q: f"round(min(CASE WHEN i >= least(n - 1, floor({q}e0 * n)) THEN v END){divide}, 6)"
    return f"SELECT {at(0.5)} AS p50, {at(0.95)} AS p95 FROM (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM scored WHERE {where})"


@query(f"""WITH {_SCORED}, lat AS ({_latency("NOT gated", " / 1000")}) SELECT count(*) AS n, sum(gated::INT)::BIGINT AS gated, round(avg(correct::INT), 6) AS accuracy, round(avg(CASE WHEN NOT is_impossible THEN correct::INT END), 6) AS accuracy_answerable,
 round(avg(CASE WHEN is_impossible THEN abstained::INT END), 6) AS abstention_absent, round(avg(CASE WHEN NOT is_impossible THEN abstained::INT END), 6) AS over_abstention_answerable,
 round(avg(CASE WHEN model_status = 'answered' THEN (status = 'answered')::INT END), 6) AS citation_validity, round(avg(shown_wrong::INT), 6) AS confidently_wrong_shown, round(avg(model_wrong::INT), 6) AS confidently_wrong_model,
 round(avg(CASE WHEN model IS NOT NULL THEN input_tokens END), 6) AS mean_input_tokens, 0.0e0 AS cost_per_100_usd, (SELECT p50 FROM lat) AS latency_p50_s, (SELECT p95 FROM lat) AS latency_p95_s FROM scored""")
def model_metrics(spark, d):
    return O.model_metrics(O.outcomes(answers(spark, d)))


@query(f"""WITH {_SCORED}, lat AS ({_latency("NOT gated AND NOT cached")}),
why AS (SELECT list({{'reason': reason, 'n': n}} ORDER BY reason) AS w FROM (SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM ans WHERE reason IS NOT NULL GROUP BY 1))
SELECT count(*) AS n, round(avg(correct::INT), 6) AS grounded_accuracy, sum((NOT is_impossible)::INT)::BIGINT AS answerable, sum(is_impossible::INT)::BIGINT AS absent, sum(gated::INT)::BIGINT AS gated,
 round(avg(CASE WHEN model_status = 'answered' THEN (status = 'answered')::INT END), 6) AS citation_validity, sum(whitespace_matches)::BIGINT AS whitespace_matches, sum(citations)::BIGINT AS citations,
 sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, 0.0e0 AS cost_usd,
 {", ".join(f"sum((status = '{s}' AND {'' if absent else 'NOT '}is_impossible)::INT)::BIGINT AS {s}_{'absent' if absent else 'answerable'}" for s in ("answered", "not_found", "rejected") for absent in (False, True))},
 (SELECT p50 FROM lat) AS latency_p50_ms, (SELECT p95 FROM lat) AS latency_p95_ms, list_transform((SELECT w FROM why), lambda x: x.reason || '=' || x.n) AS rejection_reasons FROM scored""")
def run_summary(spark, d):
    rows = O.run_summary(O.cost(O.outcomes(answers(spark, d))).withColumn("grounded", F.col("correct")))
    told = F.transform(F.map_entries("rejection_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.withColumn("rejection_reasons", told).withColumn("latency_p50_ms", F.round("latency_p50_ms", 6)).withColumn("latency_p95_ms", F.round("latency_p95_ms", 6))


_PRICED = "CASE WHEN n_chars % 3 = 0 THEN 'ollama:stub' WHEN n_chars % 3 = 1 THEN 'claude-haiku-4-5' ELSE 'claude-opus-5-5' END"


@query(f"""SELECT doc_id AS question_id, round(CASE {_PRICED} WHEN 'claude-haiku-4-5' THEN ceil(n_chars / 3.5e0) / 1000000.0e0 * 1.0e0 + n_chars % 97 / 1000000.0e0 * 5.0e0
 WHEN 'claude-opus-5-5' THEN ceil(n_chars / 3.5e0) / 1000000.0e0 * 4.0e0 + n_chars % 97 / 1000000.0e0 * 20.0e0 ELSE 0.0e0 END, 9) AS cost_usd FROM documents""")
def answer_cost(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.expr(_PRICED).alias("model"), F.ceil(F.col("n_chars") / 3.5).alias("input_tokens"), (F.col("n_chars") % 97).alias("output_tokens"))
    return O.cost(rows).select("question_id", F.round("cost_usd", 9).alias("cost_usd"))


@query(f"WITH {ANSWERS} SELECT status, is_impossible, count(*) AS n FROM ans GROUP BY ALL")
def status_counts(spark, d):
    return answers(spark, d).groupBy("status", "is_impossible").agg(F.count("*").alias("n"))


@query(f"WITH {ANSWERS} SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM ans WHERE reason IS NOT NULL GROUP BY ALL")
def rejection_reasons(spark, d):
    return O.reasons(answers(spark, d))


@query(f"""WITH {_SCORED}, f AS (SELECT question_id, CASE WHEN shown_wrong THEN 0 WHEN status = 'rejected' THEN 1 WHEN NOT is_impossible AND status = 'not_found' THEN 2 END AS severity FROM scored)
SELECT question_id, severity, row_number() OVER (ORDER BY severity, question_id) AS position FROM f WHERE severity IS NOT NULL ORDER BY severity, question_id LIMIT 5""")
def failure_examples(spark, d):
    from pyspark.sql import Window as W

    kind = F.when(F.col("shown_wrong"), 0).when(F.col("status") == "rejected", 1).when(~F.col("is_impossible") & (F.col("status") == "not_found"), 2)
    worst = O.outcomes(answers(spark, d)).select("question_id", kind.alias("severity")).filter("severity is not null").orderBy("severity", "question_id").limit(5)
    return worst.withColumn("position", F.row_number().over(W.orderBy("severity", "question_id")))


_PCT = """SELECT {by} AS run, min(CASE WHEN i >= least(n - 1, floor(0.5e0 * n)) THEN v END) AS p50, min(CASE WHEN i >= least(n - 1, floor(0.95e0 * n)) THEN v END) AS p95, any_value(n) AS n
FROM (SELECT {by}, {v} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {t}) GROUP BY {by}"""


@query("WITH e AS (SELECT event_type, value FROM events WHERE value IS NOT NULL) " + _PCT.format(by="event_type", v="value", t="e"))
def latency_percentiles(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("run"), F.col("value"))
    half = M.at_index(e, "value", M.percentile_index(0.5), "run").select("run", F.col("value").alias("p50"), "n")
    return half.join(M.at_index(e, "value", M.percentile_index(0.95), "run").select("run", F.col("value").alias("p95")), "run")


def _raters(spark, d):
    return read(spark, d, "labels").select(F.col("quality").alias("human"), (1 - F.col("toxic")).alias("judge"))


@query("""WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), s AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM p)
SELECT n, round(po, 9) AS raw_agreement, round(CASE WHEN pe = 1 THEN 'NaN'::DOUBLE ELSE (po - pe) / (1 - pe) END, 9) AS cohen_kappa FROM s""")
def cohen_kappa(spark, d):
    return M.kappa(_raters(spark, d), "human", "judge").select("n", F.round("raw_agreement", 9).alias("raw_agreement"), F.round("cohen_kappa", 9).alias("cohen_kappa"))


@query("SELECT quality AS human, 1 - toxic AS judge, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, d):
    return M.confusion(_raters(spark, d), "human", "judge")


@query(f"WITH {ANSWERS} SELECT run || ':' || a.question_id AS item_id, l.quality AS human, a.verdict AS judge FROM ans a JOIN labels l ON l.doc_id = a.question_id WHERE status = 'answered'")
def rater_agreement(spark, d):
    # Human labels name run and question in one item id, split at the first colon.
    a = answers(spark, d).filter("status = 'answered'").select("run", F.col("question_id").cast("string").alias("qid"), F.col("verdict").alias("judge"))
    human = answers(spark, d).select(F.concat_ws(":", "run", "question_id").alias("item_id"), "question_id").join(read(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").alias("human")), "question_id")
    split = human.withColumn("run", F.substring_index("item_id", ":", 1)).withColumn("qid", F.expr("substring(item_id, locate(':', item_id) + 1)"))
    return split.join(a, ["run", "qid"]).select("item_id", "human", "judge")


def _tops(spark, d):
    """(lexical, vector): each question's best chunks, as deep as fusion looks; computed once."""
    return tuple(written(R.top(f(spark, d), R.DEPTH), "top").select("question_id", "chunk_id", "rank", "score") for f in (_lexical, _vector))


def _first_hits(spark, d, hits):
    """(method, question_id, rank): the first relevant of hits (method, question_id, chunk_id, rank), for every question with gold."""
    g = B.gold(spark, d).select("question_id", "doc_id", "start", "end")
    placed = hits.join(B.chunks(spark, d).select("chunk_id", "doc_id", "start_char", "end_char"), "chunk_id")
    ok = placed.join(g, ["question_id", "doc_id"]).filter(S.overlaps("start_char", "end_char", "start", "end")).groupBy("method", "question_id").agg(F.min("rank").alias("rank"))
    asked = g.select("question_id").distinct().join(hits.select("method").distinct())  # a row per method
    return asked.join(ok, ["method", "question_id"], "left").select("method", "question_id", "rank")


def _relevant(spark, d, ranking, k=10):
    hits = R.top(ranking, k).select(F.lit("-").alias("method"), "question_id", "chunk_id", "rank")
    return _first_hits(spark, d, hits).select("question_id", "rank")


def _first_sql(table, name):
    return f"""{name} AS (SELECT a.question_id, min(h.rank)::INT AS rank FROM (SELECT DISTINCT question_id FROM gold) a LEFT JOIN
 (SELECT t.question_id, t.rank FROM {table} t JOIN chunks c USING (chunk_id) JOIN gold g ON g.question_id = t.question_id AND g.doc_id = c.doc_id AND c.start_char < g."end" AND g.start < c.end_char WHERE t.rank <= 10) h USING (question_id) GROUP BY a.question_id)"""


_FIRST = f"WITH {B.BM25}, {B.GOLD}, {_first_sql('bmr', 'fh')} "


@query(_FIRST + "SELECT * FROM fh")
def first_hit_rank(spark, d):
    return _relevant(spark, d, _bm25(spark, d))


_ALL = B.HYBRID + B.BM25[len(B.POSTINGS):] + ", " + B.GOLD + ", " + ", ".join(_first_sql(t, f"fh_{m}") for m, (_, t) in RANKINGS.items())
_METRICS = " UNION ALL ".join(
    f"SELECT '{m}' AS method, count(*) AS n, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0e0 ELSE 0.0e0 END), 6) AS recall_{k}' for k in (1, 5, 10))}, round(avg(CASE WHEN rank <= 10 THEN 1.0e0 / rank ELSE 0.0e0 END), 6) AS mrr_10 FROM fh_{m}" for m in RANKINGS)


@query(f"WITH {_ALL} {_METRICS}")
def retrieval_metrics(spark, d):
    figures = [F.round(M.recall_at("rank", k), 6).alias(f"recall_{k}") for k in (1, 5, 10)]
    return _all_hits(spark, d).groupBy("method").agg(F.count("*").alias("n"), *figures, F.round(M.reciprocal_rank_at("rank", 10), 6).alias("mrr_10"))


def _all_hits(spark, d):
    """(method, question_id, rank) of the first relevant chunk by every method."""
    lexical, vector = _tops(spark, d)
    ranked = {"lexical": lexical, "bm25": R.top(_bm25(spark, d), 10), "vector": vector, "hybrid": R.fuse([lexical, vector], 10)}
    hits = None
    for m in RANKINGS:
        rows = ranked[m].filter("rank <= 10").select(F.lit(m).alias("method"), "question_id", "chunk_id", "rank")
        hits = rows if hits is None else hits.unionByName(rows)
    return _first_hits(spark, d, written(hits, "hits"))


_FIGURES = " UNION ALL ".join(
    f"SELECT '{m}' AS method, '{f}' AS figure, a.question_id, {x.format('a')}{minus} AS x FROM fh_{m} a JOIN fh_lexical b USING (question_id)"
    for m in RANKINGS
    for f, x, minus in (
        ("recall_5", "CASE WHEN {0}.rank <= 5 THEN 1.0e0 ELSE 0.0e0 END", ""),
        ("mrr_10", "CASE WHEN {0}.rank <= 10 THEN 1.0e0 / {0}.rank ELSE 0.0e0 END", ""),
        ("recall_5 - lexical", "CASE WHEN {0}.rank <= 5 THEN 1.0e0 ELSE 0.0e0 END", " - CASE WHEN b.rank <= 5 THEN 1.0e0 ELSE 0.0e0 END"),
    )
)


@query(f"""WITH {_ALL}, fig_ AS ({_FIGURES}), v AS (SELECT *, row_number() OVER (PARTITION BY method, figure ORDER BY question_id) - 1 AS i FROM fig_),
z AS (SELECT method, figure, count(*) AS n, avg(x) AS mean FROM v GROUP BY ALL), nn AS (SELECT max(n) AS n FROM z),
dr AS (SELECT r, ('0x' || substr(md5(r || ':' || j), 1, 8))::BIGINT % nn.n AS i FROM range(2000) a(r), nn, range(nn.n) b(j)),
m AS (SELECT method, figure, r, round(avg(x), 9) AS m FROM dr JOIN v USING (i) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY method, figure ORDER BY m, r) AS k_ FROM m)
SELECT method, figure, any_value(z.n) AS n, round(any_value(z.mean), 9) AS mean, max(CASE WHEN k_ = 51 THEN m END) AS lo, max(CASE WHEN k_ = 1950 THEN m END) AS hi FROM o JOIN z USING (method, figure) GROUP BY ALL""")
def retrieval_bundle(spark, d):
    """Every method's figures and its difference to full text, question by question, with bootstrap intervals."""
    hits = written(_all_hits(spark, d), "first-hits")
    recall = F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)
    mrr = F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)
    base = hits.filter("method = 'lexical'").select("question_id", recall.alias("x"))
    figures = hits.select("method", "question_id", F.lit("recall_5").alias("figure"), recall.alias("x")).unionByName(hits.select("method", "question_id", F.lit("mrr_10").alias("figure"), mrr.alias("x")))
    for m in RANKINGS:
        pair = M.paired(hits.filter(F.col("method") == m).select("question_id", recall.alias("x")), base, "question_id", "x")
        figures = figures.unionByName(pair.select(F.lit(m).alias("method"), "question_id", F.lit("recall_5 - lexical").alias("figure"), "x"))
    figures = written(figures, "figures")
    n = figures.groupBy("method", "figure").agg(F.count("*").alias("n"))
    return M.bootstrap(figures, "x", "question_id", groups=("method", "figure")).join(n, ["method", "figure"]).select("method", "figure", "n", F.round("mean", 9).alias("mean"), "lo", "hi")


@query()
def retrieval_report(spark, d):
    """The bundle as lines of Markdown."""
    whole = retrieval_bundle(spark, d)
    named = {"recall_5": "recall_5", "mrr_10": "mrr_10"}
    wide = whole.groupBy("method", "n").agg(*[F.max(F.when(F.col("figure") == f, F.col(c))).alias(f + suffix) for f in named for c, suffix in (("mean", ""), ("lo", "_lo"), ("hi", "_hi"))])
    rest = retrieval_metrics(spark, d).select("method", "recall_1", "recall_10")
    return P.retrieval_report(wide.join(rest, "method"))


@query()
def answer_report(spark, d):
    """The outcome figures of the run as lines of Markdown."""
    return P.answer_report(model_metrics(spark, d).withColumn("model", F.lit("ollama:stub")))


@query("SELECT 'spanwright' AS label, 6 AS k, true AS redact")
def run_metadata(spark, d):
    """What a run is made with: the settings that the session gives, and versions."""
    row = run_row(spark, "spanwright")
    return row.select("label", F.col("settings")["k"].cast("int").alias("k"), F.col("settings")["redact"].cast("boolean").alias("redact"))


@query(_FIRST + "SELECT q.category, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0e0 ELSE 0.0e0 END), 6) AS recall_5 FROM fh JOIN questions q USING (question_id) GROUP BY q.category")
def category_recall(spark, d):
    r = _relevant(spark, d, _bm25(spark, d)).join(B.questions(spark, d).select("question_id", "category"), "question_id")
    return r.groupBy("category").agg(F.count("*").alias("n"), F.round(M.recall_at("rank", 5), 6).alias("recall_5"))


@query(_FIRST + """, v AS (SELECT row_number() OVER (ORDER BY question_id) - 1 AS i, CASE WHEN rank IS NULL THEN 0.0e0 ELSE 1.0e0 / rank END AS x FROM fh),
z AS (SELECT count(*) AS n, avg(x) AS mean FROM v), dr AS (SELECT r, j, ('0x' || substr(md5(r || ':' || j), 1, 8))::BIGINT % z.n AS i FROM range(2000) a(r), z, range(z.n) b(j)),
m AS (SELECT r, round(avg(x), 9) AS m FROM dr JOIN v USING (i) GROUP BY r), o AS (SELECT m, row_number() OVER (ORDER BY m, r) AS k_ FROM m)
SELECT round((SELECT mean FROM z), 9) AS mean, max(CASE WHEN k_ = 51 THEN m END) AS lo, max(CASE WHEN k_ = 1950 THEN m END) AS hi FROM o""")
def bootstrap_ci(spark, d):
    r = _relevant(spark, d, _bm25(spark, d)).select("question_id", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("x"))
    return M.bootstrap(r, "x", "question_id").withColumn("mean", F.round("mean", 9))


@query(f"""WITH {_ALL}, v AS (SELECT row_number() OVER (ORDER BY a.question_id) - 1 AS i, coalesce(1.0e0 / a.rank, 0.0e0) - coalesce(1.0e0 / b.rank, 0.0e0) AS x FROM fh_hybrid a JOIN fh_lexical b USING (question_id)),
z AS (SELECT count(*) AS n, avg(x) AS mean FROM v), dr AS (SELECT r, j, ('0x' || substr(md5(r || ':' || j), 1, 8))::BIGINT % z.n AS i FROM range(2000) a(r), z, range(z.n) b(j)),
m AS (SELECT r, round(avg(x), 9) AS m FROM dr JOIN v USING (i) GROUP BY r), o AS (SELECT m, row_number() OVER (ORDER BY m, r) AS k_ FROM m)
SELECT round((SELECT mean FROM z), 9) AS mean, max(CASE WHEN k_ = 51 THEN m END) AS lo, max(CASE WHEN k_ = 1950 THEN m END) AS hi FROM o""")
def paired_diff(spark, d):
    lexical, vector = _tops(spark, d)
    a = _relevant(spark, d, R.fuse([lexical, vector], 10)).select("question_id", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("x"))
    b = _relevant(spark, d, lexical).select("question_id", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("x"))
    return M.bootstrap(M.paired(a, b, "question_id", "x"), "x", "question_id").withColumn("mean", F.round("mean", 9))


_SIGNAL = f"""WITH {B.LEXICAL}, {B.GOLD}, sig AS (SELECT q.question_id, coalesce(max(l.score), 0.0e0) AS s, q.question_id IN (SELECT question_id FROM gold) AS pos FROM questions q LEFT JOIN lexr l ON l.question_id = q.question_id AND l.rank = 1 GROUP BY q.question_id) """


def _signal(spark, d):
    best = _lexical(spark, d).groupBy("question_id").agg(F.max("score").alias("s"))
    present = B.gold(spark, d).select("question_id").distinct().withColumn("pos", F.lit(True))
    return B.questions(spark, d).select("question_id").join(best, "question_id", "left").join(present, "question_id", "left").select("question_id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("pos", F.lit(False)).alias("pos"))


@query(_SIGNAL + "SELECT round((SELECT sum(CASE WHEN a.s > b.s THEN 1.0e0 WHEN a.s = b.s THEN 0.5e0 ELSE 0 END) FROM sig a, sig b WHERE a.pos AND NOT b.pos) / nullif((SELECT count(*) FROM sig WHERE pos) * (SELECT count(*) FROM sig WHERE NOT pos), 0), 9) AS auc")
def auc(spark, d):
    return M.auc(_signal(spark, d), "s", F.col("pos")).select(F.round("auc", 9).alias("auc"))


@query(_SIGNAL + """, t AS (SELECT s AS threshold FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM sig WHERE pos) WHERE i = floor(0.02e0 * n))
SELECT t.threshold, round(avg(CASE WHEN pos THEN (s < threshold)::INT END), 6) AS false_abstain, round(avg(CASE WHEN NOT pos THEN (s < threshold)::INT END), 6) AS caught FROM sig, t GROUP BY t.threshold""")
def gate_calibrate(spark, d):
    rows = _signal(spark, d)
    t = M.gate_threshold(rows, "s", F.col("pos"))
    both = rows.crossJoin(F.broadcast(t))  # one row
    blocked = F.col("s") < F.col("threshold")
    return both.groupBy("threshold").agg(F.round(M.share(blocked, F.col("pos")), 6).alias("false_abstain"), F.round(M.share(blocked, ~F.col("pos")), 6).alias("caught"))


_CHOICE = f"""WITH {B.HYBRID}, {B.GOLD}, both_ AS (SELECT q.question_id, 'top_ts_rank' AS signal, coalesce(max(l.score), 0.0e0) AS s FROM questions q LEFT JOIN lexr l ON l.question_id = q.question_id AND l.rank = 1 GROUP BY q.question_id
 UNION ALL SELECT q.question_id, 'top_cosine', coalesce(max(v.score), 0.0e0) FROM questions q LEFT JOIN vecr v ON v.question_id = q.question_id AND v.rank = 1 GROUP BY q.question_id),
sig AS (SELECT *, question_id IN (SELECT question_id FROM gold) AS pos, question_id % 4 <> 3 AS dev FROM both_),
auc_ AS (SELECT a.signal, a.dev, sum(CASE WHEN a.s > b.s THEN 1.0e0 WHEN a.s = b.s THEN 0.5e0 ELSE 0 END) / count(*) AS auc FROM sig a JOIN sig b ON a.signal = b.signal AND a.dev = b.dev AND a.pos AND NOT b.pos GROUP BY ALL),
best_ AS (SELECT signal, auc FROM (SELECT DISTINCT signal FROM sig) LEFT JOIN (SELECT signal, auc FROM auc_ WHERE dev) USING (signal) ORDER BY coalesce(auc, -1.0e0) DESC, signal DESC LIMIT 1),
cut_ AS (SELECT s AS threshold FROM (SELECT sig.s, row_number() OVER (ORDER BY sig.s) - 1 AS i, count(*) OVER () AS n FROM sig JOIN best_ USING (signal) WHERE pos AND dev) WHERE i = floor(0.02e0 * n))"""


@query(_CHOICE + """ SELECT b.signal, round(b.auc, 9) AS auc_dev, round((SELECT auc FROM auc_ WHERE NOT dev AND auc_.signal = b.signal), 9) AS auc_test, (SELECT threshold FROM cut_) AS threshold,
 round(avg(CASE WHEN dev AND pos THEN (s < (SELECT threshold FROM cut_))::INT END), 6) AS blocked_dev, round(avg(CASE WHEN dev AND NOT pos THEN (s < (SELECT threshold FROM cut_))::INT END), 6) AS caught_dev,
 round(avg(CASE WHEN NOT dev AND pos THEN (s < (SELECT threshold FROM cut_))::INT END), 6) AS blocked_test, round(avg(CASE WHEN NOT dev AND NOT pos THEN (s < (SELECT threshold FROM cut_))::INT END), 6) AS caught_test
 FROM best_ b JOIN sig ON sig.signal = b.signal GROUP BY b.signal, b.auc""")
def gate_choice(spark, d):
    # Three questions in four choose signal and threshold; the rest tests them.
    present = B.gold(spark, d).select("question_id").distinct().withColumn("pos", F.lit(True))
    both = R.signals(B.questions(spark, d), *_tops(spark, d)).join(present, "question_id", "left")
    each = both.select("question_id", F.coalesce("pos", F.lit(False)).alias("pos"), (F.pmod("question_id", F.lit(4)) != 3).alias("dev"), F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("s")) for c in ("top_ts_rank", "top_cosine")])).alias("x")).select("question_id", "pos", "dev", "x.*")
    each = written(each, "signals")
    best = M.best_signal(each.filter("dev"), "signal", "s", F.col("pos"))
    test = M.auc(each.filter("NOT dev"), "s", F.col("pos"), "signal").withColumnRenamed("auc", "auc_test")
    rows = each.join(F.broadcast(best.join(test, "signal", "left")), "signal")  # one row
    below, pos, dev = F.col("s") < F.col("threshold"), F.col("pos"), F.col("dev")
    cases = {"blocked_dev": pos & dev, "caught_dev": ~pos & dev, "blocked_test": pos & ~dev, "caught_test": ~pos & ~dev}
    return rows.groupBy("signal", F.round("auc", 9).alias("auc_dev"), F.round("auc_test", 9).alias("auc_test"), "threshold").agg(*[F.round(M.share(below, c), 6).alias(k) for k, c in cases.items()])


@query(_SIGNAL + f"SELECT question_id, s < {A.THRESHOLD}e0 AS gated FROM sig")
def gate_filter(spark, d):
    return _signal(spark, d).select("question_id", A.blocked("s").alias("gated"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 40")
def seeded_sample(spark, d):
    return Q.sample(read(spark, d, "documents").select("doc_id"), "doc_id", 40, 42)


_POOL = f"pool AS (SELECT d.doc_id AS cuad_id, [{B._words(Q.CATEGORIES)}][(d.doc_id % 20 + 1)::INT] AS category, l.quality = 0 AS is_impossible, 'doc-' || d.doc_id AS contract_title FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _pool(spark, d):
    category = F.element_at(F.array(*[F.lit(c) for c in Q.CATEGORIES]), (F.pmod("doc_id", F.lit(20)) + 1).cast("int"))
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select(F.col("doc_id").alias("cuad_id"), category.alias("category"), (F.col("quality") == 0).alias("is_impossible"), F.concat(F.lit("doc-"), "doc_id").alias("contract_title"))


@query(f"WITH {_POOL} SELECT cuad_id, category FROM pool WHERE NOT is_impossible")
def all_pairs(spark, d):
    return Q.all_pairs(_pool(spark, d), True).select("cuad_id", "category")


def _robin(seed, n, impossible, extra="true"):
    return f"""(SELECT cuad_id, category, is_impossible FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('{seed}:' || cuad_id), cuad_id) AS t, list_position([{B._words(Q.CATEGORIES)}], category) AS p FROM pool WHERE is_impossible = {impossible} AND {extra}) ORDER BY t, p LIMIT {n})"""


@query(f"WITH {_POOL} SELECT * FROM {_robin(42, 30, 'false')}")
def round_robin_sample(spark, d):
    return Q.round_robin(Q.all_pairs(_pool(spark, d), True), "cuad_id", 30, 42).select("cuad_id", "category", "is_impossible")


def _set(spark, d, seed=42, a=90, b=30):
    pool = _pool(spark, d)
    return Q.round_robin(Q.all_pairs(pool, True), "cuad_id", a, seed).unionByName(Q.round_robin(Q.all_pairs(pool, False), "cuad_id", b, seed))


_SET = f"qs AS (SELECT * FROM {_robin(42, 90, 'false')} UNION ALL SELECT * FROM {_robin(42, 30, 'true')})"


@query(f"WITH {_POOL}, {_SET} SELECT cuad_id, category, is_impossible, printf('q%03d', row_number() OVER (ORDER BY cuad_id)) AS id FROM qs")
def build_questions(spark, d):
    return Q.numbered(_set(spark, d), "cuad_id", "q").select("cuad_id", "category", "is_impossible", "id")


@query(f"WITH {_POOL}, {_SET} SELECT cuad_id, category, is_impossible FROM {_robin(7, 15, 'false', 'cuad_id NOT IN (SELECT cuad_id FROM qs)')} UNION ALL SELECT cuad_id, category, is_impossible FROM {_robin(7, 5, 'true', 'cuad_id NOT IN (SELECT cuad_id FROM qs)')}")
def dev_split(spark, d):
    rest = _pool(spark, d).join(_set(spark, d).select("cuad_id"), "cuad_id", "left_anti")
    return Q.round_robin(Q.all_pairs(rest, True), "cuad_id", 15, 7).unionByName(Q.round_robin(Q.all_pairs(rest, False), "cuad_id", 5, 7)).select("cuad_id", "category", "is_impossible")


@query(f"""WITH {ANSWERS}, r AS (SELECT run, question_id, row_number() OVER (PARTITION BY run ORDER BY md5('0:' || question_id), question_id) AS t FROM ans WHERE status = 'answered' AND NOT is_impossible),
q AS (SELECT run, 7 + (row_number() OVER (ORDER BY run) <= 2)::INT AS q FROM (SELECT DISTINCT run FROM r))
SELECT r.run || ':' || question_id AS item_id, r.run, question_id, row_number() OVER (ORDER BY md5('0:' || r.run || ':' || question_id), r.run || ':' || question_id) AS position FROM r JOIN q USING (run) WHERE t <= q.q""")
def label_queue(spark, d):
    shown = answers(spark, d).filter("status = 'answered' AND NOT is_impossible")
    return Q.label_queue(shown.select("run", "question_id"), "run", "question_id", 30, 4)


_CONTEXT = B.HYBRID + """,
top_ AS (SELECT question_id, chunk_id, rank FROM rrfr WHERE rank <= 20),
res_ AS (SELECT t.question_id, (c.doc_id * 100000)::BIGINT AS chunk_id FROM top_ t JOIN chunks c USING (chunk_id) WHERE t.rank = 1),
off_ AS (SELECT question_id, chunk_id, min(p * 1000000000000 + o) AS o FROM (SELECT question_id, chunk_id, 0 AS p, chunk_id AS o FROM res_ UNION ALL SELECT question_id, chunk_id, 1, rank FROM top_) GROUP BY ALL),
keep_ AS (SELECT question_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY o, chunk_id) AS t FROM off_) WHERE t <= 6),
ctx AS (SELECT k.question_id, c.chunk_id, c.doc_id, c.start_char, c.end_char, c.chunk_text, 'C' || row_number() OVER (PARTITION BY k.question_id ORDER BY c.doc_id, c.start_char) AS label FROM keep_ k JOIN chunks c USING (chunk_id))"""


def _context(spark, d, ranked=None):
    ranked = written(_hybrid(spark, d, 20), "ranked") if ranked is None else ranked
    chunks = B.chunks(spark, d).select("chunk_id", "doc_id", "start_char", "end_char", "chunk_text")
    # The first chunk of the best document is reserved.
    first = ranked.filter("rank = 1").select("question_id", (F.floor(F.col("chunk_id") / B.CHUNKS_PER_DOC) * B.CHUNKS_PER_DOC).alias("chunk_id"))
    return C.build_context(ranked, first, chunks)


@query(f"WITH {_CONTEXT} SELECT question_id, label, chunk_id, doc_id, start_char, end_char FROM ctx")
def build_context(spark, d):
    return _context(spark, d).select("question_id", "label", "chunk_id", "doc_id", "start_char", "end_char")


@query(f"""WITH {_CONTEXT}, {B.GOLD}, a AS (SELECT DISTINCT question_id FROM gold), cf AS (
 SELECT 'top-5' AS config, question_id, chunk_id FROM top_ WHERE rank <= 5 UNION ALL SELECT 'top-6', question_id, chunk_id FROM top_ WHERE rank <= 6 UNION ALL SELECT 'top-6, first chunk reserved', question_id, chunk_id FROM ctx),
h AS (SELECT DISTINCT cf.config, cf.question_id FROM cf JOIN chunks c USING (chunk_id) JOIN gold g ON g.question_id = cf.question_id AND g.doc_id = c.doc_id AND c.start_char < g."end" AND g.start < c.end_char)
SELECT k.config, count(*) AS n, round(avg((h.config IS NOT NULL)::INT), 6) AS context_recall FROM (VALUES ('top-5'), ('top-6'), ('top-6, first chunk reserved')) k(config) CROSS JOIN a LEFT JOIN h ON h.config = k.config AND h.question_id = a.question_id GROUP BY k.config""")
def context_recall(spark, d):
    ranked = written(_hybrid(spark, d, 20).select("question_id", "chunk_id", "rank"), "ranked")
    parts = [ranked.filter(F.col("rank") <= k).select(F.lit(f"top-{k}").alias("config"), "question_id", "chunk_id") for k in (5, 6)]
    seen = parts[0].unionByName(parts[1]).unionByName(_context(spark, d, ranked).select(F.lit("top-6, first chunk reserved").alias("config"), "question_id", "chunk_id"))
    g = B.gold(spark, d).select("question_id", "doc_id", "start", "end")
    hit = seen.join(B.chunks(spark, d).select("chunk_id", "doc_id", "start_char", "end_char"), "chunk_id").join(g, ["question_id", "doc_id"]).filter(S.overlaps("start_char", "end_char", "start", "end")).select("config", "question_id").distinct().withColumn("hit", F.lit(1.0))
    names = F.explode(F.array(F.lit("top-5"), F.lit("top-6"), F.lit("top-6, first chunk reserved"))).alias("config")
    cases = g.select("question_id").distinct().select("question_id", names)
    return cases.join(hit, ["config", "question_id"], "left").groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("context_recall"))


_PROMPT = _CONTEXT + """,
num_ AS (SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY doc_id) AS dn FROM ctx),
body_ AS (SELECT question_id, string_agg('<excerpt id="' || label || '" document="Document ' || dn || '">' || chr(10) || chunk_text || chr(10) || '</excerpt>', chr(10) ORDER BY substr(label, 2)::INT) AS body FROM num_ GROUP BY question_id),
prompts AS (SELECT q.question_id, '<excerpts>' || chr(10) || coalesce(body || chr(10), '') || '</excerpts>' || chr(10) || chr(10) || 'Question: ' || q.question AS prompt FROM questions q LEFT JOIN body_ USING (question_id))"""


@query(f"WITH {_PROMPT} SELECT question_id, md5(prompt) AS prompt_md5, length(prompt) AS n FROM prompts")
def build_prompt(spark, d):
    return C.build_prompts(B.questions(spark, d), _context(spark, d)).select("question_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n"))


@query(r"""WITH c AS (SELECT conv_id, list(text ORDER BY turn, text) AS ts FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, list_transform(ts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS ts FROM c)
SELECT conv_id AS question_id, md5('Question: ' || (SELECT list(text ORDER BY turn, text)[1] FROM conversations k WHERE k.conv_id = s.conv_id) || chr(10) || chr(10) || 'Reference clause text:' || chr(10) ||
 array_to_string(list_transform(ts[:3], lambda x: '- ' || CASE WHEN length(x) <= 600 THEN x ELSE substr(x, 1, 599) || '…' END), chr(10)) || chr(10) || chr(10) || 'System answer: ' || CASE WHEN length(ts[-1]) <= 800 THEN ts[-1] ELSE substr(ts[-1], 1, 799) || '…' END ||
 chr(10) || chr(10) || 'Quotes the system cited:' || chr(10) || CASE WHEN len(ts) > 3 THEN array_to_string(list_transform(ts[4:], lambda x: '- ' || CASE WHEN length(x) <= 300 THEN x ELSE substr(x, 1, 299) || '…' END), chr(10)) ELSE '- (none)' END) AS prompt_md5 FROM s""")
def judge_prompt(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("t"))
    rows = turns.select(F.col("conv_id").alias("question_id"), F.col("t")[0].alias("question"), F.slice("t", 1, 3).alias("references"), F.element_at("t", -1).alias("answer"), F.expr("filter(t, (x, i) -> i >= 3)").alias("quotes"))
    return C.judge_prompts(rows).select("question_id", F.md5("prompt").alias("prompt_md5"))


@query(f"""WITH {ANSWERS}, k AS (SELECT question_id, gated, sha256('{{"model":"' || 'stub' || '","user":"' || md5(d.text) || '"}}') AS key, d.text AS prompt FROM ans a JOIN documents d ON d.doc_id = a.question_id),
c AS (SELECT DISTINCT sha256('{{"model":"' || 'stub' || '","user":"' || md5(text) || '"}}') AS key FROM documents WHERE lang = 'en')
SELECT sum(gated::INT)::BIGINT AS gated, sum((NOT gated AND c.key IS NOT NULL)::INT)::BIGINT AS cached, sum((NOT gated AND c.key IS NULL)::INT)::BIGINT AS to_call, coalesce(sum(CASE WHEN NOT gated AND c.key IS NULL THEN ceil(length(prompt) / 3.5e0)::BIGINT END), 0)::BIGINT AS est_tokens FROM k LEFT JOIN c USING (key)""")
def cache_plan(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    key = A.cache_key(model=F.lit("stub"), user=F.md5("text"))
    asked = answers(spark, d).select("question_id", "gated").join(docs, F.col("doc_id") == F.col("question_id")).select("question_id", "gated", key.alias("key"), F.col("text").alias("prompt"))
    return A.cache_plan(asked, docs.filter("lang = 'en'").select(key.alias("key")))


@query("""SELECT conv_id AS question_id, 'ask' AS action, CASE WHEN count(DISTINCT conv_id * 7 % 3 + turn % 2) = 1 THEN min(conv_id * 7 % 3 + turn % 2) END AS matter_id, list(DISTINCT turn ORDER BY turn) AS document_ids,
 CASE WHEN conv_id % 3 = 0 THEN 'not_found' ELSE 'answered' END AS status, conv_id % 3 = 0 AS gated, (conv_id % 4)::INT AS citation_count, (conv_id * 11)::BIGINT AS input_tokens FROM conversations GROUP BY conv_id""")
def audit_log(spark, d):
    c = read(spark, d, "conversations")
    scope = c.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("doc_id"), (F.col("conv_id") * 7 % 3 + F.col("turn") % 2).alias("matter_id"))
    none, out = F.lit(None).cast("string"), F.pmod("question_id", F.lit(3)) == 0
    results = scope.select("question_id").distinct().select(
        "question_id", F.when(out, "not_found").otherwise("answered").alias("status"), out.alias("gated"), none.alias("model"), F.pmod("question_id", F.lit(4)).cast("int").alias("citation_count"),
        F.array().cast("array<string>").alias("rejection_reasons"), F.lit(0).alias("whitespace_matches"), (F.col("question_id") * 11).alias("input_tokens"), F.lit(0).alias("output_tokens"))
    rows = A.audit(results, scope)
    detail = F.from_json("detail", "document_ids array<long>, status string, gated boolean, citation_count int, input_tokens long")
    return rows.select("question_id", "action", "matter_id", detail.alias("x")).select("question_id", "action", "matter_id", "x.*")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_audit(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def _entities(spark, d):
    return X.redact(B.documents(spark, d).select("doc_id", "text"))


@query()
def redact_entities(spark, d):
    return _entities(spark, d).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")


@query()
def redact_text(spark, d):
    pieces = X.segments("text", "entities", F.lit(0), F.length("text"))
    return _entities(spark, d).select("doc_id", X.redacted_text("text", pieces).alias("redacted"))


_MAILS = r"m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+(?:\.[a-zA-Z0-9_-]+)+')) AS x, text FROM documents)"


@query(_MAILS.join(["WITH ", " SELECT 'EMAIL' AS kind, count(*) AS n FROM m"]))
def redaction_counts(spark, d):
    return X.entity_counts(_entities(spark, d)).filter("kind = 'EMAIL'")


@query(_MAILS.join(["WITH ", """, f AS (SELECT doc_id, lower(x) AS k, min(instr(text, x)) AS first_at FROM m GROUP BY ALL) SELECT doc_id, 'EMAIL_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first_at) AS placeholder, first_at - 1 AS start FROM f"""]))
def placeholder_numbers(spark, d):
    e = _entities(spark, d).select("doc_id", F.explode("entities").alias("e")).filter("e.kind = 'EMAIL'")
    return e.groupBy("doc_id", F.col("e.placeholder").alias("placeholder")).agg(F.min("e.start").cast("long").alias("start"))


@query(_MAILS.join(["WITH ", """, f AS (SELECT doc_id, lower(x) AS k, arg_min(x, instr(text, x)) AS original, min(instr(text, x)) AS first_at FROM m GROUP BY ALL) SELECT doc_id, 'EMAIL' AS kind, 'EMAIL_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first_at) AS placeholder, original FROM f"""]))
def placeholder_map(spark, d):
    return X.placeholder_map(_entities(spark, d), "doc_id").filter("kind = 'EMAIL'")


# The three queries above keep to the kind that their SQL can express; these return every kind.
@query()
def redaction_counts_all(spark, d):
    return X.entity_counts(_entities(spark, d))


@query()
def placeholder_numbers_all(spark, d):
    e = _entities(spark, d).select("doc_id", F.explode("entities").alias("e"))
    return e.groupBy("doc_id", F.col("e.placeholder").alias("placeholder")).agg(F.min("e.start").cast("long").alias("start"))


@query()
def placeholder_map_all(spark, d):
    return X.placeholder_map(_entities(spark, d), "doc_id")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def unredact(spark, d):
    # Redacting and restoring gives the text back where a name has one spelling (e-mail and phone here).
    docs = _entities(spark, d)
    pieces = X.segments("text", "entities", F.lit(0), F.length("text"))
    originals = X.placeholder_map(docs, "doc_id").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("m"))
    rows = docs.select("doc_id", X.redacted_text("text", pieces).alias("r")).join(originals, "doc_id", "left")
    restored = X.unredact("r", F.coalesce("m", F.create_map().cast("map<string,string>")))
    return rows.select("doc_id", F.md5(restored).alias("text_md5"))


@query(f"""WITH {B.BM25}, {B.GOLD}, a AS (SELECT q.question_id, q.question_id NOT IN (SELECT question_id FROM gold) AS is_impossible, b.chunk_id FROM questions q LEFT JOIN bmr b ON b.question_id = q.question_id AND b.rank = 1)
SELECT a.question_id, CASE WHEN is_impossible THEN a.chunk_id IS NULL ELSE a.chunk_id IS NOT NULL AND EXISTS (SELECT 1 FROM chunks c JOIN gold g ON g.doc_id = c.doc_id WHERE c.chunk_id = a.chunk_id AND g.question_id = a.question_id AND c.start_char < g."end" AND g.start < c.end_char) END AS grounded FROM a""")
def grounded_correct(spark, d):
    # A reader that answers with the best chunk whenever there is one.
    g = B.gold(spark, d)
    best = R.top(_bm25(spark, d), 1).select("question_id", "chunk_id").join(B.chunks(spark, d).select("chunk_id", "doc_id", F.col("start_char").alias("start"), F.col("end_char").alias("end")), "chunk_id")
    present = g.select("question_id").distinct().withColumn("_g", F.lit(True))
    rows = B.questions(spark, d).select("question_id").join(best.select("question_id", "chunk_id"), "question_id", "left").join(present, "question_id", "left")
    a = rows.select("question_id", F.col("_g").isNull().alias("is_impossible"), F.when(F.col("chunk_id").isNull(), "not_found").otherwise("answered").alias("status"))
    return O.grounded(a, best.select("question_id", "doc_id", "start", "end"), g).select("question_id", "grounded")


def _asked(spark, d):
    """(questions, gate, context, docs) of questions that ask one document each: the one of their best chunk."""
    asked = B.questions(spark, d)
    lexical, vector = _tops(spark, d)
    gate = written(R.signals(asked, lexical, vector).select("question_id", A.blocked().alias("gated")), "gate")
    ranked = R.fuse([lexical, vector], 20).withColumn("doc_id", F.floor(F.col("chunk_id") / B.CHUNKS_PER_DOC))
    ranked = written(ranked.select("question_id", "chunk_id", "rank", "doc_id"), "ranked")
    one = A.known_documents(ranked.filter("rank = 1").select("question_id", "doc_id"), B.documents(spark, d))
    context = written(_context(spark, d, ranked.join(one, ["question_id", "doc_id"], "left_semi").drop("doc_id")), "context")
    return asked, gate, context, B.documents(spark, d).select("doc_id", "text").join(one.select("doc_id").distinct(), "doc_id", "left_semi")


@query()
def answer_pipeline(spark, d):
    """All stages with the offline stub: hybrid ranking, gate, context, redaction, prompt, model, checks,
    decision, and the names put back."""
    asked, gate, context, docs = _asked(spark, d)
    return A.answer_questions(asked.select("question_id", "question"), gate, context, docs, A.StubClient())


_PLAIN = _CONTEXT.replace("ctx AS (", "ctx0 AS (").replace("top_ AS (SELECT question_id, chunk_id, rank FROM rrfr WHERE rank <= 20)", "top0_ AS (SELECT question_id, chunk_id, rank FROM rrfr WHERE rank <= 20),\ntop_ AS (SELECT t.* FROM top0_ t JOIN top0_ o ON o.question_id = t.question_id AND o.rank = 1 AND o.chunk_id // 100000 = t.chunk_id // 100000)") + """,
ctx AS (SELECT * FROM ctx0),
lead_ AS (SELECT question_id, chunk_id, doc_id, regexp_extract(chunk_text, '^\\s*((?:\\S+\\s+){0,11}\\S+)', 1) AS quote FROM ctx WHERE label = 'C1'),
sig_ AS (SELECT q.question_id, coalesce(max(l.score), 0.0e0) < """ + f"{A.THRESHOLD}e0" + """ AS gated FROM questions q LEFT JOIN lexr l ON l.question_id = q.question_id AND l.rank = 1 GROUP BY q.question_id),
n_ AS (SELECT question_id, doc_id, start_char, end_char, CASE WHEN start_char > max(end_char) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM ctx),
isl_ AS (SELECT *, sum(gap) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM n_),
reg_ AS (SELECT question_id, doc_id, min(start_char) AS a, max(end_char) AS z FROM isl_ GROUP BY question_id, doc_id, k),
hit_ AS (SELECT l.question_id, l.doc_id, l.quote, min(CASE WHEN contains(substring(d.text, r.a + 1, r.z - r.a), l.quote) THEN r.a + instr(substring(d.text, r.a + 1, r.z - r.a), l.quote) - 1 END) AS at
 FROM lead_ l JOIN reg_ r ON r.question_id = l.question_id AND r.doc_id = l.doc_id JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL)"""


@query(f"""WITH {_PLAIN} SELECT s.question_id, CASE WHEN s.gated OR h.question_id IS NULL THEN 'not_found' ELSE 'answered' END AS status, s.gated,
 CASE WHEN s.gated THEN NULL ELSE h.doc_id END AS doc_id, CASE WHEN s.gated THEN NULL ELSE h.at::INT END AS start, CASE WHEN s.gated THEN NULL ELSE (h.at + length(h.quote))::INT END AS "end" FROM sig_ s LEFT JOIN hit_ h USING (question_id)""")
def answer_plain(spark, d):
    """The same flow without redaction: each question's status and the span that its answer cites."""
    asked, gate, context, docs = _asked(spark, d)
    done = A.answer_questions(asked.select("question_id", "question"), gate, context, docs, A.StubClient(), redaction=False)
    first = F.get("citations", F.lit(0))
    return done.select("question_id", "status", "gated", first["doc_id"].alias("doc_id"), first["start"].alias("start"), first["end"].alias("end"))


@query("""SELECT doc_id AS question_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' ELSE 'incorrect' END AS verdict,
 CASE WHEN quality = 1 AND toxic = 0 THEN 'agrees' WHEN quality = 1 THEN 'differs' WHEN toxic = 1 THEN 'unparseable judge output: no verdict here' ELSE 'unparseable judge output: {"verdict":"correct"}' END AS reason FROM labels""")
def judge_verdicts(spark, d):
    """What a judge said of each answer, read leniently: anything but a verdict with its reason is 'incorrect'."""
    said = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, '{"verdict":"correct","reason":"agrees"}').otherwise('{"reason":"differs","verdict":"incorrect"}')).when(F.col("toxic") == 1, "no verdict here").otherwise('{"verdict":"correct"}')
    return A.verdicts(read(spark, d, "labels").select(F.col("doc_id").alias("question_id"), said.alias("text")))


@query("SELECT DISTINCT role AS model FROM conversations")
def distinct_models(spark, d):
    return read(spark, d, "conversations").select(F.col("role").alias("model")).distinct()


@query("SELECT lang AS category FROM documents UNION SELECT event_type FROM events")
def category_union(spark, d):
    return read(spark, d, "documents").select(F.col("lang").alias("category")).union(read(spark, d, "events").select("event_type")).distinct()
