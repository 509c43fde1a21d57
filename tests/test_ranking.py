import math

import pytest

from spanwright.operators import ranking as R


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, 0, "rare term common"), (2, 0, "common common common"), (3, 0, "common filler words here"), (4, 1, "rare rare rare"), (5, 0, "")]
    return spark.createDataFrame(rows, "chunk_id long, scope int, chunk_text string")


def ask(spark, text, scope=0):
    return spark.createDataFrame([(1, scope, text)], "question_id long, scope int, question string")


def test_bm25_prefers_rare_terms_in_scope(spark, corpus):
    posts = R.postings(corpus, "chunk_id", "chunk_text", False, "scope")
    stats = R.corpus_stats(corpus)
    assert stats.first().asDict() == {"n": 5, "avgdl": 13 / 5}
    hits = R.top(R.bm25(R.query_terms(ask(spark, "a rare common")), posts, stats), 10).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits][0] == 1 and 4 not in {h["chunk_id"] for h in hits}
    idf = math.log(1 + (5 - 2 + 0.5) / 2.5)
    only = R.bm25(R.query_terms(ask(spark, "rare", 1)), posts, stats).first()
    assert only["score"] == pytest.approx(idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 3 / 2.6)), abs=1e-6)


def test_stopwords_alone_find_nothing(spark, corpus):
    posts = R.postings(corpus, "chunk_id", "chunk_text", False, "scope")
    q = ask(spark, "is there a")
    assert R.lexical(R.query_terms(q), posts).count() == 0
    assert R.signals(q, R.lexical(R.query_terms(q), posts), R.vector_top(R.hash_vectors(q, "question"), R.hash_vectors(corpus.filter("chunk_id < 0"), "chunk_text"), 5)).first().asDict() == {"question_id": 1, "top_ts_rank": 0.0, "top_cosine": 0.0}


def test_full_text_rank_saturates(spark):
    df = spark.createDataFrame([(1, 0, "alpha " * 4 + "beta " * 5)], "chunk_id long, scope int, chunk_text string")
    posts = R.postings(df, "chunk_id", "chunk_text", False, "scope")
    s = R.lexical(R.query_terms(ask(spark, "alpha beta c d e f g")), posts).first()["score"]
    assert s == pytest.approx(0.025075, abs=1e-6)


def test_fusion_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "question_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 3, 1), (1, 1, 2)], "question_id long, chunk_id long, rank int")
    got = R.fuse([a, b], 10).orderBy("rank").collect()
    assert [g["chunk_id"] for g in got] == [1, 3, 2]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)


def test_hash_vectors_read_the_whole_digest(spark):
    import hashlib

    df = spark.createDataFrame([(1, "Zebra zebra apple 9"), (2, None), (3, "12")], "k long, t string")
    got = {r["k"]: {i: x for i, x in enumerate(r["vec"]) if x} for r in R.hash_vectors(df, "t").collect()}
    want = {int(hashlib.md5(w.encode()).hexdigest(), 16) % 384: c / math.sqrt(5) for w, c in (("zebra", 2), ("apple", 1))}
    assert got[1] == pytest.approx(want) and got[2] == got[3] == {}


def test_vector_top_matches_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "BLOCK", 3)
    rng = np.random.default_rng(0)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(size=(n, 8))]
    vectors = [(i, i % 2, v) for i, v in enumerate(unit(60))] + [(100 + i, 0, [1.0, *[0.0] * 7]) for i in range(30)]  # equal ones tie
    asked = [(i, i % 3, v) for i, v in enumerate(unit(7))] + [(9, 0, [1.0, *[0.0] * 7])]
    q = spark.createDataFrame(asked, "question_id long, scope int, vec array<double>")
    v = spark.createDataFrame(vectors, "chunk_id long, scope int, vec array<double>").repartition(4)
    got = sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in R.top(R.vector_top(q, v, 5), 5).collect())
    want = []
    for i, scope, x in asked:
        scored = sorted((-round(float(np.dot(x, y)), 6), j) for j, s, y in vectors if s == scope and np.dot(x, y) > 0)[:5]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(scored)]
    assert got == sorted(want)
