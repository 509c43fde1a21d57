import pytest
from pyspark.sql import functions as F

from spanwright.functions import text as T
from spanwright.functions.stem import stem
from spanwright.operators.chunking import chunk

GAPS = [" ", "\n", "\r\n", " ", " ", "\t "]


def python_chunks(text, size, overlap):
    spans, at = [], 0
    for word in text.split():
        start = text.index(word, at)
        at = start + len(word)
        spans.append((start, at))
    out = []
    for i in range(0, len(spans), size - overlap):
        last = min(i + size, len(spans)) - 1
        out.append((spans[i][0], spans[last][1]))
        if i + size >= len(spans):
            break
    return out


@pytest.mark.parametrize("size,overlap", [(200, 40), (5, 2), (3, 0), (1, 0)])
def test_chunks_match_a_plain_loop(spark, size, overlap):
    texts = [None, "", " \n\t", "one", "  lead and trail  "]
    texts += [GAPS[n % len(GAPS)].join(f"é{'🙂' * (i % 3)}w{i}" for i in range(n)) for n in (1, 2, 3, 5, 7, 39, 41, 161, 200, 201, 360, 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunk(df, size, overlap).orderBy("id", "ordinal").collect():
        assert texts[r["id"]][r["start_char"] : r["end_char"]] == r["chunk_text"]
        got.setdefault(r["id"], []).append((r["start_char"], r["end_char"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == python_chunks(t or "", size, overlap), i


@pytest.mark.parametrize("size,overlap", [(5, 5), (5, 6), (5, -1)])
def test_bad_chunk_sizes_fail(spark, size, overlap):
    with pytest.raises(ValueError):
        chunk(spark.createDataFrame([("a",)], "text string"), size, overlap)


def test_terms_are_distinct_and_cannot_inject(spark):
    df = spark.createDataFrame([("Cap cap & ! (LIABILITY) | 9",), ("?! &",)], "q string")
    assert [r[0] for r in df.select(T.or_terms("q")).collect()] == [["cap", "liability", "9"], None]


def test_stems(spark):
    df = spark.createDataFrame([("The Licensee shall indemnify; indemnification",)], "t string")
    assert df.select(T.tokens("t", stem=True)).first()[0] == ["license", "indemnifi", "indemnif"]
    known = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "hoping": "hope", "relational": "relat", "generously": "generous", "skies": "sky", "agreed": "agre", "succeeding": "succeed", "consistency": "consist", "happy": "happi", "national": "nation", "employment": "employ"}
    assert {w: stem(w) for w in known} == known


def test_clip_and_blank(spark):
    df = spark.createDataFrame([("a  b c",), ("abcdef",), ("  \n",)], "t string")
    assert [r[0] for r in df.select(T.clip("t", 5)).collect()] == ["a b c", "abcd…", ""]
    assert [r[0] for r in df.select(T.is_blank("t")).collect()] == [False, False, True]


def test_token_estimate(spark):
    assert spark.range(1).select(T.token_estimate(F.lit("12345678"))).first()[0] == 3
