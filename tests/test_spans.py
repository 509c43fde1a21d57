import pytest

from spanwright.operators import spans as S


def test_overlap_is_strict_and_containment_closed(spark):
    cases = [(0, 5, 5, 9), (5, 9, 0, 5), (0, 6, 5, 9), (8, 12, 5, 9), (6, 7, 5, 9), (0, 20, 5, 9)]
    df = spark.createDataFrame(cases, "a int, b int, c int, d int")
    assert [r[0] for r in df.select(S.overlaps("a", "b", "c", "d")).collect()] == [False, False, True, True, True, True]
    assert [r[0] for r in df.select(S.contains("a", "b", "c", "d")).collect()] == [False] * 5 + [True]


def test_merge_joins_touching_spans(spark):
    df = spark.createDataFrame([(1, 10, 20), (1, 0, 5), (1, 15, 30), (1, 30, 40), (1, 50, 60), (2, 0, 1)], "doc int, start int, end int")
    got = sorted(map(tuple, S.merge_regions(df, "doc").select("doc", "start", "end").collect()))
    assert got == [(1, 0, 5), (1, 10, 40), (1, 50, 60), (2, 0, 1)]


TEXT = "🙂 The  Fee (a.b*) is due\nin thirty days. Other part."


@pytest.mark.parametrize(
    "quote,regions,want",
    [
        ("Fee (a.b*)", [(0, 60)], "exact"),
        ("The Fee (a.b*) is due in thirty", [(0, 60)], "whitespace"),
        ("The Fee was due", [(0, 60)], None),
        ("  ", [(0, 60)], None),
        ("Other part", [(0, 30)], None),
        ("Other", [(0, 10), (30, 60)], "exact"),
    ],
)
def test_quotes_resolve_to_source_spans(spark, quote, regions, want):
    rows = spark.createDataFrame([(quote, TEXT, [{"start": a, "end": b} for a, b in regions])], "quote string, text string, regions array<struct<start:int,end:int>>")
    r = S.resolve_quotes(rows).first()
    assert r["mode"] == want
    if want:
        assert TEXT[r["start"] : r["end"]].split() == quote.split()
    else:
        assert r["start"] is None


def test_regions_are_tried_in_either_order(spark):
    text = "a  b | a b"
    rows = spark.createDataFrame([("a b", text, [{"start": 0, "end": 4}, {"start": 5, "end": 10}])], "quote string, text string, regions array<struct<start:int,end:int>>")
    assert S.resolve_quotes(rows).first()["mode"] == "exact"
    assert S.resolve_quotes(rows, per_region=True).first()["mode"] == "whitespace"


def test_citations_fail_for_the_first_reason(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "klmnop")], "doc_id int, text string")
    shown = spark.createDataFrame([(7, 1, 0, 4), (7, 1, 4, 6)], "question_id int, doc_id int, start int, end int")
    cites = [
        ("ok", 7, 1, 2, 6, "cdef"), ("empty", 7, 1, 2, 6, "  "), ("scope", 7, 9, 2, 6, "cdef"), ("neg", 7, 1, -1, 6, "cdef"),
        ("order", 7, 1, 6, 2, "cdef"), ("long", 7, 1, 2, 60, "cdef"), ("zero", 7, 1, 2, 2, "x"), ("differs", 7, 1, 3, 7, "cdef"), ("unseen", 7, 1, 5, 9, "fghi"),
    ]
    df = spark.createDataFrame(cites, "cite_id string, question_id int, doc_id int, start int, end int, quoted_text string")
    got = {r["cite_id"]: r["reason"] for r in S.verify_citations(df, docs, shown).collect()}
    assert got == {"ok": None, "empty": "empty_quote", "scope": "document_out_of_scope", "neg": "bad_offsets", "order": "bad_offsets", "long": "bad_offsets", "zero": "bad_offsets", "differs": "text_mismatch", "unseen": "not_in_context"}
