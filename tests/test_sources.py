import json

import pytest

from spanwright.sources import corpus, tables


def test_nested_corpus(spark, tmp_path):
    text = "The fee is five."
    qa = {"id": "c1__Fee", "question": "fee?", "is_impossible": False, "answers": [{"answer_start": 4, "text": "fee"}, {"answer_start": 5, "text": "fee"}]}
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"title": "c1", "paragraphs": [{"context": text, "qas": [qa]}]}]}))
    df = corpus.read_corpus(spark, str(tmp_path / "c.json"))
    assert df.first()["category"] == "Fee"
    assert [r["s"]["start"] for r in corpus.misaligned(df).collect()] == [5]
    (tmp_path / "bad.json").write_text(json.dumps({"data": [{"title": "c1", "paragraphs": []}]}))
    with pytest.raises(Exception, match="not one paragraph"):
        corpus.read_corpus(spark, str(tmp_path / "bad.json")).collect()


def test_ingest_is_idempotent(spark):
    docs = corpus.hashed(spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 1, "a"), (4, 0, "b")], "doc_id long, matter_id long, text string"))
    new = corpus.to_ingest(docs, docs.filter("doc_id = 4"))
    assert sorted(r["doc_id"] for r in new.collect()) == [1, 3]
    assert corpus.to_ingest(docs, docs).count() == 0
    with pytest.raises(Exception, match="NUL"):
        corpus.hashed(spark.createDataFrame([(1, 0, "a\0")], "doc_id long, matter_id long, text string")).collect()


def test_manifest_states(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "title string, text string")
    wanted = corpus.manifest(spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "q")], "title string, text string"))
    assert {r["title"]: r["state"] for r in corpus.manifest_check(wanted, docs).collect()} == {"a": "ok", "b": "changed", "c": "missing"}


def test_lines_and_labels(spark, tmp_path):
    assert corpus.read_lines(spark, str(tmp_path / "none"), "a int").count() == 0
    corpus.write_lines(spark.range(3), str(tmp_path / "x"))
    assert corpus.read_lines(spark, str(tmp_path / "x"), "id long").count() == 3
    out = str(tmp_path / "labelled")
    corpus.replace_label(spark.createDataFrame([(1, "a"), (2, "b")], "v int, label string"), out)
    corpus.replace_label(spark.createDataFrame([(9, "b")], "v int, label string"), out)
    assert sorted(map(tuple, spark.read.parquet(out).select("v", "label").collect())) == [(1, "a"), (9, "b")]


def test_violations_name_each_rule(spark):
    docs = spark.createDataFrame([(1, 0, "h", "t"), (2, 0, "h", "t")], "doc_id long, matter_id long, sha256 string, text string")
    bad = [(1, 1, 9, 0, 0, 1, "x", None, None), (2, 1, 0, 0, 5, 5, "", None, None), (3, 1, 0, 1, 0, 3, "ab", None, "m"), (4, 1, 0, 2, 0, 1, "a", [1.0], "m")]
    chunks = spark.createDataFrame(bad, "chunk_id long, doc_id long, matter_id long, ordinal int, start_char int, end_char int, chunk_text string, embedding array<float>, embedding_model string")
    members = spark.createDataFrame([("u", "guest")], "user_id string, role string")
    users = spark.createDataFrame([("u", "e"), ("v", "e")], "user_id string, email string")
    got = {r["constraint"] for r in tables.violations(docs, chunks, members, users).collect()}
    assert got == {"document_hash_unique", "chunk_document", "chunk_ordinal_unique", "chunk_range", "chunk_length", "embedding_with_model", "embedding_length", "member_role", "user_email_unique"}


def test_stale_and_matters(spark):
    chunks = spark.createDataFrame([(1, None), (2, "old"), (3, "m")], "chunk_id long, embedding_model string")
    assert sorted(r["chunk_id"] for r in corpus.stale(chunks, "m").collect()) == [1, 2]
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    assert [r["name"] for r in corpus.new_matters(names, names.filter("name = 'a'")).collect()] == ["b"]
