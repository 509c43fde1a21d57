import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["question_id", "chunk_id", "rank", "score"]


def test_stream_chunks(spark, tmp_path):
    from spanwright.streaming import ingest

    rows = [(1, 0, "a b c", "2024-01-01 00:00:00"), (2, 0, "a b c", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "doc_id long, matter_id long, text string, at string").selectExpr("doc_id", "matter_id", "text", "cast(at as timestamp) AS ingested_at").write.parquet(str(tmp_path / "in"))
    q = ingest.write_chunks(ingest.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
