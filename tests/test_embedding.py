import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import embedding as E
from spanwright.operators import reports as P
from spanwright.sources import session, store


def test_stale_chunks_are_embedded_and_merged(spark):
    rows = [(1, "alpha beta", None, None), (2, "alpha", [9.0], "older"), (3, "kept", [7.0], "hashing-256"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_id long, chunk_text string, embedding array<double>, embedding_model string")
    model = E.embedder("hashing-256")
    done = E.embedded(df, model)
    got = {r["chunk_id"]: r for r in done.collect()}
    assert got[3]["embedding"] == [7.0] and {r["embedding_model"] for r in got.values()} == {"hashing-256"}
    assert np.allclose(got[1]["embedding"], model.encode(["alpha beta"])[0]) and sum(got[4]["embedding"]) == 0 and len(got[2]["embedding"]) == 256
    assert E.searchable(done, "other").count() == 0 and E.searchable(df, "older").count() == 1
    again = {r["chunk_id"]: r["embedding"] for r in E.embedded(done, model).collect()}
    assert again == {k: r["embedding"] for k, r in got.items()}
    with pytest.raises(ValueError, match="unknown embedding model"):
        E.embedder("none")
    assert E.truncated_share(spark.range(4).withColumnRenamed("id", "t"), "t", 2).first()[0] == 0.25


def test_reports_are_tables(spark, tmp_path):
    rows = [("bm25", 9, 0.5, 0.72, 0.68, 0.77, 0.791, 0.6, 0.561, 0.64), ("hybrid", 9, 0.51, None, 0.71, 0.8, 0.84, 0.61, 0.57, 0.65)]
    names = "method n recall_1 recall_5 recall_5_lo recall_5_hi recall_10 mrr_10 mrr_10_lo mrr_10_hi".split()
    lines = P.retrieval_report(spark.createDataFrame(rows, names))
    assert [r["text"] for r in lines.orderBy("line").collect()] == [
        "| method | recall@1 | recall@5 [95% CI] | recall@10 | MRR@10 [95% CI] |", "|---|---|---|---|---|",
        "| bm25 | 0.50 | 0.72 [0.68, 0.77] | 0.79 | 0.60 [0.56, 0.64] |", "| hybrid | 0.51 | n/a [0.71, 0.80] | 0.84 | 0.61 [0.57, 0.65] |",
    ]
    P.write_report(lines, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 4


def test_settings_come_from_the_session(spark):
    assert session.Settings.of(spark).redact is True
    spark.conf.set("spark.spanwright.redact", "false")
    spark.conf.set("spark.spanwright.k", "9")
    try:
        told = session.run_metadata(spark, "run", command="test").first()
        assert session.Settings.of(spark).redact is False and told["settings"]["k"] == "9" and told["settings"]["command"] == "test" and told["made_at"]
    finally:
        spark.conf.unset("spark.spanwright.redact")
        spark.conf.unset("spark.spanwright.k")


def test_kept_tables_follow_their_inputs(spark, tmp_path):
    made = []

    def table(path):
        df = spark.read.parquet(path)
        return store.kept(spark, "sum", [df], lambda: made.append(path) or df.agg(F.sum("id").alias("s")))

    for name, n in (("a", 5), ("b", 7)):
        spark.range(n).write.parquet(str(tmp_path / name))
    assert [table(str(tmp_path / x)).first()["s"] for x in "aba"] == [10, 21, 10] and len(made) == 2
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "a"))
    assert table(str(tmp_path / "a")).first()["s"] == 3
    twice = store.written(spark.range(3), "twice")
    assert twice.join(twice.withColumnRenamed("id", "x")).count() == 9
