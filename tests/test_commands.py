import pytest

from spanwright.operators import answering as A
from spanwright.plans import commands


def test_ingest_and_embed_can_run_again(spark, tmp_path):
    folder = str(tmp_path / "store")
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(1, 7, "a", "s", text), (2, 7, "b", "s", text), (3, 8, "c", "s", text), (4, 7, "d", "s", ""), (5, 7, "e", "s", "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, matter_id long, title string, source string, text string")
    taken = {r["doc_id"]: r["chunks"] for r in commands.ingest(spark, docs, folder).collect()}
    assert taken == {1: 2, 3: 2, 4: 0, 5: 1}
    assert commands.ingest(spark, docs, folder).count() == 0
    assert commands.stored(spark, folder, "documents").count() == 4 and commands.stored(spark, folder, "chunks").count() == 5
    for r in commands.stored(spark, folder, "chunks").join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["text"][r["start_char"] : r["end_char"]] == r["chunk_text"]
    assert commands.embed(spark, folder, "hashing-384") == 5 and commands.embed(spark, folder, "hashing-384") == 0
    assert commands.embed(spark, folder, "hashing-256") == 5
    assert {(len(r["embedding"]), r["embedding_model"]) for r in commands.stored(spark, folder, "chunks").collect()} == {(256, "hashing-256")}


def test_completions_are_cached_in_the_folder(spark, tmp_path):
    folder, client = str(tmp_path / "cache"), A.StubClient()
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "question_id long, prompt string")
    with pytest.raises(ValueError, match="offline"):
        commands.complete(spark, prompts, folder, client, offline=True)
    assert commands.complete(spark, prompts, folder, client).filter("cached").count() == 0
    assert commands.stored(spark, folder, "completions").count() == 2
    assert commands.complete(spark, prompts, folder, client, offline=True).filter("cached").count() == 3
