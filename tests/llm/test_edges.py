"""Every operator takes odd tables: each case has the result its docstring names."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spanwright.llm import ann, html, langid, mixing, omh, packing, pii, substring, tiff, toxicity
from spanwright.llm.queries import tokenizer_path

EDGE_IDS = Counter([1, 2, 3, 4, 4, 5, None, None, 6, 7, 8, 9])


def labels(spark, rows=((4, 1), (5, 0), (6, 0), (6, None), (None, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


RUNS = {
    "toxicity": lambda d, s: toxicity.op1_toxicity(d, labels(s)),
    "langid": lambda d, s: langid.op3_langid(d),
    "tiff": lambda d, s: tiff.op5_media(d),
    "mixing": lambda d, s: mixing.op6_mix(d),
    "pii": lambda d, s: pii.op7_pii(d, b"k"),
    "near": lambda d, s: omh.op8_near(d),
    "substring": lambda d, s: substring.op10_substring(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_each_document(spark, edge, name):
    rows = RUNS[name](edge, spark).collect()
    assert Counter(r["doc_id"] for r in rows) == EDGE_IDS
    assert RUNS[name](edge.limit(0), spark).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[4][0] == by[4][1]
    if name == "langid":
        assert {by[i][0]["lang_pred"] for i in (1, 2, 3, 7)} == {"und"} and by[4][0]["lang_pred"] != "und"
    if name == "toxicity":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "mixing":
        assert by[1][0]["size"] == 0 and all(r["taken"] <= 2 * r["size"] for r in rows)
    if name == "near":
        assert {by[i][0]["class_id"] for i in (4, 5)} == {4} and by[1][0]["class_id"] == by[2][0]["class_id"] == 1 and by[9][0]["class_id"] == 9
    if name == "substring":
        assert by[4][0]["n_removed"] == by[4][0]["n_words"] == 54 and by[9][0]["n_removed"] == 40 and by[1][0]["n_words"] == 0
    if name == "tiff":
        assert by[1][0]["payload_bytes"] == 192 and by[6][0]["payload_bytes"] > 400_000


def test_packing_keeps_every_token(spark, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(edge, tokenizer_path()).collect()
    want = sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in edge.select("text").collect())
    assert sum(r["length"] for r in rows) == want
    assert packing.pack(edge.limit(0), tokenizer_path()).count() == 0


CLASHES = ("score", "size", "tkey", "entities", "hits", "lang_pred", "ids", "h", "class_id", "keeper", "base", "threshold", "row", "id", "text_", "_doc", "_row", "_copies", "width")


def test_pipeline_stages_keep_columns(spark, edge):
    plain = edge.select("doc_id", "text", "lang", "source", "n_chars")
    clashing = plain.selectExpr("*", *[f"doc_id AS `{c}`" for c in CLASHES])
    for docs in (plain, clashing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert stage(spark, docs.limit(0), "").count() == 0
            assert all(r["keeper"] == r["doc_id"] for r in out.collect()) if docs is clashing else out.count() > 0
        assert corpus_pipeline.packed(spark, docs, "").count() > 0 and corpus_pipeline.packed(spark, docs.limit(0), "").count() == 0
    kept = omh.near_deduplicated(plain).collect()
    assert len(kept) == len({r["text"] or "" for r in kept}) == 8


def slow_pipeline(spark, docs, tmp):
    """The five stages one after another over plain Python rows: what run() must return, as (doc_id, start, length, ids_crc32, doc_tokens) and how often."""
    import zlib
    from collections import Counter

    import numpy as np
    from test_operators import brute_near, shares
    from tokenizers import Tokenizer

    model = langid.fit(docs)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if (p := model.predict(r["text"]))[0] != "und" and p[1] >= 0.5]
    root = brute_near([r["text"] for r in rows])
    first = {}
    for r, c in zip(rows, root, strict=True):
        if c not in first or (r["doc_id"] is None, r["doc_id"]) < (first[c]["doc_id"] is None, first[c]["doc_id"]):
            first[c] = r
    rows = list(first.values())
    key = pii.session_key(spark)
    moved = {(r["kind"], r["original"]): r["attempt"] for r in pii.settled(spark.createDataFrame([(r["text"],) for r in rows], "text string"), key).collect()}
    for r in rows:
        r["text"] = pii.replace(r["text"], key, moved)[0]
    sizes = {}
    for r in rows:
        r["size"] = len(r["text"].split()) if r["text"].isascii() else len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"]) if w])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target, taken = shares(sizes), Counter()
    drawn = lambda r: hashlib.md5("|".join("" if r[c] is None else str(r[c]) for c in ("doc_id", "source", "text")).encode()).hexdigest()[:15]
    for source, size in sizes.items():
        base = int(target[source] // size) if size else 0
        rest, have, mine = target[source] - base * size, 0, sorted((r for r in rows if r["source"] == source), key=drawn)
        for i, r in enumerate(mine):
            more = 1 if have + r["size"] - rest < rest - have else 0
            taken[i, source] = base + (more if have < rest else 0)
            have += r["size"]
        for i, r in enumerate(mine):
            r["copies"] = taken[i, source]
    tok = Tokenizer.from_file(tokenizer_path())
    out = {}
    for r in rows:
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        if r["copies"]:
            out[r["doc_id"]] = (len(ids), zlib.crc32(ids.tobytes()), r["copies"], ids)
    return out


def test_the_pipeline_matches_a_slow_one(spark, edge, sf, tmp_path):
    import zlib
    from collections import defaultdict

    whole = spark.read.parquet(f"{sf}/documents.parquet")
    plain = edge.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10_000).dropDuplicates(["doc_id"])
    mixed = whole.select(*plain.columns).unionByName(plain)
    mixed.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = slow_pipeline(spark, docs, tmp_path)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: len(p) > 0 for d, p in pieces.items()} == {d: True for d in want}
    for d, rows in pieces.items():
        n, _, copies, ids = want[d]
        assert sum(r[1] for r in rows) == copies * n and {r[3] for r in rows} == {n}
        assert sorted(set(rows))[0][0] == 0 and all(r[2] == zlib.crc32(ids[r[0] : r[0] + r[1]].tobytes()) for r in rows)
        cover = [0] * n
        for start, length, *_ in rows:
            for i in range(start, start + length):
                cover[i] += 1
        assert set(cover) == {copies}
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (40, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (60, None), (8, [1.0, 2.0, 3.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.op4_ann(df).collect()}
    # The vector of three components is read beside the others, which end in a zero.
    assert got == {(20, 1): (1, 1.0), (20, 2): (2, 1.0), (20, 3): (8, 1.0), (20, 4): (40, 0.0), (40, 1): (8, 2.0), (40, 2): (1, 1.0), (40, 3): (2, 1.0), (40, 4): (20, 0.0)}
    assert ann.op4_ann(df.limit(0)).count() == 0


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://a/", "<p>a&nbsp;b <b>c</b>"), (3, "http://a/", "<p>a&nbsp;b <b>c</b>"), (None, "http://a/", "plain &lt;text"), (4, "http://b", "<script>x"), (5, "http://b", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2))
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect() if r["page_id"] != 5)
    assert got == Counter([(1, "", 0), (2, "", 0), (3, "a b c", 5), (3, "a b c", 5), (None, "plain <text", 11), (4, "", 0)])
    assert html.extract(df.limit(0)).count() == 0
