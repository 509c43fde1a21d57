import math

import numpy as np

import __spark_entry__ as entry
from spanwright.operators import nearest as N
from spanwright.operators import ranking as R

SCHEMA = "vec_id long, embedding array<float>, label int"


def cosines(v, w):
    """As SQL: null for null or empty vectors, NaN for zero or non-finite ones. Unequal lengths and null components, which SQL refuses: null."""
    if not v or not w or len(v) != len(w) or None in v or None in w:
        return None
    a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
    with np.errstate(all="ignore"):
        return round(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), 6)


def all_pairs(rows, k):
    place = lambda s: (2, 0) if s is None else (0, 0) if math.isnan(s) else (1, -s)
    told = lambda s: "nan" if s is not None and math.isnan(s) else s
    out, mine = [], {}
    for i, v, scope in rows:
        mine.setdefault(i, []).extend((cosines(v, w), j) for j, w, other in rows if scope is not None and scope == other and None not in (i, j) and i != j)
    for i, found in mine.items():
        found.sort(key=lambda f: (place(f[0]), f[1]))
        out += [(i, j, n + 1, told(s)) for n, (s, j) in enumerate(found[:k])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collected(df):
    nan = lambda s: "nan" if s is not None and math.isnan(s) else s
    return sorted(((r["query_id"], r["vec_id"], r["rank"], nan(r["score"])) for r in df.collect()), key=lambda r: (r[0], r[2]))


def test_vector_topk_on_odd_vectors(spark, tmp_path):
    """Zero, null, empty and non-finite vectors, repeated ids, copies, missing labels and labels of one row."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist(), i % 3) for i in range(90)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], 1) for i in range(40)]
    rows += [(200, [0.0] * 6, 0), (201, None, 0), (202, [], 0), (203, [math.nan, *[1.0] * 5], 1), (204, [math.inf, *[1.0] * 5], 1), (205, [1.0] * 6, None), (None, [1.0] * 6, 0), (206, [1.0] * 6, 7), (207, [1.0, 2.0], 2), (208, [1.0, None, *[1.0] * 4], 2), (5, [1.0] * 6, 2), (-4, [1.0] * 6, 0)]
    rows += [(300, None, 8), (301, [0.0] * 6, 8), (302, [1.0] * 6, 8), (303, [], 9), (304, None, 9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = entry.queries()["vector_topk"](spark, str(tmp_path))
    assert got.columns == ["query_id", "vec_id", "rank", "score"] and collected(got) == all_pairs(rows, 10)


def test_blocks_of_queries_meet_their_whole_scope(spark, monkeypatch):
    """A scope of several blocks gives what all pairs give, and k rows a query leave the blocks, not a row a pair."""
    monkeypatch.setattr(N, "LEAST", 16)
    monkeypatch.setattr(N, "MOST", 16)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), 0 if i % 4 else 1) for i, v in enumerate(rng.normal(size=(400, 5)))] + [(1000 + i, [1.0] * 5, 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id AS id", "label AS scope", "embedding AS vec").repartition(5)
    found = N.cosine_nearest(df, 7)
    assert found.count() == 7 * len(rows)
    assert collected(R.top(found, 7, key="vec_id", by="query_id")) == all_pairs(rows, 7)


def test_no_vectors(spark):
    assert N.cosine_nearest(spark.createDataFrame([], "id long, scope int, vec array<float>"), 3).count() == 0
