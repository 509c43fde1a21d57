import collections

import numpy as np
import pytest

from spanwright.llm import ann

SCHEMA = "curve int, at long, vec_id long, ask boolean, held boolean, vec binary"


def placed(spark, x, ids, curves, rng, ask):
    orders = [rng.permutation(len(x)) for _ in range(curves)]
    rows = [(c, int(at), int(ids[i]), bool(ask[i]), bool(i % 7), x[i].tobytes()) for c, order in enumerate(orders) for i, at in enumerate(order)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), orders


@pytest.mark.parametrize(("curves", "width", "reach"), [(1, 999, 1 << 16), (3, 40, 128), (2, 700, 256), (2, 0, 100)])
def test_blocks_meet_what_is_within_their_windows(spark, monkeypatch, curves, width, reach):
    """As a slow scan of the windows, with repeated ids, copies and rows that only ask."""
    monkeypatch.setattr(ann, "GROUP", 32)
    monkeypatch.setattr(ann, "LEAST", reach)
    monkeypatch.setattr(ann, "MOST", reach)
    rng = np.random.default_rng(curves)
    n, k = 1000, 4
    x, ids = rng.normal(size=(n, 6)), np.arange(n) // 3 * 3 // 2
    x[rng.random(n) < 0.2] = x[0]
    ask = rng.random(n) < 0.1
    frame, orders = placed(spark, x, ids, curves, rng, ask)
    got = collections.defaultdict(dict)
    for r in ann.met(frame, n, int(ask.sum()), curves, width, k, 6).collect():
        got[r["query_id"]][r["vec_id"]] = max(r["score"], got[r["query_id"]].get(r["vec_id"], -np.inf))
    want = collections.defaultdict(dict)
    for at in orders:
        for i in np.flatnonzero(ask):
            for j in np.flatnonzero((np.abs(at - at[i]) <= width) & (np.arange(n) % 7 > 0) & (ids != ids[i])):
                want[ids[i]][ids[j]] = max(float((x[j] * x[i]).sum()), want[ids[i]].get(ids[j], -np.inf))
    best = lambda found: sorted((-s, j) for j, s in found.items())[:k]
    assert {i: best(f) for i, f in got.items() if f} == {i: best(f) for i, f in want.items() if f}


def test_rows_made_grow_with_the_queries(spark):
    """Four times the table, where every query meets all of it: four times the rows, not sixteen times."""
    made, parts = [], 2 * spark.sparkContext.defaultParallelism
    for n in (parts * ann.GROUP, 4 * parts * ann.GROUP):
        rng = np.random.default_rng(1)
        frame, _ = placed(spark, rng.normal(size=(n, 3)), np.arange(n), 1, rng, np.arange(n) % 20 == 0)
        made.append(ann.met(frame, n, -(-n // 20), 1, n, 5, 3).count())
        assert made[-1] <= -(-n // 20) * 5 * parts
    assert made[1] <= 4.1 * made[0]
