import math
import random

import pytest
from pyspark.sql import functions as F

from spanwright.operators import metrics as M
from spanwright.operators import scoring as O


def scores(spark, pos, neg):
    return spark.createDataFrame([(float(x), True) for x in pos] + [(float(x), False) for x in neg], "s double, pos boolean")


@pytest.mark.parametrize("pos,neg,want", [([2, 3], [0, 1], 1.0), ([0], [1, 2], 0.0), ([1, 1], [1], 0.5), ([], [1], None)])
def test_auc(spark, pos, neg, want):
    assert M.auc(scores(spark, pos, neg), "s", F.col("pos")).first()["auc"] == want


def test_gate_threshold_is_strict(spark):
    df = scores(spark, range(100), [1, 2, 3, 4])
    assert M.gate_threshold(df, "s", F.col("pos")).first()["threshold"] == 2.0
    assert M.gate_stats(df, "s", F.col("pos"), F.lit(2.0)).first().asDict() == {"false_abstain": 0.02, "caught": 0.25}


def test_percentiles_take_an_index(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0)], "k string, v double")
    got = {r["k"]: r["v"] for r in M.at_index(df, "v", M.percentile_index(0.95), "k").collect()}
    assert got == {"a": 9.0, "b": 5.0}
    assert M.at_index(df.filter("k = 'a'"), "v", M.p95_index()).first()["v"] == 8.0


@pytest.mark.parametrize("pairs,want", [([("x", "x"), ("y", "y")], 1.0), ([("x", "y"), ("y", "x")], -1.0), ([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")], 0.0)])
def test_kappa(spark, pairs, want):
    assert M.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()["cohen_kappa"] == want


def test_kappa_of_one_value_and_of_nothing(spark):
    one = spark.createDataFrame([("x", "x")], "a string, b string")
    assert math.isnan(M.kappa(one, "a", "b").first()["cohen_kappa"])
    with pytest.raises(Exception, match="no pairs"):
        M.kappa(one.limit(0), "a", "b").collect()


def test_running_sums_match_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice([rng.gauss(0, 1), 1e6 * rng.random(), 3.0]), rng.randrange(5)) for _ in range(500)]
    rows = list({(k, v): (k, v, c) for k, v, c in rows}.values())
    got = {(r["k"], r["v"]): r["before_c"] for r in M.running(spark.createDataFrame(rows, "k string, v double, c long"), "v", ["c"], "k").collect()}
    assert got == {(k, v): sum(c for k2, v2, c in rows if k2 == k and v2 < v) for k, v, _ in rows}
    assert M.running(spark.createDataFrame(rows, "k string, v double, c long").limit(0), "v", ["c"]).count() == 0


def test_best_signal_and_pairs(spark):
    rows = [("a", 1.0, True), ("a", 0.0, False), ("b", 0.0, True), ("b", 1.0, False), ("b", 0.5, True)]
    got = M.best_signal(spark.createDataFrame(rows, "signal string, s double, pos boolean"), "signal", "s", F.col("pos")).first()
    assert (got["signal"], got["auc"], got["threshold"]) == ("a", 1.0, 1.0)
    x = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    assert [r["v"] for r in M.paired(x, x, "k", "v").collect()] == [0.0, 0.0]
    with pytest.raises(Exception, match="not in both runs: 2"):
        M.paired(x, x.filter("k = 1"), "k", "v").collect()


def test_summaries_count_states_and_latency(spark):
    rows = [(i, i % 3 == 0, ["answered", "not_found", "rejected"][i % 3], "answered", "correct", i == 4, i % 2 == 0, float(i), "ollama:x", ["no_citations"] if i % 3 == 2 else []) for i in range(9)]
    df = spark.createDataFrame(rows, "question_id int, is_impossible boolean, status string, model_status string, verdict string, gated boolean, cached boolean, latency_ms double, model string, rejection_reasons array<string>")
    df = df.selectExpr("*", "1L AS whitespace_matches", "1L AS citations", "10L AS input_tokens", "5L AS output_tokens", "true AS grounded")
    got = O.run_summary(O.cost(df)).first()
    assert (got["answered_absent"], got["not_found_answerable"], got["rejected_answerable"], got["latency_p50_ms"], got["latency_p95_ms"], got["cost_usd"], got["rejection_reasons"]) == (3, 3, 3, 5.0, 7.0, 0.0, {"no_citations": 3})
    whole = O.model_metrics(O.outcomes(df)).first()
    assert (whole["latency_p50_s"], whole["latency_p95_s"]) == (0.005, 0.008)
    assert O.run_summary(O.cost(df.limit(0))).first()["latency_p50_ms"] is None


def test_bootstrap_brackets_and_repeats(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 70 else 0.0) for i in range(100)], "k int, v double")
    a, b = M.bootstrap(df, "v", "k", 300).first(), M.bootstrap(df, "v", "k", 300).first()
    assert a == b and a["lo"] < 0.7 < a["hi"]
    s = M.bootstrap_seeded(df.withColumn("g", F.lit("all")), "v", "k", "g", 300).first()
    assert s["lo"] < 0.7 < s["hi"]


def test_outcome_table(spark):
    rows = [
        (1, True, "not_found", "not_found", None), (2, True, "answered", "answered", None), (3, True, "rejected", "answered", None), (4, False, "answered", "answered", "correct"),
        (5, False, "answered", "answered", "incorrect"), (6, False, "not_found", "not_found", None), (7, False, "rejected", "answered", None),
    ]
    df = spark.createDataFrame(rows, "id int, is_impossible boolean, status string, model_status string, verdict string")
    got = {r["id"]: (r["correct"], r["abstained"], r["shown_wrong"], r["model_wrong"]) for r in O.outcomes(df).collect()}
    t, f = True, False
    assert got == {1: (t, t, f, f), 2: (f, f, t, t), 3: (f, f, f, t), 4: (t, f, f, f), 5: (f, f, t, t), 6: (f, t, f, f), 7: (f, f, f, t)}
    assert O.missing_verdicts(df.withColumn("verdict", F.lit(None).cast("string"))).count() == 2


def test_costs(spark):
    df = spark.createDataFrame([("claude-haiku-4-5", 1_000_000, 100_000), ("ollama:x", 5, 5)], "model string, input_tokens long, output_tokens long")
    assert sorted(r["cost_usd"] for r in O.cost(df).collect()) == [0.0, 1.5]
    with pytest.raises(Exception, match="no price"):
        O.cost(df.withColumn("model", F.lit("other"))).collect()
