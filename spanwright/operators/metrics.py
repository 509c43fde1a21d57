"""Evaluation statistics as aggregates: rates, percentiles by index, AUC, kappa, gates, bootstrap."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col

RESAMPLES, ALPHA = 2000, 0.05


def rate(condition: Column) -> Column:
    """Share of rows where the condition holds (null counts as not)."""
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))


def share(part: Column, whole: Column) -> Column:
    """Rows with both conditions over rows with `whole`; null when there is none of these."""
    return F.sum((part & whole).cast("double")) / F.nullif(F.sum(whole.cast("double")), F.lit(0.0))


def recall_at(rank: Column | str, k: int) -> Column:
    return rate(col(rank) <= k)


def reciprocal_rank_at(rank: Column | str, k: int) -> Column:
    return F.avg(F.when(col(rank) <= k, 1.0 / col(rank)).otherwise(0.0))


def first_hit_rank(hits: DataFrame, relevant: Column | str, *keys: str) -> DataFrame:
    """(keys..., rank): rank of the first relevant hit, null for a miss."""
    return hits.groupBy(*keys).agg(F.min(F.when(col(relevant), F.col("rank"))).alias("rank"))


#: Cells that a group's range of values is cut into for running sums.
CELLS = 4096


def running(rows: DataFrame, value: str, amounts: list[str], *keys: str) -> DataFrame:
    """rows (one a group and value) + before_<amount>: the amount of all lesser values of the group.

    Sums of cells run first, a bounded number of rows a group; then each cell runs on its own, so a
    large group spreads over as many tasks as it has cells.
    """
    own = [F.col(k).alias(f"_{k}") for k in keys]
    same = lambda extra: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + extra
    span = rows.groupBy(*own).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    whole = rows.join(span, same([])) if keys else rows.crossJoin(F.broadcast(span))  # one row
    share = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    cell = whole.withColumn("_cell", F.when(F.col("_hi") > F.col("_lo"), F.floor(share * (CELLS - 1))).otherwise(0)).select(*rows.columns, "_cell")
    sums = cell.groupBy(*own, F.col("_cell").alias("_at")).agg(*[F.sum(x).alias(f"_{x}") for x in amounts])
    over = W.partitionBy(*[f"_{k}" for k in keys] or [F.lit(0)]).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*[f"_{k}" for k in keys], "_at", *[F.coalesce(F.sum(f"_{x}").over(over), F.lit(0)).alias(f"_base_{x}") for x in amounts])
    inner = W.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    sums_to = [(F.col(f"_base_{x}") + F.coalesce(F.sum(x).over(inner), F.lit(0))).alias(f"before_{x}") for x in amounts]
    return cell.join(base, same([F.col("_cell") == F.col("_at")])).select(*rows.columns, *sums_to)


def at_index(values: DataFrame, value: str, index: Column, *keys: str) -> DataFrame:
    """The value at a 0-based index (an expression over n) of each group's sorted values.

    One value and its count per row travel: groups of many equal values stay small.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    total = counted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("c").alias("n"))
    rows = running(counted, value, ["c"], *keys)
    rows = rows.join(total, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else rows.crossJoin(F.broadcast(total))  # one row
    return rows.filter((F.col("before_c") <= index) & (F.col("before_c") + F.col("c") > index)).select(*keys, value, "n")


def p95_index() -> Column:
    """Index of the p95 of chunk statistics: int(0.95 * (n - 1))."""
    return F.floor(F.lit(0.95) * (F.col("n") - 1))


def percentile_index(q: float) -> Column:
    """Index of latency percentiles: min(n - 1, int(q * n))."""
    return F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))


def auc(scores: DataFrame, score: str, positive: Column, *keys: str) -> DataFrame:
    """(keys..., auc): chance that a positive outscores a negative, ties half; null if a side is empty.

    Rank sums over distinct scores instead of all pairs.
    """
    by = scores.groupBy(*keys, score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    won = running(by, score, ["q"], *keys).withColumn("won", F.col("p") * (F.col("before_q") + F.col("q") / 2.0))
    p, n = F.sum("p"), F.sum("q")
    return won.groupBy(*keys).agg((F.sum("won") / F.nullif(p * n, F.lit(0))).alias("auc"))


def best_signal(scores: DataFrame, signal: str, score: str, positive: Column, most_blocked: float = 0.02) -> DataFrame:
    """(signal, auc, threshold) of the signal that tells best: highest AUC, ties by name. scores: a row per signal and question."""
    each = auc(scores, score, positive, signal)
    first = each.agg(F.max_by(F.struct(signal, "auc"), F.struct(F.coalesce("auc", F.lit(-1.0)), signal)).alias("b")).select(f"b.{signal}", "b.auc")
    cut = at_index(scores.filter(positive), score, F.floor(F.lit(most_blocked) * F.col("n")), signal).select(F.col(signal), F.col(score).alias("threshold"))
    return first.join(cut, signal, "left")


def gate_threshold(scores: DataFrame, score: str, positive: Column, most_blocked: float = 0.02) -> DataFrame:
    """(threshold): the positives' score at index int(rate * n); a gate blocks strictly below it."""
    return at_index(scores.filter(positive), score, F.floor(F.lit(most_blocked) * F.col("n"))).select(F.col(score).alias("threshold"))


def gate_stats(scores: DataFrame, score: str, positive: Column, threshold: Column) -> DataFrame:
    """(false_abstain, caught): shares of positives and of negatives below the threshold."""
    blocked = F.col(score) < threshold
    return scores.agg(share(blocked, positive).alias("false_abstain"), share(blocked, ~positive).alias("caught"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): a's value less b's. Keys that only one of them has fail the job."""
    both = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_x")).join(b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_y")), key, "full")
    return both.select(key, F.when(F.col("_x") & F.col("_y"), F.col("_a") - F.col("_b")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not in both runs:"), F.col(key).cast("string"))).cast("double")).alias(value))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, raw_agreement, cohen_kappa); kappa is NaN where chance agreement is 1. No pairs fail the job."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("c"))
    both = cells.select(F.col(a).alias("v"), F.col("c").alias("x"), F.lit(0).cast("long").alias("y"), F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0).alias("d"))
    both = both.unionByName(cells.select(F.col(b).alias("v"), F.lit(0).cast("long").alias("x"), F.col("c").alias("y"), F.lit(0).cast("long").alias("d")))
    margins = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("d").alias("d"))
    s = margins.agg(F.sum("x").alias("n"), F.sum("d").alias("same"), F.sum(F.col("x").cast("double") * F.col("y")).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    some = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no pairs to compare")).cast("long"))
    return s.select(some.alias("n"), po.alias("raw_agreement"), F.when(pe == 1, F.lit(float("nan"))).otherwise((po - pe) / (1 - pe)).alias("cohen_kappa"))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count("*").alias("n"))


def bootstrap(values: DataFrame, value: str, key: str, resamples: int = RESAMPLES, alpha: float = ALPHA, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups..., mean, lo, hi) by hash-indexed resampling, the same on any engine with MD5.

    Values are numbered by key within their group; draw j of resample i takes the value numbered
    md5(i:j) modulo n. The sorted means at indices int(alpha/2 * r) and int((1 - alpha/2) * r) - 1
    bound the interval. For per-question values: n * resamples draws are made in each group.
    """
    by = list(groups)
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    numbered = values.select(*by, value, (F.row_number().over(part.orderBy(key)) - 1).cast("long").alias("_i"))
    size = values.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    draws = values.sparkSession.range(resamples).select(F.col("id").alias("r")).crossJoin(F.broadcast(size))  # a row per group of questions
    draws = draws.filter("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "r", "j")), 1, 8), 16, 10).cast("long"), F.col("n"))
    drawn = draws.select(*by, "r", "mean", pick.alias("_i")).join(numbered, [*by, "_i"])
    means = drawn.groupBy(*by, "r").agg(F.round(F.avg(value), 9).alias("m"), F.first("mean").alias("mean"))
    sorted_ = means.withColumn("at", F.row_number().over(part.orderBy("m", "r")))
    lo, hi = int(alpha / 2 * resamples), int((1 - alpha / 2) * resamples) - 1
    return sorted_.groupBy(*by).agg(F.first("mean").alias("mean"), F.max(F.when(F.col("at") == lo + 1, F.col("m"))).alias("lo"), F.max(F.when(F.col("at") == hi + 1, F.col("m"))).alias("hi"))


def bootstrap_seeded(values: DataFrame, value: str, key: str, group: str, resamples: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """(group, mean, lo, hi) with Python's seeded generator, one task per group: for published figures."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(key)[value].tolist()
        rng, n = random.Random(seed), len(v)
        means = sorted(sum(v[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean": [sum(v) / n], "lo": [means[int(alpha / 2 * resamples)]], "hi": [means[int((1 - alpha / 2) * resamples) - 1]]})

    kind = values.schema[group].dataType.simpleString()
    return values.groupBy(group).applyInPandas(run, f"`{group}` {kind}, mean double, lo double, hi double")
