"""Seeded samples, round-robin question sets and labelling queues by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The twenty clause categories, in order (fixed values).
CATEGORIES = [
    "Parties",
    "Agreement Date",
    "Governing Law",
    "Expiration Date",
    "Anti-Assignment",
    "Termination For Convenience",
    "Cap On Liability",
    "Audit Rights",
    "Post-Termination Services",
    "Insurance",
    "Exclusivity",
    "Renewal Term",
    "Minimum Commitment",
    "Change Of Control",
    "Revenue/Profit Sharing",
    "Non-Compete",
    "Notice Period To Terminate Renewal",
    "Ip Ownership Assignment",
    "License Grant",
    "Liquidated Damages",
]


def draw(seed: int, key: Column) -> Column:
    """A seeded order that any engine with MD5 repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by seeded order, independent of the input's order."""
    return rows.withColumn("_d", draw(seed, F.col(key))).orderBy("_d", key).limit(n).drop("_d")


def all_pairs(questions: DataFrame, answerable: bool) -> DataFrame:
    """Questions of the chosen categories with the given answerability."""
    return questions.filter(F.col("category").isin(CATEGORIES) & (F.col("is_impossible") != F.lit(answerable)))


def round_robin(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n questions cycling through the categories in their order, shuffled within each."""
    turn = F.row_number().over(W.partitionBy("category").orderBy(draw(seed, F.col(key)), key))
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    # Later turns cannot be drawn, so each category keeps at most n rows for the final order.
    few = pool.withColumn("_t", turn).filter(F.col("_t") <= n).withColumn("_p", place)
    drawn = few.orderBy("_t", "_p").limit(n).drop("_t", "_p")
    # Fewer than asked for is an error, told with the rows: the count is of n rows at most.
    short = F.when(F.count("*").over(W.partitionBy(F.lit(0))) < n, F.raise_error(F.lit(f"fewer than {n} questions to draw from")))
    return drawn.withColumn("_short", short).filter("_short IS NULL").drop("_short")


def numbered(rows: DataFrame, order: str, prefix: str) -> DataFrame:
    """rows + id, prefix and a three-digit number in the given order (a drawn set: few rows)."""
    return rows.withColumn("id", F.format_string(prefix + "%03d", F.row_number().over(W.orderBy(order))))


def label_queue(items: DataFrame, run: str, key: str, n: int, runs: int, seed: int = 0) -> DataFrame:
    """(item_id, run, key, position): n items spread evenly over runs, the rest to the first runs."""
    per, rest = divmod(n, runs)
    turn = F.row_number().over(W.partitionBy(run).orderBy(draw(seed, F.col(key)), key))
    first = F.dense_rank().over(W.orderBy(run))
    quota = items.select(run).distinct().withColumn("_q", F.lit(per) + (first <= rest).cast("int"))
    some = items.withColumn("_t", turn).filter(F.col("_t") <= per + 1).join(F.broadcast(quota), run).filter(F.col("_t") <= F.col("_q"))  # a row per run
    item = F.concat_ws(":", F.col(run), F.col(key))
    return some.select(item.alias("item_id"), run, key).withColumn("position", F.row_number().over(W.orderBy(draw(seed, F.col("item_id")), "item_id")))
