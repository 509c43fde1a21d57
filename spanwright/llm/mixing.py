"""Mixing sources to target weights by hash-threshold histograms.

Every document draws a 64-bit hash. Sizes are summed by source and by the hash's top bits; the
running sum over buckets names the bucket in which a source's budget ends. Only that boundary
bucket is refined by the next bits, twice, and at last document by document, so a filter
`hash <= threshold` replaces any sort of the corpus. Thresholds are nested: a larger budget keeps
all that a smaller one kept.

Defined results: null text has size 0; a null source is a source of its own, last; rows with equal
id, text and source share one hash and are taken or left together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Words: runs of anything but space and U+0009 to U+000D (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that one level of the histogram resolves.
BITS = 10
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words to take from each source: (source, source_size) -> + target.

    Sources in code point order, null last, carry the weights in turn. The budget, `share` of all
    sizes, is dealt by weight; a source stops at `most` times its size and what it leaves is dealt
    again by weight. In closed form: with caps sorted by cap/weight, the level is the first value
    (budget - caps before) / (weights from here on) that does not exceed its own cap/weight.
    The rows here are one per source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("level", F.min_by(fits, F.when(fits.isNotNull(), F.col("cap") / F.col("weight"))).over(every))
    # No source fits only when the share exceeds the caps: then all stop at their caps.
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash up to which documents are taken: (source, rest) -> (source, threshold).

    sized holds (source, h, size) with 0 <= h < 2**60, and 0 <= rest < sum of the source's sizes, so
    at every level one bucket's running sum is the first to pass the rest. The kept prefix, in hash
    order, is the one whose sum lies nearest to the rest. A source without words has no row here.
    """
    state = budgets.select("source", F.col("rest").cast("double"), F.lit(0).cast("long").alias("prefix"))
    for depth in (1, 2, 3, None):
        shift = 60 - BITS * (depth or 6)
        cell = 60 - BITS * ((depth or 4) - 1)
        s = state.select(F.col("source").alias("s"), "rest", "prefix")
        near = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", cell) == F.col("prefix"))
        summed = sized.join(s, near).groupBy("source", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("size"))
        run = summed.withColumn("upto", F.sum("size").over(W.partitionBy("source").orderBy("bucket")))
        passing = run.filter(F.col("upto") > F.col("rest"))
        first = F.min(F.struct("bucket", "upto", "size", "rest"))
        found = passing.groupBy("source").agg(first.alias("x")).select("source", "x.*").withColumn("before", F.col("upto") - F.col("size"))
        if depth:
            state = found.select("source", (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("prefix"))
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")
    return found.select("source", F.when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("threshold"))


def drawn(docs: DataFrame) -> Column:
    """A document's 60-bit hash: the first 15 digits of the MD5 of its id, source and text."""
    key = F.concat_ws("|", *[F.coalesce(docs[c].cast("string"), F.lit("")) for c in ("doc_id", "source", "text")])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., source, size, h): all that the histograms need of a document."""
    return docs.select(*keep, "source", word_count(F.col("text")).alias("size"), drawn(docs).alias("h"))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, base, threshold): take base copies, one more up to the threshold."""
    sums = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goal = staged(targets(sums, weights, share, most), "mix-targets")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = goal.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    cut = thresholds(rows, goal).withColumnRenamed("source", "s")
    return staged(goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "base", "threshold"), "mix-plan")


def mix(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """rows as from sized(): + source_size, target, copies (how often the mix takes the document)."""
    p = plan(rows, weights, share, most).withColumnRenamed("source", "s")
    more = F.coalesce((F.col("h") <= F.col("threshold")).cast("int"), F.lit(0))
    return rows.join(p, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.col("base") + more).drop("s", "base", "threshold")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: documents with their own columns, each as often as it is taken (0, 1, 2 ...)."""
    p = plan(staged(sized(docs), "mix-sizes"), weights, share, most).select(F.col("source").alias("s"), "base", "threshold")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), drawn(docs).alias("h"))  # whatever the columns' names
    more = F.coalesce((F.col("h") <= F.col("threshold")).cast("int"), F.lit(0))
    copies = rows.join(p, F.col("row.source").eqNullSafe(F.col("s"))).select("row", (F.col("base") + more).alias("copies")).filter("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op6_mix(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, size, source_size, target, taken."""
    rows = staged(sized(docs, "doc_id"), "mix-sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
