"""Interval algebra on half-open [start, end) spans, quote resolution and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, col, is_blank


def overlaps(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """[a, b) and [c, d) share a character; touching ends do not."""
    return (col(a) < col(d)) & (col(c) < col(b))


def contains(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """[a, b) holds all of [c, d)."""
    return (col(a) <= col(c)) & (col(d) <= col(b))


def merge_regions(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys..., start, end): spans that overlap or touch, merged. Empty spans take part."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    gap = spans.withColumn("_gap", F.when(F.col("start") > reach, 1).otherwise(0))
    island = gap.withColumn("_i", F.sum("_gap").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def flexible(quote: Column | str) -> Column:
    """A pattern for the quote's words with any white space between them."""
    words = F.filter(F.split(col(quote), f"[{WS}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))), f"[{WS}]+")


def resolve_quotes(quotes: DataFrame, per_region: bool = False) -> DataFrame:
    """quotes (quote_id, quote, text, regions array<struct<start,end>>) + start, end, mode.

    Regions are tried in order: all exactly, then all with flexible white space (mode 'exact' or
    'whitespace'); per_region tries both ways in a region before the next. Blank quotes and misses
    give null. Offsets are code points of the source text.
    """
    exact = F.expr("transform(regions, r -> struct(locate(quote, substring(text, r.start + 1, r.end - r.start)) AS at, r.start AS start, length(quote) AS len))")
    loose = F.expr("transform(regions, r -> struct(locate(regexp_extract(substring(text, r.start + 1, r.end - r.start), _p, 0), substring(text, r.start + 1, r.end - r.start)) AS at, r.start AS start, length(regexp_extract(substring(text, r.start + 1, r.end - r.start), _p, 0)) AS len))")
    rows = quotes.withColumn("_p", flexible("quote")).withColumn("_e", exact).withColumn("_l", loose)
    first = lambda c: F.expr(f"get(filter(transform({c}, (x, i) -> struct(i AS i, x.at AS at, x.start AS start, x.len AS len)), x -> x.at > 0 AND x.len > 0), 0)")
    rows = rows.withColumn("_e", first("_e")).withColumn("_l", first("_l"))
    use_exact = F.col("_e").isNotNull()
    if per_region:
        use_exact = use_exact & (F.col("_l").isNull() | (F.col("_e.i") <= F.col("_l.i")))
    pick = F.when(is_blank("quote"), F.lit(None)).when(use_exact, F.col("_e")).otherwise(F.col("_l"))
    mode = F.when(is_blank("quote"), F.lit(None)).when(use_exact, "exact").when(F.col("_l").isNotNull(), "whitespace")
    start = pick["start"] + pick["at"] - 1
    return rows.select(*quotes.columns, start.alias("start"), (start + pick["len"]).alias("end"), mode.alias("mode"))


#: Why a citation fails, in the order of the checks (fixed values).
EMPTY, OUT_OF_SCOPE, BAD_OFFSETS, MISMATCH, NOT_IN_CONTEXT = "empty_quote", "document_out_of_scope", "bad_offsets", "text_mismatch", "not_in_context"


def verify_citations(citations: DataFrame, docs: DataFrame, context: DataFrame) -> DataFrame:
    """citations (cite_id, question_id, doc_id, start, end, quoted_text) + reason, null when sound.

    docs: (doc_id, text) in scope; context: (question_id, doc_id, start, end) spans that were shown.
    """
    shown = merge_regions(context, "question_id", "doc_id").groupBy("question_id", "doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_shown"))
    rows = citations.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id", "left").join(shown, ["question_id", "doc_id"], "left")
    fits = F.coalesce(F.exists("_shown", lambda r: (r["start"] <= F.col("start")) & (F.col("end") <= r["end"])), F.lit(False))
    reason = (
        F.when(is_blank("quoted_text"), EMPTY)
        .when(F.col("_text").isNull(), OUT_OF_SCOPE)
        .when(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("_text"))), BAD_OFFSETS)
        .when(F.expr("substring(_text, start + 1, end - start)") != F.col("quoted_text"), MISMATCH)
        .when(~fits, NOT_IN_CONTEXT)
    )
    return rows.withColumn("reason", reason).select(*citations.columns, "reason")
