"""Overlapping word windows with exact code point offsets, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS

MAX_WORDS, OVERLAP = 200, 40


def chunk(docs: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """docs (without `text`) + ordinal, start_char, end_char, chunk_text; a row per window.

    One regular expression cuts the text into steps of max_words - overlap words; a window is a step
    and the first `overlap` words of the next. Windows end with the first that reaches the last word;
    blank and null texts have none. Each explode of one element pins what was computed, so that no
    later expression runs the pattern again.
    """
    if not 0 <= overlap < max_words:
        raise ValueError("need 0 <= overlap < max_words")
    keep = [c for c in docs.columns if c != text]
    s, w = f"[{WS}]", f"[^{WS}]+"
    step = rf"{w}(?:{s}+{w}){{0,{max_words - overlap - 1}}}{s}*"
    head = rf"^{w}(?:{s}+{w}){{0,{overlap - 1}}}" if overlap else r"^\b\B"
    once = lambda *cols: F.explode(F.array(F.struct(*cols)))
    t = F.col(text)
    cut = docs.select(*keep, once(F.regexp_extract_all(t, F.lit(step), F.lit(0)).alias("s"), F.length(F.regexp_extract(t, f"^{s}*", 0)).alias("lead")).alias("_p"))
    sized = cut.select(*keep, once(F.col("_p.s").alias("s"), F.transform("_p.s", F.length).alias("n"), F.col("_p.lead").alias("lead")).alias("_p"))
    rows = sized.select(*keep, "_p", F.posexplode("_p.s").alias("ordinal", "_s"))
    rows = rows.withColumn("_next", F.expr("get(_p.s, ordinal + 1)"))
    more = F.col("_next").isNotNull() | F.col("_s").rlike(rf"^(?:{w}{s}+){{{overlap}}}{w}") | (F.col("ordinal") == 0)
    start = F.col("_p.lead") + F.expr("aggregate(slice(_p.n, 1, ordinal), 0, (a, b) -> a + b)")
    window = F.regexp_replace(F.concat("_s", F.coalesce(F.regexp_extract("_next", head, 0), F.lit(""))), f"{s}+$", "")
    done = rows.filter(more).select(*keep, "ordinal", start.alias("start_char"), window.alias("chunk_text"))
    return done.select(*keep, "ordinal", "start_char", (F.col("start_char") + F.length("chunk_text")).alias("end_char"), "chunk_text")
