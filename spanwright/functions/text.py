"""Column expressions for words, query terms, clipping and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and re see it; Java's \s is ASCII only (fixed values).
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Words without meaning for ranking (a fixed list).
STOPWORDS = """
a an and any are as at be been but by can could do does for from had has have how i if in into is
it its may of on or our shall should such than that the their them then there these they this those
to under upon was we were what when where which who whom will with would you
""".split()

CHARS_PER_TOKEN = 3.5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, stem: bool = False) -> Column:
    """Lower-cased alphanumeric runs without stopwords, in order; optionally stemmed."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(r"[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    if stem:
        from .stem import stem_all

        return stem_all(kept)
    return kept


def or_terms(question: Column | str) -> Column:
    """Distinct lower-cased terms in order of first appearance; null when there is none."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all(col(question), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))
    return F.when(F.size(terms) > 0, terms)


def squeezed(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), f"[{WS}]+", " "))


def is_blank(text: Column | str) -> Column:
    return squeezed(text) == ""


def clip(text: Column | str, n: int) -> Column:
    """Squeezed text of at most n characters; a cut is shown by an ellipsis."""
    t = squeezed(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(col(text)) / F.lit(CHARS_PER_TOKEN)).cast("long")


def digest(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def reason_kind(reason: Column | str) -> Column:
    """A rejection reason without its detail after the colon."""
    return F.substring_index(col(reason), ":", 1)
