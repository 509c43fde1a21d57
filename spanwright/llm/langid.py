"""Language identification, words first, then ever shorter character n-grams.

A word of the learned lexicon adds its log frequency in each language. An unseen word backs off: the
longest n-grams of `<word>` that the model knows speak for it, by their mean log frequency; where
none of that length is known, the next shorter length is tried. Totals become a softmax.

Fitting counts a bounded sample of labelled documents (`sample`, by hash of the id), drawn by
language: all of rare ones, and an equal number of each of the others. It keeps a bounded lexicon;
every row is then predicted from its whole text. A unit that a language's sample lacks counts there
as in the language that would give it least, so that little sampled text is never an advantage, and
a language without any sampled letter is never predicted.

Defined results: `und` with score 0 for null texts and texts without a letter, and for all when
nothing was learned; letters of which no n-gram is known get the commonest language; rows without
id or language never train; repeated rows are predicted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, held_out, released, staged

#: Documents in the training sample, at most about; languages learned, the commonest first.
SAMPLE, LANGS = 12_000, 1_000
#: What is added to each count.
ADDED = 0.5
#: Lexicon entries per language; n-grams per language and length; longest n-gram.
LEXICON, GRAMS, LONGEST = 20_000, 10_000, 5
#: Words seen less often carry no reliable frequency and back off.
LEAST = 3
_WORD = re.compile(r"[^\W\d_]+")
#: Words remembered by a worker after backing off; the memory is emptied when full.
REMEMBERED = 50_000


@dataclass
class Model:
    """langs in order; a row of log frequencies for each word and n-gram; the prior as the last resort."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    rows: np.ndarray
    prior: np.ndarray
    extra: dict[str, np.ndarray] = field(default_factory=dict)

    def backed_off(self, word: str) -> np.ndarray:
        known = self.extra.get(word)
        if known is None:
            if len(self.extra) >= REMEMBERED:
                self.extra.clear()
            known = self.extra[word] = self._back_off(word)
        return known

    def _back_off(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            hits = [table[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in table]
            if hits:
                return self.rows[hits].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        total = self.prior.copy()
        rows, missing = [], []
        for w in _WORD.findall(text.lower()):
            at = self.words.get(w)
            rows.append(at) if at is not None else missing.append(w)
        if rows:
            total += self.rows[rows].sum(axis=0)
        for w in missing:
            total += self.backed_off(w)
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def quotas(per: dict[str, int], sample: int) -> dict[str, float]:
    """Documents to draw of each language: all of rare ones, an equal number of the others, `sample` in all."""
    out, left = {}, float(sample)
    for done, (lang, n) in enumerate(sorted(per.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(float(n), left / (len(per) - done))
        left -= out[lang]
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    marked = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    per = {r["lang"]: r["n"] for r in marked.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not per:
        return Model([], {}, [{} for _ in range(LONGEST + 1)], np.zeros((0, 0)), np.zeros(0))
    # A language is drawn below its share of the range of a hash; one that is drawn whole has all of it.
    range_ = 1 << 48
    below = [(lang, range_ if n >= per[lang] else round(range_ * n / per[lang])) for lang, n in quotas(per, sample).items()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, _below long"))
    some = marked.select("doc_id", "lang", "text").join(shares, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(range_)) < F.col("_below"))
    units = some.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("unit"))
    words = staged(units.groupBy("lang", "unit").agg(F.count("*").alias("n")), "words").withColumn("len", F.lit(0))
    marked_word = F.concat(F.lit("<"), "unit", F.lit(">"))
    pieces = words.select("lang", "n", marked_word.alias("m"), F.explode(F.array(*[F.lit(k) for k in range(1, LONGEST + 1)])).alias("len")).filter("length(m) >= len")
    pieces = pieces.select("lang", "n", "len", F.explode(F.expr("transform(sequence(1, length(m) - len + 1), i -> substring(m, i, len))")).alias("unit"))
    grams = pieces.groupBy("lang", "unit", "len").agg(F.sum("n").alias("n"))
    both = words.select("lang", "unit", "len", "n").unionByName(grams.select("lang", "unit", "len", "n"))
    sums = {(r["lang"], r["len"]): r["n"] for r in both.groupBy("lang", "len").agg(F.sum("n").alias("n")).collect()}
    rank = F.row_number().over(W.partitionBy("lang", "len").orderBy(F.desc("n"), "unit"))
    top = both.filter(F.col("n") >= LEAST).withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("len") == 0, LEXICON).otherwise(GRAMS))
    kept = top.groupBy("len", "unit").agg(F.collect_list(F.struct("lang", "n")).alias("seen")).orderBy("len", "unit").collect()
    langs = sorted({lang for lang, _ in sums})
    if not langs:
        return Model([], {}, [{} for _ in range(LONGEST + 1)], np.zeros((0, 0)), np.zeros(0))
    number = {x: i for i, x in enumerate(langs)}
    rows = np.zeros((len(kept), len(langs)))
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    for i, r in enumerate(kept):
        tables[r["len"]][r["unit"]] = i
        for lang, n in r["seen"]:
            rows[i, number[lang]] = n
    of = np.array([r["len"] for r in kept], np.int64)
    for k in range(LONGEST + 1):
        if tables[k]:
            whole = np.array([sums.get((x, k), 0) for x in langs]) + ADDED * len(tables[k])
            seen = rows[of == k]
            rows[of == k] = np.where(seen > 0, (seen + ADDED) / whole, ADDED / whole.max())
    prior = np.log(np.array([per[x] for x in langs]) / sum(per.values()))
    return Model(langs, tables[0], tables, np.log(rows), prior)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs + lang_pred, score (columns of those names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in blocks(batches, "text"):
            found = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
        m.extra.clear()

    return docs.select(*keep).mapInArrow(released(run), schema)


def op3_langid(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, lang_pred, score."""
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language is told with at least that score; their columns unchanged."""
    model = fit(docs)
    tagged = predict(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    return tagged.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")
