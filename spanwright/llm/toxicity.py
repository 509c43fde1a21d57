"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased; each n-gram of the set sizes is hashed to one of 2**BITS features, present or
absent. From labelled text come, per feature, the documents of each class that hold it, so its
log-count ratio; features whose class shares differ clearly are kept, and a logistic regression
over presence times ratio is trained on them. Scoring is one narrow pass over whole texts.

The fit uses a bounded sample of labelled rows (`sample`, by hash of the id); all rows are scored.

Defined results: null or empty texts score the intercept alone; rows without id are held out; a
null label is no label; an id with both labels trains as both, one
that several rows carry by its least text; without any usable label of either
class every score is the share of toxic labels (0.5 if none); repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, released, staged

BITS = 20
SIZES = (3, 4, 5, 6)
#: Documents in the training sample, at most about (a Poisson deviation aside).
SAMPLE = 12_000
#: Features kept, at most; and how many standard errors the class shares must differ by.
FEATURES, CLEAR = 16_384, 4.0

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, text numbers) of all n-grams in the texts, sizes one after another, with repeats."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in low])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), np.diff(ends, prepend=0)) if low else np.zeros(0, np.int32)
    found, at, h = [], [], None
    for n in range(1, max(SIZES) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        part = (code[n - 1 :] + np.uint32(n)) * _MULT[n - 1]
        h = part if h is None else h[:m] + (part ^ (part >> np.uint32(15)))
        if n in SIZES:
            x = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
            inside = doc[:m] == doc[n - 1 :]
            found.append((x >> np.uint32(32 - BITS))[inside])
            at.append(doc[:m][inside])
    none = np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return (np.concatenate(found), np.concatenate(at)) if found else none


@dataclass
class Model:
    """keys: kept features, sorted; weights: their ratio times coefficient; bias: the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        slot = np.zeros(1 << BITS, np.int32)
        slot[self.keys] = np.arange(1, len(self.keys) + 1)
        return slot

    def score(self, texts: list[str], slot: np.ndarray) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        doc, key = kept(texts, slot)
        if len(doc):
            total += np.bincount(doc, self.weights[key], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def kept(texts: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, kept feature number) pairs."""
    found, at = features(texts)
    s = slot[found]
    hit = np.flatnonzero(s)
    pairs = np.unique(at[hit].astype(np.int64) << 32 | (s[hit] - 1))
    return pairs >> 32, pairs & 0xFFFFFFFF


def logistic(doc: np.ndarray, key: np.ndarray, ratio: np.ndarray, label: np.ndarray, penalty: float = 0.02, steps: int = 12) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the L2-penalised logistic loss, by Newton steps solved by conjugate gradients."""
    n, k = len(label), len(ratio)
    value = ratio[key]
    ahead = lambda v: np.bincount(doc, value * v[key], n) + v[k]
    back = lambda r: np.append(np.bincount(key, value * r[doc], k), r.sum())
    ridge = np.append(np.full(k, penalty), 1e-6)
    w = np.zeros(k + 1)

    def loss(v: np.ndarray) -> float:
        z = ahead(v)
        return float(np.sum(np.logaddexp(0, z) - label * z) + 0.5 * ridge @ (v * v))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -40, 40)))
        g = back(p - label) + ridge * w
        curve = p * (1 - p)
        d, r = np.zeros(k + 1), -g
        q, rr = r.copy(), float(r @ r)
        for _ in range(30):
            if rr < 1e-10:
                break
            h = back(curve * ahead(q)) + ridge * q
            a = rr / float(q @ h)
            d += a * q
            r -= a * h
            new = float(r @ r)
            q, rr = r + new / rr * q, new
        step = 1.0
        while step > 1e-4 and (after := loss(w + step * d)) > now:
            step /= 2
        if step <= 1e-4 or now - after < 1e-6 * now:
            break
        w, now = w + step * d, after
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on documents joined to labels by doc_id; held-out ids are never read."""
    spark = docs.sparkSession
    marked = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    total = marked.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    some = marked.filter(draw < F.lit(round(1_000_000 * min(1.0, sample / max(1, total)))))
    few = some.dropDuplicates()
    # At most about `sample` narrow rows, and a text for each: sizes set by the parameter, whatever the tables hold.
    read = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").filter("text is not null")
    read = staged(read.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, 1 << BITS), np.int64)
        docs_of = np.zeros(2, np.int64)
        for batch in blocks(batches, "text"):
            found, at = features(batch.column("text").to_pylist())
            y = batch.column("label").to_numpy()
            docs_of += np.bincount(y, minlength=2)
            pairs = np.unique(at.astype(np.int64) << 32 | found)
            np.add.at(have, (y[pairs >> 32], pairs & 0xFFFFFFFF), 1)
        any_ = np.flatnonzero(have.any(axis=0))
        key, n0, n1 = (np.append(x, y) for x, y in ((any_, -1), (have[0, any_], docs_of[0]), (have[1, any_], docs_of[1])))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n0), pa.array(n1)], names=["key", "n0", "n1"])

    sums = read.mapInArrow(released(count), "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sizes = read.groupBy().agg(F.count(F.when(F.col("label") == 0, 1)).alias("n0"), F.count(F.when(F.col("label") == 1, 1)).alias("n1")).first()
    c, t = sizes["n0"], sizes["n1"]
    prior = t / (c + t) if c + t else 0.5
    constant = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not c or not t:
        return constant
    share = (F.col("n0") + F.col("n1")) / (c + t)
    error = F.sqrt(share * (1 - share) * (1 / c + 1 / t) + 1e-9)
    clear = (F.col("n1") / t - F.col("n0") / c) / error
    best = sums.filter("key >= 0").withColumn("clear", F.abs(clear)).filter(F.col("clear") >= CLEAR).orderBy(F.desc("clear"), "key").limit(FEATURES).collect()
    if not best:
        return constant
    best.sort(key=lambda r: r["key"])
    keys = np.array([r["key"] for r in best])
    ratio = np.array([np.log((r["n1"] + 1) / (t + 2)) - np.log((r["n0"] + 1) / (c + 2)) for r in best])
    slot = Model(keys, ratio, 0.0).lookup()
    shared = spark.sparkContext.broadcast(slot)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            doc, key = kept(batch.column("text").to_pylist(), shared.value)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            held = [key[a:b].astype("<u2").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(held, pa.binary())], names=["label", "held"])

    got = read.mapInArrow(released(rows), "label int, held binary").collect()
    y = np.array([r["label"] for r in got], float)
    each = [np.frombuffer(r["held"], "<u2") for r in got]
    order = sorted(range(len(y)), key=lambda i: (y[i], bytes(each[i])))  # sums in one order give equal models
    y, each = y[order], [each[i] for i in order]
    doc = np.repeat(np.arange(len(y)), [len(x) for x in each])
    w, b = logistic(doc, np.concatenate(each).astype(np.int64), ratio, y)
    return Model(keys, w * ratio, float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs + score (0 to 1, higher: likelier toxic); a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value.lookup()
        for batch in blocks(batches, "text"):
            s = shared.value.score([t or "" for t in batch.column("text").to_pylist()], slot)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    return docs.select(*keep).mapInArrow(released(run), schema)


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    # Python is done with the text here; only the id and the score go on.
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
