"""Substring dedup over a log-structured index of window fingerprints.

A window is `size` consecutive words. Its fingerprint is the least hash of the shorter word runs in
it, so neighbouring windows mostly share one: a document becomes a short list of runs of windows
under one fingerprint. The index keeps (fingerprint, how many runs) in immutable runs of files,
bucketed and sorted by fingerprint. Each new batch becomes such a run and is merge-joined with the
historical ones, bucket by bucket and without shuffling history; a number of runs are compacted to
one, adding counts. Equal windows have equal fingerprints, so only fingerprints that the batch holds
twice or that history holds can head a repeated window: those alone are verified, window by window,
by a second 64-bit hash of all their words. What a batch's documents hold under each fingerprint is
kept beside the index as it was scanned, so a later batch reads no text of an earlier one but of
documents with hits.

Which words go depends on a text's words alone, so equal texts are decided once, by a digest.

Defined results: null and empty texts have no words and nothing removed; documents shorter than a
window keep all; repeated rows repeat their windows, so each loses all that a window covers; an
empty table gives no rows.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import Scratch, blocks, forget, grams, released, shared_dir, sliding_min, span_hash, staged, utf8, words

SIZE = 35
#: Spans that a task remembers having sent, and fingerprints that it adds up at once, at most (8 bytes each).
SENT, HELD = 1 << 20, 1 << 20
#: Word runs of SIZE - SPREAD + 1 words are hashed for fingerprints; a window holds SPREAD of them.
SPREAD = 16


class Runs:
    """The window runs of a block of texts: fingerprint, document, first window, number of windows."""

    def __init__(self, column, size: int = SIZE, spread: int = SPREAD):
        data, off = utf8(column)
        start, end, by = words(data, off)
        n = len(start)
        doc = np.repeat(np.arange(len(by) - 1), np.diff(by))
        hashes = span_hash(data, start, end) if n else np.zeros(0, np.uint64)
        full = grams(hashes, size)
        at = np.flatnonzero(doc[: len(full)] == doc[size - 1 : size - 1 + len(full)])
        key = sliding_min(grams(hashes, size - spread + 1), spread)[at] if len(at) else np.zeros(0, np.uint64)
        self.windows = full[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        new |= place % spread == 0
        self.begin = np.flatnonzero(new)
        self.count = np.diff(np.append(self.begin, len(at)))
        self.key = key[self.begin]
        self.doc = doc[at[self.begin]] if len(at) else np.zeros(0, np.int64)
        self.first = (at[self.begin] - by[self.doc]) if len(at) else np.zeros(0, np.int64)
        self.run_of = np.repeat(np.arange(len(self.begin)), self.count)
        # A run can repeat a window within itself: text whose period is short.
        self.twice = np.zeros(len(self.begin), bool)
        for d in range(1, spread):
            same = np.flatnonzero(self.windows[d:] == self.windows[:-d])
            same = same[self.run_of[same] == self.run_of[same + d]]
            self.twice[self.run_of[same]] = True


ENTRY = "fp long, span long, n byte, twice boolean, tkey binary, first int"


def entries(docs: DataFrame, size: int = SIZE, spread: int = SPREAD) -> DataFrame:
    """A row per run of windows: fp, span (hash of the run's windows), n (windows), twice, tkey, first."""

    def run(batches):
        for batch in blocks(batches, "text"):
            r = Runs(batch.column("text"), size, spread)
            digests = np.array([hashlib.md5((t or "").encode()).digest() for t in batch.column("text").to_pylist()], object)
            span = span_hash(r.windows, r.begin, r.begin + r.count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.key.view(np.int64)), pa.array(span.view(np.int64)), pa.array(r.count.astype(np.int8)), pa.array(r.twice), pa.array(digests[r.doc], pa.binary()), pa.array(r.first, pa.int32())],
                names=["fp", "span", "n", "twice", "tkey", "first"],
            )

    return docs.select("text").mapInArrow(released(run), ENTRY)


def counted(held: DataFrame) -> DataFrame:
    """(fp, n): how many runs of windows have each fingerprint, added up by task (a run that repeats a
    window within itself counts twice)."""

    def flush(keys, weights):
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(weights), minlength=len(key)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["fp", "n"])

    def run(batches):
        keys, weights, have = [], [], 0
        for batch in batches:
            keys.append(batch.column("fp").to_numpy())
            weights.append(1 + batch.column("twice").to_numpy(zero_copy_only=False).astype(np.int64))
            have += batch.num_rows
            if have >= HELD:
                yield flush(keys, weights)
                keys, weights, have = [], [], 0
        if have:
            yield flush(keys, weights)

    return held.select("fp", "twice").mapInArrow(released(run), "fp long, n long")


class FingerprintIndex:
    """Immutable runs of fingerprints, each a table bucketed and sorted by fp in files under one folder."""

    def __init__(self, spark, path: str | None = None, fanout: int = 4, buckets: int | None = None, size: int = SIZE, spread: int = SPREAD):
        self.spark, self.fanout, self.size, self.spread = spark, fanout, size, spread
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        atexit.register(forget, spark, self.path)
        self.runs: list[str] = []
        self.held: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        """rows (fp, n) as a run: one sorted file a bucket, one row a fingerprint."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "fp").groupBy("fp").agg(F.sum("n").alias("n"))
        dealt.write.bucketBy(self.buckets, "fp").sortBy("fp").option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            forget(self.spark, f"{self.path}/{name}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Append a batch of documents (column text) as a run. Returns (fp) of what it repeats, in
        itself or from history: the batch's run meets each historical one in a merge join of buckets."""
        held = staged(entries(batch, self.size, self.spread), "entries")
        new = self._write(counted(held))
        mine = self.spark.table(new)
        found = mine.filter("n > 1").select("fp")
        for old in self.runs:
            found = found.unionByName(mine.hint("merge").join(self.spark.table(old), "fp").select("fp"))
        repeated = staged(found.distinct(), "repeated")
        self.held.append(held)
        self.runs.append(new)
        if len(self.runs) >= self.fanout:
            self.compact()
        return repeated

    def compact(self) -> None:
        """Merge all runs into one; the old ones are dropped."""
        if len(self.runs) > 1:
            old = self.runs
            # Read as plain files: a union of bucketed tables is not taken for one that is dealt anew.
            rows = self.spark.read.schema("fp long, n long").parquet(*[f"{self.path}/{name}" for name in old])
            self.runs = [self._write(rows)]
            self.drop(old)

    def under(self, repeated: DataFrame) -> DataFrame:
        """The entries of all batches whose fingerprint is in `repeated` (and few others, by the bitmap's grain)."""
        shared = self.spark.sparkContext.broadcast(bitmap.build(repeated, "fp"))

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(bitmap.passes(batch.column("fp").to_numpy().view(np.uint64), shared.value)))

        out = None
        for held in self.held:
            some = held.mapInArrow(released(run), ENTRY)
            out = some if out is None else out.unionByName(some)
        return out


def windows_of(docs: DataFrame, keys: DataFrame, fps: DataFrame, lonely: DataFrame, size: int = SIZE, spread: int = SPREAD) -> DataFrame:
    """The windows of all runs under the fingerprints `fps`, which the texts `keys` hold: fp, window,
    weight, and span, i where the run's span is in `lonely` (else null)."""
    sc = docs.sparkSession.sparkContext
    under, alone = sc.broadcast(bitmap.build(fps, "fp")), sc.broadcast(bitmap.build(lonely, "span"))
    texts = sc.broadcast(bitmap.build(keys.select(short_key().alias("h")), "h"))

    def run(batches):
        sent = np.zeros(0, np.uint64)
        for batch in blocks(batches, "text"):
            r = Runs(batch.column("text").filter(pa.array(passing(batch, texts.value))), size, spread)
            keep = np.flatnonzero(bitmap.passes(r.key, under.value))
            begin, count = r.begin[keep], r.count[keep]
            span = span_hash(r.windows, begin, begin + count)
            ask = bitmap.passes(span, alone.value)
            # A span that is not lonely repeats its windows anyway: once a task is enough, at weight 2.
            # A task that has sent many forgets them and may send some again, to the same result.
            own, at = np.unique(span[~ask], return_index=True)
            once = np.zeros(len(span), bool)
            once[np.flatnonzero(~ask)[at[~np.isin(own, sent)]]] = True
            sent = own if len(sent) > SENT else np.union1d(sent, own)
            some = np.flatnonzero(ask | once)
            keep, begin, count, span, ask = keep[some], begin[some], count[some], span[some], ask[some]
            off = np.concatenate([[0], np.cumsum(count)])
            place = np.arange(off[-1]) - np.repeat(off[:-1], count)
            spans = pa.array(np.repeat(span, count).view(np.int64), mask=~np.repeat(ask, count))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(r.key[keep], count).view(np.int64)), pa.array(r.windows[np.repeat(begin, count) + place].view(np.int64)), spans, pa.array(place, pa.int8()), pa.array(np.repeat(np.where(ask, 1, 2), count), pa.int8())],
                names=["fp", "window", "span", "i", "weight"],
            )

    return docs.select("text").mapInArrow(released(run), "fp long, window long, span long, i byte, weight byte")


def verified(docs: DataFrame, found: DataFrame, size: int = SIZE, spread: int = SPREAD) -> DataFrame:
    """(tkey, hits): for each text the runs with repeated windows and a mask of which.

    A span (all windows of a run) that occurs twice repeats each of its windows. Only fingerprints
    that head a span seen once beside other spans, or repeating a window within itself, are compared
    window by window.
    """
    spans = staged(found.groupBy("fp", "span").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.max("twice").alias("twice")), "spans")
    lone = F.col("c") == 1
    per = spans.groupBy("fp").agg(F.count("*").alias("k"), F.max(lone).alias("lone"), F.max(lone & F.col("twice")).alias("twice"))
    unsure = staged(per.filter("twice OR (k > 1 AND lone)").select("fp"), "unsure")
    lonely = spans.filter(lone).join(unsure, "fp", "left_semi").select("span")
    keys = found.select("fp", "tkey").distinct().join(unsure, "fp", "left_semi").select("tkey").distinct()
    each = staged(windows_of(docs, keys, unsure, lonely, size, spread), "windows")
    twice = each.groupBy("fp", "window").agg(F.sum("weight").alias("c")).filter("c > 1").select("fp", "window")
    alone = each.filter("span is not null").join(twice, ["fp", "window"], "left_semi").groupBy("fp", "span").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    # Both may name a span: with c > 1 all of its windows are repeated either way.
    masks = spans.filter("c > 1").select("fp", "span", F.expr("shiftleft(1L, n) - 1").alias("mask")).unionByName(alone.join(spans.filter("c > 1").select("fp", "span"), ["fp", "span"], "left_anti"))
    hits = found.select("fp", "span", "tkey", "first").join(masks, ["fp", "span"])
    return hits.groupBy("tkey").agg(F.collect_set(F.struct("first", "mask")).alias("hits"))


def short_key() -> F.Column:
    """The first 8 bytes of tkey as a long."""
    return F.expr("cast(conv(substring(hex(tkey), 1, 16), 16, -10) as long)")


def passing(batch: pa.RecordBatch, keys: tuple[int, np.ndarray]) -> np.ndarray:
    """Which texts may be among those whose short keys the bitmap holds."""
    heads = [int.from_bytes(hashlib.md5((t or "").encode()).digest()[:8], "big") for t in batch.column("text").to_pylist()]
    return bitmap.passes(np.array(heads, np.uint64), keys)


def text_key() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def remove(docs: DataFrame, hits: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text's kept words joined by one space). hits: staged.

    Texts without hits are finished where they are read; only the others meet their hits in a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(hits.select(short_key().alias("h")), "h"))

    def cut(batch, wanted, lists):
        data, off = utf8(batch.column("text"))
        start, end, by = words(data, off)
        raw = data.tobytes()
        n, gone, kept = [], [], []
        for i in wanted:
            a, b = by[i], by[i + 1]
            edge = np.zeros(b - a + 1, np.int64)
            for h in lists[i] or () if lists else ():
                mask, at = h["mask"], h["first"]
                while mask:
                    if mask & 1:
                        edge[at] += 1
                        edge[at + size] -= 1
                    mask >>= 1
                    at += 1
            keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0) + a
            n.append(b - a)
            gone.append(b - a - len(keep))
            kept.append(b" ".join([raw[s:e] for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True)]))
        shas = [hashlib.sha256(k).hexdigest() for k in kept]
        ids = batch.column("doc_id").take(pa.array(wanted, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    def hit(batch):
        return passing(batch, shared.value)

    def untouched(batches):
        for batch in blocks(batches, "text"):
            yield cut(batch, np.flatnonzero(~hit(batch)), None)

    def touched(batches):
        for batch in blocks(batches, "text"):
            yield batch.filter(pa.array(hit(batch)))

    def run(batches):
        for batch in blocks(batches, "text"):
            yield cut(batch, np.arange(batch.num_rows), batch.column("hits").to_pylist())

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    own = docs.select(F.col("doc_id").cast("long"), "text")
    few = own.mapInArrow(released(touched), "doc_id long, text string").withColumn("tkey", text_key())
    cuts = few.join(hits, "tkey", "left").select("doc_id", "text", "hits").mapInArrow(released(run), schema)
    return own.mapInArrow(released(untouched), schema).unionByName(cuts)


def dedup(docs: DataFrame, batches: int = 2, size: int = SIZE, spread: int = SPREAD) -> DataFrame:
    """remove() for a table taken in `batches` steps into a fresh index.

    Every batch tells what it repeats; what earlier batches hold of that is looked up at the end.
    """
    index = FingerprintIndex(docs.sparkSession, size=size, spread=spread)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    repeated = index.add(docs.filter(turn == 0))
    for i in range(1, batches):
        repeated = repeated.unionByName(index.add(docs.filter(turn == i)))
    index.drop(index.runs)
    with Scratch(docs.sparkSession) as scratch:
        found = staged(index.under(repeated.distinct()), "window-runs")
        hits = scratch.keep(staged(verified(docs, found, size, spread), "hits"))
    return remove(docs, hits, size)


def op10_substring(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs).drop("kept")
