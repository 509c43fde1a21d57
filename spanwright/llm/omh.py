"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's words (lower-cased, split at white space and ASCII punctuation) give shingles of `k` words,
each labelled by its occurrence number. Every one of `sketches` hash functions picks the `order`
least labelled shingles and keeps them in the order of the text; two texts share such an entry the
likelier, the more shingles they share in one order. Texts that share an entry form a bucket.

Buckets are met in steps that never list all pairs of a group (see linked): heads first, then, where
several classes are left in a bucket, only texts that share one of their rarest labels, which every
pair that reaches `least` does. What is skipped is either in one class already or cannot reach
`least`, so the classes are those that all pairs of all buckets would give. Each pair that meets is
verified: multiset Jaccard of shingles bounds it from above, then matching labelled shingles within
a band are aligned (longest common order), and aligned / (all of both - aligned) must reach `least`.
Links become classes by alternating large-star and small-star steps.

Equal texts are one node throughout (keyed by a digest), so copies cost a row each.

Defined results: null text is the empty text; texts with equal bytes are always one class, and
texts without a word are linked to nothing else; 1 to k-1 words make one shingle; rows without id
are classed, and an id that several rows carry is classed by each row's text; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import SPACE, Scratch, blocks, mix, released, span_hash, staged, utf8

K, LEAST = 5, 0.8
#: At similarity 0.8 an entry of three is shared with probability about 0.51; all 16 miss in 1 of 100,000.
SKETCHES, ORDER = 16, 3
#: Cells of the label counts, at most 2**MOST_CELLS (two a byte: 32 MB), and the most that a cell counts.
MOST_CELLS, MOST_COUNT = 26, 15

#: White space and ASCII punctuation end a word (fixed values).
_BREAK = SPACE.copy()
_BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts, and n+1 offsets by text."""
    low = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
    data, off = utf8(low)
    solid = ~_BREAK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    by = np.searchsorted(start, off)
    return (span_hash(data, start, end) if len(start) else np.zeros(0, np.uint64)), by


def labelled(words: np.ndarray, k: int = K) -> np.ndarray:
    """The text's shingles as hashes that also count their occurrence, in order."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    h = words[: n - width + 1].copy()
    for i in range(1, width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i])
    by = np.argsort(h, kind="stable")
    s = h[by]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    seen = np.empty(len(s), np.uint64)
    seen[by] = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    return mix(h + seen * np.uint64(0xC2B2AE3D27D4EB4F))


_SALT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(labels: np.ndarray, sketches: int = SKETCHES, order: int = ORDER) -> np.ndarray:
    """One 64-bit entry per hash function: its `order` least labels in text order, hashed together."""
    n = len(labels)
    take = min(order, n)
    if n <= 50_000:
        values = (labels[None, :] ^ _SALT[:sketches, None]) * np.uint64(0xFF51AFD7ED558CCD)
        values ^= values >> np.uint64(32)
        at = np.argpartition(values, take - 1, axis=1)[:, :take] if n > take else np.tile(np.arange(n), (sketches, 1))
    else:
        at = np.empty((sketches, take), np.int64)
        for j in range(sketches):
            v = (labels ^ _SALT[j]) * np.uint64(0xFF51AFD7ED558CCD)
            at[j] = np.argpartition(v ^ (v >> np.uint64(32)), take - 1)[:take]
    at.sort(axis=1)
    out = np.full(sketches, take, np.uint64)
    for i in range(take):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + labels[at[:, i]])
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Similarity of two label sequences: shared in one order, over all; 0 where it cannot reach `least`."""
    if not len(a) or not len(b):
        return 0.0
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    whole = len(a) + len(b)
    if len(common) < least * (whole - len(common)):
        return 0.0
    # A pair that reaches `least` leaves at most so many labels of either unmatched, so matches keep to this band.
    band = whole - 2 * int(np.ceil(least * whole / (1 + least)))
    near = np.abs(at_a - at_b) <= max(band, 0)
    at_a, at_b = at_a[near], at_b[near]
    ends: list[int] = []
    for j in at_b[np.argsort(at_a)].tolist():
        i = bisect_left(ends, j)
        if i == len(ends):
            ends.append(j)
        else:
            ends[i] = j
    return len(ends) / (whole - len(ends))


def digest(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode()).digest()


def text_key(df: DataFrame) -> F.Column:
    return F.unhex(F.md5(F.coalesce(df["text"], F.lit("")).cast("binary")))


def sketched(docs: DataFrame, k: int = K, sketches: int = SKETCHES, order: int = ORDER) -> DataFrame:
    """doc_id, tkey, entries (empty without words), n (labels) of every row."""

    def run(batches):
        for batch in blocks(batches, "text"):
            words, by = word_hashes(batch.column("text"))
            entries = [sketch(labelled(words[a:b], k), sketches, order).view(np.int64) if b > a else [] for a, b in zip(by, by[1:], strict=False)]
            keys = [digest(t) for t in batch.column("text").to_pylist()]
            size = np.diff(by)
            n = np.maximum(size - k + 1, np.minimum(size, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(entries, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["doc_id", "tkey", "entries", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, tkey binary, entries array<long>, n long")


def members(texts: DataFrame) -> DataFrame:
    """(bucket, tkey, n): the texts of every bucket that several texts share. texts: tkey, entries, n."""
    each = texts.select("tkey", "n", F.posexplode("entries").alias("i", "entry")).select(F.xxhash64("i", "entry").alias("bucket"), "tkey", "n")
    # Staged, so that a join with a bucket of any size can be split.
    shared = staged(each.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket"), "buckets", True)
    return staged(each.join(shared, "bucket"), "members")


def wanted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(tkey, text) of the texts that `keys` names, once each (and of few others, by the bitmap's grain)."""
    short = keys.select(F.expr("cast(conv(substring(hex(tkey), 1, 16), 16, -10) as long)").alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(short, "h"))

    def run(batches):
        for batch in blocks(batches, "text"):
            digests = [digest(t) for t in batch.column("text").to_pylist()]
            keep = np.flatnonzero(bitmap.passes(np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64), shared.value))
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in keep], pa.binary()), batch.column("text").take(pa.array(keep))], names=["tkey", "text"])

    return docs.select("text").mapInArrow(released(run), "tkey binary, text string").dropDuplicates(["tkey"])


def texts_labels(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    words, by = word_hashes(batch.column("text"))
    return [labelled(words[a:b], k) for a, b in zip(by, by[1:], strict=False)]


def cells(labels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cells of each label in a table of 2**bits counts."""
    move = np.uint64(64 - bits)
    return ((labels * np.uint64(0x9E3779B97F4A7C15)) >> move).astype(np.int64), ((labels * np.uint64(0xC2B2AE3D27D4EB4F)) >> move).astype(np.int64)


def often(labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many texts hold each label, at most so many: the lesser of its two cells (MOST_COUNT: or more)."""
    a, b = cells(labels, len(counts).bit_length())
    read = lambda at: (counts[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & MOST_COUNT
    return np.minimum(read(a), read(b))


def added(have: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    """Add n to the cells `at` (each once), two to a byte, up to MOST_COUNT."""
    for odd in (0, 1):
        mine = (at & 1) == odd
        byte, shift = at[mine] >> 1, np.uint8(4 * odd)
        now = np.minimum(((have[byte] >> shift) & MOST_COUNT).astype(np.int64) + n[mine], MOST_COUNT).astype(np.uint8)
        have[byte] = (have[byte] & ~np.uint8(MOST_COUNT << shift)) | (now << shift)


def frequencies(texts: DataFrame, total: int, k: int = K) -> np.ndarray:
    """Counts of the labels of `texts` (tkey, text) in a table whose size follows `total` up to 2**MOST_CELLS cells.

    Two cells a byte: what reaches the driver and the workers is bounded. A fuller table tells fewer
    labels apart, which makes more candidates and never fewer links.
    """
    bits = min(MOST_CELLS, max(17, (4 * total).bit_length()))
    part = 1 << 16

    def count(batches):
        have = np.zeros(1 << (bits - 1), np.uint8)
        for batch in blocks(batches, "text"):
            for at in cells(np.concatenate([np.zeros(0, np.uint64), *texts_labels(batch, k)]), bits):
                added(have, *np.unique(at, return_counts=True))
        whole = have.reshape(-1, part)
        some = np.flatnonzero(whole.any(axis=1))
        for few in np.array_split(some, max(1, len(some) // 64)):
            yield pa.RecordBatch.from_arrays([pa.array(few, pa.int64()), pa.array([zlib.compress(whole[i].tobytes(), 1) for i in few], pa.binary())], names=["part", "cells"])

    def merge(rows: pa.Table) -> pa.Table:
        low, high = np.zeros(part, np.int64), np.zeros(part, np.int64)
        for x in rows.column("cells"):
            one = np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
            low += one & MOST_COUNT
            high += one >> 4
        both = np.minimum(low, MOST_COUNT) | np.minimum(high, MOST_COUNT) << 4
        return pa.table([rows.column("part").combine_chunks().slice(0, 1), pa.array([both.astype(np.uint8).tobytes()], pa.binary())], names=["part", "cells"])

    out = np.zeros(1 << (bits - 1), np.uint8).reshape(-1, part)
    for row in texts.select("text").mapInArrow(released(count), "part long, cells binary").groupBy("part").applyInArrow(merge, "part long, cells binary").toLocalIterator():
        out[row["part"]] = np.frombuffer(row["cells"], np.uint8)
    return out.reshape(-1)


def profiles(texts: DataFrame, counts: np.ndarray, k: int = K, least: float = LEAST) -> DataFrame:
    """(tkey, n, score, prefix): score tells how common a text's labels are; prefix has its rarest labels.

    All texts rank their labels alike: by count, then by value. Two texts of n and m labels that reach
    `least` share least/(1+least)*(n+m) of them, so the rarest one that they share is not later than
    what is left (see pairs_of). prefix holds (label, place) up to the last place that any partner's
    size allows; labels that no other text holds are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in blocks(batches, "text"):
            keys, n, score, prefix = [], [], [], []
            for key, labels in zip(batch.column("tkey"), texts_labels(batch, k), strict=True):
                if len(labels):
                    f = often(labels, shared.value)
                    far = len(labels) - int(np.ceil(least * len(labels) - 1e-9)) + 1
                    first = np.lexsort((labels, f))[:far]
                    at = np.flatnonzero(f[first] > 1)
                    keys.append(key)
                    n.append(len(labels))
                    score.append(float(np.log(f).mean()))
                    prefix.append([{"label": x, "place": p} for x, p in zip(labels[first[at]].view(np.int64).tolist(), at.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(prefix, pa.list_(pa.struct([("label", pa.int64()), ("place", pa.int32())])))], names=["tkey", "n", "score", "prefix"])

    return texts.mapInArrow(released(run), "tkey binary, n long, score double, prefix array<struct<label:long,place:int>>")


def stars(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): each text of a bucket and the bucket's most typical one. rows: bucket, tkey, n, score, staged."""
    heads = staged(rows.groupBy("bucket").agg(F.max(F.struct("score", "tkey", "n")).alias("h")).select("bucket", F.col("h.tkey").alias("b"), F.col("h.n").alias("m")), "heads", True)
    met = rows.join(heads, "bucket").filter((F.col("tkey") != F.col("b")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9))
    return met.select(F.least("tkey", "b").alias("a"), F.greatest("tkey", "b").alias("b")).distinct()


def size_class(n: F.Column) -> F.Column:
    """Sizes in steps of about 2 %."""
    return F.floor(F.log2(n) * 32).cast("int")


def splits(each: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(longer, shorter): what texts offer (tkey, n, score, class, label, place), by label and size class.

    A pair meets with its longer text in the first part and its shorter one in the second. The
    longer one names the classes of the sizes that its place of the label allows, so texts that
    share common labels only do not meet at all.
    """
    low = F.ceil(F.col("n") * least - 1e-9)
    high = F.least("n", F.floor((F.col("n") - F.col("place")) * ((1 + least) / least) - F.col("n") + 1e-9))
    longer = each.withColumn("low", low).withColumn("high", high).filter("low <= high AND high > 0")
    longer = longer.withColumn("size", F.explode(F.sequence(size_class(F.greatest(F.lit(1), "low")), size_class(F.col("high"))))).drop("low", "high")
    shorter = each.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * least / (1 + least)) - 1e-9)).withColumn("size", size_class(F.col("n")))
    return longer, shorter


def pairs_of(x: DataFrame, y: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b) of texts of different classes that can reach `least` and share a rare label early enough in both."""
    one = x.select("label", "size", *[F.col(c).alias(f"x_{c}") for c in ("tkey", "n", "place", "class")])
    two = y.select("label", "size", *[F.col(c).alias(f"y_{c}") for c in ("tkey", "n", "place", "class")])
    both = F.ceil((F.col("x_n") + F.col("y_n")) * (least / (1 + least)) - 1e-9)
    fit = (F.col("x_place") <= F.col("x_n") - both) & (F.col("y_place") <= F.col("y_n") - both)
    order = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_tkey") > F.col("y_tkey")))
    met = one.join(two, ["label", "size"]).filter((F.col("x_class") != F.col("y_class")) & fit & order)
    return met.select(F.least("x_tkey", "y_tkey").alias("a"), F.greatest("x_tkey", "y_tkey").alias("b"))


def mixed(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(label, size, main): where texts of several classes meet, and the class that most of them have."""
    each = longer.select("label", "size", "class", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(shorter.select("label", "size", "class", F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = each.groupBy("label", "size", "class").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    found = per.groupBy("label", "size").agg(F.count("*").alias("k"), F.max_by("class", F.col("x") + F.col("y")).alias("main"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    return found.filter("k > 1 AND x > 0 AND y > 0").select("label", "size", "main")


def verify(pairs: DataFrame, texts: DataFrame, k: int = K, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose alignment reaches `least`, + similarity. texts: (tkey, text), staged."""

    def run(batches):
        key, mine = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in blocks([whole], "x"):
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                left = texts_labels(batch.select(["x"]).rename_columns(["text"]), k)
                s = np.zeros(len(a))
                for i, other in enumerate(left):
                    if b[i] != key:
                        key, mine = b[i], texts_labels(batch.slice(i, 1).select(["y"]).rename_columns(["text"]), k)[0]
                    s[i] = aligned(other, mine, least)
                out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
                yield out.filter(pa.array(s >= least))

    one = texts.select(F.col("tkey").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("tkey").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(released(run), "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(tkey, root) of all linked nodes but the roots: root is the least key of the component.

    Large-star hangs a node's larger neighbours on its least neighbour, small-star its smaller ones;
    alternated until every node hangs on a root, which takes about log2(diameter) turns. Least
    neighbours are added up before their shuffle and staged, so a join with a node of any number of
    neighbours can be split.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", True)
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        each = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if each.filter("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty():
            return edges.select(F.col("u").alias("tkey"), F.col("v").alias("root"))
        with Scratch(links.sparkSession) as scratch:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", True)
            large = staged(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", True)
            low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low", True)
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v")))
            edges = scratch.keep(staged(small.distinct(), "small", True))


def linked(docs: DataFrame, texts: DataFrame, k: int = K, least: float = LEAST) -> DataFrame:
    """(tkey, root): classes (but for their roots) by verified links, which join all texts that reach
    `least` and share a bucket.

    First every text of a bucket meets the most typical one, which joins most groups of near copies.
    Buckets that still hold several classes are split again by the rarest labels of their texts: no
    pair that reaches `least` is without one in common. There each text meets a head, and at last
    every text that is not of the commonest class meets all those of other classes, so each pair of
    classes that is left was compared wherever it could be linked.
    """
    rows = members(texts.filter(F.size("entries") > 0))
    keys = staged(rows.select("tkey", "n").distinct(), "involved", True)
    total = keys.agg(F.sum("n")).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], "tkey binary, root binary")
    own = staged(wanted(docs, keys), "wanted")
    known = staged(profiles(own, frequencies(own, total, k), k, least), "profiles")
    pairs = staged(stars(staged(rows.join(known.select("tkey", "score"), "tkey"), "scored", True), least), "pairs", True)
    roots = components(verify(pairs, own, k, least))

    def classed(rows: DataFrame) -> DataFrame:
        """+ class, as a number: a hash of the root's key."""
        return rows.join(roots, "tkey", "left").withColumn("class", F.xxhash64(F.coalesce("root", "tkey"))).drop("root")

    several = F.min("class") != F.max("class")
    spread = staged(classed(rows.select("bucket", "tkey")), "spread", True)
    open_ = staged(spread.groupBy("bucket").agg(several.alias("open")).filter("open").select("bucket"), "open", True)
    left = spread.join(open_, "bucket", "left_semi").select("tkey", "class").distinct()
    each = staged(known.join(left, "tkey").select("tkey", "n", "score", "class", F.explode("prefix").alias("p")).select("tkey", "n", "score", "class", "p.*"), "labels", True)
    where = staged(each.groupBy("label").agg(several.alias("open")).filter("open").select("label"), "met", True)
    each = staged(each.join(where, "label"), "labels", True)
    for whole in (False, True):
        longer, shorter = splits(each, least)
        if whole:
            main = staged(mixed(longer, shorter), "mixed", True)
            x, y = longer.join(main, ["label", "size"]), shorter.join(main, ["label", "size"])
            odd = F.col("class") != F.col("main")
            found = pairs_of(x.filter(odd), y, least).unionByName(pairs_of(x.filter(~odd), y.filter(odd), least))
        else:
            found = pairs_of(longer, heads_of(shorter), least).unionByName(pairs_of(heads_of(longer), shorter, least))
        fresh = staged(found.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs", True)
        if not fresh.isEmpty():
            links = staged(verify(fresh, own, k, least).select("a", "b"), "links", True)
            if not links.isEmpty():
                roots = components(links.unionByName(roots.select(F.col("tkey").alias("a"), F.col("root").alias("b"))))
                each = staged(classed(each.drop("class")), "labels", True)
            pairs = pairs.unionByName(fresh)
    return roots


def heads_of(side: DataFrame) -> DataFrame:
    """The most typical text of each label and size class."""
    rest = [c for c in side.columns if c not in ("label", "size", "score")]
    return side.groupBy("label", "size").agg(F.max(F.struct("score", *rest)).alias("h")).select("label", "size", "h.*")


def classes(docs: DataFrame, k: int = K, least: float = LEAST, sketches: int = SKETCHES, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows has doc_id, tkey of every row; texts has tkey, class_id (least doc_id of the
    class), keeper (the text key of that document)."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(staged(sketched(docs, k, sketches, order), "sketches"))
        texts = staged(rows.groupBy("tkey").agg(F.min("doc_id").alias("id"), F.first("entries").alias("entries"), F.first("n").alias("n")), "texts")
        roots = linked(docs, texts, k, least)
        joined = staged(texts.select("tkey", "id").join(roots, "tkey", "left").withColumn("root", F.coalesce("root", "tkey")), "roots", True)
        first = joined.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("tkey"))).alias("f")).select("root", F.col("f.id").alias("class_id"), F.col("f.tkey").alias("keeper"))
        out = scratch.keep(staged(joined.join(staged(first, "first", True), "root").select("tkey", "class_id", "keeper"), "classes", True))
    return rows.select("doc_id", "tkey"), out


def op8_near(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), kept (the class's one document)."""
    rows, texts = classes(docs)
    return rows.join(texts, "tkey").select("doc_id", "class_id", ((F.col("tkey") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class; columns unchanged."""
    _, texts = classes(docs)
    keep = texts.filter(F.col("tkey") == F.col("keeper")).select("tkey", "class_id")
    # The id is part of the key, so the copies of one text spread out; only repeated rows meet.
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key(docs).alias("tkey"), id_.alias("id"))
    one = keyed.join(keep.select("tkey", F.coalesce(F.col("class_id").cast("string"), F.lit("-")).alias("id")), ["tkey", "id"]).dropDuplicates(["tkey", "id"])
    return one.select("row.*")
