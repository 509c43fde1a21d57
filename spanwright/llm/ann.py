"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors, scaled by the largest norm and given one more coordinate so that a larger inner product is
a smaller distance, are projected at random onto a few dimensions, shifted, cut to a grid and put on
a Hilbert curve; several such curves see different neighbours. Each curve's keys are range-partitioned
and sorted, so every vector gets its rank on every curve. A query meets the vectors whose rank is
within a window of its own, by exact inner products in double precision, and the windows of all
curves merge into its nearest.

Projections and grid levels are fitted on a bounded sample. The window is measured: for CHECKED
queries one scan finds the true neighbours, and their ranks tell, for each number of curves, how wide
windows must be to hold `recall` of them. The cheapest such choice is taken; where it would compare
more than the whole table (vectors without structure), one curve with a window over all of it is
cheapest: each pair is then compared once.

Ranks are cut into blocks of queries; the vectors within a block's reach stream past it, dealt to a
few parts, so a task holds one block of queries and their best so far, whatever the vectors are. Each
part gives k rows a query at most, and parts are as many as the cores ask for: the rows made grow with
the queries, not with the pairs compared. Of equal vectors only the k+1 smallest ids can be among the
k nearest of anything; the others ask, but are not compared.

Defined results: vectors that are null, zero, hold a null or non-finite component or have no id take
no part; shorter vectors are read as ending in zeros; an id that several rows carry counts once, by
its best score; a query never finds its own id; ties go to the smaller id; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.nearest import ROWS, Best, runs
from .common import released, staged

#: Curves; projected dimensions and bits of each; vectors in the fitting sample, at most about.
CURVES, DIMENSIONS, BITS = 8, 6, 8
SAMPLE = 4096
#: Queries whose true neighbours set the window, and the share of these that it must hold.
CHECKED, RECALL = 64, 0.95
#: Ranks in a block of vectors, and in a block of queries at least and at most; queries in one, on average.
GROUP, LEAST, MOST, QUERIES = 512, 1 << 16, 1 << 19, 1 << 15


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of grid points (n, d): Gray-code rotation level by level, bits interleaved."""
    x = x.astype(np.int64).copy()
    n, d = x.shape
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(d):
            flip = (x[:, i] & q) > 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, d - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> level & 1)
    return key


@dataclass
class Curves:
    """size: components; norm: the largest; per curve a projection, knots of each axis and a shift."""

    size: int
    norm: float
    planes: list[np.ndarray]
    knots: list[np.ndarray]
    shifts: list[np.ndarray]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        y = x / self.norm
        return np.column_stack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))])

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, curves) places on the curves."""
        lifted, out = self.lifted(x), []
        for plane, knots, shift in zip(self.planes, self.knots, self.shifts, strict=True):
            y = lifted @ plane
            u = np.column_stack([np.interp(y[:, i], knots[:, i], np.linspace(0, 1, len(knots))) for i in range(y.shape[1])])
            grid = ((u + shift) / 1.25 * (1 << BITS)).astype(np.int64)
            out.append(hilbert(np.clip(grid, 0, (1 << BITS) - 1), BITS))
        return np.column_stack(out)


def fit(sample: np.ndarray, norm: float, curves: int = CURVES, seed: int = 7) -> Curves:
    """Curves from a sample of the vectors (a row at least)."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    dims = min(DIMENSIONS, size + 1)
    planes = [np.linalg.qr(rng.normal(size=(size + 1, size + 1)))[0][:, :dims] for _ in range(curves)]
    shifts = [rng.random(dims) * 0.25 for _ in range(curves)]
    fitted = Curves(size, norm, planes, [], shifts)
    lifted = fitted.lifted(sample)
    fitted.knots = [np.maximum.accumulate(np.quantile(lifted @ p, np.linspace(0, 1, 65), axis=0) + np.arange(65)[:, None] * 1e-12) for p in planes]
    return fitted


def windows(apart: np.ndarray, total: int, recall: float = RECALL) -> tuple[int, int]:
    """(curves, window): the cheapest choice that holds `recall` of the neighbours.

    apart: (neighbours, curves) how many ranks each lies from its query. No choice costs more than
    one curve whose window is the whole table.
    """
    best = (total, 1, total)
    for c in range(1, apart.shape[1] + 1 if len(apart) else 1):
        nearest_ = np.sort(apart[:, :c].min(axis=1))
        width = int(nearest_[int(np.ceil(recall * len(nearest_))) - 1])
        best = min(best, (c * min(total, 2 * width + 1), c, width))
    return best[1], best[2]


def matrix(vecs: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(-1, size)


class Asked:
    """A block of queries (vec_id, at, vec), sorted by rank, and the k best of what was within `width` ranks of each."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, width: int, size: int):
        rows = pa.Table.from_batches(batches)
        self.ids, self.at, self.x = rows["vec_id"].to_numpy(), rows["at"].to_numpy(), matrix(rows["vec"].to_pylist(), size)
        self.k, self.width, self.size = k, width, size
        self.norms = np.sqrt((self.x * self.x).sum(axis=1))
        self.best = Best(len(self.ids), k, once=True)

    def meet(self, batch: pa.RecordBatch) -> None:
        ids, at, x = batch.column("vec_id").to_numpy(), batch.column("at").to_numpy(), matrix(batch.column("vec").to_pylist(), self.size)
        cuts = np.flatnonzero(np.diff(at // GROUP)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            low, high = np.searchsorted(self.at, at[a] - self.width), np.searchsorted(self.at, at[b - 1] + self.width, side="right")
            # Equal ids count once, so as many more are looked at as ids repeat here.
            take = min(self.k + (b - a) - len(np.unique(ids[a:b])), b - a)
            longest = np.sqrt((x[a:b] * x[a:b]).sum(axis=1).max())
            for begin in range(low, high, ROWS):
                self._meet(slice(begin, min(begin + ROWS, high)), ids[a:b], at[a:b], x[a:b], take, longest)

    def _meet(self, rows: slice, ids, at, x, take: int, longest: float) -> None:
        s = self.x[rows] @ x.T
        mine = self.at[rows]
        if max(at[-1] - mine[0], mine[-1] - at[0]) > self.width:
            s[np.abs(mine[:, None] - at[None, :]) > self.width] = -np.inf
        s[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        least = self.best.least(rows).copy()
        fresh = np.flatnonzero(least == -np.inf)
        if len(fresh):
            least[fresh] = np.partition(s[fresh], s.shape[1] - take, axis=1)[:, s.shape[1] - take]
        # Products of matrices differ in the last digits from the sums that are returned.
        i, j = np.nonzero((s >= (least - 1e-12 * longest * self.norms[rows])[:, None]) & (s > -np.inf))
        self.best.add(rows.start + i, ids[j], (x[j] * self.x[rows][i]).sum(axis=1))


def keyed(vectors: DataFrame, is_query, k: int, curves: int) -> tuple[DataFrame, int] | None:
    """((uid, vec_id, ask, held, vec, keys), components) of the rows that take part; held: may be a neighbour."""
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask")).filter("vec_id is not null and v is not null")
    fine = fine.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    whole = fine.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.max(F.expr("aggregate(v, 0d, (a, x) -> a + x * x)")).alias("norm")).first()
    total, size = whole["n"], whole["size"]
    if total < 2:
        return None
    share = min(1.0, SAMPLE / total)
    draw = fine.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < max(1, round(share * 1_000_000))).select("vec_id", "v").orderBy("vec_id").limit(2 * SAMPLE).collect()
    rows = [r["v"] for r in draw] or [r["v"] for r in fine.select("v").limit(64).collect()]
    sample = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        sample[i, : len(r)] = r
    model = vectors.sparkSession.sparkContext.broadcast(fit(sample, float(np.sqrt(whole["norm"])), curves))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("v")
                sizes = np.asarray(lists.value_lengths())
                x = np.zeros((batch.num_rows, size))
                x[np.arange(size)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                keys = pa.array(list(model.value.keys(x)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("ask"), pa.array([r.tobytes() for r in x], pa.binary()), keys], names=["vec_id", "ask", "vec", "keys"])

    placed = fine.mapInArrow(released(place), "vec_id long, ask boolean, vec binary, keys array<long>")
    placed = staged(placed.select(F.monotonically_increasing_id().alias("uid"), "*", F.md5("vec").alias("h")), "placed")
    # The (k+1)th smallest id of each vector that more ids than that carry. The ranking is limited before its shuffle.
    turn = F.row_number().over(W.partitionBy("h").orderBy("vec_id"))
    last = staged(placed.select("h", "vec_id").distinct().withColumn("turn", turn).filter(F.col("turn") <= k + 1).filter(F.col("turn") == k + 1).select("h", F.col("vec_id").alias("last")), "last")
    held = F.col("last").isNull() | (F.col("vec_id") <= F.col("last"))
    return placed.join(last, "h", "left").select("uid", "vec_id", "ask", held.alias("held"), "vec", "keys").filter("held OR ask"), size


def ranked(rows: DataFrame, curves: int) -> DataFrame:
    """(uid, curve, at): each row's rank on each curve, from 0, by range partitions and their sizes."""
    each = rows.select("uid", "vec_id", F.posexplode("keys").alias("curve", "key"))
    parts = max(curves, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = each.repartitionByRange(parts, "curve", "key", "vec_id", "uid").sortWithinPartitions("curve", "key", "vec_id", "uid")
    place = F.monotonically_increasing_id()
    kept = staged(sorted_.select("uid", "curve", F.shiftrightunsigned(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "order")
    counts = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per partition
    total = sum(n for _, n in counts)
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])])
    offsets = rows.sparkSession.createDataFrame([(int(p), int(b)) for (p, _), b in zip(counts, before, strict=False)] or [(0, 0)], "part long, before long")
    at = F.col("i") + F.col("before") - F.col("curve") * (total // curves)
    return kept.join(F.broadcast(offsets), "part").select("uid", "curve", at.alias("at"))  # a row per partition


def true_neighbours(rows: DataFrame, k: int, size: int, checked: int) -> list[tuple[int, int]]:
    """(query's uid, neighbour's uid) of the exact k nearest of `checked` queries: one scan, k rows a query from each task."""
    some = rows.filter("ask").orderBy(F.xxhash64("uid")).limit(checked).select("uid", "vec_id", "vec").collect()
    if not some:
        return []
    shared = rows.sparkSession.sparkContext.broadcast([(r["uid"], r["vec_id"], bytes(r["vec"])) for r in some])

    def scan(batches):
        q = matrix([v for _, _, v in shared.value], size)
        best = None
        for batch in batches:
            x = matrix(batch.column("vec").to_pylist(), size)
            ids = batch.column("vec_id").to_numpy()
            s = q @ x.T
            s[ids[None, :] == np.array([i for _, i, _ in shared.value])[:, None]] = -np.inf
            uid = np.broadcast_to(batch.column("uid").to_numpy(), s.shape)
            if best is not None:
                s, uid = np.hstack([best[0], s]), np.hstack([best[1], uid])
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(s, top, 1), np.take_along_axis(uid, top, 1)
        if best is not None:
            own = np.repeat([u for u, _, _ in shared.value], best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(best[1].ravel(), pa.int64()), pa.array(best[0].ravel(), pa.float64())], names=["query", "uid", "score"])

    found = rows.filter("held").select("uid", "vec_id", "vec").mapInArrow(released(scan), "query long, uid long, score double").filter("score > double('-infinity')")
    turn = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "uid"))
    return [(r["query"], r["uid"]) for r in found.withColumn("turn", turn).filter(F.col("turn") <= k).collect()]


def chosen(rows: DataFrame, order: DataFrame, total: int, k: int, size: int, curves: int, recall: float) -> tuple[int, int]:
    """The number of curves and the window that the checked queries ask for."""
    pairs = true_neighbours(rows, k, size, CHECKED)
    names = sorted({u for p in pairs for u in p})
    wanted = rows.sparkSession.createDataFrame([(u,) for u in names], "uid long")  # at most CHECKED * (k + 1) rows
    at = {(r["uid"], r["curve"]): r["at"] for r in order.join(F.broadcast(wanted), "uid").collect()}
    apart = np.array([[abs(at[q, c] - at[u, c]) for c in range(curves)] for q, u in pairs], np.int64).reshape(-1, curves)
    return windows(apart, total, recall)


def met(placed: DataFrame, total: int, asking: int, curves: int, width: int, k: int, size: int) -> DataFrame:
    """(query_id, vec_id, score): the k best within `width` ranks of each query, from each curve and part."""
    spark = placed.sparkSession
    cores = spark.sparkContext.defaultParallelism
    reach = min(MOST, max(LEAST, QUERIES * total // max(1, asking)))
    blocks = -(-total // reach)
    parts = -(-2 * cores // (curves * blocks))
    first, last = (lambda n: F.floor(F.greatest(F.lit(0), F.col("at") - width) / n)), (lambda n: F.floor(F.least(F.lit(total - 1), F.col("at") + width) / n))
    # A query goes to the parts that hold a block of its window; a vector to the blocks of queries whose windows hold it.
    of = F.sequence(first(GROUP), F.least(last(GROUP), first(GROUP) + (parts - 1)))
    asked = placed.filter("ask").withColumn("queries", F.floor(F.col("at") / reach)).withColumn("part", F.explode(F.transform(of, lambda b: b % parts))).withColumn("turn", F.lit(0))
    held = placed.filter("held").withColumn("queries", F.explode(F.sequence(first(reach), last(reach)))).withColumn("part", F.floor(F.col("at") / GROUP) % parts).withColumn("turn", F.lit(1))
    group = (F.col("curve") * blocks + F.col("queries")) * parts + F.col("part")
    dealt = asked.unionByName(held).select(group.cast("long").alias("group"), "turn", "at", "vec_id", "vec")
    n = min(curves * blocks * parts, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartitionById(n, (F.col("group") % n).cast("int")).sortWithinPartitions("group", "turn", "at")

    def best(asked: Asked | None):
        for query, found, s in asked.best.rows(asked.ids) if asked else ():
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    def meet(batches):
        waiting, asked, group = [], None, None
        for _, batch in runs(batches, "group", "turn"):
            if group != (group := batch.column("group")[0].as_py()):  # a new group; it may hold no queries, or nothing else
                yield from best(asked)
                waiting, asked = [], None
            if batch.column("turn")[0].as_py() == 0:
                waiting.append(batch)
                continue
            if waiting:
                waiting, asked = [], Asked(waiting, k, width, size)
            if asked:
                asked.meet(batch)
        yield from best(asked)

    return dealt.mapInArrow(released(meet), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query, k: int = 20, curves: int = CURVES, recall: float = RECALL, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of (vec_id, embedding) that is_query marks.

    told, where given, receives the curves, the window and the share of the table that a query meets.
    """
    spark = vectors.sparkSession
    made = keyed(vectors, is_query, k, curves)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, size = staged(made[0], "keyed"), made[1]
    total, asking = rows.agg(F.count("*"), F.count_if("ask")).first()
    order = ranked(rows, curves)
    used, width = chosen(rows, order, total, k, size, curves, recall)
    if told is not None:
        told.update(curves=used, window=width, share=used * min(total, 2 * width + 1) / total)
    found = met(order.filter(F.col("curve") < used).join(rows.select("uid", "vec_id", "ask", "held", "vec"), "uid"), total, asking, used, width, k, size)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(vectors: DataFrame) -> DataFrame:
    """Contract rows: every row whose id is divisible by 20 against all others."""
    return search(vectors, F.col("vec_id") % 20 == 0)
