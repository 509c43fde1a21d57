"""The k best of many, kept while blocks of candidates stream past a block of queries.

A block of queries and its candidates arrive as one run of sorted rows, queries first, so a task holds
the queries, their best so far and one batch of candidates, whatever a group's size is, and gives k
rows a query at the end: what leaves a group grows with its queries, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries multiplied at once, and candidates.
ROWS, COLUMNS = 512, 2048
#: Queries of one label in a block, at least and at most.
LEAST, MOST = 1024, 16_384
#: What sorts as SQL sorts them: NaN before every cosine, null after.
NAN, NULL = 2.0, -2.0


class Best:
    """The k best (score, then smaller id) of each query; `once`: an id counts once, by its best score."""

    def __init__(self, queries: int, k: int, once: bool):
        self.k, self.once = k, once
        self.scores, self.ids = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of queries `at`."""
        if not len(at):
            return
        own = np.unique(at)
        old = self.scores[own] > -np.inf
        at = np.concatenate([np.repeat(own, old.sum(axis=1)), at])
        ids, scores = np.concatenate([self.ids[own][old], ids]), np.concatenate([self.scores[own][old], scores])
        if self.once:
            order = np.lexsort((-scores, ids, at))
            at, ids, scores = at[order], ids[order], scores[order]
            first = np.r_[True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])]
            at, ids, scores = at[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        turn = np.arange(len(at)) - np.searchsorted(at, at)
        fit = turn < self.k
        self.scores[own] = -np.inf
        self.scores[at[fit], turn[fit]], self.ids[at[fit], turn[fit]] = scores[fit], ids[fit]

    def least(self, rows: slice) -> np.ndarray:
        """What a further candidate has to beat; -inf while there are fewer than k."""
        return self.scores[rows, -1]

    def rows(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query id, id, score) of all that was kept, some queries at a time."""
        for begin in range(0, len(queries), 1 << 14):
            some = self.scores[begin : begin + (1 << 14)]
            held = some > -np.inf
            yield np.repeat(queries[begin : begin + (1 << 14)], held.sum(axis=1)), self.ids[begin : begin + (1 << 14)][held], some[held]


def runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new group begins, rows) of batches sorted by `keys`; equal NaN keys are one group."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        each = [["nan" if v != v else v for v in batch.column(k).to_pylist()] for k in keys]
        each = list(zip(*each, strict=True))
        cuts = [i for i in range(1, len(each)) if each[i] != each[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(each)], strict=True):
            yield each[a] != last, batch.slice(a, b - a)
            last = each[a]


def units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length as doubles, how long each vector is (0: null, empty or holding a null), and whether its cosines are NaN."""
    lists = vectors.cast(pa.list_(pa.float64()))
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    x = np.full((len(sizes), sizes.max(initial=0)), 0.0)
    flat = lists.flatten()
    x[np.arange(x.shape[1])[None, :] < sizes[:, None]] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        bad = np.add.reduceat(np.r_[flat.is_null().to_numpy(zero_copy_only=False), False].astype(int), np.r_[0, np.cumsum(sizes)[:-1]]) * (sizes > 0)
        sizes = np.where(bad > 0, 0, sizes)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        odd = ~np.isfinite(x).all(axis=1) | (norm == 0)
        x = np.where(odd[:, None], 0.0, x / norm[:, None])
    return x, sizes, odd


class Asked:
    """A block of queries that candidates, ascending by id, are held against."""

    def __init__(self, batches: list[pa.RecordBatch], k: int):
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.ids = batch.column("id").to_numpy()
        self.x, self.sizes, self.odd = units(batch.column("vec"))
        self.best, self.seen = Best(len(self.ids), k, once=False), 0

    def meet(self, batch: pa.RecordBatch) -> None:
        ids = batch.column("id").to_numpy()
        x, sizes, odd = units(batch.column("vec"))
        wide = max(self.x.shape[1], x.shape[1])
        x, self.x = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in (x, self.x))
        at = 0
        while at < len(ids):
            # Few candidates at first, so that few pass before the k best so far keep the others out.
            to = at + min(COLUMNS, max(64, self.seen))
            for begin in range(0, len(self.ids), ROWS):
                self._meet(slice(begin, begin + ROWS), ids[at:to], x[at:to], sizes[at:to], odd[at:to])
            self.seen += len(ids[at:to])
            at = to

    def _meet(self, rows: slice, ids, x, sizes, odd) -> None:
        s = self.x[rows] @ x.T
        if odd.any() or self.odd[rows].any():
            s[self.odd[rows]] = NAN
            s[:, odd] = NAN
        mine = self.sizes[rows]
        if sizes.min() != sizes.max() or mine.min() != mine.max() or sizes[0] != mine[0] or not sizes[0]:
            s[(mine[:, None] != sizes[None, :]) | (sizes == 0)[None, :]] = NULL
        s[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        # Ids ascend, so what only ties with the kth best, once rounded, comes after it.
        at, c = np.nonzero(s >= (self.best.least(rows) + 4e-7)[:, None])
        scores = np.round(s[at, c], 6)
        fit = scores > self.best.least(rows)[at]
        self.best.add(rows.start + at[fit], ids[c[fit]], scores[fit])


def cosine_nearest(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each row of (id long, scope, vec) the k best rounded cosines among the other ids of its scope.

    Exact: every pair of a scope is compared. Scopes of many rows are cut into blocks of queries, and each block
    meets its whole scope. Cosines of zero or non-finite vectors are NaN and come first, those of null, empty
    or unequally long ones null and come last, as SQL orders them. Rows without an id or a scope take no part.
    """
    spark = rows.sparkSession
    rows = rows.filter("id is not null and scope is not null")
    sizes = rows.groupBy("scope").agg(F.count("*").alias("n"))
    cores = spark.sparkContext.defaultParallelism
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(LEAST, min(MOST, -(-total // (4 * cores))))
    # Scopes of more than one block: at most total / limit rows.
    many = sizes.filter(F.col("n") > limit).select(F.col("scope").alias("_scope"), F.ceil(F.col("n") / limit).alias("blocks"))
    known = rows.join(F.broadcast(many), F.col("scope") == F.col("_scope"), "left").select("id", "scope", "vec", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    asked = known.select("id", "scope", "vec", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(0).alias("turn"))
    held = known.select("id", "scope", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("turn"))
    parts = max(8 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = asked.unionByName(held).repartition(parts, "scope", "block").sortWithinPartitions("scope", "block", "turn", "id")

    def told(asked: Asked | None) -> Iterator[pa.RecordBatch]:
        for query, found, s in asked.best.rows(asked.ids) if asked else ():
            score = pa.array(np.where(s == NAN, np.nan, s), pa.float64(), mask=s == NULL)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), score], names=["query_id", "vec_id", "score"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, asked = [], None
        for new, batch in runs(batches, "scope", "block", "turn"):
            first = batch.column("turn")[0].as_py() == 0
            if new and (first or not waiting):  # a new block; it may hold no queries
                yield from told(asked)
                asked = None
            if first:
                waiting.append(batch)
                continue
            if waiting:
                waiting, asked = [], Asked(waiting, k)
            if asked:
                asked.meet(batch)
        yield from told(asked)

    return dealt.mapInArrow(meet, "query_id long, vec_id long, score double")
