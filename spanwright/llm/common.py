"""Shared pieces of the training-data operators: staging, Arrow text buffers, rolling hashes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once inside a Python worker.
BLOCK_BYTES = 1 << 20
#: Values hashed at once by prefix sums.
SPAN_VALUES = 1 << 20

#: White space of the word rule [^\x20\x09-\x0D]+ (fixed values).
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where none is configured in a local session (tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spanwright-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, label: str, gather: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    gather: as two files a core at most, for narrow tables that would else be many tiny files. The
    files go at the end of the Scratch block around it, or else with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if gather:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    _held.setdefault(id(spark.sparkContext), []).append(path)
    atexit.register(forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


_held: dict[int, list[str]] = {}


class Scratch:
    """Forgets what was staged inside a `with` block, but for what keep() names."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Scratch:
        self.begin = len(_held.setdefault(id(self.spark.sparkContext), []))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.staged_at)
        return df

    def __exit__(self, *error) -> None:
        held = _held[id(self.spark.sparkContext)]
        mine, held[self.begin :] = held[self.begin :], []
        for path in mine:
            if path in self.kept:
                held.append(path)
            else:
                forget(self.spark, path)


def forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already
        pass


def released(run: Callable) -> Callable:
    """run, giving a worker's spare memory back to the system at the end of each partition: workers
    are used again, and what one stage kept would narrow the next."""

    def whole(*batches):
        try:
            yield from run(*batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder modulo 5 (null ids: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about `limit` bytes of `column` each; a longer row is alone."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls count as empty."""
    arr = arr.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(arr.buffers()[1], np.int64, arr.offset + len(arr) + 1)[arr.offset :]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = both[0], both[1]
        if size <= 2 * SPAN_VALUES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _P) -> np.ndarray:
    """64-bit hash of values[start:end] for each pair, by prefix sums of a polynomial. start ascends.

    Long inputs go through in stretches, so the powers held never exceed one stretch and a span.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = len(start) if len(values) - low <= SPAN_VALUES else max(at + 1, int(np.searchsorted(start, low + SPAN_VALUES)))
        s, e = start[at:to] - low, end[at:to] - low
        some = values[low : low + int(e.max())]
        p, inv = powers(len(some) + 1, base)
        total = np.empty(len(some) + 1, np.uint64)
        total[0] = 0
        np.cumsum((some.astype(np.uint64) + np.uint64(1)) * p[: len(some)], out=total[1:])
        out[at:to] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
        at = to
    return out


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n+1 word offsets by document."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values (across documents too; callers mask those)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - k + 1)
    return span_hash(hashes, at, at + k, _Q)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, in about log2(w) vector steps."""
    have, size = x, 1
    while size < w:
        step = min(size, w - size)
        have = np.minimum(have[:-step], have[step:])
        size += step
    return have
