"""Shared helpers: stored intermediate tables, text batches as byte arrays, rolling hashes.

Texts reach Python as Arrow batches.  ``text_chunks`` cuts a batch into runs of
whole documents of a few megabytes, so temporary arrays stay bounded whatever
the batch size; a single longer document forms a run of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.session import fresh_dir

CHUNK_BYTES = 2 << 20
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` documents, unless the session names a size: texts are long, and a batch is held
    by the executor and by its worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "-2") == "-2":  # unset; the fallback must be a number
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, kind: str, *, free: bool = False) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back (cuts lineage, survives lost executors).

    ``free``: the shuffle files of this write go as soon as it is done, instead of when the driver next collects garbage
    (Spark 4.1; earlier ones do not know the setting and wait)."""
    spark = df.sparkSession
    path = fresh_dir(spark, kind)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    if free:
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if free and was is None:
            spark.conf.unset(key)
        elif free:
            spark.conf.set(key, was)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(doc_id: Column, text: Column) -> Column:
    """Row identity besides ``doc_id``: rows that agree in id and text are the same document."""
    return F.xxhash64(doc_id, text)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, lengthened where ``df`` has a column of that name (in either case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string without nulls); any other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


# ---------------------------------------------------------------- byte views of Arrow strings

class Texts:
    """A run of documents as one byte array; ``offs[i]:offs[i+1]`` are the bytes of document i."""

    __slots__ = ("rows", "data", "offs")

    def __init__(self, rows: slice, data: np.ndarray, offs: np.ndarray):
        self.rows, self.data, self.offs = rows, data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offs[i]:self.offs[i + 1]].tobytes()


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offs


def text_chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    data, offs = byte_view(arr)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Texts(slice(i, j), data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        i = j
    release()


# ---------------------------------------------------------------- words

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(t: Texts, is_gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words; document i owns words first[i]:first[i+1].

    ``is_gap`` tells for each byte value whether it separates words; a word never crosses documents.
    """
    gap = is_gap[t.data]
    n = len(gap)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(t.offs), np.int64)
    head = np.empty(n, bool)
    head[0] = True
    head[1:] = gap[:-1]
    head[t.offs[:-1][t.offs[:-1] < n]] = True
    tail = np.empty(n, bool)
    tail[-1] = True
    tail[:-1] = gap[1:]
    ends_at = t.offs[1:] - 1
    # an empty document ends where its predecessor does, or before the first byte
    tail[ends_at[ends_at >= 0]] = True
    word = ~gap
    starts = np.flatnonzero(head & word)
    ends = np.flatnonzero(tail & word) + 1
    return starts, ends, np.searchsorted(starts, t.offs)


# ---------------------------------------------------------------- rolling hashes

def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hash of any range of a sequence from prefix sums of ``value * base**i`` modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(rng.integers(1 << 60, 1 << 62)) * 8 + 5) % (1 << 64)
        self.inv = pow(self.base, -1, 1 << 64)
        self.pow = np.ones(1, np.uint64)
        self.ipow = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pow) <= n:
            m = -(-(n + 1) // 65536) * 65536
            a, b = np.full(m, self.base, np.uint64), np.full(m, self.inv, np.uint64)
            a[0] = b[0] = 1
            self.pow, self.ipow = np.multiply.accumulate(a), np.multiply.accumulate(b)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: bytes, or 64-bit numbers that are well mixed already."""
        self._grow(len(values) + 1)
        v = self.byte[values] if values.dtype == np.uint8 else values
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(v * self.pow[:len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each range [start, end); the length takes part in it."""
        return mix((prefix[ends] - prefix[starts]) * self.ipow[starts]
                   + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


ROLL1, ROLL2 = Rolling(11), Rolling(23)


def word_hashes(t: Texts, starts: np.ndarray, ends: np.ndarray, lower: bool = False,
                roll: Rolling = ROLL1) -> np.ndarray:
    return roll.ranges(roll.prefix(LOWER[t.data] if lower else t.data), starts, ends)


def runs(sorted_first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Start index of each run of equal keys in sorted arrays, with the length appended."""
    n = len(sorted_first)
    new = np.ones(n, bool)
    if n:
        new[1:] = sorted_first[1:] != sorted_first[:-1]
        for m in more:
            new[1:] |= m[1:] != m[:-1]
    return np.append(np.flatnonzero(new), n)


def expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, owner): lo[i], lo[i]+1, ... n[i] values for each i."""
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return lo[owner] + at, owner


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask over range(n): inside some [lo, hi)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:-1]) > 0


def release() -> None:
    """Returns freed memory to the system; workers live on after a task and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})
