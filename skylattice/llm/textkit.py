"""Vectorised helpers over Arrow string columns: words, line and word hashes, blocks of bounded size.

Texts stay UTF-8 bytes. Words are runs of bytes other than space and \\t..\\r, so splitting bytes
and splitting code points agree. Hashes are polynomial prefix hashes modulo 2**64, finalised by a
mixer, so the hash of any span costs two look-ups.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 500_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_local: dict[str, str] = {}
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; those of a usual block are kept for the life of the worker."""

    def made(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, U64)
        steps[0] = 1
        return np.cumprod(steps, dtype=U64, out=steps)

    if n > 2 * BLOCK_BYTES:
        return made(BASE, n), made(BASE_INVERSE, n)
    if len(_powers[0]) < n:
        _powers[:] = (made(b, 2 * BLOCK_BYTES) for b in (BASE, BASE_INVERSE))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Block:
    """Consecutive texts as one byte array: text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1
        self._prefix: np.ndarray | None = None

    def lowered(self) -> Block:
        return Block(LOWER[self.data], self.offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one per byte) over each text."""
        total, full = np.zeros(self.n, np.int64), np.diff(self.offsets) > 0
        if full.any():
            total[full] = np.add.reduceat(flags, self.offsets[:-1][full], dtype=np.int64)
        return total

    def word_mask(self) -> np.ndarray:
        return ~SPACE[self.data]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of every word, in order."""
        inside = self.word_mask()
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def apart(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """As spans, of spans in order that don't overlap: stretch by stretch, so that a very long text takes
        no more memory than a block does (unless one span itself is longer)."""
        if len(self.data) <= BLOCK_BYTES:
            return self.spans(starts, ends)
        out = np.empty(len(starts), U64)
        cut = np.append(np.flatnonzero(np.diff(starts // BLOCK_BYTES, prepend=-1)), len(starts))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            low, high = int(starts[a]), int(ends[b - 1])
            out[a:b] = Block(self.data[low:high], np.array([0, high - low])).spans(starts[a:b] - low, ends[a:b] - low)
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of every span; equal bytes give equal hashes wherever they stand."""
        ahead, back = powers(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, U64)
            np.cumsum((self.data.astype(U64) + U64(1)) * ahead[:-1], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * back[starts] + U64(0x51ED270B))


def string_block(column: pa.Array) -> Block:
    """The whole column as one block; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return Block(data, ends - ends[0])


def slices(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about size bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    bytes_ = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(bytes_.astype(np.int64)) // size
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def word_windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of size words within one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    key = np.zeros(len(at), U64)
    for k in range(size):
        key = key * U64(BASE) + hashes[at + k]
    return mix(key), at


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where Spark is local and none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "folder" not in _local:
            _local["folder"] = tempfile.mkdtemp(prefix="skylattice-")
        folder = _local["folder"]
    return folder


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back; cuts lineage and survives lost executors."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Deletes what materialize wrote; only for tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The settings for jobs that run inside."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further ones with clashing names do no harm."""
    return df.select(*(df[c] for c in columns))


def lowest_hashed(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows, those whose hashed keys are smallest: a bounded sample that no layout changes.
    A threshold on the hash comes first, so that partitions send about 2 * most rows together, not each."""
    rows, hashed = df.count(), F.xxhash64(*keys)
    if rows > 4 * most:  # twice as many as asked for lie below the threshold, give or take a few hundredths
        df = df.where(hashed < int(-(2**63) + 2**64 * (2 * most + 1000) / rows))
    return df.orderBy(hashed, *keys).limit(most)
