"""Context-triggered piecewise hashing: fingerprints of whole texts, compared by edit distance.

A rolling hash over WINDOW bytes ends a chunk wherever it is -1 modulo the block size; each chunk
gives one symbol of twelve hash bits, written as two characters. A fingerprint holds its block size
(LEAST * 2**k) and the symbols at that size and at twice it: "size:symbols:symbols". The block size
is the least at which SYMBOLS chunks are expected to cover the text; where fewer than a quarter of
them come about it is halved. A list ends at SYMBOLS symbols, the last covering the rest of the text.

Two fingerprints can be compared at block sizes that both hold. Likeness is 1 - edit distance /
longer length of the lists there, the most of the shared sizes; 0 where none is shared.

Defined results: a null text is the empty text, whose lists are empty and alike 1 to each other and
0 to any other; equal texts have equal fingerprints; rows without an id come first; rows that repeat
an id follow one another in the order of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

WINDOW, LEAST, SYMBOLS, HALVINGS = 5, 3, 64, 24
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Rows that one range of ids holds about; the number of ranges is bounded, as their first ids come to the driver.
RANGE_ROWS, MOST_RANGES, SAMPLE = 1_000, 10_000, 20_000
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolling(block: tk.Block) -> np.ndarray:
    """32-bit hash of the WINDOW bytes up to each byte; a text's first bytes see zeros before it."""
    n = len(block.data)
    value = np.zeros(n, np.uint64)
    place = np.arange(n) - np.repeat(block.offsets[:-1], np.diff(block.offsets))
    for back in range(WINDOW):
        byte = np.zeros(n, np.uint64)
        byte[back:] = block.data[: n - back].astype(np.uint64) + np.uint64(1)
        byte[place < back] = 0
        value = value * np.uint64(257) + byte
    return (tk.mix(value) >> np.uint64(32)).astype(np.uint32)


def chunk_symbols(block: tk.Block, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, counts): up to SYMBOLS 12-bit symbols of each text at its block size; 0 pads."""
    per_byte = np.repeat(size, np.diff(block.offsets)).astype(np.uint32)
    ends = np.flatnonzero(hashes % per_byte == per_byte - np.uint32(1)) + 1
    text = np.searchsorted(block.offsets, ends, "left") - 1
    first = np.searchsorted(ends, block.offsets[:-1], "right")
    rank = np.arange(len(ends)) - first[text]
    inner = (rank < SYMBOLS - 1) & (ends < block.offsets[text + 1])
    ends, text, rank = ends[inner], text[inner], rank[inner]
    full = np.flatnonzero(np.diff(block.offsets) > 0)
    count = np.bincount(text, minlength=block.n)
    ends = np.concatenate([ends, block.offsets[full + 1]])
    rank, text = np.concatenate([rank, count[full]]), np.concatenate([text, full])
    order = np.lexsort((rank, text))
    ends, rank, text = ends[order], rank[order], text[order]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    opening = rank == 0
    starts[opening] = block.offsets[text[opening]]
    symbols = np.zeros((block.n, SYMBOLS), np.int16)
    symbols[text, rank] = (block.apart(starts, ends) & np.uint64(4095)).astype(np.int16) + 1
    return symbols, np.bincount(text, minlength=block.n)


class Prints:
    """Fingerprints of the texts of a block."""

    def __init__(self, block: tk.Block):
        length = np.diff(block.offsets)
        level = np.ceil(np.log2(np.maximum(length / (LEAST * SYMBOLS), 1))).astype(np.int64)
        hashes = rolling(block)
        symbols, counts = chunk_symbols(block, hashes, LEAST << level)
        for _ in range(HALVINGS):
            thin = np.flatnonzero((counts < SYMBOLS // 4) & (level > 0))
            if not len(thin):
                break
            level[thin] -= 1
            part, own = subset(block, hashes, thin)
            symbols[thin], counts[thin] = chunk_symbols(part, own, LEAST << level[thin])
        double, double_counts = chunk_symbols(block, hashes, LEAST << (level + 1))
        self.level, self.lists = level, ((symbols, counts), (double, double_counts))

    def strings(self) -> list[str]:
        texts = []
        for symbols, _ in self.lists:
            bits = np.maximum(symbols.astype(np.int32) - 1, 0)
            texts.append(np.stack([LETTERS[bits >> 6], LETTERS[bits & 63]], axis=2).reshape(len(symbols), -1))
        return [
            f"{LEAST << int(k)}:{a[: 2 * n].tobytes().decode()}:{b[: 2 * m].tobytes().decode()}"
            for k, a, n, b, m in zip(self.level, texts[0], self.lists[0][1], texts[1], self.lists[1][1], strict=True)
        ]


def subset(block: tk.Block, values: np.ndarray, rows: np.ndarray) -> tuple[tk.Block, np.ndarray]:
    """The given texts of a block, and their part of one value per byte."""
    length = np.diff(block.offsets)[rows]
    offsets = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(offsets[-1]) + np.repeat(block.offsets[rows] - offsets[:-1], length)
    return tk.Block(block.data[at], offsets), values[at]


def edit_likeness(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 - Levenshtein distance / longer length, of many pairs of lists at once; 1 for two empty ones."""
    steps = np.arange(b.shape[1] + 1, dtype=np.int16)
    row = np.broadcast_to(steps, (len(a), len(steps))).copy()
    distance = np.where(n == 0, m, 0).astype(np.int64)
    at = np.arange(len(a))
    for i in range(int(n.max(initial=0))):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = np.flatnonzero(n == i + 1)
        distance[done] = row[done, m[done]]
    longer = np.maximum(n, m)
    return np.where(longer == 0, 1.0, 1 - distance / np.maximum(longer, 1))


def likeness(x: Prints, y: Prints, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of text i[k] of x and text j[k] of y: the most over the block sizes that both hold."""
    best = np.zeros(len(i))
    for p, (a, n) in enumerate(x.lists):
        for q, (b, m) in enumerate(y.lists):
            at = np.flatnonzero(x.level[i] + p == y.level[j] + q)
            found = edit_likeness(a[i[at]], n[i[at]], b[j[at]], m[j[at]])
            best[at] = np.maximum(best[at], found)
    return best


def range_cuts(ids: DataFrame, ranges: int) -> np.ndarray:
    """First ids of up to `ranges` ranges of about equal size, from a bounded sample of hashed ids."""
    sample = tk.lowest_hashed(ids.select("key"), SAMPLE, "key")
    keys = np.sort(np.array([r["key"] for r in sample.collect()], np.int64))
    return np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges]) if len(keys) else keys


def beside_next(documents: DataFrame) -> DataFrame:
    """(part, halo, key, doc_id, text): documents dealt into ranges of ids, each with a copy of the
    first document of the next range (halo), so that a task sees every document and its successor.

    The text is shuffled once. The driver holds one id of each range, MOST_RANGES at most."""
    rows = tk.only(documents, "doc_id", "text").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = range_cuts(rows, max(1, min(MOST_RANGES, rows.count() // RANGE_ROWS)))

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    found = rows.select("key").withColumn("part", part_of("key")).groupBy("part").agg(F.min("key").alias("head")).orderBy("part").collect()
    heads = np.array([r["head"] for r in found], np.int64)
    parts = np.array([r["part"] for r in found], np.int32)
    earlier = np.roll(parts, 1)

    @F.pandas_udf("int")
    def halo_of(key: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(heads, key.to_numpy()), max(len(heads) - 1, 0))
        return pd.Series(np.where(heads[at] == key.to_numpy(), earlier[at], -1).astype(np.int32)) if len(heads) else pd.Series(np.zeros(0, np.int32))

    here = F.struct(F.col("part"), F.lit(False).alias("halo"))
    there = F.struct(F.col("to").alias("part"), F.lit(True).alias("halo"))
    dealt = rows.withColumns({"part": part_of("key"), "to": halo_of("key")})
    dealt = dealt.select("key", "doc_id", "text", F.inline(F.when(F.col("to") >= 0, F.array(here, there)).otherwise(F.array(here))))
    return dealt.repartition("part").sortWithinPartitions("part", "halo", "key", "text")


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_rows(rows: pa.Table, emit: np.ndarray) -> pa.RecordBatch:
    """RESULT of the rows at emit, each beside its successor in rows."""
    texts = rows.column("text").to_pylist()
    changed = [edited(texts[i], texts[i + 1]) for i in emit]
    own = Prints(tk.string_block(rows.column("text").combine_chunks()))
    other = Prints(tk.string_block(pa.array(changed, pa.string())))
    names, edited_names = own.strings(), other.strings()
    columns = [
        rows.column("doc_id").combine_chunks().take(pa.array(emit)),
        pa.array([len(texts[i]) for i in emit], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
        pa.array([names[i] for i in emit], pa.string()),
        pa.array(edited_names, pa.string()),
        pa.array(likeness(own, other, emit, np.arange(len(emit)))),
        pa.array(likeness(own, own, emit, emit + 1)),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, halos last, to RESULT; the last row of a slice waits for its successor."""
    waiting: pa.Table | None = None
    for batch in batches:
        for part in tk.slices(batch, "text"):
            rows = pa.Table.from_batches([part])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            where, halo = rows.column("part").to_numpy(), rows.column("halo").to_numpy()
            emit = np.flatnonzero(~halo[:-1] & (where[:-1] == where[1:]))
            if len(emit):
                yield fingerprint_rows(rows, emit)
            waiting = rows.slice(rows.num_rows - 1)


def fingerprints(documents: DataFrame) -> DataFrame:
    """RESULT of each document: its fingerprint, that of its edited text, and likenesses."""
    return beside_next(documents).mapInArrow(fingerprint_batches, RESULT)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(tk.table(spark, sf_dir, "documents"))
