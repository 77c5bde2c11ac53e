"""Best-fit packing by bin completion over piece lengths.

Documents become token ids plus an end id; one longer than the capacity is cut into whole
sequences after a shorter first piece. How pieces share sequences depends only on how many there
are of each length, so the search runs on that histogram, CAPACITY numbers whatever the corpus: a
pattern is a filling around the largest remaining length, taken as often as the counts allow. The
search enumerates fillings of any number of pieces that leave no room for another, the fullest
first; best-fit decreasing gives the incumbent, and branches whose waste already exceeds what a
better packing could have are pruned.

Pieces then find their places without meeting: each has a rank among those of its length (the task
that made it, then its order there), and a pattern owns a range of ranks of each of its lengths.

Defined results: a null text is the empty text, one end id long; repeated rows are packed each; a
null id is kept; no document gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk

CAPACITY = 2048
END = 0
MOST_NODES = 1_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


@lru_cache(maxsize=2)
def tokenizers(vocabulary: str, ranks: str):
    """The tokenizer of the vocabulary file, a faster encoder of the same merges, and a pattern of the special tokens, which only the first knows."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    return exact, fast, re.compile("|".join(map(re.escape, special))) if special else None


def unusual(block: tk.Block) -> np.ndarray:
    """Texts with characters past U+027F or the C1 next-line, whose classes the two encoders might see differently."""
    odd = block.data >= 0xCA
    odd[1:] |= (block.data[1:] == 0x85) & (block.data[:-1] == 0xC2)
    return block.per_text(odd) > 0


def encode(texts: list[str], odd: np.ndarray, vocabulary: str, ranks: str) -> list[np.ndarray]:
    """Token ids with the end id of each text."""
    exact, fast, special = tokenizers(vocabulary, ranks)
    seen: dict[str, np.ndarray] = {}
    for text, rare in zip(texts, odd, strict=True):
        if text not in seen:
            ids = exact.encode(text, add_special_tokens=False).ids if rare or (special and special.search(text)) else fast.encode_to_numpy(text, disallowed_special=())
            seen[text] = np.append(np.asarray(ids, "<u4"), np.uint32(END))
    return [seen[t] for t in texts]


def cut(length: int, capacity: int) -> list[int]:
    """Where pieces start, and the end: whole sequences after a first piece that may be shorter."""
    if length <= capacity:
        return [0, length]
    return [0, *range(length % capacity or capacity, length + 1, capacity)]


def cutting(vocabulary: str, ranks: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in PIECES.split(", ")), strict=True)
        task, used = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                rows = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                all_ids = encode(texts, unusual(tk.string_block(part.column("text"))), vocabulary, ranks)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), all_ids, strict=True):
                    places = cut(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, used[b - a]))
                        used[b - a] += 1
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, k in zip(columns, kinds, strict=True)], list(names))

    return run


def least_sequences(counts: np.ndarray) -> int:
    """A bound that no packing beats: pieces over half fill sequences alone, what fits beside them fits at best whole."""
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * size)[::-1])[::-1]
    half = capacity // 2
    best = -(-int(total[0]) // capacity)
    for small in range(1, half + 1):
        alone = int(n[capacity - small + 1]) if small <= capacity else 0
        large = int(n[half + 1]) - alone
        room = large * capacity - (int(total[half + 1]) - (int(total[capacity - small + 1])))
        rest = int(total[small]) - int(total[half + 1])
        best = max(best, alone + large + max(0, -(-(rest - room) // capacity)))
    return best


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...]]:
    """Sets of any number of lengths that fit into room and leave none that would, the fullest first, then of the largest lengths; made as they are asked for."""
    lengths = np.flatnonzero(counts[: max(room, 0) + 1]).tolist()
    uses = [min(int(counts[x]), room // x) for x in lengths]
    sums, mask = [1], (1 << (max(room, 0) + 1)) - 1  # bit t of sums[j]: whether t is a sum of the first j lengths
    for x, n in zip(lengths, uses, strict=True):
        bits, step = sums[-1], 1
        while n:
            step = min(step, n)
            bits |= (bits << (x * step)) & mask
            n, step = n - step, 2 * step
        sums.append(bits)

    def of_sum(j: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        while j and sums[j] >> total & 1:
            x = lengths[j - 1]
            for k in range(min(uses[j - 1], total // x), 0, -1):
                if sums[j - 1] >> (total - k * x) & 1:
                    for others in of_sum(j - 1, total - k * x):
                        yield (x,) * k + others
            j -= 1

    for total in range(max(room, 0), -1, -1):
        if sums[-1] >> total & 1:
            for found in of_sum(len(lengths), total):
                if not any(x <= room - total and found.count(x) < counts[x] for x in lengths):
                    yield found


def best_fit_decreasing(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of best-fit decreasing, found by length instead of by piece."""
    capacity = len(counts) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            open_.setdefault(room, []).append((pattern, times))

    for x in range(capacity, 0, -1):
        n = int(counts[x])
        for room in sorted(r for r in open_ if r >= x) if n else []:
            for pattern, times in open_.pop(room):
                each = room // x
                whole = min(times, n // each)
                put(room - each * x, (*pattern, *[x] * each), whole)
                n, times = n - whole * each, times - whole
                if times and 0 < n:
                    put(room - n * x, (*pattern, *[x] * n), 1)
                    n, times = 0, times - 1
                put(room, pattern, times)
            if not n:
                break
        each = capacity // x
        put(capacity - each * x, (x,) * each, n // each)
        put(capacity - n % each * x, (x,) * (n % each), int(n % each > 0))
    return [group for groups in open_.values() for group in groups]


def bin_completion(counts: np.ndarray, most_nodes: int = MOST_NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, so that every piece has a place.

    counts[x] is the number of pieces of length x, 0 < x < len(counts) = capacity + 1. A filling is taken
    as often as the counts allow, or once, so that no packing is out of reach; the search ends when the
    bound is met, when nothing is left to try, or after most_nodes nodes and four for each length."""
    capacity = len(counts) - 1
    total, bound = int((counts * np.arange(capacity + 1)).sum()), least_sequences(counts)
    best = best_fit_decreasing(counts)
    best_bins = sum(times for _, times in best)

    def children(left: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for filling in fillings(rest, capacity - largest):
            pattern = (largest, *filling)
            lengths, uses = np.unique(pattern, return_counts=True)
            most = int((left[lengths] // uses).min())
            yield from [(pattern, most), (pattern, 1)][: 1 + (most > 1)]

    # The moves on the way to the node at hand; only that node has a live generator, which would hold all sums of
    # its lengths. A node that is come back to makes its own anew and skips what it has tried.
    left, bins, waste = counts.astype(np.int64), 0, 0
    moves: list[tuple[tuple[int, ...], int]] = []
    tried, more = [0], children(left)
    seen: set[bytes] = set()
    nodes, most_nodes = 0, most_nodes + 4 * int(np.count_nonzero(counts))

    def move(pattern: tuple[int, ...], times: int) -> None:
        nonlocal bins, waste
        np.subtract.at(left, list(pattern), times)
        bins, waste = bins + times, waste + times * (capacity - sum(pattern))

    while tried and best_bins > bound and nodes < most_nodes:
        pattern, times = next(more, (None, 0))
        tried[-1] += 1
        slack = (best_bins - 1) * capacity - total
        if pattern is None or waste + capacity - sum(pattern) > slack:  # fillings come by waste, so all others waste more
            tried.pop()
            if moves:
                undone, times = moves.pop()
                move(undone, -times)
                more = islice(children(left), tried[-1], None)
            continue
        nodes += 1
        move(pattern, times)
        if waste <= slack and not left.any():
            best_bins, best = bins, [*moves, (pattern, times)]
        state = hashlib.blake2b(left.tobytes() + bins.to_bytes(8, "big"), digest_size=16).digest()
        if waste > slack or not left.any() or state in seen:
            move(pattern, -times)
            continue
        seen.add(state)
        moves.append((pattern, times))
        tried.append(0)
        more = children(left)
    return best


def placing(patterns: list[tuple[tuple[int, ...], int]]):
    """UDF from (length, rank) to the sequence and the place in it."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            uses = pattern.count(length)
            start = taken.get(length, 0)
            rows.append((length, start, uses, sequence, offset))
            taken[length] = start + uses * times
            offset += uses * length
        sequence += times
    rows.sort()
    length_, start_, uses_, sequence_, offset_ = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
    key_ = length_ * (1 << 50) + start_

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(), rank.to_numpy()
        k = np.searchsorted(key_, size * (1 << 50) + at, "right") - 1
        since = at - start_[k]
        return pd.DataFrame({"sequence_id": sequence_[k] + since // uses_[k], "offset": offset_[k] + (since % uses_[k]) * size})

    return place


def pack(spark: SparkSession, documents: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of documents."""
    made = tk.only(documents, "doc_id", "text").mapInArrow(cutting(vocabulary, ranks, capacity), PIECES)
    pieces = tk.materialize(spark, made, "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    placed = ranked.withColumn("at", placing(bin_completion(counts))("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, tk.table(spark, sf_dir, "documents"))
