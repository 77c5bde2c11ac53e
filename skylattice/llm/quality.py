"""Quality rules: counting rules, then a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of words are hashed to BUCKETS buckets. Two multinomials over the buckets are
fitted with add-one smoothing: one on trusted texts (labelled good and not toxic), one on the whole
corpus. A document's score is the mean over its n-grams of log(p_trusted / p_raw); one that scores
below the threshold is rejected. The trusted sample is bounded by TRUSTED rows, the ones whose
hashed ids are smallest; the raw counts cover every document.

Defined results: a null text counts as empty; a text without words scores 0 and fails the base
rules; without any trusted row the ratio is 0 everywhere, and the base rules alone decide; a null
id is never trusted; repeated rows are scored one by one and all count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

BUCKETS = 10_000
TRUSTED = 20_000
THRESHOLD = -0.03
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def ngram_buckets(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every unigram and bigram."""
    pairs, at = tk.word_windows(hashes, owner, 2)
    grams = np.concatenate([hashes, pairs])
    return (grams % tk.U64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[at]])


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, trusted) to one row for each bucket that this task saw."""
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in tk.slices(batch, "text"):
            block = tk.string_block(part.column("text"))
            starts, ends, owner = block.words()
            bucket, text = ngram_buckets(block.apart(starts, ends), owner)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good = np.asarray(part.column("trusted").to_numpy(zero_copy_only=False), bool)
            trusted += np.bincount(bucket[good[text]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["bucket", "raw", "trusted"])


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of at most `most` rows labelled good and not toxic, by hashed id: a bounded sample."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id")
    return tk.lowest_hashed(good, most, "doc_id").distinct()


def fit_ratio(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket. Only BUCKETS sums come to the driver."""
    ids = trusted_ids(labels).withColumn("trusted", F.lit(True))
    flagged = tk.only(documents, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    flagged = flagged.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = flagged.mapInArrow(count_buckets, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums.toLocalIterator():
        raw[row.bucket], trusted[row.bucket] = row.raw, row.trusted
    if not trusted.any():
        return np.zeros(BUCKETS)
    return np.log((trusted + 1) / (trusted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def distinct_per_text(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(keys, return_index=True)
    return np.bincount(owner[first], minlength=n)


def judge(block: tk.Block, ratio: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The columns after doc_id of FEATURES for each text of a block."""
    n = block.n
    starts, ends, owner = block.words()
    hashes = block.apart(starts, ends)
    salt = tk.mix(np.arange(n, dtype=tk.U64) + tk.U64(1))
    n_words = np.bincount(owner, minlength=n)
    inside = block.word_mask()
    chars = block.per_text(inside & ((block.data & 0xC0) != 0x80))
    symbols = block.per_text(SYMBOLS[block.data])

    line_ends = np.flatnonzero(block.data == 10)
    a = np.sort(np.concatenate([block.offsets[:-1], line_ends + 1]))
    text = np.concatenate([np.arange(n), np.searchsorted(block.offsets, line_ends, "right") - 1])
    text = text[np.argsort(np.concatenate([block.offsets[:-1], line_ends + 1]), kind="stable")]
    order = np.lexsort((a, text))
    a, text = a[order], text[order]
    b = np.append(a[1:], block.offsets[-1]) - 1
    closing = np.append(text[1:] != text[:-1], True)
    b[closing] = block.offsets[text[closing] + 1]
    word_after = np.searchsorted(starts, a)
    full = (word_after < len(starts)) & (np.append(starts, 0)[word_after] < b)
    a, b, text = a[full], b[full], text[full]
    lines = tk.mix(block.apart(a, b) + salt[text])
    dup_lines = np.bincount(text, minlength=n) - distinct_per_text(lines, text, n)

    windows, at = tk.word_windows(hashes, owner, 3)
    _, inverse, counts = np.unique(windows + salt[owner[at]], return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    covered = np.zeros(len(hashes) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    repeated = np.bincount(owner[covered[: len(hashes)]], minlength=n)

    bucket, text = ngram_buckets(hashes, owner)
    total = np.bincount(text, weights=ratio[bucket], minlength=n)
    score = total / np.maximum(np.bincount(text, minlength=n), 1)
    failed = (n_words < MIN_WORDS) | (100 * repeated > 50 * n_words)
    return [n_words, chars, symbols, dup_lines, repeated, failed, ~failed & (score >= threshold), score]


def judging(ratio: np.ndarray, threshold: float, keep: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                columns = judge(tk.string_block(part.column("text")), ratio, threshold)
                yield keep(part, columns) if keep else pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names)

    return run


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """FEATURES of every document (doc_id, text) by the rules and the ratio fitted on labels."""
    run = judging(fit_ratio(documents, labels), threshold)
    return tk.only(documents, "doc_id", "text").mapInArrow(run, FEATURES)


def quality_filter(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that quality_rules keeps, whole and with all their columns."""
    run = judging(fit_ratio(documents, labels), threshold, lambda part, columns: part.filter(pa.array(columns[6])))
    return documents.mapInArrow(run, documents.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(tk.table(spark, sf_dir, "documents"), tk.table(spark, sf_dir, "labels"))
