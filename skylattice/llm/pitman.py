"""Hierarchical Pitman-Yor language model: context restaurants share a unigram parent.

Words and an end make the tokens; a token's context is the token before it, an end before the
first, and every context has a restaurant. Seats are sampled: in each sweep the customers of a dish
leave and are seated again one by one, given the tables that all restaurants had after the sweep
before; after the first EXACT, whose turns are cheap, the gap to the next customer that may open a
table is drawn at once (thinning, which is exact), so a frequent pair costs about as many draws as it
gets tables. Each table of a context is a customer of the unigram restaurant, whose parent is uniform over the
vocabulary and one unknown word. The probability of a token is the mean over SAMPLES seatings of
the predictive probability, which sums to one over known words and the unknown one.

Tokens are dealt to parts by their context, those after the HOT commonest words by both words, and a
part's pairs (context, word) are one packed row. A sweep draws the tables of a part's pairs and sends
their sums by word and by context to buckets of keys, which add them up over all parts and answer every
part; random numbers hash the pair and the sweep, so no result depends on how rows are laid out, and
tables can be drawn again instead of kept. At last the tokens are dealt once more, now with their rows:
a task holds the scores of one part's pairs, occurrences stream through, and sums by document go back
to the deal that the document came from. The commonest words travel as codes of two bytes.

Defined results: a null text is the empty text, one end; a null id is held out (crc32 of no text);
rows that repeat an id are scored by themselves; without training tokens every token is unknown.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

SAMPLES, SWEEPS, EXACT = 3, 4, 16
#: How the same draws are made: dishes that are left to be seated singly, and random numbers made at once for one.
ALONE, AHEAD = 64, 256
STRENGTH = 0.5
#: Layout only: words that have codes, those of them whose pairs are dealt by both words, and rows that are looked at to find them.
TOP, HOT, LOOKED_AT = 65_535, 1024, 4000
#: Layout only: tokens that a task deals out at once, bytes of text to a part of the pairs, and parts to a bucket of sums.
DEAL, PART_BYTES, BUCKET_PARTS = 1_000_000, 24_000_000, 8
FOLDS = 10
END = np.uint64(0xE0F_E0F_E0F_E0F)
#: kind 0: pairs of a part; 1: sums of a round for a part (deal: round and bucket); 2: ids of a deal's rows; 3: tokens of a deal. To a
#: bucket: sums of a part (deal). Beyond the parts: scores of rows by deal.
PACKED = "part int, kind int, deal long, a binary"
PAIRED = f"{PACKED}, one long, two long"
ANSWERED = f"{PACKED}, customers long, dishes long, one long, two long, heads long, words long, tokens long"
SUMS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0 for i in ids], bool)


class Tokens:
    """Token hashes of a record batch in order, ends included, with their contexts and rows."""

    def __init__(self, part: pa.RecordBatch):
        low = tk.string_block(part.column("text")).lowered()
        starts, ends, owner = low.words()
        n, words = low.n, np.bincount(owner, minlength=low.n)
        self.row = np.repeat(np.arange(n), words + 1)
        last = np.cumsum(words + 1) - 1
        self.hash = np.full(len(self.row), END)
        inner = np.ones(len(self.row), bool)
        inner[last] = False
        self.hash[inner] = low.apart(starts, ends)
        self.context = np.concatenate([[END], self.hash[:-1]])  # the end of the row before stands before the first
        self.ids = part.column("doc_id").to_pylist()
        self.held = held_out(self.ids)
        self.n_tokens = words + 1


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tk.mix(context * np.uint64(tk.BASE) + word)


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (context, word, n): occurrences in training documents, 0 for pairs of held-out ones alone."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        context, word, trained = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, at = np.unique(pair_keys(context, word), return_index=True, return_inverse=True)
        n = np.bincount(at, weights=trained, minlength=len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(context[first].view(np.int64)), pa.array(word[first].view(np.int64)), pa.array(n)], ["context", "word", "n"])

    held, size = [], 0
    for batch in batches:
        for part in tk.slices(batch, "text"):
            tokens = Tokens(part)
            held.append((tokens.context, tokens.hash, ~tokens.held[tokens.row]))
            size += len(tokens.hash)
            if size > DEAL:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def pair_counts(documents: DataFrame) -> DataFrame:
    """(context, word, n) of every pair of the documents (doc_id, text)."""
    return documents.mapInArrow(counting, "context long, word long, n long").groupBy("context", "word").agg(F.sum("n").alias("n"))


def word_counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            words, n = np.unique(Tokens(part).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def common_tokens(documents: DataFrame) -> np.ndarray:
    """Hashes of the end and of at most TOP - 1 words that are common in about LOOKED_AT documents, commonest first."""
    documents = tk.only(documents, "doc_id", "text")
    one_of = max(1, documents.count() // LOOKED_AT)
    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_of)) == 0)
    counts = some.mapInArrow(word_counting, "word long, n long").where(F.col("word") != int(END.view(np.int64))).groupBy("word").agg(F.sum("n").alias("n"))
    words = counts.orderBy(F.desc("n"), "word").limit(TOP - 1).toArrow().column("word").to_numpy()
    return np.append(END, words.view(np.uint64))


class Hashed:
    """Random numbers that depend only on the seed of their row."""

    def __init__(self, seeds: np.ndarray):
        self.seeds = seeds

    def uniform(self, at: np.ndarray, turn: int) -> np.ndarray:
        return (tk.mix(self.seeds[at] + np.uint64((turn + 1) * tk.BASE % 2**64)) >> np.uint64(11)) / 2.0**53

    def stream(self, at: int, turn: int) -> Iterator[float]:
        """Those of one row from a turn on."""
        while True:
            steps = np.arange(turn + 1, turn + 1 + AHEAD, dtype=np.uint64) * np.uint64(tk.BASE)
            yield from ((tk.mix(self.seeds[at] + steps) >> np.uint64(11)) / 2.0**53).tolist()
            turn += AHEAD


class Drawn:
    """Random numbers of a generator, in order."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def uniform(self, at: np.ndarray, turn: int) -> np.ndarray:
        return self.rng.random(len(at))

    def stream(self, at: int, turn: int) -> Iterator[float]:
        while True:
            yield self.rng.random()


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator | Hashed) -> np.ndarray:
    """Tables of each dish after its customers sat down one by one; opening weighs a new table.

    After i customers and t tables the next opens one with the chance a / (i - dt + a), which no later customer
    exceeds, as t grows no faster than i. So those that would open a table by the greatest chance are drawn by the
    gap to the next of them, and one of them does by the ratio of its own chance to that: exact, in as many steps
    as there are tables, but for few."""
    source = Drawn(rng) if isinstance(rng, np.random.Generator) else rng
    tables = (customers > 0).astype(np.int64)
    for i in range(1, EXACT):
        at = np.flatnonzero(customers > i)
        new = opening[at] / (np.maximum(i - discount * tables[at], 1e-9) + opening[at])
        tables[at] += source.uniform(at, i) < new
    live, turn = np.flatnonzero(customers > EXACT), EXACT
    seated = np.full(len(live), EXACT, float)
    with np.errstate(divide="ignore"):
        while len(live) > ALONE:
            a, filled = opening[live], discount * tables[live]
            most = a / (seated - filled + a)
            seated = seated + np.floor(np.log(source.uniform(live, turn)) / np.log1p(-most))
            stays = seated < customers[live]
            live, seated, a, filled, most = (x[stays] for x in (live, seated, a, filled, most))
            tables[live] += source.uniform(live, turn + 1) * most < a / (seated - filled + a)
            seated, turn = seated + 1, turn + 2
    for k, before in zip(live.tolist(), seated.tolist(), strict=True):
        tables[k] = seat_alone(int(customers[k]), before, int(tables[k]), float(opening[k]), discount, source.stream(k, turn))
    return tables


def seat_alone(customers: int, seated: float, tables: int, opening: float, discount: float, uniform: Iterator[float]) -> int:
    """The same steps for one dish, so that the commonest few take no array operations of a few numbers."""
    while True:
        most = opening / (seated - discount * tables + opening)
        seated += math.floor(math.log(max(next(uniform), 1e-300)) / math.log1p(-most))
        if seated >= customers:
            return tables
        tables += next(uniform) * most < opening / (seated - discount * tables + opening)
        seated += 1


def few(customers: np.ndarray) -> list[int]:
    """How many dishes one customer has, and two."""
    return [int((customers == 1).sum()), int((customers == 2).sum())]


def discount_of(one: float, two: float) -> float:
    """Absolute discount by the numbers of dishes that one and two customers have."""
    return float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))


@dataclass(frozen=True)
class Totals:
    """Of all restaurants: customers and dishes of the parent, known words, and both discounts."""

    customers: int
    dishes: int
    vocabulary: int
    discount: float
    parent: float


def opening_of(seats: np.ndarray, customers: np.ndarray, t: Totals) -> np.ndarray:
    """Weight of a new table: tables of the context, and customers of the word in the parent."""
    total = t.customers + STRENGTH
    rest = (STRENGTH + t.parent * t.dishes) / total / (t.vocabulary + 1)
    return (STRENGTH + t.discount * seats) * (np.maximum(customers - t.parent, 0) / total + rest)


def heads_of(customers: np.ndarray, parent: float, rng: np.random.Generator | Hashed) -> np.ndarray:
    """Tables of the words in the parent."""
    return seat(customers, np.full(len(customers), max(parent, 1e-3)), parent, rng)


def predictive(count, tables, seats, guests, customers, heads, t: Totals, parent_customers, parent_tables) -> np.ndarray:
    """Mean predictive probability: count and tables of the dish, tables and guests of its context, customers and tables of its word in the parent."""
    return sum(predictive_of(count, tables[s], seats[s], guests, customers[s], heads[s], t, parent_customers[s], parent_tables[s]) for s in range(SAMPLES)) / SAMPLES


def predictive_of(count, tables, seats, guests, customers, heads, t: Totals, parent_customers, parent_tables) -> np.ndarray:
    """The same by one seating."""
    above = (customers - t.parent * heads + (STRENGTH + t.parent * parent_tables) / (t.vocabulary + 1)) / (STRENGTH + parent_customers)
    return (count - t.discount * tables + (STRENGTH + t.discount * seats) * above) / (STRENGTH + guests)


class Model:
    """The same model of one grid of counts (contexts by words) held whole, and its probabilities."""

    def __init__(self, top: np.ndarray, cells: np.ndarray, others: np.ndarray):
        """others: customers of each context that the grid does not hold, or empty."""
        width = len(top)
        counts = cells.reshape(width + 1, width)
        context, dish = (x.ravel() for x in np.indices(counts.shape))
        count, rng = counts.ravel(), np.random.default_rng(0)
        tables, drawn = (count > 0).astype(np.int64), []
        vocabulary, discount = int((counts.sum(axis=0) > 0).sum()), discount_of(*few(count))
        for sweep in range(SWEEPS + SAMPLES - 1):
            customers = np.bincount(dish, weights=tables, minlength=width)
            t = Totals(int(customers.sum()), int((customers > 0).sum()), vocabulary, discount, discount_of(*few(customers)))
            tables = seat(count, opening_of(np.bincount(context, weights=tables)[context], customers[dish], t), discount, rng)
            if sweep >= SWEEPS - 1:
                customers = np.bincount(dish, weights=tables, minlength=width).astype(np.int64)
                drawn.append((tables, np.bincount(context, weights=tables), customers, heads_of(customers, t.parent, rng)))
        tables, self.seats, customers, heads = (np.stack(x) for x in zip(*drawn, strict=True))
        self.totals = Totals(int(customers[-1].sum()), int((customers[-1] > 0).sum()), vocabulary, discount, discount_of(*few(customers[-1])))
        self.guests = counts.sum(axis=1) + (others if len(others) else 0)
        self.parent_customers, self.parent_tables = customers.sum(axis=1), heads.sum(axis=1)
        self.common = self.probability(count, tables, context, customers[:, dish], heads[:, dish]).reshape(counts.shape)

    def probability(self, count, tables, context, customers, heads) -> np.ndarray:
        return predictive(count, tables, self.seats[:, context], self.guests[context], customers, heads, self.totals, self.parent_customers, self.parent_tables)


def drawn(context: np.ndarray, word: np.ndarray, n: np.ndarray, seats: np.ndarray, customers: np.ndarray, t: Totals, sweep: int) -> np.ndarray:
    """Tables of pairs in a sweep, by the sums of the sweep before; what a dish had itself is in no need of keeping."""
    seeds = tk.mix(pair_keys(context, word) + np.uint64(sweep + 1))
    return seat(n, opening_of(seats, customers, t), t.discount, Hashed(seeds))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed planes of bytes: first bytes of all numbers, then second ones."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    raw = np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    sizes, at, found = raw[: 8 * len(kinds)].view(np.int64), 8 * len(kinds), []
    for n, kind in zip(sizes, map(np.dtype, kinds), strict=True):
        found.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return found


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Row by row, so that one row at a time is copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(batch.num_columns))


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows that are sorted by their first column, by that column."""
    return groupby(rows_of(batches), key=lambda row: row[0])


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def sent(rows: DataFrame, parts: int) -> DataFrame:
    """Every part in one task, in order of kinds and deals."""
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind", "deal")


class Codes:
    """Words as two bytes, if they are common, or 0 and their hash."""

    def __init__(self, common: np.ndarray):
        self.common, self.order = common, np.argsort(common)
        self.sorted = common[self.order]

    def of(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.order[at] + 1, 0).astype(np.uint16)

    def words(self, codes: np.ndarray, others: np.ndarray) -> np.ndarray:
        found = self.common[np.maximum(codes, 1) - 1]
        found[codes == 0] = others
        return found


def dealing(common: np.ndarray, parts: int, with_rows: bool):
    """Texts to PACKED of kind 3, a deal's tokens by part: their pairs with the training occurrences of each or,
    with rows, in order of documents with the tokens of each; then kind 2 too, what a deal's rows are."""

    def flush(held: list[Tokens], deal: int, codes: Codes) -> pa.RecordBatch:
        context, word = np.concatenate([x.context for x in held]), np.concatenate([x.hash for x in held])
        shift = np.cumsum([0, *(len(x.ids) for x in held[:-1])])
        row = np.concatenate([x.row + k for x, k in zip(held, shift, strict=True)])
        is_held, rows = np.concatenate([x.held for x in held]), []
        if with_rows:
            ids = [i for x in held for i in x.ids]
            null, numbers = np.array([i is None for i in ids], bool), np.array([i or 0 for i in ids], np.int64)
            rows.append((deal % parts, 2, deal, packed(numbers, null, is_held, np.concatenate([x.n_tokens for x in held]).astype(np.int64))))
        else:
            _, first, at = np.unique(pair_keys(context, word), return_index=True, return_inverse=True)
            context, word, n = context[first], word[first], np.bincount(at, weights=~is_held[row], minlength=len(first)).astype(np.uint64)
        word_code, context_code = codes.of(word), codes.of(context)
        hot = (context_code > 0) & (context_code <= HOT)
        place = (np.where(hot, pair_keys(context, word), context) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            at = order[edges[p] : edges[p + 1]]
            c, w = context_code[at], word_code[at]
            if with_rows:
                own = row[at]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                further = own[first].astype(np.uint32), np.diff(np.append(first, len(at))).astype(np.uint32)
            else:
                further = (n[at],)
            rows.append((int(p), 3, deal, packed(c, w, context[at][c == 0], word[at][w == 0], *further)))
        return batch_of(rows, PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, deal, codes = [], 0, TaskContext.get().partitionId() << 32, Codes(common)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                held.append(Tokens(part))
                size += len(held[-1].hash)
                if size > DEAL:
                    yield flush(held, deal, codes)
                    held, size, deal = [], 0, deal + 1
        if held:
            yield flush(held, deal, codes)

    return run


def dealt_tokens(codes: Codes, data: bytes, *further: type) -> tuple:
    """(contexts, words, further arrays) of a row of kind 3."""
    c, w, other_contexts, other_words, *rest = unpacked(data, np.uint16, np.uint16, np.uint64, np.uint64, *further)
    return codes.words(c, other_contexts), codes.words(w, other_words), *rest


def pairing(common: np.ndarray):
    """Tokens of kind 3, without rows, to the pairs of each part."""

    def added(held: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        context, word, n = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, at = np.unique(pair_keys(context, word), return_index=True, return_inverse=True)
        return [(context[first], word[first], np.bincount(at, weights=n).astype(np.uint64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(common)
        for part, rows in by_part(batches):
            held, size, most = [], 0, 4 * DEAL
            for *_, data in rows:
                held.append(dealt_tokens(codes, data, np.uint64))
                size += len(held[-1][0])
                if size > most:
                    held = added(held)
                    size = len(held[0][0])
                    most = max(most, 2 * size)
            context, word, n = added(held)[0]
            contexts, ci = np.unique(context, return_inverse=True)
            words, wi = np.unique(word, return_inverse=True)
            order = np.lexsort((wi, ci))
            data = packed(words, contexts, np.bincount(ci).astype(np.uint32), wi[order].astype(np.uint32), n[order])
            yield batch_of([(part, 0, 0, data, int((n == 1).sum()), int((n == 2).sum()))], PAIRED)

    return run


class Part:
    """The pairs of a part: places of their contexts and words, and their occurrences in training documents."""

    def __init__(self, data: bytes):
        self.words, self.contexts, per_context, self.wi, n = unpacked(data, np.uint64, np.uint64, np.uint32, np.uint32, np.uint64)
        self.ci, self.n = np.repeat(np.arange(len(self.contexts)), per_context), n.astype(np.int64)

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.wi, weights=x, minlength=len(self.words)).astype(np.uint64)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.ci, weights=x, minlength=len(self.contexts)).astype(np.uint64)

    def tables(self, seats: np.ndarray, customers: np.ndarray, t: Totals, sweep: int) -> np.ndarray:
        """Tables of all pairs by the sums of their contexts and words; one customer has one table, whatever the others do."""
        tables, at = (self.n > 0).astype(np.int64), np.flatnonzero(self.n > 1)
        ci, wi = self.ci[at], self.wi[at]
        tables[at] = drawn(self.contexts[ci], self.words[wi], self.n[at], seats[ci], customers[wi], t, sweep)
        return tables

    def messages(self, part: int, buckets: int, tables: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Sums of tables and n by word and by context, cut by ranges of keys."""
        bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
        sides = [(keys, np.searchsorted(keys, bounds), by(tables), by(n)) for keys, by in ((self.words, self.by_word), (self.contexts, self.by_context))]
        cut = [zip(*(np.split(x, edges) for x in (keys, *sums)), strict=True) for keys, edges, *sums in sides]
        return batch_of([(b, 0, part, packed(*w, *c)) for b, (w, c) in enumerate(zip(*cut, strict=True))], PACKED)


def beginning(buckets: int):
    """Pairs to the first messages: every dish has one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, data, *_ in rows_of(batches):
            own = Part(data)
            yield own.messages(part, buckets, own.n > 0, own.n)

    return run


def sums_of(rows: Iterator[tuple]) -> dict[int, list[np.ndarray]]:
    """round: [tables of words, heads or, in round 0, occurrences of words, the same of contexts], of a part's rows of kind 1."""
    found: dict[int, list] = {}
    for _, _, deal, data in rows:
        found.setdefault(deal >> 32, []).append(unpacked(data, *[np.uint64] * 4))
    return {k: [np.concatenate(x).astype(np.int64) for x in zip(*each, strict=True)] for k, each in found.items()}


def sweeping(t: Totals, sweep: int, buckets: int):
    """Pairs with the sums of the round before to messages with those of their new tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            own = Part(next(rows)[3])
            customers, _, seats, _ = sums_of(rows)[sweep]
            yield own.messages(part, buckets, own.tables(seats, customers, t, sweep), np.zeros(len(own.n)))

    return run


def answering(turn: int, t: Totals | None):
    """Messages to the sums over all parts, for each part in the order that it asked in, and the totals of a bucket (part -1).
    After round 0 words come with their tables in the parent."""

    def summed(keys: list[np.ndarray], tables: list[np.ndarray], n: list[np.ndarray]) -> tuple:
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        tables, n = (np.bincount(at, weights=np.concatenate(x), minlength=len(unique)).astype(np.int64) for x in (tables, n))
        return unique, tables, n, np.split(at, np.cumsum([len(x) for x in keys])[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_part(batches):
            parts, held = zip(*((deal, unpacked(data, *[np.uint64] * 6)) for _, _, deal, data in rows), strict=True)
            sides = list(zip(*held, strict=True))
            words, tables, n, asked = summed(*sides[:3])
            _, seats, guests, contexts = summed(*sides[3:])
            heads = n if t is None else heads_of(tables, t.parent, Hashed(tk.mix(words + np.uint64(1000 + turn))))
            deal = (turn << 32) + bucket
            for part, w, c in zip(parts, asked, contexts, strict=True):
                data = packed(*(x.astype(np.uint64) for x in (tables[w], heads[w], seats[c], guests[c])))
                yield batch_of([(part, 1, deal, data, *[0] * 7)], ANSWERED)
            yield batch_of([(-1, 1, deal, b"", *(int(x) for x in (tables.sum(), (tables > 0).sum(), *few(tables), heads.sum(), (n > 0).sum(), n.sum())))], ANSWERED)

    return run


def scoring(common: np.ndarray, t: Totals, before: list[Totals], parent_customers: list[int], parent_tables: list[int], train_tokens: int):
    """Pairs, sums and tokens of each part to sums by row of each deal; ids of rows pass."""

    def scores(own: Part, sums: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(sorted keys of pairs, score, base score, known)."""
        total, guests, n = 0.0, sums[0][3][own.ci], sums[0][1]
        key = pair_keys(own.contexts[own.ci], own.words[own.wi])
        for s in range(SAMPLES):
            turn = SWEEPS - 1 + s
            tables = own.tables(sums[turn][2], sums[turn][0], before[s], turn)
            customers, heads, seats, _ = sums[turn + 1]
            total = total + predictive_of(own.n, tables, seats[own.ci], guests, customers[own.wi], heads[own.wi], t, parent_customers[s], parent_tables[s])
        base = np.log10((n + 0.1) / (train_tokens + 0.1 * (t.vocabulary + 1)))
        order = np.argsort(key)
        return key[order], np.log10(total / SAMPLES)[order], base[own.wi][order], (n > 0)[own.wi][order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(common)
        for _, rows in by_part(batches):
            own = None
            for kind, each in groupby(rows, key=lambda row: row[1]):
                if kind == 0:
                    own = Part(next(each)[3])
                elif kind == 1:
                    key, score, base, known = scores(own, sums_of(each))
                    own = None
                else:
                    for _, _, deal, data in each:
                        if kind == 3:
                            context, word, row, run_of = dealt_tokens(codes, data, np.uint32, np.uint32)
                            at, first = np.searchsorted(key, pair_keys(context, word)), np.cumsum(run_of, dtype=np.int64) - run_of
                            data = packed(row, *(np.add.reduceat(x[at], first, dtype=k) for x, k in ((known, np.uint32), (base, np.float64), (score, np.float64))))
                        yield batch_of([(0, kind, deal, data)], PACKED)

    return run


def adding_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by row of each deal, after the ids of its rows, to SUMS."""
    for _, rows in groupby(rows_of(batches), key=lambda row: row[2]):
        ids, null, held, n = unpacked(next(rows)[3], np.int64, bool, bool, np.int64)
        sums = np.zeros((3, len(ids)))
        for *_, data in rows:
            row, *more = unpacked(data, np.uint32, np.uint32, np.float64, np.float64)
            sums[:, row] += np.stack(more)
        columns = [pa.array(ids, mask=null), pa.array(held), pa.array(n), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SUMS.split(", ")])


def score_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each document."""
    documents = tk.only(documents, "doc_id", "text")
    with tk.settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        rows, train_tokens = scored(spark, documents)
    n = F.lit(train_tokens).cast("long").alias("train_tokens")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", n, "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def scored(spark: SparkSession, documents: DataFrame) -> tuple[DataFrame, int]:
    """(rows of SUMS, training tokens); what a round shuffled goes when its sums are written."""
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(8, -(-size // PART_BYTES))
    buckets = max(8, parts // BUCKET_PARTS)
    common = common_tokens(documents)
    kinds = [x.split()[0] for x in PACKED.split(", ")]
    pairs = tk.materialize(spark, sent(documents.mapInArrow(dealing(common, parts, False), PACKED), parts).mapInArrow(pairing(common), PAIRED), "pairs")
    one, two = pairs.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("one", "two"))).first()

    def answered(messages: DataFrame, turn: int, t: Totals | None) -> tuple[DataFrame, tuple]:
        table = tk.materialize(spark, sent(messages, buckets).mapInArrow(answering(turn, t), ANSWERED), "sums")
        totals = table.where("part < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("customers", "dishes", "one", "two", "heads", "words", "tokens"))).first()
        return table, totals

    rounds = [answered(pairs.mapInArrow(beginning(buckets), PACKED), 0, None)]
    *_, vocabulary, train_tokens = rounds[0][1]
    drawn_by = []

    def given(*turns: int) -> DataFrame:
        found = pairs.select(*kinds)
        for k in turns:
            found = found.unionByName(rounds[k][0].where("part >= 0").select(*kinds))
        return found

    def totals_of(turn: int) -> Totals:
        customers, dishes, *dishes_of, _, _, _ = rounds[turn][1]
        return Totals(customers, dishes, vocabulary, discount_of(one, two), discount_of(*dishes_of))

    for sweep in range(SWEEPS + SAMPLES - 1):
        drawn_by.append(totals_of(sweep))
        rounds.append(answered(sent(given(sweep), parts).mapInArrow(sweeping(drawn_by[-1], sweep, buckets), PACKED), sweep + 1, drawn_by[-1]))
        if 0 < sweep < SWEEPS - 1:
            tk.discard(spark, rounds[sweep][0])
    last = [stats for _, stats in rounds[SWEEPS:]]
    everything = given(0, *range(max(SWEEPS - 1, 1), SWEEPS + SAMPLES)).unionByName(documents.mapInArrow(dealing(common, parts, True), PACKED))
    by_row = sent(everything, parts).mapInArrow(scoring(common, totals_of(-1), drawn_by[SWEEPS - 1 :], [x[0] for x in last], [x[4] for x in last], train_tokens), PACKED)
    rows = tk.materialize(spark, by_row.repartition("deal").sortWithinPartitions("deal", "kind").mapInArrow(adding_up, SUMS), "scores")
    tk.discard(spark, pairs, *(table for table, _ in rounds))
    return rows, train_tokens


def op7_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, tk.table(spark, sf_dir, "documents"))
