"""Alignment of the tokens of two tokenizers, a byte-level one (A) and a sentence-piece one (B).

A reads a space and the text, B the text, to which it adds the space itself. Character offsets of A and
the spans of B's immutable pieces are the coarse cuts. A cut stands where it agrees with the bytes of
the tokens up to there; after the last that does, the tokens' own decoded bytes give the ends, which
refines tokens that split a character and byte-fallback pieces. Where a token of either ends at the
same byte, a group ends.

Neither tokenizer looks across a space between two characters that are no white space, nor past a letter that a
mark follows where no piece of B holds the two, nor past a mark or letter and a single line end. What stands
between such places, a unit, has the same tokens and groups wherever it stands. A task cuts texts into
units, told by 64 bits of hash, and encodes each unit once a part (PART_BYTES of text), many in one call.
A pair of ids is counted by documents in each part; Spark adds the parts up, finds the highest count of
each id of A, and sends each part the counts of its own pairs. Nothing but these counts leaves a part, and
a part is bounded, so no pair or id gathers rows in one task.

Defined results: a null or empty text, or one whose tokens of A or B do not join to its bytes (B writes
U+2581 as a space), has no tokens: zeros and an empty digest. Repeated rows and ids count as documents of
their own; a null id is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

VOCABULARY, MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Layout only: bytes of text of a part; of units encoded in one call; links of a group that are listed one by one; units of documents counted at once; pairs or links of a row (large values cost a JVM much memory).
PART_BYTES, CALL_BYTES, LISTED, AT_ONCE, ROWS_EACH = 12_000_000, 2_000, 4096, 100_000, 20_000
PARTS = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, base int, keys array<long>, held array<int>, links binary"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: A letter for units that begin with a mark or a line end to follow, as in the text.
LEAD = b" a"
#: Links in binary: numbers of units, places of pairs, how often.
LINK = ("<i4", "<i4", "<i8")
GROUPS = "doc_id long, groups array<struct<start: long, stop: long, a: array<int>, b: array<int>>>"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def refined(coarse: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: coarse ends that agree with the bytes of all tokens up to there stand; from the last one on, tokens' own bytes count."""
    total = np.cumsum(size)
    last = np.maximum.accumulate(np.where(coarse == total, np.arange(1, len(size) + 1), 0))
    return np.append(0, coarse)[last] + total - np.append(0, total)[last]


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, vocabulary: str, model: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        alphabet, special = byte_alphabet(), set(self.a.get_added_tokens_decoder())
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = token.encode() if k in special else bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (np.array([str(k) for k in range(len(side))], object) for side in (self.a_bytes, self.b_bytes))
        #: Whether no piece goes on after a space that follows another character; otherwise texts are not cut.
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        #: By first byte, what units begin with besides a space: marks that no piece has after a letter, a line end that none has.
        after_letter = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        self.heads = np.array([k < 0x80 and (chr(k) in string.punctuation and chr(k) not in after_letter) for k in range(256)])
        self.heads[0x0A] = not any("\n" in p for p in pieces)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and their ends in bytes, ids of B and theirs, over a space and the text; None where either's bytes are others."""
        whole = b" " + text.encode()
        data = np.frombuffer(whole, np.uint8)
        found = self.a.encode(whole.decode(), add_special_tokens=False)
        ids = found.ids
        a = np.array(ids, np.int64)
        characters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        a_ends = refined(characters[np.array([end for _, end in found.offsets], np.int64)], self.a_size[a])
        pieces = [(p.id, p.end) for p in self.b.encode(text, return_type="proto").pieces]
        b, ends = np.array(pieces, np.int64).reshape(-1, 2).T
        b_ends = refined(ends + 1, self.b_size[b])
        if b"".join([self.a_bytes[k] for k in ids]) != whole or b"".join([self.b_bytes[k] for k, _ in pieces]) != whole:
            return None
        return a, a_ends, b, b_ends


@lru_cache(maxsize=2)
def loaded(vocabulary: str, model: str) -> Tokenizers:
    return Tokenizers(vocabulary, model)


def cut_units(block: tk.Block, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every unit, in a block of texts that each begin with a space, and whether it can stand
    beside others: it begins and ends like a unit amid a text. heads: bytes besides a space that begin units. White
    space is told by its first byte, widely: next to a character of a class that holds some there is no cut."""
    data = block.data
    plain = (data > 0x20) & (data < 0x7F)
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    first = ((data >= 0xC3) & (data <= 0xDF)) | (data == 0xE0) | (data >= 0xE4)
    inner = (data & 0xC0) == 0x80

    def before(at: np.ndarray) -> np.ndarray:
        """Whether the character that ends at a place is surely no white space."""
        one, two, three, four = (np.maximum(at - k, 0) for k in (1, 2, 3, 4))
        return plain[one] | (inner[one] & (first[two] | (inner[two] & (first[three] | (inner[three] & first[four])))))

    after = np.append((plain | first)[1:], False)
    spaces = np.flatnonzero((data == 0x20) & after)
    marks = np.flatnonzero(heads[data] & ((data != 0x0A) | after))
    marks = marks[letter[marks - 1] | ((data[marks] == 0x0A) & plain[marks - 1])]  # a text begins with a space, so there is a byte before
    place = np.zeros(len(data), bool)
    place[block.offsets[:-1]] = True
    place[spaces[before(spaces)]] = True
    place[marks] = True
    starts = np.flatnonzero(place)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(block.offsets, starts, "right") - 1, (after[starts] | (plain[starts] & heads[data[starts]])) & before(ends)


class Part:
    """Units of a part in the order they were met, with their numbers, digests and links."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.number: dict[int, int] = {}
        self.counts: list[np.ndarray] = []  # tokens of A and B, groups, links of each unit
        self.good: list[bool] = []
        self.texts: list[str] = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, pair of ids, how often

    def learn(self, units: list[bytes], joins: list[bool]) -> None:
        """Encodes new units: those that can stand beside others together, the rest alone."""
        held, size = [], 0
        for unit, free in zip(units, joins, strict=True):
            if held and (not free or size + len(unit) > CALL_BYTES):
                self.encode(held)
                held, size = [], 0
            held.append(unit)
            size += len(unit)
            if not free:
                self.encode(held)
                held, size = [], 0
        if held:
            self.encode(held)

    def encode(self, units: list[bytes]) -> None:
        """Units that may stand side by side; one that begins with no space has LEAD before it, which does not count."""
        spread = [x for u in units for x in ((u,) if u[:1] == b" " else (LEAD, u))]
        found = self.t.tokens(b"".join(spread)[1:].decode())
        if found is None and len(units) > 1:
            self.encode(units[: len(units) // 2])
            self.encode(units[len(units) // 2 :])
            return
        if found is None:
            self.counts.append(np.zeros((1, 4), np.int64))
            self.good.append(False)
            self.texts.append("")
            return
        a, a_ends, b, b_ends = found
        ends = np.cumsum([len(u) for u in spread])
        cuts = a_ends[b_ends[np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)] == a_ends]
        in_a, in_b, unit = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), np.searchsorted(ends, cuts)
        n_a, n_b = np.bincount(in_a, minlength=len(cuts)), np.bincount(in_b, minlength=len(cuts))
        texts = self.written(a, b, in_a, in_b, n_a, n_b, unit, len(spread))
        real = np.array([x is not LEAD for x in spread], bool)
        base, number = len(self.good), np.cumsum(real) - 1
        sums = (np.bincount(unit, x, len(spread)).astype(np.int64) for x in (n_a, n_b, np.ones(len(cuts)), n_a * n_b))
        self.counts.append(np.stack(list(sums), 1)[real])
        self.good += [True] * len(units)
        self.texts += [t for t, r in zip(texts, real.tolist(), strict=True) if r]
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        counts = real[unit]
        listed = np.flatnonzero(counts & (n_a * n_b <= LISTED))
        many = (n_a * n_b)[listed]
        group = np.repeat(listed, many)
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key = (a[first_a[group] + rank // n_b[group]] << 32) | b[first_b[group] + rank % n_b[group]]
        self.links.append(((base + number[unit[group]]).astype(np.int32), key, np.ones(len(key), np.int32)))
        for g in np.flatnonzero(counts & (n_a * n_b > LISTED)):
            (ua, ca), (ub, cb) = (np.unique(ids[f[g] : f[g] + m[g]], return_counts=True) for ids, f, m in ((a, first_a, n_a), (b, first_b, n_b)))
            key = ((ua[:, None] << 32) | ub).ravel()
            self.links.append((np.full(len(key), base + number[unit[g]], np.int32), key, np.outer(ca, cb).ravel()))

    def written(self, a, b, in_a, in_b, n_a, n_b, unit, n) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each unit."""
        before_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
        out = np.empty(len(a) + len(b), object)
        place_a, place_b = np.arange(len(a)) + before_b[in_a], np.arange(len(b)) + before_a[in_b]
        last_a, last_b = np.append(in_a[1:] != in_a[:-1], True), np.append(in_b[1:] != in_b[:-1], True)
        out[place_a] = self.t.a_text[a] + np.where(last_a, "|", ",").astype(object)
        out[place_b] = self.t.b_text[b] + np.where(last_b, ";", ",").astype(object)
        edges = np.append(0, np.cumsum(np.bincount(unit, n_a + n_b, n).astype(np.int64)))
        pieces = out.tolist()
        return ["".join(pieces[i:j])[:-1] for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def units_of(self, block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
        """(text, unit) of every unit of a block of texts that begin with a space."""
        if self.t.parted:
            starts, ends, owner, joins = cut_units(block, self.t.heads)
        else:
            starts, ends, owner, joins = block.offsets[:-1], block.offsets[1:], np.arange(block.n), np.zeros(block.n, bool)
        unique, first, back = np.unique(block.apart(starts, ends), return_index=True, return_inverse=True)
        keys = unique.tolist()
        number = np.array([self.number.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(number < 0)
        new = new[np.argsort(first[new])]
        number[new] = np.arange(len(self.number), len(self.number) + len(new))
        self.number.update(zip(unique[new].tolist(), number[new].tolist(), strict=True))
        where, data = first[new], block.data.tobytes()
        self.learn([data[i:j] for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], joins[where].tolist())
        return owner, number[back]

    def closed(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of the part, in how many documents each is, and links (unit, place of the pair, how often) by unit."""
        unit, key, often = (np.concatenate([x[k] for x in self.links]) if self.links else np.zeros(0, np.int32) for k in range(3))
        self.links = []
        order = np.argsort(unit, kind="stable")
        unit, often, key = unit[order], often[order], key[order]
        del order
        keys = distinct(key)
        place = np.searchsorted(keys, key).astype(np.int32)
        del key
        edges = np.searchsorted(unit, np.arange(len(self.good) + 1))
        held = np.zeros(len(keys), np.int64)
        for some in at_once(documents):
            document = np.repeat(np.arange(len(some)), [len(x) for x in some])
            seen = distinct(document * len(self.good) + np.concatenate(some))
            document, u = np.divmod(seen, len(self.good))
            n = edges[u + 1] - edges[u]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - edges[u], n)
            pair = distinct(np.repeat(document, n) * len(keys) + place[at])
            held += np.bincount(pair % len(keys), minlength=len(keys))
        return keys.astype(np.int64), held, (unit, place, often)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; by sorting, as that is faster here than by a table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def at_once(documents: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for x in documents:
        if len(x):
            held.append(x)
            size += len(x)
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def spaced(block: tk.Block) -> tk.Block:
    """The block's texts, each after a space."""
    return tk.Block(np.insert(block.data, block.offsets[:-1], 0x20), block.offsets + np.arange(block.n + 1))


def batch_of(rows: int, **columns) -> pa.RecordBatch:
    """A batch of PARTS; columns that are not given are null."""
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    arrays, names = [], []
    for column in PARTS.split(", "):
        name, kind = column.split()
        kind = kinds.get(kind, pa.int64())
        arrays.append(pa.nulls(rows, kind) if name not in columns else pa.array(columns[name], kind) if not isinstance(columns[name], pa.Array) else columns[name])
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def parting(vocabulary: str, model: str):
    """Texts to PARTS: the documents of each part, then its pairs and links."""

    def closing(number: int, part: Part, documents: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, held, links = part.closed(documents)
        for k in range(0, len(keys), ROWS_EACH):
            yield batch_of(1, part=[number], base=[k], keys=[keys[k : k + ROWS_EACH]], held=[held[k : k + ROWS_EACH].astype(np.int32)])
        for k in range(0, max(1, len(links[0])), ROWS_EACH):
            yield batch_of(1, part=[number], base=[k], links=[b"".join(x[k : k + ROWS_EACH].astype(kind).tobytes() for x, kind in zip(links, LINK, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        part, documents, size = Part(loaded(vocabulary, model)), [], 0
        for batch in batches:
            for rows in tk.slices(batch, "text"):
                if size >= PART_BYTES:
                    yield from closing(number, part, documents)
                    number, part, documents, size = number + 1, Part(part.t), [], 0
                block = tk.string_block(rows.column("text"))
                size += len(block.data)
                owner, unit = part.units_of(spaced(block))
                counts, good = np.concatenate(part.counts), np.array(part.good)
                part.counts = [counts]
                edges = np.searchsorted(owner, np.arange(block.n + 1))
                bad = np.bincount(owner, ~good[unit], block.n) > 0
                bad |= np.diff(block.offsets) == 0
                sums = np.zeros((block.n, 4), np.int64)
                np.add.at(sums, owner, counts[unit])
                sums[bad] = 0
                lists = [unit[i:j] if not b else unit[:0] for i, j, b in zip(edges[:-1], edges[1:], bad, strict=True)]
                digests = [hashlib.sha256(";".join([part.texts[k] for k in x.tolist()]).encode()).hexdigest() if len(x) else "" for x in lists]
                documents += lists
                yield batch_of(block.n, part=np.full(block.n, number), doc_id=rows.column("doc_id"), n_a=sums[:, 0], n_b=sums[:, 1], n_groups=sums[:, 2], n_links=sums[:, 3], groups_sha256=digests, units=[x.astype("<i4").tobytes() for x in lists])
        if documents:
            yield from closing(number, part, documents)

    return run


def counted(_, left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a part with what the counts of its pairs add up to."""
    left = left.combine_chunks()
    links = [x.as_py() for x in left.column("links").drop_null()]
    unit, place, often = (np.concatenate([np.frombuffer(x, kind, len(x) // 16, 4 * k * (len(x) // 16)) for x in links]) for k, kind in enumerate(LINK))
    size = int(unit.max(initial=-1)) + 1
    count, best = np.zeros((2, int(place.max(initial=-1)) + 1), np.int64)
    at = right.column("place").to_numpy()
    count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
    total, top = np.zeros((2, size), np.int64)
    np.add.at(total, unit, often * count[place])
    np.add.at(top, unit, often * best[place])
    rows = left.filter(left.column("units").is_valid())
    units = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("units")]
    sums = {"n_best": pa.array([int(top[u].sum()) for u in units], pa.int64()), "count_sum": pa.array([int(total[u].sum()) for u in units], pa.int64())}
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pa.table([sums[n] if n in sums else rows.column(n) for n in names], names)


def documents_of(table: DataFrame) -> DataFrame:
    return tk.only(table, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def pair_counts(parts: DataFrame) -> DataFrame:
    """(key, count, best): each pair of ids, a << 32 | b, the documents that hold it linked, and 1 where no pair of its id of A is in more."""
    counts = pair_rows(parts).groupBy("key").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("key", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(highest, "a").select("key", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def pair_rows(parts: DataFrame) -> DataFrame:
    """(part, place, key, n) of the pairs of every part."""
    rows = parts.where("keys is not null").select("part", "base", F.posexplode(F.arrays_zip("keys", "held")).alias("k", "pair"))
    return rows.select("part", (F.col("base") + F.col("k")).alias("place"), F.col("pair.keys").alias("key"), F.col("pair.held").cast("long").alias("n"))


def aligned_parts(spark: SparkSession, documents: DataFrame, vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    return tk.materialize(spark, documents_of(documents).mapInArrow(parting(vocabulary, model), PARTS), "aligned")


def alignment_digests(spark: SparkSession, documents: DataFrame, vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """DIGESTS of every document: sizes, links, and links by the corpus-wide counts of their pairs."""
    parts = aligned_parts(spark, documents, vocabulary, model)
    counts = pair_rows(parts).join(pair_counts(parts), "key").select(F.col("part").alias("of_part"), "place", "count", "best")
    rows = parts.where("keys is null")
    return rows.groupBy("part").cogroup(counts.groupBy("of_part")).applyInArrow(counted, DIGESTS)


def token_groups(documents: DataFrame, vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """GROUPS of every document: bytes of a space and the text that each group covers, with its ids of A and B; none where there are no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(vocabulary, model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for rows in tk.slices(batch, "text"):
                groups = []
                for text in rows.column("text").to_pylist():
                    found = t.tokens(text) if text else None
                    groups.append([])
                    if found is not None:
                        a, a_ends, b, b_ends = found
                        cuts = np.intersect1d(a_ends, b_ends)
                        sides = [np.split(ids, np.searchsorted(ends, cuts, "right")[:-1]) for ids, ends in ((a, a_ends), (b, b_ends))]
                        groups[-1] = [{"start": int(i), "stop": int(j), "a": x.tolist(), "b": y.tolist()} for i, j, x, y in zip(np.append(0, cuts[:-1]), cuts, *sides, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(groups, kind)], ["doc_id", "groups"])

    return documents_of(documents).mapInArrow(run, GROUPS)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(spark, tk.table(spark, sf_dir, "documents"))
