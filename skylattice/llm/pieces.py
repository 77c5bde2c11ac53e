"""SentencePiece encoding by batched Viterbi, and decoding, over a published vocabulary file.

A text is escaped as the vocabulary asks (one mark before it and for every space) and falls into
units at runs of marks and line feeds, which no piece crosses. The hashes of all substrings of a length of
a block's distinct units probe the sorted keys of the pieces together, and only those that are pieces are tried: the units
advance by one code point at a time, side by side, and the vectorised maximum of the path scores wins. A long
unit advances alone, stretch by stretch. The longer piece wins ties. The lone mark,
which the file may rule out as a merge, counts one less than the worst piece. A code point that no piece covers
costs ten more than the worst piece and becomes its UTF-8 bytes' pieces.

The result is the segmentation of greatest total score. That is what this decoding is for; the
vocabulary's own merge order can differ from it. Decoding gives the text back, with the mark
character itself read as a space.

Defined results: a null or empty text is the lone mark's piece and decodes to the empty text;
repeated rows and null ids are encoded each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk

VOCABULARY = "piece_bpe_32k.model"
MARK, LINE_FEED = 0x2581, 0x0A
UNKNOWN_COST = 10.0
#: Layout only: code points beyond which a unit advances alone; code points of it that are looked at together, and of other units.
LONG, STRETCH, TOGETHER = 400, 50_000, 500_000
#: Leading bits of a hash that tell most substrings from all pieces.
SEEN_BITS = 20
DIGEST = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean"


class Vocabulary:
    """Sorted keys of the pieces with their scores and ids, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        words = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        raw, usable = [], []
        for i, word in enumerate(words):
            if model.is_byte(i):
                self.byte_id[int(word[3:-1], 16)] = i
                raw.append(bytes([int(word[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                raw.append(word.replace(chr(MARK), " ").encode())
                usable.append(i)
        points, offsets = code_points([words[i] for i in usable])
        keys = tk.Block(points, offsets).spans(offsets[:-1], offsets[1:])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable)[order]
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - SEEN_BITS)] = True
        self.scores = np.array([model.get_score(i) for i in usable], float)[order]
        if any(chr(MARK) in words[i].lstrip(chr(MARK)) or "\n" in words[i][1:] for i in usable):
            raise ValueError("a piece crosses the start of a unit")
        self.unknown = float(self.scores.min()) - UNKNOWN_COST
        self.longest = int(np.diff(offsets).max())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_end = np.cumsum([len(x) for x in raw])
        self.raw_length = np.array([len(x) for x in raw])


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), offsets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def probed(hashes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are pieces, and where those are among the keys."""
    maybe = np.flatnonzero(v.seen[hashes >> np.uint64(64 - SEEN_BITS)])
    at = np.minimum(np.searchsorted(v.keys, hashes[maybe]), len(v.keys) - 1)
    hit = v.keys[at] == hashes[maybe]
    return maybe[hit], at[hit]


def best_paths(block: tk.Block, starts: np.ndarray, length: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, place from the end, token) of the best segmentation of units, none empty; -1 - code point where no piece fits.

    Nodes are numbered by their distance from the start of their unit, then by unit, longest first, so those of one distance are
    one stretch. The pieces that occur are found length by length, and all units advance by one code point together."""
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    n = len(starts) - np.searchsorted(length[::-1], np.arange(length[0] + 1))  # units that have a node so far from their start
    level = np.concatenate([[0], np.cumsum(n)])
    unit, at = ragged(np.zeros(len(n) - 1, np.int64), n[1:]), np.repeat(np.arange(len(n) - 1), n[1:])
    left, ends, begins, scores, tokens = length[unit] - at, [], [], [], []
    for size in range(1, min(v.longest, int(length[0])) + 1):
        if size > 1:
            kept = left >= size
            unit, at, left = unit[kept], at[kept], left[kept]
        first = starts[unit] + at
        k, key = probed(block.spans(first, first + size), v)
        score, token = v.scores[key], v.ids[key]
        if size == 1:
            score, token = np.full(len(unit), v.unknown), -1 - block.data[first].astype(np.int64)
            score[k], token[k] = v.scores[key], v.ids[key]
            k = np.arange(len(unit))
        ends.append(level[at[k] + size] + unit[k])
        begins.append(level[at[k]] + unit[k])
        scores.append(score)
        tokens.append(token)
    end = np.concatenate(ends)
    by_end = np.argsort(end, kind="stable")  # shorter pieces first
    end, begin, score, token = (np.concatenate(x)[by_end] for x in (ends, begins, scores, tokens))
    runs = np.append(np.flatnonzero(np.diff(end, prepend=-1)), len(end))
    best, chosen = np.zeros(level[-1]), np.zeros(level[-1], np.int64)
    for e in range(1, len(n)):
        low, high = level[e], level[e + 1]
        a, b = runs[low - n[0]], runs[high - n[0]]
        total = score[a:b] + best[begin[a:b]]
        best[low:high] = np.maximum.reduceat(total, runs[low - n[0] : high - n[0]] - a)
        top = a + np.flatnonzero(total == best[end[a:b]])
        chosen[end[top]] = top  # of equal ones the last stays
    units, places, found = [], [], []
    live, where, step = np.arange(len(starts)), level[length] + np.arange(len(starts)), 0
    while len(live):
        units.append(live)
        places.append(np.full(len(live), step))
        found.append(token[chosen[where]])
        where = begin[chosen[where]]
        live, where = live[where >= n[0]], where[where >= n[0]]
        step += 1
    return order[np.concatenate(units)], np.concatenate(places), np.concatenate(found)


def matches(points: np.ndarray, base: int, low: int, high: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, size, score, token) of every piece that ends past `low` and at `high` at most, and of every code point, in order of end
    and size. points begins at `base`; each length's substrings are hashed and probed together."""
    block, found = tk.Block(points, np.array([0, len(points)])), []
    for size in range(1, v.longest + 1):
        ends = np.arange(max(low + 1, size), high + 1)
        if not len(ends):
            break
        hashes = block.spans(ends - size - base, ends - base)
        at = np.minimum(np.searchsorted(v.keys, hashes), len(v.keys) - 1)
        hit = v.keys[at] == hashes
        score, token = np.where(hit, v.scores[at], v.unknown), np.where(hit, v.ids[at], -1 - points[ends - size - base].astype(np.int64))
        kept = slice(None) if size == 1 else hit
        found.append((ends[kept], np.full(len(ends), size)[kept], score[kept], token[kept]))
    ends, size, score, token = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((size, ends))
    return ends[order], size[order], score[order], token[order]


def long_path(points: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Tokens of the best segmentation of one long unit, as best_paths finds it, last one first: a stretch at a time the pieces
    that occur are found, and only those are tried."""
    length = len(points)
    best, back, chosen = [0.0] * (length + 1), np.zeros(length + 1, np.int16), np.zeros(length + 1, np.int64)
    for low in range(0, length, STRETCH):
        high = min(length, low + STRETCH)
        base = max(0, low + 1 - v.longest)
        end, size, score, token = matches(points[base:high], base, low, high, v)
        sizes, picked = np.zeros(high - low, np.int16), np.zeros(high - low, np.int64)
        now, top, pick = low + 1, -np.inf, 0
        for k, (e, z, s) in enumerate(zip(end.tolist(), size.tolist(), score.tolist(), strict=True)):
            if e != now:
                best[now], picked[now - low - 1] = top, pick
                now, top = e, -np.inf
            s += best[e - z]
            if s >= top:
                top, pick = s, k
        best[now], picked[now - low - 1] = top, pick
        sizes[:], chosen[low + 1 : high + 1] = size[picked], token[picked]
        back[low + 1 : high + 1] = sizes
    at, tokens = length, []
    step = back.tolist()
    while at:
        tokens.append(at)
        at -= step[at]
    return chosen[np.array(tokens, np.int64)]


def with_bytes(tokens: np.ndarray, owner: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with each uncovered code point replaced by its bytes' pieces."""
    rare = np.flatnonzero(tokens < 0)
    if not len(rare):
        return tokens, owner
    encoded = [chr(-1 - int(t)).encode() for t in tokens[rare]]
    times = np.ones(len(tokens), np.int64)
    times[rare] = [len(e) for e in encoded]
    out = np.repeat(tokens, times)
    out[out < 0] = v.byte_id[np.frombuffer(b"".join(encoded), np.uint8)]
    return out, np.repeat(owner, times)


def encode_texts(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
    points, offsets = code_points([chr(MARK) + t.replace(" ", chr(MARK)) for t in texts])
    block = tk.Block(points, offsets)
    feed = points == LINE_FEED
    opens = (points == MARK) | feed
    opens[1:] &= (points[:-1] != MARK) | feed[1:]  # a run of marks stays with what follows it
    opens[1:] |= feed[:-1]
    opens[offsets[:-1]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(points))
    _, first, unit = np.unique(block.apart(starts, ends), return_index=True, return_inverse=True)
    starts_, length = starts[first], (ends - starts)[first]
    parts = []
    for k in np.flatnonzero(length > LONG).tolist():
        tokens = long_path(points[starts_[k] : starts_[k] + length[k]], v)
        parts.append((np.full(len(tokens), k), np.arange(len(tokens)), tokens))
    short = np.flatnonzero(length <= LONG)
    for rows in np.split(short, np.flatnonzero(np.diff(np.cumsum(length[short]) // TOGETHER)) + 1):
        if len(rows):
            units, places, tokens = best_paths(block, starts_[rows], length[rows], v)
            parts.append((rows[units], places, tokens))
    owner, place, token = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((-place, owner))
    token, owner = with_bytes(token[order], owner[order], v)
    count = np.bincount(owner, minlength=len(first))
    begin = np.cumsum(count) - count
    ids = token[ragged(begin[unit], count[unit])]
    total = np.concatenate([[0], np.cumsum(count[unit])])
    return ids.astype(np.int32), total[np.searchsorted(starts, offsets)]


def decode_ids(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[bytes]:
    """UTF-8 of each run of ids, without the mark before it."""
    length = v.raw_length[ids]
    data = v.raw[ragged(v.raw_end[ids] - length, length)].tobytes()
    at = np.concatenate([[0], np.cumsum(length)])[offsets]
    return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encoding(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                ids, offsets = encode_texts([t or "" for t in part.column("text").to_pylist()], vocabulary(name))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def decoding(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x if x is not None else [], np.int64) for x in batch.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            ids = np.concatenate([*lists, np.zeros(0, np.int64)])
            texts = [x.decode(errors="replace") for x in decode_ids(ids, offsets, vocabulary(name))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def round_trips(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, offsets = encode_texts(texts, vocabulary(name))
                back = decode_ids(ids, offsets, vocabulary(name))
                runs = [ids[a:b].astype("<u4") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(x.tobytes()) for x in runs], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                        pa.array([x == t.replace(chr(MARK), " ").encode() for x, t in zip(back, texts, strict=True)], pa.bool_()),
                    ],
                    [x.split()[0] for x in DIGEST.split(", ")],
                )

    return run


def encode(documents: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each document."""
    return tk.only(documents, "doc_id", "text").mapInArrow(encoding(name), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of each list of ids; null ids give the empty text."""
    return tk.only(encoded, "doc_id", "ids").mapInArrow(decoding(name), "doc_id long, text string")


def encode_and_decode(documents: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """DIGEST of each document: how many ids, their checksum, the decoded text's hash, and whether it is the text."""
    return tk.only(documents, "doc_id", "text").mapInArrow(round_trips(name), DIGEST)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(tk.table(spark, sf_dir, "documents"))
