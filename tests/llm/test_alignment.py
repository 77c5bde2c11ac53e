"""Cross-tokenizer alignment against plain Python over whole texts: groups, links, counts, digests."""

from __future__ import annotations

import collections
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skylattice.llm import alignment
from skylattice.llm import textkit as tk

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  ", "word", " word", "two  spaces and\ttabs \n\n lines\n", "naïve 日本語 𝄞 a\u0085b", "a b c　d e  f", "it's we'll 's 'S don't",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a ▁b ▁ c▁ d", "▁", "  x y", "é è́ ñ ß" * 20, "x" * 3000, "𝄞" * 50, "123 4567 89,012.5", "end ", "\x00 nul \x1c sep \x7f del", "“quoted” — dash…  ", "日本 語　 テ スト",
]


def texts() -> list:
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéonß,.") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    signs = [chr(c) for c in (*range(0x00, 0x30), 0x85, 0xA0, 0x2003, 0x2019, 0x3000, 0x2581, 0xFEFF, 0x1F600, 0x4E2D, 0xE9)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    noise = ["".join(rng.choice([*signs, *words]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    return [*ODD, *prose, prose[0], prose[0], *noise]


@functools.cache
def level_bytes(token: str) -> bytes:
    """By the published rule of byte-level vocabularies."""
    plain = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    decode, k = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            decode[chr(256 + k)] = b
            k += 1
    return bytes(decode[c] for c in token)


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.VOCABULARY))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.MODEL))

    def groups(text: str | None) -> list[tuple[list[int], list[int]]]:
        if not text:
            return []
        whole = (" " + text).encode()
        sides = [[(k, level_bytes(a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]]
        sides.append([(k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()) for k in b.encode(text) for p in [b.id_to_piece(k)]])
        if any(b"".join(x for _, x in side) != whole for side in sides):
            return []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in sides]
        out = [([], [])]
        cuts, sides = set(ends[0]) & set(ends[1]), [[k for k, _ in side] for side in sides]
        for at, side, k in sorted((e, s, k) for s in (0, 1) for e, k in zip(ends[s], range(len(ends[s])), strict=True)):
            out[-1][side].append(sides[side][k])
            if at in cuts and side == 1:
                out.append(([], []))
        return out[:-1]

    return groups


def digests(all_groups: list) -> list[tuple]:
    links = [[(x, y) for a, b in g for x in a for y in b] for g in all_groups]
    held = collections.Counter(p for one in links for p in set(one))
    top: dict[int, int] = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for g, one in zip(all_groups, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(one), sum(held[p] == top[p[0]] for p in one), sum(held[p] for p in one), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return out


def test_alignment_matches_brute_force_on_whole_texts(spark, brute, monkeypatch):
    """Parts, calls and lists of any size give the same rows; ids that are null or repeat count as documents."""
    rows = [(None if i == 30 else min(i, 40), t, "x", 5) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string, n_best int").repartition(3)
    expected = collections.Counter((i, *d) for (i, *_), d in zip(rows, digests([brute(t) for _, t, *_ in rows]), strict=True))
    assert sum(d[1] > 0 for d in expected) > 100 and sum(d[-1] == "" for d in expected) >= 3
    for part, call, listed, once in ((alignment.PART_BYTES, alignment.CALL_BYTES, alignment.LISTED, alignment.AT_ONCE), (4_000, 60, 2, 50)):
        for name, value in (("PART_BYTES", part), ("CALL_BYTES", call), ("LISTED", listed), ("AT_ONCE", once)):
            monkeypatch.setattr(alignment, name, value)
        found = alignment.alignment_digests(spark, df).collect()
        assert collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found) == expected


def test_small_parts_are_met_in_one_task(brute, monkeypatch):
    """The parts of one task, without Spark: several of them, each with its own numbers."""

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 1

    monkeypatch.setattr(alignment, "TaskContext", Task)
    monkeypatch.setattr(alignment, "PART_BYTES", 3_000)
    monkeypatch.setattr(tk, "BLOCK_BYTES", 500)
    monkeypatch.setattr(tk.slices, "__defaults__", (500,))
    some = texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(some, pa.string())], ["doc_id", "text"])
    out = pa.Table.from_batches(list(alignment.parting(alignment.VOCABULARY, alignment.MODEL)(iter([batch])))).to_pylist()
    assert len({r["part"] for r in out}) > 2
    pairs = collections.Counter()
    for r in out:
        for key, n in zip(r["keys"] or [], r["held"] or [], strict=True):
            pairs[key >> 32, key & 0xFFFFFFFF] += n
    assert pairs == collections.Counter(p for t in some for p in {(x, y) for a, b in brute(t) for x in a for y in b})


def test_groups_have_their_bytes_and_ids(spark, brute):
    rows = [(i, t) for i, t in enumerate(texts())]
    found = {r["doc_id"]: r["groups"] for r in alignment.token_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        expected = brute(text)
        assert [(g["a"], g["b"]) for g in found[i]] == expected
        if expected:
            edges = [0, *(g["stop"] for g in found[i])]
            assert [g["start"] for g in found[i]] == edges[:-1] and edges[-1] == len(text.encode()) + 1


def test_coarse_cuts_that_disagree_are_refined_by_bytes():
    """Characters split among tokens: spans of 4 bytes for the last of four byte pieces, or twice the same character."""
    assert alignment.refined(np.array([6, 7, 7, 7, 11]), np.array([6, 1, 1, 1, 2])).tolist() == [6, 7, 8, 9, 11]
    assert alignment.refined(np.array([4, 4, 4, 5]), np.array([2, 1, 1, 1])).tolist() == [2, 3, 4, 5]
    assert alignment.refined(np.array([2, 4, 4]), np.array([1, 2, 1])).tolist() == [1, 3, 4]
    assert alignment.refined(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_units_have_the_same_tokens_wherever_they_stand(brute):
    """Cut units, encoded alone, give the whole text's tokens."""
    t = alignment.loaded(alignment.VOCABULARY, alignment.MODEL)
    assert t.parted
    for text in texts():
        if not brute(text):
            continue
        block = alignment.spaced(tk.string_block(pa.array([text])))
        starts, ends, owner, _ = alignment.cut_units(block, t.heads)
        units = [block.data[i:j].tobytes().decode() for i, j in zip(starts, ends, strict=True)]
        assert "".join(units) == " " + text and not owner.any()
        alone = [t.tokens(u[1:]) if u[0] == " " else [x[1:] if k % 2 == 0 else x for k, x in enumerate(t.tokens("a" + u))] for u in units]
        whole = t.tokens(text)
        assert np.concatenate([x[0] for x in alone]).tolist() == whole[0].tolist() and np.concatenate([x[2] for x in alone]).tolist() == whole[2].tolist()


def test_tables_without_tokens_or_rows(spark):
    schema = "doc_id long, text string"
    nothing = spark.createDataFrame([], schema)
    assert alignment.alignment_digests(spark, nothing).collect() == [] and alignment.token_groups(nothing).collect() == []
    found = alignment.alignment_digests(spark, spark.createDataFrame([(1, None), (2, ""), (None, "▁")], schema)).collect()
    assert len(found) == 3 and all(r[c] == (0 if c != "groups_sha256" else "") for r in found for c in COLUMNS)


def test_very_long_texts(spark):
    """A megabyte without a space, and one of many words."""
    rng = random.Random(2)
    long = ["".join(rng.choice("abcdef0123456789+/") for _ in range(1_000_000)), " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(180_000))]
    found = {r["doc_id"]: r for r in alignment.alignment_digests(spark, spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    for i, text in enumerate(long):
        a, _, b, _ = alignment.loaded(alignment.VOCABULARY, alignment.MODEL).tokens(text)
        assert (found[i]["n_a"], found[i]["n_b"]) == (len(a), len(b)) and found[i]["n_groups"] > 100_000


def test_query_covers_every_document(spark, sf, brute):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = {r["doc_id"]: d for r, d in zip(rows, digests([brute(r["text"]) for r in rows]), strict=True)}
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.op13_tokenizer_alignment(spark, sf).collect()}
    assert found == expected
